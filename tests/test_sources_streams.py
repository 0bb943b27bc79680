import datetime
import json
import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from talentgrid.operators import titles
from talentgrid.sources import payloads, stores, tables
from talentgrid.streaming import feeds


def test_payload_flattening(spark):
    entry = {
        "job": {"slug": "j1", "title": "T", "city": "Paris", "country": "France",
                "skills": "Python, SQL,", "tools": "Git", "type": "Full Time, Remote",
                "published": "0001-01-01T00:00:00Z", "created_at": "2024-01-02T03:04:05Z"},
        "company": {"name": "Acme", "slug": "acme"}, "location": "", "types": ["Other"],
    }
    second = {"job": {"slug": "j2"}, "company": {"slug": "acme", "name": "Later"}, "types": ["Remote"]}
    dropped = [{"job": {"slug": "x"}}, {"job": {"slug": "y"}, "company": {}},
               {"company": {"slug": "z"}}, {"job": {"title": "no slug"}, "company": {"slug": "w"}}]
    pages = spark.createDataFrame(
        [(1, json.dumps([entry, second, *dropped])), (2, "[]"), (3, None)], "page int, body string")
    flat = payloads.flatten_postings(pages, "body", "page")
    jobs = {r["slug"]: r for r in flat["jobs"].collect()}
    assert set(jobs) == {"j1", "j2"}
    j = jobs["j1"]
    assert j["location"] == "Paris, France" and j["skills"] == ["Python", "SQL"]
    assert j["types"] == ["Full Time", "Remote"] and j["published"] is None and j["created_at"]
    assert (j["ai"], j["salary_min"], j["libraries"]) == (False, 0, [])
    assert jobs["j2"]["types"] == ["Remote"] and jobs["j2"]["location"] == ""
    companies = {r["slug"]: r["name"] for r in flat["companies"].collect()}
    assert companies == {"acme": "Acme", "w": None}
    details = {tuple(r) for r in flat["job_skills_detail"].collect()}
    assert details == {("j1", "Python", "technical"), ("j1", "SQL", "technical"), ("j1", "Git", "tool")}


def test_star_first_wins(spark):
    def doc(i, name):
        return json.dumps({
            "id": i, "title": f"t{i}", "company": {"id": 7, "name": name},
            "types": [{"id": 1, "name": name}, {"name": "no id"}],
            "countries": [{"id": 3, "code": "FR", "region": {"id": 9, "name": "EU"}}],
            "cities": [{"geonameid": 5, "name": "Paris", "latitude": 48.85, "country": {"code": "FR"}}],
        })
    raw = spark.createDataFrame([(1, doc(10, "first")), (2, doc(11, "second")), (3, doc(10, "again")),
                                 (4, json.dumps({"title": "no id"}))], "line int, body string")
    star = payloads.normalize_star(raw, "body", "line")
    assert {n: df.count() for n, df in star.items()} == {
        "rejected": 1, "companies": 1, "types": 1, "job_to_types": 2, "countries": 1, "locations": 1,
        "job_locations": 2, "jobs": 2}
    assert star["companies"].collect()[0]["name"] == "first"
    assert star["types"].collect()[0]["name"] == "first"
    assert float(star["locations"].collect()[0]["latitude"]) == 48.85


def test_exchange_rates(spark):
    raw = spark.createDataFrame([(1, '{"EUR": 0.5, "USD": 3, "ZZZ": 0}')], "day int, body string")
    got = {r["currency_code"]: float(r["rate_to_usd"])
           for r in payloads.exchange_rate_rows(raw, "day", "body").collect()}
    assert got == {"EUR": 2.0, "USD": 1.0}


def test_files_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", ["x", 'y"z'], " "), ("b", None, None)], "k string, l array<string>, t string")
    tables.write_csv(df, str(tmp_path / "c"))
    back = spark.read.schema("k string, l string, t string").options(header=True, escape='"').csv(str(tmp_path / "c"))
    assert rows(back) == [("a", '["x","y\\"z"]', " "), ("b", None, None)]
    tables.write_parquet(df, str(tmp_path / "p"))
    assert tables.read_parquet_table(spark, str(tmp_path / "p"), "k").columns == ["k"]
    with pytest.raises(AnalysisException):
        tables.read_csv_postings(spark, str(tmp_path / "missing")).count()


def test_nearest_category(spark, rows):
    labelled = spark.createDataFrame([("A", [2.0, 0.0]), ("A", [4.0, 0.0]), ("B", [0.0, 1.0])],
                                     "label string, v array<double>")
    centroids = titles.category_centroids(labelled, "label", "v")
    jobs = spark.createDataFrame([(1, [9.0, 1.0]), (2, [-1.0, -1.0]), (3, [1.0, 1.0]), (4, None)],
                                 "id int, v array<double>")
    got = rows(titles.nearest_category(jobs, "v", titles.category_model(centroids)), "id", "standardized_title")
    assert got == [(1, "A"), (2, "Other"), (3, "A"), (4, "Other")]
    model = titles.category_model(centroids)
    assert titles.similarity_matrix(jobs, "id", "v", model).count() == 8


def test_more_than_a_thousand_categories(spark):
    vectors = np.random.default_rng(1).normal(size=(1203, 8))
    names = [f"c{i:04}" for i in range(1203)]
    model = titles.CategoryModel(tuple(names), vectors)
    jobs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, v array<double>")
    found = titles.nearest_category(jobs, "v", model).collect()
    assert all(r.standardized_title == names[r.id] for r in found)


def test_counts_stream_equals_batch(spark, tmp_path, rows):
    schema = "company_slug string, op string, old_ai boolean, new_ai boolean"
    data = [("a", "insert", None, True), ("a", "insert", None, False), ("a", "update", False, True),
            ("a", "delete", True, None), ("b", "insert", None, True), ("b", "update", True, False),
            ("b", "update", True, True)]
    changes = spark.createDataFrame(data, schema)
    source = str(tmp_path / "in")
    changes.repartition(3).write.parquet(source)
    feed = feeds.read_feed(spark, source, changes.schema, files_per_batch=1)
    out = str(tmp_path / "out")
    feeds.write_changes(feeds.company_counts(feed), out, str(tmp_path / "state")).awaitTermination()
    assert rows(feeds.latest_counts(spark, out)) == rows(feeds.company_counts(changes)) == [("a", 1, 1), ("b", 1, 0)]


def test_insert_stream_keeps_stored_rows(spark, tmp_path, rows):
    events = spark.createDataFrame([(i, f"u{i % 4}") for i in range(40)], "event_id int, user string")
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    events.repartition(4).write.parquet(source)
    feeds.write_table(spark.createDataFrame([(-1, "u0")], events.schema), table, ["user"])
    for _ in range(2):
        feed = feeds.read_feed(spark, source, events.schema, files_per_batch=1)
        state = str(tmp_path / f"state{_}")
        feeds.insert_batches(feed, table, state, ["user"], lambda: [F.asc("event_id")]).awaitTermination()
    stored = spark.read.parquet(table)
    assert stored.count() == 4 and stored.where("event_id = -1").count() == 1


def test_first_seen_stream(spark, tmp_path):
    events = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"),
                                    ("b", "2024-01-01 00:02:00")], "k string, t string").selectExpr(
        "k", "CAST(t AS timestamp) AS t")
    source = str(tmp_path / "in")
    events.write.parquet(source)
    feed = feeds.read_feed(spark, source, events.schema)
    out = str(tmp_path / "out")
    feeds.append_rows(feeds.first_seen(feed, ["k"], "t", "1 day"), out, str(tmp_path / "s")).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def _deliver(spark, rows, source, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)


def test_changes_stay_in_proportion_to_keys(spark, tmp_path):
    """200 batches over 30 keys; the counts are those of all of them."""
    folder, keys = str(tmp_path / "out"), 30
    want, draw = {}, np.random.default_rng(2)
    largest = 0
    for number in range(200):
        changed = {int(k): number * 100 + int(k) for k in draw.integers(0, keys, 4)}
        want |= changed
        batch = spark.createDataFrame([(f"c{k:02}", v) for k, v in changed.items()], "company_slug string, jobs_count long")
        batch.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        feeds.compact_changes(spark, folder, number, "company_slug", 0.5, 20)
        if number % 40 == 39:
            held = sum(spark.read.parquet(f"{folder}/{n}").count() for n in stores.names(spark, folder))
            largest = max(largest, held)
            got = {r.company_slug: r.jobs_count for r in feeds.latest_counts(spark, folder).collect()}
            assert got == {f"c{k:02}": v for k, v in want.items()}
    assert largest <= 4 * keys
    # The last batch once more, as after a failure between its two steps.
    before = sorted(map(tuple, feeds.latest_counts(spark, folder).collect()))
    batch.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch=199")
    feeds.compact_changes(spark, folder, 199, "company_slug", 0.0, 0)
    assert sorted(map(tuple, feeds.latest_counts(spark, folder).collect())) == before
    # A base that was not written whole doesn't count.
    spark.createDataFrame([("c00", -1, 500)], "company_slug string, jobs_count long, _from long").write.parquet(f"{folder}/base=300")
    (tmp_path / "out" / "base=300" / "_SUCCESS").unlink()
    assert sorted(map(tuple, feeds.latest_counts(spark, folder).collect())) == before


def _session_starts(rows, gap):
    """(key, id) of the first row of each session, by a plain scan."""
    last, first = {}, []
    for key, at, number in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if key not in last or (at - last[key]).total_seconds() > gap:
            first.append((key, number))
        last[key] = at
    return sorted(first, key=str)


@pytest.mark.parametrize("batch_rows", [None, 7])
def test_first_of_each_session(spark, tmp_path, batch_rows):
    draw, schema = random.Random(3), "k string, ts timestamp, id long"
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        at = start + datetime.timedelta(minutes=draw.randint(0, 6 * 1440))
        rows.append((draw.choice(["hot"] * 6 + ["a", "b", None]), at, i))
    rows += [("edge", start + datetime.timedelta(hours=3 * i), 1000 + i) for i in range(4)]
    rows += [("a", None, 2000), rows[0]]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or start))
    if batch_rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        with feeds.state_on_disk(spark):
            for part in range(4):
                own = ordered[part * len(ordered) // 4: (part + 1) * len(ordered) // 4]
                draw.shuffle(own)
                _deliver(spark, own, source, schema)
                feed = feeds.read_feed(spark, source, "k string, ts timestamp, id long")
                first = feeds.first_of_session(feed, ["k"], "ts", "id", "3 hours", "1 minute")
                feeds.append_rows(first, out, state).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = spark.read.parquet(out).collect()
    assert sorted(((r.k, r.id) for r in found), key=str) == _session_starts(rows, 3 * 3600)
    at = {r[2]: r[1] for r in rows}
    assert all(r.ts == at[r.id] for r in found)


def test_state_ends_with_the_session(spark, tmp_path):
    """Keys of sessions that are over leave the state; a key that comes back begins anew."""
    schema, start = "k string, ts timestamp, id long", datetime.datetime(2024, 1, 1)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    left = []
    for day in range(4):
        own = [(f"day{day}-{i}", start + datetime.timedelta(days=day, minutes=i), day * 100 + i) for i in range(20)]
        own.append(("daily", start + datetime.timedelta(days=day), day * 100 + 50))
        _deliver(spark, own, source, schema)
        feed = feeds.read_feed(spark, source, schema)
        with feeds.state_on_disk(spark):
            query = feeds.append_rows(feeds.first_of_session(feed, ["k"], "ts", "id", "1 hour", "1 minute"), out, state)
            query.awaitTermination()
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(left) <= 42
    assert spark.read.parquet(out).where("k = 'daily'").count() == 4
    assert spark.read.parquet(out).count() == 84


def test_keys_of_sessions_share_rows_of_state(spark, tmp_path):
    """A batch makes one call and one row of state a bucket, not a key; keys come back as they were."""
    draw, schema = random.Random(5), "k string, n long, ts timestamp, id long"
    start, large = datetime.datetime(2024, 1, 1), 2**53 + 1
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    keys = [(f"k{i % 40}", large + i) for i in range(120)] + [(None, large), ("k1", None), (None, None), ('a"\\', 0)]
    rows = [(k, start + datetime.timedelta(minutes=draw.randint(0, 600)), i) for i, k in enumerate(keys * 5)]
    rows.sort(key=lambda r: r[1])
    for own in (rows[:250], rows[250:]):
        _deliver(spark, [(*k, at, i) for k, at, i in own], source, schema)
        first = feeds.first_of_session(
            feeds.read_feed(spark, source, schema), ["k", "n"], "ts", "id", "2 hours", "1 minute", buckets=3
        )
        with feeds.state_on_disk(spark):
            query = feeds.append_rows(first, out, state)
            query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    found = spark.read.parquet(out).collect()
    assert sorted((((r.k, r.n), r.id) for r in found), key=str) == _session_starts(rows, 2 * 3600)


def test_every_entry_is_a_job_or_rejected(spark):
    job = {"job": {"slug": "a"}, "company": {"slug": "c"}}
    entries = [job, {"job": {}, "company": {"slug": "c"}}, {"job": {"slug": "b"}}, {"job": {"title": "t"}, "company": {"slug": "w"}},
               None, {"job": {"slug": "d"}, "company": {"slug": "c"}}]
    whole = json.dumps(entries)
    pages = [(1, whole), (2, whole[:-20]), (3, None), (4, "  "), (5, '"text"'), (6, "[]"), (7, "{{"), (8, json.dumps([job]))]
    df = spark.createDataFrame(pages, "page int, body string")
    flat = payloads.flatten_postings(df, "body", "page")
    rejected = {(r.page, r.entry): r.reason for r in flat["rejected"].collect()}
    assert rejected == {
        (1, 1): "no job", (1, 2): "no company", (1, 3): "no slug", (1, 4): "no job", (2, None): "no JSON",
        (3, None): "empty", (4, None): "empty", (5, None): "other JSON", (7, None): "no JSON",
    }
    assert {r.length for r in flat["rejected"].where("page = 1").collect()} == {len(whole)}
    # Entries in are rows out and rejected ones; pages that were read are the rest.
    assert flat["jobs"].count() + sum(k[1] is not None for k in rejected) == len(entries) + 1
    assert {r.slug for r in flat["companies"].collect()} == {"c", "w"}
    plan = payloads.classified_entries(df, "body", "page")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(ArrayType") <= 1


def test_lines_of_the_second_source_are_read_or_rejected(spark):
    lines = [(1, json.dumps({"id": 5, "title": "t"})), (2, '{"id": 6'), (3, ""), (4, "{}"), (5, None), (6, "[1]"),
             (7, json.dumps({"id": 0})), (8, json.dumps({"id": 5, "title": "again"})), (9, json.dumps({"title": "none"}))]
    star = payloads.normalize_star(spark.createDataFrame(lines, "line int, body string"), "body", "line")
    got = {r.line: r.reason for r in star["rejected"].collect()}
    assert got == {2: "no JSON", 3: "empty", 4: "no id", 5: "empty", 6: "no id", 7: "no id", 9: "no id"}
    assert [(r.id, r.title) for r in star["jobs"].collect()] == [(5, "t")]
    assert len(got) + 2 == len(lines)
