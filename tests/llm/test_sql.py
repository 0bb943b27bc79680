"""Queries with SQL give its rows; all queries run on the smallest tables."""

import hashlib
import zlib

import duckdb
import pytest

from talentgrid.llm.queries import LLM_ORACLE, LLM_QUERIES


def duck(sf_dir):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_same_rows(spark, name, sf):
    sf_dir = f"/root/testdata/{sf}"
    df = LLM_QUERIES[name](spark, sf_dir)
    cursor = duck(sf_dir).execute(LLM_ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(cursor.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == want and want


def test_queries_each_named_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES)
    assert numbers == list(range(1, 14))


def test_documents_queries_return_each_document(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for name in ("op1_simhash", "op2_sharding", "op3_language_id", "op4_token_counts", "op6_minmax_neardup", "op9_pseudonyms"):
        rows = LLM_QUERIES[name](spark, sf_dir).collect()
        assert sorted(r.doc_id for r in rows) == sorted(docs), name
        if name == "op2_sharding":
            assert all(r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)


def test_chat_query_holds_all_conversations(spark):
    sf_dir = "/root/testdata/sf0.001"
    said = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        said.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    said[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    rows = {r.conv_id: r for r in LLM_QUERIES["op10_chat_format"](spark, sf_dir).collect()}
    assert rows.keys() == said.keys()
    for k, turns in said.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        text = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert rows[k].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert rows[k].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert (rows[k].n_turns, rows[k].loss_chars) == (len(turns), len(learned))
