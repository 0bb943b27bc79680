"""Incremental work: company counters, first-seen rows, insert-ignore batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talentgrid.operators.keyed import insert_ignore
from talentgrid.sources import stores


def read_feed(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
              files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def count_changes(changes: DataFrame) -> DataFrame:
    """(company, jobs_delta, ai_delta) per change.

    ``changes`` has company_slug, op ('insert', 'delete', 'update'), old_ai, new_ai.
    """
    op = F.col("op")
    new_ai, old_ai = F.col("new_ai").cast("int"), F.col("old_ai").cast("int")
    jobs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    ai = (
        F.when(op == "insert", F.coalesce(new_ai, F.lit(0)))
        .when(op == "delete", -F.coalesce(old_ai, F.lit(0)))
        .otherwise(F.coalesce(new_ai - old_ai, F.lit(0)))
    )
    return changes.select("company_slug", jobs.alias("jobs_delta"), ai.alias("ai_delta"))


def company_counts(changes: DataFrame) -> DataFrame:
    """Running counters per company; the same plan serves a stream and a table."""
    return count_changes(changes).groupBy("company_slug").agg(
        F.sum("jobs_delta").alias("jobs_count"), F.sum("ai_delta").alias("jobs_ai_count")
    )


def first_seen(feed: DataFrame, keys: Sequence[str], event_time: str | None = None,
               delay: str | None = None) -> DataFrame:
    """The first row of each key.

    Without a delay every key seen is remembered, so no row is lost however late it
    comes, and state grows with the keys. With one, repeats within ``delay`` of the first
    row go and state is dropped once the watermark passes: a key that comes again later
    counts anew, and rows later than the watermark are lost.
    """
    if delay is None:
        return feed.dropDuplicates(list(keys))
    return feed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def write_changes(counts: DataFrame, folder: str, checkpoint: str, key: str = "company_slug",
                  share: float = 0.5, most: int = 20) -> StreamingQuery:
    """Write the keys that a batch changed into ``folder/batch=N``; stops when caught up.

    A batch run again overwrites its own folder. ``latest_counts`` reads the table. When
    the batches since the last base hold more than ``share`` of its rows, or are more than
    ``most``, they are folded into a new one, so the table stays in proportion to its keys.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        compact_changes(batch.sparkSession, folder, number, key, share, most)

    return (
        counts.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _written(spark: SparkSession, folder: str) -> tuple[list[int], list[int]]:
    """Numbers of the bases and of the batches that were written whole."""
    found: dict[str, list[int]] = {"base": [], "batch": []}
    for name in stores.names(spark, folder):
        kind, _, number = name.partition("=")
        if kind in found and stores.exists(spark, f"{folder}/{name}/_SUCCESS"):
            found[kind].append(int(number))
    return sorted(found["base"]), sorted(found["batch"])


def _last_changes(spark: SparkSession, folder: str, base: int | None, batches: Sequence[int],
                  key: str) -> DataFrame:
    """Of each key the last row among a base and batches, with the batch it is from."""
    parts = [
        spark.read.parquet(f"{folder}/batch={n}").withColumn("_from", F.lit(n).cast("long")) for n in batches
    ]
    if base is not None:
        parts.append(spark.read.parquet(f"{folder}/base={base}"))
    rows = reduce(DataFrame.unionByName, parts)
    values = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*values), "_from").alias("_last"))
    return last.select(key, "_last.*")


def compact_changes(spark: SparkSession, folder: str, number: int, key: str, share: float,
                    most: int) -> None:
    """Fold the batches up to ``number`` into a base, if they have grown enough.

    A base has the last row of each key and counts once it is written whole. The base and
    the batches before it stay until the next one, for readers that have begun. Rows are
    states, not differences: a batch that is run again after it was folded adds nothing.
    """
    bases, batches = _written(spark, folder)
    base = max((b for b in bases if b < number), default=None)
    pending = [n for n in batches if n <= number and (base is None or n > base)]
    if base is not None and len(pending) <= most:
        held = spark.read.parquet(f"{folder}/base={base}").count()
        new = spark.read.parquet(*[f"{folder}/batch={n}" for n in pending]).count()
        if new <= share * held:
            return
    _last_changes(spark, folder, base, pending, key).write.mode("overwrite").parquet(f"{folder}/base={number}")
    for old in bases:
        if base is not None and old < base:
            stores.remove(spark, f"{folder}/base={old}")
    for old in batches:
        if base is not None and old <= base:
            stores.remove(spark, f"{folder}/batch={old}")


def latest_counts(spark: SparkSession, folder: str, key: str = "company_slug") -> DataFrame:
    """Of each key the row of the last batch that changed it: the last base and what follows."""
    bases, batches = _written(spark, folder)
    base = bases[-1] if bases else None
    later = [n for n in batches if base is None or n > base]
    return _last_changes(spark, folder, base, later, key).drop("_from")


#: Stands for a missing ``order`` while rows are sorted: after all others.
_LAST = 2**63 - 1
#: Texts of keys keep what tells two keys apart.
_KEY_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _sessions(spans: pd.DataFrame, width: int) -> pd.DataFrame:
    """Spans (_key, _at, _order, _end) of a key that lie no more than ``width`` apart, as one.

    It has the first row's _at and _order. All keys are worked through at once.
    """
    spans = spans.sort_values(["_key", "_at", "_order"], kind="stable", ignore_index=True)
    key = spans["_key"].to_numpy()
    other = np.concatenate([[True], key[1:] != key[:-1]])
    upto = spans.groupby(np.cumsum(other))["_end"].cummax().to_numpy()
    begins = other.copy()
    begins[1:] |= spans["_at"].to_numpy()[1:] - upto[:-1] > width
    starts = np.flatnonzero(begins)
    last = np.concatenate([starts[1:], [len(spans)]]) - 1
    return spans.iloc[starts].assign(_end=upto[last]).reset_index(drop=True)


def first_of_session(feed: DataFrame, keys: Sequence[str], event_time: str, order: str, gap: str,
                     delay: str, buckets: int = 1024) -> DataFrame:
    """The first row of each session of each key: (keys, event_time, order).

    Rows of a key belong to one session while no two neighbours lie more than ``gap``
    apart. The earliest row by (event_time, order) of the batch in which a session begins
    wins and is given at once; repeats within the session go. A key's state is the end of
    its session; it is dropped once the watermark, ``delay`` behind the latest row, has
    passed that end by the gap. So state holds the open sessions, not all keys ever seen.
    A row that comes late never replaces a winner, and rows later than the watermark are
    lost. Rows without an event time are no part of any session. ``order`` is a whole number.

    Keys fall into ``buckets`` by their hash. A bucket is one row of state with one timer and
    one call in Python for all its keys that a batch brings; the number stays with a checkpoint.
    """
    width = int(pd.Timedelta(gap).value // 1000)
    kinds = {f.name: f.dataType.simpleString() for f in feed.schema}
    rows = feed.where(F.col(event_time).isNotNull()).select(
        event_time, F.unix_micros(F.col(event_time)).alias("_at"), _bucket(keys, buckets).alias("_bucket"),
        F.to_json(F.struct(*keys), _KEY_TEXT).alias("_key"),
        F.coalesce(F.col(order).cast("long"), F.lit(_LAST)).alias("_order"),
    ).withWatermark(event_time, delay)

    def keep(state: GroupState, ends: pd.Series) -> None:
        # A key goes by the time at which its own timer would have gone off.
        mark = state.getCurrentWatermarkMs()
        over = (ends + width) // 1000 + 1
        ends = ends[over > mark]
        if not len(ends):
            if state.exists:
                state.remove()
            return
        state.update((pickle.dumps((ends.index.tolist(), ends.tolist())),))
        state.setTimeoutTimestamp(max(int(over[over > mark].min()), mark + 1))

    def begun(_: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, ends = pickle.loads(bytes(state.get[0])) if state.exists else ([], [])
        last = pd.Series(ends, index=pd.Index(held, dtype=object), dtype="int64")
        if state.hasTimedOut:
            keep(state, last)
            return
        # Sessions of this batch. Chunks of a bucket's rows come in any order, so they are
        # folded into the sessions found before, as soon as they are more than these.
        found, pending = None, []
        for chunk in chunks:
            pending.append(chunk[["_key", "_at", "_order"]].assign(_end=chunk["_at"]))
            if sum(map(len, pending)) > max(50_000, 0 if found is None else len(found)):
                found, pending = _sessions(pd.concat([*([] if found is None else [found]), *pending]), width), []
        if pending:
            found = _sessions(pd.concat([*([] if found is None else [found]), *pending]), width)
        at = last.index.get_indexer(found["_key"])
        before = last.to_numpy()[at] if len(last) else 0
        new = found[(at < 0) | (found["_at"].to_numpy() - before > width)]
        now = found.groupby("_key")["_end"].max()
        keep(state, pd.concat([last, now]).groupby(level=0).max())
        if len(new):
            yield new[["_key", "_at", "_order"]]

    winners = rows.groupBy("_bucket").applyInPandasWithState(
        begun, "_key string, _at long, _order long", "open binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    layout = T.StructType([feed.schema[k] for k in keys])
    return winners.select(
        F.from_json("_key", layout, _KEY_TEXT).alias("_named"), F.timestamp_micros("_at").cast(kinds[event_time]).alias(event_time),
        F.nullif(F.col("_order"), F.lit(_LAST)).cast(kinds[order]).alias(order),
    ).select(*[F.col("_named")[k].alias(k) for k in keys], event_time, order)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, not in the JVM's heap."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def append_rows(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.outputMode("append").format("parquet").option("path", folder)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_table(rows: DataFrame, folder: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Append rows to a table that is laid out by buckets of its keys."""
    placed = rows.withColumn("_bucket", _bucket(keys, buckets))
    placed.write.mode("append").partitionBy("_bucket").parquet(folder)


def insert_batches(feed: DataFrame, folder: str, checkpoint: str, keys: Sequence[str],
                   order: Callable[[], Sequence[Column]], buckets: int = 64) -> StreamingQuery:
    """Append each batch's new keys to the table in ``folder``; stored keys win.

    The table comes from ``write_table``; a batch reads only the buckets its own keys
    fall into. A batch run again after a failure finds its rows stored and adds nothing.
    """

    def save(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        touched = [
            r[0] for r in batch.select(_bucket(keys, buckets)).distinct().collect()
        ]  # at most ``buckets`` numbers
        layout = T.StructType([*batch.schema.fields, T.StructField("_bucket", T.IntegerType())])
        stored = spark.read.schema(layout).parquet(folder).where(F.col("_bucket").isin(touched))
        write_table(insert_ignore(stored, batch, keys, order()), folder, keys, buckets)

    return (
        feed.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
