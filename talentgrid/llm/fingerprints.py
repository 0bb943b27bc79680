"""Document fingerprints: SimHash, and block tables that find near fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import no_null, partitions
from talentgrid.session import settle

BITS = 256
#: Fingerprints at most this many bits apart are near. The README has the
#: distances of texts with replaced words; 31 is the most that 16 blocks of two bytes find with one bit probed.
RADIUS = 31
#: Fingerprints of a shared byte that are compared with one another at a time.
BLOCK = 4096

_WORDS = BITS // 64
_MIX = np.random.default_rng(41).integers(1, 2**63, _WORDS + 2, np.uint64) * np.uint64(2) + np.uint64(1)


def weighted_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of a text's words and pairs of neighbouring words.

    A pair counts twice as much as a word; a term found n times counts 1 + ln n.
    """
    words = text.lower().split()
    single = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    pairs = (single[:-1] * _MIX[-1] ^ single[1:]) * _MIX[-2]
    hashes, weights = [], []
    for terms, weight in ((single, 0.5), (pairs, 1.0)):
        distinct, times = np.unique(terms, return_counts=True)
        hashes.append(distinct)
        weights.append(weight * (1 + np.log(times)))
    return np.concatenate(hashes), np.concatenate(weights).astype(np.float32)


def simhash(text: str) -> np.ndarray:
    """The fingerprint as ``BITS`` / 64 numbers; a text without words gives zeros.

    Every term's hash votes on each bit with its weight, for 1 or against; the sign of
    the sum is the bit. Even sums count as 0.
    """
    hashes, weights = weighted_terms(text)
    if not len(hashes):
        return np.zeros(_WORDS, np.uint64)
    votes = np.zeros(BITS, np.float64)
    for start in range(0, len(hashes), 8192):
        wide = (hashes[start : start + 8192, None] ^ (hashes[start : start + 8192, None] >> np.uint64(31))) * _MIX[:_WORDS]
        wide ^= wide >> np.uint64(32)
        bits = np.unpackbits(wide.astype(">u8").view(np.uint8), axis=1)
        votes += weights[start : start + 8192] @ bits.astype(np.float32)
    on = votes > float(weights.sum()) / 2 + 1e-3
    return np.packbits(on).view(">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bits."""
    return 1.0 - int(np.bitwise_count(a ^ b).sum()) / BITS


def _hex(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u8").tobytes().hex()


SIGNED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket in order, each bucket followed by the head of the next."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
         ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
         ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )
    waiting: tuple | None = None  # (bucket, doc_id, text, fingerprint) without a next yet
    for batch in batches:
        rows = []
        columns = [batch.column(c) for c in ("bucket", "extra", "doc_id", "text")]
        for bucket, extra, doc_id, text in zip(*columns):
            bucket, extra, doc_id = bucket.as_py(), extra.as_py(), doc_id.as_py()
            if extra and waiting is None:
                continue  # further rows that share the head's id
            text = text.as_py()
            own = simhash(text)
            if waiting is not None:
                _, before_id, before, mark = waiting
                changed = _edited(before, text)
                changed_mark = simhash(changed)
                rows.append(
                    (before_id, len(before), hashlib.sha256(changed.encode()).hexdigest(),
                     _hex(mark), _hex(changed_mark), likeness(mark, changed_mark),
                     likeness(mark, own))
                )
            waiting = None if extra else (bucket, doc_id, text, own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema
        )


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, extra, key, doc_id, text): documents in order, for one pass per bucket.

    Ids are cut at their approximate quantiles into descending buckets. The largest id of
    a bucket is also dealt, as extra, to the bucket before it (to the last, if it is
    the first), so every document meets its next one; texts are shuffled once.
    """
    spark = docs.sparkSession
    lowest = -(2**63)
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), no_null().alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"),
    )
    buckets = 4 * partitions(spark)
    shares = [i / buckets for i in range(1, buckets)]
    bounds = keyed.agg(F.percentile_approx("key", shares, 50_000).alias("b")).first()["b"] or []
    cuts = np.unique(np.array(bounds, np.int64))

    @F.pandas_udf("int")
    def bucket_of(keys: pd.Series) -> pd.Series:
        # Descending: the largest keys are in bucket 0.
        return pd.Series(len(cuts) - np.searchsorted(cuts, keys.to_numpy(np.int64), "right")).astype("int32")

    placed = keyed.withColumn("bucket", bucket_of("key"))
    # At most one row per bucket, whatever the table's size.
    found = placed.groupBy("bucket").agg(F.max("key").alias("key")).orderBy("bucket").collect()
    heads = [(r["key"], found[i - 1]["bucket"]) for i, r in enumerate(found)]
    extra = spark.createDataFrame(heads, "key long, before int")
    both = placed.join(F.broadcast(extra), "key", "left")
    dealt = F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("extra")),
        F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra")),
    )
    return both.select(
        "key", "doc_id", "text", F.inline(F.filter(dealt, lambda d: d["bucket"].isNotNull()))
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The next document is the next lower doc_id, null ids last, ties by text; the last
    is followed by the first, a single one by itself. Null texts count as empty. Equal
    texts have equal fingerprints; an empty table gives no row.
    """
    ordered = with_next(docs).repartition(
        partitions(docs.sparkSession), "bucket"
    ).sortWithinPartitions("bucket", "extra", F.desc("key"), "text")
    return ordered.select("bucket", "extra", "doc_id", "text").mapInArrow(_signer, SIGNED)


def _compare(radius: int):
    """For the fingerprints of a cell: how many documents of it are near each of them.

    A cell holds one or two lists of fingerprints with a byte in common. Only pairs whose
    sibling byte (of the same block of two) differs in at most one bit are measured.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                place = batch.column("place")[i].as_py()
                rows = batch.column("rows")[i].values
                joined = b"".join(rows.field("mark").to_pylist())
                bytes_ = np.frombuffer(joined, np.uint8).reshape(-1, BITS // 8)
                marks = bytes_.view(">u8").astype(np.uint64)
                times = rows.field("times").to_numpy()
                side = rows.field("side").to_numpy()
                sibling = np.ascontiguousarray(bytes_[:, place ^ 1])
                near = np.zeros(len(marks), np.int64)
                # Rows of one list in a cell of two meet in that list's own cell.
                lists = [np.flatnonzero(side == k) for k in np.unique(side)]
                left, right = (lists[0], lists[-1])
                for start in range(0, len(left), 256):
                    some = left[start : start + 256]
                    close = np.bitwise_count(sibling[some, None] ^ sibling[None, right]) <= 1
                    x, y = np.nonzero(close)
                    x, y = some[x], right[y]
                    distance = np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1, dtype=np.int64)
                    hit = (distance <= radius) & (distance > 0)
                    x, y = x[hit], y[hit]
                    # A pair counts in the first place that finds it.
                    off = np.bitwise_count(bytes_[x] ^ bytes_[y])
                    swapped = off.reshape(-1, BITS // 16, 2)[:, :, ::-1].reshape(off.shape)
                    first = ((off == 0) & (swapped <= 1)).argmax(axis=1) == place
                    x, y = x[first], y[first]
                    near += np.bincount(x, times[y], len(marks)).astype(np.int64)
                    if len(lists) == 2:
                        near += np.bincount(y, times[x], len(marks)).astype(np.int64)
                found = np.flatnonzero(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bytes_[j].tobytes() for j in found], pa.binary()), pa.array(near[found])],
                    ["mark", "near"],
                )

    return compare


def near_counts(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, n_near): other rows with a fingerprint at most ``radius`` bits away.

    ``fingerprints`` has one row per document. Equal fingerprints are counted as one first.
    Of 16 blocks of two bytes at least one differs in at most ``radius`` // 16 bits; for
    1 or 0, one of its bytes is equal and the other at most a bit off. So fingerprints
    are dealt by each of their 32 bytes, and the other byte is probed in the task. What
    shares a byte is cut into lists of about ``BLOCK``, and each pair of lists meets in a
    cell of its own: exact for a byte shared by any number.
    """
    if not 0 <= radius < BITS // 8:
        raise ValueError(f"radius must be in 0..{BITS // 8 - 1}")
    distinct = fingerprints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("times"))
    marked = settle(
        distinct.select(F.unhex("fingerprint").alias("mark"), "times", F.xxhash64("fingerprint").alias("id")),
        "marks",
    )
    places = F.transform(
        F.sequence(F.lit(0), F.lit(BITS // 8 - 1)),
        lambda t: F.struct(t.alias("place"), F.substring("mark", t + 1, F.lit(1)).alias("byte")),
    )
    keys = marked.select("mark", "times", "id", F.inline(places))
    # One row per place and byte: 8,192 at most.
    sizes = keys.groupBy("place", "byte").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("lists")
    )
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("lists")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("lists") - 1),
        lambda other: F.struct(
            F.least("own", other).alias("low"), F.greatest("own", other).alias("high")
        ),
    )
    dealt = (
        keys.join(F.broadcast(sizes), ["place", "byte"]).withColumn("own", own)
        .select("place", "byte", "own", "mark", "times", F.inline(cells))
        .groupBy("place", "byte", "low", "high")
        .agg(F.collect_list(F.struct("mark", "times", F.col("own").alias("side"))).alias("rows"))
    )
    # A cell of two lists where one has no row has no pair of its own.
    whole = (F.col("low") == F.col("high")) | (
        F.size(F.array_distinct(F.transform("rows", lambda r: r["side"]))) == 2
    )
    found = dealt.where(whole).select("place", "rows").mapInArrow(
        _compare(radius), "mark binary, near long"
    )
    others = found.groupBy("mark").agg(F.sum("near").alias("near"))
    return marked.join(others, "mark", "left").select(
        F.lower(F.hex("mark")).alias("fingerprint"),
        (F.col("times") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"),
    )


def with_near_counts(signed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprinted documents with the number of others near each."""
    stored = settle(signed, "fingerprints")
    return stored.join(near_counts(stored.select("fingerprint"), radius), "fingerprint")
