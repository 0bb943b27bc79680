"""Approximate nearest neighbours by cross-polytope hashing.

A table turns a vector by three rounds of random signs and a fast Hadamard transform and
names the nearest signed axis. A query looks, in every table, into the buckets of the axes
that it lies nearest to itself, in that order (multiprobe). All that it meets there is
scored exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talentgrid.llm.vectors import block_numbers, hashed_block, matrix, one_length, one_row_per_id, sound
from talentgrid.session import settle

TABLES = 8
SEED = 12
#: Queries on which the number of probes is fitted, and the share of neighbours to find there.
FITTED = 64
RECALL = 0.95
#: Rows, and queries, that meet in one task.
BLOCK = 2048
TILE = 256

_FOUND = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalized Walsh-Hadamard transform of each row, by n log n additions."""
    n, dims = x.shape
    out, half = np.array(x, np.float64), 1
    while half < dims:
        pairs = out.reshape(n, dims // (2 * half), 2, half)
        out = np.stack(
            [pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2
        ).reshape(n, dims)
        half *= 2
    return out / math.sqrt(dims)


def table_signs(tables: int, dims: int, seed: int = SEED) -> np.ndarray:
    """[tables, 3, width] signs; the width is the next power of two."""
    width = 1 << max(0, dims - 1).bit_length()
    draw = np.random.Generator(np.random.PCG64([seed, tables, width]))
    return draw.integers(0, 2, (tables, 3, width)) * 2.0 - 1.0


def turned(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows under one table's pseudo-rotation."""
    out = np.pad(vectors, ((0, 0), (0, signs.shape[1] - vectors.shape[1])))
    for flip in signs:
        out = hadamard(out * flip)
    return out


def axis_codes(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """[rows, tables]: 2 * axis, plus 1 where the nearest signed axis is negative."""
    codes = np.empty((len(vectors), len(signs)), np.int32)
    for t, own in enumerate(signs):
        out = turned(vectors, own)
        axis = np.abs(out).argmax(axis=1)
        codes[:, t] = 2 * axis + (out[np.arange(len(out)), axis] < 0)
    return codes


def probe_order(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """[rows, tables, codes]: all codes of a table, the nearest axis first."""
    order = np.empty((len(vectors), len(signs), 2 * signs.shape[2]), np.int32)
    for t, own in enumerate(signs):
        out = turned(vectors, own)
        near = np.stack([out, -out], axis=2).reshape(len(out), -1)
        order[:, t] = np.argsort(-near, axis=1, kind="stable")
    return order


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in order: equal rows give equal bits."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def best_rows(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, most: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``most`` best rows of each query, its own id left out."""
    parts = []
    norms = np.sqrt((rows**2).sum(axis=1).max(initial=0.0))
    for start in range(0, len(queries), TILE):
        q, own = queries[start: start + TILE], query_ids[start: start + TILE]
        rough = q @ rows.T
        rough[own[:, None] == ids[None, :]] = -np.inf
        if rough.shape[1] > most:
            last = -np.partition(-rough, most - 1, axis=1)[:, most - 1]
            # The product above rounds otherwise than the exact one: keep what may be level.
            slack = 1e-9 * np.sqrt((q**2).sum(axis=1)) * norms
            keep = (rough >= (last - slack)[:, None]) & (rough > -np.inf)
        else:
            keep = rough > -np.inf
        i, j = np.nonzero(keep)
        score = exact_products(q[i], rows[j])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        there = place < most
        parts.append((i[there] + start, j[there], score[there]))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _hasher(signs: np.ndarray, dims: int):
    def sign(batches):
        for batch in batches:
            codes = axis_codes(matrix(batch.column("embedding"), dims), signs)
            offsets = np.arange(len(codes) + 1, dtype=np.int32) * len(signs)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"), listed],
                ["vec_id", "embedding", "codes"],
            )

    return sign


def _prober(signs: np.ndarray, dims: int, probes: int):
    """One row for each query and table, with the codes to look into."""

    def probe(batches):
        for batch in batches:
            order = probe_order(matrix(batch.column("embedding"), dims), signs)[:, :, :probes]
            n, tables, wide = order.shape
            offsets = np.arange(n * tables + 1, dtype=np.int32) * wide
            rows = pa.array(np.repeat(np.arange(n), tables))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(rows), batch.column("embedding").take(rows),
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), n)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.ravel())),
                ],
                ["query_id", "query", "table", "codes"],
            )

    return probe


def _fitter(ids: np.ndarray, queries: np.ndarray, signs: np.ndarray, dims: int, most: int):
    """The best rows of a batch for the fitted queries, and the probes that each needs."""
    order = probe_order(queries, signs)
    places = np.empty_like(order)
    np.put_along_axis(places, order, np.arange(order.shape[2], dtype=np.int32)[None, None], axis=2)

    def fit(batches):
        for batch in batches:
            own = np.asarray(batch.column("vec_id"))
            i, j, score = best_rows(queries, ids, matrix(batch.column("embedding"), dims), own, most)
            codes = matrix(batch.column("codes"), len(signs)).astype(np.int64)[j]
            needed = places[i[:, None], np.arange(len(signs))[None], codes].min(axis=1, initial=1 << 30) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[i]), pa.array(own[j]), pa.array(score), pa.array(needed.astype(np.int32))],
                ["query_id", "vec_id", "score", "needed"],
            )

    return fit


def _searcher(dims: int, most: int):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.table(
                {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                 "score": pa.array([], pa.float64())}
            )
        ids, own = rows.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        i, j, score = best_rows(
            matrix(queries.column("query"), dims), own, matrix(rows.column("embedding"), dims), ids, most
        )
        return pa.table({"query_id": own[i], "vec_id": ids[j], "score": score})

    return search


def fitted_probes(hashed: DataFrame, queries: DataFrame, signs: np.ndarray, dims: int, most: int) -> int:
    """The fewest probes a table that find ``RECALL`` of the true neighbours of a sample.

    The sample is the ``FITTED`` queries of the smallest hash; their neighbours come from
    all rows by brute force, so the work is in proportion to the table. The driver gets
    the sample and ``most`` small rows a query.
    """
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FITTED).collect()
    if not sample:
        return 1
    ids = np.array([r["vec_id"] for r in sample], np.int64)
    vectors = np.array([list(r["embedding"]) for r in sample], np.float64)
    found = hashed.mapInArrow(
        _fitter(ids, vectors, signs, dims, most), f"{_FOUND}, needed int"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    needed = [
        r["needed"]
        for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        .select("needed").collect()
    ]
    return int(np.quantile(needed, RECALL, method="higher")) if needed else 1


def _found_in_buckets(hashed: DataFrame, probes: DataFrame, dims: int, most: int) -> DataFrame:
    """The best rows of each query in each block of each bucket that it looks into.

    ``probes``: query_id, query, table, code. Buckets are as many as a table's signed axes;
    one that holds a large share of the rows is cut into blocks by the hash of the ids, on
    either side, and every two blocks meet in one task.
    """
    entries = hashed.select("vec_id", "embedding", F.posexplode("codes").alias("table", "code"))
    key = ["table", "code"]
    # tables * 2 * width rows at most.
    sizes = (
        entries.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        .join(probes.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("chunks")), key)
    )
    sizes = F.broadcast(settle(sizes, "bucket-sizes"))
    left = entries.join(sizes, key).select(
        "table", "code", hashed_block(F.col("blocks"), "vec_id").alias("block"),
        block_numbers(F.col("chunks")).alias("chunk"), "vec_id", "embedding",
    )
    right = probes.join(sizes, key).select(
        "table", "code", hashed_block(F.col("chunks"), "query_id").alias("chunk"),
        block_numbers(F.col("blocks")).alias("block"), "query_id", "query",
    )
    cell = ("table", "code", "block", "chunk")
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        _searcher(dims, most), _FOUND
    )


def _first(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best different rows of each query; several tables may give one row."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= most)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").distinct()
    )


def nearest(vectors: DataFrame, query: str, most: int = 20, tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``most`` nearest rows found for each query.

    ``vectors`` has vec_id and embedding; rows for which the SQL condition ``query`` holds
    are the queries, all rows but its own are a query's candidates. Nearness is the inner
    product in doubles, ties go to the smaller id. Hashing looks at directions, so the
    rows' lengths should not differ much.

    Rows with a null id, a null, empty or zero vector, or a null or non-finite component
    take no part. Of rows that share an id the smallest vector stands. Vectors of different
    lengths raise. Other columns are not read; no rows, or no queries, give no rows.

    The number of probes is fitted on a sample (``fitted_probes``), by the same rule at
    every size; it ends at all buckets, where the search is exact. A query that met fewer
    than ``most`` rows, of as many as there are, looks into every bucket of one table.
    """
    spark = vectors.sparkSession
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows = one_row_per_id(vectors.where(sound() & nonzero).select("vec_id", "embedding"), "embedding")
    rows = settle(rows, "vectors")
    size = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.size("embedding")).alias("least"),
        F.max(F.size("embedding")).alias("most"),
    ).first()
    if not size["rows"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = one_length(size["least"], size["most"])
    signs = table_signs(tables, dims)
    kind = rows.schema["embedding"].dataType.simpleString()
    hashed = settle(
        rows.mapInArrow(_hasher(signs, dims), f"vec_id long, embedding {kind}, codes array<int>"),
        "axes",
    )
    queries = hashed.where(query)

    def probed(asking: DataFrame, signs: np.ndarray, probes: int) -> DataFrame:
        return asking.select("vec_id", "embedding").mapInArrow(
            _prober(signs, dims, probes),
            f"query_id long, query {kind}, table int, codes array<int>",
        ).select("query_id", "query", "table", F.explode("codes").alias("code"))

    probes = fitted_probes(hashed, queries, signs, dims, most)
    found = settle(
        _first(_found_in_buckets(hashed, probed(queries, signs, probes), dims, most), most), "found"
    )
    due = min(most, size["rows"] - 1)
    counted = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"))
    short = settle(
        queries.join(counted, "vec_id", "left").where(F.coalesce("n", F.lit(0)) < due)
        .select("vec_id", "embedding"),
        "short",
    )
    if short.isEmpty():
        return found
    everything = probed(short, signs[:1], 2 * signs.shape[2])
    one_table = hashed.withColumn("codes", F.slice("codes", 1, 1))
    rest = _first(_found_in_buckets(one_table, everything, dims, most), most)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
