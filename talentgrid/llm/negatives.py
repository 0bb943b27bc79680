"""Hard negatives: full exact scores of all rows by Four-Russians tables.

A candidate is stored as bit planes: its integer components in two's complement, eight
components to a byte in each plane. An anchor becomes a table of the sums of every subset
of each eight of its components. A score is then the sum, over planes and groups, of the
table entry that the candidate's byte names, shifted by the plane.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talentgrid.llm.vectors import block_numbers, hashed_block, matrix, one_length, one_row_per_id, sound
from talentgrid.session import settle

GROUP = 8
#: Rows that meet in one task: anchors and candidates of a cell.
ANCHORS = 1024
CANDIDATES = 2048
#: Candidates scored at a time against all anchors of a cell.
TILE = 256

_PACKED = "vec_id long, label {label}, dims int, depth int, planes binary"


def pack_planes(values: np.ndarray) -> tuple[np.ndarray, int]:
    """[rows, planes, groups] of bytes for integer [rows, dims], and the number of planes.

    The last plane is the sign; dims are filled up to whole groups with zeros.
    """
    most = int(max(abs(int(values.min(initial=0))), abs(int(values.max(initial=0)))))
    depth = most.bit_length() + 1
    filled = np.pad(values, ((0, 0), (0, -values.shape[1] % GROUP)))
    bits = (filled[:, None, :] >> np.arange(depth)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little"), depth


def deepened(planes: np.ndarray, depth: int) -> np.ndarray:
    """The same numbers with ``depth`` planes: the sign is repeated upwards."""
    more = depth - planes.shape[1]
    return np.concatenate([planes, np.repeat(planes[:, -1:], more, axis=1)], axis=1) if more else planes


def unpack_planes(planes: np.ndarray, dims: int) -> np.ndarray:
    depth = planes.shape[1]
    bits = np.unpackbits(planes, axis=2, bitorder="little")[:, :, :dims].astype(np.int64)
    weights = np.int64(1) << np.arange(depth, dtype=np.int64)
    weights[-1] = -weights[-1]
    return np.einsum("rpd,p->rd", bits, weights)


def subset_sums(anchors: np.ndarray, dtype=np.int64) -> np.ndarray:
    """[groups, 256, anchors]: the sum of every subset of each eight components."""
    filled = np.pad(anchors, ((0, 0), (0, -anchors.shape[1] % GROUP))).astype(dtype)
    parts = filled.reshape(len(anchors), -1, GROUP).transpose(1, 2, 0)
    sums = np.zeros((parts.shape[0], 1 << GROUP, len(anchors)), dtype)
    for bit in range(GROUP):
        sums[:, 1 << bit: 2 << bit] = sums[:, : 1 << bit] + parts[:, bit, None]
    return sums


def table_scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[anchors, candidates] inner products, from looked-up sums, shifts and additions."""
    groups, _, anchors = sums.shape
    scores = np.empty((anchors, len(planes)), sums.dtype)
    for start in range(0, len(planes), TILE):
        tile = planes[start: start + TILE]
        total = np.zeros((len(tile), anchors), sums.dtype)
        for plane in range(tile.shape[1] - 1, -1, -1):
            total <<= 1
            sign = plane == tile.shape[1] - 1
            for group in range(groups):
                found = sums[group].take(tile[:, plane, group], axis=0)
                (np.subtract if sign else np.add)(total, found, out=total)
        scores[:, start: start + TILE] = total.T
    return scores


def leading(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``most`` highest allowed scores of each row, ties to the left."""
    lowest = np.iinfo(scores.dtype).min
    left = np.where(allowed, scores, lowest)
    rows, columns, every = [], [], np.arange(len(scores))
    for _ in range(most if scores.shape[1] else 0):
        best = left.argmax(axis=1)
        there = left[every, best] != lowest
        if not there.any():
            break
        rows.append(every[there])
        columns.append(best[there])
        left[every, best] = lowest
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(columns)


def _packer(scale: int):
    def pack(batches):
        for batch in batches:
            lengths = np.asarray(batch.column("dims"))
            planes, depths = [], np.zeros(batch.num_rows, np.int32)
            vectors = batch.column("embedding")
            at = 0
            # Runs of one length, in practice the whole batch.
            for run in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(lengths)) + 1):
                if not len(run):
                    continue
                values = np.floor(scale * matrix(vectors.slice(at, len(run)), int(lengths[at])))
                if np.abs(values).max() >= 2.0**52:
                    raise ArithmeticError("a scaled component does not fit an exact integer")
                packed, depth = pack_planes(values.astype(np.int64))
                planes += [p.tobytes() for p in packed]
                depths[run] = depth
                at += len(run)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("dims"),
                 pa.array(depths), pa.array(planes, pa.binary())],
                ["vec_id", "label", "dims", "depth", "planes"],
            )

    return pack


def _planes(table: pa.Table, dims: int, depth: int) -> np.ndarray:
    """The planes of rows of a table, in their order, all with ``depth`` planes."""
    groups = -(-dims // GROUP)
    out = np.empty((table.num_rows, depth, groups), np.uint8)
    own = table.column("depth").to_numpy()
    stored = table.column("planes").to_pylist()
    for d in np.unique(own):
        rows = np.flatnonzero(own == d)
        found = np.frombuffer(b"".join(stored[i] for i in rows), np.uint8)
        out[rows] = deepened(found.reshape(len(rows), int(d), groups), depth)
    return out


def _cell(anchors: pa.Table, rows: pa.Table, dims: int, depth: int):
    """Scores of all anchors with all rows, rows by ascending id, and their labels."""
    if not anchors.num_rows or not rows.num_rows:
        return None
    rows = rows.sort_by("vec_id")
    # A score is below dims * 4 ** (depth - 1); sums on the way stay within four times that.
    dtype = np.int32 if dims * 4 ** depth < 2**31 else np.int64
    tables = subset_sums(unpack_planes(_planes(anchors, dims, depth), dims), dtype)
    scores = table_scores(tables, _planes(rows, dims, depth))
    own, other = (t.column("label").to_numpy() for t in (anchors, rows))
    return rows, scores, own[:, None] == other[None, :]


def _positive_finder(dims: int, depth: int, most: int):
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        cell = _cell(anchors, rows, dims, depth)
        if cell is None:
            return pa.table({c: pa.array([], pa.int64()) for c in ("anchor_id", "positive_id", "score")})
        rows, scores, alike = cell
        a, r = anchors.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
        i, j = leading(scores, alike & (a[:, None] != r[None, :]), most)
        return pa.table(
            {"anchor_id": a[i], "positive_id": r[j], "score": scores[i, j].astype(np.int64)}
        )

    return find


def _negative_finder(dims: int, depth: int, most: int, low: int, high: int):
    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        cell = _cell(anchors, rows, dims, depth)
        if cell is None:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        rows, scores, alike = cell
        a, r = anchors.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
        positives = anchors.column("positives").to_pylist()
        parts = []
        for place in range(max(map(len, positives))):
            with_one = np.flatnonzero([len(p) > place for p in positives])
            ids = np.array([positives[k][place]["positive_id"] for k in with_one], np.int64)
            score = [positives[k][place]["score"] for k in with_one]
            # low * p <= 100 * n <= high * p, in whole n.
            least = np.array([-((-low * s) // 100) for s in score], np.int64)[:, None]
            largest = np.array([(high * s) // 100 for s in score], np.int64)[:, None]
            own = scores[with_one]
            i, j = leading(own, ~alike[with_one] & (own >= least) & (own <= largest), most)
            parts.append((a[with_one[i]], ids[i], np.array(score, np.int64)[i], r[j], own[i, j].astype(np.int64)))
        return pa.table({c: np.concatenate([p[k] for p in parts]) for k, c in enumerate(names)})

    return find


def hard_negatives(
    vectors: DataFrame, anchor: str, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and embedding; rows for which the SQL condition ``anchor``
    holds are anchors. Components count as floor(``scale`` * x); a score is the integer inner
    product with the anchor, higher first, ties to the smaller id. An anchor's positives are
    its first other rows of its label; for each of them the first ``negatives`` rows of
    another label with low * positive <= 100 * negative <= high * positive are returned.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite
    component take no part. Of rows that share an id the one with the smallest label and
    vector stands. Vectors of different lengths, and scores beyond a long, raise. Other
    columns are not read; no rows, or no anchors, give no rows.

    Every anchor meets every row. Both are cut into blocks by hash, and each two blocks
    meet in one task, which returns only its leading rows for each anchor, so neither a
    label nor a set of copies gathers anywhere. There are two passes, as a positive's
    score sets its negatives' bounds.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["label"].dataType.simpleString()
    rows = one_row_per_id(
        vectors.where(sound() & F.col("label").isNotNull()).select("vec_id", "label", "embedding"),
        "label", "embedding",
    ).select("vec_id", "label", "embedding", F.size("embedding").alias("dims"))
    packed = settle(rows.mapInArrow(_packer(scale), _PACKED.format(label=kind)), "planes")
    chosen = packed.where(anchor)
    size = packed.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.expr(anchor)).alias("anchors"),
        F.max("depth").alias("depth"), F.min("dims").alias("least"), F.max("dims").alias("most"),
    ).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size["anchors"]:
        return spark.createDataFrame([], result)
    dims, depth = one_length(size["least"], size["most"]), size["depth"]
    if dims * 4**depth >= 2**63:
        raise ArithmeticError("scores do not fit a long")
    blocks = F.lit(-(-size["rows"] // CANDIDATES))
    chunks = F.lit(-(-size["anchors"] // ANCHORS))

    def meeting(anchors: DataFrame, find, schema: str) -> DataFrame:
        left = anchors.withColumn("chunk", hashed_block(chunks, "vec_id")).withColumn(
            "block", block_numbers(blocks)
        )
        # New names of the same columns: the anchors come from this table too.
        right = packed.select(*[F.col(c).alias(c) for c in packed.columns]).withColumn(
            "block", hashed_block(blocks, "vec_id")
        ).withColumn("chunk", block_numbers(chunks))
        cell = ("chunk", "block")
        return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(find, schema)

    def first(found: DataFrame, keys: list[str], score: str, other: str, most: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(other))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    found = first(
        meeting(
            chosen, _positive_finder(dims, depth, positives),
            "anchor_id long, positive_id long, score long",
        ),
        ["anchor_id"], "score", "positive_id", positives,
    )
    # At most ``positives`` rows an anchor.
    listed = settle(
        found.groupBy(F.col("anchor_id").alias("vec_id")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("positives")
        ),
        "positives",
    )
    mined = meeting(
        chosen.join(listed, "vec_id"), _negative_finder(dims, depth, negatives, low, high),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    return first(mined, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
