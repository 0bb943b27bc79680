"""Vector code compression: product codebooks by Lloyd rounds over cover trees.

Vectors are cut into equal parts, and each part position has a codebook. Blocks of rows
build one cover tree for each part position once; every node knows the sum and number of
the parts below it and how far the farthest lies. In a round, a node whose nearest entry
beats all others by more than twice that distance gives its whole subtree to that entry
(triangle inequality). Only where that fails are its children asked, and single parts are
compared exactly, in whole numbers.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.vectors import matrix, one_length, sound
from talentgrid.session import settle

#: Rows of a block, and the parts below which a node is not split any further.
BLOCK = 8192
LEAF = 12
#: Whole numbers up to here are exact as doubles.
EXACT = 2.0**52

_TREE = ("points", "weights", "inverse", "centre", "reach", "sums", "counts", "first", "last", "low", "high")


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances [points, entries], exact: all values are whole and below ``EXACT``."""
    return (
        (points**2).sum(axis=1)[:, None] - 2.0 * (points @ entries.T) + (entries**2).sum(axis=1)
    )


def _split(points: np.ndarray, nodes: np.ndarray, centre: np.ndarray, reach: float):
    """One level of the tree: for each point its child, and each child's parent and centre.

    ``nodes`` numbers the splitting node of each point, 0 upwards in runs; ``centre`` its
    centre as a point's index. A node's first child keeps its centre; the next child is the
    first point that no child covers within ``reach``. So siblings lie farther apart.
    """
    child = np.full(len(points), -1)
    parents: list[np.ndarray] = []
    centres: list[np.ndarray] = []
    made, left, picked = 0, np.arange(len(points)), centre
    while len(left):
        own = nodes[left]
        if made:
            asking, at = np.unique(own, return_index=True)
            picked = np.full(len(centre), -1)
            picked[asking] = left[at]
        else:
            asking = np.unique(own)
        number = np.full(len(centre), -1)
        number[asking] = made + np.arange(len(asking))
        gap = points[left] - points[picked[own]]
        near = (gap**2).sum(axis=1) <= reach * reach
        child[left[near]] = number[own[near]]
        parents.append(asking)
        centres.append(picked[asking])
        made += len(asking)
        left = left[~near]
    return child, np.concatenate(parents), np.concatenate(centres)


def cover_tree(parts: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree over the different rows of ``parts``, whole numbers as doubles.

    Nodes are stored level by level. ``first`` and ``last`` bound a node's children among
    the nodes, ``low`` and ``high`` its points, which lie together; a node without children
    is a leaf. Reach halves with each level.
    """
    points, inverse, weights = np.unique(parts, axis=0, return_inverse=True, return_counts=True)
    inverse = inverse.ravel()
    n = len(points)
    farthest = np.sqrt(((points - points[0]) ** 2).sum(axis=1).max()) if n else 0.0
    order = np.arange(n)
    centre, low, high = np.array([0]), np.array([0]), np.array([n])
    levels = []
    reach = farthest
    while len(centre):
        levels.append({"centre": centre, "low": low, "high": high})
        wide = high - low
        splits = np.flatnonzero(wide > LEAF)
        reach /= 2
        first = np.zeros(len(centre), np.int64)
        last = np.zeros(len(centre), np.int64)
        levels[-1] |= {"first": first, "last": last}
        if not len(splits):
            break
        place = np.concatenate([np.arange(low[s], high[s]) for s in splits])
        nodes = np.repeat(np.arange(len(splits)), wide[splits])
        held = order[place]
        # Centres as places among the held points.
        where = np.empty(n, np.int64)
        where[held] = np.arange(len(held))
        child, parent, chosen = _split(points[held], nodes, where[centre[splits]], reach)
        by_parent = np.argsort(parent, kind="stable")
        rank = np.empty(len(parent), np.int64)
        rank[by_parent] = np.arange(len(parent))
        child = rank[child]
        # Points keep their parent's stretch and lie together by child within it.
        sorted_by_child = np.argsort(child, kind="stable")
        order[place] = held[sorted_by_child]
        sizes = np.bincount(child, minlength=len(parent))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        counts = np.bincount(parent, minlength=len(splits))
        stop = np.cumsum(counts)
        first[splits], last[splits] = stop - counts, stop
        low, high = place[starts], place[starts] + sizes
        centre = held[chosen[by_parent]]
    # Children are numbered from their level's first node.
    offset = 0
    for level in levels:
        below = offset + len(level["centre"])
        branch = level["last"] > level["first"]
        level["first"] = np.where(branch, level["first"] + below, 0)
        level["last"] = np.where(branch, level["last"] + below, 0)
        offset = below
    tree = {k: np.concatenate([level[k] for level in levels]) for k in ("centre", "first", "last", "low", "high")}
    return _with_sums(tree, points[order], weights[order], order, inverse)


def _with_sums(tree, points, weights, order, inverse):
    """Sums, counts and reaches of the nodes; points in the order of the tree."""
    n, w = points.shape
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    running = np.zeros((n + 1, w))
    np.cumsum(points * weights[:, None], axis=0, out=running[1:])
    counted = np.concatenate([[0], np.cumsum(weights)])
    low, high = tree["low"], tree["high"]
    centres = points[place[tree["centre"]]] if n else np.zeros((0, w))
    reach = np.zeros(len(low))
    # Every point once in each level that it lies in: the levels are few.
    if n:
        spans = high - low
        owner = np.repeat(np.arange(len(low)), spans)
        member = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(low, spans)
        gaps = ((points[member] - centres[owner]) ** 2).sum(axis=1)
        reach = np.sqrt(np.maximum.reduceat(gaps, np.cumsum(spans) - spans))
    return {
        "points": points, "weights": weights, "inverse": place[inverse], "centre": centres,
        "reach": reach, "sums": running[high] - running[low], "counts": counted[high] - counted[low],
        "first": tree["first"], "last": tree["last"], "low": low, "high": high,
    }


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    sizes = last - first
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


def assign(tree: dict[str, np.ndarray], entries: np.ndarray):
    """Yields (nodes, entry of each) for whole subtrees, then (None, points, entry of each).

    Ties go to the lower index. An entry equal to an earlier one never wins.
    """
    used = np.sort(np.unique(entries, axis=0, return_index=True)[1])
    asked = entries[used]
    front = np.array([0]) if len(tree["low"]) else np.array([], np.int64)
    single = []
    while len(front):
        away = np.sqrt(distances(tree["centre"][front], asked))
        best = away.argmin(axis=1)
        nearest = away[np.arange(len(front)), best]
        away[np.arange(len(front)), best] = np.inf
        second = away.min(axis=1)
        # Roots and their sums round: ask below whenever it is close.
        whole = second - nearest > 2 * tree["reach"][front] * (1 + 1e-9) + 1e-6 * (1 + nearest)
        yield front[whole], None, used[best[whole]]
        rest = front[~whole]
        leaf = tree["last"][rest] == tree["first"][rest]
        single.append(_ranges(tree["low"][rest[leaf]], tree["high"][rest[leaf]]))
        branch = rest[~leaf]
        front = _ranges(tree["first"][branch], tree["last"][branch])
    points = np.concatenate(single) if single else np.array([], np.int64)
    yield None, points, used[distances(tree["points"][points], asked).argmin(axis=1)]


def sums_by_entry(tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Componentwise sums and numbers of the parts that each entry gets."""
    sums, counts = np.zeros(entries.shape), np.zeros(len(entries), np.int64)
    for nodes, points, chosen in assign(tree, entries):
        if nodes is not None:
            np.add.at(sums, chosen, tree["sums"][nodes])
            np.add.at(counts, chosen, tree["counts"][nodes])
        else:
            weights = tree["weights"][points]
            np.add.at(sums, chosen, tree["points"][points] * weights[:, None])
            np.add.at(counts, chosen, weights)
    return sums, counts


def codes_of(tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every row of the block."""
    codes = np.empty(len(tree["points"]), np.int64)
    for nodes, points, chosen in assign(tree, entries):
        if nodes is not None:
            low, high = tree["low"][nodes], tree["high"][nodes]
            codes[_ranges(low, high)] = np.repeat(chosen, high - low)
        else:
            codes[points] = chosen
    error = ((tree["points"] - entries[codes]) ** 2).sum(axis=1)
    return codes[tree["inverse"]], error[tree["inverse"]]


def _stored(tree: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **tree)
    return out.getvalue()


def _loaded(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        return {k: held[k] for k in _TREE}


def whole_parts(vectors: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """[rows, parts, width] of floor(scale * x); raises where sums would not be exact."""
    values = np.floor(scale * vectors)
    most = np.abs(values).max(initial=0.0)
    # Distances, and sums of a block, stay whole as doubles.
    if most * most * 4 * vectors.shape[1] >= EXACT or most * BLOCK >= EXACT:
        raise ArithmeticError("a scaled component is too large for exact distances")
    return values.reshape(len(vectors), parts, -1)


def _builder(dims: int, parts: int, scale: int):
    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        cut = whole_parts(matrix(table.column("embedding"), dims), parts, scale)
        trees = [_stored(cover_tree(np.ascontiguousarray(cut[:, p]))) for p in range(parts)]
        columns = [table.column(c).combine_chunks() for c in ("vec_id", "label")]
        ends = pa.array([0, table.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, c) for c in columns]
        return pa.RecordBatch.from_arrays(
            [*lists, pa.array([trees], pa.list_(pa.binary()))], ["vec_ids", "labels", "trees"]
        )

    def build(batches):
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                taken = batch.slice(at, BLOCK - size)
                held.append(taken)
                at, size = at + taken.num_rows, size + taken.num_rows
                if size == BLOCK:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return build


def _summer(books: np.ndarray):
    """Sums for one task: as many rows as the codebooks have components."""

    def add(batches):
        parts, entries, width = books.shape
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for trees in batch.column("trees"):
                for p, data in enumerate(trees):
                    more, n = sums_by_entry(_loaded(data.as_py()), books[p])
                    sums[p] += more.astype(np.int64)
                    counts[p] += n
        p, e, d = np.nonzero(np.repeat((counts > 0)[:, :, None], width, axis=2))
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(d.astype(np.int32)),
             pa.array(sums[p, e, d]), pa.array(counts[p, e])],
            ["part", "entry", "place", "total", "n"],
        )

    return add


def _encoder(books: np.ndarray):
    def encode(batches):
        for batch in batches:
            for ids, labels, trees in zip(*(batch.column(c) for c in ("vec_ids", "labels", "trees"))):
                pairs = [codes_of(_loaded(t.as_py()), books[p]) for p, t in enumerate(trees)]
                codes = np.stack([c for c, _ in pairs], axis=1)
                error = sum(e for _, e in pairs).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values,
                     pa.array(["".join(f"{c:02x}" for c in row) for row in codes.tolist()], pa.string()),
                     pa.array(error)],
                    ["vec_id", "label", "code", "error"],
                )

    return encode


def compress(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row with a sound vector.

    Components count as floor(``scale`` * x), vectors are cut into ``parts`` equal parts.
    Each position's codebook starts as that part of the ``entries`` smallest ids' rows
    (fewer if there are fewer rows; rows that share an id go by their vector). In each of
    ``rounds`` rounds all parts go to their nearest entry, ties to the lower index, and an
    entry becomes the floor of its parts' mean, or stays if it has none. ``code`` has two
    hex digits a part; ``error`` sums the squared distances; ``label_error`` sums errors over
    equal labels, nulls together.

    Rows whose vector is null, empty, or holds a null or non-finite component go. A row
    with a null id is coded, but starts no codebook; repeated rows are rows of their own.
    Vectors of different lengths, lengths that ``parts`` doesn't divide, more than 256
    entries, and components too large for exact distances raise. Other columns are not
    read; no rows give no rows.

    The driver holds codebooks and their sums alone, whatever the number of rows. Trees
    are built once and stored; a block has a fixed number of rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = vectors.sparkSession
    kind = vectors.schema["label"].dataType.simpleString()
    rows = vectors.where(sound()).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    size = rows.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    result = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if size["least"] is None:
        return spark.createDataFrame([], result)
    dims = one_length(size["least"], size["most"])
    if dims % parts:
        raise ValueError(f"{dims} components cannot be cut into {parts} equal parts")
    start = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "embedding").limit(entries).collect()
    first = np.array([list(r["embedding"]) for r in start], np.float64).reshape(-1, dims)
    if not len(first):
        raise ValueError("no row with an id to start the codebooks")
    # [part, entry, place]
    books = np.ascontiguousarray(whole_parts(first, parts, scale).transpose(1, 0, 2))
    blocks = settle(
        rows.mapInArrow(
            _builder(dims, parts, scale),
            f"vec_ids array<long>, labels array<{kind}>, trees array<binary>",
        ),
        "cover-trees",
    )
    for _ in range(rounds):
        sums = (
            blocks.select("trees").mapInArrow(
                _summer(books), "part int, entry int, place int, total long, n long"
            )
            .groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        )
        books = books.copy()
        # parts * entries * width rows.
        for r in sums.collect():
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    said = ",".join(str(int(x)) for x in books.ravel())
    digest = hashlib.sha256(said.encode()).hexdigest()
    coded = settle(
        blocks.mapInArrow(_encoder(books), f"vec_id long, label {kind}, code string, error long"), "codes"
    )
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return coded.join(
        totals.withColumnRenamed("label", "other"), F.col("label").eqNullSafe(F.col("other"))
    ).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
