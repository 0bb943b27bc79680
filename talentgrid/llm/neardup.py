"""Near-duplicates: min-max hashing, banding, exact confirmation, components."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import no_null
from talentgrid.llm.components import components
from talentgrid.session import settle

#: Permutations; each gives its minimum and its maximum.
PERMUTATIONS = 60
#: Values in a band. 24 bands of 5: a pair at 0.85 shares none with probability 8e-7.
BAND = 5
#: Of the 120 low bits of the signature, a pair at 0.85 agrees on 111 in the mean with a
#: deviation of 2.9; fewer than this is more than six deviations away.
AGREEING_BITS = 92
#: The least similarity, in percent, that permutations, bands and bits serve. At 80 a pair
#: shares no band with probability 7.3e-5, and bits rule it out with 5.7e-6.
LEAST_PERCENT = 80
#: Rows of a shared band that are compared with as many others at a time, and shingles of
#: those rows: long texts make smaller blocks.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000

_SIGNED = (
    "doc_id long, n_shingles long, content binary, low bigint, high bigint, bands array<bigint>"
)


def words_of(text: str) -> list[bytes]:
    """Words between the six blanks, A-Z in lower case."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles; fewer words than ``width`` are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    if len(words) < width:
        joined = xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))
        return np.array([joined], np.uint64)
    factors = np.random.default_rng(3).integers(1, 2**63, width, np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        total = (total ^ (total >> np.uint64(29))) * factors[i] + hashed[i : len(hashed) - width + 1 + i]
    return np.unique(total * np.uint64(0x9E3779B97F4A7C15))


class MinMaxSigner:
    """Minimum and maximum of a shingle set under each of the permutations."""

    def __init__(self, permutations: int = PERMUTATIONS, band: int = BAND, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.factor = draw.integers(0, 2**63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = draw.integers(0, 2**63, permutations, np.uint64)
        self.bands = 2 * permutations // band
        self.band = band
        self.weights = draw.integers(0, 2**63, (self.bands, band), np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = draw.integers(0, 2**63, self.bands, np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        high = np.zeros(len(self.factor), np.uint64)
        for start in range(0, len(shingles), 1024):
            block = shingles[start : start + 1024, None]
            permuted = (block ^ self.shift) * self.factor
            permuted ^= permuted >> np.uint64(32)
            np.minimum(low, permuted.min(axis=0), out=low)
            np.maximum(high, permuted.max(axis=0), out=high)
        return np.concatenate([low, high])

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """A hash of each band of each signature, different for different bands."""
        parts = signatures.reshape(len(signatures), self.bands, self.band)
        mixed = ((parts ^ (parts >> np.uint64(31))) * self.weights).sum(axis=2, dtype=np.uint64)
        mixed = (mixed ^ self.salts) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def _low_bits(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest bit of each value, half of them in either number, none negative."""
    bits = (signatures & np.uint64(1)).astype(np.uint8)
    half = bits.shape[1] // 2
    packed = [
        np.packbits(np.pad(b, ((0, 0), (64 - b.shape[1], 0))), axis=1).view(">i8")[:, 0]
        for b in (bits[:, :half], bits[:, half:])
    ]
    return packed[0].astype(np.int64), packed[1].astype(np.int64)


def _signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = MinMaxSigner()
        names = ["doc_id", "n_shingles", "content", "low", "high", "bands"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = words_of(text.as_py())
                if not words:
                    rows.append((doc_id, 0, b"", None))
                    continue
                shingles = shingle_hashes(words, width)
                content = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                rows.append((doc_id, len(shingles), content, signer.signature(shingles)))
            if not rows:
                continue
            empty = np.zeros(2 * len(signer.factor), np.uint64)
            signatures = np.stack([empty if r[3] is None else r[3] for r in rows])
            low, high = _low_bits(signatures)
            keys = signer.keys(signatures)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.binary()),
                    pa.array(low), pa.array(high),
                    pa.array(list(keys), pa.list_(pa.int64())),
                ],
                names,
            )

    return sign


def shingle_set(text: str, width: int) -> set:
    """The exact set: shingles as tuples of words, or the whole short sequence."""
    words = words_of(text)
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return set(zip(*[words[i:] for i in range(width)]))


def _confirmer(width: int, percent: int):
    """Pairs of texts whose full sets are alike enough; the texts of hot rows are cut once."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[tuple, set] = OrderedDict()

        def cut(key: int, text: str) -> set:
            at = (key, hash(text))
            if at in recent:
                recent.move_to_end(at)
                return recent[at]
            found = recent[at] = shingle_set(text, width)
            if len(recent) > 16:
                recent.popitem(last=False)
            return found

        for batch in batches:
            kept: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]
            for a, b, text_a, text_b in zip(*columns):
                x, y = shingle_set(text_a, width), cut(b, text_b)
                shared = len(x & y)
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

    return confirm


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among candidate pairs (a, b), b the row that many pairs have in common."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirmer(width, percent), "a long, b long")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sizes and signature bits of two rows don't rule the link out."""
    sizes = (100 * F.least(f"{a}.n", f"{b}.n")) >= percent * F.greatest(f"{a}.n", f"{b}.n")
    differing = F.bit_count(F.col(f"{a}.low").bitwiseXOR(F.col(f"{b}.low"))) + F.bit_count(
        F.col(f"{a}.high").bitwiseXOR(F.col(f"{b}.high"))
    )
    return sizes & (differing <= 2 * PERMUTATIONS - AGREEING_BITS)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked where 100 * shared >= ``percent`` * all of their sets of
    ``width``-word shingles; components follow links, and the row whose id is the
    component's smallest is kept. Texts without words are linked with nothing. A null id
    can't be linked: it is its own component, null, and kept. Rows that share an id are
    one document with the links of all their texts.

    1. Every text is signed; texts of equal words become one class, named by its
       smallest id, so copies cost nothing from here on.
    2. Each class is paired with the smallest class of each band value it shares. These
       stars are as many as the rows, and pairs that sizes or signature bits rule out go.
    3. Pairs are confirmed on their full sets, and links contracted to components.
    4. Where a band value still holds several components, every row outside its largest
       one is compared with all rows of the others on full sets, block by block, so no pair
       that shares a band is left out whatever the group's size.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be {LEAST_PERCENT} to 100: below, bands would lose links")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_null().alias("text"))
    signed = settle(rows.mapInArrow(_signer(width), _SIGNED), "signatures")
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    # A class of equal words is one row from here on. Equal ids of different texts meet.
    classes = settle(
        usable.groupBy("content").agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n"), F.first("low").alias("low"),
            F.first("high").alias("high"), F.first("bands").alias("bands"),
        ),
        "classes",
    )
    banded = classes.select(
        F.explode("bands").alias("key"), F.struct("id", "n", "low", "high").alias("x")
    )
    shared = banded.groupBy("key").agg(
        F.min("x.id").alias("first"), F.count(F.lit(1)).alias("rows")
    )
    members = settle(banded.join(shared.where("rows > 1"), "key"), "band-members")
    heads = members.where(F.col("x.id") == F.col("first")).select("key", F.col("x").alias("head"))
    stars = settle(
        members.where(F.col("x.id") != F.col("first")).join(heads, "key")
        .where(_may_link("x", "head", percent))
        .select(F.col("x.id").alias("a"), F.col("head.id").alias("b")).distinct(),
        "stars",
    )
    involved = members.select(F.col("x.id").alias("doc_id")).distinct()
    texts = settle(rows.join(involved, "doc_id", "left_semi"), "texts")
    links = settle(_confirmed(stars, texts, width, percent), "star-links")
    grouped = components(links)
    bands = classes.select("id", "bands")
    more = _crossing_links(members, grouped, bands, texts, width, percent)
    # Labels stand for what stars have linked already.
    final = components(
        settle(more.unionByName(grouped.select(F.col("node").alias("a"), F.col("label").alias("b"))), "links")
    )
    named = (
        usable.select("doc_id", "content").distinct()
        .join(classes.select("content", "id"), "content")
        .select("doc_id", F.col("id").alias("class"))
    )
    labelled = named.join(final.withColumnRenamed("node", "class"), "class", "left").select(
        "doc_id", F.coalesce("label", "class").alias("component")
    )
    # One row per id; several only where rows of one id have different texts.
    chosen = labelled.groupBy("doc_id").agg(F.min("component").alias("component"))
    return (
        signed.select("doc_id", "n_shingles")
        .join(chosen, "doc_id", "left")
        .select(
            "doc_id", "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
        )
    )


def _crossing_comparer(width: int, percent: int):
    """Links between the outside rows and all rows of one block of a shared band."""

    def compare(table: pa.Table) -> pa.Table:
        outside = table.column("outer").to_numpy(zero_copy_only=False).astype(bool)
        columns = {
            c: table.column(c).to_numpy()
            for c in ("key", "id", "n", "low", "high", "group", "largest", "first")
        }
        bands = np.stack(table.column("bands").to_numpy())
        texts = table.column("text")
        o, a = np.flatnonzero(outside), np.flatnonzero(~outside)
        x, y = ({c: v[i] for c, v in columns.items()} for i in (o, a))
        # Two outside rows meet twice, with either in front.
        may = (x["group"][:, None] != y["group"]) & (
            (y["group"] == y["largest"]) | (x["id"][:, None] > y["id"])
        )
        may &= 100 * np.minimum(x["n"][:, None], y["n"]) >= percent * np.maximum(x["n"][:, None], y["n"])
        differing = np.bitwise_count(x["low"][:, None] ^ y["low"]).astype(np.int16)
        differing += np.bitwise_count(x["high"][:, None] ^ y["high"])
        may &= differing <= 2 * PERMUTATIONS - AGREEING_BITS
        # Stars have compared the first row of the band with all others.
        may &= (x["id"] != x["first"])[:, None] & (y["id"] != y["first"])
        left, right = np.nonzero(may)
        # A pair counts in the first band that both share: there it was a star, is in one
        # component already, or is compared.
        shared = bands[o[left]] == bands[a[right]]
        here = bands[o[left]] == columns["key"][0]
        now = shared.argmax(axis=1) == here.argmax(axis=1)
        left, right = left[now], right[now]
        order = np.argsort(differing[left, right], kind="stable")

        numbers: dict[tuple, int] = {}
        sets: dict[int, set[int]] = {}
        root: dict[int, int] = {}

        def find(g: int) -> int:
            while root.get(g, g) != g:
                root[g] = g = root.get(root[g], root[g])
            return g

        def numbered(i: int) -> set[int]:
            if i not in sets:
                found = shingle_set(texts[i].as_py(), width)
                sets[i] = {numbers.setdefault(s, len(numbers)) for s in found}
            return sets[i]

        links = []
        for i, j in zip(o[left[order]].tolist(), a[right[order]].tolist()):
            g, h = find(int(columns["group"][i])), find(int(columns["group"][j]))
            if g == h:
                continue
            one, other = numbered(i), numbered(j)
            both = len(one & other)
            if 100 * both >= percent * (len(one) + len(other) - both):
                links.append((int(columns["id"][i]), int(columns["id"][j])))
                root[max(g, h)] = min(g, h)
        return pa.table(
            {c: pa.array([pair[k] for pair in links], pa.int64()) for k, c in enumerate("ab")}
        )

    return compare


def _crossing_links(
    members: DataFrame, grouped: DataFrame, bands: DataFrame, texts: DataFrame, width: int, percent: int
) -> DataFrame:
    """Links (a, b) that join the components which share a band value.

    Within one band value, the rows outside its largest component meet all rows: both
    are cut into blocks and every two blocks meet in one task. Pairs are never written
    out; a block gives at most one link for each component that it joins.
    """
    placed = members.where("rows > 2").select("key", "first", "x.*").join(
        grouped.select(F.col("node").alias("id"), F.col("label").alias("group")), "id", "left"
    ).withColumn("group", F.coalesce("group", "id"))
    per_group = placed.groupBy("key", "group").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")
    )

    def blocks(rows: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    largest = F.struct("rows", "group")
    mixed = (
        per_group.groupBy("key").agg(
            F.sum("rows").alias("all"), F.max("rows").alias("most"), F.count(F.lit(1)).alias("groups"),
            F.max_by("group", largest).alias("largest"), F.sum("shingles").alias("all_shingles"),
            F.max_by("shingles", largest).alias("most_shingles"),
        )
        .where("groups > 1")
        .select(
            "key", "largest", blocks(F.col("all"), F.col("all_shingles")).alias("inner_blocks"),
            blocks(F.col("all") - F.col("most"), F.col("all_shingles") - F.col("most_shingles"))
            .alias("outer_blocks"),
        )
    )
    there = settle(placed.join(mixed, "key"), "mixed")
    full = there.join(bands, "id").join(texts.withColumnRenamed("doc_id", "id"), "id")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")).cast("int").alias(f"{own}_block")
        each = F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)
        return rows.select(
            "key", mine, F.explode(each).alias(f"{other}_block"),
            F.lit(own == "outer").alias("outer"), "id", "n", "low", "high", "group", "largest",
            "first", "bands", "text",
        )

    meeting = dealt(full.where("group != largest"), "outer", "inner").unionByName(
        dealt(full, "inner", "outer")
    )
    return meeting.groupBy("key", "outer_block", "inner_block").applyInArrow(
        _crossing_comparer(width, percent), "a long, b long"
    )


def keep_one_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    gone = near_duplicates(docs, width, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
