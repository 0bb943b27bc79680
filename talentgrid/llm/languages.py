"""Language identification: n-gram presence kernels, Nyström landmarks, ridge regression."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talentgrid.llm.common import no_null
from talentgrid.session import settle

#: n-grams of one to this many characters, each hashed to one of 2^SLOT_BITS slots.
LONGEST, SLOT_BITS = 4, 17
#: Bounds of the fit, whatever the corpus: rows it learns from, and landmarks among them.
TRAINING_ROWS, LANDMARKS = 1000, 192
#: First bits of the hash order by which rows are counted.
ORDER_BITS = 12
RIDGE = 1e-2
UNKNOWN = "und"

_SLOTS = 1 << SLOT_BITS


def _letter_table() -> np.ndarray:
    """For each character of the first plane: its lower-case letter, or a blank."""
    table = np.full(0x10000, 32, np.uint32)
    for code in range(0x10000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_LETTERS: list[np.ndarray] = []


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters with single blanks for all that lies between; empty if none."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    order = "utf-32-le" if sys.byteorder == "little" else "utf-32-be"
    codes = np.frombuffer(text.encode(order), np.uint32)
    plain = codes < 0x10000
    out = _LETTERS[0][np.where(plain, codes, 32)]
    if not plain.all():
        other = np.array([chr(c).isalpha() for c in codes[~plain]], bool)
        out[~plain] = np.where(other, codes[~plain], 32)
    if not (out != 32).any():
        return out[:0]
    padded = np.concatenate([[np.uint32(32)], out, [np.uint32(32)]]).astype(np.uint32)
    double = (padded[1:] == 32) & (padded[:-1] == 32)
    return padded[np.concatenate([[True], ~double])]


def present_slots(letters: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Sorted slots of the n-grams present. ``seen`` is an all-false work array, left so."""
    total = np.zeros(len(letters), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(letters) < n:
            break
        total = (total[: len(letters) - n + 1] * np.uint64(0x9E3779B1) + letters[n - 1 :]) * np.uint64(
            0xBF58476D1CE4E5B9
        )
        total ^= total >> np.uint64(29)
        seen[(total >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = True
    slots = np.flatnonzero(seen)
    seen[slots] = False
    return slots


@dataclass(frozen=True)
class Model:
    """Languages and one column of slot weights for each.

    The kernel of two texts is the number of n-grams both have, divided by the root of
    the product of their numbers. Landmark values times ridge weights is linear in the
    slots, so the matrix of landmarks and the regression are multiplied once.
    """

    languages: tuple[str, ...]
    weights: np.ndarray

    def scores(self, present: list[np.ndarray]) -> np.ndarray:
        """Scores (rows by languages) of texts given by their slots."""
        lengths = np.array([len(p) for p in present])
        slots, place = np.unique(np.concatenate(present), return_inverse=True)
        # The incidence of the batch in blocks of its own slots, times their weights.
        out = np.zeros((len(present), len(self.languages)), np.float32)
        rows = np.repeat(np.arange(len(present)), lengths)
        for start in range(0, len(slots), 16384):
            stop = min(start + 16384, len(slots))
            mine = (place >= start) & (place < stop)
            block = np.zeros((len(present), stop - start), np.float32)
            block[rows[mine], place[mine] - start] = 1.0
            out += block @ self.weights[slots[start:stop]]
        return out / np.sqrt(lengths)[:, None]


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """One-versus-rest kernel ridge regression on (language, slots) rows.

    The first rows are the landmarks. Nyström: a row's features are its kernel values
    with them, times the inverse root of their own kernel matrix.
    """
    if not rows:
        return None
    languages = tuple(sorted({lang for lang, _ in rows}))
    marks = rows[:landmarks]
    incidence = np.zeros((_SLOTS, len(marks)), np.float32)
    for j, (_, slots) in enumerate(marks):
        incidence[slots, j] = 1.0 / np.sqrt(len(slots))
    kernel = np.stack([incidence[slots].sum(axis=0) / np.sqrt(len(slots)) for _, slots in rows])
    own = kernel[: len(marks)].astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    strong = values > 1e-6 * values.max()
    root = vectors[:, strong] / np.sqrt(values[strong])
    features = kernel.astype(np.float64) @ root
    targets = np.array([[lang == x for x in languages] for lang, _ in rows], np.float64)
    # Every language weighs the same, however many rows it has.
    weight = 1.0 / (targets.sum(axis=0) @ targets.T)
    gram = features.T @ (features * weight[:, None])
    solved = np.linalg.solve(
        gram + ridge * np.eye(gram.shape[0]) / len(marks), features.T @ (targets * weight[:, None])
    )
    return Model(languages, incidence @ (root @ solved).astype(np.float32))


def _slot_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows as packed slot sets of fixed size: long texts stay on the executors."""
    seen = np.zeros(_SLOTS, bool)
    for batch in batches:
        packed = []
        for text in batch.column("text"):
            seen_slots = present_slots(letters_of(text.as_py()), seen)
            bits = np.zeros(_SLOTS, bool)
            bits[seen_slots] = True
            packed.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("place"), pa.array(packed, pa.binary())],
            ["lang", "place", "slots"],
        )


def training_rows(docs: DataFrame, usable: Column, most: int = TRAINING_ROWS) -> list[tuple[str, np.ndarray]]:
    """At most ``most`` rows, dealt over the languages in turn, in an order of hashes.

    Each comes to the driver as 2^SLOT_BITS bits, so the bound holds for any texts.
    """
    named = docs.where(usable & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), no_null().alias("text"), "doc_id"
    ).where(F.col("text").rlike("\\p{L}"))
    named = named.withColumn("order", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    # Chosen by narrow rows; only the chosen ones meet their texts. The order is a hash: rows
    # are counted by its first bits, and those beyond the bits that hold ``most`` rows of a
    # language go before any are ranked. So a language's task gets little more than ``most``.
    narrow = settle(named.select("lang", "order").distinct(), "training-order")
    bits = F.shiftright("order", 64 - ORDER_BITS)
    counted = narrow.groupBy("lang", bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("lang").orderBy("bits").rowsBetween(Window.unboundedPreceding, -1)
    wanted = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(
        F.col("before") < most
    )
    few = narrow.withColumn("bits", bits).join(wanted.select("lang", "bits"), ["lang", "bits"])
    each = Window.partitionBy("lang").orderBy("order")
    turns = few.withColumn("turn", F.row_number().over(each)).select("lang", "order", "turn")
    chosen = turns.where(F.col("turn") <= most).orderBy("turn", "lang").limit(most)
    placed = chosen.withColumn("place", F.row_number().over(Window.orderBy("turn", "lang")))
    # ``most`` rows at most; repeated rows count once.
    texts = named.join(F.broadcast(placed), ["lang", "order"]).dropDuplicates(["lang", "order"])
    chosen = texts.select("lang", "text", "place")
    packed = chosen.mapInArrow(_slot_sets, "lang string, place int, slots binary").collect()
    found = sorted(packed, key=lambda r: r["place"])
    rows = [
        (r["lang"], np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r["slots"]), np.uint8))))
        for r in found
    ]
    return [r for r in rows if len(r[1])]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text
    if nothing could be learned. The score is the winning ridge value, held to 0..1;
    ties go to the first language by name.
    """
    languages = model.languages if model else ()
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(_SLOTS, bool)
        known = shipped.value
        for batch in batches:
            names = np.full(batch.num_rows, UNKNOWN, object)
            scores = np.zeros(batch.num_rows)
            waiting: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                if waiting:
                    values = known.scores([slots for _, slots in waiting])
                    best = values.argmax(axis=1)
                    at = [i for i, _ in waiting]
                    names[at] = np.array(languages, object)[best]
                    scores[at] = np.clip(values[np.arange(len(at)), best], 0.0, 1.0)
                    waiting.clear()

            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                slots = present_slots(letters_of(text), seen) if text and known else []
                if len(slots):
                    waiting.append((i, slots))
                if len(waiting) == 64:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(names), pa.string()), pa.array(scores)],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", no_null().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, lang_pred string, score double")


def held_out(folds: int = 5) -> Column:
    """True for the documents that nothing is learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % folds == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned on all folds but the held-out one."""
    model = fit(training_rows(docs, F.coalesce(~held_out(), F.lit(False))))
    return predict(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
