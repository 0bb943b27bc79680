"""Packing along a space-filling curve: neighbours on the curve share sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm import tokens
from talentgrid.llm.common import no_null, running_positions
from talentgrid.session import settle

SEQUENCE = 2048
END_ID = 1
HASHED, DIMENSIONS, BITS = 512, 4, 10

_ENCODED = "doc_id long, row long, curve long, doc_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def projection(vocabulary: int = 1 << 17, seed: int = 29) -> np.ndarray:
    """Where each token id moves a document: its hashed slot and sign, projected.

    A document's vector counts its ids in ``HASHED`` slots with signs; a random matrix
    takes it to ``DIMENSIONS``. Both steps are linear, so they are one table by id.
    """
    draw = np.random.default_rng(seed)
    slots = draw.integers(0, HASHED, vocabulary)
    signs = draw.choice(np.array([-1.0, 1.0], np.float32), vocabulary)
    matrix = draw.standard_normal((HASHED, DIMENSIONS)).astype(np.float32)
    return matrix[slots] * signs[:, None]


def coordinates(means: np.ndarray) -> np.ndarray:
    """Mean moves to cells of 0..2^BITS-1, squashed so that far ones stay in range."""
    inside = 0.5 + np.arctan(4.0 * means) / np.pi
    return np.minimum((inside * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each cell (rows of coordinates) along the Hilbert curve.

    Bit planes from the top: where a coordinate has the bit, the first coordinate's lower
    bits flip, else they are exchanged with it; a Gray code of the planes, undone, is
    the key. All rows at once.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for plane in range(bits - 1, 0, -1):
        below = (1 << plane) - 1
        for i in range(n):
            has = (x[:, i] >> plane) & 1 == 1
            swap = np.where(has, 0, (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] = np.where(has, x[:, 0] ^ below, x[:, 0] ^ swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> plane) & 1 == 1, (1 << plane) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for plane in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> plane) & 1)
    return key


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = projection()
        end = np.array([END_ID], "<u2")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, stop in tokens.blocks(texts):
                found = tokens.token_ids(texts[start:stop], path)
                if found[0].dtype.itemsize > 2:
                    raise ValueError("stored ids are 16 bits wide; the vocabulary has more")
                ids = [np.concatenate([x, end]) for x in found]
                means = np.stack([moves.take(x, axis=0).sum(axis=0) / len(x) for x in ids])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, stop - start),
                        batch.column("row").slice(start, stop - start),
                        pa.array(hilbert_keys(coordinates(means))),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                    ],
                    ["doc_id", "row", "curve", "doc_tokens", "ids"],
                )

    return encode


def _cutter(sequence: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            rows = []
            columns = [batch.column(c) for c in ("doc_id", "doc_tokens", "position", "ids")]
            for doc_id, total, position, stored in zip(*columns):
                doc_id, total, position = doc_id.as_py(), total.as_py(), position.as_py()
                ids = np.frombuffer(stored.as_buffer(), "<u2").astype("<u4")
                start = 0
                while start < total:
                    offset = (position + start) % sequence
                    length = min(sequence - offset, total - start)
                    rows.append(
                        (doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()),
                         total, (position + start) // sequence, offset)
                    )
                    start += length
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)], names
                )

    return cut


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, row, place on the curve, token count and ids of every row, stored once."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), no_null().alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    return settle(rows.mapInArrow(_encoder(path), _ENCODED), "token-ids")


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces of all documents in sequences of ``sequence`` tokens.

    Documents lie end to end in the order (curve, doc_id, row) and are cut at each
    multiple of ``sequence``; only the last sequence can be short. Null or empty texts
    have the end id alone. Equal texts have equal places on the curve and follow each
    other by id; null ids come first. An empty table gives no piece. Ids are encoded
    once and stored; order and positions are worked out on counts, then joined.
    """
    encoded = encode_documents(docs, path)
    order = ["curve", "doc_id", "row"]
    placed = running_positions(encoded.select(*order, "doc_tokens"), order, "doc_tokens", "position")
    joined = encoded.select("doc_id", "row", "doc_tokens", "ids").join(
        placed.select("row", "position"), "row"
    )
    return joined.select("doc_id", "doc_tokens", "position", "ids").mapInArrow(
        _cutter(sequence), PIECES
    )
