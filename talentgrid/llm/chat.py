"""Chat formatting: schema fingerprints pick the mapping of a record to canonical turns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentgrid.llm.common import partitions

# The template. No text holds one of the three marks once escaped.
OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
LEARNED_ROLE = "assistant"

#: The shortest record in which the JSON parser could refuse a string.
PARSED = 20_000_000

TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A record layout: its field paths and how its turns are read.

    ``paths`` are the leaves, sorted, with [] after a list. ``turns`` is a SQL
    expression over the variant column ``record`` that gives the turns in order.
    """

    name: str
    paths: tuple[str, ...]
    turns: str

    @property
    def fingerprint(self) -> str:
        return _hashed(self.paths)

    @property
    def of_columns(self) -> str:
        """The same turns from a struct column ``record``."""
        return _GET.sub(
            lambda m: f"{m[1]}.`{m[2]}`" if m[3] == "array<variant>" else f"cast({m[1]}.`{m[2]}` as {m[3]})",
            self.turns,
        )


_GET = re.compile(r"variant_get\((\w+), '\$\.(\w+)', '([^']+)'\)")


def _hashed(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _text(path: str) -> str:
    return f"variant_get(record, '$.{path}', 'string')"


def _asked(prompt: str, answer: str) -> str:
    return (
        f"array(named_struct('turn', 0L, 'role', 'user', 'text', {prompt}), "
        f"named_struct('turn', 1L, 'role', 'assistant', 'text', {answer}))"
    )


def _listed(path: str, role: str, text: str) -> str:
    """A list of messages; the common short names of roles are written out."""
    return (
        f"transform(variant_get(record, '$.{path}', 'array<variant>'), (m, i) -> named_struct("
        f"'turn', cast(i as bigint), 'role', "
        f"CASE variant_get(m, '$.{role}', 'string') WHEN 'human' THEN 'user' "
        f"WHEN 'gpt' THEN 'assistant' ELSE variant_get(m, '$.{role}', 'string') END, "
        f"'text', variant_get(m, '$.{text}', 'string')))"
    )


_INPUT = "coalesce(concat('\\n', nullif(" + _text("input") + ", '')), '')"

LAYOUTS = (
    Layout(
        "turn row", ("role", "text", "turn"),
        "array(named_struct('turn', variant_get(record, '$.turn', 'bigint'), "
        f"'role', {_text('role')}, 'text', {_text('text')}))",
    ),
    Layout("prompt", ("prompt", "response"), _asked(_text("prompt"), _text("response"))),
    Layout("completion", ("completion", "prompt"), _asked(_text("prompt"), _text("completion"))),
    Layout("question", ("answer", "question"), _asked(_text("question"), _text("answer"))),
    Layout(
        "instruction", ("instruction", "output"), _asked(_text("instruction"), _text("output"))
    ),
    Layout(
        "instruction with input", ("input", "instruction", "output"),
        _asked(f"concat(coalesce({_text('instruction')}, ''), {_INPUT})", _text("output")),
    ),
    Layout(
        "messages", ("messages[].content", "messages[].role"),
        _listed("messages", "role", "content"),
    ),
    Layout(
        "from and value", ("conversations[].from", "conversations[].value"),
        _listed("conversations", "from", "value"),
    ),
)


def field_paths(record: Column) -> Column:
    """Sorted distinct leaf paths of a variant, such as ``messages[].role``.

    The schema text of the record is cut into tokens and walked with a stack, so two
    records with the same fields agree whatever their values, types and lengths.
    """


    @F.pandas_udf("array<string>")
    def apply(schemas: pd.Series) -> pd.Series:
        return schemas.map(leaf_paths)

    return apply(F.schema_of_variant(record))


@lru_cache(maxsize=1024)
def leaf_paths(schema: str | None) -> list[str] | None:
    """Sorted leaf paths of a schema text; schemas are short and few."""
    if schema is None:
        return None
    paths, at = set(), 0

    def read(prefix: str) -> None:
        nonlocal at
        if schema.startswith("OBJECT<", at):
            at += 7
            while schema[at] != ">":
                if schema[at] == "`":
                    end = at + 1
                    while schema[end] != "`" or schema[end : end + 2] == "``":
                        end += 2 if schema[end] == "`" else 1
                    name, at = schema[at + 1 : end].replace("``", "`"), end + 1
                else:
                    end = schema.index(":", at)
                    name, at = schema[at:end], end
                at += 2  # colon and blank
                read(f"{prefix}.{name}" if prefix else name)
                if schema.startswith(", ", at):
                    at += 2
            at += 1
        elif schema.startswith("ARRAY<", at):
            at += 6
            read(prefix + "[]")
            at += 1
        else:
            paths.add(prefix)
            while at < len(schema) and schema[at] not in ",>":
                at = schema.index(")", at) + 1 if schema[at] == "(" else at + 1

    read("")
    return sorted(paths)


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant."""
    return F.sha2(F.array_join(field_paths(record), "\n"), 256)


def canonical_turns(
    records: DataFrame, key: str, json: str, layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """(key, layout, turn, role, text) rows of JSON records in any of the layouts.

    A record whose paths fit no layout, or that is null or no JSON, gives one row with a
    null layout and no turn: nothing disappears, and ``format_turns`` leaves such rows out.
    Null roles and texts become empty. A record with an empty list of messages has no
    paths below it and counts as unknown. The JSON parser refuses strings of more than
    20 million characters: a record that is long enough for that and can't be parsed
    raises. ``turns_of_columns`` has no such limit.
    """
    parsed = records.select(
        F.col(key).alias("key"), F.try_parse_json(json).alias("record"), F.length(json).alias("size")
    )
    refused = F.col("record").isNull() & (F.col("size") > PARSED)
    error = F.raise_error(F.concat(F.lit("a record of "), F.col("size"), F.lit(" characters cannot be parsed")))
    parsed = parsed.withColumn(
        "print", F.when(refused, error.cast("string")).otherwise(fingerprint(F.col("record")))
    )
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for layout in layouts:
        fits = F.col("print") == layout.fingerprint
        turns = F.when(fits, F.expr(layout.turns)).otherwise(turns)
        name = F.when(fits, F.lit(layout.name)).otherwise(name)
    return parsed.select("key", name.alias("layout"), F.explode_outer(turns).alias("t")).select(
        F.col("key").alias(key), "layout", "t.turn",
        F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"),
    )


def _paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Leaf paths of a type, as ``field_paths`` gives them for a record."""
    if isinstance(kind, T.StructType):
        return {p for f in kind for p in _paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)}
    return _paths(kind.elementType, prefix + "[]") if isinstance(kind, T.ArrayType) else {prefix}


def turns_of_columns(
    rows: DataFrame, key: str, columns: list[str], layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """``canonical_turns`` of a table whose ``columns`` are the fields of its records.

    All rows have one schema, so its paths are hashed once and pick the layout; texts of
    any length stay columns and pass no parser. If no layout fits, each row has a null
    layout and no turn, as has one with a null or empty list of messages.
    """
    record = rows.select(F.col(key).alias("key"), F.struct(*columns).alias("record"))
    print_ = _hashed(_paths(record.schema["record"].dataType))
    fitting = next((x for x in layouts if x.fingerprint == print_), None)
    turns = F.expr(fitting.of_columns) if fitting else F.lit(None)
    exploded = record.select("key", F.explode_outer(turns.cast(TURNS)).alias("t"))
    name = F.when(F.col("t").isNotNull(), F.lit(fitting.name)) if fitting else F.lit(None).cast("string")
    return exploded.select(
        F.col("key").alias(key), name.alias("layout"), "t.turn",
        F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"),
    )


def escaped(text: Column) -> Column:
    """Every backslash, < and [ followed by a backslash: no control string survives.

    All control strings in use begin with < or [; none has a backslash second.
    """
    return F.regexp_replace(text, r"([\\<\[])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def format_turns(turns: DataFrame, key: str) -> DataFrame:
    """Each turn as its segment of the formatted conversation, with its loss span.

    A conversation's formatted text is its segments in (turn, role, text) order, one
    after the other; they stay apart so that a conversation of any length is never held
    whole. ``loss_start`` and ``loss_length`` are code points inside the segment and
    cover the escaped text of an assistant's turn; other turns have length 0. Rows with
    a null layout, where there is such a column, are records that hold no turn, and go.
    """
    if "layout" in turns.columns:
        turns = turns.where(F.col("layout").isNotNull())
    header = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(BODY))
    body = escaped(F.col("text"))
    learned = F.col("role") == LEARNED_ROLE
    return turns.select(
        key, "turn", "role", "text",
        F.concat(header, body, F.lit(CLOSE)).alias("segment"),
        F.length(header).alias("loss_start"),
        F.when(learned, F.length(body)).otherwise(0).alias("loss_length"),
    ).select(
        key, "turn", "segment", "loss_start", "loss_length",
        F.struct("turn", "role", "text").alias("place"),
    )


def read_back(segments: DataFrame, key: str) -> DataFrame:
    """(key, place, role, text, learned, n_chars) read from the segments alone."""
    inner = F.expr(
        f"substring(segment, {len(OPEN) + 1}, "
        f"length(segment) - {len(OPEN) + len(CLOSE)})"
    )
    cut = F.locate(BODY, F.col("inner"))
    masked = F.expr("substring(segment, loss_start + 1, loss_length)")
    return segments.withColumn("inner", inner).select(
        key, "place",
        unescaped(F.substring("inner", F.lit(1), cut - 1)).alias("role"),
        unescaped(F.substring("inner", cut + len(BODY), F.length("inner"))).alias("text"),
        unescaped(masked).alias("learned"),
        F.length("segment").cast("long").alias("n_chars"),
    )


DIGESTS = (
    "key long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of sorted rows; a key may span any number of batches."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state: list | None = None

    def row() -> tuple:
        key, turns, said, chars, learned, total = state
        return key, turns, said.hexdigest(), chars, learned.hexdigest(), total

    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("key", "role", "text", "learned", "n_chars")]
        for key, role, text, learned, n_chars in zip(*columns):
            if state is None or state[0] != key:
                if state is not None:
                    done.append(row())
                state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(learned)
            state[4].update(learned.encode())
            state[5] += n_chars
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done), types)], names
            )
    if state is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([c], t) for c, t in zip(row(), types)], names
        )


def conversation_digests(segments: DataFrame, key: str) -> DataFrame:
    """Turn, loss and length digests of each conversation, read back from its segments.

    A SHA-256 needs its bytes in order, so a conversation is streamed through one task
    in sorted batches; its memory doesn't grow with the conversation.
    """
    turns = read_back(segments, key).withColumnRenamed(key, "key")
    ordered = turns.repartition(partitions(turns.sparkSession), "key").sortWithinPartitions(
        "key", "place"
    )
    streamed = ordered.select("key", "role", "text", "learned", "n_chars").mapInArrow(
        _digests, DIGESTS
    )
    return streamed.withColumnRenamed("key", key)
