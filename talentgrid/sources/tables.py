"""Reading and writing the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentgrid.sources import schemas


_REJECTED = "_rejected"


#: What stands for a line break in a file is the escape character with a letter; the
#: escape character itself comes first. Texts without either are written as they are.
_ESCAPES = (("\x1b", "\x1be"), ("\n", "\x1bn"), ("\r", "\x1br"))


def _escaped(text: Column) -> Column:
    """Text on one line."""
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _unescaped(text: Column) -> Column:
    for plain, written in reversed(_ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _parsed_csv(spark: SparkSession, path: str, schema: str, line_breaks: str, mode: str) -> DataFrame:
    """Rows with ``_rejected``, the line of a row that doesn't fit the schema, or null.

    Every column is read whatever is selected later, as a value can only be found wrong
    where it is read.
    """
    if line_breaks not in ("escaped", "quoted"):
        raise ValueError(f"line breaks are 'escaped' or 'quoted', not {line_breaks!r}")
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    layout = fields if mode == "FAILFAST" else T.StructType([*fields, T.StructField(_REJECTED, T.StringType())])
    rows = (
        spark.read.schema(layout).options(
            header=True, escape='"', multiLine=line_breaks == "quoted", mode=mode,
            columnNameOfCorruptRecord=_REJECTED, columnPruning=False,
        ).csv(path)
    )
    all_read = F.pmod(F.xxhash64(*layout.names), F.lit(2)) >= 0
    return rows.withColumn("_file", F.col("_metadata.file_path")).where(all_read)


def _texts_unescaped(rows: DataFrame, schema, line_breaks: str) -> DataFrame:
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return rows.select(
        *[
            _unescaped(F.col(f.name)).alias(f.name)
            if line_breaks == "escaped" and isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in fields
        ]
    )


def read_csv(spark: SparkSession, path: str, schema: str, line_breaks: str = "escaped") -> DataFrame:
    """A CSV table with a header and a declared schema.

    A row that doesn't fit the schema raises when it is read, and so does a missing path.
    Files of ``write_csv`` have their line breaks escaped, so Spark cuts a large file into
    many tasks; with "quoted" a break may stand inside quotes, and a file is one task.
    """
    parsed = _parsed_csv(spark, path, schema, line_breaks, "FAILFAST")
    return _texts_unescaped(parsed, schema, line_breaks)


def read_csv_with_rejects(spark: SparkSession, path: str, schema: str,
                          line_breaks: str = "escaped") -> tuple[DataFrame, DataFrame]:
    """(rows that fit the schema, rejected lines): every line is in one of the two.

    A rejected line comes with its file and a reason: "fields" where their number is
    wrong, "value" where one is not of its column's type.
    """
    parsed = _parsed_csv(spark, path, schema, line_breaks, "PERMISSIVE")
    good = _texts_unescaped(parsed.where(F.col(_REJECTED).isNull()), schema, line_breaks)
    # What is quoted holds no separators.
    unquoted = F.regexp_replace(_REJECTED, r'"(?:[^"]|"")*"', "")
    width = len(parsed.columns) - 2
    reason = F.when(F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","))) + 1 == width, "value")
    rejected = parsed.where(F.col(_REJECTED).isNotNull()).select(
        F.col("_file").alias("file"), F.col(_REJECTED).alias("line"), reason.otherwise("fields").alias("reason"),
    )
    return good, rejected


def read_csv_postings(spark: SparkSession, path: str, schema: str = schemas.CLEANED_CSV,
                      line_breaks: str = "escaped") -> DataFrame:
    """Cleaned postings from CSV; a missing path or a row that doesn't fit raises."""
    return read_csv(spark, path, schema, line_breaks)


def read_parquet_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def read_jdbc_table(spark: SparkSession, url: str, table: str, column: str, lower, upper,
                    partitions: int, properties: dict[str, str] | None = None) -> DataFrame:
    """A database table read in ``partitions`` ranges of a numeric or date column."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower,
                 upperBound=upper, numPartitions=partitions, **(properties or {}))
        .load()
    )


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: tuple[str, ...] = (), compression: str = "zstd") -> None:
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; arrays, maps and structs are written as JSON text.

    A record is one line: line breaks inside texts are escaped. An empty text comes back as
    null, as CSV has no two forms for them that every reader tells apart.
    """
    nested = (T.ArrayType, T.MapType, T.StructType)

    def flattened(f: T.StructField) -> Column:
        if isinstance(f.dataType, nested):
            return _escaped(F.to_json(f.name)).alias(f.name)
        return _escaped(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)

    flat = df.select(*[flattened(f) for f in df.schema.fields])
    flat.write.mode(mode).options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def url_results(results: DataFrame) -> DataFrame:
    """The seven columns of URL results that are kept."""
    return results.select(
        "slug", "final_url", "type", "success", "attempts", "status_code", "error"
    )
