"""A stored table with a key, of which an update rewrites only the buckets it touches.

Rows lie in buckets by the hash of their key. A version of the table is one small file
that names the folder of each bucket; the highest version counts. An update writes the
touched buckets into a new folder and then commits a version that points to it: readers
see the table before or after, never between, and untouched files stay as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentgrid.sources import stores

BUCKET = "_bucket"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Version:
    number: int
    schema: str
    keys: tuple[str, ...]
    buckets: int
    #: Where each bucket that has rows lies, relative to the table.
    folders: dict[str, str]


def _version_path(folder: str, number: int) -> str:
    return f"{folder}/_versions/{number:012}.json"


def version_numbers(spark: SparkSession, folder: str) -> list[int]:
    return [
        int(n.removesuffix(".json")) for n in stores.names(spark, f"{folder}/_versions")
        if n.endswith(".json") and not n.startswith(".")
    ]


def current(spark: SparkSession, folder: str) -> Version:
    numbers = version_numbers(spark, folder)
    if not numbers:
        raise FileNotFoundError(f"no keyed table in {folder}")
    held = json.loads(stores.read_text(spark, _version_path(folder, numbers[-1])))
    return Version(numbers[-1], held["schema"], tuple(held["keys"]), held["buckets"], held["folders"])


def _commit(spark: SparkSession, folder: str, version: Version) -> None:
    held = {k: v for k, v in vars(version).items() if k != "number"}
    stores.commit_text(spark, _version_path(folder, version.number), json.dumps(held))


def _write_buckets(rows: DataFrame, folder: str, keys: Sequence[str], buckets: int) -> dict[str, str]:
    """Rows into a new folder of the table; the folder of each bucket that got some."""
    name = f"data/{uuid.uuid4().hex}"
    placed = rows.withColumn(BUCKET, bucket_of(keys, buckets))
    placed.repartition(min(buckets, 200), BUCKET).write.partitionBy(BUCKET).parquet(f"{folder}/{name}")
    found = stores.names(rows.sparkSession, f"{folder}/{name}")
    return {n.partition("=")[2]: f"{name}/{n}" for n in found if n.startswith(f"{BUCKET}=")}


def create(rows: DataFrame, folder: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Store rows, one for each key, as a new table; raises if there is one."""
    if stores.exists(rows.sparkSession, f"{folder}/_versions"):
        raise FileExistsError(folder)
    folders = _write_buckets(rows, folder, keys, buckets)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).json()
    _commit(rows.sparkSession, folder, Version(0, schema, tuple(keys), buckets, folders))


def _rows_of(spark: SparkSession, folder: str, version: Version, buckets: Sequence[int] | None = None) -> DataFrame:
    asked = version.folders if buckets is None else {str(b) for b in buckets}
    paths = [f"{folder}/{p}" for b, p in version.folders.items() if b in asked]
    schema = T.StructType.fromJson(json.loads(version.schema))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The table's rows as of now; later updates don't change what is read."""
    return _rows_of(spark, folder, current(spark, folder))


def read_keys(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among ``wanted``; only the buckets of those keys are read."""
    version = current(spark, folder)
    rows = _rows_of(spark, folder, version, _touched(wanted, version))
    return rows.join(wanted.select(*version.keys).distinct(), list(version.keys), "left_semi")


def _touched(rows: DataFrame, version: Version) -> list[int]:
    """Numbers of the buckets that rows fall into: as many as there are buckets at most."""
    found = rows.select(bucket_of(version.keys, version.buckets).alias(BUCKET)).distinct()
    return [r[0] for r in found.collect()]


def update(batch: DataFrame, folder: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
           version: Version | None = None) -> int:
    """Replace the touched buckets by ``merge(their rows, batch)``; the number committed.

    ``merge`` must treat keys one by one, as all upserts of ``operators.keyed`` do. If another
    update has committed since the version was read, FileExistsError is raised and the table
    stays as the other left it; called again, the update starts from there. An update that
    dies leaves files that no version names; ``vacuum`` removes them.
    """
    spark = batch.sparkSession
    version = version or current(spark, folder)
    touched = _touched(batch, version)
    if not touched:
        return version.number
    stored = _rows_of(spark, folder, version, touched)
    merged = merge(stored, batch).select(*stored.columns)
    written = _write_buckets(merged, folder, version.keys, version.buckets)
    kept = {b: p for b, p in version.folders.items() if int(b) not in set(touched)}
    following = Version(version.number + 1, version.schema, version.keys, version.buckets, kept | written)
    _commit(spark, folder, following)
    return following.number


def vacuum(spark: SparkSession, folder: str, versions: int = 2) -> None:
    """Keep the last ``versions`` versions and their files; remove all others.

    Readers of older versions, and updates that still run, must have ended.
    """
    numbers = version_numbers(spark, folder)
    named: set[str] = set()
    for number in numbers[-versions:]:
        named.update(json.loads(stores.read_text(spark, _version_path(folder, number)))["folders"].values())
    for number in numbers[:-versions]:
        stores.remove(spark, _version_path(folder, number))
    for data in stores.names(spark, f"{folder}/data"):
        for bucket in stores.names(spark, f"{folder}/data/{data}"):
            if bucket.startswith(f"{BUCKET}=") and f"data/{data}/{bucket}" not in named:
                stores.remove(spark, f"{folder}/data/{data}/{bucket}")
        if not any(p.startswith(f"data/{data}/") for p in named):
            stores.remove(spark, f"{folder}/data/{data}")
