"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from talentgrid.sources import stores

LOCAL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The test tables shuffle little but compute much: keep all cores busy.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "8", app: str = "talentgrid", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in LOCAL_SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    Written tables must be readable from every executor. Where the setting is missing,
    Spark's warehouse is used, if the executors share it: a warehouse in local files does
    for a local session alone, and raises on a cluster.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/talentgrid-work"
        master = spark.sparkContext.master
        in_files = base.startswith("file:") or "://" not in base
        if in_files and not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Folders that the innermost open ``scratch`` will remove.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are settled inside are removed at the end.

    For a step whose result is written before the end: what reads those tables later fails.
    """
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
        for folder in made:
            stores.remove(spark, folder)


def settle(df: DataFrame, purpose: str, keep: bool = False) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    Used where recomputing costs more than storing: the input is scanned and parsed
    once, and a lost executor costs nothing already written. The table stays, unless it was
    written inside ``scratch``; with ``keep`` it stays there too.
    """
    folder = shared_folder(df.sparkSession, purpose)
    if _scratch and not keep:
        _scratch[-1].append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
