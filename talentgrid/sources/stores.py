"""Files beside Spark's own: listing, removing, and committing by one rename."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    system, path = _system(spark, folder), _path(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def remove(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def read_text(spark: SparkSession, path: str) -> str:
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def commit_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all; raises FileExistsError if there is one."""
    draft = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    stream = _system(spark, draft).create(_path(spark, draft), True)
    stream.write(bytearray(text.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(
        _path(spark, draft).makeQualified(_system(spark, draft)).toUri(), spark._jsc.hadoopConfiguration()
    )
    # Without the option to overwrite, a rename onto a file fails.
    plain = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    whole = [_path(spark, p).makeQualified(_system(spark, p)) for p in (draft, path)]
    try:
        files.rename(*whole, plain)
    except Py4JJavaError as error:
        remove(spark, draft)
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise FileExistsError(path) from None
        raise
