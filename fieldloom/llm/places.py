"""Folders as executors see them."""

from __future__ import annotations

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the file system Spark resolves it on, so that executors and Spark mean one place."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return with_slashes(place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString())


def with_slashes(uri: str) -> str:
    """A URI that names a host part, if an empty one: `file:/a` becomes `file:///a`."""
    scheme, colon, rest = uri.partition(":")
    return uri if not colon or rest.startswith("//") else f"{scheme}://{rest}"


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and the path on it; schemes are those that Arrow reads (file, hdfs, viewfs, s3, gs, abfs)."""
    return arrow_fs.FileSystem.from_uri(uri)
