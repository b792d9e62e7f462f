"""Written tables in the shared folder, and reading files by URI inside tasks."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from hostweave.workspace import fresh_dir


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, stored once in the shared folder and read from there.

    Later stages neither run its plan again nor depend on the executors that made it. Zstandard
    takes less disk than the default, and no direct memory that stays until a collection.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(df: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """``df`` with every column but the needed ones renamed to _x0, _x1, .., and the needed first
    of each name kept, so that no other column can clash; and its names before."""
    names, left = df.columns, list(needed)
    for name in names:
        if name in left:
            left.remove(name)
    if left:
        raise ValueError(f"no column {', '.join(left)}")
    left, renamed = list(needed), []
    for i, name in enumerate(names):
        renamed.append(name if name in left else f"_x{i}")
        if name in left:
            left.remove(name)
    return df.toDF(*renamed), names


def only(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, whatever others there are."""
    return set_aside(df, *needed)[0].select(*needed)


def schema_with(fields: StructType | list, more: str) -> StructType:
    """The fields, and those of a DDL string."""
    return StructType([*fields, *StructType.fromDDL(more).fields])


def output_folder(spark: SparkSession, label: str, path: str | None) -> str:
    """The folder for an operator's files: the caller's, or a new one in the shared folder."""
    return (path or fresh_dir(spark, label)).rstrip("/")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute local path; Spark's names of S3 are taken, too."""
    uri = re.sub(r"\As3[an]://", "s3://", uri)
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
