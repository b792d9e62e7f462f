"""Tables replaced as a whole: one complete folder per version, the newest one counts.

There is no table format to lean on, so a version is written beside the older ones and
becomes visible with its ``_SUCCESS`` file. Versions are numbered by the table, not by any
stream: a new checkpoint goes on where the table stands. Beside its rows a version keeps the
last batch of every run that it holds, which makes a repeated micro-batch harmless.
"""

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

KEPT_VERSIONS = 3
#: Local property in which a running stream names itself; it stays with the checkpoint.
RUN_PROPERTY = "sql.streaming.queryId"


def run_of(spark: SparkSession) -> str:
    """The stream whose micro-batch is being written; outside a stream, one common name."""
    return spark.sparkContext.getLocalProperty(RUN_PROPERTY) or "batch"


def _folder(base: str, version: int) -> str:
    return f"{base}/version={version}"


def file_system(spark: SparkSession, base: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(base)
    return hadoop, path.getFileSystem(spark._jsc.hadoopConfiguration())


def complete_versions(spark: SparkSession, base: str) -> list[int]:
    hadoop, fs = file_system(spark, base)
    found = fs.globStatus(hadoop.Path(f"{base}/version=*/rows/_SUCCESS")) or []
    return sorted(int(s.getPath().getParent().getParent().getName().split("=")[1]) for s in found)


def read_version(spark: SparkSession, base: str) -> DataFrame | None:
    """The newest complete version."""
    known = complete_versions(spark, base)
    return spark.read.parquet(f"{_folder(base, known[-1])}/rows") if known else None


def held_batches(spark: SparkSession, base: str) -> dict[str, int]:
    """The last batch of each run that the newest version holds."""
    known = complete_versions(spark, base)
    if not known:
        return {}
    return json.loads(spark.read.text(f"{_folder(base, known[-1])}/runs", wholetext=True).first()[0])


def apply_batch(
    batch: DataFrame, batch_id: int, base: str, change: Callable[[DataFrame | None], DataFrame]
) -> None:
    """Writes ``change`` of the held rows (None at first) as the next version, once per batch."""
    spark, run = batch.sparkSession, run_of(batch.sparkSession)
    known, runs = complete_versions(spark, base), held_batches(spark, base)
    if runs.get(run, -1) >= batch_id:
        return
    target = _folder(base, known[-1] + 1 if known else 0)
    marks = spark.createDataFrame([(json.dumps(runs | {run: batch_id}),)], "value string")
    marks.coalesce(1).write.mode("overwrite").text(f"{target}/runs")
    change(read_version(spark, base)).write.mode("overwrite").parquet(f"{target}/rows")
    _drop_old_versions(spark, base)


def _drop_old_versions(spark: SparkSession, base: str, keep: int = KEPT_VERSIONS) -> None:
    """Deletes all but the newest versions; ``keep`` leaves time to running readers."""
    hadoop, fs = file_system(spark, base)
    for version in complete_versions(spark, base)[:-keep]:
        fs.delete(hadoop.Path(_folder(base, version)), True)
