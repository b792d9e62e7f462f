"""File-tree inventories, landed or walked on shared storage."""

import os
import sys
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from hostweave import schemas
from hostweave.workspace import fresh_dir

# Entries a task lists before it hands its remaining directories on.
TASK_ENTRIES = 50_000

_SCHEMA = (
    "node_name string, path string, is_dir boolean, size bigint, mtime_us bigint, pending boolean"
)
_ARROW = pa.schema(
    [
        ("node_name", pa.string()),
        ("path", pa.string()),
        ("is_dir", pa.bool_()),
        ("size", pa.int64()),
        ("mtime_us", pa.int64()),
        ("pending", pa.bool_()),
    ]
)


def _listed(folder: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """Entries of one directory; links are not followed, unreadable ones are skipped."""
    try:
        with os.scandir(folder) as found:
            for entry in found:
                is_dir = entry.is_dir(follow_symlinks=False)
                try:
                    stat = entry.stat(follow_symlinks=False)
                    yield entry.path, is_dir, stat.st_size, stat.st_mtime_ns // 1000
                except OSError:
                    yield entry.path, is_dir, None, None
    except OSError:
        return


def _walk(node_name: str, task_entries: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = deque(p for b in batches for p in b.column("path").to_pylist())
        listed = 0
        while waiting and listed < task_entries:
            rows = []
            for path, is_dir, size, mtime_us in _listed(waiting.popleft()):
                rows.append((node_name, path, is_dir, size, mtime_us, False))
                if is_dir:
                    waiting.append(path)
            listed += len(rows) + 1
            yield _batch(rows)
        yield _batch([(node_name, path, True, None, None, True) for path in waiting])

    return walk


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
    )


def read_path_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Landed inventory rows (Parquet)."""
    return spark.read.schema(schemas.PATH_INVENTORY).parquet(path)


def scan_file_tree(
    spark: SparkSession, root: str, node_name: str = "", task_entries: int = TASK_ENTRIES
) -> DataFrame:
    """Entries below ``root``, which every executor must have mounted.

    Walks in rounds: a task lists some ten thousand entries, breadth first, and hands the
    directories it has not reached to the next round, where they are dealt out anew. A
    subtree with most of the files is so spread over all tasks. The rounds are written to
    the shared folder. A missing root yields nothing.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    work = fresh_dir(spark, "inventory")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier = spark.createDataFrame([(root.removeprefix("file:"),)], "path string")
    rounds = 0
    while True:
        target = f"{work}/round={rounds}"
        frontier.mapInArrow(_walk(node_name, task_entries), _SCHEMA).write.parquet(target)
        found = spark.read.schema(_SCHEMA).parquet(target)
        frontier = found.filter("pending").select("path").repartition(tasks)
        rounds += 1
        if frontier.isEmpty():
            break
    written = spark.read.schema(_SCHEMA).parquet(*[f"{work}/round={i}" for i in range(rounds)])
    return written.filter(~F.col("pending")).drop("pending")
