"""Where jobs keep checkpoints and intermediate tables."""

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only where a local run or test names none a temporary folder is made and set, so that
    later calls in the session share it. On a cluster a folder of the driver's own would hide
    rows from the executors, so there it is an error to name none.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="hostweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared root that no other run uses."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
