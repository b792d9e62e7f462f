"""Mount tables and filesystem counters."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hostweave import schemas
from hostweave.functions.text import trimmed, words
from hostweave.functions.usage import avail_bytes, ratio_percent, total_bytes, used_bytes

# Filesystem types that hold no disk data.
PSEUDO_FILESYSTEMS = (
    "proc", "sysfs", "devpts", "tmpfs", "devtmpfs", "cgroup", "cgroup2", "pstore", "bpf",
    "tracefs", "debugfs", "securityfs", "hugetlbfs", "mqueue",
)
FALLBACK_MOUNT = "/"


def is_pseudo_fs(fstype: Column) -> Column:
    return fstype.isin(*PSEUDO_FILESYSTEMS)


def is_block_device(device: Column) -> Column:
    return device.startswith("/dev/")


def exclude_pseudo_fs(df: DataFrame, fstype: str = "fstype") -> DataFrame:
    return df.filter(~is_pseudo_fs(F.col(fstype)))


def only_block_devices(df: DataFrame, device: str = "device") -> DataFrame:
    return df.filter(is_block_device(F.col(device)))


def fs_samples_from_counters(counters: DataFrame) -> DataFrame:
    """Usage rows from statfs counters. Rows without counters (stat failed) are skipped."""
    blocks, bfree, bavail, bsize = (F.col(c) for c in ("blocks", "bfree", "bavail", "bsize"))
    total, used = total_bytes(blocks, bsize), used_bytes(blocks, bfree, bsize)
    return counters.dropna(subset=["blocks", "bfree", "bavail", "bsize"]).select(
        "node_name",
        "mount_point",
        total.alias("total_bytes"),
        used.alias("used_bytes"),
        avail_bytes(bavail, bsize).alias("avail_bytes"),
        ratio_percent(used, total).alias("used_percent"),
        "collected_at",
        "seq",
    )


def read_fs_samples(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Landed JSON counters, as a table or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return fs_samples_from_counters(reader.schema(schemas.FS_COUNTERS).json(path))


_CAPTURE = ["node_name", "capture_id"]


def _proc_mounts_fields(lines: DataFrame) -> DataFrame:
    split = lines.select(*_CAPTURE, "pos", words(F.col("line")).alias("f"))
    fields = [F.get("f", F.lit(i)) for i in range(3)]
    sound = (F.size("f") >= 3) & ~is_pseudo_fs(fields[2]) & is_block_device(fields[0])
    return split.select(
        *_CAPTURE, "pos",
        F.when(sound, fields[0]).alias("device"),
        F.when(sound, fields[1]).alias("mount_point"),
    )


def _bsd_mount_fields(lines: DataFrame) -> DataFrame:
    # The first " on " ends the device, the last " (" ends the mount point.
    shape = r"(?s)\A(.*?) on (.*) \("
    device = trimmed(F.regexp_extract("line", shape, 1))
    sound = F.col("line").rlike(shape) & is_block_device(device)
    return lines.select(
        *_CAPTURE, "pos",
        F.when(sound, device).alias("device"),
        F.when(sound, trimmed(F.regexp_extract("line", shape, 2))).alias("mount_point"),
    )


def first_per_device(mounts: DataFrame) -> DataFrame:
    """Keep the first mount of each device of a capture, in line order."""
    return (
        mounts.groupBy(*_CAPTURE, "device")
        .agg(F.min_by(F.struct("mount_point", "pos"), "pos").alias("m"))
        .select(*_CAPTURE, "device", "m.mount_point", "m.pos")
    )


def parse_mount_captures(
    lines: DataFrame, dialect: str = "linux", unreachable: DataFrame | None = None
) -> DataFrame:
    """Mount points of each capture from lines of ``node_name, capture_id, pos, line``.

    ``unreachable`` (``node_name, capture_id, mount_point``) lists mounts whose stat
    failed: in the ``bsd`` dialect these do not use up their device. A capture that
    keeps no mount yields the single mount ``/`` with NULL device and position.
    """
    if dialect == "linux":
        mounts = _proc_mounts_fields(lines)
    elif dialect == "bsd":
        mounts = _bsd_mount_fields(lines)
        if unreachable is not None:
            failed = unreachable.select(*_CAPTURE, "mount_point").distinct()
            mounts = mounts.join(
                failed.withColumn("_failed", F.lit(True)), [*_CAPTURE, "mount_point"], "left"
            ).withColumn("device", F.when(F.col("_failed").isNull(), F.col("device")))
    else:
        raise ValueError(f"unknown dialect: {dialect}")
    # Rejected lines share the NULL device, so a capture without mounts keeps a row and
    # one pass over the lines is enough. What the window sees is one row per device.
    kept = F.count("device").over(Window.partitionBy(*_CAPTURE))
    return (
        first_per_device(mounts)
        .withColumn("_kept", kept)
        .filter(F.col("device").isNotNull() | (F.col("_kept") == 0))
        .select(
            *_CAPTURE,
            "device",
            F.when(F.col("device").isNull(), F.lit(FALLBACK_MOUNT))
            .otherwise(F.col("mount_point")).alias("mount_point"),
            F.when(F.col("device").isNotNull(), F.col("pos")).alias("pos"),
        )
    )
