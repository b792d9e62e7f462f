"""File trees: counts below monitored roots, sizes, scan states."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructType

from hostweave.functions.globs import any_path_element_regex
from hostweave.operators.ranking import top_n_per_group
from hostweave.workspace import fresh_dir

SCAN_TIMEOUT_TEXT = "scan timeout exceeded"


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def within_depth(path: Column, root: Column, max_depth: Column) -> Column:
    """Depth below the root as it is written: a trailing slash allows one more level."""
    return (max_depth <= 0) | (_slashes(path) - _slashes(root) <= max_depth)


def containment_key(root: Column) -> Column:
    """A root without trailing slashes; the file system root becomes the empty string."""
    return F.regexp_replace(root, r"/+\z", "")


def ancestors(path: Column, include_self: bool = False) -> Column:
    """Directories above a path, outermost first; ``""`` stands for ``/``."""
    parts = F.split(path, "/")
    count = F.size(parts) if include_self else F.size(parts) - 1
    steps = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def under_roots(inventory: DataFrame, roots: DataFrame) -> DataFrame:
    """Inventory rows paired with every root at or above them.

    Prefix containment as an equi-join: each path is exploded into its ancestors and
    looked up by (node, ancestor). Roots whose bytes Spark finds small are broadcast; more of
    them join by shuffle, with adaptive skew splitting. Adds the roots' columns (their path as
    ``root``) and ``rel``, the path below the root.
    """
    keyed = roots.withColumn("_root", containment_key(F.col("root")))
    exploded = inventory.withColumn("_root", F.explode(ancestors(F.col("path"), True)))
    rel = F.substr(F.col("path"), F.length("_root") + 2)
    return exploded.join(keyed, ["node_name", "_root"]).withColumn("rel", rel).drop("_root")


def limit_depth(pairs: DataFrame) -> DataFrame:
    """Rows of :func:`under_roots` no deeper than their root's ``max_depth`` (0: no limit)."""
    return pairs.filter(within_depth(F.col("path"), F.col("root"), F.col("max_depth")))


def not_excluded(rel: Column, regex: Column) -> Column:
    """No element of ``rel``, the entry's own name included, matches; NULL excludes nothing."""
    return F.when(regex.isNull(), F.lit(True)).otherwise(~F.rlike(rel, regex))


def compile_excludes(roots: DataFrame) -> DataFrame:
    """Replaces the ``exclude`` patterns of roots by one ``exclude_regex`` per root."""
    regex = any_path_element_regex(F.col("exclude"))
    return roots.withColumn("exclude_regex", regex).drop("exclude")


def exclude_paths(pairs: DataFrame) -> DataFrame:
    """Rows of :func:`under_roots` without those an exclude pattern of their root prunes."""
    return pairs.filter(not_excluded(F.col("rel"), F.col("exclude_regex")))


def path_counts(inventory: DataFrame, specs: DataFrame) -> DataFrame:
    """Files and directories below each specified root, after depth and excludes.

    ``inventory`` is one snapshot (see ``current_snapshot``); ``specs`` are resolved. Of specs
    that name a root twice the first by ``idx`` counts, if there is such a column. A root nothing was found under has zero counts, status OK and
    ``root_found`` false. Rows are counted before the shuffle, so a root over most of the
    fleet's files costs one row per task.
    """
    place = "idx" if "idx" in specs.columns else "max_depth"
    first = F.min_by(F.struct("max_depth", "exclude"), place).alias("_spec")
    specs = specs.groupBy("node_name", "path").agg(first).select("node_name", "path", "_spec.*")
    roots = compile_excludes(
        specs.select("node_name", F.col("path").alias("root"), "max_depth", "exclude")
    )
    pairs = under_roots(inventory.select("node_name", "path", "is_dir"), roots)
    counted = (
        (F.col("rel") != "")
        & within_depth(F.col("path"), F.col("root"), F.col("max_depth"))
        & not_excluded(F.col("rel"), F.col("exclude_regex"))
    )
    counts = (
        pairs.withColumn("_counted", counted)
        .groupBy("node_name", F.col("root").alias("path"))
        .agg(
            F.count_if(F.col("_counted") & ~F.col("is_dir")).alias("file_count"),
            F.count_if(F.col("_counted") & F.col("is_dir")).alias("dir_count"),
        )
    )
    return (
        specs.select("node_name", "path")
        .join(counts.withColumn("root_found", F.lit(True)), ["node_name", "path"], "left")
        .select(
            "node_name", "path",
            F.coalesce("file_count", F.lit(0)).alias("file_count"),
            F.coalesce("dir_count", F.lit(0)).alias("dir_count"),
            F.coalesce("root_found", F.lit(False)).alias("root_found"),
            F.lit("OK").alias("status"),
        )
    )


def scan_status(scans: DataFrame) -> DataFrame:
    """Status and message of scans from their duration, timeout and error text.

    Counts of a timed-out scan are kept as they are: they are partial.
    """
    timed_out = F.col("scan_duration_ms") > F.col("timeout_ms")
    return scans.withColumns(
        {
            "status": F.when(timed_out | F.col("scan_error").isNotNull(), "ERROR").otherwise("OK"),
            "error_message": F.when(timed_out, SCAN_TIMEOUT_TEXT).otherwise(
                F.coalesce("scan_error", F.lit(""))
            ),
        }
    )


def directory_sizes(inventory: DataFrame) -> DataFrame:
    """Bytes of all files below each directory."""
    files = inventory.filter(~F.col("is_dir"))
    return (
        files.select("node_name", "size", F.explode(ancestors(F.col("path"))).alias("path"))
        .groupBy("node_name", "path")
        .agg(F.sum("size").alias("size"))
    )


def rolled_up_sizes(inventory: DataFrame) -> DataFrame:
    """Bytes and number of all files below each directory, as :func:`directory_sizes`, summed level by level.

    Files are summed into their directory once; then each level, the deepest first, is added to
    its parents. So a row is handled once for its file and once a level for its directory, instead of
    once for every directory above each file. Levels are written to the shared folder: a plan has one level.
    """
    spark = inventory.sparkSession
    work = fresh_dir(spark, "rolled-up")
    parent = F.regexp_replace("path", r"/[^/]*\z", "")
    files = inventory.filter(~F.col("is_dir") & F.col("path").contains("/"))
    own = files.groupBy("node_name", parent.alias("path")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("files"))
    own.withColumn("depth", _slashes(F.col("path"))).write.partitionBy("depth").parquet(f"{work}/own")
    schema = own.schema
    held = spark.read.schema(StructType([*schema.fields]).add("depth", IntegerType())).parquet(f"{work}/own")
    deepest = held.agg(F.max("depth")).first()[0]
    levels = []
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        rows = held.filter(F.col("depth") == depth).drop("depth")
        if levels:
            rows = rows.unionByName(spark.read.schema(schema).parquet(levels[-1]).withColumn("path", parent))
        levels.append(f"{work}/level={depth}")
        rows.groupBy("node_name", "path").agg(F.sum("size").alias("size"), F.sum("files").alias("files")).write.parquet(levels[-1])
    return spark.read.schema(schema).parquet(*levels) if levels else held.drop("depth")


def largest_files(inventory: DataFrame, roots: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest files and directories below each root (``node_name, root``)."""
    files = inventory.filter(~F.col("is_dir")).select("node_name", "path", "is_dir", "size")
    folders = directory_sizes(inventory).select(
        "node_name", "path", F.lit(True).alias("is_dir"), "size"
    )
    pairs = under_roots(files.unionByName(folders), roots).filter(F.col("rel") != "").drop("rel")
    order = [F.col("size").desc(), F.col("path")]
    return top_n_per_group(pairs, ["node_name", "root"], order, n)
