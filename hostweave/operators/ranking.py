"""First, last and largest rows: globally and per group."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

# Row counts of the reports.
TOP_ROWS = 10
TAIL_ROWS = 200

#: Literal bound up to which Spark cuts a group's rows in each task before the shuffle.
CUT_IN_TASK = 1000


def _parts(df: DataFrame) -> int:
    """Parts of a group: the square root of the shuffle width balances both rounds."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, math.isqrt(width))


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int | Column) -> DataFrame:
    """First ``n`` rows of each group in ``order``, a total order; exact for any skew.

    A column ``n`` must be the same in all rows of a group. For a literal of up to
    ``CUT_IN_TASK`` Spark cuts rows in each task before the shuffle (WindowGroupLimit).
    Otherwise groups are cut in two rounds, within parts of the group and
    then over what the parts kept; a part is a share of the input partitions.
    """

    def keep(rows: DataFrame, group: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")

    if isinstance(n, int) and n <= CUT_IN_TASK:
        return keep(df, keys)
    parted = df.withColumn("_part", F.spark_partition_id() % _parts(df))
    return keep(keep(parted, [*keys, "_part"]).select(*df.columns), keys)


def rows_before(rows: Column, keys: list[str], order: list[Column]) -> Column:
    """Sum of ``rows`` over what comes before in ``order``; 0 for the first."""
    before = Window.partitionBy(*keys).orderBy(*order)
    return F.coalesce(F.sum(rows).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def newest_by_quota(df: DataFrame, quotas: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest ``_quota`` rows of each group, of which there are ``_rows``; groups that fit pass whole."""
    counted = df.join(quotas.filter(F.col("_quota") > 0), keys)
    whole = counted.filter(F.col("_rows") <= F.col("_quota"))
    newest = [F.col(c).desc() for c in order]
    cut = top_n_per_group(counted.filter(F.col("_rows") > F.col("_quota")), keys, newest, F.col("_quota"))
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def newest_n_counted(df: DataFrame, keys: list[str], order: list[str], n: int, bucket: Column) -> DataFrame:
    """Newest ``n`` rows per group for large ``n``, sorting as little as possible.

    ``bucket`` must not decrease along ``order``. Rows are counted per group and bucket;
    buckets that fit the quota pass whole, older ones are dropped, and only the bucket
    the quota ends in is ranked.
    """
    bucketed = df.withColumn("_bucket", bucket)
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    quota = F.lit(n) - rows_before(F.col("_rows"), keys, [F.col("_bucket").desc()])
    kept = newest_by_quota(bucketed, counts.withColumn("_quota", quota), [*keys, "_bucket"], order)
    return kept.select(*df.columns)


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position in a group that is already cut to a bounded size."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_rows(df: DataFrame, column: str, tie_break: str, n: int = TOP_ROWS) -> DataFrame:
    """The ``n`` rows with the largest ``column``; plans as one top-k, not as a sort."""
    return df.orderBy(F.col(column).desc(), F.col(tie_break)).limit(n)


def top_cpu(processes: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    return top_rows(processes, "cpu_percent", "pid", n)


def top_mem(processes: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    return top_rows(processes, "mem_rss", "pid", n)


def top_per_node(processes: DataFrame, column: str, n: int = TOP_ROWS) -> DataFrame:
    """The largest ``n`` of every node, with their rank."""
    order = [F.col(column).desc(), F.col("pid")]
    kept = top_n_per_group(processes, ["node_name"], order, n)
    return rank_within(kept, ["node_name"], order)


def first_n_in_capture(processes: DataFrame, n: int | Column) -> DataFrame:
    """First ``n`` rows of each capture in listing order (no sort by CPU)."""
    capture = ["node_name", "snapshot_id"]
    return top_n_per_group(processes, capture, [F.col("pos")], n)


def list_processes(processes: DataFrame) -> DataFrame:
    return processes.orderBy(F.col("cpu_percent").desc(), "pid")
