"""Process filters and rates."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.functions.clock import MICROS, micros
from hostweave.functions.globs import any_process_glob, any_process_glob_of, process_glob_regex


def match_any_glob(processes: DataFrame, patterns: list[str], column: str = "name") -> DataFrame:
    """Rows whose name matches any pattern; no patterns keep all rows."""
    regex = any_process_glob_of(patterns)
    return processes if regex is None else processes.filter(F.rlike(F.col(column), regex))


def match_spec_globs(processes: DataFrame, specs: DataFrame) -> DataFrame:
    """As above with each node's own patterns, plus the node's ``top_n``.

    The patterns of a node become one regex, so this is an equi-join on the node and
    not a join on the match. Nodes without a specification keep all rows.
    """
    compiled = specs.select("node_name", "top_n", any_process_glob(F.col("patterns")).alias("_regex"))
    joined = processes.join(compiled, "node_name", "left")
    keep = F.col("_regex").isNull() | F.rlike(F.col("name"), F.col("_regex"))
    return joined.filter(keep).drop("_regex")


#: Letters of the pieces by which names and patterns meet.
GRAM = 3


def _folded(text: Column) -> Column:
    """In one case as case-insensitive matching sees it; dots above go, of which a lower-case i would keep one.
    Something stands between upper and lower, or Spark takes the one for the other."""
    return F.translate(F.lower(F.translate(F.upper(text), "\u0307", "")), "\u0307", "")


def match_patterns(processes: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs of a distinct ``name`` and the ``pattern_id`` (pattern_id, pattern) of each pattern that matches it.

    For very many patterns: a pattern is looked up by one piece, of up to ``GRAM`` letters, of its longest run of
    plain ASCII letters and digits, which every name that it matches must hold; names are indexed by all
    their pieces. Only pairs that share the piece are matched, each once, however many rows have
    the name. The piece that fewest names hold is taken. Patterns without such a run are matched with every name.
    """
    names = processes.select("name").filter("name IS NOT NULL").distinct()
    letters = _folded(F.col("name"))
    at = F.sequence(F.lit(1), F.greatest(F.length(letters), F.lit(1)))

    def pieces_of(length: int) -> Column:
        return F.transform(at, lambda i: F.substr(letters, i, F.lit(length)))

    pieces = [pieces_of(n) for n in range(1, GRAM + 1)]
    index = names.select("name", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *pieces))).alias("_piece"))
    runs = F.regexp_extract_all(F.lower("pattern"), F.lit("([a-z0-9]+)"), F.lit(1))
    longest = F.aggregate(runs, F.lit(""), lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best))
    spec = patterns.filter("pattern IS NOT NULL").select("pattern_id", process_glob_regex(F.col("pattern")).alias("_regex"), longest.alias("_run"))
    size = F.least(F.length("_run"), F.lit(GRAM))
    own = F.when(F.length("_run") == 0, F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.lit(1), F.length("_run") - size + 1), lambda i: F.substr(F.col("_run"), i, size))
    )
    held = index.groupBy("_piece").agg(F.count(F.lit(1)).alias("_names"))
    rarest = F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("_names"), "_piece")).alias("_best")
    chosen = spec.withColumn("_piece", F.explode(own)).join(held, "_piece", "left").groupBy("pattern_id", "_regex").agg(rarest)
    chosen = chosen.select("pattern_id", "_regex", F.col("_best._piece").alias("_piece"))
    return index.join(chosen, "_piece").filter(F.rlike("name", F.col("_regex"))).select("name", "pattern_id")


def with_previous(
    samples: DataFrame,
    keys: list[str],
    order: str,
    columns: list[str],
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Adds ``prev_<column>`` from the row before in time order (``order`` unique per key).

    A key is not sorted by one task but per time bucket, and the last row of every bucket,
    found by a pre-aggregation, is carried into the bucket that follows. Choose the bucket so
    that a key's rows in it suit one task.
    """
    previous = {c: f"prev_{c}" for c in columns}
    width = F.lit(bucket_seconds * MICROS).cast("bigint")
    bucket = F.call_function("div", micros(F.col(order)), width)
    bucketed = samples.withColumn("_bucket", bucket)
    last = bucketed.groupBy(*keys, "_bucket").agg(
        *[F.max_by(c, order).alias(name) for c, name in previous.items()]
    )
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    carried = last.select(
        *keys, "_bucket", *[F.lag(name).over(by_bucket).alias(name) for name in previous.values()]
    )
    # A carried row stands in front of its bucket and is dropped after the lag.
    rows = bucketed.withColumn("_carried", F.lit(False)).unionByName(
        carried.select(
            *keys, "_bucket", *[F.col(name).alias(c) for c, name in previous.items()],
            F.lit(True).alias("_carried"),
        ),
        allowMissingColumns=True,
    )
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_carried").desc(), order)
    return (
        rows.withColumns({name: F.lag(c).over(in_bucket) for c, name in previous.items()})
        .filter(~F.col("_carried"))
        .select(*samples.columns, *previous.values())
    )


def cpu_delta(samples: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """CPU percent between samples from the used CPU time ``cpu_time_ms``.

    NULL for the first sample of a process and where its CPU time went back (a new
    process with a reused id).
    """
    paired = with_previous(
        samples, ["node_name", "pid"], "collected_at", ["cpu_time_ms", "collected_at"],
        bucket_seconds,
    )
    used = F.col("cpu_time_ms") - F.col("prev_cpu_time_ms")
    wall = micros(F.col("collected_at")) - micros(F.col("prev_collected_at"))
    percent = F.when(
        (used >= 0) & (wall > 0),
        used.cast("double") * F.lit(1000.0) / wall.cast("double") * F.lit(100.0),
    )
    return paired.withColumn("cpu_delta_percent", percent)


def running_count(
    rows: DataFrame, keys: list[str], order: str, flag: Column, name: str, bucket_seconds: int = 86_400
) -> DataFrame:
    """Adds ``name``, how often ``flag`` held up to and with a row in time order (``order`` unique per key).

    Flags are counted per time bucket first, so a key with very many rows is summed by many tasks.
    """
    width = F.lit(bucket_seconds * MICROS).cast("bigint")
    marked = rows.withColumns({"_flag": flag.cast("bigint"), "_bucket": F.call_function("div", micros(F.col(order)), width)})
    counts = marked.groupBy(*keys, "_bucket").agg(F.sum("_flag").alias("_some"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "_bucket", F.coalesce(F.sum("_some").over(earlier), F.lit(0)).alias("_before"))
    inside = F.sum("_flag").over(Window.partitionBy(*keys, "_bucket").orderBy(order))
    return marked.withColumn("_inside", inside).join(before, [*keys, "_bucket"]).select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))


def lifetimes(samples: DataFrame) -> DataFrame:
    """The lives of each process id, from its presence in a node's snapshots.

    ``samples`` has one row per node_name, snapshot_id and pid, with name, elapsed_sec and
    collected_at, which grows with the snapshot. A life ends where the id is absent from a snapshot of its
    node or its elapsed time fell: a restart under the same id. Gives node_name, pid, life (from 1), name (the last), first_seen,
    last_seen, snapshots, elapsed_sec (the last) and status: RUNNING if it is in the node's newest snapshot, else STOPPED.
    """
    node_order = Window.partitionBy("node_name").orderBy("snapshot_id")
    numbered = samples.select("node_name", "snapshot_id").distinct().withColumn("_nth", F.row_number().over(node_order))
    newest = numbered.groupBy("node_name").agg(F.max("_nth").alias("_newest"))
    placed = samples.join(numbered, ["node_name", "snapshot_id"])
    key = ["node_name", "pid"]
    paired = with_previous(placed, key, "collected_at", ["_nth", "elapsed_sec"], 86_400)
    begins = F.col("prev__nth").isNull() | (F.col("_nth") > F.col("prev__nth") + 1)
    begins = begins | F.coalesce(F.col("elapsed_sec") < F.col("prev_elapsed_sec"), F.lit(False))
    lives = running_count(paired, key, "collected_at", begins, "life")
    last = F.max_by(F.struct("name", "elapsed_sec"), "collected_at").alias("_last")
    found = lives.groupBy(*key, "life").agg(
        F.min("collected_at").alias("first_seen"), F.max("collected_at").alias("last_seen"), F.count(F.lit(1)).alias("snapshots"),
        F.max("_nth").alias("_nth"), last,
    )
    status = F.when(F.col("_nth") == F.col("_newest"), "RUNNING").otherwise("STOPPED")
    return found.join(newest, "node_name").select(
        *key, "life", "_last.name", "first_seen", "last_seen", "snapshots", "_last.elapsed_sec", status.alias("status")
    )
