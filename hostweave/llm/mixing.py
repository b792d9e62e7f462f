"""Mixing sources to target weights with a low-discrepancy schedule, by DataFrame functions only.

Documents of a source are shuffled by a hash and laid end to end; the line is cut into blocks
of equally many words. Slots are the van der Corput points of base two: all j / 2**m, visited
in the order of j's reversed bits. A source owns the points in its stretch of the cumulative
targets. The r-th slot of a source takes its r-th block, and from the first again after the
last, until the target is reached; the slot that reaches it takes only the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.llm.tables import only, set_aside, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Words the mix takes, as a share of all words; most times that a source is taken.
SHARE, REPEATS = 1.5, 2
#: Words of a block: a 65,536th of all words, 1024 at most, more only beyond 2**30 blocks.
BLOCKS, BLOCK_WORDS, MOST_BLOCKS = 65_536, 1024, 1 << 30
#: Cells of one row that are exploded together.
RUN = 65_536
ALL_BEFORE = (Window.unboundedPreceding, -1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sum_before(value: Column, window: Window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(*ALL_BEFORE)), F.lit(0))


def source_targets(sized: DataFrame) -> DataFrame:
    """A row per source with its words, target, quota and blocks; sized: source, _source, size.

    Sources in code point order, null last, weigh ``WEIGHTS`` in turn. ``SHARE`` of all words is
    dealt by weight, but none gets more than ``REPEATS`` times its words; what that leaves over
    is dealt again by weight. So all but the full sources get weight times one common level,
    found by going through the sources in the order in which they fill up.
    """
    sources = sized.groupBy("_source").agg(F.first("source").alias("_name"), F.sum("size").alias("source_size"))
    by_name, by_level = Window.orderBy(F.col("_name").asc_nulls_last()), Window.orderBy("_fills", "_name")
    everything = Window.partitionBy()
    turn = F.row_number().over(by_name) - 1
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    level = (F.col("_all") * SHARE - F.col("_full")) / (F.col("_weights") - F.col("_lighter"))
    leveled = (
        sources.withColumn("_weight", F.get(weights, (turn % len(WEIGHTS)).cast("int")))
        .withColumn("_most", (F.col("source_size") * REPEATS).cast("double"))
        .withColumn("_fills", F.col("_most") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("_weight").over(everything))
        .withColumn("_full", _sum_before(F.col("_most"), by_level))
        .withColumn("_lighter", _sum_before(F.col("_weight"), by_level))
        .withColumn("_level", level)
        .withColumn("_is_full", F.col("_fills") <= F.col("_level"))
        .withColumn("_common", F.min_by(F.when(~F.col("_is_full"), F.col("_level")), F.when(~F.col("_is_full"), F.col("_fills"))).over(everything))
    )
    target = F.when(F.col("_is_full"), F.col("_most")).otherwise(F.least(F.col("_most"), F.col("_weight") * F.col("_common")))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.expr(f"_all div {BLOCKS}")), F.expr(f"_all div {MOST_BLOCKS}"))
    return (
        leveled.withColumn("target", F.coalesce(target, F.lit(0.0)))
        .withColumn("_block", block.cast("long"))
        .withColumn("_quota", F.floor("target"))
        .withColumn("_blocks", F.ceil(F.col("source_size") / F.col("_block")))
        .withColumn("_rounds", F.coalesce(F.expr("_quota div nullif(source_size, 0)"), F.lit(0)))
        .withColumn("_slots", F.col("_rounds") * F.col("_blocks") + F.ceil((F.col("_quota") - F.col("_rounds") * F.col("source_size")) / F.col("_block")))
        .select("_source", "source_size", "target", "_block", "_quota", "_blocks", "_slots")
    )


def _reversed_bits(value: Column, bits: Column) -> Column:
    """The lowest ``bits`` bits of a number below 2**32 in reverse."""
    for step in (1, 2, 4, 8, 16):
        low = sum(((1 << step) - 1) << at for at in range(0, 32, 2 * step))
        value = F.shiftright(value, step).bitwiseAND(F.lit(low)).bitwiseOR(F.shiftleft(value.bitwiseAND(F.lit(low)), step))
    return F.call_function("shiftright", value, (F.lit(32) - bits).cast("int"))


def mix_schedule(targets: DataFrame) -> DataFrame:
    """The schedule: position, _source, rank (of the slot in its source), block, words to take.

    Every source owns at least as many points as it needs slots; points beyond are left out.
    Ranks are counted in stretches of positions first, so that no source is ranked in one task.
    """
    total = Window.partitionBy()
    points = (
        targets.withColumn("_needed", F.sum("_slots").over(total))
        .withColumn("_bits", F.ceil(F.log2(F.greatest(F.col("_needed"), F.lit(1)).cast("double"))).cast("int"))
        .withColumn("_points", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")))
        .withColumn("_before", _sum_before(F.col("_slots"), Window.orderBy("_source")).cast("decimal(20,0)"))
        .where("_slots > 0")
        .withColumn("_from", F.floor(F.col("_before") * F.col("_points") / F.col("_needed")).cast("long"))
        .withColumn("_to", F.floor((F.col("_before") + F.col("_slots")) * F.col("_points") / F.col("_needed")).cast("long"))
        .withColumn("_run", F.explode(F.expr(f"sequence(_from, _to - 1, {RUN})")))
        .repartition("_source", "_run")
        .withColumn("_cell", F.explode(F.expr(f"sequence(_run, least(_run + {RUN}, _to) - 1)")))
        .withColumn("position", _reversed_bits(F.col("_cell"), F.col("_bits")))
        .withColumn("_stretch", F.expr(f"position div {RUN}"))
    )
    counts = points.groupBy("_source", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.withColumn("_base", _sum_before(F.col("_n"), Window.partitionBy("_source").orderBy("_stretch"))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_source", "_stretch").orderBy("position"))
    start = F.expr("rank div _blocks") * F.col("source_size") + F.col("block") * F.col("_block")
    return (
        points.join(base, ["_source", "_stretch"])
        .withColumn("rank", F.col("_base") + inside - 1)
        .where("rank < _slots")
        .withColumn("block", F.expr("rank % _blocks"))
        .withColumn("words", F.least(F.col("_block"), F.col("source_size") - F.col("block") * F.col("_block"), F.col("_quota") - start))
        .select("position", "_source", "rank", "block", "words")
    )


def mix_documents(documents: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes, with repeats) of all documents.

    Null text has size 0; null sources are one source; a document without words is never taken.
    Documents are shuffled by md5 of the seed and doc_id, then by doc_id and size, so reruns agree;
    rows equal in all of these may swap what is taken of them. Texts of any length are counted whole. Other columns are not
    read. An empty table gives no row.
    """
    return _mixed(only(documents, "doc_id", "source", "text").withColumn("size", word_count(F.col("text"))).drop("text"), seed)


def _mixed(sized: DataFrame, seed: str) -> DataFrame:
    stored = written(sized.withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    return stored.join(taken_words(stored, seed), "_row").drop("_row")


def mixed_copies(documents: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix as whole documents: each as often as the mix takes its words, rounded (only the
    document where a source's target is reached is taken in part). Their own columns only.

    Documents without words (null and empty texts) are in no mix, rows that repeat stand in each
    other's copies, and an empty table gives no row. Rows are in no order: ``mixed_stream`` has the mix's."""
    documents, names = set_aside(documents, "doc_id", "source", "text")
    key = F.xxhash64("source", "text").alias("_key")
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), key)
    copies = F.floor(F.sum("taken") / F.first("size") + 0.5).cast("long")
    taken = _mixed(sized, seed).where("size > 0").groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_taken"))
    taken = taken.agg(copies.alias("_copies"), F.count(F.lit(1)).alias("_n")).where("_copies > 0")
    rows = documents.withColumn("_key", key).join(taken, (F.col("_key") == F.col("_taken")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    # Rows that are repeated stand in the copies of all of them.
    rows = rows.where("_n = 1").unionByName(rows.where("_n > 1").dropDuplicates(["_id", "_taken"]))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*documents.columns).toDF(*names)


def _stretches(stored: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """Stored documents (_row, doc_id, source, size) with _begin, their place on their source's line of
    words; and what the schedule takes of them: position, _row, _source, block, first_word, words."""
    laid = (
        stored.select("_row", "doc_id", "source", "size")
        .withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
        .withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        .withColumn("_bucket", F.substring("_key", 1, 3))
    )
    targets = written(source_targets(laid), "mix-targets")
    buckets = (
        laid.groupBy("_source", "_bucket").agg(F.sum("size").alias("_n"))
        .withColumn("_base", _sum_before(F.col("_n"), Window.partitionBy("_source").orderBy("_bucket"))).drop("_n")
        .join(targets, "_source")
    )
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", F.col("doc_id"), "size")
    placed = laid.join(buckets, ["_source", "_bucket"]).withColumn("_begin", F.col("_base") + _sum_before(F.col("size"), inside))
    pieces = (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.expr("sequence(_begin div _block, (_begin + size - 1) div _block)")))
        .withColumn("_low", F.greatest(F.col("_begin") - F.col("block") * F.col("_block"), F.lit(0)))
        .withColumn("_high", F.least(F.col("_begin") + F.col("size") - F.col("block") * F.col("_block"), F.col("_block")))
        .withColumn("first_word", F.greatest(F.col("block") * F.col("_block") - F.col("_begin"), F.lit(0)))
        .select("_row", "_source", "block", "_low", "_high", "first_word")
    )
    slots = mix_schedule(targets).withColumnRenamed("words", "_words")
    taken = F.least(F.col("_high"), F.col("_words")) - F.col("_low")
    stream = pieces.join(slots, ["_source", "block"]).withColumn("words", taken).where("words > 0")
    return placed, stream.select("position", "_low", "_row", "_source", "block", "first_word", "words")


def taken_words(stored: DataFrame, seed: str = "mix") -> DataFrame:
    """_row, source_size, target and taken for stored documents with _row, doc_id, source and size: sums over the mixed stream."""
    placed, stream = _stretches(stored, seed)
    taken = stream.groupBy("_row").agg(F.sum("words").alias("_taken"))
    return placed.select("_row", "source_size", "target").join(taken, "_row", "left").select(
        "_row", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken")
    )


def mixed_stream(documents: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself, in the schedule's order: position (of the slot), place (in the slot), source,
    block, doc_id, first_word and words, the stretch of the document that is read there.

    Sorted by position and place; positions of slots that take nothing are left out, and a document that is
    taken twice comes in two slots of its block. Cases as in ``mix_documents``.
    """
    sized = only(documents, "doc_id", "source", "text").withColumn("size", word_count(F.col("text"))).drop("text")
    stored = written(sized.withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    stream = _stretches(stored, seed)[1].join(stored.select("_row", "doc_id", "source"), "_row")
    return stream.select("position", F.col("_low").alias("place"), "source", "block", "doc_id", "first_word", "words").orderBy("position", "place")


#: The documents' taken words from the quotas alone: the schedule takes a source's blocks in turn.
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
      FROM s),
f AS (SELECT *, CAST(source_size * 2 AS DOUBLE) AS most, CAST(source_size * 2 AS DOUBLE) / weight AS fills,
             CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total, sum(weight) OVER () AS weights FROM w),
l AS (SELECT *, (total - coalesce(sum(most) OVER o, 0)) / (weights - coalesce(sum(weight) OVER o, 0)) AS lev FROM f
      WINDOW o AS (ORDER BY fills, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(lev, fills) AS common FROM l WHERE fills > lev),
t AS (SELECT source, source_size, CASE WHEN fills <= lev THEN most ELSE least(most, weight * common) END AS target FROM l, c),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS quota,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       greatest(least(b + size, quota) - b, 0) + greatest(least(source_size + b + size, quota) - source_size - b, 0) AS taken
FROM p
"""
