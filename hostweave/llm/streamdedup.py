"""Exact duplicates of a growing table, by a stream whose keyed state lies on disk and never expires.

The stream reads the table's files as they come. Its state (RocksDB, checkpointed to the shared
folder) holds for each digest of a normalised text the row that stays, as doc_id and locator (file
and row number in it), and how many rows had it. Rows are combined in each task before they reach
the state, so a text with very many copies is a row per task there. A digest held more than once is
a hit: the text at the locator is then compared with each copy, byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.llm.tables import only, written
from hostweave.workspace import fresh_dir

WHITE = r"[\x20\x09-\x0D]+"
#: Input of a micro-batch, about: files are taken whole.
BATCH_BYTES = 4 << 30
#: Bytes of SHA-256 that key the state. Fewer make more hits that the comparison tells apart.
KEY_BYTES = 32
#: Copies that one copy of the staying text is compared with.
COPIES = 1024
#: Bounded native memory for all partitions of the state in an executor, and no disk held in advance for each.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS normal FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY normal ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(normal) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY normal)
"""


def normalised(text: Column) -> Column:
    """The text, null as empty, with each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _located(table: DataFrame, key_bytes: int) -> DataFrame:
    """doc_id, _normal, _sha, _key, _file and _row of a table of Parquet files, streamed or not."""
    at = table.metadataColumn("_metadata")
    rows = table.select(
        table["doc_id"].cast("long").alias("doc_id"), normalised(table["text"]).alias("_normal"),
        at["file_path"].alias("_file"), at["row_index"].alias("_row"),
    )
    sha = rows.withColumn("_sha", F.unhex(F.sha2(F.col("_normal").cast("binary"), 256)))
    return sha.withColumn("_key", F.substring("_sha", 1, key_bytes))


def ingest(spark: SparkSession, path: str, checkpoint: str, batch_bytes: int = BATCH_BYTES, key_bytes: int = KEY_BYTES) -> None:
    """Takes all files of ``path`` that the state at ``checkpoint`` has not seen into it, and returns.

    Called again with the same checkpoint it goes on where it ended or broke off; a micro-batch
    that is repeated replaces its first attempt's state. Key bytes are those of the first call.
    """
    path = path.rstrip("/")
    here = f"{path[:-1]}[{path[-1]}]"  # a pattern of one name: a stream takes a single file only so
    table = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", batch_bytes).parquet(here)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_file").alias("file"), F.col("_row").alias("row")))
    state = _located(table, key_bytes).groupBy("_key").agg(first.alias("keeper"), F.count(F.lit(1)).alias("n"))
    before = {name: spark.conf.get(name, None) for name in STATE}
    try:
        for name, value in STATE.items():
            spark.conf.set(name, value)
        run = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    run.awaitTermination()


def ledger(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state: _key, keeper (doc_id, file and row of the row that stays) and n, rows so far."""
    state = spark.read.format("statestore").load(checkpoint)
    keeper, n = state.schema["value"].dataType.names
    return state.select(F.col("key._key").alias("_key"), F.col(f"value.{keeper}").alias("keeper"), F.col(f"value.{n}").alias("n"))


def _checked(rows: DataFrame) -> DataFrame:
    """Rows of digests held more than once, with _other: null, or the text where it is not the keeper's."""
    here = (F.col("_file") == F.col("keeper.file")) & (F.col("_row") == F.col("keeper.row"))
    salts = F.ceil(F.col("n") / COPIES).cast("int")
    kept = rows.where(here).select("_key", F.col("_normal").alias("_kept"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("_file", "_row"), salts).cast("int"))
    other = F.when(F.col("_normal") != F.col("_kept"), F.col("_normal")).alias("_other")
    return dealt.join(kept, ["_key", "_salt"]).select("doc_id", "_sha", "_key", "_file", "_row", "keeper", "n", other)


def verdicts(table: DataFrame, held: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """A row per row of ``table`` (Parquet files that the state has seen): doc_id, keep_id, group_size, kept, text_sha256."""
    repeated = written(held.where("n > 1"), "repeated-digests")
    # Merged at every size, so that texts of a hot digest stay split by Spark's skew handling.
    found = _located(table, key_bytes).join(repeated.hint("merge"), "_key", "left")
    rows = written(found.withColumn("_normal", F.when(F.col("n") > 1, F.col("_normal"))), "digests")
    single = rows.where("n IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha")
    hits = written(_checked(rows.where("n > 1")), "hits")
    wrong = hits.where("_other IS NOT NULL")
    if not wrong.isEmpty():
        # Texts that share a digest: the others are groups of their own, told apart by the whole text.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_file").alias("file"), F.col("_row").alias("row")))
        groups = written(wrong.groupBy("_key", "_other").agg(first.alias("_own"), F.count(F.lit(1)).alias("_m")), "collisions")
        fewer = groups.groupBy("_key").agg(F.sum("_m").alias("_less"))
        right = hits.where("_other IS NULL").join(fewer, "_key", "left").withColumn("n", F.col("n") - F.coalesce("_less", F.lit(0))).drop("_less")
        moved = wrong.join(groups, ["_key", "_other"]).withColumn("keeper", F.col("_own")).withColumn("n", F.col("_m")).select(*right.columns)
        hits = right.unionByName(moved)
    stays = (F.col("_file") == F.col("keeper.file")) & (F.col("_row") == F.col("keeper.row"))
    double = hits.select("doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), "_sha")
    return single.unionByName(double).withColumn("text_sha256", F.lower(F.hex("_sha"))).drop("_sha")


def deduplicate(
    spark: SparkSession, path: str, checkpoint: str | None = None, batch_bytes: int = BATCH_BYTES, key_bytes: int = KEY_BYTES
) -> DataFrame:
    """Streams the Parquet files at ``path`` (doc_id, text) through the state and judges every row.

    Texts are equal when they are after each run of ASCII white space became one space; null counts
    as empty, and empty texts are equal to one another. Of equal texts the row with the smallest
    doc_id stays (null ids last; of repeated rows the first by file and row), the others name it in
    keep_id, which is null where all ids are. Texts of any length are digested and compared whole.
    Other columns are not read, whatever their names. An empty table gives no row. With the
    checkpoint of an earlier call only new files pass the stream; verdicts are on all of them.
    """
    table = spark.read.parquet(path)
    checkpoint = checkpoint or fresh_dir(spark, "dedup-state")
    if table.isEmpty():
        return table.select(
            F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
            F.lit(False).alias("kept"), F.lit("").alias("text_sha256"),
        ).limit(0)
    ingest(spark, path, checkpoint, batch_bytes, key_bytes)
    return verdicts(table, ledger(spark, checkpoint), key_bytes)


def deduplicate_rows(documents: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """The same for rows that are not files yet: doc_id and text are stored first."""
    spark, path = documents.sparkSession, fresh_dir(documents.sparkSession, "dedup-rows")
    only(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").write.option("compression", "zstd").parquet(path)
    return deduplicate(spark, path, key_bytes=key_bytes)
