"""Log lines from whole files or landed text."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: Text files below ``node_name=<n>/log_name=<l>``: names stay text even when they are numbers.
NAMED_TEXT = "value string, node_name string, log_name string"


def clean_line(line: Column) -> Column:
    """A line without its one trailing carriage return."""
    return F.regexp_replace(line, r"\r\z", "")


def drop_blank(df: DataFrame, line: str = "line") -> DataFrame:
    return df.filter(F.col(line) != "")


def split_log_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """Non-empty lines of each text with their 0-based position, other columns kept."""
    kept = [c for c in texts.columns if c != text]
    lines = texts.select(*kept, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return drop_blank(lines.withColumn("line", clean_line(F.col("line"))))


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of whole files, with the node and log that the path names.

    Only ``\\n`` ends a line: the reader's default also breaks at a lone ``\\r``.
    """
    raw = spark.read.schema(NAMED_TEXT).option("lineSep", "\n").text(path)
    named = raw.withColumn("log_path", F.col("_metadata.file_path"))
    lines = drop_blank(named.withColumn("line", clean_line(F.col("value"))).drop("value"))
    return lines.select("node_name", "log_name", "log_path", "line")


def log_file_info(specs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Size and time of every configured log; 0 and NULL where the file is missing.

    The inventory is first cut to the configured paths, so that the outer join, which
    cannot broadcast its left side, does not shuffle all of it.
    """
    files = inventory.filter(~F.col("is_dir")).select("node_name", "path", "size", "mtime")
    wanted = specs.select("node_name", "path").distinct()
    files = files.join(wanted, ["node_name", "path"], "left_semi")
    return specs.join(files, ["node_name", "path"], "left").select(
        "node_name", "name", "path", "max_lines",
        F.coalesce("size", F.lit(0)).alias("size"),
        F.col("mtime").alias("mod_time"),
    )
