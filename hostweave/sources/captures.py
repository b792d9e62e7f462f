"""Text captures landed one file per capture."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def number_lines(captures: DataFrame, text: str = "value") -> DataFrame:
    """One row per line of a whole capture text, with its 0-based position."""
    lines = captures.select(
        "node_name", "capture_id", F.posexplode(F.split(text, "\n")).alias("pos", "line")
    )
    return lines.select(
        "node_name", "capture_id", F.col("pos").cast("bigint").alias("pos"),
        F.regexp_replace("line", r"\r\z", "").alias("line"),
    )


def read_text_captures(spark: SparkSession, root: str) -> DataFrame:
    """Lines of captures at ``root/node_name=<node>/<capture>.txt``.

    A capture is one host's command output, so a file is read whole: positions on
    split files would not be line numbers.
    """
    files = spark.read.schema("value string, node_name string").text(root, wholetext=True)
    capture = F.regexp_extract(F.col("_metadata.file_name"), r"\A(.*?)(?:\.[^.]*)?\z", 1)
    return number_lines(files.withColumn("capture_id", capture))
