"""Process listings with the columns pid, user, cpu, rss, state, elapsed, command."""

from pyspark.sql import Column, DataFrame, functions as F

from hostweave.functions.binding import let
from hostweave.functions.process import basename, process_state
from hostweave.functions.text import words

HEADER_POS = 0
KIB = 1024

_INTEGER = r"\A[+-]?\d+\z"
_DECIMAL = r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"


def parse_ps_captures(lines: DataFrame) -> DataFrame:
    """Process rows from capture lines; narrow, no shuffle.

    ``lines`` has ``node_name, snapshot_id, pos, line, collected_at``; the line at
    position 0 of every capture is its header. Lines with fewer than seven fields or
    a bad process id are dropped, a bad CPU or memory figure counts as zero.
    """
    fields = lines.filter(F.col("pos") > HEADER_POS).select(
        "node_name", "snapshot_id", "pos", "collected_at", words(F.col("line")).alias("f")
    )

    def text(index: int) -> Column:
        return F.get("f", F.lit(index))

    def number(index: int, shape: str, sql_type: str) -> Column:
        return F.when(text(index).rlike(shape), text(index).try_cast(sql_type))

    def finite(value: Column) -> Column:
        return F.when(F.abs(value) < float("inf"), value)

    cpu = number(2, _DECIMAL, "double")
    rss = F.try_multiply(number(3, _INTEGER, "bigint"), F.lit(KIB))
    row = F.struct(
        number(0, _INTEGER, "bigint").alias("pid"),
        basename(text(6)).alias("name"),
        text(1).alias("user"),
        F.coalesce(let(cpu, finite), F.lit(0.0)).alias("cpu_percent"),
        F.coalesce(rss, F.lit(0)).alias("mem_rss"),
        process_state(text(4)).alias("status"),
        text(5).alias("elapsed"),
    )
    # Generating the row, and not filtering the split line, keeps the optimizer from
    # pushing copies of the split into the filter.
    whole = F.when(F.size("f") >= 7, F.array(row))
    parsed = fields.select("node_name", "snapshot_id", "pos", F.inline(whole), "collected_at")
    return parsed.filter(F.col("pid").isNotNull())
