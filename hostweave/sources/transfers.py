"""FTP transfer logs in the xferlog format."""

from pyspark.sql import Column, DataFrame, functions as F

# xferlog(5) line layout and its codes.
LINE_SHAPE = (
    r"\A[A-Z][a-z]{2} +[A-Z][a-z]{2} +\d{1,2} +\d{2}:\d{2}:\d{2} +\d{4} +\d{1,18} +\S+ +\d{1,18} +\S+ +"
    r"[ab] +\S+ +[oid] +[agr] +\S+ +\S+ +[01] +\S+ +[ci] *\z"
)
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DIRECTIONS = {"i": "upload", "o": "download", "d": "delete"}
COMPLETION = {"c": "complete", "i": "incomplete"}


def _decode(code: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[code]


def parse_transfer_log(lines: DataFrame, parse_start: Column | None = None) -> DataFrame:
    """Transfers from log lines, other columns kept; lines of another shape are dropped.

    ``parse_start`` is the lower bound on the log time (exclusive of earlier entries).
    """
    kept = [c for c in lines.columns if c != "line"]

    def field(index: int) -> Column:
        return F.col("f")[index]

    # Built from its parts: the weekday is no part of it, and days may have one digit.
    month = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), field(1)).cast("string"), 2, "0")
    stamp = F.concat(
        field(4), F.lit("-"), month, F.lit("-"), F.lpad(field(2), 2, "0"), F.lit(" "), field(3)
    )
    row = F.struct(
        stamp.try_cast("timestamp_ntz").alias("log_time"),
        field(6).alias("remote_host"),
        field(13).alias("username"),
        field(8).alias("filename"),
        field(7).cast("bigint").alias("bytes"),
        field(5).cast("bigint").alias("transfer_time_sec"),
        _decode(field(11), DIRECTIONS).alias("direction"),
        _decode(field(17), COMPLETION).alias("status"),
    )
    # A generated row, unlike a projected one, is not parsed again by filters on it.
    fields = F.when(F.col("line").rlike(LINE_SHAPE), F.split("line", " +"))
    parsed = lines.select(*kept, fields.alias("f")).select(
        *kept, F.inline(F.when(F.col("f").isNotNull(), F.array(row)))
    )
    return parsed if parse_start is None else parsed.filter(F.col("log_time") >= parse_start)


def list_transfers(
    transfers: DataFrame,
    user: str | None = None,
    host: str | None = None,
    filename: str | None = None,
    direction: str | None = None,
) -> DataFrame:
    """Transfers that match every given field; pass the result to ``page``."""
    wanted = {"username": user, "remote_host": host, "filename": filename, "direction": direction}
    for column, value in wanted.items():
        if value is not None:
            transfers = transfers.filter(F.col(column) == value)
    return transfers
