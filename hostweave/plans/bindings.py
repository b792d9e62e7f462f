"""Telemetry tables derived from the benchmark tables.

Every binding is a narrow projection or one aggregation over a whole table, so a query's
work grows with the tables. Defects the parsers must handle (short lines, bad numbers,
carriage returns, failed stats) are worked into the derived rows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostweave.operators.paths import ancestors
from hostweave.sources.logs import split_log_lines


def _div(column, by: int) -> Column:
    return F.call_function("div", column, F.lit(by).cast("bigint"))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _pick(options: list[str], number: Column) -> Column:
    return F.array(*[F.lit(o) for o in options])[(number % len(options)).cast("int")]


@dataclass(frozen=True)
class Bindings:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The same table as a file stream; the one-letter glob lets it be a single file."""
        schema = self.table(name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}.parque[t]")

    # -- filesystems ---------------------------------------------------------------

    def fs_counters(self, events: DataFrame | None = None) -> DataFrame:
        events = self.table("events") if events is None else events
        event, user = F.col("event_id"), F.col("user_id")
        blocks = event % 50 * 262144
        bfree = _div(blocks * (event % 11), 10)
        return events.select(
            _text("node-", user % 4).alias("node_name"),
            _text("/mnt/", _div(user, 4)).alias("mount_point"),
            F.when(event % 97 != 0, blocks).alias("blocks"),
            bfree.alias("bfree"),
            _div(bfree * 95, 100).alias("bavail"),
            F.lit(4096).cast("bigint").alias("bsize"),
            F.col("ts").alias("collected_at"),
            event.alias("seq"),
        )

    def mount_lines(self, dialect: str) -> DataFrame:
        key, brand = F.col("p_partkey"), F.col("p_brand")
        device = F.when((brand == "Brand#3") | (key % 7 == 0), F.lit("tmpfs")).otherwise(
            _text("/dev/sd", F.col("p_size"))
        )
        fstype = (
            F.when(F.col("p_type") == "PROMO", F.lit("tmpfs"))
            .when(F.col("p_type") == "SMALL", F.lit("overlay"))
            .otherwise(F.lit("ext4"))
        )
        if dialect == "linux":
            whole, broken = _text(device, "  /mnt/", key, "\t", fstype, " rw 0 0"), "short line"
        else:
            whole = _text(device, " on /mnt/", key, " on (x) (", fstype, ", local)")
            broken = "/dev/sd1 on /nothing"
        return self.table("part").select(
            _text("node-", key % 3).alias("node_name"),
            brand.alias("capture_id"),
            key.alias("pos"),
            F.when(key % 11 == 0, F.lit(broken)).otherwise(whole).alias("line"),
        )

    # -- processes -----------------------------------------------------------------

    def ps_lines(self, events: DataFrame | None = None) -> DataFrame:
        """Listing lines with one header per capture (a node's day)."""
        events = self.table("events") if events is None else events
        event, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")

        def two(number: Column) -> Column:
            return F.lpad(number.cast("string"), 2, "0")

        elapsed = _text(
            F.when(event % 3 == 2, _text(event % 9, "-")).otherwise(F.lit("")),
            F.when(event % 3 >= 1, _text(two(event % 24), ":")).otherwise(F.lit("")),
            two(event % 60), ":", two(event % 59),
        )
        command = (
            F.when(event % 4 == 0, _text("/usr/bin/", kind))
            .when(event % 4 == 1, _text(kind, event % 5))
            .when(event % 4 == 2, _text("[kworker/", event % 8, ":1]"))
            .otherwise(_text("/opt/", kind, "/ --flag"))
        )
        head = _text(
            "  ", F.when(event % 19 == 0, F.lit("abc")).otherwise(user.cast("string")),
            "  u", user % 7, " ",
            F.when(event % 13 == 0, F.lit("x")).otherwise(_text(event % 100, ".", event % 10)),
            " ", F.when(event % 23 == 0, F.lit("y")).otherwise((event * 4).cast("string")),
        )
        states = ["R", "S", "D", "Z", "T", "I", "t", "Ss", "X+"]
        line = F.when(event % 17 == 0, head).otherwise(
            _text(head, " ", _pick(states, event), " ", elapsed, " ", command)
        )
        keys = [
            _text("node-", user % 4).alias("node_name"),
            F.unix_date(F.to_date("ts")).cast("bigint").alias("snapshot_id"),
        ]
        rows = events.select(
            *keys, (event + 1).alias("pos"), line.alias("line"), F.col("ts").alias("collected_at")
        )
        if events.isStreaming:
            return rows
        headers = events.select(*keys).distinct().select(
            "node_name", "snapshot_id", F.lit(0).cast("bigint").alias("pos"),
            F.lit("PID USER %CPU RSS S ELAPSED COMMAND").alias("line"),
            F.lit(None).cast("timestamp_ntz").alias("collected_at"),
        )
        return rows.unionByName(headers)

    def process_specs(self) -> DataFrame:
        """Patterns and row limits of each node, one of them without patterns."""
        nodes = self.table("events").select(
            (F.col("user_id") % 4).alias("n"), _text("node-", F.col("user_id") % 4).alias("node_name")
        ).distinct()
        patterns = (
            F.when(F.col("n") == 0, F.array(F.lit("CLICK"), F.lit("view?")))
            .when(F.col("n") == 1, F.array(F.lit("*:1]"), F.lit("sign*")))
            .when(F.col("n") == 2, F.array().cast("array<string>"))
            .otherwise(F.array(F.lit("err")))
        )
        return nodes.select(
            "node_name", patterns.alias("patterns"), (F.col("n") * 3).cast("int").alias("top_n")
        )

    def watch_patterns(self) -> DataFrame:
        """A pattern per customer, of six shapes."""
        key = F.col("c_custkey")
        pattern = (
            F.when(key % 6 == 0, _text("cLick", key % 5))
            .when(key % 6 == 1, _text("*", key % 8, ":1]"))
            .when(key % 6 == 2, F.lit("vi?w"))
            .when(key % 6 == 3, F.lit("IGN"))
            .when(key % 6 == 4, F.lit("?rr*"))
            .otherwise(F.lit("*"))
        )
        return self.table("customer").select(key.alias("pattern_id"), pattern.alias("pattern"))

    def cpu_times(self) -> DataFrame:
        event, user = F.col("event_id"), F.col("user_id")
        return self.table("events").select(
            _text("node-", user % 4).alias("node_name"),
            user.alias("pid"),
            F.col("ts").alias("collected_at"),
            (event * 50 + event % 5 * 1000).alias("cpu_time_ms"),
        )

    # -- logs ----------------------------------------------------------------------

    def log_texts(self, documents: DataFrame | None = None) -> DataFrame:
        documents = self.table("documents") if documents is None else documents
        doc = F.col("doc_id")
        return documents.select(
            _text("node-", doc % 4).alias("node_name"),
            F.col("source").alias("log_name"),
            _text("/var/log/", F.col("source"), ".log").alias("log_path"),
            doc,
            F.when(doc % 5 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n")))
            .otherwise(F.col("text")).alias("text"),
        )

    def log_lines(self, documents: DataFrame | None = None) -> DataFrame:
        doc = F.col("doc_id")
        created = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(
            hours=(doc % 1000).cast("int")
        )
        return split_log_lines(self.log_texts(documents)).select(
            "node_name",
            (doc * 100_000 + F.col("pos")).alias("id"),
            "log_name", "log_path", "line",
            created.alias("created_at"),
        )

    def log_specs(self) -> DataFrame:
        """Limits of logs; numbers that are not positive stand for the default. Some logs are named
        twice, of which the first counts, and one is not named at all."""
        logs = self.table("documents").select(
            _text("node-", F.col("doc_id") % 4).alias("node_name"), F.col("source").alias("name")
        ).distinct()
        number = F.regexp_extract("name", r"(\d+)", 1).cast("int")
        first = logs.filter("name <> 'src7'").select(
            "node_name", "name", _text("/var/log/", F.col("name"), ".log").alias("path"),
            (number % 5 * 3 - 3).alias("max_lines"), F.lit(0).alias("idx"),
        )
        again = first.filter(number % 4 == 0).withColumns({"max_lines": F.lit(1), "idx": F.lit(1)})
        return first.unionByName(again)

    # -- file trees ----------------------------------------------------------------

    def page_files(self) -> DataFrame:
        """One file per page address, query and fragment cut off."""
        path = F.regexp_replace("url", r"\A[a-z]+:/|[?#].*\z", "")
        return self.table("pages").select(
            "page_id",
            _text("node-", F.col("page_id") % 2).alias("node_name"),
            F.regexp_replace(path, r"/+\z", "").alias("path"),
            F.length("html").cast("bigint").alias("size"),
            (F.lit("2024-01-01").cast("timestamp_ntz")
             + F.make_dt_interval(secs=F.col("page_id") % 1_000_000)).alias("mtime"),
        )

    def path_inventory(self) -> DataFrame:
        """Files and all directories above them."""
        entries = self.page_files().withColumn(
            "entry", F.explode(ancestors(F.col("path"), include_self=True))
        )
        above = F.col("entry") != F.col("path")
        return (
            entries.filter(F.col("entry") != "")
            .groupBy("node_name", F.col("entry").alias("path"))
            .agg(
                F.bool_or(above).alias("is_dir"),
                F.max(F.when(above, 0).otherwise(F.col("size"))).alias("file_size"),
                F.max("mtime").alias("mtime"),
            )
            .select(
                "node_name", "path", "is_dir",
                F.when(F.col("is_dir"), 0).otherwise(F.col("file_size")).alias("size"),
                "mtime", F.lit(1).cast("bigint").alias("snapshot_id"),
            )
        )

    def path_specs(self, depth: bool = False, exclude: bool = False) -> DataFrame:
        """The file system root, every host and language, and a missing root per node."""
        parts = F.split("path", "/")
        roots = F.array(
            F.lit("/"), F.array_join(F.slice(parts, 1, 2), "/"),
            _text(F.array_join(F.slice(parts, 1, 3), "/"), "/"),
            F.lit("/missing"),
        )
        unique = self.page_files().select("node_name", F.explode(roots).alias("path")).distinct()
        size = F.length("path")
        patterns = (
            F.when(size % 3 == 0, F.array(F.lit("*.html"), F.lit("en")))
            .when(size % 3 == 1, F.array(F.lit("[0-4]*"), F.lit("x["), F.lit("d?")))
            .otherwise(F.array(F.lit("[^0-6]??")))
        )
        none = F.array().cast("array<string>")
        return unique.select(
            "node_name", "path",
            (size % 3 if depth else F.lit(0)).cast("int").alias("max_depth"),
            (patterns if exclude else none).alias("exclude"),
        )

    def path_stats(self) -> DataFrame:
        order, customer, state = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
        status = (
            F.when(state == "F", "OK").when(state == "O", "SCANNING").otherwise("ERROR")
        )
        return self.table("orders").select(
            _text("node-", customer % 4).alias("node_name"),
            _text("/data/", F.lpad(order.cast("string"), 12, "0")).alias("path"),
            (customer * 10).alias("file_count"),
            customer.alias("dir_count"),
            (customer * 37 % 60_000).alias("scan_duration_ms"),
            status.alias("status"),
            F.when(state == "P", "permission denied").otherwise("").alias("error_message"),
            F.col("o_orderdate").alias("collected_at"),
            order.alias("seq"),
        )

    def path_history(self) -> DataFrame:
        """Line items as repeated scans of the path of their part."""
        return self.table("lineitem").groupBy("l_partkey", "l_orderkey").agg(
            F.count(F.lit(1)).alias("items"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity")
        ).select(
            _text("node-", F.col("l_partkey") % 4).alias("node_name"),
            _text("/parts/", F.col("l_partkey")).alias("path"),
            F.col("quantity").alias("file_count"),
            F.col("items").alias("dir_count"),
            _pick(["OK", "SCANNING", "ERROR"], F.col("l_orderkey")).alias("status"),
            F.col("l_orderkey").alias("seq"),
        )

    # -- specifications ------------------------------------------------------------

    def node_specs(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("config_id"),
            F.when(key % 10 == 0, "").otherwise(_text("node-", key)).alias("node_name"),
            F.when(key % 2 == 0, "").otherwise(_text("10.0.0.1:", key % 1000)).alias("listen"),
            (key % 3 * 5000).alias("disk_interval_ms"),
            (key % 4 * 30_000).alias("path_interval_ms"),
            (key % 5 * 1000).alias("process_interval_ms"),
            F.when(key % 6 != 0, key % 6 * 500).alias("log_interval_ms"),
        )

    def configured_paths(self) -> DataFrame:
        """Paths of the configurations: the orders of a customer."""
        order = F.col("o_orderkey")
        return self.table("orders").select(
            F.col("o_custkey").alias("config_id"),
            _text("node-", F.col("o_custkey")).alias("node_name"),
            order.alias("idx"),
            F.when(order % 7 == 0, "").otherwise(_text("/data/", order)).alias("path"),
            (order % 3 * 10_000).alias("scan_interval_ms"),
            (order % 4).cast("int").alias("max_depth"),
            (order % 2 * 5000).alias("timeout_ms"),
        )

    def client_nodes(self) -> DataFrame:
        order = F.col("o_orderkey")
        return self.table("orders").select(
            F.col("o_custkey").alias("config_id"),
            order.alias("idx"),
            F.when(order % 9 != 0, _text("n", order)).alias("name"),
            F.when(order % 5 == 0, "").otherwise("10.0.0.1:8080").alias("address"),
        )

    # -- transfers and schedules ---------------------------------------------------

    def transfer_lines(self) -> DataFrame:
        order, customer = F.col("o_orderkey"), F.col("o_custkey")
        at = F.col("o_orderdate") + F.make_dt_interval(secs=order % 86_400)
        line = _text(
            F.date_format(at, "EEE MMM "), F.lpad(F.dayofmonth(at).cast("string"), 2, " "),
            F.date_format(at, " HH:mm:ss yyyy "), order % 100, " 10.0.", customer % 256, ".7 ",
            order * 1000, " /srv/", F.substring("o_orderpriority", 1, 1), "_", order, ".csv b _ ",
            _pick(["o", "i", "d"], order), " r user", customer % 50, " ftp 0 * ",
            _pick(["c", "i"], order),
        )
        cut = F.when(order % 29 == 0, F.substring(line, 1, 40)).otherwise(line)
        return self.table("orders").select(
            _text("node-", customer % 4).alias("node_name"), order.alias("id"), cut.alias("line")
        )

    def cron_jobs(self) -> DataFrame:
        key = F.col("c_custkey")
        kind = key % 8
        schedule = (
            F.when(kind == 0, "*/15 * * * *")
            .when(kind == 1, _text(key % 60, " ", key % 24, " * * *"))
            .when(kind == 2, _text("0 0 ", key % 28 + 1, " * *"))
            .when(kind == 3, _text(key % 60, " 6 * * ", key % 7))
            .when(kind == 4, _text("5,35 8-18/2 * ", key % 12 + 1, " *"))
            .when(kind == 5, "0 12 13 * FRI")
            .when(kind == 6, "0 0 29 2 *")
            .otherwise(F.when(key % 16 == 7, "@daily").otherwise("61 x * * *"))
        )
        return self.table("customer").select(key.alias("job_id"), schedule.alias("schedule"))

    def crontab_lines(self) -> DataFrame:
        """Three lines of a file per customer: a variable, a job (now and then a broken or @ one), a comment or blank."""
        key = F.col("c_custkey")
        system = key % 2 == 0
        line = (
            F.when(F.col("i") == 0, F.when(key % 3 == 0, _text("MAILTO = \"ops", key % 5, "\"")).otherwise(_text("LEVEL=", key % 7)))
            .when(F.col("i") == 2, F.when(key % 5 == 0, F.lit("  # nightly")).otherwise(F.lit("")))
            .when(key % 11 == 0, F.lit("0 0 * *"))
            .otherwise(
                _text(
                    F.when(key % 4 == 0, F.lit("@daily")).otherwise(_text(key % 60, "  ", key % 24, " *\t* *")),
                    F.when(system, _text("  u", key % 9)).otherwise(F.lit("")),
                    "  /opt/job", key % 13, " --at \\%H", F.when(key % 6 == 0, F.lit(" %first%second")).otherwise(F.lit("")),
                )
            )
        )
        rows = self.table("customer").select("c_custkey", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"))
        return rows.select(
            _text("node-", key % 4).alias("node_name"), _text("/cron/", _div(key, 40)).alias("path"),
            F.when(system, F.lit("system")).otherwise(F.lit("user")).alias("source"), _text("owner", key % 3).alias("owner"),
            (key * 3 + F.col("i")).alias("pos"), line.alias("line"),
        )

    def job_starts(self) -> DataFrame:
        """Starts of the jobs of :meth:`cron_jobs`, taken from orders: some early, some late, most jobs not every time."""
        order, customer = F.col("o_orderkey"), F.col("o_custkey")
        started = F.lit("2024-01-29").cast("timestamp_ntz") + F.make_dt_interval(
            hours=(order % 48).cast("int"), mins=(order % 4 * 15).cast("int"), secs=(order % 200).cast("double")
        )
        return self.table("orders").select(customer.alias("job_id"), started.alias("started_at"))

    def feed_samples(self) -> DataFrame:
        return self.table("events").select(
            _text("node-", F.col("user_id") % 4).alias("node_name"), F.col("event_type").alias("feed"), F.col("ts").alias("collected_at")
        )

    def feed_specs(self) -> DataFrame:
        """An interval per node and feed, one feed that never reports, and one without an interval."""
        feeds = self.feed_samples().select("node_name", "feed").distinct()
        number = F.substring("node_name", -1, 1).cast("bigint")
        interval = F.when(F.col("feed") == "error", F.lit(0).cast("bigint")).otherwise((number + 1) * 600_000)
        known = feeds.select("node_name", "feed", interval.alias("interval_ms"))
        silent = feeds.select("node_name", F.lit("nothing").alias("feed"), F.lit(60_000).cast("bigint").alias("interval_ms")).distinct()
        return known.unionByName(silent)
