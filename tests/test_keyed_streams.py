import datetime as dt
import random
import time

from conftest import values
from hostweave.streaming import feeds, keyed, sinks
from hostweave.workspace import fresh_dir

LINES = "node_name string, log_name string, id long, line string"


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def newest(rows, n):
    logs = {}
    for row in set(rows):
        logs.setdefault(row[:2], []).append(row)
    return sorted((r for own in logs.values() for r in sorted(own, key=lambda r: r[2])[-n:]), key=repr)


def test_newest_lines_over_batches_restarts_and_checkpoints(spark):
    work, rng, rows, held = fresh_dir(spark, "newest"), random.Random(1), [], None
    for step in range(4):
        new = [(f"n{rng.randrange(2)}", rng.choice("abc"), i, None if i % 7 == 0 else f"line {i}") for i in rng.sample(range(step * 20, 200 + step * 60), 60)]
        new = [r for r in new if r[2] not in {x[2] for x in rows}]
        rows += new
        lines = land(spark, f"{work}/landed", new + new[:3], LINES)  # some lines come twice
        changes = keyed.keep_newest(lines, 5, initial=held if step >= 2 else None)
        checkpoint = f"{work}/checkpoint{step // 2}"
        with keyed.keyed_state(spark):
            feeds.drain(changes, sinks.append_history(f"{work}/changes{step // 2}"), checkpoint, "update")
        assert values(keyed.newest_kept(spark, checkpoint), "node_name", "log_name", "id", "line") == newest(rows, 5)
        if step == 1:
            held = keyed.newest_kept(spark, checkpoint)
            net = {}
            for r in spark.read.parquet(f"{work}/changes0").collect():
                net[r.id] = net.get(r.id, 0) + (1 if r.change == "entered" else -1)
            assert sorted(i for i, n in net.items() if n) == sorted(r[2] for r in newest(rows, 5)) and set(net.values()) <= {0, 1}


def test_heartbeat_goes_stale_without_input_and_comes_back(spark):
    work, kind = fresh_dir(spark, "beats"), "node_name string, collected_at timestamp_ntz"
    at = dt.datetime(2024, 1, 1)
    stream = land(spark, f"{work}/landed", [("a", at), ("b", None), ("a", at - dt.timedelta(1))], kind)
    with keyed.keyed_state(spark):
        run = feeds.run_feed(keyed.heartbeats(stream, 300), sinks.append_history(f"{work}/changes"), f"{work}/checkpoint", "500 milliseconds", "update")

    def until(wanted):
        found, end = [], time.time() + 90
        while time.time() < end and run.isActive:
            time.sleep(1)
            if any(p["numInputRows"] for p in run.recentProgress):
                found = [(r.node_name, r.last_seen, r.status) for r in spark.read.parquet(f"{work}/changes").orderBy("batch_id").collect()]
                if wanted <= set(found):
                    break
        return found

    try:
        first = {("a", at, "alive"), ("b", None, "alive"), ("a", at, "stale"), ("b", None, "stale")}
        assert set(until(first)) == first
        land(spark, f"{work}/landed", [("b", at + dt.timedelta(2))], kind)
        again = [r for r in until({("b", at + dt.timedelta(2), "stale")}) if r[0] == "b"]
        assert [r[2] for r in again] == ["alive", "stale", "alive", "stale"] and again[-1][1] == at + dt.timedelta(2)
    finally:
        run.stop()


SAMPLES = "node_name string, mount_point string, used long, collected_at timestamp_ntz, seq long"


def test_latest_in_windows_drops_what_comes_behind_the_watermark(spark):
    work, day = fresh_dir(spark, "windows"), dt.datetime(2024, 3, 9)

    def step(rows):
        stream = land(spark, f"{work}/landed", rows, SAMPLES)
        with keyed.keyed_state(spark):
            feeds.drain(keyed.latest_in_windows(stream, ["node_name", "mount_point"]), sinks.append_history(f"{work}/table"), f"{work}/checkpoint", "update")
        stored = spark.read.parquet(f"{work}/table")
        return values(keyed.latest_of_windows(stored, ["node_name", "mount_point"]), "mount_point", "used")

    hour = dt.timedelta(hours=1)
    assert step([("n", "/", 1, day, 1), ("n", "/", 2, day + hour, 2), ("n", "/x", 3, day, 3), ("n", "/y", 9, None, 4)]) == [("/", 2), ("/x", 3)]
    assert step([("n", "/", 4, day + 30 * hour, 5), ("n", "/x", 5, day + hour, 6)]) == [("/", 4), ("/x", 5)]  # the day is still open
    assert step([("n", "/x", 6, day + 2 * hour, 7), ("n", "/z", 7, day + 24 * hour, 8)]) == [("/", 4), ("/x", 5), ("/z", 7)]  # the day is closed
    assert {str(r.window_date) for r in spark.read.parquet(f"{work}/table").select("window_date").collect()} == {"2024-03-09", "2024-03-10"}


def test_first_copies_within_the_watermark(spark):
    work, day = fresh_dir(spark, "copies"), dt.datetime(2024, 3, 9)
    found = []
    for rows in ([("n", "/", 1, day, 1), ("n", "/", 1, day, 1)], [("n", "/", 1, day, 1), ("n", "/", 2, day, 2)]):
        stream = land(spark, f"{work}/landed", rows, SAMPLES)
        with keyed.keyed_state(spark):
            feeds.drain(keyed.first_copies(stream, ["node_name", "seq"]), sinks.append_history(f"{work}/table"), f"{work}/checkpoint")
        found.append(values(spark.read.parquet(f"{work}/table"), "used", "seq"))
    assert found == [[(1, 1)], [(1, 1), (2, 2)]]
