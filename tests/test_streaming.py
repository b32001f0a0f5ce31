"""The limiter on streams and with stored counters, against its decisions over whole tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvid import sources as S
from corvid.streaming import limiter

START = datetime(2026, 1, 1)
SCHEMA = "key string, ts timestamp, id long"


def at(seconds):
    return START + timedelta(seconds=seconds)


def run(spark, tmp_path, batches, name, **limits):
    """Each batch is a file, taken one by one."""
    limiter.prepare(spark)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}/in/{k:02}")
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}/in")
    q = limiter.stream(s, "key", "ts", "id", **limits).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return q, sorted(map(tuple, spark.table(name).collect()))


def decided(spark, rows, **limits):
    x = limiter.decide(spark.createDataFrame(rows, SCHEMA), "key", "ts", "id", **limits)
    return sorted(map(tuple, x.select("key", "ts", "id", "allowed", "remaining", "retry_after_seconds").collect()))


def test_late_and_tied_requests_get_the_table_decisions(spark, tmp_path):
    one = [("a", at(k % 7), k) for k in range(20)] + [("b", at(200 + k), 100 + k) for k in range(3)]  # ties within a batch, more than pass
    two = [("a", at(130), 40), ("a", at(130), 39), ("b", at(210), 41), ("c", at(1), 42)]
    late = [("b", at(205 + k), 50 + k) for k in range(4)] + [("a", at(59), 60), ("a", at(61), 61), ("c", at(2), 43)]  # of windows before the newest
    _, got = run(spark, tmp_path, [one, two, late], "late", most=5)
    order = {r: n for n, r in enumerate([*sorted(one, key=lambda r: r[1:]), *sorted(two, key=lambda r: r[1:]), *sorted(late, key=lambda r: r[1:])])}
    used, want = {}, []
    for key, ts, i in sorted(order, key=order.get):
        window = (key, ts.replace(second=0))
        n = used[window] = used.get(window, 0) + 1
        want.append((key, ts, i, n <= 5, max(0, 5 - n), 0 if n <= 5 else 60 - ts.second))
    assert got == sorted(want)
    _, single = run(spark, tmp_path, [[*one, *two, *late]], "whole", most=5)
    assert single == decided(spark, [*one, *two, *late], most=5)


def test_state_goes_after_its_hours(spark, tmp_path):
    batches = [[(f"k{k}", at(k), k) for k in range(30)], [("z", at(3 * 86_400), 99)], [("z", at(3 * 86_400 + 61), 100)], [("z", at(3 * 86_400 + 122), 101)]]
    q, got = run(spark, tmp_path, batches, "expiry", watermark="1 hour")
    assert len(got) == 33
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 12  # of the last windows and their timers; thirty windows are gone


def test_a_replayed_batch_leaves_counters_unchanged(spark, tmp_path):
    store = S.Snapshots(spark, f"{tmp_path}/counters")
    batches = [[("a", at(k % 50), k) for k in range(40)] + [(None, at(1), 1)], [("a", at(k), k) for k in range(90)], [], [("b", at(5), 1)]]
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in batches]
    for k in (0, 0, 1, 0, 1, 2, 2, 3):
        limiter.count_batch(frames[k], k, store, "key", "ts")
    assert not limiter.count_batch(frames[3], 3, store, "key", "ts") and store.state()["note"] == {"batch": 3}
    whole = spark.createDataFrame([r for rows in batches for r in rows], SCHEMA)
    want = limiter.counts(whole, "key", "ts").select("key", "window_start", "requests")
    assert sorted(map(str, store.read().select("key", "window_start", "requests").collect())) == sorted(map(str, want.collect()))
    # decisions of a later batch go on from the counters
    got = limiter.decide_stored(frames[3].union(frames[0]), store.read(), "key", "ts", "id", most=60)
    assert {(r["key"], r["allowed"]) for r in got.collect()} == {("a", False), ("b", True), (None, True)}
    none = limiter.decide_stored(frames[1], None, "key", "ts", "id", most=60)
    assert sorted(map(str, none.select("id", "allowed", "remaining").collect())) == sorted(map(str, limiter.decide(frames[1], "key", "ts", "id", most=60).select("id", "allowed", "remaining").collect()))
    old = spark.createDataFrame([("a", at(2 * 86_400), 1)], SCHEMA)
    limiter.count_batch(old, 4, store, "key", "ts")
    assert store.rows() == 1


def test_snapshots_are_whole_at_any_moment(spark, tmp_path):
    import threading

    path = f"{tmp_path}/corpus"
    store = S.Snapshots(spark, path)
    assert store.read() is None and S.existing_rows(spark, path) == 0
    S.publish(spark.range(1).withColumn("v", F.lit(1)), path)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            rows = S.Snapshots(spark, path).read().collect()
            seen.append((len(rows), {r["v"] for r in rows}))

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(2, 7):
        S.publish(spark.range(v).withColumn("v", F.lit(v)), path)
    stop.set()
    reader.join()
    assert seen and all(vs == {n} for n, vs in seen)
    with pytest.raises(ValueError, match="empty"):
        S.publish(spark.range(0), path)
    assert S.existing_rows(spark, path) == 6
    store.prune()
    assert store.read().count() == 6
    (tmp_path / "corpus" / "present-000000000099").write_text("broken")
    with pytest.raises(ValueError):
        S.existing_rows(spark, path)


def test_publish_replaces_and_rejects(spark, tmp_path):
    path = f"{tmp_path}/corpus"
    assert S.publish_or_reject(spark.range(3), None, path, f"{tmp_path}/no") and S.existing_rows(spark, path) == 3
    assert not S.publish_or_reject(spark.range(1), "shrunk", path, f"{tmp_path}/no")
    assert S.existing_rows(spark, path) == 3 and spark.read.parquet(f"{tmp_path}/no").count() == 1
