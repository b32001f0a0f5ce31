"""Fixed-window rate limiting: the same decisions over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.sources import Snapshots

# Fixed values.
MOST, SECONDS, KEEP_HOURS = 30, 60, 24


def _micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def window_start(ts: Column | str, seconds: int = SECONDS) -> Column:
    t = _micros(ts)
    return F.timestamp_micros(F.floor(t / (seconds * 1_000_000)) * (seconds * 1_000_000))


def retry_after(ts: Column | str, seconds: int = SECONDS) -> Column:
    """Whole seconds until the window ends, at least one."""
    t = _micros(ts)
    return F.greatest(F.lit(1), F.ceil((_micros(window_start(ts, seconds)) + seconds * 1_000_000 - t) / 1_000_000)).cast("long")


def decide(requests: DataFrame, key: str, ts: str, tie: str, most: int = MOST, seconds: int = SECONDS) -> DataFrame:
    """requests with allowed, remaining and retry_after_seconds: the first `most` of a key in each window aligned to the epoch pass.

    Counting every request or only allowed ones gives the same decisions. A key's state is one window's row numbers, spread over windows.
    """
    x = requests.withColumn("window_start", window_start(ts, seconds))
    n = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(ts, tie))
    x = x.withColumn("_n", n).withColumn("allowed", F.col("_n") <= most)
    return x.withColumns({"remaining": F.greatest(F.lit(0), F.lit(most) - F.col("_n")), "retry_after_seconds": F.when(F.col("allowed"), F.lit(0)).otherwise(retry_after(ts, seconds))}).drop("_n")


def counts(requests: DataFrame, key: str, ts: str, most: int = MOST, seconds: int = SECONDS, watermark: str | None = None) -> DataFrame:
    """Requests and allowed requests of each key and window; with a watermark it runs on a stream and drops old state."""
    x = requests.withWatermark(ts, watermark) if watermark else requests
    g = x.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), key).agg(F.count("*").alias("requests"))
    return g.select(F.col("w.start").alias("window_start"), key, "requests", F.least("requests", F.lit(most)).alias("allowed"))


def stream(requests: DataFrame, key: str, ts: str, tie: str, most: int = MOST, seconds: int = SECONDS, watermark: str = "24 hours") -> DataFrame:
    """decide() on a stream: key, ts, tie, allowed, remaining and retry_after_seconds of each request.

    The state is a counter for each key and window, so a request of an older window that arrives late is counted there, and one hot key is dealt out
    by its windows. Requests are counted in order of arrival, those of one batch by time and tie as in decide(). A window's counter goes by
    a timer once the watermark has passed it by KEEP_HOURS; requests behind the watermark are dropped by the stream. A task holds at most
    `most` requests of a window, however many arrive. The session needs the RocksDB state store, which prepare() sets.
    """
    import heapq

    import pandas as pd
    from pyspark.sql import types as T
    from pyspark.sql.streaming import StatefulProcessor

    span = seconds * 1_000_000
    out = T.StructType([*(requests.schema[c] for c in (key, ts, tie)), T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.IntegerType()), T.StructField("retry_after_seconds", T.LongType())])

    class Windows(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.used = handle.getValueState("used", "used long")

        def handleInputRows(self, k, frames, timer):
            used = int(self.used.get()[0]) if self.used.exists() else 0
            start = int(pd.Timestamp(k[1]).value // 1000)
            room = max(0, most - used)
            first: list[tuple] = []  # the earliest requests so far, latest on top

            def rows(items, allowed):
                wait = [0 if allowed else max(1, -(-(start + span - t) // 1_000_000)) for t, *_ in items]
                left = [max(0, most - used - n - 1) if allowed else 0 for n in range(len(items))]
                return pd.DataFrame({key: [k[0]] * len(items), ts: pd.to_datetime([t for t, *_ in items], unit="us"), tie: [v for _, v in items], "allowed": [allowed] * len(items), "remaining": pd.Series(left, dtype="int32"), "retry_after_seconds": pd.Series(wait, dtype="int64")})

            for frame in frames:
                times = frame[ts].astype("datetime64[us]").astype("int64")
                late = []
                for t, v in sorted(zip(times.tolist(), frame[tie].tolist(), strict=True)):
                    entry = _Later(t, v)
                    if len(first) < room:
                        heapq.heappush(first, entry)
                    else:
                        late.append(heapq.heappushpop(first, entry).item if first else entry.item)
                if late:
                    yield rows(late, False)
            kept = sorted(e.item for e in first)
            if kept:
                yield rows(kept, True)
            used += len(kept)
            self.used.update((used,))
            self.handle.registerTimer(start // 1000 + span // 1000 + KEEP_HOURS * 3_600_000)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.used.clear()
            yield from ()

        def close(self):
            pass

    x = requests.select(key, ts, tie).withWatermark(ts, watermark).withColumn("_window", window_start(ts, seconds))
    return x.groupBy(key, "_window").transformWithStateInPandas(Windows(), out, "Append", "EventTime")


class _Later:
    """A request in a heap whose top is the latest."""

    def __init__(self, t, tie):
        self.item = (t, tie)

    def __lt__(self, other):
        return self.item > other.item


def prepare(spark) -> None:
    """Set the state store that stream() needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def count_batch(batch: DataFrame, batch_id: int, store: Snapshots, key: str, ts: str, seconds: int = SECONDS) -> bool:
    """Add a batch's requests to the stored counters (key, window_start, requests), once: for foreachBatch.

    The store's pointer holds the last batch's id, and changes together with the counters, so that a batch that is replayed after a failure
    changes nothing (False). Windows older than KEEP_HOURS before the newest one are dropped.
    """
    now = store.state()
    if now is not None and batch_id <= now["note"]["batch"]:
        return False
    new = batch.select(F.col(key).alias("key"), window_start(ts, seconds).alias("window_start")).groupBy("key", "window_start").agg(F.count("*").alias("requests"))
    old = store.read()
    both = new if old is None else old.unionByName(new).groupBy("key", "window_start").agg(F.sum("requests").alias("requests"))
    newest = both.agg(F.max("window_start")).scalar()
    version, seen = store.stage(both.where(F.col("window_start") >= newest - F.expr(f"INTERVAL {KEEP_HOURS} HOURS")))
    if not seen["rows"] and now is not None:  # a batch without requests
        store.drop(version)
        version, seen = now["version"], now
    store.point(version, seen["rows"], {"batch": batch_id})
    return True


def decide_stored(batch: DataFrame, counters: DataFrame | None, key: str, ts: str, tie: str, most: int = MOST, seconds: int = SECONDS) -> DataFrame:
    """decide() of a batch whose windows have begun: stored counters (key, window_start, requests) count first."""
    x = decide(batch, key, ts, tie, most, seconds).drop("allowed", "remaining", "retry_after_seconds")
    n = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(ts, tie))
    x = x.withColumn("_n", n.cast("long"))
    if counters is not None:
        c = counters.select(F.col("key").alias("_key"), F.col("window_start").alias("_start"), "requests")
        x = x.join(c, F.col(key).eqNullSafe(F.col("_key")) & (F.col("window_start") == F.col("_start")), "left").withColumn("_n", F.col("_n") + F.coalesce("requests", F.lit(0))).drop("_key", "_start", "requests")
    x = x.withColumn("allowed", F.col("_n") <= most)
    return x.withColumns({"remaining": F.greatest(F.lit(0), F.lit(most) - F.col("_n")).cast("int"), "retry_after_seconds": F.when(F.col("allowed"), F.lit(0)).otherwise(retry_after(ts, seconds))}).drop("_n")


def client_ip(forwarded: Column | str, real: Column | str | None = None, platform: Column | str | None = None, hops: int = 1, trusted: bool = True) -> Column:
    """The client's address from proxy headers: the platform's, the real one, else the n-th from the right; 'unknown' if untrusted or absent."""
    if not trusted:
        return F.lit("unknown")
    c = lambda x: F.col(x) if isinstance(x, str) else x
    first = [F.nullif(F.btrim(F.get(F.split(c(x), ","), F.lit(0))), F.lit("")) for x in (platform, real) if x is not None]
    parts = F.filter(F.transform(F.split(F.coalesce(c(forwarded), F.lit("")), ","), lambda p: F.btrim(p)), lambda p: p != "")
    return F.coalesce(*first, F.get(parts, F.greatest(F.size(parts) - max(1, hops), F.lit(0))), F.lit("unknown"))


def hmac_sha256(secret: str, message: Column | str) -> Column:
    """Hexadecimal HMAC-SHA256 of a text, from two rounds of SHA-256 with the padded secret."""
    import hashlib

    raw = secret.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    m = F.encode(F.col(message) if isinstance(message, str) else message, "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, m), 256))), 256)


def client_key(secret: str, ip: Column | str) -> Column:
    return hmac_sha256(secret, F.concat(F.lit("rate-limit|"), F.col(ip) if isinstance(ip, str) else ip))


def pruned(state: DataFrame, now: Column, ts: str = "window_start") -> DataFrame:
    """Stored windows of the last KEEP_HOURS."""
    return state.where(F.col(ts) >= now - F.expr(f"INTERVAL {KEEP_HOURS} HOURS"))
