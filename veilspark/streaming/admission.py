"""The sliding-window rate limit, the replay check and the audit log on streams.

Requests are decided as they come: in the order of time within a batch, batches one after
another.  State is typed (admitted times; a time of expiry; a shard's entries) and goes with a
timer once the watermark has passed it, so it is bounded by the keys of one window and the
delay, or by the cache's capacity; rows later than the delay are dropped before.  Of a key's rows
in a batch only times and identifiers are held.

``transformWithState`` needs the RocksDB state store: set ``PROVIDER`` in the session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilspark.operators.admission import ID_SHARDS, TTL_S, WINDOW_S, audit_lines, shard_of

#: Name and value of the setting that the stateful operators need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Decider(StatefulProcessor):
    """Rows of one key in the order of time; ``decide`` works on what ``held`` loads and ``keep`` stores again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.held()
        for t, ident, k in sorted(((r["t"], r["ident"], r["k"]) for r in rows), key=lambda x: x[:2]):
            held, flag = self.decide(held, t, k)
            yield Row(k=k, ident=ident, t=t, flag=flag)
        self.keep(held)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if (until := self.until(held)) is not None:
            self.handle.registerTimer(max(int(until * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Limiter(_Decider):
    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def open(self) -> None:
        self.state = self.handle.getListState("times", "t double")

    def held(self) -> list[float]:
        return [x[0] for x in self.state.get()]

    def decide(self, recent: list[float], t: float, _) -> tuple[list[float], bool]:
        recent = [x for x in recent if t - x < self.window]
        ok = self.limit <= 0 or len(recent) < self.limit
        return (recent + [t] if ok and self.limit > 0 else recent), ok

    def keep(self, recent: list[float]) -> None:
        self.state.clear()
        if recent:
            self.state.put([(x,) for x in recent])

    def until(self, recent: list[float]) -> float | None:
        return max(recent) + self.window if recent else None


class _Seen(_Decider):
    def __init__(self, ttl: float):
        self.ttl = ttl

    def open(self) -> None:
        self.state = self.handle.getValueState("until", "until double")

    def held(self) -> float:
        return self.state.get()[0] if self.state.exists() else float("-inf")

    def decide(self, until: float, t: float, _) -> tuple[float, bool]:
        again = until > t
        return (until if again else t + self.ttl), again

    def keep(self, until: float) -> None:
        self.state.update((until,))

    def until(self, until: float) -> float:
        return until


class _Cache(_Decider):
    """A shard of the replay cache: identifiers and when they expire, no more than its share."""

    def __init__(self, ttl: float, share: int):
        self.ttl, self.share = ttl, share

    def open(self) -> None:
        self.state = self.handle.getMapState("entries", "k string", "until double")

    def held(self) -> dict[str, float]:
        return {k[0]: v[0] for k, v in self.state.iterator()}

    def decide(self, live: dict[str, float], t: float, k: str) -> tuple[dict, bool]:
        live = {x: u for x, u in live.items() if u > t} if live and min(live.values()) <= t else live
        refused = k in live or len(live) >= self.share
        if not refused:
            live[k] = t + self.ttl
        return live, refused

    def keep(self, live: dict[str, float]) -> None:
        before = self.held()
        for k in before.keys() - live.keys():
            self.state.removeKey((k,))
        for k, u in live.items():
            if before.get(k) != u:
                self.state.updateValue((k,), (u,))

    def until(self, live: dict[str, float]) -> float | None:
        return max(live.values()) if live else None


def _decided(stream: DataFrame, key: str, ts: str, ident: str, flag: str, processor: _Decider, delay: str, by: str | None = None) -> DataFrame:
    kind = dict(stream.dtypes)[key] if by is None else "string"
    timed = stream.select(F.col(key).cast(kind).alias("k"), F.col(ident).cast("bigint").alias("ident"), F.col(ts).cast("double").alias("t"), *([F.col(by).alias("by")] if by else []))
    timed = timed.withColumn("event_time", F.timestamp_millis((F.col("t") * 1000).cast("bigint"))).withWatermark("event_time", delay)
    out = timed.groupBy("by" if by else "k").transformWithState(processor, f"k {kind}, ident bigint, t double, flag boolean", "Append", "EventTime")
    return out.select(F.col("k").cast(dict(stream.dtypes)[key]).alias(key), F.col("ident").alias(ident), F.col("t").alias(ts), F.col("flag").alias(flag))


def rate_limited(stream: DataFrame, key: str, ts: str, ident: str, limit: int, window: int = WINDOW_S, delay: str = "10 minutes") -> DataFrame:
    """As ``operators.admission.rate_limit``."""
    return _decided(stream, key, ts, ident, "admitted", _Limiter(limit, window), delay)


def replay_checked(stream: DataFrame, key: str, ts: str, ident: str, ttl: int = TTL_S, delay: str = "10 minutes", most: int | None = None, shards: int = ID_SHARDS) -> DataFrame:
    """As ``operators.admission.replays``; with ``most`` entries a full shard refuses new identifiers."""
    if most is None:
        return _decided(stream, key, ts, ident, "replayed", _Seen(ttl), delay)
    sharded = stream.withColumn("replay_shard__", shard_of(F.col(key), shards))
    return _decided(sharded, key, ts, ident, "replayed", _Cache(ttl, -(-most // shards)), delay, "replay_shard__")


def audit_sink(path: str):
    """For ``foreachBatch``: a batch's decisions as audit lines in a folder of its number, so a batch that comes again writes once."""

    def write(batch: DataFrame, number: int) -> None:
        audit_lines(batch).select("line").write.mode("overwrite").text(f"{path}/batch={number}")

    return write
