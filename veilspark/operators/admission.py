"""Admission of requests: networks, routes, rates, replays, freshness, and the cascade of reasons.

A client's (or a request id's) rows are gone through in order of time; all that is kept
between two rows is the time of expiry, or the last admitted times.  Rows are sorted over
all tasks, so a busy key lies in many.  Where nothing happened for a whole window, its
state is empty and a task may begin afresh; only the rows from a task's beginning to the first
such place wait for the state at the end of the task before, and are gone through once
more.  Rows that don't count are dealt out with the others by time.
"""

from __future__ import annotations

import hashlib
import hmac
import pickle
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from veilspark.functions.shared import written

WINDOW_S = 60
MAX_SKEW_S = 120
TTL_S = 2 * MAX_SKEW_S + 1
#: Shards of the replay cache; each holds its share of the entries.
ID_SHARDS = 16


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null if it is none."""
    ok = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    p = F.split(ip, r"\.")
    return F.when(ok, sum((p[i].cast("bigint") * 256 ** (3 - i) for i in range(1, 4)), p[0].cast("bigint") * 256**3))


def ipv6_digits(ip: Column) -> Column:
    """The address as 32 hexadecimal digits, so that the order of texts is that of addresses; null if it is none.

    The last four bytes may be written with dots.
    """
    tail = F.regexp_extract(ip, r":([0-9]+\.[0-9.]+)$", 1)
    number = F.hex(ipv4_number(tail))
    pairs = F.concat_ws(":", *[F.substring(F.lpad(number, 8, "0"), k, 4) for k in (1, 5)])
    ip = F.when((tail != "") & number.isNotNull(), F.concat(F.substring(ip, F.lit(1), F.length(ip) - F.length(tail)), pairs)).otherwise(ip)
    sides = F.split(F.lower(ip), "::", -1)
    groups = lambda x: F.filter(F.split(x, ":", -1), lambda g: g != "") if x is not None else None
    left, right = groups(sides[0]), F.coalesce(groups(F.get(sides, F.lit(1))), F.array().cast("array<string>"))
    gap = F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))
    every = F.concat(left, F.array_repeat(F.lit("0"), gap), right)
    shape = F.lower(ip).rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,7})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,7})?)$")
    ok = shape & (F.size(every) == 8) & ((F.size(sides) == 1) | (gap >= 1))
    return F.when(ok, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))


def networks(listed: list[str]) -> list[tuple[int, int, int]]:
    """Version, lowest and highest address of each network; what is none is left out."""
    from ipaddress import ip_network

    out = []
    for item in filter(None, map(str.strip, listed)):
        try:
            n = ip_network(item, strict=False)
        except ValueError:
            continue
        out.append((n.version, int(n.network_address), int(n.broadcast_address)))
    return out


def in_networks(ip: Column, listed: list[str]) -> Column:
    """Whether a network of the configured list has the address.

    An empty list allows all; a list without a single valid network allows none, and so
    does an address that is none.
    """
    if not any(map(str.strip, listed)):
        return F.lit(True)
    out, four, six = F.lit(False), ipv4_number(ip), ipv6_digits(ip)
    for version, low, high in networks(listed):
        out = out | (four.between(low, high) if version == 4 else six.between(f"{low:032x}", f"{high:032x}"))
    return F.coalesce(out, F.lit(False))


def client_ip(peer: Column, forwarded: Column, real: Column, trusted: list[str]) -> Column:
    """Behind a trusted proxy the first forwarded address, else the real-ip header, else the peer; headers are taken as they are."""
    if not networks(trusted):
        return peer
    first = F.when(forwarded != "", F.trim(F.split(forwarded, ",")[0]))
    return F.when(in_networks(peer, trusted), F.coalesce(first, F.when(real != "", F.trim(real)), peer)).otherwise(peer)


# Routes that requests may take, and those for managing models.
ROUTES = [
    ("GET", "/api/tags"), ("GET", "/api/version"), ("POST", "/api/show"), ("POST", "/api/chat"), ("POST", "/api/generate"), ("POST", "/api/embed"),
    ("POST", "/api/embeddings"), ("GET", "/v1/models"), ("POST", "/v1/chat/completions"), ("POST", "/v1/completions"), ("POST", "/v1/embeddings"),
]
MANAGEMENT = ["/api/pull", "/api/delete", "/api/create", "/api/copy", "/api/push", "/api/blobs"]


def route_allowed(method: Column, path: Column, management: bool = False) -> Column:
    """Whether method and path are a listed pair; with ``management`` any method on its paths too."""
    listed = F.concat_ws(" ", F.upper(method), path).isin(*[" ".join(r) for r in ROUTES])
    return F.coalesce(listed | path.isin(*MANAGEMENT) if management else listed, F.lit(False))


def config_matches(config: dict[str, Column], wanted: dict[str, str]) -> Column:
    """Every field that the server sets must be equal; one it leaves empty isn't checked, a missing one counts as empty."""
    out = F.lit(True)
    for field, value in wanted.items():
        if value:
            out = out & (F.coalesce(config[field], F.lit("")) == value)
    return out


def in_order(df: DataFrame, key: str, ts: str, ident: str, flag: str, start: Callable, step: Callable, apart: float, when: str | None = None, value: str | None = None) -> DataFrame:
    """``df`` with ``flag``: each key's rows in order of time through ``step`` (state, time, value) -> (state, flag).

    A state must be as good as new after ``apart`` seconds without a row.  Rows for which
    ``when`` isn't true neither change the state nor get a flag.
    """
    columns = [c for c in df.columns if c.lower() != flag.lower()]
    kept, last = [F.col(f"`{c}`") for c in columns], len(columns)
    counts = F.coalesce(F.col(when), F.lit(False)) if when else F.lit(True)
    rows = df.select(*kept, counts.alias("o__counts"), F.when(counts, F.col(key)).alias("o__key"), F.col(ts).cast("double").alias("o__t"), F.col(ident).alias("o__ident"), F.col(value or key).alias("o__value"))
    order = ["o__counts", "o__key", "o__t", "o__ident"]
    kind = rows.schema["o__key"].dataType.simpleString()
    border = f"struct<part:int,first_key:{kind},first_t:double,last_key:{kind},last_t:double,state:binary>"
    edge_type = to_arrow_type(T._parse_datatype_string(border))
    plain = T.StructType([*rows.schema.fields[:last], T.StructField(flag, T.BooleanType())])

    def new(k, t, k0, t0) -> bool:
        return k != k0 or (t is not None and t0 is not None and t - t0 >= apart)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, at, state, schema = TaskContext.get().partitionId(), None, None, None, None
        for batch in batches:
            flags, waits = [], []
            for use, k, t, _, v in zip(*[c.to_pylist() for c in batch.columns[last:]]):
                if not use:
                    flags.append(None)
                    waits.append(False)
                    continue
                if first is None:
                    first = (k, t)
                elif new(k, t, *at):
                    state = start()
                at = (k, t)
                if state is not None:
                    state, decided = step(state, t, v)
                flags.append(decided if state is not None else None)
                waits.append(state is None)
            schema = schema or batch.schema
            nothing = pa.nulls(batch.num_rows, edge_type)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_()), pa.array(waits, pa.bool_()), pa.array([part] * batch.num_rows, pa.int32()), nothing], names=[*batch.schema.names, flag, "o__waits", "o__part", "o__border"])
        if first is not None:
            edge = {"part": part, "first_key": first[0], "first_t": first[1], "last_key": at[0], "last_t": at[1], "state": None if state is None else pickle.dumps(state)}
            empty = [pa.nulls(1, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*empty, pa.nulls(1, pa.bool_()), pa.array([False]), pa.array([part], pa.int32()), pa.array([edge], edge_type)], names=[*schema.names, flag, "o__waits", "o__part", "o__border"])

    nullable = [T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]
    wide = T.StructType([*nullable, T.StructField(flag, T.BooleanType()), T.StructField("o__waits", T.BooleanType()), T.StructField("o__part", T.IntegerType()), T.StructField("o__border", T._parse_datatype_string(border))])
    found = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(first_pass, wide), "in-order")
    # a row for each task: where a task's first rows go on, and with which state
    chains, before = [], None
    for e in sorted((r.o__border for r in found.where("o__border is not null").select("o__border").collect()), key=lambda e: e.part):
        goes_on = before is not None and not new(e.first_key, e.first_t, before.last_key, before.last_t)
        if not (goes_on and before.state is None):
            chains.append((e.part, e.part, before.state if goes_on else None))
        else:
            chains.append((e.part, chains[-1][1], None))
        before = e
    spark = df.sparkSession
    mapping = F.broadcast(spark.createDataFrame(chains, "o__part int, o__chain int, o__state binary"))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            flags = []
            for t, v, chain, entry in zip(*[batch.column(c).to_pylist() for c in ("o__t", "o__value", "o__chain", "o__state")]):
                if chain != at:
                    at, state = chain, start() if entry is None else pickle.loads(entry)
                state, decided = step(state, t, v)
                flags.append(decided)
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(flags, pa.bool_())], names=[*columns, flag])

    waiting = found.where("o__waits").drop(flag).join(mapping, "o__part")
    waiting = waiting.select(*kept, "o__t", "o__ident", "o__value", "o__part", "o__chain", "o__state").repartition("o__chain").sortWithinPartitions("o__chain", "o__part", "o__t", "o__ident")
    return found.where("not o__waits and o__border is null").select(*kept, F.col(f"`{flag}`")).unionByName(waiting.mapInArrow(second_pass, plain))


def rate_limit(df: DataFrame, key: str, ts: str, ident: str, limit: int, window: int = WINDOW_S, when: str | None = None, most_keys: int | None = None) -> DataFrame:
    """``df`` with ``admitted``: at most ``limit`` admitted in any ``window`` seconds; rejected ones don't count.

    ``most_keys``: keys that can be followed, those that come first; others are rejected.
    """
    if limit <= 0:
        return df.withColumn("admitted", F.lit(True) if when is None else F.when(F.col(when), True))
    if most_keys is not None:
        first = (df if when is None else df.where(when)).groupBy(F.col(key).alias("k__")).agg(F.min(F.struct(ts, ident)).alias("first"))
        followed = first.orderBy("first").limit(most_keys).select("k__", F.lit(True).alias("followed__"))
        df = df.join(followed, df[key].eqNullSafe(F.col("k__")), "left").drop("k__").withColumn("followed__", F.coalesce("followed__", F.lit(False)))

    def step(recent: deque, t: float | None, _) -> tuple[deque, bool]:
        while recent and (t is None or recent[0] is None or not t - recent[0] < window):
            recent.popleft()
        ok = len(recent) < limit
        if ok:
            recent.append(t)
        return recent, ok

    out = in_order(df, key, ts, ident, "admitted", deque, step, window, when)
    return out if most_keys is None else out.withColumn("admitted", F.col("admitted") & F.col("followed__")).drop("followed__")


def shard_of(key: Column, shards: int) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint") % shards


def replays(df: DataFrame, key: str, ts: str, ident: str, ttl: int = TTL_S, when: str | None = None, most: int | None = None, shards: int = ID_SHARDS) -> DataFrame:
    """``df`` with ``replayed``: seen before and not yet expired; a replay doesn't extend the time.

    ``most``: entries that the cache holds; a new id that finds it full counts as replayed too,
    and isn't taken up.  The cache is split into ``shards`` by a hash of the id, each with an
    equal share (rounded up), so that shards are gone through beside each other; with one
    shard the bound is that of the whole.
    """
    if most is None:

        def step(until: float | None, t: float | None, _) -> tuple[float, bool]:
            again = until > 0 and t is not None and until > t
            return (until if again else 0.0 if t is None else t + ttl), again

        return in_order(df, key, ts, ident, "replayed", float, step, ttl, when)
    share = -(-most // shards)

    def bounded(live: OrderedDict, t: float | None, k) -> tuple[OrderedDict, bool]:
        # entries expire in the order in which they were taken up
        while live and (t is None or next(iter(live.values())) <= t):
            live.popitem(last=False)
        refused = k in live or len(live) >= share
        if not refused and t is not None:
            live[k] = t + ttl
        return live, refused

    sharded = df.withColumn("replay_shard__", shard_of(F.col(key), shards))
    return in_order(sharded, "replay_shard__", ts, ident, "replayed", OrderedDict, bounded, ttl, when, key).drop("replay_shard__")


def fresh(now: Column, ts: Column, skew: int = MAX_SKEW_S) -> Column:
    return F.abs(now - ts) <= skew


def valid_path(path: Column) -> Column:
    """An absolute path without tricks: no empty parts, users, backslashes, queries, fragments, control characters."""
    return path.rlike(r"^/") & ~path.rlike(r"//|[@\\?#\x00-\x1f]")


def cascade(checks: list[tuple[int, str, Column]]) -> Column:
    """(status, reason) of the first check that fails, else 200 and ok."""
    out = None
    for status, reason, failed in checks:
        value = F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
        out = F.when(failed, value) if out is None else out.when(failed, value)
    return out.otherwise(F.struct(F.lit(200).alias("status"), F.lit("ok").alias("reason")))


# -- sealed requests

VERSION, TO_SERVER, TO_CLIENT = 2, 1, 2


def derived_key(secret: bytes, info: bytes, size: int = 32) -> bytes:
    """HKDF with SHA-256 and no salt (RFC 5869); keys are made on the driver."""
    prk, out, block = hmac.new(b"\0" * 32, secret, hashlib.sha256).digest(), b"", b""
    for i in range(1, -(-size // 32) + 1):
        block = hmac.new(prk, block + info + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:size]


def additional_data(version: Column, direction: Column, ts: Column, req_id: Column) -> Column:
    """Version, direction, eight big-endian bytes of the time, request id; null for a time below zero."""
    return F.when(ts >= 0, F.concat(F.unhex(F.lpad(F.hex(version), 2, "0")), F.unhex(F.lpad(F.hex(direction), 2, "0")), F.unhex(F.lpad(F.hex(ts), 16, "0")), req_id))


def seal(text: Column, key: bytes, nonce: Column, aad: Column) -> Column:
    """AES-GCM; the nonce is the first 12 bytes of the result."""
    return F.aes_encrypt(text, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce, aad)


def open_sealed(sealed: Column, key: bytes, aad: Column) -> Column:
    """The text, or null if key, data or additional data are not those it was sealed with."""
    return F.try_aes_decrypt(sealed, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")


@dataclass(frozen=True)
class Settings:
    """What a server is set to; empty lists and fields aren't checked."""

    path: str = "/secure/request"
    allowed: tuple[str, ...] = ()
    limit: int = 60
    window: int = WINDOW_S
    most_keys: int | None = 100_000
    max_body: int = 10 * 1024 * 1024
    skew: int = MAX_SKEW_S
    ttl: int = TTL_S
    most_ids: int | None = None
    id_shards: int = ID_SHARDS
    config: tuple[tuple[str, str], ...] = ()
    management: bool = False


def decide(requests: DataFrame, key: bytes, settings: Settings) -> DataFrame:
    """``status`` and ``reason`` of every request: the first check that fails decides.

    ``requests``: ``ident``, ``path``, ``ip``, ``now`` (seconds), ``length`` (text),
    ``envelope`` (a JSON text: ts, req_id, sealed), ``upstream`` (a status; null: no answer).
    The rate limit counts only requests that get past path and address, the replay check
    only those that could be opened: two shuffles, by address and by request id.
    """
    s = settings
    df = requests.withColumns({"early": F.when(~F.coalesce(F.rtrim("path", F.lit("/")) == s.path, F.lit(False)), "path").when(~in_networks(F.col("ip"), list(s.allowed)), "ip_not_allowed")})
    df = df.withColumn("counts", F.col("early").isNull())
    df = rate_limit(df, "ip", "now", "ident", s.limit, s.window, "counts", s.most_keys)
    length = F.when(F.trim("length") == "", F.lit(0)).otherwise(F.expr("try_cast(length as bigint)"))
    env = F.from_json("envelope", "ts bigint, req_id string, sealed string", {"mode": "PERMISSIVE"})
    df = df.withColumns({"n": F.coalesce(length, F.when(F.col("length").isNull(), F.lit(0))), "e": F.when(F.json_object_keys("envelope").isNotNull(), env)})
    req, sealed = F.expr("try_to_binary(e.req_id, 'base64')"), F.expr("try_to_binary(e.sealed, 'base64')")
    opened = open_sealed(sealed, key, additional_data(F.lit(VERSION), F.lit(TO_SERVER), F.col("e.ts"), req))
    df = df.withColumn("inner", F.when(fresh(F.col("now"), F.col("e.ts"), s.skew), opened))
    df = df.withColumn("middle", F.coalesce("early", F.when(~F.col("admitted"), "rate_limited").when(F.col("n").isNull(), "bad_content_length").when((F.col("n") < 0) | (F.col("n") > s.max_body), "body_too_large").when(F.col("e").isNull(), "bad_request").when(F.col("inner").isNull(), "decrypt_failure")))
    df = df.withColumns({"reaches": F.col("middle").isNull(), "req": F.col("e.req_id")})
    df = replays(df, "req", "now", "ident", s.ttl, "reaches", s.most_ids, s.id_shards)
    get = lambda f: F.get_json_object("inner", f"$.{f}")
    config = {f: get(f"config.{f}") for f, _ in s.config}
    method, path = F.coalesce(get("method"), F.lit("GET")), F.coalesce(get("path"), F.lit("/"))
    late = (
        F.when(F.col("replayed"), "replay")
        .when(F.json_object_keys("inner").isNull(), "bad_inner_json")
        .when(~(get("config").isNotNull() & config_matches(config, dict(s.config))), "bad_config")
        .when(~valid_path(path), "invalid_path")
        .when(~route_allowed(method, path, s.management), "route_denied")
        .when(F.col("upstream").isNull(), "upstream_error")
    )
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    df = df.withColumn("reason", F.coalesce("middle", late))
    return df.select("ident", "ip", "now", F.coalesce(status[F.col("reason")], F.col("upstream")).cast("int").alias("status"), F.coalesce("reason", F.lit("ok")).alias("reason"), F.when(F.col("reaches"), F.col("req")).alias("req_id"))


# The status of each reason.
STATUS = {
    "path": 404, "ip_not_allowed": 403, "rate_limited": 429, "bad_content_length": 400, "body_too_large": 413, "bad_request": 400, "decrypt_failure": 401,
    "replay": 401, "bad_inner_json": 400, "bad_config": 401, "invalid_path": 400, "route_denied": 403, "upstream_error": 502,
}


def audit_lines(decided: DataFrame, method: str = "POST", path: str = Settings.path) -> DataFrame:
    """A JSON line for each decision, without bodies; fields that have nothing are left out."""
    at = F.date_format(F.timestamp_seconds(F.col("now").cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    reason = F.when(F.col("reason") != "ok", F.col("reason"))
    return decided.select("ident", F.to_json(F.struct(at.alias("ts"), "ip", F.lit(method).alias("method"), F.lit(path).alias("path"), "status", "req_id", reason.alias("reason"))).alias("line"))


def write_audit(decided: DataFrame, path: str) -> None:
    """Append the lines as text files; requests in the order of time within a file."""
    audit_lines(decided).select("line").write.mode("append").text(path)
