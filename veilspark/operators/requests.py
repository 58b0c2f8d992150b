"""Request bodies: which texts they have, masking them in place, and refusing what isn't known.

A body is a JSON text of any depth.  ``leaves`` walks it (a small function over Arrow
batches) and gives every value with its path; what is allowed, and why not, is decided
by DataFrame expressions; masked texts go back to their places by path.  Nothing of a
body that has a reason may be forwarded.

A path is an array of parts: a key is a dot and the key, a position is ``[]`` (or, where it
says which, ``[3]``).  So no key, whatever it is called, can pass for a position or for two parts.

Texts of a request go in a fixed order: messages, then prompt, input, system, template
and suffix.  A body that is null, no JSON or no object has a reason of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.rows import with_rows

from . import mask
from .rules import RULES, Rule

# Fields that are text, keys that are never let through, strings that a field may be.
TEXT_FIELDS = ["prompt", "input", "system", "template", "suffix"]
BLOCKED = ["images", "tools", "tool_calls", "audio", "image_url"]
ALLOWED = {"format": ["json"], "encoding_format": ["float", "base64"], "think": ["low", "medium", "high"], "messages [] role": ["system", "developer", "user", "assistant", "tool"], "messages [] content [] type": ["text"]}
KEEP_ALIVE = r"^-?\d+(?:ns|us|µs|ms|s|m|h)?$"

LEAF = "struct<pointer:array<string>,path:array<string>,kind:string,value:string>"


def parts(path: str) -> list[str]:
    """The parts of a path that is written with blanks: ``messages [] role``."""
    return [p if p == "[]" else f".{p}" for p in path.split()]


def at(leaf: Column, *paths: str) -> Column:
    """Whether a leaf has one of these paths."""
    return any_of([leaf["path"] == F.array(*map(F.lit, parts(p))) for p in paths])


def _walk(value, pointer: tuple = (), path: tuple = ()) -> Iterator[tuple[tuple, tuple, str, str | None]]:
    """Pointer (with positions), path, kind and string value of every value, containers before their parts; an object's value are its keys."""
    if isinstance(value, dict):
        yield pointer, path, "object", json.dumps(sorted(value))
        for k, v in value.items():
            yield from _walk(v, (*pointer, f".{k}"), (*path, f".{k}"))
    elif isinstance(value, list):
        yield pointer, path, "array", str(len(value))
        for i, v in enumerate(value):
            yield from _walk(v, (*pointer, f"[{i}]"), (*path, "[]"))
    else:
        yield pointer, path, "string" if isinstance(value, str) else "null" if value is None else "other", value if isinstance(value, str) else None


def _parsed(body: str | None):
    try:
        value = json.loads(body)
    except (TypeError, ValueError, RecursionError):
        return None
    if isinstance(value, dict) and value.get("tools", 0) in (None, []):
        del value["tools"]  # an empty list of tools has no text
    return value


def leaves(df: DataFrame, body: str = "body", out: str = "leaves") -> DataFrame:
    """Add every value of the body with its path; null for what is no JSON object."""
    work = lambda b: (list(_walk(v)) if isinstance(v := _parsed(b), dict) else None,)
    return with_rows(df, {"body": F.col(body)}, work, {out: f"array<{LEAF}>"})


def with_texts(df: DataFrame, texts: str, body: str = "body", out: str = "body") -> DataFrame:
    """The body with ``texts`` (an array of pointer and text) in their places."""

    def put(value, pointer: tuple, new: dict):
        if isinstance(value, dict):
            return {k: put(v, (*pointer, f".{k}"), new) for k, v in value.items()}
        if isinstance(value, list):
            return [put(v, (*pointer, f"[{i}]"), new) for i, v in enumerate(value)]
        return new.get(pointer, value)

    def work(b: str | None, found: list[dict] | None) -> tuple:
        value = _parsed(b)
        if not isinstance(value, dict):
            return (None,)
        return (json.dumps(put(value, (), {tuple(x["pointer"]): x["text"] for x in found or []}), ensure_ascii=False),)

    return with_rows(df, {"body": F.col(body), "texts": F.col(texts)}, work, {out: "string"})


_TEXTS = ["messages [] content", "messages [] content [] text", *[f"{f}{e}" for f in TEXT_FIELDS for e in ("", " []")]]


def is_text(leaf: Column) -> Column:
    """Whether a leaf is text that is masked: a message's content or part, or a text field or list."""
    return (leaf["kind"] == "string") & at(leaf, *_TEXTS)


def reason(found: str = "leaves") -> Column:
    """Why a body is refused; null for one that may pass once its texts are masked."""
    any_ = lambda test: F.exists(found, test)
    part = "messages [] content []"
    allowed = lambda x: is_text(x) | at(x, "model") | (at(x, "keep_alive") & x["value"].rlike(KEEP_ALIVE))
    listed = lambda x: any_of([at(x, p) & x["value"].isin(*v) for p, v in ALLOWED.items()])
    contents = F.size(F.filter(found, lambda x: at(x, "messages [] content")))
    return (
        F.when(F.col(found).isNull(), "body is no object")
        .when(any_(lambda x: at(x, "messages") & ~x["kind"].isin("array", "null")), "messages must be a list")
        .when((contents != F.size(F.filter(found, lambda x: at(x, "messages []")))) | any_(lambda x: at(x, "messages []") & (x["kind"] != "object")), "unsupported message")
        .when(any_(lambda x: at(x, "messages [] content") & ~x["kind"].isin("string", "array")), "unsupported message content")
        .when(any_(lambda x: at(x, part) & ~((x["kind"] == "object") & (x["value"] == '["text", "type"]'))) | any_(lambda x: at(x, f"{part} text") & (x["kind"] != "string")) | any_(lambda x: at(x, f"{part} type") & ~F.coalesce(x["value"] == "text", F.lit(False))), "unsupported message content part")
        .when(any_(lambda x: (at(x, *TEXT_FIELDS) & ~x["kind"].isin("string", "array")) | (at(x, *[f"{f} []" for f in TEXT_FIELDS]) & (x["kind"] != "string"))), "unsupported text field")
        .when(any_(lambda x: F.coalesce(F.try_element_at(x["path"], F.lit(-1)).isin(*[f".{b}" for b in BLOCKED]), F.lit(False))), "unsupported content")
        .when(any_(lambda x: (x["kind"] == "string") & ~(allowed(x) | listed(x))), "unsupported string field")
    )


def any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def mask_bodies(df: DataFrame, request: str, body: str = "body", rules: list[Rule] = RULES, names: bool = True) -> tuple[DataFrame, DataFrame]:
    """The requests with ``reason`` and, where that is null, ``masked`` (the body); and each request's keys for ``deanonymize``."""
    known = leaves(df, body).withColumn("reason", reason())
    field = F.col("x.path")[0]
    order = F.when(field == ".messages", 0).otherwise(F.array_position(F.array(*[F.lit(f".{f}") for f in TEXT_FIELDS]), field)).cast("int")
    rows = known.where("reason is null").select(request, F.posexplode(F.filter("leaves", is_text)).alias("place", "x"))
    texts = rows.select(request, F.struct(order.alias("field"), "place").alias("seq"), F.col("x.pointer").alias("pointer"), F.col("x.value").alias("text"))
    masked, keys = mask.anonymize_requests(texts, request, "seq", "text", rules, names)
    by_request = masked.groupBy(request).agg(F.collect_list(F.struct("pointer", F.col("masked").alias("text"))).alias("texts__"))
    joined = known.drop("leaves").join(by_request, request, "left")
    out = with_texts(joined, "texts__", body, "masked").drop("texts__")
    return out.withColumn("masked", F.when(F.col("reason").isNull(), F.col("masked"))), keys


#: Paths of texts in a response.
ANSWERS = ["message content", "choices [] message content", "choices [] text", "response"]


def restore_bodies(responses: DataFrame, keys: DataFrame, request: str, body: str = "body") -> DataFrame:
    """Responses with the originals in their texts; ``keys`` as from ``mask_bodies``."""
    rows = leaves(responses, body).select(request, F.explode(F.filter("leaves", lambda x: (x["kind"] == "string") & at(x, *ANSWERS, *_TEXTS))).alias("x"))
    back = mask.deanonymize(rows.select(request, F.col("x.pointer").alias("pointer"), F.col("x.value").alias("masked")).join(keys, request))
    texts = back.groupBy(request).agg(F.collect_list(F.struct("pointer", F.col("restored").alias("text"))).alias("texts__"))
    return with_texts(responses.join(texts, request, "left"), "texts__", body, "restored").drop("texts__")


def stream_events(df: DataFrame, body: str = "body") -> DataFrame:
    """Rows ``event_no``, ``event`` for a complete chat answer: its texts, its ends, and its usage if it has one.

    Clients that asked for a stream read texts from ``delta``, so the whole answer is one piece.
    """
    shape = "struct<id:string,created:bigint,model:string,system_fingerprint:string,choices:array<struct<index:int,message:struct<role:string,content:string>,finish_reason:string>>,usage:map<string,bigint>>"
    b = df.withColumn("b__", F.from_json(body, shape))
    index = lambda c, i: F.coalesce(c["index"], i)
    none = F.lit(None).cast("string")
    text = F.transform("b__.choices", lambda c, i: F.struct(index(c, i).alias("index"), F.struct(F.coalesce(c["message"]["role"], F.lit("assistant")).alias("role"), c["message"]["content"].alias("content")).alias("delta"), none.alias("finish_reason")))
    end = F.transform("b__.choices", lambda c, i: F.struct(index(c, i).alias("index"), F.struct(none.alias("role"), none.alias("content")).alias("delta"), F.coalesce(c["finish_reason"], F.lit("stop")).alias("finish_reason")))
    event = lambda choices, usage: F.struct(F.col("b__.id").alias("id"), F.col("b__.created").alias("created"), F.col("b__.model").alias("model"), F.col("b__.system_fingerprint").alias("system_fingerprint"), F.lit("chat.completion.chunk").alias("object"), choices.alias("choices"), usage.alias("usage"))
    no_usage = F.lit(None).cast("map<string,bigint>")
    events = F.array(event(text, no_usage), event(end, no_usage), event(F.slice(end, 1, 0), F.col("b__.usage")))
    kept = F.filter(events, lambda e, i: (i < 2) | F.col("b__.usage").isNotNull())
    rows = b.select(*df.columns, F.posexplode(kept).alias("event_no", "e__"))
    return rows.select(*df.columns, "event_no", F.to_json("e__").alias("event"))


def with_capability(capabilities: Column, name: str = "completion") -> Column:
    """The list with one more capability, once."""
    return F.array_union(F.coalesce(capabilities, F.array().cast("array<string>")), F.array(F.lit(name)))
