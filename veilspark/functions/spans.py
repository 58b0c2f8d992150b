"""Regular-expression matches with code-point offsets, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 128
SPAN = "struct<start:bigint,end:bigint,surface:string>"


def held(value: Column) -> Column:
    """``value``, computed where it is written.

    Catalyst puts a column's expression in the place of its name when it merges
    projections or moves a filter down; inside a lambda it would then be computed for
    every element.  It leaves expressions alone that aren't deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _running(pairs: Column) -> Column:
    """Spans from (gap, match) pairs: two folds, so that long arrays are not copied for each element."""
    first = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), F.lit("").alias("surface"))

    def step(done: Column, pair: Column) -> Column:
        start = F.element_at(done, -1)["end"] + F.length(pair["gap"])
        return F.concat(done, F.array(F.struct(start.alias("start"), (start + F.length(pair["hit"])).alias("end"), pair["hit"].alias("surface"))))

    def chunk(done: Column, part: Column) -> Column:
        return F.concat(done, F.array(F.aggregate(part, F.array(F.element_at(F.element_at(done, -1), -1)), step)))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)))
    return F.flatten(F.transform(F.aggregate(parts, F.array(F.array(first)), chunk), lambda x: F.slice(x, F.lit(2), F.lit(CHUNK))))


def gap_pattern(pattern: str, tail: bool = False) -> str:
    """A pattern whose first group is what stands before each match of ``pattern``; with ``tail`` also what stands behind the last.

    Spark compiles the pattern of ``split`` anew for each row, that of ``regexp_extract_all`` once.
    """
    end = r"|\z" if tail else ""
    return rf"\G((?s:.*?))(?:{pattern}{end})"


def gaps(text: Column, pattern: str, hits: Column) -> Column:
    """What ``split`` without a limit gives, for a text and the pattern's matches in it (none is empty)."""
    return F.slice(F.regexp_extract_all(text, F.lit(gap_pattern(pattern, True)), F.lit(1)), F.lit(1), F.size(hits) + 1)


def with_spans(df: DataFrame, text: str, patterns: dict[str, str], gates: dict[str, Column] | None = None) -> DataFrame:
    """Add, for each name, the array of (start, end, surface) of a pattern's leftmost non-overlapping matches.

    ``text`` must not be null.  A match must not be empty.  Texts without a match are
    gone through once; the others a second time, for the gaps between matches.  Texts
    for which a pattern's gate is false aren't gone through for it.
    """
    gates = gates or {}
    found = {n: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for n, p in patterns.items()}
    hits = df.withColumns({f"{n}__hits": F.when(gates[n], x).otherwise(F.array().cast("array<string>")) if n in gates else x for n, x in found.items()})
    pairs = {}
    for n, p in patterns.items():
        zipped = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(gap_pattern(p)), F.lit(1)).alias("gap"), F.col(f"{n}__hits").alias("hit"))
        pairs[f"{n}__pairs"] = held(F.when(F.size(f"{n}__hits") > 0, zipped))
    zipped = hits.withColumns(pairs)
    spans = {}
    for n in patterns:
        spans[n] = F.coalesce(F.when(F.size(f"{n}__hits") > 0, _running(F.col(f"{n}__pairs"))), F.array().cast(f"array<{SPAN}>"))
    return zipped.withColumns(spans).drop(*pairs, *[f"{n}__hits" for n in patterns])
