"""Spans that carry a model's score: the best of equal ones, noise, limited labels, the longest from the left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import overlaps
from .lexicon import CORPUS_LABELS

THRESHOLD = 0.1
# What a baseline of few classes calls them.
LIMITED = {"PERSON": "NAME", "EMAIL_ADDRESS": "EMAIL", "LOCATION": "LOCATION"}


def unified(label: Column) -> Column:
    """The unified label of an annotated or predicted one: without its position in a span (B-, I-), ANON as PHI, OTHER by default."""
    base = F.element_at(F.split(label, "-"), -1)
    return F.when(base == "ANON", "PHI").otherwise(F.coalesce(F.create_map(*[F.lit(x) for kv in CORPUS_LABELS.items() for x in kv])[base], F.lit("OTHER")))


def best(spans: DataFrame, keys: list[str], score: str = "score", order: str = "seq") -> DataFrame:
    """Of spans with equal keys the one with the highest score, the first of equal ones."""
    rest = [c for c in spans.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(score, -F.col(order))).alias("b__")
    return spans.groupBy(*keys).agg(top).select(*keys, "b__.*")


def is_noise(surface: Column, score: Column, threshold: float = THRESHOLD, whitelist: list[str] = ()) -> Column:
    """Low scores, blanks, single characters, numbers of under five digits, listed words."""
    t = F.trim(F.regexp_replace(surface, r"(?U)^\s+|\s+$", ""))
    out = (score < threshold) | (F.length(t) < 2) | (t.rlike(r"(?U)^\d+$") & (F.length(t) < 5))
    return out | F.lower(t).isin(*whitelist) if whitelist else out


def limited(spans: Column, labels: dict[str, str] = LIMITED) -> Column:
    """Spans of the labels that are known, under their unified names; others go."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    good = F.filter(spans, lambda s: names[s["label"]].isNotNull() & (s["start"] < s["end"]))
    return F.transform(good, lambda s: s.withField("label", names[s["label"]]))


def longest_from_left(spans: Column) -> Column:
    """Greedy by start, the longest first of those that start alike: a span stays if it begins where the last one that stayed has ended."""
    slim = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("neg"), s["end"].alias("end"), s["label"].alias("label"))))
    kind = "array<struct<start:bigint,end:bigint,label:string>>"
    one = lambda s: F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    free = lambda done, s: F.coalesce(~overlaps(F.try_element_at(done, F.lit(-1)), s), F.lit(True))
    return F.aggregate(slim, F.array().cast(kind), lambda done, s: F.when(free(done, s), F.concat(done, one(s))).otherwise(done))
