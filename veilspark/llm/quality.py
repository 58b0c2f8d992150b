"""Quality rules as a short-circuit cascade, in DataFrame expressions.

Every rule is run alone on a sample of about ``SAMPLE_DOCS`` documents: its least time of
``RUNS`` beyond that of reading the sample is its cost, its share of rejections its
selectivity.  Rules are tried in the order of rejections per cost.  A rule owns the
values that it needs; they are worked out when it is its turn, and only for rows that no
rule before it has rejected.  The order decides how much work is done and which rule is
named; a document is kept if no rule rejects it, whatever the order and the sample.

With ``counts`` (as in the query) the counts that every row must have are worked out for
every row, and the cascade saves the rest; without (as in the pipeline) it saves all.

Null texts count as empty.  Rows are independent, so repeated rows are judged alike and
nothing has ties but rules of one rate, which go by cost, then name.  Very long texts are
judged whole.  A column named like one that is added is replaced; others stay, whatever
their names.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import held

from .common import columns_but, discard, materialize

SAMPLE_DOCS, RUNS = 1000, 2
#: Seconds below which a cost isn't told from none.
LEAST_COST = 0.02

# What separates words, and the characters that count as symbols.
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Name and condition that rejects, over ``VALUES`` in braces.
RULES: dict[str, str] = {
    "few_words": "{n_words} < 50",
    "repeated_words": "100 * {n_repeat_words} > 50 * {n_words}",
    "symbols": "10 * {n_symbols} > {n_words}",
    "repeated_lines": "2 * {n_dup_lines} > size({lines})",
    "upper_case": "3 * {n_upper} > {word_chars}",
    "exclamations": "2 * {n_marks} > {n_words}",
    "word_length": "{word_chars} < 2 * {n_words} or {word_chars} > 16 * {n_words}",
}
BASE = ("few_words", "repeated_words")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _windows(c: dict[str, Column]) -> Column:
    word = lambda i: F.get(c["words"], i)
    return F.when(F.size(c["words"]) >= 3, F.transform(F.sequence(F.lit(0), F.size(c["words"]) - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))


def _again(c: dict[str, Column]) -> Column:
    """Places of windows that occur again: in the order of their hashes equal ones are neighbours."""
    same = lambda s, k: F.coalesce(F.get(c["sorted"], k)["h"] == s["h"], F.lit(False))
    return F.array_sort(F.transform(F.filter(c["sorted"], lambda s, k: same(s, k - 1) | same(s, k + 1)), lambda s: s["i"]))


def _cover(c: dict[str, Column]) -> Column:
    """Words under the windows that occur again."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + (i + 3 - F.greatest(i, a["end"]))).alias("n"))
    return F.coalesce(F.aggregate(c["again"], zero, step, lambda a: a["n"]), F.lit(0).cast("long"))


def _without(c: dict[str, Column], chars: str) -> Column:
    return F.length(F.translate(c["text"], chars, ""))


#: Name: what it needs, and its expression over the columns of those.
VALUES: dict[str, tuple[tuple[str, ...], Callable[[dict[str, Column]], Column]]] = {
    "words": (("text",), lambda c: F.array_remove(F.split(c["text"], BLANK, -1), "")),
    "lines": (("text",), lambda c: F.filter(F.split(c["text"], "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)),
    "n_words": (("words",), lambda c: F.size(c["words"]).cast("long")),
    "word_chars": (("text",), lambda c: _without(c, BLANKS).cast("long")),
    "n_symbols": (("text",), lambda c: (F.length(c["text"]) - _without(c, SYMBOLS)).cast("long")),
    "n_dup_lines": (("lines",), lambda c: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long")),
    "n_upper": (("text",), lambda c: F.length(c["text"]) - F.length(F.regexp_replace(c["text"], r"\p{Lu}", ""))),
    "n_marks": (("text",), lambda c: F.length(c["text"]) - _without(c, "!")),
    "windows": (("words",), _windows),
    "sorted": (("windows",), lambda c: F.when(F.size(c["windows"]) > F.size(F.array_distinct(c["windows"])), F.array_sort(F.transform(c["windows"], lambda h, i: F.struct(h.alias("h"), i.alias("i")))))),
    "again": (("sorted",), lambda c: F.when(c["sorted"].isNotNull(), _again(c))),
    "n_repeat_words": (("again",), _cover),
}


class Staged:
    """A frame to which values are added when they are needed, under names that clash with no column."""

    def __init__(self, df: DataFrame, text: str):
        self.prefix = "q_"
        while any(c.lower().startswith(self.prefix) for c in df.columns):
            self.prefix = f"_{self.prefix}"
        self.df = df.withColumn(self.name("text"), F.coalesce(F.col(text), F.lit("")))
        self.have = {"text"}

    def name(self, value: str) -> str:
        return f"{self.prefix}{value}"

    def need(self, value: str, alive: Column | None = None) -> None:
        """Add a value and what it needs; null for rows that aren't ``alive``."""
        if value in self.have:
            return
        needs, make = VALUES[value]
        for n in needs:
            self.need(n, alive)
        made = make({n: F.col(self.name(n)) for n in needs})
        self.df = self.df.withColumn(self.name(value), held(made if alive is None else F.when(alive, made)))
        self.have.add(value)

    def condition(self, rule: str, alive: Column | None = None) -> Column:
        for v in VALUES:
            if f"{{{v}}}" in rule:
                self.need(v, alive)
        return F.expr(rule.format(**{v: f"`{self.name(v)}`" for v in VALUES}))


def measure(docs: DataFrame, rules: dict[str, str], text: str = "text", sample_docs: int = SAMPLE_DOCS, seed: int = 7) -> dict[str, tuple[float, float]]:
    """Cost in seconds and share of rejections of each rule on a sample."""
    n = docs.count()
    if not n:
        return {r: (1.0, 0.0) for r in rules}
    sample = docs.select(F.col(text).alias("text"))
    sample = sample.sample(fraction=min(1.0, sample_docs / n), seed=seed) if n > sample_docs else sample
    sample = materialize(sample.repartition(1), "quality-sample")

    def timed(rule: str | None) -> tuple[float, float]:
        staged, took, share = Staged(sample, "text"), [], 0.0
        condition = F.length(staged.name("text")) < 0 if rule is None else staged.condition(rule)
        query = staged.df.agg(F.avg(condition.cast("double")))
        for _ in range(RUNS):
            began = time.perf_counter()
            share = query.first()[0] or 0.0
            took.append(time.perf_counter() - began)
        return min(took), share

    timed(None)
    idle = timed(None)[0]
    found = {r: timed(c) for r, c in rules.items()}
    discard(sample)
    # to the next power of two: timings of one rule vary
    return {r: (LEAST_COST * 2 ** max(0, round(math.log2(max(t - idle, LEAST_COST) / LEAST_COST))), s) for r, (t, s) in found.items()}


def cascade(measured: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejections per cost, best first; ties by cost, then name."""
    return sorted(measured, key=lambda r: (-measured[r][1] / measured[r][0], measured[r][0], r))


def judge(docs: DataFrame, text: str = "text", rules: dict[str, str] | None = None, order: list[str] | None = None, counts: bool = True) -> DataFrame:
    """Add ``rejected_by`` (the first rule that rejects, else null) and ``kept``; with ``counts`` also the counts and ``base_failed``."""
    rules = rules or RULES
    order = order or cascade(measure(docs, rules, text))
    made = ["rejected_by", "kept", *([*COUNTS, "base_failed"] if counts else [])]
    keep = columns_but(docs, *made)
    source = docs if text in keep else docs.withColumnRenamed(text, "text")
    staged = Staged(source, text if text in keep else "text")
    if counts:
        for c in COUNTS:
            staged.need(c)
    first = staged.name("first")
    staged.df = staged.df.withColumn(first, F.lit(None).cast("string"))
    for r in order:
        condition = staged.condition(rules[r], F.col(first).isNull())
        staged.df = staged.df.withColumn(first, held(F.coalesce(F.col(first), F.when(condition, r))))
    out = {"rejected_by": F.col(first), "kept": F.col(first).isNull()}
    if counts:
        failed = [staged.condition(rules[r]) for r in BASE if r in rules]
        out |= {c: F.col(staged.name(c)) for c in COUNTS} | {"base_failed": F.coalesce(failed[0] | failed[1] if len(failed) > 1 else failed[0], F.lit(False)) if failed else F.lit(False)}
    return staged.df.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(k) for k, v in out.items()])
