"""From texts to resolved entity spans: rules, names, greedy overlap resolution, arbitration.

Patterns run as DataFrame expressions on texts that a rule's gate lets through; where their hits
are follows from the lengths of what stands between them.  Walks, names and the second search need what was found before;
they are a pass over a text's spans in Arrow batches, a slice of rows at a time.  The choice among overlapping candidates is
made for all texts of a slice at once: only groups of three or more are gone through.  A null text has no spans; texts are
gone through whole; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.rows import passed, sliced, strings, with_arrays
from veilspark.functions.spans import gap_pattern, held

from . import swift
from .lexicon import UNIFIED
from .names import discovered, named
from .rules import CHECKS, RULES, WIDE_RULES, Rule, may_match
from .spansets import Disjoint, Found, greedy
from .walks import WALKS, Words

ENTITY = "array<struct<start:bigint,end:bigint,label:string,surface:string,rule:string>>"
#: What is found, by stage: every match of every rule, candidates best first, entities.
STAGES = {
    "matches": "array<struct<start:bigint,end:bigint,label:string,surface:string,priority:int,rule:string>>",
    "candidates": "array<struct<order:int,neg_len:bigint,start:bigint,seq:int,end:bigint,label:string,surface:string,rule:string>>",
    "entities": ENTITY,
}


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def list_of(rows: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    """An Arrow list of structs from lists of tuples."""
    ends = np.cumsum([0] + [len(r) for r in rows])
    columns = list(zip(*[x for r in rows for x in r])) or [()] * kind.value_type.num_fields
    fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
    made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)


def arrow_type(spark_type: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T._parse_datatype_string(spark_type))


def ranked(found: list[tuple]) -> list[tuple]:
    """Matches as candidates, best first: priority, length, start, place in the order of rules."""
    return sorted((-priority, s - e, s, i, e, UNIFIED.get(label, "OTHER"), surface, rule) for i, (s, e, label, surface, priority, rule) in enumerate(found))


#: Texts that a white list may have: it goes to every task.
MOST_ALLOWED = 100_000


def allowed_texts(whitelist: DataFrame | list[str] | None) -> frozenset[str]:
    """The lower-case texts of a white list: a list, or a frame of one column (``standoff.whitelist``)."""
    if isinstance(whitelist, DataFrame):
        whitelist = [r[0] for r in whitelist.where(F.col(whitelist.columns[0]).isNotNull()).limit(MOST_ALLOWED + 1).collect()]
    if whitelist and len(whitelist) > MOST_ALLOWED:
        raise ValueError(f"a white list may have {MOST_ALLOWED} texts")
    return frozenset(x.strip().lower() for x in whitelist or ())


def places(gaps: pa.Array, hits: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every hit, from the lists of what stands before and in each of a text's hits."""
    rows = np.repeat(np.arange(len(hits)), hits.value_lengths().fill_null(0).to_numpy())
    long = pc.utf8_length(hits.flatten()).to_numpy()
    ends = np.cumsum(pc.utf8_length(gaps.flatten()).to_numpy() + long)
    first = np.searchsorted(rows, rows)
    ends -= np.where(first > 0, ends[first - 1], 0) if len(rows) else 0
    return rows, ends - long, ends


def resolved(row: np.ndarray, start: np.ndarray, end: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """Which spans (in the order in which they were found) the greedy choice keeps, by row and start.

    Spans that overlap in a chain are a group; of one or two the best stays, others are gone through.
    """
    width = int(end.max(initial=0)) + 1
    order = np.argsort(row * width + start, kind="stable")
    low, high = (row * width + start)[order], (row * width + end)[order]
    heads = np.flatnonzero(np.concatenate([[True], low[1:] >= np.maximum.accumulate(high)[:-1]])) if len(row) else np.arange(0)
    sizes = np.diff(np.append(heads, len(row)))
    keep = np.zeros(len(row), bool)
    keep[heads[sizes == 1]] = True
    # ranks of those alone that overlap others
    among = np.flatnonzero(np.repeat(sizes > 1, sizes))
    of = order[among]
    rank = np.zeros(len(row), np.int64)
    rank[of[np.lexsort((of, start[of], start[of] - end[of], -priority[of]))]] = np.arange(len(of))
    pair = heads[sizes == 2]
    keep[np.where(rank[order[pair]] < rank[order[pair + 1]], pair, pair + 1) if len(pair) else pair] = True
    for k in np.flatnonzero(sizes > 2).tolist():
        group = range(heads[k], heads[k] + sizes[k])
        best = sorted(group, key=lambda g: rank[order[g]])
        keep[[g for _, _, g in greedy([(low[g], high[g], g) for g in best])]] = True
    return order[keep]


def _looked(text: Column, rules: list[Rule], at: list[int], wanted: Column, gated: bool) -> Column:
    """For a text that is wanted an array of one struct, else an empty one: what each of some rules' patterns match (``hit``), and what stands before (``gap``).

    Most texts are plain and aren't wanted.  One expression for each pattern in the row's own projection makes
    a method too great for the JVM to compile, for them too; inside a lambda they are no code of it.
    """
    none = F.array().cast("array<string>")
    gate = lambda t, r: may_match(r, t) if gated else F.lit(True)
    hits = lambda t: F.struct(t.alias("t"), *[F.when(gate(t, rules[i]), F.regexp_extract_all(t, F.lit(rules[i].pattern), F.lit(0))).otherwise(none).alias(f"hit{i}") for i in at])
    before = lambda x, i: F.when(F.size(x[f"hit{i}"]) > 0, F.regexp_extract_all(x["t"], F.lit(gap_pattern(rules[i].pattern)), F.lit(1))).otherwise(none)
    both = lambda x: F.struct(*[x[f"hit{i}"].alias(f"hit{i}") for i in at], *[before(x, i).alias(f"gap{i}") for i in at])
    texts = F.when(wanted & text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.transform(F.transform(texts, hits), both)


def _stage(df: DataFrame, text: str, rules: list[Rule], names: bool, out: str, gated: bool = True, whitelist: DataFrame | list[str] | None = None, name: str = "") -> DataFrame:
    """Add one of ``STAGES``, as ``name``."""
    allowed = allowed_texts(whitelist)
    name = name or out
    keep = [c for c in df.columns if c.lower() != name.lower()]
    # the text goes to Python once
    own = text in keep
    rows = df if own else df.withColumn("r__text", F.col(text))
    rows = rows.withColumn("r__far", held(F.coalesce(F.col(text).rlike(swift.FAR), F.lit(False))) if gated else F.lit(True))
    finders = [(i, swift.FINDERS[r], r.check) for i, r in enumerate(rules) if r in swift.FINDERS]
    patterns = [i for i, r in enumerate(rules) if r.pattern]
    # rules that aren't tried many texts at a time look at every text, the others at those alone that aren't plain
    every, some = ([i for i in patterns if (rules[i] in swift.FINDERS) == far] for far in (False, True))
    shown = [F.col(f"`{c}`") for c in [*keep, *([] if own else ["r__text"]), "r__far"]]
    looked = {"r__all": every, "r__some": some}
    rows = rows.select(*shown, *[held(_looked(F.col(text), rules, at, F.col("r__far") if n == "r__some" else F.lit(True), gated)).alias(n) for n, at in looked.items() if at])
    kind, last = arrow_type(STAGES[out]), len(keep)
    at_text, at_far = keep.index(text) if own else last, last + (not own)
    walks = [(i, WALKS[r.walk], frozenset(r.words) if gated else None) for i, r in enumerate(rules) if r.walk]
    priority = np.array([r.priority for r in rules], np.int64)
    labels, rule_names = pa.array([UNIFIED.get(r.label, "OTHER") for r in rules], pa.string()), pa.array([r.name for r in rules], pa.string())

    other = [w for w in walks if rules[w[0]] not in swift.FINDERS]

    def walked(texts: list[str], far: list[bool]) -> tuple[list[Words | None], list[tuple[int, int, int, int]]]:
        """The words of each text that needs them, and row, rule, start and end of what walks find that a text's words let through."""
        words, found = [Words(t) if t and (names or (walks if f else other)) else None for t, f in zip(texts, far)], []
        for k, x in enumerate(words):
            if x is not None:
                for i, walk, known in walks if far[k] else other:
                    if not known or not known.isdisjoint(x.low):
                        found += [(k, i, s, e) for s, e in walk(x)]
        return words, found

    def spans_of(batch: pa.RecordBatch, texts: list[str], far: list[bool], more: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
        """Row, rule, start and end of every match, in the order of rows, rules and of the text."""
        parts = [np.array(more, np.int64).reshape(-1, 4).T, swift.found([None if f else t for t, f in zip(texts, far)], finders)]
        for n, at in looked.items():
            if not at or not len(flat := (column := batch.column(n)).flatten()):
                continue
            of = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
            for i in at:
                hits = flat.field(f"hit{i}")
                row, start, end = places(flat.field(f"gap{i}"), hits)
                if len(row):
                    check = CHECKS.get(rules[i].check)
                    good = np.array([bool(h.strip(" ")) and (check is None or check(h)) for h in hits.flatten().to_pylist()])
                    parts.append(np.stack([of[row], np.full(len(row), i), start, end])[:, good])
        return list(swift.ordered(np.concatenate(parts, axis=1)))

    def found_in(t: str, words: Words | None, spans: list[tuple[int, int, int]]) -> list[tuple]:
        found = Found()
        for i, s, e in spans:
            found.add(s, e, rules[i].label, t[s:e], rules[i].priority, rules[i].name)
        if names:
            named(found, words or Words(t), allowed)
            discovered(found, t)
        if out == "matches":
            return found.all
        best = ranked(found.all)
        return best if out == "candidates" else greedy([(s, e, label, surface, rule) for _, _, s, _, e, label, surface, rule in best])

    def made(batch: pa.RecordBatch, surfaced: bool) -> pa.Array:
        texts = strings(batch.column(at_text))
        far = batch.column(at_far).to_numpy(zero_copy_only=False).tolist()
        words, more = walked(texts, far)
        row, rule, start, end = spans_of(batch, texts, far, more)
        if out == "entities" and not names:
            kept = resolved(row, start, end, priority[rule])
            row, rule, start, end = row[kept], rule[kept], start[kept], end[kept]
            surfaces = pa.array([texts[k][s:e] for k, s, e in zip(row.tolist(), start.tolist(), end.tolist())], pa.string()) if surfaced else pa.nulls(len(row), pa.string())
            fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
            spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end), labels.take(pa.array(rule)), surfaces, rule_names.take(pa.array(rule))], fields=fields)
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32()), spans)
        ends = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        every = list(zip(rule.tolist(), start.tolist(), end.tolist()))
        return list_of([found_in(t, x, every[a:b]) if a < b or names else [] for t, x, a, b in zip(texts, words, ends, ends[1:])], kind)

    def run(batches: Iterator[pa.RecordBatch], surfaced: bool = True) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], made(batch, surfaced)], names=[*keep, name])

    schema = T.StructType([*rows.schema.fields[:last], T.StructField(name, T._parse_datatype_string(STAGES[out]))])
    return passed(rows, run, schema, lambda batches: run(batches, False))


def matches(df: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """Add ``matches``: every match of every rule, in the order of the rules and of the text."""
    return _stage(df, text, rules, False, "matches")


def candidates(df: DataFrame, text: str = "text", rules: list[Rule] = RULES, names: bool = False, gated: bool = True, whitelist: DataFrame | list[str] | None = None) -> DataFrame:
    """Add ``candidates``, best first; with ``names`` those of ``names`` too, but none that the white list has."""
    return _stage(df, text, rules, names, "candidates", gated, whitelist)


def detect(df: DataFrame, text: str = "text", rules: list[Rule] = RULES, names: bool = False, gated: bool = True, whitelist: DataFrame | list[str] | None = None, out: str = "entities") -> DataFrame:
    """Add ``out``: resolved spans by start; with ``names`` also by line, signature and second search.

    Greedy: a candidate stays if it overlaps none that stayed.  Names that ``whitelist`` has are none.
    """
    return _stage(df, text, rules, names, "entities", gated, whitelist, out)


def arbitrate(df: DataFrame, rule_spans: Column | str, model_spans: Column | str, more: Column | str | None = None, out: str = "entities", strong: tuple[str, ...] = ("DATE", "TIME", "PHONE", "EMAIL", "URL", "ID")) -> DataFrame:
    """Add ``out``: rule spans against model spans, in order of start: free ones are added, strong ones push overlapping spans out.

    Then spans of a third detector (``more``) where nothing is yet; accepted ones block later ones.
    Spans are (start, end, label, ...).
    """

    key = lambda s: (s[0], s[1], s[2] or "")

    def chosen(rule: list[tuple], model: list[tuple], third: list[tuple]) -> list[tuple]:
        done, rule = sorted(model, key=key), sorted(rule, key=key)
        if not done and all(a[1] <= b[0] for a, b in zip(rule, rule[1:])) and all(s[0] < s[1] for s in rule):
            done, rule = rule, []
        taken = Disjoint([(s[0], s[1]) for s in done]) if rule or third else None
        for s in rule:
            at = taken.clashing(s[0], s[1])
            clash = done[at]
            if clash:
                if s[2] not in strong or (s[2] == "PHONE" and any(m[2] == "ID" for m in clash)):
                    continue
                del done[at], taken.starts[at], taken.ends[at]
            done.insert(at.start, s)
            taken.add(s[0], s[1])
        for s in sorted(third, key=key):
            at = taken.clashing(s[0], s[1])
            if not done[at]:
                done.insert(at.start, s)
                taken.add(s[0], s[1])
        return done

    def work(*columns: pa.Array) -> tuple[pa.Array]:
        lists = []
        for spans in columns:
            ends = np.cumsum([0, *spans.value_lengths().fill_null(0).to_pylist()]).tolist()
            flat = spans.flatten()
            every = list(zip(*[flat.field(n).to_pylist() for n in ("start", "end", "label")]))
            lists.append([every[a:b] for a, b in zip(ends, ends[1:])])
        made = [chosen(*x, *[[]] * (3 - len(x))) for x in zip(*lists)]
        return (list_of(made, arrow),)

    kind = "array<struct<start:bigint,end:bigint,label:string>>"
    arrow = arrow_type(kind)
    slim = lambda c: c if isinstance(c, str) else F.transform(c, lambda s: F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"), s["label"].alias("label")))
    inputs = {"rule": slim(rule_spans), "model": slim(model_spans)} | ({} if more is None else {"third": slim(more)})
    return with_arrays(df, inputs, work, {out: kind})


def merge_adjacent(tokens: Column) -> Column:
    """Join neighbours of one label that touch or are one apart; the score is the highest."""
    kind = "array<struct<start:bigint,end:bigint,label:string,score:double>>"

    def step(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["label"] == t["label"]) & (t["start"] <= F.try_element_at(done, F.lit(-1))["end"] + 1)
        merged = F.struct(last["start"].alias("start"), F.greatest(last["end"], t["end"]).alias("end"), last["label"].alias("label"), F.greatest(last["score"], t["score"]).alias("score"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merged))).otherwise(F.concat(done, F.array(t)))

    return F.aggregate(F.array_sort(tokens), F.array().cast(kind), step)


def exploded(df: DataFrame, key: str = "doc_id", spans: str = "entities") -> DataFrame:
    """One row for each span: key, span_start, span_end, label, surface, rule."""
    rows = df.select(key, F.explode(spans).alias("s"))
    return rows.select(key, F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "s.label", "s.surface", "s.rule")


#: Ways of detecting, by name: each adds ``entities``.
SYSTEMS = {
    "rules": lambda df, text="text": detect(df, text),
    "rules+names": lambda df, text="text": detect(df, text, names=True),
    "rules+wide": lambda df, text="text": detect(df, text, RULES + WIDE_RULES),
}


def combined(df: DataFrame, model: str, more: str | None = None, text: str = "text", names: bool = True) -> DataFrame:
    """Add ``entities``: rule spans against those of a model (column ``model``), gaps filled from a third detector (``more``)."""
    found = detect(df, text, names=names)
    return arbitrate(found, F.col("entities"), F.col(model), F.col(more) if more else None)
