"""Scores of predicted against true spans, worked out in each document's row.

A frame has ``doc_id``, ``text``, ``gold`` and ``pred`` (arrays of spans by start) and,
where words count, ``words``.  Spans of a document meet in its row, so no span is
exploded, joined or sorted by document: what overlaps what is found once for a row, by
bisection (``with_touch``); every figure is an expression of the arrays, then
one sum over documents, of which tasks pass on a row or a row for each label.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.rows import over, sliced, strings, with_arrays, with_rows
from veilspark.functions.spans import held

# Labels of direct identifiers, and of the wide definition of a leak.
DIRECT = ("NAME", "ID", "PHONE", "EMAIL")
WIDE = ("EMAIL", "FAMILY", "NAME", "ID", "PHONE", "URL", "PROFESSIONAL")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from ``tp``, ``fp``, ``fn``; 0 where a denominator is."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return df.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6)})


def count(array: Column) -> Column:
    return F.size(array).cast("long")


def total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0).cast("long"))


# -- of one row


def touched(spans: list[dict], others: list[dict]) -> list[tuple[int, int]]:
    """For each span where the others (by start) begin and end among which those are that overlap it; the first of them does, (-1, -1) if none."""
    starts, ends = [o["start"] for o in others], list(accumulate((o["end"] for o in others), max))
    out = []
    for s in spans:
        low, high = bisect_right(ends, s["start"]), bisect_left(starts, s["end"])
        out.append((low, high) if low < high else (-1, -1))
    return out


class Spans:
    """Spans of many rows, by start in each: row, start and end, and where each row's begin."""

    def __init__(self, spans: pa.Array):
        """``spans``: lists of structs with ``start`` and ``end``."""
        self.sizes = spans.value_lengths().fill_null(0).to_numpy()
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.row = np.repeat(np.arange(len(spans)), self.sizes)
        self.flat = spans.flatten()
        self.start, self.end = (self.flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))

    @classmethod
    def of(cls, sizes: np.ndarray, start: np.ndarray, end: np.ndarray) -> Spans:
        """Of so many in each row, by their places."""
        made = cls.__new__(cls)
        made.sizes, made.start, made.end = sizes, start, end
        made.first, made.row = np.concatenate([[0], np.cumsum(sizes)]), np.repeat(np.arange(len(sizes)), sizes)
        return made


def touched_rows(a: Spans, b: Spans) -> tuple[np.ndarray, np.ndarray]:
    """``touched`` of every row at once: rows lie behind each other on one line, so that two bisections do for all."""
    width = int(max(a.end.max(initial=0), b.end.max(initial=0))) + 1
    starts, ends = b.row * width + b.start, np.maximum.accumulate(b.row * width + b.end)
    low = np.maximum(np.searchsorted(ends, a.row * width + a.start, "right"), b.first[a.row])
    high = np.minimum(np.searchsorted(starts, a.row * width + a.end, "left"), b.first[a.row + 1])
    hits = low < high
    return np.where(hits, low - b.first[a.row], -1), np.where(hits, high - b.first[a.row], -1)


def covered(words: Spans, spans: Spans) -> np.ndarray:
    """Whether spans (in any order) overlap each of the words, which don't overlap each other: each span's first and last word are found by bisection."""
    width = int(max(words.end.max(initial=0), spans.end.max(initial=0))) + 1
    low = np.maximum(np.searchsorted(words.row * width + words.end, spans.row * width + spans.start, "right"), words.first[spans.row])
    high = np.minimum(np.searchsorted(words.row * width + words.start, spans.row * width + spans.end, "left"), words.first[spans.row + 1])
    hits, many = low < high, len(words.row) + 1
    return np.cumsum(np.bincount(low[hits], minlength=many) - np.bincount(high[hits], minlength=many))[:-1] > 0


TOUCH = pa.struct([("first", pa.int32()), ("stop", pa.int32())])


def with_touch(df: DataFrame, **pairs: tuple[str, str]) -> DataFrame:
    """Add, for each pair of arrays of spans, an array of (first, stop): where the second has what overlaps each of the first."""
    columns = sorted({c for pair in pairs.values() for c in pair})
    at = [(columns.index(a), columns.index(b)) for a, b in pairs.values()]

    def work(*arrays: pa.Array) -> tuple[pa.Array, ...]:
        spans, made = [Spans(x) for x in arrays], []
        for a, b in at:
            both = [pa.array(x, pa.int32()) for x in touched_rows(spans[a], spans[b])]
            made.append(pa.ListArray.from_arrays(pa.array(spans[a].first, pa.int32()), pa.StructArray.from_arrays(both, fields=list(TOUCH))))
        return tuple(made)

    return with_arrays(df, {c: c for c in columns}, work, {n: "array<struct<first:int,stop:int>>" for n in pairs})


def hit(touch: str, i: Column) -> Column:
    """Whether something overlaps the i-th span."""
    return F.get(touch, i)["first"] >= 0


def lost(gold: str = "gold", touch: str = "t_gold") -> Column:
    """True spans that no predicted one overlaps."""
    return F.filter(gold, lambda g, i: ~hit(touch, i))


WORDS = "array<struct<start:bigint,end:bigint,surface:string,g:boolean,p:boolean>>"
#: White space by code point; none is beyond the last.
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
_SPACE_BYTES = _SPACE[:256].tobytes()


def words_of(texts: list[str]) -> Spans:
    """Runs without white space of many texts, which lie behind each other with a line's end between them."""
    joined = "\n".join(["", *texts, ""])
    try:
        space = np.frombuffer(joined.encode("latin-1").translate(_SPACE_BYTES), np.bool_)
    except UnicodeEncodeError:
        space = _SPACE[np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 0x3001)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    base = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    start, end = edges[0::2], edges[1::2]
    row = np.searchsorted(base, start, "right") - 1
    return Spans.of(np.bincount(row, minlength=len(texts)), start - base[row], end - base[row])


def flagged_words(texts: pa.Array, gold: pa.Array, pred: pa.Array) -> tuple[list[str], Spans, np.ndarray, np.ndarray]:
    """Texts, their words, and whether true and predicted spans (in any order) overlap each."""
    texts = strings(texts)
    words = words_of(texts)
    return texts, words, *(covered(words, Spans(x)) for x in (gold, pred))


def with_words(df: DataFrame) -> DataFrame:
    """Add ``words``: runs without white space, and whether true and predicted spans overlap them."""

    def work(texts: pa.Array, gold: pa.Array, pred: pa.Array) -> tuple[pa.Array, ...]:
        texts, words, g, p = flagged_words(texts, gold, pred)
        surfaces = [texts[k][s:e] for k, s, e in zip(words.row.tolist(), words.start.tolist(), words.end.tolist())]
        fields = [pa.array(words.start), pa.array(words.end), pa.array(surfaces, pa.string()), pa.array(g), pa.array(p)]
        return (pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "end", "surface", "g", "p"])),)

    return with_arrays(df, {"text": "text", "gold": "gold", "pred": "pred"}, work, {"words": WORDS})


def word_counts(df: DataFrame) -> DataFrame:
    """A row for each task: words by whether true and predicted spans overlap them (``tp``, ``fp``, ``fn``, ``tn``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(4, np.int64)
        for batch in sliced(batches):
            _, _, g, p = flagged_words(*batch.columns)
            sums += np.bincount(2 * g + p, minlength=4)
        yield pa.RecordBatch.from_arrays([pa.array([n]) for n in sums[[3, 1, 2, 0]].tolist()], names=["tp", "fp", "fn", "tn"])

    return over(df, ["text", "gold", "pred"], run, "tp long, fp long, fn long, tn long", surfaces=False)


def greedy(gold: list[dict], pred: list[dict], exact: bool) -> int:
    """True spans in order, each taking the first free predicted one that overlaps (or equals) it: how many find one."""
    if exact:
        return (Counter((g["start"], g["end"]) for g in gold) & Counter((p["start"], p["end"]) for p in pred)).total()
    free, taken = list(range(len(pred) + 1)), 0

    def next_free(k: int) -> int:
        while free[k] != k:
            free[k] = free[free[k]]
            k = free[k]
        return k

    for g, (first, stop) in zip(gold, touched(gold, pred)):
        k = next_free(first) if first >= 0 else stop
        while k < stop and pred[k]["end"] <= g["start"]:
            k = next_free(k + 1)
        if k < stop:
            free[k], taken = k + 1, taken + 1
    return taken


# -- over all documents


def word_scores(df: DataFrame) -> DataFrame:
    return prf(word_counts(df).agg(*[total(F.col(c)).alias(c) for c in ("tp", "fp", "fn")]))


def compact(*columns: np.ndarray) -> np.ndarray:
    """One number for each combination of the columns' values (none negative)."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        out = np.unique(out * (int(c.max(initial=0)) + 1) + c, return_inverse=True)[1]
    return out


def per_class(df: DataFrame) -> DataFrame:
    """Strict scores for each label: spans and labels must be equal, each predicted span counts for one true one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in sliced(batches):
            g, p = map(Spans, batch.columns)
            both = pa.concat_arrays([x.flat.field("label").cast(pa.string()) for x in (g, p)]).dictionary_encode("encode")
            label = both.indices.to_numpy()
            place = compact(label, *[np.concatenate([getattr(g, n), getattr(p, n)]) for n in ("row", "start", "end")])
            # of each place, how often either has it, and its label
            of = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
            of[place] = label
            n_g, n_p = (np.bincount(x, minlength=len(of)) for x in (place[: len(g.row)], place[len(g.row) :]))
            parts = [np.bincount(of, x, len(both.dictionary)).astype(np.int64).tolist() for x in (np.minimum(n_g, n_p), n_p, n_g)]
            for name, *counts in zip(both.dictionary.to_pylist(), *parts):
                sums[name] = [a + b for a, b in zip(sums.get(name, (0, 0, 0)), counts)]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        rows = [(label, *n) for label, n in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["label", "tp", "p", "g"])

    each = over(df, ["gold", "pred"], run, "label string, tp long, p long, g long", surfaces=False)
    sums = each.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("p").alias("p"), F.sum("g").alias("support"))
    return prf(sums.select("label", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), "support"))


def span_scores(df: DataFrame, exact: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(3, np.int64)
        for batch in sliced(batches):
            g, p = map(Spans, batch.columns)
            if exact:
                place = compact(*[np.concatenate([getattr(g, n), getattr(p, n)]) for n in ("row", "start", "end")])
                many = int(place.max(initial=-1)) + 1
                hits = np.minimum(*(np.bincount(x, minlength=many) for x in (place[: len(g.row)], place[len(g.row) :]))).sum()
            else:
                hits = greedy_rows(g, p)
            sums += (hits, len(p.row), len(g.row))
        yield pa.RecordBatch.from_arrays([pa.array([n]) for n in sums.tolist()], names=["tp", "p", "g"])

    m = over(df, ["gold", "pred"], run, "tp long, p long, g long", surfaces=False)
    return prf(m.agg(total(F.col("tp")).alias("tp"), total(F.col("p") - F.col("tp")).alias("fp"), total(F.col("g") - F.col("tp")).alias("fn")))


def greedy_rows(g: Spans, p: Spans) -> int:
    """``greedy`` of every row: rows in which every touch is of one span with one are counted at once, others gone through."""
    first, stop = touched_rows(g, p)
    back, back_stop = touched_rows(p, g)
    hard = np.union1d(g.row[stop - first > 1], p.row[back_stop - back > 1])
    taken = int(((first >= 0) & ~np.isin(g.row, hard)).sum())
    spans = lambda x, r: [{"start": s, "end": e} for s, e in zip(x.start[x.first[r] : x.first[r + 1]].tolist(), x.end[x.first[r] : x.first[r + 1]].tolist())]
    return taken + sum(greedy(spans(g, r), spans(p, r), False) for r in hard.tolist())


def leaks(labels: tuple[str, ...] | None) -> Column:
    """1 if a true span (with one of these labels) is lost, else 0."""
    which = lost() if labels is None else F.filter(lost(), lambda g: g["label"].isin(*labels))
    return (F.size(which) > 0).cast("long")


def leakage(df: DataFrame) -> DataFrame:
    """Documents, and those with a lost span: of a direct class, of the wide definition, of any."""
    kinds = {"direct": DIRECT, "wide": WIDE, "any": None}
    each = with_touch(df, t_gold=("gold", "pred")).select(*[leaks(x).alias(n) for n, x in kinds.items()])
    return each.agg(F.count("*").alias("docs"), *[total(F.col(n)).alias(n) for n in kinds])


def leak_examples(df: DataFrame, n: int = 10, labels: tuple[str, ...] = WIDE) -> DataFrame:
    """The first ``n`` documents by identifier with lost spans of these labels, and what was lost."""
    which = F.filter(lost(), lambda g: g["label"].isin(*labels))
    each = with_touch(df, t_gold=("gold", "pred")).select("doc_id", held(F.transform(which, lambda g: F.concat_ws(":", g["label"], g["surface"]))).alias("lost"))
    return each.where("size(lost) > 0").orderBy("doc_id").limit(n)


def best_by(scores: DataFrame, score: str = "f1", name: str = "system") -> DataFrame:
    """The scores of all systems (a row each), with ``best`` for the one with the highest (ties: the first by name)."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(score), name)
    return scores.withColumn("best", F.row_number().over(order) == 1)


def unmapped(df: DataFrame, mapping: dict[str, str], spans: str = "gold") -> DataFrame:
    """Labels of spans that a mapping lacks, and how many spans have them."""
    seen = df.select(F.explode(spans).alias("s")).groupBy("s.label").agg(F.count("*").alias("spans"))
    return seen.where(~F.col("label").isin(*mapping))


def leak_attribution(df: DataFrame) -> DataFrame:
    """Documents by what leaks of the wide definition: one class alone, or several; ``several`` comes first, documents without a leak count for the rate only. Counted in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in sliced(batches):
            g, p = map(Spans, batch.columns)
            label = g.flat.field("label").cast(pa.string()).dictionary_encode()
            wide = np.array([x in WIDE for x in label.dictionary.to_pylist()] + [False])
            code = label.indices.fill_null(len(wide) - 1).to_numpy()
            leaked = (touched_rows(g, p)[0] < 0) & wide[code]
            row, of = np.unique(np.stack([g.row[leaked], code[leaked]]), axis=1)
            classes = np.bincount(row, minlength=batch.num_rows)
            for k, n in enumerate(np.bincount(of[classes[row] == 1], minlength=len(label.dictionary)).tolist()):
                if n:
                    sums[f"solo_{label.dictionary[k].as_py()}"] += n
            sums["multiple"] += int((classes > 1).sum())
            sums[None] += int((classes == 0).sum())
        rows = [(bucket, n) for bucket, n in sums.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["bucket", "n"])

    buckets = over(df, ["gold", "pred"], run, "bucket string, n long", surfaces=False).groupBy("bucket").agg(F.sum("n").alias("docs"))
    # a row for each label at most
    rate = F.round(F.col("docs") / F.sum("docs").over(Window.partitionBy(F.lit(0))), 6)
    return buckets.select("bucket", "docs", rate.alias("rate")).where("bucket is not null").orderBy(F.col("bucket") != "multiple", "bucket")


def neutralised(df: DataFrame) -> DataFrame:
    """For each label its true spans, and those that a predicted one overlaps."""
    rows = with_touch(df, t_gold=("gold", "pred")).select(F.explode(F.transform("gold", lambda g, i: F.struct(g["label"].alias("label"), hit("t_gold", i).cast("long").alias("hit")))).alias("x"))
    return rows.groupBy("x.label").agg(F.count("*").alias("total"), F.sum("x.hit").alias("covered"))


STATES = ("missed", "partial", "full")


def has_letters(text: str) -> bool:
    """Whether a letter or number is in the text."""
    return any(category(c)[0] in "LN" for c in text)


def strict_coverage(df: DataFrame) -> DataFrame:
    """True spans (all, direct) by how much of them is taken out, and those of which letters or digits stay; counted in tasks."""
    names = ["spans", "direct", "known", "left", "direct_left"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(STATES), len(names)), np.int64)
        for batch in sliced(batches):
            texts = strings(batch.column(0))
            g, p = Spans(batch.column(1)), Spans(batch.column(2))
            first, stop = touched_rows(g, p)
            # what each touch takes out of its span
            many = np.where(first >= 0, stop - first, 0)
            of = np.repeat(np.arange(len(many)), many)
            at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + (p.first[g.row] + first)[of]
            low, high = np.maximum(g.start[of], p.start[at]), np.minimum(g.end[of], p.end[at])
            out = np.bincount(of, high - low, len(many)).astype(np.int64)
            state = np.where(out == 0, 0, np.where(out >= g.end - g.start, 2, 1))
            left = np.zeros(len(many), bool)
            ends = np.cumsum(many)
            for i in np.flatnonzero((state < 2) | (many > 1)).tolist():
                text, inner = texts[g.row[i]], range(ends[i] - many[i], ends[i])
                cuts = [int(g.start[i]), *[int(x) for k in inner for x in (p.start[at[k]], p.end[at[k]])], int(g.end[i])]
                left[i] = any(has_letters(text[a:b]) for a, b in zip(cuts[0::2], cuts[1::2]) if b > a)
            label = g.flat.field("label").cast(pa.string())
            direct = pc.is_in(label, pa.array(DIRECT)).to_numpy(zero_copy_only=False)
            known = pc.is_valid(label).to_numpy(zero_copy_only=False)
            for k in range(len(STATES)):
                here = state == k
                sums[k] += [here.sum(), (here & direct).sum(), (here & known).sum(), (here & left).sum(), (here & direct & left).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(STATES), *[pa.array(sums[:, k]) for k in range(len(names))]], names=["state", *names])

    rows = over(df, ["text", "gold", "pred"], run, "state string, " + ", ".join(f"{n} long" for n in names), surfaces=False).where("spans > 0")
    sums = rows.groupBy("state").agg(*[F.sum(n).alias(n) for n in names])
    # without any label in a state it isn't known how many are direct
    return sums.select("state", "spans", F.when(F.col("known") > 0, F.col("direct")).alias("direct"), F.col("left").alias("with_residue"), F.col("direct_left").alias("direct_with_residue"))


def over_redaction(df: DataFrame) -> DataFrame:
    """Words outside true spans, and those of them that are covered."""
    sums = word_counts(df).agg(total(F.col("fp") + F.col("tn")).alias("outside"), total(F.col("fp")).alias("covered"))
    return sums.withColumn("rate", F.round(ratio(F.col("covered"), F.col("outside")), 6))


#: Different texts that a task counts before it passes them on.
MOST_COUNTED = 20_000


def source_name(model: bool, label: str | None) -> str:
    """Which detector covers a place: both, the model, a rule by the label of its first span, or none."""
    return ("model+rule" if label is not None else "model") if model else "unattributed" if label is None else f"rule:{label}"


def over_redaction_sources(df: DataFrame, model: str | None = "model", rule: str = "rules") -> DataFrame:
    """Covered words outside true spans by the detector that covers them, most first; counted in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in sliced(batches):
            _, words, g, p = flagged_words(*batch.columns[:3])
            wrong = ~g & p
            wrong = Spans.of(np.bincount(words.row[wrong], minlength=batch.num_rows), words.start[wrong], words.end[wrong])
            rules = Spans(batch.column(3))
            at = touched_rows(wrong, rules)[0]
            places = pa.array(rules.first[wrong.row] + at, mask=at < 0)
            labels = rules.flat.field("label").take(places).to_pylist()
            by_model = touched_rows(wrong, Spans(batch.column(4)))[0] >= 0 if model else np.zeros(len(at), bool)
            sums.update(zip(by_model.tolist(), labels))
        rows = [(source_name(m, label), n) for (m, label), n in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["source", "n"])

    columns = ["text", "gold", "pred", rule, *([model] if model else [])]
    if rule == "pred":  # one column is one of a batch
        inner, run = run, lambda batches: inner(pa.RecordBatch.from_arrays([*b.columns[:3], b.column(2), *b.columns[3:]], names=["text", "gold", "pred", "rule", *(["model"] if model else [])]) for b in batches)
        columns.remove("pred")
    rows = over(df, columns, run, "source string, n long", surfaces=False)
    return rows.groupBy("source").agg(F.sum("n").alias("words")).orderBy(F.desc("words"), "source")


def plain_text(surface: Column) -> Column:
    """Blanks as one, lower case, no punctuation at the ends."""
    return F.trim(F.lower(F.regexp_replace(surface, r"(?U)\s+", " ")), F.lit(" .,;:()[]-/"))


def top_false_positives(df: DataFrame, n: int = 20, model: str | None = "model", rule: str = "rules") -> DataFrame:
    """The texts that are found most often where no true span is, with their most frequent detector (ties: by name); tasks pass on counts."""
    columns = list(dict.fromkeys(["pred", "gold", rule, *([model] if model else [])]))

    def rows_of(sums: Counter) -> pa.RecordBatch:
        rows = [(text, source_name(m, label), k) for (text, m, label), k in sums.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["surface", "source", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in sliced(batches):
            p, g, rules = (Spans(batch.column(columns.index(c))) for c in ("pred", "gold", rule))
            wrong = np.flatnonzero(touched_rows(p, g)[0] < 0)
            by_rule = touched_rows(p, rules)[0][wrong]
            labels = rules.flat.field("label").take(pa.array(rules.first[p.row[wrong]] + by_rule, mask=by_rule < 0)).to_pylist()
            by_model = (touched_rows(p, Spans(batch.column(columns.index(model))))[0][wrong] >= 0).tolist() if model else [False] * len(wrong)
            sums.update(zip(p.flat.field("surface").take(pa.array(wrong)).to_pylist(), by_model, labels))
            if len(sums) > MOST_COUNTED:
                yield rows_of(sums)
                sums.clear()
        yield rows_of(sums)

    rows = over(df, columns, run, "surface string, source string, k long").select(plain_text(F.col("surface")).alias("text"), "source", "k").where("text <> ''")
    counts = rows.groupBy("text", "source").agg(F.sum("k").alias("k"))
    best = counts.groupBy("text").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), "source"))["source"].alias("source"))
    return best.orderBy(F.desc("n"), "text").limit(n)


def rule_false_words(df: DataFrame, matches: str = "matches") -> DataFrame:
    """For each rule the words outside true spans that its matches cover, before anything is resolved."""

    def work(words: list[dict], found: list[dict] | None) -> tuple:
        by_rule: dict = {}
        for m in found or []:
            by_rule.setdefault(m["rule"], []).append(m)
        return ([(r, sum(first >= 0 for first, _ in touched(words, sorted(ms, key=lambda m: m["start"])))) for r, ms in by_rule.items()],)

    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    outside = F.transform(F.filter("words", lambda w: ~w["g"]), place)
    slim = F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["rule"].alias("rule")))
    each = with_rows(with_words(df).select(outside.alias("words"), slim.alias("found")), {"words": F.col("words"), "found": F.col("found")}, work, {"false_words": "array<struct<rule:string,n:bigint>>"})
    return each.select(F.explode("false_words").alias("x")).groupBy("x.rule").agg(F.sum("x.n").alias("words"))


def confusion(df: DataFrame) -> DataFrame:
    """True label against the label of the first overlapping predicted span, or (FN)."""
    first = lambda i: F.when(hit("t_gold", i), F.get("pred", F.get("t_gold", i)["first"])["label"]).otherwise("(FN)")
    rows = with_touch(df, t_gold=("gold", "pred")).select(F.explode(F.transform("gold", lambda g, i: F.struct(g["label"].alias("label"), first(i).alias("predicted")))).alias("x"))
    return rows.groupBy("x.label", "x.predicted").agg(F.count("*").alias("n"))


# -- entities with several mentions


def consistency(df: DataFrame) -> DataFrame:
    """Entities of which a mention has a placeholder, and those whose mentions share one.

    ``mentions``: array of (entity, surface) in order; ``names``: surface to placeholder.
    """
    named = F.filter(F.transform("mentions", lambda m: F.struct(m["entity"].alias("entity"), F.col("names")[m["surface"]].alias("ph"))), lambda m: m["ph"].isNotNull())
    rows = df.select(held(named).alias("m")).select("m", F.explode(F.array_distinct(F.transform("m", lambda x: x["entity"]))).alias("entity"))
    kinds = F.size(F.array_distinct(F.transform(F.filter("m", lambda x: x["entity"] == F.col("entity")), lambda x: x["ph"])))
    return rows.agg(F.count("*").alias("entities"), F.count_if(kinds == 1).alias("consistent"))


def collisions(df: DataFrame) -> DataFrame:
    """How often a placeholder goes from one entity to another in the order of mentions."""
    named = F.filter(F.transform("mentions", lambda m: F.struct(m["entity"].alias("entity"), F.col("names")[m["surface"]].alias("ph"))), lambda m: m["ph"].isNotNull())
    rows = df.select(held(named).alias("m"))
    before = lambda x, i: F.try_element_at(F.filter(F.slice("m", F.lit(1), i), lambda o: o["ph"] == x["ph"]), F.lit(-1))["entity"]
    moves = F.transform("m", lambda x, i: F.coalesce(before(x, i) != x["entity"], F.lit(False)))
    return rows.agg(F.count("*").alias("docs"), total(count(F.filter(moves, lambda x: x))).alias("collisions"))


# -- intervals

PRIME = 2147483647


def poisson_bounds(most: int = 8) -> list[int]:
    """Bounds, in parts of ``PRIME``, of 0, 1, 2 ... draws of mean 1."""
    share = whole = math.exp(-1)
    bounds = [round(whole * PRIME)]
    for k in range(1, most):
        share /= k
        whole += share
        bounds.append(round(whole * PRIME))
    return bounds


POISSON = poisson_bounds()


def weighted(per_doc: DataFrame, columns: list[str], replicates: int) -> DataFrame:
    """``r`` and the weighted sum of each column in that replicate (-1: every document once); documents are drawn where they are.

    A block of documents times their weights in all replicates is one product of
    matrices; a task passes on its sums, a row for each replicate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, r, plain = np.zeros((replicates, len(columns)), np.int64), np.arange(replicates), np.zeros((1, len(columns)), np.int64)
        for batch in batches:
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(np.float64)
            plain += np.rint(values.sum(axis=0)).astype(np.int64)
            for k in range(0, len(docs), 512):
                sums += np.rint(draws(docs[k : k + 512, None], r).T.astype(np.float64) @ values[k : k + 512]).astype(np.int64)
        every = np.concatenate([plain, sums])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, r)), *[pa.array(every[:, i]) for i in range(len(columns))]], names=["r", *columns])

    slim = per_doc.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in columns])
    rows = slim.mapInArrow(run, "r long, " + ", ".join(f"{c} long" for c in columns))
    return rows.groupBy("r").agg(*[F.sum(c).alias(c) for c in columns])


def draws(doc: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How often a document is drawn in a replicate: follows from both alone."""
    doc = doc % PRIME
    x = (doc * 48271 + r * 69621 + 12345) % PRIME
    for add in (7, 11, 13):  # squares mix the two; a line in both alone would draw documents evenly
        x = (x * x + r * add + doc) % PRIME
    return np.searchsorted(np.array(POISSON), x, "right")


#: Metric: what it is made from, and its value.
INTERVALS = {
    "neutralised": (("covered", "total"), lambda c: ratio(c["covered"], c["total"])),
    "leakage": (("leak", "doc"), lambda c: ratio(c["leak"], c["doc"])),
    "word_f1": (("tp", "fp", "fn"), lambda c: ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"])),
}


def intervals(per_doc: DataFrame, metrics: dict = INTERVALS, replicates: int = 1000) -> DataFrame:
    """``metric``, ``point``, ``low``, ``high`` (95 % by percentiles) and whether the point lies between.

    A Poisson bootstrap: each document's weight in a replicate follows from its identifier
    and the replicate, so no document is drawn by rank, and tasks pass on one row for each
    replicate.  It covers a mean, a ratio of sums and an F1 alike.
    """
    columns = sorted({c for needs, _ in metrics.values() for c in needs})
    col = {c: F.col(c) for c in columns}
    values = F.array(*[F.struct(F.lit(n).alias("metric"), f(col).alias("v")) for n, (_, f) in metrics.items()])
    low, high = int(0.025 * (replicates - 1)), int(0.975 * (replicates - 1))
    rows = weighted(per_doc, columns, replicates).select("r", F.explode(values).alias("x"))
    both = rows.groupBy("x.metric").agg(F.max(F.when(F.col("r") < 0, F.col("x.v"))).alias("point"), F.array_sort(F.collect_list(F.when(F.col("r") >= 0, F.col("x.v")))).alias("vs"))
    both = both.select("metric", F.round("point", 6).alias("point"), F.round(F.get("vs", F.lit(low)), 6).alias("low"), F.round(F.get("vs", F.lit(high)), 6).alias("high"))
    return both.withColumn("inside", F.col("point").between(F.col("low") - 1e-6, F.col("high") + 1e-6))


def per_document(df: DataFrame) -> DataFrame:
    """What ``INTERVALS`` are made from."""
    n = lambda keep: count(F.filter("words", keep))
    return with_touch(with_words(df), t_gold=("gold", "pred")).select(
        "doc_id",
        count(F.filter("gold", lambda g, i: hit("t_gold", i))).alias("covered"),
        count(F.col("gold")).alias("total"),
        leaks(DIRECT).alias("leak"),
        F.lit(1).cast("long").alias("doc"),
        n(lambda w: w["g"] & w["p"]).alias("tp"),
        n(lambda w: ~w["g"] & w["p"]).alias("fp"),
        n(lambda w: w["g"] & ~w["p"]).alias("fn"),
    )
