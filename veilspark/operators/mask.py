"""Reversible placeholders: escape, number, splice and restore."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from veilspark.functions.rows import over, sliced, strings, with_arrays, with_rows
from veilspark.functions.spans import gaps, held, with_spans

from . import restoring
from .detect import detect
from .lexicon import OTHER_TAGS, TAGS
from .restoring import TAG_WORDS
from .rules import RULES, Rule

NUMBERED_TAG = rf"(?:{TAG_WORDS})[\s_]*\d+(?!\d)"
#: What a language model may make of a placeholder: bold, inner blanks or a line break, any case, another language's tag, plural or genitive.
PLACEHOLDER = rf"(?iU)\*{{0,2}}\[\s*{NUMBERED_TAG}\s*\](?-i:'s|s)?\*{{0,2}}"
#: Text that is shaped like a placeholder or like a part of one.
LITERAL = rf"(?iU)\*{{0,2}}(?:\[\s*{NUMBERED_TAG}(?:\s*\](?-i:'s|s)?)?|(?<![A-Za-z0-9]){NUMBERED_TAG}\s*\]?)\*{{0,2}}"
MAPPING = "array<struct<surface:string,tag:string,n:int,placeholder:string>>"
OPEN, CLOSE = "\ue000", "\ue001"


def tag_of(label: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])[label], F.lit("ANONIMO"))


def numbered(spans: DataFrame, request: str, text_seq: str | None = None) -> DataFrame:
    """One row for each surface of a request with its placeholder.

    ``spans``: request, span_start, label, surface (and the order of texts).  Texts go in
    order, spans of a text from the last to the first; a surface takes the tag of its
    first visit, numbers count up for each tag.
    """
    order = ([F.col(text_seq)] if text_seq else []) + [F.desc("span_start")]
    place = spans.withColumn("visit", F.row_number().over(Window.partitionBy(request).orderBy(*order)))
    first = place.groupBy(request, "surface").agg(F.min_by("label", "visit").alias("label"), F.min("visit").alias("visit"))
    tagged = first.withColumn("tag", tag_of(F.col("label")))
    n = F.row_number().over(Window.partitionBy(request, "tag").orderBy("visit"))
    return tagged.withColumn("n", n).withColumn("placeholder", F.concat(F.lit("["), "tag", F.lit("_"), F.col("n").cast("string"), F.lit("]"))).drop("visit")


def numbered_together(df: DataFrame, request: str, spans: str = "entities") -> DataFrame:
    """As ``numbered``, from rows with arrays of spans where a request's rows lie behind each other in one partition; no span is sorted or dealt out.

    Spans at one place (of repeated rows) go by their end, label and surface.
    """
    kind = next(f for f in df.schema.fields if f.name == request)
    schema = T.StructType([kind, *[T.StructField(n, T.StringType()) for n in ("surface", "label", "placeholder")]])
    arrow = [to_arrow_type(f.dataType) for f in schema.fields]

    def of(ident, found: list[tuple]) -> Iterator[tuple]:
        seen, last = set(), {}
        for _, _, label, surface in sorted(found, key=lambda s: (s[0], s[1], s[2] or "", s[3]), reverse=True):
            if surface not in seen:
                seen.add(surface)
                tag = TAGS.get(label, "ANONIMO")
                last[tag] = n = last.get(tag, 0) + 1
                yield ident, surface, label, f"[{tag}_{n}]"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(arrow)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, found, begun = None, [], False
        for batch in sliced(batches):
            rows, idents, lists = [], batch.column(0).to_pylist(), batch.column(1)
            flat, ends = lists.flatten(), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()]).tolist()
            every = list(zip(*[flat.field(n).to_pylist() for n in ("start", "end", "label", "surface")]))
            for k, a, b in zip(idents, ends, ends[1:]):
                if not begun or k != ident:
                    rows += of(ident, found)
                    ident, found, begun = k, [], True
                found += every[a:b]
            yield batch_of(rows)
        yield batch_of(list(of(ident, found)))

    return over(df, [request, spans], run, schema)


def spliced(text: str, spans: list[dict], names: dict[str, str]) -> str:
    """The text with ``names[surface]`` in the place of each span (none overlaps): gaps and names, joined once."""
    pieces, at = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        pieces += [text[at : s["start"]], names.get(s["surface"], s["surface"])]
        at = s["end"]
    return "".join([*pieces, text[at:]])


def named(spans: list[dict]) -> dict[str, tuple[str, int, str]]:
    """Of each surface its tag, number and placeholder, from the last span to the first; numbers count up for each tag."""
    found, last = {}, {}
    for s in sorted(spans, key=lambda s: (s["start"], s["end"]), reverse=True):
        if s["surface"] not in found:
            tag = TAGS.get(s["label"], "ANONIMO")
            last[tag] = n = last.get(tag, 0) + 1
            found[s["surface"]] = (tag, n, f"[{tag}_{n}]")
    return found


def _slim(spans: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["surface"].alias("surface")))


def mask(df: DataFrame, mapping: DataFrame, request: str, text: str = "text", spans: str = "entities", out: str = "masked") -> DataFrame:
    """Put each span's placeholder in its place; ``mapping`` as from ``numbered``."""
    table = mapping.groupBy(request).agg(F.collect_list(F.struct("surface", "placeholder")).alias("m__"))
    work = lambda t, spans, names: (None if t is None else spliced(t, spans or [], {n["surface"]: n["placeholder"] for n in names or []}),)
    return with_rows(df.join(table, request, "left"), {"text": F.col(text), "spans": _slim(spans), "names": F.col("m__")}, work, {out: "string"}).drop("m__")


def mask_each(df: DataFrame, key: str = "doc_id", text: str = "text", spans: str = "entities") -> DataFrame:
    """Every row is a request of its own: numbers from its spans, without a shuffle; adds ``mapping`` and ``masked``."""

    def work(texts: pa.Array, spans: pa.Array) -> tuple[pa.Array, pa.Array]:
        flat, size = spans.flatten(), spans.value_lengths().fill_null(0).to_numpy()
        start, end = (flat.field(n).to_numpy() for n in ("start", "end"))
        row, ends = np.repeat(np.arange(len(size)), size), np.cumsum([0, *size]).tolist()
        order = np.lexsort((end, start, row))
        if (order[1:] < order[:-1]).any():
            flat, start, end = flat.take(pa.array(order)), start[order], end[order]
        label, surfaces = flat.field("label").dictionary_encode(), flat.field("surface")
        kinds = pa.array([*(TAGS.get(k, "ANONIMO") for k in label.dictionary.to_pylist()), "ANONIMO"], pa.string())
        kind = label.indices.fill_null(len(kinds) - 1)
        start, end, tag, surface = start.tolist(), end.tolist(), strings(kinds.take(kind)), surfaces.to_numpy(zero_copy_only=False).tolist()
        visit, number, placeholder, first, masked = [], [], [], [0], []
        for t, a, b in zip(texts.to_numpy(zero_copy_only=False).tolist(), ends, ends[1:]):
            names, last = {}, {}
            for k in range(b - 1, a - 1, -1):
                if surface[k] not in names:
                    last[tag[k]] = n = last.get(tag[k], 0) + 1
                    names[surface[k]] = made = f"[{tag[k]}_{n}]"
                    visit.append(k)
                    number.append(n)
                    placeholder.append(made)
            first.append(len(visit))
            if t is not None:
                pieces, at = [], 0
                for k in range(a, b):
                    pieces += (t[at : start[k]], names[surface[k]])
                    at = end[k]
                t = "".join([*pieces, t[at:]])
            masked.append(t)
        at = pa.array(visit, pa.int64())
        fields = [surfaces.take(at).cast(pa.string()), kinds.take(kind.take(at)), pa.array(number, pa.int32()), pa.array(placeholder, pa.string())]
        made = pa.StructArray.from_arrays(fields, ["surface", "tag", "n", "placeholder"])
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), made), pa.array(masked, pa.string())

    return with_arrays(df, {"text": text, "spans": spans}, work, {"mapping": MAPPING, "masked": "string"})


def restore(df: DataFrame, text: str = "masked", mapping: str | dict[str, str] = "mapping", out: str = "restored", tokens: str | None = None) -> DataFrame:
    """Originals in the place of placeholders, in one pass: what is put in is not read again.

    ``tokens``: lower-case words that the user wrote; a bent placeholder that lies in one
    of them whole stays as it is.  Unknown numbers stay too.  Without tokens ``mapping`` may be
    the originals of all rows, by placeholder.
    """
    if isinstance(mapping, dict):
        if tokens:
            raise ValueError("with tokens mapping is a column")
        return with_arrays(df, {"text": text}, lambda texts: (pa.array(restoring.restored_alike(strings(texts), mapping), pa.string()),), {out: "string"})
    if not tokens:
        work = lambda texts, mapping: (pa.array(restoring.restored(strings(texts), mapping), pa.string()),)
        return with_arrays(df, {"text": text, "mapping": mapping}, work, {out: "string"})
    # places count only beside the user's words
    df = with_spans(df.withColumn("r__text", F.coalesce(text, F.lit(""))), "r__text", {"r__hit": PLACEHOLDER, "r__token": r"(?U)\S+"})
    df = df.withColumns({"r__parts": held(F.arrays_zip(gaps(F.col("r__text"), PLACEHOLDER, F.col("r__hit")).alias("gap"), F.col("r__hit").alias("hit"))), "r__names": held(F.map_from_entries(F.transform(mapping, lambda m: F.struct(m["placeholder"], m["surface"]))))})
    df = df.withColumn("r__own", held(F.filter("r__token", lambda t: F.array_contains(tokens, F.lower(t["surface"])))))
    names = F.create_map(*[F.lit(x) for kv in OTHER_TAGS.items() for x in kv])

    def original(hit: Column) -> Column:
        tag = F.upper(F.regexp_extract(hit["surface"], rf"(?i)({TAG_WORDS})", 1))
        want = F.concat(F.lit("["), F.coalesce(names[tag], tag), F.lit("_"), F.regexp_extract(hit["surface"], r"(?U)(\d+)", 1), F.lit("]"))
        plain = F.lower(F.trim(hit["surface"], F.lit("*"))) == F.lower(want)
        own = F.exists("r__own", lambda t: (t["start"] <= hit["start"]) & (hit["end"] <= t["end"]))
        return F.coalesce(F.when(plain | ~own, F.col("r__names")[want]), hit["surface"])

    whole = F.array_join(F.transform("r__parts", lambda z: F.concat(z["gap"], F.when(z["hit"].isNotNull(), original(z["hit"])).otherwise(F.lit("")))), "")
    return df.withColumn(out, whole).drop("r__text", "r__parts", "r__names", "r__own", "r__hit", "r__token")


def escape_literals(df: DataFrame, text: str = "text", out: str = "escaped", literals: str = "literals", first: Column | None = None) -> DataFrame:
    """Text shaped like a placeholder becomes a private-use marker; adds the literals, in order; ``first``: the number of the first."""
    df = df.withColumn("e__text", F.coalesce(text, F.lit("")))
    df = df.withColumn(literals, held(F.regexp_extract_all("e__text", F.lit(LITERAL), F.lit(0))))
    df = df.withColumns({"e__gaps": held(gaps(F.col("e__text"), LITERAL, F.col(literals))), "e__first": F.lit(0).cast("bigint") if first is None else first})
    marked = F.transform("e__gaps", lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.lit(OPEN), (F.col("e__first") + i - 1).cast("string"), F.lit(CLOSE), g)))
    return df.withColumn(out, F.array_join(marked, "")).drop("e__gaps", "e__text", "e__first")


def unescape(df: DataFrame, text: str = "escaped", out: str = "text", literals: str = "literals") -> DataFrame:
    """Literals in the place of their markers, in one pass; unknown markers stay."""
    marker = f"{OPEN}(\\d+){CLOSE}"
    df = df.withColumn("u__hits", held(F.regexp_extract_all(text, F.lit(marker), F.lit(1)))).withColumn("u__gaps", held(gaps(F.col(text), marker, F.col("u__hits"))))
    known = lambda i: F.coalesce(F.get(literals, F.get("u__hits", i - 1).cast("int")), F.concat(F.lit(OPEN), F.get("u__hits", i - 1), F.lit(CLOSE)))
    joined = F.array_join(F.transform("u__gaps", lambda g, i: F.when(i == 0, g).otherwise(F.concat(known(i), g))), "")
    return df.withColumn(out, joined).drop("u__hits", "u__gaps")


def removed_intervals(df: DataFrame, text: str = "text", rules: list[Rule] = RULES, names: bool = False) -> DataFrame:
    """Add ``removed``: what masking takes out of the text, as intervals of the text itself, by start.

    These are the literals that are escaped before detection, and the spans found in the
    escaped text, moved back by what the literals before them had gained or lost.
    """
    df = with_spans(df.withColumn("i__text", F.coalesce(text, F.lit(""))), "i__text", {"i__literal": LITERAL})
    marker = lambda i: 2 + F.length(i.cast("string"))
    gain = lambda x, i: (x["end"] - x["start"]) - marker(i)
    df = df.withColumn("i__literal", held(F.transform("i__literal", lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), gain(x, i).alias("gain")))))
    found = detect(escape_literals(df, "i__text", "i__escaped", "i__texts"), "i__escaped", rules, names)

    def back(s: Column) -> Column:
        # a literal lies before the span if it begins before the place that the span has after it is moved
        step = lambda moved, x: F.when(x["start"] <= s["start"] + moved, moved + x["gain"]).otherwise(moved)
        shift = F.aggregate("i__literal", F.lit(0).cast("bigint"), step)
        return F.struct((s["start"] + shift).alias("start"), (s["end"] + shift).alias("end"))

    plain = F.transform("i__literal", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    out = F.array_sort(F.concat(plain, F.transform("entities", back)))
    return found.withColumn("removed", held(out)).drop("i__text", "i__literal", "i__escaped", "i__texts", "entities")


# -- whole requests


def words_of(text: Column) -> Column:
    """Lower-case words, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\S+"), F.lit(0)))


def anonymize(df: DataFrame, text: str = "text", rules: list[Rule] = RULES, names: bool = True) -> DataFrame:
    """Every row is a request: adds ``masked`` and what ``deanonymize`` needs: ``mapping``, ``literals``, ``tokens``."""
    df = escape_literals(df.withColumn("tokens", words_of(F.col(text))), text, "a__text")
    found = detect(df, "a__text", rules, names)
    return mask_each(found, text="a__text").drop("a__text", "entities")


def deanonymize(df: DataFrame, text: str = "masked", out: str = "restored") -> DataFrame:
    """Originals for placeholders, then literals for markers."""
    return unescape(restore(df, text, "mapping", "d__text", "tokens"), "d__text", out).drop("d__text")


def anonymize_requests(df: DataFrame, request: str, seq: str, text: str = "text", rules: list[Rule] = RULES, names: bool = True) -> tuple[DataFrame, DataFrame]:
    """Requests of several texts: the rows with ``masked``, and for each request ``mapping``, ``literals``, ``tokens``.

    Placeholders, markers and words go on over a request's texts in the order of ``seq``.
    A request's spans meet in one task; its texts don't.
    """
    counted = df.withColumn("q__n", F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LITERAL), F.lit(0))))
    before = F.coalesce(F.sum("q__n").over(Window.partitionBy(request).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    rows = escape_literals(counted.withColumn("q__first", before), text, "q__text", "q__literals", F.col("q__first"))
    found = detect(rows, "q__text", rules, names)
    spans = found.select(request, seq, F.explode("entities").alias("s")).select(request, seq, F.col("s.start").alias("span_start"), F.col("s.label").alias("label"), F.col("s.surface").alias("surface"))
    table = numbered(spans, request, seq)
    masked = mask(found, table, request, "q__text").drop("q__n", "q__first", "q__text", "entities")
    named = table.groupBy(request).agg(F.array_sort(F.collect_list(F.struct("surface", "tag", "n", "placeholder"))).alias("mapping"))
    texts = found.groupBy(request).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("q__first").alias("first"), F.col("q__literals").alias("x")))), lambda s: s["x"])).alias("literals"),
        F.array_distinct(F.flatten(F.collect_list(words_of(F.col(text))))).alias("tokens"),
    )
    none = F.array().cast(MAPPING)
    keys = texts.join(named, request, "left").withColumn("mapping", F.coalesce("mapping", none))
    return masked.drop("q__literals"), keys


def translated(text: Column) -> Column:
    """Tags with another name under that name; the sign keeps one that was put in from being read again."""
    for other, tag in OTHER_TAGS.items():
        if other != "OTHER":
            text = F.replace(text, F.lit(f"[{tag}_"), F.lit(f"[={other}_"))
    return text


#: Nine ways in which a model's answer may bend a placeholder (``restoring.BEND`` has them for texts in tasks); the flag says whether restoration undoes it.
PERTURBATIONS = {
    "uppercase": (lambda c: F.upper(c), True),
    "bold": (lambda c: F.regexp_replace(c, r"(\[[A-Z]+_\d+\])", "**$1**"), True),
    "lost_brackets": (lambda c: F.regexp_replace(c, r"\[([A-Z]+_\d+)\]", "$1"), False),
    "single_bracket": (lambda c: F.regexp_replace(c, r"\[([A-Z]+_\d+)\]", "[$1"), False),
    "inner_space": (lambda c: F.regexp_replace(c, r"\[([A-Z]+)_(\d+)\]", "[$1 _ $2]"), True),
    "translated": (lambda c: F.regexp_replace(translated(c), r"\[=([A-Z]+)_", "[$1_"), True),
    "plural": (lambda c: F.regexp_replace(c, r"(\[[A-Z]+_\d+\])", "$1s"), True),
    "genitive": (lambda c: F.regexp_replace(c, r"(\[[A-Z]+_\d+\])", "$1's"), True),
    "newline": (lambda c: F.regexp_replace(c, r"\[([A-Z]+)_(\d+)\]", "[$1_\n$2]"), True),
}


def kept_when_bent(df: DataFrame, text: str = "masked", mapping: str = "mapping") -> DataFrame:
    """For each way to bend, how many texts have placeholders, and in how many of them all originals are there again after restoring.

    Bent texts are no rows: a task bends, restores and compares a slice of texts at a time, and passes on a row for each way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, kept = 0, dict.fromkeys(restoring.BEND, 0)
        for batch in sliced(batches):
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(1)), 0))
            texts += batch.num_rows
            for name, n in restoring.kept(strings(batch.column(0)), batch.column(1)):
                kept[name] += n
        if texts:
            yield pa.RecordBatch.from_pydict({"name": list(kept), "texts": [texts] * len(kept), "restored": list(kept.values())})

    each = over(df, [text, mapping], run, "name string, texts bigint, restored bigint")
    return each.groupBy("name").agg(F.sum("texts").alias("texts"), F.sum("restored").alias("restored"))
