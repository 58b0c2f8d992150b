"""Ranked lexical search: variable blocks of postings, skipped exactly by their maxima.

Terms are the maximal runs of ASCII letters and digits and of all other characters beyond
ASCII, only A-Z lower-cased.  All arithmetic but a term's weight is in 64-bit integers.  With N
documents that have a term, L terms in all (with repeats), n in a document and tf times one
there, a posting's impact is ``10^9 tf div (1000 tf + 8 m)``, m = ``10 + 90 n N div L``; a
document's score is the sum of weight times impact over an item's terms, once each.  A
weight is ``floor(1000 ln((2 N + 2) / (2 df + 1)))``.

``index`` goes over the documents twice: once for N and L, once to build shards of at most
``SHARD_DOCS`` documents or ``SHARD_CHARS`` characters (a longer text is a shard of its own), each in
the task that reads them, so nothing is shuffled.  A shard has a row for every term: its
documents, impacts, and its blocks' first and last documents and maxima.  Dynamic programming
chooses the blocks of at most ``BLOCK_MOST`` postings so that their bounds' error is least: the sum,
over all documents from a block's first to its last, of the maximum less the impact (0 where the
term isn't), and ``BLOCK_COST`` a block.  Many lists are gone through in step.

``search`` takes the items by blocks of a bounded number of terms, joins a block's terms with the
index and brings a shard's postings together.  The beginnings and ends of all blocks of an item's terms cut the
shard into intervals; an interval's bound is the sum of its blocks' maxima, which is WAND's test at a
pivot, made for all at once.  Intervals are scored from the greatest bound down, all their
postings with whole terms, until a bound is below the score of the k-th document; what is left
can't hold a better or equal one, so results are exact.  Then a shard's best and the best of all are
ranked: highest score first, with ties by identifier (null first).

A null text has no terms; documents and items without terms are in no result.  Rows that are
repeated are documents of their own.  Items of one identifier are one item with the terms of
all.  Very long texts are whole; empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches

SHARD_DOCS, SHARD_CHARS = 16_384, 32_000_000
#: What a block costs in the choice of ends, in impact times documents, and its most postings.
BLOCK_COST, BLOCK_MOST = 10_000_000, 64
#: Terms of the items that are searched for at once.
ITEM_TERMS = 200_000
_ONE = np.ones(1, np.int32)
_TERM_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split(b" ")


def counted(text: str) -> Counter:
    found = Counter(terms(text))
    found.pop(b"", None)
    return found


class Index(NamedTuple):
    """Rows (``shard``, ``term``, ``df``, ``docs``, ``impacts``, ``firsts``, ``ends``, ``tops``) and (``shard``, ``ids``), and the number of documents with terms."""

    postings: DataFrame
    documents: DataFrame
    n_docs: int


def block_ends(docs: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cost: int = BLOCK_COST, most: int = BLOCK_MOST) -> list[np.ndarray]:
    """For each list of ``docs`` (ascending) and ``values`` the ends (exclusive, within the list) of its cheapest blocks."""
    out: list = [_ONE] * len(sizes)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 1]
    while len(order):
        # lists of like lengths together, longest first
        n = int(sizes[order[-1]])
        take = max(1, min(len(order), (1 << 16) // most, (1 << 24) // n))
        rows, order = order[-take:], order[:-take]
        where = np.minimum(starts[rows] + np.arange(n)[:, None], len(values) - 1)
        value, place = values[where].astype(np.float64), docs[where].astype(np.float64)
        shape = (most, len(rows))
        tops, first, before, least = np.zeros(shape), np.zeros(shape), np.full(shape, np.inf), np.zeros(len(rows))
        begun, back, every = np.zeros(most, np.int64), np.zeros((n, len(rows)), np.int32), np.arange(len(rows))
        for i in range(n):
            slot = i % most
            tops[slot], first[slot], before[slot], begun[slot] = 0, place[i] - 1, least, i
            np.maximum(tops, value[i], out=tops)
            total = place[i] - first
            total *= tops
            total += before
            best = total.argmin(axis=0)
            least = total[best, every] + cost
            back[i] = begun[best]
        stop, ends = sizes[rows].astype(np.int64), [[] for _ in rows]
        while (alive := np.flatnonzero(stop > 0)).size:
            for k, e in zip(alive.tolist(), stop[alive].tolist()):
                ends[k].append(e)
            stop[alive] = back[stop[alive] - 1, alive]
        for r, e in zip(rows.tolist(), ends):
            out[r] = np.array(e[::-1], np.int32)
    return out


CELLS = ("docs", "impacts", "firsts", "ends", "tops")
_POSTINGS = "shard long, term binary, df long, docs binary, impacts binary, firsts binary, ends binary, tops binary, ids array<long>"
_SCHEMA = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), *[(n, pa.binary()) for n in CELLS], ("ids", pa.list_(pa.int64()))])


def _cells(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary cells of consecutive pieces of ``data``, which end at ``ends`` (the first begins at 0)."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * np.int32(data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


class Shard:
    """Postings of some documents in the making."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.tf, self.many, self.length = array("i"), array("i"), array("i"), array("q")
        self.names: list[int | None] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str) -> None:
        found, know = counted(text), self.vocabulary
        self.ids.extend([know.setdefault(t, len(know)) for t in found])
        self.tf.extend(found.values())
        self.many.append(len(found))
        self.length.append(found.total())
        self.names.append(doc_id)
        self.chars += len(text)

    def batches(self, number: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        ids, tf, many, length = (np.frombuffer(x, x.typecode) for x in (self.ids, self.tf, self.many, self.length))
        m = 10 + 90 * length * n_docs // max(n_terms, 1)
        doc = np.repeat(np.arange(len(many), dtype=np.int32), many)
        order = np.argsort(ids, kind="stable")
        doc, tf = doc[order], tf[order].astype(np.int64)
        impacts = (1_000_000_000 * tf // (1000 * tf + 8 * m[doc])).astype(np.int32)
        sizes = np.bincount(ids, minlength=len(self.vocabulary))
        stops = np.cumsum(sizes)
        words = list(self.vocabulary)
        for k in range(0, len(words), 65536):
            n, part = sizes[k : k + 65536], stops[k : k + 65536]
            low = int(part[0] - n[0])
            docs, values = doc[low : part[-1]], impacts[low : part[-1]]
            starts = part - n - low
            ends = block_ends(docs, values, starts, n)
            blocks = np.array([len(e) for e in ends])
            at = np.repeat(starts, blocks) + np.concatenate(ends)
            begin, stop = np.concatenate([[0], at[:-1]]), np.cumsum(blocks)
            tops = np.maximum.reduceat(values, begin)
            cells = [_cells(docs, part - low), _cells(values, part - low), _cells(docs[begin], stop), _cells(docs[at - 1], stop), _cells(tops, stop)]
            nothing = pa.nulls(len(n), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), number)), pa.array(words[k : k + 65536], pa.binary()), pa.array(n, pa.int64()), *cells, nothing], schema=_SCHEMA)
        empty = pa.array([b""], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([number]), empty, pa.array([0]), *[empty] * len(CELLS), pa.array([self.names], pa.list_(pa.int64()))], schema=_SCHEMA)


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents, written to the shared folder."""
    small_batches(docs.sparkSession, 512)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = total = 0
        for _, texts in slices(batches):
            sizes = [len(x) - x.count(b"") for x in map(terms, texts)]
            have, total = have + sum(n > 0 for n in sizes), total + sum(sizes)
        yield pa.RecordBatch.from_pydict({"docs": pa.array([have]), "terms": pa.array([total])})

    n_docs, n_terms = docs.select(F.col(text).alias("text")).mapInArrow(count, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch, texts in slices(batches):
            for d, t in zip(batch.column("doc_id").to_pylist(), texts):
                if shard.names and (len(shard.names) >= SHARD_DOCS or shard.chars + len(t) > SHARD_CHARS):
                    yield from shard.batches(number, n_docs, n_terms)
                    number, shard = number + 1, Shard()
                shard.add(d, t)
        if shard.names:
            yield from shard.batches(number, n_docs, n_terms)

    rows = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(build, _POSTINGS), "postings")
    return Index(rows.where("ids is null").drop("ids"), rows.where("ids is not null").select("shard", "ids"), n_docs)


class Postings(NamedTuple):
    docs: np.ndarray
    impacts: np.ndarray
    firsts: np.ndarray
    ends: np.ndarray
    tops: np.ndarray


def best_in_shard(lists: list[tuple[int, Postings]], ids: np.ndarray, known: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
    """(document's place, score) of the ``k`` best of a shard, and how many postings were scored."""
    lists = [(w, p) for w, p in lists if w > 0]
    if not lists:
        return [], 0
    edges = np.unique(np.concatenate([x for _, p in lists for x in (p.firsts - 1, p.ends)]))
    bounds = np.zeros(len(edges), np.int64)
    for w, p in lists:
        block = np.searchsorted(p.ends, edges)
        begun = np.append(p.firsts, np.int32(2**31 - 1))[block] <= edges
        bounds += w * np.where(begun, np.append(p.tops, 0)[block], 0).astype(np.int64)
    order = np.argsort(-bounds, kind="stable")
    low = np.concatenate([[0], edges[:-1] + 1])
    score, at, take, least, scored = np.zeros(len(ids), np.int64), 0, 16, 0, 0
    while at < len(order) and bounds[order[at]] >= max(least, 1):
        chosen = np.sort(order[at : at + take])
        for w, p in lists:
            a, b = np.searchsorted(p.docs, low[chosen]), np.searchsorted(p.docs, edges[chosen], "right")
            n = b - a
            if total := int(n.sum()):
                place = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
                score[p.docs[place]] += w * p.impacts[place].astype(np.int64)
                scored += total
        least = int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0
        at, take = at + take, max(take, at // 2)
    found = np.flatnonzero(score >= max(least, 1))
    found = found[np.lexsort((ids[found], known[found], -score[found]))][:k]
    return list(zip(found.tolist(), score[found].tolist())), scored


def searched(batches: Iterator[pa.RecordBatch], items: list[tuple[int | None, list[tuple[bytes, int]]]], k: int) -> Iterator[pa.RecordBatch]:
    """The best of each shard for each item; rows come sorted by shard, a shard's identifiers first."""
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    shard, names, lists = None, [], {}

    def ranked() -> pa.RecordBatch:
        known = np.array([n is not None for n in names])
        ids = np.array([n or 0 for n in names], np.int64)
        out = []
        for item, weights in items:
            hits, _ = best_in_shard([(w, lists[t]) for t, w in weights if t in lists], ids, known, k)
            out += [(item, names[place], s) for place, s in hits]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], []))], schema=schema)

    for b in batches:
        for s, term, ids, *cells in zip(*[b.column(c).to_pylist() for c in ("shard", "term", "ids", *CELLS)]):
            if s != shard:
                if lists:
                    yield ranked()
                shard, names, lists = s, [], {}
            if ids is not None:
                names = ids
            else:
                lists[term] = Postings(*[np.frombuffer(x, np.int32) for x in cells])
    if lists:
        yield ranked()


def terms_of(items: DataFrame, item_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = [list(counted(t)) for t in texts]
            ids = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(ids)), pa.array([t for x in found for t in x], pa.binary())], names=["item_id", "term"])

    return items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(run, "item_id long, term binary").distinct()


def search(of: Index, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item as ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``."""
    wanted = materialize(terms_of(items, item_id, text), "item-terms")
    df = of.postings.select("term", "df").join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * of.n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    blocks = max(1, -(-wanted.count() // ITEM_TERMS))
    weighted = materialize(wanted.join(df, "term").select("item_id", "term", weight.alias("w"), F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")), "weights")
    found = None
    for block in range(blocks):
        # a block has some ITEM_TERMS terms, whatever the number of items
        rows: dict[int | None, list[tuple[bytes, int]]] = {}
        for r in weighted.where(F.col("block") == block).select("item_id", "term", "w").collect():
            rows.setdefault(r.item_id, []).append((bytes(r.term), r.w))
        spark = weighted.sparkSession
        needed = F.broadcast(spark.createDataFrame([(t,) for t in sorted({t for v in rows.values() for t, _ in v})], "term binary"))
        postings = of.postings.join(needed, "term", "left_semi").withColumn("ids", F.lit(None).cast("array<long>"))
        empty = [F.lit(b"").alias(c) for c in CELLS]
        names = of.documents.select("shard", F.lit(b"").alias("term"), F.lit(0).cast("long").alias("df"), *empty, "ids")
        together = postings.unionByName(names).repartition("shard").sortWithinPartitions("shard", "term")
        best = together.mapInArrow(lambda b, q=list(rows.items()): searched(b, q, k), "item_id long, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
