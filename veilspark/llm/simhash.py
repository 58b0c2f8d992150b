"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A fingerprint's 64 bits are cut into 32 segments of two bits; the bit counts of the
segments are a point of a grid.  Flipping one bit moves one coordinate by one, so the
Manhattan distance of two points is a lower bound of the Hamming distance.  Points at
most 4 apart are at most 2 apart in the first or in the second 16 coordinates, and two
points at most 2 apart share a cell among their own and the cells one step away.  Each
distinct fingerprint is therefore put into its cells (at most 33 for each half); those
that meet in a cell are verified exactly on all 64 bits.

A cell hands on no more links than join its members: components stay whole, and a large
cell of near copies gives as many rows as it has members, not as many as it has pairs.
Crowded cells are split into blocks, and every pair of blocks is a group of its own.
Components are found by alternating large-star and
small-star steps on a table of links, written out after every step.

Null and empty texts, and texts of white space only, have the fingerprint 0 and link
like any other.  Exact copies share one fingerprint and count once in every cell.  An
empty table gives no rows; a null identifier joins a component without naming it unless
no member has one.  Very long texts are hashed whole, and a shingle counts as often as it occurs.  A bit with as
many ones as zeros is 0; ties of a component go to the least identifier.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, longs, materialize, slices, small_batches

SEED = 42
DISTANCE = 4
SEGMENTS = 32
#: Bits of a cell's number below its view, and below the two blocks of a split cell.
VIEW, BLOCK_A, BLOCK_B = 44, 50, 56
#: Fingerprints that a cell may get from one neighbour before it is split, in 64 blocks at most.
CELL = 2048


# -- fingerprints


def shingle_bytes(text: str, words: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by blanks, and where each shingle of so many words begins and ends."""
    parts = text.encode("utf-8", "replace").lower().split()
    joined = b" ".join(parts)
    if len(parts) <= words:
        return joined, [0] * bool(parts), [len(joined)] * bool(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) + np.arange(len(parts))
    starts = np.concatenate([[0], ends[:-1] + 1])
    return joined, starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()


def simhash(text: str, words: int) -> int:
    """Bit set if it is set in over half of the shingles' hashes; 0 without a word."""
    joined, starts, ends = shingle_bytes(text, words)
    if not starts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], "<u8")
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``, the 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            fp = np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), longs(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# -- grid


def cells(fp: np.ndarray, view: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, cell (with its view) and step (0: own cell) for each fingerprint and cell."""
    u = fp.view(np.uint64)
    pairs = (u[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)
    points = (pairs & 1) + (pairs >> np.uint64(1))
    half = SEGMENTS // 2
    weight = (np.uint64(4) ** np.arange(half, dtype=np.uint64)).astype(np.int64)
    rows, keys, steps = [], [], []
    everyone = np.arange(len(fp))
    for h in range(2):
        p = points[:, h * half : (h + 1) * half].astype(np.int64)
        own = p @ weight + (h << 40) + (view.astype(np.int64) << VIEW)
        rows.append(everyone), keys.append(own), steps.append(np.zeros(len(fp), np.int8))
        for j in range(half):
            for sign in (1, -1):
                ok = np.flatnonzero(p[:, j] < 2 if sign > 0 else p[:, j] > 0)
                rows.append(ok), keys.append(own[ok] + sign * weight[j])
                steps.append(np.full(len(ok), sign * (j + 1), np.int8))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(steps)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def forest(points: np.ndarray) -> list[tuple[int, int]]:
    """Links (member, least member) of the components of one cell's fingerprints."""
    points = np.unique(points)
    u, todo, out = points.view(np.uint64), np.ones(len(points), bool), []
    for i in range(len(points)):
        if not todo[i]:
            continue
        todo[i], front, members = False, np.array([i]), []
        while len(front):
            rest = np.flatnonzero(todo)
            if not len(rest):
                break
            hit = np.zeros(len(rest), bool)
            for f in u[front]:
                hit |= near(u[rest], f)
            front = rest[hit]
            todo[front] = False
            members.append(front)
        for m in members:
            out += [(x, int(points[i])) for x in points[m].tolist()]
    return out


def links_of(keys: np.ndarray, fp: np.ndarray, steps: np.ndarray) -> list[tuple[int, int, int]]:
    """(view, larger, smaller fingerprint) among rows in cell order; ``keys``: their cells.

    In every cell each member links to the least of those it is joined to there: one link
    a member at most, so a fingerprint gets no more links than it has cells.
    """
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([cut, [len(keys)]]))
    few = np.repeat(sizes, sizes) <= 24
    u = fp.view(np.uint64)
    pairs = []
    for d in range(1, 24):  # neighbours in cells with few members, all cells at once
        if d >= len(keys):
            break
        at = np.flatnonzero((keys[d:] == keys[:-d]) & few[d:])
        if not len(at):
            break
        # equal steps from the same cell have one own cell, where they meet too
        at = at[(steps[at + d] != steps[at]) | (steps[at] == 0)]
        at = at[near(u[at], u[at + d])]
        pairs.append((at, at + d))
    root = np.arange(len(keys))
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs))
        while len(a):  # the least row that pairs lead to; rows of a cell are in order of fingerprints
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least), np.minimum.at(root, b, least)
            root = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
    joined = np.flatnonzero(fp != fp[root])
    out = set(zip(((keys[joined] >> VIEW) & 63).tolist(), fp[joined].tolist(), fp[root[joined]].tolist()))
    for s, n in zip(cut[sizes > 24].tolist(), sizes[sizes > 24].tolist()):
        out |= {((int(keys[s]) >> VIEW) & 63, a, b) for a, b in forest(fp[s : s + n])}
    return [(v, max(a, b), min(a, b)) for v, a, b in out if a != b]


def crowded(distinct: DataFrame, most: int) -> DataFrame:
    """``cell`` and ``parts`` of cells at or beside one that is the own cell of more than ``most`` fingerprints."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("view", "fp"))
            _, key, step = cells(fp, view)
            yield pa.RecordBatch.from_arrays([pa.array(key[step == 0])], names=["cell"])

    many = distinct.select("view", "fp").mapInArrow(own, "cell long").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most)
    digit = lambda j: F.shiftrightunsigned("cell", 2 * j).bitwiseAND(F.lit(3))
    beside = [F.col("cell")]
    for j in range(SEGMENTS // 2):
        beside += [F.when(digit(j) < 2, F.col("cell") + 4**j), F.when(digit(j) > 0, F.col("cell") - 4**j)]
    around = many.select("n", F.explode(F.array(*beside)).alias("cell")).where("cell is not null")
    return around.groupBy("cell").agg(F.least(F.lit(64), F.ceil(F.sum("n") / most)).cast("int").alias("parts"))


def candidate_links(distinct: DataFrame, most: int = CELL) -> DataFrame:
    """Verified links (``view``, ``a`` > ``b``) that join the near ones among distinct fingerprints (``view``, ``fp``)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("view", "fp"))
            row, key, step = cells(fp, view)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(step)], names=["cell", "fp", "step"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)]
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "step")]
            rows = [np.concatenate(x) for x in zip(held, new)]
            last = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
            held = [x[last:] for x in rows]
            if last:
                yield edges(links_of(*(x[:last] for x in rows)))
        if len(held[0]):
            yield edges(links_of(*held))

    def edges(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), longs([x[1] for x in found]), longs([x[2] for x in found])], names=["view", "a", "b"])

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = distinct.select("view", "fp").mapInArrow(spread, "cell long, fp long, step byte")
    # a crowded cell is split into blocks; every pair of blocks is a group of its own
    split = placed.join(materialize(crowded(distinct, most), "crowded"), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    block = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("long")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<bigint>"))
    split = split.select("cell", "fp", "step", block.alias("mine"), other.alias("other"))
    group = F.col("cell") + F.shiftleft(F.least("mine", "other"), BLOCK_A) + F.shiftleft(F.greatest("mine", "other"), BLOCK_B)
    dealt = split.select(group.alias("cell"), "fp", "step").repartition(n, "cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(meet, "view int, a long, b long").distinct()


# -- components


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it is joined to) for every node of the links ``a``, ``b``; a written table."""
    spark = links.sparkSession
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        # large star: larger neighbours to the least of a node and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = materialize(small.where("a <> b").distinct(), "links")
        # done when every node has one link, to a node that has none
        stars = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
        stars = stars and new.join(new.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count() == 0
        discard(edges)
        if stars:
            out = new.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out.written_to = new.written_to
            return out
        edges = new


def near_duplicates(docs: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the least identifier that links reach from each document."""
    each = materialize(fingerprints(docs, words, doc_id, text), "fingerprints")
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(candidate_links(distinct.withColumn("view", F.lit(0))).select("a", "b"))
    known = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = known.join(named, "root").select("fp", "component_id")
    return each.join(of_fp, "fp").select("doc_id", "fp", "component_id")
