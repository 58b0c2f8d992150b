"""Best-fit packing of token sequences by minimum bin slack.

Texts are encoded and cut into pieces of at most ``capacity`` ids; full pieces are
sequences already.  The others are dealt by a hash of identifier and piece to groups of
about ``group_docs`` documents.  In a group every bin begins with the longest length
left; a subset-sum dynamic program over the lengths still available, whose states are
the bits of one number, finds the fullest combination that fits beside it, which is then
taken out.  It ends as soon as the bin can be filled exactly.  Only the last few bins of
a group have slack, so the number of groups, not the input, bounds the loss.

Null and empty texts are one piece that holds the end id alone.  Repeated rows are
packed each.  An empty table gives no rows.  Of pieces of one length in a group those with the greater identifier, piece
and checksum go first.  Very long texts are cut, never left out.  Only identifier and text are read, so other columns' names don't matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches
from .word_ids import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: its document, number, place, length and checksum."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch, texts in slices(batches):
            rows = []
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], order: list[int], room: int) -> list[int]:
    """Lengths (``order``: ascending), none oftener than ``counts`` has it, with the largest sum up to ``room``."""
    full, reach, steps = 1 << room, 1, []
    mask = (full << 1) - 1
    for k in range(bisect_right(order, room) - 1, -1, -1):
        length = order[k]
        left, part = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... of them at once
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, part = left - take, 2 * part
        if reach & full:
            break
    best, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            out += [length] * take
            best -= length * take
    return out


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in ``lengths``, each bin as full as what is left allows."""
    places: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        places.setdefault(n, []).append(i)
    counts = {n: len(p) for n, p in places.items()}
    order = sorted(counts)
    bins = []

    def take(n: int) -> None:
        counts[n] -= 1
        if not counts[n]:
            order.pop(bisect_left(order, n))

    while order:
        chosen = [order[-1]]
        take(chosen[0])
        if chosen[0] < capacity:
            chosen += fullest(counts, order, capacity - chosen[0])
        for n in chosen[1:]:
            take(n)
        bins.append([places[n].pop() for n in chosen])
    return bins


def pack(pieces: DataFrame, n_docs: int, capacity: int, group_docs: int = 8192) -> DataFrame:
    """Add ``sequence_id`` and ``offset``.  Groups are dealt by the place in the written table, so identifiers don't matter."""
    groups = max(1, -(-n_docs // group_docs))
    pieces = materialize(pieces, "pieces")  # texts are encoded once, and row numbers stay the same
    small = pieces.where(F.col("length") < capacity).withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=False, ignore_index=True)
        number, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        lengths = rows["length"].tolist()
        for k, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                number[i], offset[i] = k, at
                at += lengths[i]
        rows["sequence_id"] = (rows["group"] + 1) * (1 << 32) + number
        rows["offset"] = offset
        return rows.drop(columns="group")

    packed = small.groupBy("group").applyInPandas(work, f"{PIECES}, sequence_id long, offset long")
    # full pieces: numbers below zero, by their place in the written table
    whole = pieces.where(F.col("length") >= capacity)
    alone = whole.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)
