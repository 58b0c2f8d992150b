"""One document of each group of near copies, by whole sets of five-word shingles.

Texts link if the Jaccard similarity of their shingle sets is 0.8 or more, counted on the
whole sets; groups are components of links.  What is counted comes from three searches,
each of which hands on at most one pair for each text:

* SimHash fingerprints of the sets that differ in 4 bits or fewer, by the segment-popcount
  grid of ``simhash`` (equal fingerprints among them);
* the text of a bucket that shares the most with the others.  Buckets are the 20 least
  hashes of a set, its three most frequent ones left out;
* the rest: texts that those links leave apart meet by bands of their signatures, 21 of six
  bytes.  All in a bucket of at most ``MOST`` are compared.  A greater bucket is split by
  the signature's next bands until it is small, so a phrase that any number of
  texts share brings no more of them together; those that agree in ``DEEP`` bands are all
  compared with the least of them.  A text has one row a band, whatever the groups' sizes.

SimHash alone can't give right results here: at 0.8 fingerprints are some ten bits apart.
Of two sets that are 0.8 alike 2 in 1,000 agree in no band and 2 in 10,000 in fewer than 86 of 128
signature bytes; most of these are linked by the first two searches or by way of a third text.

Null, empty and white-space texts are one set.  Of equal identifiers and texts (rows that
are repeated) one row stays; with ties the least identifier, null first, then the least
hash of the text.  Columns beside identifier and text come along whatever their names.
Very long texts are sets like others.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, longs, materialize, slices, small_batches
from .simhash import SEED, candidate_links, components
from .sketch import shingle_hashes, word_hashes

#: Words of a shingle, and least hashes of a text's shingles that pairs are looked for by.
WORDS, LOW = 5, 20
#: Sets that are 0.8 alike share more than so many of their ``LOW`` hashes.
SPARED = 3
#: Bytes of a signature, and how many of them must agree.
SIGNS, AGREE = 128, 86
#: Bands of a signature and their bytes: of two sets that are 0.8 alike, 998 in 1,000 agree in one.
BANDS, BAND = 21, 6
#: Members of a bucket that are compared with each other, and bands by which greater ones are split.
MOST, DEEP = 32, 6
#: Members of a greater bucket that meet as many others in a task, and about how many shingles they have in all.
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
_MIX = np.random.default_rng(SEED).integers(0, 2**63, (2, SIGNS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    return np.unique(shingle_hashes(word_hashes(text.encode("utf-8", "replace").lower().split()), WORDS))


def signature(hashes: np.ndarray) -> bytes:
    """The last bytes of the least hashes under ``SIGNS`` orders: as many agree as the sets are alike."""
    least = np.full(SIGNS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[k : k + 4096, None] ^ _MIX[0]) * _MIX[1]).min(axis=0))
    return least.astype(np.uint8).tobytes()


def majority(hashes: np.ndarray) -> int:
    """The SimHash of a set: bit set if it is set in over half of the hashes; as a signed long."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def sketches(keyed: DataFrame) -> DataFrame:
    """Of ``doc_id``, ``h``, ``text``: the set's digest ``unit``, its size ``n``, ``fp``, ``low`` and ``sign``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        for batch, texts in slices(batches):
            found = []
            for t in texts:
                x = shingle_set(t)
                found.append((xxhash.xxh64_intdigest(x.tobytes(), SEED) - 2**63, len(x), majority(x), x[:LOW].view(np.int64), signature(x)))
            made = [pa.array(x, t) for x, t in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *made], names=["doc_id", "h", "unit", "n", "fp", "low", "sign"])

    return keyed.mapInArrow(run, "doc_id long, h long, unit long, n int, fp long, low array<long>, sign binary")


def sets_of(keyed: DataFrame, units: DataFrame, wanted: DataFrame) -> DataFrame:
    """``unit`` and ``shingles`` (the whole set) of the ``wanted`` units, from the text of their first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            made = pa.array([shingle_set(t).view(np.int64) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("unit"), made], names=["unit", "shingles"])

    first = units.join(wanted, "unit", "left_semi").select("unit", F.col("least.doc_id").alias("first_id"), F.col("least.h").alias("first_h"))
    rows = keyed.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
    return rows.select("unit", "text").mapInArrow(run, "unit long, shingles array<long>").dropDuplicates(["unit"])


def buckets(units: DataFrame) -> DataFrame:
    """``unit``, ``key`` and ``members`` of the key: a text's least hashes without its ``SPARED`` most frequent ones.

    Of more than ``SPARED`` common hashes the rarest is none of either text's most
    frequent ones, so the pair meets there.  Hashes of one text only are left out.
    """
    placed = units.select("unit", F.explode("low").alias("key"))
    many = placed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    order = Window.partitionBy("unit").orderBy(F.desc("members"), F.desc("key"))
    return placed.join(many, "key").withColumn("place", F.row_number().over(order)).where(F.col("place") > SPARED).select("unit", "key", "members")


def simhash_pairs(units: DataFrame) -> DataFrame:
    """For each unit at most one (``a``, ``b``) with an equal fingerprint, or one at most 4 bits away."""
    fps = materialize(units.groupBy("fp").agg(F.min("unit").alias("unit")), "fps")
    links = candidate_links(fps.select(F.lit(0).alias("view"), "fp")).groupBy("a").agg(F.min("b").alias("b"))
    of = lambda c: fps.select(F.col("fp").alias(c), F.col("unit").alias(f"unit_{c}"))
    near = links.join(of("a"), "a").join(of("b"), "b").select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b"))
    equal = units.join(fps.select("fp", F.col("unit").alias("b")), "fp").where("unit <> b").select(F.col("unit").alias("a"), "b")
    out = materialize(near.unionByName(equal), "simhash-pairs")
    discard(fps)
    return out


def hub_pairs(placed: DataFrame) -> DataFrame:
    """For each unit at most one (``a``, ``b``): the hub of most of its buckets.

    A bucket's hub is the member whose buckets have the most members: among copies that
    were edited here and there that is the one that was edited least.
    """
    weight = placed.groupBy("unit").agg(F.sum("members").alias("weight"))
    hubs = placed.join(weight, "unit").groupBy("key").agg(F.max(F.struct("weight", "unit"))["unit"].alias("hub"))
    shared = placed.join(hubs, "key").where("unit <> hub").groupBy("unit", "hub").agg(F.count("*").alias("n"))
    best = shared.where(F.col("n") > SPARED).groupBy("unit").agg(F.max(F.struct("n", "hub"))["hub"].alias("b"))
    return best.select(F.col("unit").alias("a"), "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of which the sets are 0.8 alike or more: common ones to all, counted."""
    of = lambda c: sets.select(F.col("unit").alias(c), F.col("shingles").alias(f"of_{c}"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(9 * common >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def in_bands(rooted: DataFrame) -> DataFrame:
    """A row for each unit and band of its signature: ``unit``, ``root``, ``band``, ``bucket``."""
    keys = F.array(*[F.xxhash64(F.lit(j), F.substring("sign", j * BAND + 1, BAND)) for j in range(BANDS)])
    return rooted.select("unit", "root", F.posexplode(keys).alias("band", "bucket"))


def dealt(rooted: DataFrame, most: int = MOST) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """Units with different roots that meet: rows (``bucket``, ``unit``) of buckets of at most ``most``, pairs (``a``, ``b``), and the written tables that both read.

    Of the buckets with more members than that, each is split by the signature's next bands, until it
    is small.  Units that agree in all ``DEEP`` bands are pairs with the least one of them.
    """
    rows, small, written = in_bands(rooted), [], []
    for depth in range(1, DEEP + 1):
        several = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("unit").alias("hub")).where("low < high").drop("low", "high")
        rows = materialize(rows.join(several, "bucket"), "dealt")
        written.append(rows)
        small.append(rows.where(F.col("members") <= most).select("bucket", "unit"))
        rows = rows.where(F.col("members") > most)
        if depth == DEEP or not rows.limit(1).count():
            return small, rows.where("unit <> hub").select(F.col("unit").alias("a"), F.col("hub").alias("b")).distinct(), written
        at = (F.col("band") + depth) % BANDS
        rows = rows.join(rooted.select("unit", "sign"), "unit").select("unit", "root", "band", F.xxhash64("bucket", F.substring("sign", at * BAND + 1, F.lit(BAND))).alias("bucket"))


def crowded(dealt_first: DataFrame, rooted: DataFrame, roots: DataFrame, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Rows for ``lookalikes``: every two units of a bucket of more than ``most`` that have different roots by now meet in one of its pairs of blocks.

    ``dealt_first``: buckets of single bands, as ``dealt`` writes them.  Of two units with different roots one hasn't
    the bucket's most frequent root: blocks of those meet blocks of all, so what is left of a group that is joined costs
    its rows times the bucket's, not the bucket's square.  A task holds two blocks.
    """
    now = rooted.drop("root").join(roots, F.col("unit") == F.col("node"), "left").select("unit", F.coalesce("root", "unit").alias("root"), "n", "sign")
    rows = dealt_first.where(F.col("members") > most).select("bucket", "unit").join(now, "unit")
    sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.sum("n").alias("w")).groupBy("bucket").agg(F.max(F.struct("k", "root", "w")).alias("main"), F.sum("k").alias("members"), F.sum("w").alias("shingles"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda members, shingles: F.greatest(F.ceil(members / block), F.ceil(shingles / BLOCK_SHINGLES)).cast("long")
    few = blocks(F.col("members") - F.col("main.k"), F.col("shingles") - F.col("main.w"))
    sizes = sizes.select("bucket", F.col("main.root").alias("main"), few.alias("few"), blocks(F.col("members"), F.col("shingles")).alias("all"))
    rows = rows.join(sizes, "bucket")
    place = lambda count: F.pmod(F.xxhash64("unit"), F.col(count))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    met_by = rows.where("root <> main").withColumn("i", place("few")).withColumn("j", each("all"))
    meeting = met_by.unionByName(rows.withColumn("j", place("all")).withColumn("i", each("few")).select(met_by.columns))
    return meeting.select(F.xxhash64("bucket", "i", "j").alias("bucket"), "unit", "root", "n", "sign").distinct()


def by_bucket(batches: Iterator[pa.RecordBatch], work: Callable[[list], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Runs ``work`` on the columns (lists of arrays, or of Python values) of each bucket; rows come sorted by the first column."""
    rest: list | None = None

    def made(rows: list) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]])).tolist()
        out: set[tuple[int, int]] = set()
        for s, e in zip(cut, [*cut[1:], len(rows[0])]):
            if e - s > 1:
                out.update(work([x[s:e] for x in rows[1:]]))
        return pa.RecordBatch.from_arrays([longs([x[0] for x in out]), longs([x[1] for x in out])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_pylist() if pa.types.is_binary(c.type) else list(map(np.asarray, c.to_numpy(zero_copy_only=False))) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = [np.concatenate([a, b]) if isinstance(a, np.ndarray) else a + b for a, b in zip(rest, new)] if rest else new
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        rest = [x[last:] for x in rows]
        if last:
            yield made([x[:last] for x in rows])
    if rest:
        yield made(rest)


def alike(n: np.ndarray, root: np.ndarray, sign: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the later ones (rows ascend in ``n``) that may be 0.8 alike by signature and have another root."""
    ends = np.searchsorted(n, n * 5 // 4, "right")
    for i, end in enumerate(ends.tolist()):
        later = i + 1 + np.flatnonzero(root[i + 1 : end] != root[i])
        if len(later):
            same = (sign[later] == sign[i]).sum(axis=1)
            if len(hit := later[same >= AGREE]):
                yield i, hit


def lookalikes(rows: list) -> list[tuple[int, int]]:
    """Pairs of a bucket's units that have different roots and look alike, the greater first."""
    unit, root, n, sign = rows
    sign = np.frombuffer(b"".join(sign), np.uint8).reshape(-1, SIGNS)
    return [(max(u, v), min(u, v)) for i, hit in alike(n, root, sign) for u, v in zip([int(unit[i])] * len(hit), unit[hit].tolist())]


def hopeful(rows: list) -> list[tuple[int, int]]:
    """A bucket's key and each of its units that looks like another one with a different root: a row a unit, however many it looks like."""
    key, unit, root, n, sign = rows
    sign = np.frombuffer(b"".join(sign), np.uint8).reshape(-1, SIGNS)
    found = np.zeros(len(unit), bool)
    for i, hit in alike(n, root, sign):
        found[i] = found[hit] = True
    return list(zip(key[found].tolist(), unit[found].tolist()))


def joined(rows: list) -> list[tuple[int, int]]:
    """Links, the greater first, that join those of a bucket's units whose whole sets are alike and that look alike.

    Every pair of different roots is compared; roots that a link has joined are one from there on, so
    links are fewer than units.
    """
    unit, root, n, sign, sets = rows
    sign, root, out = np.frombuffer(b"".join(sign), np.uint8).reshape(-1, SIGNS), root.copy(), []
    sizes = np.array([len(x) for x in sets], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    has = np.zeros(len(ids), bool)
    for i, hit in alike(n, root, sign):
        mine = ids[first[i] : first[i + 1]]
        has[mine] = True
        low, high = int(hit[0]), int(hit[-1]) + 1
        if 4 * len(hit) >= high - low:
            common = np.add.reduceat(has[ids[first[low] : first[high]]], first[low:high] - first[low], dtype=np.int64)[hit - low]
        else:
            common = np.array([np.count_nonzero(has[ids[first[j] : first[j + 1]]]) for j in hit.tolist()])
        for j in hit[9 * common >= 4 * (sizes[i] + sizes[hit])].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((int(max(unit[i], unit[j])), int(min(unit[i], unit[j]))))
        has[mine] = False
    return out


def met(rows: DataFrame, columns: list[str], work: Callable) -> DataFrame:
    """Links (``a``, ``b``) that ``work`` finds in the buckets of ``rows``."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meeting = rows.select("bucket", *columns).repartition(tasks, "bucket").sortWithinPartitions("bucket", "n", "unit")
    return meeting.mapInArrow(lambda batches: by_bucket(batches, work), "a long, b long").distinct()


def linked(docs: DataFrame, units: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Those of the pairs whose whole sets are alike, written."""
    pairs = materialize(found.distinct(), "pairs")
    sets = materialize(sets_of(docs, units, pairs.select(F.explode(F.array("a", "b")).alias("unit")).distinct()), "sets")
    out = materialize(verified(pairs, sets), name)
    discard(sets, pairs)
    return out


def links_in(docs: DataFrame, units: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Links between the units that meet in the buckets of ``rows`` and are alike, written: whole sets are compared where the bucket is.

    No pair is a row: a bucket has a row for each unit that looks like another, and fewer links than units.
    """
    hope = materialize(met(rows.withColumn("key", F.col("bucket")), ["key", "unit", "root", "n", "sign"], hopeful).select(F.col("a").alias("bucket"), F.col("b").alias("unit")), "hopeful")
    sets = materialize(sets_of(docs, units, hope.select("unit").distinct()), "sets")
    meeting = rows.join(hope, ["bucket", "unit"], "left_semi").join(sets, "unit")
    out = materialize(met(meeting, ["unit", "root", "n", "sign", "shingles"], joined), name)
    discard(hope, sets)
    return out


def links_between(docs: DataFrame, units: DataFrame, most: int) -> DataFrame:
    """``node`` and ``root``: units joined by links of 0.8 or more."""
    placed = materialize(buckets(units), "buckets")
    found = simhash_pairs(units)
    links = linked(docs, units, found.unionByName(hub_pairs(placed)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "near")
    discard(placed, found)
    roots = components(links)
    rooted = materialize(units.join(roots, units.unit == roots.node, "left").select("unit", F.coalesce("root", "unit").alias("root"), "n", "sign"), "rooted")
    discard(roots)
    # what these links leave apart though it looks alike
    small, pairs, written = dealt(rooted, most)
    meeting = reduce(DataFrame.unionByName, small).join(rooted, "unit")
    more = linked(docs, units, pairs, "more").unionByName(links_in(docs, units, meeting, "small"))
    if more.limit(1).count():
        links = links.unionByName(more)
    roots = components(links)
    crowds = materialize(crowded(written[0], rooted, roots, most), "crowds")
    discard(rooted, *written)
    if not crowds.limit(1).count():
        discard(crowds)
        return roots
    last = links_in(docs, units, crowds, "last")
    discard(crowds)
    if not last.limit(1).count():
        return roots
    discard(roots)
    return components(links.unionByName(last))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near copies: the least identifier (null first) stays."""
    small_batches(docs.sparkSession)
    # a row is known by its identifier and a hash of its text; a unit is a set of shingles
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    each = materialize(sketches(keyed), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("least")
    units = materialize(each.groupBy("unit").agg(least, *[F.first(c).alias(c) for c in ("n", "fp", "low", "sign")]), "units")
    roots = links_between(keyed, units, most)
    kept = units.join(roots, units.unit == roots.node, "left").groupBy(F.coalesce("root", "unit").alias("group")).agg(F.min("least").alias("least")).select("least.doc_id", "least.h")
    # of rows that are repeated whole, one
    again = each.groupBy("doc_id", "h").agg(F.count("*").alias("rows")).where("rows > 1")
    k, a = kept.alias("k"), again.alias("a")
    marked = k.join(a, F.col("k.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("k.h") == F.col("a.h")), "left").select(F.col("k.doc_id").alias("kept_id"), F.col("k.h").alias("kept_h"), F.col("a.rows").isNotNull().alias("repeated"))
    marked = materialize(marked, "kept")
    discard(each, units, roots)
    # names of their own, whatever the table's columns are called
    names = [F.col(f"d.{c}") if "." not in c else F.col(f"d.`{c}`") for c in docs.columns]
    on = F.col(f"d.{doc_id}").cast("long").eqNullSafe(F.col("m.kept_id")) & (F.xxhash64(f"d.{text}") == F.col("m.kept_h"))
    once = docs.alias("d").join(marked.where("not repeated").alias("m"), on, "left_semi").select(names)
    twice = docs.alias("d").join(marked.where("repeated").alias("m"), on, "left_semi").select(names).dropDuplicates([doc_id, text])
    return once.unionByName(twice)
