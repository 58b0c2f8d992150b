"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the ``k`` least distinct hashes of a text's shingles of five words (a
shorter text is one shingle, one without words has none).  Two sketches merge by
keeping the least hashes of both, so parts can be sketched apart.  With fewer than
``k`` hashes a sketch holds the whole set and every estimate is exact.

A sketch is written as the lowercase hex digits of its hashes, ascending, 16 each.
Null and empty texts have the empty sketch; two empty sketches resemble by 1.  Equal
texts have equal sketches, whatever else a row holds; repeated rows too.  Very long texts
are sketched whole.  Equal hashes count once, so there are no ties but of neighbours with one
identifier, which go by their texts.  An empty table gives no rows.  A column named like an added one is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_but, slices, small_batches

WORDS = 5
K = 128
ODD = 0x9E3779B97F4A7C15


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """One hash for each shingle from the hashes of its words, in order."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out = (out ^ words[j : n - size + 1 + j]) * np.uint64(ODD)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` least distinct hashes, ascending."""
    take = 2 * k
    while len(hashes) > take:
        least = np.unique(np.partition(hashes, take)[:take])
        if len(least) >= k:
            return least[:k]
        take *= 4
    return np.unique(hashes)[:k]


def sketch(text: str, size: int = WORDS, k: int = K) -> np.ndarray:
    return bottom(shingle_hashes(word_hashes(text.encode("utf-8", "replace").split()), size), k)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles in all shingles of both."""
    if not len(a) and not len(b):
        return 1.0
    least = merge(a, b, k)
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), least, assume_unique=True)) / len(least)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, both / distinct_count(a, k))


def written(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def read(digits: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(digits), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", size: int = WORDS, k: int = K) -> DataFrame:
    """Add the sketch of each whole text and ``n_shingles``, its estimated distinct shingle count."""
    small_batches(docs.sparkSession)
    keep = columns_but(docs, out, "n_shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            found = [sketch(t, size, k) for t in texts]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([written(x) for x in found], pa.string()), pa.array([distinct_count(x, k) for x in found], pa.float64())], names=[*keep, out, "n_shingles"])

    return docs.select(keep).mapInArrow(run, docs.select(keep).schema.add(out, "string").add("n_shingles", "double"))


def merged(sketches: DataFrame, *keys: str, sketch: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch for each key, of all texts whose sketches it has: the ``k`` least of their distinct hashes.

    Tasks pass on at most ``k`` hashes for a key, however many sketches it has.  Keys of empty
    sketches alone have the empty one; null keys are a key.
    """
    hashes = sketches.select(*keys, F.explode_outer(F.regexp_extract_all(F.coalesce(sketch, F.lit("")), F.lit("[0-9a-f]{16}"), F.lit(0))).alias("hash__")).distinct()
    least = hashes.withColumn("place__", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("hash__")))).where(F.col("place__") <= k)
    return least.groupBy(*keys).agg(F.concat_ws("", F.array_sort(F.collect_list("hash__"))).alias(sketch))


def compared(pairs: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """Add ``resemblance`` of two columns of sketches and ``containment`` of the first in the second, estimated; null sketches count as empty."""
    keep = columns_but(pairs, "resemblance", "containment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(read(x or ""), read(y or "")) for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())]
            found = [pa.array([f(x, y, k) for x, y in both], pa.float64()) for f in (resemblance, containment)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *found], names=[*keep, "resemblance", "containment"])

    return pairs.select(keep).mapInArrow(run, pairs.select(keep).schema.add("resemblance", "double").add("containment", "double"))


# -- neighbours in the order of identifiers


def edited_hashes(own: str, own_hashes: np.ndarray, other: str, other_hashes: np.ndarray, cut: int) -> tuple[str, np.ndarray]:
    """``own`` with its last ``cut`` code points replaced by the first ones of ``other``; the hashes of its words.

    Words that lie in one part whole have been hashed already.
    """
    head, tail = own[: len(own) - cut], other[:cut]
    text = head + tail
    words = text.encode("utf-8", "replace").split()
    a, b = len(head.encode("utf-8", "replace").split()), len(tail.encode("utf-8", "replace").split())
    if a < 2 or b < 3:
        return text, word_hashes(words)
    middle = words[a - 1 : len(words) - b + 1]
    return text, np.concatenate([own_hashes[: a - 1], word_hashes(middle), other_hashes[1 : b - 1], word_hashes(words[-1:])])


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, k: int = K) -> DataFrame:
    """Sketch each text, its edited text and compare both, and with the next document, in descending order of identifiers.

    The last ``floor(n/2)`` code points of a text are replaced by the first ones of the
    next document's; after the last document comes the first.  Rows with one
    identifier follow each other in the order of their texts' bytes; null identifiers
    come last.  Documents go to ranges of identifiers; the first document of the next
    range is put into both, so no task needs the order of all.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = rows.select("doc_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * n
    bounds = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)})
    top = ids.agg(F.max("doc_id")).first()[0]
    bounds = np.array([x for x in bounds if x != top], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch, texts in slices(batches):
            keys, packed = batch.column("doc_id").to_pylist(), [press(t.encode("utf-8", "replace")) for t in texts]
            out = []
            for key, z in zip(keys, packed):
                at = 0 if key is None else int(np.searchsorted(bounds, key))
                out.append((at, False, key, z))
                if key == top:
                    out.append((0, True, key, z))
                elif key is not None and at < len(bounds) and bounds[at] == key:
                    out.append((at + 1, True, key, z))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.int64(), pa.binary()))], names=["range", "extra", "doc_id", "z"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        held = None
        for batch in batches:
            out = []
            for at, extra, key, z in zip(*(batch.column(c).to_pylist() for c in ("range", "extra", "doc_id", "z"))):
                if held is None and extra:
                    continue
                own = expand(z)
                words = word_hashes(own.split())
                now = (at, key, own.decode(), words, bottom(shingle_hashes(words, size), k))
                if held and held[0] == at:
                    _, was, t, w, s = held
                    edited, e = edited_hashes(t, w, now[2], words, len(t) // 2)
                    e = bottom(shingle_hashes(e, size), k)
                    out.append((was, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(s), written(e), resemblance(s, e, k), resemblance(s, now[4], k)))
                held = None if extra else now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    dealt = rows.mapInArrow(deal, "range int, extra boolean, doc_id long, z binary")
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "extra", F.desc_nulls_last("doc_id"), "z")
    return dealt.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
