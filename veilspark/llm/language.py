"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams of one to three letters (lower case), as a
bitmap of ``BUCKETS`` hash buckets; the kernel of two texts is the number of buckets
both have over the geometric mean of what each has.  Nyström landmarks from the
training sample turn kernel values into features, on which one ridge regression is fitted for each
language against the rest.  Everything after a text's bitmap is linear, so landmarks,
whitening and regression weights are multiplied once, and texts are scored by products
of batches of bitmaps with that matrix.

The model is fitted on at most ``TRAIN_DOCS`` labelled rows, drawn by a hash of their
identifiers, evenly over languages; only their texts and languages are used.  Texts that are null or have no
letter are ``und`` with score 0.  With no labelled rows every text is ``und``.  The draw reads twice
as many rows as it keeps, at most.  Very long texts are scored whole, repeated rows alike; of languages with one score the
first by name is taken.  An empty table gives no rows, and columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_but, slices, small_batches

BUCKETS = 1 << 15
TRAIN_DOCS = 2000
LANDMARKS = 200
RIDGE = 1e-2
SHARPNESS = 4.0
BLOCK_CHARS = 1 << 20
LETTER = regex.compile(r"\p{L}")


def bitmap(text: str) -> np.ndarray:
    """Which buckets the n-grams of a whole text fall in."""
    out = np.zeros(BUCKETS, bool)
    low = text.lower()
    for at in range(0, max(1, len(low)), BLOCK_CHARS):
        c = np.frombuffer(low[at : at + BLOCK_CHARS + 2].encode("utf-32-le", "replace"), np.uint32)
        h = c * np.uint32(0x9E3779B1)
        for n in range(3):
            if n:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n:] * np.uint32(0xC2B2AE35)
            mixed = h ^ (h >> np.uint32(13))
            out[(mixed * np.uint32(0x27D4EB2F)) >> np.uint32(17)] = True
    return out


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def scores(self, bits: np.ndarray) -> np.ndarray:
        """A row of shares for each row of bitmaps."""
        size = np.sqrt(np.maximum(bits.sum(axis=1, dtype=np.int64), 1))
        margin = (bits.astype(np.float32) @ self.weights) / size[:, None]
        e = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def train(packed: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Ridge regressions on Nyström features, from packed bitmaps; rows in a fixed order give a fixed model.

    Only landmarks and a few rows at a time are unpacked: the driver holds the packed
    bits, the landmarks and one feature for each row and landmark.
    """

    def unit(rows: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(rows, axis=1).astype(np.float32)
        return bits / np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1))

    names = sorted(set(langs))
    of = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    chosen = sorted({i for n in names for i in of[n][: max(1, landmarks // len(names))]})
    marks = unit(packed[chosen])
    value, vector = np.linalg.eigh(marks @ marks.T)
    keep = value > 1e-6 * value.max()
    white = vector[:, keep] / np.sqrt(value[keep])
    feature = np.concatenate([unit(packed[k : k + 128]) @ marks.T for k in range(0, len(packed), 128)]) @ white
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # every language counts alike
    weight = np.array([1.0 / len(of[x]) for x in langs])[:, None] * len(langs) / len(names)
    solved = np.linalg.solve(feature.T @ (weight * feature) + ridge * len(langs) * np.eye(feature.shape[1]), feature.T @ (weight * target))
    return Model(names, (marks.T @ (white @ solved)).astype(np.float32))


def sample_of(docs: DataFrame, lang: str, key: str, most: int) -> DataFrame:
    """At most about ``most`` rows with a language, evenly over languages, by a hash of the key."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    each = most / max(1, len(sizes))
    share = F.coalesce(*[F.when(F.col(lang) == x, F.lit(min(1.0, each / n))) for x, n in sizes.items()], F.lit(0.0))
    picked = labelled.where(F.pmod(F.xxhash64(F.lit("language"), key), F.lit(1_000_000)) < share * 1_000_000)
    return picked


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = TRAIN_DOCS) -> Model | None:
    """Bitmaps of the sample are made by tasks; the driver gets ``BUCKETS`` bits for each of at most twice ``most`` rows."""
    small_batches(docs.sparkSession)
    rows = sample_of(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")), "lang", "key", most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            bits = [np.packbits(bitmap(t)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.string()), batch.column("lang"), pa.array(bits, pa.binary())], names=["key", "lang", "bits"])

    made = rows.mapInArrow(run, "key string, lang string, bits binary").orderBy(F.xxhash64("key"), "key", "bits").limit(2 * most).collect()
    if not made:
        return None
    return train(np.array([np.frombuffer(r.bits, np.uint8) for r in made]), [r.lang for r in made])


def predict(docs: DataFrame, model: Model | None, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the likeliest language and its share."""
    small_batches(docs.sparkSession)
    keep = columns_but(docs, out, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in slices(batches, text):
            found, sure = ["und"] * len(texts), [0.0] * len(texts)
            todo = [i for i, t in enumerate(texts) if m and LETTER.search(t)]
            for s in range(0, len(todo), 64):
                part = todo[s : s + 64]
                shares = m.scores(np.array([bitmap(texts[i]) for i in part]))
                for i, row in zip(part, shares):
                    found[i], sure[i] = m.languages[int(row.argmax())], float(row.max())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=[*keep, out, score])

    df = docs if text in keep else docs.withColumn(text, F.col(text))
    return df.mapInArrow(run, df.select(keep).schema.add(out, "string").add(score, "double"))
