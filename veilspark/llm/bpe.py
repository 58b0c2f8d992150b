"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into segments at blanks that follow a non-blank, which no pre-token
crosses; unseen segments of a slice are encoded together.  The symbols of all their
pre-tokens lie in one flat array.  A round looks up every neighbouring pair by binary
search over the sorted pair keys, takes the lowest rank of each word and merges it.
Words over ``LONG_WORD`` symbols use a heap of pairs instead, so that one very long
word costs n log n and not a round for each merge.

Null and empty texts have no ids and decode to the empty text.  Rows are independent:
repeated rows give repeated results, empty tables give empty tables, other columns
stay as they are (an output name that clashes replaces the column).  A text that is longer than a slice is a
slice of its own, encoded whole.  Of equal pairs in a word the leftmost is merged first.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_but, slices, small_batches

LONG_WORD = 512
#: Entries after which a worker's table of segments starts anew.
CACHE_SEGMENTS = 500_000
NO_RANK = np.iinfo(np.int32).max

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space before a blank: only then are the cuts at blanks not all good ones.
BLANK_AFTER_SPACE = regex.compile(r"\s ")
CUT = regex.compile(r"(?<=\S)(?= )")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


class ByteBPE:
    """One vocabulary; ``encode`` and ``decode`` work on lists of texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        letters = byte_letters()
        self.byte_ids = np.array([vocab[x] for x in letters], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.by_pair = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.made)}
        byte_of = {x: b for b, x in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.pre_token = regex.compile(PRE_TOKEN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    # -- encoding

    def segments(self, text: str) -> list[str]:
        if BLANK_AFTER_SPACE.search(text):
            return CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.segments(t) for t in texts]
        new = set().union(*cut) - self.cache.keys()
        if len(self.cache) + len(new) > CACHE_SEGMENTS:
            self.cache = {}
            new = set().union(*cut)
        if new:
            self.learn(list(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def learn(self, segments: list[str]) -> None:
        """Encode segments and keep their ids."""
        words: dict[str, int] = {}
        plans: list[list[int]] = []  # of each segment: numbers of words, or -1 - id of special tokens
        number, find, special = words.setdefault, self.pre_token.findall, self.special
        for s in segments:
            if s[1:].isalpha() and (s[0] == " " or s[0].isalpha()):  # one pre-token
                plans.append([number(s, len(words))])
            elif any(map(s.__contains__, special)):
                plans.append([])
                for part in self.split_special.split(s):
                    plans[-1] += [-1 - special[part]] if part in special else [number(w, len(words)) for w in find(part)]
            else:
                plans.append([number(w, len(words)) for w in find(s)])
        coded = self.encode_words([w.encode("utf-8", "surrogatepass") for w in words])
        for s, plan in zip(segments, plans):
            self.cache[s] = coded[plan[0]] if len(plan) == 1 and plan[0] >= 0 else b"".join([coded[k] if k >= 0 else np.array([-1 - k], "<u4").tobytes() for k in plan])

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        short = []
        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[k] = np.array(self.merge_long(self.byte_ids[np.frombuffer(w, np.uint8)].tolist()), "<u4").tobytes()
            else:
                short.append(k)
        if not short:
            return out
        sizes = np.array([len(words[k]) for k in short])
        sym = self.byte_ids[np.frombuffer(b"".join([words[k] for k in short]), np.uint8)]
        number, rank, made = np.array(short), np.full(len(sym), NO_RANK, np.int32), np.zeros(len(sym), np.int64)
        last = np.zeros(len(sym), bool)  # of its word
        last[np.cumsum(sizes) - 1] = True
        look = np.flatnonzero(~last)
        while len(sizes):
            self.look_up(sym, look, rank, made)
            ends = np.cumsum(sizes)
            best = np.minimum.reduceat(rank, ends - sizes)
            done = best == NO_RANK
            if done.any():  # words without a pair left
                raw = sym.astype("<u4").tobytes()
                for k, s, e in zip(number[done].tolist(), (4 * (ends - sizes))[done].tolist(), (4 * ends)[done].tolist()):
                    out[k] = raw[s:e]
                stay = np.repeat(~done, sizes)
                sym, rank, made, last = sym[stay], rank[stay], made[stay], last[stay]
                sizes, number, best = sizes[~done], number[~done], best[~done]
                if not len(sizes):
                    break
            sym, rank, made, last, sizes, look = self.merge(sym, rank, made, last, sizes, best)
        return out

    def look_up(self, sym: np.ndarray, look: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """Rank and product of the pairs that begin at ``look``."""
        key = sym[look] << 32 | sym[look + 1]
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        rank[look] = np.where(hit, self.ranks[at], NO_RANK)
        made[look] = self.made[at]

    @staticmethod
    def merge(sym, rank, made, last, sizes, best):
        """Merge the lowest pair of each word, all its occurrences; ``look``: where pairs are new."""
        pos = np.flatnonzero(rank == np.repeat(best, sizes))
        # of neighbouring occurrences ("aa" in "aaa") every second one counts
        fresh = np.ones(len(pos), bool)
        fresh[1:] = pos[1:] != pos[:-1] + 1
        run = pos[fresh][np.cumsum(fresh) - 1]
        pos = pos[(pos - run) % 2 == 0]
        word = np.repeat(np.arange(len(sizes)), sizes)
        sizes = sizes - np.bincount(word[pos], minlength=len(sizes))
        sym[pos] = made[pos]
        last[pos] = last[pos + 1]
        stay = np.ones(len(sym), bool)
        stay[pos + 1] = False
        new = pos - np.arange(len(pos))  # their places once the right halves are gone
        sym, rank, made, last = sym[stay], rank[stay], made[stay], last[stay]
        rank[new[last[new]]] = NO_RANK
        around = np.zeros(len(sym), bool)
        around[new] = around[new[new > 0] - 1] = True
        return sym, rank, made, last, sizes, np.flatnonzero(around & ~last)

    def merge_long(self, ids: list[int]) -> list[int]:
        """Merges of one long word by a heap of (rank, place)."""
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.by_pair.get(ids[i] << 32 | ids[j])):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        heap: list[tuple[int, int, int, int, int]] = []
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x, ok in zip(ids, alive) if ok]

    # -- decoding

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBPE:
    return ByteBPE(path)


def _mapped(df: DataFrame, made: dict[str, T.DataType], work) -> DataFrame:
    """``df`` with the columns ``made``, which ``work`` gives for each part of a batch."""
    small_batches(df.sparkSession)
    keep = columns_but(df, *made)
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(c, t) for c, t in made.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, columns in work(batches):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, names=[*keep, *made])

    return df.mapInArrow(run, schema)


def encode_text(df: DataFrame, path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` of each whole text."""

    def work(batches):
        bpe = vocabulary(path)
        for batch, texts in slices(batches, text):
            coded = bpe.encode(texts)
            yield batch, [pa.array(coded, pa.binary()), pa.array([len(c) // 4 for c in coded], pa.int64())]

    return _mapped(df, {ids: T.BinaryType(), n_tokens: T.LongType()}, work)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each row's ids; null ids give the empty text."""

    def work(batches):
        bpe = vocabulary(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                yield batch, [pa.array([bpe.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.string())]

    return _mapped(df, {text: T.StringType()}, work)


def ids_as_array(ids):
    """SQL view of binary ids as an array of longs."""
    at = F.sequence(F.lit(0), (F.length(ids) / 4).cast("int") - 1)
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + (k + 1), F.lit(1))), 16, 10).cast("long")
    return F.when(F.length(ids) > 0, F.transform(at, lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216)).otherwise(F.array().cast("array<bigint>"))
