"""Toxicity: a learned lexicon, misspellings by Levenshtein automata, and context windows.

The lexicon holds whole words and stems (beginnings of words) that labelled toxic texts
have and others lack.  Words and stems are tries; a word that isn't in the lexicon is run
through a Levenshtein automaton (one edit from ``FUZZY_LETTERS`` letters on, two from
``TWICE_LETTERS`` on) in step with the trie, and digits and signs that stand for letters
are put right, so "m0ron", "morn" and "wortless" are found.  Stems of ``STEM_LETTERS``
letters are found misspelled at the beginning of a word.  A form that labelled clean texts
have is no misspelling, however near it is.  Around every hit a window
of ``WINDOW`` words tells quotation (quote marks on both sides, words of reporting)
from abuse (words of address).  A logistic regression on a few counts gives the score.

Lexicon and regression are fitted on at most ``TRAIN_DOCS`` labelled rows of each class
(the bound is a parameter), drawn by a hash of the identifier.  Null and empty texts
score as texts without a hit.  Repeated rows score alike.  With no labelled rows of
either class every score is 0.  Very long texts are gone through whole; scores have no ties to break, and
forms of one count are taken or left together.  An empty table gives no rows; a column named like the score is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_but, discard, materialize, slices, small_batches

TRAIN_DOCS = 6000
FUZZY_LETTERS, STEM_LETTERS, TWICE_LETTERS = 4, 6, 10
WINDOW = 6
#: Share of toxic texts that have a word of which misspellings are looked for.
COMMON = 0.02
TABLE_PIECES = 300_000
AUTOMATON_STATES = 50_000

# Letters that digits and signs stand for, words of reporting and of address.
LEET = str.maketrans("013457@$", "oieastas")
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes reported reports word term claimed".split())
ADDRESS = frozenset("you your youre are u ur".split())
QUOTES = "\"“”«»„'‘’"
WORD = re.compile(r"[^\W\d_]+")
LEET_WORD = re.compile(r"[^\W_]*[013457@$][\w@$]*")

EXACT, FUZZY, OPENS, CLOSES, REPORTS, ADDRESSES = 1, 2, 4, 8, 16, 32
FEATURES = 7


class Automaton:
    """A Levenshtein automaton in step with a trie of words, made deterministic as it is used.

    A state is the set of trie nodes that the letters so far can have led to, each with
    the fewest edits; a step over a letter is worked out once and then kept.  With
    ``prefix`` a word is accepted as soon as its beginning is.
    """

    def __init__(self, words: list[str], edits: int, prefix: bool = False):
        self.edits, self.prefix = edits, prefix
        self.children: list[dict[str, int]] = [{}]
        self.ends: set[int] = set()
        for w in words:
            node = 0
            for c in w:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.ends.add(node)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[bool] = []
        self.start = self.number({0: 0})

    def number(self, state: dict[int, int]) -> int:
        """The number of a state with all nodes that left-out letters lead to; -1 for the dead one."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            if e < self.edits:
                for child in self.children[node].values():
                    if state.get(child, self.edits + 1) > e + 1:
                        state[child] = e + 1
                        todo.append((child, e + 1))
        if not state:
            return -1
        key = frozenset(state.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.accepts.append(any(n in self.ends for n in state))
        return self.numbers[key]

    def step(self, at: int, c: str) -> int:
        new: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.edits and new.get(node, self.edits + 1) > e:
                new[node] = e

        for node, e in self.states[at].items():
            reach(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
        self.steps[at][c] = out = self.number(new)
        return out

    def accepts_word(self, word: str) -> bool:
        if len(self.states) > AUTOMATON_STATES:
            self.clear()
        at, steps = self.start, self.steps
        for c in word:
            now = steps[at].get(c)
            at = self.step(at, c) if now is None else now
            if at < 0:
                return False
            if self.prefix and self.accepts[at]:
                return True
        return self.accepts[at]


class Lexicon:
    """Words and stems (beginnings of words), the common words that misspellings are looked for of, and near forms that clean texts have."""

    def __init__(self, words: list[str], stems: list[str], common: list[str] | None = None, clean: list[str] = ()):
        self.words, self.stems, self.clean = frozenset(words), frozenset(stems), frozenset(clean)
        self.common = frozenset(words if common is None else common)
        self.lengths = sorted({len(s) for s in stems})
        self.near = {k: Automaton(sorted(w for w in self.common if len(w) >= FUZZY_LETTERS), k) for k in (1, 2)}
        self.begins = Automaton(sorted(s for s in stems if len(s) >= STEM_LETTERS), 1, prefix=True)

    def exact(self, word: str) -> bool:
        return word in self.words or any(word[:n] in self.stems for n in self.lengths)

    def misspelled(self, word: str) -> bool:
        """Whether one edit (two in a long word) makes it a word, or its beginning a long stem."""
        if len(word) < FUZZY_LETTERS:
            return False
        return self.near[2 if len(word) >= TWICE_LETTERS else 1].accepts_word(word) or (len(word) >= STEM_LETTERS and self.begins.accepts_word(word))

    def kind(self, word: str) -> int:
        if self.exact(word):
            return EXACT
        return FUZZY if word not in self.clean and self.misspelled(word) else 0


class Pieces(dict):
    """Lower-case pieces between blanks to flags."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.old = lexicon, {}

    def __missing__(self, piece: str) -> int:
        flags = self.old.get(piece)
        if flags is None:
            flags = self.flags(piece)
        self[piece] = flags
        return flags

    def flags(self, piece: str) -> int:
        out = 0
        if piece[0] in QUOTES:
            out |= OPENS
        if piece.rstrip(".,;:!?")[-1:] in QUOTES:
            out |= CLOSES
        for word in WORD.findall(piece):
            out |= self.lexicon.kind(word)
            out |= REPORTS if word in REPORTING else ADDRESSES if word in ADDRESS else 0
        if not out & EXACT:
            for word in LEET_WORD.findall(piece):
                if (put := word.translate(LEET)).isalpha() and self.lexicon.exact(put):
                    out |= FUZZY
        return out & ~FUZZY if out & EXACT else out

    def turn(self) -> None:
        if len(self) > TABLE_PIECES:
            self.old = dict(self)
            self.clear()


def features(pieces: list[str], table: Pieces) -> list[float]:
    """Counts of a text's hits: plain, misspelled and quoted ones, addressed ones, their share, how many different ones."""
    flags = np.fromiter(map(table.__getitem__, pieces), np.uint8, len(pieces))
    hits = np.flatnonzero(flags & (EXACT | FUZZY))
    if not len(hits):
        return [0.0] * FEATURES
    plain = fuzzy = quoted = addressed = 0.0
    for i in hits.tolist():
        before, after = flags[max(0, i - WINDOW) : i + 1], flags[i : i + WINDOW + 1]
        is_quoted = bool((before & OPENS).any() and (after & CLOSES).any()) or bool((before & REPORTS).any())
        addressed += bool((flags[max(0, i - WINDOW) : i + WINDOW + 1] & ADDRESSES).any())
        if is_quoted:
            quoted += 1
        elif flags[i] & EXACT:
            plain += 1
        else:
            fuzzy += 1
    kinds = len({pieces[i].strip(".,;:!?\"'") for i in hits.tolist() if flags[i] & EXACT})
    return [math.log1p(plain), min(plain, 3.0), math.log1p(fuzzy), math.log1p(quoted), math.log1p(addressed), math.sqrt(plain / len(pieces)), math.log1p(kinds)]


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None):
        self.lexicon, self.weights = lexicon, weights

    def score(self, rows: list[list[float]]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(rows))
        x = np.array(rows, np.float64).reshape(len(rows), FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; misspelled hits are held near half of a plain one's worth."""
    x = np.hstack([np.ones((len(x), 1)), x])
    prior = np.array([0.0, 1.0, 0.5, 0.8, -0.2, 0.2, 0.0, 0.5])
    penalty = np.array([1e-3, 1, 1, 5, 5, 5, 0.1, 1]) * ridge
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * (w - prior)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def support(n_toxic: int) -> float:
    """Toxic texts of the sample that must have an entry."""
    return max(3, 0.004 * n_toxic)


def choose(rows: list[tuple[str, bool, int, int]], n_toxic: int, n_clean: int, scale: float) -> tuple[list[str], list[str]]:
    """Words and stems from (entry, is stem, toxic texts, clean texts); shorter stems stand for longer ones.

    ``scale``: clean texts that each one of the sample stands for, in terms of toxic ones.
    """

    def good(toxic: int, clean: int) -> bool:
        return toxic >= support(n_toxic) and toxic >= 4 * scale * clean

    words = {e: t for e, stem, t, c in rows if not stem and len(e) > 2 and good(t, c)}
    stems: dict[str, int] = {}
    for entry, stem, toxic, clean in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        if stem and good(toxic, clean) and not any(entry[:n] in stems for n in range(1, len(entry))):
            # the beginning of one word is no stem
            if max((t for w, t in words.items() if w.startswith(entry)), default=0) < 0.6 * toxic:
                stems[entry] = toxic
    return sorted(w for w in words if not any(w[:n] in stems for n in range(1, len(w) + 1))), sorted(stems)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", most: int = TRAIN_DOCS) -> Model:
    """Learn from ``labels`` (key and a label of 0 or 1), at most ``most`` rows of each class."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y in (0, 1)").distinct()
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return Model(Lexicon([], []), None)
    # as many as bound or class allow, by hash; the bound on rows makes the broadcast small
    share = F.when(F.col("y") == 1, min(1.0, most / total[1])).otherwise(min(1.0, most / total[0]))
    picked = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "key"), F.lit(1_000_000)) < share * 1_000_000)
    sample = materialize(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key"), "toxicity-sample")
    counts = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(Lexicon([], []), None)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    # beginnings of 4 to 8 letters; a text counts once for each
    begins = lambda w: F.transform(F.sequence(F.lit(4), F.least(F.length(w), F.lit(8))), lambda n: F.substring(w, F.lit(1), n))
    stems = F.array_distinct(F.flatten(F.transform(F.filter("words", lambda w: F.length(w) >= 4), begins)))
    marked = lambda array, stem: F.transform(array, lambda e: F.struct(e.alias("entry"), F.lit(stem).alias("stem")))
    # copies of a text say no more about its words than the text does
    once = materialize(sample.dropDuplicates(["y", "text"]), "toxicity-texts")
    texts = {r.y: r.n for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    entries = once.withColumn("words", words).select("y", F.explode(F.concat(marked("words", False), marked(stems, True))).alias("e"))
    table = materialize(entries.groupBy("e.entry", "e.stem").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")), "toxicity-entries")
    scale = (total[0] / texts[0]) / (total[1] / texts[1])
    # one toxic text in 250 has each entry, so their number is bounded by the words of 250 texts
    best = table.where((F.col("toxic") >= support(texts[1])) & (F.col("toxic") >= 4 * scale * F.col("clean")))
    rows = [tuple(r) for r in best.collect()]
    words, stems = choose(rows, texts[1], texts[0], scale)
    often = {e for e, stem, toxic, _ in rows if not stem and toxic >= COMMON * texts[1]}
    lexicon = Lexicon(words, stems, sorted(often & set(words)))
    lexicon = Lexicon(words, stems, sorted(lexicon.common), near_forms(table.where("not stem and clean > 0").select("entry"), lexicon))
    discard(table, once)
    rows = featured(sample, lexicon).select("y", "x").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    weight = np.where(y == 1, total[1] / counts[1], total[0] / counts[0])
    return Model(lexicon, logistic(x, y, weight / weight.mean()))


def near_forms(words: DataFrame, lexicon: Lexicon) -> list[str]:
    """Those of the words (of clean texts) that look like misspellings; no more than the lexicon has neighbours."""
    shared = words.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [w for w in batch.column("entry").to_pylist() if not shared.value.exact(w) and shared.value.misspelled(w)]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], names=["entry"])

    return sorted(r.entry for r in words.mapInArrow(run, "entry string").collect())


def featured(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    keep = columns_but(docs, "x", text)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(shared.value)
        for batch, texts in slices(batches, text):
            table.turn()
            x = [features(t.lower().split(), table) for t in texts]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return docs.select(*keep, text).mapInArrow(run, docs.select(keep).schema.add("x", T.ArrayType(T.DoubleType())))


def predict(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Add the score, 0 to 1; an empty text has the score of a text without a hit."""
    small_batches(docs.sparkSession)
    keep = columns_but(docs, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if not hasattr(m, "table"):
            m.table = Pieces(m.lexicon)  # stays with the worker
        for batch, texts in slices(batches, text):
            m.table.turn()
            s = m.score([features(t.lower().split(), m.table) for t in texts])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(s, pa.float64())], names=[*keep, score])

    return docs.select(keep).mapInArrow(run, docs.select(keep).schema.add(score, "double"))
