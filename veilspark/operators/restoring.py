"""Placeholders of many texts at a time: bent as a model's answer may bend them, and originals put back.

Texts lie behind each other in one string, a character between them that no pattern here matches.  Every bent text
is made whole and cut at its placeholders; what a form of a placeholder stands for is worked out once for each form.
Patterns say what Java's say: blanks and digits of any script, letters in any case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa

from .lexicon import OTHER_TAGS, TAGS

TAG_WORDS = "|".join(sorted({*TAGS.values(), *OTHER_TAGS}, key=lambda t: (-len(t), t)))
#: Stands between texts; a mark beside placeholders.
APART, MARK = "\0", "\1"
#: Characters that lie behind each other at a time, but for a longer text, which is alone.
MOST = 1 << 20

_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: As ``mask.PLACEHOLDER``.
_PLACEHOLDER = re.compile(rf"(?i)(\*{{0,2}}\[[{_BLANK}]*(?:{TAG_WORDS})[{_BLANK}_]*\d+(?!\d)[{_BLANK}]*\](?-i:'s|s)?\*{{0,2}})")
_TAG, _DIGITS = re.compile(f"(?ia)({TAG_WORDS})"), re.compile(r"\d+")


@lru_cache(1 << 12)
def meant(hit: str) -> str | None:
    """The placeholder that a bent one was; None for what is no placeholder."""
    if not _PLACEHOLDER.fullmatch(hit):
        return None
    tag = m.group().upper() if (m := _TAG.search(hit)) else ""
    return f"[{OTHER_TAGS.get(tag, tag)}_{_DIGITS.search(hit).group()}]"


def cut(text: str) -> tuple[list[str], dict[str, str | None]]:
    """What stands between placeholders, and each of them, in turn (``_PLACEHOLDER.split``); and what they mean.

    A placeholder has one pair of brackets.  Where all brackets are those of placeholders, marks put beside
    brackets, and moved over what belongs to them, cut the text much faster than the pattern.
    """
    n = text.count("[")
    if n == 0 or "]" not in text:
        return [text], {}
    if n == text.count("]") and MARK not in text and "***" not in text:
        marked = text.replace("[", f"{MARK}[").replace("]", f"]{MARK}")
        if f"]{MARK}'s" in marked:
            marked = marked.replace(f"]{MARK}'s", f"]'s{MARK}")
        if f"]{MARK}s" in marked:
            marked = marked.replace(f"]{MARK}s", f"]s{MARK}")
        if "*" in marked:
            # signs behind a placeholder are its own, those left before the next one are that one's
            for stars in ("**", "*"):
                marked = marked.replace(f"{MARK}{stars}", f"{stars}{MARK}")
            for stars in ("**", "*"):
                marked = marked.replace(f"{stars}{MARK}[", f"{MARK}{stars}[")
        pieces = marked.split(MARK)
        means = {h: meant(h) for h in set(pieces[1::2])}
        if None not in means.values():
            return pieces, means
    pieces = _PLACEHOLDER.split(text)
    return pieces, {h: meant(h) for h in set(pieces[1::2])}


class Masked:
    """Texts behind each other, and what their placeholders stand for: places of surfaces by row and placeholder."""

    def __init__(self, rows: range, kinds: dict[str, int], known: dict[int, str | None]):
        self.rows, self.kinds, self.known = rows, kinds, known
        self.last: tuple[list, list, list, list] = ([], [], [], [])

    def put_back(self, text: str) -> str:
        """The texts with originals in the place of placeholders; unknown ones stay."""
        pieces, means = cut(text)
        if not means:
            return text
        gaps, hits = pieces[::2], pieces[1::2]
        kind = {h: self.kinds.get(m, -1) for h, m in means.items()}
        codes = [kind[h] for h in hits]
        gaps_before, at, codes_before, found = self.last
        same = gaps == gaps_before
        if not same:
            at = list(accumulate(map(str.count, gaps, repeat(APART)), initial=self.rows.start))[1:] if len(self.rows) > 1 else [self.rows.start] * len(gaps)
        if not same or codes != codes_before or None in found:
            n = len(self.kinds)
            found = [self.known.get(k * n + c) if c >= 0 else None for k, c in zip(at, codes)]
            self.last = gaps, at, codes, found
        pieces[1::2] = [h if x is None else x for h, x in zip(hits, found)] if None in found else found
        return "".join(pieces)

    def apart(self, text: str) -> list[str]:
        return text.split(APART) if len(self.rows) > 1 else [text]


def runs(texts: list[str], odd: list[bool]) -> Iterator[range]:
    """Rows that lie behind each other: of at most ``MOST`` characters, or one; odd ones are alone."""
    first = size = 0
    for k in range(1, len(texts) + 1):
        size += len(texts[k - 1])
        if k == len(texts) or size + len(texts[k]) > MOST or odd[k] or odd[k - 1]:
            yield range(first, k)
            first, size = k, 0


def groups(texts: list[str], lists: pa.Array) -> Iterator[tuple[Masked, str, list[list[str | None]]]]:
    """Texts behind each other, with their surfaces; ``APART`` is nowhere in several texts, or in what is put in."""
    flat, ends = lists.flatten(), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
    surfaces, coded = flat.field("surface").to_numpy(zero_copy_only=False).tolist(), flat.field("placeholder").dictionary_encode()
    kinds = {p: c for c, p in enumerate(coded.dictionary.to_pylist())}
    key = np.repeat(np.arange(len(texts)), np.diff(ends)) * len(kinds) + coded.indices.fill_null(0).to_numpy()
    known, ends = dict(zip(key.tolist(), surfaces)), ends.tolist()
    if coded.null_count or len(known) < len(surfaces):
        raise ValueError("a mapping has a placeholder twice, or a null one")
    each = [surfaces[a:b] for a, b in zip(ends, ends[1:])]
    odd = [False] * len(texts)
    if any(APART in x for x in (*texts, *filter(None, surfaces))):
        odd = [any(APART in x for x in (t, *filter(None, s))) for t, s in zip(texts, each)]
    for rows in runs(texts, odd):
        part = slice(rows.start, rows.stop)
        yield Masked(rows, kinds, known), APART.join(texts[part]), each[part]


def restored(texts: list[str], lists: pa.Array) -> list[str]:
    """The texts with originals in the place of placeholders, from lists of structs with ``surface`` and ``placeholder``."""
    return [t for masked, text, _ in groups(texts, lists) for t in masked.apart(masked.put_back(text))]


def restored_alike(texts: list[str], names: dict[str, str]) -> list[str]:
    """As ``restored``, where placeholders stand for the same in all texts."""
    known, far = Masked(range(1), {p: k for k, p in enumerate(names)}, dict(enumerate(names.values()))), any(APART in x for x in names.values())
    out = []
    for rows in runs(texts, [far or APART in t for t in texts]):
        back = known.put_back(APART.join(texts[rows.start : rows.stop]))
        out += back.split(APART) if len(rows) > 1 else [back]
    return out


# -- bending

_WHOLE = re.compile(r"(\[[A-Z]+_[0-9]+\])")
_BENT = re.compile(r"\[([A-Z]+)_([0-9]+)\]")
_OTHERS = {tag: other for other, tag in OTHER_TAGS.items() if other != "OTHER"}
_OWN = re.compile(rf"\[(?:({'|'.join(_OTHERS)})|=([A-Z]+))_")

#: As ``mask.PERTURBATIONS``, for a text or for texts behind each other.  But for capitals, each changes only what a ``[`` begins.
BEND: dict[str, Callable[[str], str]] = {
    "uppercase": str.upper,
    "bold": lambda t: _BENT.sub(r"**[\1_\2]**", t),
    "lost_brackets": lambda t: _BENT.sub(r"\1_\2", t),
    "single_bracket": lambda t: _BENT.sub(r"[\1_\2", t),
    "inner_space": lambda t: _BENT.sub(r"[\1 _ \2]", t),
    "translated": lambda t: _OWN.sub(lambda m: f"[{_OTHERS.get(m[1], m[2])}_", t),
    "plural": lambda t: _BENT.sub(r"[\1_\2]s", t),
    "genitive": lambda t: _BENT.sub(r"[\1_\2]'s", t),
    "newline": lambda t: _BENT.sub(r"[\1_\n\2]", t),
}


def bent(texts: str) -> Iterator[tuple[str, str]]:
    """Name and texts of every way to bend; where nothing but placeholders has a ``[``, each of them is bent once."""
    pieces = _WHOLE.split(texts)
    hits = pieces[1::2]
    kinds = set(hits)
    alone = len(hits) == texts.count("[")
    for name, bend in BEND.items():
        if alone and bend is not str.upper:
            each = {p: bend(p) for p in kinds}
            some = pieces.copy()
            some[1::2] = [each[p] for p in hits]
            yield name, "".join(some)
        else:
            yield name, bend(texts)


def kept(texts: list[str], lists: pa.Array) -> Iterator[tuple[str, int]]:
    """For every way to bend, in how many texts all surfaces of their placeholders are there again after bending and restoring."""
    for masked, text, surfaces in groups(texts, lists):
        whole: dict[str, int] = {}
        for name, some in bent(text):
            back = masked.put_back(some)
            if back not in whole:
                whole[back] = sum(None not in x and all(map(t.__contains__, x)) for t, x in zip(masked.apart(back), surfaces))
            yield name, whole[back]
