"""Rules that go from word to word: small helpers for the texts that a rule's gate lets through.

Each takes a text's words (runs of letters, digits and underscores, with places) and gives
spans from the left that don't overlap.  A null text has none; places are code points.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections.abc import Iterator

from . import lexicon as L

_WORD = re.compile(r"\w+")
Span = tuple[int, int]


class Words:
    """A text and its words."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in _WORD.finditer(text)]
        self.low = [w.lower() for w in _WORD.findall(text)]

    def __len__(self) -> int:
        return len(self.spans)

    def gap(self, i: int) -> str:
        """What stands between word ``i`` and the next."""
        return self.text[self.spans[i][1] : self.spans[i + 1][0]] if i + 1 < len(self.spans) else ""

    def at(self, place: int) -> int:
        """The first word that begins at a place or behind it."""
        return bisect_left(self.spans, (place, -1))

    def number(self, i: int, *digits: int) -> int | None:
        """The value of a word of so many decimal digits, else None."""
        if 0 <= i < len(self.low) and self.low[i].isdecimal() and len(self.low[i]) in digits:
            return int(self.low[i])
        return None


def in_turn(words: Words, end_of, at: list[int]) -> Iterator[Span]:
    """Spans from the left that begin with one of the words ``at``: ``end_of(i)`` is the number of the last word, or None."""
    done = -1
    for i in at:
        if i > done and (last := end_of(i)) is not None:
            yield words.spans[i][0], words.spans[last][1]
            done = last


def blanks(text: str, at: int) -> int:
    """The first place from here on without white space."""
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _between(value: int | None, low: int, high: int) -> bool:
    return value is not None and low <= value <= high


_NAMED = frozenset([*L.MONTHS, *L.WEEKDAYS])


def dates(words: Words) -> Iterator[Span]:
    """Day, month and year as numbers; "3 de marzo", also with a year; parts of a date; names of months and days; years of two centuries."""

    def end_of(i: int) -> int | None:
        near = lambda k, marks: len(words.gap(k)) == 1 and words.gap(k) in marks
        low, of = words.low, lambda k: k + 1 < len(words) and words.low[k + 1] == "de" and words.gap(k).isspace() and words.gap(k + 1).isspace()
        day, month = words.number(i, 1, 2), words.number(i + 1, 1, 2)
        if day is not None:
            numeric = near(i, "./-")
            if numeric and _between(day, 1, 31) and _between(month, 1, 12) and near(i + 1, "./-") and words.number(i + 2, 2, 4) is not None:
                return i + 2
            if of(i) and of(i + 2) and words.number(i + 4, 4) is not None:
                return i + 4
            if of(i) and i + 2 < len(words) and low[i + 2] in L.MONTHS:
                return i + 2
            if numeric and words.number(i, 2) is not None:
                if _between(day, 1, 31) and _between(words.number(i + 1, 2), 1, 12):
                    return i + 1
                if _between(day, 1, 12) and words.number(i + 1, 2, 3, 4) is not None:
                    return i + 1
        elif low[i] in L.MONTHS:
            return i + 1 if near(i, "/-") and words.number(i + 1, 2, 3, 4) is not None else i
        elif low[i] in L.WEEKDAYS or _between(words.number(i, 4), 1900, 2099):
            return i
        return None

    return in_turn(words, end_of, [i for i, w in enumerate(words.low) if w in _NAMED or len(w) in (1, 2, 4) and w.isdecimal()])


def ages(words: Words) -> Iterator[Span]:
    """A number of up to three digits with its unit, glued to it or one blank away."""

    def end_of(i: int) -> int | None:
        word = words.low[i]
        unit = word.lstrip("".join({c for c in word if c.isdecimal()}))
        if not 1 <= len(word) - len(unit) <= 3:
            return None
        if unit:
            return i if unit in L.AGE_UNITS else None
        blank = words.gap(i)
        return i + 1 if len(blank) == 1 and blank.isspace() and words.low[i + 1] in L.AGE_UNITS else None

    return in_turn(words, end_of, [i for i, w in enumerate(words.low) if w[0].isdecimal()])


_PHONE_STARTS = re.compile(rf"[689]|{'|'.join(map(re.escape, L.COUNTRY_CODES))}")


def phones(words: Words) -> Iterator[Span]:
    """Nine digits from 6, 8 or 9 on, single blanks, dots or hyphens between them, perhaps behind the country's code."""
    text, last = words.text, 0

    def digits(at: int, count: int) -> int | None:
        """The end of so many digits with at most one separator before each but the first."""
        for k in range(count):
            if k and at < len(text) and (text[at].isspace() or text[at] in ".-"):
                at += 1
            if at >= len(text) or not text[at].isdecimal():
                return None
            at += 1
        return at

    for m in _PHONE_STARTS.finditer(text):
        at = m.start()
        if at < last or (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            continue
        begin = at
        code = next((c for c in L.COUNTRY_CODES if text.startswith(c, at)), "")
        at += len(code)
        if code and at < len(text) and (text[at].isspace() or text[at] in ".-"):
            at += 1
        end = digits(at, 9) if text[at : at + 1] in ("6", "8", "9") else None
        if end is not None and not text[end : end + 1].isdecimal():
            yield begin, end
            last = end


_HOST = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*")
#: Where a host's label begins that no other letter, digit or underscore stands before.
_LABEL = re.compile(r"(?<!\w)[A-Za-z0-9]")
_UNBROKEN = re.compile(r"[^\s<>\"']+")


def urls(words: Words) -> Iterator[Span]:
    """What follows a scheme or "www." up to a blank, quote or angle; or a bare host with one of the listed domains."""
    text, last = words.text, 0

    def wordy(at: int) -> bool:
        return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")

    def end_of(at: int, stop: int) -> int | None:
        for lead in L.URL_LEADS:
            if text.startswith(lead, at) and (tail := _UNBROKEN.match(text, at + len(lead))):
                return tail.end()
        # the last of the host's labels that is a domain and ends where a word does
        dot = stop
        while (dot := text.rfind(".", at + 1, dot)) > 0:
            label = re.match("[A-Za-z0-9]*", text[dot + 1 : stop]).group()
            if label in L.DOMAINS and not wordy(dot + 1 + len(label)):
                return dot + 1 + len(label)
        return None

    for m in _HOST.finditer(text) if "." in text or "://" in text else ():
        begin, stop = m.span()
        if "." not in m.group() and not text.startswith("://", stop):
            continue
        for at in [m.start() for m in _LABEL.finditer(text, begin, stop)]:
            if at >= last and (end := end_of(at, stop)):
                yield at, end
                last = end


_LETTERS = string.ascii_lowercase + "ñáéíóú"
_NAME_WORD = re.compile(f"[{_LETTERS}][{_LETTERS}ü]+", re.IGNORECASE)


def doctors(words: Words) -> Iterator[Span]:
    """A title and the words of letters behind it, up to what is none; some words may not be the first."""
    text, last = words.text, 0
    for i in range(len(words) - 1):
        begin = words.spans[i][0]
        gap = words.gap(i)
        if begin < last or words.low[i] not in L.TITLES or not gap[-1].isspace():
            continue
        marks = "".join(gap.split())
        if not (marks in ("", ":", ".") or words.low[i] in L.TITLES_SHORT and gap[0] == "." and marks in ("..", ".:")):
            continue
        if words.low[i + 1] in L.NOT_AFTER_TITLE_LOW:
            continue
        word, end = _NAME_WORD.match(text, words.spans[i + 1][0]), None
        while word:
            end = word.end()
            after = blanks(text, end)
            word = _NAME_WORD.match(text, after) if after > end else None
        if end is not None:
            yield begin, end
            last = end


_STREET_NAME = re.compile(f"[{string.ascii_uppercase}ÁÉÍÓÚÜ][{string.ascii_lowercase}áéíóúüàèìòùñç]{{1,25}}")


def addresses(words: Words) -> Iterator[Span]:
    """A kind of street, words that lead on, a capitalised name, more of them behind such words, and a number."""
    text, last = words.text, 0

    def led(at: int, leads: list[str]) -> int | None:
        """Behind a lead and its blanks."""
        word = _WORD.match(text, at)
        after = blanks(text, word.end()) if word else at
        return after if word and word.group() in leads and after > word.end() else None

    def numbered(at: int) -> int:
        """The end of a number of up to four digits and a letter; ``at`` if there is none."""
        k = blanks(text, at + text.startswith(",", at))
        digits = k
        while digits < min(len(text), k + 4) and text[digits].isdecimal():
            digits += 1
        if digits == k:
            return at
        letter = blanks(text, digits)
        return letter + 1 if text[letter : letter + 1] in set(string.ascii_letters) else digits

    for i in range(len(words) - 1):
        begin, end = words.spans[i]
        kind, gap = text[begin:end], words.gap(i)
        mark = gap.rstrip() if gap[-1].isspace() else None
        known = kind in L.STREETS and mark == "" or kind in L.STREETS_SHORT and mark in ("", ".") or kind == "C" and mark in ("", ".", "/", "./")
        if begin < last or not known:
            continue
        at = words.spans[i + 1][0]
        for _ in range(2):
            at = led(at, L.STREET_LINKS) or at
        name = _STREET_NAME.match(text, at)
        if not name:
            continue
        stop = name.end()
        for _ in range(3):
            lead = blanks(text, stop)
            more = led(lead, L.STREET_LINKS + L.STREET_SAINTS) if lead > stop else None
            name = _STREET_NAME.match(text, more) if more else None
            if not name:
                break
            stop = name.end()
        last = numbered(stop)
        yield begin, last


#: Walks by the name of their rule.
WALKS = {"date": dates, "phone": phones, "url": urls, "doctor": doctors, "age": ages, "address": addresses}
