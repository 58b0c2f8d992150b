"""What the rules of the table find in plain texts, many texts at a time.

A text is plain if it has nothing but ASCII's printable characters, blanks, tabs, line ends, the letters of
Latin-1 and a few of its marks.  There a byte is a character, and words, digits and small letters are the same
for Java's patterns, Python's and the walks.  Texts lie behind each other in one string with a character
between them that no plain text has.  Where a rule's matches may begin (its anchors) follows from arrays over all
words at once.  Where the usual forms of a rule are told from the arrays, its match there follows from them too; a text
in which an anchor is left open has the rule itself tried at its anchors alone, from the left.  All other texts, and
rules that aren't in ``FINDERS``, go the way of ``detect``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from . import lexicon as L
from . import walks
from .rules import CHECKS, RULES, Rule

_PLAIN = re.compile(r"[\t\n\r\x20-\x7E¡«°·»¿À-ÖØ-öø-ÿ]")
#: A character that makes a text one that isn't plain; for Java and Python alike.  Each plain one is written out: Java looks
#: those up in one table, while ranges are a chain of tests for every character.
FAR = "[^" + "".join(f"\\x{k:02X}" for k in range(256) if _PLAIN.match(chr(k))) + "]"
#: Characters that lie behind each other at a time, but for a longer text, which is alone.
MOST = 1 << 20

_BYTES = bytes(range(256)).decode("latin-1")
_WORD = np.array([c.isalnum() or c == "_" for c in _BYTES])
_LOW = np.array([ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 256 else ord(c) for c in _BYTES], np.int64)
_of = lambda chars: np.isin(np.arange(256), [ord(c) for c in chars])
_DIGIT, _BLANK, _MARK, _SIGN, _HIGH = _of("0123456789"), _of("\t\n\r "), _of("./-"), _of(".-\t\n\r "), _of("689")
_NIE, _RECORD_FIRST, _RECORD_SECOND = _of("XYZ"), _of("hHnN"), _of("hcoHCO")
_LEAD = _of({lead[0] for lead in L.URL_LEADS})
_LETTER = np.array([c.isascii() and c.isalpha() for c in _BYTES])
_LOCAL = np.array([c.isascii() and (c.isalnum() or c in "._%+-") for c in _BYTES])
_HOST = np.array([c.isascii() and (c.isalnum() or c in ".-") for c in _BYTES])
#: Bits of a character: in a word, a digit, in an email's local part, in a host.
_IN_WORD, _IN_NUMBER, _IN_LOCAL, _IN_HOST = 1, 2, 4, 8
_KINDS = (_WORD * _IN_WORD + _DIGIT * _IN_NUMBER + _LOCAL * _IN_LOCAL + _HOST * _IN_HOST).astype(np.uint8).tobytes()

MONTH, WEEKDAY, DE, UNIT, PLACE, KIN, HOSPITAL, TITLE, STREET = (1 << k for k in range(9))


def _firsts(phrases: Iterable[str]) -> set[str]:
    return {re.match(r"\w+", p.lower()).group() for p in phrases}


def _key(word: np.ndarray | bytes) -> int:
    """What is compared of a word: three first letters, the last and the length."""
    n = len(word)
    return int(word[0]) | int(word[min(1, n - 1)]) << 8 | int(word[min(2, n - 1)]) << 16 | int(word[-1]) << 24 | n << 32


def _listed() -> tuple[np.ndarray, np.ndarray]:
    """Keys of listed words, ascending, and what they may begin."""
    bits: dict[int, int] = {}
    lists = [(MONTH, L.MONTHS), (WEEKDAY, L.WEEKDAYS), (DE, ["de"]), (UNIT, L.AGE_UNITS), (PLACE, _firsts(L.PLACES)), (KIN, _firsts(L.KINSHIP)), (HOSPITAL, _firsts(L.HOSPITALS)), (TITLE, L.TITLES), (STREET, [*L.STREETS, *L.STREETS_SHORT, "C"])]
    for bit, words in lists:
        for w in words:
            key = _key(w.lower().encode("latin-1"))
            bits[key] = bits.get(key, 0) | bit
    keys = sorted(bits)
    return np.array(keys, np.int64), np.array([bits[k] for k in keys], np.int64)


_KEYS, _BITS = _listed()
#: Keys of domains; a key tells words of up to four letters apart.
_DOMAIN_KEYS = np.array(sorted(_key(d.encode()) for d in L.DOMAINS if len(d) <= 4), np.int64)
assert all(len(u) <= 4 for u in L.AGE_UNITS)


class Texts:
    """Plain texts behind each other, and their words: where they begin and end, their digits, what stands beside them, what lists have them."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.text = "\0".join(["", *texts, "", "", ""])
        self.base = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[: len(texts)]
        raw = self.text.encode("latin-1")
        b, kinds = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(_KINDS), np.uint8)
        self.bytes, self.kinds = b, kinds
        word = kinds & _IN_WORD
        #: where words begin and end
        self.edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        self.start, self.end = s, e = self.edges[0::2], self.edges[1::2]
        self.size = e - s
        done = np.cumsum(kinds & _IN_NUMBER, dtype=np.int32) // _IN_NUMBER
        self.digits = done[e - 1] - done[s - 1]
        #: where no host goes on, and the dots
        self.stops, self.dots = np.flatnonzero(kinds & _IN_HOST == 0), np.flatnonzero(b == ord("."))
        self.number = self.digits == self.size
        #: digits of numbers of up to 15, else 0
        self.width = np.where(self.number & (self.size <= 15), self.size, 0).astype(np.uint8)
        self.first, self.last, self.before, self.after = b[s], b[e - 1], b[s - 1], b[e]
        key = _LOW[self.first] | _LOW[b[np.minimum(s + 1, e - 1)]] << 8 | _LOW[b[np.minimum(s + 2, e - 1)]] << 16 | _LOW[self.last] << 24 | self.size << 32
        at = np.minimum(np.searchsorted(_KEYS, key), len(_KEYS) - 1)
        self.listed = np.where(_KEYS[at] == key, _BITS[at], 0)

    def numbers(self, *sizes: tuple[int, int]) -> np.ndarray:
        """Words that begin a row of numbers of so many digits (least, most), one character between them."""
        at = np.flatnonzero((self.width >= sizes[0][0]) & (self.width <= sizes[0][1]))
        for k, (least, most) in enumerate(sizes[1:], 1):
            at = at[at + k < len(self.start)]
            at = at[(self.width[at + k] >= least) & (self.width[at + k] <= most) & (self.start[at + k] == self.end[at + k - 1] + 1)]
        return at

    def value(self, at: np.ndarray) -> np.ndarray:
        """Values of words that are numbers of one or two digits."""
        first, last = (self.bytes[x].astype(np.int64) - ord("0") for x in (self.start[at], self.end[at] - 1))
        return np.where(self.size[at] > 1, 10 * first, 0) + last


Spans = tuple[np.ndarray, np.ndarray]
NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def at_anchors(x: Texts, pattern: re.Pattern, anchors: np.ndarray) -> Spans:
    """Matches from the left that begin at anchors and don't overlap."""
    match, text, last, starts, ends = pattern.match, x.text, 0, [], []
    for at in anchors.tolist():
        if at >= last and (m := match(text, at)):
            last = m.end()
            starts.append(at)
            ends.append(last)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def leftmost(start: np.ndarray, end: np.ndarray) -> Spans:
    """Of matches by start those that overlap none from the left that stayed."""
    if not len(start):
        return NONE
    keep = np.concatenate([[True], start[1:] >= np.maximum.accumulate(end)[:-1]])
    heads = np.flatnonzero(keep)
    sizes = np.diff(np.append(heads, len(start)))
    # of two the first stays; more of a chain are gone through
    for k in np.flatnonzero(sizes > 2).tolist():
        last = end[heads[k]]
        for i in range(heads[k] + 1, heads[k] + sizes[k]):
            if start[i] >= last:
                keep[i], last = True, end[i]
    return start[keep], end[keep]


def known_or_tried(x: Texts, pattern: re.Pattern, anchors: np.ndarray, known: np.ndarray, ends: np.ndarray, open_at: np.ndarray) -> Spans:
    """Matches that begin at ``known`` places and have these ``ends`` (by start), but for texts with an open place: there the pattern is tried at all ``anchors``."""
    if not len(open_at):
        return leftmost(known, ends)
    tried = np.zeros(len(x.base) + 1, bool)
    tried[np.searchsorted(x.base, open_at, "right")] = True
    of = lambda places: tried[np.searchsorted(x.base, places, "right")]
    easy = ~of(known)
    return tuple(map(np.concatenate, zip(leftmost(known[easy], ends[easy]), at_anchors(x, pattern, anchors[of(anchors)]))))


def whole(x: Texts, keep: np.ndarray) -> Spans:
    return x.start[keep], x.end[keep]


_any = lambda words: "|".join(sorted(map(re.escape, set(words)), key=lambda w: (-len(w), w)))
_MONTHS = f"(?i:{_any(L.MONTHS)})"
_DATE = re.compile(
    r"(?:0?[1-9]|[12]\d|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:\d{4}|\d{2})(?!\w)"
    r"|\d{1,2}\s+(?i:de)\s+\w+\s+(?i:de)\s+\d{4}(?!\w)"
    rf"|\d{{1,2}}\s+(?i:de)\s+{_MONTHS}(?!\w)"
    r"|(?:0[1-9]|[12]\d|3[01])[./-](?:0[1-9]|1[0-2])(?!\w)"
    r"|(?:0[1-9]|1[0-2])[./-]\d{2,4}(?!\w)"
    rf"|{_MONTHS}(?!\w)(?:[/-]\d{{2,4}}(?!\w))?"
    rf"|(?:(?i:{_any(L.WEEKDAYS)})|19\d\d|20\d\d)(?!\w)"
)
_AGE = re.compile(rf"\d{{1,3}}\s?(?i:{_any(L.AGE_UNITS)})(?!\w)")
_PHONE = re.compile(rf"(?<!\w)(?:(?:{_any(L.COUNTRY_CODES)})[\s.-]?)?[689](?:[\s.-]?\d){{8}}(?!\d)")
assert all(c.startswith(("+", "00")) for c in L.COUNTRY_CODES)
_URL = re.compile(rf"(?:{'|'.join(map(re.escape, L.URL_LEADS))})[^\s<>\"'\0]+|[A-Za-z0-9][A-Za-z0-9.-]*\.(?:{_any(L.DOMAINS)})(?!\w)")


def dates(x: Texts) -> Spans:
    """Numbers with marks between them and years are known, names of months and days and "3 de" are tried."""
    at = np.flatnonzero((x.width == 1) | (x.width == 2))
    at = at[at + 1 < len(x.start)]
    marked = at[_MARK[x.after[at]] & (x.start[at + 1] == x.end[at] + 1) & _DIGIT[x.first[at + 1]]]
    spelled = at[_BLANK[x.after[at]] & (x.listed[at + 1] & DE > 0)]
    day, wide, second = x.value(marked), x.width[marked] == 2, x.width[marked + 1]
    month = np.where((second == 1) | (second == 2), x.value(marked + 1), 0)
    third = np.minimum(marked + 2, len(x.start) - 1)
    beside = (marked + 2 < len(x.start)) & _MARK[x.after[marked + 1]] & (x.start[third] == x.end[marked + 1] + 1)
    in_days, in_months = (day >= 1) & (day <= 31), (month >= 1) & (month <= 12)
    full = in_days & in_months & beside & ((x.width[third] == 2) | (x.width[third] == 4))
    short = wide & (in_days & in_months & (second == 2) | (day >= 1) & (day <= 12) & (second >= 2) & (second <= 4))
    lead = x.bytes[x.start + 1]
    year = (x.width == 4) & ((x.first == ord("1")) & (lead == ord("9")) | (x.first == ord("2")) & (lead == ord("0")))
    known = np.where(year, x.end, 0)
    known[marked] = np.where(full, x.end[third], np.where(short, x.end[marked + 1], 0))
    is_open = x.listed & (MONTH | WEEKDAY) > 0
    is_open[spelled] = True
    anchors = (known > 0) | is_open
    return known_or_tried(x, _DATE, x.start[anchors], x.start[known > 0], known[known > 0], x.start[is_open])


def times(x: Texts) -> Spans:
    """Hours and minutes without seconds, blank or h behind them are known."""
    at = np.flatnonzero((x.after == ord(":")) & ((x.width == 1) | (x.width == 2)))
    at = at[at + 1 < len(x.start)]
    at = at[(x.start[at + 1] == x.end[at] + 1) & _DIGIT[x.first[at + 1]]]
    behind = x.after[at + 1]
    known = (x.width[at + 1] == 2) & (behind != ord(":")) & ~_BLANK[behind]
    return known_or_tried(x, _TIME, x.start[at], x.start[at[known]], x.end[at[known] + 1], x.start[at[~known]])


def ages(x: Texts) -> Spans:
    """Numbers with their unit behind a blank are known."""
    at = np.flatnonzero((x.width >= 1) & (x.width <= 3) & _BLANK[x.after])
    at = at[at + 1 < len(x.start)]
    at = at[(x.start[at + 1] == x.end[at] + 1) & (x.listed[at + 1] & UNIT > 0)]
    glued = np.flatnonzero(_DIGIT[x.first] & (x.digits <= 3) & ~x.number)
    anchors = np.sort(np.concatenate([at, glued])) if len(glued) else at
    return known_or_tried(x, _AGE, x.start[anchors], x.start[at], x.end[at + 1], x.start[glued])


def phones(x: Texts) -> Spans:
    """Nine digits together are known; with signs between them, or behind a country's code, they are tried."""
    b, begins = x.bytes, np.flatnonzero(_HIGH[x.first])
    long = begins[x.size[begins] >= 9]
    nine = _DIGIT[b[x.start[long][:, None] + np.arange(9)]].all(axis=1) & ~_DIGIT[b[x.start[long] + 9]]
    known = x.start[long[nine]]
    parted = begins[(x.size[begins] < 9) & _SIGN[x.after[begins]] & _DIGIT[b[x.end[begins] + 1]]]
    coded = np.flatnonzero((x.first == ord("0")) & (x.size >= 4) & (b[x.start + 1] == ord("0")))
    codes = [np.frombuffer(c.encode(), np.uint8) for c in L.COUNTRY_CODES if c.startswith("00")]
    coded = coded[np.any([(b[x.start[coded][:, None] + np.arange(len(c))] == c).all(axis=1) for c in codes], axis=0)] if len(coded) else coded
    is_open = np.concatenate([x.start[parted], x.start[coded], np.flatnonzero(b == ord("+"))])
    return known_or_tried(x, _PHONE, np.sort(np.concatenate([known, is_open])), known, known + 9, is_open)


def emails(x: Texts) -> Spans:
    """Before each @ the run of characters that may stand there; a match begins at the first end or beginning of a word in it.

    Known where letters behind the host's last dot end it and no run reaches the @ before.
    """
    b = x.bytes
    signs = np.flatnonzero(b == ord("@"))
    if not len(signs):
        return NONE
    stops = np.flatnonzero(x.kinds & _IN_LOCAL == 0)
    begin = stops[np.searchsorted(stops, signs) - 1] + 1
    edge = np.append(x.edges, len(b))
    at = edge[np.searchsorted(edge, begin)]
    behind = stops[np.searchsorted(stops, signs, "right")]
    # the last dot before what ends the run behind the sign, and whether two to four letters follow it
    dot = x.dots[np.maximum(np.searchsorted(x.dots, behind) - 1, 0)] if len(x.dots) else np.zeros(len(signs), np.int64)
    end = x.stops[np.searchsorted(x.stops, signs, "right")]
    known = (end == behind) & (dot > signs + 1) & (end - dot > 2) & (end - dot <= 5) & ~_WORD[b[end]]
    for k in range(1, 5):
        known &= _LETTER[b[np.clip(end - k, 0, None)]] | (end - k <= dot)
    linked = np.concatenate([begin[1:] == signs[:-1] + 1, [False]])
    linked[1:] |= linked[:-1]
    known &= ~linked
    match, text, last, starts, ends = _EMAIL.match, x.text, 0, [], []
    for sign, run, place in zip(signs[~known].tolist(), begin[~known].tolist(), at[~known].tolist()):
        if place < last:
            place = int(edge[np.searchsorted(edge, max(run, last))])
        if place < sign and (m := match(text, place)):
            last = m.end()
            starts.append(place)
            ends.append(last)
    known &= at < signs
    return np.concatenate([at[known], np.array(starts, np.int64)]), np.concatenate([end[known], np.array(ends, np.int64)])


def urls(x: Texts) -> Spans:
    """Hosts with a dot before a letter or behind a w, or with a scheme's sign behind them; known where the last label is a domain and no scheme may begin."""
    b = x.bytes
    every, stops = x.dots, x.stops
    dots = every[_LETTER[b[every + 1]] | (b[every - 1] == ord("w"))]
    slashes = np.flatnonzero(b == ord("/"))
    slashes = slashes[(b[slashes - 1] == ord(":")) & (b[slashes + 1] == ord("/"))] - 2
    hosts = np.unique(np.searchsorted(stops, np.concatenate([dots, slashes])))
    # a host's first word
    end = stops[hosts]
    word = np.searchsorted(x.start, np.where(hosts > 0, stops[hosts - 1] + 1, 0))
    some = word < len(x.start)
    some[some] = x.start[word[some]] < end[some]
    hosts, end, first = hosts[some], end[some], x.start[word[some]]
    if not len(first):
        return NONE
    dot = every[np.maximum(np.searchsorted(every, end) - 1, 0)] if len(every) else np.zeros(len(end), np.int64)
    long = end - dot - 1
    key = b[np.minimum(dot + 1, len(b) - 1)].astype(np.int64)
    for k, place in ((8, np.minimum(dot + 2, end - 1)), (16, np.minimum(dot + 3, end - 1)), (24, end - 1)):
        key |= b[place].astype(np.int64) << k
    known = (dot > first) & (long >= 1) & np.isin(key | long << 32, _DOMAIN_KEYS) & ~_WORD[b[end]] & ~_LEAD[b[first]]
    anchors = x.start if known.all() else x.start[np.isin(np.searchsorted(stops, x.start), hosts)]
    return known_or_tried(x, _URL, anchors, first[known], end[known], first[~known])


def records(x: Texts) -> Spans:
    return at_anchors(x, _RECORD, x.start[_RECORD_FIRST[x.first] & _RECORD_SECOND[x.bytes[x.start + 1]]])


def plain(x: Texts) -> Spans:
    keep = np.flatnonzero((x.width >= 6) & (x.width <= 10))
    return x.start[keep] - (x.before[keep] == ord("(")), x.end[keep] + (x.after[keep] == ord(")"))


def walk(of: Callable, bit: int) -> Callable[[Texts], Spans]:
    """A walk over the words of those texts that have one of a list."""

    def found(x: Texts) -> Spans:
        rows = np.unique(np.searchsorted(x.base, x.start[x.listed & bit > 0], "right") - 1).tolist()
        spans = [(s + base, e + base) for k in rows for base in [int(x.base[k])] for s, e in of(walks.Words(x.texts[k]))]
        return tuple(np.array(spans, np.int64).T) if spans else NONE

    return found


_RULE = {r.name: r for r in RULES}
_python = lambda name: re.compile(_RULE[name].pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("(?iu:", "(?i:"))
_TIME, _EMAIL, _RECORD = _python("time"), _python("email"), _python("nhc_labeled")
_PLACE, _KIN, _HOSPITAL, _SS, _CIP, _NHC5, _NHC8 = map(_python, ("location", "family_relation", "hospital", "ss", "cip", "nhc_22_5", "nhc_2_8_2"))
_listed_at = lambda pattern, bit: lambda x: at_anchors(x, pattern, x.start[x.listed & bit > 0])


def identity(x: Texts) -> Spans:
    return whole(x, (x.size == 9) & (x.digits == 8) & _LETTER[x.last])


def foreign(x: Texts) -> Spans:
    return whole(x, (x.size == 9) & (x.digits == 7) & _NIE[x.first] & _LETTER[x.last])


_LETTERS = np.frombuffer(L.CHECK_LETTERS.lower().encode(), np.uint8)


def lettered(x: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the letter behind eight digits, or X, Y or Z for the first of them, is that of their remainder by 23."""
    digits = x.bytes[start[:, None] + np.arange(8)].astype(np.int64) - ord("0")
    digits[:, 0] -= np.where(digits[:, 0] > 9, ord("X") - ord("0"), 0)
    return _LETTERS[digits @ 10 ** np.arange(7, -1, -1) % 23] == _LOW[x.bytes[start + 8]]


def no_phone(x: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether numbers, perhaps in brackets, aren't nine digits from 6, 8 or 9 on."""
    begin, stop = start + (x.bytes[start] == ord("(")), end - (x.bytes[end - 1] == ord(")"))
    return (stop - begin != 9) | ~_HIGH[x.bytes[begin]]


#: Checks of many matches at once, by name.
CHECKED = {"dni": lettered, "nie": lettered, "plain": no_phone}


#: What finds a rule's matches in plain texts.
FINDERS: dict[Rule, Callable[[Texts], Spans]] = {
    _RULE[name]: f
    for name, f in {
        "date": dates,
        "time": times,
        "phone": phones,
        "email": emails,
        "url": urls,
        "doctor": walk(walks.doctors, TITLE),
        "age": ages,
        "location": _listed_at(_PLACE, PLACE),
        "address": walk(walks.addresses, STREET),
        "family_relation": _listed_at(_KIN, KIN),
        "hospital": _listed_at(_HOSPITAL, HOSPITAL),
        "dni": identity,
        "nie": foreign,
        "ss": lambda x: at_anchors(x, _SS, x.start[x.numbers((2, 2), (8, 8))]),
        "cip": lambda x: at_anchors(x, _CIP, x.start[(x.size == 14) & (x.digits == 10)]),
        "nhc_labeled": records,
        "nhc_22_5": lambda x: at_anchors(x, _NHC5, x.start[x.numbers((2, 2), (2, 2), (5, 5))]),
        "nhc_2_8_2": lambda x: at_anchors(x, _NHC8, x.start[x.numbers((2, 2), (7, 8))]),
        "plain": plain,
    }.items()
}


def parts(texts: list[str | None]) -> Iterator[list[int]]:
    """Places of texts in groups of at most ``MOST`` characters, or of one."""
    group, size = [], 0
    for k, t in enumerate(texts):
        if t:
            if group and size + len(t) > MOST:
                yield group
                group, size = [], 0
            group.append(k)
            size += len(t)
    if group:
        yield group


def ordered(spans: np.ndarray) -> np.ndarray:
    """Row, rule, start and end (by columns) in this order."""
    row, rule, start, end = spans
    width, rules = (int(v.max(initial=0)) + 1 for v in (end, rule))
    return spans[:, np.argsort((row * rules + rule) * width + start, kind="stable")]


def found(texts: list[str | None], finders: list[tuple[int, Callable[[Texts], Spans], str | None]]) -> np.ndarray:
    """Row, rule, start and end of the matches in plain texts (None: another's), by columns; finders have their rule's place and the name of its check."""
    out = [np.zeros((4, 0), np.int64)]
    for group in parts(texts):
        x = Texts([texts[k] for k in group])
        if not len(x.start):
            continue
        rows = np.array(group)
        for i, find, check in finders:
            start, end = find(x)
            if check and len(start):
                many = CHECKED.get(check)
                good = many(x, start, end) if many else np.array([CHECKS[check](x.text[s:e]) for s, e in zip(start.tolist(), end.tolist())])
                start, end = start[good], end[good]
            if len(start):
                at = np.searchsorted(x.base, start, "right") - 1
                out.append(np.stack([rows[at], np.full(len(at), i), start - x.base[at], end - x.base[at]]))
    return np.concatenate(out, axis=1)
