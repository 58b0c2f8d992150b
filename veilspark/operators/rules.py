"""The rule table: labels, priorities and what each rule looks for, written from what it means.

Order counts: candidates get their place in this order as ``seq``.  A rule is a pattern, or a
walk over the text's words (``walks``).  A pattern's ``shape`` or a walk's ``words`` are its gate: whatever it
matches has something of this shape (much cheaper than the rule itself), or one of these words; a text
without isn't gone through.  Other walks look at few words of a text anyhow.  Lists of words are patterns in the form of a tree, which
costs no more than a gate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    pattern: str = ""
    check: str = ""
    words: tuple[str, ...] = ()
    shape: str = ""
    walk: str = ""


def any_of(words: list[str], gap: str = r"\s+") -> str:
    """Alternation of quoted words, each once, longest first; ``gap`` stands where they have a blank."""
    return "|".join(re.escape(w).replace("\\ ", gap) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def tree_of(words: list[str], gap: str = r"\s+") -> str:
    """``any_of`` for patterns that take no heed of case: words that begin alike share their beginning, so few are tried at a place."""

    def joined(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in rest:
            if w:
                heads.setdefault(w[0], []).append(w[1:])
        parts = [(gap if c == " " else re.escape(c)) + joined(tails) for c, tails in sorted(heads.items())]
        if not parts:
            return ""
        if "" in rest:  # the longest first
            return f"(?:{'|'.join(parts)})?"
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return joined(sorted({w.lower() for w in words}))


def first_of(words: list[str]) -> str:
    """That one of the words may begin here: cheaper than to look for a boundary at every place."""
    return f"(?=[{''.join(sorted({w[0].lower() for w in words}))}])"


def longest_words(phrases: list[str]) -> tuple[str, ...]:
    """The longest word of each phrase in small letters."""
    return tuple(sorted({max(re.findall(r"\w+", p.lower()), key=len) for p in phrases}))


TITLE = "[A-ZÁÉÍÓÚÑ][a-záéíóúüñç]+"
HOSPITAL_LINK = rf"(?iu:{any_of(L.HOSPITAL_LINKS)}|Dr\.?)\s+"
RECORD = r"NHC|HC|N[ºo]\s*(?:de\s*)?(?:HC|H[ªa]|hist[oò]ria)"
#: A decimal digit of any script, and white space of any kind.
D, WS = r"\p{Nd}", r"[\p{IsWhite_Space}\s\x1c-\x1f]"

# In this order; every pattern is Unicode-aware.  Groups that repeat without bound are
# possessive: others recurse, and a long text would end the executor's stack.  Fixed formats leave one way to write
# them: emails, identity, insurance, health-card and record numbers.
RULES = [
    Rule("date", "DATE", 4, walk="date"),
    Rule("time", "TIME", 4, r"(?iU)(?=\d)\b\d{1,2}(?::\d{2}){1,2}\s*h?\b", shape=f"{D}:{D}"),
    Rule("phone", "PHONE", 4, walk="phone"),
    Rule("email", "EMAIL", 5, r"(?U)(?=[A-Za-z0-9._%+-])\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", shape="@"),
    Rule("url", "URL", 5, walk="url"),
    Rule("doctor", "DOCTOR", 3, walk="doctor", words=tuple(L.TITLES)),
    Rule("age", "AGE", 4, walk="age"),
    Rule("location", "LOCATION", 3, rf"(?iU){first_of(L.PLACES)}\b(?:{tree_of(L.PLACES, gap=' ')})\b"),
    Rule("address", "LOCATION", 3, walk="address", words=longest_words(L.STREETS + L.STREETS_SHORT + ["C"])),
    Rule("family_relation", "RELATION", 3, rf"(?iU){first_of(L.KINSHIP)}\b(?:{tree_of(L.KINSHIP)})\b"),
    # a head, then as often as it goes: links, and a capitalised word or one after "12 de"
    Rule("hospital", "HOSPITAL", 3, rf"(?U)(?iu:{first_of(L.HOSPITALS)})\b(?iu:{tree_of(L.HOSPITALS)})\b(?:(?:\s*{HOSPITAL_LINK})*+\s*(?:\d{{1,2}}\s+de\s+)?{TITLE})++"),
    Rule("dni", "IDENTIFICADOR", 5, r"(?U)(?=\d{8})\b\d{8}[A-Za-z]\b", "dni", shape=f"{D}{{8}}[A-Za-z]"),
    Rule("nie", "IDENTIFICADOR", 5, r"(?U)(?=[XYZ])\b[XYZ]\d{7}[A-Za-z]\b", "nie", shape=f"[XYZ]{D}{{7}}"),
    Rule("ss", "IDENTIFICADOR", 5, r"(?U)(?=\d)\b\d{2}/\d{8}/\d{2}\b", shape=f"/{D}{{8}}/"),
    Rule("cip", "IDENTIFICADOR", 5, r"(?U)(?=[A-Z])\b[A-Z]{4}\d{10}\b", shape=f"[A-Z]{D}{{10}}"),
    Rule("nhc_labeled", "IDENTIFICADOR", 5, rf"(?iU)(?=[HN])\b(?:{RECORD})\s*[:#.-]?\s*\d{{4,11}}\b", shape=rf"[CcªAa](?:{WS}|[:#.-])*+{D}{{4}}"),
    Rule("nhc_22_5", "IDENTIFICADOR", 5, r"(?U)(?=\d)\b\d{2}[\s-]\d{2}[\s-]\d{5}\b", shape=rf"{D}[^\p{{L}}\p{{Nd}}]{D}{{5}}"),
    Rule("nhc_2_8_2", "IDENTIFICADOR", 5, r"(?U)(?=\d)\b\d{2}[-/]\d{7,8}[-/]\d{2}\b", shape=f"[-/]{D}{{7}}"),
    Rule("plain", "IDENTIFICADOR", 3, r"(?U)(?=[(\d])\(?\b\d{6,10}\b\)?", "plain", shape=f"{D}{{6}}"),
]

#: Rules for documents of any country, beside ``RULES``.
WIDE_RULES = [
    Rule("ipv4", "IDENTIFICADOR", 5, r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)", shape=r"\d\.\d"),
    Rule("card", "IDENTIFICADOR", 5, r"(?U)(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)", shape=f"(?:{D}[ -]?){{12}}"),
    Rule("phone_international", "PHONE", 5, r"(?U)(?<!\w)\+(?=(?:[ ().-]*\d){8,15}(?![ ().-]*\d))\d(?:[ ().-]{0,2}\d){7,14}(?!\w)", shape=rf"\+{D}"),
    Rule("phone_grouped", "PHONE", 5, r"(?U)(?<![\w+])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)", shape=f"{D}{{3}}[ .-]{D}{{4}}"),
    Rule("date_iso", "DATE", 5, r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])", shape=r"\d-\d{2}-\d"),
]

def may_match(rule: Rule, text: Column) -> Column:
    """Whether a rule's shape lets a text through."""
    if not rule.shape:
        return F.lit(True)
    return F.contains(text, F.lit(rule.shape)) if re.fullmatch(r"[@:/]+", rule.shape) else text.rlike(rule.shape)


def check_letter(number: Column) -> Column:
    return F.substring(F.lit(L.CHECK_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))


def valid_dni(surface: Column) -> Column:
    """Eight digits and the letter of their remainder by 23."""
    return F.upper(F.substring(surface, 9, 1)) == check_letter(F.substring(surface, 1, 8).cast("bigint"))


def valid_nie(surface: Column) -> Column:
    """X, Y, Z count as 0, 1, 2 before seven digits."""
    number = F.concat(F.translate(F.substring(surface, 1, 1), "XYZ", "012"), F.substring(surface, 2, 7)).cast("bigint")
    return F.upper(F.substring(surface, 9, 1)) == check_letter(number)


def _dni(surface: str) -> bool:
    return surface[8].upper() == L.CHECK_LETTERS[int(surface[:8]) % 23]


def _nie(surface: str) -> bool:
    return surface[8].upper() == L.CHECK_LETTERS[int(f"{'XYZ'.index(surface[0])}{surface[1:8]}") % 23]


_PHONE = re.compile(r"\(?[689][0-9]{8}\)?")
#: What a rule's match must pass, by the name of the rule's check.
CHECKS = {"dni": _dni, "nie": _nie, "plain": lambda surface: not _PHONE.fullmatch(surface)}
