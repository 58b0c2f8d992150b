"""Secret scans in DataFrame expressions: base patterns, and sliding-window entropy.

Candidates are runs of 20 or more characters of one class with a digit among them.  A
window of ``WINDOW`` characters slides over a candidate; the counts of its characters
are changed by the one that leaves and the one that enters, and with them the sum of
c * log2(c), in whole millionths, so that results don't depend on the order of additions.
The window with the highest entropy decides.  Candidates on the allow-list (letters
only, digits only, identifiers with dashes, paths, placeholders) are dropped, and so are
those inside a base span.

Null and empty texts have no spans.  Rows are independent, repeated ones too, and other
columns stay; an output name that clashes replaces the column.  Very long texts and
candidates take time in proportion to their length.  Of candidates at one start the kinds'
order decides.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import held, with_spans

from .common import free_name

WINDOW = 20
#: Characters of a candidate that are gone through at once.
PIECE = 128
UNIT = 1_000_000

# The base patterns and the least length of what they must hold.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

#: Alphabet, pattern and least entropy in bits of each class of candidates.
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", r"(?<![A-Za-z0-9+/_-])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{20,}+(?![A-Za-z0-9+/_-])", 2.9),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}", 3.6),
}
ALLOWED = "|".join(
    [
        r"^[0-9]+$",
        r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
        # numbers with a mark between, then paths of short names: no repeated groups, as those recurse once a repetition
        r"^(?=.*[-/_+])(?!.*[-/_+]{2})[0-9][-0-9/_+]*+(?<=[0-9])$",
        r"^(?=/?[a-z0-9_-]++/[a-z0-9_-]++/)(?!.*//)(?!.*[a-z0-9_-]{17}/)[a-z0-9_/-]*+$",
        r"(?i)example|placeholder|changeme|xxxx|dummy|sample",
        r"^(.)\1+$",
    ]
)


def least_sum(text: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The least sum of c * log2(c) over all windows, in millionths; the text has ``window`` characters at least."""
    weights = F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0).cast("bigint") for c in range(window + 1)])
    size = len(alphabet)
    start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0).cast("bigint").alias("total"), F.lit(None).cast("bigint").alias("least"))

    def change(a: Column, e: Column) -> Column:
        """One character leaves or enters: two counts differ, and the sum by their weights."""
        old = F.get(a["counts"], e["at"] - 1)
        counts = F.concat(F.slice(a["counts"], F.lit(1), e["at"] - 1), F.array(old + e["by"]), F.slice(a["counts"], e["at"] + 1, F.lit(size)))
        return F.when(e["at"] > 0, F.struct(counts.alias("counts"), (a["total"] + F.get(weights, old + e["by"]) - F.get(weights, old)).alias("total"), a["least"].alias("least"))).otherwise(a)

    def slid(part: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            out_at = F.when(i > window, F.instr(F.lit(alphabet), F.substring(part, i - window, F.lit(1)))).otherwise(F.lit(0))
            in_at = F.instr(F.lit(alphabet), F.substring(part, i, F.lit(1)))
            events = F.array(F.struct(out_at.alias("at"), F.lit(-1).alias("by")), F.struct(in_at.alias("at"), F.lit(1).alias("by")))
            moved = F.aggregate(events, a, change)
            return F.element_at(F.transform(F.array(moved), lambda m: F.struct(m["counts"].alias("counts"), m["total"].alias("total"), F.when(i >= window, F.least(m["least"], m["total"])).alias("least"))), 1)

        return F.aggregate(F.sequence(F.lit(1), F.length(part)), start, step, lambda a: a["least"])

    def piece(a: Column, p: Column) -> Column:
        """A piece with the end of the one before it, so that every window lies in one of them."""
        least = F.element_at(F.transform(F.array(F.concat(a["before"], p)), slid), 1)
        return F.struct(F.right(p, F.lit(window - 1)).alias("before"), F.least(a["least"], least).alias("least"))

    # a character's place is counted from the beginning of its text: pieces keep that short
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{max(PIECE, window)}}}"), F.lit(0))
    none = F.struct(F.lit("").alias("before"), F.lit(None).cast("bigint").alias("least"))
    return F.aggregate(pieces, none, piece, lambda a: a["least"])


def entropy(text: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest entropy of a window, in bits a character."""
    return F.lit(math.log2(window)) - least_sum(text, alphabet, window) / F.lit(float(window * UNIT))


def scan(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: all spans (kind, start, end, surface, base) by start, then kind as in ``KINDS``."""
    whole = free_name(df, "whole__")
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, **{k: c[1] for k, c in CLASSES.items()}}
    names = {k: free_name(df, f"{k}__spans") for k in patterns}
    found = with_spans(df.withColumn(whole, F.coalesce(text, F.lit(""))), whole, {names[k]: p for k, p in patterns.items()})

    def marked(kind: str, base: bool) -> Column:
        return F.transform(names[kind], lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["surface"].alias("surface"), F.lit(base).alias("base")))

    secret = F.filter(marked("assign", True), lambda s: F.length(F.regexp_extract(s["surface"], ASSIGN, 2)) >= ASSIGN_LEAST)
    base = free_name(df, "base__")
    found = found.withColumn(base, held(F.concat(secret, marked("access", True), marked("hex", True))))
    taken = free_name(df, "added__")

    def added(kind: str) -> Column:
        alphabet, _, bits = CLASSES[kind]
        fresh = F.filter(marked(kind, False), lambda s: ~s["surface"].rlike(ALLOWED) & ~F.exists(F.col(base), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
        fresh = F.filter(fresh, lambda s: entropy(F.rtrim(s["surface"], F.lit("=")), alphabet) >= bits)
        return fresh if kind == "entropy_hex" else F.filter(fresh, lambda s: s["surface"].rlike("[A-Z]") & s["surface"].rlike("[a-z]"))

    found = found.withColumn(taken, F.concat(*[added(k) for k in CLASSES]))
    every = F.array_sort(F.concat(base, taken))
    return found.withColumn(out, F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["surface"].alias("surface"), s["base"].alias("base")))).drop(whole, base, taken, *names.values())


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
