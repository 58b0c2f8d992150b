"""Format-preserving pseudonyms for personal data, in DataFrame expressions alone.

Emails, IPv4 addresses, dates, social-security-like numbers, card numbers, phone
numbers and bank account numbers are found, validated (check digits, real dates, octets,
lengths) and permuted within their format by a Feistel network keyed with SHA-256:
equal values get equal pseudonyms in every document, separators stay, a card keeps a
right check digit, a date stays a date.  ``restore`` undoes numbers and dates with the
key.  Numbers of card length that fail the check are permuted too, as plain digits.

    digits   halves u and v: (u, v) -> (v, u + F(round, v) mod 10^|u|), 8 rounds
    dates    days of a 400-year cycle = 189 x 773, halves modulo those two numbers
    IPv4     halves of 16 bits
    emails   the local part becomes ``user`` and 12 digits of its keyed hash; the
             domain's digits stay (one way: an email isn't a number)

Null texts stay null, empty ones empty.  Rows are independent; other columns stay, and
an output name that clashes replaces the column.  Repeated rows change alike.  Very long texts are gone
through whole.  Of kinds that match at one place the first of ``PATTERNS`` decides.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import held

from .common import free_name

ROUNDS = 8
#: The key for tests and queries; production passes its own.
KEY = "veilspark-demonstration-key"

L, R = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# in this order: the first that matches at a place wins
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}",  # a domain has at most 127 labels
    "ipv4": rf"{L}(?<![0-9]\.){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9]){R}",
    "iso_date": rf"{L}(?<![-/])[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?![-/]?[0-9]){R}",
    "day_date": rf"{L}(?<![-/])[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}(?![-/]?[0-9]){R}",
    "ssn": rf"{L}(?<![0-9]-)[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?!-?[0-9]){R}",
    "phone": rf"(?:(?<![\p{{L}}\p{{N}}+])\+[0-9]{{1,3}}[ .-]?|(?<![\p{{L}}\p{{N}}]))(?:\([0-9]{{3}}\)|[0-9]{{3}})[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}{R}(?!-[0-9])",
    "card": rf"{L}[0-9](?:[ -]?[0-9]){{12,18}}{R}",
    "iban": rf"{L}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{R}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed(key: str, kind: str, number: Column, value: Column) -> Column:
    """60 bits that depend on key, kind, round and value."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def permute_digits(digits: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """A string of 2 to 36 digits to one of the same length, one to one for each length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    start = F.struct(F.substring(digits, F.lit(1), half).alias("a"), F.substring(digits, half + 1, F.length(digits)).alias("b"))
    power = lambda x: F.rpad(F.lit("1"), F.length(x) + 1, F.lit("0")).cast("bigint")
    width = lambda v, x: F.lpad(v.cast("string"), F.length(x), F.lit("0"))

    def forward(s: Column, r: Column) -> Column:
        made = F.pmod(s["a"].cast("bigint") + F.pmod(hashed(key, kind, r, s["b"]), power(s["a"])), power(s["a"]))
        return F.struct(s["b"].alias("a"), width(made, s["a"]).alias("b"))

    def backward(s: Column, r: Column) -> Column:
        was = F.pmod(s["b"].cast("bigint") - F.pmod(hashed(key, kind, r, s["a"]), power(s["b"])), power(s["b"]))
        return F.struct(width(was, s["b"]).alias("a"), s["a"].alias("b"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, backward if inverse else forward, lambda s: F.concat(s["a"], s["b"]))


def permute_pair(number: Column, left: int, right: int, key: str, kind: str, inverse: bool = False) -> Column:
    """A number below ``left * right`` to one such number, one to one."""
    start = F.struct(F.floor(number / right).cast("bigint").alias("a"), F.pmod(number.cast("bigint"), F.lit(right)).alias("b"))
    sign = -1 if inverse else 1

    def step(s: Column, r: Column) -> Column:
        def move_a(a: Column, b: Column) -> Column:
            return F.pmod(a + sign * F.pmod(hashed(key, f"{kind}a", r, b), F.lit(left)), F.lit(left))

        def move_b(a: Column, b: Column) -> Column:
            return F.pmod(b + sign * F.pmod(hashed(key, f"{kind}b", r, a), F.lit(right)), F.lit(right))

        if inverse:
            return let(move_b(s["a"], s["b"]), lambda b: F.struct(move_a(s["a"], b).alias("a"), b.alias("b")))
        return let(move_a(s["a"], s["b"]), lambda a: F.struct(a.alias("a"), move_b(a, s["b"]).alias("b")))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda s: s["a"] * right + s["b"])


def luhn_sum(digits: Column) -> Column:
    """The sum of a card number's digits, every second one from the right doubled."""
    at = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == 1
        return F.when(twice, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(at, F.lit(0), lambda s, i: s + value(i))


def permute_card(digits: Column, key: str, inverse: bool = False) -> Column:
    """Numbers with a right check digit to such numbers; others as plain digits."""

    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))

    body = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", inverse)
    # the others are walked on until they fail the check again, so both sets stay apart
    plain = lambda d: permute_digits(d, key, "number", inverse)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(12)), plain(digits), lambda d, _: F.when(luhn_sum(d) % 10 == 0, plain(d)).otherwise(d))
    return F.when(luhn_sum(digits) % 10 == 0, let(body, checked)).otherwise(walked)


def refill(shape: Column, digits: Column) -> Column:
    """The digits put in the places of the shape's digits, one after another."""
    fill = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["n"], F.lit(1))).alias("out"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["n"].alias("n")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("n")), fill, lambda s: s["out"])


def mod97(account: Column) -> Column:
    """The remainder by 97 of an account number without blanks, its first four characters put last, letters as 10 to 35."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    digit = lambda c: F.ascii(c).cast("int") - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    step = lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + digit(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def permute_iban(surface: Column, key: str, inverse: bool = False) -> Column:
    """Account numbers with right check digits to such numbers of the same country; others as plain digits."""
    compact = lambda s: F.replace(s, F.lit(" "), F.lit(""))
    digits = lambda s: F.regexp_replace(s, "[^0-9]", "")
    valid = lambda s: (mod97(compact(s)) == 1) & (F.length(digits(s)) >= 6)
    plain = lambda s: refill(s, permute_digits(digits(s), key, "number", inverse))

    def moved(s: Column) -> Column:
        body = permute_digits(F.substring(digits(s), F.lit(3), F.length(s)), key, "iban", inverse)
        open_ = refill(s, F.concat(F.lit("00"), body))
        return refill(open_, F.concat(F.lpad((98 - mod97(compact(open_))).cast("string"), 2, "0"), body))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(4)), plain(surface), lambda s, _: F.when(valid(s), plain(s)).otherwise(s))
    return let(surface, lambda s: F.when(valid(s), moved(s)).otherwise(walked))


def permute_date(surface: Column, key: str, inverse: bool = False) -> Column:
    """A real date of 1800 to 2199 to another; what is none (months first, say) as plain digits."""
    first = F.to_date(F.lit("1800-01-01"))
    day = lambda s: F.datediff(F.try_to_date(s, "yyyy-MM-dd"), first)
    iso = F.concat_ws("-", F.substring(surface, 7, 4), F.substring(surface, 4, 2), F.substring(surface, 1, 2))
    moved = lambda n: F.date_add(first, permute_pair(n, 189, 773, key, "date", inverse).cast("int"))
    in_cycle = lambda n: n.between(0, 146096)
    plain = refill(surface, permute_digits(F.regexp_replace(surface, "[^0-9]", ""), key, "number", inverse))
    is_iso = surface.rlike("^[0-9]{4}-")
    return let(
        F.when(is_iso, day(surface)).otherwise(day(iso)),
        lambda n: F.when(n.isNotNull() & in_cycle(n), F.when(is_iso, F.date_format(moved(n), "yyyy-MM-dd")).otherwise(F.date_format(moved(n), "dd/MM/yyyy"))).otherwise(plain),
    )


def permute_ipv4(surface: Column, key: str, inverse: bool = False) -> Column:
    number = F.aggregate(F.split(surface, r"\."), F.lit(0).cast("bigint"), lambda s, x: s * 256 + x.cast("bigint"))
    octets = lambda n: F.concat_ws(".", *[(F.shiftright(n, k) % 256).cast("string") for k in (24, 16, 8, 0)])
    return let(permute_pair(number, 65536, 65536, key, "ipv4", inverse), octets)


def kind_of(surface: Column) -> Column:
    """The first kind whose pattern is the whole surface."""
    out = F.when(surface.contains("@"), "email")
    for kind, p in list(PATTERNS.items())[1:]:
        out = out.when(surface.rlike(f"^(?:{p})$"), kind)
    return out.otherwise("number")


def pseudonym(surface: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    digits = F.regexp_replace(surface, "[^0-9]", "")
    of = lambda f: let(digits, f)
    domain = F.regexp_extract(surface, "@(.*)$", 1)
    name = F.lpad(F.pmod(hashed(key, "email", F.lit(0), F.lower(surface)), F.lit(10**12)).cast("string"), 12, "0")
    email = surface if inverse else F.concat(F.lit("user"), name, F.lit("@"), domain)
    country = F.regexp_extract(surface, r"^\+([0-9]{1,3})[ .-]?(?=\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$)", 1)
    phone = let(country, lambda c: of(lambda d: refill(surface, F.concat(c, permute_digits(F.substring(d, F.length(c) + 1, F.lit(40)), key, "phone", inverse)))))
    return (
        F.when(kind == "email", email)
        .when(kind == "ipv4", permute_ipv4(surface, key, inverse))
        .when(kind.isin("iso_date", "day_date"), permute_date(surface, key, inverse))
        .when(kind == "phone", phone)
        .when(kind == "iban", permute_iban(surface, key, inverse))
        .when(kind == "card", of(lambda d: refill(surface, permute_card(d, key, inverse))))
        .otherwise(of(lambda d: refill(surface, permute_digits(d, key, "number", inverse))))
    )


def _replaced(df: DataFrame, text: str, key: str, inverse: bool, out: str, counts: str | None) -> DataFrame:
    hits, parts, kinds = (free_name(df, n) for n in ("pii_hits", "pii_parts", "pii_kinds"))
    # no digit and no @: nothing to find
    found = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    df = df.withColumn(hits, found)
    zipped = F.arrays_zip(F.split(F.col(text), ANY, -1).alias("gap"), F.col(hits).alias("hit"))
    named = F.transform(zipped, lambda z: F.struct(z["gap"].alias("gap"), z["hit"].alias("hit"), kind_of(z["hit"]).alias("kind")))
    df = df.withColumn(parts, held(F.when(F.size(hits) > 0, named)))
    masked = F.array_join(F.transform(parts, lambda z: F.concat(z["gap"], F.coalesce(pseudonym(z["hit"], z["kind"], key, inverse), F.lit("")))), "")
    df = df.withColumn(out, F.coalesce(masked, F.col(text)))
    if counts:
        df = df.withColumn(counts, F.coalesce(F.size(hits), F.lit(0)).cast("long"))
        df = df.withColumn(counts, F.greatest(counts, F.lit(0).cast("long")))
    return df.drop(hits, parts, kinds)


def pseudonymise(df: DataFrame, text: str = "text", key: str = KEY, out: str = "text", counts: str | None = "n_pii") -> DataFrame:
    """Put pseudonyms in the place of personal data; ``counts``: how many."""
    return _replaced(df, text, key, False, out, counts)


def restore(df: DataFrame, text: str = "text", key: str = KEY, out: str = "text") -> DataFrame:
    """Undo the pseudonyms of numbers, addresses and dates; emails stay."""
    return _replaced(df, text, key, True, out, None)
