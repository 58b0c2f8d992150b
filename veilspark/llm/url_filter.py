"""Rules for hosts and paths, found by hashes of a URL's host suffixes and path prefixes.

A URL's host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or
the end, with A-Z lower-cased; its path goes on to ``?``, ``#`` or the end.  A null URL, or
one without ``://``, has an empty host and path.  A rule (host, path, verdict) fits its host
and all subdomains, if the URL's path starts with the rule's.

Every URL is expanded into the pairs of its host's label suffixes and of its path's prefixes
that end in a slash (the empty one too), as deep as the deepest rule.  A rule is filed
under its host and its path up to the last slash.  Pairs and rules meet by an equi-join on
the first 32 bits of a SHA-256 digest; then the whole digest and the rest of the rule's path
are confirmed.  Of the rules that fit, the longest wins (host and path together); with ties
the one with the longer host, then ``block``.  Where none fits, the verdict is the default.

Rules are broadcast up to a counted bound.  Beyond it they are shuffled, and the prefixes
that more than one in 4,096 of all pairs have (so at most 4,096 of them) are split over
``SALTS`` keys.  Rows that are repeated stay repeated, an empty table gives an empty one,
very long URLs are expanded only as deep as the rules go, and columns of the table that are
called like the added ones are replaced.  Columns of a map type can't come along.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_but

ADDED = ("host", "path", "rule", "verdict")
#: Hexadecimal digits of a digest that pairs and rules meet by.
PREFIX = 8
#: Rules that may be broadcast, at some 150 bytes each.
BROADCAST_RULES = 100_000
#: A prefix is hot if more than one pair in so many has it; its pairs are split over so many keys.
HOT_SHARE, SALTS = 4096, 64
_KEY, _AT = "_key", "_at"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def up_to_slash(path: Column, slashes: Column) -> Column:
    """The path's beginning that ends in its ``slashes``-th slash; empty for 0."""
    return F.when(slashes == 0, "").otherwise(F.concat(F.array_join(F.slice(F.split(path, "/"), F.lit(1), slashes), "/"), F.lit("/")))


def filed(rules: DataFrame) -> DataFrame:
    """Rules as ``prefix``, ``digest``, ``rule_path`` and ``code``, which is greater the earlier a rule wins."""
    host = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    slashes = F.size(F.split("path", "/")) - 1
    digest = F.sha2(F.concat(host, up_to_slash(F.col("path"), slashes)), 256)
    length = F.length("host") + F.length("path")
    code = length.cast("long") * 2**31 + F.length("host") * 2 + (F.col("verdict") == "block").cast("int")
    rows = rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
    return rows.select(F.substring(digest, 1, PREFIX).alias("prefix"), digest.alias("rule_digest"), F.col("path").alias("rule_path"), code.alias("code"), (F.size(F.split("host", r"\.")) + 0).alias("labels"), slashes.alias("slashes"))


def expanded(rows: DataFrame, labels: int, slashes: int) -> DataFrame:
    """A row for each pair of a host suffix and a path prefix: adds its ``digest`` and ``prefix``."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    depths = F.sequence(F.lit(0), F.least(F.size(F.split("path", "/")) - 1, F.lit(slashes)))
    every = rows.withColumn(f"{_KEY}_host", F.explode(suffixes)).withColumn(f"{_KEY}_depth", F.explode(depths))
    digest = F.sha2(F.concat(f"{_KEY}_host", up_to_slash(F.col("path"), F.col(f"{_KEY}_depth"))), 256)
    return every.withColumn(f"{_KEY}_digest", digest).drop(f"{_KEY}_host", f"{_KEY}_depth").withColumn(f"{_KEY}_prefix", F.substring(f"{_KEY}_digest", 1, PREFIX))


def met(pairs: DataFrame, rules: DataFrame, broadcast: bool) -> DataFrame:
    """Left join of the pairs with the rules of their prefix."""
    if broadcast:
        return pairs.join(F.broadcast(rules), F.col(f"{_KEY}_prefix") == F.col("prefix"), "left")
    counts = pairs.groupBy(F.col(f"{_KEY}_prefix").alias("hot")).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("count") > max(total // HOT_SHARE, 1)).select("hot"))
    salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64(_AT), F.lit(SALTS))).otherwise(0)
    pairs = pairs.join(hot, F.col(f"{_KEY}_prefix") == F.col("hot"), "left").withColumn(f"{_KEY}_salt", salt).drop("hot")
    salts = F.explode(F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    rules = rules.join(hot, F.col("prefix") == F.col("hot"), "left").withColumn("salt", salts).drop("hot")
    return pairs.join(rules, (F.col(f"{_KEY}_prefix") == F.col("prefix")) & (F.col(f"{_KEY}_salt") == F.col("salt")), "left")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``."""
    known = filed(rules)
    shape = known.agg(F.count("*"), F.max("labels"), F.max("slashes")).first()
    keep = [c for c in columns_but(pages, *ADDED)]
    host, path = host_and_path(F.col(f"`{url}`"))
    # the row's number keeps repeated rows apart; it is made and used in one evaluation
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias(_AT))
    if not shape[0]:
        return rows.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    names = {c: f"_row_{i}" for i, c in enumerate(keep)}
    rows = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], "host", "path", _AT)
    pairs = met(expanded(rows, shape[1], shape[2]), known.select("prefix", "rule_digest", "rule_path", "code"), shape[0] <= broadcast_rules)
    fits = (F.col(f"{_KEY}_digest") == F.col("rule_digest")) & F.startswith("path", "rule_path")
    best = pairs.groupBy(_AT, *names.values(), "host", "path").agg(F.max(F.when(fits, F.col("code"))).alias("code"))
    of_host = F.shiftright(F.col("code").bitwiseAND(2**31 - 1), 1).cast("int")
    of_path = F.shiftright("code", 31).cast("int") - of_host
    rule = F.concat(F.substring("host", F.length("host") - of_host + 1, of_host), F.substring("path", F.lit(1), of_path))
    verdict = F.when(F.col("code").isNull(), default).when(F.col("code") % 2 == 1, "block").otherwise("allow")
    return best.select(*[F.col(n).alias(c) for c, n in names.items()], "host", "path", rule.alias("rule"), verdict.alias("verdict"))
