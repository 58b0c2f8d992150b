"""URL rules, conversation repair and ranked search: against SQL, brute force and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from functools import cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import conversation_repair as cr
from veilspark.llm import queries, ranked_search, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_url_filter", "op13_conversations"])
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rel = duck.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(dict(zip(rel.columns, x))[c] for c in cols)) for x in rel.fetchall())


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://NET/", "https://a.b.Example.NET/en/x?y#z", "http://example.net/en", "http://badexample.net/x", "http://example.org/fr/1", "http://org/fr/",
    "http://example.com/de/", "http://example.com/de", "http://x.example.com/a/b/c/d?q=/de/", "ftp://u://a.net/", "http://a..net/", "http://example.net:80/", "http://net./x", "http://é.net/ü\n/z", "x://" + "a." * 3000 + "net" + "/b" * 3000,
    "http://example.com/deutsch/x", "http://example.com/de/x", "http://example.com/de/x",
]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("com", "/deu", "allow"), ("example.com", "/de", "allow"), ("com", "/de/", "allow"), ("com", "/de/", "block"), ("org", "", "block"), ("EXAMPLE.org", "/fr/1", "allow"), (None, "/", "block"), ("b.example.net", "/en/", "block"), ("com", "/x/", "block"), ("com", "/x/", "allow")]


def judged(url):
    """Brute force: every rule against the URL."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h) + len(p), len(h), v == "block", h.lower() + p, v) for h, p, v in RULES if h is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


@pytest.mark.parametrize("most", [0, 1000])
def test_url_rules_are_brute_force(spark, most):
    pages = spark.createDataFrame([(i if i else None, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, HOST string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules, broadcast_rules=most)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == [(i, *judged(u)) for i, u in enumerate(URLS)]
    assert url_filter.judge(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.where("false"), default="block").collect()} == {"block"}


def best(rows):
    """Brute force over edits from the end: (cost, audit, pieces) of the cheapest, ASCII-least repair."""

    @cache
    def go(i, q, inserts):
        found = [(0, "", ())] if i == len(rows) and q in "-a" else []
        role, text, gone, cut = rows[i] if i < len(rows) else (None,) * 4
        new = {"-": "user", "s": "user", "a": "user", "u": "assistant"}[q]
        if inserts < 3:
            c, a, p = go(i, new[0], inserts + 1)
            found.append((c + 5, "I" + a, (f"{new}:", *p)))
        if role is not None:
            c, a, p = go(i + 1, q, 0)
            found.append((c + 2, "D" + a, p))
            if not gone:
                for letter, cost, r in (("K", 0, role), ("R", 1, new)):
                    if r[:1] == new[0] or (q == "-" and r[:1] == "s"):
                        c, a, p = go(i + 1, r[:1], 0)
                        found.append((c + cost + 5 * cut, letter + a, (f"{r}:{text}", *p)))
        return min(found) if found else (10**9, "", ())

    return go(0, "-", 0)


def expected(rows):
    """Results for (turn, role, text) rows in order."""
    seen, marked, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        t = text.strip(" \t\n\x0b\x0c\r")
        fault = 0 if not t else 1 if (role, text) in seen else 2 if t[-1] not in ".!?" else 3
        seen.add((role, text))
        if fault < 3:
            counts[fault] += 1
        marked.append((role, text, fault < 2, fault == 2))
    turns = {t for t, *_ in rows if t is not None}
    cost, audit, pieces = best(tuple(marked))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(pieces).encode()).hexdigest())


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_repair_is_brute_force_whole_and_in_blocks(spark, most):
    rng = random.Random(most)
    convs = {c: [(t + (t > 4), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "-x"]), rng.choice(["ok.", "yes!", "cut", " \n", "", f"no {t}?", "a\tb. "])) for t in range(rng.randint(0, 9))] for c in range(60)}
    convs[60] = [(None, "user", "é日."), (None, "user", "é日."), (0, "assistant", "x" * 5000 + ".")]
    rows = [(c, t, r, x, True, "other") for c, v in convs.items() for t, r, x in v] + [(c, 1, "user", "dropped", False, "other") for c in convs]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, present boolean, COST string")
    got = {r[0]: tuple(r)[1:] for r in cr.repair(df, present=F.col("present"), most=most).collect()}
    assert got.keys() == convs.keys()
    for c, v in convs.items():
        assert got[c] == expected(v), (c, v)


def test_repair_odd_rows(spark):
    rows = [(None, 1, None, None), (None, 2, "user", "hi."), (None, None, "assistant", "so?"), (7, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair(df).collect()}
    assert got[None] == expected([(None, "assistant", "so?"), (1, " ", " "), (2, "user", "hi.")]) and got[7] == expected([(None, " ", " ")])
    assert cr.repair(df.where("false")).count() == 0
    states = cr.Repairs()
    for seed in range(30):
        states.scan(cr.START, bytes(random.Random(seed).choices(range(9), k=500)))
    assert len(states.vectors) < 200


def test_damage_follows_the_checksum(spark):
    rows = spark.createDataFrame([(c, t, "assistant", "a. b!") for c in range(40) for t in range(5)], "conv_id long, turn long, role string, text string")
    got = {}
    for r in queries.damaged(rows).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.present))
    for (c, t), v in got.items():
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = {0: [("assistant", "a. b!", False)], 1: [("assistant", "", True)], 2: [("assistant", "a b", True)], 3: [("assistant", "a. b!", True)] * 2, 4: [("user", "a. b!", True)]}
        assert v == want.get(kind, [("assistant", "a. b!", True)])


def ranked(docs, items, k):
    """Brute force: every document's score for every item."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = [(d, split(t)) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    out = []
    for item in {i for i, _ in items}:
        score = [0] * n_docs
        for t in {t for i, x in items if i == item for t in split(x)}:
            df = sum(t in w for _, w in words)
            if df:
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                for j, (_, w) in enumerate(words):
                    if tf := w.count(t):
                        score[j] += weight * (1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * len(w) * n_docs // n_terms)))
        best = sorted((-s, d is not None, d or 0, d) for s, (d, _) in zip(score, words) if s)[:k]
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("shard, block, items_at_once", [(7, 2, 5), (1000, 64, 100_000)])
def test_search_is_brute_force(spark, odd, monkeypatch, shard, block, items_at_once):
    """Small shards, blocks and blocks of items; ties, repeated rows, nulls, a text that is longer than a shard."""
    for name, value in (("SHARD_DOCS", shard), ("SHARD_CHARS", 5000), ("ITEM_TERMS", items_at_once)):
        monkeypatch.setattr(ranked_search, name, value)
    monkeypatch.setattr(ranked_search.block_ends, "__defaults__", (200_000, block))
    rng = random.Random(3)
    docs = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, " ".join(rng.choices("aa Bb cC été w1 w2 w3 w4 w5".split(), weights=[40, 20, 9, 5, 3, 2, 1, 1, 1], k=rng.randint(1, 30)))) for i in range(200)]
    docs += docs[-30:]
    items = [(1, "aa bb-cc AA"), (2, "ÉTÉ été w5 w4 w3"), (3, None), (4, ""), (5, "nowhere"), (6, "w1 w2 w3 w4 w5 aa bb cc x tail"), (7, "text same"), (7, "w77"), (None, "mail words line")]
    frame = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, SHARD string").repartition(3)
    queried = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, w int")
    got = ranked_search.search(ranked_search.index(frame), queried, k=4).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(ranked(docs, items, 4), key=key)
    assert ranked_search.search(ranked_search.index(frame.where("false")), queried).count() == 0
    assert ranked_search.search(ranked_search.index(frame), queried.where("false")).count() == 0


def test_blocks_are_the_cheapest():
    """The choice of ends against all choices."""
    rng = np.random.default_rng(5)
    lists = [rng.integers(1, 100, n) for n in (17, 18, 20, 1, 3, 19)]
    places = [np.sort(rng.choice(60, len(x), replace=False)) for x in lists]
    sizes = np.array([len(x) for x in lists])
    values = np.concatenate(lists).astype(np.int32)
    ends = ranked_search.block_ends(np.concatenate(places), values, np.cumsum(sizes) - sizes, sizes, cost=300, most=6)
    for x, d, e in zip(lists, places, ends):
        block = lambda a, b: 300 + int(d[b - 1] - d[a] + 1) * int(x[a:b].max())  # noqa: E731, B023
        least = [0]
        for i in range(1, len(x) + 1):
            least.append(min(least[j] + block(j, i) for j in range(max(0, i - 6), i)))
        assert e[-1] == len(x) and sum(map(block, [0, *e[:-1]], e)) == least[-1] and np.diff([0, *e]).max() <= 6


def test_search_skips_blocks_and_stays_exact():
    rng, n = np.random.default_rng(6), 4000
    lists = []
    for share in (0.5, 0.3, 0.02, 0.01):
        docs = np.flatnonzero(rng.random(n) < share).astype(np.int32)
        impacts = rng.integers(1, 1000, len(docs)).astype(np.int32)
        ends = ranked_search.block_ends(docs, impacts, np.array([0]), np.array([len(docs)]), cost=3000)[0]
        lists.append((int(100 / share), ranked_search.Postings(docs, impacts, docs[np.append(0, ends[:-1])], docs[ends - 1], np.maximum.reduceat(impacts, np.append(0, ends[:-1])))))
    ids, known = np.arange(n), np.ones(n, bool)
    found, scored = ranked_search.best_in_shard(lists, ids, known, 10)
    score = np.zeros(n, np.int64)
    for w, p in lists:
        score[p.docs] += w * p.impacts.astype(np.int64)
    want = np.lexsort((ids, -score))[:10]
    assert found == [(int(d), int(score[d])) for d in want]
    assert scored < sum(len(p.docs) for _, p in lists) / 2
