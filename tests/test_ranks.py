"""Exact ranks against sorting, and texts that are long enough to exhaust a stack."""

import random

from pyspark.sql import functions as F

from veilspark.operators import admission, detect, names, ranks, rules, walks


def test_values_at_exact_ranks(spark):
    rng = random.Random(1)
    rows = [("hot", rng.lognormvariate(0, 3)) for _ in range(4000)] + [("ties", float(rng.randrange(3))) for _ in range(3000)]
    rows += [(None, float(i)) for i in range(7)] + [("one", 2.5), ("none", None)]
    rng.shuffle(rows)
    n = F.col("n")
    got = ranks.values_at(spark.createDataFrame(rows, "key string, x double"), "key", "x", {"first": F.lit(1), "mid": F.floor((n + 1) / 2), "p95": F.floor(0.95 * (n - 1)) + 1, "last": n}).collect()
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert {r.key for r in got} == set(want) and len(got) == len(want)
    for r in got:
        v = sorted(want[r.key])
        assert (r.n, r.first, r.mid, r.p95, r.last) == (len(v), v[0], v[(len(v) + 1) // 2 - 1], v[int(0.95 * (len(v) - 1))], v[-1])


def test_values_at_of_no_rows(spark):
    assert ranks.values_at(spark.createDataFrame([], "key string, x double"), "key", "x", {"a": F.lit(1)}).count() == 0


def test_patterns_go_through_long_runs(spark):
    """A run of 100,000 words of one match is found whole."""
    rule = {r.name: [r] for r in rules.RULES}
    for name, text in (("doctor", "dr. " + "ana ruiz " * 50000), ("hospital", "Hospital " + "Ana Ruiz " * 50000)):
        found = detect.matches(spark.createDataFrame([(text,)], "t string"), "t", rule[name]).first().matches
        assert [(m.start, m.end) for m in found] == [(0, len(text) - 1)]
    for kind, lines, text in (("upper", False, "ANA RUIZ " * 50000), ("upper", True, "ANA RUIZ " * 50000), ("mixed", False, "Ana Ruiz " * 50000)):
        assert [(s, e) for s, e, _ in names.runs(walks.Words(text), 0, len(text), kind, lines)] == [(0, len(text) - 1)]


def test_names_end_at_whole_words():
    found = lambda text, kind: [x for _, _, x in names.runs(walks.Words(text), 0, len(text), kind, False)]
    cases = {"ANA RUIZ": ["ANA RUIZ"], "ANA RUIZ SOLa": ["ANA RUIZ"], "ANA RUIZa": [], "ANA, RUIZ/SOL - PO": ["ANA, RUIZ/SOL"]}
    for text, want in cases.items():
        assert found(text, "upper") == want
    cases = {"Ana Ruiz Pérez": ["Ana Ruiz Pérez"], "Ana Ruiz Ramón": ["Ana Ruiz"], "Ana Ramón": [], "Ana\nRuiz": []}
    for text, want in cases.items():
        assert found(text, "mixed") == want


def test_addresses_of_any_length(spark):
    texts = ["::1", "1:2:3:4:5:6:7:8", "1::" + "2:" * 100000 + "3", "1:2:3:4:5:6:7:8:9"]
    got = spark.createDataFrame([(x,) for x in texts], "ip string").select(admission.ipv6_digits(F.col("ip")).alias("d")).collect()
    assert [r.d is not None for r in got] == [True, True, False, False]
