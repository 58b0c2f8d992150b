"""Metrics that tasks count: against plain Python, on rows without spans, labels or text."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from veilspark.operators import metrics

SPAN = "array<struct<start:bigint,end:bigint,label:string,surface:string>>"


def made(rng, text, gap):
    spans, at = [], int(rng.integers(0, gap))
    while at < len(text) - 4:
        end = at + int(rng.integers(1, 5))
        spans.append((at, end, [None, "ID", "DATE", "NAME", "URL"][int(rng.integers(0, 5))], text[at:end]))
        at = end + int(rng.integers(0, gap))
    return spans


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = [(0, None, [], []), (1, "", None, []), (2, "ab ño 一 9", None, [(0, 2, "ID", "ab")])]
    for k in range(3, 700):
        text = "".join(rng.choice(list("aé9 .,-一"), 40))
        out.append((k, text, made(rng, text, 9), made(rng, text, 9)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, f"doc_id long, text string, gold {SPAN}, pred {SPAN}").repartition(3)


def over(a, b):
    return a[0] < b[1] and b[0] < a[1]


def no_row_a_span(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_strict_coverage(frame, rows):
    want = defaultdict(lambda: [0, 0, 0, 0])
    for _, text, gold, pred in rows:
        for g in gold or []:
            inside = [p for p in pred or [] if over(g, p)]
            gone = {i for p in inside for i in range(max(g[0], p[0]), min(g[1], p[1]))}
            left = any(text[i].isalnum() for i in range(g[0], g[1]) if i not in gone)
            state = "missed" if not gone else "full" if len(gone) >= g[1] - g[0] else "partial"
            direct = g[2] in metrics.DIRECT
            want[state] = [a + b for a, b in zip(want[state], (1, direct, left, direct and left))]
    got = metrics.strict_coverage(frame)
    assert {r[0]: list(r)[1:] for r in got.collect()} == dict(want)
    no_row_a_span(got)


def test_leak_attribution(frame, rows):
    want = Counter()
    for _, _, gold, pred in rows:
        kinds = {g[2] for g in gold or [] if g[2] in metrics.WIDE and not any(over(g, p) for p in pred or [])}
        want["multiple" if len(kinds) > 1 else f"solo_{kinds.pop()}" if kinds else None] += 1
    del want[None]
    got = metrics.leak_attribution(frame)
    assert {r.bucket: r.docs for r in got.collect()} == dict(want)
    assert {r.bucket: r.rate for r in got.collect()} == {b: round(n / len(rows), 6) for b, n in want.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("most", [metrics.MOST_COUNTED, 3])
def test_top_false_positives(frame, rows, monkeypatch, most):
    monkeypatch.setattr(metrics, "MOST_COUNTED", most)
    want = defaultdict(Counter)
    for _, _, gold, pred in rows:
        for p in pred or []:
            if not any(over(p, g) for g in gold or []) and (text := p[3].strip(" .,-")):
                want[" ".join(text.split()) if "  " in text else text]["unattributed" if p[2] is None else f"rule:{p[2]}"] += 1
    best = [(t, sum(c.values()), min((-n, s) for s, n in c.items())[1]) for t, c in want.items()]
    got = metrics.top_false_positives(frame, model=None, rule="pred")
    assert [(r.text, r.n, r.source) for r in got.collect()] == sorted(best, key=lambda x: (-x[1], x[0].encode()))[:20]
    no_row_a_span(got)


def test_placeholders_are_numbered_where_spans_are(spark, rows, tmp_path):
    """Rows of one document in several slices and batches, null keys and no spans: as ``numbered``, without a sort of spans."""
    from pyspark.sql import functions as F

    from veilspark.operators import mask
    from veilspark.plans import catalog

    # documents of up to 300 rows, with starts of their own in each
    apart = [(None if k < 60 else k // 300, [(s + 50 * k, e + 50 * k, label, x) for s, e, label, x in pred or []]) for k, (_, _, _, pred) in enumerate(rows)] + [(9, []), (10, None)]
    df = spark.createDataFrame(apart, f"doc_id long, pred {SPAN}")
    spans = df.select("doc_id", F.explode("pred").alias("s")).select("doc_id", F.col("s.start").alias("span_start"), "s.label", "s.surface")
    want = mask.numbered(spans, "doc_id").select("doc_id", "surface", "label", "placeholder")
    got = mask.numbered_together(df.repartition(2, "doc_id").sortWithinPartitions("doc_id"), "doc_id", "pred")
    plain = lambda x: sorted(map(repr, map(tuple, x.collect())))
    assert got.count() > 50 and plain(got) == plain(want)
    spark.range(300).selectExpr("id % 200 as o_orderkey", "id % 200 as o_custkey", "timestamp'2020-01-01' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    query = catalog.placeholder_numbering(spark, str(tmp_path))
    assert plain(query) == plain(mask.numbered(catalog.resolved_spans(spark, str(tmp_path)), "doc_id").select(query.columns))
    assert "Window" not in query._jdf.queryExecution().optimizedPlan().toString()


def test_metrics_of_nothing(spark, frame):
    """No rows, and rows of which none leaks or is found wrongly."""
    for df in (frame.where("false"), frame.where("doc_id < 2")):
        assert metrics.leak_attribution(df).count() == metrics.strict_coverage(df).count() == metrics.top_false_positives(df, model=None, rule="pred").count() == 0
