"""Queries on keys and batches greater than those of the small tables, and what tasks hold at a time."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.functions import rows, spans
from veilspark.operators import detect, rules
from veilspark.plans import catalog


def test_nie_numbers_of_over_seven_digits(spark, tmp_path):
    con = duckdb.connect()
    con.sql("create table customer as select range as c_custkey from range(322570, 322690)")
    con.sql(f"copy customer to '{tmp_path}/customer.parquet'")
    want = con.sql(catalog.oracle_sql()["nie_check"]).fetchall()
    assert sorted(map(tuple, catalog.nie_check(spark, str(tmp_path)).collect())) == sorted(want)


def test_python_values_are_made_of_few_rows_at_a_time():
    batch = pa.record_batch({"x": list(range(5 * rows.SLICE + 1))})
    parts = list(rows.sliced([batch]))
    assert [p.num_rows for p in parts] == [rows.SLICE] * 5 + [1] and pa.Table.from_batches(parts)["x"].to_pylist() == batch["x"].to_pylist()


@pytest.mark.parametrize("pattern", [r"(?iU)\b[a-c]+\b", r"a\b", r"\(?\d{2}\)?", r"(?<![\w.])\d+"])
def test_gaps_are_those_of_split(spark, pattern):
    texts = ["", "a", "a b", "xa ab. 12(34)5", "\n12\n", "zzz", "é😀ab 12 a", ".1 1 x1 22"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("hits", F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))
    got = df.select("t", spans.gaps(F.col("t"), pattern, F.col("hits")).alias("got"), F.split("t", pattern, -1).alias("want"))
    assert [(r.t, r.got) for r in got.collect() if r.got != r.want] == []


def test_words_in_a_tree_are_those_of_the_list(spark):
    words = ["sant", "Sant Boi", "santa", "San Boi de Llobregat", "Sant Boi de Llobregat", "vic", "L'Hospitalet"]
    text = "SANT Boi de Llobregat, sant boi de, Santa vic vics l'hospitalet San  Boi santboi san boi de llobregats"
    df = spark.createDataFrame([(text,)], "t string")
    one, other = (df.select(F.regexp_extract_all("t", F.lit(rf"(?iU){lead}\b(?:{x})\b"), F.lit(0)).alias("x")).first().x for lead, x in (("", rules.any_of(words, " ")), (rules.first_of(words), rules.tree_of(words, " "))))
    assert one == other and len(one) == 5


def test_notes_are_not_made_twice(spark):
    """Rows without a span are known by what is made, not by making it again below the exchange."""
    plan = catalog.gold_spans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(array(" not in plan


def test_choice_of_all_rows_at_once_is_that_of_each():
    import random

    import numpy as np

    rng = random.Random(5)
    for _ in range(300):
        found = sorted((rng.randrange(4), s := rng.randrange(30), s + rng.randrange(1, 7), rng.randrange(3)) for _ in range(rng.randrange(40)))
        row, start, end, priority = np.array(found, np.int64).reshape(-1, 4).T
        kept = detect.resolved(row, start, end, priority)
        want = []
        for r in range(4):
            each = [(s, e, "", "", p, "") for q, s, e, p in found if q == r]
            want += [(r, s, e) for s, e, *_ in detect.greedy([(s, e, i) for _, _, s, i, e, *_ in detect.ranked(each)])]
        assert [(int(row[k]), int(start[k]), int(end[k])) for k in kept] == want


def test_touches_of_many_rows_are_those_of_each():
    import random

    from veilspark.operators import metrics

    rng = random.Random(9)
    spans = lambda: sorted(({"start": s, "end": s + rng.randrange(1, 9)} for s in (rng.randrange(40) for _ in range(rng.randrange(6)))), key=lambda s: s["start"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for _ in range(50):
        a, b = [spans() for _ in range(12)], [spans() for _ in range(12)]
        first, stop = metrics.touched_rows(metrics.Spans(pa.array(a, kind)), metrics.Spans(pa.array(b, kind)))
        assert list(zip(first.tolist(), stop.tolist())) == [t for x, y in zip(a, b) for t in metrics.touched(x, y)]
