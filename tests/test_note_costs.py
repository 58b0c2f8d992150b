"""What a note costs (F25): the usual forms follow from arrays, the text goes to Python once, and no pattern looks at a plain text."""

import random

import numpy as np
from pyspark.sql import functions as F

from veilspark.operators import detect, metrics, rules, swift
from veilspark.plans import notes

NOTE = "Customer#000003686 con DNI 29189447D, tel. 686031094, visto el 06/02/1998 a las 00:00, edad 18 años, correo user3686@mail.example.com, historia 1234567."


class Never:
    def match(self, *_):
        raise AssertionError("a pattern was tried")


def test_usual_forms_need_no_pattern(monkeypatch):
    for name in ("_DATE", "_TIME", "_AGE", "_PHONE", "_URL", "_EMAIL"):
        monkeypatch.setattr(swift, name, Never())
    finders = [(i, swift.FINDERS[r], r.check) for i, r in enumerate(rules.RULES) if r.name in ("date", "time", "phone", "email", "url", "age")]
    spans = swift.ordered(swift.found([NOTE, None, NOTE], finders)).T.tolist()
    found = [(k, rules.RULES[i].name, NOTE[s:e]) for k, i, s, e in spans]
    once = [("date", "06/02/1998"), ("time", "00:00"), ("phone", "686031094"), ("email", "user3686@mail.example.com"), ("url", "mail.example.com"), ("age", "18 años")]
    assert found == [(k, *x) for k in (0, 2) for x in once]


def test_a_text_goes_to_python_once(spark):
    df = spark.createDataFrame([(1, NOTE), (2, None), (3, NOTE + " ☎")], "doc_id long, text string")
    rows = detect.detect(df).pass_before[0]
    assert rows.columns == ["doc_id", "text", "r__far", "r__some"]
    assert [tuple(r) for r in rows.select("doc_id", "r__far", F.size("r__some")).orderBy("doc_id").collect()] == [(1, False, 0), (2, False, 0), (3, True, 1)]
    spans = {r.doc_id: [tuple(s) for s in r.entities] for r in detect.detect(df).collect()}
    assert len(spans[1]) == 8 and spans[1] == spans[3] and spans[2] == []


def test_class_of_other_characters_has_no_ranges():
    assert "-" not in swift.FAR
    plain = [chr(k) for k in range(0x3000) if not swift.re.fullmatch(swift.FAR, chr(k))]
    assert "".join(plain) == "\t\n\r" + "".join(map(chr, range(32, 127))) + "¡«°·»¿" + "".join(chr(k) for k in range(0xC0, 0x100) if k not in (0xD7, 0xF7))


def test_leftmost_and_covered_are_those_of_one_by_one():
    rng = random.Random(25)
    for _ in range(300):
        start = sorted(rng.sample(range(60), rng.randint(0, 15)))
        end = [s + rng.randint(1, 9) for s in start]
        want, last = [], 0
        for s, e in zip(start, end):
            if s >= last:
                want.append((s, e))
                last = e
        assert list(zip(*map(np.ndarray.tolist, swift.leftmost(np.array(start, np.int64), np.array(end, np.int64))))) == want
        texts = ["".join(rng.choice("ab  ñ\n") for _ in range(rng.randint(0, 20))) for _ in range(4)]
        words = metrics.words_of(texts)
        spans = [[(s, s + rng.randint(0, 6)) for s in (rng.randint(0, 19) for _ in range(rng.randint(0, 4)))] for _ in texts]
        flat = [x for row in spans for x in row]
        some = metrics.Spans.of(np.array([len(x) for x in spans]), np.array([s for s, _ in flat], np.int64), np.array([e for _, e in flat], np.int64))
        each = [any(s < b and a < e for s, e in spans[r]) for r, a, b in zip(words.row.tolist(), words.start.tolist(), words.end.tolist())]
        assert metrics.covered(words, some).tolist() == each


def test_true_spans_of_some_fields_are_the_same(spark, tmp_path):
    orders = [(1, 7, "1998-02-06"), (2, 12345678901, "2001-12-31"), (3, None, "1992-01-01"), (12345678, 5, None)]
    df = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string").select("o_orderkey", "o_custkey", F.col("d").cast("timestamp").alias("o_orderdate"))
    df.write.parquet(f"{tmp_path}/orders.parquet")
    whole = {r.doc_id: r for r in notes.notes(spark, str(tmp_path)).collect()}
    places = {r.doc_id: r for r in notes.notes(spark, str(tmp_path), fields=("start", "end")).collect()}
    for k, r in whole.items():
        assert places[k].text == r.text and [tuple(g) for g in places[k].gold] == [(g.start, g.end) for g in r.gold]
        if k < 3:
            assert [r.text[g.start : g.end] for g in r.gold] == [g.surface for g in r.gold] and len(r.gold) == 11
    # behind a segment that is null no place is known
    assert whole[3].gold[0].start == 9 and whole[3].gold[0].end is None and whole[3].gold[1].start is None
