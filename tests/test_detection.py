"""Gates, walks, and work that grows with a text and its spans, not their square."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilspark.operators import detect, mask, metrics, names, rules, spansets, walks

SF = "/root/testdata/sf0.001"
PIECES = (
    "31/05 1/2/2020 05-2021 marzo-2020 3 de marzo 3 DE gener de 2020 DİVENDRES dıvendres 1998 10:30 7:05:09 +34 0034 612345678 612-34-56-78 9 1 2 a@b.es x@y.z.org ana@ www.a http:// https://x.y/z?a x.com. "
    "y.es_ -z.net Dra. dr doctor: DOCTORA Ana ruiz HTA . : años AÑO 45 45a 3 a Barcelona OLOT Sant Boi de Llobregat L'Hospitalet Perú Calle C/ Av. de la Rosa y Mar , 12 b MADRE àvia hospital Hospital de la Santa Creu "
    "12 de Octubre 12345678Z X1234567L 28/12345678/40 ABCD1234567890 NHC: 1234 Nº de historia 99999 28 28 20943 28-1234567-40 (123456) 1.2.3.4 4111 1111 1111 1111 +1 (980) 555-6268 2024-02-29 ſants Kilo ٣٤ ６１２３４５６７８     \x1c \n"
).split(" ")


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    made = [(f"r{k}", rng.choice(["", " ", "  "]).join(rng.choice(PIECES) + rng.choice(["", "", " ", " ", ", "]) for _ in range(rng.randint(1, 12)))) for k in range(1500)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("k"), "text")
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select(F.concat_ws("-", "conv_id", "turn").alias("k"), "text")
    return docs.unionByName(turns).unionByName(spark.createDataFrame(made, "k string, text string")).repartition(4).cache()


@pytest.mark.parametrize("table", [rules.RULES, rules.WIDE_RULES])
def test_gates_keep_nothing_back(texts, table):
    """The same candidates with gates and without, on tables and on made-up texts of every rule's pieces."""
    of = lambda gated: {r.k: r.c for r in detect.candidates(texts, rules=table, gated=gated).select("k", F.to_json("candidates").alias("c")).collect()}
    gated, all_ = of(True), of(False)
    assert gated == all_ and sum(c != "[]" for c in gated.values()) > 150
    found = set(re.findall(r'"rule":"(\w+)"', " ".join(gated.values())))
    assert found >= {r.name for r in table} - {"nhc_2_8_2", "card"}


def test_null_and_empty_texts_have_no_spans(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "a@b.es", "z")], "doc_id long, text string, ENTITIES string")
    got = detect.detect(rows, names=True)
    assert sorted((r.doc_id, r.text, [e.surface for e in r.entities]) for r in got.collect() if r.text is not None) == [(2, "", []), (2, "a@b.es", ["a@b.es"])]
    assert got.columns == ["doc_id", "text", "entities"] and detect.detect(rows.where("false")).count() == 0


@pytest.mark.parametrize("with_names", [False, True])
def test_many_spans_in_one_text(spark, with_names):
    """Four times the spans take no more than four times as long, numbering and splicing included."""

    def run(n):
        text = " ".join(f"u{i}@x.es {600000000 + i}" for i in range(n // 2))
        began = time.perf_counter()
        done = mask.mask_each(detect.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), names=with_names)).select(F.size("entities").alias("n"), F.size("mapping").alias("m"), "masked").first()
        assert (done.n, done.m) == (n, n) and done.masked.startswith(f"[CORREO_{n // 2}] [TELEFONO_{n // 2}]") and done.masked.endswith("[CORREO_1] [TELEFONO_1]")
        return time.perf_counter() - began

    run(100)
    assert run(32_000) < 4 * run(8_000) + 1


def test_second_search_of_many_texts():
    """32,000 found texts in one text against 8,000; and all of it against a plain search."""

    def run(n):
        found, at, pieces = spansets.Found(), 0, []
        for i in range(n):
            name = f"Ana{i} Ruiz"
            found.add(at, at + len(name), "PERSON", name, 2, "name_context")
            pieces.append(name)
            at += len(name) + 1
        text = " ".join(pieces + [p.upper() for p in pieces])
        began = time.perf_counter()
        names.discovered(found, text)
        assert len(found.all) == 2 * n
        return time.perf_counter() - began

    run(100)
    assert run(32_000) < 5 * run(8_000) + 0.5
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["ana ", "Ana", "ANA,", "ſam ", "Sam ", "maría", "MARÍA ", "İker ", "iker ", "ana ruiz ", "-", "."]) for _ in range(14))
        found = spansets.Found()
        for m in list(re.finditer(r"\w[\w ]{3,7}", text))[:3]:
            found.add(*m.span(), f"L{m.start()}", m.group(), 2, "x")
        want = spansets.Found()
        for f in found.all:
            want.add(*f)
        low = [(names.fold(f[3]), f[2]) for f in found.all]
        wanted = {names.fold(t) for f in found.all if len(t := f[3].strip(names.EDGES)) > 3}
        for t in sorted(wanted, key=lambda t: (-len(t), t)):
            for m in re.finditer(r"\b" + re.escape(t), text, re.IGNORECASE):
                want.add_new(*m.span(), next(x for s, x in low if t in s), m.group(), 1, "discovery")
        names.discovered(found, text)
        assert found.all == want.all, text


def test_greedy_choice_is_that_of_comparing_all():
    rng = random.Random(3)
    for _ in range(300):
        spans = [(s := rng.randrange(40), s + rng.randint(1, 9), k) for k in range(rng.randint(0, 20))]
        kept = []
        for c in spans:
            if not any(c[0] < k[1] and k[0] < c[1] for k in kept):
                kept.append(c)
        assert spansets.greedy(spans) == sorted(kept)


def test_touches_are_those_of_comparing_all():
    rng = random.Random(4)
    for _ in range(300):
        make = lambda: sorted(({"start": (s := rng.randrange(30)), "end": s + rng.randint(1, 8)} for _ in range(rng.randint(0, 8))), key=lambda x: x["start"])
        spans, others = make(), make()
        over = lambda a, b: a["start"] < b["end"] and b["start"] < a["end"]
        for s, (first, _) in zip(spans, metrics.touched(spans, others)):
            assert first == next((i for i, o in enumerate(others) if over(s, o)), -1)
        for exact in (False, True):
            used, tp = set(), 0
            for g in spans:
                k = next((i for i, p in enumerate(others) if i not in used and (g == p if exact else over(g, p))), None)
                if k is not None:
                    used.add(k)
                    tp += 1
            assert metrics.greedy(spans, others, exact) == tp


def test_walks_on_hand_worked_texts():
    cases = {
        "date": ("1/2/20201 31/05/2020. 00/12/2020 12-11 9/2020 11/2020 3 de foo de 2020, 3 de  MAYO lunes-2 2100 1900 enero/20", ["31/05/2020", "12/2020", "12-11", "2020", "11/2020", "3 de foo de 2020", "3 de  MAYO", "lunes", "1900", "enero/20"]),
        "phone": ("612345678 +34 612345678 0034612 345 678 6123456789 a612345678 +612345678 6 1 2 3 4 5 6 7 8", ["612345678", "+34 612345678", "0034612 345 678", "612345678", "6 1 2 3 4 5 6 7 8"]),
        "url": ("ftp://x \"http://a.b\" site.www.x.es/y a.com.xyz b.org, c.netx éx.com -d.info www. e_f.cat", ["ftp://x", "http://a.b", "site.www.x.es", "a.com", "b.org", "d.info"]),
        "age": ("5 años 123a 1234 a 7  años 8\taños 9 año. 1 an", ["5 años", "123a", "8\taños", "9 año"]),
        "doctor": ("Dr.. Ana Gil 2 dra : luis, doctor.: x dr oi y dr oil", ["Dr.. Ana Gil", "dra : luis", "dr oil"]),
        "address": ("C/ Mayor 5 C./ Sol,12345 Calle de los Reyes; Calle de la Reina y san Pau 7 z, Avda Mar", ["C/ Mayor 5 C", "Calle de la Reina", "Avda Mar"]),
    }
    for name, (text, want) in cases.items():
        assert [text[s:e] for s, e in walks.WALKS[name](walks.Words(text))] == want, name
