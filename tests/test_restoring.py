"""Bending and restoring of many texts at a time: against Spark's expressions, on texts full of brackets, signs and odd characters."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.operators import mask, restoring
from veilspark.plans import catalog

PIECES = ["[ID_1]", "[NOMBRE_2]", "[FECHA_1]", "[NAME_2]", "[ id _ 1 ]", "[", "]", "*", "**", "s", "'s", "'", "ID", "nombre", "_", "1", "٣", " ", "\n", " ", "\x1c", "\x85", "\0", "\1", "ı", "İ", "ſ", "K", "é", "ß", "😀", "=", "[=ID_", "[NOMBRE_x]", "Ana "]
SURFACES = {"[ID_1]": "[FECHA_1]", "[NOMBRE_2]": "Ana", "[FECHA_1]": "*s]", "[ID_2]": "\0x"}


def mapping(rng):
    chosen = sorted(p for p in SURFACES if rng.random() < 0.6)
    return [(SURFACES[p], p.strip("[]").partition("_")[0], 1, p) for p in chosen]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(0, None, None), (1, None, mapping(rng)), (2, "", []), (3, "[ID_1]", None), (4, "[ID_1]", [(None, "ID", 1, "[ID_1]")])]
    # texts of placeholders alone, and of anything
    for k in range(5, 1600):
        some = PIECES[:4] + ["x ", "*", "s", "."] if k % 4 else PIECES
        out.append((k, "".join(rng.choice(some) for _ in range(rng.randint(0, 14))), mapping(rng)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, f"doc_id long, masked string, mapping {mask.MAPPING}").repartition(3).cache()


def by_spark(df):
    """Restored by expressions: no word is the user's own."""
    return mask.restore(df.withColumn("none", F.array().cast("array<string>")), tokens="none").drop("none")


def test_restore_is_that_of_expressions(frame):
    want = {r.doc_id: r.restored for r in by_spark(frame).collect()}
    got = {r.doc_id: r.restored for r in mask.restore(frame).collect()}
    assert {k: (got[k], x) for k, x in want.items() if got[k] != x} == {} and len(got) == len(want)


@pytest.mark.parametrize("names", [SURFACES, {"[ID_1]": "x", "[NOMBRE_2]": "Ana"}])
def test_one_mapping_for_all_rows(spark, rows, names):
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, masked string")
    same = df.withColumn("mapping", F.array(*[F.struct(F.lit(x).alias("surface"), F.lit(p).alias("placeholder")) for p, x in names.items()]))
    want = {r.doc_id: r.restored for r in by_spark(same).collect()}
    assert {r.doc_id: r.restored for r in mask.restore(df, mapping=names).collect()} == {r.doc_id: r.restored for r in mask.restore(same).collect()} == want


def test_bent_texts_are_those_of_expressions(spark, rows):
    texts = [t for _, t, _ in rows if t is not None] + ["[ORGANIZACION_12] [URL_1] [=X_[LUGAR_2][ANONIMO_3]", "ǆ ŉ ﬁ ς"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = df.select("t", *[bend(F.col("t")).alias(n) for n, (bend, _) in mask.PERTURBATIONS.items()]).collect()
    assert list(restoring.BEND) == list(mask.PERTURBATIONS)
    for r in want:
        assert dict(restoring.bent(r.t)) == {n: r[n] for n in restoring.BEND}
    # texts behind each other
    clear = [t for t in texts if restoring.APART not in t]
    every = {n: x.split(restoring.APART) for n, x in restoring.bent(restoring.APART.join(clear))}
    assert every == {n: [bend(t) for t in clear] for n, bend in restoring.BEND.items()}


def test_kept_when_bent_is_that_of_rows(frame, monkeypatch):
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), bend(F.col("masked")).alias("masked")) for n, (bend, _) in mask.PERTURBATIONS.items()]))
    back = by_spark(frame.where("size(mapping) > 0").select("mapping", each.alias("p")).select("mapping", "p.name", "p.masked"))
    whole = F.forall("mapping", lambda m: F.contains(F.col("restored"), m["surface"]))
    want = back.groupBy("name").agg(F.count("*").alias("texts"), F.count_if(whole).alias("restored"))
    got = mask.kept_when_bent(frame)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 9
    assert mask.kept_when_bent(frame.where("doc_id in (0, 2)")).count() == 0


@pytest.mark.parametrize("most", [restoring.MOST, 40])
def test_groups_of_texts(rows, most, monkeypatch):
    monkeypatch.setattr(restoring, "MOST", most)
    some = [(t or "", m) for _, t, m in rows]
    kind = pa.list_(pa.struct([("surface", pa.string()), ("tag", pa.string()), ("n", pa.int32()), ("placeholder", pa.string())]))
    lists = lambda x: pa.array([m and [dict(zip(("surface", "tag", "n", "placeholder"), s)) for s in m] for m in x], kind)
    alone = [restoring.restored([t], lists([m]))[0] for t, m in some]
    assert restoring.restored([t for t, _ in some], lists([m for _, m in some])) == alone
    assert restoring.restored([], lists([])) == []
    for wrong in ([("x", "ID", 1, "[ID_1]"), ("y", "ID", 1, "[ID_1]")], [("x", "ID", 1, None)]):
        with pytest.raises(ValueError):
            restoring.restored(["[ID_1]"], lists([wrong]))


def test_usual_texts_are_cut_without_the_pattern(monkeypatch):
    class Never:
        fullmatch = restoring._PLACEHOLDER.fullmatch

        def split(self, _):
            raise AssertionError("the pattern was tried")

    want = {n: restoring._PLACEHOLDER.split(t) for n, t in restoring.bent("a [ID_1], **[ID_2]** [NOMBRE_1]'s[FECHA_1]* *[ID_1]s*.")}
    monkeypatch.setattr(restoring, "_PLACEHOLDER", Never())
    for name, text in restoring.bent("a [ID_1], **[ID_2]** [NOMBRE_1]'s[FECHA_1]* *[ID_1]s*."):
        if name not in ("bold", "single_bracket"):  # four signs in a row
            assert restoring.cut(text)[0] == want[name]


def test_robustness_makes_no_row_of_a_bent_text(spark):
    plan = catalog.robustness(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "regexp" not in plan.split("MapInArrow")[0] and plan.count("MapInArrow") == 1


def test_masks_are_those_of_each_row(spark):
    rng, kind = random.Random(6), "array<struct<start:bigint,end:bigint,label:string,surface:string>>"
    rows = [(0, None, None), (1, None, [(0, 1, "ID", "x")]), (2, "abc", None), (3, "", [])]
    for k in range(4, 700):
        text, spans, at = "".join(rng.choice("aé😀 ") for _ in range(30)), [], rng.randint(0, 3)
        while at < 27:
            end = at + rng.randint(1, 3)
            spans.append((at, end, rng.choice([None, "ID", "NAME", "PHI", "none"]), text[at:end]))
            at = end + rng.randint(0, 4)
        rows.append((k, text, spans if k % 3 else rng.sample(spans, len(spans))))
    got = mask.mask_each(spark.createDataFrame(rows, f"doc_id long, text string, entities {kind}").repartition(2)).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [dict(zip(("start", "end", "label", "surface"), s)) for s in rows[r.doc_id][2] or []]
        names = mask.named(spans)
        assert [(m.surface, (m.tag, m.n, m.placeholder)) for m in r.mapping] == list(names.items())
        assert r.masked == (None if r.text is None else mask.spliced(r.text, spans, {x: p for x, (_, _, p) in names.items()}))
