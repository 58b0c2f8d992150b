"""Plain texts many at a time: the same candidates as one text at a time by patterns and walks."""

import random

from pyspark.sql import functions as F

from veilspark.operators import detect, rules, swift

PIECES = (
    "31/05 1/2/2020 05-2021 marzo-2020 3 de marzo DE gener de 2020 30 de de de 1999 DIVENDRES dijous/12 Enero-99 1998 2099 2100 10:30 7:05:09 23:59h :15 +34 0034 +34-612345678 0034612345678 34 612345678 612-34-56-78 9 1 2 "
    "6123456789 812345678a a@b.es a@b.es-x@c.com ñ-x@y.es -a@b.es .@x.es x@y.z.org ana@ @@ a%b@c.net_ u+v@w.info www.a www.1.2 Www. http:// https://x.y/z?a ftp://q x.com. y.es_ -z.net b.c.d 1.2.cat8 .org Dra. dr doctor: DOCTORA Ana "
    "ruiz HTA . : años AÑO año. 45 45a 3 a 12A 2020a 1a2 Barcelona OLOT Sant Boi de Llobregat L'Hospitalet l' Perú Calle C/ Av. de la Rosa y Mar , 12 b MADRE àvia hospital Hospital de la Santa Creu CAP Centro  Salud "
    "12 de Octubre 12345678Z 12345678z X1234567L x1234567L Z1234567R 28/12345678/40 ABCD1234567890 abcd1234567890 NHC: 1234 nhc1234 HC#12345 No de HC 4444 no 28 28 20943 28-12-20943 28-1234567-40 28/12345678/40/1 (123456) (612345678) 1234567) _ __ 7_ é« ·"
).split(" ")


def test_plain_texts_have_the_same_candidates(spark):
    rng = random.Random(23)
    gaps = ["", " ", " ", " ", "  ", "\n", "\t", ", ", ". ", "-", "/", ":", "("]
    made = [(k, "".join(rng.choice(PIECES) + rng.choice(gaps) for _ in range(rng.randint(1, 14)))) for k in range(6000)]
    assert sum(bool(t) for _, t in made) > 5000
    texts = spark.createDataFrame(made, "k long, text string").repartition(4).cache()
    of = lambda gated: {r.k: r.c for r in detect.candidates(texts, gated=gated).select("k", F.to_json("candidates").alias("c")).collect()}
    swiftly, each = of(True), of(False)
    by = dict(made)
    assert [(by[k], swiftly[k], each[k]) for k in by if swiftly[k] != each[k]][:3] == []
    assert texts.where(F.col("text").rlike(swift.FAR)).count() == 0


def test_plain_texts_are_cut_into_groups():
    assert list(swift.parts(["a", None, "", "b" * swift.MOST, "c", "d"])) == [[0], [3], [4, 5]]
    rule = [(7, swift.FINDERS[next(r for r in rules.RULES if r.name == "email")], None)]
    assert swift.found(["x", "a@b.es", None, "é c@d.es" + " z" * swift.MOST, "e@f.es"], rule).T.tolist() == [[1, 7, 0, 6], [3, 7, 2, 8], [4, 7, 0, 6]]
