"""Every rule on hand-worked texts, and names against what was found before them."""

import pytest

from veilspark.operators import detect, rules

#: Rule, text, the spans it must find.
CASES = [
    ("date", "31/05 y 1/2/2020, 05-2021; marzo-2020 el 3 de marzo, 3 de gener de 2020", ["31/05", "1/2/2020", "05-2021", "marzo-2020", "3 de marzo", "3 de gener de 2020"]),
    ("date", "5/2020 DIVENDRES 1998 2098 1898 sábado 31/13/2020", ["2020", "DIVENDRES", "1998", "2098", "sábado", "2020"]),
    ("time", "10:30 h, 7:05:09. 12:30 con", ["10:30 h", "7:05:09", "12:30 "]),
    ("phone", "612345678 +34 912 345 678, 0034-612-34-56-78 512345678", ["612345678", "+34 912 345 678", "0034-612-34-56-78"]),
    ("email", "a.b+c@x-y.es @x.es", ["a.b+c@x-y.es"]),
    ("url", "https://x.y/z?a, ftp://a www.b x-1.cat x.xyz", ["https://x.y/z?a,", "ftp://a", "www.b", "x-1.cat"]),
    ("doctor", "La Dra. Ana ruiz, doctor: pérez gil; dr HTA alta", ["Dra. Ana ruiz", "doctor: pérez gil"]),
    ("age", "45 años, 3a 7 AÑO", ["45 años", "3a", "7 AÑO"]),
    ("location", "de BARCELONA a Sant Andreu de la Barca y Perú", ["BARCELONA", "Sant Andreu de la Barca", "Perú"]),
    ("address", "Calle de la Rosa y Mar, 12 b; Av. Diagonal 3; calle Mayor", ["Calle de la Rosa y Mar, 12 b", "Av. Diagonal 3"]),
    ("family_relation", "su MADRE y el cònjuge", ["MADRE", "cònjuge"]),
    ("hospital", "Hospital de la Santa Creu i Sant Pau. hospital por dolor, Hospital 12 de Octubre", ["Hospital de la Santa Creu i Sant Pau", "Hospital 12 de Octubre"]),
    ("dni", "12345678Z 12345678A", ["12345678Z"]),
    ("nie", "X1234567L X1234567A", ["X1234567L"]),
    ("ss", "28/12345678/40", ["28/12345678/40"]),
    ("cip", "ABCD1234567890", ["ABCD1234567890"]),
    ("nhc_labeled", "NHC: 1234 Nº de historia 99999, nº hª #4567", ["NHC: 1234", "Nº de historia 99999", "nº hª #4567"]),
    ("nhc_22_5", "28 28 20943", ["28 28 20943"]),
    ("nhc_2_8_2", "28-1234567-40", ["28-1234567-40"]),
    ("plain", "(123456) 612345678 1234567890 12345", ["(123456)", "1234567890"]),
]


@pytest.mark.parametrize("name, text, want", CASES)
def test_rule(spark, name, text, want):
    rule = [r for r in rules.RULES if r.name == name]
    row = detect.matches(spark.createDataFrame([(text,)], "t string"), "t", rule).first()
    assert [m.surface for m in row.matches] == want
    assert all(text[m.start : m.end] == m.surface for m in row.matches)


def names(spark, text):
    row = detect.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string"), names=True).first()
    return [(c.rule, c.surface, c.start) for c in sorted(row.candidates, key=lambda c: c.seq) if c.rule in ("name_context", "name_single", "signature", "name_upper_comma", "discovery")]


@pytest.mark.parametrize(
    "text, want",
    [
        # a keyword announces names on its own line only; a prefix of a word will do
        ("Paciente: Ana Ruiz Gil\nvisto por Luis Pérez", [("name_context", "Ana Ruiz Gil", 10)]),
        ("nombres: ANA RUIZ\n", [("name_context", "ANA RUIZ", 9)]),
        # single words only after four of the keywords; form fields and keywords are none
        ("Nombre Marta Localidad Paciente", [("name_context", "Nombre Marta Localidad Paciente", 0)]),
        ("nombre: Marta, en su Localidad", [("name_single", "Marta", 8)]),
        # inside what was found before: nothing new
        ("apellidos: Ruiz Gil", [("name_context", "Ruiz Gil", 11)]),
        ("Fdo: Ana Ruiz\nFdo. Luis\nFdo: Hospital", [("signature", "Ana Ruiz\nFdo", 5), ("signature", "Luis\nFdo", 19)]),
        ("Remitido por: Ana Ruiz. ", [("signature", "Ana Ruiz", 14)]),
        ("GARCIA LOPEZ, JUAN y CURSO CLINICO", [("name_upper_comma", "GARCIA LOPEZ, JUAN", 0)]),
        # found once, looked for again where a word begins with it
        ("Paciente: Ana Ruiz.\nana ruizanda y Ana Ruiz", [("name_context", "Ana Ruiz", 10), ("discovery", "ana ruiz", 20), ("discovery", "Ana Ruiz", 35)]),
        ("", []),
    ],
)
def test_names(spark, text, want):
    assert names(spark, text) == want


def test_names_of_null_and_long_texts(spark):
    rows = [(1, None), (2, "nombre: Marta " + "x " * 50_000 + "\nMarta")]
    got = {r.doc_id: [c.rule for c in r.candidates] for r in detect.candidates(spark.createDataFrame(rows, "doc_id long, text string"), names=True).collect()}
    assert got == {1: [], 2: ["name_single", "discovery"]}
