"""Made-up prompts with known entities, one for each number of a table: each task makes its own.

A template is a list of segments, SQL that Spark and DuckDB read alike; a segment with a
label is an entity, and its name says which: mentions of one name are one entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What names and places are made from.
FIRST = "Ana Luis Marta Jordi Nuria Pablo Carme Diego".split()
LAST = "Ruiz Gil Vidal Soler Puig Ferrer Molina Serra Torres Vega Roca".split()
TOWNS = "Olot Reus Salou Berga Vic".split()


def pick(values: list[str], i: str) -> str:
    return f"case ({i}) % {len(values)} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"


NAME = f"{pick(FIRST, 'id')} || ' ' || {pick(LAST, 'id * 7 + cast(floor(id / 8) as bigint)')}"
OTHER = f"{pick(FIRST, 'id + 3')} || ' ' || {pick(LAST, 'id * 5 + 1')}"
DNI_NUMBER = "(10000000 + id * 37)"
DNI = f"cast({DNI_NUMBER} as string) || substr('TRWAGMYFPDXBNJZSQVHLCKE', cast({DNI_NUMBER} % 23 as int) + 1, 1)"
PHONE = "'6' || lpad(cast(id * 7919 % 100000000 as string), 8, '0')"
MAIL = "'p' || cast(id as string) || '@example.org'"
TOWN = pick(TOWNS, "id")

#: (SQL, label or None, entity) of each segment.
DEV = [
    [("'Paciente: '", None, ""), (NAME, "NAME", "a"), ("', DNI '", None, ""), (DNI, "ID", "b"), ("'\nVive en '", None, ""), (TOWN, "LOCATION", "c"), ("'. Avisar a '", None, ""), (NAME, "NAME", "a")],
    [("'nombre: '", None, ""), (NAME, "NAME", "a"), ("'\ntel: '", None, ""), (PHONE, "PHONE", "b"), ("'\ncorreo: '", None, ""), (MAIL, "EMAIL", "c")],
    [("'INSERT INTO t VALUES ('''", None, ""), (DNI, "ID", "a"), ("''', '''", None, ""), (MAIL, "EMAIL", "b"), ("''');\n-- '", None, ""), (DNI, "ID", "a")],
    [("'Fdo: '", None, ""), (NAME, "NAME", "a"), ("'. Copia a '", None, ""), (MAIL, "EMAIL", "b"), ("' y '", None, ""), (PHONE, "PHONE", "c")],
]
HELD_OUT = [
    [("'Asunto: cita de '", None, ""), (NAME, "NAME", "a"), ("' con '", None, ""), (OTHER, "NAME", "b")],
    [("'{\"dni\": \"'", None, ""), (DNI, "ID", "a"), ("'\", \"mail\": \"'", None, ""), (MAIL, "EMAIL", "b"), ("'\"}'", None, "")],
    [("'id;tel;mail\n1;'", None, ""), (PHONE, "PHONE", "a"), ("';'", None, ""), (MAIL, "EMAIL", "b"), ("'\n2;'", None, ""), (PHONE, "PHONE", "a")],
    [("'Familiar de contacto: '", None, ""), (OTHER, "NAME", "a"), ("', '", None, ""), (PHONE, "PHONE", "b")],
    [("'Remitido por: '", None, ""), (OTHER, "NAME", "a"), ("'. Desde '", None, ""), (TOWN, "LOCATION", "b")],
]


def prompts(ids: DataFrame, templates: list = DEV) -> DataFrame:
    """``id``, ``text``, ``gold`` (spans) and ``mentions`` (entity, surface, in order) for every ``id``."""
    most, kind = max(map(len, templates)), F.col("id") % len(templates)
    made = ids.select("id", *[F.expr(turns_sql([t[k][0] if k < len(t) else "''" for t in templates])).alias(f"s{k}") for k in range(most)])
    gold = []
    for k in range(most):
        at = reduce(lambda a, b: a + b, [F.length(f"s{j}") for j in range(k)], F.lit(0)).cast("bigint")
        label, entity = (reduce(lambda out, i: F.when(kind == i, F.lit(templates[i][k][f] if k < len(templates[i]) else None)).otherwise(out), range(len(templates)), F.lit(None).cast("string")) for f in (1, 2))
        gold.append(F.struct(at.alias("start"), (at + F.length(f"s{k}")).alias("end"), label.alias("label"), F.col(f"s{k}").alias("surface"), entity.alias("entity")))
    every = F.filter(F.array(*gold), lambda g: g["label"].isNotNull())
    out = made.select("id", F.concat(*[f"s{k}" for k in range(most)]).alias("text"), every.alias("gold"))
    return out.withColumn("mentions", F.transform("gold", lambda g: F.struct(g["entity"].alias("entity"), g["surface"].alias("surface"))))


# Keys that are no tags, and texts like tags but no whole placeholder.
NEUTRAL = "valor campo fila dato clave nota".split()
TAG_LIKE = "NOMBRE FECHA ID LUGAR CORREO".split()
NUMBER = "cast(100 + id * 37 % 900 as string)"
KEY = pick(NEUTRAL, "id")
NATURAL = [
    f"'if (x > 0) {{ arr[' || {NUMBER} || '] = ' || {KEY} || '_' || {NUMBER} || '; }}'",
    f"'{{\"' || {KEY} || '_' || {NUMBER} || '\": [' || {NUMBER} || ']}}'",
    f"'SELECT ' || {KEY} || '_' || {NUMBER} || ' FROM tabla WHERE id = ' || {NUMBER}",
    f"{KEY} || '_' || {NUMBER} || ',valor\n' || {NUMBER} || ',campo'",
]
TAG = pick(TAG_LIKE, "id")
ADVERSARIAL = [
    f"lower({TAG}) || '_1 = ' || {NUMBER}",
    f"'[' || {TAG} || '_2 , ' || {KEY}",
    f"{TAG} || '_3] y ' || {KEY}",
    f"'(' || {TAG} || '_1) [' || {KEY} || '_1]'",
]


def turns_sql(kinds: list[str]) -> str:
    return f"case id % {len(kinds)} " + " ".join(f"when {i} then {k}" for i, k in enumerate(kinds)) + " end"


def samples(ids: DataFrame, kinds: list[str]) -> DataFrame:
    """For every ``id`` a text without a whole placeholder, of each kind in turn."""
    return ids.select("id", F.expr(turns_sql(kinds)).alias("text"))
