"""Short notes made from customers, one kind of entity each: what every rule must find, by construction.

A case is SQL that Spark and DuckDB read alike: what stands before the entity, the entity,
what stands behind it.  Its place follows from lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import detect
from veilspark.operators.lexicon import CHECK_LETTERS

K = "c_custkey"
DNI = f"(({K} * 7919 + 13) % 100000000)"
FIRST = f"case {K} % 3 when 0 then 'Ana' when 1 then 'Luis' else 'Marta' end"
LAST = f"case {K} % 5 when 0 then 'Ruiz' when 1 then 'Gil' when 2 then 'Vidal' when 3 then 'Soler' else 'Puig' end"


def digits(x: str, width: int) -> str:
    return f"lpad(cast(({x}) as string), {width}, '0')"


def letter(x: str) -> str:
    return f"substr('{CHECK_LETTERS}', cast(({x}) % 23 as int) + 1, 1)"


#: Rule, label, before, entity, behind.
RULE_CASES = [
    ("date", "DATE", "'el '", f"{digits(f'1 + {K} % 28', 2)} || '/' || {digits(f'1 + {K} % 12', 2)}", "' vino'"),
    ("date", "DATE", "'desde '", f"{digits(f'1 + {K} % 12', 2)} || '-' || cast(2000 + {K} % 30 as string)", "', mal'"),
    ("date", "DATE", "'en '", f"case {K} % 4 when 0 then 'Marzo' when 1 then 'gener' when 2 then 'DILLUNS' else 'desembre-' || cast(2000 + {K} % 30 as string) end", "' pasado'"),
    ("time", "TIME", "'a las '", f"cast({K} % 24 as string) || ':' || {digits(f'{K} % 60', 2)} || ' h'", "', bien'"),
    ("phone", "PHONE", "'tel '", f"'+34 9' || {digits(f'{K} * 104729 % 100000000', 8)}", "'.'"),
    ("email", "EMAIL", "'a '", f"'u' || cast({K} as string) || '@x.example.org'", "' va'"),
    ("url", "URL", "'ver '", f"'www.x' || cast({K} as string) || '.cat/a'", "' hoy'"),
    ("doctor", "NAME", "'visto por '", f"'Dra. ' || {FIRST} || ' ' || {LAST}", "', bien'"),
    ("age", "AGE", "'tiene '", f"cast(1 + {K} % 99 as string) || ' años'", "' ya'"),
    ("location", "LOCATION", "'vive en '", f"case {K} % 4 when 0 then 'Sant Boi de Llobregat' when 1 then 'PERÚ' when 2 then 'Móra d''Ebre' else 'Olot' end", "', sola'"),
    ("address", "LOCATION", "'en '", f"'Carrer de la ' || {LAST} || ', ' || cast(1 + {K} % 99 as string)", "'; bajos'"),
    ("family_relation", "FAMILY", "'su '", f"case {K} % 3 when 0 then 'cuñada' when 1 then 'ÀVIA' else 'yerno' end", "' dice'"),
    ("hospital", "HOSPITAL", "'ingreso en '", f"'Hospital de la ' || {LAST} || ' i ' || {FIRST}", "', bien'"),
    ("dni", "ID", "'con '", f"{digits(DNI, 8)} || {letter(DNI)}", "' y'"),
    ("nie", "ID", "'con '", f"'Y' || {digits(K, 7)} || {letter(f'10000000 + {K}')}", "' y'"),
    ("ss", "ID", "'n. '", f"'28/' || {digits(K, 8)} || '/40'", "' y'"),
    ("cip", "ID", "'n. '", f"'ABCD' || {digits(K, 10)}", "' y'"),
    ("nhc_labeled", "ID", "'con '", f"'nº de historia ' || {digits(K, 5)}", "' y'"),
    ("nhc_22_5", "ID", "'n. '", f"'11 22 ' || {digits(K, 5)}", "' y'"),
    ("nhc_2_8_2", "ID", "'n. '", f"'11-' || {digits(K, 8)} || '-22'", "' y'"),
    ("plain", "ID", "'n. '", f"'(' || {digits(K, 7)} || ')'", "' y'"),
]
NAME_CASES = {
    "line_scoped_names": [
        ("name_context", "NAME", "'nota de hoy\nPaciente: '", f"{FIRST} || ' ' || {LAST}", "' con fiebre\notro dia'"),
        ("name_single", "NAME", "'nombre: '", FIRST, "', sigue igual'"),
    ],
    "signatures": [("signature", "NAME", "'texto.\nRemitido  por: '", f"{FIRST} || ' ' || {LAST}", "'. fin'")],
    "upper_comma_names": [("name_upper_comma", "OTHER", "'visto '", f"upper({LAST}) || ' ' || upper({LAST}) || ', ' || upper({FIRST})", "' bien'")],
    "discovery": [("discovery", "NAME", f"'Paciente: ' || {FIRST} || ' ' || {LAST} || '.\nluego '", f"lower({FIRST} || ' ' || {LAST})", "' dijo'")],
}


def notes(cases: list[tuple]) -> str:
    """SQL of ``doc_id``, ``rule``, ``label``, ``before``, ``surface``, ``behind``."""
    pick = lambda f: " ".join(f"when {i} then {f(c)}" for i, c in enumerate(cases))
    at = f"{K} % {len(cases)}"
    return f"select {K} as doc_id, case {at} {pick(lambda c: repr(c[0]))} end as rule, case {at} {pick(lambda c: repr(c[1]))} end as label, case {at} {pick(lambda c: c[2])} end as before, case {at} {pick(lambda c: c[3])} end as surface, case {at} {pick(lambda c: c[4])} end as behind from customer"


def found(cases: list[tuple], names: bool, whitelist: DataFrame | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(K)
        made = spark.sql(notes(cases).replace("from customer", "from {customer}").replace("\n", "\\n"), customer=customer)
        texts = made.select("doc_id", F.col("rule").alias("wanted"), F.concat("before", "surface", "behind").alias("text"))
        spans = detect.candidates(texts, names=names, whitelist=whitelist).select("doc_id", "wanted", F.explode("candidates").alias("c")).where("c.rule = wanted")
        return spans.select("doc_id", F.col("c.rule").alias("rule"), F.col("c.label").alias("label"), F.col("c.start").alias("span_start"), F.col("c.end").alias("span_end"), F.col("c.surface").alias("surface"))

    return run


def found_sql(cases: list[tuple]) -> str:
    return f"SELECT doc_id, rule, label, CAST(length(before) AS BIGINT) AS span_start, CAST(length(before) + length(surface) AS BIGINT) AS span_end, surface FROM ({notes(cases)})"


def queries() -> dict:
    return {"rule_spans": found(RULE_CASES, False)} | {n: found(c, True) for n, c in NAME_CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {"rule_spans": found_sql(RULE_CASES)} | {n: found_sql(c) for n, c in NAME_CASES.items()}
