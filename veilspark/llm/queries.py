"""The numbered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, language, packing, pii, quality, ranked_search, secrets, simhash, sketch, token_table, toxicity, url_filter
from .common import crc_of_id, shared_dir, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode_text(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    back = bpe.decode_ids(ids.drop("text"), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-tables")
    token_table.write_tables(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)

    def checksum(batches):
        for b in batches:
            crc = [zlib.crc32(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return token_table.read_tables(spark, path).mapInArrow(checksum, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_of_id(F.col("doc_id")) % 4 == 2
    model = language.fit(docs.where(~held_out))
    found = language.predict(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_next(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_of_id(F.col("doc_id")) % 5 == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.predict(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)
    return packing.pack(pieces, docs.count(), capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.index(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"), k=10)


#: The rules of ``op12_url_filter``: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults: a row's identifiers settle which one it gets; dropped rows stay, with ``present`` false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = turns.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    return rows.drop("again")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))


def queries() -> dict:
    ops = (op1_bpe, op2_token_tables, op3_secrets, op4_quality, op5_language, op6_pii, op7_sketch, op8_toxicity, op9_packing, op10_simhash, op11_ranked_search, op12_url_filter, op13_conversations)
    return {f.__name__: f for f in ops}


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT k, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT k, i, a, lead(a, 1) OVER (PARTITION BY k ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY k ORDER BY i) AS c FROM p),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM g WHERE c IS NOT NULL),
again AS (SELECT k, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) v(j) WHERE n > 1 GROUP BY k),
f AS (SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
  len(ls) AS n_lines, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS upper, length(t) - length(replace(t, '!', '')) AS marks
  FROM w LEFT JOIN again USING (k)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 3 * upper > word_chars OR 2 * marks > n_words OR word_chars < 2 * n_words OR word_chars > 16 * n_words) AS kept
FROM j
"""


OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT k, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM t WHERE len(ws) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM s),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
p AS MATERIALIZED (SELECT k, w, CAST(count(*) AS BIGINT) AS tf FROM (SELECT k, unnest(ws) AS w FROM s) WHERE w IN (SELECT w FROM q) GROUP BY k, w),
d AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM g) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p GROUP BY w),
i AS (SELECT k, w, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)) AS impact FROM p JOIN s USING (k), g),
r AS (SELECT item_id, k, CAST(sum(weight * impact) AS BIGINT) AS score FROM q JOIN d USING (w) JOIN i USING (w) GROUP BY item_id, k),
o AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM r JOIN s USING (k) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""

OP12_SQL = r"""
WITH r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT s.k, arg_max(h || p, (length(h) + length(p), length(h))) AS rule, arg_max(v, (length(h) + length(p), length(h))) AS v
  FROM s JOIN r ON (s.host = h OR suffix(s.host, '.' || h)) AND starts_with(s.path, p) GROUP BY s.k)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM s LEFT JOIN f USING (k)
"""


def _op13_sql() -> str:
    """Backward dynamic programming over each conversation's rows: per state the least (cost, audit) and its text."""
    none = f"{{'c': 1000000000, 'a': '', 't': ''}}"
    least = lambda *x: f"list_sort([{', '.join(x)}])[1]"
    piece = lambda head, rest: f"{head} || CASE WHEN {rest} = '' THEN '' ELSE chr(10) || {rest} END"
    edit = lambda f, cost, letter, head: f"{{'c': {f}.c + {cost}, 'a': '{letter}' || {f}.a, 't': {piece(head, f + '.t') if head else f + '.t'}}}"
    new = {"z": ("u", "user"), "s": ("u", "user"), "a": ("u", "user"), "u": ("a", "assistant")}
    keep = {"z": [("s", "s"), ("u", "u")], "s": [("u", "u")], "a": [("u", "u")], "u": [("a", "a")]}

    def insert(f: str, q: str) -> str:
        return edit(f, 5, "I", f"'{new[q][1]}:'")

    def closed(g: dict[str, str]) -> str:
        u, a = least(g["u"], insert(g["a"], "u")), least(g["a"], insert(g["u"], "a"))
        return f"{{'z': {least(g['z'], insert('(' + u + ')', 'z'))}, 's': {least(g['s'], insert('(' + u + ')', 's'))}, 'u': {u}, 'a': {a}}}"

    def row(q: str) -> str:
        to, role = new[q]
        kept = "".join(f"WHEN x.i = '{i}' THEN {edit('f.' + p, '5 * x.cut', 'K', "x.role || ':' || x.text")} " for i, p in keep[q])
        keeps = f"CASE WHEN x.gone THEN {none} {kept} ELSE {none} END"
        reroled = f"CASE WHEN x.gone THEN {none} ELSE {edit('f.' + to, '1 + 5 * x.cut', 'R', "'" + role + ":' || x.text")} END"
        return least(edit("f." + q, 2, "D", ""), keeps, reroled)

    zero = "{'c': 0, 'a': '', 't': ''}"
    ends = closed({"z": zero, "s": none, "u": none, "a": zero})
    rows = f"{{'z': {row('z')}, 's': {row('s')}, 'u': {row('u')}, 'a': {row('a')}}}"
    inserted = closed({q: f"g.{q}" for q in "zsua"})
    return rf"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
n AS (SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again FROM n WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS again_seen,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen FROM d),
e AS (SELECT *, CASE WHEN seen = '' THEN 'b' WHEN again_seen THEN 'd' WHEN NOT regexp_matches(seen, '[.!?]$') THEN 't' ELSE '' END AS fault, left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, list({{'role': role, 'text': text, 'i': left(role, 1), 'gone': fault IN ('b', 'd'), 'cut': CAST(fault = 't' AS INTEGER)}} ORDER BY i DESC) AS xs FROM e GROUP BY conv_id),
b AS (SELECT *, list_reduce(xs, lambda f, x: list_transform([{rows}], lambda g: {inserted})[1], {ends}).z AS f FROM c)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(f.c, 0) AS BIGINT) AS cost, coalesce(f.a, '') AS audit, sha256(coalesce(f.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN b ON v.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": OP4_SQL, "op11_ranked_search": OP11_SQL, "op12_url_filter": OP12_SQL, "op13_conversations": _op13_sql()}
