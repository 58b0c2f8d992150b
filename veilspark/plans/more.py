"""Queries over request bodies, scored spans, made-up prompts and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.deltas import char_delta
from veilspark.functions.spans import held, with_spans
from veilspark.operators import admission, detect, lexicon, mask, metrics, requests, rules, scored
from veilspark.sources import results, synthetic

from . import cases
from . import notes as N


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- requests


def role_message_masking(spark, sf):
    """Conversations as request bodies: masked, restored, compared; a system prompt beside the messages."""
    turns = _t(spark, sf, "conversations").where("text is not null")
    message = F.struct("turn", F.struct(F.lit("user").alias("role"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Paciente: Ana Ruiz, "), "text")).otherwise(F.col("text")).alias("content")).alias("m"))
    body = F.to_json(F.struct(F.lit("m1").alias("model"), F.transform(F.array_sort(F.collect_list(message)), lambda x: x["m"]).alias("messages"), F.lit("nombre: Ana Ruiz, hora 14").alias("system")))
    bodies = turns.groupBy("conv_id").agg(F.count("*").alias("n_messages"), body.alias("body"))
    masked, keys = requests.mask_bodies(bodies, "conv_id")
    back = requests.restore_bodies(masked.withColumnRenamed("body", "before"), keys, "conv_id", "masked")
    clear = F.coalesce(F.contains("masked", F.lit("Ana Ruiz")), F.lit(True))
    return back.select("conv_id", "n_messages", F.coalesce("reason", F.lit("ok")).alias("reason"), clear.alias("in_clear"), (F.from_json("restored", "variant").cast("string") == F.from_json("before", "variant").cast("string")).alias("same"))


#: Bodies and why they are refused.
BODIES = [
    ('{"model": "m", "prompt": "hola", "stream": false}', "ok"),
    ('{"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}]}], "tools": []}', "ok"),
    ('{"input": ["a", "b"], "encoding_format": "float", "keep_alive": "5m", "options": {"seed": 1, "deep": [[1], {"a": null}]}}', "ok"),
    ("[1]", "body is no object"),
    ("{", "body is no object"),
    ('{"messages": "x"}', "messages must be a list"),
    ('{"messages": [{"role": "user"}]}', "unsupported message"),
    ('{"messages": [{"role": "user", "content": 1}]}', "unsupported message content"),
    ('{"messages": [{"role": "user", "content": [{"type": "image", "text": "x"}]}]}', "unsupported message content part"),
    ('{"prompt": ["a", 1]}', "unsupported text field"),
    ('{"prompt": "a", "options": {"images": ["x"]}}', "unsupported content"),
    ('{"prompt": "a", "options": {"deep": [{"note": "secret"}]}}', "unsupported string field"),
    ('{"messages": [{"role": "boss", "content": "x"}]}', "unsupported string field"),
    ('{"prompt": "a", "format": "xml"}', "unsupported string field"),
]


#: Keys that would pass for positions or for several parts if paths were joined texts.
FORGED = [
    ('{"input/[]": "llama a x@y.org"}', "unsupported string field"),
    ('{"input": {"[]": "x"}}', "unsupported text field"),
    ('{"messages/[]/role": "user", "prompt": "x"}', "unsupported string field"),
    ('{"messages [] role": "user", "prompt": "x"}', "unsupported string field"),
    ('{"messages": [{"role": "user", "content": [{"text,type": "x"}]}]}', "unsupported message content part"),
    ('{"messages": [{"role": "user", "content": "x", "content/[]/text": "y"}]}', "unsupported string field"),
    ('{"prompt": "x", "/model": "y"}', "unsupported string field"),
    ('{"prompt": "x", "": {"model": "y"}}', "unsupported string field"),
    ('{"prompt": "x", "options": {"[]": {"images": 1}}}', "unsupported content"),
]


def _bodies(spark, sf):
    """Each turn's text in a request body: in a place where it may be, or in one of those that refuse the body."""
    shapes = BODIES + FORGED
    shape = F.element_at(F.array(*[F.lit(b) for b, _ in shapes]), ((F.col("conv_id") + F.col("turn")) % len(shapes) + 1).cast("int"))
    text = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.substring(text, F.lit(6), F.length(text) - 6)
    return _t(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.replace(shape, F.lit('"x"'), quoted).alias("body"))


def json_path_allowlist(spark, sf):
    """Every turn is sent in one of the bodies; any leaf that isn't known refuses it."""
    found = requests.leaves(_bodies(spark, sf))
    texts = F.size(F.filter("leaves", requests.is_text)).cast("long")
    why = requests.reason()
    return found.select("conv_id", "turn", F.coalesce(why, F.lit("ok")).alias("reason"), F.when(why.isNull(), texts).otherwise(0).alias("n_texts"))


def stream_events(spark, sf):
    """Whole answers as the events that a client of a stream expects."""
    turns = _t(spark, sf, "conversations").where("text is not null")
    usage = F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("total_tokens"), F.length("text").cast("bigint")))
    choice = F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message"), F.when(F.col("turn") % 3 == 0, "length").alias("finish_reason"))
    body = F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("id"), F.array(choice).alias("choices"), usage.alias("usage")))
    made = requests.stream_events(turns.select("conv_id", "turn", body.alias("body")))
    get = lambda p: F.get_json_object("event", p)
    return made.select("conv_id", "turn", F.col("event_no").cast("long").alias("event_no"), get("$.object").alias("object"), get("$.choices[0].delta.content").alias("content"), get("$.choices[0].finish_reason").alias("finish"), get("$.usage.total_tokens").cast("long").alias("tokens"))


# -- scored spans


def best_scored_spans(spark, sf):
    """Of spans at one place of an order the one with the best score, the first of equal ones."""
    rows = _t(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 10).alias("span_start"), F.col("l_returnflag").alias("label"), F.col("l_discount").alias("score"), (F.col("l_linenumber") * 1000 + F.ascii("l_returnflag")).alias("seq"))
    return scored.best(rows, ["l_orderkey", "span_start"])


def longest_from_left(spark, sf):
    start = F.col("l_partkey") % 50
    span = F.struct(start.alias("start"), (start + 1 + F.col("l_suppkey") % 12).alias("end"), F.col("l_returnflag").alias("label"))
    packed = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(span).alias("spans"))
    kept = packed.select("l_orderkey", F.explode(scored.longest_from_left(F.col("spans"))).alias("s"))
    return kept.select("l_orderkey", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "s.label")


SURFACES = ["a", " 12 ", "12345", "  ", "Ana", "abc", "1234"]


def noise_filter(spark, sf):
    """Which scored texts are noise: low scores, blanks, single characters, short numbers, listed words."""
    surface = F.element_at(F.array(*map(F.lit, SURFACES)), (F.col("c_custkey") % len(SURFACES) + 1).cast("int"))
    return _t(spark, sf, "customer").select("c_custkey", scored.is_noise(surface, F.col("c_custkey") % 20 / 40, whitelist=["abc"]).alias("noise"))


def limited_labels(spark, sf):
    """Of an external detector's labels those of a few classes, under their unified names."""
    labels = ["PERSON", "LOCATION", "DATE_TIME", "EMAIL_ADDRESS", "NRP"]
    label = lambda k: F.element_at(F.array(*map(F.lit, labels)), ((F.col("c_custkey") + k) % len(labels) + 1).cast("int"))
    spans = F.array(*[F.struct(F.lit(5 * k).alias("start"), F.lit(5 * k + 3 * (k % 3)).alias("end"), label(k).alias("label")) for k in range(4)])
    kept = _t(spark, sf, "customer").select("c_custkey", F.explode(scored.limited(spans)).alias("s"))
    return kept.select("c_custkey", F.col("s.start").alias("span_start"), "s.label")


def corpus_labels(spark, sf):
    """Unified labels of annotated ones, with and without a position in the span."""
    names = [*lexicon.CORPUS_LABELS, "ANON", "NO_SUCH"]
    label = F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % len(names) + 1).cast("int"))
    return _t(spark, sf, "customer").select("c_custkey", scored.unified(F.concat(F.when(F.col("c_custkey") % 2 == 0, "B-").otherwise(""), label)).alias("label"))


# -- made-up texts


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"))


IDS_SQL = "(SELECT c_custkey AS id FROM customer)"


def _prompts(templates: list):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        listed = F.array_join(F.transform("gold", lambda g: F.concat_ws(":", g["start"], g["end"], g["label"], g["entity"])), "|")
        return synthetic.prompts(_ids(spark, sf), templates).select("id", "text", listed.alias("gold"))

    return run


def _prompts_sql(templates: list) -> str:
    def gold(t: list) -> str:
        at, out = "0", []
        for sql, label, entity in t:
            if label:
                out.append(f"CAST({at} AS VARCHAR) || ':' || CAST({at} + length({sql}) AS VARCHAR) || ':{label}:{entity}'")
            at += f" + length({sql})"
        return " || '|' || ".join(out)

    return f"SELECT id, {synthetic.turns_sql([' || '.join(s for s, _, _ in t) for t in templates])} AS text, {synthetic.turns_sql([gold(t) for t in templates])} AS gold FROM {IDS_SQL}".replace("cast(id as string)", "cast(id as varchar)")


def prompt_consistency(spark, sf):
    """Entities of made-up prompts whose found mentions share a placeholder, and collisions, by template."""
    found = detect.detect(synthetic.prompts(_ids(spark, sf)).withColumnRenamed("id", "doc_id"), names=True)
    named = mask.mask_each(found).withColumn("names", F.map_from_entries(F.transform("mapping", lambda m: F.struct(m["surface"], m["placeholder"]))))
    both = metrics.consistency(named).unionByName(metrics.collisions(named), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


#: An original that shares no character with a placeholder.
ORIGINAL = "ññ"


def spurious_restores(spark, sf):
    """Texts without a whole placeholder but for one in ten that has one behind it, restored with every tag known: those alone may change."""
    tags = sorted(set(lexicon.TAGS.values()))
    known = {f"[{tag}_{n}]": ORIGINAL for tag in tags for n in (1, 2, 3)}
    kinds = {"natural": synthetic.NATURAL, "adversarial": synthetic.ADVERSARIAL}
    rows = None
    for kind, templates in kinds.items():
        part = synthetic.samples(_ids(spark, sf), templates).withColumn("kind", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("text", F.when(F.col("id") % 10 == 0, F.concat("text", F.lit(" [FECHA_1]"))).otherwise(F.col("text")))
    back = mask.restore(rows, "text", known, "restored")
    changed = F.col("text") != F.col("restored")
    return back.groupBy("kind").agg(F.count("*").alias("samples"), F.count_if(changed).alias("altered"), F.sum(F.length("text")).alias("chars"), F.sum(F.when(changed, char_delta(F.col("text"), F.col("restored"))).otherwise(0)).cast("long").alias("altered_chars"))


def whitelisted_names(spark, sf):
    """Names on announced lines but for those on a white list that is made from the table."""
    named = f"lower({cases.FIRST} || ' ' || {cases.LAST})"
    listed = _t(spark, sf, "customer").where("c_custkey % 15 in (0, 7)").selectExpr(f"{named} as word").distinct()
    return cases.found(cases.NAME_CASES["line_scoped_names"], True, listed)(spark, sf)


def capabilities(spark, sf):
    """The return flags of each order as capabilities, with one more where it lacks it."""
    modes = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("modes"))
    return modes.select("l_orderkey", F.array_join(requests.with_capability(F.col("modes"), "R"), ",").alias("capabilities"))


def dotted_addresses(spark, sf):
    """Version 6 addresses with a dotted tail in networks written alike."""
    e = F.col("event_id")
    ip = F.concat_ws(".", F.lit("::ffff:10.0"), (e % 4).cast("string"), (e % 300).cast("string"))
    return _t(spark, sf, "events").select("event_id", ip.alias("ip"), admission.in_networks(ip, ["::ffff:10.0.1.0/120", "10.0.0.0/8"]).alias("allowed"))


def combined_redaction_sources(spark, sf):
    """Words that rules and a second detector take out beside true spans, by which of them did."""
    found = with_spans(N.notes(spark, sf), "text", {"m__number": r"\b10000\d\b", "m__word": r"\bvisto\b"})
    as_spans = lambda c, k, label: F.transform(F.filter(c, lambda s: F.col("doc_id") % 3 == k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(label).alias("label")))
    model = F.array_sort(F.concat(as_spans("m__number", 0, "ID"), as_spans("m__word", 2, "NAME")))
    ready = found.select("doc_id", "text", "gold", held(model).alias("model"))
    both = detect.arbitrate(detect.detect(ready, out="rules"), "rules", "model", out="pred")
    return metrics.over_redaction_sources(both)


#: Systems of few rules beside the whole table.
FEW = {"contacts": ("email", "phone"), "times": ("date", "time", "age")}


def best_system(spark, sf):
    """Relaxed F1 of systems, and which is best."""
    systems = {"all": rules.RULES} | {n: [r for r in rules.RULES if r.name in names] for n, names in FEW.items()}
    scores = None
    for name, chosen in systems.items():
        found = detect.detect(N.notes(spark, sf), rules=chosen, out="pred")
        one = metrics.span_scores(found, exact=False).select(F.lit(name).alias("system"), "f1")
        scores = one if scores is None else scores.unionByName(one)
    return metrics.best_by(scores)


def unmapped_gold_labels(spark, sf):
    """True labels that a system of few classes lacks, and how many spans have them."""
    return metrics.unmapped(N.notes(spark, sf), {v: v for v in scored.LIMITED.values()})


def leak_examples(spark, sf):
    """The first documents that leak by the wide definition, and what."""
    found = detect.detect(N.notes(spark, sf), out="pred")
    return metrics.leak_examples(found, 10).select("doc_id", F.array_join("lost", "|").alias("lost"))


def metrics_report(spark, sf):
    """The table of strict scores by class as lines of Markdown."""
    scores = metrics.per_class(detect.detect(N.notes(spark, sf), out="pred"))
    shown = scores.select("label", *[results.percent(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("string").alias("support"))
    return results.report("Strict scores by class", shown, ["label", "precision", "recall", "f1", "support"], ["label"])


def queries() -> dict:
    listed = [role_message_masking, json_path_allowlist, stream_events, best_scored_spans, longest_from_left, noise_filter, limited_labels, corpus_labels, prompt_consistency, spurious_restores, metrics_report, whitelisted_names, capabilities, dotted_addresses, combined_redaction_sources, best_system, unmapped_gold_labels, leak_examples]
    return {f.__name__: f for f in listed} | {"synthetic_prompts": _prompts(synthetic.DEV), "heldout_prompts": _prompts(synthetic.HELD_OUT)}


def oracle_sql() -> dict[str, str]:
    from .oracles import sql

    pick = lambda values, i: f"[{', '.join(repr(v) for v in values)}][CAST(({i}) % {len(values)} AS INT) + 1]"
    names = [*lexicon.CORPUS_LABELS, "ANON", "NO_SUCH"]
    unified = [*lexicon.CORPUS_LABELS.values(), "PHI", "OTHER"]
    assert len(names) == len(unified)
    out = {
        "role_message_masking": "SELECT conv_id, count(*) AS n_messages, 'ok' AS reason, false AS in_clear, true AS same FROM conversations WHERE text IS NOT NULL GROUP BY 1",
        "json_path_allowlist": f"SELECT conv_id, turn, {pick([r for _, r in BODIES + FORGED], 'conv_id + turn')} AS reason, CAST({pick(['1', '1', '2'] + ['0'] * (len(BODIES + FORGED) - 3), 'conv_id + turn')} AS BIGINT) AS n_texts FROM conversations WHERE text IS NOT NULL",
        "stream_events": """WITH c AS (SELECT conv_id, turn, text, unnest(CASE WHEN turn % 2 = 0 THEN [0, 1, 2] ELSE [0, 1] END) AS k FROM conversations WHERE text IS NOT NULL)
          SELECT conv_id, turn, CAST(k AS BIGINT) AS event_no, 'chat.completion.chunk' AS object, CASE WHEN k = 0 THEN text END AS content, CASE WHEN k = 1 THEN CASE WHEN turn % 3 = 0 THEN 'length' ELSE 'stop' END END AS finish, CAST(CASE WHEN k = 2 THEN length(text) END AS BIGINT) AS tokens FROM c""",
        "best_scored_spans": "SELECT l_orderkey, span_start, label, score, seq FROM (SELECT l_orderkey, l_partkey % 10 AS span_start, l_returnflag AS label, l_discount AS score, CAST(l_linenumber * 1000 + ascii(l_returnflag) AS INT) AS seq, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 10 ORDER BY l_discount DESC, l_linenumber * 1000 + ascii(l_returnflag)) AS k FROM lineitem) WHERE k = 1",
        "longest_from_left": """WITH RECURSIVE s AS (SELECT l_orderkey AS o, l_partkey % 50 AS a, l_partkey % 50 + 1 + l_suppkey % 12 AS b, l_returnflag AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 50, l_suppkey % 12 DESC, l_returnflag) AS k FROM lineitem),
          f AS (SELECT o, k, a, b, label, true AS kept, b AS reach FROM s WHERE k = 1 UNION ALL SELECT s.o, s.k, s.a, s.b, s.label, s.a >= f.reach, CASE WHEN s.a >= f.reach THEN s.b ELSE f.reach END FROM f JOIN s ON s.o = f.o AND s.k = f.k + 1)
          SELECT o AS l_orderkey, a AS span_start, b AS span_end, label FROM f WHERE kept""",
        "noise_filter": f"SELECT c_custkey, c_custkey % 20 / 40 < 0.1 OR trim(s) IN ('', 'a', '12', '1234', 'abc') AS noise FROM (SELECT c_custkey, {pick(SURFACES, 'c_custkey')} AS s FROM customer)",
        "limited_labels": f"SELECT c_custkey, CAST(5 * k AS INT) AS span_start, label FROM (SELECT c_custkey, k, {pick(['NAME', 'LOCATION', '', 'EMAIL', ''], 'c_custkey + k')} AS label FROM customer, (VALUES (1), (2)) v(k)) WHERE label <> ''",
        "corpus_labels": f"SELECT c_custkey, {pick(unified, 'c_custkey')} AS label FROM customer",
        "spurious_restores": " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS samples, count_if(id % 10 = 0) AS altered, CAST(sum(length({synthetic.turns_sql(t)}) + CASE WHEN id % 10 = 0 THEN 10 ELSE 0 END) AS BIGINT) AS chars, CAST(9 * count_if(id % 10 = 0) AS BIGINT) AS altered_chars FROM {IDS_SQL}".replace("cast(id as string)", "cast(id as varchar)") for k, t in (("natural", synthetic.NATURAL), ("adversarial", synthetic.ADVERSARIAL))),
        "prompt_consistency": f"SELECT n AS entities, n AS consistent, docs, CAST(0 AS BIGINT) AS collisions FROM (SELECT CAST(sum({synthetic.turns_sql([str(len({e for _, label, e in t if label})) for t in synthetic.DEV])}) AS BIGINT) AS n, count(*) AS docs FROM {IDS_SQL})",
        "whitelisted_names": f"WITH f AS ({cases.found_sql(cases.NAME_CASES['line_scoped_names'])}) SELECT * FROM f WHERE lower(surface) NOT IN (SELECT lower({cases.FIRST} || ' ' || {cases.LAST}) FROM customer WHERE c_custkey % 15 IN (0, 7))",
        "capabilities": "SELECT l_orderkey, list_aggregate(CASE WHEN list_contains(m, 'R') THEN m ELSE list_append(m, 'R') END, 'string_agg', ',') AS capabilities FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS m FROM lineitem GROUP BY 1)",
        "dotted_addresses": "SELECT event_id, '::ffff:10.0.' || CAST(event_id % 4 AS VARCHAR) || '.' || CAST(event_id % 300 AS VARCHAR) AS ip, event_id % 4 = 1 AND event_id % 300 < 256 AS allowed FROM events",
        "combined_redaction_sources": f"""{N.cte()}, model AS MATERIALIZED (SELECT doc_id, span_start, span_end FROM ({N.spans_sql('notes', 'doc_id', 'text', chr(92) + 'b10000' + chr(92) + 'd' + chr(92) + 'b')}) WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, span_start, span_end FROM ({N.spans_sql('notes', 'doc_id', 'text', chr(92) + 'bvisto' + chr(92) + 'b')}) WHERE doc_id % 3 = 2),
          f AS (SELECT EXISTS (SELECT 1 FROM gold b WHERE w.doc_id = b.doc_id AND w.word_start < b.span_end AND b.span_start < w.word_end) AS g, EXISTS (SELECT 1 FROM model b WHERE w.doc_id = b.doc_id AND w.word_start < b.span_end AND b.span_start < w.word_end) AS m,
            (SELECT arg_min(b.label, b.span_start) FROM pred b WHERE w.doc_id = b.doc_id AND w.word_start < b.span_end AND b.span_start < w.word_end) AS r FROM words w)
          SELECT CASE WHEN m AND r IS NOT NULL THEN 'model+rule' WHEN m THEN 'model' ELSE 'rule:' || r END AS source, count(*) AS words FROM f WHERE NOT g AND (m OR r IS NOT NULL) GROUP BY 1""",
        "best_system": f"""{N.cte()}, y AS MATERIALIZED (SELECT 'all' AS system, doc_id, span_start, span_end FROM pred UNION ALL SELECT 'contacts', doc_id, span_start, span_end FROM cand WHERE label IN ('EMAIL', 'PHONE') UNION ALL SELECT 'times', doc_id, span_start, span_end FROM cand WHERE label IN ('DATE', 'TIME', 'AGE')),
          n AS (SELECT system, count(*) AS np, (SELECT count(*) FROM gold) AS ng, count_if(EXISTS (SELECT 1 FROM gold a WHERE a.doc_id = y.doc_id AND a.span_start < y.span_end AND y.span_start < a.span_end)) AS tp FROM y GROUP BY 1)
          SELECT system, round(2 * tp / (np + ng), 6) AS f1, row_number() OVER (ORDER BY 2 * tp / (np + ng) DESC, system) = 1 AS best FROM n""",
        "unmapped_gold_labels": f"{N.cte()} SELECT label, count(*) AS spans FROM gold WHERE label NOT IN ('NAME', 'EMAIL', 'LOCATION') GROUP BY 1",
        "leak_examples": f"{N.cte()}, lost AS (SELECT a.*, substr(n.text, a.span_start + 1, a.span_end - a.span_start) AS surface FROM gold a JOIN notes n USING (doc_id) WHERE label IN {metrics.WIDE} AND NOT EXISTS (SELECT 1 FROM pred b WHERE a.doc_id = b.doc_id AND a.span_start < b.span_end AND b.span_start < a.span_end)) SELECT doc_id, string_agg(label || ':' || surface, '|' ORDER BY span_start) AS lost FROM lost GROUP BY 1 ORDER BY 1 LIMIT 10",
        "synthetic_prompts": _prompts_sql(synthetic.DEV),
        "heldout_prompts": _prompts_sql(synthetic.HELD_OUT),
    }
    pct = lambda c: f"printf('%.1f %%', 100 * {c})"
    out["metrics_report"] = f"""WITH s AS ({sql()['per_class_prf']}) SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS line_no, '| ' || concat_ws(' | ', label, {pct('precision')}, {pct('recall')}, {pct('f1')}, CAST(support AS VARCHAR)) || ' |' AS line FROM s
      UNION ALL VALUES (-3, '## Strict scores by class'), (-2, '| label | precision | recall | f1 | support |'), (-1, '|---|---|---|---|---|')"""
    return out
