"""DuckDB SQL that gives the rows of the catalog's queries."""

from __future__ import annotations

from veilspark.operators.metrics import DIRECT, POISSON, PRIME, WIDE
from veilspark.operators.admission import STATUS
from veilspark.operators.lexicon import CHECK_LETTERS, TAGS

from . import notes as N

PRF = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1"
OVER = "a.doc_id = b.doc_id AND a.span_start < b.span_end AND b.span_start < a.span_end"
LOST = f"lost AS (SELECT * FROM gold a WHERE NOT EXISTS (SELECT 1 FROM pred b WHERE {OVER}))"
TAG = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAGS.items()) + " ELSE 'ANONIMO' END"


def numbered(source: str, request: str, order: str) -> str:
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY {request} ORDER BY {order}) AS visit FROM {source}),
firsts AS (SELECT {request}, surface, arg_min(label, visit) AS label, min(visit) AS visit FROM placed GROUP BY ALL),
named AS (SELECT *, '[' || {TAG} || '_' || CAST(row_number() OVER (PARTITION BY {request}, {TAG} ORDER BY visit) AS VARCHAR) || ']' AS placeholder FROM firsts)"""


ARRIVALS = """arrivals AS (SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t,
  concat_ws('.', CASE WHEN user_id % 3 = 0 THEN '10' ELSE '192' END, CASE WHEN user_id % 3 = 0 THEN '0' ELSE '168' END, CAST(user_id % 40 AS VARCHAR), CAST(user_id % 250 AS VARCHAR)) AS ip FROM events)"""
ALLOWED = "(user_id % 3 = 0 OR user_id % 40 < 16)"


def sql() -> dict[str, str]:
    c = N.cte()
    num = numbered("pred", "doc_id", "span_start DESC")
    words = f"""flags AS (SELECT w.doc_id, w.word_start,
      EXISTS (SELECT 1 FROM gold b WHERE w.doc_id = b.doc_id AND w.word_start < b.span_end AND b.span_start < w.word_end) AS g,
      EXISTS (SELECT 1 FROM pred b WHERE w.doc_id = b.doc_id AND w.word_start < b.span_end AND b.span_start < w.word_end) AS p FROM words w)"""
    out = {
        "gold_spans": f"{c} SELECT * FROM gold",
        "resolved_spans": f"{c} SELECT doc_id, span_start, span_end, label, surface FROM pred",
        "placeholder_numbering": f"{c}, {num} SELECT doc_id, surface, label, placeholder FROM named",
        "mask_text": f"""{c}, {num}, cut AS (SELECT p.doc_id, p.span_start, p.span_end, n.placeholder, coalesce(lag(p.span_end) OVER (PARTITION BY p.doc_id ORDER BY p.span_start), 0) AS before FROM pred p JOIN named n USING (doc_id, surface))
            SELECT t.doc_id, string_agg(substr(t.text, c.before + 1, c.span_start - c.before) || c.placeholder, '' ORDER BY c.span_start) || substr(any_value(t.text), max(c.span_end) + 1) AS masked FROM notes t JOIN cut c USING (doc_id) GROUP BY t.doc_id""",
        "restore_roundtrip": f"{c} SELECT count(*) AS docs, count(*) AS exact FROM notes",
        "robustness": f"{c} SELECT name, count(*) AS texts, CASE WHEN ok THEN count(*) ELSE 0 END AS restored FROM (SELECT DISTINCT doc_id FROM pred), (VALUES ('uppercase', true), ('bold', true), ('lost_brackets', false), ('single_bracket', false), ('inner_space', true), ('translated', true), ('plural', true), ('genitive', true), ('newline', true)) v(name, ok) GROUP BY name, ok",
        "word_prf": f"{c}, {words}, n AS (SELECT CAST(count_if(g AND p) AS BIGINT) AS tp, CAST(count_if(p AND NOT g) AS BIGINT) AS fp, CAST(count_if(g AND NOT p) AS BIGINT) AS fn FROM flags) SELECT *, {PRF} FROM n",
        "per_class_prf": f"""{c}, g AS (SELECT doc_id, label, span_start, span_end, count(*) AS g FROM gold GROUP BY ALL), p AS (SELECT doc_id, label, span_start, span_end, count(*) AS p FROM pred GROUP BY ALL),
            n AS (SELECT label, CAST(sum(least(coalesce(g, 0), coalesce(p, 0))) AS BIGINT) AS tp, CAST(sum(coalesce(p, 0) - least(coalesce(g, 0), coalesce(p, 0))) AS BIGINT) AS fp, CAST(sum(coalesce(g, 0) - least(coalesce(g, 0), coalesce(p, 0))) AS BIGINT) AS fn, CAST(sum(coalesce(g, 0)) AS BIGINT) AS support FROM g FULL JOIN p USING (doc_id, label, span_start, span_end) GROUP BY label) SELECT *, {PRF} FROM n""",
        "span_strict": f"{c}, n AS (SELECT (SELECT count(*) FROM gold JOIN pred USING (doc_id, span_start, span_end)) AS tp, (SELECT count(*) FROM pred) AS np, (SELECT count(*) FROM gold) AS ng), m AS (SELECT tp, np - tp AS fp, ng - tp AS fn FROM n) SELECT *, {PRF} FROM m",
        # on notes no predicted span overlaps two true ones, nor the other way round
        "span_relaxed": f"{c}, n AS (SELECT (SELECT count(*) FROM gold a WHERE EXISTS (SELECT 1 FROM pred b WHERE {OVER})) AS tp, (SELECT count(*) FROM pred) AS np, (SELECT count(*) FROM gold) AS ng), m AS (SELECT tp, np - tp AS fp, ng - tp AS fn FROM n) SELECT *, {PRF} FROM m",
        "leakage": f"{c}, {LOST}, each AS (SELECT doc_id, max(CASE WHEN label IN {DIRECT} THEN 1 ELSE 0 END) AS direct, max(CASE WHEN label IN {WIDE} THEN 1 ELSE 0 END) AS wide FROM lost GROUP BY 1) SELECT (SELECT count(*) FROM notes) AS docs, CAST((SELECT coalesce(sum(direct), 0) FROM each) AS BIGINT) AS direct, CAST((SELECT coalesce(sum(wide), 0) FROM each) AS BIGINT) AS wide, (SELECT count(*) FROM each) AS \"any\"",
        "leak_attribution": f"{c}, {LOST}, each AS (SELECT doc_id, CASE WHEN count(DISTINCT label) = 1 THEN 'solo_' || min(label) ELSE 'multiple' END AS bucket FROM lost WHERE label IN {WIDE} GROUP BY 1) SELECT bucket, count(*) AS docs, round(count(*) / (SELECT count(*) FROM notes), 6) AS rate FROM each GROUP BY 1",
        "neutralised": f"{c} SELECT label, count(*) AS total, CAST(count_if(EXISTS (SELECT 1 FROM pred b WHERE {OVER})) AS BIGINT) AS covered FROM gold a GROUP BY label",
        "strict_coverage": f"""{c}, chars AS (SELECT g.doc_id, g.span_start, g.span_end, g.label, i, substr(n.text, CAST(i + 1 AS BIGINT), 1) AS ch FROM (SELECT *, unnest(range(span_start, span_end)) AS i FROM gold) g JOIN notes n USING (doc_id)),
            n AS (SELECT a.doc_id, a.span_start, a.span_end, label, count(*) AS size, count_if(cut) AS cut, max(CASE WHEN NOT cut AND regexp_matches(ch, '[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 0 END) AS stays FROM (SELECT c.*, EXISTS (SELECT 1 FROM pred b WHERE c.doc_id = b.doc_id AND c.i >= b.span_start AND c.i < b.span_end) AS cut FROM chars c) a GROUP BY ALL)
            SELECT CASE WHEN cut = 0 THEN 'missed' WHEN cut = size THEN 'full' ELSE 'partial' END AS state, count(*) AS spans, count_if(label IN {DIRECT}) AS direct, CAST(sum(stays) AS BIGINT) AS with_residue, CAST(sum(CASE WHEN label IN {DIRECT} THEN stays ELSE 0 END) AS BIGINT) AS direct_with_residue FROM n GROUP BY 1""",
        "confusion_matrix": f"{c}, f AS (SELECT a.doc_id, a.span_start, a.span_end, a.label, arg_min(b.label, b.span_start) AS pl FROM gold a LEFT JOIN pred b ON {OVER} GROUP BY ALL) SELECT label, coalesce(pl, '(FN)') AS predicted, count(*) AS n FROM f GROUP BY ALL",
        "over_redaction": f"{c}, {words}, n AS (SELECT count(*) AS outside, CAST(count_if(p) AS BIGINT) AS covered FROM flags WHERE NOT g) SELECT *, round(CASE WHEN outside > 0 THEN covered / outside ELSE 0.0 END, 6) AS rate FROM n",
        "top_false_positives": f"{c} SELECT trim(lower(regexp_replace(surface, '\\s+', ' ', 'g')), ' .,;:()[]-/') AS text, count(*) AS n, 'rule:' || min(label) AS source FROM pred a WHERE NOT EXISTS (SELECT 1 FROM gold b WHERE {OVER}) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20",
        "over_redaction_sources": f"{c}, {words} SELECT 'rule:' || (SELECT arg_min(b.label, b.span_start) FROM pred b WHERE f.doc_id = b.doc_id AND f.word_start < b.span_end AND b.span_start < w.word_end) AS source, count(*) AS words FROM flags f JOIN words w USING (doc_id, word_start) WHERE f.p AND NOT f.g GROUP BY 1",
        # numbers that are no true span, and the digits of what looks like a number in a name
        "rule_false_words": f"{c}, {words} SELECT CASE label WHEN 'ID' THEN 'plain' ELSE lower(label) END AS rule, count(DISTINCT (f.doc_id, f.word_start)) AS words FROM flags f JOIN words w USING (doc_id, word_start) JOIN cand b ON f.doc_id = b.doc_id AND f.word_start < b.span_end AND b.span_start < w.word_end WHERE NOT f.g GROUP BY 1",
        "class_winners": f"""{c}, sides AS (SELECT doc_id, label, span_start, span_end, label IN ('EMAIL', 'DATE', 'PHONE') AS few FROM pred), g AS (SELECT label, count(*) AS support FROM gold GROUP BY 1)
            SELECT label, round(2 * tp / (p + support), 6) AS few, CAST(0.0 AS DOUBLE) AS rest FROM (SELECT label, count(*) AS p, count_if(EXISTS (SELECT 1 FROM gold b WHERE a.doc_id = b.doc_id AND a.label = b.label AND a.span_start = b.span_start AND a.span_end = b.span_end)) AS tp FROM sides a WHERE few GROUP BY 1) JOIN g USING (label) WHERE tp > 0""",
        "collisions": f"{c} SELECT (SELECT count(*) FROM notes) AS docs, count(*) AS collisions FROM notes",
        # the numbers of a note are two; all else of one label is one text, or isn't found
        "consistency": f"{c}, {num}, e AS (SELECT g.doc_id, g.label, count(DISTINCT n.placeholder) AS k FROM gold g JOIN notes t USING (doc_id) JOIN named n ON n.doc_id = g.doc_id AND n.surface = substr(t.text, g.span_start + 1, g.span_end - g.span_start) GROUP BY 1, 2) SELECT count(*) AS entities, count_if(k = 1) AS consistent FROM e",
    }
    weight = "CASE " + " ".join(f"WHEN x < {b} THEN {k}" for k, b in enumerate(POISSON)) + f" ELSE {len(POISSON)} END"
    mixed = "".join(f", x{k} AS (SELECT * EXCLUDE (x), (x * x + r * {add} + doc_id % {PRIME}) % {PRIME} AS x FROM x{k - 1})" for k, add in enumerate((7, 11, 13), 1))
    sums = ", ".join(f"sum({weight} * {x}) AS {x}" for x in ("covered", "total", "leak", "tp", "fp", "fn")) + f", sum({weight}) AS doc"
    values = "unnest([{'metric': 'neutralised', 'v': covered / total}, {'metric': 'leakage', 'v': leak / doc}, {'metric': 'word_f1', 'v': 2 * tp / (2 * tp + fp + fn)}], recursive := true)"
    out["interval_gate"] = f"""{c}, {words}, {LOST}, a AS (SELECT doc_id, count_if(EXISTS (SELECT 1 FROM pred b WHERE {OVER})) AS covered, count(*) AS total FROM gold a GROUP BY 1),
      l AS (SELECT DISTINCT doc_id, 1 AS leak FROM lost WHERE label IN {DIRECT}), w AS (SELECT doc_id, count_if(g AND p) AS tp, count_if(p AND NOT g) AS fp, count_if(g AND NOT p) AS fn FROM flags GROUP BY 1),
      d AS MATERIALIZED (SELECT doc_id, covered, total, coalesce(leak, 0) AS leak, tp, fp, fn FROM a JOIN w USING (doc_id) LEFT JOIN l USING (doc_id)),
      x0 AS (SELECT *, (doc_id % {PRIME} * 48271 + r * 69621 + 12345) % {PRIME} AS x FROM d, range(1000) t(r)){mixed},
      s AS (SELECT r, {sums} FROM x3 GROUP BY r), v AS (SELECT {values} FROM s), k AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY v) AS k FROM v),
      p AS (SELECT {values} FROM (SELECT sum(covered) AS covered, sum(total) AS total, sum(leak) AS leak, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) AS doc FROM d)),
      q AS (SELECT metric, round(max(CASE WHEN k = 25 THEN v END), 6) AS low, round(max(CASE WHEN k = 975 THEN v END), 6) AS high FROM k GROUP BY 1)
      SELECT metric, round(p.v, 6) AS point, low, high, round(p.v, 6) BETWEEN low - 1e-6 AND high + 1e-6 AS inside FROM p JOIN q USING (metric)"""
    kinds = {"EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "IPV4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "CARD": r"\b\d{16}\b"}
    out["pii_by_lang_source"] = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS label, CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS n FROM documents GROUP BY 1, 2 HAVING sum(len(regexp_extract_all(text, '{p}'))) > 0" for k, p in kinds.items())
    for name, number, head in (("dni", "((c_custkey * 7919 + 13) % 100000000)", ""), ("nie", "(c_custkey * 31)", "substr('XYZ', CAST(c_custkey % 3 AS INT) + 1, 1) || ")):
        width = 8 if name == "dni" else 7
        value = number if name == "dni" else f"(c_custkey % 3) * 10000000 + {number}"
        out[f"{name}_check"] = f"SELECT c_custkey, {head}lpad(CAST({number} AS VARCHAR), {width}, '0') || substr('{CHECK_LETTERS}', CAST(c_custkey % 23 AS INT) + 1, 1) AS {name}, ({value}) % 23 = c_custkey % 23 AS valid FROM customer"
    out["escape_literals"] = f"SELECT c_custkey, '{chr(0xE000)}0{chr(0xE001)}y {chr(0xE000)}1{chr(0xE001)} fin' AS escaped, CAST(2 AS BIGINT) AS n, true AS same FROM customer"
    spans = N.spans_sql("(SELECT conv_id * 100000 + turn AS k, text FROM conversations)", "k", "text", r"[A-Z][a-z]{6,}", "'NAME' AS label,")
    out["request_numbering"] = f"WITH s AS (SELECT doc_id // 100000 AS conv_id, doc_id % 100000 AS turn, label, surface, span_start FROM ({spans})), {numbered('s', 'conv_id', 'turn, span_start DESC')} SELECT conv_id, surface, placeholder FROM named"
    out["cidr_membership"] = f"WITH {ARRIVALS} SELECT event_id, ip, {ALLOWED} AS allowed FROM arrivals"
    out["freshness"] = "SELECT event_id, event_id % 300 <= 120 AS fresh FROM events"
    out["decisions"] = f"""WITH RECURSIVE {ARRIVALS}, a AS MATERIALIZED (SELECT *, event_id AS e, md5(CAST(user_id % 50 AS VARCHAR)) AS req, CASE WHEN event_id % 97 = 0 THEN 'path' WHEN NOT {ALLOWED} THEN 'ip_not_allowed' END AS early FROM arrivals WHERE t IS NOT NULL),
      followed AS (SELECT ip FROM a WHERE early IS NULL GROUP BY 1 ORDER BY min((t, e)) LIMIT 300),
      r AS MATERIALIZED (SELECT ip, e, t, row_number() OVER (PARTITION BY ip ORDER BY t, e) AS k FROM a WHERE early IS NULL),
      f AS (SELECT ip, e, k, true AS ok, [t] AS live FROM r WHERE k = 1
        UNION ALL SELECT r.ip, r.e, r.k, len(list_filter(f.live, lambda x: r.t - x < 7200)) < 2,
          CASE WHEN len(list_filter(f.live, lambda x: r.t - x < 7200)) < 2 THEN list_append(list_filter(f.live, lambda x: r.t - x < 7200), r.t) ELSE list_filter(f.live, lambda x: r.t - x < 7200) END FROM f JOIN r ON r.ip = f.ip AND r.k = f.k + 1),
      m AS MATERIALIZED (SELECT a.*, CASE WHEN early IS NOT NULL THEN early WHEN NOT f.ok OR a.ip NOT IN (SELECT ip FROM followed) THEN 'rate_limited' WHEN a.e % 89 = 0 THEN 'bad_content_length' WHEN a.e * 37 % 5000 > 4500 THEN 'body_too_large' WHEN a.e % 83 = 0 THEN 'bad_request'
          WHEN a.e % 79 = 0 OR a.e % 150 > 120 THEN 'decrypt_failure' END AS middle FROM a LEFT JOIN f ON a.ip = f.ip AND a.e = f.e),
      s AS MATERIALIZED (SELECT req, e, t, shard, row_number() OVER (PARTITION BY shard ORDER BY t, e) AS k FROM (SELECT *, CAST('0x' || substr(md5(base64(unhex(req))), 1, 8) AS BIGINT) % 8 AS shard FROM m WHERE middle IS NULL)),
      g AS (SELECT shard, e, k, false AS again, [{{'r': req, 'u': t + 3600}}] AS live FROM s WHERE k = 1
        UNION ALL SELECT s.shard, s.e, s.k, len(list_filter(g.live, lambda x: x.u > s.t)) >= 2 OR len(list_filter(g.live, lambda x: x.u > s.t AND x.r = s.req)) > 0,
          CASE WHEN len(list_filter(g.live, lambda x: x.u > s.t)) >= 2 OR len(list_filter(g.live, lambda x: x.u > s.t AND x.r = s.req)) > 0 THEN list_filter(g.live, lambda x: x.u > s.t) ELSE list_append(list_filter(g.live, lambda x: x.u > s.t), {{'r': s.req, 'u': s.t + 3600}}) END FROM g JOIN s ON s.shard = g.shard AND s.k = g.k + 1),
      d AS (SELECT m.e AS ident, CASE WHEN middle IS NOT NULL THEN middle WHEN g.again THEN 'replay' WHEN m.e % 73 = 0 THEN 'bad_inner_json' WHEN m.e % 71 = 0 THEN 'bad_config' WHEN m.e % 67 = 0 THEN 'invalid_path' WHEN m.e % 61 = 0 THEN 'route_denied' WHEN m.e % 59 = 0 THEN 'upstream_error' ELSE 'ok' END AS reason FROM m LEFT JOIN g ON m.e = g.e)
      SELECT ident, CAST(CASE reason {' '.join(f"WHEN '{k}' THEN {v}" for k, v in STATUS.items())} ELSE 200 END AS INT) AS status, reason FROM d"""
    out["admission_cascade"] = f"SELECT status, reason, count(*) AS n FROM ({out['decisions']}) GROUP BY 1, 2"
    out["routes"] = """WITH x AS (SELECT event_id, ['GET', 'POST', 'PUT'][CAST(event_id % 3 AS INT) + 1] || ' ' || ['/api/chat', '/api/tags', '/api/pull', '/v1/models', '/x'][CAST(event_id // 3 % 5 AS INT) + 1] AS r FROM events)
      SELECT event_id, r IN ('POST /api/chat', 'GET /api/tags', 'GET /v1/models') AS allowed, r IN ('POST /api/chat', 'GET /api/tags', 'GET /v1/models') OR r LIKE '%/api/pull' AS managed FROM x"""
    out["client_addresses"] = """SELECT event_id, CASE WHEN CASE WHEN event_id % 2 = 0 THEN event_id % 250 < 128 ELSE event_id % 65536 < 32768 END AND event_id % 3 = 0 THEN '1.2.3.' || CAST(event_id % 250 AS VARCHAR)
      WHEN CASE WHEN event_id % 2 = 0 THEN event_id % 250 < 128 ELSE event_id % 65536 < 32768 END AND event_id % 5 = 0 THEN '8.8.8.8'
      WHEN event_id % 2 = 0 THEN '10.0.0.' || CAST(event_id % 250 AS VARCHAR) ELSE '2001:db8::' || lower(to_hex(event_id % 65536)) END AS ip FROM events"""
    out["rate_limit"] = f"""WITH RECURSIVE {ARRIVALS}, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM arrivals),
      f AS (SELECT user_id, event_id, k, true AS admitted, [t] AS live FROM r WHERE k = 1
        UNION ALL SELECT r.user_id, r.event_id, r.k, len(list_filter(f.live, lambda x: r.t - x < 7200)) < 2,
          CASE WHEN len(list_filter(f.live, lambda x: r.t - x < 7200)) < 2 THEN list_append(list_filter(f.live, lambda x: r.t - x < 7200), r.t) ELSE list_filter(f.live, lambda x: r.t - x < 7200) END
        FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1) SELECT user_id, event_id, admitted FROM f"""
    out["replay_check"] = f"""WITH RECURSIVE {ARRIVALS}, r AS MATERIALIZED (SELECT user_id % 50 AS req, event_id, t, row_number() OVER (PARTITION BY user_id % 50 ORDER BY t, event_id) AS k FROM arrivals),
      f AS (SELECT req, event_id, k, false AS replayed, t + 3600 AS until FROM r WHERE k = 1
        UNION ALL SELECT r.req, r.event_id, r.k, f.until > r.t, CASE WHEN f.until > r.t THEN f.until ELSE r.t + 3600 END FROM f JOIN r ON r.req = f.req AND r.k = f.k + 1) SELECT req, event_id, replayed FROM f"""
    out["json_allowlist"] = "SELECT event_id, CASE WHEN len(list_filter(json_keys(props), lambda x: x <> 'k')) > 0 THEN 'unknown_key' WHEN CAST(props->>'$.k' AS INT) IS NULL THEN 'missing' WHEN CAST(props->>'$.k' AS INT) > 90 THEN 'out_of_range' ELSE 'ok' END AS reason FROM events"
    out["latency_percentiles"] = "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, round(median(value), 6) AS p50, count(*) AS n, max(CASE WHEN k = floor(0.95 * (n - 1)) + 1 THEN value END) AS p95 FROM r GROUP BY event_type"
    out["unmapped_labels"] = "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view')"
    out["best_config"] = "WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_linestatus, arg_max(l_returnflag, (n, l_returnflag)) AS best FROM g GROUP BY 1"
    out["audit_records"] = f"""WITH {ARRIVALS} SELECT event_id AS ident, '{{"ts":"' || strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') || '","ip":"' || ip || '","method":"POST","path":"/secure/request","status":' || CASE WHEN event_id % 5 = 0 THEN '401,"reason":"replay"' ELSE '200' END || '}}' AS line FROM arrivals WHERE t IS NOT NULL"""
    out["sealed_roundtrip"] = "SELECT count(*) AS n, count(*) AS opened, CAST(0 AS BIGINT) AS opened_wrongly FROM events"
    return out
