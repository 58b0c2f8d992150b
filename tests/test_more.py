"""Request bodies, cached predictions, corpora in two folders, removed intervals, intervals of scores."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import detect, mask, metrics, requests
from veilspark.plans import more
from veilspark.sources import results, standoff, synthetic


def test_bodies_are_masked_and_come_back(spark):
    body = {"model": "m", "messages": [{"role": "system", "content": "Paciente: Ana Ruiz"}, {"role": "user", "content": [{"type": "text", "text": "ana@x.es y [NOMBRE_1], paciente Ana Ruiz"}]}], "suffix": ["612345678", "nada"], "options": {"seed": 3}, "tools": None}
    refused = {"messages": [{"role": "user", "content": "x", "images": ["y"]}]}
    rows = spark.createDataFrame([(1, json.dumps(body)), (2, json.dumps(refused)), (3, None), (4, "[]")], "req long, body string")
    masked, keys = requests.mask_bodies(rows, "req")
    got = {r.req: r for r in masked.collect()}
    assert [got[i].reason for i in (1, 2, 3, 4)] == [None, "unsupported content", "body is no object", "body is no object"]
    assert [got[i].masked for i in (2, 3, 4)] == [None] * 3
    new = json.loads(got[1].masked)
    assert new["messages"][0]["content"].endswith("[NOMBRE_1]") and new["suffix"][1] == "nada" and new["options"] == {"seed": 3} and "tools" not in new
    assert not any(x in got[1].masked for x in ("Ana", "612345678", "ana@"))
    back = requests.restore_bodies(masked.drop("body"), keys, "req", "masked").where("req = 1").first().restored
    assert json.loads(back) == {k: v for k, v in body.items() if k != "tools"}


@pytest.mark.parametrize("body, want", more.BODIES + more.FORGED)
def test_refusals(spark, body, want):
    row = requests.leaves(spark.createDataFrame([(body,)], "body string")).select(requests.reason().alias("r")).first()
    assert (row.r or "ok") == want


def _random_value(rng, depth):
    keys = ["input", "[]", "messages", "content", "input/[]", "role", ".prompt", "prompt", "text", "type", "model", "a b", "", "options", "x"]
    kind = rng.random()
    if depth == 0 or kind < 0.4:
        return rng.choice(["secret", "user", "text", "json", "5m", 1, None, True])
    if kind < 0.6:
        return [_random_value(rng, depth - 1) for _ in range(rng.randrange(3))]
    return {rng.choice(keys): _random_value(rng, depth - 1) for _ in range(rng.randrange(3))}


def _may_pass(body):
    """Brute force: whether every string is a text that is masked, or of a listed field and value."""
    fields = ("prompt", "input", "system", "template", "suffix")

    def fine(value, path):
        if isinstance(value, dict):
            return all(k not in requests.BLOCKED and fine(v, (*path, ("key", k))) for k, v in value.items())
        if isinstance(value, list):
            return all(fine(v, (*path, "at")) for v in value)
        if not isinstance(value, str):
            return True
        keys = [p[1] if p != "at" else None for p in path]
        if len(path) <= 2 and keys[0] in fields and (len(path) == 1 or path[1] == "at") or keys == ["model"]:
            return True
        if keys in (["messages", None, "content"], ["messages", None, "content", None, "text"]):
            return True
        return {("format",): ["json"], ("encoding_format",): ["float", "base64"], ("think",): ["low", "medium", "high"], ("keep_alive",): ["5m"], ("messages", None, "role"): ["system", "developer", "user", "assistant", "tool"], ("messages", None, "content", None, "type"): ["text"]}.get(tuple(keys), []).count(value) > 0

    def message(m):
        if not isinstance(m, dict) or not isinstance(m.get("content"), (str, list)):
            return False
        return isinstance(m["content"], str) or all(isinstance(p, dict) and sorted(p) == ["text", "type"] and isinstance(p["text"], str) and p["type"] == "text" for p in m["content"])

    messages = body.get("messages")
    if not (messages is None or isinstance(messages, list) and all(map(message, messages))):
        return False
    if any(f in body and not (isinstance(body[f], str) or isinstance(body[f], list) and all(isinstance(x, str) for x in body[f])) for f in fields):
        return False
    return fine(body, ())


def test_random_bodies_pass_only_if_all_strings_are_known(spark):
    rng = random.Random(4)
    bodies = [{rng.choice(["input", "prompt", "messages", "model", "input/[]", "options", "[]", "format", "messages/[]"]): _random_value(rng, 3) for _ in range(rng.randrange(4))} for _ in range(3000)]
    bodies += [{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}]}], "format": "json", "keep_alive": "5m", "model": "m"}]
    rows = requests.leaves(spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i long, body string")).select("i", requests.reason().alias("r")).collect()
    passed = {r.i for r in rows if r.r is None}
    assert passed == {i for i, b in enumerate(bodies) if _may_pass(b)} and 300 < len(passed) < 2700


def test_cache_predicts_what_is_missing(spark, tmp_path):
    asked = []

    def predict(missing):
        asked.append(sorted(r.doc_id for r in missing.collect()))
        return missing.select("doc_id", F.length("text").alias("n"))

    docs = spark.createDataFrame([(i, "x" * i) for i in range(4)], "doc_id long, text string")
    path = f"file://{tmp_path}/cache"
    results.cached(docs.where("doc_id < 2"), path, predict)
    got = results.cached(docs, path, predict)
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(4)] and asked == [[0, 1], [2, 3]]


def test_records_and_reports(spark, tmp_path):
    assert results.read_record(spark, f"file://{tmp_path}/none") is None
    record = spark.range(1).select(F.struct(F.lit(0.5).alias("f1"), F.array(F.lit(0.4), F.lit(0.6)).alias("ci95")).alias("word"), *[c.alias(n) for n, c in results.provenance(spark, 42).items()])
    results.write_record(record, f"file://{tmp_path}/r")
    row = results.read_record(spark, f"file://{tmp_path}/r").first()
    assert row.word.f1 == 0.5 and row.seed == 42 and row.rules_sha256 == results.table_hash()


def test_frozen_values_and_what_changed(spark, tmp_path, monkeypatch):
    from veilspark.operators import lexicon

    path = f"file://{tmp_path}/frozen"
    results.freeze(spark, path)
    assert results.changed_since(spark, path).count() == 0
    monkeypatch.setattr(lexicon, "WEEKDAYS", lexicon.WEEKDAYS[1:])
    monkeypatch.setattr(lexicon, "NEW", ["x"], raising=False)
    assert sorted(map(tuple, results.changed_since(spark, path).collect())) == [("lexicon.NEW", "added"), ("lexicon.WEEKDAYS", "changed")]
    assert set(results.provenance(spark, 1)) == {"spark_version", "python_version", "revision", "dirty", "rules_sha256", "seed"}


def test_white_list_of_a_file(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# names\n\n ANA ruiz \n")
    listed = standoff.whitelist(spark, f"file://{tmp_path}/w.txt")
    texts = spark.createDataFrame([(1, "Paciente: Ana Ruiz\npaciente: Luis Gil")], "doc_id long, text string")
    surfaces = lambda **k: [e.surface for e in detect.detect(texts, names=True, **k).first().entities]
    assert surfaces() == ["Ana Ruiz", "Luis Gil"] and surfaces(whitelist=listed) == ["Luis Gil"] and surfaces(whitelist=["luis gil"]) == ["Ana Ruiz"]
    with pytest.raises(ValueError):
        detect.detect(texts, whitelist=["x"] * 100_001)


def test_systems(spark):
    texts = spark.createDataFrame([(1, "Paciente: Ana Ruiz, ana@x.es, 4111 1111 1111 1111")], "doc_id long, text string")
    found = {n: [e.label for e in system(texts).first().entities] for n, system in detect.SYSTEMS.items()}
    assert found == {"rules": ["EMAIL"], "rules+names": ["NAME", "EMAIL"], "rules+wide": ["EMAIL", "ID"]}


def test_corpora_in_two_folders(spark, tmp_path):
    for d in ("ann", "raw", "other"):
        (tmp_path / d).mkdir()
    for n in "abc":
        (tmp_path / "ann" / f"{n}.ann").write_text("T1\tNAME 0 3\tAna\n")
    (tmp_path / "raw" / "a.txt").write_text("Ana a")
    (tmp_path / "other" / "a.txt").write_text("no")
    (tmp_path / "other" / "b.txt").write_text("Ana b")
    docs = standoff.read_apart(spark, *[f"file://{tmp_path}/{d}" for d in ("ann", "raw", "other")])
    assert [(r.doc_id, r.text) for r in standoff.sample(docs, 5).collect()] == [("a", "Ana a"), ("b", "Ana b")]


def test_removed_intervals_are_of_the_text_itself(spark):
    texts = ["Hospital 12 y ana@x.es [NOMBRE_1]x luis@y.es", "", "ana@x.es", "hora 1 hora 2 hora 3 a@b.es hora 4, c@d.es"]
    rows = mask.removed_intervals(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    got = {r.id: [texts[r.id][x.start : x.end] for x in r.removed] for r in rows.collect()}
    assert got == {0: ["Hospital 12 ", "ana@x.es", "[NOMBRE_1]", "luis@y.es"], 1: [], 2: ["ana@x.es"], 3: ["hora 1 ", "hora 2 ", "hora 3 ", "a@b.es", "hora 4", "c@d.es"]}


def test_detectors_together(spark):
    kind = "id long, text string, model array<struct<start:bigint,end:bigint,label:string>>, more array<struct<start:bigint,end:bigint,label:string>>"
    rows = spark.createDataFrame([(1, "el 01/02/2020 con Ana en Olot", [(0, 6, "NAME"), (25, 29, "ORGANIZATION")], [(18, 21, "NAME"), (26, 28, "X")])], kind)
    got = detect.combined(rows, "model", "more").first().entities
    assert [(e.start, e.label) for e in got] == [(3, "DATE"), (18, "NAME"), (25, "ORGANIZATION")]


def test_intervals_are_those_of_drawing_documents(spark):
    """Against a bootstrap that draws documents by rank: the same width, about the same bounds."""
    rng = random.Random(1)
    docs = [(i, rng.randrange(8), rng.randrange(8, 12)) for i in range(400)]
    made = metrics.intervals(spark.createDataFrame(docs, "doc_id long, covered long, total long"), {"neutralised": metrics.INTERVALS["neutralised"]}).first()
    values = []
    for _ in range(1000):
        drawn = [docs[rng.randrange(400)] for _ in docs]
        values.append(sum(d[1] for d in drawn) / sum(d[2] for d in drawn))
    values.sort()
    assert made.inside and abs(made.low - values[24]) < 0.006 and abs(made.high - values[974]) < 0.006
    assert 0.85 < (made.high - made.low) / (values[974] - values[24]) < 1.15


def test_prompts_have_their_entities_where_they_say(spark):
    for templates in (synthetic.DEV, synthetic.HELD_OUT):
        for r in synthetic.prompts(spark.range(40), templates).collect():
            assert r.gold and all(r.text[g.start : g.end] == g.surface for g in r.gold)
            assert len(r.mentions) == len(r.gold)
