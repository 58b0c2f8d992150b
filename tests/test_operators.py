"""Rules, masking, arbitration, admission and sources on small cases."""

import re

import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions.spans import with_spans
from veilspark.operators import admission, detect, mask, rules
from veilspark.sources import standoff


def found(spark, text, names=None):
    chosen = [r for r in rules.RULES if names is None or r.name in names]
    row = detect.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), rules=chosen).first()
    return [(e.label, e.surface) for e in row.entities]


@pytest.mark.parametrize(
    "text, want",
    [
        ("tel 612345678 o +34 912 345 678", [("PHONE", "612345678"), ("PHONE", "+34 912 345 678")]),
        ("ana@hospital.es visita www.web.cat/x", [("EMAIL", "ana@hospital.es"), ("URL", "www.web.cat/x")]),
        ("DNI 12345678Z y 12345678A", [("ID", "12345678Z")]),
        ("NIE X1234567L", [("ID", "X1234567L")]),
        ("el 3 de marzo de 2020 a las 10:30 h, 45 años", [("DATE", "3 de marzo de 2020"), ("TIME", "10:30 h"), ("AGE", "45 años")]),
        ("su MADRE vive en Mataró", [("FAMILY", "MADRE"), ("LOCATION", "Mataró")]),
        ("NHC: 1234567 y 28/12345678/40", [("ID", "NHC: 1234567"), ("ID", "28/12345678/40")]),
        ("", []),
    ],
)
def test_rules(spark, text, want):
    assert found(spark, text) == want


def test_spans_are_code_points_in_long_texts(spark):
    text = "é😀ab " * 1000
    row = with_spans(spark.createDataFrame([(text,)], "t string"), "t", {"s": r"a\w"}).first()
    assert [(s.start, s.end) for s in row.s] == [m.span() for m in re.finditer(r"a\w", text)]


def test_round_trip_and_perturbations(spark):
    text = "ana@x.es, luis@x.es y ana@x.es el 01/02/2020"
    done = mask.mask_each(detect.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    row = done.first()
    assert row.masked == "[CORREO_1], [CORREO_2] y [CORREO_1] el [FECHA_1]"
    for name, (bend, good) in mask.PERTURBATIONS.items():
        back = mask.restore(done.withColumn("masked", bend(F.col("masked")))).first().restored
        assert all(m.surface in back for m in row.mapping) == good, name


def test_restore_does_not_read_what_it_put_in(spark):
    m = [("[ID_2]", "ID", 1, "[ID_1]"), ("x", "ID", 2, "[ID_2]")]
    df = spark.createDataFrame([("[ID_1][ID_2] [ID_9]", m)], "masked string, mapping array<struct<surface:string,tag:string,n:int,placeholder:string>>")
    assert mask.restore(df).first().restored == "[ID_2]x [ID_9]"


def test_restore_takes_bold_and_suffix_along(spark):
    m = [("Ana", "NOMBRE", 1, "[NOMBRE_1]"), ("b", "ID", 1, "[ID_1]")]
    df = spark.createDataFrame([("**[NOMBRE_1]** [name_1]'s [ nombre 1 ]s [NOMBRE_1]S [NOMBRE_10] [ID\n1] [NOMBRE_1 NOMBRE_1]", m)], "masked string, mapping array<struct<surface:string,tag:string,n:int,placeholder:string>>")
    assert mask.restore(df).first().restored == "Ana Ana Ana AnaS [NOMBRE_10] b [NOMBRE_1 NOMBRE_1]"


def test_words_that_the_user_wrote_stay(spark):
    m = [("Ana", "NOMBRE", 1, "[NOMBRE_1]")]
    rows = [("(**[NOMBRE_1]**) y [Name_1] y [NOMBRE_1]", m, ["[name_1]"])]
    df = spark.createDataFrame(rows, "masked string, mapping array<struct<surface:string,tag:string,n:int,placeholder:string>>, tokens array<string>")
    assert mask.restore(df, tokens="tokens").first().restored == "(Ana) y [Name_1] y Ana"


TEXTS = [
    "Paciente: Ana Ruiz, Hospital 12 y [NOMBRE_1], ana@x.es",
    "[[FECHA_2]] hora 14, HORA14 **[ID_3]**s [EMAIL 4 el 01/02/2020 y 01/02/2020",
    "nada",
    "",
    "Ana\ue0000\ue001 [NOMBRE_1",
    "612345678 [PHONE_1]'s TELEFONO_1] 612345678",
]


def test_requests_come_back_as_they_were(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    back = mask.deanonymize(mask.anonymize(rows))
    got = {r.id: r for r in back.collect()}
    for i, t in enumerate(TEXTS):
        if "\ue000" not in t:
            assert got[i].restored == t, got[i].masked
    assert "Ana" not in got[0].masked and "612345678" not in got[5].masked
    # the texts of one request: numbers, markers and words go on
    masked, keys = mask.anonymize_requests(rows.where("id <> 4").withColumn("req", F.lit(1)), "req", "id")
    once = keys.collect()
    assert len(once) == 1 and len({m.placeholder for m in once[0].mapping}) == len(once[0].mapping) == len({m.surface for m in once[0].mapping})
    back = mask.deanonymize(masked.join(keys, "req"))
    assert {r.id: r.restored for r in back.collect()} == {i: t for i, t in enumerate(TEXTS) if i != 4}


def test_random_texts_come_back(spark):
    import random

    rng = random.Random(3)
    # no bold or genitive right beside an entity: they go with its placeholder
    parts = ["[NOMBRE_1]", "[ID_2", "hora 14", "Ana Ruiz", "a@b.es", "612345678", "Paciente:", " ", "\n", ", ", "x", "[", "]", "12345678Z", "URL3]"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert [(r.text, r.restored) for r in mask.deanonymize(mask.anonymize(rows)).where("text <> restored").collect()] == []


def test_escape(spark):
    df = spark.createDataFrame([("hora 14 y [NOMBRE_2]",)], "text string")
    out = mask.escape_literals(df)
    assert out.first().literals == ["hora 14 ", "[NOMBRE_2]"]
    assert mask.unescape(out.drop("text")).first().text == "hora 14 y [NOMBRE_2]"


def spans(*rows):
    if not rows:
        return F.array().cast("array<struct<start:bigint,end:bigint,label:string>>")
    return F.array(*[F.struct(F.lit(s).cast("bigint").alias("start"), F.lit(e).cast("bigint").alias("end"), F.lit(x).alias("label")) for s, e, x in rows])


def test_arbitration_depends_on_order(spark):
    one = spark.range(1)
    # the first rule span pushes the model span out, so the second is free
    got = detect.arbitrate(one, spans((0, 4, "DATE"), (6, 9, "LOCATION")), spans((2, 8, "NAME"))).first().entities
    assert [(s.start, s.label) for s in got] == [(0, "DATE"), (6, "LOCATION")]
    got = detect.arbitrate(one, spans((0, 4, "PHONE")), spans((2, 8, "ID"))).first().entities
    assert [s.label for s in got] == ["ID"]
    got = detect.arbitrate(one, spans(), spans((0, 2, "A")), spans((1, 3, "B"), (4, 6, "B"), (5, 7, "B"))).first().entities
    assert [(s.start, s.label) for s in got] == [(0, "A"), (4, "B")]


def test_merge_adjacent(spark):
    tokens = F.array(*[F.struct(F.lit(s).cast("bigint").alias("start"), F.lit(e).cast("bigint").alias("end"), F.lit(x).alias("label"), F.lit(p).alias("score")) for s, e, x, p in [(0, 3, "N", 0.5), (4, 6, "N", 0.9), (8, 9, "N", 0.3), (9, 10, "D", 0.2)]])
    got = spark.range(1).select(detect.merge_adjacent(tokens).alias("x")).first().x
    assert [(s.start, s.end, s.label, s.score) for s in got] == [(0, 6, "N", 0.9), (8, 9, "N", 0.3), (9, 10, "D", 0.2)]


def test_admission_columns(spark):
    rows = [("10.1.2.3", True), ("11.0.0.1", False), ("10.1.2.300", False), (None, False)]
    df = spark.createDataFrame(rows, "ip string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", admission.in_networks(F.col("ip"), ["10.0.0.0/8"])).collect())
    paths = spark.createDataFrame([("/api/x", True), ("api", False), ("//a", False), ("/a?b", False), ("/a@b", False)], "p string, want boolean")
    assert all(r.want == r.got for r in paths.withColumn("got", admission.valid_path(F.col("p"))).collect())


def test_rate_limit_and_replays(spark):
    hits = spark.createDataFrame([(1, float(t), i) for i, t in enumerate([0, 10, 20, 59, 60, 61, 200])], "k long, t double, id long")
    got = {r.id: r.admitted for r in admission.rate_limit(hits, "k", "t", "id", limit=2).collect()}
    assert [got[i] for i in range(7)] == [True, True, False, False, True, False, True]
    again = {r.id: r.replayed for r in admission.replays(hits, "k", "t", "id", ttl=60).collect()}
    assert [again[i] for i in range(7)] == [False, True, True, True, False, True, False]


def test_streams_give_what_batches_give(spark, tmp_path):
    from veilspark.streaming.admission import rate_limited, replay_checked

    hits = spark.createDataFrame([(k, 1000.0 + t, 10 * k + i) for k in (1, 2) for i, t in enumerate([0, 10, 20, 59, 60, 61])], "k long, t double, id long")
    hits.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, stream, batch in (
        ("a", lambda s: rate_limited(s, "k", "t", "id", 2), admission.rate_limit(hits, "k", "t", "id", 2)),
        ("b", lambda s: replay_checked(s, "k", "t", "id", 60), admission.replays(hits, "k", "t", "id", 60)),
    ):
        batch = batch.select("k", "id", "t", batch.columns[-1])
        source = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "in"))
        q = stream(source).writeStream.format("memory").queryName(f"out_{name}").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(f"out_{name}").collect())) == sorted(map(tuple, batch.collect()))


def test_standoff(spark, tmp_path):
    d = tmp_path / "dev"
    d.mkdir()
    (d / "a.txt").write_text("Ana vive aquí")
    (d / "a.ann").write_text("T1\tNAME 0 3\tAna\nR1\tx\nT2\tPLACE 4 8;9 13\tvive aquí\n")
    (d / "b.ann").write_text("")
    row = standoff.read(spark, f"file://{tmp_path}", ["dev"]).collect()
    assert [(r.doc_id, [(g.label, g.start, g.end) for g in r.gold]) for r in row] == [("a", [("NAME", 0, 3), ("PLACE", 4, 13)])]


def test_standoff_source_plans_tasks_and_misses_no_split(spark, tmp_path):
    for split, names in (("dev", "abcde"), ("test", "fg"), ("none", "")):
        (tmp_path / split / "deep").mkdir(parents=True)
        for k, n in enumerate(names):
            where = tmp_path / split / ("deep" if k % 2 else "")
            (where / f"{n}.txt").write_text(f"text é {n}")
            (where / f"{n}.ann").write_text("T1\tNAME 0 4\ttext\n")
    spark.dataSource.register(standoff.Pairs)
    load = lambda splits: spark.read.format("standoff").option("path", f"file://{tmp_path}").option("splits", splits).option("pairs", 2).load()
    pairs = load('["dev", "test"]')
    assert pairs.rdd.getNumPartitions() == 4
    assert sorted((r.split, r.doc_id, r.text) for r in pairs.collect()) == [("dev", n, f"text é {n}") for n in "abcde"] + [("test", n, f"text é {n}") for n in "fg"]
    assert load('["none"]').count() == 0
    with pytest.raises(Exception, match="no split missing"):
        load('["dev", "missing"]').count()


def test_one_key_with_very_many_hits(spark):
    """A run without a gap is a pass with little state: no array of all its hits, no work that grows with its square."""
    n = 200_000
    hits = spark.range(n).select(F.when(F.col("id") < n - 9, 1).otherwise(2).alias("k"), (F.col("id") * 7 % n).cast("double").alias("t"), "id")
    limited, checked = admission.rate_limit(hits, "k", "t", "id", limit=2, window=10), admission.replays(hits, "k", "t", "id", ttl=10)
    for df in (limited, checked):
        assert "collect_list" not in df._jdf.queryExecution().toString()
    want_ok, want_again, recent, until = {}, {}, {1: [], 2: []}, {1: -1.0, 2: -1.0}
    for t, i in sorted((float(i * 7 % n), i) for i in range(n)):
        k = 1 if i < n - 9 else 2
        recent[k] = [x for x in recent[k] if t - x < 10]
        want_ok[i] = len(recent[k]) < 2
        recent[k] += [t] if want_ok[i] else []
        want_again[i] = until[k] > t
        until[k] = until[k] if want_again[i] else t + 10
    assert {r.id: r.admitted for r in limited.collect()} == want_ok
    assert {r.id: r.replayed for r in checked.collect()} == want_again


def test_masked_documents_hide_what_every_rule_finds(spark, tmp_path):
    from veilspark.plans import catalog

    want = {
        "a@x.es from 173.33.203.46 paid 4111111111111111": "[CORREO_1] from [ID_2] paid [ID_1]",
        "4111 1111 1111 1111 on 2024-02-29": "[ID_1] on [FECHA_1]",
        "+1 (980) 555-6268, (980) 555-6268, 980-555-6268": "[TELEFONO_3], [TELEFONO_2], [TELEFONO_1]",
        "+44 20 7946 0958; +33 6 12 34 56 78; +34 612 345 678": "[TELEFONO_3]; [TELEFONO_2]; [TELEFONO_1]",
        "www.x.org y DNI 12345678Z": "[URL_1] y DNI [ID_1]",
        "su madre vive en Barcelona, 45 años, a las 10:30 h": "su [FAMILIAR_1] vive en [LUGAR_1], [EDAD_1], a las [HORA_1]",
        "nothing here, v1.2 of 10 words": "nothing here, v1.2 of 10 words",
    }
    rows = list(enumerate(want))
    spark.createDataFrame([*rows, (99, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.masked for r in catalog.masked_documents(spark, f"file://{tmp_path}").collect()}
    assert got == {i: want[t] for i, t in rows}


def test_masked_documents_leave_no_number_or_address(spark):
    """Plain Python looks for what was to be masked, in every document of the smallest table."""
    from veilspark.plans import catalog

    sf = "/root/testdata/sf0.001"
    private = re.compile(r"[\w.+-]+@[\w-]+\.\w+|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])|\b\d{16}\b|\(\d{3}\) \d{3}-\d{4}")
    before = {r.doc_id: set(private.findall(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    after = {r.doc_id: r.masked for r in catalog.masked_documents(spark, sf).collect()}
    assert sum(map(len, before.values())) > 10
    assert not [x for d, m in after.items() for x in private.findall(m)]


def test_networks_of_both_versions(spark):
    from ipaddress import ip_address, ip_network

    listed = ["10.1.0.0/16", "2001:db8::/33", "fe80::1/128", "no network"]
    ips = ["10.1.2.3", "10.2.0.0", "2001:db8::1", "2001:DB8:7fff::", "2001:db8:8000::", "fe80::1", "fe80:0:0:0:0:0:0:1", "::", "1::2::3", "1:2:3:4:5:6:7:8:9", "12345::", "x", "", "1:2:3:4:5:6:7::8", "::1:2:3:4:5:6:7:8"]

    def want(ip):
        try:
            return any(ip_address(ip) in ip_network(n) for n in listed[:3])
        except ValueError:
            return False

    df = spark.createDataFrame([(x,) for x in ips] + [(None,)], "ip string")
    got = {r.ip: r.x for r in df.withColumn("x", admission.in_networks(F.col("ip"), listed)).collect()}
    assert got == {x: want(x) for x in ips} | {None: False}
    assert not any(r.x for r in df.select(admission.in_networks(F.col("ip"), ["nothing valid"]).alias("x")).collect())
    assert all(r.x for r in df.select(admission.in_networks(F.col("ip"), []).alias("x")).collect())


def test_known_answers(spark):
    # RFC 5869, test case 3
    okm = "8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d9d201395faa4b61a96c8"
    assert admission.derived_key(b"\x0b" * 22, b"", 42).hex() == okm
    aad = admission.additional_data(F.lit(2), F.lit(1), F.lit(0x0102030405060708), F.lit(bytes([16] * 16)))
    assert bytes(spark.range(1).select(aad.alias("x")).first().x) == b"\x02\x01" + (0x0102030405060708).to_bytes(8, "big") + bytes([16] * 16)
    assert spark.range(1).select(admission.additional_data(F.lit(2), F.lit(1), F.lit(-1).cast("long"), F.lit(b"x")).alias("x")).first().x is None


def test_keys_that_cannot_be_followed_are_rejected(spark):
    hits = spark.createDataFrame([(k, float(t), 10 * k + t) for k in (3, 1, 2) for t in range(3)], "k long, t double, id long").withColumn("t", F.col("t") + F.col("k"))
    got = {(r.k, r.id): r.admitted for r in admission.rate_limit(hits, "k", "t", "id", limit=2, most_keys=2).collect()}
    assert {k for (k, _), ok in got.items() if ok} == {1, 2} and sum(got.values()) == 4


def test_streams_let_go_of_old_keys_and_take_rows_out_of_order(spark, tmp_path):
    from veilspark.streaming.admission import rate_limited

    kind = "k long, t double, id long"
    parts = [[(1, 100.0, 0), (1, 50.0, 1)], [(1, 90.0, 2), (2, 100.0, 3)], [(9, 10_000.0, 4)], [(1, 10_001.0, 5)]]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = rate_limited(source, "k", "t", "id", 2, delay="60 seconds").writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).start()
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    states = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    got = {r.id: r.admitted for r in spark.table("late").collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}
    assert states == 2


def test_busy_keys_go_on_over_tasks(spark):
    """Against plain Python: a key without a gap in all tasks, one with gaps, rows that don't count, null keys and times."""
    rng, rows = random.Random(5), []
    for k, n, most in ((1, 3000, 8), (2, 3000, 90), (None, 50, 9), (3, 1, 1)):
        t = 0.0
        for _ in range(n):
            t += rng.randrange(most)
            rows.append((k, None if rng.random() < 0.01 else t, len(rows), rng.random() < 0.8))
    df = spark.createDataFrame(rows, "k long, t double, id long, use boolean").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        limited = {r.id: r.admitted for r in admission.rate_limit(df, "k", "t", "id", 3, 20, "use").collect()}
        checked = {r.id: r.replayed for r in admission.replays(df, "k", "t", "id", 20, "use").collect()}
        bounded = {r.id: r.replayed for r in admission.replays(df, "k", "t", "id", 20, "use", most=2, shards=1).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    recent, until, live = {}, {}, {}
    for k, t, i, use in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        if not use:
            assert limited[i] is None and checked[i] is None and bounded[i] is None
            continue
        near = [x for x in recent.get(k, []) if t is not None and x is not None and t - x < 20]
        assert limited[i] == (len(near) < 3), (k, t, i)
        recent[k] = near + [t] if len(near) < 3 else near
        again = until.get(k) is not None and t is not None and until[k] > t
        assert checked[i] == again
        until[k] = until.get(k) if again else None if t is None else t + 20
        live = {x: u for x, u in live.items() if t is not None and u > t}
        assert bounded[i] == (k in live or len(live) >= 2)
        if not bounded[i] and t is not None:
            live[k] = t + 20


def test_streams_keep_the_cache_bounded_and_audit_once(spark, tmp_path):
    from veilspark.streaming.admission import audit_sink, replay_checked

    hits = spark.createDataFrame([(f"id{i % 7}", 1000.0 + 3 * i, i) for i in range(60)], "k string, t double, id long")
    hits.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "in"))
    q = replay_checked(source, "k", "t", "id", 20, most=3, shards=1).writeStream.format("memory").queryName("cache").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {r.id: r.replayed for r in admission.replays(hits, "k", "t", "id", 20, most=3, shards=1).collect()}
    assert {r.id: r.replayed for r in spark.table("cache").collect()} == want and set(want.values()) == {True, False}
    decided = spark.createDataFrame([(1, "1.2.3.4", 5.0, 200, "ok", None), (2, "1.2.3.4", 6.0, 401, "replay", "x")], "ident long, ip string, now double, status int, reason string, req_id string")
    sink = audit_sink(f"file://{tmp_path}/audit")
    for number in (0, 1, 1, 0):
        sink(decided, number)
    assert spark.read.text(f"file://{tmp_path}/audit").count() == 4
