"""The operators in DataFrame expressions against plain Python."""

import hashlib
import math
import re

import pytest
from collections import Counter

from pyspark.sql import functions as F

from veilspark.llm import pii, quality, queries, secrets

SF = "/root/testdata/sf0.01"
W = re.compile(r"[^\x20\x09-\x0D]+")


def base_secrets(text):
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def counts(text):
    w = W.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep)


def test_secrets_against_python(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op3_secrets(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(f"{k}:") for k in ("assign", "access", "hex"))
        assert set(want.split(",")) <= set(r.spans.split(",")) or not want


def test_secrets_odd_rows(odd, empty):
    rows = secrets.scan(odd).collect()
    assert len(rows) == odd.count() and secrets.scan(empty).count() == 0
    for r in rows:
        text = r.text or ""
        assert all(text[s.start : s.end] == s.surface for s in r.spans)
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base) == base_secrets(text)


def test_entropy_against_python(spark):
    value = "aZ3kQ9xLm2Pw7Rt5Yb8Nc4Vd6Ee1aaaaaaaaaaaaaaaaaaaa"
    alphabet = secrets.CLASSES["entropy_base64"][0]
    windows = [Counter(value[i : i + 20]) for i in range(len(value) - 19)]
    want = max(-sum(c / 20 * math.log2(c / 20) for c in w.values()) for w in windows)
    got = spark.createDataFrame([(value,)], "v string").select(secrets.entropy(F.col("v"), alphabet)).first()[0]
    assert abs(got - want) < 1e-5


def test_entropy_of_long_candidates(spark):
    """Windows over the borders of pieces count, and a long run takes time in proportion to its length."""
    rng = __import__("random").Random(3)
    alphabet = secrets.CLASSES["entropy_base64"][0]
    made = ["a" * (n - 10) + "".join(rng.sample(alphabet, 20)) + "b" * 300 for n in (30, 128, 129, 138, 256, 1000)]
    made += ["".join(rng.choices(alphabet[:8], k=n)) for n in (20, 127, 128, 129, 147, 148, 149, 700)]
    want = []
    for value in made:
        windows = [Counter(value[i : i + 20]) for i in range(len(value) - 19)]
        want.append(max(-sum(c / 20 * math.log2(c / 20) for c in w.values()) for w in windows))
    rows = spark.createDataFrame(list(enumerate(made)), "i long, v string").select("i", secrets.entropy(F.col("v"), alphabet).alias("e")).collect()
    assert all(abs(r.e - want[r.i]) < 1e-5 for r in rows) and len(rows) == len(want)
    blob = "aZ3kQ9xLm2Pw7Rt5" * 20000
    found = secrets.scan(spark.createDataFrame([(1, f"data {blob} end")], "doc_id long, text string")).first().spans
    assert [(s.kind, s.start, s.end) for s in found] == [("entropy_base64", 5, 5 + len(blob))]


def test_allow_list_by_plain_patterns(spark):
    """The allow-list against the same rules with repeated groups, and on candidates of many parts."""
    groups = re.compile(r"[0-9]+([-/_+][0-9]+)+|/?([a-z0-9_-]{1,16}/){2,}[a-z0-9_-]*")
    rng = __import__("random").Random(5)
    made = ["".join(rng.choices(c, k=rng.randrange(20, 45))) for c in ("1234-", "12-/", "ab1/", "a1/_-", "abcdef12/", "/ab1", "A1/b") for _ in range(60)]
    rows = spark.createDataFrame([(x,) for x in made], "v string").select("v", F.col("v").rlike(secrets.ALLOWED).alias("ok")).collect()
    other = re.compile(r"[0-9]+|(.)\1+")
    assert all(r.ok == bool(groups.fullmatch(r.v) or other.fullmatch(r.v)) for r in rows) and len({r.ok for r in rows}) == 2
    long = ["1-2_3/" * 50000 + "4", "ab1/" * 50000]
    assert [r.spans for r in secrets.scan(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).collect()] == [[], []]


def test_entropy_adds_and_allow_list_drops(spark):
    texts = ["blob aZ3kQ9xLm2Pw7Rt5Yb8Nc4Vd6Ee1 end", "id 123e4567-e89b-12d3-a456-426614174000", "12345678901234567890", "aB1" + "z" * 30, "key aZ3kQ9exampleLm2Pw7Rt5Yb8"]
    rows = secrets.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[s.kind for s in r.spans] for r in rows] == [["entropy_base64"], [], [], [], []]


def test_quality_against_python(spark, odd):
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df in (frame, odd):
        for r in quality.judge(df).collect():
            n, chars, symbols, dup, rep = counts(r.text or "")
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
            assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
            assert not (r.base_failed and r.kept) and r.kept == (r.rejected_by is None)


def test_quality_keeps_clean_and_order_does_not_matter(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    order = list(quality.RULES)
    a, b = quality.judge(frame, order=order), quality.judge(frame, order=order[::-1])
    assert {(r.doc_id, r.kept) for r in a.select("doc_id", "kept").collect()} == {(r.doc_id, r.kept) for r in b.select("doc_id", "kept").collect()}
    rows = a.where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.98 * len(rows)


def test_cascade_order():
    assert quality.cascade({"a": (1.0, 0.1), "b": (0.1, 0.1), "c": (0.1, 0.0)}) == ["b", "a", "c"]


def test_cascade_works_out_nothing_for_rejected_rows(spark):
    """An expensive rule that fails when it is run: it must not run on rows that an earlier rule rejected."""
    frame = spark.createDataFrame([(1, "one two"), (2, "one two three")], "doc_id long, text string")
    rules = {"few": "{n_words} < 3", "bomb": "if({n_repeat_words} >= 0 and size({words}) < 3, raise_error('ran'), {n_marks} > 0)"}
    rows = {r.doc_id: r.rejected_by for r in quality.judge(frame, rules=rules, order=["few", "bomb"], counts=False).collect()}
    assert rows == {1: "few", 2: None}
    with pytest.raises(Exception, match="ran"):
        quality.judge(frame, rules=rules, order=["bomb", "few"], counts=False).collect()
    values = quality.judge(frame.withColumn("Q_words", F.lit("mine")).withColumn("KEPT", F.lit(1)), order=["few_words"])
    assert [r.Q_words for r in values.collect()] == ["mine"] * 2 and "KEPT" not in values.columns


def test_quality_empty(empty):
    assert quality.judge(empty).count() == 0


PRIVATE = re.compile(r"[^\W_]+\.\d+@mail\d\.example\.com|\b\d{16}\b|\(\d{3}\) 555-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b")


def test_pii_leaves_nothing_and_links(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = pii.pseudonymise(frame, out="masked").collect()
    link, seen = {}, 0
    for r in rows:
        old, new = PRIVATE.findall(r.text), r.masked
        assert len(r.text.split()) == len(new.split())
        for v in old:
            seen += 1
            assert v not in new or sum(v in x for x in old) > 1
        if not old:
            assert new == r.text or r.n_pii
        for a, b in zip(r.text.split(), new.split()):
            if a != b and re.fullmatch(r"\d{16}|[\d.]{7,15}", a):
                assert link.setdefault(a, b) == b and len(a) == len(b) or "." in a
    assert seen > 50


def test_pii_formats_and_restore(spark):
    texts = ["4111111111111111", "+1 (980) 555-6268 and 980-555-6268", "born 2024-02-29 or 31/12/1999", "ip 10.0.255.7", "123-45-6789", "5500 0000 0000 0004", "9890149938096989", "éa.b@mail7.example.com", "Version 2.0, v4.0.1 of 10 words", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    once = pii.pseudonymise(df, out="masked")
    rows = {r.doc_id: r.masked for r in once.collect()}
    luhn = lambda d: sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    assert luhn(rows[0]) and rows[0] != texts[0] and luhn(rows[5].replace(" ", "")) and not luhn(rows[6])
    a, b = rows[1].split(" and ")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and re.sub(r"\D", "", a)[1:] == re.sub(r"\D", "", b)
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d or \d\d/\d\d/\d{4}", rows[2])
    assert all(int(x) < 256 for x in rows[3][3:].split("."))
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", rows[4]) and rows[8] == texts[8] and rows[9] is None and rows[10] == ""
    assert re.fullmatch(r"user\d{12}@mail7\.example\.com", rows[7])
    back = {r.doc_id: r.back for r in pii.restore(once, text="masked", out="back").collect()}
    assert all(back[i] == texts[i] for i in range(len(texts)) if i != 7)


def test_pii_goes_through_long_texts(spark):
    """Runs of tens of thousands of parts: no stack is exhausted, formats stay."""
    texts = ["1-2 " * 30000, "4 " * 30000 + "x", "AB12 " * 20000, "a" * 1000000, "a.b" * 100000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, "mail a@" + "ab." * 40000 + "com")], "doc_id long, text string")
    rows = {r.doc_id: r.masked for r in pii.pseudonymise(df, out="masked").collect()}
    assert len(rows) == 6 and all(len(rows[i]) == len(x) for i, x in enumerate(texts)) and all(rows[i] == texts[i] for i in (3, 4)) and rows[9].startswith("mail user")


def test_pii_odd_rows(odd, empty):
    assert pii.pseudonymise(odd).count() == odd.count() and pii.pseudonymise(empty).count() == 0
    assert pii.pseudonymise(odd).where("text is null").count() == 1


def test_entropy_finds_unquoted_assignments_and_parameters(spark):
    blob, digits = "aZ3kQ9xLm2Pw7Rt5Yb8Nc4Vd6Ee1Gh0J", "04DBEBAB91AB85687D33EE"
    made = [f"AWS_SECRET_ACCESS_KEY={blob}", f"GET /x?id=7&sig={blob}&v=2", f"?sig={blob}==", f"KEY=={blob}", f"HASH={digits};", f"x={blob}={blob}"]
    want = [[blob], [blob], [f"{blob}=="], [blob], [digits], [f"{blob}=", blob]]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[s.surface for s in r.spans] for r in rows] == want
    assert {s.kind for s in rows[4].spans} == {"entropy_hex"}


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_ibans_stay_valid_and_come_back(spark):
    good = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "ES9121000418450200051332", "FR1420041010050500013M02606"]
    bad = ["DE88 3704 0044 0532 0130 00", "ES9021000418450200051332"]
    df = spark.createDataFrame([(i, f"to {x} now") for i, x in enumerate(good + bad)], "doc_id long, text string")
    done = pii.pseudonymise(df)
    rows = {r.doc_id: r.text[3:-4] for r in done.collect()}
    for i, x in enumerate(good + bad):
        assert rows[i] != x and re.sub(r"\d", "0", rows[i]) == re.sub(r"\d", "0", x) and iban_ok(rows[i]) == (i < len(good))
    assert {r.doc_id: r.text for r in pii.restore(done).collect()} == {i: f"to {x} now" for i, x in enumerate(good + bad)}


def feistel(digits, key, kind):
    """The permutation of digits in plain Python."""
    half = len(digits) // 2
    a, b = digits[:half], digits[half:]
    for r in range(8):
        f = int(hashlib.sha256(f"{key}|{kind}|{r}|{b}".encode()).hexdigest()[:15], 16)
        made = (int(a) + f % 10 ** len(a)) % 10 ** len(a)
        a, b = b, str(made).zfill(len(a))
    return a + b


def test_pseudonyms_against_plain_python(spark):
    rng = __import__("random").Random(4)
    rows = [(i, f"{rng.randrange(1000):03d}-{rng.randrange(100):02d}-{rng.randrange(10000):04d}") for i in range(60)]
    rows += [(100 + i, f"({rng.randrange(1000):03d}) {rng.randrange(1000):03d}-{rng.randrange(10000):04d}") for i in range(60)]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in rows:
        digits = iter(feistel(re.sub(r"\D", "", x), pii.KEY, "number" if i < 100 else "phone"))
        assert got[i] == re.sub(r"\d", lambda _: next(digits), x)
