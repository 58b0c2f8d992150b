"""The operators with Python in tasks against libraries and brute force, and on odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm import bpe, language, near_copies, packing, queries, simhash, sketch, token_table, toxicity
from veilspark.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = ["", "  a  b \n c", "a<|endoftext|>  b <|endoftext|>", "aaaaaa aaa" * 30, "x" * 2000 + "日本語" * 400, "é́ \xa0 b\t\tc  ", "it's they'll I'D", "12345,,, !!\n\n\n", "  a\x85 c", "İΣς ß", "THE!! of&&& 😀", "ab" * 700]


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def le(ids):
    return np.array(ids, "<u4").tobytes()


def test_byte_bpe_is_the_library(texts):
    lib, own = Tokenizer.from_file(BYTE), bpe.ByteBPE(BYTE)
    every = ODD + list(texts.values())
    for t, got, want in zip(every, own.encode(every), lib.encode_batch(every, add_special_tokens=False)):
        assert got == le(want.ids), t[:80]
        assert own.decode(got) == lib.decode(want.ids, skip_special_tokens=False)


def test_op1(spark, texts):
    lib = Tokenizer.from_file(BYTE)
    rows = queries.op1_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(le(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(odd, empty):
    back = bpe.decode_ids(bpe.encode_text(odd, BYTE), BYTE)
    assert all(r.decoded == (r.text or "") for r in back.collect()) and back.count() == odd.count()
    assert bpe.encode_text(empty, BYTE).count() == 0
    some = bpe.encode_text(odd.limit(4), BYTE).select("ids", bpe.ids_as_array(F.col("ids")).alias("a"))
    assert all(le(r.a) == bytes(r.ids) for r in some.collect())


def word_ids(text, end):
    return Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids + [end]


def test_op2(spark, texts):
    lib, at, want = Tokenizer.from_file(WORD), 0, []
    for d in sorted(texts):
        ids = lib.encode(texts[d], add_special_tokens=False).ids + [1]
        want.append((d, at, len(ids), zlib.crc32(le(ids))))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op2_token_tables(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_word_ids_are_the_librarys():
    from veilspark.llm.word_ids import encoder

    lib = Tokenizer.from_file(WORD)
    assert encoder(WORD)(ODD) == [le(lib.encode(t, add_special_tokens=False).ids) for t in ODD]


def test_token_tables_lookup_and_odd_rows(spark, odd, empty):
    path = shared_dir(spark, "tables")
    token_table.write_tables(odd, path, WORD, 1)
    rows = token_table.read_tables(spark, path).collect()
    assert len(rows) == odd.count() and [r.doc_id for r in sorted(rows, key=lambda r: r.start)][0] is None
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(r.doc_id for r in odd.collect() if r.doc_id is not None)
    assert [bytes(x) for _, x in token_table.lookup(spark, path, 3)] == [le(word_ids("word", 1))]
    assert len(token_table.lookup(spark, path, 11)) == 2 and not token_table.lookup(spark, path, 999)
    path = shared_dir(spark, "tables")
    token_table.write_tables(empty, path, WORD, 1)
    assert token_table.read_tables(spark, path).count() == 0


def test_op5_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op5_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(odd, empty, docs):
    model = language.fit(docs)
    rows = language.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(r.lang_pred == "und" for r in rows if not (r.text or "").strip())
    assert language.predict(empty, model).count() == 0
    assert language.fit(docs.where("false")) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}


def test_op7_against_brute_force(spark, texts):
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in queries.op7_sketch(spark, SF).collect()}
    assert sorted(rows) == sorted(texts)
    for d, n in zip(order, order[1:] + order[:1]):
        own, other, r = texts[d], texts[n], rows[d]
        edited = own[: len(own) - len(own) // 2] + other[: len(own) // 2]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(own)
        assert r.fingerprint == sketch.written(sketch.sketch(own)) and r.edited_fingerprint == sketch.written(sketch.sketch(edited))
        assert r.near_next == sketch.resemblance(sketch.sketch(own), sketch.sketch(other))


def test_sketch_estimates_and_merge():
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    sa, sb = sketch.sketch(a), sketch.sketch(b)
    assert abs(sketch.resemblance(sa, sb) - 996 / 2996) < 0.12
    assert abs(sketch.containment(sa, sb) - 0.5) < 0.17
    assert abs(sketch.distinct_count(sa) / 1996 - 1) < 0.3
    parts = [sketch.bottom(sketch.shingle_hashes(sketch.word_hashes([w.encode() for w in words[s:e]]))) for s, e in ((0, 1004), (1000, 2000))]
    assert (sketch.merge(*parts) == sa).all() and (sketch.read(sketch.written(sa)) == sa).all()
    assert sketch.resemblance(sketch.sketch("a b"), sketch.sketch("a b")) == 1 and not len(sketch.sketch(" "))


def test_sketch_odd_rows(odd, empty):
    assert sketch.compare_with_next(odd).count() == odd.count() and sketch.compare_with_next(empty).count() == 0
    assert sketch.compare_with_next(odd.limit(1)).count() == 1
    assert sketch.fingerprint(odd).where("fingerprint = ''").count() == 3


def test_op8_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.toxic == r.predicted for r in rows) >= 0.97 * len(rows)
    assert sum(r.predicted for r in rows if r.toxic) >= 0.9 * sum(r.toxic for r in rows)


def test_toxicity_misspellings_and_quotes():
    lexicon = toxicity.Lexicon(["moron", "worthless", "disgusting"], ["gruml"])
    kinds = {w: lexicon.kind(w) for w in ("moron", "wortless", "worthles", "worthless", "dissgusting", "grumlig", "mor", "harmless", "disgustng")}
    assert kinds == {"moron": 1, "wortless": 2, "worthles": 2, "worthless": 1, "dissgusting": 2, "grumlig": 1, "mor": 0, "harmless": 0, "disgustng": 2}
    table = toxicity.Pieces(lexicon)
    assert table["m0ron"] == toxicity.FUZZY and table["plain"] == 0
    quoted = toxicity.features('they wrote "moron" on it'.split(), table)
    plain = toxicity.features("you are a moron today".split(), table)
    assert quoted[0] == 0 < quoted[3] and plain[0] > 0 == plain[3] and plain[4] > 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abc"), 6)) for _ in range(20)]
    for k in (1, 2):
        auto = toxicity.Automaton(words, k)
        for _ in range(500):
            w = "".join(rng.choice(list("abcd"), rng.integers(3, 9)))
            assert auto.accepts_word(w) == (min(edits(w, x) for x in words) <= k)


def test_toxicity_odd_rows(spark, odd, empty, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.predict(odd, model).collect()
    assert len(rows) == odd.count() and len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert toxicity.predict(empty, model).count() == 0
    assert {r.score for r in toxicity.predict(odd, toxicity.fit(docs, labels.where("false"))).collect()} == {0.0}


def check_packing(rows, texts):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_op9(spark, texts):
    rows = queries.op9_packing(spark, SF).collect()
    n = check_packing(rows, texts)
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r.doc_id][r.piece] = (r.start, r.length, r.ids_crc32)
    lib, total = Tokenizer.from_file(WORD), 0
    for d, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids + [0]
        total += len(ids)
        want = {k: (s, len(ids[s : s + 2048]), zlib.crc32(le(ids[s : s + 2048]))) for k, s in enumerate(range(0, len(ids), 2048))}
        assert pieces[d] == want
    assert n <= -(-total // 2048) * 1.03 + 2


def test_fullest_against_brute_force():
    from itertools import combinations

    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 40, 9).tolist()
        counts = {x: lengths.count(x) for x in lengths}
        got = packing.fullest(counts, sorted(counts), 60)
        best = max(s for k in range(10) for c in combinations(lengths, k) if (s := sum(c)) <= 60)
        assert sum(got) == best and all(got.count(x) <= counts[x] for x in got)


def test_packing_odd_rows(odd, empty):
    rows = packing.pack(packing.cut_pieces(odd, WORD, 0, 2048), odd.count(), 2048).collect()
    check_packing(rows, None)
    assert packing.pack(packing.cut_pieces(empty, WORD, 0, 2048), 0, 2048).count() == 0


def brute_components(fps, ids):
    parent = {i: i for i in range(len(fps))}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least.setdefault(find(i), []).append(ids[i])
    return {ids[i]: min(least[find(i)]) for i in range(len(fps))}


def slow_simhash(text):
    words = [w for w in text.encode().lower().split()]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def test_op10(spark, texts):
    rows = {r.doc_id: r for r in queries.op10_simhash(spark, SF).collect()}
    ids = sorted(texts)
    fps = [slow_simhash(texts[d]) for d in ids]
    want = brute_components(fps, ids)
    assert all(rows[d].fingerprint == f"{f:016x}" and rows[d].component_id == want[d] for d, f in zip(ids, fps))


@pytest.mark.parametrize("most", [simhash.CELL, 20])
def test_simhash_dense_groups(spark, most):
    """Hundreds of fingerprints around a few centres: large cells, chains, and outsiders."""
    rng = np.random.default_rng(5)
    fps = set()
    for centre in rng.integers(0, 2**63, 4):
        for _ in range(150):
            f = int(centre)
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame([(0, f) for f in signed], "view int, fp long")
    assert (simhash.crowded(frame, most).count() > 0) == (most == 20)
    links = simhash.candidate_links(frame, most).select("a", "b")
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for f in signed:
        got[roots.get(f, f)].add(f)
    for i, root in brute_components(fps, list(range(len(fps)))).items():
        want[root].add(signed[i])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and simhash.near_duplicates(empty).count() == 0
    assert len({r.component_id for r in rows if r.fp == 0}) == 1


def test_one_of_each(spark, odd, empty):
    base = [f"word{i}" for i in range(300)]
    near = base[:100] + ["other"] + base[101:200] + ["thing"] + base[201:]
    apart = [f"else{i}" for i in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(apart)), (4, " ".join(base)), (4, " ".join(base)), (3, " ".join(apart))]
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]
    assert near_copies.one_of_each(empty).count() == 0 and near_copies.one_of_each(odd).count() < odd.count()


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def edited_copies(rng, kind, n, share):
    """A text of n words and a copy of which so great a share of shingles has changed by one kind of edit."""
    words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
    fresh = [f"x{x}" for x in rng.integers(0, 10**6, n)]
    m = round(share * (n - 4))
    if kind == "appended":
        new = words + fresh[:m]
    elif kind == "truncated":
        new = words[: n - m]
    elif kind == "replaced":
        at, m = int(rng.integers(10, n // 2)), m - 4
        new = words[:at] + fresh[:m] + words[at + m :]
    else:
        new = list(words)
        for i in (np.arange(m // 5) * 7 + 5).tolist():
            new[i] = fresh[i]
    return " ".join(words), " ".join(new)


#: Shares of changed shingles that give similarities just above 0.8, and below.
KINDS = {"appended": (0.24, 0.30), "truncated": (0.19, 0.25), "replaced": (0.105, 0.15), "scattered": (0.105, 0.15)}


@pytest.mark.parametrize("most", [near_copies.MOST, 2])
def test_one_of_each_finds_every_kind_of_copy(spark, most):
    rng = np.random.default_rng(7)
    rows = []
    for kind, (near, _) in KINDS.items():
        for n in (120, 400, 1500):
            for _ in range(20):
                a, b = edited_copies(rng, kind, n, near)
                assert 0.8 <= jaccard(a, b) < 0.85
                rows += [(len(rows), a), (len(rows) + 1, b)]
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()
    assert sorted(r.doc_id for r in kept) == [r[0] for r in rows[::2]]


def test_one_of_each_keeps_texts_below_the_similarity(spark):
    """Pairs below 0.8 stay whole; of a chain of links at 0.8 or more one text stays."""
    rng = np.random.default_rng(8)
    rows = []
    for kind, (_, far) in KINDS.items():
        for n in (120, 400, 1500):
            for _ in range(10):
                a, b = edited_copies(rng, kind, n, far)
                assert 0.7 <= jaccard(a, b) < 0.8
                rows += [(len(rows), a), (len(rows) + 1, b)]
    far = len(rows)
    words = [f"c{i}" for i in range(600)]
    rows += [(far + i, " ".join(words[30 * i : 30 * i + 400])) for i in range(4)]
    assert jaccard(rows[far][1], rows[far + 1][1]) >= 0.8 > jaccard(rows[far][1], rows[far + 3][1])
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(far + 1))


@pytest.mark.parametrize("n", [1000, 4000, 16000])
def test_dealt_rows_are_constant_a_text(spark, n):
    """Texts that share 100 words and nothing else: rows that meet don't grow with the size of their group."""
    phrase = " ".join(f"licence{i}" for i in range(100))
    rows = [(k, k, f"{phrase} " + " ".join(f"own{k}x{i}" for i in range(115))) for k in range(n)]
    keyed = spark.createDataFrame(rows, "doc_id long, h long, text string").repartition(8)
    rooted = near_copies.sketches(keyed).select("unit", F.col("unit").alias("root"), "n", "sign")
    small, pairs, written = near_copies.dealt(rooted)
    assert sum(w.count() for w in written) <= 8 * n and pairs.count() <= n
    assert max(s.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0 for s in small) <= near_copies.MOST


def test_copies_under_a_shared_phrase_are_found(spark):
    """Copies among texts that all share a phrase, and a group of hundreds of copies of one another."""
    rng = np.random.default_rng(9)
    phrase = " ".join(f"licence{i}" for i in range(100))
    rows = []
    for _ in range(150):
        a, b = edited_copies(rng, "scattered", 400, 0.09)
        rows += [(len(rows), f"{phrase} {a}"), (len(rows) + 1, f"{phrase} {b}")]
    base = [f"base{i}" for i in range(300)]
    for k in range(300):
        words = list(base)
        for i in rng.choice(300, 3, replace=False):
            words[i] = f"edit{k}x{i}"
        rows.append((1000 + k, " ".join(words)))
    kept = {r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {*range(0, 300, 2), 1000}


def test_packing_groups_do_not_hang_on_identifiers(spark):
    docs = spark.range(64).select(F.when(F.col("id") < 32, 7).cast("long").alias("doc_id"), F.lit("some words of a text").alias("text"))
    rows = packing.pack(packing.cut_pieces(docs, WORD, 0, 2048), 64, 2048, group_docs=8).collect()
    check_packing(rows, None)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.sequence_id >> 32] += 1
    assert len(rows) == 64 and max(sizes.values()) < 24


def test_names_that_differ_in_case_are_replaced(spark, docs):
    few = spark.createDataFrame([(1, "plain words of a text", 5, "x")], "doc_id long, text string, IDS int, Score string")
    few = few.withColumns({"Lang_Pred": F.lit(1), "Fingerprint": F.lit(2), "N_Tokens": F.lit(3)})
    assert bpe.encode_text(few, BYTE).select("ids", "n_tokens").first().n_tokens > 0
    assert toxicity.predict(few, toxicity.Model(toxicity.Lexicon([], []), None)).select("score").first().score == 0
    assert language.predict(few, None).select("lang_pred", "score").first().lang_pred == "und"
    assert len(sketch.fingerprint(few).select("fingerprint").first().fingerprint) == 16


@pytest.mark.parametrize("n", [100, 400, 1600])
def test_links_grow_with_members_not_pairs(spark, n):
    """Around one centre a fingerprint has no more links than it has cells, however large the group."""
    rng = np.random.default_rng(n)
    fps = {int(rng.integers(0, 2**62))}
    centre = min(fps)
    while len(fps) < n:
        f = centre
        for b in rng.choice(62, rng.integers(1, 4), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    frame = spark.createDataFrame([(0, f) for f in sorted(fps)], "view int, fp long")
    assert simhash.candidate_links(frame).count() <= 34 * n


def test_language_against_brute_force(spark):
    """Scores of the queries' model against kernels, features and regressions worked out whole."""
    rng = np.random.default_rng(2)
    words = {"aa": ["bana", "lono", "mira"], "bb": ["krst", "prsk", "vlk"], "cc": ["yueh", "xiao", "qing"]}
    texts = [(lang, " ".join(rng.choice(w, 12))) for lang, w in words.items() for _ in range(20)]
    bits = np.array([language.bitmap(t) for _, t in texts], np.float64).reshape(len(texts), -1)
    langs = [x for x, _ in texts]
    model = language.train(np.packbits(bits.astype(np.uint8), axis=1), langs, landmarks=9)
    unit = bits / np.sqrt(bits.sum(axis=1, keepdims=True))
    chosen = [i for k in range(3) for i in range(20 * k, 20 * k + 3)]
    kernel = unit[chosen] @ unit[chosen].T
    value, vector = np.linalg.eigh(kernel)
    white = vector[:, value > 1e-6 * value.max()] / np.sqrt(value[value > 1e-6 * value.max()])
    feature = unit @ unit[chosen].T @ white
    target = np.array([[1.0 if x == n else -1.0 for n in sorted(words)] for x in langs])
    solved = np.linalg.solve(feature.T @ feature + language.RIDGE * len(texts) * np.eye(feature.shape[1]), feature.T @ target)
    assert (model.scores(bits.astype(np.float32)).argmax(axis=1) == (feature @ solved).argmax(axis=1)).all()
    assert [sorted(words)[k] for k in model.scores(bits.astype(np.float32)).argmax(axis=1)] == langs


def test_near_edited_and_near_next_against_whole_sets(texts, spark):
    """Estimates of op7 against resemblance counted on whole shingle sets."""
    rows = queries.op7_sketch(spark, SF).collect()
    order = sorted(texts, reverse=True)

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def share(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    off = []
    for r in rows:
        own, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        cut = len(own) // 2
        edited = own[: len(own) - cut] + after[:cut]
        assert hashlib.sha256(edited.encode()).hexdigest() == r.edited_sha256 and r.n_chars == len(own)
        off += [abs(r.near_edited - share(own, edited)), abs(r.near_next - share(own, after))]
    assert np.mean(off) < 0.03 and np.max(off) < 0.2


def test_short_terms_and_stems_are_found_misspelled():
    lexicon = toxicity.Lexicon(["moron", "idiot", "rareword"], ["worthl"], ["moron", "idiot"], ["moroon"])
    near = {w: lexicon.kind(w) for w in ("moron", "morn", "idoit", "idiots", "lozer", "moroon", "rarewurd", "worthless", "wortless", "worthxess", "mo", "x")}
    fuzzy = {w for w, k in near.items() if k == toxicity.FUZZY}
    # one letter left out, put in or changed; two that change places are two edits, which long words alone may have
    assert fuzzy == {"morn", "idiots", "wortless", "worthxess"} and near["moron"] == near["worthless"] == toxicity.EXACT


def test_lexicon_and_regression_against_brute_force(spark):
    """Counts of distinct texts, support and the fitted weights, worked out in plain Python."""
    import re

    rows = [(i, f"{w} plain text number n{i} you {w}") for i, w in enumerate(["moron"] * 4 + ["scumbag"] * 4)] + [(100 + i, f"a clean text of words c{i} and more") for i in range(12)] + [(0, "moron plain text number n0 you moron")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 100)) for d, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    texts = {(t, int(d < 100)) for d, t in rows}
    toxic = Counter(w for t, y in texts if y for w in set(re.findall(r"[^\W\d_]+", t)))
    clean = Counter(w for t, y in texts if not y for w in set(re.findall(r"[^\W\d_]+", t)))
    good = {w for w, k in toxic.items() if len(w) > 2 and k >= 3 and not clean[w]}
    assert {w for w in good if model.lexicon.exact(w)} == {w for w in good if w not in ("text",)} and model.lexicon.exact("moron")
    table = toxicity.Pieces(model.lexicon)
    x = np.array([toxicity.features(t.lower().split(), table) for _, t in rows])
    y = np.array([int(d < 100) for d, _ in rows])
    total = {1: 8, 0: 12}
    weight = np.where(y == 1, total[1] / y.sum(), total[0] / (1 - y).sum())
    weights = toxicity.logistic(x, y, weight / weight.mean())
    assert np.allclose(weights, model.weights, atol=1e-6)
    score = {r.doc_id: r.score for r in toxicity.predict(docs, model).collect()}
    assert all((score[d] >= 0.5) == (d < 100) for d, _ in rows)
