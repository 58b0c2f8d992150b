"""A text of over two million characters, beyond every slice and block, through the operators with Python in tasks."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm import bpe, conversation_repair, language, near_copies, packing, ranked_search, simhash, sketch, token_table, toxicity
from veilspark.llm.common import shared_dir

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
LONG = " ".join(f"w{i * i % 9973} né, {i % 311}" for i in range(170_000))
ROWS = [(1, "a short text before"), (2, LONG), (3, LONG + " tail"), (4, "a short text behind"), (5, None)]


@pytest.fixture(scope="module")
def long_docs(spark):
    assert len(LONG) > 2_000_000
    return spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)


def le(ids):
    return np.array(ids, "<u4").tobytes()


def test_tokens(spark, long_docs):
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for r in bpe.decode_ids(bpe.encode_text(long_docs, BYTE), BYTE).collect():
        assert bytes(r.ids) == le(byte.encode(r.text or "", add_special_tokens=False).ids) and r.decoded == (r.text or "")
    want = {d: word.encode(t or "", add_special_tokens=False).ids for d, t in ROWS}
    path = shared_dir(spark, "long-tables")
    token_table.write_tables(long_docs, path, WORD, 1)
    assert {r.doc_id: bytes(r.ids) for r in token_table.read_tables(spark, path).collect()} == {d: le(ids + [1]) for d, ids in want.items()}
    pieces = packing.pack(packing.cut_pieces(long_docs, WORD, 0, 2048), 5, 2048).collect()
    for d, ids in want.items():
        mine = sorted((r for r in pieces if r.doc_id == d), key=lambda r: r.piece)
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(le((ids + [0])[r.start : r.start + r.length])) for r in mine] and sum(r.length for r in mine) == len(ids) + 1


def test_fingerprints_and_near_copies(long_docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(long_docs, words=4).collect()}
    words = LONG.lower().split()
    total = np.zeros(64, np.int64)
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)], np.uint64)
    total = np.array([int((hashes >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)])
    fp = sum(1 << b for b in range(64) if 2 * total[b] > len(hashes))
    assert got[2].fp % 2**64 == fp and got[3].component_id == 2
    assert sorted(r.doc_id for r in near_copies.one_of_each(long_docs).collect()) == [1, 2, 4, 5]
    sketches = sketch.fingerprint(long_docs)
    by_id = {r.doc_id: r.fingerprint for r in sketches.collect()}
    assert by_id[2] == sketch.written(sketch.sketch(LONG)) and by_id[5] == ""
    merged = sketch.merged(sketches.withColumn("half", F.col("doc_id") < 3), "half")
    want = {half: sketch.written(sketch.merge(sketch.read(by_id[a]), sketch.read(by_id[b]))) for half, a, b in ((True, 1, 2), (False, 3, 4))}
    assert {r.half: r.fingerprint for r in merged.collect()} == want
    pair = sketches.where("doc_id = 2").select(F.col("fingerprint").alias("a")).crossJoin(sketches.where("doc_id in (3, 4)").select("doc_id", F.col("fingerprint").alias("b")))
    found = {r.doc_id: r for r in sketch.compared(pair, "a", "b").collect()}
    assert found[3].resemblance > 0.95 and found[3].containment > 0.95 and found[4].resemblance == 0


def test_scores_search_and_repair(spark, long_docs):
    labelled = spark.createDataFrame([(i, f"bana lono mira {i}" if i % 2 else f"krst prsk vlk {i}", "aa" if i % 2 else "bb") for i in range(40)], "doc_id long, text string, lang string")
    scored = {r.doc_id: r for r in language.predict(long_docs, language.fit(labelled)).collect()}
    assert scored[2].lang_pred in ("aa", "bb") and scored[5].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in toxicity.predict(long_docs, toxicity.Model(toxicity.Lexicon(["moron"], []), None)).collect())
    items = spark.createDataFrame([(1, "w49 né tail")], "item_id long, text string")
    assert [(r.rank, r.doc_id) for r in sorted(ranked_search.search(ranked_search.index(long_docs), items).collect(), key=lambda r: r["rank"])] == [(1, 3), (2, 2)]
    turns = spark.createDataFrame([(1, 0, "user", LONG + "."), (1, 1, "assistant", LONG + "."), (1, 2, "user", LONG + "."), (1, 3, "user", LONG)], "conv_id long, turn long, role string, text string")
    row = conversation_repair.repair(turns).first()
    assert (row.duplicate, row.truncated, row.cost, row.audit) == (1, 1, 4, "KKDD")
    assert row.repaired_sha256 == hashlib.sha256(f"user:{LONG}.\nassistant:{LONG}.".encode()).hexdigest()
