"""Near copies in buckets that are too great to be compared at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import near_copies


@pytest.mark.parametrize("block", [1024, 16])
def test_pairs_of_great_buckets_meet(spark, block):
    """Two signatures that agree in one band of many texts and in 100 bytes, but in no two bands behind each other that split the bucket."""
    rng = np.random.default_rng(3)
    signs = rng.integers(0, 256, (200, near_copies.SIGNS)).astype(np.uint8)
    signs[:, : near_copies.BAND] = 7
    # of the second, a byte of every band but the first is another's
    signs[1] = signs[0]
    signs[1, near_copies.BAND :: near_copies.BAND] += 1
    # a group that is joined already
    rows = [(k, 50 if k >= 50 else k, 100, bytes(x)) for k, x in enumerate(signs)]
    rooted = spark.createDataFrame(rows, "unit long, root long, n int, sign binary").repartition(4)
    small, pairs, written = near_copies.dealt(rooted)
    columns = ["unit", "root", "n", "sign"]
    near = {tuple(r) for x in small for r in near_copies.met(x.join(rooted, "unit"), columns, near_copies.lookalikes).collect()}
    assert (1, 0) not in near | {tuple(r) for r in pairs.collect()}
    roots = rooted.where("unit <> root").select(F.col("unit").alias("node"), "root")
    crowds = near_copies.crowded(written[0], rooted, roots, block=block)
    got = near_copies.met(crowds, columns, near_copies.lookalikes)
    assert [tuple(r) for r in got.collect()] == [(1, 0)]
    assert crowds.groupBy("bucket").count().agg(F.max("count")).first()[0] <= min(4 * block, 200)


def test_texts_that_look_alike_and_are_not_cost_no_row_a_pair(spark, monkeypatch):
    """Hundreds of texts 0.72 alike, three pairs of copies among them: the copies are found, and rows that are written follow the texts."""
    shared = " ".join(f"shared{i}" for i in range(300))
    rows = [(k, f"{shared} " + " ".join(f"own{k}x{i}" for i in range(58))) for k in range(500)]
    rows += [(500 + k, " ".join([*rows[k][1].split()[:320], *(f"new{k}x{i}" for i in range(38))])) for k in range(3)]
    written, plain = {}, near_copies.materialize

    def counted(df, name):
        out = plain(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(500))
    assert max(written.values()) <= 45 * len(rows), written
