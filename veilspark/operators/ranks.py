"""Values at exact ranks, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the values of a key are cut into; only those with a wanted rank are sorted.
RANGES = 64


def values_at(df: DataFrame, key: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """``key``, ``n`` (values that aren't null) and, for each name, the value at that rank.

    ``ranks``: whole numbers from 1, as expressions of ``n``.  Ranges come from a sketch
    of the quantiles, but what is counted in them is exact, so ranks are exact too; equal
    values are added up before they meet.  A null key is a key like others; keys without
    values give no row.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).alias("v")).where("v is not null")
    steps = [i / RANGES for i in range(1, RANGES)]
    marks = rows.groupBy("k").agg(F.percentile_approx("v", steps, 10000).alias("marks"), F.count("*").alias("n"))
    of = marks.select(F.col("k").alias("mk"), "marks", "n")
    in_range = F.size(F.filter("marks", lambda m: m < F.col("v")))
    counted = rows.join(of, F.col("k").eqNullSafe(F.col("mk"))).select("k", "n", in_range.alias("part"), "v").groupBy("k", "n", "part", "v").agg(F.count("*").alias("c"))
    parts = counted.groupBy("k", "n", "part").agg(F.sum("c").alias("c"))
    before = F.sum("c").over(Window.partitionBy("k").orderBy("part")) - F.col("c")
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()]))
    wanted = parts.withColumn("before", before).withColumn("x", asked).where("x.rank > before and x.rank <= before + c")
    wanted = wanted.select(F.col("k").alias("wk"), F.col("part").alias("wp"), F.col("x.name").alias("name"), (F.col("x.rank") - F.col("before")).alias("at"))
    here = F.col("k").eqNullSafe(F.col("wk")) & (F.col("part") == F.col("wp"))
    upto = F.sum("c").over(Window.partitionBy("k", "part").orderBy("v"))
    sorted_ = counted.join(wanted.select("wk", "wp").distinct(), here, "left_semi").withColumn("upto", upto)
    hits = sorted_.join(wanted, here).where("at > upto - c and at <= upto")
    return hits.groupBy(F.col("k").alias(key), "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
