"""Results and predictions as tables and files: JSON records, a cache of predictions, a report, where they come from."""

from __future__ import annotations

import hashlib
import os
import platform
import subprocess
from dataclasses import astuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from veilspark.operators import lexicon, rules


def write_record(record: DataFrame, path: str) -> None:
    """Records as JSON files, a line each."""
    record.write.mode("overwrite").json(path)


def read_record(spark: SparkSession, path: str) -> DataFrame | None:
    """Records of JSON files, over several lines or one; None where there are none."""
    try:
        return spark.read.json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def cached(docs: DataFrame, path: str, predict, key: str = "doc_id") -> DataFrame:
    """Predictions of all ``docs``: those that the Parquet table has, and new ones, which are appended to it."""
    spark = docs.sparkSession
    try:
        have = spark.read.parquet(path)
        missing = docs.join(have.select(key), key, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        missing = docs
    predict(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(docs.select(key), key, "left_semi")


def percent(value: Column) -> Column:
    return F.concat(F.format_string("%.1f", 100 * value), F.lit(" %"))


def report(title: str, scores: DataFrame, columns: list[str], order: list) -> DataFrame:
    """Lines of a Markdown table, numbered; the values must be text."""
    head = scores.sparkSession.createDataFrame([(-3, f"## {title}"), (-2, "| " + " | ".join(columns) + " |"), (-1, "|" + "---|" * len(columns))], "line_no long, line string")
    from pyspark.sql import Window

    rows = scores.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |")).alias("line"))
    return head.unionByName(rows)


def fixed_values() -> dict[str, str]:
    """All that detection hangs on, as text by name: rules and fixed values."""
    values = {f"lexicon.{k}": repr(sorted(v) if isinstance(v, set) else v) for k, v in vars(lexicon).items() if k.isupper()}
    return values | {f"rule.{i:02d}.{r.name}": repr(astuple(r)) for i, r in enumerate(rules.RULES)}


def table_hash() -> str:
    return hashlib.sha256(repr(sorted(fixed_values().items())).encode()).hexdigest()


def freeze(spark: SparkSession, path: str) -> None:
    """Write the fixed values, so that later ones can be held against them."""
    spark.createDataFrame(sorted(fixed_values().items()), "name string, value string").coalesce(1).write.mode("overwrite").json(path)


def changed_since(spark: SparkSession, path: str) -> DataFrame:
    """``name`` and ``change`` (added, removed, changed) of the fixed values against frozen ones; no rows: a detector as it was."""
    now = spark.createDataFrame(sorted(fixed_values().items()), "name string, new string")
    both = spark.read.schema("name string, value string").json(path).join(now, "name", "full")
    change = F.when(F.col("value").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("value") != F.col("new"), "changed")
    return both.select("name", change.alias("change")).where("change is not null")


def revision() -> tuple[str | None, bool | None]:
    """The commit of the code's folder and whether files differ from it; None where that isn't known."""
    run = lambda *a: subprocess.run(["git", "-C", os.path.dirname(os.path.abspath(__file__)), *a], capture_output=True, text=True, timeout=20, check=True).stdout.strip()
    try:
        return run("rev-parse", "HEAD"), bool(run("status", "--porcelain"))
    except (OSError, subprocess.SubprocessError):
        return None, None


def provenance(spark: SparkSession, seed: int) -> dict[str, Column]:
    """Columns that say what made a record."""
    commit, dirty = revision()
    return {"spark_version": F.lit(spark.version), "python_version": F.lit(platform.python_version()), "revision": F.lit(commit).cast("string"), "dirty": F.lit(dirty).cast("boolean"), "rules_sha256": F.lit(table_hash()), "seed": F.lit(seed)}
