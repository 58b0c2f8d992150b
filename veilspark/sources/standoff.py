"""Annotated corpora: pairs of text and standoff files, one folder for each split.

``Pairs`` is a data source: it lists the folders once, pairs files by name and plans a task for every
``PAIRS`` pairs, which reads them through pyarrow's file systems; nothing is joined.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pairs of files that a task reads.
PAIRS = 256


@dataclass
class Chunk(InputPartition):
    """Pairs of files: (split, name, annotation file, text file)."""

    files: list[tuple[str, str, str, str]]


class _PairReader(DataSourceReader):
    def __init__(self, path: str, splits: list[str], pairs: int):
        self.path, self.splits, self.pairs = path, splits, pairs

    def partitions(self) -> list[Chunk]:
        found = []
        for split in self.splits:
            store, name = fs.FileSystem.from_uri(f"{self.path.rstrip('/')}/{split}")
            if store.get_file_info(name).type != fs.FileType.Directory:
                raise FileNotFoundError(f"no split {split} in {self.path}")
            of = {"ann": {}, "txt": {}}
            for info in store.get_file_info(fs.FileSelector(name, recursive=True)):
                if info.is_file and info.extension in of:
                    of[info.extension][info.base_name.rpartition(".")[0]] = info.path
            found += [(split, stem, of["ann"][stem], of["txt"][stem]) for stem in sorted(of["ann"].keys() & of["txt"].keys())]
        return [Chunk(found[k : k + self.pairs]) for k in range(0, len(found), self.pairs)] or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)

        def text(name: str) -> str:
            with store.open_input_stream(name) as f:
                return f.read().decode("utf-8", "replace")

        for split, stem, ann, txt in partition.files:
            yield stem, split, text(txt), text(ann)


class Pairs(DataSource):
    """``spark.read.format("standoff")`` with options ``path`` (a URI), ``splits`` (JSON list) and ``pairs``; a missing split is an error."""

    @classmethod
    def name(cls) -> str:
        return "standoff"

    def schema(self) -> str:
        return "doc_id string, split string, text string, ann string"

    def reader(self, schema) -> DataSourceReader:
        return _PairReader(self.options["path"], json.loads(self.options["splits"]), int(self.options.get("pairs", PAIRS)))


def entities(ann: Column) -> Column:
    """Spans of a standoff file: lines ``T<id>\\t<label> <start> <end>\\t<surface>``; split spans give the enclosing one."""
    lines = F.transform(F.filter(F.split(ann, "\r?\n"), lambda x: x.startswith("T")), lambda x: F.split(x, "\t"))
    heads = F.transform(F.filter(lines, lambda f: F.size(f) >= 3), lambda f: F.struct(F.split(f[1], "[ ;]").alias("h"), f[2].alias("surface")))
    good = F.filter(heads, lambda x: F.size(x["h"]) >= 3)
    return F.transform(good, lambda x: F.struct(x["h"][1].cast("bigint").alias("start"), F.element_at(x["h"], -1).cast("bigint").alias("end"), x["h"][0].alias("label"), x["surface"].alias("surface")))


def read(spark: SparkSession, path: str, splits: list[str]) -> DataFrame:
    """``doc_id``, ``split``, ``text``, ``gold`` of documents that have both files; a missing split is an error."""
    spark.dataSource.register(Pairs)
    uri = path if "://" in path else f"file://{path}"
    pairs = spark.read.format("standoff").option("path", uri).option("splits", json.dumps(splits)).load()
    return pairs.select("doc_id", "split", "text", entities(F.col("ann")).alias("gold"))


def read_apart(spark: SparkSession, annotations: str, texts: str, fallback: str) -> DataFrame:
    """Annotation files in one folder, texts in another or, where that lacks one, in a third."""
    stem = F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]+$", 1)
    files = lambda path, kind, name: spark.read.text(path, wholetext=True, pathGlobFilter=f"*.{kind}").select(stem.alias("doc_id"), F.col("value").alias(name))
    both = files(annotations, "ann", "ann").join(files(texts, "txt", "raw"), "doc_id", "left").join(files(fallback, "txt", "other"), "doc_id", "left")
    return both.select("doc_id", F.coalesce("raw", "other").alias("text"), entities(F.col("ann")).alias("gold")).where("text is not null")


def sample(docs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` documents by name."""
    return docs.orderBy("doc_id").limit(n)


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """Lower-case words of a file, without blank lines and comments."""
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("word"))
    return words.where("word <> '' and not startswith(word, '#')").distinct()
