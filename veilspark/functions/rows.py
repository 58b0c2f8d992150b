"""Columns that a small function makes of each row, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


#: Rows whose values are Python objects at a time: a task's memory doesn't grow with Spark's batches.
SLICE = 512


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``SLICE`` rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            yield batch.slice(k, SLICE)


def strings(texts: pa.Array) -> list[str]:
    """The texts, null as an empty one."""
    return [t or "" for t in texts.to_numpy(zero_copy_only=False).tolist()]


Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def passed(rows: DataFrame, run: Pass, schema: T.StructType | str, bare: Pass | None = None) -> DataFrame:
    """``rows.mapInArrow``; a pass over its result that needs columns by name alone runs in the same worker (``over``).

    ``bare`` is the same without the surfaces of spans, for those that need places alone.
    """
    out = rows.mapInArrow(run, schema)
    out.pass_before = (rows, run, bare or run)
    return out


def over(df: DataFrame, columns: list[str], run: Pass, schema: T.StructType | str, surfaces: bool = True) -> DataFrame:
    """``run`` over batches of some columns; of a frame that is itself such a pass's, without another worker and another transfer.

    Without ``surfaces`` found spans may come without theirs.
    """
    if not (before := df.__dict__.get("pass_before")):
        return passed(df.select(*[F.col(f"`{c}`") for c in columns]), run, schema)
    rows, first = before[0], before[1 if surfaces else 2]
    return passed(rows, lambda batches: run(b.select(columns) for b in first(batches)), schema)


def _added(df: DataFrame, inputs: dict[str, Column | str], make: Callable[[list[pa.Array]], list[pa.Array]], outputs: dict[str, str]) -> DataFrame:
    """The frame with ``outputs`` that ``make`` gives for a slice; inputs that are names are columns as they are."""
    gone = {n.lower() for n in outputs}
    keep = [c for c in df.columns if c.lower() not in gone]
    made = [T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs.items()]
    fields = {f.name: f for f in df.schema.fields}
    if all(isinstance(c, str) for c in inputs.values()):
        needed = [*keep, *[c for c in dict.fromkeys(inputs.values()) if c not in keep]]
        places = [needed.index(c) for c in inputs.values()]
    else:
        df = df.select(*[F.col(f"`{c}`") for c in keep], *[(F.col(c) if isinstance(c, str) else c).alias(f"w__{n}") for n, c in inputs.items()])
        needed, places = df.columns, list(range(len(keep), len(keep) + len(inputs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *make([batch.column(k) for k in places])], names=[*keep, *outputs])

    return over(df, needed, run, T.StructType([*[fields[c] for c in keep], *made]))


def with_arrays(df: DataFrame, inputs: dict[str, Column | str], work: Callable[..., tuple[pa.Array, ...]], outputs: dict[str, str]) -> DataFrame:
    """As ``with_rows``, but ``work`` takes and gives Arrow arrays of a slice of rows."""
    arrow = [to_arrow_type(T._parse_datatype_string(t)) for t in outputs.values()]
    return _added(df, inputs, lambda columns: [c.cast(k) for c, k in zip(work(*columns), arrow)], outputs)


def with_rows(df: DataFrame, inputs: dict[str, Column | str], work: Callable[..., tuple], outputs: dict[str, str]) -> DataFrame:
    """Add ``outputs`` (name: Spark type): ``work`` gives their values from a row's ``inputs``.

    Columns of these names are replaced, whatever their case; the others come along.
    """
    arrow = [to_arrow_type(T._parse_datatype_string(t)) for t in outputs.values()]

    def make(columns: list[pa.Array]) -> list[pa.Array]:
        made = [work(*x) for x in zip(*[c.to_pylist() for c in columns])]
        return [pa.array(c, k) for c, k in zip(zip(*made) if made else [()] * len(arrow), arrow)]

    return _added(df, inputs, make, outputs)
