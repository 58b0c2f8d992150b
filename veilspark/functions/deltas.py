"""How many characters differ between two texts, as sequence matching counts them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def char_delta(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longer side of every replaced, added or deleted part, summed; 0 where a text is null."""

    def one(x: str | None, y: str | None) -> int:
        if x is None or y is None or x == y:
            return 0
        return sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in SequenceMatcher(None, x, y).get_opcodes() if tag != "equal")

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int64")
