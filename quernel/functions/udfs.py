"""User-defined functions, for what built-in functions cannot say; all but the last take batches.

Types are objects, not strings: strings would need a session at import.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def clipped(values: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """Values held within bounds."""
    return values.clip(low, high)


@F.arrow_udf(T.StringType())
def initials(names: pa.Array) -> pa.Array:
    """First letter and length of a name, as one string."""
    return pc.binary_join_element_wise(pc.utf8_slice_codeunits(names, 0, 1), pc.cast(pc.utf8_length(names), pa.string()), "")


@F.pandas_udf(T.DoubleType())
def trimmed_mean(values: pd.Series) -> float:
    """Mean without the smallest and the largest value; null for fewer than three."""
    v = values.dropna().sort_values()
    return float(v.iloc[1:-1].mean()) if len(v) > 2 else None


@F.udtf(returnType=T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("word", T.StringType())]))
class NumberedWords:
    """The words of a text with their places."""

    def eval(self, text: str):
        for i, w in enumerate((text or "").split(" ")):
            yield i, w


@F.udf(T.LongType())
def digit_sum(n):
    """Row at a time: for functions that have no batch form, on few rows."""
    return None if n is None else sum(map(int, str(abs(n))))
