"""Integer averages and sums, empty aggregates, text keys, byte-bounded text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def int_avg(c: Column) -> Column:
    """Average of integers, truncated toward zero, as INT."""
    return F.call_function("div", F.sum(c), F.nullif(F.count(c), F.lit(0))).cast("int")


def int32_wrap(c: Column) -> Column:
    """The low 32 bits of a bigint as INT."""
    return F.shiftright(F.shiftleft(c.cast("bigint"), 32), 32).cast("int")


def wrapping_sum(c: Column) -> Column:
    """Sum that wraps to INT as 32-bit arithmetic does."""
    return int32_wrap(F.sum(c))


def global_agg(df: DataFrame, *aggregates: Column, empty: str = "none") -> DataFrame:
    """Aggregate of all rows; over no rows it has no row (``empty="none"``) or Spark's one (``"row"``)."""
    if empty == "row":
        return df.agg(*aggregates)
    if empty != "none":
        raise ValueError(f'empty is "none" or "row", not {empty!r}')
    return df.groupBy(F.lit(0).alias("__all")).agg(*aggregates).drop("__all")


def alike(left: Column, left_type: T.DataType, right: Column, right_type: T.DataType) -> tuple[Column, Column]:
    """Join keys as they are compared: a number meets a text by its decimal digits, so 1 meets '1' but not '01'."""
    if isinstance(left_type, T.StringType) != isinstance(right_type, T.StringType):
        left, right = left.cast("string"), right.cast("string")
    return left, right


def fit_bytes(c: Column, most: int) -> Column:
    """Text cut to ``most`` bytes of UTF-8 at the end of a whole character: of the bytes at most three, those of a
    broken character, are dropped again."""
    data = F.encode(c, "UTF-8")

    def inside(k: int) -> Column:
        """Whether byte k goes on a character: its first hexadecimal digit is 8 to B."""
        return F.substring(F.hex(F.substring(data, k + 1, 1)), 1, 1).isin("8", "9", "A", "B")

    cut = F.coalesce(*[F.when(~inside(k), F.decode(F.substring(data, 1, k), "UTF-8")) for k in range(most, max(-1, most - 4), -1)])
    return F.when(F.octet_length(c) <= most, c).otherwise(cut)
