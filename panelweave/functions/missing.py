"""Missing and special values.

Rules kept throughout: text that is no number becomes NULL; sums skip NULL and give 0 for a group
without values; means skip NULL and give NULL for such a group; logs of non-positive numbers are
NULL; a ratio with zero denominator is NULL unless infinities are asked for.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.DecimalType)
FLOATING = (T.DoubleType, T.FloatType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column) -> Column:
    """Text to double; anything that is not a number becomes NULL.

    Most non-numbers are marks such as (D) or N. They are told by their first character, because a
    failing cast is far dearer than a comparison when many cells are suppressed.
    """
    text = F.ltrim(col(c).cast("string"))
    return F.when(F.ascii(text).between(ord("+"), ord("9")), text.try_cast("double"))


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double, NULL where the denominator is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def ratio_inf(num: str | Column, den: str | Column) -> Column:
    """num / den where a zero denominator gives +-Infinity, and 0/0 gives NaN."""
    n, d = col(num).cast("double"), col(den).cast("double")
    at_zero = (
        F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf"))).when(n == 0, F.lit(float("nan")))
    )
    return F.when(d == 0, at_zero).otherwise(F.try_divide(n, d))


def log(c: str | Column) -> Column:
    """Natural log, NULL for values that are zero, negative or NaN."""
    x = col(c).cast("double")
    return F.when((x > 0) & ~F.isnan(x), F.ln(x))


def log_inf(c: str | Column) -> Column:
    """Natural log with -Infinity for zero and NaN for negative values."""
    x = col(c).cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def sum0(c: str | Column) -> Column:
    """Sum over a group that is 0, not NULL, when the group holds no value."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def cast_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in columns})


def fill_zero(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.fillna(0, subset=list(columns))


def suppress_small(df: DataFrame, columns: Iterable[str], threshold: float = 3) -> DataFrame:
    """Cells below ``threshold`` become 0; NULL stays NULL."""
    return df.withColumns({c: F.when(F.col(c) < threshold, F.lit(0.0)).otherwise(F.col(c)) for c in columns})


def row_sum(columns: Iterable[str]) -> Column:
    """Sum across columns of one row, skipping NULL."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def drop_infinite(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Drop rows holding +-Infinity in any of the columns; NULL and NaN are kept."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)}
    names = [c for c in (columns if columns is not None else df.columns) if c in floats]
    if not names:
        return df
    return df.filter(" AND ".join(f"(`{c}` IS NULL OR abs(`{c}`) <> CAST('Infinity' AS DOUBLE))" for c in names))


def complete_cases(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Keep rows without NULL or NaN in the columns."""
    return df.dropna(how="any", subset=[f"`{c}`" for c in (columns if columns is not None else df.columns)])


def finite_cases(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Listwise deletion before a fit: no NULL, NaN or Infinity in the columns."""
    names = list(dict.fromkeys(columns))
    return drop_infinite(complete_cases(df, names), names)
