"""Column selection and reshaping."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import missing


def starts_with(*prefixes: str) -> Callable[[str], bool]:
    return lambda c: c.startswith(prefixes)


def ends_with(*suffixes: str) -> Callable[[str], bool]:
    return lambda c: c.endswith(suffixes)


def contains(*parts: str) -> Callable[[str], bool]:
    return lambda c: any(p in c for p in parts)


def select_where(df: DataFrame, *tests: Callable[[str], bool], negate: bool = False) -> DataFrame:
    """Columns whose names pass any of the tests (none of them with ``negate``), in frame order."""
    return df.select(*[f"`{c}`" for c in df.columns if any(t(c) for t in tests) != negate])


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long; NULL cells are kept as rows."""
    return df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in columns], name, value)


def years_to_long(df: DataFrame, ids: Sequence[str], value: str, first: int = 0, last: int = 9999) -> DataFrame:
    """Year columns to (year INT, value DOUBLE) rows; non-numeric cells become NULL."""
    years = [c for c in df.columns if c.isdigit() and first <= int(c) <= last]
    text = df.select(*[f"`{c}`" for c in ids], *[F.col(f"`{c}`").cast("string").alias(c) for c in years])
    long = to_long(text, ids, years, "year", value)
    return long.select(*ids, F.col("year").cast("int").alias("year"), missing.to_number(value).alias(value))


def row_to_long(df: DataFrame, where: Column, name: str, value: str, prefix: str = "X", ids: Sequence[str] = ()) -> DataFrame:
    """Turn the one row selected by ``where`` into (name INT, value) rows, one per prefixed column."""
    picked = df.filter(where)
    columns = [c for c in picked.columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    long = to_long(
        picked.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]), ids, columns, name, value
    )
    return long.withColumn(name, F.regexp_replace(name, f"^{prefix}", "").cast("int"))


def pairwise_ratio(df: DataFrame, keys: Sequence[str], names: Iterable[str], num: str, den: str) -> DataFrame:
    """For each name n, column n = n+num / n+den (suffixes as left by a suffixed join)."""
    return df.select(*keys, *[missing.ratio(f"`{n}{num}`", f"`{n}{den}`").alias(n) for n in names])


def split_by_class(
    df: DataFrame, keys: Sequence[str], klass: str, classes: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Sums of ``columns`` per key, one column per (measure, class), named measure_class.

    The classes are given, so no extra pass looks them up.
    """
    aggs = [
        F.coalesce(F.sum(F.when(F.col(klass) == k, F.col(c))), F.lit(0)).alias(f"{c}_{k}")
        for c in columns
        for k in classes
    ]
    return df.groupBy(*keys).agg(*aggs)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename old -> new."""
    return df.withColumnsRenamed(dict(names))
