"""Joins.

Catalyst and adaptive execution broadcast a side only when its measured size is under the session
threshold, and split skewed partitions of a sort-merge join. The only hint is ``small_side``, which
counts rows and bytes first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def small_side(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20) -> DataFrame:
    """A join side computed once and, if its counted rows are few and small, marked for broadcast.

    Worth its extra job before a large table would otherwise be shuffled to meet a few group rows:
    adaptive execution finds out only after that shuffle has been written.
    """
    held = materialise(df)
    size = F.length(F.to_json(F.struct("*")))
    row = held.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    return F.broadcast(held) if row["n"] <= max_rows and (row["bytes"] or 0) <= max_bytes else held


def join_all(frames: Sequence[DataFrame], on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join several frames on the same composite key; the shared key keeps one partitioning throughout."""
    return reduce(lambda a, b: a.join(b, list(on), how), frames)


def join_renamed(left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str = "inner") -> DataFrame:
    """Join where key names differ (left name -> right name); the left names survive."""
    return left.join(right.withColumnsRenamed({r: l for l, r in on.items()}), list(on), how)


def enrich(left: DataFrame, right: DataFrame, on: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Left outer join: every left row stays, missing attributes are NULL."""
    if isinstance(on, Mapping):
        return join_renamed(left, right, on, "left")
    return left.join(right, list(on), "left")


def join_suffixed(
    left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str], how: str = "inner"
) -> DataFrame:
    """Join in which non-key columns present on both sides receive a suffix."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    l = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    r = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return l.join(r, list(on), how)


def to_members(members: DataFrame, zones: DataFrame, on: Sequence[str]) -> DataFrame:
    """Carry zone values down to every member row."""
    return members.join(zones, list(on), "inner")


def one_per_key(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key before a fan-out join, for values that are constant within the key."""
    return df.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def fan_out(geography: DataFrame, df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Join de-duplicated values to all geography rows of their zone."""
    common = [k for k in keys if k in geography.columns]
    return geography.join(one_per_key(df, keys, values), common, "inner")
