"""Grouped aggregates.

All of them combine map-side before the shuffle, so a group that holds a large part of the rows
reaches its reducer as a few partial rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import missing
from ..session import materialise
from .joins import small_side


def sum_list(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sum of each column per group, 0 for a group without values."""
    return df.groupBy(*by).agg(*[missing.sum0(c).alias(c) for c in columns])


def roll_up(df: DataFrame, by: Sequence[str], sums: Sequence[str] = (), means: Sequence[str] = ()) -> DataFrame:
    """Sums (0 when empty) and means (NULL when empty) per group, columns keeping their names."""
    aggs = [missing.sum0(c).alias(c) for c in sums] + [F.avg(c).alias(c) for c in means]
    return df.groupBy(*by).agg(*aggs)


def two_stage_roll_up(
    df: DataFrame,
    by: Sequence[str],
    recoded: Mapping[str, Column],
    sums: Sequence[str] = (),
    means: Sequence[str] = (),
) -> DataFrame:
    """Roll up, replace key columns by coarser ones, roll up again.

    The second stage averages first-stage means: a mean of means, not the pooled mean.
    """
    return roll_up(roll_up(df, by, sums, means).withColumns(dict(recoded)), by, sums, means)


def mean_rest(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of every column that is not a key."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in df.columns if c not in by])


def weighted_mean(df: DataFrame, by: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """Sum of value times within-group weight share; 0 where no weighted value exists."""
    w, v = F.col(weight).cast("double"), F.col(value).cast("double")
    return df.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(w * v), F.sum(w)), F.lit(0.0)).alias(name))


def _same(keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def attach_group(df: DataFrame, by: Sequence[str], stats: Mapping[str, Column], few: bool = False) -> DataFrame:
    """Group statistics on every row, as an aggregate joined back.

    Unlike a window this never brings a whole group to one task: the totals are one small row per
    group, broadcast when small and otherwise joined with skewed partitions split. ``few`` computes
    the totals at once and, if the count bears it out, spares ``df`` the shuffle.
    """
    totals = df.groupBy(*[F.col(k).alias(f"__{k}") for k in by]).agg(*[c.alias(n) for n, c in stats.items()])
    totals = small_side(totals) if few else totals
    return df.join(totals, _same(by, "__"), "left").drop(*[f"__{k}" for k in by])


def attach_group_window(df: DataFrame, by: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """As ``attach_group`` through a window: for panels whose groups are bounded by their unique key."""
    w = Window.partitionBy(*by)
    return df.withColumns({n: c.over(w) for n, c in stats.items()})


def share_of_total(df: DataFrame, by: Sequence[str], shares: Mapping[str, str], bounded: bool = False) -> DataFrame:
    """Column ``name`` = value / group total, for {name: value column}.

    ``bounded`` says that the unique key of the panel limits the rows per group.
    """
    attach = attach_group_window if bounded else attach_group
    out = attach(df, by, {f"__tot_{n}": F.sum(c) for n, c in shares.items()})
    out = out.withColumns({n: missing.ratio(c, f"__tot_{n}") for n, c in shares.items()})
    return out.drop(*[f"__tot_{n}" for n in shares])


def median_bounded(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact medians of panels whose groups are small (zones of one sector and year)."""
    return df.groupBy(*by).agg(*[F.median(c).alias(c) for c in columns])


def quantiles(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], probs: Sequence[float], accuracy: int = 100000
) -> DataFrame:
    """Exact interpolated quantiles for groups of any size, without gathering a group.

    One row per group; column ``c`` holds an array with one value per probability. A mergeable sketch
    with rank error n / accuracy brackets each wanted rank. Values below a bracket are only counted;
    the few inside are counted per distinct value and ranked exactly. Groups of fewer rows than
    ``accuracy`` need no bracket. What is ranked in one task is therefore at most 8 / accuracy of a
    group, or ``accuracy`` values. Should a bracket miss its rank, all are widened tenfold and the
    quantiles taken again; a bracket over the whole group cannot miss.
    """
    gap = 4.0 / accuracy
    while True:
        found, missed = _bracketed(df, by, columns, probs, accuracy, gap)
        if gap >= 1.0 or not missed.first()["missed"]:
            return found
        gap *= 10.0


def _bracketed(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], probs: Sequence[float], accuracy: int, gap: float
) -> tuple[DataFrame, DataFrame]:
    """Quantiles by brackets of width ``gap`` on each side, and one row that says whether a bracket missed."""
    items = [(c, j) for c in columns for j in range(len(probs))]
    clean = df.select(
        *by,
        *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns],
    )
    sketch = []
    for c in columns:
        ends = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-gap, gap)]
        sketch += [F.percentile_approx(c, ends, accuracy).alias(f"__q_{c}"), F.count(c).alias(f"__n_{c}")]
    brackets = clean.groupBy(*[F.col(k).alias(f"__{k}") for k in by]).agg(*sketch)
    if by:
        brackets = small_side(brackets)
    if by:
        placed = clean.join(brackets, _same(by, "__"), "inner")
    else:
        # One group: its brackets are a handful of numbers, used as literals.
        known = brackets.first().asDict()
        placed = clean.withColumns({k: F.lit(v) for k, v in known.items()})
    few = lambda c: F.col(f"__n_{c}") < accuracy
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                # Values under the bracket share one cell; values over it play no part.
                F.when(few(c) | (F.col(c) >= F.col(f"__q_{c}")[2 * j]), F.col(c)).alias("v"),
                F.col(f"__n_{c}").alias("n"),
                (F.col(c).isNotNull() & (few(c) | (F.col(c) <= F.col(f"__q_{c}")[2 * j + 1]))).alias("ok"),
            )
            for i, (c, j) in enumerate(items)
        ]
    )
    cell = placed.select(*by, F.explode(cells).alias("e")).filter("e.ok")
    counted = cell.groupBy(*by, F.col("e.i").alias("i"), F.col("e.v").alias("v")).agg(
        F.count(F.lit(1)).alias("k"), F.max("e.n").alias("n")
    )
    running = F.sum("k").over(Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first()))
    prob = F.array(*[F.lit(float(probs[j])) for _, j in items])[F.col("i")]
    ranked = counted.withColumn("upto", running).withColumn("h", (F.col("n") - 1) * prob + 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("k") < rank) & (rank <= F.col("upto")), F.col("v")))

    picked = ranked.groupBy(*by, "i").agg(
        at(F.floor("h")).alias("a"), at(F.ceil("h")).alias("b"), F.max(F.col("h") - F.floor("h")).alias("w")
    )
    picked = materialise(picked)  # a row per group, column and probability
    missed = picked.agg(F.coalesce(F.bool_or(F.col("a").isNull() | F.col("b").isNull()), F.lit(False)).alias("missed"))
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("w")
    at_item = lambda i: F.max(F.when(F.col("i") == i, value))
    wide = picked.groupBy(*by).agg(
        *[F.array(*[at_item(i) for i, (d, _) in enumerate(items) if d == c]).alias(c) for c in columns]
    )
    if not by:
        return wide, missed
    keyed = wide.withColumnsRenamed({k: f"__m_{k}" for k in by})
    groups = brackets.select(*[F.col(f"__{k}").alias(k) for k in by])
    return groups.join(keyed, _same(by, "__m_"), "left").select(*by, *columns), missed


def median(df: DataFrame, by: Sequence[str], columns: Sequence[str], accuracy: int = 100000) -> DataFrame:
    """Exact medians for groups of any size (see ``quantiles``)."""
    out = quantiles(df, by, columns, [0.5], accuracy)
    return out.select(*by, *[F.col(c)[0].alias(c) for c in columns])


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def panel_dimensions(df: DataFrame, entity: Sequence[str], time: str) -> DataFrame:
    """Entities, periods, observations, shortest and longest entity, and whether all are equal."""
    per_entity = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("t"))
    sizes = per_entity.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.sum("t").alias("n_obs"),
        F.min("t").alias("t_min"),
        F.max("t").alias("t_max"),
    )
    periods = df.select(time).distinct().agg(F.count(F.lit(1)).alias("n_periods"))
    # Two one-row results side by side: stacked, then reduced to the values that are present.
    both = sizes.unionByName(periods, allowMissingColumns=True)
    out = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return out.withColumn("balanced", (F.col("t_min") == F.col("t_max")) & (F.col("t_max") == F.col("n_periods")))
