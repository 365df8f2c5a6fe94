"""Panels: a frame with a unique (entity, time) key, and operators along time.

Two lags exist and are never mixed. A *row* lag is the previous observation of the entity, however
long ago. A *calendar* lag is the value exactly k periods earlier, or NULL. Both stay inside the
entity. The unique key bounds an entity's rows by the number of periods, which is what makes a
per-entity window safe; ``check`` verifies it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import missing
from . import aggregate

ROW, CALENDAR = "row", "calendar"


class Panel:
    """A frame and its panel key. Holds no data of its own."""

    def __init__(self, df: DataFrame, entity: str | Sequence[str], time: str = "year"):
        self.df = df
        self.entity = [entity] if isinstance(entity, str) else list(entity)
        self.time = time

    def on(self, df: DataFrame) -> "Panel":
        return Panel(df, self.entity, self.time)

    @property
    def window(self):
        return Window.partitionBy(*self.entity).orderBy(self.time)

    # key -------------------------------------------------------------------------------------

    def duplicates(self) -> DataFrame:
        """Keys occurring more than once, with their row counts."""
        counted = self.df.groupBy(*self.entity, self.time).agg(F.count(F.lit(1)).alias("n_rows"))
        return counted.filter("n_rows > 1")

    def check(self) -> "Panel":
        """Raise unless (entity, time) is unique."""
        if not self.duplicates().isEmpty():
            raise ValueError(f"({', '.join(self.entity)}, {self.time}) is not a unique key")
        return self

    def dimensions(self) -> DataFrame:
        return aggregate.panel_dimensions(self.df, self.entity, self.time)

    # columns ---------------------------------------------------------------------------------

    def row_lag(self, c: str | Column, k: int = 1) -> Column:
        return F.lag(missing.col(c), k).over(self.window)

    def calendar_lag(self, c: str | Column, k: int = 1) -> Column:
        if k == 0:
            return missing.col(c)
        return F.first(missing.col(c)).over(self.window.rangeBetween(-k, -k))

    def lag(self, c: str | Column, k: int = 1, mode: str = ROW) -> Column:
        if mode not in (ROW, CALENDAR):
            raise ValueError(f"unknown lag mode {mode!r}")
        return self.row_lag(c, k) if mode == ROW else self.calendar_lag(c, k)

    def diff(self, c: str | Column, mode: str = ROW) -> Column:
        return missing.col(c) - self.lag(c, 1, mode)

    def log_diff(self, c: str | Column, mode: str = ROW, infinite: bool = False) -> Column:
        log = missing.log_inf if infinite else missing.log
        return log(c) - log(self.lag(c, 1, mode))

    def growth(self, c: str | Column, mode: str = ROW) -> Column:
        prev = self.lag(c, 1, mode)
        return missing.ratio(missing.col(c) - prev, prev)

    def ratio_diff(self, num: str | Column, den: str | Column, mode: str = ROW, infinite: bool = False) -> Column:
        """Change of num / den."""
        ratio = missing.ratio_inf if infinite else missing.ratio
        return ratio(num, den) - ratio(self.lag(num, 1, mode), self.lag(den, 1, mode))

    # frames ----------------------------------------------------------------------------------

    def with_columns(self, columns: Mapping[str, Column]) -> "Panel":
        return self.on(self.df.withColumns(dict(columns)))

    def demean(self, columns: Sequence[str], suffix: str = "_w") -> DataFrame:
        """Columns less their entity mean."""
        out = aggregate.attach_group(self.df, self.entity, {f"__m_{c}": F.avg(c) for c in columns})
        out = out.withColumns({c + suffix: F.col(c) - F.col(f"__m_{c}") for c in columns})
        return out.drop(*[f"__m_{c}" for c in columns])

    def long_difference(
        self,
        start: int,
        end: int,
        levels: Mapping[str, str | Column] = {},
        logs: Mapping[str, str | Column] = {},
        growths: Mapping[str, str | Column] = {},
        infinite: bool = False,
    ) -> DataFrame:
        """Change between two chosen periods, one row per entity observed in ``end``.

        Conditional aggregates do it in one exchange, without sorting or lags. An entity without the
        start period has NULL changes. With ``infinite`` a growth from zero and the log of zero are
        infinite (0/0 and the logs of two zeros NaN), else NULL.
        """
        log, ratio = (missing.log_inf, missing.ratio_inf) if infinite else (missing.log, missing.ratio)
        t = F.col(self.time)
        at = lambda c, p: F.max(F.when(t == p, missing.col(c)))
        aggs = []
        for n, c in levels.items():
            aggs.append((at(c, end) - at(c, start)).alias(n))
        for n, c in logs.items():
            aggs.append((log(at(c, end)) - log(at(c, start))).alias(n))
        for n, c in growths.items():
            aggs.append(ratio(at(c, end) - at(c, start), at(c, start)).alias(n))
        present = F.max(F.when(t == end, F.lit(1))).alias("__end")
        return (
            self.df.filter(t.isin(start, end))
            .groupBy(*self.entity)
            .agg(*aggs, present)
            .filter("__end = 1")
            .drop("__end")
        )
