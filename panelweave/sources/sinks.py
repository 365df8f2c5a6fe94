"""Writers for panels handed to other tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions import missing


def write_csv(df: DataFrame, path: str, complete: bool = True, mode: str = "overwrite") -> None:
    """CSV with header; by default only rows without missing values."""
    (missing.complete_cases(df) if complete else df).write.mode(mode).option("header", True).csv(path)


def write_panel(df: DataFrame, path: str, partition_by: Sequence[str] = ("year",), mode: str = "overwrite") -> None:
    """Parquet partitioned by period, so that year filters read only their own files."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_keyed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None, mode: str = "overwrite") -> DataFrame:
    """A table laid out by its key: joins and grouping on ``keys`` with tables of as many buckets need no shuffle.

    Rows are dealt out by the key first, so a bucket is one sorted file whatever the number of tasks.
    Returns the table. ``path`` puts its files elsewhere than the warehouse.
    """
    dealt = df.repartition(buckets, *keys)
    writer = dealt.write.mode(mode).format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)
