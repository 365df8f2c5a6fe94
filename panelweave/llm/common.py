"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from panelweave.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def struct_of(names: Sequence[str]) -> Column:
    """A struct of columns whose names may hold dots and backticks."""
    return F.struct(*(F.col(f"`{n.replace('`', '``')}`") for n in names))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Only the two columns an operator reads, as ``doc_id`` and ``text``; a null text counts as empty.

    Columns named in ``carry`` come along untouched in a struct ``row``, out of the way of other names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text, *([struct_of(carry).alias("row")] if carry else []))


def with_row(schema: str, read: DataFrame, *extra: str) -> StructType:
    """``schema`` with the struct ``row`` of ``read``, if it has one, and ``extra`` columns before it."""
    out = _parse_datatype_string(schema)
    if "row" in read.columns:
        for name in extra:
            out = out.add(name, read.schema[name].dataType)
        out = out.add("row", read.schema["row"].dataType)
    return out


def beside(batch: pa.RecordBatch, source: pa.RecordBatch, *extra: str) -> pa.RecordBatch:
    """``batch`` with the columns ``extra`` and ``row`` of the batch it was made from, if that has ``row``."""
    if "row" not in source.schema.names:
        return batch
    names = [*extra, "row"]
    return pa.RecordBatch.from_arrays([*batch.columns, *(source.column(n) for n in names)], names=[*batch.schema.names, *names])


def _hand_back() -> None:
    """Give freed memory back to the system. Python workers live on and run other operators' tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package shipped to the Python workers, which hand memory back after each task."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        _hand_back()

    return df.mapInArrow(run, schema)


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Python tuples of the named columns."""
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def batch_of(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from row tuples in the order of ``fields``."""
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


class Bounded(dict):
    """A memo of a function that forgets everything once it holds ``limit`` entries."""

    def __init__(self, fn: Callable, limit: int = 300_000):
        super().__init__()
        self.fn = fn
        self.limit = limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value
