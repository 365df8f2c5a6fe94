"""Any function of a group's rows, for groups of any size.

The function is given as a state that rows can be added to and that can be merged. Tasks read their
rows as they lie, keep one state per group, and only states are shuffled: a group that holds most of the rows is
worked on by all tasks and never gathered. States of one group meet in two steps, first by parts of the tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import ship_package

#: States a task holds before it passes them on.
HELD = 10_000
#: Parts in which the states of a group are merged before they meet.
PARTS = 32

Arrays = Mapping[str, np.ndarray]


@dataclass(frozen=True)
class Grouped:
    """A function of a group: ``add`` takes columns of some of its rows, ``finish`` gives output rows.

    ``merge`` must not depend on order. States are pickled, so they should be small: their size is what
    a task holds per group.
    """

    start: Callable[[], Any]
    add: Callable[[Any, Arrays], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Iterable[tuple]]


def _codes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """A number per row, equal where all keys are; nulls are equal to each other."""
    codes = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        column = batch.column(k)
        own = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return codes


def apply_grouped(df: DataFrame, by: Sequence[str], columns: Sequence[str], function: Grouped, schema: str | T.StructType) -> DataFrame:
    """The keys of each group with the rows ``function`` finishes it with.

    ``columns`` reach ``add`` as NumPy arrays (numbers with NaN for null, others as objects); ``schema`` names the output
    beside the keys. A null key is a group of its own. Groups appear once they have a row; an empty frame has none.
    """
    by, columns = list(by), list(columns)
    ship_package(df.sparkSession)
    fields = df.select(*by).schema.fields
    out_type = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    state_type = T.StructType([*fields, T.StructField("state", T.BinaryType())])

    def rows_of(keys: list[pa.Scalar], states: list, template: pa.Schema) -> pa.RecordBatch:
        arrays = [pa.array([k[i].as_py() for k in keys], template.field(b).type) for i, b in enumerate(by)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([pickle.dumps(s) for s in states], pa.binary())], [*by, "state"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list, Any]] = {}
        template = None
        for b in batches:
            if not b.num_rows:
                continue
            template = b.schema
            codes = _codes(b, by)
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order], prepend=-1, append=-1))
            arrays = {c: b.column(c).to_numpy(zero_copy_only=False)[order] for c in columns}
            for at, to in zip(cuts.tolist(), cuts[1:].tolist()):
                key = [b.column(k)[int(order[at])] for k in by]
                name = tuple(k.as_py() for k in key)
                state = held[name][1] if name in held else function.start()
                held[name] = (key, function.add(state, {c: v[at:to] for c, v in arrays.items()}))
            if len(held) > HELD:
                yield rows_of([k for k, _ in held.values()], [s for _, s in held.values()], template)
                held = {}
        if held:
            yield rows_of([k for k, _ in held.values()], [s for _, s in held.values()], template)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Any, pa.Schema]]:
        """States of each group merged, from rows sorted by key."""
        last: tuple | None = None
        held: tuple[list, Any, pa.Schema] | None = None
        for b in batches:
            columns_ = [b.column(k) for k in by]
            for i, data in enumerate(b.column("state")):
                key = [c[i] for c in columns_]
                name = tuple(k.as_py() for k in key)
                state = pickle.loads(data.as_buffer())
                if held is not None and name == last:
                    held = (held[0], function.merge(held[1], state), b.schema)
                    continue
                if held is not None:
                    yield held
                last, held = name, (key, state, b.schema)
        if held is not None:
            yield held

    def halfway(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, state, template in merged(batches):
            yield rows_of([key], [state], template)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, state, template in merged(batches):
            rows = [tuple(r) for r in function.finish(state)]
            if not rows:
                continue
            keys = [pa.array([k.as_py()] * len(rows), template.field(b).type) for k, b in zip(key, by)]
            values = [pa.array([r[i] for r in rows]) for i in range(len(out_type.fields))]
            yield pa.RecordBatch.from_arrays([*keys, *values], [*by, *out_type.names])

    states = df.select(*by, *[c for c in columns if c not in by]).mapInArrow(partial, state_type)
    if not by:
        return states.repartition(PARTS).mapInArrow(halfway, state_type).coalesce(1).mapInArrow(_typed(final, out_type), out_type)
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("__part")
    parted = states.select("*", part).repartition(*by, "__part").sortWithinPartitions(*by).drop("__part")
    met = parted.mapInArrow(halfway, state_type).repartition(*by).sortWithinPartitions(*by)
    whole = T.StructType([*fields, *out_type.fields])
    return met.mapInArrow(_typed(final, whole), whole)


def _typed(run: Callable, schema: T.StructType) -> Callable:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, target)], schema=target)

    return typed
