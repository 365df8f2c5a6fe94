"""Packing of token pieces into fixed windows with minimum bin slack.

The lengths of all pieces form a histogram with at most ``capacity`` entries, whatever the number of
pieces. The plan is made on that histogram alone: for the longest length left, a subset-sum dynamic
programme over a bitset finds the multiset of remaining lengths that fills the window closest to
capacity, and the pattern is used as often as the counts allow. Pieces are then numbered within their
length and looked up in the plan, so no task needs more than its own rows and the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.bpe import load, token_values
from panelweave.llm.common import batch_of, id_and_text, map_arrow
from panelweave.session import materialise

CAPACITY = 4096
END_ID = 2


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as token ids plus ``end_id``, cut into pieces of at most ``capacity`` ids.

    Columns: ``doc_id``, ``start`` (ids of the document before the piece), ``length``, ``ids_crc32`` (of the
    little-endian unsigned 32-bit ids), ``doc_tokens``; with ``with_ids`` also ``ids`` (those bytes). An empty or
    null text gives one piece that holds ``end_id``. Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, "library")
        values = token_values(bpe, lambda ids: np.asarray(ids, "<u4").tobytes())
        end, step = np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
        for b in batches:
            rows = []
            for i, words in zip(b.column("doc_id").to_pylist(), values(b.column("text").to_pylist()), strict=True):
                ids = b"".join(words) + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    rows.append((i, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, *([piece] if with_ids else [])))
            yield batch_of(rows, fields + ([("ids", pa.binary())] if with_ids else []))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return map_arrow(id_and_text(docs, id_col, text_col), run, schema)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths whose sum comes closest to ``room`` without passing it, longer lengths tried first.

    Bit s of the bitset says that sum s can be reached. Counts enter in powers of two; the way back
    through the saved bitsets gives how often each length is used.
    """
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left and not bits >> room:
            take = min(times, left)
            steps.append((length, take, bits))
            bits |= (bits << take * length) & mask
            left, times = left - take, times * 2
        if bits >> room:
            break
    target, used = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            target -= take * length
            used[length] = used.get(length, 0) + take
    return used


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, last rank + 1, per sequence, first sequence, offset), sorted by length and rank.

    Each use of a pattern empties a length or leaves fewer of it than the pattern takes, so the number of
    patterns depends on ``capacity`` and not on the number of pieces.
    """
    left, given, rows, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    for longest in sorted(histogram, reverse=True):
        while left.get(longest):
            left[longest] -= 1
            use = best_fill(left, capacity - longest)
            left[longest] += 1
            use[longest] = use.get(longest, 0) + 1
            times = min(left[x] // k for x, k in use.items())
            offset = 0
            for x in sorted(use, reverse=True):
                k = use[x]
                rows.append((x, given[x], given[x] + k * times, k, sequence, offset))
                given[x] += k * times
                left[x] -= k * times
                if not left[x]:
                    del left[x]
                offset += k * x
            sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` between 1 and ``capacity``.

    Pieces of a sequence lie one after the other from offset 0. Longer pieces, or lengths below one, stop
    the job. Null lengths have no place: both columns are null. Repeated rows are packed as often as they
    occur. No pieces give no rows. The driver holds the histogram and the plan, both bounded by ``capacity``.
    """
    order = [c for c in ("doc_id", "start") if c in pieces.columns]
    numbered = materialise(pieces.withColumn("_part", F.spark_partition_id()))
    per_part = numbered.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("_n").alias("n")).filter("length is not null").limit(capacity + 2).collect()}
    if any(not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    plan = make_plan(histogram, capacity)
    # Few rows: one for each partition and length.
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_part.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_part", "length").orderBy(*(order or [F.lit(1)]))
    ranked = numbered.withColumn("_in", F.row_number().over(inside) - 1).join(
        firsts.withColumnRenamed("length", "_length").withColumnRenamed("_part", "_p"),
        (F.col("_part") == F.col("_p")) & F.col("length").eqNullSafe(F.col("_length")),
    )
    ranked = ranked.withColumn("_rank", F.col("_first") + F.col("_in")).select(*pieces.columns, "_rank")
    span = int(max(histogram.values(), default=0)) + 1
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = plan[:, 0] * span + plan[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column("length")
            known = ~np.asarray(length.is_null())
            x, rank = length.fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64), b.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            if known.any():
                row = plan[np.maximum(np.searchsorted(keys, x * span + rank, "right") - 1, 0)]
                turn = rank - row[:, 1]
                sequence, offset = row[:, 4] + turn // row[:, 3], row[:, 5] + (turn % row[:, 3]) * x
            names = [n for n in b.schema.names if n != "_rank"]
            out = [b.column(n) for n in names] + [pa.array(sequence, mask=~known), pa.array(offset, mask=~known)]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return map_arrow(ranked, place, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """The finished windows: ``sequence_id``, ``n_tokens``, ``padded`` (window length) and ``ids`` (padded bytes).

    A window is padded to ``capacity`` unless it fills a power of two. A group holds one window at most.
    """
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = packed.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"),
        F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
    )
    full = F.when(F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0, F.col("n_tokens")).otherwise(F.lit(capacity))
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.col("padded") - F.col("n_tokens")).cast("int")))
    return joined.withColumn("padded", full).select("sequence_id", "n_tokens", "padded", F.concat("ids", pad).alias("ids"))
