"""Long passages that occur more than once in a corpus, found with run-compressed Burrows-Wheeler indexes.

A passage of ``length`` bytes always holds an anchor: the k-gram whose hash is least among its k-grams,
which is the same wherever the passage stands. So only the surroundings of anchors that occur twice or
more can hold a repeat, and all copies of a passage meet at one anchor. Surroundings that are equal as a
whole are settled by their hash. The different ones of each anchor form one repetitive collection. Its
Burrows-Wheeler transform is built column by column over the aligned segments and kept as runs: inside
a run the match of two neighbours just grows by one symbol, and only at run ends, whose segments are
sampled, is it measured on the text. The statistics stream out with the columns, and matches of at least
``length`` are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import batch_of, beside, id_and_text, map_arrow, rows_of, with_row
from panelweave.session import materialise

LENGTH = 200
#: Bytes of an anchor. Longer anchors are rarer by chance but stand closer together.
ANCHOR = 48
#: Different segments of one anchor that a task may index; anchors with more take the hashes of single passages.
GROUP = 65536
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_TEXT_KEY = ["doc_id", "text_hash"]


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, and powers of an odd base and of its inverse."""
    out = [np.random.default_rng(11).integers(1, 2**63, 256, np.uint64)]
    for b in (_BASE, pow(_BASE, -1, 2**64)):
        factors = np.full(n, b, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    return tuple(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _prefix_hash(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    table, power, inverse = _powers(_BLOCK + 8 * 4096)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(table[codes] * power[: len(codes)], out=sums[1:])
    return sums, inverse


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum over each ``width`` neighbouring entries."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[:n], x[width - span : width - span + n])


def block_anchors(codes: np.ndarray, allowed: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions and hashes in a block, for the passages whose starts are ``allowed``; and the block's prefix hashes."""
    sums, inverse = _prefix_hash(codes)
    values = _mix((sums[k:] - sums[:-k]) * inverse[: len(codes) - k + 1])
    width = length - k + 1
    least = _sliding(values, width, np.minimum)
    least[~allowed[: len(least)]] = 0
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero((_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == values) & (values > 0))
    return at, values[at], sums, inverse


def anchors_of(texts: list[bytes], length: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, positions, anchor hashes, hashes of the surroundings) of texts that have a passage."""
    side = length - k
    group: list[int] = []
    size = 0

    def short(group: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        if not group:
            return
        lengths = np.array([len(texts[i]) for i in group])
        stops = np.cumsum(lengths)
        codes = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        ends = np.repeat(stops, lengths)
        at, fp, sums, inverse = block_anchors(codes, np.arange(len(codes)) + length <= ends, length, k)
        own = np.searchsorted(stops, at, "right")
        first, last = np.maximum(at - side, stops[own] - lengths[own]), np.minimum(at + length, stops[own])
        around = _surroundings(sums, inverse, at, first, last)
        cuts = np.searchsorted(own, np.arange(len(group) + 1))
        for n, i in enumerate(group):
            a, b = cuts[n], cuts[n + 1]
            if b > a:
                yield i, at[a:b] - (stops[n] - lengths[n]), fp[a:b], around[a:b]

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > _BLOCK:
            found: dict[int, tuple[int, int]] = {}
            whole = np.frombuffer(text, np.uint8)
            for start in range(0, len(text) - length + 1, _BLOCK):
                low, high = max(0, start - side), min(len(text), start + _BLOCK + 2 * length)
                codes = whole[low:high]
                starts = np.arange(low, high)
                at, fp, sums, inverse = block_anchors(codes, (starts >= start) & (starts < start + _BLOCK) & (starts + length <= len(text)), length, k)
                around = _surroundings(sums, inverse, at, np.maximum(at - side, 0), np.minimum(at + length, len(codes)))
                found.update(zip((at + low).tolist(), zip(fp.tolist(), around.tolist(), strict=True), strict=True))
            places = np.array(sorted(found))
            pairs = np.array([found[p] for p in places.tolist()], np.uint64)
            yield i, places, pairs[:, 0], pairs[:, 1]
            continue
        if size + len(text) > _BLOCK:
            yield from short(group)
            group, size = [], 0
        group.append(i)
        size += len(text)
    yield from short(group)


def _surroundings(sums: np.ndarray, inverse: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``first`` to ``last``, and of where the anchor stands among them."""
    content = (sums[last] - sums[first]) * inverse[first]
    return _mix(content + _mix((at - first).astype(np.uint64) * np.uint64(_BASE) + (last - at).astype(np.uint64)))


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """Rows with the hash of their text, so that rows of one id with different texts stay apart."""
    return id_and_text(docs, id_col, text_col, carry).withColumn("text_hash", F.xxhash64("text"))


def anchors(keyed: DataFrame, length: int, k: int) -> DataFrame:
    """One row per anchor: ``fp`` (its hash), ``around`` (hash of its surroundings), ``doc_id``, ``text_hash``, ``pos`` (byte)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() for t in b.column("text").to_pylist()]
            rows, places, fps, around = [], [], [], []
            for i, at, fp, sh in anchors_of(texts, length, k):
                rows.append(np.full(len(at), i))
                places.append(at)
                fps.append(fp)
                around.append(sh)
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(around).view(np.int64)), b.column("doc_id").take(take), b.column("text_hash").take(take), pa.array(np.concatenate(places).astype(np.int64))],
                    names=["fp", "around", "doc_id", "text_hash", "pos"],
                )

    return map_arrow(keyed, run, "fp long, around long, doc_id long, text_hash long, pos long")


def _same_text(a: DataFrame, b: DataFrame) -> tuple:
    """Null-safe join condition on the key of a text."""
    return (a["doc_id"].eqNullSafe(b["_doc_id"])) & (a["text_hash"] == b["_text_hash"])


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"})


def _packed(keyed: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            found = pa.array([press.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())
            yield beside(pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), found], names=["doc_id", "text_hash", "packed"]), b)

    return map_arrow(keyed, run, with_row("doc_id long, text_hash long, packed binary", keyed))


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


class RunColumns:
    """The run-compressed transform of a collection of aligned segments, column by column from the right.

    ``order`` ranks the segments by what follows the column, inside their collection; ``match`` is what each shares
    with the one ranked before it. ``runs`` counts the runs seen so far.
    """

    def __init__(self, segments: np.ndarray, collection: np.ndarray):
        self.segments, self.collection = segments, collection
        self.order = np.arange(len(segments))
        self.match = np.zeros(len(segments), np.int32)
        self.runs = 0

    def step(self, c: int) -> None:
        """Takes in column c, the symbols before those ranked so far."""
        symbols = self.segments[self.order, c]
        key = self.collection[self.order].astype(np.int64) << 9 | symbols
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        match = np.zeros(len(key), np.int32)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        inside = moved[same] == moved[same - 1] + 1
        # Two neighbours in a run stay neighbours and share one symbol more.
        match[same[inside]] = self.match[moved[same[inside]]] + 1
        ends = same[~inside]
        self.runs += len(key) - int(inside.sum())
        self.order = self.order[moved]
        match[ends] = self._measure(self.order[ends - 1], self.order[ends], c)
        self.match = match

    def _measure(self, a: np.ndarray, b: np.ndarray, c: int) -> np.ndarray:
        """Symbols that sampled segments share from column c on."""
        width = self.segments.shape[1]
        out, open_ = np.zeros(len(a), np.int32), np.arange(len(a))
        at, size = c, 8
        while len(open_) and at < width:
            to = min(at + size, width)
            differ = self.segments[a[open_], at:to] != self.segments[b[open_], at:to]
            any_ = differ.any(axis=1)
            out[open_] += np.where(any_, differ.argmax(axis=1), to - at).astype(np.int32)
            open_ = open_[~any_]
            at, size = to, size * 4
        return out


def repeated_starts(segments: np.ndarray, collection: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, starts: int) -> np.ndarray:
    """For each segment and each of the first ``starts`` columns, whether the passage from there stands in another segment of its collection.

    ``first`` and ``last`` bound the columns inside the document; others hold 256.
    """
    out = np.zeros((len(segments), starts), bool)
    index = RunColumns(segments, collection)
    for c in range(segments.shape[1] - 1, -1, -1):
        index.step(c)
        if c < starts:
            best = index.match.copy()
            best[:-1] = np.maximum(best[:-1], index.match[1:])
            row = index.order
            out[row, c] = (np.minimum(best, last[row] - c) >= length) & (first[row] <= c)
    return out


def _spans(mask: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and end columns covered by passages that start where ``mask`` holds."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, start, end - 1 + length


def _segments(wanted: DataFrame, keyed: DataFrame, length: int, k: int) -> DataFrame:
    """The bytes around each wanted anchor: ``fp``, ``doc_id``, ``text_hash``, ``pos``, ``n``, ``left`` (bytes before the anchor), ``segment``."""
    # An anchor list is as long as its document at most.
    lists = _renamed(wanted.groupBy(*_TEXT_KEY).agg(F.collect_list(F.struct("fp", "pos", "n")).alias("at")))
    texts = _packed(keyed)
    # Rows of one key have one text, and one of them is enough.
    joined = texts.join(lists, _same_text(texts, lists)).select(*_TEXT_KEY, "at", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("fp", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("left", pa.int32()), ("segment", pa.binary())]
        for b in batches:
            rows = []
            for doc, text_hash, at, packed in rows_of(b, "doc_id", "text_hash", "at", "packed"):
                text = _unpack(packed)
                for x in at:
                    start = max(0, x["pos"] - (length - k))
                    rows.append((x["fp"], doc, text_hash, x["pos"], x["n"], x["pos"] - start, text[start : x["pos"] + length]))
                    if len(rows) >= 8192:
                        yield batch_of(rows, fields)
                        rows = []
            yield batch_of(rows, fields)

    return map_arrow(joined, run, "fp long, doc_id long, text_hash long, pos long, n long, left int, segment binary")


def _index_groups(segments: DataFrame, length: int, k: int, group: int) -> DataFrame:
    """Spans (``doc_id``, ``text_hash``, ``start``, ``end``) found per anchor; rows of anchors with over ``group`` segments come back with ``fp`` set."""
    side, width = length - k, 2 * length - k
    dealt = segments.repartition("fp").sortWithinPartitions("fp")
    fields = [("fp", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("left", pa.int32()), ("segment", pa.binary())]

    def found(rows: list[tuple]) -> pa.RecordBatch:
        matrix = np.full((len(rows), width), 256, np.int16)
        for r, (_, _, _, _, _, left, segment) in enumerate(rows):
            matrix[r, side - left : side - left + len(segment)] = np.frombuffer(segment, np.uint8)
        left = np.array([r[5] for r in rows])
        last = side - left + np.array([len(r[6]) for r in rows])
        collection = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
        mask = repeated_starts(matrix, collection, side - left, last, length, side + 1)
        # Surroundings that occur twice as a whole are settled already.
        mask[np.array([r[4] for r in rows]) > 1] = False
        out = []
        for r, a, b in zip(*(x.tolist() for x in _spans(mask, length)), strict=True):
            _, doc, text_hash, pos, *_ = rows[r]
            out.append((None, doc, text_hash, pos - side + a, pos - side + b, None, None))
        return batch_of(out, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole anchors, then rows of the one still open
        open_at, large = 0, None

        def over(rows: list[tuple]) -> pa.RecordBatch:
            return batch_of([(fp, doc, text_hash, pos, None, left, segment) for fp, doc, text_hash, pos, _, left, segment in rows], fields)

        for b in batches:
            for row in rows_of(b, "fp", "doc_id", "text_hash", "pos", "n", "left", "segment"):
                if held and held[-1][0] != row[0]:
                    if len(held) >= 8192:
                        yield found(held)
                        held = []
                    open_at = len(held)
                if large == row[0]:
                    yield over([row])
                    continue
                large = None
                if not held:
                    open_at = 0
                held.append(row)
                if len(held) - open_at > group:
                    yield over(held[open_at:])
                    del held[open_at:]
                    large = row[0]
        if held:
            yield found(held)

    return map_arrow(dealt, run, "fp long, doc_id long, text_hash long, start long, end long, left int, segment binary")


def _by_passage(large: DataFrame, length: int, k: int) -> DataFrame:
    """Spans of anchors with too many segments for one task: the hash of every passage is counted instead.

    Passages meet only if the anchor stands at the same place in them, so none meets itself by way of another anchor.
    """
    side = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, (pos, left, segment) in enumerate(rows_of(b, "start", "left", "segment")):
                n = len(segment) - length + 1
                if n <= 0:
                    continue
                codes = np.frombuffer(segment, np.uint8)
                sums, inverse = _prefix_hash(codes)
                own = _mix((sums[length:] - sums[:-length]) * inverse[:n])
                take = pa.array(np.full(n, r))
                yield pa.RecordBatch.from_arrays([b.column("fp").take(take), b.column("doc_id").take(take), b.column("text_hash").take(take), pa.array(pos - left + np.arange(n)), pa.array(left - np.arange(n)), pa.array(own.view(np.int64))], names=["fp", "doc_id", "text_hash", "at", "offset", "passage"])

    passages = map_arrow(large, run, "fp long, doc_id long, text_hash long, at long, offset long, passage long")
    twice = passages.groupBy("fp", "offset", "passage").count().filter("count > 1").drop("count")
    return passages.join(twice, ["fp", "offset", "passage"]).select("doc_id", "text_hash", F.col("at").alias("start"), (F.col("at") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of bytes covered by passages that stand somewhere else too: ``doc_id``, ``text_hash``, ``start``, ``end``; they may overlap."""
    if not 0 < k < length <= 4096:
        raise ValueError("an anchor must be shorter than the passage, and the passage at most 4096 bytes")
    keyed = _keyed(docs, id_col, text_col)
    every = anchors(keyed, length, k)
    # Written out, so that the join has a shuffle of its own on both sides and a frequent anchor's rows can be split.
    often = materialise(every.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("fp"))
    repeated = materialise(every.join(often, "fp"))
    around = materialise(repeated.groupBy("fp", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_TEXT_KEY, "pos")).alias("first")))
    # Different surroundings of an anchor have to be compared, if one of them stands alone.
    mixed = around.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("fp")
    mixed = materialise(mixed)
    wanted = around.join(mixed, "fp").select("fp", "n", "first.*")
    indexed = materialise(_index_groups(_segments(wanted, keyed, length, k), length, k, group))
    spans = indexed.filter("fp is null").select(*_TEXT_KEY, "start", "end")
    large = indexed.filter("fp is not null")
    if not large.isEmpty():
        spans = spans.unionByName(_by_passage(large, length, k))
    # Clipped at the end of the text by whoever reads the spans.
    whole = repeated.join(around.filter("n > 1").select("fp", "around"), ["fp", "around"])
    whole = whole.select(*_TEXT_KEY, F.greatest(F.col("pos") - (length - k), F.lit(0)).alias("start"), (F.col("pos") + length).alias("end"))
    return spans.unionByName(whole)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, group: int = GROUP, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text",
                   carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; with ``with_text`` also ``kept``.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in any row, is removed; strings are
    judged on the input, and overlapping ones count. ``n_spans`` counts maximal removed runs. ``kept`` is the text left,
    without the pieces of characters that a cut leaves. Null texts are empty and lose nothing, like all texts shorter
    than ``length``. Repeated rows are copies of each other. Other columns are not read, but those named in ``carry``
    come back in a struct ``row``.
    """
    keyed = _keyed(docs, id_col, text_col, carry)
    # A document has at most a few spans for each anchor it holds.
    spans = repeated_spans(docs, length, k, group, id_col, text_col).groupBy(*_TEXT_KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    texts, spans = _packed(keyed), _renamed(spans)
    joined = texts.join(spans, _same_text(texts, spans), "left").drop(*spans.columns[:2], "text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        for b in batches:
            rows, kept = [], []
            for doc, packed, found in rows_of(b, "doc_id", "packed", "spans"):
                text = _unpack(packed)
                at, pieces, removed, n = 0, [], 0, 0
                end = -1
                for s in sorted((x["start"], min(x["end"], len(text))) for x in found or ()):
                    if s[0] > end:
                        pieces.append(text[at : s[0]])
                        n += 1
                        removed += s[1] - s[0]
                        at = end = s[1]
                    elif s[1] > end:
                        removed += s[1] - end
                        at = end = s[1]
                pieces.append(text[at:])
                left = b"".join(pieces)
                rows.append((doc, len(text), removed, n, hashlib.sha256(left).hexdigest()))
                kept.append(left.decode("utf-8", "ignore"))
            out = batch_of(rows, fields)
            if with_text:
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(kept, pa.string())], names=[*out.schema.names, "kept"])
            yield beside(out, b)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else "")
    return map_arrow(joined, run, with_row(schema, joined))
