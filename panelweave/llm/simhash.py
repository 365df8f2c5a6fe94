"""Near-duplicates by SimHash fingerprints, found with pivot distance tables.

Fingerprints that differ in at most ``max_bits`` bits agree on some of the blocks that the bits are cut
into, so one copy of each distinct fingerprint goes to each choice of blocks, and only fingerprints
with equal bits there meet. Inside such a group a table holds the Hamming distances of each fingerprint
to many reference fingerprints. By the triangle inequality two fingerprints differ in at least as many
bits as any of their table entries differ; pairs over the limit go, and survivors are verified. Groups
larger than a task may hold are dealt out again by further bits until they fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.common import batch_of, beside, id_and_text, map_arrow, struct_of, with_row
from panelweave.llm.components import connected, local_components
from panelweave.session import materialise

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Reference fingerprints: rows of random bits, half of the bits set on average.
PIVOTS = np.random.default_rng(7).integers(0, 2**64, 24, np.uint64, endpoint=False)
#: Fingerprints that a group may hold in a task; larger groups are dealt out by more bits.
GROUP = 4096


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's word shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed=SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-shingle]]).tolist()
        hashes = list(map(partial(xxhash.xxh64_intdigest, seed=SEED), [joined[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]))
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a long). Null and empty texts, and texts without words, have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >> 63 else mask


def _blocks(bits: list[int], n: int) -> list[int]:
    """The given bit positions cut into n blocks, as masks."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(bits, n)]


def _finer(mask: int, max_bits: int) -> list[int]:
    """Masks with one more block of the bits outside ``mask``; one of max_bits + 1 blocks must agree."""
    return [mask | m for m in _blocks([b for b in range(64) if not mask >> b & 1], max_bits + 1)]


def close_pairs(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints within ``max_bits``: pivot table, largest coordinate difference, then the bits."""
    order = np.argsort(np.bitwise_count(fps ^ PIVOTS[0]), kind="stable")
    fps = fps[order]
    tables = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    first, out = tables[:, 0], []
    for at in range(0, len(fps), 256):
        to = min(at + 256, len(fps))
        # In order of the first distance, partners lie in a band.
        last = int(np.searchsorted(first, first[to - 1] + max_bits, "right"))
        i, j = np.nonzero(np.arange(at, to)[:, None] < np.arange(at, last)[None, :])
        i, j = i + at, j + at
        for p in range(tables.shape[1]):
            near = np.abs(tables[i, p] - tables[j, p]) <= max_bits
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        out.append((order[i[near]], order[j[near]]))
    return np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])


def _links_within(keyed: DataFrame, max_bits: int, group: int) -> DataFrame:
    """Rows (a, b, mask): links that hold the close pairs of each group together, or, with null b, rows of groups too large."""
    dealt = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64())]

        def finished(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]), [True]]))
            rows, sizes = [], np.diff(cuts)
            pairs = cuts[:-1][sizes == 2]
            if len(pairs):
                a, b = fp[pairs].view(np.uint64), fp[pairs + 1].view(np.uint64)
                gap = np.abs(np.bitwise_count(a[:, None] ^ PIVOTS).astype(np.int16) - np.bitwise_count(b[:, None] ^ PIVOTS).astype(np.int16)).max(axis=1)
                near = (gap <= max_bits) & (np.bitwise_count(a ^ b) <= max_bits)
                rows += [(x, y, 0) for x, y in zip(fp[pairs][near].tolist(), fp[pairs + 1][near].tolist(), strict=True)]
            for start in np.flatnonzero(sizes > 2):
                own = fp[cuts[start] : cuts[start + 1]]
                label = local_components(len(own), *close_pairs(own.view(np.uint64), max_bits))
                moved = np.flatnonzero(label != np.arange(len(own)))
                rows += [(x, y, 0) for x, y in zip(own[moved].tolist(), own[label[moved]].tolist(), strict=True)]
            yield batch_of(rows, fields)

        held, large = None, None  # rows of the group that is still open; the key of a group found too large
        for b in batches:
            if not b.num_rows:
                continue
            now = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in ("mask", "key", "fp")])
            held = now if held is None else np.concatenate([held, now], axis=1)
            if large is not None:
                more = (held[0] == large[0]) & (held[1] == large[1])
                yield batch_of([(x, None, int(large[0])) for x in held[2][more].tolist()], fields)
                held = held[:, ~more]
                if not held.shape[1]:
                    continue
                large = None
            ends = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            done, held = held[:, :cut], held[:, cut:]
            if cut:
                sizes = np.diff(np.concatenate([[0], ends + 1]))
                big = np.repeat(sizes > group, sizes)
                yield batch_of([(x, None, m) for m, x in zip(done[0][big].tolist(), done[2][big].tolist(), strict=True)], fields)
                if not big.all():
                    yield from finished(*done[:, ~big])
            if held.shape[1] > group:
                large = held[:2, 0].copy()
                yield batch_of([(x, None, int(large[0])) for x in held[2].tolist()], fields)
                held = held[:, :0]
        if held is not None and held.shape[1]:
            yield from finished(*held)

    return map_arrow(dealt, run, "a long, b long, mask long")


def links(distinct: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) whose components are those of all close pairs."""
    if group < 2**12:
        raise ValueError("groups are dealt out until fewer than 13 bits are free, so they may hold 4096 fingerprints")
    masks = [sum(m) for m in combinations(_blocks(list(range(64)), 2 * max_bits), max_bits)]
    keys = F.explode(F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks)))
    keyed, found = distinct.select("fp", keys.alias("k")).select("fp", "k.mask", "k.key"), []
    while True:
        out = materialise(_links_within(keyed, max_bits, group))
        found.append(out.filter("b is not null").select("a", "b"))
        large = out.filter("b is null")
        masks = [r["mask"] % 2**64 for r in large.select("mask").distinct().collect()]
        if not masks:
            break
        table = F.create_map(*(F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for m in masks for x in (_signed(m), [_signed(f) for f in _finer(m, max_bits)])))
        finer = large.select(F.col("a").alias("fp"), F.explode(table[F.col("mask")]).alias("mask"))
        # Two masks may lead to one finer mask; a fingerprint is needed there once.
        keyed = finer.distinct().withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return whole


def _classes(rows: DataFrame, max_bits: int, group: int) -> DataFrame:
    """``fp`` and ``class``, the smallest fingerprint that it is linked with, for each fingerprint of ``rows``."""
    distinct = rows.select("fp").distinct()
    joined = connected(links(distinct, max_bits, group))
    return distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", F.coalesce("component", "fp").alias("class"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links between fingerprints that differ in at most
    ``max_bits`` bits. Null, empty and word-less texts have fingerprint zero, linked like any other. Equal
    fingerprints are one class, however many rows they have. Rows with a null id belong to their class
    but name no component. Repeated rows give repeated rows; other columns are not read.
    """
    rows = materialise(fingerprints(docs, shingle, id_col, text_col))
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    named = _classes(rows, max_bits, group).join(firsts, "fp")
    least = named.groupBy("class").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(least, "class").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id (null last), among equal ids the smallest text hash.

    All columns stay. Of rows equal in id and text, one stays.
    """
    # Plain keys without nulls, so that the join and the choice among repeated rows use one shuffle.
    last = F.lit(2**63 - 1)
    keys = [F.coalesce(F.col(id_col).cast("long"), last).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_text")]
    keyed = docs.select(struct_of(docs.columns).alias("_row"), *keys)
    read = docs.select(F.struct(*keys).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield beside(pa.RecordBatch.from_arrays([pa.array(found)], names=["fp"]), b)

    rows = materialise(map_arrow(read.select("text", "row"), run, with_row("fp long", read)).select("fp", "row.*"))
    firsts = rows.groupBy("fp").agg(F.min(F.struct("_id", "_text")).alias("first"))
    named = _classes(rows, max_bits, group).join(firsts, "fp")
    chosen = named.groupBy("class").agg(F.min("first").alias("first")).select("first.*")
    place = Window.partitionBy("_id", "_text").orderBy(F.lit(1))
    one = keyed.join(chosen, ["_id", "_text"]).withColumn("_n", F.row_number().over(place)).filter("_n = 1")
    return one.select("_row.*")
