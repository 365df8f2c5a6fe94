"""Collocations from exact phrase counts in counting quotient filters.

Words too rare to be part of a candidate split pieces like punctuation. The others get dense ids, and a
phrase is the ids of its words packed side by side. An invertible permutation mixes the packed bits; the
leading bits of the result are the quotient, the others the remainder, which is kept in full. A filter is the
sorted permuted phrases: per quotient the length of its run, then remainders and counters. Nothing is
lost, so shards merge filters by sorted order and read the phrases back by inverting the permutation.

Phrases of k words are counted where both phrases of k - 1 words inside them are frequent; a bitmap of fixed
size says where that may be so, and its false alarms only cost counting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.common import map_arrow
from panelweave.llm.vocabulary import word_counts
from panelweave.operators.joins import small_side
from panelweave.session import materialise

#: Longest phrase, least count, scale of the score, phrases a language returns.
MAX_WORDS, MIN_COUNT, SCALE, TOP = 5, 100, 1000, 2000
#: Language of rows without one.
NO_LANG = "und"
#: A dictionary within these rows and bytes is broadcast; a larger one is joined with the words of each document.
DICTIONARY_ROWS, DICTIONARY_BYTES = 1 << 20, 32 << 20
#: Ids in a block of encoded text, and phrases a task holds before it passes its filters on.
BLOCK_IDS, HELD = 1 << 20, 1 << 22
#: Bits of the bitmap of frequent phrases.
SEEN_BITS = 25
#: Phrase occurrences a shard gets on average.
SHARD = 1 << 22
SKIP = 2**32 - 1
_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


def tokens(text: str) -> list[bytes]:
    """Lower-cased words, a line feed for each end of a piece, and empty strings to skip."""
    return text.encode().lower().translate(_BREAKS).replace(b"\n", b" \n ").split(b" ")


# Packed phrases ------------------------------------------------------------------------------


@dataclass
class Packing:
    """Phrases of ``k`` word ids of ``bits`` bits each, two ids to a limb, and the permutation of their bits."""

    k: int
    bits: int

    @property
    def widths(self) -> list[int]:
        return [self.bits * min(2, self.k - 2 * j) for j in range((self.k + 1) // 2)]

    def pack(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Limbs of phrases whose i-th words are ``ids[i]``."""
        return [ids[j] << np.uint64(self.bits) | ids[j + 1] if j + 1 < self.k else ids[j] for j in range(0, self.k, 2)]

    def unpack(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        low = np.uint64((1 << self.bits) - 1)
        out = []
        for j, limb in enumerate(limbs):
            out += [limb >> np.uint64(self.bits), limb & low] if 2 * j + 1 < self.k else [limb]
        return out

    def permute(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        """Rounds that mix each limb within itself and, if there are several, with the next one; all invertible."""
        limbs = list(limbs)
        for turn in range(2):
            for j, w in enumerate(self.widths):
                if len(limbs) > 1:
                    limbs[j] = limbs[j] ^ (_mixed(limbs[(j + 1) % len(limbs)], turn) & _mask(w))
                limbs[j] = _stir(limbs[j], w)
        return limbs

    def restore(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        limbs = list(limbs)
        for turn in (1, 0):
            for j, w in reversed(list(enumerate(self.widths))):
                limbs[j] = _unstir(limbs[j], w)
                if len(limbs) > 1:
                    limbs[j] = limbs[j] ^ (_mixed(limbs[(j + 1) % len(limbs)], turn) & _mask(w))
        return limbs


_ODD = 0x9E3779B97F4A7C15


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def _mixed(x: np.ndarray, turn: int) -> np.ndarray:
    x = (x + np.uint64(turn + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) >> np.uint64(1)


def _stir(x: np.ndarray, width: int) -> np.ndarray:
    """Multiplication by an odd number modulo 2^width, then the upper half onto the lower one."""
    x = x * np.uint64(_ODD) & _mask(width)
    return x ^ x >> np.uint64((width + 1) // 2)


def _unstir(x: np.ndarray, width: int) -> np.ndarray:
    x = x ^ x >> np.uint64((width + 1) // 2)
    return x * np.uint64(pow(_ODD, -1, 1 << width)) & _mask(width)


# Filters -------------------------------------------------------------------------------------


@dataclass
class Counts:
    """Permuted phrases in ascending order, each once, with counts."""

    limbs: list[np.ndarray]
    count: np.ndarray

    @classmethod
    def of(cls, limbs: list[np.ndarray], count: np.ndarray | None = None) -> Counts:
        n = len(limbs[0])
        if not n:
            return cls(limbs, np.zeros(0, np.int64))
        order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
        limbs = [x[order] for x in limbs]
        new = np.zeros(n, bool)
        new[0] = True
        for x in limbs:
            new[1:] |= x[1:] != x[:-1]
        first = np.flatnonzero(new)
        total = np.diff(np.append(first, n)) if count is None else np.add.reduceat(count[order], first)
        return cls([x[first] for x in limbs], total.astype(np.int64))

    @classmethod
    def merged(cls, parts: list[Counts]) -> Counts:
        if len(parts) == 1:
            return parts[0]
        return cls.of([np.concatenate(x) for x in zip(*(p.limbs for p in parts), strict=True)], np.concatenate([p.count for p in parts]))

    def part(self, at: slice | np.ndarray) -> Counts:
        return Counts([x[at] for x in self.limbs], self.count[at])


def _bytes_of(x: np.ndarray, width: int) -> bytes:
    """The low bits of each number in as few whole bytes as they need."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (width + 7) // 8].tobytes()


def _from_bytes(data: memoryview, n: int, width: int) -> tuple[np.ndarray, memoryview]:
    size = (width + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data[: n * size], np.uint8).reshape(n, size)
    return out.view("<u8")[:, 0], data[n * size :]


def to_filter(part: Counts, widths: list[int], shard_bits: int) -> bytes:
    """A quotient filter of phrases that agree in their first ``shard_bits`` bits.

    Quotients are the bits after those, about as many values as phrases: the run length of each quotient, then the
    remainders (all other bits), then counters of one byte, the large ones at the end in full.
    """
    n = len(part.count)
    q = min(max(n.bit_length() - 1, 0), widths[0] - shard_bits)
    rest = widths[0] - shard_bits - q
    quotient = part.limbs[0] >> np.uint64(rest) & _mask(q)
    runs = np.bincount(quotient.astype(np.int64), minlength=1 << q)
    wide = int(runs.max(initial=0)) > 255
    large = part.count > 254
    return b"".join([
        np.array([n, q, wide], "<u4").tobytes(), runs.astype("<u4" if wide else np.uint8).tobytes(), _bytes_of(part.limbs[0] & _mask(rest), rest),
        *(_bytes_of(x, w) for x, w in zip(part.limbs[1:], widths[1:], strict=True)), np.where(large, 255, part.count).astype(np.uint8).tobytes(), part.count[large].astype("<i8").tobytes(),
    ])


def from_filter(data: bytes, widths: list[int], shard_bits: int, shard: int) -> Counts:
    view = memoryview(data)
    n, q, wide = np.frombuffer(view[:12], "<u4").tolist()
    size = (1 << q) * (4 if wide else 1)
    runs, view = np.frombuffer(view[12 : 12 + size], "<u4" if wide else np.uint8), view[12 + size :]
    rest = widths[0] - shard_bits - q
    low, view = _from_bytes(view, n, rest)
    quotient = np.repeat(np.arange(1 << q, dtype=np.uint64), runs)
    limbs = [np.uint64(shard << (widths[0] - shard_bits)) | quotient << np.uint64(rest) | low]
    for w in widths[1:]:
        x, view = _from_bytes(view, n, w)
        limbs.append(x)
    small, view = np.frombuffer(view[:n], np.uint8).astype(np.int64), view[n:]
    small[small == 255] = np.frombuffer(view, "<i8")
    return Counts(limbs, small)


def _slots(limbs: list[np.ndarray]) -> np.ndarray:
    """Place of a phrase in the bitmap."""
    x = limbs[0]
    for more in limbs[1:]:
        x = x * np.uint64(_ODD) ^ more
    return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SEEN_BITS)).astype(np.int64)


def _marked(seen: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return seen[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1) > 0


# Encoding ------------------------------------------------------------------------------------


def _langs_and_texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("grp")
    return docs.select(lang, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def language_words(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``grp`` (the language), ``word``, ``n`` over all texts."""

    def words_of(b: pa.RecordBatch):
        for lang, text in zip(b.column("grp").to_pylist(), b.column("text").to_pylist(), strict=True):
            yield lang, len(text), tokens(text)

    return word_counts(_langs_and_texts(docs, lang_col, text_col), words_of, skip=(b"", b"\n"))


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with dense ids from 1. Only the number of rows of each partition is read back."""
    held = materialise(words.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in held.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return held.withColumn("id", F.lit(0).cast("long")).drop("_at")
    starts = np.cumsum([0, *(sizes[p] for p in sorted(sizes))]).tolist()
    offset = F.create_map(*(F.lit(x) for p, s in zip(sorted(sizes), starts, strict=False) for x in (p, s)))
    return held.withColumn("id", (offset[part] + place + 1).cast("long")).drop("_at")


def _ids(found: list[bytes], table: dict[bytes, int]) -> np.ndarray:
    out = np.fromiter(map(table.get, found, repeat(0)), np.uint32, len(found))
    return out[out != SKIP]


class _Blocks:
    """Ids of texts one after the other, zeros between pieces; single words between two zeros are left out."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts += [ids, np.zeros(1, np.uint32)]
        self.size += len(ids) + 1
        if self.size >= BLOCK_IDS:
            yield self.out()

    def out(self) -> pa.RecordBatch:
        ids = np.concatenate([np.zeros(1, np.uint32), *self.parts, np.zeros(1, np.uint32)])
        word = ids > 0
        word[1:-1] &= word[2:] | word[:-2]
        ids = np.where(word, ids, 0)
        ids = ids[1:][(ids[1:] > 0) | (ids[:-1] > 0)]
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=["ids"])


def encoded(docs: DataFrame, words: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = DICTIONARY_ROWS) -> DataFrame:
    """``ids``: blocks of 32-bit word ids; words that ``words`` (``grp``, ``word``, ``id``) lacks count as zero."""
    read = _langs_and_texts(docs, lang_col, text_col)
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("bytes")).first()
    if size["n"] <= rows and (size["bytes"] or 0) <= DICTIONARY_BYTES:
        tables: dict[str, dict[bytes, int]] = {}
        for r in words.select("grp", "word", "id").toLocalIterator():
            tables.setdefault(r["grp"], {b"": SKIP})[r["word"].encode()] = r["id"]
        shared = docs.sparkSession.sparkContext.broadcast(tables)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks, nothing = _Blocks(), {b"": SKIP}
            for b in batches:
                for lang, text in zip(b.column("grp").to_pylist(), b.column("text").to_pylist(), strict=True):
                    yield from blocks.add(_ids(tokens(text), shared.value.get(lang, nothing)))
            yield blocks.out()

        return map_arrow(read, run, "ids binary")

    # Each document meets the ids of its own words.
    held = materialise(read.withColumn("key", F.monotonically_increasing_id()))

    def own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, lang, text in zip(b.column("key").to_pylist(), b.column("grp").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = pa.array(set(tokens(text)) - {b"", b"\n"}, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array([lang] * len(found), pa.string()), found], names=["key", "grp", "word"])

    known = map_arrow(held, own_words, "key long, grp string, word string").join(words.select("grp", "word", "id"), ["grp", "word"])
    lists = known.groupBy("key").agg(F.collect_list("word").alias("own"), F.collect_list("id").alias("own_ids"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks()
        for b in batches:
            for text, own, ids in zip(b.column("text").to_pylist(), b.column("own").to_pylist(), b.column("own_ids").to_pylist(), strict=True):
                yield from blocks.add(_ids(tokens(text), {b"": SKIP} | {w.encode(): i for w, i in zip(own, ids, strict=True)}))
        yield blocks.out()

    return map_arrow(held.join(lists, "key").select("text", "own", "own_ids"), look_up, "ids binary")


# Counting ------------------------------------------------------------------------------------


def _runs(ids: np.ndarray, k: int) -> np.ndarray:
    """Where phrases of ``k`` words begin."""
    if len(ids) < k:
        return np.zeros(0, np.int64)
    zeros = np.concatenate([[0], np.cumsum(ids == 0)])
    return np.flatnonzero(zeros[k:] == zeros[:-k])


def phrase_counts(blocks: DataFrame, k: int, bits: int, shard_bits: int, min_count: int, seen: np.ndarray | None) -> DataFrame:
    """``ids`` (array of ``k`` ids), ``n``, ``slot`` for phrases that occur at least ``min_count`` times."""
    packing, shorter = Packing(k, bits), Packing(k - 1, bits)
    widths = packing.widths
    shard_bits = min(shard_bits, widths[0])
    shared = None if seen is None else blocks.sparkSession.sparkContext.broadcast(seen)

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counts] = []

        def out() -> Iterator[pa.RecordBatch]:
            whole = Counts.merged(held)
            held.clear()
            shards = (whole.limbs[0] >> np.uint64(widths[0] - shard_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]])) if len(shards) else np.zeros(1, np.int64)
            made = [to_filter(whole.part(slice(a, b)), widths, shard_bits) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(shards[cuts[:-1]], pa.int32()), pa.array(made, pa.binary())], names=["shard", "filter"])

        for b in batches:
            for data in b.column("ids"):
                ids = np.frombuffer(data.as_buffer(), "<u4").astype(np.uint64)
                at = _runs(ids, k)
                if shared is not None and len(at):
                    inner = _runs(ids, k - 1)
                    ok = np.zeros(len(ids), bool)
                    ok[inner] = _marked(shared.value, _slots(shorter.permute(shorter.pack([ids[inner + j] for j in range(k - 1)]))))
                    at = at[ok[at] & ok[at + 1]]
                if len(at):
                    held.append(Counts.of(packing.permute(packing.pack([ids[at + j] for j in range(k)]))))
                if sum(len(c.count) for c in held) > HELD:
                    held[:] = [Counts.merged(held)]
                    if len(held[0].count) > HELD // 2:
                        yield from out()
        if held:
            yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counts] = []
        current = None

        def frequent() -> Iterator[pa.RecordBatch]:
            whole = Counts.merged(held)
            whole = whole.part(whole.count >= min_count)
            held.clear()
            ids = np.stack(packing.unpack(packing.restore(whole.limbs)), axis=1).astype(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, ids.size + 1, k, dtype=np.int32), pa.array(ids.ravel()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(whole.count), pa.array(_slots(whole.limbs))], names=["ids", "n", "slot"])

        for b in batches:
            for shard, data in zip(b.column("shard").to_pylist(), b.column("filter"), strict=True):
                if held and shard != current:
                    yield from frequent()
                current = shard
                held.append(from_filter(data.as_buffer(), widths, shard_bits, shard))
                if len(held) > 1 and sum(len(c.count) for c in held[1:]) > max(HELD // 4, len(held[0].count)):
                    held[:] = [Counts.merged(held)]
        if held:
            yield from frequent()

    made = map_arrow(blocks, filters, "shard int, filter binary")
    return map_arrow(made.repartition("shard").sortWithinPartitions("shard"), merge, "ids array<long>, n long, slot long")


def _bitmap(found: DataFrame) -> np.ndarray:
    """Which slots frequent phrases have: at most 2^19 words of 64 bits, whatever the number of phrases."""
    words = found.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(1 << (SEEN_BITS - 6), np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text", dictionary_rows: int = DICTIONARY_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of 2 to 5 words (``ids``, ``n``), frequent words (``grp``, ``word``, ``n``, ``id``), and words in all per language (``grp``, ``total``)."""
    counts = materialise(language_words(docs, lang_col, text_col))
    totals = materialise(counts.groupBy("grp").agg(F.sum("n").alias("total")))
    words = materialise(numbered(counts.filter(F.col("n") >= min_count)))
    n_words = words.count()
    size = totals.agg(F.sum("total")).first()[0] or 0
    bits, shard_bits = max(1, n_words.bit_length()), max(4, (size // SHARD).bit_length())
    if bits > 32:
        raise ValueError("ids of words have 32 bits")
    blocks = materialise(encoded(docs, words, lang_col, text_col, dictionary_rows))
    seen, levels = None, []
    for k in range(2, MAX_WORDS + 1):
        found = materialise(phrase_counts(blocks, k, bits, shard_bits, min_count, seen))
        levels.append(found.select("ids", "n"))
        if k < MAX_WORDS:
            seen = _bitmap(found)
    phrases = levels[0]
    for more in levels[1:]:
        phrases = phrases.unionByName(more)
    return phrases, words, totals


# Collocations --------------------------------------------------------------------------------


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, lang_col: str = "lang", text_col: str = "text", dictionary_rows: int = DICTIONARY_ROWS) -> DataFrame:
    """Per language its first ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase counts from ``min_count`` occurrences on. Its score is that of its worst cut in two, the count times the
    language's words over the product of the parts' counts, in thousandths, rounded down. Phrases that only occur inside
    one longer phrase are left out. A null language is ``und``, a null text empty; repeated rows count each; other columns are
    not read; an empty table has no rows.
    """
    phrases, words, totals = frequent_phrases(docs, min_count, lang_col, text_col, dictionary_rows)
    named = words.select("id", "grp", "word")
    counts = phrases.unionByName(words.select(F.array("id").alias("ids"), "n"))
    cut = phrases.select("ids", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.withColumns({"left": F.expr("slice(ids, 1, k)"), "right": F.expr("slice(ids, k + 1, size(ids) - k)")})
    cut = cut.join(counts.select(F.col("ids").alias("left"), F.col("n").alias("l")), "left")
    cut = cut.join(counts.select(F.col("ids").alias("right"), F.col("n").alias("r")), "right")
    first = cut.withColumn("id", F.col("ids")[0]).join(small_side(words.select("id", "grp")), "id").join(small_side(totals), "grp")
    parts = first.withColumns({"product": _exact("a") * _exact("total"), "over": _exact("l") * _exact("r")})
    scored = parts.withColumn("score", F.expr(f"CAST(({SCALE} * product) DIV over AS BIGINT)"))
    worst = scored.groupBy("grp", "ids", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    # Phrases inside longer ones, with the largest count of those.
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), w -> transform(sequence(1, size(ids) - w + 1), s -> slice(ids, s, w))))")
    longer = phrases.filter("size(ids) > 2").select(F.explode(inner).alias("ids"), "n").groupBy("ids").agg(F.max("n").alias("longest"))
    free = worst.join(longer, "ids", "left").filter("longest IS NULL OR longest < a").select("grp", "ids", "a", F.col("total").alias("n"), "worst.score", "worst.l", "worst.r")
    # The best of each of many parts, then the best of those.
    parted = free.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(64)))
    at = parted.select("grp", "part", "ids", "a", "n", "score", "l", "r", F.posexplode("ids").alias("at", "id")).join(small_side(named.select("id", "word")), "id")
    spelled = at.groupBy("grp", "part", "ids", "a", "n", "score", "l", "r").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelled = spelled.withColumn("phrase", F.expr("array_join(transform(words, w -> w.word), ' ')")).drop("words", "ids")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    best = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select(F.col("grp").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), split AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM split, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS k) WHERE len(w) >= k
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS MATERIALIZED (SELECT lang, k AS size, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND c >= {MIN_COUNT}
), cuts AS (SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS k FROM cand
), scored AS (
  SELECT u.lang, u.phrase, u.a, u.k, x.c AS l, y.c AS r, t.n, CAST({SCALE}::HUGEINT * u.a * t.n // (x.c::HUGEINT * y.c) AS BIGINT) AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.k], ' ')
    JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.k + 1:], ' ') JOIN totals t ON t.lang = u.lang
), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, a, unnest(flatten(list_transform(range(2, size), lambda k: list_transform(range(1, CAST(size - k + 2 AS BIGINT)), lambda i: array_to_string(w[i : i + k - 1], ' '))))) AS phrase FROM cand WHERE size > 2
  ) GROUP BY ALL
)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.phrase COLLATE "C") AS rank, o.phrase, a, l, r, n, score
FROM worst o LEFT JOIN longer g ON g.lang = o.lang AND g.phrase = o.phrase WHERE longest IS NULL OR 100 * longest < 100 * a
QUALIFY rank <= {TOP}
"""
