"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

Words that differ by one edit share all but one stretch: the halves of the shorter word cut it so that
either its first or its second half is untouched. Each word goes to the groups of both halves, for its own length
and as a partner of words one shorter. Groups too large for a task are dealt out again by halves of
the stretch left open, until they must fit.

Inside a task the open stretches of many groups form one sorted list. The edit matrix of all words of
a group against the list is computed column by column; its band has two cells, as lengths differ by none or one.
Adjacent words reuse the rows of their longest common prefix: a prefix shared by a range of the list has one
row, and the range goes as soon as that row exceeds one edit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import id_and_text, map_arrow
from panelweave.llm.vocabulary import word_counts
from panelweave.operators.joins import small_side
from panelweave.session import materialise

#: Runs of letters, and the rule that drops one code point of some of them.
RUN = re.compile("[a-zÀ-ÿ]+")
DROP_EVERY = 97
MIN_LENGTH, MIN_COUNT, MIN_RATIO = 5, 3, 2
#: Words of a group that one task takes at once, and bytes of its open stretches; larger groups are dealt out again.
GROUP, GROUP_BYTES = 4096, 16 << 20
#: Rows of many groups that a task scans together, and their bytes.
SCAN_ROWS, SCAN_BYTES = 40_000, 32 << 20
#: Words compared with the list at once.
BLOCK = 4096


def runs(doc_id: int | None, text: str) -> Counter:
    """Runs of letters of a text in lower case with their counts; some lose one code point, by a hash of id and run."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
        if len(run) >= MIN_LENGTH:
            word = run.encode()
            h = zlib.crc32(word, seed)
            if h % DROP_EVERY == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < MIN_LENGTH:
                    continue
                word = run.encode()
            found[word] += n
    return found


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n``: words of at least 5 code points that occur at least ``min_count`` times in all texts together."""

    def words_of(b: pa.RecordBatch):
        for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            yield "", len(text), runs(i, text)

    return word_counts(id_and_text(docs, id_col, text_col), words_of).filter(F.col("n") >= min_count).select("word", "n")


def _keyed(words: DataFrame) -> DataFrame:
    """Four rows a word: its length as the shorter word's (m), and one less, each with the first and the second half shared.

    ``a`` and ``b`` are the code points shared at the start and at the end.
    """
    size = F.length("word")

    def keys(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        zero = F.lit(0)
        return [F.struct(m.alias("m"), half.alias("a"), zero.alias("b")), F.struct(m.alias("m"), zero.alias("a"), (m - half).alias("b"))]

    return words.select("word", "n", F.explode(F.array(*keys(size), *keys(size - 1))).alias("k")).select("word", "n", "k.*")


def _named(keyed: DataFrame) -> DataFrame:
    return keyed.withColumns({"head": F.expr("left(word, a)"), "tail": F.expr("right(word, b)")})


def _finer(keyed: DataFrame) -> DataFrame:
    """Rows of groups too large, dealt to the groups of both halves of the stretch that was open."""
    half = F.expr("(m - a - b) div 2").cast("int")
    children = F.array(F.struct("m", (F.col("a") + half).alias("a"), "b"), F.struct("m", "a", (F.col("m") - F.col("a") - half).alias("b")))
    return keyed.select("word", "n", F.explode(children).alias("k")).select("word", "n", "k.*")


def groups(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``word``, ``n``, ``m``, ``a``, ``b``, ``head``, ``tail``: every two words one edit apart meet in a group, and none has over ``group`` rows.

    A stretch of one code point or less leaves 57 + 57 x 57 letters at most, so ``group`` must be 3306 or more.
    """
    if group < 57 + 57 * 57:
        raise ValueError("groups are dealt out until one code point is open, so they may hold 3306 words")
    keyed, done = _named(_keyed(words)), []
    while True:
        open_size = F.col("m") - F.col("a") - F.col("b")
        size = F.count(F.lit(1))
        large = keyed.groupBy("m", "a", "b", "head", "tail").agg(size.alias("rows"))
        large = large.filter((open_size > 1) & ((F.col("rows") > group) | (F.col("rows") * open_size > GROUP_BYTES))).drop("rows")
        large = materialise(large)
        if large.isEmpty():
            done.append(keyed)
            break
        side, on = small_side(large), ["m", "a", "b", "head", "tail"]
        done.append(keyed.join(side, on, "left_anti"))
        keyed = _named(_finer(materialise(keyed.join(side, on, "left_semi"))))
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole


class SortedList:
    """Open stretches of the words of many groups, sorted by group and stretch.

    ``first`` and ``last`` bound each row's group. ``cut[p]`` is the longest common prefix of rows p - 1 and
    p, -1 between groups.
    """

    def __init__(self, stretches: list[bytes], group: np.ndarray, short: np.ndarray, tailed: np.ndarray):
        n = len(stretches)
        self.short, self.tailed = short, tailed  # length of the shorter word's stretch; whether the group shares an end
        self.sizes = np.fromiter(map(len, stretches), np.int64, n)
        width = int(self.sizes.max(initial=0))
        self.width, flat = width, np.frombuffer(b"".join(stretches), np.uint8)
        starts = np.cumsum(self.sizes) - self.sizes
        self.codes = np.zeros((n, width + 1), np.uint8)  # zero ends a stretch
        self.codes[np.repeat(np.arange(n), self.sizes), np.arange(len(flat)) - np.repeat(starts, self.sizes)] = flat
        self.cut = np.full(n + 1, -1, np.int64)
        if n > 1:
            differ = self.codes[1:] != self.codes[:-1]
            self.cut[1:n] = np.where(group[1:] != group[:-1], -1, np.where(differ.any(axis=1), differ.argmax(axis=1), width))
        edges = np.flatnonzero(self.cut < 0)
        at = np.searchsorted(edges, np.arange(n), "right")
        self.first, self.last = edges[at - 1], edges[np.minimum(at, len(edges) - 1)]

    def near(self, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (word, row) one edit apart, for words whose stretch has the shorter length.

        A pair that shares more than the group's end may also be in the group of its first half, so a group
        with a shared end leaves out pairs that agree on all of the shorter stretch's positions.
        """
        words = np.flatnonzero(self.sizes == self.short)
        for at in range(0, len(words), block):
            yield from self._scan(words[at : at + block])

    def _scan(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lo, hi = self.first[q], self.last[q]
        # Cells (i, i) and (i, i - 1) of the edit matrix for the first i code points of the list's words.
        x, y = np.zeros(len(q), np.int8), np.full(len(q), 2, np.int8)
        for i in range(self.width + 2):
            r = self.short[q]
            ended = (self.sizes[lo] == i) & (((i == r) & (x == 1)) | ((i == r + 1) & (y == 1)))
            if ended.any():
                yield q[ended], lo[ended]
            going = (i < r) | ((i == r) & ~((x == 0) & self.tailed[q]))
            q, lo, hi, x, y, r = (v[going] for v in (q, lo, hi, x, y, r))
            if not len(q):
                return
            # Ranges of the list that share i + 1 code points begin where adjacent words share i at most.
            bounds = np.flatnonzero(self.cut <= i)
            place = np.zeros(len(self.cut), np.int64)
            place[bounds] = np.arange(len(bounds))
            begin = place[lo]
            count = place[hi] - begin
            parent = np.repeat(np.arange(len(q)), count)
            child = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
            start = bounds[child]
            code = self.codes[start, i]
            x, y, own = x[parent], y[parent], q[parent]
            # Two stands for all larger values.
            y = np.minimum(np.minimum(y + (code != self.codes[own, i - 1]), x + 1) if i else x + 1, 2).astype(np.int8)
            x = np.where(i < r[parent], np.minimum(x + (code != self.codes[own, i]), 2), 2).astype(np.int8)
            keep = (code != 0) & ((x <= 1) | (y <= 1))
            q, lo, hi, x, y = own[keep], start[keep], bounds[child[keep] + 1], x[keep], y[keep]


def _partners(words: list[bytes], n: np.ndarray, rows: SortedList) -> pa.RecordBatch:
    """Per word with partners in its group: their number, the largest count among them, and the smallest such word."""
    pairs = [np.concatenate(side) for side in zip(*rows.near(), strict=True)] or [np.zeros(0, np.int64)] * 2
    q, v = pairs
    longer = rows.sizes[v] > rows.sizes[q]
    # Words of one length find each other twice; of two lengths the shorter one finds the longer.
    word, other = np.concatenate([q, v[longer]]), np.concatenate([v, q[longer]])
    rank = np.empty(len(words), np.int64)
    short = max(map(len, words), default=0) <= 256
    # Long words are not laid out side by side.
    rank[np.argsort(np.array(words, dtype=bytes), kind="stable") if words and short else sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], word))
    word, other = word[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(word)))
    named = lambda at: pa.array([words[i].decode("latin-1") for i in at.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([named(word[first]), pa.array(count), pa.array(n[other[first]]), named(other[first])], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``word``, ``n_near``, ``best_n``, ``best`` for the words of ``words`` (``word``, ``n``) that have a near word."""
    key = ["m", "a", "b", "head", "tail"]
    dealt = groups(words, group).withColumn("open", F.expr("substring(word, a + 1, length(word) - a - b)"))
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scan(part: pa.Table) -> pa.RecordBatch:
            m, a, b, n = (part.column(c).to_numpy() for c in ("m", "a", "b", "n"))
            codes = {c: [s.encode("latin-1") for s in part.column(c).to_pylist()] for c in ("word", "open")}
            return _partners(codes["word"], n, SortedList(codes["open"], part.column("group").to_numpy(), (m - a - b).astype(np.int64), b > 0))

        held: list[pa.RecordBatch] = []
        last, number, rows, width = None, 0, 0, 0
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in key), strict=True))
            new = np.fromiter((k != p for k, p in zip(keys, [last, *keys], strict=False)), np.int64, len(keys))
            numbers = number + np.cumsum(new)
            if len(keys):
                last, number = keys[-1], int(numbers[-1])
            sizes = pa.compute.binary_length(b.column("open")).to_numpy(zero_copy_only=False)
            b = b.append_column("group", pa.array(numbers))
            at = 0
            # A scan ends between two groups.
            for cut in np.flatnonzero(new).tolist():
                if rows + cut - at >= SCAN_ROWS or (rows + cut - at) * max(width, int(sizes[at:cut].max(initial=0))) >= SCAN_BYTES:
                    yield scan(pa.Table.from_batches([*held, b.slice(at, cut - at)]))
                    held, rows, width, at = [], 0, 0, cut
            held.append(b.slice(at))
            rows, width = rows + b.num_rows - at, max(width, int(sizes[at:].max(initial=0)))
        if rows:
            yield scan(pa.Table.from_batches(held))

    found = map_arrow(dealt, run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("least")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("least.less")).alias("best_n"), F.col("least.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: where the chain of ``form`` ends that starts at ``word``. Each round doubles the steps taken.

    A form is at least twice as frequent as its word, so chains are short and have no loops.
    """
    at = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialise(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of the texts: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the most frequent word one edit away (of equal ones the smallest) if at least twice as frequent,
    else null; ``root`` is where following forms ends, ``word`` itself without one; ``n_near`` counts the words one edit
    away. Null texts have no words, a null id counts as an empty one; repeated rows count each; other columns are not
    read. An empty table has no rows.
    """
    words = materialise(vocabulary(docs, MIN_COUNT, id_col, text_col))
    near = near_words(words, group)
    taken = F.col("best_n") >= MIN_RATIO * F.col("n")
    form = F.when(taken, F.col("best")).alias("form")
    found = materialise(words.join(near, "word", "left").select("word", form, "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best_n")).alias("form_n")))
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
