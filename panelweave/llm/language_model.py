"""Scores of texts under a hidden Markov language model.

States emit symbols: each of the most frequent words is one, all other words share symbols by their last
letters. Within a symbol a word's share follows its count in the training texts, so a word's probability
in a state is the symbol's there times that share. Baum-Welch counts of all training texts are
added up across partitions, round by round; the scaled forward recursion then gives the exact probability
of each whole text. The shares do not depend on the states, so words beyond the tables of bounded size
meet their counts in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import id_and_text, map_arrow
from panelweave.llm.vocabulary import word_counts
from panelweave.session import materialise

#: Training rows have another remainder than 0, and what each count is raised by.
FOLDS, ADDED = 10, 0.1
#: Latent states, rounds of Baum-Welch, words with a symbol of their own, symbols of all other words by their last letters.
STATES, ROUNDS, OWN_SYMBOLS, SHARED_SYMBOLS, LAST_LETTERS = 8, 8, 16_384, 4096, 3
#: Words whose counts tasks hold (those of at most 64 bytes); all others meet theirs in a join.
TABLE, TABLE_BYTES = 1 << 17, 64
#: Training cuts texts into sequences of this many symbols; scores do not.
SEQUENCE = 256
#: Symbols that a task takes through a recursion at once, when training and when scoring.
TRAIN_BATCH, BATCH = 3 << 16, 1 << 20
#: Bytes of text that a task cuts into words at once.
PART = 4 << 20
END = 0


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == 0


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def shared_symbol(word: bytes, own: int) -> int:
    """Symbol of a word without one of its own, by its last letters."""
    return 1 + own + zlib.crc32(word.decode()[-LAST_LETTERS:].encode()) % SHARED_SYMBOLS


# The chain -----------------------------------------------------------------------------------


@dataclass
class Chain:
    """Probabilities of first states, of steps between states [from, to], and of symbols [symbol, state]."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def first_guess(frequency: np.ndarray, states: int = STATES, seed: int = 11) -> Chain:
    """States that mostly stay, with symbols near their overall frequencies, each state a little different."""
    rng = np.random.default_rng(seed)
    emit = frequency[:, None] * rng.gamma(4.0, 0.25, (len(frequency), states))
    step = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
    return Chain(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


def _by_position(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences from long to short, symbol by symbol: all first symbols, then all second ones, and so on.

    Returns the symbols, where each position begins, and the order taken.
    """
    sizes = np.array([len(s) for s in sequences])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")
    starts = np.concatenate([[0], np.cumsum(alive)])
    flat = np.empty(starts[-1], np.int64)
    place = np.concatenate([starts[: len(sequences[i])] + k for k, i in enumerate(order.tolist())])
    flat[place] = np.concatenate([sequences[i] for i in order.tolist()])
    return flat, starts, order


def log_likelihood(model: Chain, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log of the probability of each whole sequence: forward recursion, scaled to sum one at each step."""
    flat, starts, order = _by_position(sequences)
    table, step_back = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.step.T)
    out = np.zeros(len(sequences))
    state = np.repeat(model.start[:, None], len(sequences), axis=1)
    for symbols in np.split(flat, starts[1:-1]):
        n = len(symbols)
        state = state[:, :n] * np.take(table, symbols, axis=1)
        scale = state.sum(axis=0)
        out[:n] += np.log(scale)
        state /= scale
        state = step_back @ state
    back = np.empty(len(sequences))
    back[order] = out
    return back


def expected_counts(model: Chain, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected first states, steps and symbols, and the log probability of all sequences."""
    flat, starts, _ = _by_position(sequences)
    states = len(model.start)
    table, step_back = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.step.T)
    forward, emits, total, state = [], [], 0.0, None
    # One row per state: all sequences take a step at once.
    for symbols in np.split(flat, starts[1:-1]):
        emit = np.take(table, symbols, axis=1)
        state = emit * model.start[:, None] if state is None else (step_back @ state[:, : len(symbols)]) * emit
        scale = 1 / state.sum(axis=0)
        state *= scale
        emit *= scale
        total -= float(np.log(scale).sum())
        forward.append(state)
        emits.append(emit)
    # Backward values are scaled like the forward ones, so that products are posteriors.
    steps, after = np.zeros((states, states)), emits.pop()
    for own in forward[-2::-1]:
        emit, n = emits.pop(), after.shape[1]
        back, part = model.step @ after, own[:, :n]
        steps += part @ after.T
        part *= back
        emit[:, :n] *= back
        after = emit
    steps *= model.step
    posterior = np.concatenate(forward, axis=1)
    seen = np.stack([np.bincount(flat, posterior[s], len(model.emit)) for s in range(states)], axis=1)
    return forward[0].sum(axis=1), steps, seen, total


def improved(start: np.ndarray, step: np.ndarray, symbols: np.ndarray, frequency: np.ndarray) -> Chain:
    """The chain that counts suggest, each row raised a little so that nothing has probability zero."""
    states = len(start)
    emit = symbols + frequency[:, None] * states
    return Chain((start + 1) / (start + 1).sum(), (step + 1) / (step + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


# Corpus --------------------------------------------------------------------------------------


@dataclass
class Words:
    """What tasks know of the training counts: a table of frequent words, and totals.

    ``share[symbol]`` is the sum of raised counts in a symbol of several words, one unknown word among them.
    """

    table: dict[bytes, tuple[int, int]]  # word -> symbol, count
    texts: int
    tokens: int
    distinct: int
    frequency: np.ndarray
    share: np.ndarray

    @property
    def base_denominator(self) -> float:
        return float(np.log10(self.tokens + ADDED * (self.distinct + 1)))


def training_counts(docs: DataFrame) -> DataFrame:
    """``word``, ``n`` over the training rows of ``doc_id``, ``text``; the empty word stands for the end of a text."""

    def training(b: pa.RecordBatch):
        for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if not held_out(i):
                yield "", len(text), words_of(text)
                yield "", 0, {b"": 1}

    return word_counts(docs, training).select("word", "n")


def learn_words(counts: DataFrame, own: int = OWN_SYMBOLS, table: int = TABLE) -> Words:
    """Reads back at most ``table`` words of 64 bytes or less, and one sum per symbol."""
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == "", F.col("n"))).alias("texts")).first()
    short = counts.filter((F.col("word") != "") & (F.octet_length("word") <= TABLE_BYTES))
    top = short.orderBy(F.col("n").desc(), "word").limit(table).toArrow()
    words, ns = [w.encode() for w in top.column("word").to_pylist()], top.column("n").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-ns[i], words[i]))
    symbol = {words[i]: k + 1 for k, i in enumerate(order[:own])}
    size = 1 + own + SHARED_SYMBOLS
    mass, frequency = np.zeros(size), np.zeros(size)
    frequency[END] = totals["texts"] or 0
    for i in order[:own]:
        frequency[symbol[words[i]]] = ns[i]
    # Words without a symbol of their own, by their last letters; the frequent ones are taken off again.
    letters = F.crc32(F.encode(F.expr(f"right(word, {LAST_LETTERS})"), "UTF-8")) % SHARED_SYMBOLS
    for r in counts.filter("word != ''").groupBy(letters.alias("s")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[1 + own + r["s"]], frequency[1 + own + r["s"]] = r["n"] + ADDED * r["v"], r["n"]
    for i in order[:own]:
        s = shared_symbol(words[i], own)
        mass[s] -= ns[i] + ADDED
        frequency[s] -= ns[i]
    frequency = (frequency + ADDED) / (frequency + ADDED).sum()
    known = {w: (symbol.get(w) or shared_symbol(w, own), n) for w, n in zip(words, ns, strict=True)}
    return Words(known, int(totals["texts"] or 0), int(totals["n"] or 0), int(totals["v"]), frequency, np.maximum(mass, 0) + ADDED)


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``PART`` bytes of text each."""
    ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
        yield b.slice(at, to - at)
        at = to


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of ``flat``, up to each of ``ends``, as binary values."""
    offsets = np.concatenate([[0], ends * flat.itemsize])
    kind, place = (pa.binary(), np.int32) if offsets[-1] < 2**31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets.astype(place).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def encode(docs: DataFrame, words: Words, own: int = OWN_SYMBOLS) -> DataFrame:
    """Per row of ``key``, ``doc_id``, ``text``: its symbols, what the table says of its words, and its other words with counts."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kind = _kind(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        end = float(np.log10(words.texts + ADDED))
        # Only symbols of several words have shares.
        of_symbol = np.log10(words.share)
        of_symbol[: 1 + own] = 0
        number = {w: i for i, w in enumerate(words.table)}
        symbol_of, count_of = np.array([*words.table.values(), (0, 0)], np.int64).T
        log_of = np.log10(count_of + ADDED)
        for b in (part for whole in batches for part in _parts(whole)):
            found = [words_of(t) for t in b.column("text").to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = list(chain.from_iterable(found))
            ids = np.fromiter(map(number.get, flat, repeat(-1)), np.int64, len(flat))
            text, symbol, known, logs = np.repeat(np.arange(len(found)), sizes), symbol_of[ids], ids >= 0, log_of[ids]
            # Words the table lacks, numbered within the part.
            missing = np.flatnonzero(~known)
            others: dict[bytes, int] = {}
            other = np.fromiter((others.setdefault(flat[i], len(others)) for i in missing.tolist()), np.int64, len(missing))
            logs[missing] = 0
            symbol[missing] = np.fromiter((shared_symbol(w, own) for w in others), np.int64, len(others))[other]
            share = np.where(symbol > own, logs, 0.0) - of_symbol[symbol]
            per_text = lambda values: np.bincount(text, values, len(found))  # noqa: B023, E731
            symbols = np.insert(symbol, np.cumsum(sizes), END).astype(kind)
            # Once per text, with their counts there.
            pairs, times = np.unique(text[missing] * max(1, len(others)) + other, return_counts=True)
            of_text, word = np.divmod(pairs, max(1, len(others)))
            cuts = np.searchsorted(of_text, np.arange(len(found) + 1)).astype(np.int32)
            spelled = pa.array(list(others), pa.binary()).cast(pa.string()).take(pa.array(word))
            columns = [
                b.column("key"), b.column("doc_id"), _binary(symbols, np.cumsum(sizes + 1)), pa.array(sizes + 1), pa.array(per_text(known).astype(np.int64) + (words.texts > 0)),
                pa.array(per_text(logs) + end), pa.array(per_text(share)), pa.ListArray.from_arrays(cuts, spelled), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["key", "doc_id", "symbols", "n_tokens", "n_known", "table_log", "share_log", "others", "other_counts"]
    return map_arrow(docs, run, "key long, doc_id long, symbols binary, n_tokens long, n_known long, table_log double, share_log double, others array<string>, other_counts array<long>")


def _kind(own: int) -> str:
    return "<u2" if 1 + own + SHARED_SYMBOLS <= 1 << 16 else "<u4"


def _sequences(column: pa.Array, own: int) -> list[np.ndarray]:
    return [np.frombuffer(s.as_buffer(), _kind(own)).astype(np.int64) for s in column]


def _batched(sequences: Iterator[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for s in sequences:
        held.append(s)
        size += len(s)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def baum_welch(rows: DataFrame, model: Chain, frequency: np.ndarray, own: int = OWN_SYMBOLS) -> tuple[Chain, float]:
    """One round over the training rows (``doc_id``, ``symbols``): the next chain, and the log probability under this one.

    Each task adds up expected counts of its own rows; sums per symbol come back, one row per symbol.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    states, size = len(model.start), len(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        start, step, symbols, total = np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0

        def cut() -> Iterator[np.ndarray]:
            for b in batches:
                for i, s in zip(b.column("doc_id").to_pylist(), _sequences(b.column("symbols"), own), strict=True):
                    if not held_out(i):
                        yield from (s[a : a + SEQUENCE] for a in range(0, len(s), SEQUENCE))

        for part in _batched(cut(), TRAIN_BATCH):
            one, two, three, log = expected_counts(model, part)
            start, step, symbols, total = start + one, step + two, symbols + three, total + log
        # Rows: symbols, then first states, then steps by state left, then the log probability.
        at = np.flatnonzero(symbols.any(axis=1))
        values = np.vstack([symbols[at], start, step, np.full(states, total)])
        names = np.concatenate([at, size + np.arange(states + 2)])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array(values[:, s]) for s in range(states))], names=["at", *(f"s{s}" for s in range(states))])

    made = map_arrow(rows.select("doc_id", "symbols"), run, "at int, " + ", ".join(f"s{s} double" for s in range(states)))
    found = made.groupBy("at").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states))).toArrow()
    total = np.zeros((size + states + 2, states))
    total[found.column("at").to_numpy()] = np.stack([found.column(f"s{s}").to_numpy() for s in range(states)], axis=1)
    return improved(total[size], total[size + 1 : size + 1 + states], total[:size], frequency), float(total[size + 1 + states, 0])


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, own: int = OWN_SYMBOLS, table: int = TABLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Rows whose crc32(doc_id) mod 10 is not 0 train. Tokens are the words and one end per text. ``base_score`` is the unigram
    log10 probability with counts raised by 0.1, ``score`` the model's. A word without training count is the one unknown word
    of its symbol. A null id counts as an empty one, a null text is empty: one token, its end. Repeated rows train and are
    scored each; other columns are not read. Without training rows all words are unknown.
    """
    read = id_and_text(docs, id_col, text_col)
    counts = materialise(training_counts(read))
    words = learn_words(counts, own, table)
    rows = materialise(encode(read.withColumn("key", F.monotonically_increasing_id()), words, own))
    model = first_guess(words.frequency, states)
    for _ in range(rounds if words.tokens else 0):
        model, _ = baum_welch(rows, model, words.frequency, own)
    return _scored(rows, counts, words, model, own)


def _scored(rows: DataFrame, counts: DataFrame, words: Words, model: Chain, own: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs = [log_likelihood(shared.value, part) for part in _batched(iter(_sequences(b.column("symbols"), own)), BATCH)]
            keep = [b.column(c) for c in ("key", "doc_id", "n_tokens", "n_known", "table_log", "share_log")]
            out = pa.array([held_out(i) for i in b.column("doc_id").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*keep, out, pa.array(np.concatenate([*logs, np.zeros(0)]) / np.log(10))], names=["key", "doc_id", "n_tokens", "n_known", "table_log", "share_log", "held_out", "chain_log"])

    chained = map_arrow(rows.drop("others", "other_counts"), run, "key long, doc_id long, n_tokens long, n_known long, table_log double, share_log double, held_out boolean, chain_log double")
    other = rows.select("key", F.explode(F.arrays_zip("others", "other_counts")).alias("o")).select("key", F.col("o.others").alias("word"), F.col("o.other_counts").alias("times"))
    met = other.join(counts, "word", "left")
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED))
    per_text = met.groupBy("key").agg(F.sum(log).alias("other_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("other_known"))
    both = chained.join(per_text, "key", "left").withColumns({"other_log": F.coalesce("other_log", F.lit(0.0)), "other_known": F.coalesce("other_known", F.lit(0))})
    base = F.col("table_log") + F.col("other_log") - F.col("n_tokens") * F.lit(words.base_denominator)
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("other_known")).cast("long").alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("chain_log") + F.col("share_log") + F.col("other_log")).alias("score"),
    )
