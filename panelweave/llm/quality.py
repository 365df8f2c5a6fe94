"""Quality rules, and a logistic regression over hashed word and character n-grams.

The regression is trained on labelled rows, calibrated on labelled rows it has not seen, and applied to
Arrow batches against a fixed threshold. Plain counts and rules stand beside it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import batch_of, beside, id_and_text, map_arrow, rows_of, with_row

#: Fixed values of the base rules.
SYMBOLS, WHITE = "#*$%&|<>", " \t\n\v\f\r"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Hash buckets of word n-grams and of character n-grams.
BUCKETS = 1 << 15
#: Labelled rows to train and calibrate on, at most: those with the smallest hashes of their ids.
MAX_LABELLED = 4096
#: Texts whose calibrated probability of good quality is below this are rejected.
THRESHOLD = 0.5


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words inside windows of 8 words that the text has at least twice, each word counted once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    # Equal hashes only propose; the words decide.
    proposed = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
    count = Counter(tuple(words[i : i + WINDOW]) for i in proposed)
    cover = np.zeros(len(words) + 1, np.int64)
    for i in proposed:
        if count[tuple(words[i : i + WINDOW])] > 1:
            cover[i] += 1
            cover[i + WINDOW] -= 1
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words, hashes),
    )


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def features(text: str, hashes: np.ndarray) -> np.ndarray:
    """Square roots of the shares of each bucket: word 1- and 2-grams, then character 1- and 3-grams (as UTF-8 bytes)."""
    mixed = (hashes * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    pairs = (hashes[:-1] * np.uint64(0x85EBCA6B) + hashes[1:] * np.uint64(0xC2B2AE35) + np.uint64(1)) & np.uint64(0xFFFFFFFF)
    codes = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    three = (codes[:-2] | codes[1:-1] << 8 | codes[2:] << 16) * np.uint32(0x9E3779B1)
    shift = 32 - BUCKETS.bit_length() + 1
    out = []
    for grams in (np.concatenate([mixed, pairs]) >> np.uint64(shift), np.concatenate([codes, three >> np.uint32(shift)])):
        counts = np.bincount(grams.astype(np.int64), minlength=BUCKETS)
        out.append(np.sqrt(counts / max(1, len(grams))))
    return np.concatenate(out)


@dataclass
class Model:
    """Weights of the n-gram regression, and the slope and shift of its calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights + self.bias) + self.shift, -40, 40))))


class Sparse:
    """Feature rows one after the other: how many entries each has, their buckets and values."""

    def __init__(self, rows: list[tuple[bytes, bytes]]):
        self.sizes = np.array([len(at) // 2 for at, _ in rows], np.int64)
        self.columns = np.frombuffer(b"".join(at for at, _ in rows), "<u2").astype(np.int64)
        self.values = np.frombuffer(b"".join(value for _, value in rows), "<f4").astype(np.float64)
        self.filled = np.flatnonzero(self.sizes)
        self.starts = (np.cumsum(self.sizes) - self.sizes)[self.filled]

    def times(self, weights: np.ndarray) -> np.ndarray:
        """A row's entries times their weights, summed."""
        out = np.zeros(len(self.sizes))
        if len(self.filled):
            out[self.filled] = np.add.reduceat(self.values * weights[self.columns], self.starts)
        return out

    def back(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Per bucket, the entries times their row's number, summed."""
        return np.bincount(self.columns, self.values * np.repeat(rows, self.sizes), width)


def fit_logistic(x: Sparse, y: np.ndarray, width: int, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps on the mean loss; a row's squares sum to 2 at most."""
    n, rate = len(y), 1 / (0.75 + penalty)
    weights, bias, ahead, ahead_bias = np.zeros(width), 0.0, np.zeros(width), 0.0
    for step in range(steps):
        error = (1 / (1 + np.exp(-np.clip(x.times(ahead) + ahead_bias, -40, 40))) - y) / n
        new = ahead - rate * (x.back(error, width) + penalty * ahead)
        new_bias = ahead_bias - rate * error.sum()
        push = step / (step + 3)
        ahead, ahead_bias = new + push * (new - weights), new_bias + push * (new_bias - bias)
        weights, bias = new, new_bias
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fits on at most ``max_labelled`` labelled rows; three in four train, the rest calibrate.

    None if the labelled rows hold one class only, or too few rows to calibrate. The rows are taken in order of a hash of their id.
    """
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("double").alias("_y")).filter("_id is not null and _y is not null").dropDuplicates(["_id"])
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, y, text in rows_of(b, "doc_id", "_y", "text"):
                x = features(text, word_hashes(text.encode().split()))
                at = np.flatnonzero(x)
                rows.append((i, y, at.astype("<u2").tobytes(), x[at].astype("<f4").tobytes()))
            yield batch_of(rows, [("doc_id", pa.int64()), ("y", pa.float64()), ("at", pa.binary()), ("value", pa.binary())])

    # At most max_labelled ids are broadcast, and as many rows come back.
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "text")
    found = map_arrow(texts, run, "doc_id long, y double, at binary, value binary").dropDuplicates(["doc_id"]).collect()
    found.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    y = np.array([r["y"] for r in found])
    held = np.arange(len(y)) % 4 == 3
    if len(y) < 8 or any(len(np.unique(y[part])) < 2 for part in (held, ~held)):
        return None
    parts = [Sparse([(r["at"], r["value"]) for r, h in zip(found, held, strict=True) if h == side]) for side in (False, True)]
    found.clear()
    weights, bias = fit_logistic(parts[0], y[~held], 2 * BUCKETS, 1e-5, 200)
    margin = parts[1].times(weights) + bias
    # Calibration: a logistic curve over the margin, with targets drawn in a little so that it stays finite.
    good, bad = (y[held] == 1).sum(), (y[held] != 1).sum()
    target = np.where(y[held] == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        a = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(a, [((target - p) * margin).sum(), (target - p).sum()])
        slope, shift = slope + np.clip(move[0], -2, 2), shift + np.clip(move[1], -2, 2)
    return Model(weights, bias, float(slope), float(shift))


def judge(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed``, ``quality`` (calibrated probability), ``kept``.

    ``kept`` is false where the base rules fail or ``quality`` is below ``threshold``. Without a model ``quality`` is null and
    the base rules decide. A null text is empty, has no words, and fails the base rules. Repeated rows give
    repeated rows; other columns are not read, but those named in ``carry`` come back in a struct ``row`` beside ``text``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        fields = [("doc_id", pa.int64()), *((c, pa.int64()) for c in counts), ("base_failed", pa.bool_()), ("quality", pa.float64()), ("kept", pa.bool_())]
        for b in batches:
            rows = []
            for i, text in rows_of(b, "doc_id", "text"):
                words = text.encode().split()
                hashes = word_hashes(words)
                base = base_counts(text, words, hashes)
                failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
                p = None if model is None else model.probability(features(text, hashes))
                rows.append((i, *base, failed, p, not failed and (p is None or p >= threshold)))
            yield beside(batch_of(rows, fields), b, "text")

    schema = "doc_id long, " + "".join(f"{c} long, " for c in counts) + "base_failed boolean, quality double, kept boolean"
    read = id_and_text(docs, id_col, text_col, carry)
    return map_arrow(read, run, with_row(schema, read, "text"))
