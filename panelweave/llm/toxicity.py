"""Toxicity from a learned lexicon, matched with Levenshtein automata, and scored by context.

Words and stems that labelled rows single out form a trie. The trie is intersected with Levenshtein
automata (one edit for words and stems of five letters or more; swapped neighbours are one edit)
and the result is turned into a deterministic automaton state by state, as texts need it. Hits are then
weighed by what stands around them: quoted hits and hits with other hits nearby are counted apart, and
a small regression learns what each kind is worth.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import Bounded, batch_of, id_and_text, map_arrow, rows_of
from panelweave.llm.segments import TokenValues, space_words
from panelweave.session import materialise

#: Labelled rows to learn from, at most: those with the smallest hashes of their ids.
MAX_LABELLED = 8192
#: A term needs so many rows of label 1, and a share of label 1 that is above this by so many standard errors.
MIN_ROWS, MIN_SHARE, SURE = 5, 0.5, 2.5
#: Letters of a stem.
STEM = range(3, 13)
THRESHOLD = 0.7
#: Words on either side of a hit in which other hits count as nearby.
NEAR = 8
QUOTES = "\"“”«»„"
_EDGES = "".join(chr(c) for c in range(0x21, 0x100) if not chr(c).isalnum()) + "“”„‘’…–—"


def core(word: str) -> str:
    """A word in lower case without the signs at its ends."""
    return word.lower().strip(_EDGES)


def terms_of(word: str) -> list[str]:
    """The word itself, marked by a final $, and its stems."""
    return [word + "$", *(word[:n] for n in STEM if n <= len(word))]


def edits_allowed(term: str) -> int:
    """Edits that still count as the term: of the whole word, or of the letters of a stem, which any tail may follow."""
    return 1 if len(term.removesuffix("$")) >= 5 else 0


def share_at_least(one: int, zero: int) -> float:
    """Lower end of the Wilson interval for the share of label 1."""
    n, z2 = one + zero, SURE * SURE
    p = one / n
    return float((p + z2 / (2 * n) - SURE * np.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n))


def choose_terms(counts: dict[str, tuple[int, int]], base: float) -> dict[str, float]:
    """Weight (log odds against ``base``) of the terms that stand for label 1, given rows with label 1 and 0 per term.

    Of a stem and its continuations, the shortest that qualifies counts, made longer as long as one continuation
    has most of its rows and is no less sure. Below a stem too short for edits, the shortest that allows them counts as well.
    """
    children: dict[str, list[str]] = {}
    for t in counts:
        children.setdefault(t[:-1], []).append(t)
    chosen: dict[str, float] = {}
    for term in sorted(counts, key=lambda t: (len(t), t)):
        sure = share_at_least(*counts[term])
        covered = any(term[:n] in chosen and edits_allowed(term[:n]) >= edits_allowed(term) for n in range(1, len(term)))
        if counts[term][0] < MIN_ROWS or sure < MIN_SHARE or covered:
            continue
        while True:
            longer = [t for t in children.get(term, []) if counts[t][0] >= 0.75 * counts[term][0] and share_at_least(*counts[t]) >= sure]
            if not longer:
                break
            term = max(longer, key=lambda t: (counts[t][0], t))
            sure = share_at_least(*counts[term])
        chosen[term] = float(np.log(sure / (1 - sure)) - np.log(base / (1 - base)))
    return {t: w for t, w in chosen.items() if w > 0}


@dataclass
class Trie:
    """Terms as nodes: children, the term that ends in a node, the most edits allowed below it."""

    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[str | None] = field(default_factory=lambda: [None])
    most: list[int] = field(default_factory=lambda: [0])

    def add(self, term: str) -> None:
        edits, node = edits_allowed(term), 0
        self.most[0] = max(self.most[0], edits)
        for c in term.removesuffix("$"):
            if c not in self.children[node]:
                self.children[node][c] = len(self.ends)
                self.children.append({})
                self.ends.append(None)
                self.most.append(0)
            node = self.children[node][c]
            self.most[node] = max(self.most[node], edits)
        # A whole word and a stem with the same letters: the stem covers both.
        if self.ends[node] is None or self.ends[node].endswith("$"):
            self.ends[node] = term


class Automaton:
    """Finds the term that a word is, within the edits the term allows.

    A state is a set of (trie node, edits so far, letter still owed by a swap), known by a number; 0 is the empty set. States and
    their steps are made when a word first needs them, and all forgotten when there are too many.
    """

    def __init__(self, terms: list[str], limit: int = 100_000):
        self.trie, self.limit = Trie(), limit
        for t in terms:
            self.trie.add(t)
        self._forget()

    def _forget(self) -> None:
        self.steps: dict[int, int] = {}
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.stems: list[str | None] = []
        self.near: list[str | None] = []
        self._number(frozenset())
        self._number(self._closed({(0, 0, "")}))

    def _number(self, states: frozenset) -> int:
        n = self.numbers.get(states)
        if n is None:
            n = self.numbers[states] = len(self.states)
            self.states.append(states)
            ends = self.trie.ends
            stems = [(e, ends[i]) for i, e, owed in states if not owed and ends[i] and not ends[i].endswith("$") and e <= edits_allowed(ends[i])]
            self.stems.append(min((t for e, t in stems if not e), default=None))
            self.near.append(min((t for e, t in stems if e), default=None))
        return n

    def _closed(self, states: set[tuple[int, int, str]]) -> frozenset:
        """With the states reached by leaving out letters of a term; of equal nodes the fewest edits stay."""
        trie, todo, best = self.trie, list(states), {}
        while todo:
            node, edits, owed = todo.pop()
            if edits > trie.most[node] or best.get((node, owed), 9) <= edits:
                continue
            best[node, owed] = edits
            if not owed:
                todo += [(child, edits + 1, "") for child in trie.children[node].values()]
        return frozenset((node, edits, owed) for (node, owed), edits in best.items())

    def _step(self, states: frozenset, c: str) -> frozenset:
        trie, new = self.trie, set()
        for node, edits, owed in states:
            if owed:
                if c == owed:
                    new.add((node, edits, ""))
                continue
            new.add((node, edits + 1, ""))
            for letter, child in trie.children[node].items():
                if letter == c:
                    new.add((child, edits, ""))
                else:
                    new.add((child, edits + 1, ""))
                    if c in trie.children[child]:
                        new.add((trie.children[child][c], edits + 1, letter))
        return self._closed(new)

    def find(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest edits (then the first by name), and its edits; a stem wins as soon as the word has it.

        A misspelt stem is a beginning of the word within the stem's edits; it counts unless the rest of the word shows a better term.
        """
        if len(self.states) > self.limit:
            self._forget()
        now, steps, stems, near = 1, self.steps, self.stems, self.near
        found: set[tuple[int, str]] = set()
        for c in word:
            key = now << 21 | ord(c)
            now = steps.get(key, -1)
            if now < 0:
                now = steps[key] = self._number(self._step(self.states[key >> 21], c))
            if not now:
                break
            if stems[now]:
                return stems[now], 0
            if near[now]:
                found.add((1, near[now]))
        ends = self.trie.ends
        found |= {(e, ends[n]) for n, e, owed in self.states[now] if not owed and ends[n] is not None and e <= edits_allowed(ends[n])}
        return min(found)[::-1] if found else None


def quoted(text: str, places: list[tuple[int, int]]) -> list[bool]:
    """Whether each place lies between quotation marks of its line. All marks of the text are found once."""
    breaks, straight, opening, closing = ([m.start() for m in re.finditer(f"[{c}]", text)] for c in ("\n", '"', "“„«", "”»"))
    out = []
    for start, end in places:
        k = bisect_left(breaks, start)
        line, stop = breaks[k - 1] + 1 if k else 0, breaks[bisect_left(breaks, end)] if breaks and breaks[-1] >= end else len(text)

        def last(marks: list[int], line: int = line, start: int = start) -> int:
            i = bisect_left(marks, start)
            return marks[i - 1] if i and marks[i - 1] >= line else -1

        def follows(marks: list[int], end: int = end, stop: int = stop) -> bool:
            i = bisect_left(marks, end)
            return i < len(marks) and marks[i] < stop

        # An odd number of straight marks before, with one after; or an opening mark not closed yet.
        odd = (bisect_left(straight, start) - bisect_left(straight, line)) % 2 == 1
        out.append(odd and follows(straight) or last(opening) > last(closing) and follows(closing))
    return out


def hit_features(text: str, hits: list[tuple[int, str, int, str]], weights: dict) -> list[float]:
    """Sums of weights over hits (word number, term, edits, word): outside quotes, inside, with others nearby; then density.

    ``weights`` has terms, and under (term,) what a misspelling of the term weighs.
    """
    if not hits:
        return [0.0] * 4
    marked = [False] * len(hits)
    if any(q in text for q in QUOTES):
        places, wanted, n = [], {h[0] for h in hits}, 0
        at = 0
        for piece in text.encode().split():
            word = piece.decode()
            at = text.index(word, at)
            if n in wanted:
                inner = word.lower().lstrip(_EDGES)
                start = at + len(word) - len(inner)
                places.append((start, start + max(1, len(core(word)))))
            at += len(word)
            n += 1
        marked = quoted(text, places)
    outside = inside = near = 0.0
    number, seen = [h[0] for h in hits], set()
    for k, (i, term, edits, word) in enumerate(hits):
        w = weights[(term,) if edits else term]
        # A word counts once for each way it stands; junk that repeats a word is no more toxic for it.
        if (word, marked[k]) in seen:
            continue
        seen.add((word, marked[k]))
        if marked[k]:
            inside += w
            continue
        outside += w
        if k and i - number[k - 1] <= NEAR or k + 1 < len(hits) and number[k + 1] - i <= NEAR:
            near += w
    size = 1 + text.count(" ") + text.count("\n")
    return [float(np.log1p(x)) for x in (outside, inside, near, 100 * outside / size)]


@dataclass
class Model:
    """Weights of terms and, under (term,), of their misspellings; bias and coefficients of the features."""

    weights: dict
    coefficients: list[float]

    @property
    def terms(self) -> list[str]:
        return sorted(t for t in self.weights if isinstance(t, str))

    def score(self, features: list[float]) -> float:
        z = self.coefficients[0] + sum(a * b for a, b in zip(self.coefficients[1:], features, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps; coefficients of evidence do not go below zero."""
    x = np.column_stack([np.ones(len(x)), x])
    w, free = np.zeros(x.shape[1]), np.ones(x.shape[1], bool)
    ridge = np.array([1e-3, *[penalty] * (x.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w
        hessian = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        move = np.zeros_like(w)
        move[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        w = w + move
        low = (w < 0) & (np.arange(len(w)) > 0)
        w[low], free[low] = 0.0, False
        if np.abs(move).max() < 1e-8:
            break
    return w.tolist()


def finder(model_terms: list[str]) -> Callable[[list[str]], Iterator[list[tuple[int, str, int, str]]]]:
    """A function from texts to their hits."""
    automaton = Automaton(model_terms)

    def value(word: str):
        inner = core(word)
        found = automaton.find(inner) if inner else None
        return found and (*found, inner)

    words = Bounded(value)
    tokens = TokenValues(space_words, value, lambda t: [words[w.decode()] for w in t.encode().split()], lower=True)
    return lambda texts: ([(i, *v) for i, v in enumerate(values) if v is not None] for values in tokens.of(texts))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and coefficients from at most ``max_labelled`` labelled rows that are not held out.

    Terms are counted in the tasks; only those with enough rows of label 1 come to the driver. Without both labels the lexicon is empty and every score is
    the share of label 1 (0 without any rows). An id labelled more than once has its larger label; all documents of an id count.
    """
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("double").alias("_y")).filter("_id is not null and _y in (0, 1)")
    chosen = chosen.filter(~held_out("_id")).groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    # At most max_labelled ids are broadcast; their texts are found once for all passes below.
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y")
    rows = materialise(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("term", pa.string()), ("one", pa.int64()), ("zero", pa.int64())]
        found: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            # Terms no row of label 1 has can't be chosen, but others' rows of label 0 may sit in other tasks.
            return batch_of([(t, *n) for t, n in found.items()], fields)

        split = Bounded(lambda w: terms_of(core(w.decode())) if core(w.decode()) else [], 100_000)
        for b in batches:
            for text, y in rows_of(b, "text", "_y"):
                for t in {t for w in set(text.encode().split()) for t in split[w]}:
                    found.setdefault(t, [0, 0])[0 if y == 1 else 1] += 1
                if len(found) > 500_000:
                    yield out()
                    found = {}
        yield out()

    totals = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    one, zero = totals.get(1.0, 0), totals.get(0.0, 0)
    if not one or not zero:
        return Model({}, [40.0 if one else -40.0, *[0.0] * 4])
    summed = map_arrow(rows, count, "term string, one long, zero long").groupBy("term").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    kept = summed.filter((F.col("one") >= MIN_ROWS) & (F.col("one") >= 0.25 * (F.col("one") + F.col("zero")))).collect()
    weights = choose_terms({r["term"]: (r["one"], r["zero"]) for r in kept}, one / (one + zero))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(sorted(weights))
        for b in batches:
            found = [(t,) for hits in find(b.column("text").to_pylist()) for t in {t for _, t, edits, _ in hits if edits}]
            yield batch_of(found, [("term", pa.string())])

    # A misspelling weighs half of its term, less if rows of label 0 hold words that look like one.
    clean = map_arrow(rows.filter("_y = 0"), alike, "term string").groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = {r["term"]: r["n"] for r in clean}
    weights |= {(t,): w / (2 + 2 * seen.get(t, 0)) for t, w in weights.items()}
    terms = sorted(t for t in weights if isinstance(t, str))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(terms)
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [(y, hit_features(t, h, weights)) for y, t, h in zip(b.column("_y").to_pylist(), texts, find(texts), strict=True)]
            yield batch_of(found, [("y", pa.float64()), ("x", pa.list_(pa.float64()))])

    measured = map_arrow(rows, measure, "y double, x array<double>").collect()
    measured.sort(key=lambda r: (r["y"], r["x"]))
    return Model(weights, fit(np.array([r["x"] for r in measured]), np.array([r["y"] for r in measured])))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``score``, ``predicted`` (1 if score >= threshold), ``n_hits``.

    Only the text is read. A null or empty text has no hits and gets the score of such texts. Repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        find = finder(model.terms)
        for b in batches:
            texts, rows = b.column("text").to_pylist(), []
            for i, t, hits in zip(b.column("doc_id").to_pylist(), texts, find(texts), strict=True):
                s = model.score(hit_features(t, hits, model.weights))
                rows.append((i, s, int(s >= threshold), len(hits)))
            yield batch_of(rows, [("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_hits", pa.int64())])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, score double, predicted int, n_hits long")
