"""Values of repeated tokens, looked up per batch of texts instead of per token.

Texts within the first 256 code points are cut into tokens with NumPy, the tokens of a batch are
hashed and made unique, and only unique tokens meet the Python memo. A hash only proposes: each token is
compared with the one that stands for it, character by character. Other texts, and very long ones, take a
function that handles one text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

SPACE, LETTER, DIGIT, OTHER, BREAK = range(5)
#: Characters that one batch may hold.
BATCH = 1_000_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each of the first 256 code points, as Unicode general categories have them."""
    out = np.full(256, OTHER, np.uint8)
    for c in range(256):
        if chr(c).isalpha():
            out[c] = LETTER
        elif chr(c).isnumeric():
            out[c] = DIGIT
        elif c in (0x20, 0x85, 0xA0) or 9 <= c <= 13:
            out[c] = SPACE
    return out


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    return np.array([ord(x) if len(x := chr(c).lower()) == 1 and ord(x) < 256 else c for c in range(256)], np.uint8)


@lru_cache(maxsize=1)
def _hashing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random byte table, and the powers of an odd base and of its inverse."""
    table = np.random.default_rng(20240611).integers(1, 2**63, 256, np.uint64)
    base = 0x9E3779B97F4A7C15
    powers = []
    for b in (base, pow(base, -1, 2**64)):
        factors = np.full(BATCH + 2, b, np.uint64)
        factors[0] = 1
        powers.append(np.cumprod(factors, dtype=np.uint64))
    return table, *powers


def _same_characters(codes: np.ndarray, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether each token equals the other one of its size that begins at ``others``."""
    moved = np.flatnonzero(starts != others)
    first, shift, sizes = starts[moved].astype(np.int32), (others - starts)[moved].astype(np.int32), sizes[moved].astype(np.int32)
    at = np.repeat(first - (np.cumsum(sizes, dtype=np.int32) - sizes), sizes)
    at += np.arange(len(at), dtype=np.int32)
    own = codes[at]
    at += np.repeat(shift, sizes)
    return np.array_equal(own, codes[at])


def contractions(codes: np.ndarray, new: np.ndarray, at: np.ndarray) -> None:
    """Makes 's 't 'm 'd 're 've 'll at the given quotes one token each."""
    codes = np.concatenate([codes, [0, 0, 0]])
    a, b = codes[at + 1], codes[at + 2]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    for found, size in ((one, 2), (two, 3)):
        new[at[found] + 1] = False
        new[at[found] + size] = True


def word_tokens(codes: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of letter runs, single digits, contractions and runs of other characters."""
    new = np.concatenate([[True], cls[1:] != cls[:-1]]) | (cls == DIGIT)
    contractions(codes, new, np.flatnonzero(new & (codes == ord("'"))))
    return _spans(new, (cls != SPACE) & (cls != BREAK))


def space_words(codes: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs between ASCII white space."""
    gap = (codes == 0x20) | (codes >= 9) & (codes <= 13)
    return _spans(np.concatenate([[True], gap[1:] != gap[:-1]]), ~gap)


def spaced_tokens(codes: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters, digits or other characters with one space before them, contractions, and the white space left."""
    new = np.concatenate([[True], cls[1:] != cls[:-1]])
    quotes = np.flatnonzero(new & (codes == ord("'")))
    contractions(codes, new, quotes[codes[quotes - 1] != ord(" ")])
    after = 1 + np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & (cls[1:] != BREAK))
    new[after - 1] = True
    new[after[codes[after - 1] == ord(" ")]] = False
    return _spans(new, cls != BREAK)


def _spans(new: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.flatnonzero(new)
    ends = np.append(bounds[1:], len(new))
    keep = wanted[bounds]
    return bounds[keep], ends[keep]


class TokenValues:
    """``value(token)`` for every token of texts; ``one(text)`` gives the list for a text that can't be batched.

    Remembers two generations of up to ``limit`` tokens each: tokens seen since the last change of
    generation stay, the others go.
    """

    def __init__(self, cut: Callable, value: Callable[[str], object], one: Callable[[str], list], lower: bool, limit: int = 200_000):
        self.cut, self.value, self.one, self.lower, self.limit = cut, value, one, lower, limit
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def of(self, texts: list[str], alone: Callable[[str], bool] = lambda text: False) -> Iterator[list]:
        """A list of values for each text, in order. Texts for which ``alone`` holds go to ``one``."""
        waiting: list[bytes | None] = []
        single: list[str] = []
        size = 0
        for text in texts:
            code = None
            if len(text) < BATCH // 4 and not alone(text):
                try:
                    code = text.encode("latin-1")
                except UnicodeEncodeError:
                    pass
            if code is None:
                single.append(text)
            elif size + len(code) + 1 > BATCH - 2:
                yield from self._flush(waiting, single)
                waiting, single, size = [], [], 0
            waiting.append(code)
            size += 1 + len(code or b"")
        yield from self._flush(waiting, single)

    def _flush(self, waiting: list[bytes | None], single: list[str]) -> Iterator[list]:
        batched, alone = iter(self._batch([c for c in waiting if c is not None])), iter(single)
        for c in waiting:
            yield self.one(next(alone)) if c is None else next(batched)

    def _batch(self, texts: list[bytes]) -> list[list]:
        if not texts:
            return []
        codes = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        if self.lower:
            codes = lower_table()[codes]
        breaks = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cls = classes()[codes]
        cls[breaks] = BREAK
        starts, ends = self.cut(codes, cls)
        joined = codes.tobytes().decode("latin-1")
        table, powers, inverse = _hashing()
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(table[codes] * powers[: len(codes)], out=sums[1:])
        sizes = ends - starts
        keys = (sums[ends] - sums[starts]) * inverse[starts]
        unique, first, place = np.unique(keys, return_index=True, return_inverse=True)
        stands = first[place]
        if not (np.array_equal(sizes[stands], sizes) and _same_characters(codes, starts, starts[stands], sizes)):
            # Two tokens with one hash: each text goes alone.
            return [self.one(t.decode("latin-1")) for t in texts]
        values = np.empty(len(unique), object)
        for i, (a, b) in enumerate(zip(starts[first].tolist(), ends[first].tolist(), strict=True)):
            token = joined[a:b]
            if token in self.young:
                values[i] = self.young[token]
                continue
            values[i] = self.old[token] if token in self.old else self.value(token)
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[token] = values[i]
        ordered = values[place].tolist()
        cuts = np.searchsorted(starts, breaks).tolist()
        return [ordered[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
