"""Exact token counts at every prefix of a text, by dynamic programming.

For each prefix of a pre-token there is one last token with which its encoding ends: the one that is
compatible with the last token of the prefix before it. So the count of a prefix is the count of that
shorter prefix plus one, and one pass gives the counts of all prefixes. Counts are kept as changes per
code point; a running sum over a text then answers budget and truncation questions without encoding
the text again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelweave.llm.bpe import SPACE, Bpe
from panelweave.llm.common import Bounded, batch_of, id_and_text, map_arrow
from panelweave.llm.segments import TokenValues, spaced_tokens

#: Contractions that a pre-token pattern takes whole; a cut inside one leaves the quote and the letter apart.
_CUT = ("'r", "'v", "'l")
#: Letters, digits and white space among the first 256 code points, and the pre-token pattern over them.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_PLAIN = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: A run of white space before a word. Cut at its end it is one pre-token, though its last character goes to the word.
_CUT_RUN = re.compile(f"[{SPACE}]{{2,}}")


class PrefixCounter:
    """Prefix counts under a byte-level BPE file whose pre-tokens keep their leading space."""

    def __init__(self, path: str):
        self.bpe = Bpe(path, "library")
        if self.bpe.drops_space or self.bpe.library.normalizer is not None or self.bpe.suffix:
            raise ValueError("prefix counts need a tokenizer that keeps every character of the text")
        self.vocab = self.bpe.vocab
        # Length of the longest token that ends with each symbol.
        self.longest: dict[str, int] = {}
        for token in self.vocab:
            self.longest[token[-1:]] = max(len(token), self.longest.get(token[-1:], 0))
        self.follows = Bounded(self._follows, 1_000_000)
        self.part = Bounded(self._part)
        self.chunk = Bounded(self._chunk)
        self.tokens = TokenValues(spaced_tokens, self._token, lambda t: list(map(self.chunk.__getitem__, self.bpe.chunks(t))), lower=False)

    def _follows(self, pair: int) -> bool:
        """Whether two tokens side by side are what the merges make of their string. Packed: id of the first plus one (none: 0), id of the second."""
        before, token = pair >> 32, self.bpe.name[pair & 0xFFFFFFFF]
        found = self.bpe.library.model.tokenize((self.bpe.name[before - 1] if before else "") + token)
        return len(found) == 1 + bool(before) and found[-1].value == token

    def _word(self, word: str) -> list[int]:
        """Counts at each byte prefix of a pre-token in byte symbols."""
        last, count, get, follows, longest = [0], [0], self.vocab.get, self.follows, self.longest
        for end, symbol in enumerate(word, 1):
            reach = longest.get(symbol, 0)
            for start in range(end - reach if end > reach else 0, end):
                token = get(word[start:end])
                if token is not None and follows[last[start] << 32 | token]:
                    last.append(token + 1)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError(f"no token ends {word[:end]!r}")
        return count

    def _part(self, text: str) -> list[int]:
        """Counts at each code point of a pre-token."""
        if text.isascii():
            counts = self._word("Ġ" + text[1:] if text[0] == " " and text[1:].isalnum() else text if text.isalnum() else self._symbols(text))[1:]
        else:
            by_byte, at, counts = self._word(self._symbols(text)), 0, []
            for c in text:
                at += len(c.encode())
                counts.append(by_byte[at])
        if text[:2] in _CUT and len(text) == 3:
            counts[1] = 2
        return counts

    def _symbols(self, text: str) -> str:
        symbols = self.bpe.symbols
        return "".join([symbols[b] for b in text.encode()])

    def _split(self, text: str) -> list[str]:
        if text.isascii() or max(text) <= "\xff":
            return _PLAIN.findall(text)
        return [text[a:b] for _, (a, b) in self.bpe.library.pre_tokenizer.pre_tokenize_str(text)]

    def _plain(self, text: str) -> list[int]:
        """Counts at prefixes 1 .. n of a chunk without special tokens."""
        out: list[int] = []
        for part in self._split(text):
            base = out[-1] if out else 0
            counts = self.part[part]
            out += [base + c for c in counts] if base else counts
        return out

    def _token(self, text: str) -> bytes:
        """Change of the count at each code point of a pre-token, as native 16-bit numbers."""
        counts = self._part(text)
        return array("h", map(sub, counts, [0, *counts])).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """The same for white space and what follows it up to the next white space, special tokens included."""
        if "<" not in chunk or not self.bpe.split_special:
            counts = self._plain(chunk)
        else:
            counts, base, at = [], 0, 0
            for m in self.bpe.split_special.finditer(chunk):
                # Until its last character the special string is ordinary text.
                part = self._plain(chunk[at : m.end() - 1])
                ended = self._plain(chunk[at : m.start()])[-1] if m.start() > at else 0
                counts += [base + c for c in part]
                base += ended + 1
                counts.append(base)
                at = m.end()
            if at < len(chunk):
                counts += [base + c for c in self._plain(chunk[at:])]
        return array("h", map(sub, counts, [0, *counts])).tobytes()

    def counts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text, the token counts of ``text[:1]``, ``text[:2]``, ... up to the whole text."""
        special = list(self.bpe.special)
        alone = lambda t: "<" in t and any(s in t for s in special)
        for text, changes in zip(texts, self.tokens.of(texts, alone), strict=True):
            counts = np.frombuffer(b"".join(changes), np.int16).cumsum(dtype=np.int64)
            for m in _CUT_RUN.finditer(text):
                if m.end() == len(text):
                    break
                counts[m.end() - 1] = (counts[m.start() - 1] if m.start() else 0) + self.part[m[0]][-1]
            yield counts


@lru_cache(maxsize=2)
def load(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``prefix_tokens``: entry k is the exact token count of the first k + 1 code points.

    An empty or null text has an empty array. Repeated rows give repeated rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for b in batches:
            counts = [c.astype(np.int32) for c in counter.counts(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, prefix_tokens array<int>")


def budget(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_chars``, read off the prefix counts.

    ``fit_chars`` is the longest prefix, in code points, that has at most ``limit`` tokens. A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for b in batches:
            rows = []
            texts = b.column("text").to_pylist()
            for i, text, counts in zip(b.column("doc_id").to_pylist(), texts, counter.counts(texts), strict=True):
                n = int(counts[-1]) if len(counts) else 0
                fit = len(text) if n <= limit else len(counts) - int(np.argmax(counts[::-1] <= limit)) if (counts <= limit).any() else 0
                rows.append((i, len(text.encode()), n, n > limit, fit))
            fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())]
            yield batch_of(rows, fields)

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
