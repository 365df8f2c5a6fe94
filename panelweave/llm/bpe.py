"""BPE encoding with a priority queue of merge ranks, and decoding by joining vocabulary strings.

A tokenizer file in JSON form (byte pair merges, optional end-of-word suffix, special tokens) is read
by path. Texts are cut into chunks that no merge can cross, and chunks repeat a lot, so each worker
remembers the latest of them in a memo of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from panelweave.llm.common import Bounded, batch_of, id_and_text, map_arrow
from panelweave.llm.segments import TokenValues, word_tokens

#: Letters, digits and white space among the first 256 code points, lower case.
_LETTER, _DIGIT, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
#: Unicode white space, as the tokenizer files' patterns understand it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """One tokenizer file. ``merge="queue"`` runs the merges here, ``"library"`` leaves them to the library.

    Both give the library's ids; the library also names the pre-tokens of chunks outside the first 256
    code points.
    """

    def __init__(self, path: str, merge: str = "queue"):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.rank = {(self.vocab[a], self.vocab[b]): i for i, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.name = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_decoder = (data["decoder"] or {}).get("type") == "ByteLevel"
        self.drops_space = any(p.get("behavior") == "Removed" for p in (data["pre_tokenizer"] or {}).get("pretokenizers", []))
        lower = any(n["type"] == "Lowercase" for n in (data["normalizer"] or {}).get("normalizers", []))
        self.plain = None
        if self.drops_space and lower:
            self.plain = re.compile(rf"[{_LETTER}]+|[{_DIGIT}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_SPACE}{_LETTER}{_DIGIT}]+")
        self.symbols = byte_symbols()
        self.encode_word = self.merge if merge == "queue" else self._library_word
        self.word = Bounded(self.encode_word)
        self._run = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token, given in byte symbols.

        Symbols, as ids, form a doubly linked list. The queue holds rank and position in one number; an
        entry is stale, and skipped, once the pair at that position has another rank.
        """
        ids = [self.vocab[c] for c in word[:-1]]
        ids.append(self.vocab[word[-1] + self.suffix])
        n, rank, made = len(ids), self.rank, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [rank.get(pair, -1) for pair in zip(ids, ids[1:])]
        now.append(-1)
        queue = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            if now[i] != r:
                continue
            gone = after[i]
            ids[i], ids[gone], now[gone] = made[r], -1, -1
            j = after[i] = after[gone]
            if j < n:
                before[j] = i
                r = now[i] = rank.get((ids[i], ids[j]), -1)
                if r >= 0:
                    heapq.heappush(queue, r << 32 | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                r = now[h] = rank.get((ids[h], ids[i]), -1)
                if r >= 0:
                    heapq.heappush(queue, r << 32 | h)
        return tuple([i for i in ids if i >= 0])

    def _library_word(self, word: str) -> tuple[int, ...]:
        return tuple(t.id for t in self.library.model.tokenize(word))

    def words(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk without special tokens, in byte symbols."""
        if self.plain is not None and (chunk.isascii() or max(chunk) <= "\xff"):
            return [self.in_symbols(w) for w in self.plain.findall(chunk.lower())]
        if self.library.normalizer is not None:
            chunk = self.library.normalizer.normalize_str(chunk)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def in_symbols(self, word: str) -> str:
        return word if word.isascii() and word.isalnum() else "".join([self.symbols[b] for b in word.encode()])

    def ids(self, chunk: str) -> list[int]:
        """Ids of a chunk; special tokens inside it become their own ids."""
        out: list[int] = []
        for part in self.split_special.split(chunk) if "<" in chunk and self.split_special else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for w in self.words(part):
                    out.extend(self.word[w])
        return out

    def chunks(self, text: str) -> list:
        """Pieces that can be encoded apart: UTF-8 words where white space is dropped, else runs with the space before them."""
        return text.encode().split() if self.drops_space else self._run.findall(text)

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.ids(c.decode() if isinstance(c, bytes) else c)]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by spaces, or, where the file names a byte decoder, joined and read as bytes."""
        names = [self.name[i] for i in ids if i in self.name]
        if not self.byte_decoder:
            return " ".join(names)
        back = {c: b for b, c in self.symbols.items()}
        out = bytearray()
        for c in "".join(names):
            if c in back:
                out.append(back[c])
            else:
                out += c.encode()
        return out.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str, merge: str = "queue") -> Bpe:
    return Bpe(path, merge)


def token_values(bpe: Bpe, value: Callable[[list[int]], object]) -> Callable[[list[str]], Iterator[list]]:
    """A function from texts to lists of ``value(ids)`` of their tokens, in order, remembered for repeated tokens."""
    known = Bounded(lambda c: value(bpe.ids(c.decode() if isinstance(c, bytes) else c)))

    def one(text: str) -> list:
        return list(map(known.__getitem__, bpe.chunks(text)))

    if bpe.plain is None:
        return lambda texts: map(one, texts)
    tokens = TokenValues(word_tokens, lambda w: value(bpe.encode_word(bpe.in_symbols(w))), one, lower=True)
    special = list(bpe.special)
    return lambda texts: tokens.of(texts, lambda t: "<" in t and any(s in t for s in special))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` (array<int>), ``decoded`` (the text decoded from the ids).

    A null or empty text has no ids. Repeated rows give repeated rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        values = token_values(bpe, list)
        for b in batches:
            found = [[i for v in vs for i in v] for vs in values(b.column("text").to_pylist())]
            decoded = [bpe.decode(ids) for ids in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same work, but only counts and SHA-256 digests of the ids (decimal, one space) and the decoded text.

    Ids and strings of a chunk are put together once per chunk; a file with a byte decoder is decoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)

        def strings(ids) -> tuple[bytes, bytes]:
            return " ".join(map(str, ids)).encode(), " ".join([bpe.name[i] for i in ids]).encode()

        values = token_values(bpe, strings)
        for b in batches:
            rows = []
            for i, pairs in zip(b.column("doc_id").to_pylist(), values(b.column("text").to_pylist()), strict=True):
                ids = b" ".join([p[0] for p in pairs if p[0]])
                decoded = b" ".join([p[1] for p in pairs if p[0]])
                if bpe.byte_decoder:
                    decoded = bpe.decode([int(x) for x in ids.split()]).encode()
                n = ids.count(b" ") + 1 if ids else 0
                rows.append((i, n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield batch_of(rows, [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
