"""Secrets in texts: three fixed patterns, and a token-efficiency test for random strings.

Words of a language cost few tokens per character under a byte pair vocabulary; random strings cost
many. A long run of key characters with few characters per token is reported as ``random``, unless it
is a known kind of harmless string: a digest, a UUID, a number, or a name made of words. Long parts of a
name count as words only if their letters follow each other as they do in the vocabulary's words.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate
from string import ascii_lowercase

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from panelweave.llm.common import batch_of, beside, id_and_text, map_arrow, rows_of, with_row

KINDS = ("assign", "access", "hex", "random")
#: The base patterns and the least lengths of what they must hold.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 16 or more; a shorter run can't be part of a longer one, so this equals dropping short runs.
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18

SEPARATORS = "+/_=.-"
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
PART = re.compile(r"[^+/_=.-]+")
DIGEST = re.compile(r"[0-9a-fA-F]+")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
#: Characters per token below which a run counts as random. English prose has about 4, base64 about 1.4.
MAX_RATIO = 2.0
MIN_PART = 20
#: A part that can be a word: each of its forms has one way to match, so the time is linear.
PLAIN = re.compile(r"[a-z]*|[A-Z]*|[0-9]+|[a-z]{2,}([A-Z][a-z]{2,}){0,5}|([A-Z][a-z]{2,}){1,6}|[A-Za-z][a-z]+[0-9]{1,4}")
#: With so many letters or more a part must have usual letter pairs: bits a pair, on average. Words have 0 to 2, random letters -3.
MIN_LETTERS, MIN_BITS = 12, -1.0


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secret-scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, in order of start, then kind."""
    found = []
    if any(c in text for c in ":="):
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@lru_cache(maxsize=2)
def letter_pairs(encoding: tiktoken.Encoding) -> dict[str, float]:
    """Bits by which a pair of letters is more frequent inside the vocabulary's words than if all pairs were equally so."""
    words = [w.lower().decode() for t in encoding.token_byte_values() if re.fullmatch(rb"[A-Za-z]{3,}", w := t.strip())]
    counts = Counter(a + b for w in words for a, b in zip(w, w[1:]))
    total, every = sum(counts.values()), [a + b for a in ascii_lowercase for b in ascii_lowercase]
    return {p: math.log2((counts[p] + 1) * len(every) / (total + len(every))) for p in every}


def reads_as_word(part: str, encoding: tiktoken.Encoding) -> bool:
    """A number, letters of one case, or CamelCase of up to six; with many letters only if their pairs are usual ones."""
    if not PLAIN.fullmatch(part):
        return False
    letters = part.rstrip("0123456789").lower()
    if len(letters) < MIN_LETTERS:
        return True
    bits = letter_pairs(encoding)
    return sum(bits[a + b] for a, b in zip(letters, letters[1:])) >= MIN_BITS * (len(letters) - 1)


def harmless(run: str, known: frozenset[str], encoding: tiktoken.Encoding) -> bool:
    """Digests of usual lengths, UUIDs, numbers, listed strings, and names whose parts are words or numbers."""
    if run.lower() in known or UUID.fullmatch(run):
        return True
    plain = re.sub(r"[+/_=.-]", "", run)
    if re.fullmatch(r"[0-9]*", plain) or re.fullmatch(r"[0-9a-fA-F]+", run) and len(run) in DIGEST_LENGTHS:
        return True
    # A secret mixes letters and digits, or lower and upper case, inside one part, or its letters follow each other at random; a name doesn't.
    return all(reads_as_word(p, encoding) for p in re.split(r"[+/_=.-]+", run))


def _word_places(text: str, start: int, end: int) -> bool:
    """Whether the place can read as a word or a number; the text is not copied for it."""
    return PLAIN.fullmatch(text, start, end) is not None


def base_cuts(text: str, start: int, end: int, base: list[tuple[int, int, int]], encoding: tiktoken.Encoding) -> list[tuple[int, int]]:
    """Base spans that end or start a part of the run; not those inside a longer random part, which is tested whole."""
    cuts = []
    for s, kind, e in base:
        if e <= start:
            continue
        a, b = s, e
        while kind and a > start and text[a - 1] not in SEPARATORS:
            a -= 1
        while kind and b < end and text[b] not in SEPARATORS:
            b += 1
        if _word_places(text, a, s) and _word_places(text, e, b) and harmless(f"{text[a:s]}.{text[e:b]}", frozenset(), encoding):
            cuts.append((s, e))
    return cuts


def is_dense(run: str, encoding: tiktoken.Encoding, ratio: float) -> bool:
    return len(run) < ratio * len(encoding.encode_ordinary(run))


def dense_parts(run: str, encoding: tiktoken.Encoding, ratio: float, known: frozenset[str]) -> list[tuple[int, int]]:
    """Places of neighbouring parts, of ``MIN_PART`` characters or more, that are dense though the run as a whole is not.

    From each part on, and up to each part, the fewest parts with enough characters are tested; those that share
    parts are one place. Listed strings, digests and UUIDs are in none; readable parts at the ends are left out.
    """
    spared = [m.span() for m in UUID.finditer(run) if not (run[m.start() - 1 : m.start()] + run[m.end() : m.end() + 1]).strip(SEPARATORS)]
    low = run.lower()
    spared += [(at, at + len(k)) for k in known if k in low for at in range(len(low)) if low.startswith(k, at)]
    spared.sort()
    starts, over = [s for s, _ in spared], list(accumulate((e for _, e in spared), max))
    groups: list[list[tuple[int, int]]] = [[]]
    for a, b in (m.span() for m in PART.finditer(run)):
        if bisect_right(over, a) < bisect_left(starts, b) or DIGEST.fullmatch(run, a, b) and b - a in DIGEST_LENGTHS:
            groups.append([])
        else:
            groups[-1].append((a, b))
    found = []
    for parts in groups:
        plain = [harmless(run[a:b], known, encoding) for a, b in parts]

        def dense(i: int, j: int, parts: list = parts, plain: list = plain) -> bool:
            a, b = parts[i][0], parts[j][1]
            return b - a >= MIN_PART and not all(plain[i : j + 1]) and is_dense(run[a:b], encoding, ratio)

        tried, i, j = set(), 0, 0
        for i in range(len(parts)):
            while j < len(parts) and parts[j][1] - parts[i][0] < MIN_PART:
                j += 1
            if j < len(parts):
                tried.add((i, j))
        i = 0
        for j in range(len(parts)):
            while i < j and parts[j][1] - parts[i + 1][0] >= MIN_PART:
                i += 1
            tried.add((i, j))
        def trimmed(i: int, j: int, plain: list = plain) -> tuple[int, int]:
            while plain[i] and dense(i + 1, j):
                i += 1
            while plain[j] and dense(i, j - 1):
                j -= 1
            return i, j

        places: list[tuple[int, int]] = []
        for i, j in sorted(trimmed(*t) for t in tried if dense(*t)):
            if places and i <= places[-1][1]:
                places[-1] = places[-1][0], max(j, places[-1][1])
            else:
                places.append((i, j))
        places = [trimmed(*t) if dense(*t) else t for t in places]
        found += [(parts[i][0], parts[j][1]) for i, j in places]
    return found


def random_spans(text: str, base: list[tuple[int, int, int]], encoding: tiktoken.Encoding, ratio: float, known: frozenset[str]) -> list[tuple[int, int, int]]:
    """Runs, without the base spans in them, whose characters per token are below ``ratio``, or else such parts of them."""
    found = []
    # Spans that may touch a run begin before it ends, and from the first on that is not over before it begins.
    starts, over = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for m in RUN.finditer(text):
        at = m.start()
        near = base[bisect_right(over, at) : bisect_left(starts, m.end())]
        for s, e in [*base_cuts(text, *m.span(), near, encoding), (m.end(), m.end())]:
            start, end, at = at, s, max(at, e)
            while start < end and text[start] in "=.-/+_":
                start += 1
            while start < end and text[end - 1] in ".-/":
                end -= 1
            run = text[start:end]
            if end - start < MIN_PART or harmless(run, known, encoding):
                continue
            if is_dense(run, encoding, ratio):
                found.append((start, 3, end))
            else:
                found += [(start + a, 3, start + b) for a, b in dense_parts(run, encoding, ratio, known)]
    return found


def _joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, path: str, pattern: str, ratio: float = MAX_RATIO, known: Iterable[str] = (), id_col: str = "doc_id", text_col: str = "text",
         mask: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_sha256``, ``spans``.

    ``spans`` lists kind:start:end in code points by start, then kind. ``path`` and ``pattern`` give a tiktoken
    vocabulary, ``known`` strings never to report as random. With ``mask`` there is a column ``masked``: the
    text with each span's characters (overlapping spans as one) replaced by that string. A null text is
    empty and has no spans. Repeated rows give repeated rows; other columns are not read, but those named in
    ``carry`` come back in a struct ``row``.
    """
    listed = frozenset(x.lower() for x in known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path, pattern)
        fields = [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex", "n_random")), ("base_sha256", pa.string()), ("spans", pa.string())]
        for b in batches:
            rows = []
            for i, text in rows_of(b, "doc_id", "text"):
                base = base_spans(text)
                spans = sorted(base + random_spans(text, base, encoding, ratio, listed))
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                row = (i, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans))
                rows.append(row if mask is None else (*row, masked(text, spans, mask)))
            yield beside(batch_of(rows, fields + ([] if mask is None else [("masked", pa.string())])), b)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    read = id_and_text(docs, id_col, text_col, carry)
    return map_arrow(read, run, with_row(schema + ("" if mask is None else ", masked string"), read))


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
