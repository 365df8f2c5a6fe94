"""BPE, prefix counts and packing against the libraries and plain recounts."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelweave.llm import bpe, packing, token_counts
from panelweave.llm.queries import QUERIES

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", "  \n\n  hé́ ß µ İI ΑΣ Σ中文 ½²x٣ <|EndOfText|>", "a<|endoftext|>b  <|startoftext|> x", "  <|endoftext|>  <|endof", "\x85a\xa0b\x1cc d   e",
    "I'll don't ' 's 're'RE's's ''s !'s 'l 'v", " " * 300 + "x", "=" * 90, "a" * 400, "\n \t\x0b\x0c\r", "\x00\x01",
]
TEXTS = st.text(st.one_of(st.sampled_from(" \n'srevlt1²!#é中\xa0\x85 \x1c"), st.characters(codec="utf-8")), max_size=30)


@pytest.mark.parametrize("path", [WORDS, BYTES])
@pytest.mark.parametrize("merge", ["queue", "library"])
def test_encode_equals_library(path, merge):
    library, own = Tokenizer.from_file(path), bpe.Bpe(path, merge)
    values = bpe.token_values(own, list)

    @settings(max_examples=150, deadline=None)
    @given(TEXTS)
    def check(text):
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        assert [i for v in next(iter(values([text]))) for i in v] == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)

    check()
    for text in HARD:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    found = [[i for v in vs for i in v] for vs in values(HARD)]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in HARD]


def test_every_first_code_point(tmp_path):
    library, own = Tokenizer.from_file(WORDS), bpe.Bpe(WORDS)
    for c in range(256):
        for text in (chr(c), f"a{chr(c)}b", f"1{chr(c)}{chr(c)}2 '{chr(c)}"):
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_prefix_counts_equal_encoding_each_prefix():
    library, counter = Tokenizer.from_file(BYTES), token_counts.PrefixCounter(BYTES)

    def check(text):
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        assert next(iter(counter.counts([text]))).tolist() == want

    settings(max_examples=200, deadline=None)(given(TEXTS)(check))()
    for text in HARD:
        check(text)


def test_token_operators_with_nulls_and_repeats(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "y"), (None, "two words", None), (3, None, "z"), (4, "", "z"), (5, "word " * 9000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    library = Tokenizer.from_file(WORDS)
    got = sorted(bpe.encode(docs, WORDS).collect(), key=str)
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows), key=str)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(i), ids) for i, ids in want)
    digests = {(r["doc_id"], r["ids_sha256"]) for r in bpe.encode_digests(docs, WORDS).collect()}
    assert digests == {(i, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for i, ids in want}
    counted = sorted(token_counts.budget(docs, BYTES, 2).select("doc_id", "n_tokens", "over_limit", "fit_chars").collect(), key=str)
    other = Tokenizer.from_file(BYTES)
    for r in counted:
        text = next(t or "" for i, t, _ in rows if i == r["doc_id"])
        n = [len(other.encode(text[:k], add_special_tokens=False).ids) for k in (len(text), r["fit_chars"], r["fit_chars"] + 1)]
        assert r["n_tokens"] == n[0] and r["over_limit"] == (n[0] > 2) and n[1] <= 2 and (n[2] > 2 or r["fit_chars"] == len(text))
    prefixes = {str(r["doc_id"]): r["prefix_tokens"] for r in token_counts.prefix_counts(docs, BYTES).collect()}
    assert prefixes["3"] == [] and prefixes["1"][-1] == 2
    empty = docs.filter("false")
    assert bpe.encode(empty, WORDS).count() == token_counts.budget(empty, BYTES, 1).count() == packing.pack(packing.token_pieces(empty, WORDS)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_best_fill_is_the_best_subset(seed):
    rng = random.Random(seed)
    for _ in range(60):
        counts = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(rng.randrange(6))}
        room = rng.randrange(40)
        used = packing.best_fill(counts, room)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[x] for x, n in used.items())


def test_packing_places_every_id_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    library = Tokenizer.from_file(WORDS)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    rows = QUERIES["op2_packing"](spark, folder).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"] and len(ids[r["doc_id"]]) == r["doc_tokens"]
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[i])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padding += 4096 - at
    assert padding < 2 * 4096


def test_sequences_and_odd_lengths(spark):
    pieces = spark.createDataFrame([(1, 3), (2, 5), (3, 2), (None, 6), (5, None), (2, 5)], "doc_id long, length long")
    got = packing.pack(pieces, 8).collect()
    assert len(got) == 6 and sum(r["sequence_id"] is None for r in got) == 1
    assert sorted(r["length"] for r in got if r["sequence_id"] is not None) == [2, 3, 5, 5, 6]
    assert len({r["sequence_id"] for r in got if r["sequence_id"] is not None}) == 3
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 9)], "doc_id long, length long"), 8)
    docs = spark.createDataFrame([(i, "one two three " * i) for i in range(9)], "doc_id long, text string")
    made = packing.sequences(packing.pack(packing.token_pieces(docs, WORDS, 16, with_ids=True), 16), 16).collect()
    assert all(len(r["ids"]) == 4 * r["padded"] and r["padded"] in (1, 2, 4, 8, 16) for r in made)
