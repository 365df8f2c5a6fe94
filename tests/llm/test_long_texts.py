"""Texts that once met wrong ids or took time that grows with the square of their length."""

from __future__ import annotations

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelweave.llm import bpe, packing, quality, secret_scan, simhash, token_counts, toxicity
from panelweave.llm.common import id_and_text

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def doubled(n):
    """A sequence of a and b that doubles by appending its complement, and its complement."""
    text, other = "a", "b"
    while len(text) < n:
        text, other = text + other, other + text
    return text, other


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_tokens_are_told_apart_by_their_characters(n):
    pair = doubled(n)
    library = Tokenizer.from_file(WORDS)
    want = [library.encode(t, add_special_tokens=False).ids for t in pair]
    assert want[0] != want[1]
    own = bpe.Bpe(WORDS, "library")
    together = bpe.token_values(own, list)
    assert [[i for v in vs for i in v] for vs in together(list(pair))] == want
    apart = bpe.token_values(own, list)
    assert [[i for v in next(iter(apart([t]))) for i in v] for t in pair] == want
    other = Tokenizer.from_file(BYTES)
    for counter, lists in ((token_counts.PrefixCounter(BYTES), [list(pair)]), (token_counts.PrefixCounter(BYTES), [[t] for t in pair])):
        got = [int(c[-1]) for texts in lists for c in counter.counts(texts)]
        assert got == [len(other.encode(t, add_special_tokens=False).ids) for t in pair]


def test_equal_hashes_do_not_mix_documents(spark):
    pair = doubled(1024)
    library = Tokenizer.from_file(WORDS)
    docs = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.pack(packing.token_pieces(docs, WORDS)).collect()}
    assert got == {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(pair)}


def test_random_long_tokens_equal_the_library():
    rng = random.Random(4)
    library, values = Tokenizer.from_file(WORDS), bpe.token_values(bpe.Bpe(WORDS, "library"), list)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.choice([1, 3, 8, 9, 40, 300]))) for _ in range(rng.randrange(6))) for _ in range(300)]
    assert [[i for v in vs for i in v] for vs in values(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def within(seconds, fn):
    start = time.process_time()
    out = fn()
    assert time.process_time() - start < seconds
    return out


def test_counts_of_long_white_space():
    counter, library = token_counts.PrefixCounter(BYTES), Tokenizer.from_file(BYTES)
    for text in ("x" + "\n" * 1_000_000, " " * 300_000 + "x", "a \n" * 100_000 + " " * 100_000):
        got = within(40, lambda t=text: next(iter(counter.counts([t]))))
        assert got[-1] == len(library.encode(text, add_special_tokens=False).ids)
    for text in ("a \n\n  ", " \n", "  x  ", "\n\n\nx\n\n\n"):
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        assert next(iter(counter.counts([text]))).tolist() == want


def test_secrets_in_a_long_checksum_list():
    rng = random.Random(2)
    line = lambda: "%064x  path/to/file%d.txt\n" % (rng.getrandbits(256), rng.randrange(10**6))
    text = "".join(line() for _ in range(100_000))
    encoding = secret_scan.vocabulary(VOCABULARY, PATTERN)
    base = within(10, lambda: secret_scan.base_spans(text))
    assert len(base) == 100_000 and within(60, lambda: secret_scan.random_spans(text, base, encoding, secret_scan.MAX_RATIO, frozenset())) == []
    glued = ".".join("%08x-%04x-%04x-%04x-%012x" % tuple(rng.getrandbits(b) for b in (32, 16, 16, 16, 48)) for _ in range(20_000))
    within(30, lambda: secret_scan.random_spans(glued, secret_scan.base_spans(glued), encoding, secret_scan.MAX_RATIO, frozenset()))


def quoted_by_rule(text, places):
    out = []
    for start, end in places:
        line = text.rfind("\n", 0, start) + 1
        left, stop = text[line:start], text.find("\n", end)
        right = text[end : stop if stop >= 0 else len(text)]
        straight = left.count('"') % 2 == 1 and '"' in right
        opened = max(left.rfind(m) for m in "“„«") > max(left.rfind(m) for m in "”»") and any(m in right for m in "”»")
        out.append(straight or opened)
    return out


def test_quotes_of_a_long_line():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice('ab "“„«”»\n') for _ in range(40))
        places = [(a, a + rng.randrange(1, 3)) for a in range(38)]
        assert toxicity.quoted(text, places) == quoted_by_rule(text, places)
    line = 'he said "you idiot" again ' * 60_000
    places = [(i * 26 + 13, i * 26 + 18) for i in range(60_000)]
    assert all(within(5, lambda: toxicity.quoted(line, places)))


def test_column_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "one two three four", "x", 2), (2, "one two three four", "y", 3), (3, None, "z", 4)], ["doc_id", "text", "a.b", "c`d"])
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert id_and_text(docs, carry=["a.b", "c`d"]).select("row.*").columns == ["a.b", "c`d"]
    found = secret_scan.scan(docs, VOCABULARY, PATTERN, mask="*", carry=["a.b"])
    assert found.count() == 3 and quality.judge(docs, None, carry=["a.b"]).count() == 3


def test_repeated_labels_and_an_empty_table(spark):
    rows = [(i, ("vile scum " if i % 2 else "fine words ") + f"number{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(i, 0) for i in range(200)], "doc_id long, toxic int")
    models = [toxicity.learn(docs, labels.repartition(n)) for n in (1, 7)]
    once = toxicity.learn(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    assert models[0].weights == models[1].weights == once.weights and models[0].coefficients == pytest.approx(once.coefficients)
    assert toxicity.score(docs.filter("false"), once).count() == 0
    assert toxicity.score(docs, toxicity.learn(docs.filter("false"), labels)).filter("predicted = 1").count() == 0
