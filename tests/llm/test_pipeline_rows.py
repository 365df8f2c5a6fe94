"""Each stage of the pipeline, row by row, against brute force on the rows it was given."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from test_corpus import base_by_rule, base_counts_by_rule
from test_duplicates import fingerprint_by_rule
from tokenizers import Tokenizer

import corpus_pipeline
from panelweave.llm import quality, secret_scan
from panelweave.llm.components import local_components

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def kept_text(rows, length=200):
    """Texts without the bytes that strings of ``length`` bytes cover which stand elsewhere too."""
    seen = {}
    texts = [r[1].encode() for r in rows]
    for b in texts:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for b in texts:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        out.append(bytes(x for x, y in zip(b, np.cumsum(cover)[:-1]) if not y).decode("utf-8", "ignore"))
    return out


def test_stages_row_by_row(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(3)
    said = "said once " * 3 + "password = 'hunter2hunter2hunter2' and 0123456789abcdef0123 " + "plain words that go on and on in their own way until there are enough of them to pass the rules of length"
    planted = [(10**6 + i, said, "en", "s", len(said)) for i in range(3)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema)).cache()
    given = rows_of(docs)

    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = []
    for r in given:
        n_words, _, _, _, n_repeat = base_counts_by_rule(r[1])
        words = r[1].encode().split()
        good = model.probability(quality.features(r[1], quality.word_hashes(words))) >= quality.THRESHOLD
        if n_words >= 20 and 100 * n_repeat <= 30 * n_words and good:
            want.append(r)
    kept = stages["quality_rules"](spark, docs, folder).cache()
    assert rows_of(kept) == want and len(want) < len(given)

    fps = np.array([fingerprint_by_rule(r[1]) for r in want], np.uint64)
    label = local_components(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))
    least = {}
    for r, c in zip(want, label.tolist()):
        least[c] = min(r, least.get(c, r))
    want = sorted(least.values())
    kept = stages["simhash_dedup"](spark, kept, folder).cache()
    assert rows_of(kept) == want

    want = [(r[0], t, *r[2:4], len(t)) for r, t in zip(want, kept_text(want))]
    kept = stages["suffix_dedup"](spark, kept, folder).cache()
    assert rows_of(kept) == want

    encoding, masked = secret_scan.vocabulary(VOCABULARY, PATTERN), []
    for r in want:
        base = base_by_rule(r[1])
        hidden = np.zeros(len(r[1]) + 1, bool)
        for a, _, b in base + secret_scan.random_spans(r[1], base, encoding, secret_scan.MAX_RATIO, frozenset()):
            hidden[a:b] = True
        text = "".join((corpus_pipeline.SECRET_MARK if not i or not hidden[i - 1] else "") if hidden[i] else c for i, c in enumerate(r[1]))
        masked.append((r[0], text, *r[2:4], len(text)))
    kept = stages["secrets"](spark, kept, folder).cache()
    got = rows_of(kept)
    assert [(r[0], *r[2:4]) for r in got] == [(r[0], *r[2:4]) for r in masked]
    mark = corpus_pipeline.SECRET_MARK
    for a, b in zip(got, masked):
        # Spans that touch without overlapping have a mark each.
        assert a[1].replace(mark * 2, mark) == b[1] and a[4] == len(a[1])
    assert any(corpus_pipeline.SECRET_MARK in r[1] for r in got)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["packing"](spark, kept, folder).collect()
    found, windows = {}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert p["start"] == len(found.setdefault(p["doc_id"], [])) and len(ids) == p["length"]
        assert p["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        found[p["doc_id"]] += ids
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert found == {r[0]: [*library.encode(r[1], add_special_tokens=False).ids, 2] for r in got}
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
