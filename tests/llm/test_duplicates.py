"""Near-duplicates, repeated passages and vector links against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from panelweave.llm import embeddings, repeats, simhash
from panelweave.llm.components import connected, local_components
from panelweave.llm.queries import QUERIES


def fingerprint_by_rule(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_rule(rows):
    fps = np.array([fingerprint_by_rule(t) for _, t in rows], np.uint64)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    label, least = local_components(len(fps), i, j), {}
    for (doc, _), x in zip(rows, label, strict=True):
        if doc is not None:
            least[x] = min(doc, least.get(x, doc))
    return collections.Counter((doc, f"{int(f):016x}", least.get(x)) for (doc, _), f, x in zip(rows, fps, label, strict=True))


def test_simhash(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert collections.Counter(tuple(r) for r in QUERIES["op8_simhash"](spark, folder).collect()) == classes_by_rule(rows)
    rng = random.Random(1)
    words = ["Ab", "b\x0bc", "é", "d\x1ce", "f"]
    rows = [(rng.choice([i, None, 7]), rng.choice([None, "", " \n", " ".join(rng.choice(words) for _ in range(rng.randrange(6)))])) for i in range(80)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    assert collections.Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == classes_by_rule(rows)
    assert simhash.near_duplicates(docs.filter("false")).count() == 0
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(_class_labels(rows)))


def _class_labels(rows):
    fps = np.array([fingerprint_by_rule(t) for _, t in rows], np.uint64)
    return local_components(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)).tolist()


def test_links_in_large_groups(spark):
    rng, base, found = np.random.default_rng(1), 0x1234567890ABCDEF, set()
    while len(found) < 5200:
        x = base
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            x ^= 1 << int(b)
        found.add(x)
    fps = np.array(sorted(found), np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    pairs = [(at[r["a"]], at[r["b"]]) for r in simhash.links(frame).collect()]
    a, b = map(np.array, zip(*pairs, strict=True))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert np.array_equal(local_components(len(fps), a, b), local_components(len(fps), i, j))


def test_connected(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5), (9, None)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = [(a, b) for a, b in links if b is not None and a != b]
    label = local_components(500, *map(np.array, zip(*pairs, strict=True)))
    assert got == {n: int(label[n]) for p in pairs for n in p if label[n] != n}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats_by_rule(rows, length):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = collections.Counter()
    for doc, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def passages(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5))) for _ in range(12)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, rows = [*(text(30) for _ in range(5)), "a" * 300, "ab" * 100, "é" * 120], []
    for i in range(120):
        t = text(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            t += p[a : a + rng.randrange(len(p))] + text(rng.randrange(8))
        rows.append((rng.choice([i, i, i, i // 2, None]), rng.choice([t, t, t, t, "", None])))
    return rows + [rows[3], rows[3], rows[9]]


@pytest.mark.parametrize(("length", "k", "group"), [(20, 6, 65536), (20, 6, 3), (40, 12, 4), (64, 63, 100)])
def test_repeats(spark, length, k, group):
    rows = passages(length)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    assert collections.Counter(tuple(r) for r in repeats.remove_repeats(docs, length, k, group).collect()) == repeats_by_rule(rows, length)


def test_repeats_of_long_texts(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    rows = [(1, long), (2, long[250_000:270_500] + "x" + long[524_000:530_000]), (3, long[262_100:262_400])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in repeats.remove_repeats(docs).collect()) == repeats_by_rule(rows, 200)
    assert repeats.remove_repeats(docs.filter("false")).count() == 0


def test_repeats_on_given_documents(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert collections.Counter(tuple(r) for r in QUERIES["op4_repeats"](spark, folder).collect()) == repeats_by_rule(rows, 200)


def links_by_rule(rows):
    usable = [(k, v) for k, v in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = np.zeros((len(usable), len(usable)), bool)
    for i, (_, a) in enumerate(usable):
        for j, (_, b) in enumerate(usable):
            if i != j and len(a) == len(b):
                x, y = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                linked[i, j] = x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9
    same = np.array([[a == b for b, _ in usable] for a, _ in usable])
    label = local_components(len(usable), *np.nonzero(linked | same))
    least = {}
    for (k, _), x in zip(usable, label, strict=True):
        least[x] = min(k, least.get(x, k))
    out = collections.Counter((k, int(linked[i].sum()), least[label[i]], least[label[i]] == k) for i, (k, _) in enumerate(usable))
    rest = collections.Counter((k, 0, k, True) for k, v in rows if not (k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)))
    return out + rest


@pytest.mark.parametrize("tile", [7, 4096])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 20))
    vectors = [(centres[rng.integers(12)] + rng.normal(size=20) * rng.choice([0, 0.05, 0.3, 0.5])).tolist() for _ in range(120)]
    vectors += [None, [], [0.0] * 20, [float("nan")] * 20, [None] + [1.0] * 19, [float("inf")] * 20, [1.0, 2.0], [2.0, 4.0], [1e200, 2e200], [1e-300, 2e-300], [-1.0], [3.0], [5.0], vectors[0], vectors[0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(None, vectors[1])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, n_links int")
    assert collections.Counter(tuple(r) for r in embeddings.near_duplicates(frame, tile=tile).collect()) == links_by_rule(rows)
    assert embeddings.near_duplicates(frame.filter("false")).count() == 0
