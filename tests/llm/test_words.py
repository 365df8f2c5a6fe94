"""Language model, phrases and spelling variants against enumeration, plain recounts and the SQL rule."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelweave.llm import language_model as lm
from panelweave.llm import phrases, spelling
from panelweave.llm.queries import QUERIES

# Language model ------------------------------------------------------------------------------


def small_chain(rng, states, symbols):
    chain = lm.Chain(rng.random(states), rng.random((states, states)), rng.random((symbols, states)))
    return lm.Chain(chain.start / chain.start.sum(), chain.step / chain.step.sum(axis=1, keepdims=True), chain.emit / chain.emit.sum(axis=0))


def paths(chain, s):
    """Probability of each path of states with the sequence."""
    for path in itertools.product(range(len(chain.start)), repeat=len(s)):
        p = chain.start[path[0]] * chain.emit[s[0], path[0]]
        for a, b, x in zip(path, path[1:], s[1:]):
            p *= chain.step[a, b] * chain.emit[x, b]
        yield path, p


@pytest.mark.parametrize("seed", range(4))
def test_recursions_equal_the_sum_over_all_paths(seed):
    rng = np.random.default_rng(seed)
    chain = small_chain(rng, 3, 4)
    sequences = [rng.integers(0, 4, n) for n in rng.integers(1, 7, 6)]
    want = [sum(p for _, p in paths(chain, s)) for s in sequences]
    np.testing.assert_allclose(lm.log_likelihood(chain, sequences), np.log(want))
    start, step, symbols, total = lm.expected_counts(chain, sequences)
    first, moves, seen = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for s, whole in zip(sequences, want):
        for path, p in paths(chain, s):
            first[path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / whole
            for x, a in zip(s, path):
                seen[x, a] += p / whole
    np.testing.assert_allclose(start, first)
    np.testing.assert_allclose(step, moves)
    np.testing.assert_allclose(symbols, seen)
    assert total == pytest.approx(np.log(want).sum())
    # All sequences of one length together have probability one.
    every = [np.array(s) for s in itertools.product(range(4), repeat=4)]
    assert np.exp(lm.log_likelihood(chain, every)).sum() == pytest.approx(1)


def test_long_sequences_do_not_underflow():
    chain = small_chain(np.random.default_rng(1), 2, 5)
    one = np.random.default_rng(2).integers(0, 5, 50_000)
    whole = lm.log_likelihood(chain, [one, one[:3]])
    assert np.isfinite(whole).all() and whole[0] < -40_000


def base_by_rule(rows):
    counts = Counter()
    for i, text in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            counts.update([*(text or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        words = [*(text or "").encode().lower().split(), b""]
        score = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((i, len(words), sum(counts[w] > 0 for w in words), n, round(score, 6)))
    return sorted(out, key=str)


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    kinds = [["ka", "ko", "ku", "kamo", "kora"], ["tis", "ten", "tora", "tilde", "ton"]]
    return [(i, " ".join(rng.choice(kinds[i % 2]) + ("" if rng.random() < 0.95 else str(rng.randrange(50))) for _ in range(rng.randrange(1, 700)))) for i in range(n)]


def test_language_model_on_odd_rows(spark):
    rows = [*corpus(), (500, None), (501, ""), (None, "Ka\x1ck KO\tkó\n\x0bko"), (7, "ka ko ku"), (7, "ka ko ku"), (502, "x" * 300_000 + " ka"), (503, "\x1c é \x85  ")]
    docs = spark.createDataFrame([(i, t, 0.0, "x") for i, t in rows], "doc_id long, text string, score double, word string").repartition(5)
    got = lm.score(docs, states=3, rounds=4, own=4, table=8).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == base_by_rule(rows)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10 == 0) for r in got)
    texts = [r for r in got if (r["doc_id"] or 0) < 60]
    assert sum(r["score"] for r in texts) > sum(r["base_score"] for r in texts)
    same = [r["score"] for r in got if r["doc_id"] == 7 and r["n_tokens"] == 4]
    assert len(same) == 2 and same[0] == pytest.approx(same[1])
    assert lm.score(docs.filter("false")).count() == 0
    alone = lm.score(docs.filter("doc_id is null or doc_id in (500, 501)").limit(2)).collect()
    assert len(alone) == 2 and all(math.isfinite(r["score"]) for r in alone)


def test_score_is_the_sum_over_paths_of_whole_words(spark):
    """The model's score of a short text, by enumeration of states with each word's own probability."""
    docs = spark.createDataFrame(corpus(30), "doc_id long, text string")
    read = docs.select("doc_id", "text")
    counts = lm.materialise(lm.training_counts(read))
    words = lm.learn_words(counts, 4, 8)
    rows = lm.materialise(lm.encode(read.withColumn("key", F.monotonically_increasing_id()), words, 4))
    chain, before = lm.baum_welch(rows, lm.first_guess(words.frequency, 2), words.frequency, 4)
    for _ in range(3):
        chain, log = lm.baum_welch(rows, chain, words.frequency, 4)
        assert log > before
        before = log
    probe = spark.createDataFrame([(1, "ka tora kamo17 nowhere")], "doc_id long, text string")
    encoded = lm.encode(probe.withColumn("key", F.lit(0).cast("long")), words, 4)
    got = lm._scored(encoded, counts, words, chain, 4).first()["score"]
    n = {r["word"].encode(): r["n"] for r in counts.collect()}
    order = sorted((w for w in n if w), key=lambda w: (-n[w], w))
    symbol = lambda w: 0 if not w else order.index(w) + 1 if w in order[:4] else lm.shared_symbol(w, 4)
    mass = Counter()
    for w, c in n.items():
        if symbol(w) > 4:
            mass[symbol(w)] += c + 0.1
    share = lambda w: 1 if symbol(w) <= 4 else (n.get(w, 0) + 0.1) / (mass[symbol(w)] + 0.1)
    sequence = [*b"ka tora kamo17 nowhere".split(), b""]
    p = sum(p for _, p in paths(chain, [symbol(w) for w in sequence])) * math.prod(map(share, sequence))
    assert got == pytest.approx(math.log10(p))
    # Counts added up over many tasks are those of one.
    one, many = (lm.baum_welch(rows.repartition(k), chain, words.frequency, 4)[0] for k in (1, 7))
    np.testing.assert_allclose(one.emit, many.emit)
    np.testing.assert_allclose(one.step, many.step)


def test_held_out_texts_are_likelier_than_by_word_counts(spark, folder):
    got = QUERIES["op11_language_model"](spark, folder).filter("held_out").collect()
    n = sum(r["n_tokens"] for r in got)
    assert sum(r["score"] - r["base_score"] for r in got) / n > 0.05


# Phrases -------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 5), st.sampled_from([1, 2, 7, 17, 31, 32]), st.integers(0, 2**32), st.integers(0, 6))
def test_permutation_and_filters_lose_nothing(k, bits, seed, shard_bits):
    rng = np.random.default_rng(seed)
    packing = phrases.Packing(k, bits)
    ids = [rng.integers(0, min(2**bits, 50), 400).astype(np.uint64) for _ in range(k)]
    limbs = packing.permute(packing.pack(ids))
    assert all((x < 2.0**w).all() for x, w in zip(limbs, packing.widths))
    assert all((a == b).all() for a, b in zip(packing.unpack(packing.restore(limbs)), ids))
    halves = [phrases.Counts.of([x[part] for x in limbs]) for part in (slice(0, 150), slice(150, None))]
    halves[0].count[0] += 1000
    shard_bits = min(shard_bits, packing.widths[0])
    read = []
    for c in halves:
        shards = c.limbs[0] >> np.uint64(packing.widths[0] - shard_bits)
        for s in np.unique(shards).tolist():
            read.append(phrases.from_filter(phrases.to_filter(c.part(shards == s), packing.widths, shard_bits), packing.widths, shard_bits, s))
    whole = phrases.Counts.merged(read)
    got = Counter(dict(zip(zip(*(x.tolist() for x in packing.unpack(packing.restore(whole.limbs)))), whole.count.tolist())))
    want = Counter(zip(*(x.tolist() for x in ids)))
    extra = [x - y for x, y in ((got[g], want[g]) for g in got)]
    assert set(got) == set(want) and sorted(extra)[-1] == 1000 and sum(extra) == 1000


def collocations_by_rule(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").encode().lower().decode()):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    candidates = {p for p, c in f.items() if c >= least and len(p[1]) > 1}
    inside = set()
    for lang, p in candidates:
        for k in range(2, len(p)):
            inside |= {(lang, p[i : i + k]) for i in range(len(p) - k + 1) if f[lang, p] >= f[lang, p[i : i + k]]}
    out = []
    for lang, p in candidates - inside:
        a = f[lang, p]
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(ranked)


def phrase_rows(seed=5):
    rng = random.Random(seed)
    words = ["The", "of", "and", "ka", "É", "é", "x", "\x1c", " ", "a-b", "new", "york", "city", "hall"]
    text = lambda: " ".join(rng.choice(["new york city hall", "of the", "ka ka ka ka ka ka", rng.choice(words)]) + rng.choice(["", "", "", ".", ",", "\n", "\t", " \r\n", "!?"]) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "fr", None, "und", "en"]), text()) for _ in range(80)] + [("en", None), ("de", ""), (None, ""), ("en", "of the " * 3000), ("en", "z" * 100_000)]


@pytest.mark.parametrize("dictionary_rows", [1 << 20, 0])
def test_collocations(spark, dictionary_rows, monkeypatch):
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, lang, t, 0) for i, (lang, t) in enumerate(rows)], "ids long, lang string, text string, n int").repartition(6)
    monkeypatch.setattr(phrases, "SHARD", 64)
    for least, top in ((4, 2000), (2, 7)):
        got = phrases.collocations(docs, least, top, dictionary_rows=dictionary_rows).collect()
        assert sorted(map(tuple, got)) == collocations_by_rule(rows, least, top)


def test_no_phrases(spark):
    docs = spark.createDataFrame([("en", "one two")], "lang string, text string")
    assert phrases.collocations(docs.filter("false")).count() == phrases.collocations(docs).count() == 0


# Spelling ------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def variants_by_rule(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def spelling_rows(seed=7):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abeéß") for _ in range(rng.randrange(4, 9))) for _ in range(40)]
    def word():
        w = rng.choice(base)
        while rng.random() < 0.4:
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abeé") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abeÉ÷") + w[i + 1 :]])
        return w.upper() if rng.random() < 0.1 else w
    rows = [(i, rng.choice([" ", "1", "-", "\n"]).join(word() for _ in range(rng.randrange(200)))) for i in range(120)]
    long = "".join(rng.choice("abc") for _ in range(5000))
    return rows + [(None, "aaaaa aaaab aaaab"), (900, None), (901, ""), (902, "aaaaa " * 40), (902, "aaaaa " * 40), (903, f"{long} {long} {long} {long[1:]} " * 3), (904, "ÀÁÂÃÄ 中中中中中 Ÿabcde ſabcde " * 5)]


def test_variants(spark):
    rows = spelling_rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string").repartition(5)
    got = spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = variants_by_rule(rows)
    assert sorted(map(tuple, got)) == want
    assert any(r[1] and r[1] != r[2] for r in want) and max(r[4] for r in want) > 5
    assert spelling.variants(docs.filter("false")).count() == 0


def test_large_groups_are_dealt_out_again(spark):
    words = ["".join(w) for w in itertools.product("abcdefghij", repeat=4)]
    words = [f"mm{w}" for w in words] + [f"{w}mm" for w in words] + [f"mm{w}x" for w in words[:3000]]
    counts = {w: 3 + zlib.crc32(w.encode()) % 5 for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    sizes = spelling.groups(frame, 3306).groupBy("m", "a", "b", "head", "tail").count()
    assert sizes.agg(F.max("count")).first()[0] <= 3306
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(frame, 3306).collect()}
    for w in random.Random(1).sample(sorted(counts), 400):
        letters = "abcdefghijmx"
        near = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + w[i + 1 :] for i in range(len(w))}
        near = [v for v in near - {w} if v in counts]
        best = min(near, key=lambda v: (-counts[v], v))
        assert got[w] == (len(near), counts[best], best)
    with pytest.raises(ValueError):
        spelling.groups(frame, 3305)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=30, unique=True))
def test_sorted_list_scan_finds_all_pairs(words):
    for size in {len(w) for w in words}:
        own = sorted(w for w in words if len(w) in (size, size + 1))
        rows = spelling.SortedList([w.encode() for w in own], np.zeros(len(own), np.int64), np.full(len(own), size), np.zeros(len(own), bool))
        got = sorted((own[a], own[b]) for q, v in rows.near(3) for a, b in zip(q.tolist(), v.tolist()))
        assert got == sorted((a, b) for a in own for b in own if len(a) == size and one_edit(a, b))
