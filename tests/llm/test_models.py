"""Weights, scores and spaces against plain computations."""

import math

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import decontaminate, lattice, near_dedup, quality
from gridloom.llm._text import HashIndex, mix, word_hashes

rng = np.random.default_rng(7)
VOCAB = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 7)))) for _ in range(200)]


def prose(n):
    return " ".join(rng.choice(VOCAB, n))


def test_importance_weights_against_the_formula(spark):
    texts = [prose(40) + (" vile rot" * 3 if i % 5 == 0 else "") for i in range(200)] + [None, "", "  "]
    kind = {i: 3 if i % 5 == 0 else 1 for i in range(0, 200, 2)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(k == 3)) for i, k in kind.items()], "doc_id long, quality int, toxic int")
    grams = [quality.ngrams(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for t in texts]
    size = 1 << quality.BITS
    count = lambda ids: sum((np.bincount(grams[i], minlength=size) for i in ids), np.zeros(size))
    every, good, bad = count(range(len(texts))), count(i for i, k in kind.items() if k == 1), count(i for i, k in kind.items() if k == 3)
    share = (1 - quality.ALL_TEXT) * sum(k == 3 for k in kind.values()) / len(kind)
    want = []
    for g in grams:
        total = 1 - quality.ALL_TEXT - share
        for c, s, pseudo, shrink in ((every, quality.ALL_TEXT, quality.PSEUDO_ALL, None), (bad, share, quality.PSEUDO_KIND, quality.SHRINK)):
            n = min(c.sum(), good.sum())
            r = 0.0
            for b in g:
                x = math.log((c[b] * n / c.sum() + pseudo) / (good[b] * n / good.sum() + pseudo))
                if shrink is not None:
                    x = math.copysign(max(abs(x) - max(math.sqrt(1 / (c[b] + pseudo) + 1 / (good[b] + pseudo)), shrink), 0), x)
                r += x
            total += s * math.exp(r)
        want.append(-math.log(total) / quality.TEMPERATURE if len(g) else None)
    got = {r.doc_id: r for r in quality.weights(df, labels).collect()}
    assert all(got[i].log_weight is None if w is None else got[i].log_weight == pytest.approx(w, rel=1e-3, abs=1e-2) for i, w in enumerate(want))
    even = -math.log(2 * (1 - quality.ALL_TEXT - share)) / quality.TEMPERATURE
    k = sum(r.log_weight is not None and r.log_weight >= even for r in got.values())
    least = sorted((r.gumbel_key for r in got.values() if r.gumbel_key is not None), reverse=True)[k - 1]
    assert all(r.kept == (r.gumbel_key is not None and r.gumbel_key >= least) for r in got.values())
    assert not any(got[i].kept for i in range(0, 200, 5))
    clash = df.selectExpr("*", "'mine' as kept", "7 as log_weight")
    kept = quality.keep(clash, labels)
    assert kept.columns == clash.columns and {r.kept for r in kept.collect()} == {"mine"}


def test_latent_space_against_the_exact_decomposition(spark):
    words = [f"w{i}" for i in range(40)]
    items = [" ".join(rng.choice(words, 20)) for _ in range(12)]
    texts = [" ".join(rng.choice(words, 150)) for _ in range(30)]
    bench = decontaminate.Benchmark([(i, 1) for i in range(12)], items, stop_share=1.0)
    df = spark.createDataFrame([(i, i, bytearray(t.encode())) for i, t in enumerate(texts)], "x long, y long, text binary")
    compact = df.mapInArrow(decontaminate._words_of(bench), "x long, y long, place array<int>, word array<int>").cache()
    idf = np.linspace(0.5, 2, len(bench.words))
    v, s = decontaminate.latent_space(compact, bench.term, idf)
    rows = []
    number = {w: int(np.searchsorted(bench.words, decontaminate.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0])) for w in words if w in " ".join(items).split()}
    for t in texts:
        own = t.split()
        for lo in range(0, len(own), decontaminate.PASSAGE):
            r = np.zeros(len(idf))
            for w in own[lo : lo + decontaminate.PASSAGE]:
                if w in number:
                    r[number[w]] += 1
            r = np.where(r > 0, 1 + np.log(np.maximum(r, 1)), 0) * idf
            rows.append(r / np.linalg.norm(r))
    _, exact, basis = np.linalg.svd(np.array(rows), full_matrices=False)
    assert np.allclose(s[:10], exact[:10], rtol=1e-3)
    assert abs(v[:, 0] @ basis[0]) == pytest.approx(1, abs=1e-4)


def test_short_items_leak_nothing(spark):
    bench = spark.createDataFrame([(0, "yes"), (1, "one two three four five six")], "item_id long, text string")
    df = spark.createDataFrame([(0, "yes it is"), (1, "so one two three four five six ends")], "doc_id long, text string")
    assert {r.doc_id: r.item_id for r in decontaminate.contamination(df, bench).collect()} == {0: None, 1: 1}


def test_long_strings_have_the_same_sums_and_paths():
    v = lattice.Vocabulary.load()
    tables = v.tables()
    data = np.frombuffer(("the" * 500 + "é" * 200).encode(), np.uint8)
    off = np.array([0, len(data)])
    long, short = lattice.LONG, lattice.FEW
    try:
        one = lattice.Lattice(v, tables, data, off)
        a = one.forward()
        lattice.LONG = 1 << 20
        whole = lattice.Lattice(v, tables, data, off)
        assert np.allclose(a, whole.forward())
        draw = lambda: lattice.Sampler(whole).draw(np.array([0]), np.array([9], np.uint64), np.array([0]))[1]
        x = draw()
        lattice.FEW = 0
        assert np.array_equal(x, draw())
    finally:
        lattice.LONG, lattice.FEW = long, short


def test_shared_shingles_and_short_texts():
    a, b = ([rng.choice(60, int(rng.integers(3, 40)), replace=False).astype(np.uint64) for _ in range(n)] for n in (30, 20))
    got = near_dedup.shared_counts(a, b)
    assert np.array_equal(got, [[len(np.intersect1d(x, y)) for y in b] for x in a])
    # Four and five shingles, similarity 0.8: they always meet.
    for i in range(50):
        w = [f"{i}x{j}" for j in range(9)]
        keys = []
        for t in (w, w[:8], w[1:]):
            data = np.frombuffer(" ".join(t).encode(), np.uint8)
            keys.append(set(near_dedup.sketch(*near_dedup.shingles(data, np.array([0, len(data)])))[1].tolist()))
        assert keys[0] & keys[1] and keys[0] & keys[2]


def test_hash_index_and_word_hashes():
    keys = mix(np.arange(1, 5000, dtype=np.uint64))
    index = HashIndex(keys)
    assert np.array_equal(index.find(keys), np.arange(len(keys))) and (index.find(mix(np.arange(6000, 7000, dtype=np.uint64))) < 0).all()
    words = [("ab" * n).encode() for n in (1, 3, 4, 5, 20, 200)] * 2
    off = np.r_[0, np.cumsum([len(w) for w in words])]
    h = word_hashes(np.frombuffer(b"".join(words), np.uint8), off[:-1], off[1:])
    assert np.array_equal(h[:6], h[6:]) and len(set(h.tolist())) == 6
    assert len(pa.array(h)) == 12
