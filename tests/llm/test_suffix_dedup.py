import hashlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import suffix_dedup as S


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_and_prefixes_against_sorting():
    rng = np.random.default_rng(1)
    for _ in range(200):
        t = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(0, 80))).astype(np.uint8)
        b = t.tobytes()
        order = sorted(range(len(b)), key=lambda i: b[i:])
        sa = S.suffix_array(t, len(b) + 8)
        assert sa.tolist() == order
        lcp = S.common_prefixes(t, sa, len(b) + 8)
        for i in range(len(b) - 1):
            x, y = b[order[i] :], b[order[i + 1] :]
            assert lcp[i] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


@pytest.mark.parametrize("most_variants", [4096, 1])
def test_against_brute_force(spark, most_variants):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abé"), int(rng.integers(1, 5))))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(int(rng.integers(0, 120)))) for _ in range(12)]
    texts += [texts[0], texts[1][:70] + "x" + texts[1][71:], "pre " + passage + " post", passage[3:], "q" + passage + passage]
    texts += ["a" * 90, "", None, "ab " * 50, texts[0]]
    rows = [(i if i != 20 else None, t, "clash", 1) for i, t in enumerate(texts)]
    rows[-1] = rows[0]
    df = spark.createDataFrame(rows, "doc_id long, text string, rk string, at int")
    got = S.remove_repeats(df, length=40, k=16, most_variants=most_variants).drop("kept").collect()
    want = brute([(r[1] or "").encode() for r in rows], 40)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted([(r[0], *w) for r, w in zip(rows, want, strict=True)], key=key)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
