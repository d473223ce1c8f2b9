"""The operators on small tables: nulls, empty and repeated rows, ties, clashing columns, against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import ann, decontaminate, lattice, lm_scoring, near_dedup, pieces, quality, sharding, urls, warc

rng = np.random.default_rng(0)
VOCAB = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 7)))) for _ in range(300)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCAB, n))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", len(t or ""), 7) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long, rk int")


EMPTY = "doc_id long, text string"


# ---- 2 ------------------------------------------------------------------------------------------

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_against_the_full_table():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = r.integers(0, 12, int(r.integers(1, 40)))
        b = a.copy()
        for _ in range(int(r.integers(0, 4))):
            b[int(r.integers(0, len(b)))] = 99
        b = np.delete(b, int(r.integers(0, len(b)))) if r.random() < 0.5 and len(b) > 1 else b
        m = lcs(a.tolist(), b.tolist())
        want = m / (len(a) + len(b) - m)
        assert near_dedup.similarity(a, b) == pytest.approx(want if want >= 0.8 - 1e-12 else 0.0)


def test_near_duplicates_against_brute_force(spark):
    r = np.random.default_rng(2)
    texts = [prose(int(r.integers(30, 120)), r) for _ in range(25)]
    for i in range(10):
        w = texts[i].split()
        w[int(r.integers(0, len(w)))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "", "", None, "   ", "one two", "one two", "one two three", texts[3] + " " + texts[4]]
    df = docs_of(spark, texts)

    def seq(t):
        w = (t or "").lower().split()
        return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    s = [seq(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if s[i] and s[j]:
                m = lcs(s[i], s[j])
                if m / (len(s[i]) + len(s[j]) - m) >= 0.8:
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
    got = {r.doc_id: r.class_id for r in near_dedup.near_dups(df).collect()}
    assert got == dict(enumerate(label))
    kept = near_dedup.keep_one(df.union(df.where("doc_id = 2")))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


def test_variants_of_one_base_are_one_class(spark):
    r = np.random.default_rng(21)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(150):
        w = base.copy()
        for j, at in enumerate(r.choice(np.arange(10, 190, 9), 4, replace=False)):
            w[at] = f"v{i}x{j}"
        texts.append(" ".join(w))
    got = near_dedup.near_dups(docs_of(spark, texts)).collect()
    assert {x.class_id for x in got} == {0} and {x.class_size for x in got} == {151}


def test_every_pair_of_a_bucket_is_aligned_or_linked(spark):
    r = np.random.default_rng(22)
    texts = []
    for base in range(3):
        words = [f"b{base}w{i}" for i in range(80)]
        for i in range(25):
            w = words.copy()
            for j, at in enumerate(r.choice(np.arange(5, 75, 7), int(r.integers(1, 4)), replace=False)):
                w[at] = f"v{i}x{j}"
            texts.append(" ".join(w))
    seqs = [[tuple(t.split()[i : i + 5]) for i in range(76)] for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            m = lcs(seqs[i], seqs[j]) if i // 25 == j // 25 else 0
            if m / (152 - m) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert {x.doc_id: x.class_id for x in near_dedup.near_dups(docs_of(spark, texts)).collect()} == dict(enumerate(label))


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_dups(spark.createDataFrame([], EMPTY)).count() == 0


# ---- 3 ------------------------------------------------------------------------------------------

def test_kth_largest(spark):
    x = np.round(np.random.default_rng(3).standard_normal(500), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for k in (1, 7, 250, 499, 500, 900):
        assert quality.kth_largest(df, "v", k) == sorted(x, reverse=True)[min(k, 500) - 1]
    assert quality.kth_largest(df, "v", 0) is None


def test_quality_on_held_out_rows(spark):
    r = np.random.default_rng(4)
    bad = [f"zz{i}" for i in range(40)]
    texts = [prose(60, r) if i % 3 else " ".join([*r.choice(bad, 30), *r.choice(VOCAB, 30)]) for i in range(600)] + [None, "", " "]
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.judge(df, labels).collect()}
    assert set(got[0].asDict()) == {*df.columns, "log_weight", "gumbel_key", "kept"}
    held = range(400, 600)
    assert np.mean([got[i].kept == bool(i % 3) for i in held]) > 0.95
    assert not any(got[i].kept for i in (600, 601, 602)) and got[601].log_weight is None
    assert all(x.kept for x in quality.judge(df.limit(5), labels.limit(0)).collect())
    assert quality.judge(spark.createDataFrame([], EMPTY), labels).count() == 0


# ---- 4 ------------------------------------------------------------------------------------------

def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards(spark):
    texts = [prose(5) for _ in range(300)] + [None, "", "é"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 50 + [(None, "x"), (-3, "y")]
    got = sharding.shard_rows(spark.createDataFrame(rows, EMPTY).repartition(5), 16).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((k is None, k or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    slots = {}
    for r in got:
        assert r.shard == jump(r.doc_id or 0, 16) and r.grown_shard == jump(r.doc_id or 0, 17) and r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_rows(spark.createDataFrame([], EMPTY)).count() == 0


def test_shards_of_text_keys(spark):
    keys = [f"k{i}" for i in range(200)] + ["b", "", None, "k7"]
    df = spark.createDataFrame([(k, "x") for k in keys], "doc_id string, text string").repartition(3)
    got = sharding.shard_rows(df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, keys))
    hashed = {r.doc_id: r.h for r in df.selectExpr("doc_id", "if(doc_id is null, 0, xxhash64(doc_id)) as h").collect()}
    assert all(r.shard == jump(hashed[r.doc_id], 16) and r.grown_shard in (r.shard, 16) for r in got)


def test_clashing_columns_are_not_read(spark):
    rows = [(i, prose(4)) for i in range(40)]
    plain = spark.createDataFrame(rows, EMPTY)
    names = ["key", "grp", "held_out", "score", "size", "shard", "slot", "stable", "part", "word", "n"]
    more = plain.selectExpr("doc_id", "text", *[f"'clash' as {c}" for c in names])
    columns = ("doc_id", "size", "text_crc32", "shard", "grown_shard")
    pick = lambda df: sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert pick(sharding.shard_rows(more)) == pick(sharding.shard_rows(plain))
    rounded = lambda df: sorted((r.doc_id, r.n_tokens, round(r.base_score, 9), round(r.score, 6)) for r in df.collect())
    assert rounded(lm_scoring.score_texts(more)) == rounded(lm_scoring.score_texts(plain))


# ---- 5 and 7 -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return lattice.Vocabulary.load()


def all_segmentations(vocabulary, text):
    got = [bytes(vocabulary.buffer[a:b]) for a, b in zip(vocabulary.begin[:-1], vocabulary.begin[1:])]
    by = {}
    for i, p in enumerate(got):
        by.setdefault(p, []).append(math.exp(vocabulary.score[i]))
    best = [1.0] + [0.0] * len(text)
    for j in range(1, len(text) + 1):
        best[j] = sum(best[i] * sum(by.get(text[i:j], [])) for i in range(j))
    return math.log(best[-1])


def test_lattice_against_all_segmentations(vocabulary):
    words = [b" the", b" tion", "é▁".encode(), b" a\n b".replace(b" b", b"b")]
    off = np.r_[0, np.cumsum([len(w) for w in words])]
    lat = lattice.Lattice(vocabulary, vocabulary.tables(), np.frombuffer(b"".join(words), np.uint8), off)
    assert np.allclose(lat.totals(), [all_segmentations(vocabulary, w) for w in words])


def test_scores(spark):
    texts = [prose(20) for _ in range(60)] + [None, "", "The THE\tthe\x0bÉ", prose(3)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the"), (3, texts[3])]
    got = lm_scoring.score_texts(spark.createDataFrame(rows, EMPTY), group_bytes=2000).collect()
    held = lambda k: zlib.crc32(str(k if k is not None else "").encode()) % 10 == 0
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: [w for w in (t or "").translate(low).replace("\t", " ").replace("\x0b", " ").split(" ") if w]
    count = Counter(w for k, t in rows if not held(k) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    want = sorted((held(k), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]), 6)) for k, t in rows)
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.score_texts(spark.createDataFrame([], EMPTY)).count() == 0


def test_probabilities_stay_below_one(spark):
    rows = [(i, prose(10)) for i in range(40)]
    probe = [(1000 + i, w) for i, w in enumerate(sorted({w for _, t in rows for w in t.split()} | {"q", "zz", "ab c"}))]
    got = {r.doc_id: r for r in lm_scoring.score_texts(spark.createDataFrame(rows, EMPTY).union(spark.createDataFrame([(k, t) for k, t in probe if zlib.crc32(str(k).encode()) % 10 == 0], EMPTY))).collect()}
    assert sum(10 ** r.score for k, r in got.items() if k >= 1000) < 1


def test_pieces_round_trip(spark):
    texts = [prose(30), "two  spaces\n\nand \t tabs ", "▁ mark <0x0A> é漢🙂", "", None, "x" * 3000, " lead", prose(30)]
    df = docs_of(spark, texts).union(docs_of(spark, texts).where("doc_id = 0"))
    enc = pieces.encode(df).collect()
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in enc)
    again = {r.doc_id: r.ids for r in pieces.encode(df.repartition(3)).collect()}
    assert all(again[r.doc_id] == r.ids for r in enc)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    other = {r.doc_id: r.ids for r in pieces.encode(df, seed=2).collect()}
    assert other[0] != again[0]
    assert pieces.encode(spark.createDataFrame([], EMPTY)).count() == 0


def test_samples_follow_the_lattice(vocabulary):
    n = 20000
    data = np.frombuffer(b" the" * n, np.uint8)
    piece, count = pieces.encode_chunk(vocabulary, vocabulary.tables(), data, np.array([0, len(data)]), np.array([5]))
    spelt = [bytes(vocabulary.buffer[vocabulary.begin[p] : vocabulary.begin[p + 1]]) for p in piece]
    whole = sum(s == b" the" for s in spelt) / n
    one = vocabulary.score[[i for i in range(len(vocabulary.ids)) if bytes(vocabulary.buffer[vocabulary.begin[i] : vocabulary.begin[i + 1]]) == b" the"][0]]
    assert whole == pytest.approx(math.exp(one - all_segmentations(vocabulary, b" the")), abs=0.02)


# ---- 6 ------------------------------------------------------------------------------------------

def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(6)
    m = r.standard_normal((400, 8)).astype(np.float32)
    m[100:180] = m[100]
    rows = [(i, v.tolist(), 0, 1.0) for i, v in enumerate(m)] + [(400, None, 0, 1.0), (401, [0.0] * 8, 0, 1.0), (402, [float("nan")] * 8, 0, 1.0), (403, [1.0] * 3, 0, 1.0), (405, [None] * 8, 0, 1.0), (None, m[0].tolist(), 0, 1.0), (20, m[20].tolist(), 0, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")
    got = {}
    for x in ann.search(df, wanted=10**6).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    d = m.astype(float)
    assert set(got) == set(range(0, 400, 20))
    for q, found in got.items():
        s = (d * d[q]).sum(1)
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:20]
        assert [i for _, i, _ in sorted(found)] == want and [k for k, _, _ in sorted(found)] == list(range(1, 21))
        assert np.allclose([x for *_, x in sorted(found)], s[want], atol=1e-12)
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id in (0, 1, 2)")).count() == 2


def test_walk_goes_down_and_stops():
    a, b, counts = np.array([0.5, 2.0, 1.0]), np.array([0.1, 0.9]), np.array([1, 2, 3, 4, 0, 6])
    order = sorted(range(6), key=lambda c: -(a[c // 2] + b[c % 2]))
    assert ann.walk(a, b, counts, 10**6) == [c for c in order if counts[c]]
    assert ann.walk(a, b, counts, 5) == [c for c in order if counts[c]][:2]


# ---- 8 ------------------------------------------------------------------------------------------

def test_archives(spark, tmp_path):
    big, small = "<p>" + "x" * 200, "tiny"
    rows = [(5, "http://a/%0A\nb", big, 1), (3, "http://b", big, 1), (9, None, big, 1), (4, "u", small, 1), (6, "u", small, 1), (7, "u", None, 1), (8, "u", "", 1), (None, "n", big, 1), (3, "http://b", big, 1), (10, "é", "é" * 60, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    index = warc.write_archives(df, str(tmp_path / "w"), file_bytes=200)
    got = warc.read_records(index, str(tmp_path / "w")).collect()
    want = sorted((str(p), str(u), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == big and p != 3 else "response", str(3 if h == big and p != 3 else None)) for p, u, h, _ in rows)
    assert sorted((str(r.page_id), str(r.url), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == want
    assert all(bytes(r.payload) == big.encode() for r in got if r.page_id == 3)
    some = warc.read_records(index.where("page_id = 10"), str(tmp_path / "w")).collect()
    assert [bytes(r.payload).decode() for r in some] == ["é" * 60]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_requests_are_coalesced():
    assert list(warc._requests([0, 10, 30, 1000, 1010], [10, 10, 10, 10, 10], 20, 10**6)) == [(0, 3), (3, 5)]
    assert list(warc._requests([0, 10, 20], [10, 10, 10], 20, 20)) == [(0, 2), (2, 3)]


# ---- 9 ------------------------------------------------------------------------------------------

def test_leaks_against_planted_items(spark):
    r = np.random.default_rng(9)
    items = [prose(int(r.integers(15, 50)), r) for _ in range(12)] + [None, "", "?!"]
    texts = [prose(300, r) for _ in range(40)]
    planted = {}
    for i in range(10):
        w = texts[i].split()
        at = int(r.integers(0, 250))
        item = items[i].split()
        if i % 2:
            item[len(item) // 2] = "other"
        texts[i] = " ".join(w[:at] + item + w[at:]).upper() if i % 3 == 0 else ", ".join(w[:at] + item + w[at:])
        planted[i] = i
    texts += [None, "", " . ", items[11]]
    planted[43] = 11
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, rk int")
    df = docs_of(spark, texts).union(docs_of(spark, texts).where("doc_id = 1"))
    got = decontaminate.contamination(df, bench)
    rows = got.collect()
    assert len(rows) == len(texts) + 1
    assert {x.doc_id: x.item_id for x in rows if x.contaminated} == planted
    blocks = decontaminate.contamination(df, bench, items=5).collect()
    assert {x.doc_id: x.item_id for x in blocks if x.contaminated} == planted
    kept = decontaminate.without_leaks(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == set(range(len(texts))) - set(planted)
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(spark.createDataFrame([], EMPTY), bench).count() == 0


def leaked(spark, items, texts, **options):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {x.doc_id: x.item_id for x in decontaminate.contamination(docs_of(spark, texts), bench, **options).collect() if x.contaminated}


def test_long_items_are_found(spark):
    r = np.random.default_rng(31)
    wide = [f"t{i}" for i in range(4000)]
    items = [" ".join(r.choice(wide, 500, replace=False)) for _ in range(6)] + [prose(30, r) for _ in range(30)]
    texts = [prose(100, r) + f" {items[i]} " + prose(100, r) for i in range(6)] + [prose(300, r) for _ in range(20)]
    assert leaked(spark, items, texts) == {i: i for i in range(6)}


def test_repeated_and_templated_items_are_found(spark):
    r = np.random.default_rng(32)
    items = [prose(30, r) for _ in range(40)]
    near = [items[0].rsplit(" ", 1)[0] + f" end{i}" for i in range(20)]
    texts = [prose(100, r) + f" {items[0]} " + prose(100, r)] + [prose(300, r) for _ in range(20)]
    for more in ([items[0]] * 20, near):
        assert set(leaked(spark, items + more, texts)) == {0}
    assert set(leaked(spark, [items[0], items[0], items[1]], texts)) == {0}


def test_short_items_among_benchmark_words_are_found(spark):
    r = np.random.default_rng(33)
    wide = [f"t{i}" for i in range(3000)]
    items = [" ".join(r.choice(wide, 6 + i % 5, replace=False)) for i in range(60)] + [" ".join(r.choice(wide, 40)) for _ in range(300)]
    texts = [" ".join([*r.choice(wide, 60), items[i], *r.choice(wide, 60)]) for i in range(60)] + [" ".join(r.choice(wide, 300)) for _ in range(20)]
    # No cosine that a passage of other benchmark words reaches.
    assert leaked(spark, items, texts, cosine=0.95) == {i: i for i in range(60)}


# ---- 10 -----------------------------------------------------------------------------------------

def test_urls(spark):
    u = ["http://a.ORG/x", "https://example.org/es/1?q", "http://www.example.org/en/12#f", "http://example.org/en/2", "http://xexample.org/es/", "ftp://m.site.net/p/", "http://site.net/p", "http://site.net", "nothing", None,
         "http://b.com/de/1", "http://b.com/fr", "://", "http://HOST.net?x=/a", "http://org", "http://c.com/fr/"]
    df = spark.createDataFrame([(i, x, "clash", 3) for i, x in enumerate(u)] + [(5, u[5], "clash", 3)], "page_id long, url string, rule string, block int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, df.where("page_id in (5, 9)")).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow") and got[1] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("www.example.org", "/en/12", "example.org/en/1", "block") and got[3][2:] == ("org/", "allow") and got[4][2:] == ("org/", "allow")
    assert got[5] == ("m.site.net", "/p/", None, "block") and got[6] == ("site.net", "/p", None, "block") and got[7][2:] == (None, "allow")
    assert got[8] == ("", "", None, "allow") == got[9] and got[10][2:] == ("com/de/", "block") and got[11][2:] == (None, "allow")
    assert got[12] == ("", "", None, "allow") and got[13] == ("host.net", "", None, "allow") and got[14][2:] == (None, "allow") and got[15][2:] == ("com/fr/", "allow")
    assert urls.filter_urls(df, df.limit(0)).where("verdict = 'block'").count() == 3
    assert urls.filter_urls(df.limit(0), df).count() == 0


def test_filter_misses_nothing_and_the_join_removes_the_rest(spark):
    pages = spark.range(4000).selectExpr("id as page_id", "concat('http://h', id, '.net/p') as url")
    out = urls.filter_urls(pages, pages.where("page_id % 7 = 0"))
    assert {r.page_id for r in out.where("verdict = 'block'").collect()} == set(range(0, 4000, 7))
