"""Benchmark decontamination by latent semantic retrieval, checked by common subsequences and answers.

Texts are read as words (runs of letters and digits, A-Z lower-cased). A passage is PASSAGE words; the matrix has
one for every PASSAGE words, the search one for every STRIDE. Terms are the benchmark's words but for those of more than STOP_SHARE of its
different items; an item that is left with less than LEFT of its words, or fewer than TERMS, keeps them all. The TF-IDF
matrix of all passages (idf counted over all of them) gets a randomised SVD: each task multiplies its rows with one
Gaussian matrix and back, the sums (terms x rank) meet by term, and the Nystrom formula gives singular values and
right vectors from them in one pass. Passages and items, these in parts of PASSAGE words, are compared by cosine in that space; pairs of COSINE or more
that share TERM_SHARE of the part's terms are candidates, and so are passages that hold STRETCH_SHARE of the different terms of STRIDE
words of an item, whatever else stands in them. A candidate's words, taken with as many around it as the item has, are held against the item by their longest
common subsequence: LEAK of the item's words or more is a leak; PARAPHRASE or more is one if the answer (the item's last ANSWER
words) is there in order as well. Items of fewer words than ANSWER are too short to tell a leak from chance: they leak nothing.

A text is tokenised once for each block of items; from there on it is the places of the words that the block's items have, which is all that
the matrix, the search and the check look at. A block has at most ITEMS items and about MOST_WORDS different words: what the tasks are
given (a row of the rank's length for each term) and what the driver gathers are bounded by that. Words are counted as one where they
are the same 64-bit hash. Of a very long text the words are held whole.

Nulls and empty texts leak nothing, nor do null, empty or wordless items. Repeated rows are judged alike; items with equal texts are
searched for once and count as items each (the least id speaks for them). Empty tables: nothing leaks. Null ids stay null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_scratch, materialise
from ._text import HashIndex, lean, text_chunks, word_hashes
from .quality import _KIND, _LOWER

PASSAGE, STRIDE = 48, 24
STOP_SHARE = 0.1
#: An item that would lose more of its different words than this leaves keeps them all.
LEFT = 0.5
RANK, OVERSAMPLE = 128, 16
COSINE = 0.4
#: Half the words in common, half of an item's part in its best passage.
TERM_SHARE = 0.25
#: Of the different terms of STRIDE words of an item: such a passage is a candidate at any cosine.
STRETCH_SHARE = 0.6
LEAK, PARAPHRASE, ANSWER = 0.8, 0.5, 5
ITEMS = 10_000
MOST_WORDS = 50_000
#: Words of texts whose passages are held at once (a longer single text is held whole).
SLICE_WORDS = 1 << 17
#: A passage with fewer different terms is not looked up, unless an item has as few.
TERMS = 3


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and each text's first word's index (with the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    word = _KIND[data] == 1
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return word_hashes(_LOWER[data], s, np.flatnonzero(end) + 1), np.searchsorted(s, off)


def pieces(seqs: list[np.ndarray], size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each sequence in parts of `size` words, the last of which ends with it: their sequences' numbers and the parts."""
    cut = [(i, max(0, min(lo, len(s) - size)), s) for i, s in enumerate(seqs) for lo in range(0, len(s), size)]
    return np.array([i for i, _, _ in cut], np.int64), [s[lo : lo + size] for _, lo, s in cut]


class Benchmark:
    """One block of items: their word sequences, the different words, which of them are terms and, once known, vectors."""

    def __init__(self, ids: list, texts: list[str | None], stop_share: float = STOP_SHARE, least: int = ANSWER):
        self.ids, seqs = [], []
        column = pa.array([t or "" for t in texts], pa.string())
        for lo, hi, data, off in text_chunks(column):
            h, first = words(data, off)
            for i in range(hi - lo):
                if first[i + 1] - first[i] >= least:
                    self.ids.append(ids[lo + i])
                    seqs.append(h[first[i] : first[i + 1]])
        self.words = np.unique(np.concatenate(seqs or [np.zeros(0, np.uint64)]))
        self.seqs = [np.searchsorted(self.words, s) for s in seqs]
        # An item given twice is counted once.
        own = [np.unique(s) for s in {s.tobytes(): s for s in self.seqs}.values()]
        df = np.bincount(np.concatenate(own or [np.zeros(0, np.int64)]), minlength=len(self.words))
        self.term = df <= max(1, stop_share * len(own))
        rare = self.term.copy()
        for w in own:
            if rare[w].sum() < max(TERMS, LEFT * len(w)):
                self.term[w] = True


def _piece_terms(bench: Benchmark, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, term, count) triples in order."""
    a = [(i, *x) for i, s in enumerate(parts) for x in zip(*np.unique(s[bench.term[s]], return_counts=True), strict=True)]
    p, t, c = (np.array(x, np.int64) for x in zip(*a, strict=True)) if a else (np.zeros(0, np.int64),) * 3
    return p, t, c


def _words_of(bench: Benchmark):
    """Rows (key, text): the places of the items' words in each text that has any, and which words they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex(bench.words)
        for b in batches:
            for lo, hi, data, off in text_chunks(b.column("text")):
                h, first = words(data, off)
                t = index.find(h)
                at = np.flatnonzero(t >= 0)
                row = np.searchsorted(first, at, "right") - 1
                cut = np.searchsorted(at, first)
                some = pa.array(np.flatnonzero(np.diff(cut)))
                lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x.astype(np.int32))).take(some) for x in (at - first[row], t[at])]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo).take(some) for c in ("x", "y")), *lists], names=["x", "y", "place", "word"])
    return lean(run)


def passages(b: pa.RecordBatch, term: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, count) triples in order, and each passage's row in b and its number in the text."""
    place, word = b.column("place"), b.column("word")
    row = np.repeat(np.arange(b.num_rows), np.asarray(place.value_lengths()))
    p, t = np.asarray(place.flatten()).astype(np.int64), np.asarray(word.flatten()).astype(np.int64)
    real = term[t]
    row, p, t = row[real], p[real], t[real]
    here = p // stride
    reach = PASSAGE // stride
    parts = [(row[m], (here - back)[m], t[m]) for back in range(reach) for m in [here >= back]]
    row, number, t = (np.concatenate(x) for x in zip(*parts, strict=True))
    most = int(number.max(initial=0)) + 1
    width = len(term)
    pair, count = np.unique((row * most + number) * width + t, return_counts=True)
    where, t = pair // width, pair % width
    # Passages stand together: their numbers are running counts of changes.
    new = np.r_[True, where[1:] != where[:-1]] if len(where) else np.zeros(0, bool)
    own = where[new]
    return np.cumsum(new) - 1, t, count, own // most, own % most


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_WORDS words: their passages fit in a worker's memory many times over."""
    for b in batches:
        off = np.asarray(b.column("place").offsets)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_WORDS, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def _df(term: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(term), np.int64), 0
        for b in _small(batches):
            _, t, _, own, _ = passages(b, term, PASSAGE)
            total += np.bincount(t, minlength=len(total))
            n += len(own)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[total[at], n])], names=["term", "n"])
    return lean(run)


def _weights(passage: np.ndarray, t: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF of the triples, rows of length one."""
    w = (1 + np.log(count)) * idf[t]
    norm = np.sqrt(np.bincount(passage, weights=w * w, minlength=n))
    return w / np.maximum(norm, 1e-12)[passage]


#: Bytes of gathered rows that one product takes: they stay in a core's cache.
CACHE_BYTES = 1 << 20


def _rows_times(passage: np.ndarray, t: np.ndarray, w: np.ndarray, by_term: np.ndarray, n: int) -> np.ndarray:
    """The sparse rows (in order of passage) times by_term: rows of one size are one stack of products."""
    out = np.zeros((n, by_term.shape[1]), np.float32)
    size = np.bincount(passage, minlength=n)
    start = np.cumsum(size) - size
    w = w.astype(np.float32)
    by = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(size[by]) != 0, True]) if n else []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        k = int(size[by[a]])
        step = max(1, CACHE_BYTES // max(1, 4 * k * by_term.shape[1]))
        for lo in range(a, b if k else a, step):
            rows = by[lo : min(lo + step, b)]
            at = start[rows][:, None] + np.arange(k)
            out[rows] = np.matmul(w[at][:, None, :], by_term[t[at]])[:, 0]
    return out


def _gram(term: np.ndarray, idf: np.ndarray, omega: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(omega.shape, np.float64)
        for b in _small(batches):
            passage, t, count, own, _ = passages(b, term, PASSAGE)
            w = _weights(passage, t, count, idf, len(own))
            y = _rows_times(passage, t, w, omega, len(own))
            by = np.argsort(t, kind="stable")
            here, t = np.unique(t[by], return_inverse=True)
            total[here] += _rows_times(t, passage[by], w[by], y, len(here))
        at = np.flatnonzero(total.any(axis=1))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * omega.shape[1]), pa.array(total[at].ravel().astype(np.float32)))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), rows], names=["term", "row"])
    return lean(run)


def latent_space(compact: DataFrame, term: np.ndarray, idf: np.ndarray, rank: int = RANK, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors: terms x rank, singular values) of all passages' TF-IDF rows."""
    d = len(idf)
    r = min(rank + OVERSAMPLE, d)
    omega = np.random.default_rng(seed).standard_normal((d, r)).astype(np.float32)
    # A row for each term, added up by term before the driver sees it.
    sums = compact.mapInArrow(_gram(term, idf, omega), "term int, row array<float>").groupBy("term").agg(*[F.sum(F.col("row")[i].cast("double")).alias(f"c{i}") for i in range(r)]).toArrow()
    g = np.zeros((d, r))
    if sums.num_rows:
        g[sums.column("term").to_numpy()] = np.column_stack([sums.column(f"c{i}").to_numpy() for i in range(r)])
    # Nystrom: A'A is close to G (O'G)^-1 G', for G = A'A O.
    o = omega.astype(np.float64)
    shift = 1e-9 * max(np.linalg.norm(g), 1e-9)
    g = g + shift * o
    c = o.T @ g
    lam, u = np.linalg.eigh((c + c.T) / 2)
    good = lam > max(lam.max(initial=0), 0) * 1e-10
    f = g @ (u[:, good] / np.sqrt(lam[good]))
    v, s, _ = np.linalg.svd(f, full_matrices=False)
    return v[:, :rank], np.sqrt(np.maximum(s[:rank] ** 2 - shift, 0))


class Stretches:
    """The items in parts of STRIDE words, each of which stands whole in some passage, to be looked up by shared terms."""

    def __init__(self, bench: Benchmark, df: np.ndarray):
        self.owner, parts = pieces(bench.seqs, STRIDE)
        p, t, _ = _piece_terms(bench, parts)
        self.n_terms = len(df)
        self.codes = p * self.n_terms + t
        size = np.bincount(p, minlength=len(parts))
        self.need = np.maximum(np.ceil(STRETCH_SHARE * size - 1e-9), 1).astype(np.int64)
        # Whoever has `need` of a part's terms has one of its size - need + 1 rarest.
        by = np.lexsort((t, df[t], p))
        rank = np.arange(len(by)) - np.repeat(np.cumsum(size) - size, size)
        by = by[rank < (size - self.need + 1)[p[by]]]
        by = by[np.argsort(t[by], kind="stable")]
        self.part = p[by]
        self.first = np.searchsorted(t[by], np.arange(self.n_terms + 1))

    def met(self, passage: np.ndarray, t: np.ndarray, n: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passage, item) pairs that share STRETCH_SHARE of a part's terms; (passage, t) in order."""
        posts = self.first[t + 1] - self.first[t]
        begin = np.searchsorted(passage, np.arange(n + 1))
        total = np.r_[0, np.cumsum(posts)][begin]
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
            at = np.arange(begin[lo], begin[hi])
            at = at[posts[at] > 0]
            if len(at):
                c = posts[at]
                post = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c - self.first[t[at]], c)
                pair = np.unique(np.repeat(passage[at], c) * len(self.need) + self.part[post])
                p, part = pair // len(self.need), pair % len(self.need)
                for cut in range(0, len(pair), most // 16):
                    q, own = p[cut : cut + most // 16], part[cut : cut + most // 16]
                    k = begin[q + 1] - begin[q]
                    inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k - begin[q], k)
                    code = np.repeat(own, k) * self.n_terms + t[inside]
                    hit = self.codes[np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)] == code
                    good = np.bincount(np.repeat(np.arange(len(q)), k), weights=hit, minlength=len(q)) >= self.need[own]
                    if good.any():
                        yield q[good], self.owner[own[good]]
            lo = hi


def subsequence(places: dict[int, int], n: int, inside: list[int]) -> int:
    """Length of the longest common subsequence of `inside` and a sequence of n words given by the bits of each word's places."""
    ones = row = (1 << n) - 1
    for y in inside:
        m = places.get(y)
        if m is not None:
            u = row & m
            if u:
                row = ((row + u) | (row - u)) & ones
    return n - row.bit_count()


def _bits(seq: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(seq):
        out[x] = out.get(x, 0) | 1 << i
    return out


class Judge:
    """How much of an item a window of a text has: the share of its words in order where that is a leak, else 0."""

    def __init__(self, bench: Benchmark, leak: float, paraphrase: float, answer: int):
        self.items = [(len(s), _bits(s.tolist()), len(s[-answer:]), _bits(s[-answer:].tolist())) for s in bench.seqs]
        self.leak, self.paraphrase = leak, paraphrase

    def __call__(self, item: int, inside: list[int]) -> float:
        n, places, tail, tail_places = self.items[item]
        if len(inside) < self.paraphrase * n:
            return 0.0
        share = subsequence(places, n, inside) / n
        if share >= self.leak or share >= self.paraphrase and subsequence(tail_places, tail, inside) == tail:
            return share
        return 0.0


def _find(bench: Benchmark, idf: np.ndarray, v: np.ndarray, df: np.ndarray, cosine: float, leak: float, paraphrase: float, answer: int):
    """Rows (x, y, item, share) of the texts that leak, from rows of _words_of()."""
    term = bench.term
    owner, parts = pieces(bench.seqs, PASSAGE)
    part, part_term, part_count = _piece_terms(bench, parts)
    basis = v.astype(np.float32)
    vectors = _rows_times(part, part_term, _weights(part, part_term, part_count, idf, len(parts)), basis, len(parts))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
    codes = np.sort(part * len(idf) + part_term)
    n_terms = np.bincount(part, minlength=len(parts))
    least_terms = max(1, int(min([TERMS, *n_terms])))
    stretches = Stretches(bench, df)

    def shared(item: np.ndarray, p: np.ndarray, start: np.ndarray, size: np.ndarray, t: np.ndarray) -> np.ndarray:
        n = size[p]
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(first - start[p], n)
        code = np.repeat(item.astype(np.int64), n) * len(idf) + t[at]
        hit = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
        return np.bincount(np.repeat(np.arange(len(p)), n), weights=hit, minlength=len(p))

    def met(passage: np.ndarray, t: np.ndarray, count: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passage, item) pairs that the check must look at."""
        yield from stretches.met(passage, t, n)
        size = np.bincount(passage, minlength=n)
        start = np.cumsum(size) - size
        z = _rows_times(passage, t, _weights(passage, t, count, idf, n), basis, n)
        z /= np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
        rows = np.flatnonzero(size >= least_terms)
        for lo in range(0, len(rows), 4096):
            some = rows[lo : lo + 4096]
            for at in range(0, len(vectors), 1024):
                p, i = np.nonzero(z[some] @ vectors[at : at + 1024].T >= cosine)
                if len(p):
                    near = shared(at + i, some[p], start, size, t) >= TERM_SHARE * n_terms[at + i]
                    yield some[p[near]], owner[at + i[near]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bench, leak, paraphrase, answer)
        length = np.array([len(s) for s in bench.seqs])
        for b in _small(batches):
            passage, t, count, own, number = passages(b, term)
            found = [np.stack(x) for x in met(passage, t, count, len(own))]
            best: dict[tuple[int, int], float] = {}
            if found:
                p, item = np.unique(np.concatenate(found, axis=1), axis=1)
                row, number = own[p], number[p]
                off = np.asarray(b.column("place").offsets).astype(np.int64)
                off -= off[0]
                place = np.asarray(b.column("place").flatten()).astype(np.int64)
                # Words by row and place: a window's are a slice of them.
                reach = int(place.max(initial=0)) + int(length.max()) + PASSAGE + 1
                line = np.repeat(np.arange(b.num_rows), np.diff(off)) * (2 * reach) + place
                base = row * (2 * reach)
                lo = np.searchsorted(line, base + np.maximum(0, number * STRIDE - length[item]))
                hi = np.searchsorted(line, base + number * STRIDE + PASSAGE + length[item])
                word = np.asarray(b.column("word").flatten()).tolist()
                for r, i, x, y in zip(row.tolist(), item.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    had = best.get((r, i), 0.0)
                    if had < 1.0:
                        share = judge(i, word[x:y])
                        if share > had:
                            best[r, i] = share
            rows = pa.array([r for r, _ in best], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("x").take(rows), b.column("y").take(rows), pa.array([i for _, i in best], pa.int32()), pa.array(list(best.values()), pa.float64())], names=["x", "y", "item", "share"])
    return lean(run)


def _row_key(key: str, body) -> list:
    """Two hashes of a row's key and text."""
    return [F.xxhash64(F.col(f"`{key}`"), body), F.xxhash64(F.lit(1), F.col(f"`{key}`"), body)]


def _body(text: str):
    return F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
          rank: int = RANK, cosine: float = COSINE, leak: float = LEAK, paraphrase: float = PARAPHRASE, answer: int = ANSWER, items: int = ITEMS, most_words: int = MOST_WORDS) -> DataFrame:
    """(x, y, item, items, share): every leak found, by the row key of _row_key(); item is the least key of the items with one text, items how many they are."""
    x, y = _row_key(key, _body(text))
    keyed = docs.select(x.alias("x"), y.alias("y"), _body(text).alias("text"))
    kind = benchmark.schema[item_key].dataType.simpleString()
    distinct = (benchmark.select(F.col(f"`{item_key}`").alias("k"), F.col(f"`{item_text}`").alias("t")).where("t is not null").groupBy("t").agg(F.min("k").alias("k"), F.count("*").alias("n")))
    word = F.explode(F.split(F.lower("t"), r"[^\p{L}\p{N}_]+"))
    n_items = distinct.count()
    n_words = distinct.select(word.alias("w")).agg(F.approx_count_distinct("w")).first()[0]
    blocks = max(1, -(-n_items // items), -(-n_words // most_words))
    out = None
    for block in range(blocks):
        mine = distinct.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block) if blocks > 1 else distinct
        # `items` rows of different texts on average: the block is bounded by that parameter.
        rows = mine.orderBy("k", "t").collect()
        found = _leaks_of(keyed, Benchmark([(r["k"], r["n"]) for r in rows], [r["t"] for r in rows], least=answer), rank, cosine, leak, paraphrase, answer, kind)
        out = found if out is None else out.union(found)
    return out


def _leaks_of(keyed: DataFrame, bench: Benchmark, rank: int, cosine: float, leak: float, paraphrase: float, answer: int, kind: str) -> DataFrame:
    """The block's leaks, written."""
    spark = keyed.sparkSession
    if not bench.seqs:
        return spark.createDataFrame([], f"x long, y long, item {kind}, items long, share double")
    compact = materialise(keyed.mapInArrow(_words_of(bench), "x long, y long, place array<int>, word array<int>"), "words")
    counts = compact.select("place", "word").mapInArrow(_df(bench.term), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term
    df, n = np.zeros(len(bench.words)), 0
    for r in counts:
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    v, _ = latent_space(compact.select("place", "word"), bench.term, idf, rank)
    found = compact.mapInArrow(_find(bench, idf, v, df, cosine, leak, paraphrase, answer), "x long, y long, item int, share double")
    names = spark.createDataFrame([(i, *k) for i, k in enumerate(bench.ids)], f"i int, item {kind}, items long")
    # The names are a block's items: bounded.
    out = materialise(found.withColumnRenamed("item", "i").join(F.broadcast(names), "i").select("x", "y", "item", "items", "share"), "leaks")
    drop_scratch(spark, compact)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, contaminated, item_id, share, n_items): a row for each of docs; the item is that with the largest share, ties to the smaller id."""
    found = leaks(docs, benchmark, key, text, **options).distinct()
    best = found.groupBy("x", "y").agg(F.min(F.struct((-F.col("share")).alias("s"), "item")).alias("best"), F.sum("items").alias("n"))
    x, y = _row_key(key, _body(text))
    rows = docs.select(F.col(f"`{key}`").alias("key"), x.alias("x"), y.alias("y"))
    return rows.join(best, ["x", "y"], "left").select(
        F.col("key").alias(key), F.col("best").isNotNull().alias("contaminated"), F.col("best.item").alias("item_id"),
        (-F.col("best.s")).alias("share"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs in which no leak was found."""
    found = materialise(leaks(docs, benchmark, key, text, **options).selectExpr("x as __x", "y as __y").distinct(), "leaking")
    x, y = _row_key(key, _body(text))
    return docs.withColumn("__x", x).withColumn("__y", y).join(found, ["__x", "__y"], "left_anti").select(*docs.columns)
