"""Near-duplicate texts by order min-hashing, verified by a banded alignment.

A text is the sequence of its k-word shingles (lower case, words parted by ASCII white space; a text
of fewer words is one shingle), each labelled with how often it has occurred before. For each of
BANDS hash functions the LABELS labelled shingles with the least hashes are put in text order, and
their sequence is the band's key: equal for texts that share those shingles in the same order. Texts
of at most SHORT shingles also have keys for their whole sequence and for it with any one left out, which
finds every pair that is similar enough at that length.

Texts that share a key are not paired with each other. Of the texts of a key the one that meets most
others is its leader, and the keys of one leader are one group. Each text is first aligned with the leader it
met most often; links make components. In groups that then hold several components, all that lies outside the
largest one is held against the whole group in blocks of bounded size: shared shingles are counted for
a block of pairs at once, as a product of matrices, and only pairs that could reach `similarity` and are not yet in
one component are aligned. So two texts that share a key end in one class or cannot be similar enough.

The alignment is the longest common subsequence of shingles inside a band that every pair of enough similarity
fits in; similarity is common / (n1 + n2 - common), two texts being linked at `similarity` or more.

Equal texts are one node throughout (told apart by 128 bits), and get their class at the end. A class is a connected
component of the links; its id is its least document id.

Nulls and texts without a word are classes of their own. A null id stays null and can not name a class
while another id is there. Repeated rows are equal texts. The empty table gives an empty result. Of
other columns none is read. Of a very long text its shingles are held whole (8 bytes each), its sketch in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop_scratch, materialise
from ._text import group_starts, lean, mix, prefix_sums, span_hash, text_chunks, word_hashes, word_spans
from .components import components

WORDS = 5
SIMILARITY = 0.8
#: A pair at 0.8 meets in one band with probability 0.8 ** 4 (a little less where the texts are short), and in none of 20 with 3e-5.
BANDS = 20
LABELS = 4
#: Texts of so many shingles and fewer have keys that find all pairs at SIMILARITY.
SHORT = 8
#: Shingles whose band hashes are held at once.
SKETCH_BLOCK = 8192
#: Texts, and shingles of texts, that a block of a group holds on either side (a longer single text makes a larger block).
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Texts that are aligned with one copy of their leader.
FOLLOWERS = 1024

_U = np.uint64
_KEY = "x long, y long"


def shingles(data: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and where each text's begin (with the end of the last)."""
    s, e, first = word_spans(data, off)
    words = word_hashes(data, s, e)
    p = prefix_sums(words)
    n = np.diff(first)
    m = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.r_[0, np.cumsum(m)]
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], m) + np.repeat(first[:-1], m)
    return span_hash(p, at, np.minimum(at + k, np.repeat(first[1:], m))), begin


def labelled(sh: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Each shingle with its occurrence in its text: a text's are all different, and sets of them count as multisets."""
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    own = mix(sh ^ mix(row.astype(np.uint64) + _U(1)))
    order = np.argsort(own, kind="stable")
    start = group_starts(own[order])
    occurrence = np.empty(len(sh), np.uint64)
    occurrence[order] = (np.arange(len(sh)) - np.repeat(start, np.diff(np.r_[start, len(sh)]))).astype(np.uint64)
    return mix(sh + occurrence * _U(0x9E3779B97F4A7C15))


def _least_places(label: np.ndarray, factor: np.ndarray, k: int) -> np.ndarray:
    """For each factor the places of the k labels with the least products, in order of place."""
    if len(label) <= k:
        return np.broadcast_to(np.arange(len(label)), (len(factor), len(label)))
    best = np.zeros((len(factor), 0), np.int64)
    for lo in range(0, len(label), SKETCH_BLOCK):
        at = np.concatenate([best, np.broadcast_to(np.arange(lo, min(lo + SKETCH_BLOCK, len(label))), (len(factor), min(SKETCH_BLOCK, len(label) - lo)))], axis=1) if lo else None
        h = label[None, :SKETCH_BLOCK] * factor[:, None] if at is None else label[at] * factor[:, None]
        pick = np.argpartition(h, k - 1, axis=1)[:, :k]
        best = pick if at is None else np.take_along_axis(at, pick, 1)
    return np.sort(best, axis=1)


def sketch(sh: np.ndarray, begin: np.ndarray, bands: int = BANDS, labels: int = LABELS) -> tuple[np.ndarray, np.ndarray]:
    """(text index, key) pairs: `bands` keys for each text that has a shingle, and those of short texts."""
    n = np.diff(begin)
    label = labelled(sh, begin)
    factor = mix(np.arange(1, bands + 1, dtype=np.uint64)) | _U(1)
    full = np.flatnonzero(n)
    out = np.empty((len(full), bands), np.uint64)
    turn = mix(np.arange(101, 101 + max(labels, SHORT), dtype=np.uint64)) | _U(1)
    for i, t in enumerate(full):
        own = label[begin[t] : begin[t + 1]]
        least = _least_places(own, factor, labels)
        out[i] = (own[least] * turn[: least.shape[1]]).sum(axis=1, dtype=np.uint64)
    text, key = [np.repeat(full, bands)], [mix(mix(out) + factor).ravel()]
    # A pair at 0.8 or more of which one has at most SHORT - 1 shingles differs by one that is left out.
    for size in range(4, SHORT + 1):
        rows = np.flatnonzero(n == size)
        if len(rows):
            own = label[begin[rows][:, None] + np.arange(size)]
            for left in range(size + 1):
                part = np.delete(own, left, axis=1) if left < size else own
                text.append(rows)
                key.append(mix(mix((part * turn[: part.shape[1]]).sum(axis=1, dtype=np.uint64)) + _U(1000 + part.shape[1])))
    return np.concatenate(text), np.concatenate(key)


def common_subsequence(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence in which matched places differ by `band` at most.

    One bit for each place of a that a step of b can reach: the row of bits moves along with the band, so a step costs the
    band's width, not the length of a.
    """
    place: dict = {}
    for i, x in enumerate(a):
        place.setdefault(x, []).append(i)
    often = {x: sum(1 << i for i in p) for x, p in place.items() if len(p) > 16}
    width = 2 * band + 1
    full = (1 << width) - 1
    # Bit i of row stands for place low + i of a; places that the band has left are counted in `found`.
    row, low, found, n = full, 0, 0, len(a)
    for j, y in enumerate(b):
        if j > band:
            found += not row & 1
            row = row >> 1 | 1 << width - 1
            low += 1
        p = place.get(y)
        if p is None:
            continue
        if y in often:
            m = often[y] >> low & full
        else:
            m = 0
            for i in p:
                if 0 <= i - low < width:
                    m |= 1 << i - low
        # Up to j + band only: in the first steps the row is wider than that.
        if j < band:
            m &= (1 << j + band + 1) - 1
        u = row & m
        if u:
            row = ((row + u) | (row - u)) & full
    return found + width - row.bit_count() if n else 0


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """common / (n1 + n2 - common) of two shingle sequences; 0.0 where it can not reach `least`."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    short = min(n, m)
    lead = int(np.argmin(np.r_[a[:short] == b[:short], False]))
    a, b, short = a[lead:], b[lead:], short - lead
    trail = int(np.argmin(np.r_[(a[len(a) - short :] == b[len(b) - short :])[::-1], False]))
    a, b = a[: len(a) - trail], b[: len(b) - trail]
    common = lead + trail
    need = least * (n + m) / (1 + least)
    if len(a) and len(b) and common < n + m:
        ua, ca = np.unique(a, return_counts=True)
        ub, cb = np.unique(b, return_counts=True)
        _, x, y = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
        if common + np.minimum(ca[x], cb[y]).sum() < need - 1e-9:
            return 0.0
        # An alignment with `need` matches leaves out so many places of either text at most.
        band = int(max(n, m) - need) + 1
        common += common_subsequence(a.tolist(), b.tolist(), band)
    s = common / (n + m - common)
    return s if s >= least - 1e-12 else 0.0


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many labelled shingles each of a has in common with each of b."""
    out = np.zeros((len(a), len(b)))
    _, code = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    sides = list(zip(rows, np.split(code, [len(rows[0])]), strict=True))
    n = int(code.max(initial=-1)) + 1
    held = [np.bincount(c, minlength=n) for _, c in sides]
    pairs = held[0] * held[1]
    # Shingles that many texts of both sides have go through a product of matrices, the others pair by pair.
    dense = pairs * 16 > len(a) * len(b)
    for lo in range(0, int(dense.sum()), 2048):
        column = np.full(n, -1)
        own = np.flatnonzero(dense)[lo : lo + 2048]
        column[own] = np.arange(len(own))
        m = [np.zeros((len(x), len(own)), np.float32) for x in (a, b)]
        for x, (r, c) in zip(m, sides, strict=True):
            at = column[c]
            x[r[at >= 0], at[at >= 0]] = 1
        out += m[0] @ m[1].T
    (ra, ca), (rb, cb) = sides
    keep_a, keep_b = ~dense[ca] & (pairs[ca] > 0), ~dense[cb] & (pairs[cb] > 0)
    ra, ca, rb, cb = ra[keep_a], ca[keep_a], rb[keep_b], cb[keep_b]
    by = np.argsort(cb, kind="stable")
    rb, cb = rb[by], cb[by]
    first = np.searchsorted(cb, ca)
    each = held[1][ca]
    upto = np.cumsum(each)
    lo = 0
    while lo < len(ca):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 20), "right")))
        e = each[lo:hi]
        at = np.arange(e.sum()) - np.repeat(np.cumsum(e) - e - first[lo:hi], e)
        out += np.bincount(np.repeat(ra[lo:hi], e) * len(b) + rb[at], minlength=out.size).reshape(out.shape)
        lo = hi
    return out


# ---- on the executors -----------------------------------------------------------------------

def _sketches(k: int, bands: int, labels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            _, one = np.unique(x ^ mix(y.view(np.uint64)).view(np.int64), return_index=True)  # copies in this batch are sketched once
            one = np.sort(one)
            x, y, texts = x[one], y[one], b.column(2).take(pa.array(one))
            for lo, hi, data, off in text_chunks(texts):
                sh, begin = shingles(data, off, k)
                text, key = sketch(sh, begin, bands, labels)
                n = np.diff(begin)[text].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(x[lo:hi][text]), pa.array(y[lo:hi][text]), pa.array(n)], names=["bucket", "x", "y", "n"])
    return lean(run)


def _sequences(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of each text, a chunk of texts at a time."""
    for lo, hi, data, off in text_chunks(column):
        sh, begin = shingles(data, off, k)
        for i in range(hi - lo):
            yield lo + i, sh[begin[i] : begin[i + 1]]


_LINKS = "ax long, ay long, bx long, by long"


def _links(pairs: list[tuple]) -> pa.RecordBatch:
    cols = zip(*pairs, strict=True) if pairs else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["ax", "ay", "bx", "by"])


def _follow(k: int, least: float):
    """Rows (lx, ly, salt, role, x, y, body) in order: a leader's text (role 0), then those that are aligned with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for b in batches:
            role, x, y, lx, ly = (b.column(c).to_pylist() for c in ("role", "x", "y", "lx", "ly"))
            found = []
            for i, seq in _sequences(b.column("body"), k):
                if not role[i]:
                    head = seq.copy()
                elif similarity(head, seq, least):
                    found.append((lx[i], ly[i], x[i], y[i]))
            yield _links(found)
    return lean(run)


def _block_links(rows: list[tuple], main: tuple, least: float) -> list[tuple]:
    """Links between labels that a block shows. rows: (side, text's key, label, shingles); side 0 lies outside the label `main`."""
    outer, every = ([r for r in rows if r[0] == s] for s in (0, 1))
    if not outer or not every:
        return []
    size = [np.array([len(r[3]) for r in s], float) for s in (outer, every)]
    total = size[0][:, None] + size[1][None, :]
    possible = np.minimum(size[0][:, None], size[1][None, :]) >= (least - 1e-9) * np.maximum(size[0][:, None], size[1][None, :])
    names = {n: i for i, n in enumerate({r[2] for r in rows})}
    label = [np.array([names[r[2]] for r in s]) for s in (outer, every)]
    possible &= label[0][:, None] != label[1][None, :]
    if possible.sum() > 4:
        own = []
        for s in (outer, every):
            begin = np.r_[0, np.cumsum([len(r[3]) for r in s])].astype(np.int64)
            marked = labelled(np.concatenate([r[3] for r in s]), begin)
            own.append([marked[a:e] for a, e in zip(begin[:-1], begin[1:], strict=True)])
        common = shared_counts(*own)
        possible &= common >= least / (1 + least) * total - 1e-9
    else:
        common = total
    i, j = np.nonzero(possible)
    by = np.argsort(-(common[i, j] / total[i, j]), kind="stable")
    up = list(range(len(names)))

    def top(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    found = []
    for p, q in zip(i[by].tolist(), j[by].tolist(), strict=True):
        a, c = outer[p], every[q]
        # Where both lie outside, each pair comes twice.
        if c[2] != main and c[1] < a[1]:
            continue
        s, t = top(names[a[2]]), top(names[c[2]])
        if s != t and similarity(a[3], c[3], least):
            up[s] = t
            found.append((*a[2], *c[2]))
    return found


def _cross(k: int, least: float):
    """Rows (lx, ly, o, e, side, x, y, labelx, labely, mainx, mainy, body), a block's rows together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        here = main = None
        for b in batches:
            names = ("lx", "ly", "o", "e", "side", "x", "y", "labelx", "labely", "mainx", "mainy")
            rows = list(zip(*(b.column(c).to_pylist() for c in names), strict=True))
            found = []
            for i, seq in _sequences(b.column("body"), k):
                r = rows[i]
                if r[:4] != here:
                    found += _block_links(held, main, least)
                    held, here, main = [], r[:4], r[9:]
                held.append((r[4], r[5:7], r[7:9], seq.copy()))
            yield _links(found)
        yield _links(_block_links(held, main, least))
    return lean(run)


# ---- the operator ------------------------------------------------------------------------------

def with_text_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __body (lower case, bytes) and __tk, two hashes of the text; both null where it has no word."""
    body = F.lower(F.col(f"`{text}`"))
    worded = body.rlike(r"[^\x20\x09-\x0D]")
    key = F.struct(F.xxhash64(body).alias("x"), F.xxhash64(F.lit(1), body).alias("y"))
    return docs.withColumn("__body", F.when(worded, body.cast("binary"))).withColumn("__tk", F.when(worded, key))


def _blocks(count: str, shingle: str) -> str:
    return f"cast(1 + greatest({count} div {BLOCK}, {shingle} div {BLOCK_SHINGLES}) as int)"


def text_classes(docs: DataFrame, text: str = "text", k: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, labels: int = LABELS) -> DataFrame:
    """(node, label): the component of each text key that is linked to another."""
    spark = docs.sparkSession
    keyed = with_text_key(docs.select(F.col(f"`{text}`").alias("text"))).where("__tk is not null").selectExpr("__tk.x as x", "__tk.y as y", "__body as body")
    met = materialise(keyed.mapInArrow(_sketches(k, bands, labels), f"bucket long, {_KEY}, n int"), "buckets")
    several = (met.groupBy("bucket").agg(F.count("*").alias("c"), *(f(c).alias(f"{f.__name__}{c}") for f in (F.min, F.max) for c in "xy"))
               .where("minx <> maxx or miny <> maxy").select("bucket", "c"))
    shared = materialise(met.join(several, "bucket").distinct(), "shared")
    drop_scratch(spark, met)

    # Leaders: the text of a key that meets most others. Keys of one leader make one group.
    ranked = shared.withColumn("meets", F.sum("c").over(Window.partitionBy("x", "y")))
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("meets", "x", "y")).alias("top")).selectExpr("bucket", "top.x as lx", "top.y as ly")
    votes = materialise(ranked.join(leaders, "bucket").groupBy("lx", "ly", "x", "y").agg(F.count("*").alias("votes"), F.first("n").alias("n")), "votes")
    drop_scratch(spark, shared)
    # One text for each node; copies are folded before they are shuffled. Joins with texts are merge joins at every
    # size: the plan does not change (nor its growth bend) where a few nodes would fit a broadcast.
    named = votes.select("x", "y").distinct()
    texts = materialise(keyed.join(named.hint("merge"), ["x", "y"], "left_semi").groupBy("x", "y").agg(F.first("body").alias("body")), "texts")

    best = (votes.where("x <> lx or y <> ly").groupBy("x", "y").agg(F.max(F.struct("votes", "lx", "ly")).alias("best")).selectExpr("x", "y", "best.lx as lx", "best.ly as ly"))
    fan = best.groupBy("lx", "ly").agg((1 + F.expr(f"count(*) div {FOLLOWERS}")).cast("int").alias("blocks"))
    followers = best.join(fan, ["lx", "ly"]).selectExpr("lx", "ly", "pmod(xxhash64(x, y), blocks) as salt", "1 as role", "x", "y")
    heads = fan.selectExpr("lx", "ly", "explode(sequence(0, blocks - 1)) as salt", "0 as role", "lx as x", "ly as y").withColumn("salt", F.col("salt").cast("long"))
    line = followers.unionByName(heads).hint("merge").join(texts, ["x", "y"]).repartition("lx", "ly", "salt").sortWithinPartitions("lx", "ly", "salt", "role")
    links = materialise(line.select("lx", "ly", "role", "x", "y", "body").mapInArrow(_follow(k, least), _LINKS), "links")
    ends = (F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("a"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")).alias("b"))
    found = components(links.select(*ends))

    # Groups that hold several components: what lies outside the largest against all, block by block.
    own = F.coalesce(F.col("label"), F.struct("x", "y"))
    placed = votes.join(found.selectExpr("node.x as x", "node.y as y", "label"), ["x", "y"], "left").select("lx", "ly", "x", "y", "n", own.alias("label"))
    parts = placed.groupBy("lx", "ly", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    groups = (parts.groupBy("lx", "ly").agg(F.max(F.struct("c", "n", "label")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
              .selectExpr("lx", "ly", "top.label as main", f"{_blocks('c', 'n')} as every", f"{_blocks('(c - top.c)', '(n - top.n)')} as outer"))
    rows = placed.join(groups, ["lx", "ly"]).hint("merge").join(texts, ["x", "y"])
    flat = ["lx", "ly", "o", "e", "side", "x", "y", "label.x as labelx", "label.y as labely", "main.x as mainx", "main.y as mainy", "body"]
    block = lambda c: f"cast(pmod(xxhash64(x, y), {c}) as int)"
    one = rows.where("label <> main").withColumn("o", F.expr(block("outer"))).withColumn("e", F.explode(F.sequence(F.lit(0), F.col("every") - 1))).withColumn("side", F.lit(0))
    two = rows.withColumn("e", F.expr(block("every"))).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("outer") - 1))).withColumn("side", F.lit(1))
    pairs = one.selectExpr(*flat).unionByName(two.selectExpr(*flat)).repartition("lx", "ly", "o", "e").sortWithinPartitions("lx", "ly", "o", "e", "side")
    more = materialise(pairs.mapInArrow(_cross(k, least), _LINKS), "links")
    up = components(more.select(*ends))
    old = found.join(up.selectExpr("node as label", "label as onward"), "label", "left").select("node", F.coalesce("onward", "label").alias("label"))
    out = materialise(old.union(up.join(found, "node", "left_anti").select("node", "label")), "classes")
    drop_scratch(spark, votes, texts, links, more, found, up)
    return out


def near_dups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, labels: int = LABELS) -> DataFrame:
    """(key, class_id, class_size): one row for each row of docs."""
    found = text_classes(docs, text, k, least, bands, labels)
    rows = with_text_key(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))).select("key", "__tk")
    named = rows.where("__tk is not null").join(found.selectExpr("node as __tk", "label"), "__tk", "left").select("key", F.coalesce("label", "__tk").alias("label"))
    classes = named.groupBy("label").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size"))
    alone = rows.where("__tk is null").select("key", F.col("key").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return named.join(classes, "label").select("key", "class_id", "class_size").union(alone).withColumnRenamed("key", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without near copies: of each class the row of least key, once; texts without a word all stay."""
    found = text_classes(docs, text, **options)
    rows = with_text_key(docs, text).drop("__body")
    own = F.col(f"`{key}`")
    # 128 bits for the row: its key and its text.
    rows = rows.withColumn("__rk", F.when(F.col("__tk").isNotNull(), F.struct(F.xxhash64(own, "__tk").alias("x"), F.xxhash64(F.lit(1), own, F.col("__tk")).alias("y"))))
    light = rows.where("__tk is not null").select(own.alias("__key"), "__tk", "__rk")
    first = (light.join(found.selectExpr("node as __tk", "label"), "__tk", "left").groupBy(F.coalesce("label", "__tk").alias("label"))
             .agg(F.min(F.struct(F.col("__key").isNull(), "__key", "__rk")).alias("first")).select(F.col("first.__rk").alias("__rk")))
    once = rows.where("__tk is not null").join(first, "__rk", "left_semi").dropDuplicates(["__rk"])
    return once.select(*docs.columns).unionByName(rows.where("__tk is null").select(*docs.columns))
