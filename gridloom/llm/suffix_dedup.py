"""Exact removal of long repeated byte strings by suffix arrays that are sorted in two stages.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same
text or another. Judged on the input; matches never cross texts.

How it is spread out. Every window of `length` bytes has an anchor: of the k-byte strings inside
it, the leftmost one with the least hash. The windows of one anchor start at consecutive
places; the bytes they cover are a run. Equal windows have equal anchors, so a run whose anchor is
found nowhere else has no repeated window. Runs with an anchor in common are told apart by a hash of
all their bytes. Where an anchor's runs are all equal, all their windows repeat. Where they differ
(at the edges of what is shared), one copy of each different run goes to the suffix array of its
anchor's block, and adjacent common prefixes of `length` bytes show the windows that repeat. Copies
are thus counted, not compared: a text that occurs a million times sends one run of each kind.
An anchor with more than MOST_VARIANTS different runs is split by its windows: they are counted one by one, by
two hashes, which spreads them over the cluster and gives the same answer as the suffix array that no task could hold.

Nulls and empty texts have no bytes and lose none; kept_sha256 is then that of nothing. Texts that
are shorter than `length` are left whole. Repeated rows are copies of each other, and lose all their
windows. The empty table gives an empty result. Only the key and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import drop_scratch, materialise
from ._text import group_starts, lean, mix, prefix_sums, span_hash, text_chunks

LENGTH = 200
#: Bytes of an anchor. Shorter ones make fewer and longer runs, but more chance matches.
ANCHOR = 64
#: Different runs of one anchor that share a suffix array (330 bytes each or so).
MOST_VARIANTS = 4096
#: Bytes of whole anchor groups that one suffix array takes.
BLOCK_BYTES = 1 << 20


# ---- suffix arrays -------------------------------------------------------------------------

def _words_at(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place, big-endian, as one number; zeros after the end."""
    padded = np.r_[text, np.zeros(depth + 16, np.uint8)].astype(np.uint64)
    n = len(text) + depth + 8
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + n]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text in the order of their first `depth` bytes (whole suffixes, for a depth of len(text)).

    First stage: only suffixes smaller than their successor are sorted by their bytes. Second: one
    scan over the buckets of first bytes, in order, puts each other suffix behind its bucket's
    head when its successor is met; a bucket is scanned in waves, since it can feed itself.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    word = _words_at(text, depth)
    # A suffix has the kind of the last of its run of equal bytes; the end of text counts as least.
    last = np.r_[np.flatnonzero(text[1:] != text[:-1]), n - 1]
    kind = np.r_[text[last[:-1]] < text[last[:-1] + 1], False]
    small = np.repeat(kind, np.diff(np.r_[-1, last]))

    order = np.flatnonzero(small)
    order = order[np.argsort(word[order], kind="stable")]
    same = np.r_[False, word[order[1:]] == word[order[:-1]]] if len(order) else np.zeros(0, bool)
    for at in range(8, depth, 8):
        if not same.any():
            break
        # Only ties go on: same[i] says that i equals i - 1 so far.
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        group = np.cumsum(~same[tied])
        key = word[order[tied] + at]
        by = np.lexsort((key, group))
        order[tied] = order[tied][by]
        key, g = key[by], group[by]
        same[tied] = np.r_[False, (key[1:] == key[:-1]) & (g[1:] == g[:-1])]

    first = np.bincount(text, minlength=256)
    head = np.cumsum(first) - first
    n_small = np.bincount(text[order], minlength=256)
    tail = head + first - n_small
    sa = np.full(n, -1, np.int64)
    at = 0
    for c in np.flatnonzero(n_small):
        sa[tail[c] : tail[c] + n_small[c]] = order[at : at + n_small[c]]
        at += n_small[c]

    fill = head.copy()

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        c = text[before]
        by = np.argsort(c, kind="stable")
        before, c = before[by], c[by]
        at = group_starts(c)
        for s, e in zip(at, np.r_[at[1:], len(c)], strict=True):
            sa[fill[c[s]] : fill[c[s]] + e - s] = before[s:e]
            fill[c[s]] += e - s

    induce(np.array([n]))  # the empty suffix is the least
    for c in np.flatnonzero(first):
        done = head[c]
        while done < fill[c]:
            upto = fill[c]
            induce(sa[done:upto])
            done = upto
        induce(sa[tail[c] : tail[c] + n_small[c]])
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """For each place in sa but the first: bytes in common with the one before, up to depth."""
    word = _words_at(text, depth)
    out = np.zeros(max(len(sa) - 1, 0), np.int64)
    going = np.arange(len(out))
    for at in range(0, depth, 8):
        diff = word[sa[going] + at] ^ word[sa[going + 1] + at]
        stop = diff != 0
        bits = diff[stop]
        same = np.zeros(len(bits), np.int64)
        for i in range(7):
            same += (bits >> np.uint64(56 - 8 * i)) == 0
        out[going[stop]] = at + same
        going = going[~stop]
        out[going] = at + 8
    room = len(text) - np.maximum(sa[1:], sa[:-1])
    return np.minimum(np.minimum(out, depth), room)


def repeated_windows(text: np.ndarray, starts: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """For each place of text: whether the window there stays in its segment and occurs twice or more.

    starts: where each segment begins; weights: how many copies of the segment there are.
    """
    sa = suffix_array(text, length)
    lcp = common_prefixes(text, sa, length)
    ends = np.r_[starts[1:], len(text)]
    segment = np.searchsorted(starts, sa, "right") - 1
    weight = np.where(sa + length <= ends[segment], weights[segment], 0)
    group = np.r_[0, np.cumsum(lcp < length)]
    total = np.bincount(group, weights=weight)
    out = np.zeros(len(text), bool)
    out[sa[(total[group] >= 2) & (weight > 0)]] = True
    return out


# ---- anchors and runs -----------------------------------------------------------------------

def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return values if span == width else np.minimum(values[: len(values) - (width - span)], values[width - span :])


def runs_of(data: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = ANCHOR):
    """(row, start in the text, bytes, anchor's hash, run's hash) of every run of windows."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    p = prefix_sums(data)
    at = np.arange(len(data) - k + 1)
    gram = span_hash(p, at, at + k)
    width = length - k + 1
    # Hash above, place below: the least is the leftmost of those with the least hash (in 33 bits).
    low = np.uint64((1 << 31) - 1)
    least = _least((gram & ~low) | at.astype(np.uint64), width)
    anchor_at = (least & low).astype(np.int64)
    places = np.arange(len(least))
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(least)]
    where = places[places + length <= off[row + 1]]
    nxt = anchor_at[where]
    new = np.r_[True, (nxt[1:] != nxt[:-1]) | (row[where[1:]] != row[where[:-1]])] if len(where) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(where)] - 1
    start, end = where[first], where[last] + length
    rows = row[start]
    anchor = gram[nxt[first]]
    # Two runs are the same only if their anchors stand at the same place in them.
    whole = mix(span_hash(p, start, end) ^ (nxt[first] - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return rows, start - off[rows], end - start, anchor, whole


# ---- the operator -----------------------------------------------------------------------------

_RUNS = "anchor long, whole long, copies int, x long, y long, at int, bytes int"
_SPANS = "x long, y long, at int, upto int"
#: Bytes of segments that one task sorts.
TASK_BYTES = 2 << 20


def _merge(rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans of each row, from spans that may touch or overlap."""
    by = np.lexsort((start, rows))
    rows, start, end = rows[by], start[by], end[by]
    if not len(rows):
        return rows, start, end
    shift = rows.astype(np.int64) * (1 << 32)  # keeps the rows apart in one running maximum
    far = np.maximum.accumulate(shift + end)
    first = np.flatnonzero(np.r_[True, shift[1:] + start[1:] > far[:-1]])
    last = np.r_[first[1:], len(rows)] - 1
    return rows[first], start[first], far[last] - shift[last]


def _find_runs(length: int, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [b.column(c).to_numpy() for c in ("x", "y")]
            for lo, hi, data, off in text_chunks(b.column("text")):
                rows, at, n, anchor, whole = runs_of(data, off, length, k)
                # Runs that this chunk has twice are known to repeat: one row for all, and their spans.
                by = np.lexsort((whole, anchor))
                a, w = anchor[by], whole[by]
                first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])]) if len(by) else np.zeros(0, np.int64)
                copies = np.diff(np.r_[first, len(by)])
                pick = by[first]
                again = by[np.repeat(copies > 1, copies)]
                srow, sat, send = _merge(rows[again], at[again], at[again] + n[again])
                m = len(srow)
                own = np.r_[rows[pick], srow]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.r_[anchor[pick].view(np.int64), np.zeros(m, np.int64)]),
                    pa.array(np.r_[whole[pick].view(np.int64), np.zeros(m, np.int64)]),
                    pa.array(np.r_[copies, np.zeros(m, np.int64)].astype(np.int32)),
                    *(pa.array(c[lo:hi][own]) for c in keys),
                    pa.array(np.r_[at[pick], sat].astype(np.int32)),
                    pa.array(np.r_[n[pick], send - sat].astype(np.int32))], names=["anchor", "whole", "copies", "x", "y", "at", "bytes"])
    return lean(find)


def _sort_blocks(length: int):
    """Rows (anchor, copies, x, y, at, seg), sorted by anchor: the repeated spans of runs that occur once."""
    def solve(part: list[tuple]) -> pa.RecordBatch:
        copies, x, y, at = (np.concatenate([p[i] for p in part]) for i in range(4))
        segs = [s for p in part for s in p[4]]
        starts = np.r_[0, np.cumsum([len(s) for s in segs])].astype(np.int64)
        found = repeated_windows(np.frombuffer(b"".join(segs), np.uint8), starts[:-1], np.minimum(copies, 2), length)
        hit = np.flatnonzero(found)
        seg = np.searchsorted(starts, hit, "right") - 1
        one = copies[seg] == 1
        rows, s, e = _merge(seg[one], hit[one] - starts[seg[one]], hit[one] - starts[seg[one]] + length)
        return pa.RecordBatch.from_arrays([pa.array(x[rows]), pa.array(y[rows]), pa.array((at[rows] + s).astype(np.int32)), pa.array((at[rows] + e).astype(np.int32))], names=["x", "y", "at", "upto"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, tail = [], 0, None
        for b in batches:
            anchor = b.column("anchor").to_numpy()
            cut = np.r_[group_starts(anchor), len(anchor)]
            cols = [b.column(c).to_numpy() for c in ("copies", "x", "y", "at")]
            segs = b.column("seg").to_pylist()
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if size >= BLOCK_BYTES and anchor[s] != tail:
                    yield solve(held)
                    held, size = [], 0
                held.append((*(c[s:e] for c in cols), segs[s:e]))
                size += sum(map(len, segs[s:e]))
                tail = anchor[s]
        if held:
            yield solve(held)
    return lean(run)


def _windows(length: int):
    """Rows (anchor, copies, x, y, at, seg): one row for each window (anchor, two hashes of the window, copies, x, y, at)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("anchor", "copies", "x", "y", "at")]
            for lo, hi, data, off in text_chunks(b.column("seg"), CHUNK_WINDOWS):
                p = prefix_sums(data)
                n = np.maximum(np.diff(off) - length + 1, 0)
                row = np.repeat(np.arange(hi - lo), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                begin = off[row] + at
                h = span_hash(p, begin, begin + length)
                half = span_hash(p, begin, begin + length // 2)
                anchor, copies, x, y, at0 = (c[lo:hi][row] for c in cols)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (anchor, h.view(np.int64), half.view(np.int64), copies, x, y, (at0 + at).astype(np.int32))], names=["anchor", "window", "half", "copies", "x", "y", "at"])
    return lean(run)


CHUNK_WINDOWS = 1 << 18


#: Bytes of segments in one batch.
CUT_BYTES = 4 << 20


@lean
def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, text, runs: those of one text): a row (anchor, copies, x, y, at, seg, variants) for each run."""
    for b in batches:
        for lo, hi, data, off in text_chunks(b.column("text")):
            runs = b.column("runs").slice(lo, hi - lo)
            n = np.asarray(runs.value_lengths())
            anchor, copies, at, size, variants = (np.asarray(c) for c in runs.flatten().flatten())
            row = np.repeat(np.arange(hi - lo), n)
            start, total = off[row] + at, np.cumsum(size, dtype=np.int64)
            a = 0
            while a < len(row):
                z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CUT_BYTES, "right")))
                width = size[a:z].astype(np.int64)
                end = np.cumsum(width)
                place = np.arange(end[-1]) - np.repeat(end - width - start[a:z], width)
                seg = pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(np.r_[0, end].astype(np.int32)), pa.py_buffer(data[place])])
                own = row[a:z]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[a:z]), pa.array(np.minimum(copies[a:z], 2)), *(b.column(c).slice(lo, hi - lo).take(pa.array(own)) for c in ("x", "y")), pa.array(at[a:z]), seg, pa.array(variants[a:z])],
                                                 names=["anchor", "copies", "x", "y", "at", "seg", "variants"])
                a = z


def _row_key(key: str, body) -> list:
    """x and y: 128 bits that tell rows apart but for true copies, whose spans are the same."""
    return [F.xxhash64(F.col(f"`{key}`"), body).alias("x"), F.xxhash64(F.lit(1), F.col(f"`{key}`"), body).alias("y")]


def _body(text: str):
    return F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = ANCHOR,
                   most_variants: int = MOST_VARIANTS) -> DataFrame:
    """(x, y, spans): the different spans of bytes to remove (at, upto), perhaps touching or overlapping, by the row key of _row_key(); written."""
    spark = docs.sparkSession
    long_ones = docs.select(*_row_key(key, _body(text)), _body(text).alias("text")).where(F.octet_length("text") >= length)
    found = materialise(long_ones.mapInArrow(_find_runs(length, k), _RUNS), "runs")
    runs, known = found.where("copies > 0"), found.where("copies = 0")
    met = (runs.groupBy("anchor").agg(F.sum("copies").alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi"))
           .where("n > 1").selectExpr("anchor", "lo <> hi as mixed"))
    shared = materialise(runs.join(met, "anchor"), "shared")
    mixed = shared.where("mixed")
    kinds = (mixed.groupBy("anchor", "whole").agg(F.sum("copies").cast("int").alias("copies"), F.min(F.struct("x", "y", "at", "bytes")).alias("first")))
    again = kinds.where("copies > 1").select("anchor", "whole")
    span = ("x", "y", "at", "at + bytes as upto")
    spans = [known.selectExpr(*span), shared.where("not mixed or copies > 1").selectExpr(*span),
             mixed.where("copies = 1").join(again, ["anchor", "whole"], "left_semi").selectExpr(*span)]
    sizes = kinds.groupBy("anchor").agg(F.count("*").alias("variants"))
    kinds = kinds.join(sizes, "anchor").selectExpr("anchor", "copies", "first.x as x", "first.y as y", "first.at as at", "first.bytes as bytes", "variants")
    # A text's own runs, gathered by text: their number follows its length.
    wanted = kinds.groupBy("x", "y").agg(F.collect_list(F.struct("anchor", "copies", "at", "bytes", "variants")).alias("runs"))
    # Repeated rows have the same key: one of them stands for all.
    one = long_ones.join(wanted, ["x", "y"]).dropDuplicates(["x", "y"])
    segs = materialise(one.select("x", "y", "text", "runs").mapInArrow(_cut_segments, "anchor long, copies int, x long, y long, at int, seg binary, variants long"), "segments")
    few = segs.where(F.col("variants") <= most_variants).drop("variants")
    # The work follows the segments' bytes, and is more than adaptive execution takes it for.
    parts = max(1, -(-(few.agg(F.sum(F.octet_length("seg"))).first()[0] or 0) // TASK_BYTES))
    few = few.repartition(max(parts, spark.sparkContext.defaultParallelism), "anchor").sortWithinPartitions("anchor")
    spans.append(few.mapInArrow(_sort_blocks(length), _SPANS))
    windows = segs.where(F.col("variants") > most_variants).drop("variants").mapInArrow(_windows(length), "anchor long, window long, half long, copies int, x long, y long, at int")
    same = ["anchor", "window", "half"]
    twice = windows.groupBy(*same).agg(F.sum("copies").alias("n")).where("n > 1")
    spans.append(windows.where("copies = 1").join(twice, same, "left_semi").selectExpr("x", "y", "at", f"at + {length} as upto"))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    # Copies of a row share its key, so a span can come once for each of them: distinct bounds the list by the text.
    out = materialise(out.distinct().groupBy("x", "y").agg(F.collect_list(F.struct("at", "upto")).alias("spans")), "spans")
    drop_scratch(spark, found, shared, segs)
    return out


@lean
def _drop_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, spans as a list of structs or null): what is left of each text."""
    for b in batches:
        for start in range(0, b.num_rows, 256):
            part = b.slice(start, 256)
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for text, spans in zip(part.column("text"), part.column("spans"), strict=True):
                view = memoryview(text.as_buffer())
                pieces, at, removed, n = [], 0, 0, 0
                if spans.is_valid and len(spans):
                    flat = spans.values
                    s, e = flat.field("at").to_numpy(), flat.field("upto").to_numpy().astype(np.int64)
                    _, s, e = _merge(np.zeros(len(s), np.int64), s.astype(np.int64), e)
                    for x, y in zip(s.tolist(), e.tolist(), strict=True):
                        pieces.append(view[at:x])
                        removed, n, at = removed + y - x, n + 1, y
                pieces.append(view[at:])
                kept = b"".join(pieces)
                for c, v in zip(out, (len(view), removed, n, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns) if part.schema.names[i] not in ("text", "spans")), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())], names=[*(c for c in part.schema.names if c not in ("text", "spans")), *out])


_KEPT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = ANCHOR, most_variants: int = MOST_VARIANTS) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept: the bytes that stay), a row for each of docs."""
    spans = repeated_spans(docs, key, text, length, k, most_variants)
    rows = docs.select(F.col(f"`{key}`").alias("key"), _body(text).alias("text"), *_row_key(key, _body(text)))
    kind = docs.schema[key].dataType.simpleString()
    return rows.join(spans, ["x", "y"], "left").select("key", "text", "spans").mapInArrow(_drop_bytes, f"key {kind}, {_KEPT}").withColumnRenamed("key", key)


def strip_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str | None = None, **options) -> DataFrame:
    """docs with the repeated bytes taken out of the text (and of no character a part); chars: a column for its new length.

    A null text stays null.
    """
    spans = repeated_spans(docs, key, text, **options)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.col(f"`{text}`").isNull().alias("__null"))
    rows = docs.select(rest.alias("key"), _body(text).alias("text"), *_row_key(key, _body(text)))
    kind = rows.schema["key"].dataType.simpleString()
    kept = rows.join(spans, ["x", "y"], "left").select("key", "text", "spans").mapInArrow(_drop_bytes, f"key {kind}, {_KEPT}")
    whole = F.when(~F.col("key.__null"), _whole_characters(F.col("kept")))
    out = kept.select("key", whole.alias("__text"))
    columns = [F.col("__text").alias(c) if c == text else F.length("__text").cast(docs.schema[c].dataType).alias(c) if c == chars else F.col(f"key.`{c}`") for c in docs.columns]
    return out.select(*columns)


@F.arrow_udf(T.StringType())
def _whole_characters(column: pa.Array) -> pa.Array:
    """Bytes as text; what is left of a character that was cut goes."""
    return pa.array([x.decode("utf-8", "ignore") if x is not None else None for x in column.to_pylist()], pa.string())
