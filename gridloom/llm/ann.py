"""Nearest neighbours by an inverted multi-index: two halves quantised apart, cells walked by a heap, exact reranking.

Centroids of either half are fitted on a bounded sample (SAMPLE vectors of least id hash); every vector is
indexed, in the cell of its two nearest centroids. A query walks the pairs of centroids from the
largest sum of inner products down, with a heap, until the cells passed hold `wanted` different vectors; these are
scored exactly, in double precision. Unless it is given, `wanted` is measured: TRIALS of the queries are searched
through all vectors, and it is set so that RECALL of what they find lies in the cells that a walk of that length passes.

Equal vectors are one entry that holds their least ids, no more than an answer can need, so a vector that a third of
the rows share costs one entry and is searched for once. Entries are dealt to blocks of at most BLOCK: small cells
share one, large cells have several, and a query goes to each block of each cell that it passes.

Vectors that are null, zero, not of the most common length, or hold null or non-finite components take no part, nor do null ids.
Rows that repeat an id with its vector count once. Ties go to the smaller id. Fewer candidates than asked for: all
of them. The empty table gives an empty result. Columns beside id and vector are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialise

SAMPLE = 20_000
TRIALS, RECALL = 64, 0.94
BLOCK = 4096
#: Cells hold so many different vectors on average; centroids of a half are at most MOST_CENTROIDS.
PER_CELL, MOST_CENTROIDS = 3, 256


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1) if len(x) else np.zeros(0, np.int64)


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray | list, wanted: int) -> list[int]:
    """Cells (i * len(b) + j) in falling order of a[i] + b[j], until `wanted` entries are passed."""
    ia, ib = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    x, y, rows, cols = (-a[ia]).tolist(), (-b[ib]).tolist(), (ia * len(b)).tolist(), ib.tolist()
    held, out, got = counts.tolist() if isinstance(counts, np.ndarray) else counts, [], 0
    # Each row of pairs has one place on the heap; the next row joins when the one before has left its first pair.
    heap = [(x[0] + y[0], 0, 0)]
    while heap and got < wanted:
        _, i, j = heap[0]
        if j + 1 < len(y):
            heapq.heapreplace(heap, (x[i] + y[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        cell = rows[i] + cols[j]
        if held[cell]:
            out.append(cell)
            got += held[cell]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def _search_block(k: int, dim: int):
    def run(probes: pa.Table, entries: pa.Table) -> pa.Table:
        none = pa.table({"qk": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        if not probes.num_rows or not entries.num_rows:
            return none
        q, v = (_matrix(t.column("vec").combine_chunks(), dim) for t in (probes, entries))
        qk, cell = probes.column("qk").to_numpy(), entries.column("cell").to_numpy()
        ids = entries.column("ids").combine_chunks()
        least = np.asarray(ids.values)[np.asarray(ids.offsets)[:-1] - ids.offsets[0].as_py()]
        out_q, out_v, out_s = [], [], []
        cells = probes.column("cells").combine_chunks()
        passed, width = np.asarray(cells.values), np.diff(np.asarray(cells.offsets))
        present, which = np.unique(cell, return_inverse=True)
        for at0 in range(0, len(v), 4 * BLOCK):
            at = np.arange(at0, min(at0 + 4 * BLOCK, len(v)))
            for lo in range(0, len(q), 256):
                part = np.arange(lo, min(lo + 256, len(q)))
                row = np.repeat(part - lo, width[part])
                mine = passed[np.asarray(cells.offsets)[lo] - cells.offsets[0].as_py() :][: len(row)]
                open_cell = np.zeros((len(part), len(present)), bool)
                open_cell[row, np.searchsorted(present, mine)] = True
                s = q[part] @ v[at].T
                s[~open_cell[:, which[at]]] = -np.inf
                m = min(len(at), k)
                cut = np.partition(s, len(at) - m, axis=1)[:, len(at) - m]
                near = np.where(np.isfinite(cut), cut - 1e-9 * (1 + np.abs(cut)), -np.finfo(float).max)
                r, col = np.nonzero(s >= near[:, None])
                exact = (q[part[r]] * v[at[col]]).sum(axis=1)
                by = np.lexsort((least[at[col]], -exact, r))
                r, col, exact = r[by], col[by], exact[by]
                n = np.bincount(r, minlength=len(part))
                rank = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
                keep = rank < k
                out_q.append(qk[part[r[keep]]])
                out_v.append(at[col[keep]])
                out_s.append(exact[keep])
        if not out_q:
            return none
        return pa.table({"qk": np.concatenate(out_q), "score": np.concatenate(out_s), "ids": ids.take(pa.array(np.concatenate(out_v)))})
    return run


def _measure(sought: DataFrame, index: DataFrame, c1: np.ndarray, c2: np.ndarray, counts: np.ndarray, k: int, dim: int) -> int:
    """Entries that a walk must pass so that it meets RECALL of the true neighbours of TRIALS queries."""
    trial = _matrix(sought.orderBy(F.xxhash64(F.lit(9), "vk")).limit(TRIALS).select("vec").toArrow().column("vec").combine_chunks(), dim)
    if not len(trial):
        return 0

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = trial @ _matrix(b.column("vec"), dim).T
            m = min(k + 1, s.shape[1])
            col = np.argpartition(-s, m - 1, axis=1)[:, :m] if m else np.zeros((len(trial), 0), np.int64)
            cell = b.column("cell").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(trial)), m).astype(np.int32)), pa.array(np.take_along_axis(s, col, 1).ravel()), pa.array(cell[col].ravel())], names=["q", "score", "cell"])

    best = index.select("vec", "cell").mapInArrow(exact, "q int, score double, cell int")
    top = Window.partitionBy("q").orderBy(F.desc("score"))
    found = best.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).select("q", "cell").collect()  # TRIALS * (k + 1) rows
    half, reached = dim // 2, []
    for q in range(len(trial)):
        order = np.argsort(-((trial[q, :half] @ c1.T)[:, None] + (trial[q, half:] @ c2.T)[None, :]).ravel(), kind="stable")
        upto = np.empty(len(order), np.int64)
        upto[order] = np.cumsum(counts[order])
        reached += [upto[r["cell"]] for r in found if r["q"] == q]
    return int(np.quantile(reached, RECALL, method="higher"))


def search(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, key: str = "vec_id", vector: str = "embedding", wanted: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, key, score): the k nearest rows of each row that the SQL condition `queries` picks."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"),
                          F.expr(queries).alias("asked")).where("id is not null and vec is not null")
    sane = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(sane)
    most = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    spark = vectors.sparkSession
    schema = f"query_id long, rank int, {key} long, score double"
    if most is None:
        return spark.createDataFrame([], schema)
    dim = most["dim"]
    rows = rows.where(F.size("vec") == dim).withColumn("vk", F.xxhash64("vec"))
    # Of equal vectors, the k + 1 least ids: the query's own may be one of them.
    place = F.dense_rank().over(Window.partitionBy("vk").orderBy("id"))
    entries = (rows.select("vk", "id", "vec").withColumn("place", place).where(F.col("place") <= k + 1)
               .groupBy("vk").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_set("id")).alias("ids")))
    entries = materialise(entries, "vectors")

    n = entries.count()
    half = dim // 2
    kk = int(min(MOST_CENTROIDS, max(1, round((n / PER_CELL) ** 0.5))))
    picked = entries.orderBy(F.xxhash64(F.lit(5), "vk")).limit(sample).select("vec").toArrow().column("vec").combine_chunks()
    x = _matrix(picked, dim)
    c1, c2 = kmeans(x[:, :half], kk), kmeans(x[:, half:], kk)
    width = len(c2)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("vec"), dim)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((nearest(v[:, :half], c1) * width + nearest(v[:, half:], c2)).astype(np.int32))], names=["vk", "vec", "ids", "cell"])

    index = materialise(entries.mapInArrow(assign, "vk long, vec array<double>, ids array<long>, cell int"), "index")
    # One count for each cell: at most MOST_CENTROIDS ** 2.
    counts = np.zeros(len(c1) * width, np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    parts = np.maximum(-(-counts // BLOCK), 1)
    first, room, block = np.zeros(len(counts), np.int64), 0, -1
    for c in np.flatnonzero(counts):
        if parts[c] > 1 or counts[c] > room:
            first[c] = block + 1
            block += int(parts[c])
            room = BLOCK - int(counts[c]) if parts[c] == 1 else 0
        else:
            first[c] = block
            room -= int(counts[c])

    asked = rows.where("asked").select("id", "vk").distinct()
    wanted_keys = asked.select("vk").distinct()
    sought = index.join(wanted_keys, "vk", "left_semi").select("vk", "vec")
    if wanted is None:
        wanted = _measure(sought, index, c1, c2, counts, k, dim)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counts.tolist()
        for b in batches:
            v = _matrix(b.column("vec"), dim)
            a1, a2 = v[:, :half] @ c1.T, v[:, half:] @ c2.T
            for lo in range(0, len(v), 256):
                who, blocks, lists = [], [], []
                for i in range(lo, min(lo + 256, len(v))):
                    c = np.array(walk(a1[i], a2[i], held, wanted), np.int64)
                    n = parts[c]
                    each = np.repeat(c, n)
                    blk = np.repeat(first[c], n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    by = np.argsort(blk, kind="stable")
                    each, blk = each[by], blk[by]
                    at = np.flatnonzero(np.r_[True, blk[1:] != blk[:-1]]) if len(blk) else np.zeros(0, np.int64)
                    who += [i] * len(at)
                    blocks.append(blk[at])
                    lists += np.split(each.astype(np.int32), at[1:]) if len(at) else []
                take = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("vk").take(take), b.column("vec").take(take), pa.array(lists, pa.list_(pa.int32())), pa.array(np.concatenate(blocks).astype(np.int32))], names=["qk", "vec", "cells", "block"])

    def place_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column("cell").to_numpy()
            blk = first[cell] + b.column("vk").to_numpy() % parts[cell]
            yield pa.RecordBatch.from_arrays([b.column("vec"), b.column("ids"), b.column("cell"), pa.array(blk.astype(np.int32))], names=["vec", "ids", "cell", "block"])

    probes = sought.mapInArrow(probe, "qk long, vec array<double>, cells array<int>, block int")
    placed = index.mapInArrow(place_entries, "vec array<double>, ids array<long>, cell int, block int")
    hits = probes.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(_search_block(k + 1, dim), "qk long, score double, ids array<long>")
    top = Window.partitionBy("qk").orderBy(F.desc("score"), F.col("ids")[0])
    best = hits.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).select("qk", "score", F.explode("ids").alias("id"))
    line = Window.partitionBy("qk").orderBy(F.desc("score"), "id")
    answers = (best.withColumn("r", F.row_number().over(line)).where(F.col("r") <= k + 1)
               .groupBy("qk").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("found")))
    return (asked.join(answers.withColumnRenamed("qk", "vk"), "vk")
            .select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, k).alias("found"))
            .select("query_id", F.posexplode("found").alias("p", "f"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.id").alias(key), F.col("f.score").alias("score")))
