"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Generative models over hashed word and word-pair buckets are counted: of the target (labelled rows of good
quality that are not toxic), of all text (every row), and of each kind of labelled row that is no target (poor, toxic). Raw text is
the mixture of these, in the shares of the labelled rows (ALL_TEXT for the model of all text), and a text's importance weight is the
ratio of the two generative models:

    log_weight = log( p_target(text) / p_raw(text) ) / TEMPERATURE
               = -log( share_target + sum over the other models k of share_k exp(sum over its n-grams of r_k) ) / TEMPERATURE

with r_k(bucket) = log((c_k + pseudo) / (c_target + pseudo)), counts scaled to the smaller of both models' totals. The models of few labelled
rows differ from the target's by chance in most buckets, which long texts would add up: there r_k is shrunk towards 0 by its
standard error or by SHRINK, whichever is more, and only what is left counts. The model of all text needs no such
shrinking, only more pseudo-counts.

The number to sample, k, is that of the texts which the mixture gives to the target with probability 1/2 or more;
the k rows with the largest log weight + Gumbel noise, seeded by the row key, are kept. A temperature below 1
sharpens the sample: hardly a row that the models reject comes in by its noise.

At most LABELLED labelled rows are used (those with the least hash of their id, one for each id); all counts, sums and
the choice of the k rows cover every row.

Nulls and texts without a token have no weight (null) and are not kept. Without labelled rows of both
kinds nothing can be told apart: every text with a token has log weight 0 and is kept. Rows with equal
keys share their noise; those that tie at the last kept place all stay. Null ids are a key like any
other. The empty table gives an empty result. Other columns pass through judge() untouched, but for those named
log_weight, gumbel_key and kept, which the operator's own replace; keep() leaves all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._shared import drop_scratch, materialise
from ._text import lean, mix, text_chunks, word_hashes

BITS = 18
#: Labelled rows that the models of the target and of the other kinds are counted from.
LABELLED = 20_000
SEED = 7
#: Share of the model of all text in the raw mixture.
ALL_TEXT = 0.05
#: Added to both counts of a ratio: against all text, and against a kind of labelled rows.
PSEUDO_ALL, PSEUDO_KIND = 10.0, 0.5
#: A kind's log ratio counts by what it has beyond this (and beyond its standard error).
SHRINK = 1.5
TEMPERATURE = 0.1

_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def ngrams(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of every token and pair of tokens; tokens are runs of letters and digits, or of other signs."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = np.r_[True, kind[1:] != kind[:-1]]
    edge[off[off < len(data)]] = True
    start = np.flatnonzero(edge)
    end = np.r_[start[1:], len(data)]
    real = kind[start] > 0
    start, end = start[real], end[real]
    h = word_hashes(_LOWER[data], start, end)
    row = np.searchsorted(off, start, "right") - 1
    pair = row[1:] == row[:-1]
    two = mix(h[:-1][pair] * np.uint64(3) + h[1:][pair])
    shift = np.uint64(64 - bits)
    return np.r_[h >> shift, two >> shift].astype(np.int64), np.r_[row, row[1:][pair]]


def _count(bits: int, kinds: int):
    """Rows (kind, text): (bucket, n_0 .. n_kinds): all n-grams, and those of each kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kinds + 1, 1 << bits), np.int64)
        for b in batches:
            kind = b.column(0).to_numpy()
            for lo, hi, data, off in text_chunks(b.column(1)):
                bucket, row = ngrams(data, off, bits)
                total[0] += np.bincount(bucket, minlength=1 << bits)
                own = kind[lo:hi][row]
                for k in range(1, kinds + 1):
                    if (kind[lo:hi] == k).any():
                        total[k] += np.bincount(bucket[own == k], minlength=1 << bits)
        at = np.flatnonzero(total[0])
        for s in range(0, len(at), 1 << 16):
            part = at[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(t[part]) for t in total)], names=["bucket", *(f"n{k}" for k in range(kinds + 1))])
    return lean(run)


def count_buckets(texts: DataFrame, bits: int = BITS, kinds: int = 0) -> np.ndarray:
    """texts (kind int, text): counts of n-grams by bucket, of all rows and of each kind: (kinds + 1) x 2 ** bits numbers, however many texts."""
    names = [f"n{k}" for k in range(kinds + 1)]
    rows = texts.mapInArrow(_count(bits, kinds), "bucket int, " + ", ".join(f"{n} long" for n in names)).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((kinds + 1, 1 << bits))
    for k, n in enumerate(names):
        out[k][rows.column("bucket").to_numpy()] = rows.column(n).to_numpy()
    return out


def log_ratio(count: np.ndarray, target: np.ndarray, pseudo: float, shrink: float | None) -> np.ndarray:
    """log(p_count / p_target) of each bucket; shrunk towards 0 unless shrink is None."""
    least = min(count.sum(), target.sum())
    r = np.log((count * (least / count.sum()) + pseudo) / (target * (least / target.sum()) + pseudo))
    if shrink is None:
        return r
    error = np.sqrt(1 / (count + pseudo) + 1 / (target + pseudo))
    return np.sign(r) * np.maximum(np.abs(r) - np.maximum(error, shrink), 0)


class Weigher:
    """Log importance weight of texts; its size is that of the bucket tables."""

    def __init__(self, ratios: list[np.ndarray], shares: list[float], bits: int, temperature: float = TEMPERATURE):
        """ratios and shares: of the models beside the target, which has what the shares leave. No ratio: all weights are 0."""
        self.ratios, self.shares, self.bits, self.temperature = [r.astype(np.float32) for r in ratios], shares, bits, temperature

    def __call__(self, column: pa.Array) -> np.ndarray:
        out = []
        for lo, hi, data, off in text_chunks(column):
            bucket, row = ngrams(data, off, self.bits)
            mixture = np.full(hi - lo, np.log(1 - sum(self.shares)))
            for r, share in zip(self.ratios, self.shares, strict=True):
                mixture = np.logaddexp(mixture, np.log(share) + np.bincount(row, weights=r[bucket], minlength=hi - lo))
            w = -mixture / self.temperature if self.ratios else np.zeros(hi - lo)
            out.append(np.where(np.bincount(row, minlength=hi - lo) > 0, w, np.nan))
        return np.concatenate(out) if out else np.zeros(0)

    @property
    def even(self) -> float:
        """The log weight of a text that is the target's with probability 1/2."""
        return -np.log(2 * (1 - sum(self.shares))) / self.temperature if self.ratios else 0.0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, labelled: int = LABELLED, temperature: float = TEMPERATURE) -> Weigher:
    """labels: (key, quality 0/1, toxic 0/1); the target is quality 1 without toxic 1."""
    toxic, poor = F.coalesce(F.col("toxic"), F.lit(0)) == 1, F.coalesce(F.col("quality"), F.lit(0)) != 1
    # Kinds: 1 the target, 2 poor, 3 toxic. Of several labels of one id the worst holds.
    kind = F.when(toxic, 3).when(poor, 2).otherwise(1)
    picked = (labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__key")).agg(F.max(kind).alias("__kind"))
              .orderBy(F.xxhash64(F.lit(SEED), "__key"), "__key").limit(labelled))
    # `labelled` rows of a few bytes: bounded, so broadcast. Every row of docs is counted, labelled or not.
    texts = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "__key", "left").select(F.coalesce("__kind", F.lit(0)).alias("kind"), "text")
    every, *kinds = count_buckets(texts, bits, 3)
    held = {r["__kind"]: r["n"] for r in picked.groupBy("__kind").agg(F.count("*").alias("n")).collect()}
    target, others = kinds[0], [(c, held.get(k, 0)) for k, c in ((2, kinds[1]), (3, kinds[2])) if c.sum()]
    if not target.sum() or not others:
        return Weigher([], [], bits, temperature)
    total = sum(held.values())
    ratios = [log_ratio(every, target, PSEUDO_ALL, None), *(log_ratio(c, target, PSEUDO_KIND, SHRINK) for c, _ in others)]
    return Weigher(ratios, [ALL_TEXT, *((1 - ALL_TEXT) * n / total for _, n in others)], bits, temperature)


def with_weights(docs: DataFrame, weigher: Weigher, key: str = "doc_id", text: str = "text", weight: str = "log_weight", gumbel: str = "gumbel_key") -> DataFrame:
    """docs with the log weight and the Gumbel key."""
    @arrow_udf("double")
    def weigh(column: pa.Array) -> pa.Array:
        w = weigher(column)
        return pa.array(w, from_pandas=True)

    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(f"`{key}`")), 11).cast("double") + 0.5) * 2.0**-53
    return docs.withColumn(weight, weigh(F.col(f"`{text}`"))).withColumn(gumbel, F.col(weight) - F.log(-F.log(u)))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value: counts by ever finer equal ranges, 1024 of them a round; no sort, no rows on the driver."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return lo
    while lo < hi:
        width = (hi - lo) / 1024
        place = F.least(F.floor((F.col(column) - lo) / width), F.lit(1023)) if width > 0 else F.lit(0)
        inside = df.where((F.col(column) >= lo) & (F.col(column) <= hi))
        ranges = inside.groupBy(place.alias("r")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("r")).collect()
        for r in ranges:
            if k <= r["n"]:
                stuck = (lo, hi) == (r["lo"], r["hi"])
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
        if stuck and width == 0:
            break
    return hi


def sample_size(weighted: DataFrame, even: float) -> tuple[int, float | None]:
    """(k, the least key that is kept) of rows with log_weight and gumbel_key."""
    k = weighted.where(F.col("log_weight") >= even).count()
    return k, kth_largest(weighted.where("gumbel_key is not null"), "gumbel_key", k)


def _kept(gumbel: str, least: float | None):
    return F.coalesce(F.col(gumbel) >= F.lit(least), F.lit(False)) if least is not None else F.lit(False)


def weights(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, log_weight, gumbel_key, kept) of each row of docs: every text is weighed once, and the weights are written."""
    weigher = fit(docs, labels, key, text, **options)
    light = materialise(with_weights(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), weigher, "key").select("key", "log_weight", "gumbel_key"), "weights")
    return light.withColumn("kept", _kept("gumbel_key", sample_size(light, weigher.even)[1])).withColumnRenamed("key", key)


def _weighed(docs: DataFrame, labels: DataFrame, key: str, text: str, weight: str, gumbel: str, **options) -> tuple[DataFrame, float | None]:
    weigher = fit(docs, labels, key, text, **options)
    light = materialise(with_weights(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), weigher, "key").select("log_weight", "gumbel_key"), "weights")
    least = sample_size(light, weigher.even)[1]
    drop_scratch(docs.sparkSession, light)
    # Weighing whole rows again is cheaper than a shuffle of their texts.
    return with_weights(docs, weigher, key, text, weight, gumbel), least


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with log_weight, gumbel_key and kept."""
    rows, least = _weighed(docs, labels, key, text, "log_weight", "gumbel_key", **options)
    return rows.withColumn("kept", _kept("gumbel_key", least))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    rows, least = _weighed(docs, labels, key, text, "__log_weight", "__gumbel_key", **options)
    return rows.where(_kept("__gumbel_key", least)).select(*[F.col(f"`{c}`") for c in docs.columns])
