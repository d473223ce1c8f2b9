"""Language-model scores of whole texts: a subword lattice, against a word unigram base.

A text is its words (A-Z lower-cased, parted by ASCII white space) and one end. The lattice model spells each word, after a
space, with pieces of an existing unigram vocabulary and a stop; the probability L(w) of a word is the sum over all its
segmentations, taken by the forward recursion in log space. Pieces don't reach over words, so the marginal
probability of a whole document is the product of its words':

    P(document) = (1 - e) L(w1) ... (1 - e) L(wn) e,   e = ends / tokens of the training texts

`score` is its log10. The vocabulary's own scores are where the piece weights start; ROUNDS expectation steps over the training
words, each as often as it occurs, adapt the weights (never the vocabulary; with rounds = 0 the existing scores stay as they are).

The base model is the add-0.1 unigram of the training texts' tokens (`base_score`). `blended_score` is a third model:
counts less a discount d, whose mass the lattice spreads over all words, P(w) = (max(c - d, 0) + d V L(w)) / N with
d = n1 / (n1 + 2 n2) of the words seen once and twice, P(end) = c(end) / N. Each model sums to at most one over all texts.

Words never share a piece, so each distinct word of the corpus is scored once. Rows are dealt to groups by a hash of id and text,
group sizes following the bytes; each group's own distinct words carry their scores back to its texts, so
no task holds the whole vocabulary of the corpus, which grows with it. (Only rows that repeat an id with its text share a group.)
Lattices are built for blocks of words of bounded bytes; a longer word is a block of its own.

Nulls and texts without a word are an end alone. A null id is read as an empty string: its remainder is
0, held out. Repeated rows are scored alike. The empty table gives an empty result. Without any training
text N and V are 0: base_score is then 0 for each token, and the models give words and ends half each.
Columns beside id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_scratch, materialise
from ._text import lean
from .lattice import MODEL, Lattice, Prefixes, Vocabulary

FOLDS = 10
#: Bytes of text in a group (rows are dealt by hash; a longer text makes a larger group).
GROUP_BYTES = 8 << 20
ROUNDS = 2
#: Added to each piece's expected count.
PRIOR = 0.1
#: Bytes of distinct words whose lattice is held at once.
BLOCK_BYTES = 160 << 10

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def _lattices(words: pa.Array, vocabulary: Vocabulary, tables: Prefixes) -> Iterator[tuple[int, int, Lattice]]:
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None and words.buffers()[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK_BYTES, "right")) - 1)
        own = off[lo : hi + 1] - off[lo]
        # A space before each word.
        spaced = own + np.arange(len(own))
        out = np.full(spaced[-1], 0x20, np.uint8)
        mine = np.ones(len(out), bool)
        mine[spaced[:-1]] = False
        out[mine] = data[off[lo] : off[hi]]
        yield lo, hi, Lattice(vocabulary, tables, out, spaced)
        lo = hi


def _words_of(table: pa.Table) -> pa.Table:
    train, rest = Counter(), Counter()
    for text, out in zip(table.column("text"), table.column("held_out").to_pylist(), strict=True):
        (rest if out else train).update(tokens(text.as_py()))
    words = list(train.keys() | rest.keys())
    group = table.column("grp")[0].as_py()
    return pa.table({"grp": pa.array([group] * len(words), pa.int32()), "word": pa.array(words, pa.binary()), "n": pa.array([train[w] for w in words], pa.int64())})


def _expect(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, total = vocabulary.tables(), np.zeros(len(vocabulary.ids))
        for b in batches:
            times = b.column("n").to_numpy().astype(float)
            for lo, hi, lattice in _lattices(b.column("word"), vocabulary, tables):
                total += lattice.expected(times[lo:hi], len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "count"])
    return lean(run)


def _marginals(vocabulary: Vocabulary, stop: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabulary.tables()
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, hi, lattice in _lattices(b.column("word"), vocabulary, tables):
                out[lo:hi] = (lattice.totals() + np.log(stop)) / np.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=["word", "n", "lp"])
    return lean(run)


def _score(n_train: int, v: int, n_ends: int, discount: float):
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        count, lattice = words.column("n").to_numpy().astype(float), words.column("lp").to_numpy()
        base = np.log10((count + 0.1) / (n_train + 0.1 * (v + 1)))
        if n_train:
            seen = v - (n_ends > 0)
            own = np.log10(np.maximum(count - discount, 0) / n_train + discount * seen / n_train * 10.0**lattice)
            # Where the lattice's share is too small for a double, it is all there is for an unseen word.
            unseen = count == 0
            own[unseen] = np.log10(max(discount * seen, 1e-9) / n_train) + lattice[unseen]
        else:
            own = np.log10(0.5) + lattice
        end = n_ends / n_train if n_train else 0.5
        # Where training texts have no word at all, an end is all that the model knows.
        whole, end_whole = np.log10(max(1 - end, 1e-300)) + lattice, float(np.log10(end)) if end else -np.inf
        end_base = float(np.log10((n_ends + 0.1) / (n_train + 0.1 * (v + 1))))
        end_own = float(np.log10(n_ends / n_train)) if n_train else float(np.log10(0.5))
        known = count > 0
        place = {w: i for i, w in enumerate(words.column("word").to_pylist())}
        rows = []
        for text in texts.column("text"):
            at = np.array([place[w] for w in tokens(text.as_py())], np.int64)
            rows.append((len(at) + 1, int(known[at].sum()) + (n_ends > 0), float(base[at].sum()) + end_base, float(own[at].sum()) + end_own, float(whole[at].sum()) + end_whole))
        n, k, b, s, w = zip(*rows, strict=True)
        return pa.table({"key": texts.column("key"), "held_out": texts.column("held_out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(k, pa.int64()),
                         "base_score": pa.array(b, pa.float64()), "blended_score": pa.array(s, pa.float64()), "score": pa.array(w, pa.float64())})
    return run


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, rounds: int = ROUNDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, blended_score): one row for each row of docs."""
    held = F.crc32(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0
    keyed = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text")).withColumn("held_out", held)
    size = keyed.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    groups, n_ends = max(1, -(-(size[0] or 0) // group_bytes)), size[1]
    keyed = keyed.withColumn("grp", F.pmod(F.xxhash64("key", "text"), F.lit(groups)).cast("int"))

    own = materialise(keyed.groupBy("grp").applyInArrow(_words_of, "grp int, word binary, n long"), "words")
    words = materialise(own.groupBy("word").agg(F.sum("n").alias("n")), "counts")
    n_words, distinct, once, twice = words.agg(F.sum("n"), *(F.count_if(c) for c in (F.col("n") > 0, F.col("n") == 1, F.col("n") == 2))).first()
    n_train, v = (n_words or 0) + n_ends, distinct + (n_ends > 0)
    discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5

    vocabulary = Vocabulary.load(model)
    known = words.where("n > 0")
    stop = 0.5
    for _ in range(rounds):
        # One row for each piece: bounded by the vocabulary.
        rows = known.mapInArrow(_expect(vocabulary), "piece int, count double").groupBy("piece").agg(F.sum("count").alias("count")).collect()
        count = np.full(len(vocabulary.ids), PRIOR)
        for r in rows:
            count[r["piece"]] += r["count"]
        # The stop of a word is one more symbol among the pieces: as many as there are words.
        times = n_train - n_ends
        total = count.sum() + times + PRIOR
        stop = (times + PRIOR) / total
        vocabulary = vocabulary.with_score(np.log(count / total))
    lp = materialise(words.mapInArrow(_marginals(vocabulary, stop), "word binary, n long, lp double"), "marginals")
    carried = own.select("grp", "word").join(lp, "word")
    kind = docs.schema[key].dataType.simpleString()
    scored = keyed.groupBy("grp").cogroup(carried.groupBy("grp")).applyInArrow(
        _score(n_train, v, n_ends, discount), f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, blended_score double, score double")
    drop_scratch(docs.sparkSession, words)  # the other tables are read by the result
    return scored.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "blended_score")
