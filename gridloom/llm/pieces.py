"""Sampled segmentations of whole texts by forward filtering and backward sampling, and their decoding.

Every text is cut before each space that follows another byte than a space; no piece of the vocabulary reaches over such a cut, so a path over
the text's piece lattice is one path for each part. The forward sums of each distinct part are
filtered once per block; the backward pass then draws each occurrence's pieces. The uniform
number at a place follows from the seed, the row's key and the place alone: the same key and text give
the same pieces on any cluster, and another row with the same text gets a sample of its own.

Bytes are the base of the lattice: whatever no piece spells is spelt by byte pieces, the mark of
word starts in the text itself included, so decoding gives back every text.

Nulls and empty texts have no pieces; decoding gives the empty text. Null keys count as 0. Repeated rows are
sampled alike. The empty table gives an empty result. Columns beside key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import lean, mix, prefix_sums, span_hash, text_chunks
from .lattice import MODEL, Lattice, Prefixes, Sampler, Vocabulary

#: Seed of the draws.
SEED = 1
#: Bytes of text whose distinct parts share a lattice.
BLOCK_BYTES = 1 << 20


def encode_chunk(vocabulary: Vocabulary, tables: Prefixes, data: np.ndarray, off: np.ndarray, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(piece of each draw, text after text; number of pieces of each text)."""
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    cut = data == 0x20
    cut[1:] &= data[:-1] != 0x20
    cut[off[:-1][np.diff(off) > 0]] = True
    begin = np.flatnonzero(cut)
    end = np.r_[begin[1:], len(data)]
    h = span_hash(prefix_sums(data), begin, end)
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    # The distinct parts in one buffer; parts of like length stand together.
    size = (end - begin)[one]
    poff = np.r_[0, np.cumsum(size)]
    at = np.arange(poff[-1]) - np.repeat(poff[:-1], size) + np.repeat(begin[one], size)
    sampler = Sampler(Lattice(vocabulary, tables, data[at], poff))
    row = np.searchsorted(off, begin, "right") - 1
    seeds = mix(mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed)))[row]
    part, piece = sampler.draw(which, seeds, begin - off[row])
    return piece, np.bincount(row[part], minlength=n)


def decode_pieces(vocabulary: Vocabulary, piece: np.ndarray) -> np.ndarray:
    """The bytes that the pieces spell."""
    size = np.diff(vocabulary.begin)[piece]
    off = np.r_[0, np.cumsum(size)]
    return vocabulary.buffer[np.arange(off[-1]) - np.repeat(off[:-1] - vocabulary.begin[piece], size)]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, seed: int = SEED) -> DataFrame:
    """(key, n_pieces, ids: the sampled pieces' model ids, lossless: decoding them gave the text's bytes)."""
    vocabulary = Vocabulary.load(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabulary.tables()
        for b in batches:
            seeds = b.column(2).to_numpy()
            for lo, hi, data, off in text_chunks(b.column(1), BLOCK_BYTES):
                piece, n = encode_chunk(vocabulary, tables, data, off, seeds[lo:hi], seed)
                spelt = decode_pieces(vocabulary, piece)
                pieces_at = np.r_[0, np.cumsum(n)]
                bytes_at = np.r_[0, np.cumsum(np.diff(vocabulary.begin)[piece])][pieces_at]
                same = np.array_equal(bytes_at, off)
                fine = np.array([same and np.array_equal(spelt[off[i] : off[i + 1]], data[off[i] : off[i + 1]]) for i in range(hi - lo)], bool)
                ids = pa.ListArray.from_arrays(pa.array(pieces_at.astype(np.int32)), pa.array(vocabulary.ids[piece]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), ids, pa.array(fine)], names=["key", "n_pieces", "ids", "lossless"])

    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    seeded = F.coalesce(F.col(f"`{key}`").cast("long") if whole else F.xxhash64(F.col(f"`{key}`")), F.lit(0).cast("long"))
    return (docs.select(F.col(f"`{key}`").alias("key"), body.alias("text"), seeded.alias("seed"))
            .mapInArrow(lean(run), f"key {kind}, n_pieces long, ids array<int>, lossless boolean").withColumnRenamed("key", key))


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(key, text): the texts that encode() was given (null ids: null)."""
    vocabulary = Vocabulary.load(model)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(int(vocabulary.ids.max()) + 1, -1, np.int64)
        place[vocabulary.ids] = np.arange(len(vocabulary.ids))
        for b in batches:
            texts = [decode_pieces(vocabulary, place[np.array(x.values, np.int64)]).tobytes().decode() if x.is_valid else None for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return encoded.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids")).mapInArrow(lean(run), f"key {kind}, text string").withColumnRenamed("key", key)
