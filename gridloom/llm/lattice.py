"""The lattice of a unigram piece vocabulary over short strings, for many strings at once.

Nodes are the places between bytes. An edge is a piece that spells the bytes between its nodes; the
256 byte pieces give every byte an edge of its own, so each string has a segmentation. Edges are found by walking a
table of all prefixes of pieces from every place at once. Forward sums, posterior edge counts and sampled paths run in
NumPy over the edges of a whole block, place by place; beyond LONG bytes, where few strings are left, one
place at a time in plain Python, so a string of any length costs what its bytes cost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ._text import HashIndex, mix, prefix_sums, span_hash

#: The installed vocabulary of the queries; any unigram or BPE model file of the same kind will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Places of a string that are walked for all strings of a block at once.
LONG = 512
#: Paths that are drawn in plain Python once no more than so many are unfinished.
FEW = 8


@dataclass
class Vocabulary:
    """Pieces and the 256 bytes. A space stands for the mark of word starts; pieces that have one behind another byte than a
    space are left out, since texts are cut there (the installed model has none; its runs of spaces stay).

    The arrays go to the executors with the function that uses them: their size is the vocabulary's.
    """

    ids: np.ndarray  # model id of each piece
    buffer: np.ndarray  # all pieces' bytes
    begin: np.ndarray  # where each begins, and the end
    score: np.ndarray  # natural log weights; they sum to one

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Log weights come from the model's own scores.

        Unigram models hold log probabilities. Models of merges hold ranks (0, -1, -2, ...): a rank r
        then weighs 1 / (r + 2), which is how frequency falls with rank. Byte pieces weigh as the last rank.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, pieces, scores = [], [], []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                piece = bytes([int(model.id_to_piece(i)[1:-1], 16)])
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            else:
                piece = model.id_to_piece(i).replace("▁", " ").encode()
                if b" " in piece.lstrip(b" "):
                    continue
            ids.append(i)
            pieces.append(piece)
            scores.append(model.get_score(i) if not model.is_byte(i) else np.nan)
        s = np.array(scores)
        if np.nanmin(s) < -100:
            # Characters that no merge made have scores far below any rank: they count as the last.
            s = -np.log(2.0 - np.maximum(s, -float(len(scores))))
        s = np.where(np.isnan(s), np.nanmin(s), s)
        s -= np.log(np.exp(s).sum())
        return cls(np.array(ids, np.int32), np.frombuffer(b"".join(pieces), np.uint8), np.r_[0, np.cumsum([len(p) for p in pieces])], s)

    def with_score(self, score: np.ndarray) -> Vocabulary:
        return Vocabulary(self.ids, self.buffer, self.begin, score)

    def tables(self) -> Prefixes:
        return Prefixes(self)


class Prefixes:
    """All prefixes of pieces by their hashes; first and second: the pieces that a prefix is (a byte may also be a character), or -1."""

    def __init__(self, vocabulary: Vocabulary):
        begin, size = vocabulary.begin[:-1], np.diff(vocabulary.begin)
        self.widest = int(size.max(initial=0))
        p = prefix_sums(vocabulary.buffer)
        piece = np.repeat(np.arange(len(size)), size)
        upto = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size) + 1
        h = span_hash(p, begin[piece], begin[piece] + upto)
        keys, at = np.unique(h, return_inverse=True)
        self.index = HashIndex(keys)
        self.first, self.second = (np.full(len(keys) + 1, -1, np.int32) for _ in range(2))
        whole = upto == size[piece]
        for node, i in zip(at[whole].tolist(), piece[whole].tolist(), strict=True):
            (self.first if self.first[node] < 0 else self.second)[node] = i


class Lattice:
    """Edges of all strings data[off[i]:off[i + 1]]; node of place j in string i: off[i] + i + j."""

    def __init__(self, vocabulary: Vocabulary, tables: Prefixes, data: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        size = np.diff(off)
        self.first = off[:-1] + np.arange(n)
        self.last = self.first + size
        self.nodes = int(off[-1]) + n
        if self.nodes >= 1 << 31:
            raise ValueError("too many bytes for one lattice")
        # Nodes, pieces and depths are held in 32 bits or fewer: edges outnumber bytes several times.
        string = np.repeat(np.arange(n, dtype=np.int32), size)
        at = np.arange(len(data), dtype=np.int32)
        left = np.repeat(off[1:], size).astype(np.int32) - at  # bytes to the string's end
        p = prefix_sums(data)
        src, dst, piece = [], [], []
        for width in range(1, tables.widest + 1):
            if width > 1:
                at = at[left[at] >= width]
            if not len(at):
                break
            # Places go on while what they spell so far begins some piece.
            node = tables.index.find(span_hash(p, at, at + np.int32(width)))
            on = node >= 0
            at, node = at[on], node[on]
            for found in (tables.first[node], tables.second[node]):
                hit = found >= 0
                if hit.any():
                    where = at[hit]
                    begin = where + string[where]
                    src.append(begin)
                    dst.append(begin + np.int32(width))
                    piece.append(found[hit])
        del p, left
        src, dst, piece = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (src, dst, piece))
        by = np.argsort(dst, kind="stable")
        self.src, self.dst, self.piece = src[by], dst[by], piece[by]
        self.weights = vocabulary.score
        start = np.repeat(self.first, size + 1).astype(np.int32)  # the first node of each node's string
        depth = self.dst - start[self.dst]
        self.depth = depth.astype(np.uint16) if len(depth) and depth.max() < 65536 else depth

    @property
    def score(self) -> np.ndarray:
        return self.weights[self.piece]

    def _steps(self, depth: np.ndarray, node: np.ndarray):
        """Edges of depths up to LONG in rounds of one depth, within a round by node: (edges, first of each node, nodes). Then the rest, in that order."""
        by = np.arange(len(node), dtype=np.int32) if node is self.dst else np.argsort(node, kind="stable")
        d = depth if node is self.dst else depth[by]
        by = by[np.argsort(d.astype(np.uint16) if len(d) and d.max() < 65536 else d, kind="stable")]
        d = depth[by]
        far = int(np.searchsorted(d, LONG, "right"))
        cut = np.r_[np.flatnonzero(np.r_[True, d[1:far] != d[: far - 1]]), far] if far else []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            e = by[a:b]
            start = np.flatnonzero(np.r_[True, node[e][1:] != node[e][:-1]])
            yield e, start, node[e[start]]
        if far < len(by):
            yield by[far:], None, None

    def _sums(self, into: np.ndarray, of: np.ndarray, depth: np.ndarray, zero: np.ndarray) -> np.ndarray:
        out = np.full(self.nodes, -np.inf)
        out[zero] = 0.0
        for e, start, nodes in self._steps(depth, into):
            if start is None:
                self._long_sums(out, into[e].tolist(), of[e].tolist(), self.weights[self.piece[e]].tolist())
                continue
            v = out[of[e]] + self.weights[self.piece[e]]
            top = np.maximum.reduceat(v, start)
            out[nodes] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.r_[start, len(e)]))), start))
        return out

    @staticmethod
    def _long_sums(out: np.ndarray, into: list, of: list, weight: list) -> None:
        """The same sums for the edges of long strings, which come in an order that has each node's sources first."""
        got: dict[int, float] = {}
        at, n = 0, len(into)
        while at < n:
            node, upto, v = into[at], at, []
            while upto < n and into[upto] == node:
                o = of[upto]
                v.append((got[o] if o in got else float(out[o])) + weight[upto])
                upto += 1
            top = max(v)
            got[node] = top + math.log(sum(math.exp(x - top) for x in v)) if top > -math.inf else top
            at = upto
        out[np.fromiter(got.keys(), np.int64, len(got))] = np.fromiter(got.values(), float, len(got))

    def forward(self) -> np.ndarray:
        """Log of the summed weight of all segmentations up to each node."""
        return self._sums(self.dst, self.src, self.depth, self.first)

    def totals(self) -> np.ndarray:
        """Log marginal of each string."""
        return self.forward()[self.last]

    def expected(self, weight: np.ndarray, pieces: int) -> np.ndarray:
        """How often each piece is used, over all segmentations by their posterior, string i counting weight[i]."""
        ahead = self.forward()
        string = np.searchsorted(self.first, self.src, "right") - 1
        back = self._sums(self.src, self.dst, (self.last[string] - self.src).astype(np.int32), self.last)
        post = np.exp(ahead[self.src] + self.score + back[self.dst] - ahead[self.last[string]])
        return np.bincount(self.piece, weights=post * weight[string], minlength=pieces)


class Sampler:
    """Paths drawn backwards from the forward sums (the filter) of a block of strings."""

    def __init__(self, lattice: Lattice):
        ahead = lattice.forward()
        p = ahead[lattice.src]
        p += lattice.score
        p -= ahead[lattice.dst]
        np.exp(p, out=p)
        start = np.flatnonzero(np.r_[True, lattice.dst[1:] != lattice.dst[:-1]]) if len(p) else np.zeros(0, np.int64)
        n = np.diff(np.r_[start, len(p)])
        # Upper end of each edge's share of [0, 1) at its node; a node's edges stand together, their shares sum to one.
        total = np.cumsum(p)
        total -= np.repeat(total[start] - p[start], n)
        self.upto = total.astype(np.float32)
        self.upto[start + n - 1] = 1.0
        self.start = np.zeros(lattice.nodes, np.int32)
        self.start[lattice.dst[start]] = start
        self.edge_src, self.edge_piece = lattice.src, lattice.piece
        self.first, self.last = lattice.first, lattice.last

    def draw(self, string: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrence, piece) pairs, occurrences in order and pieces of each from left to right.

        string: which string each occurrence is; seed and place: its row's seed and byte place in its
        text, which fix the uniform number drawn at each of its nodes.
        """
        node, todo = self.last[string], np.arange(len(string))
        shift = place - self.first[string]
        who, what = [], []
        while len(todo) > FEW or len(todo) and len(who) < 64:
            u = (mix(seed[todo] ^ mix((node + shift[todo]).astype(np.uint64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e = self.start[node]
            over = np.flatnonzero(self.upto[e] <= u)
            while len(over):
                e[over] += 1
                over = over[self.upto[e[over]] <= u[over]]
            who.append(todo)
            what.append(self.edge_piece[e])
            node = self.edge_src[e]
            on = node > self.first[string[todo]]
            node, todo = node[on], todo[on]
        if len(todo):
            own, taken = [], []
            for i, at in zip(todo.tolist(), node.tolist(), strict=True):
                self._long_draw(at, int(self.first[string[i]]), int(seed[i]), int(shift[i]), i, own, taken)
            who.append(np.array(own, np.int64))
            what.append(np.array(taken, np.int64))
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, q = np.concatenate(who), np.concatenate(what)
        by = np.argsort(w[::-1], kind="stable")  # later steps are further left
        return w[::-1][by], q[::-1][by]

    def _long_draw(self, node: int, first: int, seed: int, shift: int, who: int, own: list, taken: list) -> None:
        """One path by itself: the same numbers, one place at a time."""
        start, upto, src, piece = self.start, self.upto, self.edge_src, self.edge_piece
        while node > first:
            u = (_mix1(seed ^ _mix1(node + shift)) >> 11) * 2.0**-53
            e = int(start[node])
            while float(upto[e]) <= u:
                e += 1
            own.append(who)
            taken.append(int(piece[e]))
            node = int(src[e])


def _mix1(x: int) -> int:
    """mix() of one number."""
    x &= _ALL
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


_ALL = (1 << 64) - 1
