"""SentencePiece encoding by sampling: forward filtering, backward sampling over the piece lattice; lossless decoding.

A text is taken as words that are led by the space sign, as the vocabulary has them: every space is a sign, and one more
sign stands before the first word. The lattice of a word has a node at each byte boundary and an edge for each piece that
matches; a character that no one-character piece covers, or a sign of the text itself, has one edge that stands for its
byte pieces. A piece of rank r weighs 1 / (r + SHIFT) ** theta (frequencies of merge-ranked pieces fall about so). A node
that no edge passes over cuts the word, and each segment between cuts is a lattice of its own, so long runs without spaces
are many short lattices. Forward weights of each distinct word are computed once for a batch; then each occurrence is
sampled backward, all segments at a time in numpy; the few that are longer than LONG are done edge by edge. The random
number of a step is a hash of the seed, the row key, and the place of the step in the text, so a row is segmented alike
on any machine, in any batch and on any retry; rows with one key and one text are segmented alike.

Nulls: a null text is empty, as is an empty one: no pieces. A null key counts as the key 0. An empty table gives an empty
result. Other columns are left out.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, texts_of
from .tokens import gather
from .words import mixed, mixed_int

SHIFT, THETA, SEED = 32.0, 1.0, 20_240_501
#: Words whose lattices a Python worker keeps, at about 600 bytes a word. It changes memory and speed, never the pieces.
CACHE_WORDS, EDGES_A_WORD = 200_000, 32
SIGN = "▁"
#: Segments of more characters are filtered edge by edge; so many segments at most are sampled step by step at the end.
LONG, FEW = 512, 12
#: Stands for a sign of the text itself, which is no word's beginning; no character has this number.
LITERAL = 0x110000


class PieceLattice:
    """Vocabulary of a SentencePiece model and the samplers over it. Keeps the lattices of at most cache_size words."""

    def __init__(self, path: str, theta: float = THETA, cache_size: int = CACHE_WORDS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.byte_ids = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(SIGN, " ").encode())
        self.longest = max(map(len, self.ids))
        self.weight = 1.0 / (np.arange(len(self.bytes_of)) + SHIFT) ** theta
        self.weights = self.weight.tolist()
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])])
        self.log_weight = np.log(self.weight)
        # an ASCII character without a piece has one byte piece, which is an edge like any other
        edges = self.ids | {chr(b): int(self.byte_ids[b]) for b in range(128) if chr(b) not in self.ids}
        self.single = np.array(sorted(ord(p) for p in edges if len(p) == 1), np.uint32)
        # for each length the hashes of all beginnings of pieces, and the piece that is that beginning (-1: none)
        self.by_length = {}
        for size in range(1, self.longest + 1):
            begun = {p[:size]: edges.get(p[:size], -1) for p in edges if len(p) >= size}
            points = np.array([[ord(c) for c in p] for p in begun], np.uint64).reshape(-1, size)
            h = np.zeros(len(begun), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(size):
                    h = mixed(h + points[:, k])
            order = np.argsort(h)
            self.by_length[size] = h[order], np.array(list(begun.values()), np.int64)[order]
        # what an edge stands for: itself, or, beyond the vocabulary, the byte pieces of a character (one entry each)
        self.spelled: dict[int, int] = {}
        self.out_ids, self.out_starts = np.arange(len(self.bytes_of)), np.arange(len(self.bytes_of) + 1)
        self.cache_size = cache_size
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        none = np.zeros(0, np.int64)
        #: Segments: first and last node. Words: their first segments. Edges in order of the node they lead to: where from,
        #: which piece, cumulative share. Nodes: their first edges. All in blocks that are joined when they are needed.
        self.segments, self.words = [(none, none)], [np.zeros(1, np.int64)]
        self.edges: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64))]
        self.n_nodes = self.n_edges = self.n_segments = 0

    def _spell(self, points: np.ndarray) -> np.ndarray:
        """The edge of each character that no piece covers."""
        uniq, where = np.unique(points, return_inverse=True)
        new = [p for p in uniq.tolist() if p not in self.spelled]
        if new:
            raw = [chr(p if p != LITERAL else ord(SIGN)).encode("utf-8", "surrogatepass") for p in new]
            ids = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            lens = np.array([len(r) for r in raw])
            self.spelled.update(zip(new, range(len(self.out_starts) - 1, len(self.out_starts) - 1 + len(new))))
            ends = np.cumsum(lens)
            self.log_weight = np.concatenate([self.log_weight, np.add.reduceat(self.log_weight[ids], ends - lens)])
            self.out_starts = np.concatenate([self.out_starts, len(self.out_ids) + ends])
            self.out_ids = np.concatenate([self.out_ids, ids])
        return np.array([self.spelled[p] for p in uniq.tolist()], np.int64)[where]

    def _learn(self, words: list[str]) -> None:
        """Forward filtering of new words, many at a time."""
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
            lens = np.fromiter(map(len, part), np.int64, len(part))
            begin = np.cumsum(lens) - lens
            signs = points == ord(SIGN)
            signs[begin] = False  # the leading sign itself
            points[signs] = LITERAL
            self._learn_part(points, lens)
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))

    def _learn_part(self, points: np.ndarray, lens: np.ndarray) -> None:
        begin = np.cumsum(lens) - lens
        left = np.repeat(begin + lens, lens) - np.arange(len(points))  # characters to the word's end
        node = np.arange(len(points)) + np.repeat(np.arange(len(lens)), lens)  # a word of n characters has n + 1 nodes
        nodes = len(points) + len(lens)
        source, target, piece = [], [], []
        alive, h = np.arange(len(points)), np.zeros(len(points), np.uint64)
        with np.errstate(over="ignore"):
            for size in range(1, self.longest + 1):  # only beginnings of pieces are followed on
                more = left[alive] >= size
                alive, h = alive[more], h[more]
                if not len(alive):
                    break
                h = mixed(h + points[alive + size - 1])
                keys, ids = self.by_length[size]
                found = np.searchsorted(keys, h)
                found[found == len(keys)] = 0
                hit = keys[found] == h
                alive, h, ids = alive[hit], h[hit], ids[found[hit]]
                whole = ids >= 0
                source.append(node[alive[whole]])
                target.append(source[-1] + size)
                piece.append(ids[whole])
        strange = np.flatnonzero(~np.isin(points, self.single))
        if len(strange):
            source.insert(0, node[strange])
            target.insert(0, source[0] + 1)
            piece.insert(0, self._spell(points[strange]))
        # long pieces first: they are the likelier
        source, target, piece = np.concatenate(source[::-1]), np.concatenate(target[::-1]), np.concatenate(piece[::-1])
        order = np.argsort(target, kind="stable")
        source, target, piece = source[order], target[order], piece[order]
        # cuts: nodes that no edge passes over, word ends among them
        word_first = begin + np.arange(len(lens))
        over = np.bincount(source + 1, minlength=nodes + 1) - np.bincount(target, minlength=nodes + 1)
        cuts = np.flatnonzero(np.cumsum(over)[:nodes] == 0)
        is_last = np.zeros(nodes, bool)
        is_last[word_first + lens] = True
        seg_first = cuts[~is_last[cuts]]
        seg_last = cuts[np.searchsorted(cuts, seg_first) + 1]
        segment = np.searchsorted(seg_first, target, "left") - 1
        share = self._shares(source, target, piece, segment, seg_first, seg_last)
        per_word = np.diff(np.append(np.searchsorted(seg_first, word_first), len(seg_first)))
        self.segments.append((seg_first + self.n_nodes, seg_last + self.n_nodes))
        self.words.append(self.n_segments + np.cumsum(per_word))
        into = np.bincount(target, minlength=nodes)
        self.edges.append(((source + self.n_nodes).astype(np.int32), piece.astype(np.int32), share, self.n_edges + np.cumsum(into) - into))
        self.n_nodes, self.n_edges, self.n_segments = self.n_nodes + nodes, self.n_edges + len(source), self.n_segments + len(seg_first)

    def _shares(self, source, target, piece, segment, seg_first, seg_last) -> np.ndarray:
        """Forward filtering: the cumulative share of each edge among the paths that reach its node. By distance from the
        segment's start, all segments at a time, in logarithms."""
        share = np.empty(len(target))
        size = seg_last - seg_first
        long = np.flatnonzero(size > LONG)
        short = np.arange(len(target))
        if len(long):
            cut = np.searchsorted(segment, np.stack([long, long + 1]))
            for s, lo, hi in zip(long.tolist(), *cut.tolist()):
                share[lo:hi] = self._long_shares((source[lo:hi] - seg_first[s]).tolist(), (target[lo:hi] - seg_first[s]).tolist(), np.exp(self.log_weight[piece[lo:hi]]).tolist(), int(size[s]))
            short = np.flatnonzero(size[segment] <= LONG)
        distance = target[short] - seg_first[segment[short]]
        log_alpha = np.zeros(int(target.max(initial=0)) + 1)
        opens = source == seg_first[segment]  # a segment's first node weighs one
        by_distance = short[np.argsort(distance, kind="stable")]
        ends = np.cumsum(np.bincount(distance)) if len(short) else np.zeros(1, np.int64)
        for lo, hi in zip(ends[:-1], ends[1:]):
            e = by_distance[lo:hi]
            if len(e):
                to = target[e]
                head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(e))))
                value = np.where(opens[e], 0.0, log_alpha[source[e]]) + self.log_weight[piece[e]]
                top = np.maximum.reduceat(value, head)
                value = np.exp(value - top[group])
                total = np.add.reduceat(value, head)
                log_alpha[to[head]] = top + np.log(total)
                run = np.cumsum(value)
                run -= np.concatenate([[0.0], run])[head][group]
                value = np.minimum(run / total[group], 1.0)
                value[np.append(head[1:], len(e)) - 1] = 1.0
                share[e] = value
        return share

    def _long_shares(self, source: list[int], target: list[int], weight: list[float], size: int) -> list[float]:
        """The same for one long segment, edge by edge."""
        alpha, out, e = [1.0] + [0.0] * size, [], 0
        while e < len(target):
            to, lo, run = target[e], e, 0.0
            sums = []
            while e < len(target) and target[e] == to:
                run += alpha[source[e]] * weight[e]
                sums.append(run)
                e += 1
            alpha[to] = run
            out += [x / run for x in sums[:-1]] + [1.0]
            if run < 1e-200:  # lift what later edges can start from, which leaves all shares as they are
                for j in range(max(0, to - self.longest), to + 1):
                    alpha[j] *= 1e200
        return out

    def _joined(self):
        if len(self.edges) > 1:
            self.edges = [tuple(np.concatenate(x) for x in zip(*self.edges))]
            self.segments = [tuple(np.concatenate(x) for x in zip(*self.segments))]
            self.words = [np.concatenate(self.words)]
        return *self.segments[0], self.words[0], *self.edges[0]

    def encode(self, texts: pa.Array, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts end to end, and the number of each text's ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if len(self.known) > self.cache_size or self.n_edges > EDGES_A_WORD * self.cache_size:
            self._clear()
        pieces = pc.split_pattern(texts, " ")
        some = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        offsets = pieces.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = pieces.flatten().dictionary_encode()
        known = self.known
        words = [SIGN + w for w in coded.dictionary.to_pylist()]
        new = [w for w in words if w not in known]
        if new:
            self._learn(new)
        number = np.array([known[w] for w in words], np.int64)
        codes = number[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        live = some[text]
        codes, text = codes[live], text[live]
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        seg_first, seg_last, word_start, edge_from, edge_id, share, start = self._joined()
        codes, lens = gather(np.arange(len(seg_first)), word_start, codes)
        text = np.repeat(text, lens)
        in_text = np.bincount(text, minlength=len(texts))
        place = np.arange(len(codes)) - np.repeat(np.cumsum(in_text) - in_text, in_text)
        with np.errstate(over="ignore"):
            stream = mixed(mixed(keys.astype(np.uint64) + np.uint64(seed))[text] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at, goal = seg_last[codes].copy(), seg_first[codes]
        live, steps, step = np.arange(len(codes)), [], 0
        while len(live) > FEW:
            with np.errstate(over="ignore"):
                u = (mixed(stream[live] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = start[at[live]]
            behind = np.flatnonzero(share[edge] <= u)
            while len(behind):
                edge[behind] += 1
                behind = behind[share[edge[behind]] <= u[behind]]
            steps.append((live, edge_id[edge]))
            at[live] = edge_from[edge]
            live = live[at[live] != goal[live]]
            step += 1
        count = np.zeros(len(codes), np.int64)
        for rows, _ in steps:
            count[rows] += 1
        tails = {i: self._walk_back(int(stream[i]), int(at[i]), int(goal[i]), step, edge_from, edge_id, share, start) for i in live.tolist()}
        for i, ids in tails.items():
            count[i] += len(ids)
        # backward order: the last piece of a segment was drawn first
        ends = np.cumsum(count)
        out = np.empty(ends[-1], np.int64)
        for k, (rows, ids) in enumerate(steps):
            out[ends[rows] - 1 - k] = ids
        for i, ids in tails.items():
            out[ends[i] - count[i] : ends[i] - len(steps)] = ids[::-1]
        count = np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)
        if len(out) and out.max() >= len(self.bytes_of):  # characters that are spelled in byte pieces
            out, lens = gather(self.out_ids, self.out_starts, out)
            count = np.diff(np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(count)])])
        return out, count

    @staticmethod
    def _walk_back(stream: int, at: int, goal: int, step: int, edge_from, edge_id, share, start) -> list[int]:
        """The steps that are left of one long segment."""
        out = []
        while at != goal:
            u = (mixed_int(stream + step) >> 11) * 2.0**-53
            edge = int(start[at])
            while share[edge] <= u:
                edge += 1
            out.append(int(edge_id[edge]))
            at = int(edge_from[edge])
            step += 1
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text again: pieces end to end without the first sign."""
        raw, lens = gather(self.flat, self.starts, ids)
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
        data = raw.tobytes()
        return [data[a + 1 : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


_LATTICES: dict[tuple[str, float], PieceLattice] = {}


def lattice(path: str, theta: float = THETA, cache_size: int = CACHE_WORDS) -> PieceLattice:
    """One lattice for each Python worker, kept between tasks."""
    if (path, theta) not in _LATTICES:
        _LATTICES[path, theta] = PieceLattice(path, theta)
    _LATTICES[path, theta].cache_size = cache_size
    return _LATTICES[path, theta]


def _encode(batches, path: str, theta: float, seed: int, cache_size: int):
    model = lattice(path, theta, cache_size)
    for rows in batches:
        for part in slices(rows, 1, 2 << 20):
            texts = texts_of(part.column(1))
            keys = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            ids, counts = model.encode(texts, keys, seed)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array([x.decode("utf-8", "surrogatepass") for x in model.decode(ids, counts)], pa.string())], names=["doc_id", "pieces", "decoded"])
    model._clear()  # a worker that goes on to other work keeps the vocabulary only


def encode_pieces(docs: DataFrame, path: str, theta: float = THETA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", cache_size: int = CACHE_WORDS) -> DataFrame:
    """Per row: doc_id, pieces (ids), decoded (the text again). One pass, no shuffle."""
    return id_text(docs, id_col, text_col).mapInArrow(partial(_encode, path=path, theta=theta, seed=seed, cache_size=cache_size), "doc_id long, pieces array<int>, decoded string")


def _digest(batches, path: str, theta: float, seed: int):
    import zlib

    model = lattice(path, theta)
    for rows in batches:
        for part in slices(rows, 1, 2 << 20):
            texts = texts_of(part.column(1))
            ids, counts = model.encode(texts, part.column(0).fill_null(0).to_numpy(zero_copy_only=False), seed)
            ends = np.cumsum(counts)
            raw = ids.astype("<u4")
            crcs = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip((ends - counts).tolist(), ends.tolist())]
            same = [a == b for a, b in zip(model.decode(ids, counts), pc.cast(texts, pa.large_binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "pieces_crc32", "lossless"])


def piece_digests(docs: DataFrame, path: str, theta: float = THETA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_pieces, pieces_crc32 (ids as little-endian 32-bit numbers), lossless (decoding gave the text)."""
    return id_text(docs, id_col, text_col).mapInArrow(partial(_digest, path=path, theta=theta, seed=seed), "doc_id long, n_pieces long, pieces_crc32 long, lossless boolean")
