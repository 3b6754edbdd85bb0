"""SentencePiece encoding and decoding with exact N-best segmentations.

The first result is the model's own encoding of the whole text, put together from that of its segments (below), over
which no merge reaches. The model merges pairs by rank, so this is in general
not the segmentation with the largest sum of scores. The alternatives after it are the lattice's segmentations with the
largest sums, in falling order, without the model's own; their sums can exceed the first.

For the lattice a text is normalised as the model does, and cut before each run of the space mark: no piece of the vocabulary reaches
over such a cut (checked when the model is loaded), so the lattice of the text is the chain of the lattices of its
segments; a segment is cut further between characters that no piece holds side by side. For each part, a forward Viterbi
pass gives the best score up to every position and the score of the second choice; the N best of a text are the N
smallest sums of losses, and only the N - 1 parts with the smallest losses of a second choice can take part in them.
For these, A* search from the end over partial paths uses the forward scores as its exact heuristic and so yields
complete segmentations in falling order. The alternatives chosen are carried along and give the ids.

Decoding joins the pieces' bytes, drops the space mark that the model puts before a text and turns the other marks into
spaces. A text that holds the mark itself comes back with spaces in its place: ``round_trip`` is false there.

Characters that no piece covers fall back to byte pieces with the model's scores. Ties come in the order in which the
search meets them, which depends on the segment alone. Null counts as empty text: no pieces, score 0, one segmentation. Repeated
rows get a row each; extra columns are ignored; an empty table gives an empty result. A very long text is worked whole,
in memory in proportion to it.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_executors, prepare

SPACE = "▁"
SCHEMA = "doc_id long, n_pieces long, ids array<int>, packed binary, best_score double, nbest_ids array<array<int>>, nbest_scores array<double>, decoded string, round_trip boolean"
#: Bytes of ids after which a task hands its rows on.
FLUSH_BYTES = 8 << 20
#: Segmentations, best first: the ids of each as little-endian u32, and the score of each.
Best = tuple[tuple[bytes, ...], tuple[float, ...]]
_models: dict[str, PieceModel] = {}


#: Characters of the texts whose segments are learnt at a time.
TOGETHER = 1 << 22
#: Of the hash of an edge of the trie: a factor modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


class Runs:
    """Short arrays in a row; the k-th is ``flat[at[k] : at[k + 1]]``."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.at = flat, np.r_[0, np.cumsum(sizes, dtype=np.int64)]

    def take(self, which: np.ndarray) -> Runs:
        sizes = np.diff(self.at)[which]
        out = Runs(self.flat, sizes)
        out.flat = self.flat[np.repeat(self.at[which] - out.at[:-1], sizes) + np.arange(out.at[-1])]
        return out

    def plus(self, more: Runs) -> Runs:
        return Runs(np.concatenate([self.flat, more.flat]), np.diff(np.r_[self.at, self.at[-1] + more.at[1:]]))

    def of(self, k: int) -> np.ndarray:
        return self.flat[self.at[k] : self.at[k + 1]]


class Segments:
    """What is known of distinct segments, in columns: ids and score of the model's encoding; ids, score and smallest loss of the lattice's best; of each of its links, characters and loss of the second choice (inf: none)."""

    def __init__(self, names: list[str], own: Runs, best: Runs, chars: Runs, losses: Runs, score: np.ndarray, total: np.ndarray, loss: np.ndarray):
        self.place = {s: k for k, s in enumerate(names)}
        self.own, self.best, self.chars, self.losses, self.score, self.total, self.loss = own, best, chars, losses, score, total, loss

    @staticmethod
    def none() -> Segments:
        ids, chars, real = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0)
        return Segments([], Runs(ids, chars), Runs(ids, chars), Runs(chars, chars), Runs(real, chars), real, real, real)

    def only(self, names: list[str]) -> Segments:
        """Those of ``names`` alone, all known."""
        k = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        return Segments(names, *[c.take(k) for c in (self.own, self.best, self.chars, self.losses)], *[c[k] for c in (self.score, self.total, self.loss)])

    def add(self, more: Segments) -> None:
        """Put others, none known, behind these."""
        self.place.update(zip(more.place, range(len(self.place), len(self.place) + len(more.place)), strict=True))
        self.own, self.best, self.chars, self.losses = self.own.plus(more.own), self.best.plus(more.best), self.chars.plus(more.chars), self.losses.plus(more.losses)
        self.score, self.total, self.loss = (np.concatenate(c) for c in ((self.score, more.score), (self.total, more.total), (self.loss, more.loss)))


class Batch:
    """Some texts, as the columns of their segments in order."""

    def __init__(self, m: PieceModel, texts: list[str]):
        self.names, codes, self.ends = m.cuts(texts)
        self.known, place = m.learn(self.names)
        self.codes, self.place = codes, place[codes]
        self.score, self.total, self.loss = (c[self.place] for c in (self.known.score, self.known.total, self.known.loss))
        self.own, self.best = self.known.own.take(self.place), self.known.best.take(self.place)
        #: The bytes of the model's pieces, and where those of each text end.
        taken = m.bytes.take(pa.array(self.own.flat))
        if taken.null_count:
            raise ValueError("a piece without bytes")
        self.bytes, at = taken.buffers()[2], np.frombuffer(taken.buffers()[1], np.int64)
        self.upto = at[self.own.at[self.ends]].tolist() if len(self.own.flat) else [0] * len(self.ends)

    def of(self, k: int) -> Found:
        return Found(self, k)


class Found:
    """The part of a batch that belongs to one text."""

    def __init__(self, batch: Batch, k: int):
        self.batch, self.k, self.start, self.end = batch, k, int(batch.ends[k]), int(batch.ends[k + 1])

    def __len__(self) -> int:
        return self.end - self.start

    def own_ids(self) -> bytes:
        own = self.batch.own
        return own.flat[own.at[self.start] : own.at[self.end]].tobytes()

    def best_ids(self, a: int, b: int) -> bytes:
        """The ids of the lattice's best for the segments from a to b."""
        best = self.batch.best
        return best.flat[best.at[self.start + a] : best.at[self.start + b]].tobytes()

    def score(self) -> float:
        return float(self.batch.score[self.start : self.end].sum())

    def total(self) -> float:
        return float(self.batch.total[self.start : self.end].sum())

    def loss(self) -> np.ndarray:
        return self.batch.loss[self.start : self.end]

    def losses(self, at: int) -> list[float]:
        """Those of the links of a segment."""
        return self.batch.known.losses.of(self.batch.place[self.start + at]).tolist()

    def links(self, at: int) -> list[str]:
        s = self.batch.names[self.batch.codes[self.start + at]]
        ends = np.cumsum(self.batch.known.chars.of(self.batch.place[self.start + at])).tolist()
        return [s[a:b] for a, b in itertools.pairwise([0, *ends])]

    def text(self) -> str:
        """The text that the model's ids decode to."""
        a, b = self.batch.upto[self.k : self.k + 2]
        return self.batch.bytes[a:b].to_pybytes().decode("utf-8", "replace") if a < b else ""


class PieceModel:
    #: With so many segments known, those that the next texts do without are forgotten; so many links searched.
    LIMIT, SEARCHED = 400_000, 100_000
    #: Links of up to so many characters are worked many at a time.
    TOGETHER = 40

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.scores, self.bytes_of, self.byte_id = {}, {}, {}, {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.scores[i] = sp.get_score(i)
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[p], self.scores[i] = i, sp.get_score(i)
                self.bytes_of[i] = p.encode()
                if SPACE in p.lstrip(SPACE):
                    raise ValueError(f"piece {p!r} reaches over a segment")
        self.score_of = np.array([self.scores.get(i, 0.0) for i in range(sp.get_piece_size())])
        self.longest = max(map(len, self.pieces))
        joined = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.joined = np.unique(np.array([ord(a) << 32 | ord(b) for a, b in joined], np.uint64))
        self.bytes = pa.array([self.bytes_of.get(i) for i in range(sp.get_piece_size())], pa.large_binary())
        self.plant()
        #: As :meth:`cuts`, for one text.
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known = Segments.none()
        self.searched: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def plant(self) -> None:
        """The trie of the pieces: nodes numbered from the root (0), edges in a hash table of open addresses."""
        chars = sorted({c for p in self.pieces for c in p})
        self.kinds = np.uint64(len(chars) + 1)
        self.kind = np.zeros(0x110000, np.uint32)  # 0: in no piece
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        kind, edges, ids = {c: k for k, c in enumerate(chars, 1)}, {}, [-1]
        for p, i in self.pieces.items():
            node = 0
            for c in p:
                key = node * int(self.kinds) + kind[c]
                if (node := edges.get(key, 0)) == 0:
                    node = edges[key] = len(ids)
                    ids.append(-1)
            ids[node] = i
        self.id_at = np.array(ids, np.int64)
        self.score_at = np.where(self.id_at < 0, -math.inf, self.score_of[self.id_at])
        bits = (4 * len(edges)).bit_length()
        self.shift, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.edge, self.to = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)  # no edge has key 0
        keys = np.array(list(edges), np.uint64)
        for key, slot, node in zip(edges, (keys * BASE >> self.shift).tolist(), edges.values(), strict=True):
            while self.edge[slot]:
                slot = (slot + 1) & int(self.last)
            self.edge[slot], self.to[slot] = key, node

    def step(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The nodes that kinds of characters lead to from nodes; 0: none."""
        key = node.astype(np.uint64) * self.kinds + kind
        slot = (key * BASE >> self.shift).astype(np.int64)
        met = self.edge[slot]
        out = np.where(met == key, self.to[slot], 0)
        open_ = np.flatnonzero((met != key) & (met != 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.last
            met = self.edge[slot[open_]]
            hit = met == key[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (met != 0)]
        return out

    def edges(self, s: str, end: int) -> list[tuple[int, tuple[int, ...], float]]:
        """(start, ids, score) of the pieces that end at ``end``, the longest first."""
        get, scores = self.pieces.get, self.scores
        out = [(start, (i,), scores[i]) for start in range(max(0, end - self.longest), end) if (i := get(s[start:end])) is not None]
        if not out or out[-1][0] < end - 1:
            ids = tuple([self.byte_id[b] for b in s[end - 1].encode()])
            out.append((end - 1, ids, sum([scores[i] for i in ids])))
        return out

    @staticmethod
    def viterbi(ways: list[list[tuple[int, tuple[int, ...], float]]]) -> list[float]:
        """The best score up to every position, of the edges by their end."""
        best = [0.0]
        for edges in ways:
            best.append(max([best[start] + score for start, _, score in edges]))
        return best

    def forward(self, s: str) -> tuple[tuple[int, ...], float, float]:
        """(ids, score) of the best segmentation and the score of the second best (-inf: none), in one forward pass."""
        get, scores, longest = self.pieces.get, self.scores, self.longest
        best, second, back = [0.0], [-math.inf], [(0, ())]
        for end in range(1, len(s) + 1):
            b1 = b2 = -math.inf
            way, at = None, 0
            for start in range(end - longest if end > longest else 0, end):
                i = get(s[start:end])
                if i is not None:
                    score, ids = scores[i], i
                elif start == end - 1:
                    ids = tuple([self.byte_id[b] for b in s[start].encode()])
                    score = sum([scores[k] for k in ids])
                else:
                    continue
                v = best[start] + score
                if v > b1:
                    w = second[start] + score
                    b2 = b1 if b1 > w else w
                    b1, way, at = v, ids, start
                elif v > b2:
                    b2 = v
            best.append(b1)
            second.append(b2)
            back.append((at, way))
        ids, end = [], len(s)
        while end:
            end, way = back[end]
            ids[:0] = way if isinstance(way, tuple) else (way,)
        return tuple(ids), best[-1], second[-1]

    def nbest(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one segment, best first: A* from the end, ordered by exact total score."""
        ways = [self.edges(s, end) for end in range(1, len(s) + 1)]
        best = self.viterbi(ways)
        found: list[tuple[float, tuple[int, ...]]] = []
        # Of equal totals, the path nearest to its end goes first; no position takes part in more than n suffixes.
        heap, tick, left = [(-best[-1], len(s), 0, 0.0, None)], 0, [n] * (len(s) + 1)
        while heap and len(found) < n:
            total, at, _, behind, path = heapq.heappop(heap)
            left[at] -= 1
            if left[at] < 0:
                continue
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((-total, tuple(ids)))
                continue
            for start, piece, score in ways[at - 1]:
                if left[start] > 0:
                    tick += 1
                    heapq.heappush(heap, (-(best[start] + score + behind), start, tick, behind + score, (piece, path)))
        return found

    def forward_all(self, text: str, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[Runs, np.ndarray, np.ndarray]:
        """:meth:`forward` of many links, given by place and length in a text and its code points."""
        n = len(start)
        best, second, slow = np.zeros(n), np.zeros(n), size > self.TOGETHER
        few = np.flatnonzero(~slow)
        few = few[np.argsort(-size[few], kind="stable")]
        ids, best[few], second[few], plain = self.forward_together(codes, start[few], size[few])
        slow[few[~plain]] = True  # long, or with bytes on its best path
        more = []
        for k in np.flatnonzero(slow).tolist():
            own, best[k], second[k] = self.forward(text[start[k] : start[k] + size[k]])
            more.append(own)
        which = np.zeros(n, np.int64)
        which[few] = np.arange(len(few))
        which[slow] = len(few) + np.arange(len(more))
        sizes = np.fromiter(map(len, more), np.int64, len(more))
        return ids.plus(Runs(np.fromiter(itertools.chain.from_iterable(more), "<u4"), sizes)).take(which), best, second

    def forward_together(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
        """Of links that come by falling length: ids, best, second, and whether the ids are pieces of the vocabulary alone.

        Every position hands its sums on along the trie's edges, for all links that have the position. A character
        that is in no piece is a link by itself, so no walk goes on from the root.
        """
        n, longest = len(start), int(size[0]) if len(size) else 0
        upto = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # links with a k-th character
        kinds = [self.kind[codes[start[:m] + k]] for k, m in enumerate(upto.tolist())]
        best, second = ([np.full(m, x) for m in (n, *upto.tolist())] for x in (-math.inf, -math.inf))
        came, id_of = ([np.zeros(m, np.int64) for m in (n, *upto.tolist())] for _ in range(2))
        best[0][:] = 0
        for k in range(longest):
            links, node, d = np.arange(upto[k]), self.step(np.zeros(upto[k], np.int64), kinds[k]), 0
            while len(links):
                d += 1
                ids, scores = self.id_at[node], self.score_at[node]
                if d == 1:
                    for j in np.flatnonzero(ids < 0).tolist():
                        scores[j] = sum([self.scores[self.byte_id[x]] for x in chr(codes[start[j] + k]).encode("utf-8", "surrogatepass")])
                    at = links
                else:
                    hit = ids >= 0
                    at, ids, scores = links[hit], ids[hit], scores[hit]
                v, w, b = best[k][at] + scores, second[k][at] + scores, best[k + d][at]
                better = v > b
                second[k + d][at] = np.where(better, np.maximum(b, w), np.maximum(second[k + d][at], v))
                at = at[better]
                best[k + d][at], came[k + d][at], id_of[k + d][at] = v[better], d, ids[better]
                if k + d == longest or d == self.longest:
                    break
                few = np.searchsorted(links, upto[k + d])
                links, node = links[:few], node[:few]
                node = self.step(node, kinds[k + d][links])
                links, node = links[node > 0], node[node > 0]
        base = np.cumsum([0, n, *upto.tolist()])
        best, second, came, id_of = map(np.concatenate, (best, second, came, id_of))
        back, ends, at, every = np.zeros(size.sum(), "<u4"), np.cumsum(size), size.copy(), np.arange(n)
        count, plain = np.zeros(n, np.int64), np.ones(n, bool)
        while len(every):
            here = base[at[every]] + every
            plain[every[id_of[here] < 0]] = False
            count[every] += 1
            back[ends[every] - count[every]] = id_of[here].astype("<u4")
            at[every] -= came[here]
            every = every[at[every] > 0]
        own = Runs(back, size)
        # A link's ids are the last of its run.
        skip = np.repeat(size - count, size) <= np.arange(len(back)) - np.repeat(own.at[:-1], size)
        last = base[size] + np.arange(n)
        return Runs(back[skip], count), best[last], second[last], plain

    def columns(self, new: list[str]) -> Segments:
        """What is to be known of these segments."""
        # The model puts the mark before a text and merges nothing over a cut: the ids of a segment are those in its text.
        own = self.sp.encode([s[1:].replace(SPACE, " ") for s in new], num_threads=1)
        own = [ids or list(self.forward(s)[0]) for s, ids in zip(new, own, strict=True)]  # a mark alone is no text
        own = Runs(np.fromiter(itertools.chain.from_iterable(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)))
        text = "".join(new)
        raw, codes = text.encode("utf-8", "surrogatepass"), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        # Cut into links between neighbouring characters that no piece holds side by side: no edge crosses such a cut.
        first = np.ones(len(codes), bool)
        pairs = codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:]
        first[1:] = self.joined[np.minimum(np.searchsorted(self.joined, pairs), len(self.joined) - 1)] != pairs
        begin = np.cumsum([0, *map(len, new)])
        first[begin[:-1]] = True
        start = np.flatnonzero(first)
        size = np.diff(np.r_[start, len(codes)])
        at = np.searchsorted(start, begin)
        bytes_at = np.r_[0, np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), dtype=np.int64)]
        which = distinct(raw, bytes_at[np.r_[start, len(codes)]]).indices.to_numpy()
        one = np.zeros(which.max() + 1, np.int64)
        one[which] = np.arange(len(which))
        ids, best, second = self.forward_all(text, codes, start[one], size[one])
        best, loss = best[which], (best - second)[which]
        ids = ids.take(which)
        return Segments(
            new, own, Runs(ids.flat, np.diff(ids.at[at])), Runs(size, np.diff(at)), Runs(loss, np.diff(at)),
            np.add.reduceat(self.score_of[own.flat], own.at[:-1]), np.add.reduceat(best, at[:-1]), np.minimum.reduceat(loss, at[:-1]),
        )

    def learn(self, segments: list[str]) -> tuple[Segments, np.ndarray]:
        """The columns of what is known, and the places of these distinct segments there."""
        if len(self.known.place) >= self.LIMIT:
            self.known = self.known.only([s for s in segments if s in self.known.place])
        new = [s for s in segments if s not in self.known.place]
        if new:
            self.known.add(self.columns(new))
        return self.known, np.fromiter(map(self.known.place.__getitem__, segments), np.int64, len(segments))

    def forget(self) -> None:
        self.known, self.searched = Segments.none(), {}

    def alternatives(self, link: str, n: int) -> list[tuple[float, bytes]]:
        key = (link, n)
        if (got := self.searched.get(key)) is None:
            if len(self.searched) >= self.SEARCHED:
                self.searched = {}
            got = self.searched[key] = [(score, np.array(ids, "<u4").tobytes()) for score, ids in self.nbest(link, n)]
        return got

    def normalize(self, text: str) -> str:
        return self.sp.normalize(text) if text else ""

    def cuts(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct segments of some texts; those of all texts in order, as places among them; where each text's begin."""
        each = [self.normalize(t).encode() for t in texts]
        ends, raw = np.cumsum([0, *map(len, each)]), b"".join(each)
        b = np.frombuffer(raw, np.uint8)
        mark = np.zeros(len(b), bool)
        mark[:-2] = (b[:-2] == 0xE2) & (b[1:-1] == 0x96) & (b[2:] == 0x81)
        first = mark.copy()
        first[3:] &= ~mark[:-3]
        first[ends[:-1][np.diff(ends) > 0]] = True
        start = np.flatnonzero(first)
        found = distinct(raw, np.r_[start, len(b)])
        return found.dictionary.to_pylist(), found.indices.to_numpy(), np.searchsorted(start, ends)

    def best(self, found: Found, n: int) -> Best:
        """The n best segmentations of a text.

        Only the n - 1 links with the smallest losses of a second choice can take part in the n best sums, so A* runs
        for these alone.
        """
        total, loss = found.total(), found.loss()
        if n < 2 or not len(found):
            return (found.best_ids(0, len(found)),), (total,)
        limit = np.partition(loss, min(n - 1, len(loss)) - 1)[min(n - 1, len(loss)) - 1]
        first = np.flatnonzero((loss <= limit) & (loss < math.inf))
        first = first[np.argsort(loss[first], kind="stable")[: n - 1]].tolist()
        many = sorted([(x, at, k) for at in first for k, x in enumerate(found.losses(at)) if x < math.inf])[: n - 1]
        # (loss, the alternatives taken as (segment, link, which)); the first is the best segmentation of every part.
        ways: list[tuple[float, tuple[tuple[int, int, int], ...]]] = [(0.0, ())]
        places = sorted({at for _, at, _ in many})
        links = {at: found.links(at) for at in places}
        for _, at, k in many:
            choices = self.alternatives(links[at][k], n)
            ways = sorted([(x + choices[0][0] - score, (*taken, (at, k, j))) for x, taken in ways for j, (score, _) in enumerate(choices)], key=lambda w: w[0])[:n]
        start, around = 0, []
        for k in [*places, len(found)]:
            around.append(found.best_ids(start, k))
            start = k + 1
        out = []
        for _, taken in ways:
            which, ids = {(p, k): j for p, k, j in taken}, [around[0]]
            for p, after in zip(places, around[1:], strict=True):
                ids += [self.alternatives(link, n)[which.get((p, k), 0)][1] for k, link in enumerate(links[p])]
                ids.append(after)
            out.append(b"".join(ids))
        return tuple(out), tuple([total - x for x, _ in ways])

    def lattice(self, text: str, n: int) -> Best:
        """The n segmentations of a text with the largest sums of scores."""
        return self.best(Batch(self, [text]).of(0), n)

    def encode(self, text: str, n: int) -> tuple[bytes, list[float]]:
        """Ids of the lattice's best segmentation of a text, and the scores of its n best."""
        ids, scores = self.lattice(text, n)
        return ids[0], list(scores)

    def results(self, texts: list[str], n: int) -> Iterator[tuple[list[bytes], list[float], str]]:
        """Of each text, ids and scores of the model's encoding and of the n - 1 best other segmentations, and the text decoded from the first."""
        while texts:
            size, few = 0, 0
            while few < len(texts) and size < TOGETHER:
                size += len(texts[few])
                few += 1
            yield from self.results_together(texts[:few], n)
            texts = texts[few:]

    def results_together(self, texts: list[str], n: int) -> list[tuple[list[bytes], list[float], str]]:
        batch = Batch(self, texts)
        return [self.result(batch.of(k), n) for k in range(len(texts))]

    def result(self, found: Found, n: int) -> tuple[list[bytes], list[float], str]:
        own = found.own_ids()
        others = [x for x in zip(*self.best(found, n), strict=True) if x[0] != own][: n - 1] if n > 1 else []
        return [own, *[ids for ids, _ in others]], [found.score(), *[x for _, x in others]], self.spaced(found.text())

    def decode(self, ids: bytes) -> str:
        """The normalised text of ids."""
        return b"".join([self.bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")

    @staticmethod
    def spaced(text: str) -> str:
        """Without the mark that the model puts before a text, other marks as spaces."""
        return text.removeprefix(SPACE).replace(SPACE, " ")

    def plain(self, ids: bytes) -> str:
        """The text of ids."""
        return self.spaced(self.decode(ids))


def distinct(raw: bytes, at: np.ndarray) -> pa.DictionaryArray:
    """The strings of which each begins in UTF-8 at ``at`` and ends where the next begins, as places among the distinct ones."""
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def lists(blobs: list[bytes]) -> pa.ListArray:
    """Ids as lists of 32-bit integers."""
    ends = np.cumsum([0, *[len(x) // 4 for x in blobs]]).astype("<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), "<i4")))


def table_of(rows: list[tuple[int, list[bytes], list[float], str, bool]]) -> pa.RecordBatch:
    ids, found, scores, plain, same = ([r[k] for r in rows] for k in range(5))
    ends = np.cumsum([0, *[len(x) for x in found]]).astype("<i4")
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(x[0]) // 4 for x in found], pa.int64()),
        lists([x[0] for x in found]),
        pa.array([x[0] for x in found], pa.binary()),
        pa.array([x[0] for x in scores], pa.float64()),
        pa.ListArray.from_arrays(pa.array(ends), lists([x for f in found for x in f])),
        pa.array(scores, pa.list_(pa.float64())),
        pa.array(plain, pa.string()),
        pa.array(same, pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def encode_pieces(docs: DataFrame, model_path: str, n_best: int = 4) -> DataFrame:
    """One row per document: the model's ids (packed: the same as little-endian u32) and their score, ids and scores of the n best (the model's first), the text decoded from the model's ids, and whether it is the document's."""
    prepare(docs.sparkSession)
    local = on_executors(docs.sparkSession, model_path)

    def run(batches):
        m = model(local())
        try:
            yield from rows_of(m, batches)
        finally:
            m.forget()  # workers live on; the next operator needs the memory

    def rows_of(m, batches):
        for b in batches:
            rows, size = [], 0
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, text, (found, scores, back) in zip(b.column(0).to_pylist(), texts, m.results(texts, n_best), strict=True):
                rows.append((i, found, scores, back, back == text))
                size += sum([len(x) for x in found])
                if size >= FLUSH_BYTES:
                    yield table_of(rows)
                    rows, size = [], 0
            if rows:
                yield table_of(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The rows of :func:`encode_pieces` with hashes for ids and text."""
    return pieces.select("doc_id", "n_pieces", F.crc32("packed").alias("ids_crc32"), "best_score", "nbest_scores", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), "round_trip", F.xxhash64("nbest_ids").alias("nbest_xxhash64"))
