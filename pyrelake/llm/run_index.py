"""A run-length index (r-index) over many short texts, in numpy.

The Burrows-Wheeler transform of the joined texts is kept by its runs: head, first row, and the text positions at the
first and last row of each run (the sampled run ends). Matching statistics of many patterns are streamed together,
from their last bytes to their first: where the run's head is the next byte, the row maps by LF; elsewhere the match
moves to the nearest run end of that byte above or below, whichever agrees longer with what has been matched.

For matches of at least ``k`` bytes, the rows of equal k-byte strings are an interval; each interval keeps the smallest
document among its texts.
"""

from __future__ import annotations

import numpy as np

#: Matches are followed up to this length; k must be below it.
CAP = 64


def suffix_order(t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all suffixes, sorted to a depth of 112 symbols at least, and whether a row starts a new k-symbol string."""
    n = len(t)
    key = np.zeros(n, np.uint64)
    padded = np.r_[t.astype(np.uint64), np.zeros(7, np.uint64)]
    for i in range(7):
        key = key << np.uint64(9) | padded[i : i + n]
    depth, equal = 7, None
    while True:
        order = np.argsort(key)
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if equal is None and 2 * depth >= k:
            equal = rank, k - depth
        if depth >= 112 or new.all():
            break
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - depth)] = rank[depth:]
        key = rank.astype(np.uint64) << np.uint64(32) | ahead.astype(np.uint64)
        depth *= 2
    if equal is None:  # all suffixes differ before depth k / 2
        equal = rank, 0
    a = equal[0][order]
    b = np.r_[equal[0], np.zeros(equal[1], np.int64)][order + equal[1]]
    return order, np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]


class RunIndex:
    def __init__(self, texts: list[bytes], docs: np.ndarray, k: int):
        self.k = k
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        raw[ends] = 0
        owner = np.repeat(np.asarray(docs, np.int64), [len(t) + 1 for t in texts])
        sa, new = suffix_order(raw, k)
        self.starts = np.flatnonzero(new)
        self.smallest = np.minimum.reduceat(owner[sa], self.starts)
        bwt = raw[sa - 1]
        n = len(sa)
        self.first = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        last = np.r_[self.first[1:], n] - 1
        self.head = bwt[self.first].astype(np.int64)
        self.at_first, self.at_last, self.last = sa[self.first], sa[last], last
        counts = np.bincount(bwt, minlength=258)
        below = np.r_[0, np.cumsum(counts)]
        by_head = np.argsort(self.head, kind="stable")
        length = (last - self.first + 1)[by_head]
        heads = self.head[by_head]
        before = np.cumsum(length) - length  # over all smaller heads too, which is what C counts
        self.lf = np.empty(len(self.first), np.int64)
        self.lf[by_head] = before
        self.by_head, self.n = by_head, n
        self.keys = heads * n + self.first[by_head]
        self.text = np.r_[raw, np.zeros(CAP, np.uint16)]
        assert below[-1] == n

    @property
    def runs(self) -> int:
        return len(self.first)

    def _agree(self, at: np.ndarray, query: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols agree from text position ``at`` and query position ``q`` on, ``most`` at most."""
        out = np.zeros(len(at), np.int64)
        live = np.flatnonzero(most > 0)
        for s in range(0, CAP, 8):
            if not len(live):
                break
            span = np.arange(s, s + 8)
            same = self.text[at[live, None] + span] == query[q[live, None] + span]
            n = np.where(same.all(axis=1), 8, same.argmin(axis=1))
            out[live] = s + n
            live = live[n == 8]
            live = live[most[live] > out[live]]
        return np.minimum(out, most)

    def matches(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, position, smallest document) of every position at which a match of k bytes or more starts."""
        lengths = np.array([len(p) for p in patterns], np.int64)
        query = np.r_[np.frombuffer(b"".join(patterns), np.uint8).astype(np.uint16) + 1, np.full(CAP + 8, 300, np.uint16)]
        base = np.cumsum(lengths) - lengths
        who = np.argsort(-lengths, kind="stable")
        row = np.zeros(len(who), np.int64)
        place = np.full(len(who), int(self.at_first[0]), np.int64)
        size = np.zeros(len(who), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(-lengths[who], -step, "left"))
            who, row, place, size = who[:m], row[:m], place[:m], size[:m]
            q = base[who] + lengths[who] - 1 - step
            c = query[q].astype(np.int64)
            run = np.searchsorted(self.first, row, "right") - 1
            off = np.flatnonzero(self.head[run] != c)
            if len(off):
                j = np.searchsorted(self.keys, c[off] * self.n + row[off], "right") - 1
                up_ok = (j >= 0) & (self.head[self.by_head[np.maximum(j, 0)]] == c[off])
                dn = np.minimum(j + 1, len(self.keys) - 1)
                dn_ok = (j + 1 < len(self.keys)) & (self.head[self.by_head[dn]] == c[off])
                up, dn = self.by_head[np.maximum(j, 0)], self.by_head[dn]
                a = np.where(up_ok, self._agree(self.at_last[up], query, q[off] + 1, np.where(up_ok, size[off], 0)), -1)
                b = np.where(dn_ok, self._agree(self.at_first[dn], query, q[off] + 1, np.where(dn_ok, size[off], 0)), -1)
                use_up = a >= b
                run[off] = np.where(use_up, up, dn)
                row[off] = np.where(use_up, self.last[up], self.first[dn])
                place[off] = np.where(use_up, self.at_last[up], self.at_first[dn])
                size[off] = np.maximum(a, b)  # -1: the byte is nowhere in the index
            lost = size < 0
            row = np.where(lost, 0, self.lf[run] + row - self.first[run])
            place = np.where(lost, int(self.at_first[0]), place - 1)
            size = np.where(lost, 0, np.minimum(size + 1, CAP))
            if len(hit := np.flatnonzero(size >= self.k)):
                found.append((who[hit], lengths[who[hit]] - 1 - step, self.smallest[np.searchsorted(self.starts, row[hit], "right") - 1]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
