"""Suffix-array dedup by run-length indexes: removes long strings that an earlier document holds too.

A byte goes if it is covered by a ``SPAN``-byte string that also starts in a document with a smaller doc_id. Every such string has a
minimizer, the 24-byte string in it with the smallest hash, and equal strings have equal minimizers, so texts meet by
them instead of each against each:

1. minimizers that one document alone holds are dropped (:func:`common.shared_keys`);
2. the stretches of text under each remaining one (all strings that share it, joined) are dealt to buckets by it;
   equal stretches of one block of documents are sent once, the later documents being covered already;
3. in a bucket, equal stretches are merged, and run-length indexes (:mod:`run_index`) are built over those whose
   minimizer has more than one text, all texts of a minimizer in one. Matching statistics of these are streamed through the index; a match of
   ``SPAN`` bytes or more whose smallest document is earlier is marked;
4. marks are merged for each document and its bytes are cut.

A bucket holds about 16 MB of text whatever the size of the input. Null counts as empty text. doc_id is taken to
identify a text: repeated rows get a row each and do not cover each other. Texts shorter than ``SPAN`` bytes stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, buckets_for, mix, runs_of, shared_keys, prepare, volume
from .run_index import RunIndex

SPAN, GRAM = 50, 24
#: Stretches are cut at this many starting positions.
LONGEST = 4096
#: Text of one run-length index; a minimizer with more has a larger one.
INDEX_BYTES = 1 << 20
CHUNK = 1 << 18


def stretches(text: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, document, first start, number of starts) over joined texts; ``doc`` is the document of each byte."""
    n = len(text) - SPAN + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    small = np.empty(n, np.uint64)
    padded = np.r_[text, np.zeros(GRAM, np.uint8)]
    for s in range(0, n, CHUNK):
        m = min(CHUNK, n - s) + SPAN - GRAM  # hashes that these windows need
        h = np.zeros(m, np.uint64)
        for at in range(0, GRAM, 8):
            h += np.ndarray((m,), "<u8", padded, s + at, (1,))
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        width, want = 1, SPAN - GRAM + 1
        while 2 * width <= want:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        small[s : s + CHUNK] = np.minimum(h[: len(h) - (want - width)], h[want - width :])
    ok = doc[:n] == doc[SPAN - 1 :]
    at = np.flatnonzero(ok)
    small, own = small[ok], doc[:n][ok]
    new = np.r_[True, (small[1:] != small[:-1]) | (own[1:] != own[:-1])] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(at)])
    return mix(small[first]), own[first], at[first], count


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.arange(len(texts)), lengths), np.cumsum(lengths) - lengths


def keys_of(ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    text, doc, _ = joined(texts)
    key, own, _, _ = stretches(text, doc)
    return key, own


def spans_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(doc_id, spans): one row a document, spans as pairs of little-endian 64-bit integers."""
    o = np.lexsort((start, doc))
    doc, pairs = doc[o], np.c_[start, end][o].astype("<i8")
    for s, e in runs_of(doc):
        yield int(doc[s]), merged(pairs[s:e]).tobytes()


def merged(pairs: np.ndarray) -> np.ndarray:
    """Union of [start, end) pairs as maximal runs."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.r_[True, pairs[1:, 0] > reach[:-1]])
    return np.c_[pairs[first, 0], reach[np.r_[first[1:], len(pairs)] - 1]].astype("<i8")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of the bytes to remove; several rows a document."""
    import pyarrow.compute  # noqa: F401
    import zstandard

    n_buckets = buckets_for(volume(docs))
    lists = shared_keys(docs, keys_of, n_buckets).groupBy("doc_id").agg(F.collect_list("key").alias("lists"))  # bounded by the document's own keys
    asked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(lists, "doc_id", "left")  # as below, so that one shuffle of the texts serves both

    def deal(batches):
        press = zstandard.ZstdCompressor(level=5)

        def work(ids, texts, lists):
            text, doc, base = joined(texts)
            key, own, at, count = stretches(text, doc)
            full = ((key >> np.uint64(32)) % np.uint64(n_buckets)) << np.uint64(32) | (key & np.uint64(0xFFFFFFFF))
            keep = np.zeros(len(full), bool)
            ends = np.searchsorted(own, np.arange(len(texts) + 1))
            for d in range(len(texts)):
                keep[ends[d] : ends[d + 1]] = np.isin(full[ends[d] : ends[d + 1]], lists[d].view(np.uint64))
            full, own, at, count = full[keep], own[keep], at[keep], count[keep]
            cuts = -(-count // LONGEST)
            if (cuts > 1).any():
                part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                full, own, at, left = (np.repeat(x, cuts) for x in (full, own, at, count))
                at, count = at + part * LONGEST, np.minimum(left - part * LONGEST, LONGEST)
            doc_ids, raw = ids[own], text.tobytes()
            strings = [raw[a : a + c + SPAN - 1] for a, c in zip(at.tolist(), count.tolist(), strict=True)]
            least: dict[bytes, int] = {}
            for s, d in zip(strings, doc_ids.tolist(), strict=True):
                if least.get(s, d) >= d:
                    least[s] = d
            covered = np.array([least[s] for s in strings], np.int64) < doc_ids if strings else np.zeros(0, bool)
            start = at - base[own]
            rows = [(d % n_buckets, d, spans) for d, spans in spans_rows(doc_ids[covered], start[covered], (start + count + SPAN - 1)[covered])]
            send = np.flatnonzero(~covered)
            send = send[np.argsort(full[send], kind="stable")]
            bucket = (full[send] >> np.uint64(32)).astype(np.int64)
            for s, e in runs_of(bucket):
                some = send[s:e]
                head = np.c_[(full[some] & np.uint64(0xFFFFFFFF)).astype("<i8"), doc_ids[some], start[some], count[some] + SPAN - 1].astype("<i8")
                rows.append((int(bucket[s]), None, press.compress(np.int64(len(some)).tobytes() + np.ascontiguousarray(head.T).tobytes() + b"".join([strings[i] for i in some]))))
            for s in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[s : s + 2000]], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["bucket", "doc_id", "spans"])

        ids, texts, lists, n = [], [], [], 0
        for b in batches:
            b = b.filter(pa.compute.is_valid(b.column(2)))
            if not b.num_rows:
                continue
            keys, ends = b.column(2).values.to_numpy(), b.column(2).offsets.to_numpy()[1:-1]
            for i, t, k in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), np.split(keys, ends), strict=True):
                ids.append(i)
                texts.append(t)
                lists.append(k)
                n += len(t)
                if n >= BLOCK_BYTES:
                    yield from work(np.array(ids, np.int64), texts, lists)
                    ids, texts, lists, n = [], [], [], 0
        if ids:
            yield from work(np.array(ids, np.int64), texts, lists)

    def settle(blobs):
        unpress = zstandard.ZstdDecompressor()
        heads, strings = [], []
        for z in blobs:
            raw = unpress.decompress(z)
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            head = np.frombuffer(raw, "<i8", 4 * n, 8).reshape(4, n)
            heads.append(head)
            ends = 8 + 32 * n + np.cumsum(head[3])
            strings += [raw[e - m : e] for e, m in zip(ends.tolist(), head[3].tolist(), strict=True)]
        key, doc, start, length = np.concatenate(heads, axis=1)
        place: dict[bytes, int] = {}
        which = np.array([place.setdefault(s, len(place)) for s in strings], np.int64)
        unique = list(place)
        least = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        covered = doc > least[which]
        rows = [(doc[covered], start[covered], (start + length)[covered])]
        key_of = np.empty(len(unique), np.int64)
        key_of[which] = key
        _, group, size = np.unique(key_of, return_inverse=True, return_counts=True)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        length_of = np.array([len(u) for u in unique], np.int64)
        longest = np.zeros(len(size), np.int64)
        np.maximum.at(longest, group, length_of)
        # Strings of one minimizer stay together; small indexes of strings alike in length work fastest.
        several = np.flatnonzero(size[group] > 1)
        several = several[np.lexsort((group[several], longest[group[several]]))]
        new = np.flatnonzero(np.r_[True, group[several][1:] != group[several][:-1]]) if len(several) else np.zeros(0, np.int64)
        at_byte = np.cumsum(length_of[several])[new] // INDEX_BYTES if len(several) else new
        cuts = new[np.r_[True, at_byte[1:] != at_byte[:-1]]].tolist() if len(several) else []
        for low_cut, high_cut in zip(cuts, [*cuts[1:], len(several)], strict=True):
            part = several[low_cut:high_cut]
            strings_of = [unique[i] for i in part]
            pattern, at, smallest = RunIndex(strings_of, least[part], SPAN).matches(strings_of)
            hit = smallest < least[part][pattern]
            pattern, at = part[pattern[hit]], at[hit]
            o = np.lexsort((at, pattern))
            pattern, at = pattern[o], at[o]
            first = np.flatnonzero(np.r_[True, (pattern[1:] != pattern[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
            last = (np.r_[first[1:], len(at)] - 1)[: len(first)]
            found.append((pattern[first], at[first], at[last] + SPAN))
        if found:
            runs = tuple(np.concatenate(x) for x in zip(*found, strict=True))
            # Each run, for each place at which the smallest document holds the stretch.
            mine = np.flatnonzero(~covered)
            mine = mine[np.argsort(which[mine], kind="stable")]
            low, high = np.searchsorted(which[mine], runs[0], "left"), np.searchsorted(which[mine], runs[0], "right")
            n = high - low
            r = np.repeat(np.arange(len(n)), n)
            e = mine[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            rows.append((doc[e], start[e] + runs[1][r], start[e] + runs[2][r]))
        return spans_rows(*(np.concatenate(x) for x in zip(*rows, strict=True)))

    def meet(batches):
        def flush(blobs):
            rows = list(settle(blobs)) if blobs else []
            for s in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[s : s + 5000]], pa.int64()), pa.array([r[1] for r in rows[s : s + 5000]], pa.binary())], ["doc_id", "spans"])

        now, blobs = None, []
        for b in batches:
            for bucket, d, z in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if d is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([z], pa.binary())], ["doc_id", "spans"])
                    continue
                if bucket != now:
                    yield from flush(blobs)
                    now, blobs = bucket, []
                blobs.append(z)
        yield from flush(blobs)

    dealt = asked.mapInArrow(deal, "bucket long, doc_id long, spans binary")
    return dealt.repartition(min(n_buckets, 8192), "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "doc_id long, spans binary")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    prepare(docs.sparkSession)
    spans = repeats(docs).groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))  # bounded by the document's own length

    def cut(batches):
        for b in batches:
            rows = []
            for i, t, lists in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                runs = merged(np.frombuffer(b"".join(lists or []), "<i8").reshape(-1, 2))
                kept, at = hashlib.sha256(), 0
                for s, e in runs.tolist():
                    kept.update(t[at:s])
                    at = e
                kept.update(t[at:])
                rows.append((i, len(t), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), kept.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
