"""Language-model scores: an interpolated modified Kneser-Ney n-gram model.

Tokens are words with A-Z lower-cased and one end a text; contexts before a text are filled up with a begin mark. Tokens
and n-grams are known by 64-bit hashes. Counting is a Spark job a level, from the highest order down: a task counts the
n-grams of some millions of tokens and deals them, packed, to buckets by the hash of their context; a bucket adds the counts up
and writes its part of the model, a file of sorted hash arrays: n-grams with their counts and contexts with their totals.
What an n-gram adds to the next lower level (one context more, or its count if it begins a text) is dealt on.
A context that a sample shows to hold over a quarter of a bucket is dealt to several by its last token; its totals are
added up from these, at most four such contexts a bucket. The sample only balances the work.

Scoring tasks memory-map these files from the shared folder, look the distinct n-grams of some millions of tokens up
in sorted order, and add the logarithms up for each text: p_k = max(c - D, 0) / sum + (D1 N1 + D2 N2 + D3 N3) / sum * p_(k-1),
down to the uniform 1 / (V + 1), with the discounts D1 to D3 of a level from how many n-grams have counts 1 to 4. Where the
shared folder is no mounted one, Spark ships the files to every executor first.

The model grows with the corpus: about 12 bytes a distinct n-gram, on a disk that workers can map. Null texts count as
empty, which is one end; texts are learnt and scored whole, in pieces if long. Repeated rows are learnt as often as they
occur and scored alike. A null doc_id counts as an empty one. Extra columns are ignored; an empty table gives an empty
result, and with nothing to learn every probability is uniform.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, mix, prepare, sampled, save, spread_buckets, starts_of, threshold

ORDER = 2
BEGIN, END = mix(np.array([11, 12], np.uint64))
#: Tokens that a task counts or scores at once, and bytes that are hashed at once.
TOGETHER, PIECE = 1 << 20, 1 << 20
#: Documents of the sample that shows heavy contexts.
SAMPLE = 2000
#: Open files of a worker.
OPEN = 1024

_LETTERS = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_LETTERS[65:91] = _LETTERS[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LETTERS[_BLANK] = 0
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        base = 0x9E3779B97F4A7C15
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, PIECE), x, np.uint64)]) for x in (base, pow(base, -1, 1 << 64))]
    return _powers


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``PIECE`` bytes that end behind a blank; the last byte is one."""
    s = 0
    while s < len(data):
        e = min(s + PIECE, len(data))
        while e < len(data) and not (cut := np.flatnonzero(_BLANK[data[s:e]])).size:
            e = min(e + PIECE, len(data))
        if e < len(data):
            e = s + int(cut[-1]) + 1
        yield s, e
        s = e


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens in a row, the end of each text included, and how many each text has."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for s, e in pieces(data):
        part = data[s:e]
        word = ~_BLANK[part]
        first = np.flatnonzero(word & ~np.r_[False, word[:-1]])
        if len(first):
            up, down = powers(e - s)
            found.append(mix(np.add.reduceat(_LETTERS[part] * up[: e - s], first) * down[first]))
            places.append(s + first)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    upto = np.searchsorted(np.concatenate(places), ends)
    return np.insert(np.concatenate(found), upto, END), np.diff(upto, prepend=0) + 1


def chain(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of an n-gram."""
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        out = mix(out * np.uint64(0xD1342543DE82EF95) + c)
    return out


def context(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of all but the last token; of a single one, its own hash, as all share the empty context and buckets go by it."""
    return chain(columns[:-1]) if len(columns) > 1 else chain(columns)


def columns_of(flat: np.ndarray, n: np.ndarray, order: int) -> list[np.ndarray]:
    """The n-gram that ends in each token, token by token."""
    at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    return [np.where(at >= k, np.r_[np.full(min(k, len(flat)), BEGIN), flat[: max(0, len(flat) - k)]], BEGIN) for k in range(order - 1, -1, -1)]


def place(columns: list[np.ndarray], heavy: tuple[np.ndarray, np.ndarray], n_buckets: int) -> np.ndarray:
    """The bucket of each n-gram: by its context, and for a heavy one by its last token, too."""
    ctx = context(columns)
    bucket = ((ctx >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    if len(columns) > 1 and len(heavy[0]):
        k = np.minimum(np.searchsorted(heavy[0], ctx), len(heavy[0]) - 1)
        hit = heavy[0][k] == ctx
        bucket[hit] = (bucket[hit] + chain(columns[-1:])[hit] % heavy[1][k[hit]]) % np.uint64(n_buckets)
    return bucket.astype(np.int64)


def added(columns: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct n-grams, sorted by context and last token, and their counts added up."""
    o = np.lexsort((columns[-1], context(columns)))
    columns = [c[o] for c in columns]
    new = np.zeros(len(o), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], [np.add.reduceat(c[o], at) if len(at) else c for c in counts]


def pack(columns: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """Columns of 64-bit hashes and of counts, the counts in as few bytes as the largest needs."""
    import zstandard

    small = [c.astype(np.min_scalar_type(int(c.max()))) for c in counts]
    head = struct.pack("<IBB", len(columns[0]), len(columns), len(counts)) + bytes(c.itemsize for c in small)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(c.tobytes() for c in [*columns, *small]))


def unpack(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, k, m = struct.unpack_from("<IBB", raw)
    at, out = 6 + m, []
    for size in [8] * k + list(raw[6 : 6 + m]):
        out.append(np.frombuffer(raw, f"<u{size}", n, at))
        at += n * size
    return out[:k], [c.astype(np.uint64) for c in out[k:]]


def merged(blobs: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    parts = [unpack(z) for z in blobs]
    return added(*([np.concatenate(x) for x in zip(*side, strict=True)] for side in zip(*parts, strict=True)))


def dealt(columns: list[np.ndarray], counts: list[np.ndarray], heavy, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed n-grams) of distinct n-grams."""
    bucket = place(columns, heavy, n_buckets)
    o = np.argsort(bucket, kind="stable")
    first = starts_of(bucket[o])
    for s, e in zip(first, [*first[1:], len(o)], strict=True):
        yield int(bucket[o[s]]), pack([c[o[s:e]] for c in columns], [c[o[s:e]] for c in counts])


def rows_of(rows, names: str) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows each, from tuples that begin with a long."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    named = [x.split(" ") for x in names.split(", ")]
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kinds[t]) for k, (_, t) in enumerate(named)], [n for n, _ in named])

    for r in rows:
        held.append(r)
        if len(held) >= 64:
            yield batch()
            held = []
    if held:
        yield batch()


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


# The model's files


def write_file(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after the other behind their kinds and lengths; a task run again writes the same file anew."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    import uuid

    part = f"{path}.{uuid.uuid4().hex}"
    head = b"".join(struct.pack("<cBQ", a.dtype.kind.encode(), a.itemsize, len(a)) for a in arrays)
    with store.open_output_stream(part) as f:
        f.write(struct.pack("<Q", len(arrays)) + head + b"\0" * (-len(head) % 8))
        for a in arrays:
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    store.move(part, path)


def map_file(path: str) -> list[np.ndarray] | None:
    """The arrays of a file, memory-mapped; None if no task had anything to write."""
    try:
        raw = np.memmap(path, np.uint8, "r")
    except FileNotFoundError:
        return None
    n = int(raw[:8].view("<u8")[0])
    at, out = 8 + 10 * n + (-10 * n % 8), []
    for k in range(n):
        kind, size, length = struct.unpack_from("<cBQ", raw, 8 + 10 * k)
        out.append(raw[at : at + size * length].view(f"<{kind.decode()}{size}"))
        at += size * length + (-size * length % 8)
    return out


def found_in(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of sorted values in a sorted array, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return k, keys[k] == wanted


class Model:
    """The model's files on a worker, and the probabilities that follow from them."""

    def __init__(self, folder: str, facts: dict):
        self.folder, self.facts, self.files = folder, facts, {}

    def file(self, name: str) -> list[np.ndarray] | None:
        if name not in self.files:
            if len(self.files) >= OPEN:
                self.files.clear()
            self.files[name] = map_file(f"{self.folder}/{name}")
        return self.files[name]

    def look_up(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct n-grams the counts (all kinds), and the totals of their contexts: sum, and how many have count 1, 2, 3 or more."""
        level, n = len(columns), len(columns[0])
        grams, ctx = chain(columns), context(columns)
        counts, totals = np.zeros((2 if level == 1 else 1, n)), np.zeros((4, n))
        bucket = place(columns, self.facts["heavy"], self.facts["buckets"])
        o = np.lexsort((grams, bucket))
        first = starts_of(bucket[o])
        for s, e in zip(first, [*first[1:], n], strict=True):
            i = o[s:e]
            if (arrays := self.file(f"{level}/{int(bucket[i[0]])}")) is None:
                continue
            k, hit = found_in(arrays[0], grams[i])
            for row, c in enumerate(arrays[1 : 1 + len(counts)]):
                counts[row, i[hit]] = c[k[hit]]
            if level > 1:
                i = i[np.argsort(ctx[i], kind="stable")]
                k, hit = found_in(arrays[2], ctx[i])
                for row, c in enumerate(arrays[3:7]):
                    totals[row, i[hit]] = c[k[hit]]
        if level > 1 and (arrays := self.file(f"{level}/heavy")) is not None:
            i = np.argsort(ctx, kind="stable")
            k, hit = found_in(arrays[0], ctx[i])
            for row, c in enumerate(arrays[1:5]):
                totals[row, i[hit]] = c[k[hit]]
        if level == 1:
            totals[:] = np.array(self.facts["all"])[:, None]
        return counts, totals

    def probabilities(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct n-grams of the highest order, and how often the last token was learnt."""
        p = np.full(len(columns[0]), 1 / (self.facts["V"] + 1))
        seen = p
        for level in range(1, len(columns) + 1):
            some = columns[len(columns) - level :]
            _, at, back = np.unique(chain(some), return_index=True, return_inverse=True)
            counts, totals = self.look_up([c[at] for c in some])
            counts, totals = counts[:, back], totals[:, back]
            if level == 1:
                seen = counts[1]
            d = np.array([0, *self.facts["D"][level - 1]])
            rest = d[1] * totals[1] + d[2] * totals[2] + d[3] * totals[3]
            known = totals[0] > 0
            total = np.where(known, totals[0], 1)
            p = np.where(known, (counts[0] - d[np.minimum(counts[0], 3).astype(np.int64)]) / total + rest / total * p, p)
        return p, seen


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3 from how many n-grams have counts 1 to 4; 0.5, 1, 1.5 where these are too few to tell."""
    if min(n[:4]) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return d if all(0 < x <= k + 1 for k, x in enumerate(d)) else [0.5, 1.0, 1.5]


# The jobs


def heavy_contexts(docs: DataFrame, n_docs: int, order: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts with over a quarter of a bucket, as a sample of documents shows, and to how many buckets to deal each."""

    def run(batches):
        for b in batches:
            flat, n = tokens(texts_of(b, 0))
            columns = columns_of(flat, n, order)
            some = np.concatenate([chain(columns[k:-1]) for k in range(order - 1)])
            keys, counts = np.unique(some, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts), pa.array(np.full(len(keys), len(flat)))], ["ctx", "n", "tokens"])

    sample = docs.filter(sampled(F.lit(threshold(SAMPLE, n_docs)))).select("text").mapInArrow(run, "ctx long, n long, tokens long")
    counts = sample.groupBy("ctx").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    total //= order - 1
    rows = counts.filter(F.col("n") * 4 * n_buckets > total).collect()  # of each level at most 4 a bucket
    rows = sorted((r["ctx"] % (1 << 64), -(-r["n"] * 4 * n_buckets // total)) for r in rows)
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.uint64)


def counted(docs: DataFrame, order: int, heavy, n_buckets: int) -> DataFrame:
    """(bucket, data): the n-grams of the highest order, counted by the tasks that read the texts."""

    def run(batches):
        def flush(held):
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            columns, counts = added(columns, [np.ones(len(columns[0]), np.uint64)])
            return dealt(columns, [counts[0], counts[0]], heavy, n_buckets)

        def rows():
            held, n = [], 0
            for b in batches:
                held.append(columns_of(*tokens(texts_of(b, 0)), order))
                n += len(held[-1][0])
                if n >= TOGETHER:
                    yield from flush(held)
                    held, n = [], 0
            if n:
                yield from flush(held)

        yield from rows_of(rows(), "bucket long, data binary")

    return docs.select("text").mapInArrow(run, "bucket long, data binary")


def totals_of(ctx: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Of n-grams sorted by context: the contexts, their sums, and how many n-grams have count 1, 2, 3 or more."""
    at = starts_of(ctx)
    return [ctx[at], *(np.add.reduceat(x.astype(np.uint64), at) for x in (c, c == 1, c == 2, c >= 3))]


def built(blobs: DataFrame, level: int, order: int, heavy, n_buckets: int, folder: str, scratch: Scratch) -> DataFrame:
    """Write a level's files; (bucket, kind, facts, data): facts of a file, totals of heavy contexts, n-grams for the level below."""

    def settle(bucket, blobs):
        columns, (count, raw) = merged(blobs)
        # Counts of the highest order are plain; below, how many tokens go before, or again plain where none can.
        c = raw if level == order else np.where(columns[0] == BEGIN, raw, count)
        grams, ctx = chain(columns), context(columns)
        o = np.argsort(grams)
        small = lambda x: x.astype(np.min_scalar_type(int(x.max())))
        arrays = [grams[o], small(c)[o]]
        if level == 1:
            arrays.append(small(raw)[o])
        else:
            own = totals_of(ctx, c)
            is_heavy = np.isin(own[0], heavy[0])
            arrays += [small(x[~is_heavy]) if k and (~is_heavy).any() else x[~is_heavy] for k, x in enumerate(own)]
            if is_heavy.any():
                yield bucket, "heavy", [], pack([x[is_heavy] for x in own], [])
            below = added(columns[1:], [np.ones(len(c), np.uint64), raw])
            for k, data in dealt(*below, heavy, n_buckets):
                yield k, "below", [], data
        write_file(f"{folder}/{level}/{bucket}", arrays)
        yield bucket, "file", [*(int((c == k).sum()) for k in (1, 2, 3, 4)), int((c >= 3).sum()), int(c.sum()), len(c), int(raw.sum())], None

    def run(batches):
        def rows():
            now, held = None, []
            for b in batches:
                for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if bucket != now:
                        if held:
                            yield from settle(now, held)
                        now, held = bucket, []
                    held.append(data)
            if held:
                yield from settle(now, held)

        yield from rows_of(rows(), "bucket long, kind string, facts array<long>, data binary")

    def together(data):
        return pack(*merged(data))

    blobs = spread_buckets(blobs, n_buckets, together)
    return scratch.save(blobs.sortWithinPartitions("bucket").mapInArrow(run, "bucket long, kind string, facts array<long>, data binary"))


def write_heavy(found: DataFrame, folder: str, level: int) -> None:
    """The totals of heavy contexts, at most four a bucket, in one file."""
    schema = ", ".join(f"{c} long" for c in ("ctx", "total", "n1", "n2", "n3"))

    def run(batches):
        for b in batches:
            for z in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in unpack(z)[0]], ["ctx", "total", "n1", "n2", "n3"])

    def write(batches):
        got = [np.zeros((5, 0), np.int64), *(np.stack([b.column(k).to_numpy() for k in range(5)]) for b in batches)]
        rows = np.concatenate(got, axis=1).view(np.uint64)
        rows = rows[:, np.argsort(rows[0])]
        write_file(f"{folder}/{level}/heavy", list(rows))
        yield pa.RecordBatch.from_arrays([pa.array([rows.shape[1]])], ["n"])

    sums = found.select("data").mapInArrow(run, schema).groupBy("ctx").agg(*[F.sum(c).alias(c) for c in ("total", "n1", "n2", "n3")])
    sums.coalesce(1).mapInArrow(write, "n long").collect()


def model(docs: DataFrame, learn: Column, order: int, scratch: Scratch) -> dict:
    """Learn from the documents where ``learn`` holds and write the model's files; what a worker needs to know of them."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n_buckets = buckets_for(size["bytes"] or 0)
    some = docs.filter(learn)
    heavy = heavy_contexts(some, size["n"], order, n_buckets)
    folder = f"{scratch.base}/model"
    facts = {"heavy": heavy, "buckets": n_buckets, "D": [], "folder": folder}
    blobs = counted(some, order, heavy, n_buckets)
    for level in range(order, 0, -1):
        out = built(blobs, level, order, heavy, n_buckets, folder, scratch)
        sums = out.filter("kind = 'file'").select(*[F.sum(F.col("facts")[k]).alias(f"f{k}") for k in range(8)]).first()
        n1, n2, n3, n4, more, total, distinct, raw = (x or 0 for x in sums)
        facts["D"].insert(0, discounts([n1, n2, n3, n4]))
        if level > 1:
            write_heavy(out.filter("kind = 'heavy'"), folder, level)
        blobs = out.filter("kind = 'below'").select("bucket", "data")
    return facts | {"all": (total, n1, n2, more), "V": distinct, "N": raw}


def shared_folder(spark, folder: str):
    """In a task, where the files of a shared folder are: under its own path if it is mounted, else where Spark ships them."""
    if folder.startswith("file:") or "://" not in folder:
        path = folder.removeprefix("file://").removeprefix("file:")
        return lambda: path
    spark.sparkContext.addFile(folder, recursive=True)
    name = folder.rsplit("/", 1)[-1]

    def local():
        from pyspark import SparkFiles

        return SparkFiles.get(name)

    return local


def language_model_scores(docs: DataFrame, learn: Column, order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score; learnt where ``learn`` holds."""
    spark = docs.sparkSession
    prepare(spark)
    with Scratch(spark) as scratch:
        facts = model(docs, learn, order, scratch)
        local = shared_folder(spark, facts["folder"])
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"

        def run(batches):
            lm = Model(local(), facts)

            def flush(held):
                ids, flats, counts = zip(*held, strict=True)
                flat, n = np.concatenate(flats), np.concatenate(counts)
                columns = columns_of(flat, n, order)
                _, at, back = np.unique(chain(columns), return_index=True, return_inverse=True)
                p, seen = lm.probabilities([c[at] for c in columns])
                begins = np.cumsum(n) - n
                score = np.add.reduceat(np.log10(p)[back], begins)
                base = np.add.reduceat(np.log10((seen + 1) / (facts["N"] + facts["V"] + 1))[back], begins)
                known = np.add.reduceat((seen > 0)[back].astype(np.int64), begins)
                cells = [pa.array(n), pa.array(known), pa.array(np.full(len(n), facts["N"])), pa.array(base), pa.array(score)]
                return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *cells], names)

            held, n = [], 0
            for b in batches:
                if b.num_rows:
                    held.append((b.column(0), *tokens(texts_of(b, 1))))
                    n += len(held[-1][1])
                if n >= TOGETHER:
                    yield flush(held)
                    held, n = [], 0
            if n:
                yield flush(held)

        return save(docs.select("doc_id", "text").mapInArrow(run, schema))


def held_out_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Adds held_out, whether crc32(doc_id as text) mod 7 is 2; the others are learnt."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return language_model_scores(docs, ~held, order).withColumn("held_out", held)
