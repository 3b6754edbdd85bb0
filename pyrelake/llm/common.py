"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text gathered in a Python task before a block is worked off; bounds the memory of a task.
BLOCK_BYTES = 6 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, local mode gets a temporary one; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def save(df: DataFrame, base: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{base or scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run in the shared folder, removed when the run ends or fails; its result must be saved elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.tables = spark, f"{scratch_dir(spark)}/{uuid.uuid4().hex}", []

    def save(self, df: DataFrame) -> DataFrame:
        return save(df, self.base)

    def bucketed(self, df: DataFrame, n: int, column: str) -> DataFrame:
        """``df`` as a table in buckets of a column, so that joins on it shuffle the other side alone."""
        self.tables.append(f"t_{uuid.uuid4().hex}")
        df.write.bucketBy(n, column).option("path", f"{self.base}/{self.tables[-1]}").option("compression", "zstd").saveAsTable(self.tables[-1])
        return self.spark.table(self.tables[-1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()
#: Bytes of one Arrow batch: bounds what a Python task is handed at once.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """For operators with Python tasks: Arrow batches of bounded bytes, and this package on the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        with tempfile.NamedTemporaryFile(prefix=f"{root.name}-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        atexit.register(Path(f.name).unlink, missing_ok=True)
        spark.sparkContext.addPyFile(f.name)
        _shipped.add(app)


def on_executors(spark: SparkSession, path: str) -> Callable[[], str]:
    """Ship a file of the driver to the executors; in a task, the function returned tells its path there."""
    name = Path(path).name
    if (key := f"{spark.sparkContext.applicationId} {path}") not in _shipped:
        spark.sparkContext.addFile(path)
        _shipped.add(key)

    def local() -> str:
        from pyspark import SparkFiles

        return SparkFiles.get(name)

    return local


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def held_out(col: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2


def threshold(n_wanted: int, n: int) -> int:
    """Of hashes below 2^62, those below this are ``n_wanted`` of ``n`` on average; never none."""
    return max(1, min(n_wanted, n) * (1 << 62) // max(1, n))


def sampled(below: Column, col: str = "doc_id") -> Column:
    """Whether the hash of the id is below a :func:`threshold`."""
    return F.shiftrightunsigned(F.xxhash64(col), 2) < below


def volume(docs: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of all texts; sizes partitions and buckets."""
    return docs.agg(F.sum(F.octet_length(F.col(col))).alias("n")).first()["n"] or 0


def buckets_for(n_bytes: int, per_bucket: int = 16 << 20, least: int = 16) -> int:
    return max(least, -(-n_bytes // per_bucket))


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(doc_ids, UTF-8 texts) of about ``limit`` bytes each, from batches of (doc_id, text)."""
    ids: list[int] = []
    texts: list[bytes] = []
    n = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            t = t or b""
            ids.append(i)
            texts.append(t)
            n += len(t)
            if n >= limit:
                yield np.array(ids, np.int64), texts
                ids, texts, n = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Positions at which a sorted array takes a new value."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def runs_of(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of each value of a sorted array."""
    s = starts_of(sorted_keys).tolist()
    return list(zip(s, [*s[1:], len(sorted_keys)], strict=True)) if s else []


def planes(a: np.ndarray) -> bytes:
    """32-bit integers byte by byte, the lowest bytes first: compresses better."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Partitions that a block deals to at most; beyond, buckets are dealt in two steps.
PARTS = 4096
#: Entries that a partition of several buckets gathers before it passes them on bucket by bucket.
REGROUP = 8 << 20


def part_of(bucket: np.ndarray, n_buckets: int) -> np.ndarray:
    return bucket * first_parts(n_buckets) // n_buckets


def shared_keys(docs: DataFrame, keys_of: Callable[[np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray]], n_buckets: int, distinct: bool = False) -> DataFrame:
    """(doc_id, key): the keys of each document that at least one other document holds too.

    ``keys_of`` maps a block of texts to (64-bit keys, index of the document). Keys are dealt to buckets of
    about 16 MB of text as compressed blocks of 32-bit prints, beyond ``PARTS`` buckets in two steps, so that neither
    the blocks nor the work of a task grow with the input; a bucket is sorted, and its keys with two documents go back. A key that several documents of one block hold is known as shared already: one entry
    of it is dealt, so that a key in a third of all rows adds one entry a block. Prints may collide, which only adds
    keys: exact checks follow. ``key`` is bucket and print as a signed 64-bit integer. ``distinct``: the keys of a document
    are different 64-bit numbers, and each counts: two that fold into one key stay two rows. Else a (document, key) is
    repeated only if the document's row is.
    """
    import pyarrow.compute  # noqa: F401
    import zstandard

    def pack(press, full, doc, many) -> bytes:
        who, local = np.unique(doc, return_inverse=True)
        first = starts_of(full >> np.uint64(32))
        runs = np.r_[full[first] >> np.uint64(32), np.diff(np.r_[first, len(full)]).astype(np.uint64)]
        head = np.array([len(full), len(who), len(first)], "<u4").tobytes()
        return press.compress(head + who.astype("<i8").tobytes() + runs.astype("<u4").tobytes() + planes(np.diff(full & np.uint64(0xFFFFFFFF), prepend=np.uint64(0))) + planes(local) + many.tobytes())

    def unpack(unpress, z: bytes):
        raw = unpress.decompress(z)
        n, k, r = np.frombuffer(raw, "<u4", 3).tolist()
        who = np.frombuffer(raw, "<i8", k, 12)
        at = 12 + 8 * k
        bucket, count = np.frombuffer(raw, "<u4", 2 * r, at).reshape(2, r)
        at += 8 * r
        full = np.repeat(bucket.astype(np.uint64), count) << np.uint64(32) | np.cumsum(from_planes(raw[at : at + 4 * n]), dtype=np.uint32)
        return full, who[from_planes(raw[at + 4 * n : at + 8 * n])], np.frombuffer(raw, bool, n, at + 8 * n)

    def rows_of(rows):
        for s in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[s : s + 2000]], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["bucket", "doc_id", "keys"])

    def deal(batches):
        press = zstandard.ZstdCompressor(level=1)
        for ids, texts in blocks(batches):
            keys, at = keys_of(ids, texts)
            rows: list[tuple[int, int | None, bytes]] = []
            full = ((keys >> np.uint64(32)) % np.uint64(n_buckets)) << np.uint64(32) | (keys & np.uint64(0xFFFFFFFF))
            o = np.lexsort((at, full))
            full, at = full[o], at[o]
            if not distinct:
                new = np.r_[True, (full[1:] != full[:-1]) | (at[1:] != at[:-1])] if len(full) else np.zeros(0, bool)
                full, at = full[new], at[new]
            first = starts_of(full)
            many = np.diff(np.r_[first, len(full)]) > 1
            known = np.repeat(many, np.diff(np.r_[first, len(full)]))
            o = np.argsort(at[known], kind="stable")
            own, own_keys = at[known][o], full[known][o]
            for s, e in runs_of(own):
                rows.append((int(ids[own[s]] % n_buckets), int(ids[own[s]]), own_keys[s:e].astype("<u8").tobytes()))
            full, doc = full[first], ids[at[first]]
            bucket = (full >> np.uint64(32)).astype(np.int64)
            for s, e in runs_of(part_of(bucket, n_buckets)):
                rows.append((int(bucket[s]), None, pack(press, full[s:e], doc[s:e], many[s:e])))
            yield from rows_of(rows)

    def regroup(batches):
        """Of a partition with several buckets: one block a bucket for every ``REGROUP`` entries."""
        press, unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

        def flush(held):
            full, doc, many = (np.concatenate(x) for x in zip(*held, strict=True))
            o = np.argsort(full, kind="stable")
            full, doc, many = full[o], doc[o], many[o]
            yield from rows_of([(int(full[s] >> np.uint64(32)), None, pack(press, full[s:e], doc[s:e], many[s:e])) for s, e in runs_of(full >> np.uint64(32))])

        held, n = [], 0
        for b in batches:
            ready = pa.compute.is_valid(b.column(1))
            yield b.filter(ready)
            for z in b.filter(pa.compute.invert(ready)).column(2).to_pylist():
                held.append(unpack(unpress, z))
                n += len(held[-1][0])
                if n >= REGROUP:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    def settle(blobs):
        unpress = zstandard.ZstdDecompressor()
        full, doc, sent = (np.concatenate(x) for x in zip(*[unpack(unpress, z) for z in blobs], strict=True))
        o = np.argsort(full, kind="stable")
        full, doc, sent = full[o], doc[o], sent[o]
        n = np.diff(np.r_[starts_of(full), len(full)])
        back = np.repeat(n > 1, n) & ~sent
        full, doc = full[back], doc[back]
        o = np.argsort(doc, kind="stable")
        return doc[o], full[o].view(np.int64)

    def meet(batches):
        def table(d, k):
            for s in range(0, len(d), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(d[s : s + 100_000]), pa.array(k[s : s + 100_000])], ["doc_id", "key"])

        now, blobs = None, []
        for b in batches:
            ready = pa.compute.is_valid(b.column(1))
            if (own := b.filter(ready)).num_rows:
                keys = [np.frombuffer(k, "<i8") for k in own.column(2).to_pylist()]
                yield from table(np.repeat(own.column(1).to_numpy(), [len(k) for k in keys]), np.concatenate(keys))
            rest = b.filter(pa.compute.invert(ready))
            for bucket, z in zip(rest.column(0).to_pylist(), rest.column(2).to_pylist(), strict=True):
                if bucket != now:
                    if blobs:
                        yield from table(*settle(blobs))
                    now, blobs = bucket, []
                blobs.append(z)
        if blobs:
            yield from table(*settle(blobs))

    parts = first_parts(n_buckets)
    dealt = docs.select("doc_id", "text").mapInArrow(deal, "bucket long, doc_id long, keys binary")
    dealt = dealt.repartition(parts, F.expr(f"bucket * {parts} div {n_buckets}"))
    if parts < n_buckets:
        dealt = dealt.mapInArrow(regroup, dealt.schema).repartition(n_buckets, "bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(meet, "doc_id long, key long")


def first_parts(n_buckets: int) -> int:
    """Partitions of a first deal: all buckets if they are few, else so many that neither deal has too many."""
    return n_buckets if n_buckets <= PARTS else math.isqrt(n_buckets * PARTS)


def spread_buckets(blobs: DataFrame, n_buckets: int, together: Callable[[list[bytes]], bytes], held_bytes: int = 32 << 20) -> DataFrame:
    """(bucket, data) with each bucket in one partition. Very many buckets are dealt in two steps, blobs of a bucket put ``together`` between them."""
    if n_buckets <= PARTS:
        return blobs.repartition(n_buckets, "bucket")
    parts = first_parts(n_buckets)

    def regroup(batches):
        held: dict[int, list[bytes]] = {}
        n = 0

        def flush():
            for bucket, data in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([together(data)], pa.binary())], ["bucket", "data"])

        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(bucket, []).append(data)
                n += len(data)
                if n >= held_bytes:
                    yield from flush()
                    held, n = {}, 0
        yield from flush()

    first = blobs.repartition(parts, F.expr(f"bucket * {parts} div {n_buckets}"))
    return first.mapInArrow(regroup, "bucket long, data binary").repartition(n_buckets, "bucket")


def components(edges: DataFrame, save: Callable[[DataFrame], DataFrame] = save) -> DataFrame:
    """(id, component): the smallest id that links reach, for every id in ``edges`` (a, b).

    Every round takes the smallest label around each vertex and then the label of that label, so chains shorten by
    doubling. Minima are combined before the shuffle, so a vertex with very many links costs one row a task.
    """
    edges = save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = save(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")))
    while True:
        around = edges.join(labels, edges.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(around, "id", "left").select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        new = save(step.join(jump, "next", "left").select("id", F.coalesce("far", "next").alias("component"), (F.coalesce("far", "next") != F.col("component")).alias("moved")))
        if new.filter("moved").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
