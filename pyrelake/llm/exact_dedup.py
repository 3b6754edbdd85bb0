"""Exact dedup: tree-merge of sorted digest runs.

Documents are dealt to runs by a hash of their id, and digests to ranges by a hash of the digest. A run holds one row
for each digest it has seen: how many documents, and the identifier to retain. In binomial rounds ``fan_in``
neighbouring runs of a range are exchanged, sorted by digest and merged in one pass that holds one digest at a time,
until one run is left for each range. A digest that a third of all rows share is combined before the first exchange
and is one row a run from then on.

Equality is verified at every level: rows merge only if SHA-256, byte length and an independent 64-bit hash agree.
Groups that hold a ten-thousandth of all rows or more are found by a broadcast of at most 10,000 rows, the others by a
join of the groups of two or more.

Null counts as empty text; long texts are hashed whole. Repeated rows (the same id and text twice) count as two members
of their group, and both return. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, save, text_of

CHECKS = ["digest", "n_bytes", "check"]
RUN = "part long, run long, digest binary, n_bytes long, check long, keep_id long, group_size long"
#: Rows of a range of digests.
RANGE_ROWS = 1_000_000
#: Groups with at least one of so many rows are hot.
HOT = 10_000


def merge_sorted(batches: Iterator[pa.RecordBatch], keep: str) -> Iterator[pa.RecordBatch]:
    """One row for each group of equal neighbours in part, run, digest, n_bytes and check; the last group of a batch waits for the next one."""
    best = np.maximum if keep == "largest" else np.minimum
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_arrays(b.columns, b.schema.names)
        t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        if not t.num_rows:
            continue
        numbers = {c: t.column(c).to_numpy() for c in ("part", "run", "n_bytes", "check")}
        digest = np.frombuffer(b"".join(t.column("digest").to_pylist()), "<u8").reshape(-1, 4)
        new = np.r_[True, (digest[1:] != digest[:-1]).any(axis=1)]
        for x in numbers.values():
            new[1:] |= x[1:] != x[:-1]
        first = np.flatnonzero(new)
        merged = t.take(pa.array(first)).set_column(5, "keep_id", pa.array(best.reduceat(t.column("keep_id").to_numpy(), first)))
        merged = merged.set_column(6, "group_size", pa.array(np.add.reduceat(t.column("group_size").to_numpy(), first)))
        held = merged.slice(len(first) - 1)
        yield from merged.slice(0, len(first) - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def merge_runs(runs: DataFrame, fan_in: int, n_runs: int, n_parts: int, keep: str) -> DataFrame:
    """One row for each digest: (digest, n_bytes, check, keep_id, group_size)."""
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        exchanged = runs.withColumn("run", F.expr(f"run div {fan_in}")).repartition(n_parts, "part", "run")
        runs = exchanged.sortWithinPartitions("part", "run", *CHECKS).mapInArrow(lambda batches: merge_sorted(batches, keep), RUN)
    return runs.drop("part", "run")


def exact_dedup(docs: DataFrame, keep: str = "largest", n_runs: int = 64, fan_in: int = 8, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "largest" or "smallest" identifier of a group of equal texts stays.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep!r}")
    spark = docs.sparkSession
    prepare(spark)
    t = text_of()
    digests = save(docs.select("doc_id", F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), F.octet_length(t).cast("long").alias("n_bytes"), F.xxhash64(t).alias("check")))
    n = digests.count()
    n_parts = max(16, -(-n // range_rows))
    best = F.max if keep == "largest" else F.min
    level = (
        digests.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(n_runs)))
        .withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(n_parts)))
        .groupBy("part", "run", *CHECKS)
        .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    several = save(merge_runs(level.select(*[c.split()[0] for c in RUN.split(", ")]), fan_in, n_runs, n_parts, keep).filter("group_size > 1"))
    large = F.col("group_size") * HOT >= n
    # At most HOT groups can be that large.
    hot = digests.join(F.broadcast(several.filter(large)), CHECKS, "left")
    found = hot.filter("keep_id IS NOT NULL").union(hot.filter("keep_id IS NULL").drop("keep_id", "group_size").join(several.filter(~large), CHECKS, "left").select(hot.columns))
    keep_id = F.coalesce("keep_id", "doc_id")
    return found.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), (F.col("doc_id") == keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
