"""Conversation prefix trie: level-synchronous construction.

A conversation is a sequence of turns; every distinct sequence of its first d turns is a node of depth d, known by its
depth and its smallest member. Per depth, the conversations still live are grouped by (parent node, next turn), which
gives each group its smallest conv_id; a conversation leaves when its node has no other member, as all that follows is
a path of its own. Then levels are joined from the deepest upwards to roll up children, leaves and savings.

Turns are ranked without one task a conversation: rows are range-partitioned in order, numbered within a partition, and
moved on by the turns of the same conversation in earlier partitions. A group that very many conversations share costs
one row a task (minimum and count) and a join on (parent, turn) that Spark splits where it is skewed. The ids that end
in a node are sorted over partitions and hashed block by block, never gathered.

Null roles and texts count as empty, null turns come first; turns that tie go by role and then by the digest of the
turn, so repeated rows are turns that follow each other. Rows without a conv_id belong to no conversation. Turns are
compared by the SHA-256 of role and whole text, however long. Extra columns are ignored; an empty table has no node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, prepare, save, text_of, volume

#: Bytes of joined ids in one block.
ID_BLOCK = 1 << 20


def ranked(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, depth (from 1), turn_key, n_bytes: the turns of every conversation in order."""
    role, text = text_of("role"), text_of("text")
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    order = ["conv_id", "turn", "role", "turn_key"]
    turns = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), key.alias("turn_key"), F.octet_length(text).cast("long").alias("n_bytes"))
    parts = buckets_for(volume(conversations))
    placed = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = scratch.save(placed.select("conv_id", "turn_key", "n_bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    runs = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    runs = runs.select("conv_id", "part", (F.col("first") - earlier - 1).alias("origin"))
    return placed.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("origin")).alias("depth"), "turn_key", "n_bytes")


def with_shared_heads(turns: DataFrame, head: Column, source: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are another's: (conv_id, length) of each, and its turns.

    The first ``head`` turns (columns of conv_id, at most ``most``) are those of conversation ``source``, all if it has
    fewer and none if it is absent; then come the conversation's own turns after its first ``head``.
    """
    own = turns.groupBy("conv_id").agg(F.max("depth").alias("own"))
    other = own.select(F.col("conv_id").alias("source"), F.col("own").alias("theirs"))
    convs = own.withColumn("head", head).withColumn("source", source).join(other, "source", "left")
    convs = convs.withColumn("taken", F.least("head", F.coalesce("theirs", F.lit(0))))
    tail = turns.join(convs.select("conv_id", "head", "taken"), "conv_id").filter("depth > head")
    tail = tail.select("conv_id", (F.col("depth") - F.col("head") + F.col("taken")).alias("depth"), "turn_key", "n_bytes")
    first = turns.filter(F.col("depth") <= most).withColumnRenamed("conv_id", "source")
    first = first.join(convs.select("conv_id", "source", "taken"), "source").filter("depth <= taken").select("conv_id", "depth", "turn_key", "n_bytes")
    return convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length")), tail.union(first)


def digests(ends: DataFrame, parts: int) -> DataFrame:
    """depth, node, ends_sha256: of the conv_ids that end in a node, ascending and joined by commas."""

    def pack(batches):
        key, ids, size, first = None, [], 0, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(ids).encode()], pa.binary())], ["depth", "node", "first", "ids"])

        for b in batches:
            for depth, node, conv in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if key != (depth, node) or size >= ID_BLOCK:
                    if ids:
                        yield row()
                    key, ids, size, first = (depth, node), [], 0, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield row()

    def digest(batches):
        key, sha = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([sha.hexdigest()])], ["depth", "node", "ends_sha256"])

        for b in batches:
            for depth, node, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if key == (depth, node):
                    sha.update(b",")
                elif key is not None:
                    yield row()
                if key != (depth, node):
                    key, sha = (depth, node), hashlib.sha256()
                sha.update(ids)
        if key is not None:
            yield row()

    order = ["depth", "node", "conv_id"]
    packed = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, "depth long, node long, first long, ids binary")
    return packed.repartition(parts, "depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(digest, "depth long, node long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node. convs: conv_id, length (0: no turn, a member of the root alone); turns: conv_id, depth, turn_key, n_bytes."""
    prepare(convs.sparkSession)
    with Scratch(convs.sparkSession) as scratch:
        convs = scratch.save(convs)
        n = convs.count()
        parts = buckets_for(64 * n)
        # In order of depth, so that a level reads its own row groups.
        turns = scratch.save(turns.repartitionByRange(parts, "depth", "conv_id").sortWithinPartitions("depth", "conv_id"))
        root = convs.agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_ends")).filter("n_convs > 0")
        levels = [scratch.save(root.select("node", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("n_bytes"), "n_ends"))]
        first = convs.agg(F.min("conv_id")).first()[0]
        live = convs.withColumn("node", F.lit(first).cast("long"))
        ended = [(live.filter("length = 0"), 0)]
        while n:
            depth = len(levels)
            grown = live.filter(F.col("length") >= depth).select("conv_id", "length", F.col("node").alias("parent"))
            grown = scratch.save(grown.join(turns.filter(F.col("depth") == depth).drop("depth"), "conv_id"))
            groups = grown.groupBy("parent", "turn_key").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.count_if(F.col("length") == depth).alias("n_ends"))
            groups = scratch.save(groups)
            if groups.isEmpty():
                break
            levels.append(groups.drop("turn_key"))
            live = grown.drop("n_bytes").join(groups.filter("n_convs > 1").select("parent", "turn_key", "node"), ["parent", "turn_key"]).select("conv_id", "length", "node")
            ended.append((live.filter(F.col("length") == depth), depth))
        if not n:
            return save(convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], F.lit("").alias("ends_sha256")))
        done, above = [], None
        alone = F.col("n_convs") == 1
        for depth in reversed(range(len(levels))):
            nodes = levels[depth]
            if above is None:
                nodes = nodes.withColumns({"children": F.lit(None).cast("long"), "leaves": F.lit(None).cast("long"), "saved": F.lit(None).cast("long")})
            else:
                nodes = nodes.join(above.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")), "node", "left")
            above = scratch.save(
                nodes.select(
                    F.lit(depth).cast("long").alias("depth"),
                    "node",
                    "parent",
                    "n_convs",
                    "n_ends",
                    # The path of a node's only member goes on below.
                    F.when(alone, 1 - F.col("n_ends")).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"),
                    F.coalesce(F.when(~alone, F.col("leaves")), F.lit(1)).alias("n_leaves"),
                    ((F.col("n_convs") - 1) * F.col("n_bytes") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
                )
            )
            done.append(above)
        nodes = done[0]
        for level in done[1:]:
            nodes = nodes.union(level)
        left = nodes.filter(alone & (F.col("n_children") == 1)).select(F.col("node").alias("conv_id"), F.col("depth").alias("left_at"))
        path = turns.join(left, "conv_id").filter("depth > left_at").join(convs, "conv_id")
        one, last = F.lit(1).cast("long"), F.col("depth") == F.col("length")
        path = path.select("depth", F.col("conv_id").alias("node"), F.col("conv_id").alias("parent"), one.alias("n_convs"), last.cast("long").alias("n_ends"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        ends = ended[0][0].select(F.lit(0).cast("long").alias("depth"), "node", "conv_id")
        for rows, depth in ended[1:]:
            ends = ends.union(rows.select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
        shared = nodes.filter(~alone).join(digests(ends, parts), ["depth", "node"], "left")
        alone_ends = F.sha2(F.when(F.col("n_ends") == 1, F.col("node").cast("string")).otherwise("").cast("binary"), 256)
        out = shared.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))).unionByName(nodes.filter(alone).union(path.select(nodes.columns)).withColumn("ends_sha256", alone_ends))
        return save(out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))


def rebuilt_trie(conversations: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """The trie of conversations rebuilt in groups: conversation c takes its first crc32(c) % (most + 1) turns from c - c % group."""
    with Scratch(conversations.sparkSession) as scratch:
        turns = scratch.save(ranked(conversations, scratch))
        head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
        convs, turns = with_shared_heads(turns, head, F.col("conv_id") - F.col("conv_id") % group, most)
        return prefix_trie(convs, turns)


#: Prefixes are known by a chain of digests; a node's subtree is the nodes whose smallest member belongs to it.
ORACLE_SQL = """
WITH RECURSIVE crc(v, k, c) AS (
    SELECT v, 0, v FROM range(256) AS bytes(v)
    UNION ALL
    SELECT v, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
), tab AS (SELECT list(c ORDER BY v) AS t FROM crc WHERE k = 8),
ranked AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS rank,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_key, strlen(coalesce(text, '')) AS n_bytes
    FROM conversations WHERE conv_id IS NOT NULL
), hashed AS (
    SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM ranked), tab
), turns AS (
    SELECT h.conv_id, r.rank AS place, r.turn_key, r.n_bytes FROM hashed h JOIN ranked r ON r.conv_id = h.conv_id - h.conv_id % 5 AND r.rank <= h.h
    UNION ALL
    SELECT h.conv_id, r.rank + 1000000 AS place, r.turn_key, r.n_bytes FROM hashed h JOIN ranked r ON r.conv_id = h.conv_id AND r.rank > h.h
), numbered AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, turn_key, n_bytes FROM turns
), members AS (
    SELECT conv_id, depth, sha256(string_agg(turn_key, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix, n_bytes FROM numbered
    UNION ALL
    SELECT conv_id, 0, '', 0 FROM hashed
), lengths AS (
    SELECT conv_id, max(depth) AS length FROM members GROUP BY conv_id
), nodes AS (
    SELECT m.depth, m.prefix, min(m.conv_id) AS conv_id, count(*) AS n_convs, max(m.n_bytes) AS n_bytes,
        sha256(coalesce(string_agg(CASE WHEN l.length = m.depth THEN m.conv_id::VARCHAR END, ',' ORDER BY m.conv_id), '')) AS ends_sha256
    FROM members m JOIN lengths l USING (conv_id) GROUP BY m.depth, m.prefix
), parents AS (
    SELECT n.*, p.conv_id AS parent_conv_id
    FROM nodes n LEFT JOIN members m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN nodes p ON p.depth = m.depth AND p.prefix = m.prefix
), children AS (
    SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
    SELECT p.*, coalesce(c.n_children, 0) AS n_children FROM parents p LEFT JOIN children c USING (depth, conv_id)
), below AS (
    SELECT m.depth, m.prefix, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.n_bytes) AS saved_tokens
    FROM full_nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.depth, m.prefix
)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b USING (depth, prefix)
"""
