"""Line dedup over overlapping three-line windows.

Every three consecutive lines form a window, hashed to 128 bits. A window that occurs more than once anywhere keeps
its first occurrence, by (doc_id, line number); the lines under all later ones are removed, positions of overlapping
windows merged. Lines are split at "\\n" alone and compared as they are. Windows of three blank lines don't count, and
texts of fewer than three lines stay as they are. Null counts as empty text. Rows that repeat both doc_id and
text count as one occurrence and return a row each. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, text_of

SPAN = 3


def windows(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, row_id, pos): one row for each window that is not blank."""
    lines = docs.select("doc_id", "row_id", F.split(text_of(), "\n", -1).alias("l"))
    at = lambda i: [F.get("l", i + k) for k in range(SPAN)]
    hashes = F.transform(
        F.when(F.size("l") >= SPAN, F.sequence(F.lit(0), F.size("l") - SPAN)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("pos"), F.xxhash64(*at(i)).alias("h1"), F.xxhash64(F.lit(7), *at(i)[::-1]).alias("h2"), (F.length(F.trim(F.concat(*at(i)))) == 0).alias("blank")),
    )
    return lines.select("doc_id", "row_id", F.inline(hashes)).filter("not blank").select("h1", "h2", "doc_id", "row_id", "pos")


def kept_lines(lines: Column, covered: Column) -> Column:
    """The lines whose positions are not in the sorted array ``covered``."""
    return F.filter(lines, lambda _, i: ~F.array_contains(covered, i))


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_text."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_id"))
    spread = save(windows(rows))
    first = spread.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).filter("n > 1").select("h1", "h2", "first")
    later = spread.join(first, ["h1", "h2"]).filter(F.struct("doc_id", "pos") != F.col("first"))
    covered = later.select("doc_id", "row_id", F.explode(F.sequence("pos", F.col("pos") + SPAN - 1)).alias("line")).groupBy("doc_id", "row_id").agg(F.sort_array(F.collect_set("line")).alias("covered"))
    out = rows.join(covered, ["doc_id", "row_id"], "left").withColumn("lines", F.split(text_of(), "\n", -1))
    kept = F.when(F.col("covered").isNull(), F.col("lines")).otherwise(kept_lines(F.col("lines"), F.col("covered")))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"), F.array_join(kept, "\n").alias("kept_text"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, pos, l[pos] || chr(10) || l[pos + 1] || chr(10) || l[pos + 2] AS win
      FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS pos FROM d)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k
      FROM w WHERE length(trim(replace(win, chr(10), ''))) > 0),
c AS (SELECT DISTINCT doc_id, pos + i AS line FROM r, (SELECT unnest([0, 1, 2]) AS i) WHERE k > 1),
e AS (SELECT doc_id, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d)
SELECT e.doc_id, any_value(n)::BIGINT AS n_lines, count(c.line)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN c.line IS NULL THEN e.line END, chr(10) ORDER BY e.pos), '')) AS kept_sha256
FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.pos = c.line GROUP BY e.doc_id
"""
