"""Spelling variants: rare-first q-gram prefix filter.

Two words are near when they differ by one inserted, deleted or replaced code point. Their bigrams are put in one global
order, the rarest first. One edit spoils at most two bigrams of a word, so the three rarest positional bigrams of near
words have one in common, at the same place where lengths are equal, and at the same or the next place of the longer
word where they differ by one. Words meet by (bigram, place, length). As one edit also leaves the first or the second
half of the shorter word as it is, that half belongs to the key: a bigram that very many words have among their rarest
is split by it, and no group of it is paired whole. What meets is verified by its edit distance; skewed keys are split
by Spark's join.

The order of bigrams has a row for each pair of letters, at most 90 * 90, and is the only thing that the driver holds:
all joins are merge joins. Spark would broadcast tables that grow with the words, as it takes a table for as large as its
compressed file, and what a Python task makes of a word for as large as the word.
A word's form is its near word of largest n (ties: the first in code-point order) if that n is at least ``factor``
times its own; forms of forms lead to a root, each step at least ``factor`` times as frequent, so steps are few.

Null texts have no word, texts are searched whole. Repeated rows count as often as they occur. A null doc_id counts as
empty. Extra columns are ignored; an empty table or one without words gives an empty result.
"""

from __future__ import annotations

import string

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare, save

LETTERS = "A-Za-zÀ-ÿ"
LEAST, FACTOR, PREFIX = 7, 10, 3
SAME, SHORTER, LONGER = 0, 1, 2


def counted_words(docs: DataFrame, least: int = LEAST, damage: int = 31) -> DataFrame:
    """word, n: runs of letters with A-Z lower-cased. Where ``damage`` divides the crc32 h of doc_id:run, the run has lost its code point h % length."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least},}})"), 1))
    words = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    words = words.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    words = words.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"), F.length("run").alias("length"))
    lost = F.concat(F.col("run").substr(F.lit(1), (F.col("h") % F.col("length")).cast("int")), F.col("run").substr((F.col("h") % F.col("length") + 2).cast("int"), F.col("length")))
    words = words.select(F.when(F.col("h") % damage == 0, lost).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def ranks_of(words: DataFrame) -> dict[str, int]:
    """The global order of bigrams: by the number of places where they occur, then by themselves."""
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.col("word").substr(k, F.lit(2))))
    counts = words.select(gram.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return {r["gram"]: k for k, r in enumerate(sorted(counts.collect(), key=lambda r: (r["n"], r["gram"])))}


def rarest(word: str, ranks: dict[str, int]) -> list[tuple[int, str]]:
    """(place, bigram) of the three first in the global order; equal bigrams go by place."""
    grams = sorted((ranks[word[k : k + 2]], k) for k in range(len(word) - 1))
    return [(k, word[k : k + 2]) for _, k in grams[:PREFIX]]


def keys_of(word: str, ranks: dict[str, int]) -> list[tuple[int, str]]:
    """(role, key): what a word meets words of its own length under, longer ones, and shorter ones."""
    n, out = len(word), []
    for role, shorter in ((SAME, n), (SHORTER, n), (LONGER, n - 1)):
        half = shorter // 2
        intact = (f"<{word[:half]}", f">{word[n - (shorter - half) :]}")
        kind = "s" if role == SAME else "d"
        for place, gram in rarest(word, ranks):
            for at in (place, place + 1) if role == SHORTER else (place,):
                out += [(role, f"{kind}{shorter}:{at}:{gram}{part}") for part in intact]
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: every pair of near words once."""
    prepare(words.sparkSession)
    ranks = ranks_of(words)

    def run(batches):
        for b in batches:
            role, key, word = [], [], []
            for w in b.column(0).to_pylist():
                found = set(keys_of(w, ranks))
                word += [w] * len(found)
                role += [r for r, _ in found]
                key += [xxhash.xxh3_64_intdigest(k) - (1 << 63) for _, k in found]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(role, pa.int8()), pa.array(word, pa.string())], ["key", "role", "word"])

    keys = words.select("word").mapInArrow(run, "key long, role byte, word string")
    x = keys.filter(F.col("role") != LONGER).select("key", "role", F.col("word").alias("a"))
    y = keys.filter(F.col("role") != SHORTER).select("key", F.col("word").alias("b"))
    near = (F.col("role") == SHORTER) | (F.col("a") < F.col("b"))
    both = x.hint("merge").join(y, "key").filter(near & (F.levenshtein("a", "b", 1) == 1))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n from words (word, n), each word once."""
    with Scratch(words.sparkSession) as scratch:
        words = scratch.save(words.select("word", "n"))
        pairs = scratch.save(near_pairs(words))
        both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
        both = both.hint("merge").join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
        best = F.min(F.struct((-F.col("other_n")).alias("order"), "other"))
        near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        forms = words.hint("merge").join(near, "word", "left").withColumn("frequent", -F.col("best.order") >= factor * F.col("n"))
        forms = forms.select("word", F.when(F.col("frequent"), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("frequent"), -F.col("best.order")).alias("form_n"))
        forms = scratch.save(forms)
        step = forms.filter("form IS NOT NULL").select("word", "form")
        roots = step.withColumnRenamed("form", "root")
        while True:
            further = step.select(F.col("word").alias("root"), F.col("form").alias("next"))
            moved = scratch.save(roots.hint("merge").join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            roots = moved.drop("moved")
            if moved.filter("moved").isEmpty():
                break
        out = forms.hint("merge").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return save(out)


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants among the words of ``documents``."""
    return variants(counted_words(docs))


#: Near words have a string in common that is either of them or what a deletion leaves of it.
ORACLE_SQL = """
WITH RECURSIVE crc(v, k, c) AS (
    SELECT v, 0, v FROM range(256) AS bytes(v)
    UNION ALL
    SELECT v, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
), tab AS (SELECT list(c ORDER BY v) AS t FROM crc WHERE k = 8),
runs AS (
    SELECT doc_id::VARCHAR AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), once AS (
    SELECT id, run, count(*) AS times, list_transform(string_split(id || ':' || run, ''), lambda x: ord(x)::BIGINT) AS points FROM runs GROUP BY id, run
), hashed AS (
    SELECT run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(points, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + x // 64, 128 + x % 64] END))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
    FROM once, tab
), words AS (
    SELECT word, sum(times)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed
    ) WHERE length(word) >= 7 GROUP BY word HAVING sum(times) > 1
), parts AS (
    SELECT word, word AS part FROM words
    UNION
    SELECT word, left(word, k::INT) || substr(word, k::INT + 2) AS part FROM (SELECT word, unnest(range(length(word))) AS k FROM words)
), near AS (
    SELECT DISTINCT x.word, y.word AS other FROM parts x JOIN parts y USING (part)
    WHERE x.word <> y.word AND (length(x.word) <> length(y.word) OR len(list_filter(range(1, length(x.word) + 1), lambda k: x.word[k] <> y.word[k])) = 1) AND abs(length(x.word) - length(y.word)) <= 1
), best AS (
    SELECT near.word, count(*) AS n_near, arg_min(other, (-o.n, other)) AS other, max(o.n) AS other_n FROM near JOIN words o ON o.word = near.other GROUP BY near.word
), forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
    FROM words w LEFT JOIN best b USING (word)
), steps(word, root, k) AS (
    SELECT word, word, 0 FROM forms
    UNION ALL
    SELECT s.word, f.form, k + 1 FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r USING (word)
"""
