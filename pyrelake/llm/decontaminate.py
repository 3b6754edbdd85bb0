"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Texts become templates: numbers, units after numbers, and names (capitalised words inside a sentence) are replaced by
typed placeholders, other words are lower-cased and freed of punctuation. Windows of ``window`` template words of the
benchmark are hash-joined with those of the documents. A document that holds at least ``coverage`` of an item's
windows is a candidate; then the words behind the placeholders are compared: the document may put other values there,
but the same value of the item must always get the same value (consistent slots). ``verbatim`` means no value differs,
``reparameterised`` that some do, consistently.

Windows with fewer than half literal words say too little as templates: they match by their words as they are (lower
case), so copies of items made mostly of numbers and names are found, but such windows don't match with other values. Coverage is
the larger of the share of all windows and that of the others. Below ``coverage``, ``run_words`` words of an item in one
piece make a candidate too, whatever share of the item they are. An item shorter than a window forms one window of its own
length; items without words match nothing. Null counts as empty text. Repeated documents get a row each pair of ids;
repeated items likewise. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, text_of

#: Words that are units when a number stands before them.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "percent", "euros", "dollars", "usd", "eur", "miles", "feet", "inches", "pounds", "kmh", "mph")
MARK = "§"
#: Windows of the benchmark up to which they are broadcast; beyond, the join shuffles.
BROADCAST_WINDOWS = 200_000


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{MARK}\s]+", "")


def words(text: Column) -> Column:
    """The words as they are, aligned with :func:`template`."""
    return F.filter(F.split(_bare(F.translate(text, MARK, " ")), r"\s+"), lambda w: w != "")


def template(text: Column) -> Column:
    """Template words: ``§d`` a number, ``§u`` a unit after a number, ``§n`` a name."""
    t = F.translate(text, MARK, " ")
    t = F.regexp_replace(t, r"(?<=[\p{Ll}\p{N},;] )\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", f"{MARK}n")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])[+-]?\d+(?:[.,:/]\d+)*(?![\p{L}\p{N}])", f"{MARK}d")
    t = F.regexp_replace(t, rf"(?<={MARK}d )(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", f"{MARK}u")
    return F.filter(F.split(F.lower(_bare(t)), r"\s+"), lambda w: w != "")


def windows(templates: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """(key, pos, size, h) of all windows of the given sizes over the words in t."""

    def of_size(n: int) -> Column:
        starts = F.when(F.size("t") >= n, F.sequence(F.lit(0), F.size("t") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("size"), F.xxhash64(F.slice("t", i + 1, F.lit(n))).alias("h")))

    each = [of_size(n) for n in sizes]
    return templates.select(key, F.inline(F.concat(*each) if len(each) > 1 else each[0]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.5, consistency: float = 0.8, run_words: int = 24) -> DataFrame:
    """One row for each contaminated (document, item): doc_id, item_id, n_windows, coverage, n_slots, consistency, verdict."""
    items = save(benchmark.select("item_id", text_of().alias("text")).select("item_id", template(F.col("text")).alias("t"), words(F.col("text")).alias("w")).filter(F.size("t") > 0))
    sizes = sorted(r["n"] for r in items.select(F.least(F.size("t"), F.lit(window)).alias("n")).distinct().collect()) or [window]  # at most ``window`` numbers
    own = items.withColumn("n", F.least(F.size("t"), F.lit(window)))
    lowered = F.transform("w", lambda w: F.lower(w)).alias("t")
    grams = None
    for n in sizes:
        sized = own.filter(F.col("n") == n)
        g = windows(sized.select("item_id", "t"), "item_id", [n]).join(own.select("item_id", "t"), "item_id")
        g = g.withColumn("thin", F.size(F.filter(F.slice("t", F.col("pos") + 1, F.col("size")), lambda w: ~F.startswith(w, F.lit(MARK)))) * 2 < F.col("size"))
        raw = windows(sized.select("item_id", lowered), "item_id", [n]).withColumnRenamed("h", "raw").distinct()
        g = g.join(raw, ["item_id", "pos", "size"]).select("item_id", F.col("pos").alias("item_pos"), "size", F.when(F.col("thin"), F.col("raw")).otherwise(F.col("h")).alias("h"), "thin")
        grams = g if grams is None else grams.union(g)
    grams = save(grams)
    count = {r["thin"]: r["n"] for r in grams.groupBy("thin").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select("doc_id", text_of().alias("text"))

    def meet(column: Column, thin: bool) -> DataFrame:
        hashes = grams.filter(F.col("thin") == thin).drop("thin")
        if count.get(thin, 0) <= BROADCAST_WINDOWS:
            hashes = F.broadcast(hashes)
        return windows(texts.select("doc_id", column), "doc_id", sizes).join(hashes, ["h", "size"]).select("doc_id", "item_id", "pos", "item_pos", "size", F.lit(thin).alias("thin"))

    hits = meet(template(F.col("text")).alias("t"), False)
    if count.get(True):
        hits = hits.union(meet(F.transform(words(F.col("text")), lambda w: F.lower(w)).alias("t"), True))
    hits = save(hits)
    places = F.countDistinct("item_pos"), F.countDistinct(F.when(~F.col("thin"), F.col("item_pos")))
    totals = grams.groupBy("item_id").agg(places[0].alias("total"), places[1].alias("total_full"))
    counted = hits.groupBy("doc_id", "item_id").agg(places[0].alias("n_windows"), places[1].alias("n_full")).join(totals, "item_id")
    share = F.greatest(F.col("n_windows") / F.col("total"), F.when(F.col("total_full") > 0, F.col("n_full") / F.nullif(F.col("total_full"), F.lit(0))))
    counted = save(counted.select("doc_id", "item_id", "n_windows", share.alias("coverage")))
    # Of the others, those with enough windows for a run: the longest piece on one diagonal.
    rest = counted.filter((F.col("coverage") < coverage) & (F.col("n_windows") >= run_words - window + 1))
    steps = hits.join(rest.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", "size").distinct()
    piece = F.col("item_pos") - F.row_number().over(Window.partitionBy("doc_id", "item_id", "shift").orderBy("item_pos"))
    runs = steps.withColumn("piece", piece).groupBy("doc_id", "item_id", "shift", "piece", "size").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") + F.col("size") - 1 >= run_words)
    found = save(counted.filter(F.col("coverage") >= coverage).union(rest.join(runs, ["doc_id", "item_id"], "left_semi").select(rest.columns)))
    # The values behind the placeholders, on the diagonals that matched.
    lines = hits.join(found.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi").groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.min("item_pos").alias("low"), F.max(F.col("item_pos") + F.col("size")).alias("high"))
    slots = items.select("item_id", F.posexplode("t").alias("at", "kind"), "w").filter(F.startswith("kind", F.lit(MARK))).select("item_id", "at", F.lower(F.get("w", F.col("at"))).alias("value")).distinct()
    asked = lines.join(slots, "item_id").filter("at >= low AND at < high").select("doc_id", "item_id", "shift", "value", (F.col("at") + F.col("shift")).alias("pos"))
    candidates = asked.select("doc_id").distinct()
    theirs = texts.join(candidates, "doc_id", "left_semi").select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "ours")).distinct()  # repeated rows count once
    where = ["doc_id", "item_id", "shift"]
    pairs = asked.join(theirs, ["doc_id", "pos"]).groupBy(*where, "value", F.lower("ours").alias("ours")).agg(F.count(F.lit(1)).alias("n"))
    by_value = pairs.groupBy(*where, "value").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.when(F.col("value") == F.col("ours"), F.col("n")).otherwise(0)).alias("same"))
    again = lambda c: F.sum(F.when(F.col("n") > 1, F.col(c)))
    by_shift = by_value.groupBy(*where).agg(F.sum("n").alias("n_slots"), F.coalesce(again("most") / again("n"), F.lit(1.0)).alias("consistency"), (F.sum("same") == F.sum("n")).alias("equal"))
    # The placement with the most slots speaks for the pair, the most consistent one of several.
    checked = by_shift.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_slots", "consistency", "equal")).alias("best")).select("doc_id", "item_id", "best.*")
    out = found.join(checked, ["doc_id", "item_id"], "left").withColumns({"n_slots": F.coalesce("n_slots", F.lit(0)), "consistency": F.coalesce("consistency", F.lit(1.0)), "equal": F.coalesce("equal", F.lit(True))})
    return out.filter(F.col("consistency") >= consistency).select("doc_id", "item_id", "n_windows", "coverage", "n_slots", "consistency", F.when(F.col("equal"), "verbatim").otherwise("reparameterised").alias("verdict"))
