"""N-gram Jaccard join: universe-partition pigeonhole.

Documents are sets of distinct five-word shingles. Two sets link when their Jaccard similarity is at least ``percent``
hundredths. Sets fall into bands by size, each bound 1.25 times the last, so that a partner is in the same or a
neighbouring band. In a band, the shingles are dealt to m segments by hash. Linked sets X, Y of sizes x <= y differ in
at most H = (x + y)(100 - p) / (100 + p) shingles, so of any allocation of thresholds v_i in {0, 1, 2} to the segments
with sum H + 1, one segment has fewer than v_i differences: equal subsets (v_i >= 1), or one deletion apart (v_i = 2).

Each band indexes the subsets of both sides under one global order of keys, the most frequent first: a set gives 0 to as
many of the first as it has segments to spare. As a linked pair shares more keys than either has to spare, the rarest of
them is allocated on both sides. Allocation goes by cost in other ways, too. An empty segment, which very many sets share, gets 0. A set with too few other segments to
reach H + 1 makes up for it with 2 on these, and then its one-deletion neighbourhoods are indexed too; if that is not
enough, empty segments get 1. m leaves some segments to spare.

Work done, in order:
1. equal sets are merged, by size and two independent hashes (the links between them are known);
2. keys of (band, segment, subset) that only one set holds are dropped (:func:`common.shared_keys`);
3. every set is compared with the hub of its keys, the document that shares the most keys (a star a key), if it
   shares enough of them; links are joined to components, and a second round takes the hubs outside the first ones'
   components;
4. the keys that still reach over components are allocated. Of the sets that keep any, a pair that links shares a rare
   shingle (one that ``RARE`` of these sets hold at most), or its common shingles alone are enough: it meets under
   the rare one, or under an allocated key in a size that its number of common shingles allows (:func:`meetings`).
   What may still link across components is verified exactly.
Step 4 makes the result independent of step 3. In a cloud of copies around a hub it is linear: a copy too far from the
hub to link has too few common shingles for any partner. Where sets just under the threshold share nearly all their
shingles with many others and no hub links them, their pairs are verified one by one.
Sets are compared by 64-bit shingle hashes.

A text without words has an empty set and links with nothing. Null counts as empty. Very long texts are whole sets like
any other. Repeated rows form one class, ties do not arise. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PARTS, Scratch, blocks, buckets_for, components, mix, prepare, save, shared_keys, starts_of, volume

WORDS, PERCENT = 5, 80
#: Star rounds before the exhaustive one.
ROUNDS = 2
#: Sizes at which sets meet: their natural logarithms times this, rounded down.
SIZES = 50
#: Classes of the universe in which common shingles are counted.
CLASSES = 16
#: Sets that meet under a shingle: the shingles of more sets count as common ones.
RARE = 16


def shingles(text: bytes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; bytes.split() cuts at space and \\x09-\\x0D, lower() folds A-Z alone."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - k + 1)
    factor = factors(k)
    out = np.full(n, min(len(w), k), np.uint64)
    for i in range(min(k, len(w))):
        out += h[i : i + n] * factor[i]
    return distinct_sorted(mix(out))


@cache
def factors(k: int) -> np.ndarray:
    """An odd factor for each place in a shingle."""
    return mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)


def distinct_sorted(a: np.ndarray) -> np.ndarray:
    a.sort()
    return a[starts_of(a)]


def segment_of(s: np.ndarray, m: int) -> np.ndarray:
    """The segment of each shingle: equal ranges of the hashes, so that a sorted set lies segment by segment."""
    return ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)


def bands(limit: int, percent: int = PERCENT) -> np.ndarray:
    """Lower bounds of the size bands."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, out[-1] * 100 // percent))
    return np.array(out, np.int64)


BOUNDS = bands(1 << 40)


def differences(x: int, y: int, percent: int = PERCENT) -> int:
    """The most shingles in which linked sets of these sizes differ."""
    return (x + y) * (100 - percent) // (100 + percent)


def segments_of(band: int, percent: int = PERCENT) -> tuple[int, int]:
    """(segments, largest possible H) of a band: one more than H, and a tenth and two to spare."""
    top = int(BOUNDS[band + 1]) - 1
    h = differences(top, top, percent)
    return (h + 1) + (h // 10 + 2) if h else 1, h


def needed(n: int, band: int, percent: int = PERCENT) -> int:
    """H + 1 for a set of size n that probes a band: what its thresholds must add up to."""
    top = int(BOUNDS[band + 1]) - 1
    return differences(n, min(top, n * 100 // percent), percent) + 1


def band_keys(s: np.ndarray, band: int, percent: int = PERCENT) -> np.ndarray:
    """The keys of a set in a band; the last bit tells the set's two bands apart."""
    m, _ = segments_of(band, percent)
    need = needed(len(s), band, percent)
    if m == 1:
        return np.zeros(0, np.uint64)  # only equal sets could link
    part = segment_of(s, m)
    at = starts_of(part)
    seg, total = part[at], np.add.reduceat(s, at)
    tag = lambda seg, total, role: mix(total ^ mix((seg.astype(np.uint64) << np.uint64(20)) + np.uint64(band * 8 + role))) & ~np.uint64(1) | np.uint64(band & 1)
    full = tag(seg, total, 0)
    if len(seg) >= need:
        return full
    # Too few: subsets of two or more get 2. The subset and its one-deletion neighbourhood share a role, so that X = Y less one shingle meets.
    sizes = np.diff(np.r_[at, len(s)])
    big = np.repeat(sizes > 1, sizes)
    less = tag(np.repeat(seg, sizes)[big], (np.repeat(total, sizes) - s)[big], 1)
    keys = [full, tag(seg, total, 1), less]
    if len(seg) + int((sizes > 1).sum()) < need:
        empty = np.setdiff1d(np.arange(m), seg)
        keys += [tag(empty, np.zeros(len(empty), np.uint64), 0)]
    return np.concatenate(keys)


def set_keys(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of the set's own band and of the next one, where larger partners may be."""
    if not len(s):
        return np.zeros(0, np.uint64)
    band = int(np.searchsorted(BOUNDS, len(s), "right")) - 1
    return distinct_sorted(np.concatenate([band_keys(s, b, percent) for b in (band, band + 1)]))


def spare_of(s: np.ndarray, percent: int = PERCENT) -> int:
    """How many segments the set may give 0 in either of its bands and still reach H + 1."""
    if not len(s):
        return 0
    band = int(np.searchsorted(BOUNDS, len(s), "right")) - 1
    return max(0, min(len(starts_of(segment_of(s, segments_of(b, percent)[0]))) - needed(len(s), b, percent) for b in (band, band + 1)))


def keys_of(ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys = [set_keys(shingles(t)) for t in texts]
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.repeat(np.arange(len(texts)), [len(k) for k in keys])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, spare, and two hashes of the set."""

    def run(batches):
        for ids, texts in blocks(batches):
            sets = [shingles(t) for t in texts]
            a, b = zip(*((xxhash.xxh3_64_intdigest(s.tobytes()), xxhash.xxh64_intdigest(s.tobytes(), 7)) for s in sets), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), pa.array([spare_of(s) for s in sets], pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], ["doc_id", "n_shingles", "spare", "h1", "h2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, spare long, h1 long, h2 long")


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, hashes: the set as little-endian unsigned 64-bit integers."""

    def run(batches):
        for ids, texts in blocks(batches):
            for s in range(0, len(ids), 200):
                yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + 200]), pa.array([shingles(t).astype("<u8").tobytes() for t in texts[s : s + 200]], pa.binary())], ["doc_id", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, hashes binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("yb")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("xa")), "a")
    return both.select("a", "b", "xa", "yb").mapInArrow(run, "a long, b long").distinct()


def shingle_keys(ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sets = [shingles(t) for t in texts]
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.repeat(np.arange(len(texts)), [len(s) for s in sets])


def hub() -> Column:
    """Of the rows under a key the document that shares the most keys with others: in a cloud of copies, what they are copies of."""
    return F.min(F.struct((-F.col("held")).alias("order"), "doc_id", "label", "n", "spare")).over(Window.partitionBy("key"))


def stars(live: DataFrame, peel: int, percent: int) -> DataFrame:
    """Pairs (a, b): documents and the hub of their key, if in another component and with enough keys of the hub.

    ``peel``: how many hubs have had their turn; the rows of their components are out.
    """
    for _ in range(peel):
        live = live.withColumn("hub", hub()).filter("label <> hub.label").drop("hub")
    near = (F.col("hub.n") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("hub.n") * percent)
    # Linked sets share more keys than the smaller one has to spare; under stars, a part of these shows.
    enough = F.count(F.lit(1)) * 2 > F.min(F.when(F.col("n") <= F.col("hub.n"), F.col("spare")).otherwise(F.col("hub.spare")))
    found = live.withColumn("hub", hub()).filter("label <> hub.label").filter(near)
    return found.groupBy(F.least("hub.doc_id", "doc_id").alias("a"), F.greatest("hub.doc_id", "doc_id").alias("b")).agg(enough.alias("enough")).filter("enough").select("a", "b")


def mixed(live: DataFrame) -> DataFrame:
    """The rows of keys that reach over components, with ``freq``, the rows of the key."""
    by_key = Window.partitionBy("key")
    ends = live.select("*", F.min("label").over(by_key).alias("low"), F.max("label").over(by_key).alias("high"), F.count(F.lit(1)).over(by_key).alias("freq"))
    return ends.filter("low < high").drop("low", "high")


def allocate(live: DataFrame) -> DataFrame:
    """Of the keys that reach over components, those of each set and band but the ``spare`` most frequent ones, which get 0."""
    place = F.row_number().over(Window.partitionBy("doc_id", F.col("key").bitwiseAND(1)).orderBy(F.desc("freq"), "key"))
    return mixed(live).withColumn("place", place).filter("place > spare").select("doc_id", "n", "label", "key")


def overlap_allows(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of sizes n and m can link with an overlap of at most this."""
    return overlap * (100 + percent) >= (n + m) * percent


def common_at_most(x: str, y: str) -> Column:
    """The most common shingles that two sets can share, from their counts in each class of the universe."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.least(a, b)), F.lit(0), lambda total, v: total + v)


def met_by_segment(probes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components under a key allocated on both sides that need share no rare shingle to link.

    probes: doc_id, n, label, key, and e: how many shingles of the set more than ``RARE`` of the probing sets hold. The
    overlap is e at most, which bounds the size of a partner; sets meet by key and size, the larger one looking up the
    sizes that its e allows. by_class: e by classes of the universe, a sharper bound for two sets that lack different shingles. In a cloud, a copy too far from the hub to link has too few common shingles for any size.
    """
    size = lambda c: F.floor(F.log(c) * SIZES).cast("int")
    low, high = F.ceil(F.col("n") * percent / 100), F.least(F.col("n"), F.floor(F.col("e") * (100 + percent) / percent).cast("long") - F.col("n"))
    x = probes.withColumn("low", low).withColumn("high", high).filter("high >= low")
    x = x.select("key", F.explode(F.sequence(size(F.col("low")), size(F.col("high")))).alias("size"), F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("e").alias("ex"), F.col("by_class").alias("cx"), F.col("label").alias("lx"))
    y = probes.select("key", size(F.col("n")).alias("size"), "doc_id", "n", "e", "by_class", "label")
    smaller = (F.col("n") < F.col("nx")) | ((F.col("n") == F.col("nx")) & (F.col("doc_id") < F.col("x")))
    fits = (F.col("n") * 100 >= F.col("nx") * percent) & overlap_allows(F.least("e", "ex"), F.col("n"), F.col("nx"), percent)
    fits &= overlap_allows(common_at_most("by_class", "cx"), F.col("n"), F.col("nx"), percent)
    both = x.join(y, ["key", "size"]).filter((F.col("label") != F.col("lx")) & smaller & fits)
    return both.select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b"))


def met_by_shingle(rare: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share rare shingles, enough of them to link. rare: key, doc_id; about: doc_id, n, label, e, by_class.

    At most ``RARE`` sets meet under a shingle. The overlap of a pair is the rare shingles that it shares and
    what its common ones allow: by their number e first, then, for the pairs left, by class.
    """
    rows = rare.join(about.drop("by_class"), "doc_id")
    x, y = ([rows.select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "n", "label", "e")]) for k in "ab"])
    fits = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    both = x.join(y, "key").filter((F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("label_a") != F.col("label_b")) & fits)
    shared = both.groupBy("doc_id_a", "doc_id_b", "n_a", "n_b", F.least("e_a", "e_b").alias("e")).agg(F.count(F.lit(1)).alias("r"))
    likely = shared.filter(overlap_allows(F.col("e") + F.col("r"), F.col("n_a"), F.col("n_b"), percent))
    for k in "ab":
        likely = likely.join(about.select(F.col("doc_id").alias(f"doc_id_{k}"), F.col("by_class").alias(f"by_class_{k}")), f"doc_id_{k}")
    e = common_at_most("by_class_a", "by_class_b")
    return likely.filter(overlap_allows(e + F.col("r"), F.col("n_a"), F.col("n_b"), percent)).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))


def meetings(probes: DataFrame, shared: DataFrame, percent: int, keep: Callable[[DataFrame], DataFrame] = save) -> DataFrame:
    """Pairs of different components that may link. probes: doc_id, n, label, key; shared: (doc_id, key), the shingles of these sets that several of them hold."""
    few = shared.groupBy("key").agg(F.count(F.lit(1)).alias("f")).filter(F.col("f") <= RARE).select("key")
    rare = keep(shared.join(few, "key"))
    classes = lambda name: F.array(*[F.count_if(F.pmod("key", F.lit(CLASSES)) == k) for k in range(CLASSES)]).alias(name)
    own = rare.groupBy("doc_id").agg(F.count(F.lit(1)).alias("r"), classes("rare"))
    every = shared.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), classes("every"))
    by_class = F.when(F.col("rare").isNull(), F.col("every")).otherwise(F.zip_with("every", "rare", lambda a, b: a - b)).cast("array<int>")
    e = every.join(own, "doc_id", "left").select("doc_id", (F.col("c") - F.coalesce("r", F.lit(0))).alias("e"), by_class.alias("by_class"), (F.col("c") * 100).alias("c"))
    about = keep(probes.select("doc_id", "n", "label").distinct().join(e, "doc_id").filter(F.col("c") >= F.col("n") * percent).drop("c"))
    segments = met_by_segment(probes.select("doc_id", "key").join(about, "doc_id"), percent)
    return segments.union(met_by_shingle(rare, about, percent)).distinct()


def ngram_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_verified (the links of its set found on the way, not all)."""
    spark = docs.sparkSession
    prepare(spark)
    with Scratch(spark) as scratch:
        sized = scratch.save(describe(docs))
        same = ["n_shingles", "h1", "h2"]
        classes = sized.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"))
        members = scratch.save(sized.join(classes, same, "left").select("doc_id", "n_shingles", "spare", F.coalesce("rep", "doc_id").alias("rep")))
        reps = members.filter("doc_id = rep AND n_shingles > 0").select("doc_id", F.col("n_shingles").alias("n"), "spare").distinct()

        n_buckets = buckets_for(volume(docs), 8 << 20)
        held = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
        live = scratch.save(shared_keys(docs, keys_of, n_buckets, distinct=True).join(reps, "doc_id").withColumn("held", held))
        texts = docs.select("doc_id", "text")
        parts = min(n_buckets, PARTS)
        sets = scratch.bucketed(sets_of(texts.join(live.select("doc_id").distinct(), "doc_id", "left_semi")).repartition(parts, "doc_id"), parts, "doc_id")

        links = tested = sets.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)
        labels = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
        for peel in range(ROUNDS):
            pairs = scratch.save(stars(labelled(live, labels), peel, percent).join(tested, ["a", "b"], "left_anti"))
            found = scratch.save(verify(pairs, sets, percent))
            links, tested = links.union(found), tested.union(pairs)
            labels = components(links, scratch.save)
            if peel == 0:  # keys within one component have done their work
                live = scratch.save(mixed(labelled(live, labels)).select("doc_id", "key", "n", "spare", "held"))
        probes = scratch.save(allocate(labelled(live, labels)))
        asked = texts.join(probes.select("doc_id").distinct(), "doc_id", "left_semi")
        shared = scratch.save(shared_keys(asked, shingle_keys, n_buckets, distinct=True))
        pairs = scratch.save(meetings(probes, shared, percent, scratch.save).join(tested, ["a", "b"], "left_anti"))
        found = scratch.save(verify(pairs, sets, percent))
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links, scratch.save)
        degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_verified"))
        out = members.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
        return save(out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_verified", F.lit(0)).cast("long").alias("n_verified")))


def labelled(live: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the component of each document, its own id if it has none yet."""
    return live.join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
