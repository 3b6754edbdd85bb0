"""Token-ID output: one wavelet matrix per shard of consecutive documents.

Documents are ordered by doc_id over range partitions. Each partition encodes its texts in order, appends the end id
to each document, and cuts shards of about ``shard_tokens`` ids; a shard is a row of a Parquet table: its partition
and number, the ids before it in that partition, its documents with their lengths, and the wavelet matrix as bytes.
Spark's writer puts the files wherever the cluster's storage is. Reading them back decodes every shard; the ids of all
partitions before a partition come from a sum of one row a partition.

Null counts as empty text, which is the end id alone. A document longer than a shard has a shard of its own. Repeated
rows are written as often as they occur, in an order fixed by their text. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import gc
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wavelet
from .common import buckets_for, on_executors, prepare, save, volume

SCHEMA = "part int, shard int, before long, n_tokens long, doc_ids array<long>, lengths array<long>, matrix binary"
END_ID = 0
#: Partitions whose offsets, two longs each, are broadcast: a megabyte.
FEW = 1 << 16
_encoders: dict[str, Encoder] = {}


class Encoder:
    """The tokenizers library behind a bounded cache of what stands between two splits.

    A space before a character that is no white space always starts a new pre-token of a byte-level BPE, so a text
    may be cut there: the pieces' ids, joined, are the text's ids. Texts are cut and their pieces counted in Arrow; new
    pieces go to the library's model where their pre-tokens are plain, and else through the whole tokenizer, many as one
    text, told apart by the tokens that begin with a space. The cache has two generations.
    """

    LIMIT, TOGETHER = 400_000, 4000
    #: A space that ends the text or stands before white space (or a control character): such texts are cut one by one.
    WIDE = r" ([\s\pZ\pC]|\z)"

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.former = Tokenizer.from_file(path), {"": b""}, {}
        self.cut = re.compile(r" (?=\S)")
        self.simple = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)").fullmatch
        # A byte-level tokenizer's letters for bytes: printable ones stand for themselves, the others follow from 256.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelled = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        # Whether the tokenizer cuts and spells like that, and no added token is made of letters alone.
        probe = "Aé\u024f".encode().decode("latin-1").translate(self.spelled)
        cuts = [t for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(" Aé\u024f,.;:!?")] if self.tokenizer.pre_tokenizer else []
        self.direct = self.tokenizer.normalizer is None and cuts == ["Ġ" + probe, ",.;:!?"] and not any(self.simple(t.content.strip()) for t in self.tokenizer.get_added_tokens_decoder().values())
        top = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(top)])

    def alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Words that follow a space. Latin letters before plain punctuation are two pre-tokens, given to the model as they are."""
        tokenize, spelled, rest = self.tokenizer.model.tokenize, self.spelled, []
        own, ids, ends = [], [], [0]
        for w in words:
            if self.direct and (m := self.simple(w)):
                letters, marks = m.groups()
                ids += [t.id for t in tokenize("Ġ" + (letters if letters.isascii() else letters.encode().decode("latin-1").translate(spelled)))]
                if marks:
                    ids += [t.id for t in tokenize(marks)]
                own.append(w)
                ends.append(4 * len(ids))
            else:
                rest.append(w)
        raw = np.array(ids, "<u4").tobytes()
        self.known.update(zip(own, [raw[a:e] for a, e in itertools.pairwise(ends)], strict=True))
        for s in range(0, len(rest), self.TOGETHER):
            self.together(rest[s : s + self.TOGETHER])

    def together(self, words: list[str]) -> None:
        """Words without a space are encoded as one text."""
        some = [w for w in words if " " not in w]
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4") if some else np.zeros(0, "<u4")
        at = np.flatnonzero(self.spaced[ids])
        if some and len(at) == len(some) and at[0] == 0:
            raw, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
            self.known.update(zip(some, [raw[a:e] for a, e in zip((4 * at).tolist(), ends, strict=True)], strict=True))
        else:  # a token that takes in the space
            self.known.update(zip(some, self.alone([" " + w for w in some]), strict=True))
        odd = [w for w in words if " " in w]
        self.known.update(zip(odd, self.alone([" " + w for w in odd]), strict=True))

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of words that follow a space; the empty one has none."""
        if len(self.known) > self.LIMIT:
            self.known, self.former = {"": b""}, self.known
        known, former = self.known, self.former
        out = list(map(known.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        known.update([(w, former[w]) for i in missing if (w := words[i]) in former])
        gc.disable()  # many small objects, no cycles
        try:
            self.learn([w for i in missing if (w := words[i]) not in known])
        finally:
            gc.enable()
        for i in missing:
            out[i] = known[words[i]]
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        hard = pc.match_substring_regex(texts, self.WIDE)
        easy = pc.split_pattern(texts.filter(pc.invert(hard)), " ")
        other = [self.cut.split(t) for t in texts.filter(hard).to_pylist()]
        words = pa.concat_arrays([easy.flatten(), pa.array(itertools.chain.from_iterable(other), texts.type)])
        counts = np.concatenate([pc.list_value_length(easy).to_numpy(zero_copy_only=False), np.fromiter(map(len, other), np.int64, len(other))]).astype(np.int64)
        begins = np.cumsum(counts) - counts
        coded = words.dictionary_encode()
        codes, following = coded.indices.to_numpy().astype(np.int64), self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        first = words.take(pa.array(begins)).dictionary_encode()
        codes[begins] = len(following) + first.indices.to_numpy()
        if other:  # back to the order of the texts
            place = np.argsort(np.argsort(hard.to_numpy(zero_copy_only=False), kind="stable"))
            begins, counts = begins[place], counts[place]
            codes = codes[spread(begins, counts)]
        raw = following + self.alone(first.dictionary.to_pylist())
        pool, sizes = np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        n = sizes[codes]
        return pool[spread((np.cumsum(sizes) - sizes)[codes], n)], np.add.reduceat(n, np.cumsum(counts) - counts)


def spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at ``begins``, run after run."""
    ends = np.cumsum(counts)
    return np.repeat(begins - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_shards(docs: DataFrame, tokenizer: str, shard_tokens: int = 1 << 19, end_id: int = END_ID) -> DataFrame:
    """Write the shards; the table of them, as written."""
    spark = docs.sparkSession
    prepare(spark)

    local = on_executors(spark, tokenizer)

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part, shard, before = encoder(local()), TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        lengths: list[int] = []
        flats: list[np.ndarray] = []
        n = 0

        def row():
            cells = (part, shard, before, n, ids, lengths, wavelet.encode(np.concatenate(flats)))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        for b in batches:
            flat, sizes = encode(pc.fill_null(b.column(1), ""))
            flat, who, sizes = np.insert(flat, np.cumsum(sizes), end_id), b.column(0).to_pylist(), (sizes + 1).tolist()
            k = start = at = 0  # the first document, and the first id, that no shard has yet
            for i, size in enumerate(sizes):
                n, at = n + size, at + size
                if n >= shard_tokens:
                    ids, lengths = ids + who[k : i + 1], lengths + sizes[k : i + 1]
                    flats.append(flat[start:at])
                    yield row()
                    shard, before, k, start = shard + 1, before + n, i + 1, at
                    ids, lengths, flats, n = [], [], [], 0
            ids, lengths = ids + who[k:], lengths + sizes[k:]
            flats.append(flat[start:])
        if ids:
            yield row()

    parts = buckets_for(volume(docs))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return save(ordered.mapInArrow(run, SCHEMA))


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded matrices."""
    # Ids before a partition: within its group of 1024 partitions, and before that group.
    sizes = shards.groupBy("part", F.expr("part div 1024").alias("batch")).agg(F.sum("n_tokens").alias("n"))
    groups = sizes.groupBy("batch").agg(F.sum("n").alias("all"))
    earlier = groups.select("batch", (F.sum("all").over(Window.orderBy("batch")) - F.col("all")).alias("earlier"))
    inside = F.sum("n").over(Window.partitionBy("batch").orderBy("part")) - F.col("n")
    first = sizes.withColumn("inside", inside).join(earlier, "batch").select("part", (F.col("earlier") + F.col("inside")).alias("first"))
    if shards.select("part").distinct().limit(FEW + 1).count() <= FEW:  # else the join shuffles the matrices
        first = F.broadcast(first)
    placed = shards.join(first, "part").select((F.col("first") + F.col("before")).alias("start"), "doc_ids", "lengths", "matrix")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, lengths = np.array(b.column(1)[k].as_py(), np.int64), np.array(b.column(2)[k].as_py(), np.int64)
                flat = wavelet.WaveletMatrix(b.column(3)[k].as_py()).decode().astype("<u4")
                ends = np.cumsum(lengths)
                raw = memoryview(flat).cast("B")
                crcs = [zlib.crc32(raw[4 * int(e - n) : 4 * int(e)]) for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(b.column(0)[k].as_py() + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    prepare(shards.sparkSession)
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_shards(encode_shards(docs, tokenizer))
