"""Language ID by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams (n = 1 to 3; runs of letters, folded to lower case, padded
with one blank on each side). A document goes to the language whose profile is nearest by the out-of-place distance:
the sum, over the document's own profile, of how far each n-gram is from its place in the language's profile, an
absent one counting as the profile's full length.

Profiles are learnt from a bounded sample of labelled texts: at most about ``train_docs`` documents a language, those
whose hashed id is smallest. A null text, or one without a letter, is ``und`` with score 0. Ties between languages go
to the alphabetically first. With no labelled text at all, everything is ``und``. Repeated rows get a row each. Extra
columns are ignored, very long texts are profiled whole, and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, held_out, prepare, sampled, starts_of, threshold

#: Length of a profile.
TOP = 400
_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 if it is no letter."""
    global _fold
    if _fold is None:
        _fold = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                _fold[c] = ord(low) if len(low) == 1 else c
    return _fold


def ngrams(text: bytes) -> np.ndarray:
    """All n-grams, n = 1 to 3, packed into 64 bits; a blank stands only at either end."""
    letters = fold_table()[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")]
    letters = letters[np.r_[True, (letters[1:] != 0) | (letters[:-1] != 0)]] if len(letters) else letters
    c = np.r_[np.uint32(0), letters, np.uint32(0)].astype(np.uint64)
    if len(letters) and letters[0] == 0:
        c = c[1:]
    if len(letters) > 1 and letters[-1] == 0:
        c = c[:-1]
    one = c[c != 0]
    two = (c[:-1] << np.uint64(21) | c[1:]) | np.uint64(1 << 62)
    mid = c[1:-1] != 0
    three = (c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])[mid] | np.uint64(1 << 63)
    return np.concatenate([one, two, three])


def profile(text: bytes, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams in order; ties by the n-gram itself."""
    g = np.sort(ngrams(text))
    s = starts_of(g)
    n = np.diff(np.r_[s, len(g)])
    return g[s][np.argsort(-n, kind="stable")[:top]]


def train(docs: DataFrame, train_docs: int = 2000, top: int = TOP) -> dict[str, np.ndarray]:
    """Language -> its n-grams in order of rank. Bounded by languages times ``top``."""
    prepare(docs.sparkSession)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    below = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, threshold(train_docs, n))])
    sample = labelled.filter(sampled(F.element_at(below, F.col("lang")))).select("lang", "text")

    def count(batches):
        for b in batches:
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                g = np.sort(np.concatenate([ngrams(t) for t in texts]))
                s = starts_of(g)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s), pa.string()), pa.array(g[s].view(np.int64)), pa.array(np.diff(np.r_[s, len(g)]))], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counted.withColumn("r", rank).filter(F.col("r") <= top).collect()
    out: dict[str, np.ndarray] = {}
    for lang in sorted(sizes):
        own = sorted((r["r"], r["gram"]) for r in rows if r["lang"] == lang)
        if own:
            out[lang] = np.array([g for _, g in own], np.int64).view(np.uint64)
    return out


def classify(texts: list[bytes], profiles: dict[str, np.ndarray], top: int = TOP) -> tuple[list[str], list[float]]:
    """Nearest language of each text and a score: the runner-up's share of the two distances."""
    langs = sorted(profiles)
    grams = np.unique(np.concatenate([profiles[k] for k in langs])) if langs else np.zeros(0, np.uint64)
    rank = np.full((len(langs), len(grams) + 1), top, np.int64)
    for k, lang in enumerate(langs):
        rank[k, np.searchsorted(grams, profiles[lang])] = np.arange(len(profiles[lang]))
    absent = len(grams)
    preds, scores = [], []
    for text in texts:
        own = profile(text, top) if langs else np.zeros(0, np.uint64)
        if not len(own) or not (own < np.uint64(1 << 62)).any():
            preds.append("und")
            scores.append(0.0)
            continue
        at = np.searchsorted(grams, own)
        at = np.where(grams[np.minimum(at, absent - 1)] == own, np.minimum(at, absent - 1), absent)
        r = rank[:, at]
        d = np.where(r == top, top, np.abs(r - np.arange(len(own)))).sum(axis=1)
        o = np.argsort(d, kind="stable")
        preds.append(langs[o[0]])
        scores.append(float(d[o[1]] / max(1, d[o[0]] + d[o[1]])) if len(o) > 1 else 1.0)
    return preds, scores


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    prepare(docs.sparkSession)

    def predict(batches):
        for ids, texts in blocks(batches):
            preds, scores = classify(texts, profiles, top)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, train_docs: int = 2000) -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    profiles = train(docs.filter(~held_out()), train_docs)
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
