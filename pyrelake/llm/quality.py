"""Quality classifier by compression with two dictionaries.

One zstandard dictionary is built from texts labelled good, one from texts labelled bad. A text's feature is the
difference of its two compressed sizes over its own length; a logistic curve fitted on labelled texts that took no
part in the dictionaries turns it into a probability.

Dictionaries and curve are fitted on a bounded sample of labelled rows: about ``train_docs`` documents a class, those
with the smallest hashed ids; one half, whole texts in pieces, feeds the dictionaries, the other half the curve. The
sample is held by the driver: about 2 x ``train_docs`` texts. Every text is scored whole, however long. Empty and null
texts have feature 0 and get the curve's value there. With labels of one class only, the score is that class's share
of the labels (0.5 without any). Several labels of one document count once each; repeated documents get a row each.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, held_out, prepare, sampled, threshold


def features(texts: list[bytes], good: bytes, bad: bytes, level: int = 3) -> np.ndarray:
    import zstandard

    a, b = (zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) for d in (good, bad))
    return np.array([(len(b.compress(t)) - len(a.compress(t))) / len(t) if t else 0.0 for t in texts])


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float, float]:
    """(scale, slope, intercept) of a logistic curve, by Newton's method with a light penalty on the slope."""
    scale = float(np.std(x)) or 1.0
    z = np.c_[x / scale, np.ones(len(x))]
    w, keep = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + keep, z.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return scale, float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 2000, dict_bytes: int = 16384) -> dict:
    """Fit on a sample of labelled rows whose size does not depend on the input."""
    import zstandard

    known = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id"), F.col("quality").cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    below = F.when(F.col("y") == 1, threshold(train_docs, sizes.get(1, 1))).otherwise(threshold(train_docs, sizes.get(0, 1)))
    sample = known.filter(sampled(below))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text").collect()  # about 2 * train_docs texts
    rows = sorted(((r["doc_id"], r["y"], (r["text"] or "").encode()) for r in rows), key=lambda r: (r[0], r[1], r[2]))
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    parts = {}
    for y in (0, 1):
        own = [t for k, (_, q, t) in enumerate(rows) if q == y and k % 2 == 0 and t]
        pieces = [t[k : k + 2048] for t in own for k in range(0, len(t), 2048)]
        n = sum([len(t) for t in own])
        try:
            parts[y] = zstandard.train_dictionary(max(256, min(dict_bytes, n // 8)), pieces).as_bytes() if len(pieces) >= 8 else b"".join(pieces)[-dict_bytes:]
        except zstandard.ZstdError:
            parts[y] = b"".join(pieces)[-dict_bytes:]
    rest = [(q, t) for k, (_, q, t) in enumerate(rows) if k % 2]
    if not (parts[0] and parts[1]) or len({q for q, _ in rest}) < 2:
        return {"prior": prior}
    x = features([t for _, t in rest], parts[1], parts[0])
    y = np.array([q for q, _ in rest], float)
    # Classes are sampled apart: the intercept is put back to their true shares.
    scale, slope, intercept = fit_curve(x, y)
    ours = y.mean()
    intercept += np.log(prior / (1 - prior)) - np.log(ours / (1 - ours))
    return {"prior": prior, "good": parts[1], "bad": parts[0], "curve": (scale, slope, float(intercept))}


def score_texts(texts: list[bytes], model: dict) -> np.ndarray:
    if "curve" not in model:
        return np.full(len(texts), float(model["prior"]))
    scale, slope, intercept = model["curve"]
    return 1 / (1 + np.exp(-np.clip(features(texts, model["good"], model["bad"]) / scale * slope + intercept, -30, 30)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score for every row."""
    prepare(docs.sparkSession)

    def run(batches):
        for ids, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(score_texts(texts, model))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def quality_filter(docs: DataFrame, labels: DataFrame, cut: float = 0.7, **options) -> DataFrame:
    """Learn from the rows that are not held out, score all: doc_id, held_out, score, predicted."""
    model = fit(docs.filter(~held_out()), labels.filter(~held_out()), **options)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
