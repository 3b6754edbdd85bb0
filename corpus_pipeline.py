"""Corpus pipeline: five stages, each an operator of the ``llm`` subpackage over all its predecessor kept.

Every stage but the last returns the columns of ``documents`` as they were, extra ones too. A stage lists the
documents that it drops, writes that list, and reads its input once against it: a list that is small enough is
broadcast by Spark's own size check, a large one meets the documents in a shuffled join. Empty tables give empty
results in every stage; texts are worked whole, however long; columns other than doc_id and text may be null (lang
serves as the label that languages are learnt from).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pyrelake.llm import decontaminate, exact_dedup, language_id, ngram_join, piece_lattice
from pyrelake.llm.common import save, scratch_dir
from pyrelake.llm.queries import table, tokenizer_path


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose id is not in ``dropped``."""
    return docs.join(save(dropped.select("doc_id").distinct()), "doc_id", "left_anti").select(docs.columns)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null or empty texts and those without a letter; all go if no text has a label. Rows that repeat an id are kept or dropped alike."""
    return without(docs, language_id.language_id(docs).filter("lang_pred = 'und'"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays; null equals empty. All rows of the id that stays are kept."""
    return without(docs, exact_dedup.exact_dedup(docs).filter("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the smallest id stays. A text without words links with nothing and stays."""
    return without(docs, ngram_join.ngram_join(docs).filter("doc_id <> component_id"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go; with an empty benchmark, all stay. Null texts hold nothing."""
    return without(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row of its input: digests of the model's ids, the n best segmentations and the decoded text. Null counts as empty."""
    return piece_lattice.digest(piece_lattice.encode_pieces(docs, tokenizer_path("piece_bpe_32k.model")))


STAGES = [("language_id", identify), ("exact_dedup", exact), ("ngram_join", near), ("decontaminate", clean), ("piece_lattice", pieces)]

#: Language profiles, set similarity over all documents and the piece lattice are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
