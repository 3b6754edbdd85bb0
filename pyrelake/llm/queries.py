"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, kneser_ney, language_id, line_dedup, ngram_join, piece_lattice, prefix_trie, quality, secret_scan, spelling, substring_dedup, token_output


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark, sf_dir):
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_output(spark, sf_dir):
    return token_output.token_output(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_piece_lattice(spark, sf_dir):
    return piece_lattice.digest(piece_lattice.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")))


def op6_quality(spark, sf_dir):
    return quality.quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.secret_scan(table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_lm_scores(spark, sf_dir):
    return kneser_ney.held_out_scores(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_ngram_join, op3_decontaminate, op4_token_output, op5_piece_lattice, op6_quality, op7_line_dedup, op8_substring_dedup, op9_exact_dedup, op10_secret_scan, op11_prefix_trie, op12_lm_scores, op13_spelling_variants)}

ORACLE_SQL = {"op7_line_dedup": line_dedup.ORACLE_SQL, "op9_exact_dedup": exact_dedup.ORACLE_SQL, "op11_prefix_trie": prefix_trie.ORACLE_SQL, "op13_spelling_variants": spelling.ORACLE_SQL}
