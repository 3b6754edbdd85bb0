"""Each stage of the pipeline alone: odd rows, repeated rows, empty tables, clashing columns, long texts."""

import struct
import zlib

import pytest
import sentencepiece

import corpus_pipeline as pipeline
from pyrelake.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id int, lang_pred string, score double, keep_id long, n int"
FILTERS = [pipeline.identify, pipeline.exact, pipeline.near, pipeline.clean]
LONG = " ".join(f"w{i}x{i * i % 977}" for i in range(90_000))


def docs(spark, rows):
    """(doc_id, text, lang) with columns that stages use names of; they are to come through as they were."""
    return spark.createDataFrame([(i, t, lang, None, None, "no", 7, "zz", 0.5, -1, i) for i, t, lang in rows], COLUMNS).repartition(3)


def left(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.fixture(scope="module")
def item(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]


def odd(item):
    return [
        (0, None, None), (1, "", "en"), (2, "  \n\t", "en"), (3, "123 456 !!", "en"), (4, "A river runs through the old town", "en"), (5, "A river runs through the old town", None),
        (6, "a river RUNS through the old town", "en"), (7, "Il fiume scorre nella vecchia città", "it"), (8, f"Before it. {item} And after it.", "en"), (9, LONG, "en"), (10, LONG + " end", "en"), (11, None, "en"), (12, "é", None),
    ]


WANT = {
    pipeline.identify: [4, 5, 6, 7, 8, 9, 10, 12],
    pipeline.exact: [2, 3, 5, 6, 7, 8, 9, 10, 11, 12],
    pipeline.near: [0, 1, 2, 3, 4, 7, 8, 9, 11, 12],
    pipeline.clean: [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12],
}


@pytest.mark.parametrize("stage", FILTERS, ids=lambda f: f.__name__)
def test_stage_odd_rows(spark, item, stage):
    got = stage(spark, docs(spark, odd(item)), SF)
    assert got.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert left(got) == WANT[stage]
    row = got.filter("doc_id = 7").first().asDict()
    assert (row["kept"], row["component_id"], row["lang_pred"], row["score"], row["keep_id"], row["n"]) == ("no", 7, "zz", 0.5, -1, 7)


@pytest.mark.parametrize("stage", FILTERS, ids=lambda f: f.__name__)
def test_stage_repeated_rows(spark, item, stage):
    """Rows that repeat an id are kept or dropped alike."""
    once = docs(spark, odd(item))
    assert left(stage(spark, once.union(once), SF)) == sorted(WANT[stage] * 2)


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES], ids=lambda f: f.__name__)
def test_stage_empty_table(spark, stage):
    assert stage(spark, docs(spark, [(0, "x", "en")]).limit(0), SF).collect() == []


def test_identify_without_labels(spark):
    assert left(pipeline.identify(spark, docs(spark, [(0, "some words here", None), (1, None, None)]), SF)) == []


def test_clean_without_items(spark, item, tmp_path):
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert left(pipeline.clean(spark, docs(spark, odd(item)), str(tmp_path))) == list(range(13))


def test_pieces_brute(spark, item):
    """Ids, their number and the decoded text as the model itself gives them, one row for each row."""
    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    rows = odd(item)
    got = pipeline.pieces(spark, docs(spark, rows + rows[3:5]), SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted([*range(13), 3, 4])
    texts = {i: t or "" for i, t, _ in rows}
    for r in got:
        ids = model.encode(texts[r["doc_id"]])
        assert r["n_pieces"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        assert r["decoded_crc32"] == zlib.crc32(model.decode(ids).encode())
        assert r["round_trip"] == (model.decode(ids) == texts[r["doc_id"]])


def test_stages_in_order():
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontaminate", "piece_lattice"]
