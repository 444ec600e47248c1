import pytest
from awkward_rows import clashing, long_text, rows_of

import corpus_pipeline
from vetline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with one case for each stage, as files."""
    folder = tmp_path_factory.mktemp("corpus")
    passage = long_text(91, 40)
    docs = [(i, f"{long_text(100 + i, 60)}\nfooter of all sites", "en", f"s{i % 12}", 1) for i in range(120)]
    docs += [(200 + i, long_text(100, 60) + f"\nchanged {i}", "en", "s1", 1) for i in range(3)]
    docs += [(300 + i, f"{long_text(400 + i, 40)} {passage} {long_text(500 + i, 40)}", "en", "s2", 1) for i in range(4)]
    docs += [(400 + i, " ".join(f"{w.upper()}!!" for w in long_text(600 + i, 40).split()), "en", "s3", 1) for i in range(40)]
    docs += [(500, None, None, None, None), (501, "", "en", "s", 0), (None, long_text(77, 30), "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(80)] + [(400 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_do_their_work(spark, tables, tmp_path):
    docs, kept = spark.read.parquet(f"{tables}/documents.parquet"), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns, name
        kept[i] = {r.doc_id: r for r in docs.collect()}
    assert not any(400 + i in kept[0] for i in range(40)) and all(i in kept[0] for i in range(120))
    assert sum("footer" in (r.text or "") for r in kept[1].values()) == 1 and len(kept[1]) == len(kept[0])
    assert 0 in kept[2] and not any(200 + i in kept[2] for i in range(3))
    assert all(300 + i in kept[2] and 300 + i not in kept[3] for i in range(4))
    assert all(r.n_pieces == len(r.ids) for r in kept[4].values()) and "text" not in docs.columns
    assert all(r.round_trip for r in kept[4].values())
    assert set(kept[4]) == set(kept[3])
    assert rows_of(corpus_pipeline.run(spark, tables)) == rows_of(docs)


def test_stages_call_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding",
    ]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_extra_columns(spark, tables):
    docs = clashing(spark.read.parquet(f"{tables}/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, tables).columns == docs.columns
        assert stage(spark, docs.limit(0), tables).count() == 0


@pytest.mark.parametrize("name", queries.QUERIES)
def test_registered_queries_run_whole_tables(spark, name):
    rows = queries.QUERIES[name](spark, SF).count()
    if name not in ("op1_decontamination", "op4_top_k", "op11_nearest", "op12_hard_negatives", "op13_divergence"):
        assert rows == spark.read.parquet(f"{SF}/documents.parquet").count()

