import pyarrow as pa

import corpus_pipeline
from vetline.llm import quality

DOCS = "doc_id long, text string"


class Captured:
    """Stands for a table; its mapInArrow hands out the function."""

    def __init__(self, df):
        self.schema, self.sparkSession = df.schema, df.sparkSession

    def select(self, *_):
        return self

    def mapInArrow(self, work, _):
        return work


def test_quality_workers_keep_no_words(spark, monkeypatch):
    docs = Captured(spark.createDataFrame([], DOCS))
    model = quality.Model(*[pa.array([0.0] * quality.BUCKETS).to_numpy()] * 2, 0.0, 1.0, 0.0)
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["some words here", "and more of them"])], ["doc_id", "text"])
    monkeypatch.setattr(quality, "learn", lambda *_: model)
    for work in (quality.score(docs, model), quality.keep_good(docs, None)):
        rows = 0
        for out in work(iter([batch])):
            rows += out.num_rows
            assert quality._codes
        assert rows in (0, 2) and not quality._codes


def test_last_stage_has_one_python_worker_a_task(spark):
    """Two in one stage would both stay with the executor while later stages run."""
    docs = spark.createDataFrame([(1, "one two  three\n"), (2, ""), (3, None), (4, "ü 漢")], DOCS)
    out = corpus_pipeline.token_ids(spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in out.collect()) and out.count() == 4
