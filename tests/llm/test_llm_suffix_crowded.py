"""Anchors with more segments than a shard is to hold."""

from awkward_rows import long_text
from pyspark.sql import functions as F
from test_llm_suffix import brute, found

from vetline.llm import suffix


def test_copies_of_a_window_do_not_fill_a_shard(frame, monkeypatch):
    """One passage in all documents, each time in its own context."""
    monkeypatch.setattr(suffix, "CROWDED", 8)
    passage = long_text(7, 40)
    rows = [(i, f"{long_text(100 + i, 30)} {passage} {long_text(300 + i, 30)}", "en", "s", 1) for i in range(60)]
    docs = frame(rows).withColumn("doc", F.col("doc_id"))
    opened = suffix._judged(suffix._segment_rows(docs, 100)).where("key is not null")
    assert opened.groupBy("key").count().where("count > 8").count() > 0
    sizes = suffix._cut(docs, opened, 100).groupBy("shard").count().agg(F.max("count")).first()[0]
    assert (sizes or 0) <= 8
    assert found(frame(rows)) == brute(rows)
