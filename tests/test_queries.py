"""Every registered query against its SQL twin, and the plans behind them."""

import pytest

import __spark_entry__ as entry
from check import check, duck
from vetline import runtime
from vetline.operators import clean, encode, iforest, metrics, neighbours, ordered, profile, selection
from vetline.operators.clean import clean_postings
from vetline.plans import cleaning, evaluation, models, postings, profiling, services, views

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_registry():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["fraudulent", "rows", "mean_clean_desc_len"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name, monkeypatch):
    """Right rows, and no all-pairs join in any plan run on the way."""
    plans = []

    def spy(df):
        plans.append(plan_of(df))
        return runtime.settle(df)

    for module in (clean, encode, iforest, metrics, neighbours, ordered, profile, selection,
                   cleaning, evaluation, models, profiling, services, views):
        if hasattr(module, "settle"):
            monkeypatch.setattr(module, "settle", spy)

    def run(session, sf_dir):
        df = QUERIES[name](session, sf_dir)
        plans.append(plan_of(df))
        return df

    _, wrong = check(spark, con, name, run, ORACLES.get(name), SF)
    assert wrong is None
    for plan in plans:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_narrow_readers_do_not_shuffle_texts(spark):
    """Duplicate removal shuffles keys and digests, then only the asked-for columns; nothing sorts texts."""
    narrow = clean_postings(postings.raw_postings(spark, SF)).select("job_id", "salary_range")
    lines = plan_of(narrow).splitlines()
    below = [after for line, after in zip(lines, lines[1:]) if "Exchange hashpartitioning" in line and "labels" not in after]
    moved = [line for line in below if "HashAggregate" in line or "salary_range" in line]
    assert len(moved) == 2 and not any("description" in line for line in moved)
    assert not any("SortAggregate" in line for line in lines)
    aggregates = [line for line in lines if "Aggregate(" in line]
    assert aggregates and all("min(job_id" in line for line in aggregates)


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(profile.correlations(postings.table(spark, SF, "lineitem"), ["l_tax", "l_discount"]))
    assert "ReadSchema: struct<l_discount:double,l_tax:double>" in plan


def test_cleaning_compiles(spark, tmp_path):
    """The JVM compiles no method above 8,000 bytes of byte code."""
    postings.raw_postings(spark, SF).write.parquet(str(tmp_path / "raw"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = clean_postings(spark.read.parquet(str(tmp_path / "raw")))
        stages = encode.encode_features(rows, keep=["job_id"])._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000
