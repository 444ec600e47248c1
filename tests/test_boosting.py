"""Boosted trees against rows taken one by one, attributions against all coalitions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetline.operators import boosting, fusion

FEATURES = ["a", "b", "c"]


def rows_of(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.round(rng.normal(size=n), 2), rng.integers(0, 2, n), np.round(rng.exponential(size=n), 1)])
    y = (x[:, 0] + 2 * x[:, 1] - x[:, 2] + rng.normal(size=n) * 0.3 > 0.5).astype(int)
    return x, y


def frame(spark, x, y):
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k int, a double, b double, c double, y int")


@pytest.fixture(scope="module")
def fitted(spark):
    x, y = rows_of()
    return x, y, boosting.fit_boosted(frame(spark, x, y), FEATURES, "y", rounds=4, depth=2, bins=8)


def brute_bins(x, cuts):
    return np.array([[sum(c < v for c in own) for v, own in zip(r, cuts)] for r in x])


def brute_trees(x, y, cuts, rounds, depth, rate=0.5, penalty=1.0):
    """Margins of the rows after each round, every split tried on the rows themselves."""
    bins, f, s = brute_bins(x, cuts), np.zeros(len(x)), boosting.SCALE
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = np.rint((y - p) * s), np.rint(p * (1 - p) * s)
        parts = [np.arange(len(x))]
        for _ in range(depth):
            new = []
            for members in parts:
                best = (0.0, None, None)
                for j in range(x.shape[1]):
                    for k in range(len(cuts[j])):
                        low = bins[members, j] <= k
                        value = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty * s)
                        gain = value(members[low]) + value(members[~low]) - value(members)
                        if gain > best[0] * (1 + 1e-12) + 1e-3:
                            best = (gain, j, k)
                low = np.ones(len(members), bool) if best[1] is None else bins[members, best[1]] <= best[2]
                new += [members[low], members[~low]]
            parts = new
        for members in parts:
            f[members] += rate * g[members].sum() / (h[members].sum() + penalty * s)
    return f


def test_cuts_are_exact_quantiles(fitted):
    x, _, model = fitted
    for j, cuts in enumerate(model.cuts):
        assert np.allclose(cuts, np.unique(np.percentile(x[:, j], [100 * i / 8 for i in range(1, 8)])))


def test_trees_equal_rows_taken_one_by_one(fitted):
    x, y, model = fitted
    bins = brute_bins(x, model.cuts)
    assert np.allclose(boosting.margins(model, bins), brute_trees(x, y, model.cuts, 4, 2), atol=1e-9)
    hit = (boosting.margins(model, bins) > 0) == (y == 1)
    assert hit.mean() > 0.85


def test_attributions_equal_all_coalitions(fitted):
    x, _, model = fitted
    bins = brute_bins(x[:40], model.cuts)
    got, n = boosting.attributions(model, bins), len(FEATURES)
    for row, shares in zip(bins, got):
        def value(chosen):
            mixed = [row[i] if i in chosen else model.background[i] for i in range(n)]
            return boosting.margins(model, np.array([mixed]))[0]

        for i in range(n):
            others = [j for j in range(n) if j != i]
            want = sum(
                factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (value({*s, i}) - value(set(s)))
                for size in range(n) for s in combinations(others, size))
            assert abs(shares[i] - want) < 1e-12
        assert abs(shares.sum() - value({0, 1, 2}) + boosting.base_margin(model)) < 1e-12


def test_order_and_copies_of_rows_do_not_matter(spark, fitted):
    x, y, model = fitted
    df = frame(spark, x, y)
    again = boosting.fit_boosted(df.orderBy(F.desc("c")).repartition(5), FEATURES, "y", rounds=4, depth=2, bins=8)
    assert (again.feature == model.feature).all() and (again.bin == model.bin).all() and (again.value == model.value).all()


def test_scores_keep_every_row(spark, fitted, tmp_path):
    """Repeated and null keys, nulls, a round trip; one row out for each row in."""
    x, _, model = fitted
    path = str(tmp_path / "m")
    assert boosting.load_boosted(spark, path) is None
    boosting.save_boosted(spark, model, path)
    stored = boosting.load_boosted(spark, path)
    df = spark.createDataFrame([(1, 0.5, 1.0, 0.2), (1, -2.0, 0.0, 3.0), (None, 0.5, 1.0, 0.2), (2, None, None, None)],
                               "k int, a double, b double, c double")
    got = boosting.score_boosted(df, stored).collect()
    assert [r.k for r in got] == [1, 1, None, 2] and got[0].margin == got[2].margin != got[1].margin
    want = boosting.margins(model, brute_bins([[-1e9] * 3], model.cuts))[0]
    assert got[3].margin == want


def test_one_label_and_constant_features(spark):
    df = spark.createDataFrame([(i, 1.0, 0.0, 2.0, 1) for i in range(20)], "k int, a double, b double, c double, y int")
    model = boosting.fit_boosted(df, FEATURES, "y", rounds=2)
    assert (model.feature == -1).all() and boosting.base_margin(model) > 0
    assert all(s == 0.0 for s in boosting.score_boosted(df, model).first().shares)


def test_fused_postings_that_share_a_key(spark):
    """Two postings with one key, and without any, keep their own scores and attributions."""
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.random(3)), *map(float, rng.integers(0, 2, 3)), int(rng.random() < 0.3)) for i in range(120)]
    names = ", ".join(f"{c} double" for c in fusion.META_FEATURES)
    meta = spark.createDataFrame(rows, f"k int, {names}, fraudulent int")
    model = fusion.fit_fusion(meta, rounds=2)
    new = spark.createDataFrame([(7, *r[1:7]) for r in rows[:2]] + [(None, *r[1:7]) for r in rows[2:4]], f"k int, {names}")
    got = fusion.score_fusion(new, model, "k").collect()
    assert [r.k for r in got] == [7, 7, None, None]
    for r in got:
        total = np.log(r.fraud_score / (1 - r.fraud_score)) - boosting.base_margin(model)
        assert abs(sum(r.shap_values.values()) - total) < 1e-9 and set(r.shap_values) == set(fusion.META_FEATURES)


def test_scorer_without_one_of_its_parts(spark, tmp_path):
    assert fusion.load_scorer(spark, str(tmp_path / "none")) is None
    folder = tmp_path / "half" / "version-x"
    folder.mkdir(parents=True)
    from vetline.runtime import publish
    publish(spark, str(tmp_path / "half"), str(folder))
    assert fusion.load_scorer(spark, str(tmp_path / "half")) is None
