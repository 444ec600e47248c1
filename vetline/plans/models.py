"""Registered queries: nearest neighbours, Local Outlier Factor, Isolation Forest."""

from pyspark.sql import functions as F

from vetline import schema
from vetline.operators import boosting, iforest, metrics, neighbours, profile, selection, tuning
from vetline.plans.evaluation import baseline_metrics, report_rows
from vetline.plans.postings import table
from vetline.plans.views import KEY, LABEL, clean, single, split_scored, sql
from vetline.runtime import fresh_path, settle

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


FEATURES = schema.FEATURES


def _split(spark, sf_dir):
    """Encoded training and validation rows; narrow, computed once."""
    rows = settle(split_scored(spark, sf_dir).select(KEY, LABEL, "split", *FEATURES))
    return rows.where("split = 'train'"), rows.where("split = 'val'")


# --- SQL twins: every pair of distinct vectors, for the small check tables --

_F = ", ".join(FEATURES)
_QF = ", ".join(f"q.{f}" for f in FEATURES)
_NF = ", ".join(f"n.{f} AS n_{f}" for f in FEATURES)
_D2 = " + ".join(f"(q.{f} - n.{f}) * (q.{f} - n.{f})" for f in FEATURES)
_Q_EQ = " AND ".join(f"a.{f} = b.{f}" for f in FEATURES)
_N_EQ = " AND ".join(f"a.n_{f} = b.{f}" for f in FEATURES)


def _vectors(where, source="split"):
    cells = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)
    return f"SELECT {_F}, count(*) AS weight FROM (SELECT {cells} FROM {source} WHERE {where}) GROUP BY {_F}"


def _pairs(queries, k, leave_self, fitted="v"):
    """Neighbour copies of each query, nearest first, until k are used."""
    w = "n.weight - CASE WHEN " + " AND ".join(f"q.{f} = n.{f}" for f in FEATURES) + " THEN 1 ELSE 0 END" \
        if leave_self else "n.weight"
    order = "d2, " + ", ".join(f"n_{f}" for f in FEATURES)
    wanted = f"greatest(1, least({k}, (SELECT sum(weight) FROM {fitted}) - 1))"
    return f"""SELECT *, least(w, {wanted} - before) AS take FROM (
        SELECT *, coalesce(sum(w) OVER (PARTITION BY {_F} ORDER BY {order}
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT {_QF}, {_NF}, {_D2} AS d2, sqrt({_D2}) AS d, {w} AS w FROM {queries} q, {fitted} n))
        WHERE least(w, {wanted} - before) > 0"""


def lof_ctes(k, tag="", train="split = 'train'", val="split = 'val'", source="split"):
    """v: fitted vectors, ft: their density and factor, sc: factors of new vectors."""
    v, t = f"v{tag}", tag
    mean = "sum(a.take * b.{c}) / sum(a.take)"

    def density(pairs):
        return f"""SELECT {', '.join(f'a.{f}' for f in FEATURES)},
            1.0 / (sum(a.take * greatest(b.kd, a.d)) / sum(a.take) + 1e-10) AS density
            FROM {pairs} a JOIN kd{t} b ON {_N_EQ} GROUP BY {', '.join(f'a.{f}' for f in FEATURES)}"""

    def factor(pairs, own):
        return f"""SELECT {', '.join(f'b.{f}' for f in FEATURES)}, -(a.m / b.density) AS factor FROM
            (SELECT {', '.join(f'a.{f}' for f in FEATURES)}, {mean.format(c='density')} AS m
             FROM {pairs} a JOIN dn{t} b ON {_N_EQ} GROUP BY {', '.join(f'a.{f}' for f in FEATURES)}) a
            JOIN {own} b ON {_Q_EQ}"""

    return {
        v: _vectors(train, source),
        f"fp{t}": _pairs(v, k, True, v),
        f"kd{t}": f"SELECT {_F}, max(d) AS kd FROM fp{t} GROUP BY {_F}",
        f"dn{t}": density(f"fp{t}"),
        f"ft{t}": f"SELECT a.*, b.weight FROM ({factor(f'fp{t}', f'dn{t}')}) a JOIN {v} b ON {_Q_EQ}",
        f"qv{t}": _vectors(val, source),
        f"qp{t}": _pairs(f"qv{t}", k, False, v),
        f"qd{t}": density(f"qp{t}"),
        f"sc{t}": factor(f"qp{t}", f"qd{t}"),
        # Row-level factors in single precision: fitted rows, and labelled new rows.
        f"fr{t}": f"SELECT {single('factor')} AS factor FROM ft{t}, range(CAST(weight AS BIGINT))",
        f"qr{t}": f"""SELECT a.*, {single('b.factor')} AS factor
            FROM (SELECT * FROM {source} WHERE {val}) a JOIN sc{t} b ON {_Q_EQ}""",
    }


_CELLS = """count(*) FILTER (fraudulent = 0 AND p = 0) AS tn, count(*) FILTER (fraudulent = 0 AND p = 1) AS fp,
    count(*) FILTER (fraudulent = 1 AND p = 0) AS fn, count(*) FILTER (fraudulent = 1 AND p = 1) AS tp"""


def _ratio(a, b, digits):
    r = f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"
    return f"round_even({r}, {digits})" if digits else r


def _metrics(c, tag="", digits=4):
    return f"""SELECT {_ratio('2 * tp', '2 * tp + fp + fn', digits)} AS f1, {_ratio('tp', 'tp + fp', digits)} AS precision,
        {_ratio('tp', 'tp + fn', digits)} AS recall, tp + fp AS flagged FROM (SELECT {_CELLS} FROM (SELECT *,
        CASE WHEN factor < (SELECT quantile_cont(factor, {c}) FROM fr{tag}) THEN 1 ELSE 0 END AS p FROM qr{tag}))"""


# --- SQL twin of the forest -----------------------------------------------

_TREES, _SAMPLE, _SEED = 100, 256, 42
_PATH = """CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0
    ELSE 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} END"""


def _fraction(what):
    digest = f"md5('{_SEED}:' || tree || ':' || node || ':{what}')"
    return f"(CAST('0x' || substr({digest}, 1, 13) AS UBIGINT) / CAST(4503599627370496 AS DOUBLE))"


def forest_ctes(tag="", train="split = 'train'", val="split = 'val'", source="split", val_source=None):
    """Trees grown row by row from the same digests; scores of distinct vectors; of rows.

    sm: samples, gr: sampled rows at every node, nd: nodes, fw: walks of all vectors, fs: raw
    score per vector, fr and qr: one row per fitted and per labelled new row, as for LOF.
    """
    t, i = tag, range(len(FEATURES))
    size = f"(SELECT least({_SAMPLE}, count(*)) FROM ft_{t})"
    limits = ", ".join(f"min(f{k}) OVER w AS lo{k}, max(f{k}) OVER w AS hi{k}" for k in i)
    varying = ", ".join(f"CASE WHEN lo{k} < hi{k} THEN {k} END" for k in i)
    pick = lambda name: "CASE feature " + " ".join(f"WHEN {k} THEN {name}{k}" for k in i) + " END"
    split = f"""SELECT *, CASE WHEN raw >= hi THEN lo ELSE raw END AS cut FROM (
        SELECT *, lo + {_fraction('c')} * (hi - lo) AS raw FROM (
        SELECT *, {pick('lo')} AS lo, {pick('hi')} AS hi FROM (
        SELECT *, CASE WHEN depth < ceil(log2(greatest({size}, 2))) AND n > 1
            THEN can[CAST(floor({_fraction('s')} * len(can)) AS INTEGER) + 1] END AS feature FROM (
        SELECT *, [x FOR x IN [{varying}] IF x IS NOT NULL] AS can FROM (
        SELECT *, count(*) OVER w AS n, {limits} FROM {{rows}} WINDOW w AS (PARTITION BY tree, node))))))"""
    fs = ", ".join(f"f{k}" for k in i)
    named = ", ".join(f"CAST({f} AS DOUBLE) AS f{k}" for k, f in enumerate(FEATURES))
    path = _PATH.format(n="n")
    scale = _PATH.format(n=size)
    equal = " AND ".join(f"a.f{k} = b.f{k}" for k in i)
    return {
        f"ft_{t}": f"SELECT {KEY}, {LABEL}, {named} FROM {source} WHERE {train}",
        f"fq_{t}": f"SELECT {KEY}, {LABEL}, {named}, {_F} FROM {val_source or source} WHERE {val}",
        f"pl_{t}": f"SELECT * FROM ft_{t} QUALIFY row_number() OVER (ORDER BY md5('{_SEED}:' || {KEY}), {KEY}) <= {_TREES} * {_SAMPLE}",
        f"sm_{t}": f"""SELECT tree, 1 AS node, 0 AS depth, {fs} FROM (SELECT *, row_number() OVER (PARTITION BY tree
            ORDER BY md5('{_SEED}:' || tree || ':' || {KEY}), {KEY}) AS place
            FROM pl_{t}, (SELECT CAST(range AS INTEGER) AS tree FROM range({_TREES}))) WHERE place <= {size}""",
        f"gr_{t}": f"""SELECT * FROM sm_{t} UNION ALL
            SELECT tree, 2 * node + CASE WHEN {pick('f')} > cut THEN 1 ELSE 0 END, depth + 1, {fs}
            FROM ({split.format(rows=f'gr_{t}')}) WHERE feature IS NOT NULL""",
        f"nd_{t}": f"""SELECT DISTINCT tree, node, feature, cut, depth + {path} AS path
            FROM ({split.format(rows=f'gr_{t}')})""",
        f"fv_{t}": f"SELECT {fs} FROM ft_{t} UNION SELECT {fs} FROM fq_{t}",
        f"fw_{t}": f"""SELECT {fs}, tree, 1 AS node FROM fv_{t}, (SELECT CAST(range AS INTEGER) AS tree FROM range({_TREES}))
            UNION ALL SELECT {', '.join(f'w.f{k}' for k in i)}, w.tree,
            2 * w.node + CASE WHEN {pick('w.f')} > d.cut THEN 1 ELSE 0 END
            FROM fw_{t} w JOIN nd_{t} d ON w.tree = d.tree AND w.node = d.node WHERE d.feature IS NOT NULL""",
        f"fs_{t}": f"""SELECT {fs}, round(-power(2.0, -avg(path) / ({scale})), 12) AS raw FROM fw_{t} w
            JOIN nd_{t} d ON w.tree = d.tree AND w.node = d.node WHERE d.feature IS NULL GROUP BY {fs}""",
        f"fr{t}": f"SELECT b.raw AS factor FROM ft_{t} a JOIN fs_{t} b ON {equal}",
        f"qr{t}": f"SELECT a.*, b.raw AS factor FROM fq_{t} a JOIN fs_{t} b ON {equal}",
    }


def forest_sql(body, before=None, **source):
    """Like ``sql`` up to the split rows, with the forest in front of the body."""
    return sql(body, "split", (before or {}) | forest_ctes(**source)).replace("WITH ", "WITH RECURSIVE ", 1)


def offset_sql(c, tag=""):
    return f"(SELECT quantile_cont(factor, {c}) FROM fr{tag})"


# --- queries --------------------------------------------------------------


@query("knn_join", sql(
    f"""SELECT * FROM (SELECT {_QF}, CAST(row_number() OVER (PARTITION BY {_QF} ORDER BY {_D2},
        {', '.join(f'n.{f}' for f in FEATURES)}) AS INTEGER) AS rank, {_NF}, {_D2} AS d2, n.weight AS weight
        FROM qv q, v n) WHERE rank <= 5""", "split",
    {"v": _vectors("split = 'train'"), "qv": _vectors("split = 'val'")}))
def knn_join(spark, sf_dir):
    train, val = _split(spark, sf_dir)
    fitted = settle(neighbours.distinct_vectors(train, FEATURES))
    near = neighbours.nearest_vectors(neighbours.distinct_vectors(val, FEATURES), fitted, FEATURES, 5)
    rows = near.select(*FEATURES, F.posexplode("near").alias("_pos", "e"))
    return rows.select(*FEATURES, (F.col("_pos") + 1).alias("rank"), *[
        F.col(f"e.n_{f}").alias(f"n_{f}") for f in FEATURES], F.col("e.d2").alias("d2"),
        F.col("e.w").alias("weight"))


@query("lof_fit", sql(
    f"SELECT CAST(20 AS INTEGER) AS k, {_F}, weight, {single('factor')} AS factor FROM ft", "split", lof_ctes(20)))
def lof_fit(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    table = neighbours.fit_lof(train, FEATURES, [20]).table
    return table.select("k", *FEATURES, "weight", "factor")


@query("lof_scores", sql(
    """SELECT job_id, factor AS lof_factor, CASE WHEN factor < (SELECT quantile_cont(factor, 0.05) FROM fr)
       THEN -1 ELSE 1 END AS lof_anomaly FROM qr""", "split", lof_ctes(20)))
def lof_scores(spark, sf_dir):
    train, val = _split(spark, sf_dir)
    model = neighbours.fit_lof(train, FEATURES, [20])
    return neighbours.score_lof(val, model, 20, 0.05).select(KEY, "lof_factor", "lof_anomaly")


@query("lof_contamination_sweep", sql(" UNION ALL ".join(
    f"SELECT CAST({c} AS DOUBLE) AS contamination, * FROM ({_metrics(c)})" for c in schema.CONTAMINATIONS),
    "split", lof_ctes(20)))
def lof_contamination_sweep(spark, sf_dir):
    train, val = _split(spark, sf_dir)
    model = neighbours.fit_lof(train, FEATURES, [20])
    return neighbours.sweep_lof_contamination(model, val, LABEL, schema.CONTAMINATIONS, 20)


_K_CTES = {}
for _k in schema.NEIGHBOUR_COUNTS:
    _K_CTES |= lof_ctes(_k, f"_{_k}")


@query("lof_k_sweep", sql(" UNION ALL ".join(
    f"""SELECT CAST({k} AS INTEGER) AS n_neighbors, CAST(0.1 AS DOUBLE) AS contamination, *
        FROM ({_metrics(0.1, f'_{k}')})""" for k in schema.NEIGHBOUR_COUNTS), "split", _K_CTES))
def lof_k_sweep(spark, sf_dir):
    train, val = _split(spark, sf_dir)
    model = neighbours.fit_lof(train, FEATURES, schema.NEIGHBOUR_COUNTS)
    return neighbours.sweep_lof_neighbours(model, val, LABEL, 0.1)


_FOLDS = " + ".join(f"(fr >= floor(fn * CAST({b} AS DOUBLE) + 0.5))::INT" for b in (0.2, 0.4, 0.6, 0.8))
_FOLD_CTES = {
    "tr": f"""SELECT {KEY}, {LABEL}, {_F}, row_number() OVER (PARTITION BY {LABEL} ORDER BY h) - 1 AS fr,
        count(*) OVER (PARTITION BY {LABEL}) AS fn FROM split WHERE split = 'train'""",
    "fo": f"SELECT *, {_FOLDS} AS fold FROM tr",
}
for _i in range(5):
    _FOLD_CTES |= lof_ctes(20, f"_{_i}", f"fold <> {_i}", f"fold = {_i}", "fo")


@query("lof_cv", sql(" UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS fold, f1, precision, recall FROM ({_metrics(0.1, f'_{i}', 0)})"
    for i in range(5)), "split", _FOLD_CTES))
def lof_cv(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    return neighbours.cross_validate_lof(train, KEY, LABEL, 20, 0.1)


@query("iforest_scores", forest_sql(
    f"""SELECT {KEY}, {LABEL}, {_F}, factor - {offset_sql(0.05)} AS anomaly_score,
        CAST(CASE WHEN factor < {offset_sql(0.05)} THEN -1 ELSE 1 END AS INTEGER) AS anomaly_label FROM qr"""))
def iforest_scores(spark, sf_dir):
    train, val = _split(spark, sf_dir)
    model = iforest.fit_forest(train, KEY, FEATURES, contamination=0.05)
    return iforest.score_outliers(val.select(KEY, LABEL, *FEATURES), model)


@query("iforest_fraud_convention", forest_sql(
    f"""SELECT {KEY}, {LABEL}, {_F}, -(factor - {offset_sql(0.1)}) AS anomaly_score,
        CAST(CASE WHEN factor < {offset_sql(0.1)} THEN 1 ELSE 0 END AS INTEGER) AS anomaly_label FROM qr"""))
def iforest_fraud_convention(spark, sf_dir):
    train, val = _split(spark, sf_dir)
    model = iforest.fit_forest(train, KEY, FEATURES, contamination=0.1)
    path = fresh_path(spark, "forest")
    iforest.save_forest(spark, model, path)
    return iforest.score_outliers(
        val.select(KEY, LABEL, *FEATURES), iforest.load_forest(spark, path), "fraud")


@query("neutral_scores", sql(
    "SELECT job_id, CAST(0.0 AS DOUBLE) AS anomaly_score, CAST(1 AS INTEGER) AS anomaly_label FROM split "
    "WHERE split = 'val'", "split"))
def neutral_scores(spark, sf_dir):
    _, val = _split(spark, sf_dir)
    missing = iforest.load_forest(spark, fresh_path(spark, "no-forest"))
    return iforest.score_outliers(val.select(KEY), missing)


_FLAGS = ["telecommuting", "has_company_logo", "has_questions"]
_TEXTS = [c for c in schema.METADATA_COLUMNS if c not in _FLAGS]


def one_hot_ctes(source="clean"):
    """The forest over flags and one-hot categories, grown on all rows of ``source``.

    A split is a struct (f, v): column number, and for a category its value. A column with
    at least two values in a node offers each of them but its alphabetically first overall.
    """
    flags, texts = range(len(_FLAGS)), range(len(_TEXTS))
    cells = [f"CAST({c} AS DOUBLE) AS f{k}" for k, c in enumerate(_FLAGS)]
    cells += [f"coalesce({c}, '{schema.MISSING_CATEGORY}') AS c{k}" for k, c in enumerate(_TEXTS)]
    names = ", ".join([f"f{k}" for k in flags] + [f"c{k}" for k in texts])
    size = f"(SELECT least({_SAMPLE}, count(*)) FROM mt)"
    windows = ", ".join(
        [f"min(f{k}) OVER w AS lo{k}, max(f{k}) OVER w AS hi{k}" for k in flags]
        + [f"list(c{k}) OVER w AS all{k}" for k in texts])
    numbers = ", ".join(f"CASE WHEN lo{k} < hi{k} THEN {{'f': {k}, 'v': CAST(NULL AS VARCHAR)}} END" for k in flags)
    lists = [f"[x FOR x IN [{numbers}] IF x IS NOT NULL]"] + [
        f"""[{{'f': {len(_FLAGS) + k}, 'v': x}} FOR x IN list_sort(list_distinct(all{k}))
            IF x <> b{k} AND len(list_distinct(all{k})) > 1]""" for k in texts]
    can = lists[0]
    for more in lists[1:]:
        can = f"list_concat({can}, {more})"
    pick = lambda name: "CASE pick.f " + " ".join(f"WHEN {k} THEN {name}{k}" for k in flags) + " END"
    split = f"""SELECT *, CASE WHEN raw >= hi THEN lo ELSE raw END AS cut FROM (
        SELECT *, lo + {_fraction('c')} * (hi - lo) AS raw FROM (
        SELECT *, {pick('lo')} AS lo, {pick('hi')} AS hi FROM (
        SELECT *, CASE WHEN depth < ceil(log2(greatest({size}, 2))) AND n > 1
            THEN can[CAST(floor({_fraction('s')} * len(can)) AS INTEGER) + 1] END AS pick FROM (
        SELECT * EXCLUDE ({', '.join(f'all{k}, b{k}' for k in texts)}), {can} AS can FROM (
        SELECT *, count(*) OVER w AS n, {windows} FROM mg, mb WINDOW w AS (PARTITION BY tree, node))))))"""
    right = "CASE pick.f " + " ".join(
        [f"WHEN {k} THEN f{k} > cut" for k in flags] + [f"WHEN {len(_FLAGS) + k} THEN c{k} = pick.v" for k in texts]) + " END"
    equal = " AND ".join(f"a.{c} = b.{c}" for c in names.split(", "))
    trees = f"(SELECT CAST(range AS INTEGER) AS tree FROM range({_TREES}))"
    return {
        "mt": f"SELECT {KEY}, {LABEL}, {', '.join(cells)} FROM {source}",
        "mb": f"SELECT {', '.join(f'min(c{k}) AS b{k}' for k in texts)} FROM mt",
        "ms": f"""SELECT tree, 1 AS node, 0 AS depth, {names} FROM (SELECT *, row_number() OVER (PARTITION BY tree
            ORDER BY md5('{_SEED}:' || tree || ':' || {KEY}), {KEY}) AS place FROM mt, {trees}) WHERE place <= {size}""",
        "mg": f"""SELECT * FROM ms UNION ALL SELECT tree, 2 * node + CASE WHEN {right} THEN 1 ELSE 0 END, depth + 1, {names}
            FROM ({split}) WHERE pick IS NOT NULL""",
        "mn": f"SELECT DISTINCT tree, node, pick, cut, depth + {_PATH.format(n='n')} AS path FROM ({split})",
        "mv": f"SELECT DISTINCT {names} FROM mt",
        "mw": f"""SELECT {names}, tree, 1 AS node FROM mv, {trees} UNION ALL
            SELECT {names}, tree, 2 * node + CASE WHEN {right} THEN 1 ELSE 0 END FROM (
            SELECT w.*, d.pick, d.cut FROM mw w JOIN mn d ON w.tree = d.tree AND w.node = d.node WHERE d.pick IS NOT NULL)""",
        "mx": f"""SELECT {names}, round(-power(2.0, -avg(path) / ({_PATH.format(n=size)})), 12) AS raw FROM mw w
            JOIN mn d ON w.tree = d.tree AND w.node = d.node WHERE d.pick IS NULL GROUP BY {names}""",
        "fr": f"SELECT a.{LABEL}, b.raw AS factor FROM mt a JOIN mx b ON {equal}",
    }


@query("iforest_one_hot_crosstab", sql(
    f"""SELECT CAST(CASE WHEN factor < {offset_sql(0.05)} THEN -1 ELSE 1 END AS INTEGER) AS anomaly_label,
        count(*) FILTER (fraudulent = 0) AS fraudulent_0, count(*) FILTER (fraudulent = 1) AS fraudulent_1
        FROM fr GROUP BY 1""", "clean", one_hot_ctes()).replace("WITH ", "WITH RECURSIVE ", 1))
def iforest_one_hot_crosstab(spark, sf_dir):
    rows = settle(clean(spark, sf_dir).select(KEY, LABEL, *schema.METADATA_COLUMNS))
    model = iforest.fit_forest(rows, KEY, _FLAGS, _TEXTS, contamination=0.05)
    return profile.crosstab(iforest.score_outliers(rows, model), "anomaly_label", LABEL, [0, 1])


@query("iforest_sweep", forest_sql(" UNION ALL ".join(
    f"SELECT CAST({c} AS DOUBLE) AS contamination, * FROM ({_metrics(c)})" for c in schema.CONTAMINATIONS)))
def iforest_sweep(spark, sf_dir):
    train, val = _split(spark, sf_dir)
    return selection.sweep_forest(train, val, KEY, LABEL, schema.CONTAMINATIONS)[0]


_FOREST_FOLDS = dict(list(_FOLD_CTES.items())[:2])
for _i in range(5):
    _FOREST_FOLDS |= forest_ctes(f"_{_i}", f"fold <> {_i}", f"fold = {_i}", "fo")


@query("iforest_cv", sql(" UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS fold, f1, precision, recall FROM ({_metrics(0.1, f'_{i}', 0)})"
    for i in range(5)), "split", _FOREST_FOLDS).replace("WITH ", "WITH RECURSIVE ", 1))
def iforest_cv(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    return iforest.cross_validate_forest(train, KEY, LABEL, numeric=FEATURES, contamination=0.1)


_BOTH = forest_ctes("_f") | lof_ctes(20)


def _recursive(body, ctes):
    return sql(body, "split", ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("model_comparison", _recursive(" UNION ALL ".join(
    f"""SELECT CAST({c} AS DOUBLE) AS contamination, {', '.join(f'{m}.{x} AS {n}_{x}' for m, n in (('a', 'IF'), ('b', 'LOF'))
    for x in ('f1', 'precision', 'recall', 'flagged'))} FROM ({_metrics(c, '_f')}) a, ({_metrics(c)}) b"""
    for c in schema.CONTAMINATIONS), _BOTH))
def model_comparison(spark, sf_dir):
    """Both real models swept and set side by side."""
    train, val = _split(spark, sf_dir)
    forest, _ = selection.sweep_forest(train, val, KEY, LABEL, schema.CONTAMINATIONS)
    model = neighbours.fit_lof(train, FEATURES, [20])
    lof = neighbours.sweep_lof_contamination(model, val, LABEL, schema.CONTAMINATIONS, 20)
    return tuning.compare_sweeps(forest, lof)


# --- the two fitted models on the validation rows --------------------------

DEFAULT_CONTAMINATION = 0.05
_PREDICTED = {
    "pred": f"""SELECT 'IF' AS model, {LABEL}, -factor AS suspicion, CASE WHEN factor < {offset_sql(DEFAULT_CONTAMINATION, '_f')}
        THEN 1 ELSE 0 END AS p FROM qr_f UNION ALL SELECT 'LOF', {LABEL}, -factor,
        CASE WHEN factor < {offset_sql(DEFAULT_CONTAMINATION)} THEN 1 ELSE 0 END FROM qr""",
    "cells": f"SELECT model, {_CELLS} FROM pred GROUP BY model",
}


def _predicted(spark, sf_dir):
    """Rows (model, label, suspicion, p): both models at the default contamination."""
    train, val = _split(spark, sf_dir)
    forest = iforest.fit_forest(train, KEY, FEATURES, contamination=DEFAULT_CONTAMINATION)
    lof = neighbours.fit_lof(train, FEATURES, [20])
    a = iforest.score_vectors(val.select(KEY, LABEL, *FEATURES), forest, [KEY, LABEL])
    b = neighbours.score_lof(val, lof, 20, DEFAULT_CONTAMINATION)
    return settle(a.select(
        F.lit("IF").alias("model"), LABEL, (-F.col("score")).alias("suspicion"),
        (F.col("score") < forest.offset).cast("int").alias("p"),
    ).union(b.select(F.lit("LOF"), LABEL, -F.col("lof_factor"), (F.col("lof_anomaly") == -1).cast("int"))))


@query("models_report", _recursive(" UNION ALL ".join(
    f"SELECT '{m}' AS model, r.* FROM ({report_rows(f'(SELECT * FROM cells WHERE model = {chr(39)}{m}{chr(39)})')}) r"
    for m in ("IF", "LOF")), _BOTH | _PREDICTED))
def models_report(spark, sf_dir):
    rows = _predicted(spark, sf_dir)
    reports = [
        metrics.class_report(rows.where(F.col("model") == m), LABEL, "p").withColumn("model", F.lit(m))
        for m in ("IF", "LOF")
    ]
    both = reports[0].union(reports[1])
    return both.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("models_confusion", _recursive(
    f"SELECT *, fp AS false_alarms, fn AS missed, {baseline_metrics()} FROM cells", _BOTH | _PREDICTED))
def models_confusion(spark, sf_dir):
    """Confusion cells, the trade-off and the baseline metrics of both models."""
    cells = metrics.confusion(_predicted(spark, sf_dir), LABEL, "p", ["model"])
    scored = metrics.precision_recall_f1(cells).drop("flagged")
    return scored.withColumns({"false_alarms": F.col("fp"), "missed": F.col("fn")})


@query("models_roc_auc", _recursive(
    """SELECT model, round(sum(neg * (cp - pos + pos / 2)) / (max(p) * max(n)), 6) AS auc,
    CAST(max(p) AS BIGINT) AS positives, CAST(max(n) AS BIGINT) AS negatives FROM (
    SELECT model, pos, neg, sum(pos) OVER w AS cp, sum(pos) OVER a AS p, sum(neg) OVER a AS n FROM (
    SELECT model, suspicion, count(*) FILTER (fraudulent = 1) AS pos, count(*) FILTER (fraudulent = 0) AS neg
    FROM pred GROUP BY model, suspicion)
    WINDOW w AS (PARTITION BY model ORDER BY suspicion DESC), a AS (PARTITION BY model)) GROUP BY model""",
    _BOTH | _PREDICTED))
def models_roc_auc(spark, sf_dir):
    rows = _predicted(spark, sf_dir)
    both = [
        metrics.roc_auc(rows.where(F.col("model") == m), "suspicion", LABEL).withColumn("model", F.lit(m))
        for m in ("IF", "LOF")
    ]
    return both[0].union(both[1]).withColumn("auc", F.round("auc", 6))


def _cv_sql(ctes):
    folds = " UNION ALL ".join(f"SELECT * FROM ({_metrics(0.1, f'_{i}', 0)})" for i in range(5))
    return _recursive(" UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std FROM folds"
        for m in tuning.METRICS), ctes | {"folds": folds})


def _cv_summary(folds):
    summary = metrics.cross_validation_summary(folds)
    return summary.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("iforest_cv_summary", _cv_sql(_FOREST_FOLDS))
def iforest_cv_summary(spark, sf_dir):
    return _cv_summary(iforest_cv(spark, sf_dir))


@query("lof_cv_summary", _cv_sql(_FOLD_CTES))
def lof_cv_summary(spark, sf_dir):
    return _cv_summary(lof_cv(spark, sf_dir))


# --- the same searches over tables with many distinct vectors ----------------

_PRICE = ["o_totalprice", "o_custkey"]


def _with(body, ctes):
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes.items()) + f"\n{body}"


@query("knn_orders", _with(
    """SELECT * FROM (SELECT q.o_totalprice, q.o_custkey, CAST(row_number() OVER (PARTITION BY q.o_totalprice, q.o_custkey
        ORDER BY d2, n_o_totalprice, n_o_custkey) AS INTEGER) AS rank, n_o_totalprice, n_o_custkey, d2, weight FROM (
        SELECT q.*, n.o_totalprice AS n_o_totalprice, n.o_custkey AS n_o_custkey, n.weight,
        (q.o_totalprice - n.o_totalprice) * (q.o_totalprice - n.o_totalprice)
        + (q.o_custkey - n.o_custkey) * (q.o_custkey - n.o_custkey) AS d2 FROM qv q, v n) q) WHERE rank <= 5""", {
        "o": "SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders",
        "v": "SELECT o_totalprice, o_custkey, count(*) AS weight FROM o GROUP BY o_totalprice, o_custkey",
        "qv": "SELECT DISTINCT o_totalprice, o_custkey FROM o WHERE o_orderkey % 50 = 0"}))
def knn_orders(spark, sf_dir):
    """The five nearest orders by price and customer, for every order whose key 50 divides."""
    orders = table(spark, sf_dir, "orders")
    fitted = settle(neighbours.distinct_vectors(orders, _PRICE))
    asked = neighbours.distinct_vectors(orders.where("o_orderkey % 50 = 0"), _PRICE).select(*_PRICE)
    near = neighbours.nearest_vectors(asked, fitted, _PRICE, 5)
    rows = near.select(*_PRICE, F.posexplode("near").alias("_pos", "e"))
    return rows.select(*_PRICE, (F.col("_pos") + 1).alias("rank"), *[
        F.col(f"e.n_{f}").alias(f"n_{f}") for f in _PRICE], F.col("e.d2").alias("d2"), F.col("e.w").alias("weight"))


_CUSTOMERS = ["c_acctbal", "c_nationkey", "0", "0"]  # in place of the four features


@query("lof_customers", _with(
    f"SELECT CAST(20 AS INTEGER) AS k, {_F}, weight, {single('factor')} AS factor FROM ft", {
        "cust": "SELECT " + ", ".join(f"{c} AS {f}" for c, f in zip(_CUSTOMERS, FEATURES)) + " FROM customer",
        **dict(list(lof_ctes(20, train="true", source="cust").items())[:5])}))
def lof_customers(spark, sf_dir):
    """Factors of all customers by balance and nation."""
    rows = table(spark, sf_dir, "customer").selectExpr(
        *[f"{c} AS {f}" for c, f in zip(_CUSTOMERS, FEATURES)])
    return neighbours.fit_lof(rows, FEATURES, [20]).table.select("k", *FEATURES, "weight", "factor")


# --- the winner -----------------------------------------------------------

_WINNER_KS = sorted({*schema.NEIGHBOUR_COUNTS, 20})
_WINNER = forest_ctes("_f")
for _k in _WINNER_KS:
    _WINNER |= lof_ctes(_k, f"_{_k}")
_WINNER |= {
    "fsweep": " UNION ALL ".join(
        f"SELECT CAST({c} AS DOUBLE) AS c, * FROM ({_metrics(c, '_f')})" for c in schema.CONTAMINATIONS),
    "lsweep": " UNION ALL ".join(
        f"SELECT {k} AS k, CAST({c} AS DOUBLE) AS c, * FROM ({_metrics(c, f'_{k}')})"
        for k in _WINNER_KS for c in schema.CONTAMINATIONS),
    "fbest": "SELECT * FROM fsweep ORDER BY f1 DESC, c LIMIT 1",
    "lc": "SELECT c FROM lsweep WHERE k = 20 ORDER BY f1 DESC, c LIMIT 1",
    "lbest": "SELECT * FROM lsweep WHERE c = (SELECT c FROM lc) ORDER BY f1 DESC, k LIMIT 1",
    "choice": """SELECT CASE WHEN abs(a.f1 - b.f1) < 0.005 THEN a.recall >= b.recall ELSE a.f1 > b.f1 END AS forest,
        a.c AS fc, b.c AS lc, b.k AS k FROM fbest a, lbest b""",
}


def _winner_rows(tag, c, where):
    return f"""SELECT {KEY}, {LABEL}, {_F}, -(factor - {offset_sql(c, tag)}) AS outlier_score,
        CAST(CASE WHEN factor < {offset_sql(c, tag)} THEN 1 ELSE 0 END AS INTEGER) AS outlier_predict
        FROM qr{tag}, choice WHERE {where}"""


@query("winner_scores", _recursive(" UNION ALL ".join(
    [_winner_rows("_f", c, f"forest AND fc = {c}") for c in schema.CONTAMINATIONS]
    + [_winner_rows(f"_{k}", c, f"NOT forest AND k = {k} AND lc = {c}")
       for k in _WINNER_KS for c in schema.CONTAMINATIONS]), _WINNER))
def winner_scores(spark, sf_dir):
    """Select, set up and store the winner, read it back and score the validation rows with it."""
    train, val = _split(spark, sf_dir)
    chosen = selection.select_model(train, val, KEY, LABEL)
    path = fresh_path(spark, "winner")
    selection.save_winner(spark, chosen.winner, path)
    return selection.score_with_winner(val.select(KEY, LABEL, *FEATURES), selection.load_winner(spark, path))


# --- boosted trees --------------------------------------------------------

_ROUNDS, _DEPTH, _BINS, _RATE, _STEP = 10, 3, 32, 0.5, float(1 << 30)
_BOOSTED = [*FEATURES, "score_a", "score_b"]


def boosted_ctes(features, train, label, source, key=KEY):
    """Trees grown step by step from the rows' gradients, and all coalitions of features.

    bn: bins, bs: every row after each step (a level of a tree, or its leaves), tn and tl: splits
    and leaves, cm: margin of each coalition, sh: margin and attributions per row of ``source``
    for which ``train`` does not hold.
    """
    i = range(len(features))
    probs = ", ".join(f"{j / _BINS!r}::DOUBLE" for j in range(1, _BINS))
    bins = lambda x: ", ".join(
        f"len([c FOR c IN c{k} IF c < {x.format(f=f, k=k)}])::INTEGER AS b{k}" for k, f in enumerate(features))
    bs, level = ", ".join(f"b{k}" for k in i), f"(step % {_DEPTH + 1})"
    pick = lambda name, j: f"CASE {j} " + " ".join(f"WHEN {k} THEN {name}{k}" for k in i) + " END"
    lam = f"{_STEP!r}::DOUBLE"
    steps = _ROUNDS * (_DEPTH + 1)
    share = lambda k: " + ".join(
        f"{_shapley(len(features), k, m)!r}::DOUBLE * max(margin) FILTER (mask = {m})" for m in range(1 << len(features)))
    walk = "1"
    for d in range(_DEPTH):
        walk = f"""(SELECT 2 * w.node + coalesce((n.j >= 0 AND {pick('w.m', 'n.j')} > n.b)::INTEGER, 0) AS node, w.* EXCLUDE (node)
            FROM {walk} w LEFT JOIN tn n ON n.tree = w.tree AND n.node = w.node)""" if d else f"""(
            SELECT 2 + coalesce((n.j >= 0 AND {pick('w.m', 'n.j')} > n.b)::INTEGER, 0) AS node, w.*
            FROM (SELECT * FROM mx, (SELECT range::INTEGER AS tree FROM range({_ROUNDS}))) w
            LEFT JOIN tn n ON n.tree = w.tree AND n.node = 1)"""
    return {
        "ct": "SELECT " + ", ".join(
            f"list_sort(list_distinct(quantile_cont(CAST({f} AS DOUBLE) + 0.0, [{probs}]))) AS c{k}"
            for k, f in enumerate(features)) + f" FROM {source} WHERE {train} AND {label} IS NOT NULL",
        "bn": f"SELECT {key} AS id, ({train} AND {label} IS NOT NULL) AS tr, CAST({label} AS DOUBLE) AS y, "
              + bins("CAST({f} AS DOUBLE)") + f" FROM {source}, ct",
        "bg": "SELECT " + bins("x{k}").replace(" AS b", " AS g") + " FROM ct, (SELECT " + ", ".join(
            f"avg(CAST({f} AS DOUBLE)) AS x{k}" for k, f in enumerate(features))
              + f" FROM {source} WHERE {train} AND {label} IS NOT NULL)",
        "bs": f"""SELECT id, tr, y, {bs}, 0.0::DOUBLE AS f, 1 AS node, 0 AS step, 1 AS own, -1 AS j, 0 AS b, 0.0::DOUBLE AS v FROM bn
            UNION ALL SELECT id, tr, y, {bs}, CASE WHEN {level} = {_DEPTH} THEN f + leaf ELSE f END,
            CASE WHEN {level} = {_DEPTH} THEN 1 WHEN best.gain > 0 THEN 2 * node + ({pick('b', 'best.j')} > best.b)::INTEGER
                ELSE 2 * node END, step + 1, node, CASE WHEN best.gain > 0 THEN best.j ELSE -1 END, best.b, leaf
            FROM (SELECT *, first_value({{'gain': gain, 'j': fi, 'b': own_b}}) OVER (PARTITION BY node ORDER BY gain DESC, fi, own_b) AS best,
                    {_RATE!r}::DOUBLE * (gt / (ht + {lam})) AS leaf
                FROM (SELECT *, gl * gl / (hl + {lam}) + (gt - gl) * (gt - gl) / (ht - hl + {lam}) - gt * gt / (ht + {lam}) AS gain
                FROM (SELECT *, CAST(sum(g) OVER (PARTITION BY node, fi ORDER BY own_b) AS DOUBLE) AS gl,
                    CAST(sum(h) OVER (PARTITION BY node, fi ORDER BY own_b) AS DOUBLE) AS hl,
                    CAST(sum(g) OVER (PARTITION BY node, fi) AS DOUBLE) AS gt, CAST(sum(h) OVER (PARTITION BY node, fi) AS DOUBLE) AS ht
                FROM (SELECT *, {pick('b', 'fi')} AS own_b,
                    CASE WHEN tr THEN CAST(round((y - p) * {_STEP!r}::DOUBLE) AS BIGINT) ELSE 0 END AS g,
                    CASE WHEN tr THEN CAST(round(p * (1.0 - p) * {_STEP!r}::DOUBLE) AS BIGINT) ELSE 0 END AS h
                FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-f)) AS p FROM bs WHERE step < {steps}),
                    (SELECT range::INTEGER AS fi FROM range({len(features)}))))))
            WHERE fi = 0""",
        "tn": f"""SELECT DISTINCT ((step - 1) // {_DEPTH + 1})::INTEGER AS tree, own AS node, j, b FROM bs
            WHERE step > 0 AND (step - 1) % {_DEPTH + 1} < {_DEPTH}""",
        "tl": f"""SELECT DISTINCT ((step - 1) // {_DEPTH + 1})::INTEGER AS tree, own AS node, v FROM bs
            WHERE step > 0 AND (step - 1) % {_DEPTH + 1} = {_DEPTH}""",
        "mx": "SELECT id, mask, " + ", ".join(f"CASE WHEN mask & {1 << k} <> 0 THEN b{k} ELSE g{k} END AS m{k}" for k in i)
              + f" FROM bn, bg, (SELECT range::INTEGER AS mask FROM range({1 << len(features)})) WHERE NOT tr",
        "cm": f"SELECT id, mask, sum(coalesce(l.v, 0)) AS margin FROM {walk} w LEFT JOIN tl l ON l.tree = w.tree AND l.node = w.node GROUP BY ALL",
        "sh": "SELECT id, max(margin) FILTER (mask = " + str((1 << len(features)) - 1) + ") AS margin, "
              + ", ".join(f"{share(k)} AS s{k}" for k in i) + " FROM cm GROUP BY id",
    }


def _shapley(n, feature, mask):
    """Weight of a coalition's value in the Shapley value of a feature."""
    from math import factorial
    size = mask.bit_count()
    if mask >> feature & 1:
        return factorial(size - 1) * factorial(n - size) / factorial(n)
    return -factorial(size) * factorial(n - size - 1) / factorial(n)


def shapley_columns(features, digits=6):
    return ", ".join(f"round(s{k}, {digits}) + 0.0 AS shap_{f}" for k, f in enumerate(features))


@query("boosted_scores", sql(
    f"SELECT id AS {KEY}, round(1.0 / (1.0 + exp(-margin)), 6) AS fraud_score, "
    f"CASE WHEN 1.0 / (1.0 + exp(-margin)) >= 0.5 THEN 'Fraudulent' ELSE 'Legitimate' END AS label, "
    f"{shapley_columns(_BOOSTED)} FROM sh WHERE id IN (SELECT {KEY} FROM split WHERE split = 'val')", "split",
    boosted_ctes(_BOOSTED, "split = 'train'", LABEL, "split")).replace("WITH ", "WITH RECURSIVE ", 1))
def boosted_scores(spark, sf_dir):
    """Boosted trees over features and scores that SQL knows: probability, label and attributions of validation rows."""
    rows = settle(split_scored(spark, sf_dir).select(KEY, LABEL, "split", *_BOOSTED))
    model = boosting.fit_boosted(rows.where("split = 'train'"), _BOOSTED, LABEL, _ROUNDS, _DEPTH, _BINS, _RATE)
    path = fresh_path(spark, "boosted")
    boosting.save_boosted(spark, model, path)
    scored = boosting.score_boosted(rows.where("split = 'val'"), boosting.load_boosted(spark, path))
    p = 1.0 / (1.0 + F.exp(-F.col("margin")))
    return scored.select(KEY, F.round(p, 6).alias("fraud_score"),
                         F.when(p >= 0.5, "Fraudulent").otherwise("Legitimate").alias("label"),
                         *[(F.round(F.get("shares", F.lit(k)), 6) + 0.0).alias(f"shap_{f}") for k, f in enumerate(_BOOSTED)])
