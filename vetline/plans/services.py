"""Registered queries: file round trip, pages, stream, text classifier, fusion."""

from pyspark.sql import functions as F

from vetline import schema
from vetline.functions import text
from vetline.operators import boosting, classifier, fusion, iforest, profile, sampling
from vetline.operators.clean import clean_postings
from vetline.operators.encode import encode_features
from vetline.plans import views
from vetline.operators.profile import stop_words
from vetline.plans.models import boosted_ctes, forest_ctes, forest_sql, offset_sql, shapley_columns
from vetline.plans.postings import postings_of, raw_postings, table, table_stream
from vetline.plans.views import CLEAN_COLUMNS, KEY, LABEL, clean, sql, strip
from vetline.runtime import fresh_path, settle, side_by_side, stored
from vetline.sources import files, pages
from vetline.streaming.scoring import landed_postings, score_postings, write_scored

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


@query("csv_round_trip", sql(
    f"SELECT CAST({KEY} AS VARCHAR) AS {KEY}, {', '.join(CLEAN_COLUMNS)} FROM single", "single"))
def csv_round_trip(spark, sf_dir):
    path = fresh_path(spark, "postings-csv")
    files.write_csv(raw_postings(spark, sf_dir), path)
    return clean_postings(files.read_csv(spark, path), dedupe=False)


def _plain(c):
    for p in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    for entity, char in pages.ENTITIES:
        c = f"replace({c}, '{entity}', {views.quoted([char])})"
    return strip(f"regexp_replace({c}, '{views.WS}+', ' ', 'g')")


def _element(tag):
    return rf"nullif(regexp_extract(html, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1), '')"


@query("pages_to_postings",
       f"""SELECT page_id AS job_id, {_plain(f"coalesce({_element('title')}, {_element('h1')})")} AS title,
           {_plain(f"coalesce({_element('article')}, {_element('body')}, html)")} AS description, """
       + ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in schema.RAW_COLUMNS if c not in ("title", "description"))
       + " FROM pages")
def pages_to_postings(spark, sf_dir):
    return pages.pages_to_postings(table(spark, sf_dir, "pages"))


#: Columns that the made-up pages state, with the label a page gives them and the embedded property.
_STATED = {
    "department": ("Department:", None), "employment_type": ("Job type", "employmentType"),
    "required_experience": ("Experience :", "experienceRequirements"),
    "required_education": ("EDUCATION", "educationRequirements"), "industry": ("Industry", "industry"),
    "function": ("Job function", "occupationalCategory"),
}


def _flat(c):
    return f"nullif({strip(f"regexp_replace({c}, '{views.WS}+', ' ', 'g')")}, '')"


_NUMBERS = r"regexp_extract_all(salary_range, '[0-9]+(?:\.[0-9]+)?')"
_AREA = [_flat(f"split_part(location, ',', {i})") for i in (1, 2, 3)]


@query("stated_fields", sql(
    f"""SELECT {KEY}, CASE WHEN {KEY} % 3 <> 0 THEN {_flat('location')}
            WHEN coalesce({', '.join(_AREA)}) IS NOT NULL THEN {" || ', ' || ".join(f"coalesce({a}, '')" for a in _AREA)} END AS location,
        CASE WHEN len({_NUMBERS}) = 2 THEN {_NUMBERS}[1] || '-' || {_NUMBERS}[2]
            WHEN {KEY} % 3 <> 0 THEN {_flat('salary_range')} END AS salary_range,
        CASE WHEN telecommuting IN ('t', ' T ') THEN 't' WHEN {KEY} % 3 <> 0 AND telecommuting = 'f' THEN 'f' END AS telecommuting,
        """ + ", ".join(f"CASE WHEN {KEY} % 3 <> 0 OR {prop is not None} THEN {_flat(c)} END AS {c}" for c, (_, prop) in _STATED.items())
    + " FROM raw", "raw"))
def stated_fields(spark, sf_dir):
    """Postings written as web pages (embedded posting, definition list or table, by key) and read back."""
    raw = raw_postings(spark, sf_dir)

    def escaped(c):
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(char), F.lit(entity))
        return c

    pairs = {c: label for c, (label, _) in _STATED.items()} | {
        "location": "Location", "salary_range": "Salary range", "telecommuting": "Remote"}

    def listed(before, between, after):
        return F.concat_ws("\n", *[
            F.concat(F.lit(f"{before}{label}{between}"), escaped(F.trim(F.col(c))), F.lit(after)) for c, label in pairs.items()])

    numbers = F.regexp_extract_all("salary_range", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    area = [F.when(F.trim(part) != "", F.trim(part)) for part in (F.get(F.split("location", ","), F.lit(i)) for i in range(3))]
    flag = F.upper(F.trim("telecommuting")) == "T"
    embedded = F.to_json(F.struct(
        *[F.col(c).alias(prop) for c, (_, prop) in _STATED.items() if prop],
        F.when(flag, "TELECOMMUTE").alias("jobLocationType"),
        F.struct(F.struct(*[a.alias(n) for a, n in zip(area, ("addressCountry", "addressRegion", "addressLocality"))]).alias("address")).alias("jobLocation"),
        F.struct(F.when(F.size(numbers) == 2, F.struct(numbers[0].alias("minValue"), numbers[1].alias("maxValue"))).alias("value")).alias("baseSalary"),
    ))
    body = F.when(F.col(KEY) % 3 == 0, F.concat(F.lit('<script type="application/ld+json">'), embedded, F.lit("</script>"))).when(
        F.col(KEY) % 3 == 1, F.concat(F.lit("<dl>"), listed("<dt>", "</dt> <dd class='v'>", "</dd>"), F.lit("</dl>"))).otherwise(
        F.concat(F.lit("<table>"), listed("<tr><th>", "</th>\n<td>", "</td></tr>"), F.lit("</table>")))
    html = raw.select(F.col(KEY).alias("page_id"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))
    return pages.pages_to_postings(html).select(KEY, "location", "salary_range", "telecommuting", *_STATED)


@query("stream_encoded_postings", sql(
    """SELECT job_id, salary_processed, employment_type, has_company_logo, required_education,
       CAST(0.0 AS DOUBLE) AS anomaly_score, CAST(1 AS INTEGER) AS anomaly_label FROM enc1""", "single",
    {"enc1": views.features_sql("single")}))
def stream_encoded_postings(spark, sf_dir):
    stream = table_stream(spark, sf_dir, "documents")
    # Without a model every posting scores neutral, as in the SQL twin.
    scored = score_postings(postings_of(stream, None), None, [KEY])
    path, checkpoint = fresh_path(spark, "scored"), fresh_path(spark, "stream-state")
    write_scored(scored, path, checkpoint).awaitTermination()
    return files.read_table(spark, path)


_RAW = " || ' ' || ".join(f"coalesce({c}, '')" for c in ["title", "company_profile", "description", "requirements"])

#: Share of the training rows that the text model is fitted on.
TEXT_SAMPLE = 0.3


def _split_keys(spark, sf_dir):
    """(key, label, split) of the rows that remain after cleaning; narrow, computed once."""
    return settle(sampling.stratified_split(settle(clean(spark, sf_dir).select(KEY, LABEL)), KEY, LABEL))


def _cleaned(spark, sf_dir):
    """All cleaned postings, copies included; the keys of a split pick those that count."""
    return clean_postings(raw_postings(spark, sf_dir), dedupe=False)


def _texts(spark, sf_dir, keys):
    """The texts of the rows ``keys``, next to its columns; joined and written once."""
    texts = _cleaned(spark, sf_dir).select(KEY, text.raw_full_text().alias("text"))
    return stored(texts.join(keys, KEY), "texts")


# --- SQL twin of the text classifier --------------------------------------

_WORDS, _PENALTY, _STEPS = 512, 0.01, 200
#: Smoothness of the loss: a quarter of the squared length of (vector, 1), and the penalty.
_SMOOTH = 0.5 + _PENALTY
_MOMENTUM = (_SMOOTH**0.5 - _PENALTY**0.5) / (_SMOOTH**0.5 + _PENALTY**0.5)


def text_ctes(tag, rows, asked, texts="tx"):
    """Logistic regression by accelerated gradient steps; p{tag}: (id, p) of the rows ``asked``.

    ``rows`` gives (id, y, weight) to fit on, ``texts`` (id, text) of all.
    """
    t, stop = tag, views.quoted(stop_words())
    return {
        f"fr{t}": f"SELECT * FROM ({rows})",
        f"tk{t}": f"""SELECT id, w, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w
            FROM {texts} WHERE id IN (SELECT id FROM fr{t}) OR id IN ({asked})) WHERE w NOT IN ({stop}) GROUP BY ALL""",
        f"vo{t}": f"""SELECT w, ln(((SELECT count(*) FROM fr{t}) + 1) / (count(*) + 1)) AS idf FROM tk{t}
            WHERE id IN (SELECT id FROM fr{t}) GROUP BY w ORDER BY count(*) DESC, w LIMIT {_WORDS}""",
        f"ve{t}": f"""SELECT id, w, tf * idf / length AS x FROM (SELECT id, w, tf, idf, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS length
            FROM tk{t} JOIN vo{t} USING (w)) WHERE length > 0 UNION ALL SELECT id, '', 1.0 FROM {texts}
            WHERE id IN (SELECT id FROM fr{t}) OR id IN ({asked})""",
        f"px{t}": f"SELECT w, x, id, y, weight / (SELECT sum(weight) FROM fr{t}) AS c FROM ve{t} JOIN fr{t} USING (id)",
        f"gd{t}": f"""SELECT w, 0.0::DOUBLE AS theta, 0.0::DOUBLE AS ahead, 0 AS step FROM (SELECT DISTINCT w FROM px{t})
            UNION ALL SELECT w, new, new + {_MOMENTUM!r}::DOUBLE * (new - theta), step FROM (
            SELECT w, theta, step, ahead - (g + CASE WHEN w = '' THEN 0 ELSE {_PENALTY} * ahead END) / {_SMOOTH!r}::DOUBLE AS new FROM (
            SELECT w, theta, ahead, step + 1 AS step, sum(x * c * (1.0 / (1.0 + exp(-m)) - y)) AS g FROM (
            SELECT *, sum(x * ahead) OVER (PARTITION BY id) AS m FROM gd{t} JOIN px{t} USING (w) WHERE step < {_STEPS}) GROUP BY ALL))""",
        f"p{t}": f"""SELECT id, 1.0 / (1.0 + exp(-sum(x * theta))) AS p FROM ve{t} JOIN gd{t} USING (w)
            WHERE step = {_STEPS} AND id IN ({asked}) GROUP BY id""",
    }


def _weighted(where):
    """(id, y, weight): balanced over the rows that ``where`` picks from the split."""
    return f"""SELECT {KEY} AS id, {LABEL}::DOUBLE AS y, (count(*) OVER ()) / (2.0 * count(*) OVER (PARTITION BY {LABEL})) AS weight
        FROM split WHERE {where}"""


_TEXT_CTES = {"tx": f"SELECT {KEY} AS id, {_RAW} AS text FROM single"}
_SAMPLED = f"""SELECT id, y, weight FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || id)) - 1 AS place, count(*) OVER () AS m
    FROM ({_weighted("split = 'train'")})) WHERE place < floor(m * CAST({{share}} AS DOUBLE) + 0.5)"""


def text_sql(body, ctes):
    return sql(body, "split", _TEXT_CTES | ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("text_classifier", text_sql(
    f"""SELECT {KEY}, {LABEL}, round(p, 4) AS nlp_score, (p >= 0.5)::INTEGER AS predicted
        FROM split JOIN pt ON id = {KEY} WHERE split = 'val'""",
    text_ctes("t", _weighted("split = 'train'"), f"SELECT {KEY} FROM split WHERE split = 'val'")))
def text_classifier(spark, sf_dir):
    """Validation rows with their score and label by a model of all training rows."""
    keys = _split_keys(spark, sf_dir)
    texts = _texts(spark, sf_dir, keys)
    model = classifier.fit_text_classifier(classifier.with_class_weights(texts.where("split = 'train'")))
    scored = classifier.predict_proba(texts.where("split = 'val'"), model, keep=[KEY, LABEL])
    return scored.select(KEY, LABEL, F.round("nlp_score", 4).alias("nlp_score"),
                         (F.col("nlp_score") >= 0.5).cast("int").alias("predicted"))


@query("text_scores", text_sql(
    f"SELECT {KEY}, {LABEL}, round(p, 4) AS nlp_score FROM split JOIN pt ON id = {KEY} WHERE split = 'val'",
    text_ctes("t", _SAMPLED.format(share=TEXT_SAMPLE), f"SELECT {KEY} FROM split WHERE split = 'val'")))
def text_scores(spark, sf_dir):
    keys = _split_keys(spark, sf_dir)
    weighted = classifier.with_class_weights(keys.where("split = 'train'"))
    sample = sampling.exact_sample(settle(weighted), KEY, TEXT_SAMPLE)
    asked = keys.where("split = 'val'").withColumn("weight", F.lit(None).cast("double"))
    texts = _texts(spark, sf_dir, sample.unionByName(asked))
    model = classifier.fit_text_classifier(texts.where("split = 'train'"))
    scored = classifier.predict_proba(texts.where("split = 'val'"), model, keep=[KEY, LABEL])
    return scored.select(KEY, LABEL, F.round("nlp_score", 4).alias("nlp_score"))


@query("landed_scores", forest_sql(
    f"""SELECT CAST({KEY} AS VARCHAR) AS {KEY}, {', '.join(schema.FEATURES)}, factor - {offset_sql(0.05)} AS anomaly_score,
        CAST(CASE WHEN factor < {offset_sql(0.05)} THEN -1 ELSE 1 END AS INTEGER) AS anomaly_label FROM qr""",
    before={"enc1": views.features_sql("single")}, val="true", val_source="enc1"))
def landed_scores(spark, sf_dir):
    """Postings written as CSV, streamed from the folder and scored with a stored forest."""
    train = settle(views.split_scored(spark, sf_dir).select(KEY, "split", *schema.FEATURES)).where("split = 'train'")
    model = fresh_path(spark, "forest")
    iforest.save_forest(spark, iforest.fit_forest(train, KEY, contamination=0.05), model)
    landed = fresh_path(spark, "landed")
    files.write_csv(raw_postings(spark, sf_dir).select(KEY, *schema.RAW_COLUMNS), landed)
    scored = score_postings(landed_postings(spark, landed, KEY), iforest.load_forest(spark, model), [KEY])
    path, checkpoint = fresh_path(spark, "scored"), fresh_path(spark, "stream-state")
    write_scored(scored, path, checkpoint).awaitTermination()
    return files.read_table(spark, path)


@query("posting_by_key", sql(
    f"SELECT {KEY}, {', '.join(schema.FEATURES)} FROM enc WHERE {KEY} = (SELECT max({KEY}) FROM clean)", "enc"))
def posting_by_key(spark, sf_dir):
    rows = views.encoded(spark, sf_dir).drop(LABEL)
    return profile.row_by_key(rows, KEY, rows.agg(F.max(KEY)).scalar())


def _fused(spark, sf_dir):
    """(scored postings, fusion): trained, stored, read back and applied to all raw postings."""
    keys = _split_keys(spark, sf_dir)
    train = _cleaned(spark, sf_dir).drop(LABEL).join(keys.where("split = 'train'").drop("split"), KEY)
    weighted = settle(classifier.with_class_weights(keys.where("split = 'train'")).drop("split"))
    texts = _texts(spark, sf_dir, settle(sampling.stratified_folds(weighted, KEY, LABEL, fusion.FOLDS)))
    # The words are counted once for the three text models.
    counted = fusion.count_by_fold(texts, KEY, LABEL)

    def text_model():
        return counted.for_texts(classifier.fit_text_classifier(counted.rows, counting=counted.counting()))

    def outlier_model():
        return iforest.fit_forest(settle(encode_features(train, keep=[KEY])), KEY, contamination=0.1)

    def unseen_scores():
        return settle(fusion.out_of_fold_scores(texts, KEY, LABEL, counted=counted))

    # Fits are many short jobs, and none needs another's result.
    nlp, forest, unseen = side_by_side(spark, lambda work: work(), [text_model, outlier_model, unseen_scores])
    fused = fusion.fit_fusion(settle(fusion.meta_features(train, None, forest, [KEY, LABEL], unseen)))
    path = fresh_path(spark, "scorer")
    fusion.save_scorer(spark, nlp, fused, path)
    nlp, fused = fusion.load_scorer(spark, path)
    return fusion.score_end_to_end(raw_postings(spark, sf_dir), nlp, forest, fused, KEY), fused


_META = fusion.META_FEATURES
_FOLDS = f"""SELECT id, y, weight, (r >= floor(n * CAST(0.5 AS DOUBLE) + 0.5))::INTEGER AS fold FROM (SELECT *,
    row_number() OVER (PARTITION BY y ORDER BY md5('42:' || id)) - 1 AS r, count(*) OVER (PARTITION BY y) AS n
    FROM ({_weighted("split = 'train'")}))"""
_SIGNALS = f"-(q.factor - {offset_sql(0.1)}) AS outlier_score, s.desc_len, s.has_company_logo, s.telecommuting, s.has_questions"


def _fused_sql(body):
    """All of it: text models (whole, and one per fold), forest, meta-features, trees, coalitions."""
    ctes = (
        {"enc1": views.features_sql("single")} | forest_ctes(val="true", val_source="enc1") | _TEXT_CTES
        | text_ctes("t", _weighted("split = 'train'"), f"SELECT {KEY} FROM single") | {"fo": _FOLDS}
        | text_ctes("u", "SELECT id, y, weight FROM fo WHERE fold = 1", "SELECT id FROM fo WHERE fold = 0")
        | text_ctes("w", "SELECT id, y, weight FROM fo WHERE fold = 0", "SELECT id FROM fo WHERE fold = 1")
        | {"mt": f"""SELECT -f.id - 1 AS rid, true AS fit, f.y, round(p, 3) AS nlp_score, {_SIGNALS}
                FROM fo f JOIN (FROM pu UNION ALL FROM pw) u ON u.id = f.id JOIN single s ON s.{KEY} = f.id JOIN qr q ON q.{KEY} = f.id
                UNION ALL SELECT s.{KEY}, false, NULL, round(p, 3), {_SIGNALS}
                FROM single s JOIN pt ON pt.id = s.{KEY} JOIN qr q ON q.{KEY} = s.{KEY}"""}
        | boosted_ctes(_META, "fit", "y", "mt", "rid")
    )
    return sql(body, "split", ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("fused_scores", _fused_sql(
    f"""SELECT id AS {KEY}, round(1.0 / (1.0 + exp(-margin)), 6) AS fraud_score,
        CASE WHEN 1.0 / (1.0 + exp(-margin)) >= 0.5 THEN 'Fraudulent' ELSE 'Legitimate' END AS label,
        {shapley_columns(_META, 5)} FROM sh"""))
def fused_scores(spark, sf_dir):
    """Raw postings to fused score, label and attributions, all models trained, stored and read back."""
    scored, _ = _fused(spark, sf_dir)
    return scored.select(KEY, F.round("fraud_score", 6).alias("fraud_score"), "label", *[
        (F.round(F.col("shap_values")[c], 5) + 0.0).alias(f"shap_{c}") for c in _META])


@query("fused_checks",
       "SELECT doc_id AS job_id, true AS is_probability, true AS label_fits, true AS attributions_add_up FROM documents")
def fused_checks(spark, sf_dir):
    """Every posting: a probability, the label that goes with it, attributions that sum to the difference.

    The attributions of a row sum to its log-odds minus those of the training means.
    """
    scored, fused = _fused(spark, sf_dir)
    total = F.aggregate(F.map_values("shap_values"), F.lit(0.0), lambda a, v: a + v)
    p = F.col("fraud_score")
    return scored.select(
        KEY, p.between(0, 1).alias("is_probability"),
        ((p >= 0.5) == (F.col("label") == "Fraudulent")).alias("label_fits"),
        (F.abs(total - (F.log(p / (1 - p)) - F.lit(boosting.base_margin(fused)))) < 1e-9).alias("attributions_add_up"),
    )
