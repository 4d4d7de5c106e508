"""Studies built on the roles: sub-corpora, contrasts, models with their verdicts, coding sheets and the frames behind figures.

Each has SQL unless it fits a model or draws random numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlode.functions import scalars, text
from reviewlode.operators import gaps, patterns, relational, temporal, topics
from reviewlode.plans import bindings as B
from reviewlode.plans.queries import ITS_SQL, QUERIES, SQL, design_rows, query, r6, rated
from reviewlode.scorers import guess_language
from reviewlode.stats import agreement, linear, small

_NUM = "CASE label WHEN 'Negative' THEN -1.0 WHEN 'Neutral' THEN 0.0 WHEN 'Positive' THEN 1.0 END"
ACCURACY, COMPARISON = ("prayer_times", "qibla", "travel"), ("ui",)


# ---------------------------------------------------------------- corpus
@query("language_guess", r""" SELECT reviewId, CASE WHEN text = '' OR greatest(bn, ar, en) = 0 THEN 'unk' WHEN bn >= ar AND bn >= en THEN 'bn' WHEN ar >= en THEN 'ar' ELSE 'en' END AS lang, CASE WHEN text = '' THEN 0.0 ELSE 0.5 END AS lang_conf FROM (
  SELECT reviewId, text, length(regexp_replace(text, '[^\x{980}-\x{9FF}]', '', 'g')) AS bn, length(regexp_replace(text, '[^\x{600}-\x{6FF}]', '', 'g')) AS ar, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS en FROM r)""")
def _(spark, d):
    lang, conf = guess_language("text")
    return r6(B.reviews(spark, d).select("reviewId", lang.alias("lang"), conf.alias("lang_conf")))


@query("subcorpora", r""", k AS (SELECT r.*, CASE WHEN greatest(bn, ar, en) = 0 THEN 'unk' WHEN bn >= ar AND bn >= en THEN 'bn' WHEN ar >= en THEN 'ar' ELSE 'en' END AS lang FROM (SELECT *, length(regexp_replace(text, '[^\x{980}-\x{9FF}]', '', 'g')) AS bn,
  length(regexp_replace(text, '[^\x{600}-\x{6FF}]', '', 'g')) AS ar, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS en FROM r) r)
  SELECT count(*) AS corpus_all, count(*) FILTER (corpus_text) AS corpus_text, count(*) FILTER (corpus_text AND lang = 'en') AS corpus_en, count(*) FILTER (corpus_text AND lang <> 'en') AS corpus_trans,
  count(*) FILTER (corpus_text AND app IN (SELECT app FROM f WHERE csv_annotated IS NOT NULL)) AS corpus_annot FROM k""")
def _(spark, d):
    lang, _conf = guess_language("text")
    annotated = B.features(spark, d).where("csv_annotated IS NOT NULL").select("app").distinct()
    r = relational.semi_flag(B.reviews(spark, d).withColumn("lang", lang), annotated, ["app"], "annotated")
    t = F.col("corpus_text")
    return r.agg(F.count(F.lit(1)).alias("corpus_all"), F.count_if(t).alias("corpus_text"), F.count_if(t & (F.col("lang") == "en")).alias("corpus_en"), F.count_if(t & (F.col("lang") != "en")).alias("corpus_trans"), F.count_if(t & F.col("annotated")).alias("corpus_annot"))


@query("translation_check", r""" SELECT row_id, coalesce(trim(replyContent) <> '' AND trim(replyContent) <> trim(content) AND CASE WHEN t = 0 THEN 0.0 ELSE l / t END >= 0.5, FALSE) AS looks_translated FROM (
  SELECT row_id, content, replyContent, length(regexp_replace(replyContent, '[^\p{L}]', '', 'g'))::DOUBLE AS t, length(regexp_replace(replyContent, '[^A-Za-z\x{C0}-\x{24F}]', '', 'g')) AS l FROM r)""")
def _(spark, d):
    return B.reviews(spark, d).select("row_id", text.looks_translated("content", "replyContent").alias("looks_translated"))


@query("emoji_texts", r" SELECT reviewId, CASE WHEN regexp_matches(coalesce(content, ''), '[\x{2501}-\x{10FFFF}]') THEN array_to_string(regexp_extract_all(content, '" + B._EMOJI + r"'), '') ELSE '' END AS emoji FROM r")
def _(spark, d):
    return B.reviews(spark, d).select("reviewId", text.emoji_of(F.coalesce("content", F.lit(""))).alias("emoji"))


@query("folder_names", r" SELECT app_dir, substring(regexp_replace(trim(regexp_replace(strip_accents(title), '[^A-Za-z0-9_\s\-]', '', 'g')), '\s+', '_', 'g'), 1, 80) AS folder FROM app_metadata WHERE title IS NOT NULL AND regexp_full_match(title, '[\x00-\x7F\x{C0}-\x{17F}]*')", base=False)
def _(spark, d):
    m = B.table(spark, d, "app_metadata").where(F.col("title").isNotNull() & F.col("title").rlike(r"^[\x00-\x7F\x{C0}-\x{17F}]*$"))
    return m.select("app_dir", text.safe_dirname("title").alias("folder"))


@query("quarter_bounds", """ SELECT CAST(date_trunc('quarter', ts) AS DATE) AS quarter, CAST(date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, count(*) AS n FROM r WHERE ts IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    r = B.reviews(spark, d).where("at IS NOT NULL")
    return r.groupBy(scalars.quarter_start("at").alias("quarter"), scalars.quarter_end("at").alias("quarter_end")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- joins
@query("one_to_one_left", """, k AS (SELECT reviewId, count(*) AS n_aspects FROM a WHERE NOT is_request GROUP BY reviewId) SELECT r.reviewId, label, k.n_aspects FROM r LEFT JOIN k USING (reviewId)""")
def _(spark, d):
    k = B.aspects(spark, d).where("NOT is_request").groupBy("reviewId").agg(F.count(F.lit(1)).alias("n_aspects"))
    return relational.one_to_one(B.reviews(spark, d).select("reviewId", "label"), k, ["reviewId"], "left").select("reviewId", "label", "n_aspects")


@query("annotator_pairs", """WITH first_ AS (SELECT reviewId, min_by(theme_code, row_id) AS x FROM rq1_tracker_negative_50 WHERE theme_code IS NOT NULL GROUP BY reviewId), last_ AS (SELECT reviewId, max_by(theme_code, row_id) AS y FROM rq1_tracker_negative_50 WHERE theme_code IS NOT NULL GROUP BY reviewId HAVING count(*) > 1)
  SELECT reviewId, x, y, x = y AS agree FROM first_ JOIN last_ USING (reviewId)""", base=False)
def _(spark, d):
    s = B.table(spark, d, "rq1_tracker_negative_50").where("theme_code IS NOT NULL").groupBy("reviewId")
    first = s.agg(F.min_by("theme_code", "row_id").alias("x"))
    last = s.agg(F.max_by("theme_code", "row_id").alias("y"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return relational.one_to_one(first, last, ["reviewId"], "inner").select("reviewId", "x", "y", (F.col("x") == F.col("y")).alias("agree"))


@query("demand_of_all_apps", """, k AS (SELECT app, count(DISTINCT reviewId) AS n FROM d WHERE request_type = 'request' GROUP BY app) SELECT m.app_dir AS app, k.n FROM k RIGHT JOIN app_metadata m ON m.app_dir = k.app""")
def _(spark, d):
    k = B.demands(spark, d).where("request_type = 'request'").groupBy("app").agg(F.countDistinct("reviewId").alias("n"))
    return k.join(B.table(spark, d, "app_metadata").select(F.col("app_dir").alias("app")), "app", "right").select("app", "n")


@query("complaint_terms", " SELECT 'complaint_' || aspect AS term, count(*) AS n FROM a WHERE sentiment_label = 'Negative' AND aspect IN (" + ", ".join(f"'{x.name}'" for x in B.LEXICON) + ") GROUP BY aspect")
def _(spark, d):
    x, _terms = gaps.design(B.reviews(spark, d), B.aspects(spark, d), [a.name for a in B.LEXICON]), None
    cells = [c for c in x.columns if c.startswith(("complaint_", "mentions_"))]
    long = x.agg(*[F.sum(c).alias(c) for c in cells]).unpivot([], cells, "term", "n")
    return long.where(F.col("term").startswith("complaint_") & (F.col("n") > 0)).select("term", F.col("n").cast("bigint").alias("n"))


@query("entailment_softmax", """ SELECT reviewId, aspect, round(exp(prob_pos) / (exp(prob_pos) + exp(prob_neg)), 6) AS entailed, round(exp(prob_neg) / (exp(prob_neg) + exp(prob_neu) + exp(prob_pos)), 6) AS s_neg FROM a WHERE NOT is_request""")
def _(spark, d):
    a = B.aspects(spark, d).where("NOT is_request")
    return r6(a.select("reviewId", "aspect", scalars.softmax2(F.col("prob_pos"), F.col("prob_neg")).alias("entailed"), scalars.softmax3(F.col("prob_neg"), F.col("prob_neu"), F.col("prob_pos"))[0].alias("s_neg")))


# ---------------------------------------------------------------- topics of coded texts
_THEMES = """, b AS (SELECT DISTINCT reviewId, theme FROM rq1_tracker_negative_50 WHERE theme IS NOT NULL), t AS (SELECT r.app, b.theme, r.score, r.label FROM r JOIN b USING (reviewId))"""


def _themes(spark, d):
    return B.reviews(spark, d).join(B.table(spark, d, "rq1_tracker_negative_50").where("theme IS NOT NULL").select("reviewId", "theme").distinct(), "reviewId")


@query("theme_prevalence", _THEMES + " SELECT app, theme, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY app)::DOUBLE, 6) AS share_of_app FROM t GROUP BY app, theme")
def _(spark, d):
    n = _themes(spark, d).groupBy("app", "theme").agg(F.count(F.lit(1)).alias("n"))
    return r6(relational.share_of_group(n, ["app"], "n", "share_of_app"))


@query("theme_sentiment", _THEMES + f" SELECT theme, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg({_NUM}), 6) + 0.0 AS mean_sentiment, round(avg(CASE WHEN label = 'Negative' THEN 1.0 ELSE 0 END), 6) AS pct_negative FROM t GROUP BY theme")
def _(spark, d):
    return r6(_themes(spark, d).groupBy("theme").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(temporal.numeric_label()).alias("mean_sentiment"), relational.rate(F.col("label") == "Negative").alias("pct_negative")))


@query("aspect_shares_wide", " SELECT app, " + ", ".join(f"round(count(*) FILTER (aspect = '{x.name}') / count(*)::DOUBLE, 6) AS {x.name}" for x in B.LEXICON) + " FROM a WHERE NOT is_request GROUP BY app")
def _(spark, d):
    names = [x.name for x in B.LEXICON]
    return r6(relational.row_shares(B.aspects(spark, d).where("NOT is_request"), "app", "aspect", names))


@query("topic_tags", """ SELECT aspect, CASE WHEN aspect IN ('prayer_times', 'qibla', 'travel') THEN 'accuracy' WHEN aspect IN ('ads', 'subscription') THEN 'money' ELSE '' END AS tags FROM a GROUP BY aspect""")
def _(spark, d):
    t = B.aspects(spark, d).select("aspect").distinct()
    return topics.tag_topics(t, "aspect", {"accuracy": ["prayer_times", "qibla", "travel"], "money": ["ads", "subscription"]})


@query("prefilter_recall", """WITH l AS (SELECT label::VARCHAR AS label, min_by(embedding, vec_id) AS v FROM embeddings GROUP BY label), c AS (SELECT vec_id AS item, e.label::VARCHAR AS gold, l.label, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 9) AS cosine FROM embeddings e, l),
  k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY cosine DESC, label) AS rank FROM c) SELECT count(DISTINCT item) AS n, round(count(*) FILTER (rank <= 3 AND gold = label) / count(DISTINCT item)::DOUBLE, 6) AS recall FROM k""", base=False)
def _(spark, d):
    e = B.table(spark, d, "embeddings")
    labels = e.groupBy(F.col("label").cast("string").alias("label")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    short = topics.nearest(e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), labels, 3)
    return r6(topics.prefilter_recall(short, e.select(F.col("vec_id").alias("item"), F.col("label").cast("string").alias("label"))))


@query("topic_stability")
def _(spark, d):
    value = topics.stability(B.table(spark, d, "embeddings"), "vec_id", "embedding", 10, [42, 43, 44])
    return spark.createDataFrame([(value,)], "mean_ari double")


@query("topic_submodels")
def _(spark, d):
    e = B.table(spark, d, "embeddings")
    got = topics.submodels(e, "vec_id", "embedding", {"low": e.where("label < 5"), "high": e.where("label >= 5"), "none": e.where("label < 0")}, 4)
    return r6(got) if got is not None else spark.createDataFrame([], "vec_id bigint, topic_id int, distance double, submodel string")


@query("topic_terms", r""", w AS (SELECT topic, list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda t: length(t) > 2 AND t NOT IN (""" + ", ".join(f"'{x}'" for x in B.STOPWORDS) + r""")) AS ws FROM (SELECT theme AS topic, content_clean AS text FROM rq1_tracker_negative_50 WHERE theme IS NOT NULL)),
  t AS (SELECT topic, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w), n AS (SELECT topic, term, count(*) AS n FROM t GROUP BY ALL), z AS (SELECT topic, sum(n) AS size FROM n GROUP BY topic), o AS (SELECT term, sum(n) AS alls FROM n GROUP BY term),
  sc AS (SELECT n.topic, n.term, n.n, n.n / size::DOUBLE * ln(1 + (SELECT avg(size) FROM z) / alls) AS weight FROM n JOIN z USING (topic) JOIN o USING (term)), k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 12) DESC, term) AS rn FROM sc) SELECT topic, term, n, round(weight, 6) AS weight FROM k WHERE rn <= 10""")
def _(spark, d):
    docs = B.table(spark, d, "rq1_tracker_negative_50").where("theme IS NOT NULL").select(F.col("theme").alias("topic"), F.col("content_clean").alias("text"))
    return r6(topics.terms(docs, "topic", "text", B.STOPWORDS))


# ---------------------------------------------------------------- time
@query("aspect_early_late", """, q AS (SELECT reviewId, CAST(date_trunc('quarter', ts) AS DATE) AS quarter FROM r WHERE ts IS NOT NULL), t AS (SELECT quarter, count(DISTINCT reviewId) AS total FROM q GROUP BY 1), v AS (SELECT quarter, aspect, count(DISTINCT a.reviewId) / any_value(total)::DOUBLE AS rate FROM a JOIN q USING (reviewId) JOIN t USING (quarter) GROUP BY quarter, aspect),
  y AS (SELECT min(year(quarter)) AS lo, max(year(quarter)) AS hi FROM v) SELECT aspect, round(avg(CASE WHEN year(quarter) <= lo + 2 THEN rate END), 6) AS early, round(avg(CASE WHEN year(quarter) >= hi - 2 THEN rate END), 6) AS late,
  round(avg(CASE WHEN year(quarter) >= hi - 2 THEN rate END) - avg(CASE WHEN year(quarter) <= lo + 2 THEN rate END), 6) + 0.0 AS change FROM v, y GROUP BY aspect HAVING early IS NOT NULL AND late IS NOT NULL""")
def _(spark, d):
    return r6(temporal.early_late(temporal.aspect_quarterly(B.reviews(spark, d), B.aspects(spark, d), "reviewId")))


@query("neighbour_means", """, m AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n, avg(score) AS mean_score FROM r WHERE ts IS NOT NULL GROUP BY 1)
  SELECT month, n, round(avg(mean_score) OVER (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 6) AS mean_before, round(avg(mean_score) OVER (ORDER BY month ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 6) AS mean_after FROM m""")
def _(spark, d):
    m = B.reviews(spark, d).where("at IS NOT NULL").groupBy(scalars.month("at").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    return r6(temporal.neighbour_means(m.withColumn("series", F.lit(1)), "series", "mean_score").select("month", "n", "mean_before", "mean_after"))


_ITS_WLS = ITS_SQL + """, b AS (SELECT n::DOUBLE AS n, rate, months_from_event AS x, months_from_event > 0 AS post FROM its2 WHERE months_from_event BETWEEN -12 AND 12),
  m AS (SELECT post, sum(n) AS w, sum(n * x) / sum(n) AS xm, sum(n * rate) / sum(n) AS ym, count(*) AS k FROM b GROUP BY post),
  sq AS (SELECT post, any_value(w) AS w, any_value(xm) AS xm, any_value(ym) AS ym, any_value(k) AS k, sum(n * (x - xm) * (x - xm)) AS sxx, sum(n * (x - xm) * (rate - ym)) AS sxy, sum(n * (rate - ym) * (rate - ym)) AS syy FROM b JOIN m USING (post) GROUP BY post),
  u AS (SELECT post, k, sxy / sxx AS slope, ym - sxy / sxx * xm AS cut, syy - sxy * sxy / sxx AS rss, 1 / sxx AS vs, 1 / w + xm * xm / sxx AS vc FROM sq),
  e AS (SELECT p.cut AS c0, p.slope AS s0, q.cut AS c1, q.slope AS s1, (p.rss + q.rss) / (p.k + q.k - 4) AS s2, p.vc AS vc0, p.vs AS vs0, q.vc AS vc1, q.vs AS vs1 FROM u p, u q WHERE NOT p.post AND q.post),
  z AS (SELECT 'Intercept' AS term, c0 AS est, sqrt(s2 * vc0) AS se FROM e UNION ALL SELECT 'months_from_event', s0, sqrt(s2 * vs0) FROM e UNION ALL SELECT 'post', c1 - c0, sqrt(s2 * (vc0 + vc1)) FROM e UNION ALL SELECT 'time_x_post', s1 - s0, sqrt(s2 * (vs0 + vs1)) FROM e)
  SELECT term, round(est, 6) + 0.0 AS estimate, round(se, 6) AS std_error, round(CASE WHEN se > 0 THEN est / se ELSE 0 END, 4) + 0.0 AS t_value FROM z"""


def _interrupted(spark, d):
    hits = B.aspects(spark, d).where("aspect = 'subscription'")
    m = temporal.interrupted(B.reviews(spark, d), hits, "reviewId", 2024, 1)
    return m.withColumn("post", (F.col("period") == "post").cast("int")).withColumn("time_x_post", F.col("post") * F.col("months_from_event"))


@query("its_wls", _ITS_WLS)
def _(spark, d):
    fit = linear.weighted_fit(_interrupted(spark, d), "rate", ["months_from_event", "post", "time_x_post"], "n")
    return r6(spark.createDataFrame([(a, b, c, round(t, 4)) for a, b, c, t in fit], "term string, estimate double, std_error double, t_value double"))


@query("its_p_values")
def _(spark, d):
    m = _interrupted(spark, d)
    fit = linear.weighted_fit(m, "rate", ["months_from_event", "post", "time_x_post"], "n")
    free = m.dropna(subset=["rate"]).count() - 4
    return spark.createDataFrame([(a, linear.student_p(t, free)) for a, _b, _c, t in fit], "term string, p_value double")


# ---------------------------------------------------------------- models and verdicts
@query("normal_interval", """ SELECT app, count(score) AS n, round(avg(score), 6) AS estimate, round(avg(score) - 1.96 * stddev_samp(score) / sqrt(count(score)), 6) AS low, round(avg(score) + 1.96 * stddev_samp(score) / sqrt(count(score)), 6) AS high FROM r GROUP BY app""")
def _(spark, d):
    g = B.reviews(spark, d).groupBy("app").agg(F.count("score").alias("n"), F.avg("score").alias("estimate"), F.stddev_samp("score").alias("s_"))
    half = 1.96 * F.col("s_") / F.sqrt("n")
    return r6(g.select("app", "n", "estimate", (F.col("estimate") - half).alias("low"), (F.col("estimate") + half).alias("high")))


@query("complaint_cost")
def _(spark, d):
    """Stars that a complaint costs within an app, of the terms with enough positives, and which family costs more; no verdict without both sides."""
    x, terms = design_rows(spark, d)
    kept = linear.drop_sparse(x, [t for t in terms if t.startswith("complaint_")])
    if not kept:
        return spark.createDataFrame([], linear.SCHEMA)
    fit = linear.mixed(linear.moments(x, "score", [*kept, "log_words"], "app"))
    cost = dict(zip(fit.terms, fit.estimate))
    a = [cost[f"complaint_{n}"] for n in ACCURACY if cost.get(f"complaint_{n}") is not None]
    b = [cost[f"complaint_{n}"] for n in COMPARISON if cost.get(f"complaint_{n}") is not None]
    verdict = "unavailable" if not a or not b else "accuracy costs more" if sum(a) / len(a) < sum(b) / len(b) else "comparison costs more"
    return spark.createDataFrame([*fit.rows("complaint_cost"), ("complaint_cost", "verdict", *[None] * 5, fit.n, verdict)], linear.SCHEMA)


@query("dropped_terms", " SELECT 'complaint_' || aspect AS term, count(*) >= 25 AS kept FROM a JOIN r USING (reviewId) WHERE sentiment_label = 'Negative' AND r.score IS NOT NULL GROUP BY aspect")
def _(spark, d):
    x, terms = design_rows(spark, d)
    terms = [t for t in terms if t.startswith("complaint_")]
    n = x.agg(*[F.sum(t).alias(t) for t in terms]).unpivot([], terms, "term", "n").where("n > 0")
    kept = linear.drop_sparse(x, terms)
    return n.select("term", F.col("term").isin(kept).alias("kept"))


@query("tier_model")
def _(spark, d):
    t = gaps.tracker_tier(B.features(spark, d), "tracker", "reminders")
    x = B.reviews(spark, d).where("score IS NOT NULL AND n_words > 0").join(t, "app").select("app", "score", F.log1p("n_words").alias("log_words"), *[(F.col("tier") == v).cast("double").alias(f"tier_{v}") for v in ("plain", "extended")])
    m = linear.moments(x, "score", ["tier_plain", "tier_extended", "log_words"], "app")
    return spark.createDataFrame([*linear.cluster_ols(m).rows("tier_ols"), *linear.mixed(m).rows("tier_mixed")], linear.SCHEMA)


_COUNTS = """, fc AS (SELECT app, sum(feature_present) AS feature_count FROM f GROUP BY app), z AS (SELECT r.app, any_value(feature_count) AS feature_count, avg(score) AS mean_score, avg(CASE WHEN label = 'Negative' THEN 1.0 ELSE 0 END) AS pct_negative, count(*) AS n FROM r JOIN fc USING (app) GROUP BY r.app)"""


def _counts(spark, d):
    c = B.features(spark, d).groupBy("app").agg(F.sum("feature_present").alias("feature_count"))
    return B.reviews(spark, d).join(F.broadcast(c), "app").groupBy("app").agg(F.first("feature_count").alias("feature_count"), F.avg("score").alias("mean_score"), relational.rate(F.col("label") == "Negative").alias("pct_negative"), F.count(F.lit(1)).alias("n"))


@query("feature_count_apps", _COUNTS + " SELECT app, round(feature_count, 6) AS feature_count, round(mean_score, 6) AS mean_score, round(pct_negative, 6) AS pct_negative, n FROM z")
def _(spark, d):
    return r6(_counts(spark, d))


@query("feature_count_rho", _COUNTS + """, k AS (SELECT rank() OVER (ORDER BY feature_count) + (count(*) OVER (PARTITION BY feature_count) - 1) / 2.0 AS rx, rank() OVER (ORDER BY mean_score) + (count(*) OVER (PARTITION BY mean_score) - 1) / 2.0 AS ry FROM z WHERE mean_score IS NOT NULL) SELECT count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS rho FROM k""")
def _(spark, d):
    return r6(agreement.spearman(_counts(spark, d), "feature_count", "mean_score"))


@query("feature_count_model")
def _(spark, d):
    meta = B.table(spark, d, "app_metadata").select(F.col("app_dir").alias("app"), F.log1p("realInstalls").alias("log_installs"))
    c = B.features(spark, d).groupBy("app").agg(F.sum("feature_present").alias("feature_count")).join(meta, "app")
    x = B.reviews(spark, d).where("score IS NOT NULL").join(F.broadcast(gaps.centred(c, ["feature_count", "log_installs"])), "app").withColumn("log_words", F.log1p("n_words"))
    m = linear.moments(x, "score", ["feature_count_c", "log_installs_c", "log_words"], "app")
    return spark.createDataFrame([*linear.cluster_ols(m).rows("feature_count_ols"), *linear.mixed(m).rows("feature_count_mixed")], linear.SCHEMA)


@query("centred_counts", """, fc AS (SELECT app, sum(feature_present)::DOUBLE AS feature_count FROM f GROUP BY app), k AS (SELECT fc.app, feature_count, ln(1 + realInstalls) AS log_installs FROM fc JOIN app_metadata m ON m.app_dir = fc.app)
  SELECT app, round(feature_count - (SELECT avg(feature_count) FROM k), 6) + 0.0 AS feature_count_c, round(log_installs - (SELECT avg(log_installs) FROM k), 6) + 0.0 AS log_installs_c FROM k""")
def _(spark, d):
    meta = B.table(spark, d, "app_metadata").select(F.col("app_dir").alias("app"), F.log1p("realInstalls").alias("log_installs"))
    c = B.features(spark, d).groupBy("app").agg(F.sum("feature_present").alias("feature_count")).join(meta, "app")
    return r6(gaps.centred(c, ["feature_count", "log_installs"]).select("app", "feature_count_c", "log_installs_c"))


@query("contrast_model")
def _(spark, d):
    have = B.features(spark, d).where("aspect = 'travel' AND feature_present >= 1").select("app").distinct()
    x = relational.semi_flag(B.reviews(spark, d).where("score IS NOT NULL"), have, ["app"], "has_").withColumns({"has_travel": F.col("has_").cast("double"), "log_words": F.log1p("n_words")})
    m = linear.moments(x, "score", ["has_travel", "log_words"], "app")
    return spark.createDataFrame([*linear.cluster_ols(m).rows("contrast_ols"), *linear.mixed(m).rows("contrast_mixed")], linear.SCHEMA)


_CELLS = """, m AS (SELECT reviewId, coalesce(max(CASE WHEN aspect = 'ads' THEN 1 END), 0) AS x, coalesce(max(CASE WHEN aspect = 'ui' THEN 1 END), 0) AS y FROM (SELECT reviewId FROM r WHERE corpus_text) LEFT JOIN (SELECT * FROM a WHERE NOT is_request) USING (reviewId) GROUP BY reviewId),
  c AS (SELECT sum(x * y)::BIGINT AS both, sum(x * (1 - y))::BIGINT AS only_a, sum((1 - x) * y)::BIGINT AS only_b, sum((1 - x) * (1 - y))::BIGINT AS neither FROM m)"""


@query("odds_ratio", _CELLS + " SELECT \"both\", only_a, only_b, neither, round(\"both\" * neither / nullif(only_a * only_b, 0)::DOUBLE, 6) AS odds_ratio FROM c")
def _(spark, d):
    c = gaps.cooccurrence(B.reviews(spark, d).where("corpus_text"), B.aspects(spark, d).where("NOT is_request"), "reviewId", "ads", "ui")
    return r6(c.select("both", "only_a", "only_b", "neither", F.try_divide((F.col("both") * F.col("neither")).cast("double"), F.col("only_a") * F.col("only_b")).alias("odds_ratio")))


@query("difference_of_means", """, h AS (SELECT DISTINCT app FROM f WHERE aspect = 'travel' AND feature_present >= 1) SELECT round(avg(score) FILTER (app IN (SELECT app FROM h)) - avg(score) FILTER (app NOT IN (SELECT app FROM h)), 6) + 0.0 AS difference FROM r""")
def _(spark, d):
    have = B.features(spark, d).where("aspect = 'travel' AND feature_present >= 1").select("app").distinct()
    r = relational.semi_flag(B.reviews(spark, d), have, ["app"], "has_")
    return r6(r.agg((F.avg(F.when(F.col("has_"), F.col("score"))) - F.avg(F.when(~F.col("has_"), F.col("score")))).alias("difference")))


@query("bloat_band")
def _(spark, d):
    rows = [r for r in _counts(spark, d).select("feature_count", "mean_score").collect() if r.mean_score is not None]  # a row for each app
    at = sorted({float(r.feature_count) for r in rows})
    band = small.trend_band([float(r.feature_count) for r in rows], [r.mean_score for r in rows], at)
    return spark.createDataFrame([(x, *b) for x, b in zip(at, band or [])], "feature_count double, fit double, low double, high double")


@query("precision_interval")
def _(spark, d):
    z = rated(spark, d).where("x IS NOT NULL")
    n = z.groupBy("app").agg(F.count_if(F.col("x") == F.col("y")).alias("k"), F.count(F.lit(1)).alias("n")).orderBy("app").collect()  # a row for each app
    got = small.weighted_precision_interval([(r.k, r.n, float(r.n)) for r in n])
    return spark.createDataFrame([got or (None, None)], "low double, high double")


@query("bimodality", """, st AS (SELECT count(score)::DOUBLE AS n, avg(score) AS m FROM r), c AS (SELECT any_value(n) AS n, sum(power(score - m, 2)) / any_value(n) AS m2, sum(power(score - m, 3)) / any_value(n) AS m3, sum(power(score - m, 4)) / any_value(n) AS m4 FROM r, st WHERE score IS NOT NULL),
  g AS (SELECT n, m3 / power(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM c) SELECT round((skew * skew + 1) / (kurt + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))), 6) AS bimodality FROM g""")
def _(spark, d):
    h = {float(x.score): x.n for x in B.reviews(spark, d).where("score IS NOT NULL").groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}  # five rows
    return r6(spark.createDataFrame([(small.bimodality(h),)], "bimodality double"))


# ---------------------------------------------------------------- demand and loyalty
@query("travel_demand_by_app", """, q AS (SELECT app, count(DISTINCT reviewId) AS n FROM d WHERE aspect = 'travel' GROUP BY app), t AS (SELECT app, count(*) AS total FROM r WHERE corpus_text GROUP BY app) SELECT t.app, coalesce(n, 0) AS n, round(coalesce(n, 0) / total::DOUBLE, 6) AS rate FROM t LEFT JOIN q USING (app)""")
def _(spark, d):
    q = B.demands(spark, d).where("aspect = 'travel'").groupBy("app").agg(F.countDistinct("reviewId").alias("n"))
    t = B.reviews(spark, d).where("corpus_text").groupBy("app").agg(F.count(F.lit(1)).alias("total"))
    return r6(t.join(q, "app", "left").fillna(0, ["n"]).select("app", "n", (F.col("n") / F.col("total")).alias("rate")))


@query("complaints_by_quarter", """ SELECT CAST(date_trunc('quarter', ts) AS DATE) AS quarter, count(*) AS n, round(avg(CASE WHEN sentiment_label = 'Negative' THEN 1.0 ELSE 0 END), 6) AS pct_negative FROM a JOIN (SELECT reviewId, ts FROM r WHERE ts IS NOT NULL) USING (reviewId) WHERE aspect = 'subscription' AND NOT is_request GROUP BY 1 HAVING count(*) >= 10""")
def _(spark, d):
    dated = B.reviews(spark, d).where("at IS NOT NULL").select("reviewId", scalars.quarter_start("at").alias("quarter"))
    a = B.aspects(spark, d).where("aspect = 'subscription' AND NOT is_request").join(dated, "reviewId")
    return r6(a.groupBy("quarter").agg(F.count(F.lit(1)).alias("n"), relational.rate(F.col("sentiment_label") == "Negative").alias("pct_negative")).where("n >= 10"))


_SYN = [("reviews", "(SELECT count(*) FROM r)"), ("text_reviews", "(SELECT count(*) FROM r WHERE corpus_text)"), ("aspect_rows", "(SELECT count(*) FROM a WHERE NOT is_request)"), ("request_rows", "(SELECT count(*) FROM a WHERE is_request)"), ("demand_rows", "(SELECT count(*) FROM d)"), ("promised", "(SELECT count(*) FROM f WHERE feature_present >= 1)")]


@query("synthesis", " " + " UNION ALL ".join(f"SELECT '{n}' AS item, {q}::BIGINT AS value" for n, q in _SYN))
def _(spark, d):
    r, a, dm, f = B.reviews(spark, d), B.aspects(spark, d), B.demands(spark, d), B.features(spark, d)
    out = None
    for name, df, cond in (("reviews", r, "true"), ("text_reviews", r, "corpus_text"), ("aspect_rows", a, "NOT is_request"), ("request_rows", a, "is_request"), ("demand_rows", dm, "true"), ("promised", f, "feature_present >= 1")):
        one = df.agg(F.lit(name).alias("item"), F.count_if(F.expr(cond)).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- coding sheets
_STRATUM = "CASE WHEN realInstalls > 100000000 THEN '100M+' WHEN realInstalls > 10000000 THEN '10M+' WHEN realInstalls > 1000000 THEN '1M+' ELSE '<1M' END || '|' || CASE WHEN r.score <= 2 THEN 'low' WHEN r.score = 3 THEN 'mid' ELSE 'high' END"


@query("gold_documents", f""", g AS (SELECT reviewId, app, r.score, {_STRATUM} AS stratum, text AS content_clean, md5(reviewId || '|42') AS h FROM r LEFT JOIN app_metadata m ON m.app_dir = r.app WHERE corpus_text AND r.score IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, reviewId) AS rn FROM g)
  SELECT reviewId, app, score::BIGINT AS score, stratum, content_clean, '' AS gold_label, '' AS annotator, '' AS notes FROM k ORDER BY CASE WHEN rn > greatest(1, 500 // (SELECT count(DISTINCT stratum) FROM g)) THEN 1 ELSE 0 END, h, reviewId LIMIT 500""")
def _(spark, d):
    m = B.table(spark, d, "app_metadata").select(F.col("app_dir").alias("app"), "realInstalls")
    rows = B.reviews(spark, d).where("corpus_text AND score IS NOT NULL").join(F.broadcast(m), "app", "left")
    rows = rows.select("reviewId", "app", F.col("score").cast("bigint").alias("score"), F.concat_ws("|", text.install_tier("realInstalls"), text.star_band("score")).alias("stratum"), F.col("text").alias("content_clean"))
    sheet = relational.stratified(rows, "stratum", "reviewId", 500)
    return sheet.withColumns({c: F.lit("") for c in ("gold_label", "annotator", "notes")})


@query("gold_aspects", """, g AS (SELECT reviewId, app, aspect AS predicted_aspect, triggering_sentence, sentiment_label AS predicted_sentiment, match_method, reviewId || '|' || aspect AS pair FROM a WHERE NOT is_request), k AS (SELECT *, row_number() OVER (PARTITION BY predicted_aspect ORDER BY md5(pair || '|42'), pair) AS rn FROM g)
  SELECT reviewId, app, predicted_aspect, triggering_sentence, predicted_sentiment, match_method FROM k ORDER BY CASE WHEN rn > greatest(1, 300 // (SELECT count(DISTINCT predicted_aspect) FROM g)) THEN 1 ELSE 0 END, md5(pair || '|42'), pair LIMIT 300""")
def _(spark, d):
    a = B.aspects(spark, d).where("NOT is_request").select("reviewId", "app", F.col("aspect").alias("predicted_aspect"), "triggering_sentence", F.col("sentiment_label").alias("predicted_sentiment"), "match_method", F.concat_ws("|", "reviewId", "aspect").alias("pair"))
    return relational.stratified(a, "predicted_aspect", "pair", 300).drop("pair")


@query("sheet_checks", """WITH s AS (SELECT count(*) AS n_rows, count(DISTINCT row_id) AS n_ids, count(*) FILTER (trim(coalesce(theme_code, '')) = '') AS n_blank, count(*) FILTER ((theme_code IS NULL) <> (theme IS NULL)) AS n_half, count(*) - count(DISTINCT reviewId) AS n_repeated, count(*) FILTER (reviewId NOT IN (SELECT reviewId FROM reviews WHERE reviewId IS NOT NULL)) AS n_unknown FROM rq1_tracker_negative_50) SELECT * FROM s""", base=False)
def _(spark, d):
    s = B.table(spark, d, "rq1_tracker_negative_50")
    known = relational.semi_flag(s, B.table(spark, d, "reviews").select("reviewId"), ["reviewId"], "known")
    return known.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("row_id").alias("n_ids"), F.count_if(F.trim(F.coalesce("theme_code", F.lit(""))) == "").alias("n_blank"), F.count_if(F.col("theme_code").isNull() != F.col("theme").isNull()).alias("n_half"),
        (F.count(F.lit(1)) - F.countDistinct("reviewId")).alias("n_repeated"), F.count_if(~F.col("known")).alias("n_unknown"),
    )


@query("surviving_precision", """, sh AS (SELECT DISTINCT reviewId FROM rq1_tracker_negative_50), e AS (SELECT a.aspect, a.sentiment_label = 'Negative' AS ok FROM a JOIN sh USING (reviewId) WHERE NOT is_request) SELECT aspect, count(*) AS n, round(avg(ok::INT), 6) AS precision FROM e GROUP BY aspect""")
def _(spark, d):
    sheet = B.table(spark, d, "rq1_tracker_negative_50").select("reviewId")
    a = B.aspects(spark, d).where("NOT is_request").join(sheet, "reviewId", "left_semi")
    return r6(a.groupBy("aspect").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("sentiment_label") == "Negative").cast("double")).alias("precision")))


# ---------------------------------------------------------------- figure frames
def _counted(name, sql, make):
    query(name, sql)(lambda spark, d: r6(make(spark, d)))




def _one():
    return F.count(F.lit(1)).alias("n")


_counted("fig_stars_by_label", " SELECT score::BIGINT AS score, label, count(*) AS n FROM r WHERE score IS NOT NULL GROUP BY ALL", lambda s, d: B.reviews(s, d).where("score IS NOT NULL").groupBy("score", "label").agg(_one()))
_counted("fig_months", " SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n, round(avg(score), 6) AS mean_score FROM r WHERE ts IS NOT NULL GROUP BY 1", lambda s, d: B.reviews(s, d).where("at IS NOT NULL").groupBy(scalars.month("at").alias("month")).agg(_one(), F.avg("score").alias("mean_score")))
_counted("fig_complaints", " SELECT aspect, count(*) FILTER (sentiment_label = 'Negative') AS n_negative, count(*) AS n FROM a WHERE NOT is_request GROUP BY aspect ORDER BY n_negative DESC, aspect LIMIT 10", lambda s, d: B.aspects(s, d).where("NOT is_request").groupBy("aspect").agg(F.count_if(F.col("sentiment_label") == "Negative").alias("n_negative"), _one()).orderBy(F.desc("n_negative"), "aspect").limit(10))
_counted("fig_demand", " SELECT aspect, request_type, count(*) AS n FROM d WHERE aspect IS NOT NULL GROUP BY ALL", lambda s, d: B.demands(s, d).where("aspect IS NOT NULL").groupBy("aspect", "request_type").agg(_one()))
_counted("fig_promises", " SELECT aspect, count(*) FILTER (description_claimed) AS n_claimed, count(*) FILTER (feature_present >= 1) AS n_present FROM f GROUP BY aspect", lambda s, d: B.features(s, d).groupBy("aspect").agg(F.count_if("description_claimed").alias("n_claimed"), F.count_if(F.col("feature_present") >= 1).alias("n_present")))
_counted("fig_bloat", _COUNTS + " SELECT feature_count, count(*) AS n_apps, round(avg(mean_score), 6) AS mean_score FROM z GROUP BY feature_count", lambda s, d: _counts(s, d).groupBy("feature_count").agg(F.count(F.lit(1)).alias("n_apps"), F.avg("mean_score").alias("mean_score")))
_counted("fig_tiers", """, t AS (SELECT app, CASE WHEN max(CASE WHEN aspect = 'tracker' THEN feature_present END) >= 1 THEN CASE WHEN max(CASE WHEN aspect = 'reminders' THEN feature_present END) >= 1 THEN 'extended' ELSE 'plain' END ELSE 'none' END AS tier FROM f GROUP BY app)
  SELECT tier, score::BIGINT AS score, count(*) AS n FROM r JOIN t USING (app) WHERE score IS NOT NULL GROUP BY ALL""", lambda s, d: B.reviews(s, d).where("score IS NOT NULL").join(F.broadcast(gaps.tracker_tier(B.features(s, d), "tracker", "reminders")), "app").groupBy("tier", "score").agg(_one()))  # fmt: skip
_counted("fig_affect", r""" SELECT app, count(*) AS n, round(avg(CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(guilt|anxious|anxiety|pressure|ashamed|shame|stress|depress|fail|bad about)') THEN 1.0 ELSE 0 END), 6) AS guilt, round(avg(CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(motivat|encourag|discipline|consisten|barakah|closer to allah|helpful|improve|habit)') THEN 1.0 ELSE 0 END), 6) AS motivation FROM r WHERE corpus_text GROUP BY app""",
    lambda s, d: B.reviews(s, d).where("corpus_text").groupBy("app").agg(_one(), relational.rate(F.lower("text").rlike(patterns.stems(patterns.GUILT))).alias("guilt"), relational.rate(F.lower("text").rlike(patterns.stems(patterns.MOTIVATION))).alias("motivation")))
_counted("fig_reply_delay", " SELECT floor(least(days_to_reply, 60))::BIGINT AS days, count(*) AS n FROM r WHERE days_to_reply IS NOT NULL GROUP BY 1", lambda s, d: B.reviews(s, d).where("days_to_reply IS NOT NULL").groupBy(F.floor(F.least("days_to_reply", F.lit(60.0))).alias("days")).agg(_one()))
_counted("fig_length_by_score", " SELECT score::BIGINT AS score, round(median(n_words), 6) AS median_words, round(avg(n_words), 6) AS mean_words FROM r WHERE score IS NOT NULL GROUP BY 1", lambda s, d: B.reviews(s, d).where("score IS NOT NULL").groupBy("score").agg(F.median("n_words").alias("median_words"), F.avg("n_words").alias("mean_words")))
_counted("fig_scripts", r" SELECT app, script, count(*) AS n FROM (SELECT app, CASE WHEN greatest(bn, ar, en) = 0 THEN 'unk' WHEN bn >= ar AND bn >= en THEN 'bn' WHEN ar >= en THEN 'ar' ELSE 'en' END AS script FROM (SELECT app, length(regexp_replace(text, '[^\x{980}-\x{9FF}]', '', 'g')) AS bn, length(regexp_replace(text, '[^\x{600}-\x{6FF}]', '', 'g')) AS ar, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS en FROM r)) GROUP BY ALL", lambda s, d: B.reviews(s, d).groupBy("app", text.script_guess("text").alias("script")).agg(_one()))

__all__ = ["QUERIES", "SQL"]
