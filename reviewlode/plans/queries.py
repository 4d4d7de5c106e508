"""The named queries of the review pipeline, with the SQL that checks each.

Doubles are rounded to six digits on both sides; counts are 64-bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlode.functions import scalars, text
from reviewlode.operators import absa, demand, gaps, patterns, promise, relational, temporal, topics
from reviewlode.plans import bindings as B
from reviewlode.plans.bindings import BASE_SQL, _q, _rex
from reviewlode.scorers import LexiconScorer
from reviewlode.stats import agreement, linear, small

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True):
    def deco(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (BASE_SQL + sql) if base else sql
        return f

    return deco


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six digits (no negative zero), counts to bigint."""
    out = []
    for c, t in df.dtypes:
        out.append((F.round(c, 6) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c))
    return df.select(*out)


# ---------------------------------------------------------------- corpus
@query("corpus_dedup_keep_first", " SELECT r.reviewId, r.row_id, r.app, m.title AS app_title, m.realInstalls, CAST(r.score AS BIGINT) AS score FROM r LEFT JOIN app_metadata m ON m.app_dir = r.app")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = B.table(spark, d, "app_metadata").select(F.col("app_dir").alias("app"), F.col("title").alias("app_title"), "realInstalls")
    return r6(B.reviews(spark, d).join(F.broadcast(m), "app", "left").select("reviewId", "row_id", "app", "app_title", "realInstalls", "score"))


@query("corpus_flags", " SELECT reviewId, CAST(n_words AS BIGINT) AS n_words, corpus_text, has_reply, label, round(days_to_reply, 6) AS days_to_reply FROM r")
def _(spark, d):
    return r6(B.reviews(spark, d).select("reviewId", "n_words", "corpus_text", "has_reply", "label", "days_to_reply"))


@query("star_proxy", " SELECT CASE WHEN score <= 2 THEN 'Negative' WHEN score = 3 THEN 'Neutral' WHEN score >= 4 THEN 'Positive' END AS star_label, count(*) AS n, count(*) FILTER (label IS NULL) AS n_unlabelled FROM r GROUP BY 1")
def _(spark, d):
    return B.reviews(spark, d).groupBy(text.star_label("score").alias("star_label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").isNull()).alias("n_unlabelled"))


@query("text_normalize", " SELECT reviewId, text, CAST(length(text) AS BIGINT) AS n_chars, CAST(n_words AS BIGINT) AS n_words FROM r")
def _(spark, d):
    return r6(B.reviews(spark, d).select("reviewId", "text", F.length("text").alias("n_chars"), "n_words"))


@query("sentence_explode", " SELECT reviewId, CAST(sentence_index AS BIGINT) AS sentence_index, sentence FROM s")
def _(spark, d):
    return r6(B.sentences(spark, d))


@query("clause_explode", " SELECT reviewId, clause FROM clauses")
def _(spark, d):
    return absa.clauses(B.reviews(spark, d).where("corpus_text"), "reviewId", "text").select("reviewId", "clause")


@query("script_guess", rf""" SELECT reviewId, CASE WHEN greatest(bn, ar, en) = 0 THEN 'unk' WHEN bn >= ar AND bn >= en THEN 'bn' WHEN ar >= en THEN 'ar' ELSE 'en' END AS script FROM (
  SELECT reviewId, length(regexp_replace(text, '[^\x{{980}}-\x{{9FF}}]', '', 'g')) AS bn, length(regexp_replace(text, '[^\x{{600}}-\x{{6FF}}]', '', 'g')) AS ar, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS en FROM r)""")
def _(spark, d):
    return B.reviews(spark, d).select("reviewId", text.script_guess("text").alias("script"))


@query("lang_crosstab", """ SELECT app, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END), 6) AS en, round(avg(CASE WHEN lang = 'ar' THEN 1.0 ELSE 0 END), 6) AS ar, round(avg(CASE WHEN lang = 'bn' THEN 1.0 ELSE 0 END), 6) AS bn, count(*) AS n
  FROM (SELECT app_dir AS app, lang FROM reviews WHERE lang IS NOT NULL) GROUP BY app""", )
def _(spark, d):
    rows = B.table(spark, d, "reviews").where("lang IS NOT NULL").groupBy(F.col("app_dir").alias("app"))
    return r6(rows.agg(*[relational.rate(F.col("lang") == x).alias(x) for x in ("en", "ar", "bn")], F.count(F.lit(1)).alias("n")))


@query("latin_share", r""" SELECT reviewId, round(CASE WHEN t = 0 THEN 0.0 ELSE l / t END, 6) AS latin FROM (SELECT reviewId, length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE AS t,
  length(regexp_replace(text, '[^A-Za-z\x{C0}-\x{24F}]', '', 'g')) - length(regexp_replace(text, '[^\x{D7}\x{F7}]', '', 'g'))::DOUBLE + length(regexp_replace(text, '[^\x{D7}\x{F7}]', '', 'g')) AS l FROM r)""")
def _(spark, d):
    return r6(B.reviews(spark, d).select("reviewId", text.latin_ratio("text").alias("latin")))


@query("strata", """ SELECT CASE WHEN realInstalls > 100000000 THEN '100M+' WHEN realInstalls > 10000000 THEN '10M+' WHEN realInstalls > 1000000 THEN '1M+' ELSE '<1M' END || '|' || coalesce(CASE WHEN r.score <= 2 THEN 'low' WHEN r.score = 3 THEN 'mid' ELSE 'high' END, '') AS stratum, count(*) AS n
  FROM r LEFT JOIN app_metadata m ON m.app_dir = r.app WHERE r.score IS NOT NULL GROUP BY 1""")
def _(spark, d):
    m = B.table(spark, d, "app_metadata").select(F.col("app_dir").alias("app"), "realInstalls")
    rows = B.reviews(spark, d).where("score IS NOT NULL").join(F.broadcast(m), "app", "left")
    return rows.groupBy(F.concat_ws("|", text.install_tier("realInstalls"), text.star_band("score")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("package_ids", r" SELECT row_id, coalesce(nullif(trim(package), ''), nullif(regexp_extract('https://store.example/details?hl=en&id=x.' || row_id || '&gl=us', '[?&]id=([^&]*)', 1), '')) AS package_id FROM scrape_summary")
def _(spark, d):
    s = B.table(spark, d, "scrape_summary").withColumn("link", F.concat(F.lit("https://store.example/details?hl=en&id=x."), F.col("row_id").cast("string"), F.lit("&gl=us")))
    return s.select("row_id", text.package_id("package", "link").alias("package_id"))


@query("lenient_ratings", " SELECT app_name, count(*) AS n, count(try_cast(csv_rating AS DOUBLE)) AS n_numbers, round(avg(try_cast(csv_rating AS DOUBLE)), 6) AS mean_rating FROM scrape_summary GROUP BY app_name", base=False)
def _(spark, d):
    v = F.expr("try_cast(csv_rating AS double)")
    return r6(B.table(spark, d, "scrape_summary").groupBy("app_name").agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("n_numbers"), F.avg(v).alias("mean_rating")))


@query("app_age", """ SELECT reviewId, CAST(datediff('day', rel, CAST(ts AS DATE)) AS BIGINT) AS app_age FROM r JOIN (SELECT app_dir, CAST(coalesce(try_strptime(released, '%b %d, %Y'), try_strptime(released, '%Y-%m-%d'), try_strptime(released, '%d/%m/%Y')) AS DATE) AS rel FROM app_metadata) m ON m.app_dir = r.app""")
def _(spark, d):
    m = B.table(spark, d, "app_metadata").select(F.col("app_dir").alias("app"), scalars.lenient_timestamp("released").alias("rel"))
    return B.reviews(spark, d).join(F.broadcast(m), "app").select("reviewId", F.date_diff(F.to_date("at"), F.to_date("rel")).cast("bigint").alias("app_age"))


_KEY = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]', '', 'g')"
_LEAD = r"regexp_replace(lower(regexp_extract({0}, '^([^–—\-:|(]*)', 1)), '[^\p{{L}}\p{{N}}_]', '', 'g')"


@query("entity_resolve", f"""WITH n AS (SELECT name, {_KEY.format('name')} AS key, {_LEAD.format('name')} AS lead FROM (SELECT DISTINCT app_name AS name FROM scrape_summary)),
  k AS (SELECT appId AS package, {_KEY.format('title')} AS key, {_LEAD.format('title')} AS lead FROM app_metadata WHERE title IS NOT NULL),
  sub AS (SELECT name, min(package) AS p FROM n JOIN k ON length(n.key) > 3 AND length(k.key) > 3 AND (contains(n.key, k.key) OR contains(k.key, n.key)) GROUP BY name HAVING count(DISTINCT package) = 1),
  l AS (SELECT lead, min(package) AS p FROM k WHERE lead <> '' GROUP BY lead HAVING count(*) = 1)
  SELECT n.name, coalesce((SELECT min(package) FROM k WHERE k.key = n.key), sub.p, l.p) AS resolved FROM n LEFT JOIN sub USING (name) LEFT JOIN l ON l.lead = n.lead""", base=False)
def _(spark, d):
    names = B.table(spark, d, "scrape_summary").select(F.col("app_name").alias("name")).distinct()
    names = names.select("name", text.app_key("name").alias("key"), text.brand_lead("name").alias("lead"), F.lit(None).cast("string").alias("package"))
    known = B.table(spark, d, "app_metadata").where("title IS NOT NULL").select(F.col("appId").alias("package"), text.app_key("title").alias("key"), text.brand_lead("title").alias("lead"))
    return relational.resolve_names(names, known)


# ---------------------------------------------------------------- aspects
@query("lexicon_tag", " SELECT reviewId, CAST(sentence_index AS BIGINT) AS sentence_index, aspect FROM tagged")
def _(spark, d):
    return r6(absa.tag_sentences(B.sentences(spark, d), B.PATTERNS).select("reviewId", "sentence_index", "aspect"))


@query("lexicon_unmatched", " SELECT reviewId, CAST(sentence_index AS BIGINT) AS sentence_index FROM s ANTI JOIN tagged USING (reviewId, sentence_index)")
def _(spark, d):
    s = B.sentences(spark, d)
    return r6(absa.unmatched(s, absa.tag_sentences(s, B.PATTERNS), "reviewId").select("reviewId", "sentence_index"))


@query("lexicon_hit_rate", " SELECT count(*) AS n_sentences, (SELECT count(DISTINCT reviewId || '#' || sentence_index) FROM tagged) AS n_matched, (SELECT count(*) FROM tagged) AS n_pairs FROM s")
def _(spark, d):
    s = B.sentences(spark, d).withColumn("k", F.size(patterns.tags(F.lower("sentence"), B.PATTERNS)))
    return s.agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if(F.col("k") > 0).alias("n_matched"), F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("n_pairs"))


@query("request_handling", " SELECT aspect, count(*) AS n, count(*) FILTER (is_request) AS n_requests, count(*) FILTER (has_negation) AS n_negated FROM pairs GROUP BY aspect")
def _(spark, d):
    return B.pairs(spark, d).groupBy("aspect").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_request").alias("n_requests"), F.count_if("has_negation").alias("n_negated"))


@query("dua_like_dominance", rf""" SELECT row_id, round(CASE WHEN t = 0 THEN 0.0 ELSE k / t END, 6) AS kept_share FROM (SELECT row_id, length(regexp_replace(low, '[^\p{{L}}]', '', 'g'))::DOUBLE AS t,
  length(regexp_replace(regexp_replace(low, '{B.SQL_DEVOTIONAL}', '', 'g'), '[^\p{{L}}]', '', 'g')) AS k FROM (SELECT row_id, lower(replyContent) AS low FROM r WHERE replyContent IS NOT NULL))""")
def _(spark, d):
    rows = B.reviews(spark, d).where("replyContent IS NOT NULL")
    return r6(rows.select("row_id", text.devotional_share(F.lower("replyContent"), patterns.DEVOTIONAL).alias("kept_share")))


@query("aspect_aggregate", """ SELECT reviewId, aspect, round(prob_neg, 6) AS prob_neg, round(prob_neu, 6) AS prob_neu, round(prob_pos, 6) AS prob_pos, n_sentences, triggering_sentence, match_method, has_negation,
  CASE WHEN prob_neg >= prob_neu AND prob_neg >= prob_pos THEN 'Negative' WHEN prob_neu >= prob_pos THEN 'Neutral' ELSE 'Positive' END AS sentiment_label FROM scored""")
def _(spark, d):
    out = absa.aspect_table(LexiconScorer()(B.pairs(spark, d)), "reviewId")
    return r6(out.where("NOT is_request").drop("is_request"))


@query("request_rows", " SELECT reviewId, aspect, n_sentences, triggering_sentence, has_negation FROM a WHERE is_request")
def _(spark, d):
    return absa.request_rows(B.pairs(spark, d), "reviewId").select("reviewId", "aspect", "n_sentences", "triggering_sentence", "has_negation")


@query("aspect_coverage", """ SELECT aspect, count(DISTINCT reviewId) AS n_reviews, round(avg(CASE WHEN sentiment_label = 'Negative' THEN 1.0 ELSE 0 END), 6) AS neg_rate,
  round(count(DISTINCT reviewId) / (SELECT count(*) FROM r WHERE corpus_text)::DOUBLE, 6) AS share FROM a WHERE NOT is_request GROUP BY aspect""")
def _(spark, d):
    total = B.reviews(spark, d).where("corpus_text").agg(F.count(F.lit(1)).alias("total_"))
    per = B.aspects(spark, d).where("NOT is_request").groupBy("aspect").agg(F.countDistinct("reviewId").alias("n_reviews"), relational.rate(F.col("sentiment_label") == "Negative").alias("neg_rate"))
    return r6(per.join(F.broadcast(total.withColumn("k_", F.lit(1))), F.lit(1) == F.col("k_")).select("aspect", "n_reviews", "neg_rate", (F.col("n_reviews") / F.col("total_")).alias("share")))


@query("star_masking", """ SELECT aspect, count(DISTINCT reviewId) AS n FROM a WHERE sentiment_label = 'Negative' AND score BETWEEN 4 AND 5 AND aspect IN ('prayer_times', 'qibla', 'travel', 'reminders') GROUP BY aspect""")
def _(spark, d):
    a = B.aspects(spark, d).where((F.col("sentiment_label") == "Negative") & F.col("score").between(4, 5) & F.col("aspect").isin("prayer_times", "qibla", "travel", "reminders"))
    return a.groupBy("aspect").agg(F.countDistinct("reviewId").alias("n"))


@query("high_star_divergence", " SELECT aspect, count(*) AS n FROM a WHERE sentiment_label = 'Negative' AND reviewId IN (SELECT reviewId FROM r WHERE score >= 4) GROUP BY aspect")
def _(spark, d):
    high = B.reviews(spark, d).where("score >= 4").select("reviewId")
    return B.aspects(spark, d).where("sentiment_label = 'Negative'").join(high, "reviewId", "left_semi").groupBy("aspect").agg(F.count(F.lit(1)).alias("n"))


@query("aspect_families", """ SELECT CASE WHEN aspect IN ('prayer_times', 'qibla', 'travel') THEN 'accuracy' WHEN aspect IN ('ui', 'ads', 'widgets') THEN 'comparison' ELSE 'other' END AS family, count(DISTINCT reviewId) AS n_reviews, count(*) FILTER (sentiment_label = 'Negative') AS n_negative FROM a GROUP BY 1""")
def _(spark, d):
    fam = F.when(F.col("aspect").isin("prayer_times", "qibla", "travel"), "accuracy").when(F.col("aspect").isin("ui", "ads", "widgets"), "comparison").otherwise("other")
    return B.aspects(spark, d).groupBy(fam.alias("family")).agg(F.countDistinct("reviewId").alias("n_reviews"), F.count_if(F.col("sentiment_label") == "Negative").alias("n_negative"))


@query("design_matrix", " SELECT r.reviewId, " + ", ".join(f"coalesce(max(CASE WHEN aspect = '{x.name}' AND NOT is_request THEN 1 END), 0)::BIGINT AS mentions_{x.name}, coalesce(max(CASE WHEN aspect = '{x.name}' AND sentiment_label = 'Negative' THEN 1 END), 0)::BIGINT AS complaint_{x.name}" for x in B.LEXICON) + ", round(ln(1 + any_value(n_words)), 6) AS log_words, any_value(CASE label WHEN 'Negative' THEN -1.0 WHEN 'Neutral' THEN 0.0 WHEN 'Positive' THEN 1.0 END) AS sent_num FROM (SELECT * FROM r WHERE corpus_text) r LEFT JOIN a USING (reviewId) GROUP BY r.reviewId")
def _(spark, d):
    return r6(gaps.design(B.reviews(spark, d), B.aspects(spark, d), [x.name for x in B.LEXICON]).drop("app", "score", "has_reply"))


@query("cooccurrence_2x2", """, m AS (SELECT reviewId, coalesce(max(CASE WHEN aspect = 'ads' THEN 1 END), 0) AS x, coalesce(max(CASE WHEN aspect = 'ui' THEN 1 END), 0) AS y FROM (SELECT reviewId FROM r WHERE corpus_text) LEFT JOIN (SELECT * FROM a WHERE NOT is_request) USING (reviewId) GROUP BY reviewId)
  SELECT sum(x * y)::BIGINT AS both, sum(x * (1 - y))::BIGINT AS only_a, sum((1 - x) * y)::BIGINT AS only_b, sum((1 - x) * (1 - y))::BIGINT AS neither, round((sum(x * y) / nullif(sum(y), 0)) / nullif(avg(x), 0), 6) + 0.0 AS lift FROM m""")
def _(spark, d):
    return r6(gaps.cooccurrence(B.reviews(spark, d).where("corpus_text"), B.aspects(spark, d).where("NOT is_request"), "reviewId", "ads", "ui"))


@query("same_evidence_split", """, p AS (SELECT reviewId, triggering_sentence, bool_or(aspect = 'ads') AS x, bool_or(aspect = 'ui') AS y FROM a WHERE NOT is_request AND aspect IN ('ads', 'ui') GROUP BY ALL),
  v AS (SELECT reviewId, bool_or(x AND y) AS same, bool_or(x) AND bool_or(y) AS xy FROM p GROUP BY reviewId) SELECT count(*) FILTER (xy) AS n_both, count(*) FILTER (same) AS n_same_evidence FROM v""")
def _(spark, d):
    return gaps.same_group(B.aspects(spark, d).where("NOT is_request"), "reviewId", "triggering_sentence", "ads", "ui").withColumnRenamed("n_same", "n_same_evidence")


@query("same_sentence_split", """, p AS (SELECT reviewId, sentence_index, bool_or(aspect = 'ads') AS x, bool_or(aspect = 'ui') AS y FROM pairs WHERE aspect IN ('ads', 'ui') GROUP BY ALL),
  v AS (SELECT reviewId, bool_or(x AND y) AS same, bool_or(x) AND bool_or(y) AS xy FROM p GROUP BY reviewId) SELECT count(*) FILTER (xy) AS n_both, count(*) FILTER (same) AS n_same FROM v""")
def _(spark, d):
    return gaps.same_group(B.pairs(spark, d), "reviewId", "sentence_index", "ads", "ui")


@query("guilt_motivation_2x2", f" SELECT count(*) FILTER (x AND y) AS n_both, count(*) FILTER (x AND NOT y) AS n_a, count(*) FILTER (NOT x AND y) AS n_b, count(*) FILTER (NOT x AND NOT y) AS n_neither FROM (SELECT regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(guilt|anxious|anxiety|pressure|ashamed|shame|stress|depress|fail|bad about)') AS x, regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(motivat|encourag|discipline|consisten|barakah|closer to allah|helpful|improve|habit)') AS y FROM r WHERE corpus_text)")
def _(spark, d):
    return gaps.pattern_2x2(B.reviews(spark, d).where("corpus_text"), "text", patterns.stems(patterns.GUILT), patterns.stems(patterns.MOTIVATION))


@query("tracker_tier", """, t AS (SELECT app, CASE WHEN max(CASE WHEN aspect = 'tracker' THEN feature_present END) >= 1 THEN CASE WHEN max(CASE WHEN aspect = 'reminders' THEN feature_present END) >= 1 THEN 'extended' ELSE 'plain' END ELSE 'none' END AS tier FROM f GROUP BY app)
  SELECT tier, count(*) AS n_reviews, round(avg(score), 6) AS mean_score FROM r JOIN t USING (app) GROUP BY tier""")
def _(spark, d):
    t = gaps.tracker_tier(B.features(spark, d), "tracker", "reminders")
    return r6(B.reviews(spark, d).join(t, "app").groupBy("tier").agg(F.count(F.lit(1)).alias("n_reviews"), F.avg("score").alias("mean_score")))


@query("app_name_stopwords", r" SELECT DISTINCT w AS word FROM (SELECT unnest(string_split_regex(lower(title), '[^\p{L}\p{N}]+')) AS w FROM app_metadata WHERE title IS NOT NULL) WHERE length(w) > 2", base=False)
def _(spark, d):
    return topics.name_stopwords(B.table(spark, d, "app_metadata"), "title")


# ---------------------------------------------------------------- demand
@query("demand_families", " SELECT reviewId, clause, request_type FROM fam")
def _(spark, d):
    return demand.families(absa.clauses(B.reviews(spark, d).where("corpus_text"), "reviewId", "text")).select("reviewId", "clause", "request_type")


@query("demand_attach", " SELECT reviewId, evidence_sentence, request_type, aspect, app FROM d")
def _(spark, d):
    return B.demands(spark, d).select("reviewId", "evidence_sentence", "request_type", "aspect", "app")


@query("demand_flagged", """, q AS (SELECT DISTINCT reviewId, aspect FROM a WHERE is_request) SELECT request_type, count(*) AS n, count(*) FILTER (q.aspect IS NOT NULL) AS n_flagged FROM d LEFT JOIN q ON q.reviewId = d.reviewId AND q.aspect = d.aspect GROUP BY 1""")
def _(spark, d):
    req = B.aspects(spark, d).where("is_request")
    return demand.flag_shared(B.demands(spark, d), req, "reviewId").groupBy("request_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("absa_flagged_request").alias("n_flagged"))


@query("demand_summary", " SELECT request_type, count(*) AS n, count(DISTINCT reviewId) AS n_reviews, count(aspect) AS n_with_aspect FROM d GROUP BY 1")
def _(spark, d):
    return demand.summary(B.demands(spark, d), "reviewId")


_TAX = {k: v for k, v in patterns.QIBLA_FAILURES.items()} | {f"travel_{k}": v for k, v in patterns.TRAVEL_FAILURES.items()}


@query("failure_taxonomy", ", z AS (SELECT lower(triggering_sentence) AS low FROM a WHERE aspect IN ('qibla', 'travel') AND sentiment_label = 'Negative') " + " UNION ALL ".join(f"SELECT '{n}' AS kind, count(*) FILTER (regexp_matches(low, '{_q(p)}')) AS n FROM z" for n, p in _TAX.items()))
def _(spark, d):
    a = B.aspects(spark, d).where(F.col("aspect").isin("qibla", "travel") & (F.col("sentiment_label") == "Negative"))
    wide = patterns.taxonomy(a, "triggering_sentence", _TAX).agg(*[F.count_if(n).alias(n) for n in _TAX])
    return wide.unpivot([], list(_TAX), "kind", "n")


# ---------------------------------------------------------------- promises and gaps
@query("promise_first_evidence", " SELECT app, aspect, description_claimed, description_evidence, n_segments FROM cells")
def _(spark, d):
    return r6(B.features(spark, d).select("app", "aspect", "description_claimed", "description_evidence", "n_segments"))


@query("combine_sources", " SELECT app, aspect, csv_annotated, feature_present, promise_source, source_agreement FROM f")
def _(spark, d):
    return B.features(spark, d).select("app", "aspect", "csv_annotated", "feature_present", "promise_source", "source_agreement")


@query("source_agreement", """, c AS (SELECT aspect, csv_annotated >= 1 AS x, description_claimed AS y FROM f WHERE csv_annotated IS NOT NULL),
  g AS (SELECT aspect, count(*) AS n_apps, count(*) FILTER (x) AS csv_present, count(*) FILTER (y) AS description_present, avg((x = y)::INT) AS po, avg(x::INT) * avg(y::INT) + (1 - avg(x::INT)) * (1 - avg(y::INT)) AS pe,
    count(*) FILTER (x AND NOT y) AS description_misses, count(*) FILTER (NOT x AND y) AS description_overclaims FROM c GROUP BY aspect)
  SELECT aspect, n_apps, csv_present, description_present, round(po, 6) AS agreement, description_misses, description_overclaims, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) + 0.0 AS cohens_kappa FROM g""")
def _(spark, d):
    return r6(promise.source_agreement(B.features(spark, d)))


@query("monetization_contradiction", """ SELECT m.app_dir AS app, coalesce(c.claims_free, FALSE) AS claims_free, coalesce(adSupported, FALSE) OR coalesce(offersIAP, FALSE) AS monetized, coalesce(c.claims_free, FALSE) AND (coalesce(adSupported, FALSE) OR coalesce(offersIAP, FALSE)) AS claims_free_but_monetized
  FROM app_metadata m LEFT JOIN (SELECT app, bool_or(aspect = 'subscription' AND description_claimed) AS claims_free FROM cells GROUP BY app) c ON c.app = m.app_dir""")
def _(spark, d):
    claims = B.features(spark, d).groupBy("app").agg(F.bool_or((F.col("aspect") == "subscription") & F.col("description_claimed")).alias("claims_free"))
    m = B.table(spark, d, "app_metadata").withColumnRenamed("app_dir", "app")
    return promise.monetisation_contradiction(m, claims, "app").select("app", "claims_free", "monetized", "claims_free_but_monetized")


GAP_SQL = """, per AS (SELECT app, aspect, count(DISTINCT reviewId) AS n_mentions, count(*) FILTER (sentiment_label = 'Negative') AS n_negative FROM a WHERE NOT is_request GROUP BY app, aspect),
  dem AS (SELECT app, aspect, count(DISTINCT reviewId) AS demand_signals FROM d WHERE aspect IS NOT NULL AND request_type IN ('request', 'absence') GROUP BY app, aspect),
  gap AS (SELECT f.app, f.aspect, f.feature_present, f.promise_source, coalesce(n_mentions, 0) AS n_mentions, coalesce(n_negative, 0) AS n_negative, n_negative / n_mentions::DOUBLE AS neg_rate, coalesce(demand_signals, 0) AS demand_signals, f.feature_present >= 1 AS promised,
    coalesce(f.feature_present >= 1 AND n_mentions >= 30 AND n_negative / n_mentions::DOUBLE > 0.40, FALSE) AS broken_promise FROM f LEFT JOIN per USING (app, aspect) LEFT JOIN dem USING (app, aspect))"""


def gap(spark, d):
    return gaps.gap_matrix(B.features(spark, d), B.aspects(spark, d), B.demands(spark, d))


@query("q28_gap_matrix", GAP_SQL + " SELECT app, aspect, feature_present, promise_source, n_mentions, n_negative, round(neg_rate, 6) AS neg_rate, demand_signals, promised, broken_promise FROM gap")
def _(spark, d):
    return r6(gap(spark, d))


@query("unmet_ranking", GAP_SQL + " SELECT aspect, count(*) AS apps_lacking, sum(demand_signals)::BIGINT AS demand_volume, sum(n_negative)::BIGINT AS negative_mentions, (sum(demand_signals) * count(*))::BIGINT AS unmet_score FROM gap WHERE NOT promised GROUP BY aspect")
def _(spark, d):
    return r6(gaps.unmet(gap(spark, d)))


@query("served_well", GAP_SQL + """ SELECT aspect, round(avg(feature_present), 6) AS coverage, round(avg(neg_rate), 6) AS mean_neg_rate, count(*) FILTER (broken_promise) AS n_broken, round(count(*) FILTER (broken_promise) / nullif(count(*) FILTER (promised), 0)::DOUBLE, 6) AS broken_share,
  coalesce(avg(feature_present) > 0.5 AND avg(neg_rate) < 0.30, FALSE) AS served_well FROM gap GROUP BY aspect""")
def _(spark, d):
    return r6(gaps.served(gap(spark, d)))


@query("unmet_evidence", GAP_SQL + """, top AS (SELECT aspect, sum(demand_signals) * count(*) AS score FROM gap WHERE NOT promised GROUP BY aspect ORDER BY score DESC, aspect LIMIT 8)
  SELECT aspect, evidence_sentence FROM (SELECT aspect, evidence_sentence, row_number() OVER (PARTITION BY aspect ORDER BY length(evidence_sentence), evidence_sentence) AS rn FROM (SELECT DISTINCT aspect, evidence_sentence FROM d WHERE request_type = 'request' AND aspect IN (SELECT aspect FROM top))) WHERE rn <= 2""")
def _(spark, d):
    top = gaps.unmet(gap(spark, d)).orderBy(F.desc("unmet_score"), "aspect").limit(8).select("aspect")
    ev = B.demands(spark, d).where("request_type = 'request'").join(F.broadcast(top), "aspect", "left_semi").select("aspect", "evidence_sentence").distinct()
    return relational.top_per_group(ev, ["aspect"], [F.length("evidence_sentence").asc(), F.asc("evidence_sentence")], 2)


@query("app_comparison", """ SELECT r.app, count(*) AS n_reviews, round(avg(r.score), 6) AS mean_score, round(avg(CASE label WHEN 'Negative' THEN -1.0 WHEN 'Neutral' THEN 0.0 WHEN 'Positive' THEN 1.0 END), 6) AS mean_sentiment, round(avg(CASE WHEN label = 'Negative' THEN 1.0 ELSE 0 END), 6) AS pct_negative, round(median(n_words), 6) AS median_words,
  round(avg(CASE WHEN has_reply THEN 1.0 ELSE 0 END), 6) AS reply_rate, round(median(days_to_reply), 6) AS median_days_to_reply, any_value(m.realInstalls) AS realInstalls, any_value(fc.feature_count) AS feature_count FROM r LEFT JOIN app_metadata m ON m.app_dir = r.app LEFT JOIN (SELECT app, sum(feature_present) AS feature_count FROM f GROUP BY app) fc ON fc.app = r.app GROUP BY r.app""")
def _(spark, d):
    return r6(gaps.app_comparison(B.reviews(spark, d), B.features(spark, d), B.table(spark, d, "app_metadata").select(F.col("app_dir").alias("app"), "realInstalls")))


@query("dev_response", """ SELECT app, count(*) AS n_reviews, count(*) FILTER (has_reply) AS n_replied, round(avg(CASE WHEN has_reply THEN 1.0 ELSE 0 END), 6) AS reply_rate, round(avg(CASE WHEN has_reply THEN score END), 6) AS score_replied, round(avg(CASE WHEN NOT has_reply THEN score END), 6) AS score_unreplied, round(median(days_to_reply), 6) AS median_days FROM r GROUP BY app""")
def _(spark, d):
    return r6(gaps.developer_response(B.reviews(spark, d)))


@query("loyalty", """, k AS (SELECT app, count(DISTINCT CASE WHEN request_type = 'tenure' THEN reviewId END) AS tenure, count(DISTINCT CASE WHEN request_type = 'churn' THEN reviewId END) AS churn FROM d GROUP BY app)
  SELECT r.app, count(*) AS n, round(coalesce(any_value(k.tenure), 0) / count(*)::DOUBLE, 6) AS tenure_rate, round(coalesce(any_value(k.churn), 0) / count(*)::DOUBLE, 6) AS churn_rate, round(avg(thumbsUpCount), 6) AS mean_thumbs,
  round(CASE WHEN count(*) > 100 AND count(CASE WHEN score IS NOT NULL THEN ts END) > 50 AND max(ts) > min(ts) THEN regr_slope(score, epoch_us(ts) / 86400000000.0) * 365 END, 6) + 0.0 AS score_slope FROM (SELECT * FROM r WHERE corpus_text) r LEFT JOIN k ON k.app = r.app GROUP BY r.app""")
def _(spark, d):
    return r6(gaps.loyalty(B.reviews(spark, d).where("corpus_text"), B.demands(spark, d)))


@query("citation_rate", """, m AS (SELECT aspect, count(DISTINCT reviewId) AS x FROM a GROUP BY aspect), k AS (SELECT aspect, count(DISTINCT reviewId) AS y FROM d WHERE request_type = 'preference' AND aspect IS NOT NULL GROUP BY aspect)
  SELECT coalesce(m.aspect, k.aspect) AS aspect, coalesce(x, 0) AS mentions, coalesce(y, 0) AS citations, round(coalesce(y, 0) / nullif(coalesce(x, 0), 0)::DOUBLE, 6) AS citation_rate FROM m FULL JOIN k ON m.aspect = k.aspect""")
def _(spark, d):
    return r6(gaps.citation_rate(B.aspects(spark, d), B.demands(spark, d)))


@query("feature_contrast", """, h AS (SELECT app, max(feature_present) >= 1 AS has FROM f WHERE aspect = 'travel' GROUP BY app)
  SELECT coalesce(has, FALSE) AS has_feature, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN label = 'Negative' THEN 1.0 ELSE 0 END), 6) AS pct_negative FROM r LEFT JOIN h USING (app) GROUP BY 1""")
def _(spark, d):
    return r6(gaps.with_without(B.reviews(spark, d), B.features(spark, d), "travel"))


@query("absent_feature_demand", """ SELECT app, count(DISTINCT reviewId) AS n FROM d WHERE aspect = 'widgets' AND app NOT IN (SELECT app FROM f WHERE aspect = 'widgets' AND feature_present >= 1) GROUP BY app""")
def _(spark, d):
    have = B.features(spark, d).where("aspect = 'widgets' AND feature_present >= 1").select("app")
    return B.demands(spark, d).where("aspect = 'widgets'").join(have, "app", "left_anti").groupBy("app").agg(F.countDistinct("reviewId").alias("n"))


@query("family_pivot", " SELECT app, " + ", ".join(f"count(DISTINCT CASE WHEN request_type = '{n}' THEN reviewId END) AS {n}" for n in patterns.FAMILIES) + " FROM d GROUP BY app")
def _(spark, d):
    p = B.demands(spark, d).groupBy("app").pivot("request_type", list(patterns.FAMILIES)).agg(F.countDistinct("reviewId"))
    return p.fillna(0)


@query("complaint_rates", """, n AS (SELECT app, count(*) AS n FROM r WHERE corpus_text GROUP BY app), fc AS (SELECT app, sum(feature_present) AS feature_count FROM f GROUP BY app),
  z AS (SELECT n.app, feature_count, round(count(DISTINCT CASE WHEN aspect = 'battery' AND sentiment_label = 'Negative' THEN reviewId END) / any_value(n.n)::DOUBLE, 6) AS battery_rate FROM n JOIN fc USING (app) LEFT JOIN a ON a.app = n.app GROUP BY n.app, feature_count)
  SELECT * FROM (SELECT 'leanest' AS side, * FROM z ORDER BY feature_count, app LIMIT 5) UNION ALL SELECT * FROM (SELECT 'fullest' AS side, * FROM z ORDER BY feature_count DESC, app LIMIT 5)""")
def _(spark, d):
    z = gaps.complaint_rate(B.reviews(spark, d).where("corpus_text"), B.features(spark, d), B.aspects(spark, d), "battery", "battery_rate")
    lean, full = z.orderBy("feature_count", "app").limit(5), z.orderBy(F.desc("feature_count"), "app").limit(5)
    return r6(lean.select(F.lit("leanest").alias("side"), "*").unionByName(full.select(F.lit("fullest").alias("side"), "*")))


# ---------------------------------------------------------------- time
@query("monthly_trends", """, m AS (SELECT app, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n, avg(score) AS mean_score, avg(CASE label WHEN 'Negative' THEN -1.0 WHEN 'Neutral' THEN 0.0 WHEN 'Positive' THEN 1.0 END) AS mean_sentiment,
    avg(CASE WHEN label = 'Negative' THEN 1.0 ELSE 0 END) AS pct_negative, avg(CASE WHEN label = 'Positive' THEN 1.0 ELSE 0 END) AS pct_positive, avg(CASE WHEN has_reply THEN 1.0 ELSE 0 END) AS reply_rate, median(n_words) AS median_words FROM r WHERE ts IS NOT NULL GROUP BY 1, 2)
  SELECT app, month, n, round(mean_score, 6) AS mean_score, round(mean_sentiment, 6) + 0.0 AS mean_sentiment, round(pct_negative, 6) AS pct_negative, round(pct_positive, 6) AS pct_positive, round(reply_rate, 6) AS reply_rate, round(median_words, 6) AS median_words, """ + ", ".join(f"round(CASE WHEN count({c}) OVER w >= 2 THEN avg({c}) OVER w END, 6) + 0.0 AS {c}_roll3" for c in ("mean_score", "mean_sentiment", "pct_negative")) + ", n < 20 AS sparse FROM m WINDOW w AS (PARTITION BY app ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    return r6(temporal.monthly(B.reviews(spark, d)))


@query("aspect_quarterly", """, q AS (SELECT reviewId, CAST(date_trunc('quarter', ts) AS DATE) AS quarter FROM r WHERE ts IS NOT NULL), t AS (SELECT quarter, count(DISTINCT reviewId) AS total_reviews FROM q GROUP BY 1)
  SELECT quarter, aspect, count(DISTINCT a.reviewId) AS mentions, round(avg(CASE WHEN sentiment_label = 'Negative' THEN 1.0 ELSE 0 END), 6) AS pct_negative, any_value(total_reviews) AS total_reviews, round(count(DISTINCT a.reviewId) / any_value(total_reviews)::DOUBLE, 6) AS mention_rate FROM a JOIN q USING (reviewId) JOIN t USING (quarter) GROUP BY quarter, aspect""")
def _(spark, d):
    return r6(temporal.aspect_quarterly(B.reviews(spark, d), B.aspects(spark, d), "reviewId"))


@query("version_flags", """, v AS (SELECT app, version, count(*) AS n, min(ts) AS first_seen, avg(score) AS mean_score, avg(CASE label WHEN 'Negative' THEN -1.0 WHEN 'Neutral' THEN 0.0 WHEN 'Positive' THEN 1.0 END) AS mean_sentiment, avg(CASE WHEN label = 'Negative' THEN 1.0 ELSE 0 END) AS pct_negative
    FROM r WHERE version IS NOT NULL GROUP BY app, version HAVING count(*) >= 3), m AS (SELECT app, median(mean_sentiment) AS md FROM v GROUP BY app)
  SELECT app, version, n, first_seen, round(mean_score, 6) AS mean_score, round(mean_sentiment, 6) + 0.0 AS mean_sentiment, round(pct_negative, 6) AS pct_negative, round(md, 6) + 0.0 AS app_median_sentiment, round(mean_sentiment - md, 6) + 0.0 AS sentiment_delta, coalesce(mean_sentiment - md < -0.15, FALSE) AS flagged_drop FROM v JOIN m USING (app)""")
def _(spark, d):
    # versions of the test tables have few reviews each; the operator's own floor is 30
    return r6(temporal.versions(B.reviews(spark, d), least=3).withColumn("first_seen", F.col("first_seen").cast("timestamp_ntz")))


ITS_SQL = """, h AS (SELECT DISTINCT reviewId FROM a WHERE aspect = 'subscription'), its AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n, count(h.reviewId) AS mentions, avg(CASE label WHEN 'Negative' THEN -1.0 WHEN 'Neutral' THEN 0.0 WHEN 'Positive' THEN 1.0 END) AS mean_sentiment, avg(score) AS mean_score FROM r LEFT JOIN h USING (reviewId) WHERE ts IS NOT NULL GROUP BY 1),
  its2 AS (SELECT *, mentions / n::DOUBLE AS rate, (year(month) - 2024) * 12 + month(month) - 1 AS months_from_event FROM its)"""


@query("its_monthly", ITS_SQL + " SELECT month, n, mentions, round(mean_sentiment, 6) + 0.0 AS mean_sentiment, round(mean_score, 6) AS mean_score, round(rate, 6) AS rate, months_from_event, CASE WHEN months_from_event > 0 THEN 'post' ELSE 'pre' END AS period FROM its2 WHERE months_from_event BETWEEN -12 AND 12")
def _(spark, d):
    hits = B.aspects(spark, d).where("aspect = 'subscription'")
    return r6(temporal.interrupted(B.reviews(spark, d), hits, "reviewId", 2024, 1))


@query("its_slope", ITS_SQL + " SELECT round(sum(n * (x - mx) * (rate - my)) / sum(n * (x - mx) * (x - mx)), 6) + 0.0 AS slope FROM (SELECT n, rate, months_from_event AS x, sum(n * months_from_event) OVER () / sum(n) OVER ()::DOUBLE AS mx, sum(n * rate) OVER () / sum(n) OVER () AS my FROM its2 WHERE months_from_event BETWEEN -12 AND 12)")
def _(spark, d):
    hits = B.aspects(spark, d).where("aspect = 'subscription'")
    fit, _n = linear.weighted_trend(temporal.interrupted(B.reviews(spark, d), hits, "reviewId", 2024, 1), "rate", ["months_from_event"], "n")
    return r6(spark.createDataFrame([(fit[1] if fit else None,)], "slope double"))


@query("events_daily", """ SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean_value, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2""", base=False)
def _(spark, d):
    return r6(B.table(spark, d, "events").groupBy(F.to_date(F.date_trunc("day", "ts")).alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.countDistinct("user_id").alias("n_users")))


# ---------------------------------------------------------------- agreement and precision
_RATED = """, z AS (SELECT reviewId, app, CASE WHEN score <= 2 THEN 'Negative' WHEN score = 3 THEN 'Neutral' WHEN score >= 4 THEN 'Positive' END AS x, CASE WHEN ng > ps THEN 'Negative' WHEN ps > ng THEN 'Positive' ELSE 'Neutral' END AS y, (abs(ps - ng) + 1) / (ps + ng + 1.0) AS conf FROM
  (SELECT reviewId, app, score, len(list_filter(w, lambda t: t IN (POS)))  AS ps, len(list_filter(w, lambda t: t IN (NEG))) AS ng FROM (SELECT *, string_split_regex(lower(text), '[^a-z]+') AS w FROM r WHERE corpus_text)))""".replace("(POS)", f"({B._POS})").replace("(NEG)", f"({B._NEG})")


def rated(spark, d):
    r = B.reviews(spark, d).where("corpus_text")
    s = LexiconScorer()(r.withColumn("sentence", F.col("text")))
    y = F.when(F.col("p_neg") > F.col("p_pos"), "Negative").when(F.col("p_pos") > F.col("p_neg"), "Positive").otherwise("Neutral")
    return s.select("reviewId", "app", text.star_label("score").alias("x"), y.alias("y"), (F.abs(F.col("p_pos") - F.col("p_neg")) + F.col("p_neu")).alias("conf"))


_KAPPA = """SELECT {g} count(*) AS n, avg((x = y)::INT) AS po, avg((x = 'Negative')::INT) * avg((y = 'Negative')::INT) + avg((x = 'Neutral')::INT) * avg((y = 'Neutral')::INT) + avg((x = 'Positive')::INT) * avg((y = 'Positive')::INT) AS pe FROM z WHERE x IS NOT NULL"""


@query("kappa", _RATED + " SELECT round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) + 0.0 AS cohens_kappa FROM (" + _KAPPA.format(g="") + ")")
def _(spark, d):
    return r6(agreement.kappa(rated(spark, d), "x", "y", []))


@query("kappa_by_app", _RATED + " SELECT app, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) + 0.0 AS cohens_kappa FROM (" + _KAPPA.format(g="app,") + " GROUP BY app)")
def _(spark, d):
    return r6(agreement.kappa(rated(spark, d), "x", "y", ["app"]))


@query("confusion_norm", _RATED + " SELECT x, y, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY x)::DOUBLE, 6) AS share FROM z WHERE x IS NOT NULL GROUP BY x, y")
def _(spark, d):
    return r6(agreement.confusion(rated(spark, d), "x", "y"))


@query("prf", _RATED + """, t AS (SELECT x AS label, count(*) AS support, count(*) FILTER (x = y) AS hit FROM z WHERE x IS NOT NULL GROUP BY x), g AS (SELECT y AS label, count(*) AS guessed FROM z WHERE x IS NOT NULL GROUP BY y), pr AS (SELECT label, support, coalesce(hit / guessed::DOUBLE, 0) AS p, hit / support::DOUBLE AS rc FROM t LEFT JOIN g USING (label))
  SELECT label, support, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1 FROM pr""")
def _(spark, d):
    return r6(agreement.precision_recall(rated(spark, d), "x", "y"))


@query("krippendorff", _RATED + """, m AS (SELECT c, count(*)::DOUBLE AS m FROM (SELECT x AS c FROM z WHERE x IS NOT NULL UNION ALL SELECT y FROM z WHERE x IS NOT NULL) GROUP BY c)
  SELECT n, round(1 - (2 * diff / t) / ((t * t - sq) / (t * (t - 1))), 6) + 0.0 AS alpha FROM (SELECT count(*) AS n, count(*) FILTER (x <> y)::DOUBLE AS diff FROM z WHERE x IS NOT NULL), (SELECT sum(m) AS t, sum(m * m) AS sq FROM m)""")
def _(spark, d):
    return r6(agreement.krippendorff(rated(spark, d), "x", "y"))


@query("threshold_sweep", _RATED + " SELECT threshold, count(*) AS n, round(avg((x = y)::INT), 6) AS precision FROM z, (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS threshold) WHERE x IS NOT NULL AND conf + 1e-9 >= threshold GROUP BY threshold HAVING count(*) >= 5")
def _(spark, d):
    rows = rated(spark, d).where("x IS NOT NULL").withColumn("ok", F.col("x") == F.col("y")).withColumn("conf", F.col("conf") + 1e-9)
    return r6(agreement.threshold_sweep(rows, "conf", "ok"))


_WIL = """, k AS (SELECT app, count(*) FILTER (x = y) AS k, count(*)::DOUBLE AS n FROM z WHERE x IS NOT NULL GROUP BY app)"""


@query("wilson_precision", _RATED + _WIL + " SELECT app, k, n::BIGINT AS n, round((k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS low, round((k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS high FROM k")
def _(spark, d):
    k = rated(spark, d).where("x IS NOT NULL").groupBy("app").agg(F.count_if(F.col("x") == F.col("y")).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = agreement.wilson(F.col("k"), F.col("n"))
    return r6(k.select("app", "k", "n", lo.alias("low"), hi.alias("high")))


@query("weighted_precision", _RATED + """, g AS (SELECT app, avg((x = y)::INT) AS p, count(*) AS drawn FROM z JOIN (SELECT DISTINCT reviewId FROM rq1_tracker_negative_50) USING (reviewId) WHERE x IS NOT NULL GROUP BY app), c AS (SELECT app, count(*) AS w FROM z WHERE x IS NOT NULL GROUP BY app)
  SELECT sum(drawn)::BIGINT AS n_drawn, round(sum(p * w) / sum(w), 6) AS weighted, round(sum(p * drawn) / sum(drawn), 6) AS unweighted FROM g JOIN c USING (app)""")
def _(spark, d):
    z = rated(spark, d).where("x IS NOT NULL").withColumn("ok", (F.col("x") == F.col("y")).cast("double"))
    sheet = B.table(spark, d, "rq1_tracker_negative_50").select("reviewId")
    drawn = z.join(sheet, "reviewId", "left_semi").groupBy("app").agg(F.avg("ok").alias("p"), F.count(F.lit(1)).alias("drawn"))
    w = z.groupBy("app").agg(F.count(F.lit(1)).alias("w"))
    p = F.col("p")
    return r6(drawn.join(w, "app").agg(F.sum("drawn").alias("n_drawn"), (F.sum(p * F.col("w")) / F.sum("w")).alias("weighted"), (F.sum(p * F.col("drawn")) / F.sum("drawn")).alias("unweighted")))


@query("ari", _RATED + """, c AS (SELECT x, y, count(*)::DOUBLE AS n FROM z WHERE x IS NOT NULL GROUP BY x, y), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM c), u AS (SELECT sum(n * (n - 1) / 2) AS u FROM (SELECT sum(n) AS n FROM c GROUP BY x)), v AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY y))
  SELECT t::BIGINT AS n, round((i - u * v / (t * (t - 1) / 2)) / ((u + v) / 2 - u * v / (t * (t - 1) / 2)), 6) + 0.0 AS ari FROM i, u, v""")
def _(spark, d):
    return r6(agreement.adjusted_rand(rated(spark, d), "x", "y"))


@query("spearman", """, z AS (SELECT app, avg(score) AS x, avg(n_words) AS y FROM r GROUP BY app), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM z WHERE x IS NOT NULL AND y IS NOT NULL) SELECT count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS rho FROM k""")
def _(spark, d):
    z = B.reviews(spark, d).groupBy("app").agg(F.avg("score").alias("x"), F.avg("n_words").alias("y"))
    return r6(agreement.spearman(z, "x", "y"))


@query("bh_fdr", """, c AS (SELECT app AS term, CASE WHEN length(app) % 5 = 0 THEN 'exploratory' ELSE 'primary' END AS family, CASE WHEN length(app) % 7 = 0 THEN NULL ELSE round(count(*) FILTER (score <= 2) / count(*)::DOUBLE / 10, 6) END AS p_value FROM r GROUP BY app),
  k AS (SELECT term, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, term) AS raw, p_value FROM c WHERE family = 'primary' AND p_value IS NOT NULL), q AS (SELECT term, least(1.0, min(raw) OVER (ORDER BY p_value DESC, term DESC ROWS UNBOUNDED PRECEDING)) AS q_value FROM k)
  SELECT c.term, c.family, c.p_value, round(q_value, 6) AS q_value, coalesce(q_value < 0.05, FALSE) AS significant_q05 FROM c LEFT JOIN q USING (term)""")
def _(spark, d):
    g = B.reviews(spark, d).groupBy(F.col("app").alias("term")).agg((F.round(F.count_if(F.col("score") <= 2) / F.count(F.lit(1)) / 10, 6)).alias("p"))
    c = g.select("term", F.when(F.length("term") % 5 == 0, "exploratory").otherwise("primary").alias("family"), F.when(F.length("term") % 7 != 0, F.col("p")).alias("p_value"))
    return r6(agreement.benjamini_hochberg(c))


# ---------------------------------------------------------------- samples and sheets
@query("stratified_md5", """, g AS (SELECT reviewId, app, md5(reviewId || '|42') AS h FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY h, reviewId) AS rn FROM g) SELECT reviewId, app FROM k ORDER BY CASE WHEN rn > greatest(1, 300 // (SELECT count(DISTINCT app) FROM g)) THEN 1 ELSE 0 END, h, reviewId LIMIT 300""")
def _(spark, d):
    return relational.stratified(B.reviews(spark, d).select("reviewId", "app"), "app", "reviewId", 300)


@query("roundrobin_draw", """, g AS (SELECT reviewId, app FROM r WHERE corpus_text AND reviewId NOT IN (SELECT reviewId FROM rq1_tracker_negative_50 WHERE theme_code IS NOT NULL)), k AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY md5(reviewId || '|42'), reviewId) AS rn FROM g) SELECT reviewId, app FROM k ORDER BY rn, app LIMIT 30""")
def _(spark, d):
    seen = B.table(spark, d, "rq1_tracker_negative_50").where("theme_code IS NOT NULL").select("reviewId")
    pool = B.reviews(spark, d).where("corpus_text").select("reviewId", "app").join(seen, "reviewId", "left_anti")
    return relational.round_robin(pool, "app", "reviewId", 30)


@query("overlap_split", """WITH g AS (SELECT reviewId, row_number() OVER (ORDER BY md5(reviewId || '|42'), reviewId) AS k0 FROM (SELECT DISTINCT reviewId FROM rq1_tracker_negative_50)) SELECT reviewId, CASE WHEN k0 <= 100 THEN 'shared' WHEN (k0 - 100) % 2 = 1 THEN 'first' ELSE 'second' END AS part FROM g""", base=False)
def _(spark, d):
    return relational.overlap_split(B.table(spark, d, "rq1_tracker_negative_50").select("reviewId").distinct(), "reviewId", 100)


@query("label_merge", """WITH b AS (SELECT reviewId, min_by(theme_code, (theme_code, theme)) AS tc, min_by(theme, (theme_code, theme)) AS th FROM rq1_tracker_negative_50 WHERE theme_code IS NOT NULL GROUP BY reviewId)
  SELECT row_id, s.reviewId, CASE WHEN trim(coalesce(s.theme_code, '')) = '' THEN b.tc ELSE s.theme_code END AS theme_code, CASE WHEN trim(coalesce(s.theme, '')) = '' THEN b.th ELSE s.theme END AS theme FROM rq1_tracker_negative_50 s LEFT JOIN b USING (reviewId)""", base=False)
def _(spark, d):
    s = B.table(spark, d, "rq1_tracker_negative_50").select("row_id", "reviewId", "theme_code", "theme")
    return relational.label_merge(s, s.where("theme_code IS NOT NULL"), ["reviewId"], ["theme_code", "theme"])


@query("theme_counts", " SELECT theme, theme_code, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM rq1_tracker_negative_50 WHERE theme IS NOT NULL GROUP BY 1, 2", base=False)
def _(spark, d):
    n = B.table(spark, d, "rq1_tracker_negative_50").where("theme IS NOT NULL").groupBy("theme", "theme_code").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t_"), F.lit(1).alias("k_"))
    return r6(n.withColumn("k_", F.lit(1)).join(F.broadcast(total), "k_").select("theme", "theme_code", "n", (F.col("n") / F.col("t_")).alias("share")))


@query("quote_export", " SELECT reviewId, app, CAST(score AS BIGINT) AS score, ts AS at_, text AS quote FROM r WHERE corpus_text AND score <= 2 ORDER BY reviewId LIMIT 15")
def _(spark, d):
    return B.reviews(spark, d).where("corpus_text AND score <= 2").select("reviewId", "app", F.col("score").cast("bigint").alias("score"), F.col("at").alias("at_"), F.col("text").alias("quote")).orderBy("reviewId").limit(15)


@query("set_ops", """, x AS (SELECT DISTINCT reviewId FROM a WHERE aspect = 'ads'), y AS (SELECT DISTINCT reviewId FROM a WHERE aspect = 'ui') SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM x UNION SELECT * FROM y) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y)""")
def _(spark, d):
    a = B.aspects(spark, d)
    x, y = (a.where(F.col("aspect") == v).select("reviewId").distinct() for v in ("ads", "ui"))
    n = lambda op, df: df.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    return n("union", x.union(y).distinct()).unionByName(n("intersect", x.intersect(y))).unionByName(n("except", x.subtract(y)))


# ---------------------------------------------------------------- topics
@query("topic_prevalence", """WITH t AS (SELECT l_orderkey % 10 AS topic_id, n_name AS app FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), n AS (SELECT app, topic_id, count(*) AS n FROM t GROUP BY 1, 2) SELECT app, topic_id, n, round(n / sum(n) OVER (PARTITION BY app)::DOUBLE, 6) AS share_of_app FROM n""", base=False)
def _(spark, d):
    o = B.table(spark, d, "orders").join(B.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(B.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    li = B.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 10).alias("topic_id"))
    rows = li.join(o.select("o_orderkey", F.col("n_name").alias("app")), F.col("l_orderkey") == F.col("o_orderkey"))
    return r6(relational.share_of_group(rows.groupBy("app", "topic_id").agg(F.count(F.lit(1)).alias("n")), ["app"], "n", "share_of_app"))


@query("rep_docs", " SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 2", base=False)
def _(spark, d):
    return relational.top_per_group(B.table(spark, d, "embeddings").select("label", "vec_id"), ["label"], [F.asc("vec_id")], 2)


@query("cosine_topk", """WITH l AS (SELECT label::VARCHAR AS label, min_by(embedding, vec_id) AS v FROM embeddings GROUP BY label), c AS (SELECT vec_id AS item, l.label, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 9) AS cosine FROM embeddings, l),
  k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY cosine DESC, label) AS rank FROM c) SELECT item, label, round(cosine, 6) AS cosine, rank FROM k WHERE rank <= 3""", base=False)
def _(spark, d):
    e = B.table(spark, d, "embeddings")
    labels = e.groupBy(F.col("label").cast("string").alias("label")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    return r6(topics.nearest(e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), labels, 3))


@query("topic_ctfidf")
def _(spark, d):
    docs = B.reviews(spark, d).where("corpus_text").select(text.script_guess("text").alias("topic"), "text")
    return r6(topics.terms(docs, "topic", "text", B.STOPWORDS))


@query("topic_kmeans")
def _(spark, d):
    return r6(topics.cluster(B.table(spark, d, "embeddings"), "vec_id", "embedding", 10))


# ---------------------------------------------------------------- models
def design_rows(spark, d):
    x = gaps.design(B.reviews(spark, d), B.aspects(spark, d), [a.name for a in B.LEXICON])
    return x.where("score IS NOT NULL"), [f"complaint_{a.name}" for a in B.LEXICON] + ["log_words"]


@query("cluster_ols")
def _(spark, d):
    x, terms = design_rows(spark, d)
    return spark.createDataFrame(linear.cluster_ols(linear.moments(x, "score", terms, "app")).rows("cluster_ols"), linear.SCHEMA)


@query("mixed_effects")
def _(spark, d):
    x, terms = design_rows(spark, d)
    return spark.createDataFrame(linear.mixed(linear.moments(x, "score", terms, "app")).rows("mixed_effects"), linear.SCHEMA)


@query("ordinal")
def _(spark, d):
    x, all_terms = design_rows(spark, d)
    terms = linear.drop_sparse(x, [t for t in all_terms if t.startswith("complaint_")])
    cells = x.groupBy(*terms, (F.col("score") - 1).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each combination of complaints and score
    fit = linear.ordered_logit([(tuple(float(c[t]) for t in terms), c.y, c.n) for c in cells], 5)
    rows = [("ordinal", t, e, s, linear._normal_p(e / s), *linear.interval(e, s), fit["n"], "") for t, e, s in zip(terms, fit["coef"], fit["std_error"])] if fit else [("ordinal", "complaint_ads", *[None] * 5, 0, "not estimable")]
    return spark.createDataFrame(rows, linear.SCHEMA)


@query("fisher")
def _(spark, d):
    c = gaps.cooccurrence(B.reviews(spark, d).where("corpus_text"), B.aspects(spark, d).where("NOT is_request"), "reviewId", "ads", "ui").first()
    odds, p = small.fisher_exact(c.both, c.only_a, c.only_b, c.neither)
    return spark.createDataFrame([(odds, p)], "odds_ratio double, p_value double")


@query("bootstrap")
def _(spark, d):
    have = B.features(spark, d).where("aspect = 'travel' AND feature_present >= 1").select("app").distinct()
    h = relational.semi_flag(B.reviews(spark, d).where("score IS NOT NULL"), have, ["app"], "has").groupBy("has", "score").agg(F.count(F.lit(1)).alias("n")).collect()  # ten rows
    got = small.bootstrap_difference({float(x.score): x.n for x in h if x["has"]}, {float(x.score): x.n for x in h if not x["has"]})
    return spark.createDataFrame([got or (None, None, None)], "difference double, low double, high double")


@query("dip")
def _(spark, d):
    h = {float(x.score): x.n for x in B.reviews(spark, d).where("score IS NOT NULL").groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}  # five rows
    return spark.createDataFrame([(small.dip(h), small.bimodality(h))], "dip double, bimodality double")


@query("pelt")
def _(spark, d):
    trend = temporal.monthly(B.reviews(spark, d).withColumn("app", F.lit("all")))
    return r6(temporal.changepoints(trend, "app", "mean_score"))


# ---------------------------------------------------------------- figure frames
@query("fig_length_histogram", " SELECT least(n_words, 100)::BIGINT AS words, count(*) AS n FROM r GROUP BY 1")
def _(spark, d):
    return B.reviews(spark, d).groupBy(F.least("n_words", F.lit(100)).cast("bigint").alias("words")).agg(F.count(F.lit(1)).alias("n"))


@query("fig_aspect_heatmap", """ SELECT app, """ + ", ".join(f"CASE WHEN count(*) FILTER (aspect = '{x.name}') >= 10 THEN round(avg(CASE WHEN aspect = '{x.name}' THEN prob_pos - prob_neg END), 6) + 0.0 END AS {x.name}" for x in B.LEXICON) + " FROM a WHERE NOT is_request GROUP BY app")
def _(spark, d):
    a = B.aspects(spark, d).where("NOT is_request").withColumn("v", scalars.valence("prob_pos", "prob_neg"))
    cells = [F.when(F.count_if(F.col("aspect") == x.name) >= 10, F.avg(F.when(F.col("aspect") == x.name, F.col("v")))).alias(x.name) for x in B.LEXICON]
    return r6(a.groupBy("app").agg(*cells))


@query("fig_reply_rating", " SELECT app, round(avg(CASE WHEN has_reply THEN 1.0 ELSE 0 END), 6) AS reply_rate, round(avg(score), 6) AS mean_score, count(*) AS n FROM r GROUP BY app HAVING count(*) >= 30")
def _(spark, d):
    return r6(B.reviews(spark, d).groupBy("app").agg(relational.rate(F.col("has_reply")).alias("reply_rate"), F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n")).where("n >= 30"))


__all__ = ["QUERIES", "SQL", "Window", "_rex"]
