"""Design matrix, contrasts and the matrix of promised against delivered features.

Missing counts are zero, missing rates stay null, and a null rate breaks no
promise.  Requests are left out by the caller where they don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlode.operators.relational import rate, semi_flag
from reviewlode.operators.temporal import numeric_label

NEG_RATE, LEAST_MENTIONS = 0.40, 30


def design(reviews: DataFrame, aspects: DataFrame, names: list[str]) -> DataFrame:
    """One row for each text review with 0/1 columns for mentions and complaints of each aspect, length and numeric label."""
    cells = [F.max(F.when((F.col("aspect") == n) & ~F.col("is_request"), 1)).alias(f"mentions_{n}") for n in names]
    cells += [F.max(F.when((F.col("aspect") == n) & (F.col("sentiment_label") == "Negative"), 1)).alias(f"complaint_{n}") for n in names]
    wide = aspects.groupBy("reviewId").agg(*cells)
    base = reviews.where("corpus_text").select("reviewId", "app", "score", "has_reply", F.log1p("n_words").alias("log_words"), numeric_label().alias("sent_num"))
    return base.join(wide, "reviewId", "left").fillna(0, [f"{p}_{n}" for n in names for p in ("mentions", "complaint")])


def centred(df: DataFrame, columns: list[str]) -> DataFrame:
    """A small table with ``<column>_c``: the value less the mean of all rows."""
    means = df.agg(*[F.avg(c).alias(f"{c}_m_") for c in columns]).withColumn("k_", F.lit(1))
    out = df.withColumn("k_", F.lit(1)).join(F.broadcast(means), "k_")
    return out.withColumns({f"{c}_c": F.col(c) - F.col(f"{c}_m_") for c in columns}).drop("k_", *[f"{c}_m_" for c in columns])


def cooccurrence(reviews: DataFrame, aspects: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Counts of the 2x2 table of two aspects over reviews, and the lift P(a|b) / P(a)."""
    flags = aspects.groupBy(key).agg(F.max((F.col("aspect") == a).cast("int")).alias("x"), F.max((F.col("aspect") == b).cast("int")).alias("y"))
    m = reviews.select(key).join(flags, key, "left").fillna(0, ["x", "y"])
    x, y = F.col("x"), F.col("y")
    return m.agg(
        F.sum(x * y).alias("both"), F.sum(x * (1 - y)).alias("only_a"), F.sum((1 - x) * y).alias("only_b"), F.sum((1 - x) * (1 - y)).alias("neither"),
        F.try_divide(F.try_divide(F.sum(x * y), F.sum(y)), F.avg(x)).alias("lift"),
    )


def same_group(rows: DataFrame, key: str, within: str, a: str, b: str) -> DataFrame:
    """Reviews with both aspects, and those with both in one group (a sentence, an evidence string)."""
    p = rows.where(F.col("aspect").isin(a, b)).groupBy(key, within).agg(F.bool_or(F.col("aspect") == a).alias("x"), F.bool_or(F.col("aspect") == b).alias("y"))
    v = p.groupBy(key).agg(F.bool_or(F.col("x") & F.col("y")).alias("same"), (F.bool_or("x") & F.bool_or("y")).alias("both"))
    return v.agg(F.count_if("both").alias("n_both"), F.count_if("same").alias("n_same"))


def gap_matrix(features: DataFrame, aspects: DataFrame, demand: DataFrame) -> DataFrame:
    """Per app and aspect: promise, mentions, negative rate, demand, and whether the promise is broken; aspect rows are unique by review and aspect."""
    per = aspects.where("NOT is_request").groupBy("app", "aspect").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_if(F.col("sentiment_label") == "Negative").alias("n_negative"))
    asked = demand.where("aspect IS NOT NULL").where(F.col("request_type").isin("request", "absence")).groupBy("app", "aspect").agg(F.countDistinct("reviewId").alias("demand_signals"))
    g = features.select("app", "aspect", "feature_present", "promise_source").join(per, ["app", "aspect"], "left").join(asked, ["app", "aspect"], "left")
    g = g.withColumn("neg_rate", F.try_divide(F.col("n_negative").cast("double"), F.col("n_mentions"))).fillna(0, ["n_mentions", "n_negative", "demand_signals"])
    promised = F.coalesce(F.col("feature_present") >= 1, F.lit(False))
    broken = promised & (F.col("n_mentions") >= LEAST_MENTIONS) & F.coalesce(F.col("neg_rate") > NEG_RATE, F.lit(False))
    return g.select("app", "aspect", "feature_present", "promise_source", "n_mentions", "n_negative", "neg_rate", "demand_signals", promised.alias("promised"), broken.alias("broken_promise"))


def unmet(gap: DataFrame) -> DataFrame:
    """Aspects by demand where the feature is absent, times the apps that lack it."""
    g = gap.where("NOT promised").groupBy("aspect").agg(F.count(F.lit(1)).alias("apps_lacking"), F.sum("demand_signals").alias("demand_volume"), F.sum("n_negative").alias("negative_mentions"))
    return g.withColumn("unmet_score", F.col("demand_volume") * F.col("apps_lacking"))


def served(gap: DataFrame) -> DataFrame:
    """Coverage, mean negative rate and broken promises of each aspect, and whether it is served well."""
    g = gap.groupBy("aspect").agg(
        F.avg("feature_present").alias("coverage"), F.avg("neg_rate").alias("mean_neg_rate"), F.count_if("broken_promise").alias("n_broken"),
        F.try_divide(F.count_if("broken_promise").cast("double"), F.count_if("promised")).alias("broken_share"),
    )
    return g.withColumn("served_well", F.coalesce((F.col("coverage") > 0.5) & (F.col("mean_neg_rate") < 0.30), F.lit(False)))


def app_comparison(reviews: DataFrame, features: DataFrame, meta: DataFrame) -> DataFrame:
    per = reviews.groupBy("app").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.avg("score").alias("mean_score"), F.avg(numeric_label()).alias("mean_sentiment"), rate(F.col("label") == "Negative").alias("pct_negative"),
        F.median("n_words").alias("median_words"), rate(F.col("has_reply")).alias("reply_rate"), F.median("days_to_reply").alias("median_days_to_reply"),
    )
    counts = features.groupBy("app").agg(F.sum("feature_present").alias("feature_count"))
    return per.join(meta, "app", "left").join(counts, "app", "left")


def developer_response(reviews: DataFrame) -> DataFrame:
    replied = F.col("has_reply")
    return reviews.groupBy("app").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.count_if(replied).alias("n_replied"), rate(replied).alias("reply_rate"),
        F.avg(F.when(replied, F.col("score"))).alias("score_replied"), F.avg(F.when(~replied, F.col("score"))).alias("score_unreplied"), F.median("days_to_reply").alias("median_days"),
    )


def loyalty(reviews: DataFrame, demand: DataFrame) -> DataFrame:
    """Rates of tenure and churn, mean thumbs, and the slope of the score in stars a year where there are enough dated rows."""
    signs = demand.groupBy("app").agg(*[F.countDistinct(F.when(F.col("request_type") == t, F.col("reviewId"))).alias(f"{t}_") for t in ("tenure", "churn")])
    days = F.unix_micros(F.col("at").cast("timestamp")) / 86_400_000_000
    enough = (F.count(F.lit(1)) > 100) & (F.count(F.when(F.col("score").isNotNull(), F.col("at"))) > 50) & (F.max("at") > F.min("at"))
    per = reviews.groupBy("app").agg(F.count(F.lit(1)).alias("n"), F.avg("thumbsUpCount").alias("mean_thumbs"), F.when(enough, F.regr_slope(F.col("score"), days) * 365).alias("score_slope"))
    j = per.join(signs, "app", "left").fillna(0, ["tenure_", "churn_"])
    return j.select("app", "n", (F.col("tenure_") / F.col("n")).alias("tenure_rate"), (F.col("churn_") / F.col("n")).alias("churn_rate"), "mean_thumbs", "score_slope")


def citation_rate(aspects: DataFrame, demand: DataFrame) -> DataFrame:
    m = aspects.groupBy("aspect").agg(F.countDistinct("reviewId").alias("mentions"))
    c = demand.where("request_type = 'preference' AND aspect IS NOT NULL").groupBy("aspect").agg(F.countDistinct("reviewId").alias("citations"))
    j = m.join(c, "aspect", "full_outer").fillna(0, ["mentions", "citations"])
    return j.withColumn("citation_rate", F.try_divide(F.col("citations").cast("double"), F.col("mentions")))


def with_without(reviews: DataFrame, features: DataFrame, aspect: str) -> DataFrame:
    """Reviews of apps with a feature against those without."""
    have = features.where((F.col("aspect") == aspect) & (F.col("feature_present") >= 1)).select("app")
    flagged = semi_flag(reviews, have, ["app"], "has_feature")
    return flagged.groupBy("has_feature").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), rate(F.col("label") == "Negative").alias("pct_negative"))


def complaint_rate(reviews: DataFrame, features: DataFrame, aspects: DataFrame, aspect: str, name: str) -> DataFrame:
    n = reviews.groupBy("app").agg(F.count(F.lit(1)).alias("n_"))
    counts = features.groupBy("app").agg(F.sum("feature_present").alias("feature_count"))
    bad = aspects.where((F.col("aspect") == aspect) & (F.col("sentiment_label") == "Negative")).groupBy("app").agg(F.countDistinct("reviewId").alias("bad_"))
    j = n.join(counts, "app").join(bad, "app", "left").fillna(0, ["bad_"])
    return j.select("app", "feature_count", (F.col("bad_") / F.col("n_")).alias(name))


def tracker_tier(features: DataFrame, base: str, scored: str) -> DataFrame:
    """Apps by whether they have a feature, and its extended form: none, plain, extended."""
    have = lambda a: F.max(F.when((F.col("aspect") == a) & (F.col("feature_present") >= 1), 1).otherwise(0))
    g = features.groupBy("app").agg(have(base).alias("b_"), have(scored).alias("s_"))
    return g.select("app", F.when((F.col("b_") == 1) & (F.col("s_") == 1), "extended").when(F.col("b_") == 1, "plain").otherwise("none").alias("tier"))


def pattern_2x2(reviews: DataFrame, text: str, a: str, b: str) -> DataFrame:
    """Counts of the 2x2 table of two patterns over texts; null text matches neither."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    x, y = low.rlike(a), low.rlike(b)
    return reviews.agg(F.count_if(x & y).alias("n_both"), F.count_if(x & ~y).alias("n_a"), F.count_if(~x & y).alias("n_b"), F.count_if(~x & ~y).alias("n_neither"))
