"""Calendar trends, interventions, versions and change points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlode.functions import scalars
from reviewlode.operators.relational import rate

SPARSE = 20
NUMERIC = {"Negative": -1.0, "Neutral": 0.0, "Positive": 1.0}


def numeric_label(column: str = "label"):
    c = F.col(column)
    return F.when(c == "Negative", -1.0).when(c == "Neutral", 0.0).when(c == "Positive", 1.0)


def monthly(reviews: DataFrame, app: str = "app") -> DataFrame:
    """Per app and month: volume, means, rates and three-row rolling means (at least two rows); months that are missing are not filled."""
    m = (
        reviews.where("at IS NOT NULL")
        .withColumn("month", scalars.month("at"))
        .groupBy(app, "month")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("score").alias("mean_score"),
            F.avg(numeric_label()).alias("mean_sentiment"),
            rate(F.col("label") == "Negative").alias("pct_negative"),
            rate(F.col("label") == "Positive").alias("pct_positive"),
            rate(F.col("has_reply")).alias("reply_rate"),
            F.median("n_words").alias("median_words"),
        )
    )
    w = Window.partitionBy(app).orderBy("month").rowsBetween(-2, 0)
    roll = {f"{c}_roll3": F.when(F.count(c).over(w) >= 2, F.avg(c).over(w)) for c in ("mean_score", "mean_sentiment", "pct_negative")}
    return m.withColumns(roll | {"sparse": F.col("n") < SPARSE})


def aspect_quarterly(reviews: DataFrame, aspects: DataFrame, key: str) -> DataFrame:
    """Per quarter and aspect: mentions, negative share and rate among all reviews of the quarter."""
    dated = reviews.where("at IS NOT NULL").select(key, scalars.quarter_start("at").alias("quarter"))
    totals = dated.groupBy("quarter").agg(F.countDistinct(key).alias("total_reviews"))
    per = aspects.join(dated, key).groupBy("quarter", "aspect").agg(F.countDistinct(key).alias("mentions"), rate(F.col("sentiment_label") == "Negative").alias("pct_negative"))
    return per.join(totals, "quarter").withColumn("mention_rate", F.col("mentions") / F.col("total_reviews"))


def early_late(quarterly: DataFrame, years: int = 3) -> DataFrame:
    """Mean mention rate of each aspect in the first and the last years with data, and the change; aspects without both are left out."""
    ends = quarterly.agg(F.min(F.year("quarter")).alias("lo_"), F.max(F.year("quarter")).alias("hi_")).withColumn("k_", F.lit(1))
    q = quarterly.withColumn("k_", F.lit(1)).join(F.broadcast(ends), "k_")
    early = F.avg(F.when(F.year("quarter") <= F.col("lo_") + years - 1, F.col("mention_rate")))
    late = F.avg(F.when(F.year("quarter") >= F.col("hi_") - years + 1, F.col("mention_rate")))
    return q.groupBy("aspect").agg(early.alias("early"), late.alias("late")).dropna().withColumn("change", F.col("late") - F.col("early"))


def neighbour_means(trend: DataFrame, series: str, metric: str, before: int = 6, after: int = 6) -> DataFrame:
    """Means of a metric over the rows before each month and over it and those that follow; a series has one row for each month."""
    w = Window.partitionBy(series).orderBy("month")
    return trend.withColumns({"mean_before": F.avg(metric).over(w.rowsBetween(-before, -1)), "mean_after": F.avg(metric).over(w.rowsBetween(0, after - 1))})


def versions(reviews: DataFrame, app: str = "app", version: str = "version", least: int = 30, drop: float = -0.15) -> DataFrame:
    """Versions with enough reviews, against the median of their app."""
    v = (
        reviews.where(F.col(version).isNotNull())
        .groupBy(app, version)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("at").alias("first_seen"),
            F.avg("score").alias("mean_score"),
            F.avg(numeric_label()).alias("mean_sentiment"),
            rate(F.col("label") == "Negative").alias("pct_negative"),
        )
        .where(F.col("n") >= least)
    )
    medians = v.groupBy(app).agg(F.median("mean_sentiment").alias("app_median_sentiment"))
    delta = F.col("mean_sentiment") - F.col("app_median_sentiment")
    return v.join(medians, app, "left").withColumns({"sentiment_delta": delta, "flagged_drop": F.coalesce(delta < drop, F.lit(False))})


def interrupted(reviews: DataFrame, hits: DataFrame, key: str, year: int, mon: int, window: int = 12) -> DataFrame:
    """Monthly rate of reviews in ``hits`` around an event; the event's own month counts as before."""
    marked = hits.select(key).distinct().withColumn("hit_", F.lit(1))
    m = (
        reviews.where("at IS NOT NULL")
        .join(marked, key, "left")
        .withColumn("month", scalars.month("at"))
        .groupBy("month")
        .agg(F.count(F.lit(1)).alias("n"), F.count("hit_").alias("mentions"), F.avg(numeric_label()).alias("mean_sentiment"), F.avg("score").alias("mean_score"))
    )
    m = m.withColumns({"rate": F.col("mentions") / F.col("n"), "months_from_event": scalars.months_from("month", year, mon)})
    return m.withColumn("period", F.when(F.col("months_from_event") > 0, "post").otherwise("pre")).where(F.col("months_from_event").between(-window, window))


def changepoints(trend: DataFrame, app: str, metric: str, penalty: float = 3.0, least: int = 6, months: int = 24) -> DataFrame:
    """Change points of each app's monthly series with enough months; one short series (months of one app) a group."""
    from reviewlode.stats.pelt import pelt

    types = dict(trend.dtypes)

    def scan(frame):
        import numpy as np
        import pandas as pd

        frame = frame.dropna(subset=[metric]).sort_values("month")
        x = frame[metric].to_numpy(dtype=float)
        rows = []
        if len(x) >= months:
            for i in pelt(x, penalty, least):
                before, after = x[max(0, i - 6) : i], x[i : i + 6]
                rows.append((frame[app].iloc[0], metric, frame["month"].iloc[i], float(np.mean(before)), float(np.mean(after)), float(np.mean(after) - np.mean(before)), len(after)))
        return pd.DataFrame(rows, columns=[app, "metric", "month", "mean_before", "mean_after", "delta", "n_after"])

    series = trend.where("NOT sparse").select(app, "month", metric)
    return series.groupBy(app).applyInPandas(scan, f"{app} {types[app]}, metric string, month date, mean_before double, mean_after double, delta double, n_after int")
