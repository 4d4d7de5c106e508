"""Agreement, precision and rank statistics as aggregates.

Null ratings don't count.  Empty inputs give no row, or null statistics where a
row for each group is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kappa(df: DataFrame, a: str, b: str, by: list[str], name: str = "cohens_kappa") -> DataFrame:
    """Cohen's kappa for each group: null if both raters are constant and equal, 0 if only one is constant."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).cast("string").alias("a_"), F.col(b).cast("string").alias("b_"))
    cells = rows.groupBy(*by, "a_", "b_").agg(F.count(F.lit(1)).alias("n_"))
    total = cells.groupBy(*by).agg(F.sum("n_").alias("t_"), F.sum(F.when(F.col("a_") == F.col("b_"), F.col("n_")).otherwise(0)).alias("same_"))
    ma = cells.groupBy(*by, F.col("a_").alias("c_")).agg(F.sum("n_").alias("x_"))
    mb = cells.groupBy(*by, F.col("b_").alias("c_")).agg(F.sum("n_").alias("y_"))
    if by:
        chance = ma.join(mb, [*by, "c_"], "inner").groupBy(*by).agg(F.sum(F.col("x_").cast("double") * F.col("y_")).alias("e_"))
        out = total.join(chance, by, "left")
    else:
        chance = ma.join(mb, "c_", "inner").agg(F.sum(F.col("x_").cast("double") * F.col("y_")).alias("e_"))
        out = total.withColumn("k_", F.lit(1)).join(chance.withColumn("k_", F.lit(1)), "k_", "left")
    t = F.col("t_").cast("double")
    po, pe = F.col("same_") / t, F.coalesce("e_", F.lit(0.0)) / (t * t)
    return out.select(*by, F.when(pe < 1, (po - pe) / (1 - pe)).alias(name))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """truth, guess, n and share of the truth's row."""
    n = df.dropna(subset=[truth, guess]).groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def precision_recall(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1 of each class of the truth."""
    rows = df.dropna(subset=[truth, guess])
    t = rows.groupBy(F.col(truth).alias("label")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col(truth) == F.col(guess)).alias("hit_"))
    g = rows.groupBy(F.col(guess).alias("label")).agg(F.count(F.lit(1)).alias("guessed_"))
    j = t.join(g, "label", "left")
    p, r = F.try_divide(F.col("hit_"), F.col("guessed_")), F.col("hit_") / F.col("support")
    p = F.coalesce(p, F.lit(0.0))
    return j.select("label", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def krippendorff(df: DataFrame, a: str, b: str) -> DataFrame:
    """Nominal alpha of two raters, one row."""
    rows = df.dropna(subset=[a, b])
    agree = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) != F.col(b)).alias("diff"))
    marg = rows.select(F.explode(F.array(a, b)).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("m")).agg(F.sum("m").alias("t"), F.sum(F.col("m").cast("double") * F.col("m")).alias("sq"))
    j = agree.withColumn("k", F.lit(1)).join(marg.withColumn("k", F.lit(1)), "k")
    t = F.col("t").cast("double")
    observed = 2 * F.col("diff") / t
    expected = (t * t - F.col("sq")) / (t * (t - 1))
    return j.select(F.col("n").alias("n"), F.when(expected > 0, 1 - observed / expected).alias("alpha"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; 0 and 1 without trials."""
    n_ = n.cast("double")
    p = k / n_
    centre, half = p + z * z / (2 * n_), z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_))
    den = 1 + z * z / n_
    return F.when(n == 0, 0.0).otherwise((centre - half) / den), F.when(n == 0, 1.0).otherwise((centre + half) / den)


def benjamini_hochberg(df: DataFrame, p: str = "p_value", family: str = "family", key: str = "term") -> DataFrame:
    """q values of the primary family with a p value; other rows get null.  A table of coefficients is small by nature."""
    primary = df.where((F.col(family) == "primary") & F.col(p).isNotNull())
    rank = F.row_number().over(Window.orderBy(F.col(p), key))
    m = F.count(F.lit(1)).over(Window.partitionBy())
    w = Window.orderBy(F.col(p).desc(), F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = primary.withColumn("raw_", F.col(p) * m / rank).withColumn("q_value", F.least(F.lit(1.0), F.min("raw_").over(w))).select(key, "q_value")
    return df.join(q, key, "left").withColumn("significant_q05", F.coalesce(F.col("q_value") < 0.05, F.lit(False)))


def spearman(df: DataFrame, x: str, y: str, least: int = 5) -> DataFrame:
    """rho over rows without nulls, with average ranks; null under ``least`` rows.  For tables of groups, which are small."""
    rows = df.dropna(subset=[x, y]).select(x, y)

    def average_rank(c):
        return F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2

    return rows.withColumns({"rx": average_rank(x), "ry": average_rank(y)}).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.corr("rx", "ry")).alias("rho"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two partitions, one row; 1 for identical ones."""
    pairs = lambda n: F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2)
    rows = df.dropna(subset=[a, b])
    cells = rows.groupBy(F.col(a).alias("a_"), F.col(b).alias("b_")).agg(F.count(F.lit(1)).alias("n_"))
    one = F.lit(1).alias("k_")
    i = cells.agg(pairs("n_").alias("i_"), F.sum("n_").alias("t_")).select("*", one)
    x = cells.groupBy("a_").agg(F.sum("n_").alias("n_")).agg(pairs("n_").alias("x_")).select("*", one)
    y = cells.groupBy("b_").agg(F.sum("n_").alias("n_")).agg(pairs("n_").alias("y_")).select("*", one)
    j = i.join(x, "k_").join(y, "k_")
    total = F.col("t_").cast("double") * (F.col("t_") - 1) / 2
    expected = F.col("x_") * F.col("y_") / total
    top = (F.col("x_") + F.col("y_")) / 2
    return j.select(F.col("t_").alias("n"), F.when(top == expected, 1.0).otherwise((F.col("i_") - expected) / (top - expected)).alias("ari"))


def threshold_sweep(df: DataFrame, score: str, correct: str, least: int = 5) -> DataFrame:
    """Precision of rows at or over each threshold from 0.50 to 0.95; thresholds with fewer than ``least`` rows are left out."""
    steps = F.array(*[F.lit(round(0.5 + 0.05 * i, 2)) for i in range(10)])
    reached = df.where(F.col(score).isNotNull()).select(correct, F.explode(F.filter(steps, lambda t: t <= F.col(score))).alias("threshold"))
    return reached.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("precision")).where(F.col("n") >= least)
