"""Relational operators that Spark has no single call for.

Empty inputs give empty results.  Null keys are groups of their own unless a
docstring says otherwise.  Input columns other than the named ones pass
through; helper columns end in an underscore so that they don't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class NotUnique(ValueError):
    """A side of a validated join has repeated keys."""


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; raises NotUnique if a key occurs twice.  One aggregate with map-side combine."""
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").limit(1).count():
        raise NotUnique(f"repeated keys {keys}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return assert_unique(left, keys).join(assert_unique(right, keys), keys, how)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by ``order``; rows with a null key are dropped.

    An aggregate, not a window: partial results on the map side keep a key with
    a third of all rows from becoming one task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("row_")
    return df.dropna(subset=keys).groupBy(*keys).agg(first).select(*[c if c in keys else F.col(f"row_.{c}").alias(c) for c in df.columns])


def semi_flag(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with a column that says whether its keys occur in ``other``; null keys don't."""
    marked = other.select(*keys).dropna().distinct().withColumn("hit_", F.lit(True))
    return df.join(marked, keys, "left").withColumn(name, F.coalesce("hit_", F.lit(False))).drop("hit_")


def first_texts(text: str, order: list[Column | str], n: int = 3, sep: str = " || ") -> Column:
    """Aggregate: the first ``n`` texts by order, joined.  Only sums up groups that are small by nature, such as sentences of a review."""
    keyed = F.struct(*[F.col(o).alias(f"o{i}_") if isinstance(o, str) else o.alias(f"o{i}_") for i, o in enumerate(order)], F.col(text).alias("t_"))
    return F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(keyed)), 1, n), lambda x: x["t_"]), sep)


def rate(condition: Column) -> Column:
    """Aggregate: share of all rows that meet a condition; null conditions count as not met."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= n).drop("rn_")


def share_of_group(df: DataFrame, group: list[str], n: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(n) / F.sum(n).over(Window.partitionBy(*group)))


def row_shares(df: DataFrame, group: str, value: str, names: list[str]) -> DataFrame:
    """One row for each group with the share of each of some values among all its rows."""
    return df.groupBy(group).agg(*[rate(F.col(value) == n).alias(n) for n in names])


def shuffled(key: str, seed: int) -> Column:
    """A deterministic order by the md5 of key and seed, the same in any SQL engine."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def stratified(df: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` rows: max(1, n // groups) of each stratum, topped up or cut to ``n`` in hash order."""
    groups = df.select(by).distinct().count()
    per = max(1, n // groups) if groups else 0
    ranked = df.withColumn("h_", shuffled(key, seed)).withColumn("rn_", F.row_number().over(Window.partitionBy(by).orderBy("h_", key)))
    # no stratum gives more than n rows, so ranks beyond n are cut where the rows are, before the shuffle
    first = ranked.where(F.col("rn_") <= n).withColumn("late_", (F.col("rn_") > per).cast("int"))
    return first.orderBy("late_", "h_", key).limit(n).drop("h_", "rn_", "late_")


def round_robin(df: DataFrame, by: str, key: str, n: int, seed: int = 42, floor: int = 0) -> DataFrame:
    """``n`` rows drawn in turns from the groups, each group in hash order, after ``floor`` rows of every group.

    Ranks beyond ``n`` are cut before the shuffle: no group can give more.
    """
    w = Window.partitionBy(by).orderBy(shuffled(key, seed), key)
    ranked = df.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= n)
    return ranked.orderBy(F.when(F.col("rn_") <= floor, 0).otherwise(F.col("rn_")), by, "rn_").limit(n).drop("rn_")


def overlap_split(df: DataFrame, key: str, shared: int, seed: int = 42) -> DataFrame:
    """Rows of a bounded sheet as 'shared', 'first' or 'second': ``shared`` for both raters, the rest halved."""
    w = Window.orderBy(shuffled(key, seed), key)
    rn = F.row_number().over(w)
    return df.withColumn("part", F.when(rn <= shared, "shared").when((rn - shared) % 2 == 1, "first").otherwise("second"))


def label_merge(sheet: DataFrame, backup: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Blank labels of a sheet filled from a backup; filled ones stay; a key's first backup row counts."""
    old = keep_first(backup.select(*keys, *labels), keys, labels).select(*keys, *[F.col(c).alias(f"{c}_old_") for c in labels])
    joined = sheet.join(old, keys, "left")
    for c in labels:
        joined = joined.withColumn(c, F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.col(f"{c}_old_")).otherwise(F.col(c)))
    return joined.select(*sheet.columns)


def resolve_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """Names matched to known apps: recorded id, exact key, unique substring either way, unique brand lead, else null.

    ``names``: name, key, lead, package?; ``known``: package, key, lead.  Both
    are small sheets; substrings are found through their shared grams of four
    characters, not through all pairs.
    """
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - 3, F.lit(1))), lambda i: F.substring(F.col("key"), i, F.lit(4))))
    a = names.select("name", F.col("key").alias("a_"), F.explode(grams).alias("g_"))
    b = known.select(F.col("package").alias("sub_"), F.col("key").alias("b_"), F.explode(grams).alias("g_"))
    contained = (F.length("a_") > 3) & (F.length("b_") > 3) & (F.col("a_").contains(F.col("b_")) | F.col("b_").contains(F.col("a_")))
    sub = a.join(b, "g_").where(contained).select("name", "sub_").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_"), F.min("sub_").alias("sub_")).where("n_ = 1").drop("n_")
    exact = known.groupBy("key").agg(F.min("package").alias("exact_"))
    lead = known.where("lead <> ''").groupBy("lead").agg(F.min("package").alias("lead_"), F.count(F.lit(1)).alias("n_")).where("n_ = 1").drop("n_")
    ids = known.select(F.col("package").alias("given_")).distinct()
    out = names.join(ids, names.package == F.col("given_"), "left").join(exact, "key", "left").join(sub, "name", "left").join(lead, "lead", "left")
    return out.select("name", F.coalesce("given_", "exact_", "sub_", "lead_").alias("resolved"))
