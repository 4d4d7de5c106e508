"""Topics over supplied embeddings: clustering, terms, representatives, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlode.functions import scalars
from reviewlode.operators import relational
from reviewlode.stats import agreement


#: Most labels of a shortlist.
MOST_LABELS = 1000


def cluster(df: DataFrame, key: str, embedding: str, k: int, seed: int = 42, outlier: float = 0.95) -> DataFrame:
    """key, topic_id, distance by k-means; rows beyond the ``outlier`` quantile of the distance are topic -1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.where(F.col(embedding).isNotNull()).select(key, array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(v)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    out = model.transform(v).withColumn("c_", F.element_at(centres, F.col("prediction") + 1)).withColumn("x_", vector_to_array("features"))
    out = out.withColumn("distance", F.sqrt(F.aggregate(F.zip_with("x_", "c_", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))
    far = out.agg(F.percentile_approx("distance", outlier, 10_000)).first()[0]
    return out.select(key, F.when(F.col("distance") > far, -1).otherwise(F.col("prediction")).alias("topic_id"), "distance")


def stability(df: DataFrame, key: str, embedding: str, k: int, seeds: list[int]) -> float | None:
    """Mean adjusted Rand index over all pairs of seeds."""
    runs = [cluster(df, key, embedding, k, s).select(key, F.col("topic_id").alias("t")) for s in seeds]
    values = []
    for i, a in enumerate(runs):
        for b in runs[i + 1 :]:
            row = agreement.adjusted_rand(a.join(b.withColumnRenamed("t", "u"), key), "t", "u").first()
            values.append(row["ari"])
    return sum(values) / len(values) if values else None


def prevalence(topics: DataFrame, reviews: DataFrame, key: str, app: str) -> DataFrame:
    n = topics.join(reviews.select(key, app), key).groupBy(app, "topic_id").agg(F.count(F.lit(1)).alias("n"))
    return relational.share_of_group(n, [app], "n", "share_of_app")


def terms(docs: DataFrame, topic: str, text: str, stopwords: list[str], top: int = 10) -> DataFrame:
    """topic, term, n, weight: class-based tf-idf of words and pairs of words; the best ``top`` of each topic."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: (F.length(w) > 2) & ~w.isin(stopwords))
    pairs = F.when(F.size("w_") > 1, F.transform(F.sequence(F.lit(1), F.size("w_") - 1), lambda i: F.concat_ws(" ", F.element_at("w_", i), F.element_at("w_", i + 1)))).otherwise(F.array().cast("array<string>"))
    t = docs.where(F.col(topic).isNotNull()).withColumn("w_", words).select(topic, F.explode(F.concat("w_", pairs)).alias("term")).groupBy(topic, "term").agg(F.count(F.lit(1)).alias("n"))
    sizes = t.groupBy(topic).agg(F.sum("n").alias("size_"))
    overall = t.groupBy("term").agg(F.sum("n").alias("all_"))
    mean = sizes.agg(F.avg("size_").alias("mean_")).first()["mean_"]
    scored = t.join(sizes, topic).join(overall, "term").withColumn("weight", F.col("n") / F.col("size_") * F.log(1 + F.lit(mean) / F.col("all_")))
    return relational.top_per_group(scored.select(topic, "term", "n", "weight"), [topic], [F.desc("weight"), F.asc("term")], top)


def nearest(items: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` labels nearest to each item by cosine.  ``labels`` (label, vector) is a list of at most ``MOST_LABELS``, which becomes a literal array; longer ones are refused."""
    rows = labels.orderBy("label").limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not rows:
        return items.limit(0).select("item", F.lit("").alias("label"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank"))
    lit = F.array(*[F.struct(F.lit(r.label).alias("label"), F.array(*[F.lit(float(x)) for x in r.vector]).alias("v")) for r in rows])
    scored = F.transform(lit, lambda s: F.struct((-F.round(scalars.cosine(F.col("vector"), s["v"]), 9)).alias("c"), s["label"].alias("label")))
    best = items.select("item", F.posexplode(F.slice(F.array_sort(scored), 1, k)).alias("rank", "s"))
    return best.select("item", F.col("s.label").alias("label"), (-F.col("s.c")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def name_stopwords(apps: DataFrame, name: str) -> DataFrame:
    """Words of app names longer than two letters, to be left out of topic terms."""
    low = F.regexp_replace(F.lower(name), r"\x{307}", "")  # the dot that a lower-case dotted I leaves behind
    words = F.explode(F.split(low, r"[^\p{L}\p{N}]+")).alias("word")
    return apps.where(F.col(name).isNotNull()).select(words).where(F.length("word") > 2).distinct()


def tag_topics(topics: DataFrame, words: str, tags: dict[str, list[str]], name: str = "tags") -> DataFrame:
    """Topics with the tags whose keywords their top words contain, joined by a bar; empty without any."""
    low = F.lower(words)
    hits = [F.when(F.greatest(*[low.contains(k.lower()).cast("int") for k in [*ks, ks[0]]]) == 1, F.lit(t)) for t, ks in tags.items() if ks]
    return topics.withColumn(name, F.array_join(F.filter(F.array(*hits), lambda x: x.isNotNull()), "|") if hits else F.lit(""))


def prefilter_recall(shortlist: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of gold (item, label) pairs that a shortlist holds, one row; null without gold."""
    hit = gold.select("item", "label").distinct().join(shortlist.select("item", "label").distinct().withColumn("hit_", F.lit(1)), ["item", "label"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count("hit_").cast("double"), F.count(F.lit(1))).alias("recall"))


def submodels(df: DataFrame, key: str, embedding: str, subsets: dict[str, DataFrame], k: int, least: int = 200) -> DataFrame | None:
    """Clusters within each subset of keys that has at least ``least`` rows; None if no subset is large enough."""
    out = None
    for name, keys in subsets.items():
        part = df.join(keys.select(key).distinct(), key, "left_semi")
        if part.limit(least).count() >= least:
            got = cluster(part, key, embedding, k).withColumn("submodel", F.lit(name))
            out = got if out is None else out.unionByName(got)
    return out
