"""Spark side of problem 6: corpus statistics, restoration and the queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.llm import encoding
from reviewlode.llm.common import map_rows, table, words


def model_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Word counts and character-pair counts of all texts, in ``N_BUCKETS`` buckets each.

    Words are counted with map-side combine; pairs are counted over distinct
    words.  The driver gets at most two numbers a bucket, whatever the corpus.
    """
    n = encoding.N_BUCKETS
    counted = texts.select(F.explode(words("text")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.expr("zip_with(concat(array(' '), filter(split(w, ''), c -> c <> '')), concat(filter(split(w, ''), c -> c <> ''), array(' ')), (a, b) -> concat(a, b))")
    keyed = counted.select(
        "n",
        F.explode(F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.col("w").alias("s"))), F.transform(pairs, lambda p: F.struct(F.lit(1).alias("kind"), p.alias("s"))))).alias("e"),
    )
    rows = keyed.groupBy(F.col("e.kind").alias("kind"), (F.crc32(F.col("e.s").cast("binary")) % n).cast("int").alias("b")).agg(F.sum("n").alias("n")).toPandas()
    out = (np.zeros(n), np.zeros(n))
    for kind in (0, 1):
        part = rows[rows.kind == kind]
        out[kind][part.b.to_numpy()] = part.n.to_numpy()
    return out


def restore(df: DataFrame, key: list[str], text: str, counts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Damaged rows of ``df`` with the restored text (null where it can't be known); clean, null and empty texts give no row."""
    spark = df.sparkSession
    model = spark.sparkContext.broadcast((counts[0].astype(np.float32), counts[1].astype(np.float32)))
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in key) + ", original string, restored string"

    def make():
        restorer = encoding.Restorer(encoding.Model(*model.value))

        def one(*values):
            *ids, t = values
            bad, new = restorer.restore(t)
            return [(*ids, t, new)] if bad else ()

        return one

    return map_rows(df.select(*key, text), schema, make)


def _sources(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "reviews").select(F.lit("reviews").alias("table_name"), "row_id", F.col("content").alias("text"))
    b = table(spark, d, "scrape_summary").select(F.lit("scrape_summary").alias("table_name"), "row_id", F.col("app_name").alias("text"))
    return a.unionByName(b)


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    """Damaged contents and app names with their original text where it can still be known."""
    src = _sources(spark, d)
    return restore(src, ["table_name", "row_id"], "text", model_counts(src.select("text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_restored(spark, d).select("table_name", "row_id")
