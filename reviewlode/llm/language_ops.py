"""Spark side of problem 2."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.llm import languages as L
from reviewlode.llm.common import map_rows, table

_CODES = [c for v in L.CODES.values() for c in v.split()]


def label_code(column: str) -> F.Column:
    """The first part of a label in lower case."""
    return F.lower(F.element_at(F.split(F.trim(F.col(column)), "[-_.@ ]"), 1))


def labelled_sample(df: DataFrame, key: str, text: str, label: str, size: int = L.SAMPLE) -> list[tuple[str, str]]:
    """(language, text) of at most ``size`` labelled rows, the first by hash of the key; bounded by ``size``.

    Texts are taken whole.  Rows beyond a hash threshold that leaves about twice the sample are not
    sorted, so that each task hands on a share of the sample, whatever the input.
    """
    share = min(1.0, 2.0 * size / max(1, df.count()))
    df = df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    rows = df.where(label_code(label).isin(_CODES) & (F.length(text) >= 8)).select(F.xxhash64(key).alias("h"), label, F.col(text).alias("t"))
    return [(L.canonical(r[label]), r.t) for r in rows.orderBy("h").limit(size).collect()]


_CUTTERS: dict = {}


def _cutter(token: str, parts):
    """The cached segmenter of a worker; tasks of the same query share it."""
    if token not in _CUTTERS:
        _CUTTERS.clear()
        model = L.worker_model(token, parts)

        @lru_cache(20_000)
        def cut(t, lab):
            s = L.stretches(t, model, lab)
            return [(i, lang, conf, len(s)) for i, (lang, conf) in enumerate(s, 1)]

        _CUTTERS[token] = cut
    return _CUTTERS[token]


def segments(df: DataFrame, key: list[str], text: str, label: str | None, counts) -> DataFrame:
    """One row per stretch of one language: key, seg_no, lang, confidence, n_segments."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, L.Ngrams(counts).packed()))
    types = dict(df.dtypes)

    def make():
        cut = _cutter(*shared.value)

        def one(*values):
            *ids, t, lab = values
            return [(*ids, *s) for s in cut(t, L.canonical(lab))]

        return one

    lab = F.col(label) if label else F.lit(None).cast("string")
    schema = ", ".join(f"{k} {types[k]}" for k in key) + ", seg_no int, lang string, confidence double, n_segments int"
    some = df.where(F.col(text).rlike(r"\p{L}"))
    return map_rows(some.select(*key, text, lab.alias("label_")), schema, make)


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of every review and coding-sheet text with confidence and the label given."""
    reviews = table(spark, d, "reviews")
    counts = L.fit(labelled_sample(reviews, "row_id", "content", "lang"))
    a = reviews.select(F.lit("reviews").alias("table_name"), "row_id", F.col("content").alias("text"), "lang")
    b = table(spark, d, "rq1_tracker_negative_50").select(
        F.lit("rq1_tracker_negative_50").alias("table_name"), "row_id", F.col("content_clean").alias("text"), F.lit(None).cast("string").alias("lang")
    )
    src = a.unionByName(b).withColumn("label", F.col("lang"))
    return segments(src, ["table_name", "row_id", "label"], "text", "lang", counts)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    canon = F.create_map(*[F.lit(x) for k, v in L.CODES.items() for c in v.split() for x in (c, k)])
    s = p2_segments(spark, d)
    given = F.coalesce(canon[label_code("label")], F.lit(""))
    wanted = (F.col("table_name") != "reviews") | (F.col("n_segments") > 1) | (given != F.col("lang"))
    return s.where(wanted).select("table_name", "row_id", "seg_no", "lang")
