"""Spark side of problem 7."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.llm import personal
from reviewlode.llm.common import map_rows, table

FIELDS = ("content", "replyContent", "userName")


def name_counts(df: DataFrame, column: str, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """How often a word is the given and the family name in names of two words, over all rows, in buckets of a fixed number; only words with ``least`` partners."""
    return name_statistics(df, column, least)[:2]


def name_statistics(df: DataFrame, column: str, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As given and as family name the counts of each word, and with how many partners it goes."""
    name = r"^\s*(?:\p{Lu}[\p{L}\p{M}'’-]+\s+\p{Lu}[\p{L}\p{M}'’-]+|\p{Lo}[\p{Lo}\p{M}]+\s+\p{Lo}[\p{Lo}\p{M}]+)\s*$"
    pairs = df.where(F.col(column).rlike(name)).select(F.split(F.trim(F.lower(column)), r"\s+").alias("w"))
    both = pairs.groupBy("w").agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("w")[0].alias("s")), F.struct(F.lit(1).alias("kind"), F.col("w")[1].alias("s")))).alias("e")
    )
    # a name goes with several others; a fixed pair of words may be anything, so the partners are a feature
    words = both.groupBy("e.kind", "e.s").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("partners")).where(F.col("partners") >= least)
    rows = words.groupBy("kind", (F.crc32(F.col("s").cast("binary")) % personal.BUCKETS).cast("int").alias("b")).agg(F.sum("n").alias("n"), F.max("partners").alias("partners")).toPandas()
    out = tuple(np.zeros(personal.BUCKETS, dtype=np.float32) for _ in range(3))
    for kind in (0, 1):
        part = rows[rows.kind == kind]
        out[kind][part.b.to_numpy()] = part.n.to_numpy()
        np.maximum.at(out[2], part.b.to_numpy(), part.partners.to_numpy())
    return out


def _spans(df: DataFrame, key: str, schema: str, make_row) -> DataFrame:
    counts = name_statistics(df, "userName")
    shared = df.sparkSession.sparkContext.broadcast((personal.train(), *counts))
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in FIELDS])
    some = df.select(key, F.explode(pairs).alias("f")).select(key, "f.field_name", "f.text").where("text <> ''")

    def make():
        detector = personal.Detector(*shared.value)

        @lru_cache(20_000)
        def look(field: str, text: str):
            return tuple(detector.spans(text, field == "userName"))

        return lambda k, field, text: make_row(k, field, text, look(field, text))

    return map_rows(some, f"{key} {dict(df.dtypes)[key]}, {schema}", make)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    def kinds(k, field, _text, spans):
        return [(k, field, kind) for kind in sorted({s[2] for s in spans})]

    return _spans(table(spark, d, "reviews").select("row_id", *FIELDS), "row_id", "field_name string, kind string", kinds)


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Fields that hold personal information, with typed placeholders."""

    def redacted(k, field, text, spans):
        if not spans:
            return ()
        out, at = [], 0
        for a, b, kind in spans:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        return [(k, field, "".join(out) + text[at:])]

    return _spans(table(spark, d, "reviews").select("row_id", *FIELDS), "row_id", "field_name string, redacted string", redacted)
