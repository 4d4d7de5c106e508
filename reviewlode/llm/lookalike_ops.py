"""Spark side of problem 3."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.llm.common import map_rows, once_a_worker, table, words
from reviewlode.llm.encoding import is_damaged
from reviewlode.llm.lookalikes import Speller, Trie, is_odd, plain

#: Words in the trie, the most frequent ones; tokens beyond it are normalised by table, so none is lost.
VOCABULARY = 50_000
#: A word in the letters of one script.
ONE_SCRIPT = "^(?:" + "|".join(rf"[\p{{Is{s}}}\p{{M}}]+" for s in ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Thai", "Hangul", "Armenian", "Georgian")) + r"|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+)$"


def vocabulary(texts: DataFrame, size: int = VOCABULARY) -> list[tuple[str, int]]:
    """The most frequent words in the letters of one script, with their counts over all texts; without odd ones."""
    w = texts.select(F.explode(words("text")).alias("w")).where(F.col("w").rlike(ONE_SCRIPT))
    top = w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(size)
    return [(r.w, r.n) for r in top.collect() if not is_odd(r.w)]  # at most ``size`` rows


def _fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])
    return df.select(key, F.explode(pairs).alias("f")).select(key, "f.field_name", "f.text").where(F.col("text").rlike(r"[^\x09\x0A\x0D\x20-\x7E]"))


def normalise(df: DataFrame, key: str, fields: list[str], not_if_damaged: tuple[str, ...] = ()) -> DataFrame:
    """key, field_name, original, normalised of every text with odd characters; null, empty and plain texts give no row.

    Texts of the fields in ``not_if_damaged`` that a wrong encoding damaged are left out.
    """
    spark = df.sparkSession
    types = dict(df.dtypes)
    texts = None
    for f in fields:
        part = df.select(F.col(f).alias("text"))
        texts = part if texts is None else texts.unionByName(part)
    words_ = spark.sparkContext.broadcast((uuid.uuid4().hex, vocabulary(texts)))

    def make():
        token, counted = words_.value
        speller = once_a_worker(token, lambda: Speller(Trie(counted)))

        @lru_cache(20_000)
        def form(field: str, t: str):
            new = plain(t, speller)
            return None if new == t or field in not_if_damaged and is_damaged(t) else new

        def one(k, field, t):
            new = form(field, t)
            return () if new is None else [(k, field, t, new)]

        return one

    return map_rows(_fields(df, key, fields), f"{key} {types[key]}, field_name string, original string, normalised string", make)


def p3_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every odd text of content and replyContent with its consistent form."""
    return normalise(table(spark, d, "reviews"), "row_id", ["content", "replyContent"], ("content",))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_normalised(spark, d).select("row_id", "field_name")
