"""Spark side of problem 1."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlode.llm import languages as L
from reviewlode.llm.common import map_rows, table
from reviewlode.llm.encoding import is_damaged
from reviewlode.llm.language_ops import labelled_sample
from reviewlode.llm.sentences import split


def sentences(df: DataFrame, key: str, text: str, skip_damaged: bool = True, carry_text: bool = False, counts=None) -> DataFrame:
    """One row per sentence of every text: key, sent_no, char_start, char_end, and the sentence with ``carry_text``.

    ``counts`` are those of the n-gram model that tells the language where an
    abbreviation depends on it; without them only shared abbreviations count.
    Null, empty and letterless texts give no row, and with ``skip_damaged``
    texts damaged by a wrong encoding neither.
    """
    types = dict(df.dtypes)
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, L.Ngrams(counts).packed())) if counts else None

    def make():
        language = L.worker_model(*shared.value).language if shared else None

        @lru_cache(20_000)
        def cut(t: str):
            if skip_damaged and is_damaged(t):
                return ()
            spans = split(t, language)
            return tuple((i, a, b, t[a - 1 : b]) if carry_text else (i, a, b) for i, (a, b) in enumerate(spans, 1))

        def one(k, t):
            return [(k, *s) for s in cut(t)]

        return one

    some = df.select(key, text).where(F.col(text).rlike(r"\p{L}"))
    return map_rows(some, f"{key} {types[key]}, sent_no int, char_start int, char_end int" + (", sentence string" if carry_text else ""), make)


def _of_reviews(spark: SparkSession, d: str, carry_text: bool) -> DataFrame:
    reviews = table(spark, d, "reviews")
    counts = L.fit(labelled_sample(reviews, "row_id", "content", "lang"))
    return sentences(reviews, "row_id", "content", True, carry_text, counts)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _of_reviews(spark, d, False)


def p1_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences with their text, in one pass."""
    return _of_reviews(spark, d, True).select("row_id", "sent_no", "sentence")
