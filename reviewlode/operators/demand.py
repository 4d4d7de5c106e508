"""Requests, absences, churn, preferences and tenure mined from clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlode.operators import absa, patterns, relational


def families(clauses: DataFrame, column: str = "clause") -> DataFrame:
    """One row for each clause and family it shows; a clause may show several."""
    return patterns.tag(clauses, column, patterns.family_patterns(), "request_type")


def mine(reviews: DataFrame, key: str, column: str, lexicon: dict[str, str], carry: tuple[str, ...] = ()) -> DataFrame:
    """key, carried columns, evidence_sentence, request_type, aspect; clauses without an aspect keep a null one; repeated rows count once."""
    found = families(absa.clauses(reviews, key, column, carry))
    tagged = patterns.tag(found, "clause", lexicon, "aspect", keep_unmatched=True)
    return tagged.select(key, *carry, F.col("clause").alias("evidence_sentence"), "request_type", "aspect").distinct()


def flag_shared(demand: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Whether the aspect stage saw the same review and aspect as a request; a null aspect never matches."""
    return relational.semi_flag(demand, requests, [key, "aspect"], "absa_flagged_request")


def summary(demand: DataFrame, key: str) -> DataFrame:
    return demand.groupBy("request_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("n_reviews"), F.count("aspect").alias("n_with_aspect"))
