"""From review text to aspect sentiment.

Every operator takes and gives DataFrames.  Empty inputs give empty results;
null text has no sentence, null labels are not negative, requests carry no
sentiment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlode.functions import scalars, text
from reviewlode.operators import patterns, relational

WEIGHT_FLOOR = 0.05
EVIDENCE = 3


def sentences(reviews: DataFrame, key: str, column: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, carried columns, sentence_index from 0, sentence."""
    return reviews.select(key, *carry, F.posexplode(text.sentence_array(column)).alias("sentence_index", "sentence"))


def clauses(reviews: DataFrame, key: str, column: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return reviews.select(key, *carry, F.posexplode(text.clause_array(column)).alias("clause_index", "clause"))


def tag_sentences(s: DataFrame, lexicon: dict[str, str]) -> DataFrame:
    """One row for each sentence and aspect, in one pass over the sentences."""
    return patterns.tag(s, "sentence", lexicon).withColumn("match_method", F.lit("lexicon"))


def unmatched(s: DataFrame, tagged: DataFrame, key: str) -> DataFrame:
    """Sentences that no aspect matched."""
    return s.join(tagged.select(key, "sentence_index").distinct(), [key, "sentence_index"], "left_anti")


def handle_requests(tagged: DataFrame, devotional: str = patterns.DEVOTIONAL, share: float = 0.5) -> DataFrame:
    """Tagged pairs with request and negation flags, without those that are mostly devotional phrases."""
    low = F.lower("sentence")
    kept = tagged.where(text.devotional_share(low, devotional) >= share)
    return kept.withColumns({"is_request": patterns.is_request(F.col("sentence")), "has_negation": patterns.has_negation(F.col("sentence"))})


def aspect_rows(pairs: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Per review and aspect: confidence-weighted sentiment of its sentences, evidence and flags.

    ``scores``: sentence, p_neg, p_neu, p_pos, one row for each distinct sentence.
    """
    rows = pairs.where("NOT is_request").join(scores, "sentence", "left").withColumn("w_", F.greatest(1 - F.col("p_neu"), F.lit(WEIGHT_FLOOR)))
    mean = lambda c: (F.sum(F.col(c) * F.col("w_")) / F.sum(F.when(F.col(c).isNotNull(), F.col("w_")))).alias(c.replace("p_", "prob_"))
    out = rows.groupBy(key, "aspect").agg(
        mean("p_neg"), mean("p_neu"), mean("p_pos"),
        F.count(F.lit(1)).alias("n_sentences"),
        relational.first_texts("sentence", ["sentence_index"], EVIDENCE).alias("triggering_sentence"),
        F.min_by("match_method", F.struct("match_method", "sentence_index")).alias("match_method"),
        F.bool_or("has_negation").alias("has_negation"),
    )
    return out.withColumn("sentiment_label", scalars.argmax_label("prob_neg", "prob_neu", "prob_pos")).withColumn("is_request", F.lit(False))


def request_rows(pairs: DataFrame, key: str) -> DataFrame:
    """Per review and aspect: its requests, with null sentiment."""
    return (
        pairs.where("is_request")
        .groupBy(key, "aspect")
        .agg(
            F.count(F.lit(1)).alias("n_sentences"),
            relational.first_texts("sentence", ["sentence_index"], EVIDENCE).alias("triggering_sentence"),
            F.min_by("match_method", F.struct("match_method", "sentence_index")).alias("match_method"),
            F.bool_or("has_negation").alias("has_negation"),
        )
        .withColumns({"sentiment_label": F.lit(None).cast("string"), "is_request": F.lit(True)})
    )


def aspect_table(pairs: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Aspect rows and request rows in one aggregation, for pairs that hold p_neg, p_neu and p_pos already."""
    said = ~F.col("is_request")
    w = F.greatest(1 - F.col("p_neu"), F.lit(WEIGHT_FLOOR))
    mean = lambda c: (F.sum(F.when(said, F.col(c) * w)) / F.sum(F.when(said & F.col(c).isNotNull(), w))).alias(c.replace("p_", "prob_"))
    out = pairs.groupBy(key, "aspect", "is_request", *carry).agg(
        mean("p_neg"), mean("p_neu"), mean("p_pos"),
        F.count(F.lit(1)).alias("n_sentences"),
        relational.first_texts("sentence", ["sentence_index"], EVIDENCE).alias("triggering_sentence"),
        F.min_by("match_method", F.struct("match_method", "sentence_index")).alias("match_method"),
        F.bool_or("has_negation").alias("has_negation"),
    )
    return out.withColumn("sentiment_label", scalars.argmax_label("prob_neg", "prob_neu", "prob_pos"))


def once_per_text(df: DataFrame, text_column: str, score) -> DataFrame:
    """Scores of distinct texts; ``score`` maps a one-column DataFrame to texts with scores.  Expensive models see each text once."""
    return score(df.select(text_column).where(F.col(text_column).isNotNull()).distinct())
