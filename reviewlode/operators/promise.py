"""Features promised in descriptions, compared with annotations and monetisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlode.functions import text
from reviewlode.operators import patterns
from reviewlode.stats import agreement

EVIDENCE_LENGTH = 300


def matrix(apps: DataFrame, app: str, description: str, lexicon: dict[str, str]) -> DataFrame:
    """One row for each app and aspect: whether its description claims it, with the first segment that does."""
    segments = apps.select(app, F.posexplode(text.segment_array(description)).alias("pos", "segment"))
    hits = patterns.tag(segments, "segment", lexicon).groupBy(app, "aspect").agg(F.min_by("segment", "pos").alias("e_"), F.count(F.lit(1)).alias("n_segments"))
    cells = apps.select(app, F.explode(F.array(*[F.lit(a) for a in lexicon])).alias("aspect"))
    return cells.join(hits, [app, "aspect"], "left").select(
        app, "aspect", F.col("e_").isNotNull().alias("description_claimed"), F.substring("e_", 1, EVIDENCE_LENGTH).alias("description_evidence"), F.coalesce("n_segments", F.lit(0)).alias("n_segments")
    )


def source_agreement(cells: DataFrame) -> DataFrame:
    """For each aspect: how far annotations and descriptions agree; cells without an annotation don't count."""
    both = cells.where("csv_annotated IS NOT NULL").select("aspect", (F.col("csv_annotated") >= 1).alias("a"), F.col("description_claimed").alias("b"))
    counts = both.groupBy("aspect").agg(
        F.count(F.lit(1)).alias("n_apps"),
        F.count_if("a").alias("csv_present"),
        F.count_if("b").alias("description_present"),
        F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"),
        F.count_if(F.col("a") & ~F.col("b")).alias("description_misses"),
        F.count_if(~F.col("a") & F.col("b")).alias("description_overclaims"),
    )
    return counts.join(agreement.kappa(both, "a", "b", ["aspect"]), "aspect", "left")


def combine(cells: DataFrame) -> DataFrame:
    """The annotation where there is one, else the description, and which of them it was."""
    return cells.withColumns(
        {
            "feature_present": F.coalesce("csv_annotated", F.col("description_claimed").cast("double")),
            "promise_source": F.when(F.col("csv_annotated").isNotNull(), "csv").otherwise("description"),
            "source_agreement": F.when(F.col("csv_annotated").isNotNull(), (F.col("csv_annotated") >= 1) == F.col("description_claimed")),
        }
    )


def monetisation_contradiction(apps: DataFrame, claims: DataFrame, app: str) -> DataFrame:
    """Apps that claim to be free of charge or ads but sell or advertise; missing flags count as false."""
    flags = apps.select(app, F.coalesce("adSupported", F.lit(False)).alias("ads"), F.coalesce("offersIAP", F.lit(False)).alias("iap"))
    joined = flags.join(claims, app, "left").withColumn("claims_free", F.coalesce("claims_free", F.lit(False)))
    return joined.withColumns({"monetized": F.col("ads") | F.col("iap"), "claims_free_but_monetized": F.col("claims_free") & (F.col("ads") | F.col("iap"))})
