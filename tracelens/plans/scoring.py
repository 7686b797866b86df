"""Exposure scores and the rules that recommend something."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights and limits of the score.
GEO_WEIGHT, DATA_WEIGHT, EASE_WEIGHT = 0.35, 0.45, 0.20
TYPICAL_RICHNESS, MANY_POSTS, ATTRIBUTES = 0.45, 200, 6
#: Confidences are added in decimals: a sum of doubles depends on the order in which tasks send them, and limits are compared with it.
EXACT = "decimal(28,15)"


def ease(posts: Column, richness: Column, peak: Column) -> Column:
    """How easily a person could be told from others: volume, unusual vocabulary, regular hours."""
    volume = F.least(posts / MANY_POSTS, F.lit(1.0))
    unusual = F.when(richness > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(richness - TYPICAL_RICHNESS) / TYPICAL_RICHNESS))).otherwise(0.0)
    return F.least((volume * 0.4 + unusual * 0.3 + F.coalesce(peak, F.lit(0.0)) * 0.3) * 100, F.lit(100.0))


def exact_sum(confidence: Column) -> Column:
    return F.sum(confidence.cast(EXACT)).cast("double")


def double_sum(confidence: Column) -> Column:
    """The sum of a profile's few confidences as doubles, the largest first: where all orders agree it is what SQL has that adds doubles."""
    return F.aggregate(F.sort_array(F.collect_list(confidence), asc=False), F.lit(0.0), lambda s, x: s + x)


def scored(profiles: DataFrame, attributes: DataFrame, total: Callable[[Column], Column] = exact_sum) -> DataFrame:
    """profiles: profile_id, posts, richness, peak_share; attributes: profile_id, category, confidence. total: how confidences are added."""
    a = attributes.groupBy("profile_id").agg(
        F.coalesce(F.max(F.when(F.col("category") == "ubicacion", F.col("confidence"))), F.lit(0.0)).alias("geo"),
        total(F.col("confidence")).alias("sum"),
        F.max(F.col("category") == "ocupacion").alias("works"),
    )
    p = profiles.join(a, "profile_id", "left").withColumns(
        {
            "geolocation_risk": F.least(F.coalesce("geo", F.lit(0.0)) * 100, F.lit(100.0)),
            "inferable_data_risk": F.least(F.coalesce("sum", F.lit(0.0)) / ATTRIBUTES * 100, F.lit(100.0)),
            "deanonymization_ease": ease(F.col("posts"), F.col("richness"), F.col("peak_share")),
        }
    )
    overall = F.col("geolocation_risk") * GEO_WEIGHT + F.col("inferable_data_risk") * DATA_WEIGHT + F.col("deanonymization_ease") * EASE_WEIGHT
    return p.select("profile_id", overall.alias("overall_score"), "geolocation_risk", "inferable_data_risk", "deanonymization_ease", "peak_share", F.coalesce("works", F.lit(False)).alias("works"))


def recommendations(scores: DataFrame) -> DataFrame:
    """profile_id and the codes of all rules that apply, `low_exposure` where none does."""
    rules = [
        ("avoid_place_tags", F.col("geolocation_risk") > 30),
        ("review_history", F.col("inferable_data_risk") > 40),
        ("vary_activity", F.col("deanonymization_ease") > 50),
        ("peak_hour", F.col("peak_share") > 0.25),
        ("professional_groups", F.col("works")),
    ]
    said = F.array_compact(F.array(*[F.when(c, code) for code, c in rules]))
    return scores.select("profile_id", F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("low_exposure"))).alias("codes"))


def score_label(score: Column) -> Column:
    return F.when(score < 25, "bajo").when(score < 55, "moderado").when(score < 80, "alto").otherwise("critico")
