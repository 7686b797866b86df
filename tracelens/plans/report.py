"""The exposure report of every consented profile: one nested row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import text as T
from tracelens.operators import activity as A
from tracelens.operators import findings as O
from tracelens.operators.progress import Progress
from tracelens.plans import narrowing, scoring
from tracelens.plans.queries_persons import tag_attributes


def exposure_report(posts: DataFrame, consents: DataFrame, special: bool = False, progress: Progress | None = None) -> DataFrame:
    """profile_id, n_posts, language, richness, peak_hour, hours, top_groups, keywords, attributes, narrowing,
    final_population, score, recommendations. Profiles without consent or without posts have none.

    posts: profile_id, seq, permalink, text, created_utc, group, tags. progress: gets the rows of each stage as they pass.
    """

    def at(stage: str, df: DataFrame) -> DataFrame:
        return progress.at(stage, df) if progress else df

    posts = O.consented(posts, consents)
    hours = A.hour_shares(posts)
    peak = A.peak_hours(hours)
    rich = A.richness(posts).select("profile_id", "richness")
    base = posts.groupBy("profile_id").agg(F.count("*").alias("posts")).join(rich, "profile_id", "left").join(peak, "profile_id")
    attributes = tag_attributes(posts)
    scores = scoring.scored(base, attributes)
    steps = narrowing.narrowed(O.declared(posts, special), special)

    def nested(df: DataFrame, name: str, *cols: str) -> DataFrame:
        return df.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

    parts = [
        at("analyzing_writing_style", A.language(posts, T.SPANISH_MARKERS)),
        hours.groupBy("profile_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("hour", "share")))).alias("hours")),
        nested(A.top_groups(at("reading_posts", posts)), "top_groups", "rank", "group", "posts"),
        nested(A.keywords(posts), "keywords", "rank", "term", "score"),
        nested(at("detecting_attributes", attributes), "attributes", "category", "value", "confidence", "evidence"),
        nested(steps, "narrowing", "step_no", "category", "value", "remaining_population", "risk_level", "reduction_percent"),
        narrowing.final_population(steps).select("profile_id", "final_population"),
        at("computing_score", scores).select("profile_id", F.struct(F.bround("overall_score", 1).alias("overall"), F.bround("geolocation_risk", 1).alias("geolocation"), F.bround("inferable_data_risk", 1).alias("data"), F.bround("deanonymization_ease", 1).alias("ease")).alias("score")),
        scoring.recommendations(scores).withColumnRenamed("codes", "recommendations"),
    ]
    out = base.select("profile_id", F.col("posts").alias("n_posts"), "richness", "peak_hour")
    for p in parts:
        out = out.join(p, "profile_id", "left")
    return at("generating_report", out)


def flagship_report(spark: SparkSession, sf_dir: str, progress: Progress | None = None) -> DataFrame:
    """Documents as posts of their sources; every third source has not agreed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    posts = docs.select(
        F.col("source").alias("profile_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("permalink"), "text",
        F.timestamp_seconds(F.lit(1735689600) + F.col("doc_id") * 5400).alias("created_utc"), F.col("lang").alias("group"), F.array("lang").alias("tags"),
    )
    consents = docs.select(F.col("source").alias("profile_id")).distinct().filter(F.regexp_extract("profile_id", r"(\d+)", 1).cast("int") % 3 != 0)
    return exposure_report(posts, consents, progress=progress)
