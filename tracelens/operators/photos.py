"""What the analysis of photos adds to a report: inferences, partner signals, descriptions, places at home."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCATION_FIELDS = ("provincia", "municipio", "comunidad_autonoma")


def estimates(photos: DataFrame) -> DataFrame:
    """One row a photo with a place: profile_id, permalink, photo_link, region, confidence."""
    return photos.filter("region IS NOT NULL").select("profile_id", "permalink", "photo_link", "region", "confidence")


def inferences(photos: DataFrame) -> DataFrame:
    """Every inference of every photo, with the photo's post at the end of its evidence.

    photos: inferences array<struct<category, value, confidence, evidence array<string>>>.
    """
    each = photos.select("profile_id", "permalink", "photo_link", F.explode("inferences").alias("i"))
    evidence = F.array_append(F.coalesce("i.evidence", F.array().cast("array<string>")), F.col("permalink"))
    return each.select("profile_id", "photo_link", "i.category", "i.value", "i.confidence", evidence.alias("evidence"))


def partner_posts(photos: DataFrame) -> DataFrame:
    """The posts (not photos: those of one post share its link) with a hint at a partner."""
    return photos.filter("partner").select("profile_id", "permalink").distinct()


def descriptions(photos: DataFrame, column: str) -> DataFrame:
    """photo_link and text of the photos that are described; a post's photos have links of their own."""
    return photos.filter(F.coalesce(F.col(column), F.lit("")) != "").groupBy("photo_link").agg(F.min(column).alias("description"))


def with_home(findings: DataFrame, homes: DataFrame) -> DataFrame:
    """findings, and for each profile whose text named no place the home region of its photos.

    homes: profile_id, level (a location field), key, evidence. Its source is `imagen`.
    """
    placed = findings.filter(F.col("field").isin(*LOCATION_FIELDS)).select("profile_id").distinct()
    new = homes.join(placed, "profile_id", "left_anti")
    return findings.unionByName(new.select("profile_id", F.col("level").alias("field"), F.col("key").alias("value"), F.lit("imagen").alias("source"), F.lit(None).cast("double").alias("confidence"), "evidence"))


def with_partner(findings: DataFrame, posts: DataFrame) -> DataFrame:
    """findings, and for each profile with partner signals in photos and no marital status from its text `con_pareja`."""
    said = findings.filter("field = 'estado_civil'").select("profile_id").distinct()
    new = posts.groupBy("profile_id").agg(F.array_sort(F.collect_set("permalink")).alias("evidence")).join(said, "profile_id", "left_anti")
    return findings.unionByName(new.select("profile_id", F.lit("estado_civil").alias("field"), F.lit("con_pareja").alias("value"), F.lit("imagen").alias("source"), F.lit(None).cast("double").alias("confidence"), "evidence"))


def all_attributes(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, equal ones as often as they come; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def marker_radius(confidence: Column) -> Column:
    return 8 + confidence * 10


def percent(confidence: Column) -> Column:
    """Whole per cent, halves up."""
    return F.floor(confidence * 100 + 0.5).cast("long")


def footnotes(steps: DataFrame, sources: tuple[str, ...] = ("imagen", "ia_nombre")) -> DataFrame:
    """profile_id, note: the sources that need a footnote, where any step has them."""
    return steps.filter(F.col("source").isin(*sources)).select("profile_id", F.col("source").alias("note")).distinct()


def photo_links(posts: DataFrame) -> DataFrame:
    """permalink, photo_index (from 1), photo_total, photo_link, url: a row a photo. The photos of an album have links of their own.

    posts: permalink, type, media_urls; only pictures and albums have photos.
    """
    p = posts.filter(F.col("type").isin("image", "carousel_album")).select("permalink", F.size("media_urls").alias("photo_total"), F.posexplode("media_urls").alias("_i", "url"))
    n = F.col("_i") + 1
    own = F.concat("permalink", F.when(F.contains("permalink", F.lit("?")), "&").otherwise("?"), F.lit("img_index="), n.cast("string"))
    return p.select("permalink", n.alias("photo_index"), "photo_total", F.when(F.col("photo_total") > 1, own).otherwise(F.col("permalink")).alias("photo_link"), "url")
