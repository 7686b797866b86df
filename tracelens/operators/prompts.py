"""What is sent to a language model and what comes back, as columns; nothing here calls a model. And what a page says about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a post that are sent; posts of a profile at most (a platform gives no more).
SNIPPET, MOST = 600, 500
LANGUAGES = ("es", "en")
BLANKS = " \t\n\r\x0b\x0c"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def snippets(posts: DataFrame, most: int = MOST) -> DataFrame:
    """profile_id, said: a line `[permalink] beginning` for each post that says something, in their order; the first `most` of them."""
    p = posts.withColumn("_t", F.substring(stripped(F.col("text")), 1, SNIPPET)).filter("_t <> ''")
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy("profile_id").orderBy("seq"))).filter(F.col("_r") <= most)
    line = F.concat(F.lit("["), "permalink", F.lit("] "), "_t")
    return p.groupBy("profile_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("l")))), lambda x: x["l"]), "\n").alias("said"))


def about(username: Column, full_name: Column, bio: Column) -> Column:
    """What a profile says of itself, a line each; what is null or empty has none."""
    name = F.when(F.coalesce(full_name, F.lit("")) != "", F.concat(F.lit("Nombre público mostrado por la cuenta: "), full_name))
    own = F.when(F.coalesce(bio, F.lit("")) != "", F.concat(F.lit("Biografía: "), F.substring(stripped(bio), 1, SNIPPET)))
    return F.concat_ws("\n", F.concat(F.lit("Nombre de usuario/handle: "), username), name, own)


def prompts(profiles: DataFrame, posts: DataFrame, most: int = MOST) -> DataFrame:
    """profile_id, prompt of each profile (profile_id, username, full_name, bio)."""
    p = profiles.withColumn("_about", about(F.col("username"), F.col("full_name"), F.col("bio"))).join(snippets(posts, most), "profile_id", "left")
    return p.select("profile_id", F.when(F.col("said").isNotNull(), F.concat("_about", F.lit("\n\nPublicaciones:\n"), "said")).otherwise(F.col("_about")).alias("prompt"))


def summaries(answers: DataFrame) -> DataFrame:
    """profile_id, verdict, conclusions of answers (profile_id, json): what isn't text is left out, empty conclusions too. An answer that
    isn't an object has neither."""
    parts = F.from_json("json", "struct<veredicto:variant,conclusiones:variant>")
    a = answers.select("profile_id", parts["veredicto"].alias("v"), parts["conclusiones"].alias("c"))
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", stripped(F.try_variant_get(x, "$", "string")))
    listed = F.coalesce(F.try_variant_get(F.col("c"), "$", "array<variant>"), F.array().cast("array<variant>"))
    return a.select("profile_id", F.coalesce(text(F.col("v")), F.lit("")).alias("verdict"), F.filter(F.transform(listed, text), lambda t: t.isNotNull() & (t != "")).alias("conclusions"))


def language_of(asked: Column) -> Column:
    """The language of an answer: Spanish unless another that is known is asked for."""
    return F.when(asked.isin(*LANGUAGES), asked).otherwise(LANGUAGES[0])


def with_answers(photos: DataFrame, answers: DataFrame, key: str = "photo", enabled: bool = True) -> DataFrame:
    """photos with what a model has said of them: nulls where it said nothing in time, or was not to be asked."""
    return photos.join(answers if enabled else answers.limit(0), key, "left")


def available(files: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """available: whether all needed files (ids) are there."""
    return files.filter(F.col("id").isin(*needed)).agg((F.count_distinct("id") == len(set(needed))).alias("available"))


def badges(reduction: Column, confidence: Column) -> Column:
    """The badges of a step: its reduction and its confidence, where there are any."""
    return F.array_compact(F.array(
        F.when(reduction.isNotNull(), F.concat(F.lit("-"), reduction.cast("string"), F.lit("%"))), F.when(confidence.isNotNull(), F.concat(F.lit("~"), F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%"))),
    ))


def map_message(platform: Column, is_available: Column, points: Column, representative: Column) -> Column:
    """Why a map is missing or empty, the first reason that holds; null where there is nothing to say."""
    return F.when(~platform.eqNullSafe(F.lit("instagram")), "redditNoPhotos").when(~F.coalesce(is_available, F.lit(False)), "indexUnavailable").when(points == 0, "noPhotos").when(representative == 0, "noRepresentative")
