"""Raw payloads of two platforms, landed as JSON lines, to one model of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REDDIT_SITE = "https://www.reddit.com"
ITEM = "id:string,subreddit:string,title:string,selftext:string,body:string,created_utc:double,score:long,permalink:string"
REDDIT = f"struct<data:struct<children:array<struct<data:struct<{ITEM}>>>>>"
MEDIA = "id:string,caption:string,timestamp:string,media_type:string,permalink:string,like_count:long,comments_count:long,media_url:string,children:struct<data:array<struct<media_url:string,media_type:string>>>"
INSTAGRAM = f"struct<data:array<struct<{MEDIA}>>>"
#: Most items that are taken of a profile.
MOST_POSTS, MOST_COMMENTS, MOST_MEDIA, PAGE = 200, 300, 200, 100


def _reddit(pages: DataFrame, kind: str, most: int) -> DataFrame:
    """pages: profile_id, page, json."""
    item = pages.select("profile_id", "page", F.posexplode(F.from_json("json", REDDIT)["data"]["children"]).alias("i", "c")).select("profile_id", "page", "i", "c.data.*")
    w = Window.partitionBy("profile_id").orderBy("page", "i")
    return _reddit_model(item.withColumn("seq", (F.row_number().over(w) - 1).cast("long")).filter(F.col("seq") < min(most, PAGE)), kind)


def reddit_items(items: DataFrame, kind: str = "post") -> DataFrame:
    """items: profile_id, seq, json of one post or comment."""
    return _reddit_model(items.select("profile_id", "seq", F.from_json("json", f"struct<{ITEM}>").alias("c")).select("profile_id", "seq", "c.*"), kind)


def _reddit_model(item: DataFrame, kind: str) -> DataFrame:
    text = F.coalesce(F.nullif("selftext", F.lit("")), "title") if kind == "post" else F.col("body")
    return item.select(
        "profile_id", "seq", "id", F.lit("reddit").alias("platform"), F.lit(kind).alias("type"), F.col("subreddit").alias("group"), F.array(F.lower("subreddit")).alias("tags"),
        (F.col("title") if kind == "post" else F.lit(None).cast("string")).alias("title"), F.coalesce(text, F.lit("")).alias("text"), F.timestamp_seconds("created_utc").alias("created_utc"),
        "score", F.concat(F.lit(REDDIT_SITE), "permalink").alias("permalink"), F.array().cast("array<string>").alias("media_urls"),
    )


def reddit_posts(pages: DataFrame, most: int = MOST_POSTS) -> DataFrame:
    return _reddit(pages, "post", most)


def reddit_comments(pages: DataFrame, most: int = MOST_COMMENTS) -> DataFrame:
    return _reddit(pages, "comment", most)


def activity(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts, then comments, in one order."""
    last = posts.groupBy("profile_id").agg((F.max("seq") + 1).alias("_n"))
    after = comments.join(last, "profile_id", "left").withColumn("seq", F.col("seq") + F.coalesce("_n", F.lit(0))).drop("_n")
    return posts.unionByName(after)


def with_bio(posts: DataFrame, profiles: DataFrame) -> DataFrame:
    """A profile's text about itself comes before all its posts."""
    bio = profiles.filter(F.coalesce("bio", F.lit("")) != "").select("profile_id", F.lit(-1).cast("long").alias("seq"), F.lit("bio").alias("type"), F.col("bio").alias("text"), F.lit("bio").alias("permalink"))
    return posts.unionByName(bio, allowMissingColumns=True)


def unescaped(c: Column) -> Column:
    """The entities that avatar links hold."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def hashtags(caption: Column) -> Column:
    return F.transform(F.regexp_extract_all(caption, F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1)), F.lower)


def media_urls(item: Column) -> Column:
    """The pictures of one item: those of an album's parts, none of a video."""
    parts = F.filter(item["children"]["data"], lambda c: (c["media_type"] == "IMAGE") & c["media_url"].isNotNull())
    none = F.array().cast("array<string>")
    return (
        F.when(item["media_type"] == "CAROUSEL_ALBUM", F.coalesce(F.transform(parts, lambda c: c["media_url"]), none))
        .when((item["media_type"] == "VIDEO") | item["media_url"].isNull(), none)
        .otherwise(F.array(item["media_url"]))
    )


def instagram_media(pages: DataFrame, most: int = MOST_MEDIA) -> DataFrame:
    """pages: profile_id, page, json; the pages of a profile in the order of their cursors."""
    item = pages.select("profile_id", "page", F.posexplode(F.from_json("json", INSTAGRAM)["data"]).alias("i", "c"))
    w = Window.partitionBy("profile_id").orderBy("page", "i")
    return _instagram_model(item.withColumn("seq", (F.row_number().over(w) - 1).cast("long")).filter(F.col("seq") < most))


def instagram_posts(items: DataFrame) -> DataFrame:
    """items: profile_id, seq, json of one picture, video or album."""
    return _instagram_model(items.select("profile_id", "seq", F.from_json("json", f"struct<{MEDIA}>").alias("c")))


def _instagram_model(item: DataFrame) -> DataFrame:
    c = F.col("c")
    caption = F.coalesce(c["caption"], F.lit(""))
    tags = hashtags(caption)
    return item.select(
        "profile_id", "seq", c["id"].alias("id"), F.lit("instagram").alias("platform"), F.lower(c["media_type"]).alias("type"), F.coalesce(F.try_element_at(tags, F.lit(1)), F.lit("sin_etiqueta")).alias("group"),
        tags.alias("tags"), F.lit(None).cast("string").alias("title"), caption.alias("text"), F.to_timestamp(c["timestamp"], "yyyy-MM-dd'T'HH:mm:ssxx").alias("created_utc"),
        (F.coalesce(c["like_count"], F.lit(0)) + F.coalesce(c["comments_count"], F.lit(0))).alias("score"), c["permalink"].alias("permalink"), media_urls(c).alias("media_urls"),
    )


def type_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("profile_id").agg(
        F.count_if(F.col("type") == "comment").alias("n_comments"),
        F.count_if(F.col("type").isin("image", "video", "carousel_album")).alias("n_media_items"),
        F.sum(F.size("media_urls")).alias("n_photos"),
        F.count_if(F.col("type") == "post").alias("n_posts"),
    )


#: Platforms and the readers of their landed payloads.
READERS = {"reddit": reddit_posts, "instagram": instagram_media}


def reader_of(platform: str):
    if platform not in READERS:
        raise ValueError(f"unknown platform: {platform}")
    return READERS[platform]
