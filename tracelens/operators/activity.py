"""Activity and vocabulary of profiles: histograms, top groups, evidence, keyword weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.operators.shared import small, stored

# Tags that hint at a place or an occupation; the short ones count only when they are the whole tag.
PLACE_TAGS = ("madrid", "barcelona", "spain", "espana", "valencia", "sevilla", "argentina", "mexico", "vzla", "malaga", "bilbao", "zaragoza", "galicia", "andalucia", "catalunya", "asturias")
PLACE_EXACT = ("es", "askspain")
WORK_TAGS = ("programming", "developer", "dev", "nurse", "enfermeria", "teacher", "docente", "legaladvice", "abogad", "accounting", "medlab", "medicina", "ingenieria", "arquitect")
WORK_EXACT = ("cscareerquestions", "developerspain", "medlabprofessionals", "teachers", "nursing", "legaladvice", "accounting")
EVIDENCE = 5


def hour_shares(posts: DataFrame) -> DataFrame:
    """profile_id, hour (all 24), share of the profile's posts."""
    n = posts.groupBy("profile_id", F.hour("created_utc").alias("hour")).agg(F.count("*").alias("n"))
    total = n.groupBy("profile_id").agg(F.sum("n").alias("total"))
    grid = total.select("profile_id", "total", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return grid.join(n, ["profile_id", "hour"], "left").select("profile_id", "hour", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def peak_hours(shares: DataFrame) -> DataFrame:
    """The hour with the largest share of each profile, the first of equal ones."""
    return shares.groupBy("profile_id").agg(F.max(F.struct("share", -F.col("hour"))).alias("b")).select("profile_id", (-F.col("b.col2")).alias("peak_hour"), F.col("b.share").alias("peak_share"))


def top_groups(posts: DataFrame, n: int = 15) -> DataFrame:
    """The n most frequent groups of each profile; of equal ones the one seen first."""
    c = posts.groupBy("profile_id", "group").agg(F.count("*").alias("posts"), F.min("seq").alias("_first"))
    w = Window.partitionBy("profile_id").orderBy(F.desc("posts"), "_first")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("_first")


def tags_of(tags: Column, group: Column) -> Column:
    """Lower-case tags; the group where there are none."""
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, F.transform(tags, F.lower)).otherwise(F.array(F.lower(group)))


def matching_tag(tags: Column, keys: tuple[str, ...], exact: tuple[str, ...]) -> Column:
    """The first tag that is one of `exact` or holds one of `keys`."""
    known = F.array(*map(F.lit, keys))
    return F.try_element_at(F.filter(tags, lambda t: t.isin(*exact) | F.exists(known, lambda k: F.contains(t, k))), F.lit(1))


def tagged(posts: DataFrame, category: str, keys: tuple[str, ...], exact: tuple[str, ...], base: float, most: float) -> DataFrame:
    """profile_id, category, value (the most frequent matching tag), n, confidence, evidence (first posts)."""
    hits = posts.withColumn("_tag", matching_tag(tags_of(F.col("tags"), F.col("group")), keys, exact)).filter("_tag IS NOT NULL")
    c = hits.groupBy("profile_id", "_tag").agg(F.count("*").alias("n"), F.min("seq").alias("_first"))
    best = c.groupBy("profile_id").agg(F.max(F.struct("n", -F.col("_first"), "_tag")).alias("b"))
    return best.join(evidence(hits), "profile_id").select(
        "profile_id",
        F.lit(category).alias("category"),
        F.col("b._tag").alias("value"),
        F.col("b.n").alias("n"),
        F.bround(F.least(F.lit(base) + 0.05 * F.col("b.n"), F.lit(most)), 2).alias("confidence"),
        "evidence",
    )


def evidence(hits: DataFrame, n: int = EVIDENCE) -> DataFrame:
    """The permalinks of the first n posts of each profile, in their order; no more than n are gathered for a profile."""
    w = Window.partitionBy("profile_id").orderBy("seq")
    first = hits.select("profile_id", "seq", "permalink", F.row_number().over(w).alias("_r")).filter(F.col("_r") <= n)
    return first.groupBy("profile_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "permalink"))), lambda x: x["permalink"]).alias("evidence"))


def phrase_hits(posts: DataFrame, category: str, pattern: str, confidence: float) -> DataFrame:
    hits = posts.filter(F.col("text").rlike(pattern))
    return evidence(hits).select("profile_id", F.lit(category).alias("category"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("n"), F.lit(confidence).alias("confidence"), "evidence")


# -- words --------------------------------------------------------------------------------------------------------------


def alphabetic(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def richness(posts: DataFrame) -> DataFrame:
    """Distinct words by words of each profile, by two sums so that no profile's words meet in one task."""
    words = posts.select("profile_id", F.explode(alphabetic(F.col("text"))).alias("w"))
    each = words.groupBy("profile_id", "w").agg(F.count("*").alias("n"))
    return each.groupBy("profile_id").agg((F.count("*") / F.sum("n")).alias("richness"), F.sum("n").alias("tokens"))


def sentence_lengths(posts: DataFrame) -> DataFrame:
    """Mean tokens of a sentence: words, numbers and signs between ends of sentences or lines."""
    s = posts.select("profile_id", F.explode(F.split("text", r"(?<=[.!?…])\s+|\n+")).alias("s")).filter(F.trim("s") != "")
    n = F.regexp_count("s", F.lit(r"\p{L}+|[0-9]+|[^\s\p{L}0-9]"))
    return s.groupBy("profile_id").agg(F.avg(n).alias("avg_sentence_length"), F.count("*").alias("sentences"))


def emoji_rate(posts: DataFrame, pattern: str) -> DataFrame:
    return posts.groupBy("profile_id").agg((F.sum(F.regexp_count("text", F.lit(pattern))) / F.greatest(F.sum(F.length("text")), F.lit(1))).alias("emoji_rate"))


def words_of(posts: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """profile_id, seq, w: the words of two letters or more of each post, in their order."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    if stop:
        w = F.filter(w, lambda x: ~x.isin(*stop))
    return posts.select("profile_id", "seq", w.alias("w"))


def neighbours(words: DataFrame) -> DataFrame:
    """profile_id, seq, a, b: each word, and the one that follows it in its post, null after the last."""
    pairs = F.arrays_zip("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))))
    return words.select("profile_id", "seq", F.inline(pairs)).toDF("profile_id", "seq", "a", "b")


def frequent_terms(words: DataFrame, features: int) -> DataFrame:
    """profile_id, a, b, term: the words (b is null) and pairs of words that are the most frequent terms of each profile, of equal ones
    the first by name.

    A pair is no more frequent than its words. So the words that are among the most frequent words, equal ones of the last included, and
    pairs of two such words are all that can be among the most frequent terms; other pairs, nearly all of which stand once, are not gathered."""
    by_n = Window.partitionBy("profile_id").orderBy(F.desc("n"))
    single = words.select("profile_id", F.explode("w").alias("a")).groupBy("profile_id", "a").agg(F.count("*").alias("n"))
    single = small(single.withColumn("_r", F.rank().over(by_n)).filter(F.col("_r") <= features).drop("_r"), "keyword-words")
    pairs = neighbours(words).filter("b IS NOT NULL").select("profile_id", "a", "b")
    for side in ("a", "b"):
        pairs = pairs.join(single.select("profile_id", F.col("a").alias(side)), ["profile_id", side], "left_semi")
    pairs = pairs.groupBy("profile_id", "a", "b").agg(F.count("*").alias("n"))
    every = single.withColumn("b", F.lit(None).cast("string")).unionByName(pairs).withColumn("term", F.concat_ws(" ", "a", "b"))  # nulls are left out
    w = Window.partitionBy("profile_id").orderBy(F.desc("n"), "term")
    return every.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= features).select("profile_id", "a", "b", "term")


def keywords(posts: DataFrame, features: int = 500, top: int = 20, shortest: int = 20, least_posts: int = 3, stop: tuple[str, ...] = ()) -> DataFrame:
    """profile_id, rank, term, score: summed TF-IDF of the most frequent terms, each post's weights scaled to length 1. Terms are words
    of two letters or more and pairs of them.

    idf is ln((1 + posts) / (1 + posts with the term)) + 1. Profiles of fewer than least_posts texts longer than
    `shortest` have none.
    """
    long = posts.filter(F.length("text") > shortest)
    enough = long.groupBy("profile_id").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least_posts)
    enough = small(enough, "keyword-profiles")
    words = words_of(long.join(enough.select("profile_id"), "profile_id", "left_semi"), stop)
    # the frequent terms of each profile first: only these are counted by post
    few = small(frequent_terms(words, features), "keyword-terms")
    ones, twos = few.filter("b IS NULL").select("profile_id", "a", F.col("term").alias("_one")), few.filter("b IS NOT NULL").select("profile_id", "a", "b", F.col("term").alias("_two"))
    found = neighbours(words).join(ones, ["profile_id", "a"], "left").join(twos, ["profile_id", "a", "b"], "left")
    found = found.filter("_one IS NOT NULL OR _two IS NOT NULL").select("profile_id", "seq", F.explode(F.array("_one", "_two")).alias("term")).filter("term IS NOT NULL")
    tf = stored(found.groupBy("profile_id", "seq", "term").agg(F.count("*").alias("tf")), "keyword-counts")
    kept = tf.groupBy("profile_id", "term").agg(F.count("*").alias("df")).join(enough, "profile_id")
    kept = kept.select("profile_id", "term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(kept, ["profile_id", "term"]).withColumn("x", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy("profile_id", "seq").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    scores = weighted.join(norm, ["profile_id", "seq"]).groupBy("profile_id", "term").agg(F.sum(F.col("x") / F.col("norm")).alias("score"))
    v = Window.partitionBy("profile_id").orderBy(F.desc(F.round("score", 9)), "term")
    return scores.withColumn("rank", F.row_number().over(v)).filter(F.col("rank") <= top)


def language(posts: DataFrame, markers: tuple[str, ...], tokens: int = 300, hits: int = 3) -> DataFrame:
    """es where three markers or more are among the profile's first words, else en."""
    w = Window.partitionBy("profile_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), 1, tokens)
    # every post with words has one at least, so the first `tokens` of these hold all that count; each task keeps its own first, and
    # only these are cut into words
    first = Window.partitionBy("profile_id").orderBy("_none", "seq")
    none = (~F.lower("text").rlike(r"[\p{L}\p{N}_]")).cast("int")
    p = posts.select("profile_id", "seq", "text", F.coalesce(none, F.lit(1)).alias("_none")).withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= tokens)
    p = p.select("profile_id", "seq", words.alias("_w")).withColumn("_before", F.coalesce(F.sum(F.size("_w")).over(w), F.lit(0)))
    # a post counts with the words that are still among the first ones
    head = F.slice("_w", F.lit(1), F.greatest(F.lit(0), F.lit(tokens) - F.col("_before")).cast("int"))
    seen = p.select("profile_id", F.explode_outer(F.array_intersect(head, F.array(*map(F.lit, markers)))).alias("m"))
    return seen.groupBy("profile_id").agg(F.when(F.count_distinct("m") >= hits, "es").otherwise("en").alias("language"))


# -- texts and orders -----------------------------------------------------------------------------------------------------


def with_text(posts: DataFrame, longer_than: int = 0) -> DataFrame:
    """Posts that say something, of more than so many characters."""
    return posts.filter(F.length("text") > longer_than)


def without_posts(profiles: DataFrame, posts: DataFrame, key: str = "profile_id") -> DataFrame:
    """Profiles that have no posts."""
    return profiles.join(posts.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def joined_text(posts: DataFrame, most: int = 200_000) -> DataFrame:
    """profile_id, text: the posts' texts in their order, a line each, cut at `most` characters. Posts that begin beyond the cut are not gathered."""
    before = Window.partitionBy("profile_id").orderBy("seq", "text").rowsBetween(Window.unboundedPreceding, -1)
    p = posts.filter("text IS NOT NULL").withColumn("_at", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).filter(F.col("_at") < most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    return p.groupBy("profile_id").agg(F.substring(joined, 1, most).alias("text"))


def capped(n: Column, base: float, step: float, most: float) -> Column:
    """Confidence that grows with the number of hits, to a limit."""
    return F.least(F.lit(base) + step * n, F.lit(most))


def first_said(posts: DataFrame, value: Column, order: str = "seq") -> DataFrame:
    """profile_id, value: of each profile the first value that isn't null; null where all are."""
    return posts.groupBy("profile_id").agg(F.min_by(value, F.when(value.isNotNull(), F.col(order))).alias("value"))


def signals(posts: DataFrame, **hits: Column) -> DataFrame:
    """profile_id, and for each named condition whether any post meets it."""
    return posts.groupBy("profile_id").agg(*(F.bool_or(c).alias(name) for name, c in hits.items()), *(F.count_if(c).alias(f"n_{name}") for name, c in hits.items()))


def changes(events: DataFrame, by: str, stage: str, *order: str) -> DataFrame:
    """The events at which a stage differs from the one before, with `previous_stage`."""
    e = events.withColumn("previous_stage", F.lag(stage).over(Window.partitionBy(by).orderBy(*order)))
    return e.filter(~F.col("previous_stage").eqNullSafe(F.col(stage)))


def newest(posts: DataFrame, n: int, *order: Column, by: str = "profile_id") -> DataFrame:
    """The first n posts of each profile in an order, as a rule the newest."""
    return posts.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def markers_in(text: Column, markers: tuple[str, ...]) -> Column:
    """How many of the markers are among the words of a text."""
    return F.size(F.array_intersect(F.split(F.lower(text), " "), F.array(*map(F.lit, markers))))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is in one or the other, once."""
    return a.unionByName(b).distinct()


def only_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is in the first and not in the second, once; nulls are alike."""
    return a.subtract(b.select(*a.columns))


def first_of_each(*parts: DataFrame, key: str) -> DataFrame:
    """All parts one after the other, a row a key: that of the first part that has it."""
    every = None
    for n, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(n))
        every = p if every is None else every.unionByName(p)
    rest = [c for c in parts[0].columns if c != key]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_part", *rest)).alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*parts[0].columns)
