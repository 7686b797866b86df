"""Queries on activity and words: histograms, groups, evidence, scores, keywords, guards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelens.functions import text as T
from tracelens.operators import activity as A
from tracelens.operators import reference_etl as E
from tracelens.operators.findings import consented
from tracelens.plans import scoring
from tracelens.plans.registry import query, read


def posts_of_events(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("profile_id"), F.col("event_id").alias("seq"), F.col("ts").alias("created_utc"), F.col("event_type").alias("group"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("permalink"), "value", F.array().cast("array<string>").alias("tags"))


def posts_of_documents(spark, d):
    return read(spark, d, "documents").select(F.col("source").alias("profile_id"), F.col("doc_id").alias("seq"), "text", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("permalink"))


@query(
    "a01_hour_histogram",
    """WITH n AS (SELECT user_id AS profile_id, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
    t AS (SELECT profile_id, sum(n) AS total FROM n GROUP BY 1)
    SELECT t.profile_id, h.hour, coalesce(n.n, 0)::DOUBLE / t.total AS share
    FROM t CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN n ON n.profile_id = t.profile_id AND n.hour = h.hour""",
)
def a01(spark, d):
    return A.hour_shares(posts_of_events(spark, d))


@query(
    "a15_peak_hour",
    """WITH n AS (SELECT user_id AS profile_id, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT profile_id, hour AS peak_hour, n::DOUBLE / sum(n) OVER (PARTITION BY profile_id) AS peak_share FROM n
    QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, hour) = 1""",
)
def a15(spark, d):
    return A.peak_hours(A.hour_shares(posts_of_events(spark, d)))


@query(
    "a02_top_groups",
    """SELECT user_id AS profile_id, event_type AS "group", count(*) AS posts,
    row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS rank FROM events GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) <= 15""",
)
def a02(spark, d):
    return A.top_groups(posts_of_events(spark, d))


@query(
    "a04_type_token_ratio",
    """WITH w AS (SELECT source AS profile_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents)
    SELECT profile_id, count(DISTINCT w)::DOUBLE / count(*) AS richness, count(*) AS tokens FROM w GROUP BY 1""",
)
def a04(spark, d):
    return A.richness(posts_of_documents(spark, d))


@query(
    "a03_sentence_length",
    r"""WITH s AS (SELECT source AS profile_id, unnest(string_split_regex(regexp_replace(text, '([.!?…])\s+', '\1' || chr(10), 'g'), '\n+')) AS s FROM documents)
    SELECT profile_id, avg(len(regexp_extract_all(s, '\p{L}+|[0-9]+|[^\s\p{L}0-9]'))) AS avg_sentence_length, count(*) AS sentences FROM s WHERE trim(s) <> '' GROUP BY 1""",
)
def a03(spark, d):
    return A.sentence_lengths(posts_of_documents(spark, d))


@query(
    "a05_emoji_rate",
    r"""SELECT source AS profile_id, sum(len(regexp_extract_all(text, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]')))::DOUBLE / greatest(sum(length(text)), 1) AS emoji_rate FROM documents GROUP BY 1""",
)
def a05(spark, d):
    return A.emoji_rate(posts_of_documents(spark, d), T.EMOJI)


@query(
    "a06_ordered_concat",
    """SELECT conv_id AS profile_id, md5(substr(string_agg(text, chr(10) ORDER BY turn, text), 1, 200000)) AS text_md5,
    length(substr(string_agg(text, chr(10) ORDER BY turn, text), 1, 200000)) AS chars FROM conversations WHERE text IS NOT NULL GROUP BY 1""",
)
def a06(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("profile_id"), F.col("turn").alias("seq"), "text")
    return A.joined_text(c).select("profile_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


@query(
    "a07_mode_with_confidence",
    """WITH h AS (SELECT user_id, event_id, event_type FROM events WHERE contains(event_type, 'c') OR event_type IN ('view')),
    c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM h GROUP BY 1, 2),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1),
    e AS (SELECT user_id, list('e' || event_id ORDER BY event_id) AS ev FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM h) WHERE r <= 5 GROUP BY 1)
    SELECT b.user_id AS profile_id, 'probe' AS category, b.event_type AS value, b.n, round_even(least(0.4 + 0.05 * b.n, 0.9), 2)::DOUBLE AS confidence, e.ev AS evidence
    FROM b JOIN e ON b.user_id = e.user_id""",
)
def a07(spark, d):
    return A.tagged(posts_of_events(spark, d), "probe", ("c",), ("view",), 0.4, 0.9)


@query(
    "a08_capped_confidence",
    "SELECT user_id AS profile_id, event_type, count(*) AS n, least(0.3 + 0.05 * count(*), 0.8)::DOUBLE AS confidence FROM events GROUP BY 1, 2",
)
def a08(spark, d):
    n = read(spark, d, "events").groupBy(F.col("user_id").alias("profile_id"), "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("confidence", A.capped(F.col("n"), 0.3, 0.05, 0.8))


@query(
    "a09_first_evidence",
    """SELECT user_id AS profile_id, list('e' || event_id ORDER BY event_id) AS evidence FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 5 GROUP BY 1""",
)
def a09(spark, d):
    return A.evidence(posts_of_events(spark, d))


@query(
    "a10_first_non_null",
    """SELECT user_id AS profile_id, arg_min(CASE WHEN value > 50 THEN event_type END, CASE WHEN value > 50 THEN event_id END) AS first_high FROM events GROUP BY 1""",
)
def a10(spark, d):
    return A.first_said(posts_of_events(spark, d), F.when(F.col("value") > 50, F.col("group"))).withColumnRenamed("value", "first_high")


@query(
    "a11_any_signal",
    """SELECT source AS profile_id, bool_or(contains(text, 'Apache')) AS apache, bool_or(contains(text, '@')) AS at_sign,
    bool_or(length(text) > 20000) AS very_long, count(*) FILTER (contains(text, '@')) AS n_at FROM documents GROUP BY 1""",
)
def a11(spark, d):
    t = F.col("text")
    s = A.signals(posts_of_documents(spark, d), apache=F.contains(t, F.lit("Apache")), at=F.contains(t, F.lit("@")), very_long=F.length(t) > 20000)
    return s.select("profile_id", "apache", F.col("at").alias("at_sign"), "very_long", "n_at")


KEYWORDS_SQL = r"""
WITH p AS (SELECT conv_id AS profile_id, turn AS seq, text FROM conversations WHERE length(text) > 20 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1),
e AS (SELECT profile_id, count(*) AS docs FROM p GROUP BY 1 HAVING count(*) >= 3),
w AS (SELECT profile_id, seq, docs, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM p JOIN e USING (profile_id)),
g AS (SELECT profile_id, seq, docs, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] ELSE [] END)) AS term FROM w),
tf AS (SELECT profile_id, seq, docs, term, count(*) AS tf FROM g GROUP BY ALL),
k AS (SELECT profile_id, term, docs, sum(tf) AS n, count(*) AS df FROM tf GROUP BY profile_id, term, docs QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY sum(tf) DESC, term) <= 500),
x AS (SELECT tf.profile_id, seq, tf.term, tf * (ln((1 + k.docs) / (1 + df)) + 1) AS x FROM tf JOIN k ON tf.profile_id = k.profile_id AND tf.term = k.term),
s AS (SELECT profile_id, term, sum(x / nrm) AS score FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY profile_id, seq)) AS nrm FROM x) GROUP BY 1, 2)
SELECT profile_id, term, round(score, 6) AS score, row_number() OVER (PARTITION BY profile_id ORDER BY round(score, 9) DESC, term) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY round(score, 9) DESC, term) <= 20
"""


@query("a23_keywords", KEYWORDS_SQL)
def a23(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("profile_id"), F.col("turn").alias("seq"), "text").filter(F.length("text") > 20)
    w = Window.partitionBy("profile_id", "seq").orderBy("text")
    c = c.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return A.keywords(c).withColumn("score", F.round("score", 6))


@query(
    "f14_language",
    r"""WITH w AS (SELECT source AS profile_id, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w,
      generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1) AS i FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY doc_id, i) AS k FROM w)
    SELECT profile_id, CASE WHEN count(DISTINCT CASE WHEN w IN ('que','de','la','el','en','y','los','se','un','por') THEN w END) >= 3 THEN 'es' ELSE 'en' END AS language
    FROM r WHERE k <= 300 GROUP BY 1""",
)
def f14(spark, d):
    return A.language(posts_of_documents(spark, d), T.SPANISH_MARKERS)


@query(
    "g01_consent_gate",
    "SELECT user_id AS profile_id, count(*) AS posts FROM events WHERE user_id % 3 <> 0 GROUP BY 1",
)
def g01(spark, d):
    e = posts_of_events(spark, d)
    agreed = e.select("profile_id").distinct().filter("profile_id % 3 <> 0")
    return consented(e, agreed).groupBy("profile_id").agg(F.count("*").alias("posts"))


@query("g02_platform_dispatch", "SELECT DISTINCT event_type AS platform, event_type IN ('view', 'click') AS supported FROM events")
def g02(spark, d):
    return read(spark, d, "events").select(F.col("event_type").alias("platform")).distinct().withColumn("supported", F.col("platform").isin("view", "click"))


@query("g03_empty_activity", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def g03(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return A.without_posts(read(spark, d, "customer"), o, "c_custkey").select("c_custkey", "c_name")


@query("g04_nonempty_text", "SELECT lang, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1")
def g04(spark, d):
    return A.with_text(read(spark, d, "documents")).groupBy("lang").agg(F.count("*").alias("n"))


@query("g05_long_text", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE length(text) > 20 GROUP BY 1")
def g05(spark, d):
    return A.with_text(read(spark, d, "documents"), 20).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("g14_projection", "SELECT event_id, user_id AS profile_id, ts AS created_utc, event_type AS \"group\", value::BIGINT AS score FROM events WHERE value IS NOT NULL")
def g14(spark, d):
    return read(spark, d, "events").filter("value IS NOT NULL").select("event_id", F.col("user_id").alias("profile_id"), F.col("ts").alias("created_utc"), F.col("event_type").alias("group"), F.bround("value").cast("long").alias("score"))


SCORE_SQL = """
WITH h AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT user_id AS profile_id, sum(n) AS posts, max(n)::DOUBLE / sum(n) AS peak_share FROM h GROUP BY 1),
r AS (SELECT user_id AS profile_id, count(DISTINCT event_type)::DOUBLE / count(*) AS richness FROM events GROUP BY 1),
a AS (SELECT user_id AS profile_id, CASE event_type WHEN 'view' THEN 'ubicacion' WHEN 'click' THEN 'ocupacion' ELSE 'rutina' END AS category, least(0.3 + 0.01 * count(*), 0.8)::DOUBLE AS confidence FROM events GROUP BY user_id, event_type),
g AS (SELECT profile_id, coalesce(max(CASE WHEN category = 'ubicacion' THEN confidence END), 0) AS geo, sum(confidence) AS s, bool_or(category = 'ocupacion') AS works FROM a GROUP BY 1),
s AS (SELECT p.profile_id, least(geo * 100, 100) AS geolocation_risk, least(s / 6 * 100, 100) AS inferable_data_risk,
  least((least(posts / 200.0, 1) * 0.4 + CASE WHEN richness > 0 THEN greatest(0, least(1, 1 - abs(richness - 0.45) / 0.45)) ELSE 0 END * 0.3 + peak_share * 0.3) * 100, 100) AS deanonymization_ease, peak_share, works
  FROM p JOIN r USING (profile_id) JOIN g USING (profile_id))
"""


def scores(spark, d):
    posts = posts_of_events(spark, d)
    shares = A.peak_hours(A.hour_shares(posts)).select("profile_id", "peak_share")
    base = posts.groupBy("profile_id").agg(F.count("*").alias("posts"), (F.count_distinct("group") / F.count("*")).alias("richness")).join(shares, "profile_id")
    kind = F.when(F.col("group") == "view", "ubicacion").when(F.col("group") == "click", "ocupacion").otherwise("rutina")
    attributes = posts.groupBy("profile_id", "group").agg(F.round(F.least(F.lit(0.3) + 0.01 * F.count("*"), F.lit(0.8)), 2).alias("confidence")).select("profile_id", kind.alias("category"), "confidence")
    return scoring.scored(base, attributes, scoring.double_sum)


@query("f23_privacy_score", SCORE_SQL + "SELECT profile_id, round(geolocation_risk * 0.35 + inferable_data_risk * 0.45 + deanonymization_ease * 0.2, 6) AS overall_score, round(geolocation_risk, 6) AS geolocation_risk, round(inferable_data_risk, 6) AS inferable_data_risk, round(deanonymization_ease, 6) AS deanonymization_ease FROM s")
def f23(spark, d):
    names = ["overall_score", "geolocation_risk", "inferable_data_risk", "deanonymization_ease"]
    return scores(spark, d).select("profile_id", *[F.round(n, 6).alias(n) for n in names])


@query(
    "f24_recommendations",
    SCORE_SQL
    + """, c AS (SELECT profile_id, [x FOR x IN [CASE WHEN geolocation_risk > 30 THEN 'avoid_place_tags' END, CASE WHEN inferable_data_risk > 40 THEN 'review_history' END,
    CASE WHEN deanonymization_ease > 50 THEN 'vary_activity' END, CASE WHEN peak_share > 0.25 THEN 'peak_hour' END, CASE WHEN works THEN 'professional_groups' END] IF x IS NOT NULL] AS c FROM s)
    SELECT profile_id, CASE WHEN len(c) > 0 THEN c ELSE ['low_exposure'] END AS codes FROM c""",
)
def f24(spark, d):
    return scoring.recommendations(scores(spark, d))


@query(
    "f34_score_label",
    "SELECT p_partkey, CASE WHEN p_size < 25 THEN 'bajo' WHEN p_size < 55 THEN 'moderado' WHEN p_size < 80 THEN 'alto' ELSE 'critico' END AS label FROM part",
)
def f34(spark, d):
    return read(spark, d, "part").select("p_partkey", scoring.score_label(F.col("p_size")).alias("label"))


@query("f35_chart_scale", "SELECT event_id, round_even(value * 1000, 0) / 10 AS scaled FROM events WHERE value IS NOT NULL")
def f35(spark, d):
    return read(spark, d, "events").filter("value IS NOT NULL").select("event_id", E.scaled_percent(F.col("value")).alias("scaled"))


@query(
    "w07_stage_changes",
    """SELECT user_id, event_id, event_type AS stage, previous_stage FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_stage FROM events)
    WHERE previous_stage IS DISTINCT FROM event_type""",
)
def w07(spark, d):
    e = read(spark, d, "events").withColumnRenamed("event_type", "stage")
    return A.changes(e, "user_id", "stage", "ts", "event_id").select("user_id", "event_id", "stage", "previous_stage")


@query("t07_volume_limit", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def t07(spark, d):
    return A.newest(read(spark, d, "events"), 20, F.desc("ts"), F.desc("event_id"), by="user_id").select("user_id", "event_id")


@query("t08_head_of_text", "SELECT doc_id, substr(text, 1, 600) AS head FROM documents WHERE text IS NOT NULL")
def t08(spark, d):
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.substring("text", 1, 600).alias("head"))


@query("u01_concat", "SELECT user_id, event_id, 0 AS part FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id, 1 FROM events WHERE event_type = 'click'")
def u01(spark, d):
    e = read(spark, d, "events")
    one, two = (e.filter(F.col("event_type") == t).select("user_id", "event_id", F.lit(n).alias("part")) for n, t in enumerate(("view", "click")))
    return one.unionByName(two)


@query("u02_set_union", "SELECT user_id FROM events WHERE event_type = 'view' AND value > 90 UNION SELECT user_id FROM events WHERE event_type = 'click' AND value > 95")
def u02(spark, d):
    e = read(spark, d, "events")
    return A.either(e.filter("event_type = 'view' AND value > 90").select("user_id"), e.filter("event_type = 'click' AND value > 95").select("user_id"))


@query("u05_set_difference", "SELECT p_brand FROM part EXCEPT SELECT p_brand FROM part WHERE p_size > 48")
def u05(spark, d):
    p = read(spark, d, "part")
    return A.only_first(p.select("p_brand"), p.filter("p_size > 48").select("p_brand"))


@query(
    "u06_marker_intersection",
    "SELECT doc_id, len(list_intersect(string_split(lower(text), ' '), ['que','de','la','el','en','y','los','se','un','por'])) AS markers FROM documents WHERE text IS NOT NULL",
)
def u06(spark, d):
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", A.markers_in(F.col("text"), T.SPANISH_MARKERS).alias("markers"))


@query("u07_concat_dedupe", "SELECT DISTINCT n_nationkey AS id, n_name AS name FROM nation")
def u07(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return A.first_of_each(n, n.filter("id < 10"), key="id")
