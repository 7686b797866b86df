"""Queries on sources that are landed first: pages of platforms, shards, indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.operators import geo, labels, prompts
from tracelens.operators.progress import Progress
from tracelens.operators.shared import shared_path
from tracelens.plans.registry import Fixture, query, read
from tracelens.plans.report import flagship_report
from tracelens.sources import files, index, platforms, shards, social


def landed_conversations(spark, d, per_page: int = 3) -> str:
    """The turns of conversations as an Instagram account each, in pages."""
    c = read(spark, d, "conversations")
    item = F.to_json(F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" #"), "role").alias("caption"), F.date_format(F.timestamp_seconds(F.lit(1735689600) + F.col("turn") * 3600), "yyyy-MM-dd'T'HH:mm:ssxx").alias("timestamp"),
        F.lit("IMAGE").alias("media_type"), F.concat(F.lit("p"), "turn").alias("permalink"), F.length("text").alias("like_count"), F.col("turn").alias("comments_count"), F.concat(F.lit("u"), "conv_id").alias("media_url"),
    ))
    path = shared_path(spark, "landed")
    platforms.land(c.select(F.col("conv_id").cast("string").alias("profile_id"), F.col("turn").alias("seq"), item.alias("json")), path, per_page)
    return path


@query(
    "x01_platform_reader",
    """SELECT conv_id::VARCHAR AS profile_id, row_number() OVER w - 1 AS seq, conv_id || '-' || turn AS id, 'instagram' AS platform, 'image' AS type, role AS "group", text || ' #' || role AS text,
    TIMESTAMP '2025-01-01' + turn * INTERVAL 1 HOUR AS created_utc, length(text) + turn AS score, 'u' || conv_id AS media_url FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY row_number() OVER w <= 5""",
)
def x01(spark, d):
    posts = platforms.read_platform(spark, "instagram", landed_conversations(spark, d), limit=5)
    return posts.select("profile_id", "seq", "id", "platform", "type", "group", "text", F.col("created_utc").cast("timestamp_ntz").alias("created_utc"), "score", F.col("media_urls")[0].alias("media_url"))


def landed_documents(spark, d) -> str:
    """Documents as posts of a Reddit account a source."""
    docs = read(spark, d, "documents")
    item = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("subreddit"), F.concat(F.lit("doc "), "doc_id").alias("title"), F.col("text").alias("selftext"),
        (F.lit(1735689600.0) + F.col("doc_id")).alias("created_utc"), F.coalesce(F.length("text"), F.lit(0)).alias("score"), F.concat(F.lit("/d/"), "doc_id").alias("permalink"),
    ))
    path = shared_path(spark, "landed")
    platforms.land(docs.select(F.col("source").alias("profile_id"), F.col("doc_id").alias("seq"), item.alias("json")), path, 25, "reddit")
    return path


def landed_comments(spark, d) -> str:
    """Turns of conversations as comments of twenty accounts that are named as sources are."""
    c = read(spark, d, "conversations")
    item = F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("subreddit"), F.col("text").alias("body"), (F.lit(1735689600.0) + F.col("conv_id")).alias("created_utc"), F.col("turn").alias("score"), F.concat(F.lit("/c/"), "conv_id").alias("permalink")))
    path = shared_path(spark, "landed")
    platforms.land(c.select(F.concat(F.lit("src"), F.col("conv_id") % 20).alias("profile_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), item.alias("json")), path, 10, "reddit")
    return path


DOCUMENT_POSTS = """SELECT source AS profile_id, row_number() OVER w - 1 AS seq, doc_id::VARCHAR AS id, 'reddit' AS platform, 'post' AS type, lang AS "group", [lower(lang)] AS tags, 'doc ' || doc_id AS title, coalesce(nullif(text, ''), 'doc ' || doc_id) AS text,
    TIMESTAMP '2025-01-01' + doc_id * INTERVAL 1 SECOND AS created_utc, coalesce(length(text), 0) AS score, 'https://www.reddit.com/d/' || doc_id AS permalink FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id) QUALIFY row_number() OVER w <= 40"""
TURN_COMMENTS = """SELECT 'src' || conv_id % 20 AS profile_id, row_number() OVER w - 1 AS seq, conv_id || '-' || turn AS id, 'reddit' AS platform, 'comment' AS type, role AS "group", [lower(role)] AS tags, NULL AS title, coalesce(text, '') AS text,
    TIMESTAMP '2025-01-01' + conv_id * INTERVAL 1 SECOND AS created_utc, turn AS score, 'https://www.reddit.com/c/' || conv_id AS permalink FROM conversations WINDOW w AS (PARTITION BY conv_id % 20 ORDER BY conv_id * 1000 + turn) QUALIFY row_number() OVER w <= 15"""


def plain_posts(posts):
    return posts.withColumn("created_utc", F.col("created_utc").cast("timestamp_ntz")).drop("media_urls")


@query("s01_reddit_posts", DOCUMENT_POSTS)
def s01(spark, d):
    """Of each source the first 40 documents, as posts."""
    return plain_posts(platforms.read_platform(spark, "reddit", landed_documents(spark, d), limit=40))


@query("s02_reddit_comments", TURN_COMMENTS)
def s02(spark, d):
    return plain_posts(platforms.read_platform(spark, "reddit", landed_comments(spark, d), limit=15, kind="comment"))


@query("u01_posts_then_comments", f"WITH p AS ({DOCUMENT_POSTS}), c AS ({TURN_COMMENTS}), l AS (SELECT profile_id, max(seq) + 1 AS n FROM p GROUP BY 1) SELECT profile_id, seq, id, type FROM p UNION ALL SELECT profile_id, seq + coalesce(n, 0), id, type FROM c LEFT JOIN l USING (profile_id)")
def u01_posts(spark, d):
    posts = platforms.read_platform(spark, "reddit", landed_documents(spark, d), limit=40)
    comments = platforms.read_platform(spark, "reddit", landed_comments(spark, d), limit=15, kind="comment")
    return social.activity(posts, comments).select("profile_id", "seq", "id", "type")


@query("s03_avatar_unescape", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')) AS plain FROM pages WHERE html IS NOT NULL""")
def s03(spark, d):
    return read(spark, d, "pages").filter("html IS NOT NULL").select("page_id", F.md5(social.unescaped(F.col("html"))).alias("plain"))


@query("s04_paged_limit", "SELECT conv_id::VARCHAR AS profile_id, conv_id || '-' || turn AS id FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2")
def s04(spark, d):
    return platforms.read_platform(spark, "instagram", landed_conversations(spark, d, 1), limit=2).select("profile_id", "id")


MEDIA_TYPES = ["IMAGE", "VIDEO", "CAROUSEL_ALBUM"]


def landed_media(spark, d) -> str:
    """Documents as pictures, videos and albums of an account a source; captions hold tags."""
    k = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, MEDIA_TYPES)), (k % 3 + 1).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.struct(F.concat(F.lit("m"), k.cast("string"), F.lit("_"), i.cast("string")).alias("media_url"), F.when(i == 1, "VIDEO").otherwise("IMAGE").alias("media_type")))
    caption = F.when(k % 5 != 0, F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 200), F.lit(" #"), "lang", F.lit(" #Año"), k % 7))
    item = F.to_json(F.struct(
        k.cast("string").alias("id"), caption.alias("caption"), F.date_format(F.timestamp_seconds(F.lit(1735689600) + k * 60), "yyyy-MM-dd'T'HH:mm:ssxx").alias("timestamp"), kind.alias("media_type"), F.concat(F.lit("p"), k).alias("permalink"),
        F.when(k % 2 == 0, k).alias("like_count"), (k % 9).alias("comments_count"), F.when(kind != "CAROUSEL_ALBUM", F.concat(F.lit("u"), k)).alias("media_url"), F.when(kind == "CAROUSEL_ALBUM", F.struct(parts.alias("data"))).alias("children"),
    ))
    path = shared_path(spark, "landed")
    platforms.land(read(spark, d, "documents").select(F.col("source").alias("profile_id"), k.alias("seq"), item.alias("json")), path, 20)
    return path


MEDIA_SQL = r"""WITH c AS (SELECT *, CASE WHEN doc_id % 5 <> 0 THEN coalesce(text, '')[1:200] || ' #' || lang || ' #Año' || doc_id % 7 ELSE '' END AS caption, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq FROM documents),
    t AS (SELECT *, [lower(x) FOR x IN regexp_extract_all(caption, '#([\p{L}\p{N}_]+)', 1)] AS tags FROM c),
    m AS (SELECT source AS profile_id, seq, doc_id::VARCHAR AS id, ['image', 'video', 'carousel_album'][doc_id % 3 + 1] AS type, coalesce(tags[1], 'sin_etiqueta') AS "group", array_to_string(tags, ',') AS tags, md5(caption) AS text, TIMESTAMP '2025-01-01' + doc_id * INTERVAL 1 MINUTE AS created_utc,
      CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END + doc_id % 9 AS score, 'p' || doc_id AS permalink, CASE doc_id % 3 WHEN 0 THEN 'u' || doc_id WHEN 1 THEN '' ELSE array_to_string(['m' || doc_id || '_' || i FOR i IN range(0, doc_id % 4 + 1) IF i <> 1], ',') END AS urls FROM t WHERE seq < 30)
    """


def media_of(spark, d):
    return platforms.read_platform(spark, "instagram", landed_media(spark, d), limit=30)


@query("s06_instagram_media", MEDIA_SQL + "SELECT * FROM m")
def s06(spark, d):
    m = media_of(spark, d)
    return m.select("profile_id", "seq", "id", "type", "group", F.array_join("tags", ",").alias("tags"), F.md5("text").alias("text"), F.col("created_utc").cast("timestamp_ntz").alias("created_utc"), "score", "permalink", F.array_join("media_urls", ",").alias("urls"))


@query("g15_type_counts", MEDIA_SQL + "SELECT profile_id, 0 AS n_comments, count(*) AS n_media_items, sum(CASE WHEN urls = '' THEN 0 ELSE len(string_split(urls, ',')) END)::BIGINT AS n_photos, 0 AS n_posts FROM m GROUP BY 1")
def g15(spark, d):
    return social.type_counts(media_of(spark, d))


def odd_names(spark, d):
    """Customers under column names as others write them."""
    country = F.when(F.col("c_nationkey") % 3 == 0, " es ").when(F.col("c_nationkey") % 3 == 1, "Spain").otherwise("FR")
    return read(spark, d, "customer").select(F.col("c_custkey").alias("ID"), (F.col("c_nationkey") + 0.5).alias("Latitude"), (F.col("c_nationkey") - 0.5).alias("LNG"), F.col("c_mktsegment").alias("State"), country.alias("country"))


@query("s09_column_aliases", "SELECT c_custkey AS id, c_nationkey + 0.5::DOUBLE AS lat, c_nationkey - 0.5::DOUBLE AS lon, c_mktsegment AS region FROM customer")
def s09(spark, d):
    return files.resolved_columns(odd_names(spark, d))


@query("g07_country_filter", "SELECT c_custkey AS id FROM customer WHERE c_nationkey % 3 < 2")
def g07(spark, d):
    return files.of_countries(odd_names(spark, d), "country").select(F.col("ID").alias("id"))


@query("s16_run_log", "SELECT event_id % 5 AS n_photos, event_type AS platform, count(*) AS runs, count(*) FILTER (event_id % 3 = 0) AS with_ai, min(epoch_us(ts)) AS first_us FROM events WHERE event_id % 5 > 0 GROUP BY ALL")
def s16(spark, d):
    """A log that is appended to twice, the first time without one of the flags; runs without photos are not logged."""
    e = read(spark, d, "events").select(F.expr("unix_micros(cast(ts AS timestamp)) / 1e6").alias("timestamp"), F.col("event_type").alias("platform"), (F.col("event_id") % 5).cast("int").alias("n_photos"), (F.col("event_id") % 3 == 0).alias("ai_enabled"))
    log = shared_path(spark, "log")
    files.append_run_log(e.filter("NOT ai_enabled").drop("ai_enabled"), log)
    files.append_run_log(e.filter("ai_enabled"), log)
    runs = files.read_run_log(spark, log)
    return runs.groupBy(F.col("n_photos").cast("long").alias("n_photos"), "platform").agg(F.count("*").alias("runs"), F.count_if("ai_enabled").alias("with_ai"), F.min(F.expr("unix_micros(at)")).alias("first_us"))


LETTERS = "[(length(text) - length(replace(replace(text, chr((97 + i)::INT), ''), chr((65 + i)::INT), '')))::DOUBLE FOR i IN range(26)]"


@query(
    "x05_index_build",
    f"""WITH c AS (SELECT doc_id, source, {LETTERS} AS n FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 3),
    p AS (SELECT doc_id, source, [list_sum([n[i + 1] * ((7 * i + 13 * j + i * j) % 11 - 5) FOR i IN range(26)]) FOR j IN range(16)] AS v FROM c),
    u AS (SELECT doc_id, source, [x / sqrt(list_inner_product(v, v)) FOR x IN v] AS v FROM p WHERE list_inner_product(v, v) > 0)
    SELECT q.doc_id AS query_id, i.doc_id AS vec_id, 's' || i.source AS region, i.doc_id / 100.0 AS lat, row_number() OVER (PARTITION BY q.doc_id ORDER BY round(list_inner_product(q.v, i.v), 9) DESC, i.doc_id) AS rank,
    round(list_inner_product(q.v, i.v), 6) AS similarity FROM u q, u i WHERE q.doc_id % 100 = 0 QUALIFY rank <= 10""",
)
def x05(spark, d):
    """An index of documents with a sidecar, read back for the neighbours of every hundredth; every seventh has no file."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", F.concat(F.lit("s"), "source").alias("region"), (F.col("doc_id") / 100).alias("lat"), F.lit(None).cast("double").alias("lon"))
    path = shared_path(spark, "index")
    index.build(docs, path, index.LetterProjection, files=docs.filter("vec_id % 7 <> 3").select(F.col("vec_id").cast("string").alias("id")))
    built = index.load(spark, path)
    queries = built.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = geo.nearest(queries, built, 10, digits=9).join(built.select("vec_id", "region", "lat"), "vec_id")
    return near.select("query_id", "vec_id", "region", "lat", "rank", F.round("similarity", 6).alias("similarity"))


def shards_of(spark, d, per_shard: int = 40) -> str:
    path = shared_path(spark, "shards")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    shards.packed(docs, path, per_shard).write.format("noop").mode("overwrite").save()
    return path


BUDGET_SQL = """WITH s AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 40 AS k, strlen(coalesce(text, '')) AS bytes, coalesce(text, '') AS text FROM documents),
    p AS (SELECT k, coalesce(sum(bytes) FILTER (doc_id % 3 = 0), 0)::BIGINT AS size FROM s WHERE k % 5 <> 1 GROUP BY k),
    b AS (SELECT k, size, coalesce(sum(size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1000 AS before FROM p),
    c AS (SELECT * FROM b WHERE before < (SELECT sum(bytes) // 10 FROM s))
    """


def shards_in_budget(spark, d):
    """Shards of documents of which every third is wanted and every fifth shard is done; the budget is a tenth of all bytes, 1000 of them used."""
    path = shards_of(spark, d)
    found = shards.listing(spark, f"{path}/*.zip")
    done = found.filter(F.substring("shard", 1, 6).cast("int") % 5 == 1)
    docs = read(spark, d, "documents")
    wanted = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"))
    budget = docs.agg(F.expr("sum(octet_length(coalesce(text, ''))) div 10")).first()[0]
    return shards.within_budget(found.join(done.select("shard"), "shard", "left_anti"), wanted, budget, 1000), wanted


@query("a42_shards_in_budget", BUDGET_SQL + "SELECT printf('%06d.zip', k) AS shard, size, before FROM c")
def a42(spark, d):
    return shards_in_budget(spark, d)[0].select("shard", "size", "before")


@query("s10_wanted_members", BUDGET_SQL + "SELECT printf('%06d.zip', k) AS shard, doc_id::VARCHAR AS id, bytes AS n_bytes, sha256(text) AS sha FROM s JOIN c USING (k) WHERE doc_id % 3 = 0")
def s10(spark, d):
    chosen, wanted = shards_in_budget(spark, d)
    return shards.taken(chosen, wanted).select("shard", "id", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha"))


TRANSLATIONS = Fixture(
    "lang string, key string, text string",
    [
        ("es", "attribute.ubicacion_provincia", "Vive en la provincia de {{value}}"), ("en", "attribute.ubicacion_provincia", "Lives in the province of {{value}}"), ("en", "attribute.view", "Has seen: {{value}}, {{value}}"),
        ("es", "attribute.view", "Ha visto: {{value}}"), ("en", "attribute.click", "Clicked {{value}} in {{place}}"), ("en", "value.view.3", "three"), ("es", "value.view.3", "tres"), ("en", "value.click.7", "seven"),
        ("es", "note.2", "nota dos"), ("en", "note.2", "note two"), ("en", "note.4", "note four"),
    ],
)


@query(
    "f36_labels",
    f"""WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'ubicacion' ELSE event_type END AS category, CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'provincia' WHEN 1 THEN 'municipio' END END AS level,
        CASE WHEN event_id % 13 = 0 THEN NULL ELSE (user_id % 10)::VARCHAR END AS value, 'evento ' || event_id AS attribute_label, CASE WHEN event_id % 2 = 0 THEN (event_id % 7)::VARCHAR END AS code, 'nota ' || (event_id % 9) AS note FROM events),
    l AS (SELECT e.*, lang, CASE WHEN category = 'ubicacion' AND level IS NOT NULL THEN 'ubicacion_' || level ELSE category END AS k FROM e, (VALUES ('es'), ('en')) AS v(lang)), t AS (SELECT * FROM {TRANSLATIONS.sql()})
    SELECT event_id, lang, coalesce(replace((SELECT any_value(text) FROM t WHERE t.lang = l.lang AND key = 'attribute.' || k), '{{{{value}}}}', coalesce((SELECT any_value(text) FROM t WHERE t.lang = l.lang AND key = 'value.' || category || '.' || value), value)), attribute_label) AS label,
    coalesce((SELECT any_value(text) FROM t WHERE t.lang = l.lang AND key = 'note.' || code), note) AS shown_note FROM l""",
)
def f36(spark, d):
    """Events as steps in two languages, with values, templates and notes that only one of them knows, or none."""
    level = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "provincia").when(F.col("event_id") % 3 == 1, "municipio"))
    steps = read(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "ubicacion").otherwise(F.col("event_type")).alias("category"), level.alias("location_level"), F.when(F.col("event_id") % 13 != 0, (F.col("user_id") % 10).cast("string")).alias("value_raw"),
        F.concat(F.lit("evento "), "event_id").alias("attribute_label"), F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 7).cast("string")).alias("note_code"), F.concat(F.lit("nota "), F.col("event_id") % 9).alias("note"),
    )
    return labels.labelled(steps, TRANSLATIONS.frame(spark), ["es", "en"]).select("event_id", "lang", "label", "shown_note")


@query(
    "x03_progress_counts",
    r"""WITH p AS (SELECT source, doc_id, lang FROM documents WHERE regexp_extract(source, '(\d+)', 1)::INT % 3 <> 0)
    SELECT 'reading_posts' AS stage, count(*) AS rows FROM p UNION ALL SELECT s, (SELECT count(DISTINCT source) FROM p) FROM (VALUES ('analyzing_writing_style'), ('computing_score'), ('generating_report')) AS t(s)""",
)
def x03(spark, d):
    """Rows by stage of a run of the report, counted as they pass."""
    progress = Progress()
    flagship_report(spark, d, progress).write.format("noop").mode("overwrite").save()
    rows = [(stage, figures["rows"]) for stage, figures in progress.counts().items() if stage != "detecting_attributes"]
    return spark.createDataFrame(rows, "stage string, rows long")


@query("j12_with_files", "SELECT doc_id FROM documents WHERE doc_id // 20 < (SELECT (count(*) + 39) // 40 FROM documents)")
def j12(spark, d):
    """Documents whose number by twenties has a shard; there are half as many shards."""
    docs = read(spark, d, "documents").select("doc_id", F.lpad(F.expr("doc_id div 20").cast("string"), 6, "0").alias("id"))
    return files.with_files(docs, files.present_files(spark, f"{shards_of(spark, d)}/*.zip")).select("doc_id")


@query("t11_shards", "SELECT printf('%06d', k) AS id FROM (SELECT unnest(range((SELECT (count(*) + 39) // 40 FROM documents))) AS k) WHERE k < 3")
def t11(spark, d):
    return files.shard_list(files.present_files(spark, f"{shards_of(spark, d)}/*.zip"), 3)


@query("g16_available", "SELECT count(*) > 40 AS two_shards, false AS four_digits FROM documents")
def g16(spark, d):
    """Whether the files that a step needs are there."""
    there = files.present_files(spark, f"{shards_of(spark, d)}/*.zip")
    two = prompts.available(there, ("000000", "000001")).withColumnRenamed("available", "two_shards")
    return two.withColumn("four_digits", F.lit(prompts.available(there, ("000000", "0001")).first()[0]))
