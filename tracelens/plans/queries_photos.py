"""Queries on what photos add to a report, on files, and on the report itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.functions import text as T
from tracelens.operators import geo as G
from tracelens.operators import photos as P
from tracelens.operators import reference_etl as E
from tracelens.operators.shared import shared_path
from tracelens.plans.queries_places import K, VOTE_SQL, index_of, photos_of
from tracelens.plans.registry import query, read
from tracelens.plans.report import flagship_report
from tracelens.sources import files


def photos_of_embeddings(spark, d):
    """Two photos a post; some with inferences, places, partners and descriptions."""
    e = read(spark, d, "embeddings")
    one = F.struct(F.lit("aficion").alias("category"), F.concat(F.lit("h"), F.col("label").cast("string")).alias("value"), F.lit(0.5).alias("confidence"), F.array(F.lit("v")).alias("evidence"))
    two = F.struct(F.lit("objeto").alias("category"), F.concat(F.lit("o"), (F.col("vec_id") % 3).cast("string")).alias("value"), F.lit(0.25).alias("confidence"), F.lit(None).cast("array<string>").alias("evidence"))
    return e.select(
        F.concat(F.lit("u"), F.col("label").cast("string")).alias("profile_id"), F.concat(F.lit("p"), F.floor(F.col("vec_id") / 2).cast("string")).alias("permalink"), F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("photo_link"),
        F.when(F.col("vec_id") % 4 == 0, F.lit("r")).alias("region"), F.lit(0.5).alias("confidence"), F.when(F.col("vec_id") % 5 == 0, F.array(one, two)).otherwise(F.array(one)).alias("inferences"), (F.col("vec_id") % 7 == 0).alias("partner"),
        F.when(F.col("vec_id") % 6 == 0, F.concat(F.lit("d"), F.col("vec_id").cast("string"))).otherwise("").alias("description"),
    )


@query(
    "d11_photo_inferences",
    """SELECT 'u' || label AS profile_id, 'p' || vec_id AS photo_link, 'aficion' AS category, 'h' || label AS value, 0.5::DOUBLE AS confidence, ['v', 'p' || vec_id // 2] AS evidence FROM embeddings
    UNION ALL SELECT 'u' || label, 'p' || vec_id, 'objeto', 'o' || vec_id % 3, 0.25, ['p' || vec_id // 2] FROM embeddings WHERE vec_id % 5 = 0""",
)
def d11(spark, d):
    return P.inferences(photos_of_embeddings(spark, d))


@query("d11_photo_estimates", "SELECT 'u' || label AS profile_id, 'p' || vec_id // 2 AS permalink, 'p' || vec_id AS photo_link, 'r' AS region, 0.5::DOUBLE AS confidence FROM embeddings WHERE vec_id % 4 = 0")
def d11_estimates(spark, d):
    return P.estimates(photos_of_embeddings(spark, d))


@query("d11_photo_descriptions", "SELECT 'p' || vec_id AS photo_link, 'd' || vec_id AS description FROM embeddings WHERE vec_id % 6 = 0")
def d11_descriptions(spark, d):
    return P.descriptions(photos_of_embeddings(spark, d), "description")


@query("d11_partner_posts", "SELECT DISTINCT 'u' || label AS profile_id, 'p' || vec_id // 2 AS permalink FROM embeddings WHERE vec_id % 7 = 0")
def d11_partners(spark, d):
    return P.partner_posts(photos_of_embeddings(spark, d))


def findings_of_customers(spark, d):
    c = read(spark, d, "customer")
    field = F.element_at(F.array(F.lit("provincia"), F.lit("edad"), F.lit("estado_civil"), F.lit("municipio")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("profile_id"), field.alias("field"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("value"), F.lit("texto").alias("source"), F.lit(None).cast("double").alias("confidence"), F.array(F.lit("t")).alias("evidence"))


FINDINGS_SQL = """f AS (SELECT c_custkey AS profile_id, ['provincia', 'edad', 'estado_civil', 'municipio'][c_custkey % 4 + 1] AS field, 'n' || c_nationkey AS value, 'texto' AS source, NULL::DOUBLE AS confidence, ['t'] AS evidence FROM customer)"""


@query(
    "d12_home_applied",
    f"""WITH {FINDINGS_SQL}, h AS (SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 5 = 0 THEN 'provincia' ELSE 'comunidad_autonoma' END AS field, 'k' || c_nationkey AS value, 'imagen' AS source, NULL::DOUBLE AS confidence, ['i', 'j'] AS evidence FROM customer WHERE c_custkey % 3 = 0)
    SELECT * FROM f UNION ALL SELECT * FROM h WHERE profile_id NOT IN (SELECT profile_id FROM f WHERE field IN ('provincia', 'municipio', 'comunidad_autonoma'))""",
)
def d12(spark, d):
    c = read(spark, d, "customer").filter("c_custkey % 3 = 0")
    homes = c.select(F.col("c_custkey").alias("profile_id"), F.when(F.col("c_custkey") % 5 == 0, "provincia").otherwise("comunidad_autonoma").alias("level"), F.concat(F.lit("k"), F.col("c_nationkey").cast("string")).alias("key"), F.array(F.lit("i"), F.lit("j")).alias("evidence"))
    return P.with_home(findings_of_customers(spark, d), homes)


@query(
    "d06_partner_from_photos",
    f"""WITH {FINDINGS_SQL}, s AS (SELECT o_custkey AS profile_id, list_sort(list_distinct(list(o_orderpriority))) AS evidence FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT * FROM f UNION ALL SELECT profile_id, 'estado_civil', 'con_pareja', 'imagen', NULL, evidence FROM s WHERE profile_id NOT IN (SELECT profile_id FROM f WHERE field = 'estado_civil')""",
)
def d06(spark, d):
    posts = read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderpriority").alias("permalink"))
    return P.with_partner(findings_of_customers(spark, d), posts)


@query(
    "u03_attribute_bag",
    """SELECT user_id AS profile_id, event_type AS category, NULL::DOUBLE AS confidence FROM events UNION ALL SELECT o_custkey, o_orderpriority, 0.5 FROM orders UNION ALL SELECT o_custkey, o_orderpriority, 0.5 FROM orders WHERE o_orderstatus = 'F'""",
)
def u03(spark, d):
    tags = read(spark, d, "events").select(F.col("user_id").alias("profile_id"), F.col("event_type").alias("category"))
    soft = read(spark, d, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderpriority").alias("category"), F.lit(0.5).alias("confidence"), "o_orderstatus")
    return P.all_attributes(tags, soft.drop("o_orderstatus"), soft.filter("o_orderstatus = 'F'").drop("o_orderstatus"))


@query(
    "f02_titles",
    r"""SELECT p_partkey, list_aggregate([upper(x[1]) || lower(x[2:]) FOR x IN regexp_extract_all(s, '[a-zA-Z]+|[^a-zA-Z]+')], 'string_agg', '') AS title, rtrim(trim(s), '.') AS unended
    FROM (SELECT p_partkey, '  ' || p_name || '''s ' || p_type || '-' || p_brand || '...' AS s FROM part)""",
)
def f02(spark, d):
    s = F.concat(F.lit("  "), "p_name", F.lit("'s "), "p_type", F.lit("-"), "p_brand", F.lit("..."))
    return read(spark, d, "part").select("p_partkey", T.titled(s).alias("title"), T.unended(s).alias("unended"))


@query("a45_sample_names", "SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'zzz') ORDER BY 1 LIMIT 12")
def a45(spark, d):
    return E.sample_names(read(spark, d, "part"), "p_name", ("RED", "zzz"), 12)


@query("a45_sample_of_all", "SELECT DISTINCT p_name FROM part ORDER BY 1 LIMIT 12")
def a45_all(spark, d):
    return E.sample_names(read(spark, d, "part"), "p_name", ("no such part",), 12)


@query("p02_markers", VOTE_SQL + f"SELECT query_id, round(8 + votes / {K}.0::DOUBLE * 10, 6) AS radius, floor(votes / {K}.0::DOUBLE * 100 + 0.5)::BIGINT AS percent FROM s")
def p02(spark, d):
    i = index_of(spark, d)
    n = G.nearest(photos_of(spark, d), i, K).join(i.drop("embedding"), "vec_id")
    return G.voted(n, K).select("query_id", F.round(P.marker_radius(F.col("confidence")), 6).alias("radius"), P.percent(F.col("confidence")).alias("percent"))


@query("p03_footnotes", "SELECT DISTINCT o_custkey AS profile_id, CASE o_orderstatus WHEN 'F' THEN 'imagen' ELSE 'ia_nombre' END AS note FROM orders WHERE o_orderstatus IN ('F', 'P')")
def p03(spark, d):
    source = F.when(F.col("o_orderstatus") == "F", "imagen").when(F.col("o_orderstatus") == "P", "ia_nombre").otherwise("texto")
    return P.footnotes(read(spark, d, "orders").select(F.col("o_custkey").alias("profile_id"), source.alias("source")))


@query("s19_details", "SELECT o_orderstatus AS university, o_orderpriority AS degree, count(*) AS students FROM orders GROUP BY 1, 2")
def s19(spark, d):
    path = shared_path(spark, "details")
    rows = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("university"), F.col("o_orderpriority").alias("degree")).agg(F.count("*").alias("students"))
    files.write_details(rows, path)
    return spark.read.schema(rows.schema).json(path)


def metadata_csv(spark, d):
    path = shared_path(spark, "metadata")
    c = read(spark, d, "customer")
    country = F.when(F.col("c_nationkey") % 3 == 0, " es ").when(F.col("c_nationkey") % 3 == 1, "Spain").otherwise("FR")
    c.select(F.col("c_custkey").alias("ID"), (F.col("c_nationkey") + 0.5).alias("Latitude"), (F.col("c_nationkey") - 0.5).alias("LNG"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("State"), country.alias("country")).write.option("header", True).csv(path)
    return path


METADATA_SQL = "SELECT c_nationkey + 0.5::DOUBLE AS lat, c_nationkey - 0.5::DOUBLE AS lon, 's' || c_nationkey AS region, c_custkey AS id FROM customer"


@query("s08_metadata_of_country", METADATA_SQL + " WHERE c_nationkey % 3 < 2")
def s08(spark, d):
    return files.read_metadata(spark, metadata_csv(spark, d), "country").withColumn("id", F.col("id").cast("long"))


@query("s25_metadata_of_all", METADATA_SQL)
def s25(spark, d):
    return files.read_metadata(spark, metadata_csv(spark, d)).withColumn("id", F.col("id").cast("long"))


@query(
    "d08_report",
    r"""WITH p AS (SELECT source AS profile_id, doc_id, text, lang, to_timestamp(1735689600 + doc_id * 5400) AS t FROM documents WHERE regexp_extract(source, '(\d+)', 1)::INT % 3 <> 0),
    n AS (SELECT profile_id, count(*) AS n_posts FROM p GROUP BY 1),
    w AS (SELECT profile_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM p), r AS (SELECT profile_id, count(DISTINCT w)::DOUBLE / count(*) AS richness FROM w GROUP BY 1),
    h AS (SELECT profile_id, (1735689600 + doc_id * 5400) // 3600 % 24 AS hour, count(*) AS n FROM p GROUP BY 1, 2),
    k AS (SELECT profile_id, hour AS peak_hour FROM h QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, hour) = 1),
    l AS (SELECT profile_id, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1) AS i FROM p),
    g AS (SELECT profile_id, CASE WHEN count(DISTINCT CASE WHEN w IN ('que','de','la','el','en','y','los','se','un','por') THEN w END) >= 3 THEN 'es' ELSE 'en' END AS language
      FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY doc_id, i) AS k FROM l) WHERE k <= 300 GROUP BY 1),
    t AS (SELECT profile_id, lang, count(*) AS c, row_number() OVER (PARTITION BY profile_id ORDER BY count(*) DESC, min(doc_id)) AS rank FROM p GROUP BY 1, 2)
    SELECT n.profile_id, n_posts, round(richness, 9) AS richness, peak_hour::INT AS peak_hour, language, (SELECT string_agg(lang || '=' || c, ',' ORDER BY rank) FROM t WHERE t.profile_id = n.profile_id) AS top_groups
    FROM n LEFT JOIN r USING (profile_id) LEFT JOIN k USING (profile_id) LEFT JOIN g USING (profile_id)""",
)
def d08(spark, d):
    """The report's parts that SQL can say; the others have queries of their own."""
    groups = F.array_join(F.transform("top_groups", lambda g: F.concat(g["group"], F.lit("="), g["posts"].cast("string"))), ",")
    return flagship_report(spark, d).select("profile_id", "n_posts", F.round("richness", 9).alias("richness"), "peak_hour", "language", groups.alias("top_groups"))
