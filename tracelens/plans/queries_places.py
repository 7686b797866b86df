"""Queries on photo places: neighbours, votes, distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.operators import geo as G
from tracelens.plans.registry import query, read

K = 15
# a made-up place for each label, the same in SQL
LAT, LON = "36.0 + label * 0.8", "-8.0 + label * 1.1"


def index_of(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "embedding", F.concat(F.lit("r"), F.col("label").cast("string")).alias("region"), F.expr(f"CASE WHEN vec_id % 11 = 0 THEN NULL ELSE {LAT} END").cast("double").alias("lat"), F.expr(f"CASE WHEN vec_id % 11 = 0 THEN NULL ELSE {LON} END").cast("double").alias("lon"))


def photos_of(spark, d):
    return read(spark, d, "embeddings").filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


KNN_SQL = f"""
WITH i AS (SELECT vec_id, embedding::DOUBLE[] AS v, 'r' || label AS region, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE {LAT} END::DOUBLE AS lat, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE {LON} END::DOUBLE AS lon FROM embeddings),
n AS (SELECT q.vec_id AS query_id, i.vec_id, list_inner_product(q.v, i.v) AS similarity, i.region, i.lat, i.lon,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, i.v) DESC, i.vec_id) AS rank FROM i q CROSS JOIN i WHERE q.vec_id % 25 = 0 QUALIFY rank <= {K})
"""


@query("j09_nearest_neighbours", KNN_SQL + "SELECT query_id, vec_id, rank, round(similarity, 5) AS similarity FROM n")
def j09(spark, d):
    return G.nearest(photos_of(spark, d), index_of(spark, d), K).select("query_id", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


HAV = "2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a))"


def hav_a(lat1, lon1, lat2, lon2):
    return f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"


VOTE_SQL = (
    KNN_SQL
    + """, v AS (SELECT query_id, region, count(*) AS votes, min(rank) AS r, avg(lat) AS lat, avg(lon) AS lon FROM n GROUP BY 1, 2),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, r) = 1),
f AS (SELECT b.query_id, b.region, b.votes, b.lat, b.lon, n.similarity, """
    + hav_a("n.lat", "n.lon", "b.lat", "b.lon")
    + """ AS a FROM b JOIN n ON n.query_id = b.query_id),
s AS (SELECT query_id, region, votes, lat, lon, avg(similarity) AS mean_similarity, CASE WHEN count(a) >= 3 THEN avg(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a))) END AS spread_km FROM f GROUP BY ALL)
"""
)


@query(
    "a16_region_vote",
    VOTE_SQL + f"SELECT query_id, region, votes, votes / {K}.0::DOUBLE AS confidence, round(lat, 4) AS lat, round(lon, 4) AS lon, round(mean_similarity, 5) AS mean_similarity, round(spread_km, 3) AS spread_km, coalesce(spread_km, 0) <= 300 AS representative FROM s",
)
def a16(spark, d):
    i = index_of(spark, d)
    n = G.nearest(photos_of(spark, d), i, K).join(i.select("vec_id", "region", "lat", "lon"), "vec_id")
    v = G.voted(n, K)
    return v.select("query_id", "region", "votes", "confidence", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("mean_similarity", 5).alias("mean_similarity"), F.round("spread_km", 3).alias("spread_km"), "representative")


@query(
    "j10_nearest_place",
    "WITH p AS (SELECT c_custkey AS point_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 36 + (c_custkey % 70) / 10.0 END::DOUBLE AS lat, (-8 + (c_custkey % 110) / 10.0)::DOUBLE AS lon FROM customer), "
    f"l AS (SELECT DISTINCT 'r' || label AS region, ({LAT})::DOUBLE AS lat, ({LON})::DOUBLE AS lon FROM embeddings), "
    f"d AS (SELECT point_id, region, coalesce({HAV}, 'infinity'::DOUBLE) AS km FROM (SELECT point_id, region, {hav_a('p.lat', 'p.lon', 'l.lat', 'l.lon')} AS a FROM p CROSS JOIN l)) "
    "SELECT point_id, region, round(km, 4) AS km FROM d QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY km, region) = 1",
)
def j10(spark, d):
    p = read(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 36 + (c_custkey % 70) / 10D END").alias("lat"), F.expr("-8 + (c_custkey % 110) / 10D").alias("lon"))
    places = read(spark, d, "embeddings").select(F.concat(F.lit("r"), F.col("label").cast("string")).alias("region"), F.expr(LAT).cast("double").alias("lat"), F.expr(LON).cast("double").alias("lon")).distinct()
    return G.nearest_place(p, places).withColumn("km", F.round("km", 4))


@query("s12_normalise_vectors", "SELECT vec_id, round(sqrt(list_inner_product(v, v)) / (sqrt(list_inner_product(v, v)) + 1e-8), 6) AS length, round(v[1] / (sqrt(list_inner_product(v, v)) + 1e-8), 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def s12(spark, d):
    v = read(spark, d, "embeddings").withColumn("u", G.normalized(F.col("embedding")))
    return v.select("vec_id", F.round(F.sqrt(G.dot(F.col("u"), F.col("u"))), 6).alias("length"), F.round(F.col("u")[0], 6).alias("first"))


@query("s11_index_read", "SELECT label, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY 1")
def s11(spark, d):
    return read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


@query("a39_map_centre", "SELECT coalesce(avg(lat), 40.0) AS lat, coalesce(avg(lon), -3.7) AS lon FROM (SELECT CASE WHEN vec_id % 11 = 0 THEN NULL ELSE 36.0 + label * 0.8 END::DOUBLE AS lat, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE -8.0 + label * 1.1 END::DOUBLE AS lon FROM embeddings)")
def a39(spark, d):
    return index_of(spark, d).agg(F.coalesce(F.avg("lat"), F.lit(40.0)).alias("lat"), F.coalesce(F.avg("lon"), F.lit(-3.7)).alias("lon"))


@query("p01_mappable_points", "SELECT vec_id % 11 <> 0 AS mappable, count(*) AS n FROM embeddings GROUP BY 1")
def p01(spark, d):
    return index_of(spark, d).groupBy((F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("mappable")).agg(F.count("*").alias("n"))


