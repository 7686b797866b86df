"""Queries on lookups, bands and merges of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.functions import text as T
from tracelens.operators import activity as A
from tracelens.operators import findings as O
from tracelens.operators import reference_etl as E
from tracelens.plans import narrowing
from tracelens.plans.registry import query, read


@query(
    "a12_running_product",
    """SELECT l_orderkey, l_linenumber, round(product(1 - l_discount::DOUBLE) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING), 9) AS kept FROM
    (SELECT l_orderkey, l_linenumber, max(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2)""",
)
def a12p(spark, d):
    lines = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("x"))
    return lines.select("l_orderkey", "l_linenumber", F.round(narrowing.running(1 - F.col("x").cast("double"), "l_orderkey", "l_linenumber"), 9).alias("kept"))


@query("f21_risk_bands", "SELECT c_custkey, CASE WHEN c_acctbal >= 100000 THEN 'bajo' WHEN c_acctbal >= 1000 THEN 'medio' WHEN c_acctbal >= 20 THEN 'alto' ELSE 'critico' END AS risk FROM customer WHERE c_acctbal IS NOT NULL")
def f21(spark, d):
    return read(spark, d, "customer").filter("c_acctbal IS NOT NULL").select("c_custkey", narrowing.risk(F.col("c_acctbal")).alias("risk"))


@query("f25_age_band", "SELECT p_partkey, CASE WHEN p_size + 40 >= 85 THEN '85+' ELSE (p_size + 40) // 5 * 5 || '-' || ((p_size + 40) // 5 * 5 + 4) END AS band FROM part")
def f25(spark, d):
    return read(spark, d, "part").select("p_partkey", E.age_band(F.col("p_size") + 40).alias("band"))


@query("a25_band_to_years", "WITH b AS (SELECT n_nationkey * 5 AS lo, n_nationkey * 5 + 4 AS hi, (1 + n_nationkey) / 100.0 AS p FROM nation) SELECT unnest(range(lo, hi + 1))::INT AS age, round(p / 5, 8)::DOUBLE AS p FROM b")
def a25(spark, d):
    b = read(spark, d, "nation").select((F.col("n_nationkey") * 5).cast("int").alias("lo"), ((1 + F.col("n_nationkey")) / 100).alias("share"))
    return E.years_of(b, "lo", "share").withColumn("p", F.round("p", 8))


@query("a24_community_population", "SELECT r_name AS community, count(*) AS provinces, sum(c)::BIGINT AS population FROM region JOIN nation ON r_regionkey = n_regionkey JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1")
def a24(spark, d):
    n = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    by = read(spark, d, "nation").join(n, "n_nationkey").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return E.populations_of(by, "r_name", "c").withColumnsRenamed({"r_name": "community", "parts": "provinces"})


@query("j16_hierarchy_inverted", "SELECT n_name AS province, r_name AS community FROM nation JOIN region ON n_regionkey = r_regionkey")
def j16(spark, d):
    n = read(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("provinces"))
    r = read(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    return E.inverted(r, "r_name", "provinces", "province").withColumnRenamed("r_name", "community")


@query("j01_share_lookup", "WITH s AS (SELECT c_mktsegment AS segment, count(*)::DOUBLE / (SELECT count(*) FROM customer) AS share FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) SELECT c_custkey, round(share, 9) AS share FROM customer LEFT JOIN s ON segment = c_mktsegment")
def j01(spark, d):
    c = read(spark, d, "customer")
    n = c.count()
    s = c.filter("c_mktsegment <> 'BUILDING'").groupBy("c_mktsegment").agg((F.count("*") / n).alias("share"))
    return E.share_of(c, "c_mktsegment", s).select("c_custkey", F.round("share", 9).alias("share"))


@query(
    "j04_first_key_in_text",
    "SELECT p_partkey, [k FOR k IN ['green', 'blue', 'red', 'a'] IF contains(lower(p_name), k)][1] AS key FROM part",
)
def j04(spark, d):
    return read(spark, d, "part").select("p_partkey", T.first_key(F.lower("p_name"), ["green", "blue", "red", "a"]).alias("key"))


@query("j05_tag_match", "SELECT p_partkey, len([t FOR t IN string_split(lower(p_name), ' ') IF t = 'ring' OR contains(t, 'olt')]) > 0 AS hit FROM part")
def j05(spark, d):
    tags = F.split(F.lower("p_name"), " ")
    return read(spark, d, "part").select("p_partkey", A.matching_tag(tags, ("olt",), ("ring",)).isNotNull().alias("hit"))


@query(
    "j17_merge",
    """SELECT coalesce(a.o_custkey, b.o_custkey) AS profile_id, coalesce(a.v, b.v) AS value, CASE WHEN a.o_custkey IS NOT NULL THEN 'texto' ELSE 'ia' END AS source FROM
    (SELECT o_custkey, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.o_custkey = b.o_custkey""",
)
def j17(spark, d):
    def side(status, source):
        o = read(spark, d, "orders").filter(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("profile_id")).agg(F.max("o_orderpriority").alias("value"))
        return o.withColumns({"field": F.lit("f"), "source": F.lit(source)})

    return O.merged(side("F", "texto"), side("O", "ia")).select("profile_id", "value", "source")


@query("f17_before_bracket", "SELECT p_partkey, string_split(p_name, ' ')[1] AS head FROM part")
def f17(spark, d):
    return read(spark, d, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("head"))


@query("f33_figures", "SELECT n_nationkey, round_even(1 / p, 0)::BIGINT AS figures, round_even(1 / p, 0) > 100 AS compact FROM (SELECT n_nationkey, 1.0::DOUBLE / (3 + n_nationkey * n_nationkey) AS p FROM nation)")
def f33(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", F.bround(1 / (F.lit(1.0) / (3 + F.col("n_nationkey") * F.col("n_nationkey"))), 0).cast("long").alias("figures"))
    return n.withColumn("compact", F.col("figures") > 100)


def tag_attributes(posts):
    """The union of the three kinds of attributes that tags and phrases hint at."""
    return (
        A.tagged(posts, "ubicacion", A.PLACE_TAGS, A.PLACE_EXACT, 0.4, 0.9)
        .unionByName(A.tagged(posts, "ocupacion", A.WORK_TAGS, A.WORK_EXACT, 0.3, 0.8))
        .unionByName(A.phrase_hits(posts, "rutina", T.ROUTINE, 0.6))
    )
