"""Queries on sources, reference data, run logs and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.operators import reference_etl as E
from tracelens.operators import run_logs as L
from tracelens.operators.shared import shared_path
from tracelens.plans.registry import query, read
from tracelens.sources import files


@query("g09_label_segments", "SELECT p_partkey, string_split(p_name, ' ')[2] AS second FROM part WHERE len(string_split(p_name, ' ')) >= 2 AND starts_with(p_name, 's')")
def g09(spark, d):
    parts = E.segments(F.col("p_name"))
    return read(spark, d, "part").filter((F.size(parts) >= 2) & F.startswith("p_name", F.lit("s"))).select("p_partkey", F.element_at(parts, 2).alias("second"))


@query("g10_plausible_range", "SELECT round(avg(l_discount)::DOUBLE, 6) AS rate FROM lineitem")
def g10(spark, d):
    a = read(spark, d, "lineitem").agg(F.round(F.avg("l_discount").cast("double"), 6).alias("x"))
    return a.select(E.within(F.col("x"), 0.0, 0.2, "discount").alias("rate"))


@query("a26_latest_per_key", "SELECT o_custkey, arg_max(o_totalprice, o_orderkey)::DOUBLE AS price FROM (SELECT * FROM orders QUALIFY dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1) GROUP BY 1")
def a26(spark, d):
    o = read(spark, d, "orders")
    return E.latest(o, "o_custkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey")).select("o_custkey", F.col("o_totalprice").cast("double").alias("price"))


@query("a27_share_of_total", "SELECT c_mktsegment, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 3) AS share FROM customer GROUP BY 1")
def a27(spark, d):
    n = read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return E.shares(n, "n")


@query("a28_sum_by_category", "SELECT CASE WHEN contains(p_type, 'ARGE') THEN 'large' WHEN contains(p_type, 'SMA') THEN 'small' ELSE 'other' END AS category, sum(l_quantity)::DOUBLE AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def a28(spark, d):
    parts = read(spark, d, "part").select("p_partkey", E.category_of(F.col("p_type"), (("ARGE", "large"), ("SMA", "small")), "other").alias("category"))
    lines = read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("quantity"))
    return E.sums_by_category(lines, parts, "p_partkey", "quantity").withColumn("quantity", F.col("quantity").cast("double"))


@query("a29_residual_share", "WITH s AS (SELECT round(avg((o_orderstatus = 'F')::INT)::DOUBLE, 3) AS f, round(avg((o_orderstatus = 'O')::INT)::DOUBLE, 3) AS o FROM orders) SELECT f, o, round(1 - (f + o), 3) AS rest FROM s")
def a29(spark, d):
    s = read(spark, d, "orders").agg(*[F.round(F.avg((F.col("o_orderstatus") == k).cast("int")), 3).alias(k.lower()) for k in "FO"])
    return s.withColumn("rest", F.round(E.completed([F.col("f"), F.col("o")]), 3))


@query("a30_rates_to_shares", "SELECT n_nationkey, round(a * (1 - u), 6) AS active, round(a * u, 6) AS unemployed, round((1 - a) * 0.57, 6) AS retired, round((1 - a) * 0.20, 6) AS students, round((1 - a) * 0.23, 6) AS others FROM (SELECT n_nationkey, 0.5::DOUBLE + n_nationkey / 100.0::DOUBLE AS a, 0.1::DOUBLE AS u FROM nation)")
def a30(spark, d):
    shares = E.activity_shares(F.lit(0.5) + F.col("n_nationkey") / 100.0, F.lit(0.1))
    return read(spark, d, "nation").select("n_nationkey", *(F.round(c, 6).alias(k) for k, c in shares.items()))


@query(
    "a31_two_step_allocation",
    "WITH p AS (SELECT p_brand AS branch, p_type AS part, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT p_brand AS branch, sum(p_retailprice)::DOUBLE AS total FROM part GROUP BY 1) SELECT branch, part, round(total * n / sum(n) OVER (PARTITION BY branch) / 1e6, 9) AS share FROM p JOIN t USING (branch)",
)
def a31(spark, d):
    p = read(spark, d, "part")
    parts = p.groupBy(F.col("p_brand").alias("branch"), F.col("p_type").alias("part")).agg(F.count("*").alias("n"))
    totals = p.groupBy(F.col("p_brand").alias("branch")).agg(F.sum("p_retailprice").cast("double").alias("total"))
    return E.allocated(parts, totals, "branch", "n", "total", 1e6).select("branch", "part", F.round("share", 9).alias("share"))


@query("a32_control_total", "SELECT abs(sum(n) - (SELECT count(*) FROM part)) <= 0.02 * (SELECT count(*) FROM part) AS agrees FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def a32(spark, d):
    p = read(spark, d, "part")
    return p.groupBy("p_brand").agg(F.count("*").alias("n")).agg(E.agrees(p, "n", float(p.count())))


@query(
    "a33_multi_key_stats",
    """SELECT event_type, hour(ts) AS hour, user_id % 2 = 0 AS even, value > 50 AS high, user_id % 3 = 0 AS third, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median
    FROM events GROUP BY 1, 2, 3, 4, 5""",
)
def a33(spark, d):
    keys = ["event_type", F.hour("ts").alias("hour"), (F.col("user_id") % 2 == 0).alias("even"), (F.col("value") > 50).alias("high"), (F.col("user_id") % 3 == 0).alias("third")]
    return L.stats(read(spark, d, "events"), keys, "value", ("n", "total", "mean", "median"))


@query("a34_stage_stats", "SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS most FROM events GROUP BY 1")
def a34(spark, d):
    return L.stats(read(spark, d, "events"), [F.col("event_type").alias("stage")], "value", ("n", "mean", "median", "most"))


@query("a35_platform_stats", "SELECT o_orderstatus AS platform, count(*) AS n, round(avg(o_totalprice)::DOUBLE, 4) AS mean, round(median(o_totalprice)::DOUBLE, 4) AS median FROM orders GROUP BY 1")
def a35(spark, d):
    o = read(spark, d, "orders").withColumn("x", F.col("o_totalprice").cast("double"))
    return L.stats(o, [F.col("o_orderstatus").alias("platform")], "x", digits=4)


@query("a36_correlation", "SELECT CASE WHEN count(DISTINCT l_quantity) > 1 THEN round(corr(l_quantity, l_extendedprice)::DOUBLE, 6) END AS r FROM lineitem")
def a36(spark, d):
    return L.correlation(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("a37_distinct", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def a37(spark, d):
    return L.distinct(read(spark, d, "orders"), customers="o_custkey", priorities="o_orderpriority")


@query("a38_stage_timer", "SELECT user_id AS run, event_type AS stage, round(sum(value), 6) AS seconds FROM events GROUP BY 1, 2")
def a38(spark, d):
    e = read(spark, d, "events")
    return L.stats(e, [F.col("user_id").alias("run"), F.col("event_type").alias("stage")], "value", ("total",)).withColumnRenamed("total", "seconds")


@query("a40_map_explode", "SELECT user_id AS run, event_type AS stage, round(max(value), 6) AS seconds FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def a40(spark, d):
    steps = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), F.round("value", 6).alias("seconds"))
    return L.stages_of(L.stage_maps(steps))


@query("a41_array_mean", "SELECT vec_id, round(list_avg([round(x, 3) FOR x IN embedding::DOUBLE[]]), 6) AS mean FROM embeddings")
def a41(spark, d):
    v = F.transform("embedding", lambda x: F.round(x.cast("double"), 3))
    return read(spark, d, "embeddings").select("vec_id", F.round(L.mean_of(v), 6).alias("mean"))


@query("a43_labels_known", "SELECT DISTINCT p_brand AS label, p_brand IN ('Brand#1', 'Brand#2') AS known FROM part")
def a43(spark, d):
    return L.known_labels(read(spark, d, "part"), "p_brand", ("Brand#1", "Brand#2"))


@query("a44_duplicate_series", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def a44(spark, d):
    return L.repeated(read(spark, d, "part"), "p_name")


@query("j07_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j07(spark, d):
    return E.without(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").filter("toxic = 1"), "doc_id")


@query("j08_left_lookup", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j08(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("j11_semi_and_missing", "SELECT doc_id, EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND n_chars > 1000) AS found FROM labels l")
def j11(spark, d):
    return E.found_in(read(spark, d, "labels").select("doc_id"), read(spark, d, "documents").filter("n_chars > 1000"), "doc_id")


DIFF_SQL = "a AS (SELECT c_nationkey AS k, count(*) AS v FROM customer GROUP BY 1), b AS (SELECT c_nationkey + 1 AS k, count(*) AS v FROM customer GROUP BY 1)"


@query("j13_differences", f"WITH {DIFF_SQL} SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new, CASE WHEN b.k IS NULL THEN 'gone' WHEN a.k IS NULL THEN 'added' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def j13(spark, d):
    c = read(spark, d, "customer")
    a, b = (c.groupBy((F.col("c_nationkey") + n).alias("k")).agg(F.count("*").alias("v")) for n in (0, 1))
    return E.differences(a, b, "k", "v")


@query("s20_upsert", "WITH o AS (SELECT n_nationkey AS k, n_nationkey * 10 AS v FROM nation), n AS (SELECT n_nationkey + 20 AS k, -n_nationkey AS v FROM nation) SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v, row_number() OVER (ORDER BY o.k NULLS LAST, n.k) - 1 AS ord FROM o FULL JOIN n ON o.k = n.k")
def s20(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    old = n.select("k", (F.col("k") * 10).alias("v"), F.col("k").alias("ord"))
    return E.upserted(old, n.select((F.col("k") + 20).alias("k"), (-F.col("k")).alias("v")), "k", "v")


@query("j14_canonical_names", "SELECT n_nationkey, CASE n_name WHEN 'NATION_0' THEN 'cero' WHEN 'NATION_1' THEN 'uno' ELSE lower(n_name) END AS name FROM nation")
def j14(spark, d):
    names = spark.createDataFrame([("NATION_0", "cero"), ("NATION_1", "uno")], "n_name string, own string")
    return E.canonical(read(spark, d, "nation"), "n_name", names).select("n_nationkey", "name")


@query("f31_multi_label", r"SELECT p_partkey, unnest([x FOR x IN [CASE WHEN regexp_matches(p_name, 'bolt|gear') THEN 'metal' END, CASE WHEN regexp_matches(p_type, '^(LARGE|ECONOMY)') THEN 'size' END, CASE WHEN contains(p_name, 'red') THEN 'red' END] IF x IS NOT NULL]) AS label FROM part")
def f31(spark, d):
    rules = (("metal", "p_name", "bolt|gear"), ("size", "p_type", "^(LARGE|ECONOMY)"), ("red", "p_name", "red"))
    return read(spark, d, "part").select("p_partkey", F.explode(F.array_compact(F.array(*[F.when(F.col(c).rlike(p), k) for k, c, p in rules]))).alias("label"))


@query("j15_category_map", "SELECT CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'high' ELSE 'low' END AS category, count(*) AS n FROM orders GROUP BY 1")
def j15(spark, d):
    return E.counts_by_category(read(spark, d, "orders"), "o_orderpriority", E.category_of(F.col("o_orderpriority"), (("^[12]", "high"),), "low"))


@query("w08_latest_non_null", "SELECT event_id, coalesce(CASE WHEN value > 80 THEN value END, CASE WHEN value > 40 THEN value / 2 END, -1)::DOUBLE AS v FROM events")
def w08(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select("event_id", F.coalesce(F.when(v > 80, v), F.when(v > 40, v / 2), F.lit(-1.0)).alias("v"))


@query("t10_sorted_first", "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1 ORDER BY mean DESC, event_type LIMIT 1")
def t10(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean")).orderBy(F.desc("mean"), "event_type").limit(1)


@query("s18_report_json", "SELECT c_custkey, md5('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}') AS json_md5 FROM customer")
def s18(spark, d):
    """Reports as a JSON line each, read back as they stand there."""
    path = shared_path(spark, "reports")
    files.write_reports(read(spark, d, "customer").select("c_custkey", "c_name"), path)
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.c_custkey").cast("long").alias("c_custkey"), F.md5("value").alias("json_md5"))
