"""Queries on streams; each runs as a Structured Streaming query over the files that are there, or that land in slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.operators.shared import shared_path, stored
from tracelens.plans.registry import query, read
from tracelens.sources import files
from tracelens.streaming import feeds, runs
from tracelens.streaming import metrics as M


def requests_of(e):
    code = F.when(F.col("event_id") % 17 == 0, "503").when(F.col("event_id") % 29 == 0, "404").otherwise("200")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run_id"), F.col("event_type").alias("route"), F.col("event_type").alias("stage"), code.alias("code"), F.col("value").alias("seconds"))


def events_of(spark, d):
    return requests_of(M.file_stream(spark, d, "events.parquet", read(spark, d, "events").schema))


DAYS = 8


def slices_of(events, n: int = 4, shift=None):
    """Events as they land: slice k has those of DAYS days, the k-th from the first day on; shift: by how many slices a row comes later."""
    first = events.agg(F.to_date(F.min("ts"))).first()[0]
    place = F.floor(F.datediff(F.to_date("ts"), F.lit(first)) / DAYS) + (F.lit(0) if shift is None else shift)
    return [events.filter(F.least(place, F.lit(n - 1)) == k) for k in range(n)]


def flat(df):
    return df.withColumn("start", F.col("w.start").cast("timestamp_ntz")).drop("w")


@query("r07_requests_per_window", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS requests FROM events GROUP BY 1")
def r07(spark, d):
    return flat(feeds.once(M.requests_per_minute(events_of(spark, d), length="1 hour")))


@query("r08_errors_per_window", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS requests FROM events WHERE event_id % 17 = 0 GROUP BY 1")
def r08(spark, d):
    return flat(feeds.once(M.requests_per_minute(events_of(spark, d), errors_only=True, length="1 hour")))


@query("r10_mean_duration", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type AS route, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def r10(spark, d):
    return flat(feeds.once(M.durations(events_of(spark, d), "6 hours"))).select("start", "route", "n", F.round("mean", 6).alias("mean"))


@query("r09_duration_quantiles", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type AS route, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY 1, 2")
def r09(spark, d):
    q = flat(M.exact_quantiles(feeds.once(M.value_counts(events_of(spark, d), "1 day"))))
    return q.select("start", "route", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"))


@query(
    "r09_merged_sketches",
    "SELECT time_bucket(INTERVAL '6 days', ts, TIMESTAMP '1970-01-01') AS start, event_type AS route, count(*) AS n, true AS p50_within, true AS p90_within FROM events GROUP BY 1, 2",
)
def r09_sketches(spark, d):
    """Quantiles of six days from sketches of six hours, which a stream has stored; are their ranks within the stated error of what was asked for?"""
    parts = feeds.once(M.duration_sketches(events_of(spark, d), "6 hours"))
    q = M.quantiles_over(parts, "6 days")
    e = requests_of(read(spark, d, "events")).select(F.window("ts", "6 days").alias("w"), "route", "seconds")
    ranked = e.join(q, ["w", "route"]).groupBy("w", "route", "n")
    bound = M.RANK_ERROR + 1 / F.col("n")  # to the next value
    share = [(F.count_if(F.col("seconds") < F.col("q")[k]) / F.count("*"), F.count_if(F.col("seconds") <= F.col("q")[k]) / F.count("*")) for k in (0, 1)]
    out = ranked.agg(*(x.alias(f"{side}{k}") for k, pair in enumerate(share) for side, x in zip(("low", "high"), pair, strict=True)))
    within = [((F.col(f"low{k}") <= F.lit(p) + bound) & (F.col(f"high{k}") >= F.lit(p) - bound)).alias(f"p{int(p * 100)}_within") for k, p in enumerate((0.5, 0.9))]
    return flat(out.select("w", "route", "n", *within))


CHANGES = """SELECT user_id AS run_id, event_id, event_type AS stage, previous FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
    WHERE previous IS DISTINCT FROM event_type"""


@query("r04_stage_changes", CHANGES)
def r04(spark, d):
    """In slices, with state over them; nobody is idle for 60 days."""
    e = slices_of(requests_of(read(spark, d, "events")))
    return feeds.fed(e, lambda s: runs.stage_changes(s, 60 * runs.DAY_MS)).select("run_id", "event_id", "stage", "previous")


@query("r03_track_progress", "SELECT user_id AS run_id, event_type AS track, max(event_id % 50) AS done, 45::BIGINT AS total, max(event_id % 50) >= 45 AS complete FROM events GROUP BY 1, 2")
def r03(spark, d):
    e = requests_of(read(spark, d, "events")).select("run_id", F.col("stage").alias("track"), "ts", (F.col("event_id") % 50).alias("done"), F.lit(45).cast("long").alias("total"))
    return runs.latest_progress(feeds.fed(slices_of(e), runs.track_progress, "update"))


@query(
    "r01_life_of_runs",
    """WITH e AS (SELECT *, lag(ts) OVER w AS last_ts, lag(event_type) OVER w AS last_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(CASE WHEN last_ts IS NULL OR last_type = 'purchase' OR ts - last_ts > INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
    g AS (SELECT user_id, run, min(ts) AS began, max(ts) AS ended, count(*) AS events, list_sort(list(DISTINCT event_type)) AS stages, bool_or(event_type = 'purchase') AS done FROM r GROUP BY ALL)
    SELECT user_id AS run_id, began, ended, events, stages, CASE WHEN done THEN 'done' ELSE 'timed out' END AS ending FROM g
    WHERE done OR run < (SELECT max(run) FROM g AS h WHERE h.user_id = g.user_id) OR ended + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def r01(spark, d):
    """A run of a user ends with a purchase, or a day after its last event; those that haven't ended are still state."""
    e = requests_of(read(spark, d, "events")).withColumn("done", F.col("stage") == "purchase")
    out = feeds.fed(slices_of(e), runs.lives)
    return out.select("run_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "events", "stages", "ending")


def shift_of(event_id):
    """Which events come a slice late, and which three."""
    return F.when(event_id % 101 == 0, 3).when(event_id % 11 == 0, 1).otherwise(0)


@query(
    "r07_sliding_late_rows",
    f"""WITH e AS (SELECT *, least(datediff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) // {DAYS} + CASE WHEN event_id % 101 = 0 THEN 3 WHEN event_id % 11 = 0 THEN 1 ELSE 0 END, 3) AS k FROM events),
    -- the watermark that a slice meets: the last time of the slices before it, less ten days
    m AS (SELECT s.k, coalesce((SELECT max(ts) FROM e WHERE e.k < s.k) - INTERVAL 10 DAY, TIMESTAMP '1970-01-01') AS mark FROM range(0, 5) s(k)),
    kept AS (SELECT ts FROM e JOIN m USING (k) WHERE ts > mark)
    SELECT t AS start, count(*) AS requests FROM (SELECT unnest([time_bucket(INTERVAL '4 hours', ts) - i * INTERVAL '4 hours' FOR i IN range(0, 6)]) AS t FROM kept)
    WHERE t + INTERVAL '24 hours' <= (SELECT mark FROM m WHERE k = 4) GROUP BY t""",
)
def r07_late(spark, d):
    """Windows of a day every four hours over events that land in four slices: every seventh comes again in the next slice, every 11th a slice late,
    every 101st three slices late, which is behind the watermark of ten days unless its slice is the last in any case."""
    e = stored(requests_of(read(spark, d, "events")), "requests")
    own, again = slices_of(e, shift=shift_of(F.col("event_id"))), slices_of(e.filter("event_id % 7 = 0 AND event_id % 11 != 0 AND event_id % 101 != 0"), shift=F.lit(1))
    again[0] = again[0].limit(0)
    slices = [a.unionByName(b) for a, b in zip(own, again, strict=True)]
    return flat(feeds.fed(slices, lambda s: M.sliding_requests(s, "24 hours", "4 hours", "10 days")))


@query(
    "r05_stage_codes",
    f"""SELECT code, CASE WHEN code IS NULL THEN stage END AS stage, count(*) AS n FROM (SELECT event_type AS stage, CASE event_type WHEN 'signup' THEN 'connecting' WHEN 'view' THEN 'reading_posts' WHEN 'click' THEN 'detecting_attributes'
    WHEN 'error' THEN CASE WHEN datediff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) >= {2 * DAYS} THEN 'computing_score' END END AS code FROM events) GROUP BY ALL""",
)
def r05(spark, d):
    """Names of stages to codes; a name that is added before the third slice counts from there on, others are counted as unknown."""
    path = shared_path(spark, "codes")
    known = [[("signup", "connecting", 1), ("view", "reading_posts", 1), ("click", "computing_score", 1)], [("click", "detecting_attributes", 2)], [("error", "computing_score", 3)]]

    def more(k):
        if k == 0:  # the first two versions are there before anything comes
            for rows in known[:2]:
                spark.createDataFrame(rows, "name string, code string, version long").write.mode("append").parquet(path)
        elif k == 2:
            spark.createDataFrame(known[2], "name string, code string, version long").write.mode("append").parquet(path)

    e = slices_of(requests_of(read(spark, d, "events")))
    return runs.code_counts(feeds.fed(e, lambda s: s.select("event_id", "stage"), between=more, write=runs.coded(path)))


@query("r06_tailed_log", "SELECT event_type AS platform, count(*) AS runs, sum(event_id % 5)::BIGINT AS photos, round(sum(value), 4) AS seconds FROM events WHERE event_id % 5 > 0 GROUP BY 1")
def r06(spark, d):
    """A log of runs that grows in slices, tailed into a table; runs without photos are not logged."""
    e = read(spark, d, "events").select("ts", F.expr("unix_micros(cast(ts AS timestamp)) / 1e6").alias("timestamp"), F.col("event_type").alias("platform"), (F.col("event_id") % 5).cast("int").alias("n_photos"), F.col("value").alias("total_seconds"))
    log, out, state = (shared_path(spark, f"log-{x}") for x in ("lines", "table", "state"))
    for part in slices_of(e):
        files.append_run_log(part.drop("ts"), log)
        tail = feeds.tail_run_log(spark, log)
        feeds.started(tail, feeds.sink(out), state, every=None).awaitTermination()
    runs_ = feeds.kept(spark, out, tail.schema)
    return runs_.groupBy("platform").agg(F.count("*").alias("runs"), F.sum("n_photos").alias("photos"), F.round(F.sum("total_seconds"), 4).alias("seconds"))
