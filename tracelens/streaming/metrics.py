"""Service metrics over streams of events (event_id, ts, route, code, seconds)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LATE = "10 minutes"


def file_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Rows of the files of that name in a folder, as they come."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def requests_per_minute(events: DataFrame, errors_only: bool = False, length: str = "1 minute", slide: str | None = None) -> DataFrame:
    e = events.filter(F.col("code").rlike("^5")) if errors_only else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return e.withWatermark("ts", LATE).groupBy(w.alias("w")).agg(F.count("*").alias("requests"))


def durations(events: DataFrame, length: str = "10 minutes") -> DataFrame:
    """Number and mean of the seconds by route."""
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", length).alias("w"), "route").agg(F.count("*").alias("n"), (F.sum("seconds") / F.count("*")).alias("mean"))


def value_counts(events: DataFrame, length: str = "10 minutes") -> DataFrame:
    """Of each window and route how often each number of seconds came, to be stored; exact_quantiles() reads it. State is a count a
    value, spread over the tasks by value, so no window's rows meet in one."""
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", length).alias("w"), "route", "seconds").agg(F.count("*").alias("n"))


def exact_quantiles(counts: DataFrame, at: tuple[str, ...] = ("0.5", "0.9")) -> DataFrame:
    """w, route, n, q: the smallest value with at least that share of the rows at or below it, from counts of values; values that are null
    don't count, of a route without others q is null. Shares are decimals, so no rank is off by a rounding."""
    by = Window.partitionBy("w", "route")
    known = F.when(F.col("seconds").isNotNull(), F.col("n")).otherwise(F.lit(0))
    c = counts.withColumns({"_below": F.sum(known).over(by.orderBy("seconds")), "_n": F.sum(known).over(by)})
    found = [F.min(F.when(F.col("seconds").isNotNull() & (F.col("_below") >= F.lit(Decimal(x)) * F.col("_n")), F.col("seconds"))) for x in at]
    return c.groupBy("w", "route").agg(F.max("_n").alias("n"), F.array(*found).alias("q"))


def distinct_requests(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events without those that come again, which is remembered until the watermark has passed them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sliding_requests(events: DataFrame, length: str = "1 minute", slide: str = "5 seconds", late: str = LATE) -> DataFrame:
    """Requests in each window of `length` that begins every `slide`, once the watermark has passed its end; repeats count once, rows
    behind the watermark don't count. State holds the ids and windows that the watermark hasn't passed."""
    e = distinct_requests(events, late)
    return e.groupBy(F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("requests"))


#: Size of a sketch: a value's rank is known to RANK_ERROR of all rows, with 99 % confidence.
SKETCH, RANK_ERROR = 400, 0.0085


def duration_sketches(events: DataFrame, length: str = "10 minutes", size: int = SKETCH) -> DataFrame:
    """Of each window and route the rows and a mergeable sketch of their seconds, to be stored."""
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", length).alias("w"), "route").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("seconds", F.lit(size)).alias("sketch"))


def quantiles_over(sketches: DataFrame, length: str, at: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Quantiles over any longer windows, from stored sketches alone: w, route, n, q."""
    merged = sketches.groupBy(F.window(F.col("w.start"), length).alias("w"), "route").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select("w", "route", "n", F.array(*(F.kll_sketch_get_quantile_double("sketch", F.lit(x)) for x in at)).alias("q"))
