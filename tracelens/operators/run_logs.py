"""Figures of run logs: by stage, platform and several keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(rows: DataFrame, keys: list, value: str, figures: tuple[str, ...] = ("n", "mean", "median"), digits: int = 6) -> DataFrame:
    """keys and figures (n, total, mean, median, most) of a value, rounded; nulls count in n only."""
    x = F.col(value)
    known = {"n": F.count("*"), "total": F.round(F.sum(x), digits), "mean": F.round(F.avg(x), digits), "median": F.round(F.median(x), digits), "most": F.max(x)}
    return rows.groupBy(*keys).agg(*(known[f].alias(f) for f in figures))


def correlation(rows: DataFrame, x: str, y: str, digits: int = 6) -> DataFrame:
    """r of two values over all rows; null where x is the same everywhere."""
    v = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return v.agg(F.when(F.max("x") > F.min("x"), F.round(F.corr("x", "y"), digits)).alias("r"))


def distinct(rows: DataFrame, **columns: str) -> DataFrame:
    """How many different values each column has, under the names given."""
    return rows.agg(*(F.count_distinct(c).alias(name) for name, c in columns.items()))


def stage_maps(steps: DataFrame, run: str = "run", stage: str = "stage", seconds: str = "seconds") -> DataFrame:
    """run, stages_seconds: the stages of each run and their seconds as one map; of a stage that comes twice the longer time."""
    each = steps.filter(F.col(seconds).isNotNull()).groupBy(run, stage).agg(F.max(seconds).alias("_s"))
    return each.groupBy(run).agg(F.map_from_entries(F.collect_list(F.struct(stage, "_s"))).alias("stages_seconds"))


def stages_of(runs: DataFrame, run: str = "run") -> DataFrame:
    """run, stage, seconds: a row a stage of each run."""
    return runs.select(run, F.explode("stages_seconds").alias("stage", "seconds"))


def mean_of(values: Column) -> Column:
    """Mean of an array of numbers."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def known_labels(rows: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """label, known: each value of a column and whether it is one of the known ones."""
    return rows.select(F.col(column).alias("label"), F.col(column).isin(*known).alias("known")).distinct()


def repeated(rows: DataFrame, column: str) -> DataFrame:
    """name, n: values that come more than once."""
    return rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).filter("n > 1")
