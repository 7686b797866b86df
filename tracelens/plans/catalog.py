"""Named queries over the shared tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelens.plans import queries_activity, queries_data, queries_flagship, queries_persons, queries_photos, queries_places, queries_sources, queries_streams  # noqa: F401
from tracelens.plans.registry import ORACLE_SQL, QUERIES
from tracelens.plans.report import flagship_report

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_report(spark, sf_dir)
