"""Files: tables with uncertain column names, run logs, archives of shards, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.sources import shards

ALIASES = {"lat": ("lat", "latitude"), "lon": ("lon", "lng", "longitude"), "region": ("region", "state", "province", "admin1", "city"), "id": ("id",)}
SPAIN = ("ES", "ESP", "SPAIN")
RUN_LOG = "timestamp double, platform string, n_posts int, n_comments int, n_media_items int, n_photos int, ai_enabled boolean, scene_analysis_enabled boolean, geolocation_available boolean, total_seconds double, stages_seconds map<string,double>"


def resolved_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Each wanted column under its first known name, whatever its case; ValueError where none is there."""
    have = {c.lower(): c for c in df.columns}
    out = {}
    for want, names in aliases.items():
        found = next((have[n] for n in names if n in have), None)
        if found is None:
            raise ValueError(f"no column for {want} among {df.columns}")
        out[want] = found
    return df.select(*[F.col(f"`{c}`").alias(w) for w, c in out.items()])


def of_countries(df: DataFrame, country_col: str, countries: tuple[str, ...] = SPAIN) -> DataFrame:
    """The rows of some countries, whatever case and blanks their names have."""
    return df.filter(F.upper(F.trim(F.col(country_col))).isin(*countries))


def read_metadata(spark: SparkSession, path: str, country_col: str | None = None, countries: tuple[str, ...] = SPAIN) -> DataFrame:
    """CSV with a header, its columns by their aliases; with a country column only those countries."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    if country_col:
        raw = of_countries(raw, country_col, countries)
    return resolved_columns(raw)


def read_run_log(spark: SparkSession, path: str, schema: str = RUN_LOG) -> DataFrame:
    """JSON lines; missing columns are null, missing flags false."""
    df = spark.read.schema(schema).json(path)
    flags = [f.name for f in df.schema if f.dataType.typeName() == "boolean"]
    return df.fillna(False, flags).withColumn("at", F.timestamp_seconds("timestamp"))


def append_run_log(runs: DataFrame, path: str) -> None:
    """Runs without photos are not logged."""
    runs.filter("n_photos > 0").write.mode("append").json(path)


def report_name(platform, username, day):
    return F.concat_ws("_", F.lit("informe_exposicion"), platform, username, F.date_format(day, "yyyy-MM-dd"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON line a report."""
    reports.write.mode("overwrite").json(path)


def write_details(details: DataFrame, path: str) -> None:
    """One JSON line a detail row."""
    details.write.mode("overwrite").json(path)


def present_files(spark: SparkSession, path: str) -> DataFrame:
    """id (the name before the first dot) of the files, or folders of files, that a pattern matches; no content is read."""
    found = spark.read.format("binaryFile").load(path).select("path")
    return found.select(F.regexp_extract("path", r"/([^/.]+)\.[a-z]\w*(?:/[^/]*)?$", 1).alias("id")).distinct()


def with_files(df: DataFrame, files: DataFrame) -> DataFrame:
    """The rows whose id has a file."""
    return df.join(files.select("id"), "id", "left_semi")


def shard_list(files: DataFrame, most: int | None = None) -> DataFrame:
    """The shards in the order of their names, the first `most` of them."""
    ordered = files.select("id").orderBy("id")
    return ordered if most is None else ordered.limit(most)


def extracted(spark: SparkSession, path: str, wanted: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(shard, id, bytes) of the members of zip shards whose stem is a wanted id; shards that are done are left out."""
    return shards.taken(shards.listing(spark, path, done), wanted)


def folder_gib(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg((F.sum("length") / F.lit(2.0**30)).alias("gib"))
