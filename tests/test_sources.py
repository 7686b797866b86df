"""Readers of platforms: pages, cursors, limits, pushed filters."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from tracelens.sources import platforms, social


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Profile a has 7 items, b 1, c 600 (many row groups), é 3."""
    rows = [(p, s, json.dumps({"id": f"{p}{s}", "caption": f"say #T{s % 3} {p}", "timestamp": "2025-01-01T10:00:00+0000", "media_type": "IMAGE", "media_url": "u"})) for p, n in (("a", 7), ("b", 1), ("c", 600), ("é", 3)) for s in range(n)]
    path = str(tmp_path_factory.mktemp("pages") / "instagram")
    platforms.land(spark.createDataFrame(rows, "profile_id string, seq long, json string").repartition(5), path, per_page=2)
    return path


def posts(spark, path, **how):
    return [(r["profile_id"], r["seq"], r["id"]) for r in platforms.read_platform(spark, "instagram", path, **how).orderBy("profile_id", "seq").collect()]


def test_all_pages_are_followed_in_order(spark, landed):
    assert posts(spark, landed) == [(p, s, f"{p}{s}") for p, n in (("a", 7), ("b", 1), ("c", social.MOST_MEDIA), ("é", 3)) for s in range(n)]


def test_limit_ends_within_a_page(spark, landed):
    assert posts(spark, landed, limit=3) == [(p, s, f"{p}{s}") for p, n in (("a", 3), ("b", 1), ("c", 3), ("é", 3)) for s in range(n)]
    assert posts(spark, landed, limit=0) == []


def test_pages_beyond_the_limit_are_not_asked_for(landed, monkeypatch):
    asked = []
    get = platforms.Pages.get
    monkeypatch.setattr(platforms.Pages, "get", lambda self, cursor: asked.append(cursor) or get(self, cursor))
    reader = platforms.PageReader(landed, 5, platforms.instagram_body)
    got = [row for part in reader.partitions() for row in reader.read(part)]
    assert len(got) == 5 + 1 + 5 + 3
    assert sorted(asked) == sorted(f"{p}~{k:09d}" for p, n in (("a", 3), ("b", 1), ("c", 3), ("é", 2)) for k in range(n))


def test_filters_on_profiles_are_pushed(spark, landed):
    reader = platforms.PageReader(landed, 5, platforms.instagram_body)
    left = list(reader.pushFilters([EqualTo(("profile_id",), "a"), GreaterThan(("seq",), 1)]))
    assert left == [GreaterThan(("seq",), 1)]
    assert [p.wanted for p in reader.partitions()] == [("a",)]
    assert list(reader.pushFilters([In(("profile_id",), ("b", "c"))])) == [] and list(reader.partitions()) == []
    assert {p for p, _, _ in posts(spark, landed, profiles=["é"])} == {"é"}
    assert {p for p, _, _ in posts(spark, landed, profiles=["b", "c", "nobody"])} == {"b", "c"}
    platforms.register(spark)
    plan = spark.read.format("instagram").option("path", landed).load().filter("profile_id = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan instagram" in plan and ") Filter" not in plan  # the reader does it all


def test_row_groups_are_small(landed):
    import glob

    import pyarrow.parquet as pq

    groups = [pq.ParquetFile(f).metadata.row_group(g).num_rows for f in glob.glob(f"{landed}/bucket=*/*.parquet") for g in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(groups) == 4 + 1 + 300 + 2 and max(groups) <= platforms.GROUP_ROWS < 300


def test_reddit_pages_and_unknown_platforms(spark, tmp_path):
    rows = [("u", s, json.dumps({"id": str(s), "subreddit": "Madrid", "title": f"T{s}", "selftext": "" if s % 2 else "body", "created_utc": 1735732800.0, "score": s, "permalink": f"/r/{s}"})) for s in range(130)]
    platforms.land(spark.createDataFrame(rows, "profile_id string, seq long, json string"), str(tmp_path / "r"), 100, "reddit", buckets=4)
    got = platforms.read_platform(spark, "reddit", str(tmp_path / "r")).orderBy("seq").collect()
    assert len(got) == social.PAGE and [r["text"] for r in got[:2]] == ["body", "T1"] and got[0]["tags"] == ["madrid"]
    with pytest.raises(ValueError):
        platforms.read_platform(spark, "tiktok", "x")


def test_landed_items_equal_pages_read_in_spark(spark, landed):
    pages = spark.read.parquet(landed).select("profile_id", F.split("cursor", "~")[1].cast("int").alias("page"), "json")
    want = [(r["profile_id"], r["seq"], r["id"]) for r in social.instagram_media(pages).orderBy("profile_id", "seq").collect()]
    assert posts(spark, landed) == want


def test_empty_landing(spark, tmp_path):
    platforms.land(spark.createDataFrame([], "profile_id string, seq long, json string"), str(tmp_path / "none"))
    assert posts(spark, str(tmp_path / "none")) == []
