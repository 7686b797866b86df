"""Readers of platforms by name: spark.read.format("instagram") over landed pages, followed by their cursors.

A platform answers in pages: a body with some items and, unless it is the last, a cursor to the next. land() writes the
answers as they would come, a row a page (bucket, profile_id, cursor, json), in a folder a bucket of profiles, sorted by
profile and page. The reader has a partition a bucket. In it each profile is read from its first page on, by the cursor in
each body, until `limit` items are there or a body names no next page: pages beyond the limit are never parsed, and row
groups that hold none of the wanted pages are never read. Equality on profile_id is pushed into the reader, which then opens
the buckets of those profiles only.

Options: path (the landed folder), limit (items of each profile; the platform's own bound otherwise), buckets (that land() had).
A row is an item: profile_id, seq (its place), json.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from tracelens.operators.shared import file_system, with_prefix
from tracelens.sources import social

BUCKETS = 64
#: Rows of a row group of landed pages: a reader holds one group at a time.
GROUP_ROWS = 256


def cursor_of(profile, page):
    """Name of a page: sorts as the pages do."""
    return F.concat_ws("~", profile, F.lpad(page.cast("string"), 9, "0"))


def land(items: DataFrame, path: str, per_page: int = social.PAGE, body: str = "instagram", buckets: int = BUCKETS) -> None:
    """Write items (profile_id, seq, json) as pages of `per_page`, in the order of seq, with the cursors that link them. Items without a
    profile are nobody's and aren't landed."""
    items = items.filter("profile_id IS NOT NULL")
    placed = with_prefix(items.select("profile_id", "seq", "json"), ["seq"], group=["profile_id"], name="place")
    pages = placed.groupBy("profile_id", F.expr(f"place div {int(per_page)}").alias("page")).agg(F.array_sort(F.collect_list(F.struct("place", "json"))).alias("items"))
    last = items.groupBy("profile_id").agg(F.ceil(F.count("*") / per_page).alias("pages"))
    pages = pages.join(last, "profile_id")
    data = F.array_join(F.transform("items", lambda i: i["json"]), ",")
    following = F.when(F.col("page") + 1 < F.col("pages"), F.to_json(F.struct(cursor_of(F.col("profile_id"), F.col("page") + 1).alias("next")))).otherwise(F.lit("{}"))
    if body == "reddit":
        text = F.concat(F.lit('{"data":{"children":['), F.array_join(F.transform("items", lambda i: F.concat(F.lit('{"data":'), i["json"], F.lit("}"))), ","), F.lit('],"paging":'), following, F.lit("}}"))
    else:
        text = F.concat(F.lit('{"data":['), data, F.lit('],"paging":'), following, F.lit("}"))
    out = pages.select((F.crc32("profile_id") % buckets).cast("int").alias("bucket"), "profile_id", cursor_of(F.col("profile_id"), F.col("page")).alias("cursor"), text.alias("json"))
    # sorted ranges of (bucket, cursor): a bucket of many pages is written by many tasks
    out.repartitionByRange("bucket", "cursor").sortWithinPartitions("bucket", "cursor").write.option("parquet.block.row.count.limit", str(GROUP_ROWS)).partitionBy("bucket").parquet(path)


class Bucket(InputPartition):
    def __init__(self, folder: str, wanted: tuple[str, ...] | None):
        super().__init__(folder)
        self.folder, self.wanted = folder, wanted


class Pages:
    """The pages of a bucket by their cursor, a row group in memory at a time."""

    def __init__(self, folder: str):
        import pyarrow.parquet as pq
        from pyarrow import fs

        where, path = file_system(folder)
        self.groups, self.loaded = [], (None, {})
        for f in sorted(i.path for i in where.get_file_info(fs.FileSelector(path)) if i.path.endswith(".parquet")):
            file = pq.ParquetFile(where.open_input_file(f))
            column = file.schema_arrow.get_field_index("cursor")
            for g in range(file.num_row_groups):
                bounds = file.metadata.row_group(g).column(column).statistics
                self.groups.append((bounds.min, bounds.max, file, g))
        self.groups.sort(key=lambda g: g[:2])

    def get(self, cursor: str) -> str | None:
        for k, (low, high, file, g) in enumerate(self.groups):
            if low <= cursor <= high:
                if self.loaded[0] != k:
                    t = file.read_row_group(g, columns=["cursor", "json"])
                    self.loaded = k, dict(zip(t["cursor"].to_pylist(), t["json"].to_pylist(), strict=True))
                if cursor in self.loaded[1]:
                    return self.loaded[1][cursor]
        return None

    def profiles(self):
        """Each profile once, in order: of every row group only the names are read."""
        last = None
        for _, _, file, g in self.groups:
            for name in file.read_row_group(g, columns=["profile_id"])["profile_id"].to_pylist():
                if name != last:
                    yield name
                last = name


class PageReader(DataSourceReader):
    def __init__(self, path: str, limit: int, items_of, buckets: int = BUCKETS):
        self.path, self.limit, self.items_of, self.buckets, self.wanted = path, limit, items_of, buckets, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("profile_id",):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.wanted = values if self.wanted is None else self.wanted & values
            elif not (isinstance(f, IsNotNull) and f.attribute == ("profile_id",)):  # landed items have one
                yield f

    def partitions(self):
        from pyarrow import fs

        where, path = file_system(self.path)
        folders = sorted(i.path for i in where.get_file_info(fs.FileSelector(path)) if i.base_name.startswith("bucket="))
        root = self.path.rstrip("/")
        names = [f.rsplit("/", 1)[-1] for f in folders]
        if self.wanted is None:
            return [Bucket(f"{root}/{n}", None) for n in names]
        own: dict[str, list[str]] = {}
        for p in self.wanted:
            own.setdefault(f"bucket={zlib.crc32(p.encode()) % self.buckets}", []).append(p)
        return [Bucket(f"{root}/{n}", tuple(sorted(own[n]))) for n in names if n in own]

    def read(self, partition):
        if self.limit <= 0 or partition is None:  # no bucket at all
            return
        pages = Pages(partition.folder)
        for profile in pages.profiles() if partition.wanted is None else partition.wanted:
            cursor, place = f"{profile}~{0:09d}", 0
            while cursor and place < self.limit and (text := pages.get(cursor)):
                items, cursor = self.items_of(json.loads(text))
                for item in items[: self.limit - place]:
                    yield (profile, place, json.dumps(item, ensure_ascii=False))
                    place += 1


def instagram_body(body: dict) -> tuple[list, str | None]:
    return body.get("data", []), body.get("paging", {}).get("next")


def reddit_body(body: dict) -> tuple[list, str | None]:
    data = body.get("data", {})
    return [c["data"] for c in data.get("children", [])], data.get("paging", {}).get("next")


class Platform(DataSource):
    """What the platforms share; a subclass has its name, its bound and how its bodies are read."""

    most, items_of = social.MOST_MEDIA, staticmethod(instagram_body)

    def schema(self):
        return "profile_id string, seq long, json string"

    def reader(self, schema):
        most = int(self.options.get("limit", self.most))
        return PageReader(self.options["path"], min(most, self.most), type(self).items_of, int(self.options.get("buckets", BUCKETS)))


class Instagram(Platform):
    @classmethod
    def name(cls):
        return "instagram"


class Reddit(Platform):
    most, items_of = min(social.MOST_POSTS, social.PAGE), staticmethod(reddit_body)

    @classmethod
    def name(cls):
        return "reddit"


#: Platforms, and how their items become posts.
PLATFORMS = {
    "instagram": (Instagram, lambda items, kind: social.instagram_posts(items)),
    "reddit": (Reddit, lambda items, kind: social.reddit_items(items, kind or "post")),
}


def register(spark: SparkSession) -> None:
    """Make the platforms known to spark.read.format()."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source, _ in PLATFORMS.values():
        spark.dataSource.register(source)


def read_platform(spark: SparkSession, platform: str, path: str, limit: int | None = None, kind: str | None = None, profiles: list[str] | None = None) -> DataFrame:
    """Posts of a platform's landed pages in the common model; ValueError for a platform that nobody registered."""
    if platform not in PLATFORMS:
        raise ValueError(f"unknown platform: {platform}")
    register(spark)
    r = spark.read.format(platform).option("path", path)
    items = (r if limit is None else r.option("limit", limit)).load()
    if profiles is not None:
        items = items.filter(F.col("profile_id").isin(*profiles)) if len(profiles) != 1 else items.filter(F.col("profile_id") == profiles[0])
    return PLATFORMS[platform][1](items, kind)
