"""Archives of many members: packing, listing under a budget of disk, and taking out what is wanted.

A shard is a zip file. Its directory of members stands at its end, so members are listed without reading their content, the
wanted ones are found by a join, and tasks then seek to these alone. Shards are taken in the order of their names as long as
the disk that is used stays below a budget; what is done is kept as a table, so a run that was stopped goes on behind it.
"""

from __future__ import annotations

import posixpath
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.operators.shared import file_system, stored, with_prefix

#: Wanted members of one shard that one task takes out, and bytes of a batch of them.
MEMBERS_EACH, BATCH_BYTES = 2048, 8 << 20


def packed(items: DataFrame, path: str, per_shard: int, compress: bool = True) -> DataFrame:
    """(shard, members): items (id, bytes) in the order of id, `per_shard` a zip file. A task writes beside the shard and renames, so one
    that runs twice leaves one file."""
    placed = with_prefix(items.select("id", "bytes"), ["id"], name="place").withColumn("n", F.expr(f"place div {int(per_shard)}"))
    how = zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        where, base = file_system(path)
        where.create_dir(base, recursive=True)
        name, part = f"{int(rows['n'].iloc[0]):06d}.zip", f"{base}/_{uuid.uuid4().hex}"
        with where.open_output_stream(part) as f, zipfile.ZipFile(f, "w", how) as z:
            for i, content in rows.sort_values("place")[["id", "bytes"]].itertuples(index=False):
                z.writestr(f"images/{i}.bin", content or b"")
        where.move(part, f"{base}/{name}")
        return pd.DataFrame({"shard": [name], "members": [len(rows)]})

    return placed.select("n", "place", F.col("id").cast("string").alias("id"), "bytes").groupBy("n").applyInPandas(write, "shard string, members long")


def listing(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """(shard, path, size) of the files that a pattern matches, without those that are done; no content is read."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("shard"), "path", F.col("length").alias("size"))
    return found if done is None else found.join(done.select("shard"), "shard", "left_anti")


def stem(name: str) -> str:
    return posixpath.splitext(posixpath.basename(name))[0]


def members(shards: DataFrame) -> DataFrame:
    """(shard, path, name, id, size) of all members of shards (shard, path): their directories alone are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, path in zip(b["shard"], b["path"], strict=True):
                where, at = file_system(path)
                with where.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    infos = [i for i in z.infolist() if not i.is_dir()]
                yield pd.DataFrame({"shard": shard, "path": path, "name": [i.filename for i in infos], "id": [stem(i.filename) for i in infos], "size": [i.file_size for i in infos]})

    return shards.select("shard", "path").mapInPandas(run, "shard string, path string, name string, id string, size long")


def wanted_members(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shard, name, path, size) of the members whose stem is a wanted id, each id once: of the first shard, then name, that has it."""
    found = members(shards).join(wanted.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
    return found.groupBy("id").agg(F.min(F.struct("shard", "name", "path", "size")).alias("m")).select("id", "m.*")


def within_budget(shards: DataFrame, wanted: DataFrame, budget: int, used: int = 0) -> DataFrame:
    """(shard, path, size, before): of shards (shard, path) in the order of their names those that are begun while less than the budget is used.
    size: bytes of the members that are wanted of it; before: bytes used when it is begun. Sums go by sorted ranges."""
    sizes = wanted_members(shards, wanted).groupBy("shard").agg(F.sum("size").alias("size"))
    sized = shards.select("shard", "path").join(sizes, "shard", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return with_prefix(sized, ["shard"], F.col("size")).withColumn("before", F.col("before") + F.lit(used)).filter(F.col("before") < F.lit(budget))


def taken(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """(shard, id, bytes) of the wanted members of shards. Tasks seek to them; the others are never unpacked."""
    once = wanted_members(shards, wanted)
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    # a shard with very many wanted members is opened by several tasks
    sizes = once.groupBy("shard").agg(F.ceil(F.count("*") / MEMBERS_EACH).alias("parts"))
    once = once.join(sizes, "shard").withColumn("part", part % F.col("parts"))
    groups = once.groupBy("shard", "path", "part").agg(F.array_sort(F.collect_list("name")).alias("names"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, path, names in zip(b["shard"], b["path"], b["names"], strict=True):
                where, at = file_system(path)
                ids, contents, size = [], [], 0
                with where.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    for n in names:
                        ids.append(stem(n))
                        contents.append(z.read(n))
                        size += len(contents[-1])
                        if size >= BATCH_BYTES:
                            yield pd.DataFrame({"shard": shard, "id": ids, "bytes": contents})
                            ids, contents, size = [], [], 0
                if ids:
                    yield pd.DataFrame({"shard": shard, "id": ids, "bytes": contents})

    return groups.select("shard", "path", "names").mapInPandas(run, "shard string, id string, bytes binary")


def take_within(spark: SparkSession, path: str, wanted: DataFrame, out: str, budget: int, most: int | None = None) -> int:
    """One run: of the first `most` shards those that aren't done and are begun below the budget are taken out to out/images, then noted in
    out/done. Returns how many. What is there already counts against the budget; a run that is lost before its note repeats its shards,
    and ids that are there aren't taken again."""
    done, images = (present(spark, f"{out}/{name}", schema) for name, schema in (("done", "shard string"), ("images", "shard string, id string, bytes binary")))
    used = images.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    shards = listing(spark, path)
    if most is not None:
        shards = with_prefix(shards, ["shard"], name="rank").filter(F.col("rank") < most).drop("rank")
    missing = wanted.select(F.col("id").cast("string").alias("id")).join(images.select("id"), "id", "left_anti")
    chosen = stored(within_budget(shards.join(done.distinct(), "shard", "left_anti"), missing, budget, used), "chosen-shards")
    n = chosen.count()
    if n:
        taken(chosen, missing).write.mode("append").parquet(f"{out}/images")
        chosen.select("shard").write.mode("append").parquet(f"{out}/done")
    return n


def present(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one where nothing was written yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
