"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "/tmp/checkpoints"


_written: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in that folder, with its scheme, so that Spark and the tasks mean the same; what stands there stays until the end of scratch()."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tracelens-{name}-{uuid.uuid4().hex}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    _written.append(out)
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is stored within is deleted at its end; what rests on it must be written before."""
    since = len(_written)
    try:
        yield
    finally:
        while len(_written) > since:
            discard(spark, _written.pop())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written there and read back: its lineage ends, and what uses it twice computes it once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that a row of a small table takes in a broadcast, and the most bytes of one.
ROW_BYTES, BROADCAST_BYTES = 96, 32 << 20


def small(df: DataFrame, name: str) -> DataFrame:
    """df stored, with a broadcast hint if it is small: what is joined with it then stays where it is, in the parts in which it was read."""
    kept = stored(df, name)
    return F.broadcast(kept) if kept.count() * ROW_BYTES <= BROADCAST_BYTES else kept


def file_system(uri: str):
    """(pyarrow file system, path in it) of a place in the shared folder, for tasks that read or write files themselves."""
    from pyarrow import fs

    path = uri.removeprefix("file:")
    return (fs.LocalFileSystem(), "/" + path.lstrip("/")) if path.startswith("/") else fs.FileSystem.from_uri(uri)


def with_prefix(df: DataFrame, order: list, amount=None, group: list[str] | None = None, name: str = "before") -> DataFrame:
    """df with the sum of `amount` (1 a row if None) over the rows before each in an order over all rows, or in its group of them.

    One range sort by (group, order); the sum of each sorted part is aggregated and only those sums meet, so neither all rows
    nor a group of many rows stand in one task.
    """
    group = group or []
    amount = F.lit(1) if amount is None else amount
    kept = df.withColumn("_amount", amount.cast("long")).orderBy(*group, *order)
    kept = stored(kept.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "sorted")
    sums = kept.groupBy(*group, "_part").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("_off", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum").withColumnsRenamed({c: f"_g{i}" for i, c in enumerate([*group, "_part"])}), "sorted-sums")
    on = [kept[c].eqNullSafe(sums[f"_g{i}"]) for i, c in enumerate([*group, "_part"])]
    within = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = kept.join(sums, on).withColumn(name, F.col("_off") + F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    return out.drop("_amount", "_at", "_part", "_off", *[f"_g{i}" for i in range(len(on))])


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table or folder in the shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
