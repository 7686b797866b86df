"""Running streams: triggers, a sink that a repeated batch doesn't write twice, streams fed in slices, tailed logs."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tracelens.operators.shared import shared_path
from tracelens.sources.files import RUN_LOG

#: How often a service's figures are taken.
EVERY = "5 seconds"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings of the session for the time of a block; a stream keeps those that it started with."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def sink(path: str, mode: str = "append") -> Callable[[DataFrame, int], None]:
    """A writer of batches for foreachBatch: batch n goes to path/batch=n and replaces what is there, so a batch that is run again after
    a failure leaves its rows once. mode complete keeps the last batch only."""

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n if mode != 'complete' else 0}")

    return keep


def kept(spark: SparkSession, path: str, schema: StructType, with_batch: bool = False) -> DataFrame:
    """What a sink has written so far; with_batch: and by which batch. Nothing where no batch was written."""
    try:
        out = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).option("basePath", path).parquet(f"{path}/batch=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        out = spark.createDataFrame([], StructType([*schema, StructField("batch", LongType())]))
    return out if with_batch else out.drop("batch")


def started(stream: DataFrame, write: Callable[[DataFrame, int], None], state: str, mode: str = "append", every: str | None = EVERY) -> StreamingQuery:
    """Start a stream; every: how often a batch begins, None for all that is there now and then an end. State is kept in files that
    are carried on by changes, so a batch writes what it has changed."""
    spark = stream.sparkSession
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
        w = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write)
        return (w.trigger(availableNow=True) if every is None else w.trigger(processingTime=every)).start()


def once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote: a table in the shared folder."""
    spark, base = stream.sparkSession, shared_path(stream.sparkSession, "stream")
    started(stream, sink(f"{base}/out", mode), f"{base}/state", mode, None).awaitTermination()
    return kept(spark, f"{base}/out", stream.schema)


def fed(slices: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str = "append", between: Callable[[int], None] | None = None, progress: list | None = None, write=None, form: str = "parquet") -> DataFrame:
    """What a stream writes that gets its input in slices, one after the other, and is stopped and started between them.

    build makes the stream's plan from its source. between(k) is called before slice k lands. progress gets the stream's own account of each batch.
    write(path, batch, n) in place of the sink's plain writing."""
    spark, base, schema = slices[0].sparkSession, shared_path(slices[0].sparkSession, "feed"), slices[0].schema
    plain = sink(f"{base}/out", mode)
    out = None
    for k, rows in enumerate(slices):
        if between:
            between(k)
        rows.write.mode("append").format(form).save(f"{base}/in")
        stream = build(spark.readStream.schema(schema).format(form).load(f"{base}/in"))
        out = stream.schema
        q = started(stream, (lambda b, n: plain(write(b), n)) if write else plain, f"{base}/state", mode, None)
        q.awaitTermination()
        if progress is not None:
            progress += [p for p in q.recentProgress if p["durationMs"].get("addBatch")]
    if write:
        out = write(spark.createDataFrame([], out)).schema
    return kept(spark, f"{base}/out", out)


def tail_run_log(spark: SparkSession, path: str, schema: str = RUN_LOG) -> DataFrame:
    """Lines of a JSON log as they are added; missing columns are null, lines that are no JSON are rows of nulls and left out."""
    return spark.readStream.schema(schema).json(path).filter("timestamp IS NOT NULL")
