"""Runs as streams with state that ends: life of a run, changes of its stage, progress of its tracks, codes of its stages.

Each function of state keeps one small value a key (progress: a small table a bucket of keys) and one timeout on event time,
which clears it when the watermark passes the last event by `idle`. Rows of a batch that belong to one key are taken in the order of their times; what a key holds
between batches doesn't grow with its rows. Rows behind the watermark are dropped by Spark.

Events: run_id, event_id, ts, stage, and what a function says beside these.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelens.streaming.metrics import LATE

DAY_MS = 24 * 3600 * 1000
RUNS = "run_id long, began timestamp, ended timestamp, events long, stages array<string>, ending string"
CHANGES = "run_id long, event_id long, ts timestamp, stage string, previous string"
#: Buckets of runs and tracks whose progress is held together.
BUCKETS = 512


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def in_order(parts: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """The rows of a key in the order of the first two of these columns; missing values are None, and last."""
    rows: list[tuple] = []
    for p in parts:
        rows += zip(*([None if x is None or x != x else x for x in p[c].tolist()] for c in columns), strict=True)
    return sorted(rows, key=lambda r: (r[0], r[1] is None, r[1]))


class Timed:
    """What a key holds between batches, one small value, and when it ends: `idle` after its last event, which is the value's last entry.

    An instance is the function of applyInPandasWithState: values come and go with the rows in Arrow batches, so a key costs no
    calls of its own to the state store. Times are microseconds.
    """

    state, columns = "", ()

    def __init__(self, idle_ms: int):
        self.idle_ms, self.idle = idle_ms, idle_ms * 1000

    def came(self, key: tuple, parts: Iterator[pd.DataFrame], value: tuple | None) -> tuple[tuple | None, list[tuple]]:
        """The value after the rows of a batch, None for none, and rows to write."""
        raise NotImplementedError

    def expired(self, key: tuple, value: tuple) -> list[tuple]:
        return []

    def __call__(self, key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            value, out = None, self.expired(key, held.get)
        else:
            value, out = self.came(key, parts, held.getOption)
        if value is not None:
            end = -(-value[-1] // 1000) + self.idle_ms
            if end > held.getCurrentWatermarkMs():
                held.update(value)
                held.setTimeoutTimestamp(end - 1)  # Spark ends what the watermark is later than
            else:
                out, value = out + self.expired(key, value), None
        if value is None and held.exists:
            held.remove()
        if out:
            yield pd.DataFrame(out, columns=self.columns)


class Life(Timed):
    """A run ends with a terminal event, or when nothing comes for `idle`; what comes then is a new run."""

    state, columns = "began long, events long, stages array<string>, last long", names(RUNS)

    def expired(self, key: tuple, value: tuple) -> list[tuple]:
        began, events, stages, last = value
        return [(key[0], began, last, events, sorted(stages), "timed out")]

    def came(self, key: tuple, parts: Iterator[pd.DataFrame], value: tuple | None) -> tuple[tuple | None, list[tuple]]:
        out: list[tuple] = []
        run = value and (value[0], value[1], set(value[2]), value[3])
        for at, _, stage, done in in_order(parts, "us", "event_id", "stage", "done"):
            if run and at - run[3] > self.idle:
                out += self.expired(key, run)
                run = None
            began, events, stages, last = run or (at, 0, set(), at)
            run = (min(began, at), events + 1, stages if stage is None else stages | {stage}, max(last, at))
            if done:
                out.append((key[0], run[0], run[3], run[1], sorted(run[2]), "done"))
                run = None
        return run and (run[0], run[1], sorted(run[2]), run[3]), out


class Changes(Timed):
    """A row each time a key's stage differs from the one before."""

    state, columns = "stage string, last long", names(CHANGES)

    def came(self, key: tuple, parts: Iterator[pd.DataFrame], value: tuple | None) -> tuple[tuple | None, list[tuple]]:
        out: list[tuple] = []
        before, last = value or (None, None)
        for at, event, stage in in_order(parts, "us", "event_id", "stage"):
            if last is not None and at - last > self.idle:
                before = None
            if stage != before:
                out.append((key[0], event, at, stage, before))
            before, last = stage, at
        return (before, last), out


class Furthest:
    """The most that each run and track has done of how many, each time it rises, for a bucket of runs and tracks at once: a call of
    a function of state costs as much as thousands of rows.

    What is held of a bucket is a table of its runs and tracks that haven't been idle for `idle`, a row each, and one timeout, when the
    first of them ends. Nulls among the keys are said by bits of `nulls`. Times are microseconds.
    """

    state, keys, most = "held binary", ["nulls", "run_id", "track"], ["done", "total", "us"]
    schema = pa.schema([("nulls", pa.int32()), ("run_id", pa.int64()), ("track", pa.string()), ("done", pa.int64()), ("total", pa.int64()), ("us", pa.int64())])

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def of_each(self, parts: list[pa.Table], most: list[str]) -> pa.Table:
        t = pa.concat_tables(parts).group_by(self.keys).aggregate([(c, "max") for c in most])
        return t.select([*self.keys, *(f"{c}_max" for c in most)]).rename_columns([*self.keys, *most])

    def __call__(self, key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        before = pa.ipc.open_stream(bytes(held.get[0])).read_all() if held.exists else self.schema.empty_table()
        now, was = before, ["was_done", "was_total"]
        if not held.hasTimedOut:
            # chunk by chunk: no more is held at once than the runs and tracks that a batch has of the bucket
            new = [self.of_each([pa.Table.from_pandas(p[self.schema.names], self.schema, preserve_index=False)], self.most) for p in parts]
            none = [pa.nulls(sum(len(t) for t in new), pa.int64())] * 2
            new = pa.concat_tables(new) if new else self.schema.empty_table()
            both = [t.append_column(was[0], a).append_column(was[1], b) for t, (a, b) in ((before, (before["done"], before["total"])), (new, none))]
            all_ = self.of_each(both, [*self.most, *was])
            rose = pc.or_(pc.not_equal(all_["done"], all_["was_done"]), pc.not_equal(all_["total"], all_["was_total"]))
            rose = all_.filter(pc.fill_null(rose, True))  # null: not held before
            now = all_.select(self.schema.names)
            if len(rose):
                yield rose.select([*self.keys, "done", "total"]).to_pandas()
        ends = -(-now["us"].to_numpy() // 1000) + self.idle_ms
        stay = ends > held.getCurrentWatermarkMs()
        if stay.any():
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, self.schema) as w:
                w.write_table(now.filter(pa.array(stay)).cast(self.schema).combine_chunks())
            held.update((out.getvalue().to_pybytes(),))
            held.setTimeoutTimestamp(int(ends[stay].min()) - 1)  # Spark ends what the watermark is later than
        elif held.exists:
            held.remove()


def timed(events: DataFrame, by: tuple[str, ...], what: Timed, schema: str, late: str, mode: str = "append") -> DataFrame:
    """The rows that `what` writes; its times, which are numbers, are timestamps again. Events without a time don't count."""
    kinds = dict(c.split() for c in schema.split(", "))
    e = events.filter("ts IS NOT NULL").withColumn("us", F.unix_micros("ts")).withWatermark("ts", late).groupBy(*by)
    out = e.applyInPandasWithState(what, schema.replace("timestamp", "long"), what.state, mode, GroupStateTimeout.EventTimeTimeout)
    return out.select(*(F.timestamp_micros(c).alias(c) if kind == "timestamp" else c for c, kind in kinds.items()))


def lives(events: DataFrame, idle_ms: int = DAY_MS, late: str = LATE) -> DataFrame:
    """run_id, began, ended, events, stages, ending (done or timed out): a row a run that has ended, when it has. events also have
    done, true of a terminal event. An event out of order counts to the run that is open when it comes."""
    e = events.select("run_id", "event_id", "ts", "stage", F.coalesce("done", F.lit(False)).alias("done"))
    return timed(e, ("run_id",), Life(idle_ms), RUNS, late)


def stage_changes(events: DataFrame, idle_ms: int = DAY_MS, late: str = LATE) -> DataFrame:
    """run_id, event_id, ts, stage, previous, each time a run's stage differs from the one before; a run that was idle for longer has no
    stage before, and a null stage is none."""
    return timed(events.select("run_id", "event_id", "ts", "stage"), ("run_id",), Changes(idle_ms), CHANGES, late)


def track_progress(events: DataFrame, idle_ms: int = DAY_MS, late: str = LATE, buckets: int = BUCKETS) -> DataFrame:
    """run_id, track, done, total, complete, each time that more is done; latest_progress() has the last of each. events also have
    track, done and total. State is kept by bucket, so their number stays as it is as long as a stream goes on."""
    many = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("done", "total")}
    nulls = F.col("run_id").isNull().cast("int") + F.col("track").isNull().cast("int") * 2
    keys = F.pmod(F.xxhash64("run_id", "track"), F.lit(buckets)).alias("bucket"), nulls.alias("nulls"), F.coalesce("run_id", F.lit(0)).cast("long").alias("run_id"), F.coalesce("track", F.lit("")).alias("track")
    e = events.filter("ts IS NOT NULL").select(*keys, "ts", F.unix_micros("ts").alias("us"), *many.values()).withWatermark("ts", late).groupBy("bucket")
    out = e.applyInPandasWithState(Furthest(idle_ms), "nulls int, run_id long, track string, done long, total long", Furthest.state, "update", GroupStateTimeout.EventTimeTimeout)
    named = [F.when(F.col("nulls").bitwiseAND(bit) == 0, F.col(c)).alias(c) for bit, c in ((1, "run_id"), (2, "track"))]
    return out.select(*named, "done", "total", ((F.col("done") >= F.col("total")) & (F.col("total") > 0)).alias("complete"))


def latest_progress(progress: DataFrame) -> DataFrame:
    """The furthest that each run and track has come."""
    p = progress.groupBy("run_id", "track").agg(F.max("done").alias("done"), F.max("total").alias("total"))
    return p.withColumn("complete", (F.col("done") >= F.col("total")) & (F.col("total") > 0))


def codes(spark: SparkSession, path: str) -> DataFrame:
    """name, code: of a table (name, code, version) that only grows, the last version of each name."""
    return spark.read.schema("name string, code string, version long").parquet(path).groupBy("name").agg(F.max_by("code", "version").alias("code"))


def coded(path: str):
    """For each batch of a stream, its rows with the code of their stage, null where none is known. The table is read anew by each
    batch, so names that were added since count from the next batch on."""

    def with_codes(batch: DataFrame) -> DataFrame:
        return batch.join(codes(batch.sparkSession, path).withColumnRenamed("name", "stage"), "stage", "left")

    return with_codes


def code_counts(rows: DataFrame) -> DataFrame:
    """code, stage (of unknown names only), n."""
    return rows.groupBy("code", F.when(F.col("code").isNull(), F.col("stage")).alias("stage")).agg(F.count("*").alias("n"))
