"""Streams over several batches: restarts, late rows, state that ends, tables that change."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tracelens.streaming import feeds, metrics, runs

T0 = dt.datetime(2025, 1, 1)
EVENT = "run_id long, event_id long, ts timestamp, stage string, done boolean"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def slices(spark, *parts, schema=EVENT):
    return [spark.createDataFrame(p, schema) for p in parts]


def lives(spark, *parts, **how):
    out = feeds.fed(slices(spark, *parts), lambda s: runs.lives(s, **how))
    return sorted((r["run_id"], r["began"], r["ended"], r["events"], r["stages"], r["ending"]) for r in out.collect())


def test_runs_end_with_their_event_or_in_time(spark):
    got = lives(
        spark,
        [(1, 1, at(0), "a", False), (1, 2, at(1), "b", False), (2, 3, at(1), "a", True), (3, 4, at(0), None, None)],
        [(1, 5, at(2), "a", True), (1, 6, at(3), "c", False), (4, 7, at(30), "x", False)],
        [(1, 8, at(40), "d", False), (5, 9, at(60), "y", False)],
    )
    assert got == [
        (1, at(0), at(2), 3, ["a", "b"], "done"),
        (1, at(3), at(3), 1, ["c"], "timed out"),
        (2, at(1), at(1), 1, ["a"], "done"),
        (3, at(0), at(0), 1, [], "timed out"),
        (4, at(30), at(30), 1, ["x"], "timed out"),
    ]  # the last runs of 1 and 5 are open


def test_runs_in_one_batch_are_as_in_many(spark):
    import random

    r = random.Random(1)
    rows = [(r.randrange(6), i, at(i * 0.7), r.choice("abc"), r.random() < 0.2) for i in range(200)]
    one = lives(spark, rows, idle_ms=5 * 3600 * 1000)
    assert one == lives(spark, rows[:50], rows[50:90], rows[90:], idle_ms=5 * 3600 * 1000)
    want, open_run = [], {}
    for run, _, ts, stage, done in rows:
        held = open_run.get(run)
        if held and ts - held[1] > dt.timedelta(hours=5):
            want.append((run, held[0], held[1], held[2], sorted(held[3]), "timed out"))
            held = None
        held = [held[0], ts, held[2] + 1, held[3] | {stage}] if held else [ts, ts, 1, {stage}]
        open_run[run] = held
        if done:
            want.append((run, held[0], held[1], held[2], sorted(held[3]), "done"))
            open_run[run] = None
    mark = rows[-1][2] - dt.timedelta(minutes=10)
    want += [(run, h[0], h[1], h[2], sorted(h[3]), "timed out") for run, h in open_run.items() if h and h[1] + dt.timedelta(hours=5) <= mark]
    assert one == sorted(want)


def test_state_ends(spark):
    """A thousand runs over ten slices: what is held doesn't grow, as old runs leave."""
    progress = []
    parts = [[(k * 100 + i, k * 100 + i, at(30 * k + i / 100), "a", False) for i in range(100)] for k in range(5)]
    out = feeds.fed(slices(spark, *parts), runs.lives, progress=progress)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert out.count() == 400 and max(held) <= 2 * 4 * 100 and held[-1] <= min(h for h in held if h) * 2


def test_changes_over_slices_and_idle(spark):
    parts = ([(1, 1, at(0), "a", None), (1, 2, at(1), "a", None), (1, 3, at(2), "b", None)], [(1, 5, at(4), "c", None), (1, 4, at(3), "b", None), (2, 6, at(4), None, None)], [(1, 7, at(40), "c", None), (1, 8, at(41), "c", None)])
    got = feeds.fed(slices(spark, *parts), runs.stage_changes)
    assert sorted((r["event_id"], r["stage"], r["previous"]) for r in got.collect()) == [(1, "a", None), (3, "b", "a"), (5, "c", "b"), (7, "c", None)]


def test_progress_of_tracks(spark):
    schema = "run_id long, track string, ts timestamp, done long, total long"
    parts = ([(1, "fotos", at(0), 1, 3), (1, "fotos", at(1), 2, 3), (1, "geo", at(1), 0, 0)], [(1, "fotos", at(2), 3, 3), (2, "fotos", at(2), 1, 5), (1, "fotos", at(2), 2, 3)], [(2, "fotos", at(50), None, None)])
    out = feeds.fed(slices(spark, *parts, schema=schema), runs.track_progress, "update")
    got = sorted((r["run_id"], r["track"], r["done"], r["total"], r["complete"]) for r in runs.latest_progress(out).collect())
    assert got == [(1, "fotos", 3, 3, True), (1, "geo", 0, 0, False), (2, "fotos", 1, 5, False)]


REQUEST = "event_id long, ts timestamp"


def test_late_and_repeated_requests(spark):
    progress = []
    parts = ([(1, at(0)), (2, at(0.1)), (1, at(0))], [(2, at(0.1)), (3, at(9)), (4, at(0.5))], [(5, at(0.2)), (6, at(20)), (3, at(9))], [(7, at(40))])
    out = feeds.fed(slices(spark, *parts, schema=REQUEST), lambda s: metrics.sliding_requests(s, "2 hours", "1 hour", "1 hour"), progress=progress)
    got = {(r["w"]["start"], r["requests"]) for r in out.collect()}
    # 4 comes late, within the watermark of 1 hour before 0.1; 5 comes when it stands at 8
    assert got == {(at(-1), 3), (at(0), 3), (at(8), 1), (at(9), 1), (at(19), 1), (at(20), 1)}
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) >= 1


def test_state_of_windows_is_flat(spark):
    progress = []
    parts = [[(k * 50 + i, at(k * 10 + i / 10)) for i in range(50)] for k in range(6)]
    feeds.fed(slices(spark, *parts, schema=REQUEST), lambda s: metrics.sliding_requests(s, "1 hour", "30 minutes", "30 minutes"), progress=progress)
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress]
    assert max(held[-4:]) <= max(held[:4]) + 2  # as much after the last slices as after the first


def test_a_batch_that_is_run_again_writes_once(spark, tmp_path):
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    line = lambda k: json.dumps({"timestamp": 1.5 + k, "platform": "reddit", "n_photos": k})
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(line(k) for k in range(3)) + "\nno json\n")
    keep = feeds.sink(out)

    def broken(batch, n):
        keep(batch, n)
        raise RuntimeError("lost after the rows were written, before the batch was committed")

    with pytest.raises(Exception, match="lost"):
        feeds.started(feeds.tail_run_log(spark, log), broken, state, every=None).awaitTermination()
    assert feeds.kept(spark, out, feeds.tail_run_log(spark, log).schema).count() == 3
    feeds.started(feeds.tail_run_log(spark, log), keep, state, every=None).awaitTermination()
    (tmp_path / "log" / "b.json").write_text(line(3))
    feeds.started(feeds.tail_run_log(spark, log), keep, state, every=None).awaitTermination()
    got = feeds.kept(spark, out, feeds.tail_run_log(spark, log).schema, with_batch=True).collect()
    assert sorted((r["n_photos"], r["batch"]) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 1)]


def test_a_log_is_tailed_while_it_grows(spark, tmp_path):
    """With a trigger by the clock; the log grows while the stream runs."""
    import time

    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    (tmp_path / "log").mkdir()
    tail = feeds.tail_run_log(spark, log)
    q = feeds.started(tail, feeds.sink(out), str(tmp_path / "state"), every="1 second")
    try:
        for k in range(3):
            (tmp_path / f"{k}.json").write_text(json.dumps({"timestamp": 1.0, "n_photos": k}))
            (tmp_path / f"{k}.json").rename(tmp_path / "log" / f"{k}.json")
            until = time.time() + 60
            while feeds.kept(spark, out, tail.schema).count() <= k and time.time() < until:
                time.sleep(0.2)
        assert q.isActive and feeds.kept(spark, out, tail.schema).count() == 3
    finally:
        q.stop()


def test_codes_that_are_added_count_from_then_on(spark, tmp_path):
    path = str(tmp_path / "codes")

    def more(k):
        rows = [[("a", "x", 1)], [("b", "y", 1), ("a", "z", 2)]][k]
        spark.createDataFrame(rows, "name string, code string, version long").write.mode("append").parquet(path)

    rows = [[("a",), ("b",), (None,)]] * 2
    out = feeds.fed(slices(spark, *rows, schema="stage string"), lambda s: s, between=more, write=runs.coded(path))
    got = {(r["code"], r["stage"], r["n"]) for r in runs.code_counts(out).collect()}
    assert got == {("x", None, 1), ("z", None, 1), ("y", None, 1), (None, "b", 1), (None, None, 2)}


def test_sketches_merge_within_their_error(spark):
    import random

    r = random.Random(2)
    rows = [(i, at(i / 400), "r" if i % 3 else "s", r.random() ** 3) for i in range(20_000)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, route string, seconds double")
    parts = metrics.duration_sketches(e, "2 hours")
    at_ = (0.01, 0.5, 0.9, 0.99)
    for q in metrics.quantiles_over(parts, "30 days", at_).collect():
        own = sorted(s for _, _, route, s in rows if route == q["route"])
        assert q["n"] == len(own)
        for want, value in zip(at_, q["q"], strict=True):
            assert abs(sum(s <= value for s in own) / len(own) - want) <= metrics.RANK_ERROR + 1 / len(own)
    assert metrics.quantiles_over(parts.limit(0), "1 day").count() == 0


def test_quantiles_are_exact_beyond_a_sketch(spark):
    """More values than an approximation of 10,000 keeps apart; nulls don't count, and a route of nulls has no quantiles."""
    n = 40_001
    e = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1735689600) + F.col("id") % 3600).alias("ts"), F.lit("r").alias("route"), (F.col("id") * 7919 % n).cast("double").alias("seconds"))
    none = e.limit(10).withColumns({"route": F.lit("s"), "seconds": F.lit(None).cast("double")})
    e = e.unionByName(none).unionByName(none.withColumn("route", F.lit("r")))
    got = {(r["route"], r["n"], *r["q"]) for r in metrics.exact_quantiles(metrics.value_counts(e, "1 day"), ("0.5", "0.9", "0.123")).collect()}
    assert got == {("r", n, 20_000.0, 36_000.0, 4920.0), ("s", 0, None, None, None)}


def test_settings_are_restored(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with feeds.settings(spark, spark__sql__streaming__stateStore__providerClass=feeds.ROCKSDB):
        assert spark.conf.get(name) == feeds.ROCKSDB
    assert spark.conf.get(name, None) == before


def test_empty_streams(spark):
    none = slices(spark, [])
    assert feeds.fed(none, runs.lives).count() == feeds.fed(none, runs.stage_changes).count() == 0
    assert feeds.fed([none[0].select("event_id", "ts")], lambda s: metrics.sliding_requests(s, "1 hour", "1 hour")).count() == 0
    assert feeds.fed(none, runs.lives).filter(F.col("ending") == "done").columns == ["run_id", "began", "ended", "events", "stages", "ending"]


def test_keys_make_no_calls_to_the_state_store(spark):
    """Values travel with the rows; a value whose end the watermark has passed already is not kept."""
    from types import SimpleNamespace

    import pandas as pd

    kept = []
    held = SimpleNamespace(hasTimedOut=False, getOption=None, exists=False, getCurrentWatermarkMs=lambda: 5000, update=kept.append, setTimeoutTimestamp=kept.append)
    rows = pd.DataFrame({"us": [1_000_001, 2_000_000], "event_id": [1, 2], "stage": ["a", None], "done": [False, False]})
    out = pd.concat(list(runs.Life(1000)((7,), iter([rows]), held)))
    assert not kept and out.to_dict("records") == [{"run_id": 7, "began": 1_000_001, "ended": 2_000_000, "events": 2, "stages": ["a"], "ending": "timed out"}]
    assert not list(runs.Life(3_000_500)((7,), iter([rows]), held)) and kept == [(1_000_001, 2, ["a"], 2_000_000), 3_002_499]


def test_tracks_are_held_by_bucket(spark):
    """Many tracks make few calls and few values of state; each rises, ends when idle and begins again on its own, nulls among the keys too."""
    schema, progress, n = "run_id long, track string, ts timestamp, done long, total long", [], 700
    many = [(i, "t", at(0), 1, 2) for i in range(n)]
    own = [(2**60 + 1, "t"), (2**60, "t"), (None, "t"), (0, None), (0, ""), (None, None)]
    parts = (many + [(*k, at(1), 2, 2) for k in own], [(*k, at(2), 1, 2) for k in own] + [(5, "t", at(2), 2, 2)], [(900, "t", at(60), 0, 0)], [(*own[0], at(61), 1, 2), (6, "t", at(61), 0, 0)])
    out = feeds.fed(slices(spark, *parts, schema=schema), lambda s: runs.track_progress(s, buckets=16), "update", progress=progress)
    got = sorted(((r["run_id"], r["track"], r["done"], r["total"], r["complete"]) for r in out.collect()), key=str)
    want = [(i, "t", 1, 2, False) for i in range(n)] + [(*k, 2, 2, True) for k in own] + [(5, "t", 2, 2, True), (900, "t", 0, 0, False), (6, "t", 0, 0, False), (own[0][0], "t", 1, 2, False)]
    assert got == sorted(want, key=str)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(held) == 16 and held[-1] <= 3
