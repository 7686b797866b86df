"""Shards under a budget, indexes, labels, and progress."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.operators import geo, labels, shared
from tracelens.operators.progress import Progress, StreamProgress
from tracelens.sources import index, shards
from tracelens.streaming import feeds


def test_sums_before_each_row(spark):
    rows = [(g, k, (k * 7) % 5) for g in ("a", "b", None) for k in range(40)]
    df = spark.createDataFrame(rows, "g string, k long, n long").repartition(7)
    got = {(r["g"], r["k"]): r["before"] for r in shared.with_prefix(df, ["k"], F.col("n"), ["g"]).collect()}
    assert got == {(g, k): sum((j * 7) % 5 for j in range(k)) for g, k, _ in rows}
    got = [r["rank"] for r in shared.with_prefix(df.filter("g = 'a'"), [F.col("k").desc()], name="rank").orderBy("k").collect()]
    assert got == list(range(39, -1, -1))
    assert shared.with_prefix(df.limit(0), ["k"]).count() == 0


def test_stored_tables_go_with_their_scratch(spark):
    import os

    with shared.scratch(spark):
        kept = shared.stored(spark.range(5), "kept")
        with shared.scratch(spark):
            gone = shared.stored(spark.range(7), "gone")
            assert gone.count() == 7
            path = gone.inputFiles()[0].removeprefix("file:").replace("///", "/").rsplit("/", 1)[0]
        assert not os.path.exists(path) and kept.count() == 5


@pytest.fixture(scope="module")
def zips(spark, tmp_path_factory):
    """Ten shards of ten items of 100 bytes; item 5 stands in two of them."""
    path = str(tmp_path_factory.mktemp("zips"))
    items = spark.createDataFrame([(k, bytes([k]) * 100) for k in range(100)], "id long, bytes binary").repartition(3)
    made = shards.packed(items, path, 10).collect()
    assert sorted((r["shard"], r["members"]) for r in made) == [(f"{k:06d}.zip", 10) for k in range(10)]
    with zipfile.ZipFile(f"{path}/000007.zip", "a") as z:
        z.writestr("other/5.jpg", b"second")
        z.writestr("folder/", b"")
    return path


def ids(*values):
    return [(str(v),) for v in values]


def test_members_are_taken_once_and_only_the_wanted(spark, zips):
    wanted = spark.createDataFrame(ids(5, 5, 33, 71, 200), "id string")
    got = shards.taken(shards.listing(spark, f"{zips}/*.zip"), wanted).collect()
    assert sorted((r["shard"], r["id"], bytes(r["bytes"])) for r in got) == [("000000.zip", "5", b"\5" * 100), ("000003.zip", "33", b"!" * 100), ("000007.zip", "71", b"G" * 100)]
    done = spark.createDataFrame([("000000.zip",)], "shard string")
    got = shards.taken(shards.listing(spark, f"{zips}/*.zip", done), wanted).collect()
    assert sorted((r["shard"], bytes(r["bytes"])[:6]) for r in got) == [("000003.zip", b"!!!!!!"), ("000007.zip", b"GGGGGG"), ("000007.zip", b"second")]


def test_a_broken_member_that_nobody_wants_is_not_read(spark, zips, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.bin", b"good" * 10)
        z.writestr("b.bin", b"evil" * 10)
    raw = (tmp_path / "x.zip").read_bytes().replace(b"evilevil", b"EVILEVIL")  # its checksum is wrong now
    (tmp_path / "x.zip").write_bytes(raw)
    listed = shards.listing(spark, str(tmp_path / "*.zip"))
    assert [r["id"] for r in shards.taken(listed, spark.createDataFrame(ids("a"), "id string")).collect()] == ["a"]
    with pytest.raises(Exception, match="Bad CRC"):
        shards.taken(listed, spark.createDataFrame(ids("b"), "id string")).collect()


def test_hot_shards_are_opened_by_several_tasks(spark, zips, monkeypatch):
    monkeypatch.setattr(shards, "MEMBERS_EACH", 3)
    monkeypatch.setattr(shards, "BATCH_BYTES", 150)
    got = shards.taken(shards.listing(spark, f"{zips}/*.zip"), spark.createDataFrame(ids(*range(100)), "id string")).collect()
    assert sorted(int(r["id"]) for r in got) == list(range(100))


def test_runs_stop_at_the_budget_and_go_on(spark, zips, tmp_path):
    out, wanted = str(tmp_path), spark.createDataFrame(ids(*range(0, 100, 2)), "id string")
    run = lambda budget, most=None: shards.take_within(spark, f"{zips}/*.zip", wanted, out, budget, most)
    assert run(0) == 0 and run(10_000, most=0) == 0
    assert run(1001) == 3  # begun at 0, 500 and 1000
    assert run(1500) == 0
    assert run(1501) == 1 and run(10_000, most=6) == 2 and run(10_000) == 4 and run(10_000) == 0
    images = spark.read.parquet(f"{out}/images")
    assert sorted(int(r["id"]) for r in images.collect()) == list(range(0, 100, 2))
    assert spark.read.parquet(f"{out}/done").count() == 10


def test_a_run_without_its_note_doesnt_take_twice(spark, zips, tmp_path):
    wanted = spark.createDataFrame(ids(1, 2, 11), "id string")
    shards.taken(shards.listing(spark, f"{zips}/*.zip"), wanted.limit(2)).write.parquet(f"{tmp_path}/images")  # lost before the note
    assert shards.take_within(spark, f"{zips}/*.zip", wanted, str(tmp_path), 10_000) == 10
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/images").collect()) == ["1", "11", "2"]


# ---- index


def test_an_index_equals_brute_force(spark, tmp_path):
    texts = ["abc abc", "ABC abc", "xyz", None, "123", "", "hello wörld", "the quick brown fox", "zzz yyy", "hello world"]
    items = spark.createDataFrame([(i, t, f"r{i}", i / 2, None) for i, t in enumerate(texts)] + [(None, "no id", "r", 0.0, None)], "vec_id long, text string, region string, lat double, lon double").repartition(3)
    n = index.build(items, str(tmp_path / "i"), index.LetterProjection, parts=3)
    got = index.load(spark, str(tmp_path / "i"))
    rows = {r["vec_id"]: r for r in got.collect()}
    assert n == len(rows) and sorted(rows) == [0, 1, 2, 6, 7, 8, 9] and rows[7]["region"] == "r7" and rows[7]["lon"] is None
    model = index.LetterProjection()
    want = {}
    for i in rows:
        counts = [sum(c in (chr(97 + k), chr(65 + k)) for c in texts[i]) for k in range(26)]
        v = np.array([sum(counts[a] * ((7 * a + 13 * b + a * b) % 11 - 5) for a in range(26)) for b in range(16)], float)
        assert np.array_equal(model([texts[i]])[0], v)
        want[i] = v / np.sqrt((v * v).sum())
        assert np.allclose(rows[i]["embedding"], want[i], atol=1e-15)
    queries = got.select(F.col("vec_id").alias("query_id"), "embedding")
    near = {(r["query_id"], r["rank"]): r["vec_id"] for r in geo.nearest(queries, got, 3, digits=9).collect()}
    for q in rows:
        best = sorted(rows, key=lambda i: (-round(float(want[q] @ want[i]), 9), i))[:3]
        assert [near[q, k] for k in (1, 2, 3)] == best


def test_one_model_a_task(spark, tmp_path):
    made = str(tmp_path)

    class Counted:
        def __init__(self):
            import os
            import uuid

            open(os.path.join(made, uuid.uuid4().hex), "w").close()

        def __call__(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    with feeds.settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2"):
        out = index.embedded(spark.createDataFrame([(k, "x" * k) for k in range(40)], "vec_id long, text string").repartition(2), Counted)
        assert out.count() == 40 and len(list(tmp_path.iterdir())) <= 2


def test_files_decide_and_unfinished_indexes_fail(spark, tmp_path):
    items = spark.createDataFrame([(k, "text") for k in range(5)], "vec_id long, text string")
    files = spark.createDataFrame(ids(1, 3, 77), "id string")
    assert index.build(items, str(tmp_path / "i"), index.LetterProjection, files, columns=()) == 2
    assert index.build(items.limit(0), str(tmp_path / "none"), index.LetterProjection, columns=()) == 0
    assert index.load(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        index.load(spark, str(tmp_path / "nowhere"))


# ---- labels


def test_labels_in_two_languages(spark):
    t = [("es", "attribute.edad", "Tiene {{value}} años"), ("en", "attribute.edad", "Is {{value}}"), ("en", "attribute.ubicacion_provincia", "Lives in {{value}}, {{country}}"), ("en", "value.sexo.mujer", "woman"), ("en", "attribute.sexo", "Is a {{value}}"), ("en", "note.n1", "estimated")]
    steps = [
        (1, "edad", None, "30", "Edad: 30", "n1", "estimado"), (2, "ubicacion", "provincia", "León", "Provincia: León", "n9", "nota"), (3, "sexo", None, "mujer", "Mujer", None, None),
        (4, "edad", None, None, "Edad", None, "x"), (5, "ubicacion", None, "León", "Lugar", "n1", None), (6, "sexo", None, "{{value}}", "?", None, None),
    ]
    df = spark.createDataFrame(steps, "n int, category string, location_level string, value_raw string, attribute_label string, note_code string, note string")
    out = labels.labelled(df, spark.createDataFrame(t, "lang string, key string, text string"), ["es", "en", "en"])
    got = {(r["n"], r["lang"]): (r["label"], r["shown_note"]) for r in out.collect()}
    assert len(got) == out.count() == 12
    assert got[1, "es"] == ("Tiene 30 años", "estimado") and got[1, "en"] == ("Is 30", "estimated")
    assert got[2, "en"] == ("Lives in León, {{country}}", "nota") and got[2, "es"] == ("Provincia: León", "nota")
    assert got[3, "en"] == ("Is a woman", None) and got[3, "es"] == ("Mujer", None)
    assert got[4, "en"] == ("Edad", "x") and got[5, "en"] == ("Lugar", "estimated") and got[6, "en"] == ("Is a {{value}}", None)
    row = spark.range(1).select(labels.filled(F.lit("{{a}}-{{b}}-{{c}}"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("{{a}}"), F.lit("c"), F.lit(None).cast("string"))))
    assert row.first()[0] == "1-{{a}}-{{c}}"


# ---- progress


def test_rows_are_counted_as_they_pass(spark):
    progress = Progress()
    df = progress.at("read", spark.range(100), top=F.max("id"))
    out = progress.at("left", df.filter("id % 4 = 0"))
    out.write.format("noop").mode("overwrite").save()
    assert progress.counts() == {"read": {"rows": 100, "top": 99}, "left": {"rows": 25}}


def test_a_listener_counts_batches(spark):
    listener = StreamProgress()
    spark.streams.addListener(listener)
    try:
        parts = [spark.createDataFrame([(k,) for k in range(n)], "id long") for n in (3, 5)]
        feeds.fed(parts, lambda s: s.observe("read", F.count(F.lit(1)).alias("rows")).filter("id > 0").observe("left", F.count(F.lit(1)).alias("rows")))
        import time

        until = time.time() + 30
        while len(listener.ended) < 2 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals() == {"read": 8, "left": 6} and [e for _, e in listener.ended] == [None, None]
    listener.rows += listener.rows[-2:]  # a batch that was run again
    assert listener.totals()["read"] == 8


def test_a_model_gets_few_characters_at_once():
    from tracelens.sources import index

    texts = ["a" * n for n in (3, 4, 9, 1, 1, 0, 12, 2)]
    parts = list(index.portions(texts, 8))
    assert [t for p in parts for t in texts[p]] == texts
    assert [sum(map(len, texts[p])) for p in parts] == [7, 9, 2, 12, 2] and list(index.portions([], 8)) == []
