"""Prompts, summaries, badges and messages: edges that tables don't have."""

from pyspark.sql import functions as F

from tracelens.operators import activity, photos, prompts


def test_prompts(spark):
    posts = [("a", 2, "p2", " \t\n"), ("a", 1, "p1", "  hola \n"), ("a", 3, "p3", "x" * 700), ("a", 0, "p0", None), ("c", 1, "q", "one"), ("c", 2, "r", "two")]
    p = spark.createDataFrame(posts, "profile_id string, seq long, permalink string, text string")
    profiles = spark.createDataFrame([("a", "ana", None, " bio "), ("b", "beto", "Beto B", ""), ("c", "cruz", "", None)], "profile_id string, username string, full_name string, bio string")
    got = {r["profile_id"]: r["prompt"] for r in prompts.prompts(profiles, p, most=2).collect()}
    assert got["a"] == "Nombre de usuario/handle: ana\nBiografía: bio\n\nPublicaciones:\n[p1] hola\n[p3] " + "x" * 600
    assert got["b"] == "Nombre de usuario/handle: beto\nNombre público mostrado por la cuenta: Beto B"
    assert got["c"] == "Nombre de usuario/handle: cruz\n\nPublicaciones:\n[q] one\n[r] two"
    assert prompts.prompts(profiles, p, most=1).filter("prompt LIKE '%two%'").count() == 0


def test_summaries(spark):
    told = [("a", '{"veredicto": " ok ", "conclusiones": [" x ", "", 3, null, {"y": "z"}, "w"]}'), ("b", '{"veredicto": 5, "conclusiones": "no"}'), ("c", "no json"), ("d", None), ("e", "[]"), ("f", '{"conclusiones": ["only"]}')]
    got = {r["profile_id"]: (r["verdict"], r["conclusions"]) for r in prompts.summaries(spark.createDataFrame(told, "profile_id string, json string")).collect()}
    assert got == {"a": ("ok", ["x", "w"]), "b": ("", []), "c": ("", []), "d": ("", []), "e": ("", []), "f": ("", ["only"])}


def test_badges_and_messages(spark):
    rows = spark.createDataFrame([(1, 49.2, 0.825), (2, None, None), (3, 0.0, 1.0)], "n int, r double, c double")
    assert {x["n"]: x["b"] for x in rows.select("n", prompts.badges(F.col("r"), F.col("c")).alias("b")).collect()} == {1: ["-49.2%", "~83%"], 2: [], 3: ["-0.0%", "~100%"]}
    cases = [("reddit", True, 5, 5, "redditNoPhotos"), (None, True, 5, 5, "redditNoPhotos"), ("instagram", False, 0, 0, "indexUnavailable"), ("instagram", None, 1, 1, "indexUnavailable"), ("instagram", True, 0, 0, "noPhotos"), ("instagram", True, 2, 0, "noRepresentative"), ("instagram", True, 2, 1, None)]
    df = spark.createDataFrame(cases, "p string, a boolean, n long, g long, want string")
    assert df.filter(~prompts.map_message(F.col("p"), F.col("a"), F.col("n"), F.col("g")).eqNullSafe(F.col("want"))).count() == 0
    assert [r[0] for r in df.select(prompts.language_of(F.col("p"))).distinct().collect()] == ["es"]


def test_answers_that_are_missing(spark):
    p, a = spark.createDataFrame([(1,), (2,)], "photo int"), spark.createDataFrame([(1, "x")], "photo int, hobby string")
    assert sorted(map(tuple, prompts.with_answers(p, a).collect())) == [(1, "x"), (2, None)]
    assert sorted(map(tuple, prompts.with_answers(p, a, enabled=False).collect())) == [(1, None), (2, None)]
    files = spark.createDataFrame([("i",), ("m",), ("m",)], "id string")
    assert prompts.available(files, ("i", "m")).first()[0] and not prompts.available(files, ("i", "z")).first()[0] and not prompts.available(files.limit(0), ("i",)).first()[0]


def test_links_of_albums(spark):
    posts = spark.createDataFrame([("a", "image", ["u"]), ("b?x=1", "carousel_album", ["v", "w"]), ("c", "video", ["z"]), ("d", "image", [])], "permalink string, type string, media_urls array<string>")
    assert sorted((r["photo_link"], r["photo_index"], r["url"]) for r in photos.photo_links(posts).collect()) == [("a", 1, "u"), ("b?x=1&img_index=1", 1, "v"), ("b?x=1&img_index=2", 2, "w")]


def test_texts_in_order_and_first_rows_of_keys(spark):
    posts = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("a", 3, None), ("b", 1, "x" * 50)], "profile_id string, seq long, text string")
    got = {r["profile_id"]: r["text"] for r in activity.joined_text(posts, most=5).collect()}
    assert got == {"a": "one\nt", "b": "x" * 5}
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "z"), (3, None)], "id int, v string")
    assert sorted((r["id"], r["v"]) for r in activity.first_of_each(one, two, key="id").collect()) == [(1, "a"), (2, "b"), (3, None)]
    assert [r["id"] for r in activity.only_first(one, two.select("id", "v")).orderBy("id").collect()] == [1, 2]
    assert activity.either(one, one).count() == 2
