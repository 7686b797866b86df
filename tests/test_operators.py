"""Operators on small inputs: order, ties, empty tables, files, guards."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.fixture_queries import FINDINGS
from tracelens.functions import reference as R
from tracelens.operators import activity, findings, geo
from tracelens.operators import reference_etl as E
from tracelens.plans import narrowing
from tracelens.sources import files, social


def test_special_categories_are_left_out_unless_asked_for(spark):
    f = FINDINGS.frame(spark)
    assert narrowing.narrowed(f).filter("category = 'religion'").count() == 0
    assert narrowing.narrowed(f, special=True).filter("category = 'religion'").count() == 1
    posts = spark.createDataFrame([("a", 1, "p", "soy lesbiana y budista ☸")], "profile_id string, seq long, permalink string, text string")
    assert findings.declared(posts).count() == 0
    assert {r["value"] for r in findings.declared(posts, special=True).collect()} == {"lesbiana", "budismo"}


def test_consent_gate(spark):
    p = spark.createDataFrame([("a",), ("b",), (None,)], "profile_id string")
    c = spark.createDataFrame([("b",), ("b",), ("x",)], "profile_id string")
    assert [r[0] for r in findings.consented(p, c).collect()] == ["b"]


def test_empty_posts(spark):
    posts = spark.createDataFrame([], "profile_id string, seq long, permalink string, text string, created_utc timestamp, group string, tags array<string>")
    assert findings.declared(posts).count() == 0
    assert activity.hour_shares(posts).count() == 0
    assert activity.keywords(posts).count() == 0


def test_neighbours_in_blocks_are_the_same(spark):
    rows = [(i, [float((i * 7 + k * 3) % 11) for k in range(4)]) for i in range(60)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame(rows[:7], "query_id long, embedding array<float>")
    want = {(q, n): v for q, qv in rows[:7] for n, (v, _) in enumerate(sorted(((v, sum(a * b for a, b in zip(qv, vv, strict=True))) for v, vv in rows), key=lambda x: (-x[1], x[0]))[:5], 1)}
    for block in (2, 100):
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in geo.nearest(queries, index, 5, block).collect()}
        assert got == want


def test_ages_sum_to_their_bands():
    ages = R.one_year_ages()
    assert len(ages) == 101 and abs(sum(ages.values()) - sum(R.AGE_BANDS.values())) < 1e-12


def test_columns_by_alias(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "x")], "ID long, LAT double, Longitude double, city string")
    assert files.resolved_columns(df).columns == ["lat", "lon", "region", "id"]
    with pytest.raises(ValueError):
        files.resolved_columns(df.drop("city"))


def test_csv_metadata(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,latitude,lng,region,country\n1,40.5,-3.1,Madrid,es\n2,48.0,2.0,Paris,FR\n")
    got = files.read_metadata(spark, str(tmp_path / "m.csv"), "country").collect()
    assert [(r["id"], r["region"]) for r in got] == [(1, "Madrid")]


def test_run_log_round_trip(spark, tmp_path):
    p = str(tmp_path / "log")
    runs = spark.createDataFrame([(1.5, "reddit", 3, {"a": 2.0}), (2.5, "instagram", 0, {"a": 1.0})], "timestamp double, platform string, n_photos int, stages_seconds map<string,double>")
    files.append_run_log(runs, p)
    got = files.read_run_log(spark, p).collect()
    assert len(got) == 1 and got[0]["ai_enabled"] is False and got[0]["stages_seconds"] == {"a": 2.0}


def test_shards(spark, tmp_path):
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            for i in range(3):
                z.writestr(f"d/{k * 2 + i}.jpg", bytes([i]))
    wanted = spark.createDataFrame([("1",), ("2",), ("4",)], "id string")
    assert sorted(r["id"] for r in files.extracted(spark, str(tmp_path / "*.zip"), wanted).collect()) == ["1", "2", "4"]
    done = spark.createDataFrame([("1.zip",)], "shard string")
    assert sorted(r["id"] for r in files.extracted(spark, str(tmp_path / "*.zip"), wanted, done).collect()) == ["1", "2"]
    assert files.folder_gib(spark, str(tmp_path)).first()[0] > 0


def test_reports(spark, tmp_path):
    r = spark.createDataFrame([("reddit", "u", [1, 2])], "platform string, username string, xs array<int>").withColumn("name", files.report_name("platform", "username", F.lit("2025-02-03").cast("date")))
    files.write_reports(r, str(tmp_path / "out"))
    # an empty partition can have a file of its own
    (line,) = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert line["name"] == "informe_exposicion_reddit_u_2025-02-03" and line["xs"] == [1, 2]


def test_bio_comes_first(spark):
    posts = spark.createDataFrame([("a", 0, "post", "x", "p")], "profile_id string, seq long, type string, text string, permalink string")
    profiles = spark.createDataFrame([("a", "soy yo"), ("b", ""), ("c", None)], "profile_id string, bio string")
    assert [(r["profile_id"], r["seq"]) for r in social.with_bio(posts, profiles).orderBy("seq").collect()] == [("a", -1), ("a", 0)]


def test_unknown_platform():
    with pytest.raises(ValueError):
        social.reader_of("other")


def test_implausible_share_fails(spark):
    with pytest.raises(Exception, match="not plausible"):
        spark.range(1).select(E.within(F.lit(2.0), 0.0, 1.0, "share")).collect()


def test_final_population_without_estimates(spark):
    f = spark.createDataFrame([("q", "empresa", "Acme", "texto", None, ["1"])], "profile_id string, field string, value string, source string, confidence double, evidence array<string>")
    r = narrowing.final_population(narrowing.narrowed(f)).first()
    assert r["final_population"] is None and r["estimated_steps"] == 0


def test_nearest_with_many_queries_holds_few_similarities(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(5)
    v = np.round(r.normal(size=(3000, 8)), 1)
    index = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, x) for i, x in enumerate(v[:700].tolist())], "query_id long, embedding array<double>")
    monkeypatch.setattr(geo, "TILE", 20_000)  # tiles of a few queries
    got = {}
    for x in geo.nearest(queries, index, 5, block=300).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    sims = v[:700] @ v.T
    for q in range(700):
        want = sorted(range(3000), key=lambda i: (-sims[q, i], i))[:5]
        near = [i for _, i in sorted(got[q])]
        assert np.allclose(sims[q, near], sims[q, want])
    assert geo.nearest(queries, index.filter("vec_id < 3"), 5).count() == 2100


def test_best_of_keeps_the_smallest_of_equals():
    import numpy as np

    sims, vecs = np.full((2, 3), -np.inf), np.full((2, 3), np.iinfo(np.int64).max)
    s, v = geo.best_of(np.array([[1.0, 1, 1, 1], [4, 2, 2, 2]]), np.array([9, 7, 5, 8]), sims, vecs)
    assert v.tolist() == [[5, 7, 8], [9, 5, 7]] and s.tolist() == [[1, 1, 1], [4, 2, 2]]


def test_nearest_place_from_any_grid(spark):
    points = spark.createDataFrame([(1, 40.0, -3.0), (2, 36.0, -6.0)], "point_id long, lat double, lon double")
    places = spark.createDataFrame([(f"r{k}", 35.0 + k, -8.0 + k) for k in range(9)], "region string, lat double, lon double")
    a, b = (sorted(map(tuple, geo.nearest_place(points, places, start).collect())) for start in (2, 12))
    assert a == b and len(a) == 2


def test_nearest_places_equal_all_pairs(spark):
    """Around the poles and the date line, in clusters, with equal coordinates and without any."""
    import math
    import random

    r = random.Random(9)
    spot = lambda: (r.choice([r.uniform(-90, 90), 89.9, -90.0, 40 + r.random() / 100]), r.choice([r.uniform(-180, 180), 179.99, -179.99, 180.0, -3 + r.random() / 100]))
    places = [(f"r{k:03d}", *spot()) for k in range(80)] + [("a", 0.0, 0.0), ("b", 0.0, 0.0), ("nowhere", None, 1.0)]
    points = [(k, *spot()) for k in range(300)] + [(900, places[5][1], places[5][2]), (901, None, 0.0), (902, 0.0, 0.0), (902, 0.0, 0.0)]

    def km(a, b, c, d):
        if None in (a, b, c, d):
            return math.inf
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * geo.EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))

    want = sorted((i, *min((round(km(a, b, c, d), 6), n) for n, c, d in places)) for i, a, b in points)
    p, q = spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(places, "region string, lat double, lon double")
    for start in (None, 1, 9):
        got = sorted((x["point_id"], round(x["km"], 6), x["region"]) for x in geo.nearest_place(p, q, start).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        for g, w in zip(got, want, strict=True):
            assert g[1] == w[1] or abs(g[1] - w[1]) < 1e-5, (g, w)
            assert g[2] == w[2] or abs(g[1] - min(km(a, b, c, d) for i, a, b in points if i == g[0] for n, c, d in places if n == g[2])) < 1e-5


def test_nearest_place_without_places(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, lat double, lon double")
    none = spark.createDataFrame([], "region string, lat double, lon double")
    assert geo.nearest_place(p, none).count() == 0 and geo.nearest_place(p.limit(0), none).count() == 0
    lost = spark.createDataFrame([("x", None, None)], "region string, lat double, lon double")
    assert [tuple(r) for r in geo.nearest_place(p, lost).collect()] == [(1, "x", float("inf"))]


def test_points_are_compared_with_few_places(spark):
    """On a lattice of 40 by 40 places a point meets a handful of them."""
    places = spark.range(1600).selectExpr("concat('p', id) AS region", "30 + id div 40 * 0.5 AS lat", "-10 + id % 40 * 0.5 AS lon")
    level = 1 + 6
    near = geo.in_cells(spark.range(500).selectExpr("31 + id * 0.03 AS _lat", "-9 + id * 0.03 AS _lon"), 10, around=True)
    here = geo.in_cells(places.selectExpr("region", "lat AS _plat", "lon AS _plon", "lat AS _lat", "lon AS _lon"), 10).drop("_lat", "_lon")
    assert near.join(here, "_cell").count() <= 10 * 500 and level < 10
    got = geo.nearest_place(spark.createDataFrame([(1, 40.2, 2.3)], "point_id long, lat double, lon double"), places)
    assert got.first()["region"] == f"p{20 * 40 + 25}"


def test_limits_of_scores_do_not_depend_on_the_order_of_sums(spark):
    """Three times 0.8 is 40 of 100 in any order, which isn't above the limit of 40; in doubles it is 40.00000000000001."""
    from tracelens.plans import scoring

    profiles = spark.createDataFrame([("p", 1, 0.0, 0.0)], "profile_id string, posts long, richness double, peak_share double")
    attributes = spark.createDataFrame([("p", c, 0.8) for c in "abc"], "profile_id string, category string, confidence double")
    scores = scoring.scored(profiles, attributes)
    assert scores.first()["inferable_data_risk"] == 40.0 and scoring.recommendations(scores).first()["codes"] == ["low_exposure"]


def test_recommendations_at_a_limit_are_those_of_their_sql(spark, tmp_path):
    """Three confidences of 0.8, as doubles, are above the limit of 40 in any order."""
    import duckdb

    from tests.test_catalog import ORACLE_SQL, QUERIES

    counts = {1: (50, 50, 50), 2: (60, 50, 70), 3: (49, 50, 50), 4: (1,)}
    kinds = ("view", "click", "signup")
    rows = [(user, kind) for user, n in counts.items() for kind, k in zip(kinds, n, strict=False) for _ in range(k)]
    events = spark.createDataFrame(rows, "user_id long, event_type string").selectExpr("monotonically_increasing_id() AS event_id", "timestamp_ntz'2025-01-01 07:30:00' AS ts", "*", "1.0D AS value")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[0]: list(r[1]) for r in c.sql(ORACLE_SQL["f24_recommendations"]).fetchall()}
    got = {r["profile_id"]: r["codes"] for r in QUERIES["f24_recommendations"](spark, str(tmp_path)).collect()}
    assert got == want and "review_history" in got[1] and "review_history" not in got[3]


def test_every_match_holds_a_piece_of_its_pattern(spark):
    """Texts that match patterns, as they stand, in capitals and with letters that only (?iu) takes for s, i and k, find the same with and without a look for pieces first."""
    from tracelens.functions import text as T

    said = [
        "tengo 24 años", "99 años", "soy un chico", "soy un chaval", "soy hombre", "soy una chica", "soy mujer", "universidad de Soria", "Trabajo en Indra", "trabajo para Acme", "estudio derecho", "estudiante de historia", "graduada en arte", "soy español",
        "soy española", "nacionalidad española", "soy extranjera", "nacionalidad extranjera", "soy marroquí", "soy colombiano", "soy rumana", "soy venezolano", "soy peruana", "soy ecuatoriano", "soy argentina", "soy boliviano", "soy china", "estoy en paro",
        "desempleada", "buscando empleo", "busco trabajo", "jubilado", "pensionista", "soy estudiante", "estudiante a tiempo completo", "trabajo como médico", "trabajo de noche", "soy autónoma", "tengo trabajo", "mi lengua materna es el catalán", "hablo catalán",
        "catalanoparlante", "hablo euskera", "euskaldun", "hablo gallego", "galegofalante", "hablo valenciano", "vivo en leon", "madre soltera", "padre soltero", "familia monoparental", "vivo sola", "vivo con mi marido", "mis hijos", "mi hija", "hetero", "gay",
        "lesbiana", "pansexual", "asexual", "homosexual", "bi - sexual", "bisexuial", *(w for w, _ in T.RELIGION_WORDS), *(sign for _, sign, _ in T.ZODIAC), "nada",
    ]
    odd = str.maketrans("sik", "ſıK")
    texts = [f"x {t}, y" for s in said for t in (s, s.upper(), s.title(), s.translate(odd), s.replace("i", "İ"))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumns({"low": F.lower("text"), "odd": T.is_odd(F.col("text"))})
    may = T.pieces_in(F.col("low"), F.col("odd"))
    wrong = [F.count_if(F.col("text").rlike(p) & ~may(p)) for p in T.PIECES]
    assert df.agg(F.array(*wrong)).first()[0] == [0] * len(T.PIECES)
    hits = df.agg(F.array(*(F.count_if(F.col("text").rlike(p)) for p in T.PIECES))).first()[0]
    assert min(hits) > 0  # each pattern is tried


def test_letters_that_only_a_pattern_folds(spark):
    """Of all characters only FOLDED match a letter of the patterns in another case without being that letter in lower case."""
    from tracelens.functions import text as T

    letters = "abcdefghijklmnopqrstuvwxyzáéíóúñ"
    chars = spark.createDataFrame([(chr(c),) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000], "c string")
    found = chars.filter(F.col("c").rlike(rf"(?iu)^[{letters}]$") & ~F.lower("c").isin(*letters)).collect()
    assert {r["c"] for r in found} <= set(T.FOLDED)


def test_only_what_is_asked_for_is_looked_for(spark):
    from tracelens.operators import findings as O

    posts = spark.createDataFrame([("p", 1, "a", "soy budista y tengo 24 años"), ("p", 2, "b", "universidad de Soria, ateo")], "profile_id string, seq long, permalink string, text string")
    every = O.declared(posts, special=True).filter("field = 'religion'")
    one = O.declared(posts, special=True, only=("religion",))
    assert one.collect() == every.collect() and one.count() == 1
    assert "universidad" not in one._jdf.queryExecution().optimizedPlan().toString()


def test_documents_as_posts_are_not_shuffled(spark):
    from tests.test_catalog import SF
    from tracelens.plans import queries_flagship

    assert "Exchange hashpartitioning" not in queries_flagship.posts_of(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_posts_of_those_who_agreed_are_not_brought_together(spark):
    posts = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "profile_id string, seq long")
    agreed = findings.consented(posts, posts.select("profile_id").filter("profile_id = 'b'"))
    assert "Exchange hashpartitioning" not in agreed._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["seq"] for r in agreed.collect()) == [2, 3]


def test_frequent_terms_are_those_of_all_terms(spark):
    """Against counting every word and pair, with many ties at the limit; pairs that can't be frequent are not gathered."""
    import random
    import re
    from collections import Counter

    r = random.Random(3)
    rows = [(f"p{k % 3}", k, " ".join(r.choice("el la x1 ab Ab cd ef gh ij kl mn op qr st".split()) for _ in range(r.randrange(0, 30)))) for k in range(60)] + [("q", 60, "solo una"), ("q", 61, "")]
    words = activity.words_of(spark.createDataFrame(rows, "profile_id string, seq long, text string"))
    for features in (1, 5, 20, 500):
        want = set()
        for p in {row[0] for row in rows}:
            each = [re.findall(r"\w{2,}", text.lower()) for who, _, text in rows if who == p]
            n = Counter(t for w in each for t in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])
            want |= {(p, t) for t, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:features]}
        got = [(x["profile_id"], x["term"]) for x in activity.frequent_terms(words, features).collect()]
        assert set(got) == want and len(got) == len(want)


def test_posts_without_text_do_not_stand_before_those_with_words(spark):
    rows = [("p", k, None) for k in range(4)] + [("p", 4, "que de la"), ("n", 1, None)]
    got = {r["profile_id"]: r["language"] for r in activity.language(spark.createDataFrame(rows, "profile_id string, seq long, text string"), ("que", "de", "la"), tokens=3).collect()}
    assert got == {"p": "es", "n": "en"}
