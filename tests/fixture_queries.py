"""Operators on small literal tables, each with the rows it must give in SQL: unit tests of single rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.functions import reference as R
from tracelens.functions import text as T
from tracelens.operators import answers
from tracelens.operators import findings as O
from tracelens.operators import geo as G
from tracelens.operators import reference_etl as E
from tracelens.plans import narrowing
from tracelens.plans.queries_persons import tag_attributes
from tracelens.plans.registry import Fixture
from tracelens.sources import files, social

FIXED = {}


def query(name, sql):
    def keep(f):
        FIXED[name] = f, sql
        return f

    return keep


REDDIT = Fixture(
    "profile_id string, page int, json string",
    [
        ("u", 0, '{"data":{"children":[{"data":{"id":"1","subreddit":"Madrid","title":"T1","selftext":"","created_utc":1735732800.0,"score":3,"permalink":"/r/1"}},{"data":{"id":"2","subreddit":"dev","title":"T2","selftext":"body","created_utc":1735736400.0,"score":5,"permalink":"/r/2"}}]}}'),
        ("v", 0, '{"data":{"children":[]}}'),
    ],
)


@query("s01_reddit_posts", "SELECT * FROM (VALUES ('u', 0, '1', 'T1', ['madrid'], TIMESTAMP '2025-01-01 12:00:00', 'https://www.reddit.com/r/1'), ('u', 1, '2', 'body', ['dev'], TIMESTAMP '2025-01-01 13:00:00', 'https://www.reddit.com/r/2')) AS t(profile_id, seq, id, text, tags, created_utc, permalink)")
def s01(spark, d):
    return social.reddit_posts(REDDIT.frame(spark)).select("profile_id", "seq", "id", "text", "tags", F.col("created_utc").cast("timestamp_ntz").alias("created_utc"), "permalink")


COMMENTS = Fixture("profile_id string, page int, json string", [("u", 0, '{"data":{"children":[{"data":{"id":"9","subreddit":"Spain","body":"hola","created_utc":1735732800.0,"score":1,"permalink":"/r/9"}}]}}')])


@query("s02_reddit_comments", "SELECT 'u' AS profile_id, '9' AS id, 'comment' AS type, NULL AS title, 'hola' AS text, ['spain'] AS tags")
def s02(spark, d):
    return social.reddit_comments(COMMENTS.frame(spark)).select("profile_id", "id", "type", "title", "text", "tags")


@query("u01_posts_then_comments", "SELECT * FROM (VALUES ('u', 0, '1'), ('u', 1, '2'), ('u', 2, '9')) AS t(profile_id, seq, id)")
def u01p(spark, d):
    return social.activity(social.reddit_posts(REDDIT.frame(spark)), social.reddit_comments(COMMENTS.frame(spark))).select("profile_id", "seq", "id")


AVATARS = Fixture("id long, url string", [(1, "https://a/b?x=1&amp;s=2"), (2, "plain"), (3, None)])


@query("s03_avatar_unescape", f"SELECT id, replace(url, '&amp;', '&') AS url FROM {AVATARS.sql()}")
def s03(spark, d):
    return AVATARS.frame(spark).select("id", social.unescaped(F.col("url")).alias("url"))


MEDIA = Fixture(
    "profile_id string, page int, json string",
    [
        ("i", 0, '{"data":[{"id":"m1","caption":"Sol #Madrid #Año","timestamp":"2025-01-01T10:00:00+0000","media_type":"IMAGE","permalink":"p1","like_count":4,"comments_count":1,"media_url":"u1"}],"paging":{"next":"x"}}'),
        ("i", 1, '{"data":[{"id":"m2","timestamp":"2025-01-02T10:00:00+0100","media_type":"CAROUSEL_ALBUM","permalink":"p2","children":{"data":[{"media_url":"a","media_type":"IMAGE"},{"media_url":"b","media_type":"VIDEO"},{"media_type":"IMAGE"}]}},{"id":"m3","caption":"v","timestamp":"2025-01-03T00:00:00+0000","media_type":"VIDEO","permalink":"p3","media_url":"z"}]}'),
    ],
)


@query(
    "s06_instagram_media",
    """SELECT * FROM (VALUES ('i', 0, 'm1', 'image', 'madrid', ['madrid', 'año'], 5, TIMESTAMP '2025-01-01 10:00:00', ['u1']), ('i', 1, 'm2', 'carousel_album', 'sin_etiqueta', [], 0, TIMESTAMP '2025-01-02 09:00:00', ['a']),
    ('i', 2, 'm3', 'video', 'sin_etiqueta', [], 0, TIMESTAMP '2025-01-03 00:00:00', [])) AS t(profile_id, seq, id, type, "group", tags, score, created_utc, media_urls)""",
)
def s06(spark, d):
    return social.instagram_media(MEDIA.frame(spark)).select("profile_id", "seq", "id", "type", "group", "tags", "score", F.col("created_utc").cast("timestamp_ntz").alias("created_utc"), "media_urls")


@query("s04_paged_limit", "SELECT * FROM (VALUES ('m1'), ('m2')) AS t(id)")
def s04(spark, d):
    return social.instagram_media(MEDIA.frame(spark), most=2).select("id")


@query("g15_type_counts", "SELECT 'i' AS profile_id, 0 AS n_comments, 3 AS n_media_items, 2 AS n_photos, 0 AS n_posts")
def g15(spark, d):
    return social.type_counts(social.instagram_media(MEDIA.frame(spark)))


GEO = Fixture("ID long, Latitude double, LNG double, State string, country string", [(1, 40.0, -3.0, "Madrid", " es "), (2, 48.0, 2.0, "Paris", "FR"), (3, 41.0, 2.0, "Barcelona", "Spain")])


@query("s09_column_aliases", "SELECT 1 AS id, 40.0::DOUBLE AS lat, -3.0::DOUBLE AS lon, 'Madrid' AS region UNION ALL SELECT 3, 41.0, 2.0, 'Barcelona'")
def s09(spark, d):
    g = GEO.frame(spark)
    return files.resolved_columns(g.filter(F.upper(F.trim("country")).isin(*files.SPAIN)))


@query("g07_country_filter", f"SELECT ID FROM {GEO.sql()} WHERE upper(trim(country)) IN ('ES', 'ESP', 'SPAIN')")
def g07(spark, d):
    return GEO.frame(spark).filter(F.upper(F.trim("country")).isin(*files.SPAIN)).select("ID")


SERIES = Fixture(
    "json string",
    [
        ('[{"Nombre":"Total. Sevilla","MetaData":[{"T3_Variable":"Provincias","Nombre":"Sevilla"},{"T3_Variable":"Sexo","Nombre":"Total"}],"Data":[{"Valor":10.0,"Fecha":5,"Anyo":2020,"FK_Periodo":1},{"Valor":12.0,"Fecha":9,"Anyo":2021,"FK_Periodo":1}]},'
         '{"Nombre":"Hombres. Sevilla","MetaData":[{"T3_Variable":"Provincias","Nombre":"Sevilla"},{"T3_Variable":"Sexo","Nombre":"Hombres"}],"Data":[{"Valor":6.0,"Anyo":2021,"FK_Periodo":2},{"Valor":5.0,"Anyo":2021,"FK_Periodo":1}]}]',),
    ],
)


@query("s13_series_latest", "SELECT * FROM (VALUES ('Total. Sevilla', 12.0::DOUBLE), ('Hombres. Sevilla', 6.0::DOUBLE)) AS t(name, value)")
def s13(spark, d):
    s = E.long_series(SERIES.frame(spark))
    return E.latest(s, "name", "value", F.coalesce("fecha", F.col("anyo") * 100 + F.col("periodo")))


@query("g08_dimension_filter", "SELECT 'Sevilla' AS province, 12.0::DOUBLE AS value")
def g08(spark, d):
    s = E.long_series(SERIES.frame(spark)).filter("variables['Sexo'] = 'Total' AND size(variables) = 2")
    return E.latest(s.withColumn("province", F.col("variables")["Provincias"]), "province", "value", "fecha")


POSTS = Fixture(
    "profile_id string, seq long, permalink string, text string",
    [
        ("ana", -1, "bio", "Soy una chica de ciudad. Estudiante de enfermería ♌"), ("ana", 1, "a1", "Tengo 24 años y vivo en León, cerca del río"), ("ana", 2, "a2", "Con 30 años todo cambia"),
        ("ana", 3, "a3", "Trabajo en Indra desde ayer"), ("ana", 4, "a4", "vivo con mi pareja"), ("ana", 5, "a5", "mis hijos y yo"), ("ana", 6, "a6", "Estoy en paro y antes trabajo como docente"),
        ("beto", 1, "b1", "Soy un chico normal, vivo en Canarias"), ("beto", 2, "b2", "Universidad de Sevilla, graduado en ingeniería informática"), ("beto", 3, "b3", "soy marroquí; hablo catalán"), ("beto", 4, "b4", "200 años de historia"),
        ("cruz", 1, "c1", "vivo en Asturias, soy piscis"), ("cruz", 2, "c2", "vivo sola"), ("cruz", 3, "c3", ""), ("cruz", 4, "c4", "soy jubilada, nacionalidad española, hablo gallego"),
        ("dani", 1, "d1", "vivo en Cuenca, muy lejos"), ("dani", 2, "d2", "ocupada con 17 años"), ("dani", 3, "d3", "madre soltera"), ("eva", 1, "e1", "nada que decir"),
    ],
)


FOUND = [
    ("ana", "edad", "24", ["a1"]), ("ana", "sexo", "mujer", ["bio"]), ("ana", "municipio", "leon", ["a1"]), ("ana", "estudios", "enfermeria", ["bio"]), ("ana", "ocupacion", "docente", ["a6"]), ("ana", "empresa", "Indra", ["a3"]),
    ("ana", "situacion_laboral", "activo", ["a3"]), ("ana", "signo_zodiacal", "leo (23 jul - 22 ago)", ["bio"]), ("ana", "tipo_hogar", "pareja_con_hijos", ["a4", "a5"]),
    ("beto", "sexo", "hombre", ["b1"]), ("beto", "comunidad_autonoma", "canarias", ["b1"]), ("beto", "universidad", "Sevilla", ["b2"]), ("beto", "estudios", "ingenieria informatica", ["b2"]), ("beto", "nacionalidad", "extranjera", ["b3"]), ("beto", "lengua_materna", "catalan", ["b3"]),
    ("cruz", "provincia", "asturias", ["c1"]), ("cruz", "signo_zodiacal", "piscis (19 feb - 20 mar)", ["c1"]), ("cruz", "tipo_hogar", "unipersonal", ["c2"]), ("cruz", "situacion_laboral", "jubilado", ["c4"]), ("cruz", "nacionalidad", "espanola", ["c4"]), ("cruz", "lengua_materna", "gallego", ["c4"]),
    ("dani", "provincia", "cuenca", ["d1"]), ("dani", "edad", "17", ["d2"]), ("dani", "tipo_hogar", "monoparental", ["d3"]),
]


EXPECTED = Fixture("profile_id string, field string, value string, evidence array<string>", FOUND)


@query("a10_declared_findings", f"SELECT * FROM {EXPECTED.sql()}")
def a10f(spark, d):
    return O.declared(POSTS.frame(spark)).select("profile_id", "field", "value", "evidence")


@query(
    "f08_household_table",
    """SELECT p, a, c, s, CASE WHEN s OR (c AND a) THEN 'monoparental' WHEN a THEN 'unipersonal' WHEN p AND c THEN 'pareja_con_hijos' WHEN p THEN 'pareja_sin_hijos' END AS household
    FROM (SELECT unnest([true, false]) AS p) CROSS JOIN (SELECT unnest([true, false]) AS a) CROSS JOIN (SELECT unnest([true, false]) AS c) CROSS JOIN (SELECT unnest([true, false]) AS s)""",
)
def f08(spark, d):
    bits = spark.range(16).select(*[F.expr(f"shiftright(id, {k}) % 2 = 1").alias(n) for k, n in enumerate("pacs")])
    return bits.withColumn("household", O.household(F.col("p"), F.col("a"), F.col("c"), F.col("s")))


FINDINGS = Fixture(
    "profile_id string, field string, value string, source string, confidence double, evidence array<string>",
    [
        ("x", "sexo", "mujer", "texto", None, ["1"]), ("x", "edad", "24", "texto", None, ["2"]), ("x", "provincia", "barcelona", "imagen", None, ["3"]), ("x", "lengua_materna", "catalan", "texto", None, ["4"]), ("x", "estado_civil", "soltero", "ia_simbolica", 0.6, ["5"]),
        ("y", "ocupacion", "astronauta", "texto", None, ["6"]), ("y", "municipio", "soria", "texto", None, ["7"]), ("y", "signo_zodiacal", "leo (23 jul - 22 ago)", "texto", None, ["8"]), ("y", "tipo_hogar", "monoparental", "texto", None, ["9"]), ("y", "universidad", "Soria", "texto", None, ["10"]),
        ("z", "edad_rango", "25-29", "ia_estimada", 0.8, ["11"]), ("z", "estado_civil", "casado", "ia_simbolica", None, ["12"]), ("z", "lengua_materna", "euskera", "texto", None, ["13"]), ("z", "empresa", "Acme", "texto", None, ["14"]), ("z", "religion", "islam", "texto", None, ["15"]),
    ],
)


NARROW_SQL = f"""
WITH s AS (SELECT * FROM (VALUES
 ('x', 1, 'sexo', 0.508::DOUBLE), ('x', 2, 'edad', 0.045::DOUBLE / 5), ('x', 3, 'ubicacion', 5959941::DOUBLE / {R.TOTAL_POPULATION}), ('x', 9, 'lengua_materna', 0.555), ('x', 13, 'estado_civil', 0.136),
 ('y', 3, 'ubicacion', 39000::DOUBLE / {R.TOTAL_POPULATION}), ('y', 5, 'ocupacion', NULL), ('y', 8, 'tipo_hogar', 0.1), ('y', 12, 'signo_zodiacal', 1.0::DOUBLE / 12), ('y', 14, 'universidad', NULL),
 ('z', 2, 'edad', 0.052), ('z', 9, 'lengua_materna', NULL), ('z', 13, 'estado_civil', 0.458), ('z', 15, 'empresa', NULL)) AS t(profile_id, step_no, category, p)),
r AS (SELECT *, {R.TOTAL_POPULATION}::DOUBLE * product(coalesce(p, 1)) OVER (PARTITION BY profile_id ORDER BY step_no) AS l FROM s)
"""


@query(
    "a12_narrowing",
    NARROW_SQL
    + """SELECT profile_id, step_no, category, CASE WHEN p IS NOT NULL THEN round_even(l, 0)::BIGINT END AS remaining_population,
    CASE WHEN p IS NULL THEN 'no_estimable' WHEN l >= 100000 THEN 'bajo' WHEN l >= 1000 THEN 'medio' WHEN l >= 20 THEN 'alto' ELSE 'critico' END AS risk_level, round_even((1 - p) * 100, 1)::DOUBLE AS reduction_percent FROM r""",
)
def a12(spark, d):
    return narrowing.narrowed(FINDINGS.frame(spark)).select("profile_id", "step_no", "category", "remaining_population", "risk_level", "reduction_percent")


@query("a13_final_population", NARROW_SQL + "SELECT profile_id, arg_max(round_even(l, 0)::BIGINT, step_no) FILTER (p IS NOT NULL) AS final_population, count(p) AS estimated_steps FROM r GROUP BY 1")
def a13(spark, d):
    return narrowing.final_population(narrowing.narrowed(FINDINGS.frame(spark)))


AGE_TABLE = Fixture("age int, share double", [(a, p) for a, p in R.one_year_ages().items() if a % 10 == 3 or a > 95])


@query("d01_age_shares", f"SELECT age, round(share, 10) AS share FROM {AGE_TABLE.sql()}")
def d01(spark, d):
    ages = R.distributions(spark).filter("field = 'edad'").select(F.col("key").cast("int").alias("age"), F.round("p", 10).alias("share"))
    return ages.filter("age % 10 = 3 OR age > 95")


WIDE = Fixture("id long, sexo string, estado string", [(1, "mujer", "soltero"), (2, "hombre", "viudo"), (3, None, "casado"), (4, "otro", "soltero"), (5, "mujer", "raro"), (6, None, "raro")])


@query(
    "j02_marital_given_sex",
    f"""SELECT id, CASE WHEN sexo IN ('hombre', 'mujer') THEN CASE sexo || estado WHEN 'mujersoltero' THEN 0.136 WHEN 'hombreviudo' THEN 0.025 END
    ELSE CASE estado WHEN 'casado' THEN 0.458 WHEN 'soltero' THEN 0.152 END END::DOUBLE AS share FROM {WIDE.sql()}""",
)
def j02(spark, d):
    w = WIDE.frame(spark).withColumn("g", F.when(F.col("sexo").isin(*R.SEX), F.col("sexo")))
    s = R.distributions(spark).filter("field = 'estado_civil'").select(F.col("key").alias("estado"), F.col("given").alias("h"), F.col("p").alias("share"))
    return w.join(s, (w["estado"] == s["estado"]) & w["g"].eqNullSafe(s["h"]), "left").select("id", "share")


PLACES = Fixture("id long, text string", [(1, "Vivo en Castilla y León"), (2, "vivo en la comunidad valenciana"), (3, "vivo en Islas Canarias"), (4, "vivo en euskadi"), (5, "vivo en marte"), (6, "vivo en Navarra"), (7, "nada")])


@query("f07_location", "SELECT * FROM (VALUES (1, 'municipio', 'leon'), (2, 'municipio', 'valencia'), (3, 'comunidad_autonoma', 'canarias'), (4, 'comunidad_autonoma', 'pais vasco'), (5, NULL, NULL), (6, 'provincia', 'navarra'), (7, NULL, NULL)) AS t(id, level, key)")
def f07(spark, d):
    return PLACES.frame(spark).withColumn("l", O.location(F.col("text"))).select("id", "l.level", "l.key")


REGIONS = Fixture("raw string", [("Sevilla",), ("  CATALONIA ",), ("País Vasco",), ("Principado de Asturias",), ("desconocido",), ("Canary Islands",), ("León",)])


@query("j06_resolve_region", "SELECT * FROM (VALUES ('Sevilla', 'provincia', 'sevilla'), ('  CATALONIA ', 'comunidad_autonoma', 'cataluna'), ('País Vasco', 'comunidad_autonoma', 'pais vasco'), ('Principado de Asturias', 'provincia', 'asturias'), ('desconocido', NULL, NULL), ('Canary Islands', 'comunidad_autonoma', 'canarias'), ('León', 'provincia', 'leon')) AS t(raw, level, key)")
def j06(spark, d):
    p = R.populations(spark).filter("level = 'provincia'").select(F.col("key").alias("_p"))
    only = R.places(spark).filter("provinces_in_community = 1").select(F.col("community").alias("_oc"), F.col("province").alias("_only"))
    r = REGIONS.frame(spark).withColumn("n", F.trim(T.plain(F.col("raw"))))
    r = r.join(p, F.col("n") == F.col("_p"), "left").join(R.aliases(spark), F.col("n") == F.col("alias"), "left").join(only, F.col("community") == F.col("_oc"), "left")
    level = F.when(F.col("_p").isNotNull() | F.col("_only").isNotNull(), "provincia").when(F.col("community").isNotNull(), "comunidad_autonoma")
    return r.select("raw", level.alias("level"), F.coalesce("_p", "_only", "community").alias("key"))


@query("j18_alias_lookup", "SELECT * FROM (VALUES ('Sevilla', NULL), ('  CATALONIA ', 'cataluna'), ('País Vasco', 'pais vasco'), ('Principado de Asturias', 'asturias'), ('desconocido', NULL), ('Canary Islands', 'canarias'), ('León', NULL)) AS t(raw, community)")
def j18(spark, d):
    r = REGIONS.frame(spark).withColumn("alias", F.trim(T.plain(F.col("raw"))))
    return r.join(R.aliases(spark), "alias", "left").select("raw", "community")


AI = Fixture(
    "profile_id string, json string",
    [
        ("m", '{"sexo": "mujer", "edad": 31, "situacion_laboral": "activo", "inferencias_blandas": [{"categoria": "aficion", "valor": "ciclismo", "confianza": 0.8}, {"categoria": "x", "valor": "", "confianza": 2}]}'),
        ("n", '{"sexo": "otro", "edad": 140, "edad_rango": {"valor": "30-34", "confianza": 0.9}}'), ("o", "not json"), ("p", '{"edad": true, "edad_rango": {"valor": "30-34", "confianza": 0.5}, "nacionalidad": "espanola"}'),
    ],
)


@query("f29_model_answers", "SELECT * FROM (VALUES ('m', 'edad', '31', NULL), ('m', 'sexo', 'mujer', NULL), ('m', 'situacion_laboral', 'activo', NULL), ('n', 'edad_rango', '30-34', 0.9::DOUBLE), ('p', 'nacionalidad', 'espanola', NULL)) AS t(profile_id, field, value, confidence)")
def f29(spark, d):
    return answers.from_model(AI.frame(spark)).select("profile_id", "field", "value", "confidence")


@query("t06_soft_inferences", "SELECT * FROM (VALUES ('m', 'aficion', 'ciclismo', 0.8::DOUBLE)) AS t(profile_id, category, value, confidence)")
def t06(spark, d):
    return answers.soft_inferences(AI.frame(spark))


STALE = Fixture("name string, verified string, days long", [(k, v, n or R.DEFAULT_STALE_DAYS) for k, (v, n) in R.VERIFIED.items()])


@query("d05_stale_tables", f"SELECT name, verified, date_diff('day', verified::DATE, DATE '2027-01-15') AS age FROM {STALE.sql()} WHERE verified IS NOT NULL AND date_diff('day', verified::DATE, DATE '2027-01-15') > days")
def d05(spark, d):
    s = STALE.frame(spark).withColumn("verified", F.to_date("verified"))
    return s.withColumn("age", F.datediff(F.lit("2027-01-15").cast("date"), F.col("verified")).cast("long")).filter("age > days").select("name", F.col("verified").cast("string").alias("verified"), "age")


WORDS = Fixture("id long, text string", [(1, "Ávila y CÓRDOBA"), (2, "niño pingüino"), (3, "façade Übung"), (4, "plain")])


@query("f01_strip_accents", f"SELECT id, lower(strip_accents(text)) AS text FROM {WORDS.sql()}")
def f01(spark, d):
    return WORDS.frame(spark).select("id", T.plain(F.col("text")).alias("text"))


TAGGED = Fixture(
    "profile_id string, seq long, permalink string, text string, tags array<string>, group string",
    [
        ("r", 1, "r1", "madrugo siempre", ["amanecemosMadrid", "x"], "g"), ("r", 2, "r2", "", [], "Madrid"), ("r", 3, "r3", "", ["es"], "g"), ("r", 4, "r4", "night shift", ["nurselife"], "g"),
        ("s", 1, "s1", "", ["espresso"], "cafe"), ("s", 2, "s2", "WFH hoy", ["devlife"], "g"), ("s", 3, "s3", "", ["devlife"], "g"), ("s", 4, "s4", "", [], "teachers"),
    ],
)


@query(
    "u08_tag_attributes",
    """SELECT * FROM (VALUES ('r', 'ubicacion', 'amanecemosmadrid', 0.45::DOUBLE, ['r1', 'r2', 'r3']), ('r', 'ocupacion', 'nurselife', 0.35::DOUBLE, ['r4']), ('r', 'rutina', NULL, 0.6::DOUBLE, ['r1', 'r4']),
    ('s', 'ocupacion', 'devlife', 0.4::DOUBLE, ['s2', 's3', 's4']), ('s', 'rutina', NULL, 0.6::DOUBLE, ['s2'])) AS t(profile_id, category, value, confidence, evidence)""",
)
def u08(spark, d):
    return tag_attributes(TAGGED.frame(spark)).select("profile_id", "category", "value", "confidence", "evidence")


ESTIMATES = Fixture(
    "profile_id string, seq long, permalink string, region string, confidence double, representative boolean, is_avatar boolean",
    [
        ("a", 1, "a1", "sevilla", 0.85, True, False), ("a", 2, "a2", "sevilla", 0.9, True, False), ("a", 3, "a3", "madrid", 0.95, True, False),
        ("b", 1, "b1", "canarias", 0.65, True, False), ("b", 2, "b2", "las palmas", 0.7, True, False), ("b", 3, "b3", "canary islands", 0.61, True, False), ("b", 4, "b4", "santa cruz de tenerife", 0.75, True, False),
        ("c", 1, "c1", "asturias", 0.99, True, False), ("c", 2, "c2", "asturias", 0.99, False, False), ("c", 3, "c3", "asturias", 0.99, True, True),
        ("d", 1, "d1", "principado de asturias", 0.9, True, False), ("d", 2, "d1", "principado de asturias", 0.91, True, False), ("d", 3, "d2", "desconocido", 1.0, True, False),
        ("e", 1, "e1", "madrid", 0.81, True, False), ("e", 2, "e2", "madrid", 0.82, True, False), ("e", 3, "t1", "sevilla", 0.9, True, False), ("e", 4, "t1", "cadiz", 0.9, True, False), ("e", 5, "t1", "sevilla", 0.9, True, False),
    ],
)


@query(
    "d04_home_region",
    """SELECT * FROM (VALUES ('a', 'provincia', 'sevilla', 2, 0.875::DOUBLE, ['a1', 'a2']), ('b', 'comunidad_autonoma', 'canarias', 4, 0.6775::DOUBLE, ['b1', 'b2', 'b3', 'b4']),
    ('d', 'provincia', 'asturias', 2, 0.905::DOUBLE, ['d1', 'd1']), ('e', 'provincia', 'madrid', 2, 0.815::DOUBLE, ['e1', 'e2'])) AS t(profile_id, level, key, n_photos, confidence, evidence)""",
)
def d04(spark, d):
    travel = spark.createDataFrame([("e", "t1")], "profile_id string, permalink string")
    out = G.consensus(ESTIMATES.frame(spark), R.places(spark), R.aliases(spark), R.populations(spark).filter("level = 'provincia'"), travel)
    return out.withColumn("confidence", F.round("confidence", 6))


CAPTIONS = Fixture(
    "post string, text string",
    [("p1", "De viaje por la costa"), ("p2", "Hoy en casa"), ("p3", "Unos días en Roma"), ("p4", ""), ("p5", "visitando a mi abuela"), ("p6", "viajes baratos")],
)


@query("f12_travel_posts", f"SELECT post FROM {CAPTIONS.sql()} WHERE regexp_matches(lower(text), '(de viaje|unos d[ií]as en|visitando)')")
def f12(spark, d):
    return CAPTIONS.frame(spark).filter(F.col("text").rlike(T.TRAVEL)).select("post").distinct()


PHOTOS = Fixture("permalink string, kind string, urls array<string>", [("https://x/1", "image", ["u1"]), ("https://x/2", "carousel_album", ["u2", "u3"]), ("https://x/3?a=1", "carousel_album", ["u4", "u5", "u6"]), ("https://x/4", "video", ["v"]), ("https://x/5", "image", [])])


@query(
    "f15_photo_links",
    f"""SELECT permalink, i AS photo_index, len(urls) AS photo_total, CASE WHEN len(urls) > 1 THEN permalink || CASE WHEN contains(permalink, '?') THEN '&' ELSE '?' END || 'img_index=' || i ELSE permalink END AS photo_link, urls[i] AS url
    FROM (SELECT *, unnest(range(1, len(urls) + 1)) AS i FROM {PHOTOS.sql()} WHERE kind IN ('image', 'carousel_album'))""",
)
def f15(spark, d):
    p = PHOTOS.frame(spark).filter(F.col("kind").isin("image", "carousel_album")).select("permalink", F.size("urls").alias("photo_total"), F.posexplode("urls").alias("i", "url"))
    n = (F.col("i") + 1).alias("photo_index")
    link = F.when(F.col("photo_total") > 1, F.concat("permalink", F.when(F.contains("permalink", F.lit("?")), "&").otherwise("?"), F.lit("img_index="), (F.col("i") + 1).cast("string"))).otherwise(F.col("permalink"))
    return p.select("permalink", n, "photo_total", link.alias("photo_link"), "url")


DMS = Fixture("id long, d double, m double, s double, ref string", [(1, 40.0, 25.0, 0.0, "N"), (2, 3.0, 42.0, 9.0, "W"), (3, 33.0, 52.0, 10.0, "S"), (4, 151.0, 12.0, 30.5, "E")])


@query("f19_dms_to_decimal", f"SELECT id, round((d + m / 60 + s / 3600) * CASE WHEN ref IN ('S', 'W') THEN -1 ELSE 1 END, 8) AS degrees FROM {DMS.sql()}")
def f19(spark, d):
    return DMS.frame(spark).select("id", F.round((F.col("d") + F.col("m") / 60 + F.col("s") / 3600) * F.when(F.col("ref").isin("S", "W"), -1).otherwise(1), 8).alias("degrees"))


VQA = Fixture(
    "photo string, answer string",
    [
        ("f1", "PERSONAS: una.\nAFICION: ciclismo\nPAREJA: no\nTEXTO_VISIBLE: ninguno"), ("f2", "PERSONAS: varias\nAFICION: cocina.\nPAREJA: sí\nTEXTO_VISIBLE: Bar Pepe"),
        ("f3", "PERSONAS: ninguna\nAFICION: N/A\nTEXTO_VISIBLE:"), ("f4", "sin formato"),
    ],
)


@query(
    "f27_photo_answers",
    """SELECT * FROM (VALUES ('f1', 'una', 'ciclismo', 'no', NULL, 'ciclismo'), ('f2', 'varias', 'cocina', 'sí', 'bar pepe', NULL), ('f3', 'ninguna', NULL, NULL, NULL, NULL), ('f4', NULL, NULL, NULL, NULL, NULL))
    AS t(photo, persons, hobby, couple, visible_text, inferred_hobby)""",
)
def f27(spark, d):
    def line(name, negative=()):
        v = F.lower(F.rtrim(F.trim(T.captured(F.col("answer"), rf"(?im)^{name}:[ \t]*([^\n]*)")), F.lit(".")))
        return F.when((v != "") & ~v.isin(*negative), v) if negative else F.when(v != "", v)

    none = ("ninguno", "ninguna", "none", "n/a", "no")
    a = VQA.frame(spark).select("photo", line("PERSONAS").alias("persons"), line("AFICION", none).alias("hobby"), line("PAREJA").alias("couple"), line("TEXTO_VISIBLE", none).alias("visible_text"))
    return a.withColumn("inferred_hobby", F.when(F.col("persons").isin("ninguna", "una"), F.col("hobby")))


NAMED = Fixture("id string, n long", [("documents", 1), ("pages", 2), ("nothing", 3), ("benchmark", 4), ("Region", 5)])


@query("j12_with_files", "SELECT * FROM (VALUES ('documents', 1), ('pages', 2), ('benchmark', 4)) AS t(id, n)")
def j12(spark, d):
    return files.with_files(NAMED.frame(spark), files.present_files(spark, f"{d}/*.parquet"))


@query("t11_shards", "SELECT * FROM (VALUES ('benchmark'), ('conversations'), ('customer')) AS t(id)")
def t11(spark, d):
    return files.shard_list(files.present_files(spark, f"{d}/*.parquet"), 3)
