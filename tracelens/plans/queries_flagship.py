"""The flagship over tables: documents as posts, each with something that its author says, to findings, narrowing and the whole report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.functions import reference as R
from tracelens.functions import text as T
from tracelens.operators import activity as A
from tracelens.operators import answers, geo, photos
from tracelens.operators import findings as O
from tracelens.operators import prompts as PR
from tracelens.operators import reference_etl as E
from tracelens.plans import narrowing
from tracelens.plans.queries_persons import tag_attributes
from tracelens.plans.registry import Fixture, literal, query, read
from tracelens.plans.report import exposure_report

#: What authors say at the end of a text, and the tags of the post; most say nothing.
SAID = Fixture(
    "n long, phrase string, tags array<string>",
    [(n, *said) for n, said in enumerate([
        ("Soy una chica de ciudad. Estudiante de enfermería ♌", []), ("Tengo 24 años y vivo en León, cerca del río", ["amanecemosMadrid", "x"]), ("", []), ("Con 30 años todo cambia", ["es"]), ("Trabajo en Indra desde ayer", ["devlife"]), ("vivo con mi pareja", []),
        ("mis hijos y yo", ["viajes"]), ("Estoy en paro y antes trabajo como docente", ["nurselife", "madridismo"]), ("Soy un chico normal, vivo en Canarias", ["Spain"]), ("nada", []), ("Universidad de Sevilla, graduado en ingeniería informática", ["teachers"]), ("soy marroquí; hablo catalán", []),
        ("200 años de historia", ["espresso"]), ("vivo en Asturias, soy piscis", []), ("vivo sola", []), ("soy jubilada, nacionalidad española, hablo gallego", []), ("vivo en Cuenca, muy lejos", ["devlife"]), ("ocupada con 17 años", []),
        ("madre soltera", []), ("madrugo siempre", ["legaladvice"]), ("vivo en Barcelona con 5 años menos", []), ("soy español y busco trabajo, hablo catalán ♓", []), ("Vivo en marte, universidad de la vida", ["galicia"]), ("turno de noche en Madrid", []),
        ("vivo en Euskadi y hablo euskera", []), ("soy abogado, 130 años", ["Abogada"]), ("Soy mujer y estudio derecho", []), ("vivo en Soria", []), ("", ["otra"]), ("Trabajo para Acme de sanitario", []), ("99 años y contando", ["ES"]),
        ("De viaje por la costa", []), ("Unos días en Roma, visitando museos", ["viajes"]), ("viajes baratos", []), ("soy lesbiana y budista ☸", []), ("católica practicante, hetero", []), ("ateo y homosexual", []), ("bisexual, de vacaciones 🕉 ✝", []),
    ])],
)
PROFILES = 97


def posts_of(spark, d):
    n = F.col("doc_id") * 7 % len(SAID.rows)
    docs = read(spark, d, "documents").withColumn("n", n).join(F.broadcast(SAID.frame(spark)), "n")
    return docs.select(
        F.concat(F.lit("p"), F.pmod("doc_id", F.lit(PROFILES)).cast("string")).alias("profile_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("permalink"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(" "), "phrase").alias("text"), F.timestamp_seconds(F.lit(1735689600) + F.col("doc_id") * 5400).alias("created_utc"), F.col("lang").alias("group"), "tags",
    )


def consents_of(posts):
    return posts.select("profile_id").distinct().filter("NOT profile_id LIKE '%3'")


def re2(pattern: str) -> str:
    """The pattern for SQL, whose word ends know ASCII letters only: those beside a group are spelt out."""
    edge = r"[^\p{L}\p{N}_]"
    return literal(pattern.replace("(?iu)", "(?i)").replace(r"\b(", f"(?:^|{edge})(").replace(r")\b", f")(?:$|{edge})"))


def first_key_sql(x: str, keys) -> str:
    return f"[k FOR k IN {literal(list(keys))} IF contains({x}, k)][1]"


def ordered_sql(x: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {re2(p)}) THEN {literal(v)}" for p, v in patterns) + " END"


def captured_sql(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {re2(pattern)}, {group}), '')"


def mapped_sql(x: str, table: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in table.items()) + " END"


def plain_sql(x: str) -> str:
    return f"translate(lower({x}), {literal(T._ACCENTED)}, {literal(T._BARE)})"


POSTS_SQL = f"""posts AS (SELECT 'p' || doc_id % {PROFILES} AS profile_id, doc_id AS seq, 'd' || doc_id AS permalink, coalesce(text, '') || ' ' || phrase AS text, tags, lang AS "group", 1735689600 + doc_id * 5400 AS moment
FROM documents JOIN {SAID.sql('s')} ON n = doc_id * 7 % {len(SAID.rows)})"""
AGE_SQL = f"try_cast(coalesce({captured_sql('text', T.AGE, 1)}, {captured_sql('text', T.AGE, 2)}) AS INT)"
ZODIAC_SQL = (
    "coalesce(CASE " + " ".join(f"WHEN contains(text, '{symbol}') THEN '{sign} ({days})'" for symbol, sign, days in R.ZODIAC) + " END, "
    + mapped_sql(captured_sql("plain", T.ZODIAC_WORD), {sign: f"{sign} ({days})" for _, sign, days in R.ZODIAC}) + ")"
)
SINGLE_PROVINCE = {c: ps[0] for c, (_, ps) in R.COMMUNITIES.items() if len(ps) == 1}
DETECTORS = {
    "edad": f"CASE WHEN {AGE_SQL} BETWEEN 12 AND 100 THEN {AGE_SQL}::VARCHAR END", "sexo": ordered_sql("text", T.SEX), "estudios": first_key_sql(plain_sql(captured_sql("text", T.STUDY)), R.STUDIES), "ocupacion": first_key_sql("plain", R.OCCUPATIONS),
    "universidad": captured_sql("text", T.UNIVERSITY), "empresa": captured_sql("text", T.COMPANY), "nacionalidad": ordered_sql("text", T.NATIONALITY), "situacion_laboral": ordered_sql("text", T.EMPLOYMENT), "lengua_materna": ordered_sql("text", T.LANGUAGE),
    "signo_zodiacal": ZODIAC_SQL, "ubicacion": "CASE WHEN town IS NOT NULL THEN 'municipio|' || town WHEN province IS NOT NULL THEN 'provincia|' || province WHEN single IS NOT NULL THEN 'provincia|' || single WHEN community IS NOT NULL THEN 'comunidad_autonoma|' || community END",
}
HOME = {k: f"bool_or(regexp_matches(text, {re2(p)}))" for k, p in T.HOUSEHOLD_SIGNALS.items()}
FOUND_SQL = f"""{POSTS_SQL}, said AS (SELECT *, {plain_sql('text')} AS plain, trim({captured_sql(plain_sql('text'), T.LIVES_IN)}) AS lives FROM posts WHERE text <> ''),
placed AS (SELECT *, {first_key_sql('lives', R.MUNICIPALITIES)} AS town, {first_key_sql('lives', R.PROVINCES)} AS province, {mapped_sql(first_key_sql('lives', R.ALIASES), R.ALIASES)} AS community FROM said),
spots AS (SELECT *, {mapped_sql('community', SINGLE_PROVINCE)} AS single FROM placed),
pairs AS (SELECT profile_id, seq, permalink, unnest({literal(list(DETECTORS))}) AS field, unnest([{', '.join(DETECTORS.values())}]) AS value FROM spots),
firsts AS (SELECT profile_id, field, arg_min(value, seq) AS value, arg_min(permalink, seq) AS permalink FROM pairs WHERE value <> '' GROUP BY 1, 2),
home AS (SELECT profile_id, {', '.join(f'{v} AS {k}' for k, v in HOME.items())}, list(DISTINCT permalink ORDER BY permalink) FILTER ({' OR '.join(f'regexp_matches(text, {re2(p)})' for p in T.HOUSEHOLD_SIGNALS.values())}) AS evidence FROM said GROUP BY 1),
found AS (SELECT profile_id, CASE field WHEN 'ubicacion' THEN split_part(value, '|', 1) ELSE field END AS field, CASE field WHEN 'ubicacion' THEN split_part(value, '|', 2) ELSE value END AS value, [permalink] AS evidence FROM firsts
UNION ALL SELECT profile_id, 'tipo_hogar', CASE WHEN single_parent OR (children AND alone) THEN 'monoparental' WHEN alone THEN 'unipersonal' WHEN partner AND children THEN 'pareja_con_hijos' WHEN partner THEN 'pareja_sin_hijos' END AS value,
    list_sort(evidence) FROM home WHERE value IS NOT NULL)"""


@query("a10_declared_findings", f"WITH {FOUND_SQL} SELECT profile_id, field, value, array_to_string(list_sort(evidence), ',') AS evidence FROM found")
def a10(spark, d):
    out = O.declared(posts_of(spark, d))
    return out.select("profile_id", "field", "value", F.array_join(F.array_sort("evidence"), ",").alias("evidence"))


DIST = Fixture("f string, k string, g string, p double", [(f, k, None, float(p)) for f, t in R.SINGLE.items() for k, p in t.items()] + [("edad", str(a), None, p) for a, p in R.one_year_ages().items()] + [("lengua_materna", k, c, p) for c, t in R.LANGUAGE_BY_COMMUNITY.items() for k, p in t.items()])
COMMUNITY_OF = {p: c for c, (_, ps) in R.COMMUNITIES.items() for p in ps}
PEOPLE = Fixture("f string, k string, n long", [("municipio", k, n) for k, n in R.MUNICIPALITIES.items()] + [("provincia", k, n) for k, n in R.PROVINCES.items()] + [("comunidad_autonoma", c, sum(R.PROVINCES[p] for p in ps)) for c, (_, ps) in R.COMMUNITIES.items()])
PLACE_FIELDS = "('municipio', 'provincia', 'comunidad_autonoma')"
NARROW_SQL = f"""{FOUND_SQL}, com AS (SELECT profile_id, coalesce(max(value) FILTER (field = 'comunidad_autonoma'), {mapped_sql("max(value) FILTER (field = 'provincia')", COMMUNITY_OF)}, '') AS c FROM found GROUP BY 1),
dist AS (SELECT * FROM {DIST.sql('v')}), people AS (SELECT * FROM {PEOPLE.sql('v')}),
steps AS (SELECT profile_id, list_position({literal(list(R.STEPS))}, CASE WHEN field IN {PLACE_FIELDS} THEN 'ubicacion' ELSE field END) AS step_no, CASE WHEN field IN {PLACE_FIELDS} THEN 'ubicacion' ELSE field END AS category, value,
  CASE WHEN field IN {PLACE_FIELDS} THEN (SELECT n / {float(R.TOTAL_POPULATION)} FROM people WHERE people.f = field AND people.k = value)
  ELSE (SELECT p FROM dist WHERE dist.f = field AND dist.k = split_part(value, ' (', 1) AND dist.g IS NOT DISTINCT FROM CASE field WHEN 'lengua_materna' THEN c END) END AS p FROM found JOIN com USING (profile_id)),
r AS (SELECT *, {float(R.TOTAL_POPULATION)} * product(coalesce(p, 1)) OVER (PARTITION BY profile_id ORDER BY step_no) AS l FROM steps),
n AS (SELECT profile_id, step_no, category, value, CASE WHEN p IS NOT NULL THEN round_even(l, 0)::BIGINT END AS remaining_population,
  CASE WHEN p IS NULL THEN 'no_estimable' WHEN l >= 100000 THEN 'bajo' WHEN l >= 1000 THEN 'medio' WHEN l >= 20 THEN 'alto' ELSE 'critico' END AS risk_level, round_even((1 - p) * 100, 1)::DOUBLE AS reduction_percent FROM r)"""


@query("a12_narrowing", f"WITH {NARROW_SQL} SELECT * FROM n")
def a12(spark, d):
    return narrowing.narrowed(O.declared(posts_of(spark, d))).select("profile_id", "step_no", "category", "value", "remaining_population", "risk_level", "reduction_percent")


@query("a13_final_population", f"WITH {NARROW_SQL} SELECT profile_id, arg_max(remaining_population, step_no) FILTER (remaining_population IS NOT NULL) AS final_population, count(remaining_population) AS estimated_steps FROM n GROUP BY 1")
def a13(spark, d):
    return narrowing.final_population(narrowing.narrowed(O.declared(posts_of(spark, d))))


def tagged_sql(name: str, category: str, keys, exact, base: float, most: float) -> str:
    hit = f"[t FOR t IN CASE WHEN len(tags) > 0 THEN [lower(t) FOR t IN tags] ELSE [lower(\"group\")] END IF t IN {tuple(exact)} OR len([k FOR k IN {literal(list(keys))} IF contains(t, k)]) > 0][1]"
    return f"""{name}_hits AS (SELECT profile_id, seq, permalink, {hit} AS tag FROM posts),
{name}_best AS (SELECT profile_id, tag, count(*) AS n FROM {name}_hits WHERE tag IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY count(*) DESC, min(seq)) = 1),
{name}_seen AS (SELECT profile_id, string_agg(permalink, ',' ORDER BY seq) AS evidence FROM (SELECT * FROM {name}_hits WHERE tag IS NOT NULL QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY seq) <= {A.EVIDENCE}) GROUP BY 1),
{name} AS (SELECT profile_id, '{category}' AS category, tag AS value, round_even(least({base} + 0.05 * n, {most}), 2)::DOUBLE AS confidence, evidence FROM {name}_best JOIN {name}_seen USING (profile_id))"""


TAGS_SQL = f"""{tagged_sql('spot', 'ubicacion', A.PLACE_TAGS, A.PLACE_EXACT, 0.4, 0.9)}, {tagged_sql('work', 'ocupacion', A.WORK_TAGS, A.WORK_EXACT, 0.3, 0.8)},
daily AS (SELECT profile_id, 'rutina' AS category, NULL AS value, 0.6::DOUBLE AS confidence, string_agg(permalink, ',' ORDER BY seq) AS evidence FROM (SELECT * FROM posts WHERE regexp_matches(text, {re2(T.ROUTINE)}) QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY seq) <= {A.EVIDENCE}) GROUP BY 1),
hints AS (SELECT * FROM spot UNION ALL SELECT * FROM work UNION ALL SELECT * FROM daily)"""


@query("u08_tag_attributes", f"WITH {POSTS_SQL}, {TAGS_SQL} SELECT * FROM hints")
def u08(spark, d):
    return tag_attributes(posts_of(spark, d)).select("profile_id", "category", "value", "confidence", F.array_join("evidence", ",").alias("evidence"))


WORDS = r"[\p{L}\p{N}_]"
REPORT_SQL = (
    NARROW_SQL.replace(f"ON n = doc_id * 7 % {len(SAID.rows)})", f"ON n = doc_id * 7 % {len(SAID.rows)} WHERE doc_id % {PROFILES} % 10 <> 3)")
    + f""", {TAGS_SQL},
counted AS (SELECT profile_id, count(*) AS n_posts FROM posts GROUP BY 1),
wordy AS (SELECT profile_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM posts), rich AS (SELECT profile_id, count(DISTINCT w)::DOUBLE / count(*) AS richness FROM wordy GROUP BY 1),
hour_n AS (SELECT profile_id, moment // 3600 % 24 AS hour, count(*) AS n FROM posts GROUP BY 1, 2), hourly AS (SELECT c.profile_id, h.hour, coalesce(n, 0)::DOUBLE / n_posts AS share FROM counted c CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN hour_n x ON x.profile_id = c.profile_id AND x.hour = h.hour),
peaks AS (SELECT profile_id, hour AS peak_hour, share AS peak_share FROM hourly QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY share DESC, hour) = 1),
lw AS (SELECT profile_id, seq, unnest(regexp_extract_all(lower(text), '{WORDS}+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '{WORDS}+'), 1) AS i FROM posts),
tongue AS (SELECT profile_id, CASE WHEN count(DISTINCT CASE WHEN w IN {T.SPANISH_MARKERS} THEN w END) >= 3 THEN 'es' ELSE 'en' END AS language FROM (SELECT * FROM lw QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY seq, i) <= 300) GROUP BY 1),
grp AS (SELECT profile_id, "group" AS g, count(*) AS c, row_number() OVER (PARTITION BY profile_id ORDER BY count(*) DESC, min(seq)) AS rank FROM posts GROUP BY 1, 2),
kp AS (SELECT profile_id, seq, text FROM posts WHERE length(text) > 20), ke AS (SELECT profile_id, count(*) AS docs FROM kp GROUP BY 1 HAVING count(*) >= 3),
kw AS (SELECT profile_id, seq, docs, regexp_extract_all(lower(text), '{WORDS}{{2,}}') AS w FROM kp JOIN ke USING (profile_id)),
kg AS (SELECT profile_id, seq, docs, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] ELSE [] END)) AS term FROM kw),
ktf AS (SELECT profile_id, seq, docs, term, count(*) AS tf FROM kg GROUP BY ALL),
kk AS (SELECT profile_id, term, docs, sum(tf) AS n, count(*) AS df FROM ktf GROUP BY profile_id, term, docs QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY sum(tf) DESC, term) <= 500),
kx AS (SELECT ktf.profile_id, seq, ktf.term, tf * (ln((1 + kk.docs) / (1 + df)) + 1) AS x FROM ktf JOIN kk ON ktf.profile_id = kk.profile_id AND ktf.term = kk.term),
ks AS (SELECT profile_id, term, sum(x / nrm) AS score FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY profile_id, seq)) AS nrm FROM kx) GROUP BY 1, 2),
keyed AS (SELECT profile_id, term, score, row_number() OVER (PARTITION BY profile_id ORDER BY round(score, 9) DESC, term) AS rank FROM ks QUALIFY rank <= 20),
att AS (SELECT profile_id, coalesce(max(confidence) FILTER (category = 'ubicacion'), 0) AS geo, sum(confidence) AS s, bool_or(category = 'ocupacion') AS works FROM hints GROUP BY 1),
sc AS (SELECT c.profile_id, least(coalesce(geo, 0) * 100, 100) AS g, least(coalesce(s, 0) / 6 * 100, 100) AS i, peak_share, coalesce(works, false) AS works,
  least((least(n_posts / 200.0::DOUBLE, 1) * 0.4::DOUBLE + CASE WHEN richness > 0 THEN greatest(0, least(1, 1 - abs(richness - 0.45::DOUBLE) / 0.45::DOUBLE)) ELSE 0 END * 0.3::DOUBLE + coalesce(peak_share, 0) * 0.3::DOUBLE) * 100, 100) AS e
  FROM counted c LEFT JOIN rich USING (profile_id) LEFT JOIN peaks USING (profile_id) LEFT JOIN att USING (profile_id)),
rules AS (SELECT profile_id, array_to_string([x FOR x IN [CASE WHEN g > 30 THEN 'avoid_place_tags' END, CASE WHEN i > 40 THEN 'review_history' END, CASE WHEN e > 50 THEN 'vary_activity' END, CASE WHEN peak_share > 0.25 THEN 'peak_hour' END, CASE WHEN works THEN 'professional_groups' END] IF x IS NOT NULL], ',') AS codes FROM sc)
SELECT profile_id, n_posts, round(richness, 9) AS richness, peak_hour::INT AS peak_hour, language,
(SELECT string_agg(hour || '=' || round(share * 1000000)::BIGINT, ',' ORDER BY hour) FROM hourly h WHERE h.profile_id = c.profile_id) AS hours,
(SELECT string_agg(g || '=' || c, ',' ORDER BY rank) FROM grp WHERE grp.profile_id = c.profile_id) AS top_groups,
(SELECT string_agg(term || '=' || round(score * 10000)::BIGINT, ',' ORDER BY rank) FROM keyed k WHERE k.profile_id = c.profile_id) AS keywords,
(SELECT string_agg(category || '=' || coalesce(value, '') || ':' || round(confidence * 100)::BIGINT || ':' || evidence, ';' ORDER BY category) FROM hints h WHERE h.profile_id = c.profile_id) AS attributes,
(SELECT string_agg(step_no || ' ' || category || '=' || value || ':' || coalesce(remaining_population::VARCHAR, '') || ':' || risk_level || ':' || coalesce(round(reduction_percent * 10)::BIGINT::VARCHAR, ''), ';' ORDER BY step_no) FROM n WHERE n.profile_id = c.profile_id) AS narrowing,
(SELECT arg_max(remaining_population, step_no) FILTER (remaining_population IS NOT NULL) FROM n WHERE n.profile_id = c.profile_id) AS final_population,
round_even(g * 0.35::DOUBLE + i * 0.45::DOUBLE + e * 0.2::DOUBLE, 1)::DOUBLE AS overall, round_even(g, 1)::DOUBLE AS geolocation, round_even(i, 1)::DOUBLE AS data, round_even(e, 1)::DOUBLE AS ease, CASE WHEN codes = '' THEN 'low_exposure' ELSE codes END AS recommendations
FROM counted c LEFT JOIN rich USING (profile_id) LEFT JOIN peaks USING (profile_id) LEFT JOIN tongue USING (profile_id) LEFT JOIN sc USING (profile_id) LEFT JOIN rules USING (profile_id)"""
)


def listed(column: str, text, by: str = ","):
    return F.array_join(F.transform(column, text), by).alias(column)


def whole(x, scale: int = 1):
    return F.round(x * scale).cast("long").cast("string")


@query("d08_report_whole", f"WITH {REPORT_SQL}")
def d08_whole(spark, d):
    """Every column of the report of every profile that has agreed; lists are written out as text."""
    posts = posts_of(spark, d)
    r = exposure_report(posts, consents_of(posts))
    none = F.lit("")

    def or_null(column: str, c):
        return F.when(F.col(column).isNotNull(), c).alias(column)

    return r.select(
        "profile_id", "n_posts", F.round("richness", 9).alias("richness"), "peak_hour", "language", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.concat_ws("=", h, whole(F.element_at("hours", h), 1_000_000))), ",").alias("hours"),
        listed("top_groups", lambda g: F.concat_ws("=", g["group"], g["posts"])), listed("keywords", lambda k: F.concat_ws("=", k["term"], whole(k["score"], 10_000))),
        or_null("attributes", listed("attributes", lambda a: F.concat(a["category"], F.lit("="), F.coalesce(a["value"], none), F.lit(":"), whole(a["confidence"], 100), F.lit(":"), F.array_join(a["evidence"], ",")), ";")),
        or_null("narrowing", listed("narrowing", lambda s: F.concat(s["step_no"].cast("string"), F.lit(" "), s["category"], F.lit("="), s["value"], F.lit(":"), F.coalesce(s["remaining_population"].cast("string"), none), F.lit(":"), s["risk_level"], F.lit(":"), F.coalesce(whole(s["reduction_percent"], 10), none)), ";")),
        "final_population", F.col("score.overall").alias("overall"), F.col("score.geolocation").alias("geolocation"), F.col("score.data").alias("data"), F.col("score.ease").alias("ease"), F.array_join("recommendations", ",").alias("recommendations"),
    )


# ---- what single operators find in the same posts


def said_by(text: str, sql: str) -> str:
    return f"WITH {FOUND_SQL.split(', pairs AS')[0]} SELECT seq, {sql} FROM spots"


@query("f07_location", said_by("text", "CASE WHEN town IS NOT NULL THEN 'municipio' WHEN province IS NOT NULL OR single IS NOT NULL THEN 'provincia' WHEN community IS NOT NULL THEN 'comunidad_autonoma' END AS level, coalesce(town, province, single, community) AS key"))
def f07(spark, d):
    return posts_of(spark, d).withColumn("l", O.location(F.col("text"))).select("seq", "l.level", "l.key")


WORD = captured_sql("plain", T.RELIGION_WORD)
RELIGION_SQL = "coalesce(CASE " + " ".join(f"WHEN contains(text, '{s}') THEN '{v}'" for s, v in T.RELIGION_SYMBOLS) + " END, " + mapped_sql(WORD, dict(T.RELIGION_WORDS)) + ")"
ORIENTATION_SQL = "CASE " + " ".join(f"WHEN contains(o, '{k}') THEN '{v}'" for k, v in T.ORIENTATION_KEYS) + " END"


def special_of(spark, d, field):
    return O.declared(posts_of(spark, d), special=True, only=(field,)).select("profile_id", "value", F.col("evidence")[0].alias("permalink"))


@query("f11_religion", f"WITH {FOUND_SQL}, w AS (SELECT profile_id, seq, permalink, {RELIGION_SQL} AS v FROM said) SELECT profile_id, arg_min(v, seq) AS value, arg_min(permalink, seq) AS permalink FROM w WHERE v IS NOT NULL GROUP BY 1")
def f11(spark, d):
    return special_of(spark, d, "religion")


@query("f09_orientation", f"WITH {FOUND_SQL}, w AS (SELECT profile_id, seq, permalink, {ORIENTATION_SQL} AS v FROM (SELECT *, lower(regexp_extract(text, {re2(T.ORIENTATION)})) AS o FROM said)) SELECT profile_id, arg_min(v, seq) AS value, arg_min(permalink, seq) AS permalink FROM w WHERE v IS NOT NULL GROUP BY 1")
def f09(spark, d):
    return special_of(spark, d, "orientacion_sexual")


@query("f12_travel_posts", f"WITH {POSTS_SQL} SELECT profile_id, permalink FROM posts WHERE regexp_matches(text, {re2(T.TRAVEL)})")
def f12(spark, d):
    return O.travel_posts(posts_of(spark, d))


@query("f01_strip_accents", "SELECT doc_id, md5(lower(strip_accents(text))) AS plain FROM documents WHERE text IS NOT NULL")
def f01(spark, d):
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(T.plain(F.col("text"))).alias("plain"))


@query(
    "f08_household_table",
    """SELECT user_id, day, CASE WHEN s OR (c AND a) THEN 'monoparental' WHEN a THEN 'unipersonal' WHEN p AND c THEN 'pareja_con_hijos' WHEN p THEN 'pareja_sin_hijos' END AS household
    FROM (SELECT user_id, ts::DATE::VARCHAR AS day, bool_or(event_type = 'view') AS p, bool_or(event_type = 'click') AS a, bool_or(event_type = 'purchase') AS c, bool_or(event_type = 'error') AS s FROM events GROUP BY 1, 2)""",
)
def f08(spark, d):
    e = read(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day"))
    bits = e.agg(*(F.bool_or(F.col("event_type") == kind).alias(n) for n, kind in (("p", "view"), ("a", "click"), ("c", "purchase"), ("s", "error"))))
    return bits.select("user_id", "day", O.household(F.col("p"), F.col("a"), F.col("c"), F.col("s")).alias("household"))


# ---- shares of the population


def findings_of(df, **fields):
    """Findings of one value a field; null values are none."""
    each = df.select("profile_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields.items()))).alias("f")).filter("f.value IS NOT NULL")
    return each.select("profile_id", "f.field", "f.value", F.lit("texto").alias("source"), F.lit(None).cast("double").alias("confidence"), F.array().cast("array<string>").alias("evidence"))


def pick(options: list, at):
    return F.element_at(F.array(*(F.lit(o) for o in options)), (at % len(options) + 1).cast("int"))


def pick_sql(options: list, at: str) -> str:
    return f"{literal(options)}[(({at}) % {len(options)} + 1)::INT]"


SEXES, MARITAL = ["mujer", "hombre", None, "otro"], ["soltero", "viudo", "casado", "raro", "divorciado", "con_pareja"]


@query(
    "j02_marital_given_sex",
    f"""WITH m AS (SELECT * FROM {Fixture("g string, k string, p double", [(s, k, p) for s, t in R.MARITAL_BY_SEX.items() for k, p in t.items()] + [(None, k, p) for k, p in R.MARITAL.items()]).sql("v")}),
    c AS (SELECT c_custkey AS profile_id, {pick_sql(SEXES, 'c_custkey')} AS sex, {pick_sql(MARITAL, 'c_nationkey')} AS estado FROM customer)
    SELECT profile_id, p::DOUBLE AS share FROM c LEFT JOIN m ON k = estado AND g IS NOT DISTINCT FROM CASE WHEN sex IN ('hombre', 'mujer') THEN sex END""",
)
def j02(spark, d):
    c = read(spark, d, "customer").withColumn("profile_id", F.col("c_custkey"))
    f = findings_of(c, sexo=pick(SEXES, F.col("c_custkey")), estado_civil=pick(MARITAL, F.col("c_nationkey")))
    return narrowing.shares(f).filter("category = 'estado_civil'").select("profile_id", "share")


@query(
    "d01_age_shares",
    f"""WITH b AS (SELECT * FROM {Fixture("lo long, hi long, p double", [(*((85, 100) if k == "85+" else map(int, k.split("-"))), p) for k, p in R.AGE_BANDS.items()]).sql("v")})
    SELECT c_custkey AS profile_id, c_custkey * 3 % 120 AS age, round(p / (hi - lo + 1), 10) AS share FROM customer LEFT JOIN b ON c_custkey * 3 % 120 BETWEEN lo AND hi""",
)
def d01(spark, d):
    c = read(spark, d, "customer").withColumn("profile_id", F.col("c_custkey"))
    s = narrowing.shares(findings_of(c, edad=(F.col("c_custkey") * 3 % 120).cast("string")))
    return s.select("profile_id", F.col("value").cast("long").alias("age"), F.round("share", 10).alias("share"))


NAMES = ["Sevilla", "  CATALONIA ", "País Vasco", "Principado de Asturias", "desconocido", "Canary Islands", "León", "La Rioja", "MADRID", "region of Valencia", "Melilla ", "Lérida", "castile-la mancha", "Marte"]
NAMED_SQL = f"n AS (SELECT s_suppkey AS id, {pick_sql(NAMES, 's_suppkey')} AS raw, trim({plain_sql(pick_sql(NAMES, 's_suppkey'))}) AS name FROM supplier), a AS (SELECT *, CASE WHEN name IN {tuple(R.PROVINCES)} THEN name END AS p, {mapped_sql('name', R.ALIASES)} AS c FROM n)"


def regions_of(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), pick(NAMES, F.col("s_suppkey")).alias("raw"))
    return geo.resolved(s, R.places(spark), R.aliases(spark), R.populations(spark).filter("level = 'provincia'"))


@query("j06_resolve_region", f"WITH {NAMED_SQL}, s AS (SELECT *, {mapped_sql('c', SINGLE_PROVINCE)} AS single FROM a) SELECT id, raw, CASE WHEN coalesce(p, single) IS NOT NULL THEN 'provincia' WHEN c IS NOT NULL THEN 'comunidad_autonoma' END AS level, coalesce(p, single, c) AS key FROM s")
def j06(spark, d):
    return regions_of(spark, d).select("id", "raw", "level", "key")


@query("j18_alias_lookup", f"WITH {NAMED_SQL} SELECT id, raw, c AS community FROM a")
def j18(spark, d):
    return regions_of(spark, d).select("id", "raw", "community")


# ---- where the photos of a profile agree

SPOTS = ["sevilla", "madrid", "canarias", "las palmas", "santa cruz de tenerife", "asturias", "principado de asturias", "desconocido", "cadiz", "andalucia"]
ESTIMATES_SQL = f"""e AS (SELECT 'u' || vec_id % 23 AS profile_id, vec_id AS seq, 'q' || vec_id // 2 AS permalink, {pick_sql(SPOTS, 'label + vec_id // 100')} AS region, 0.5 + vec_id * 13 % 50 / 100.0::DOUBLE AS confidence FROM embeddings
WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND vec_id // 2 % 5 <> 1),
a AS MATERIALIZED (SELECT *, {mapped_sql('region', R.ALIASES)} AS c FROM e), p AS MATERIALIZED (SELECT *, CASE WHEN region IN {tuple(R.PROVINCES)} THEN region ELSE {mapped_sql('c', SINGLE_PROVINCE)} END AS province FROM a),
q AS MATERIALIZED (SELECT *, coalesce({mapped_sql('province', COMMUNITY_OF)}, c) AS community FROM p),
g AS (SELECT profile_id, community, count(*) FILTER (confidence > 0.8) AS high, count(*) AS n_photos, avg(confidence) AS confidence, count(DISTINCT province) AS n, min(province) AS one, min(seq) AS first, string_agg(permalink, ',' ORDER BY seq) AS evidence
  FROM q WHERE community IS NOT NULL AND confidence > 0.6 GROUP BY 1, 2)"""


@query(
    "d04_home_region",
    f"""WITH {ESTIMATES_SQL} SELECT profile_id, CASE WHEN n = 1 THEN 'provincia' ELSE 'comunidad_autonoma' END AS level, CASE WHEN n = 1 THEN one ELSE community END AS key, n_photos, round(confidence, 6) AS confidence, evidence FROM g
    WHERE high >= 2 OR n_photos >= 4 QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY n_photos DESC, round(confidence, 9) DESC, first) = 1""",
)
def d04(spark, d):
    v = F.col("vec_id")
    e = read(spark, d, "embeddings").select(
        F.concat(F.lit("u"), (v % 23).cast("string")).alias("profile_id"), v.alias("seq"), F.concat(F.lit("q"), F.expr("vec_id div 2").cast("string")).alias("permalink"), pick(SPOTS, F.col("label") + F.expr("vec_id div 100")).alias("region"),
        (F.lit(0.5) + v * 13 % 50 / 100).alias("confidence"), (v % 7 != 0).alias("representative"), (v % 11 == 0).alias("is_avatar"),
    )
    travel = e.filter("seq div 2 % 5 = 1").select("profile_id", "permalink").distinct()
    out = geo.consensus(e, R.places(spark), R.aliases(spark), R.populations(spark).filter("level = 'provincia'"), travel)
    return out.select("profile_id", "level", "key", "n_photos", F.round("confidence", 6).alias("confidence"), F.array_join("evidence", ",").alias("evidence"))


@query("f19_dms_to_decimal", "SELECT c_custkey, round((c_custkey % 90 + c_custkey % 60 / 60.0::DOUBLE + abs(c_acctbal) % 60 / 3600) * CASE WHEN c_custkey % 4 < 2 THEN -1 ELSE 1 END, 8) + 0 AS degrees FROM customer")
def f19(spark, d):
    k = F.col("c_custkey")
    degrees = geo.decimal_degrees((k % 90).cast("double"), (k % 60).cast("double"), F.abs("c_acctbal") % 60, pick(["S", "W", "N", "E"], k))
    return read(spark, d, "customer").select("c_custkey", (F.round(degrees, 8) + 0).alias("degrees"))


# ---- photos and answers


@query(
    "f15_photo_links",
    """WITH c AS (SELECT 'https://x/' || conv_id || '/' || turn || CASE WHEN turn % 2 = 1 THEN '?a=1' ELSE '' END AS permalink, conv_id, turn, (conv_id + turn) % 4 AS n FROM conversations WHERE turn % 5 < 3)
    SELECT permalink, i::INT AS photo_index, n::INT AS photo_total, CASE WHEN n > 1 THEN permalink || CASE WHEN contains(permalink, '?') THEN '&' ELSE '?' END || 'img_index=' || i ELSE permalink END AS photo_link, 'u' || i AS url FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM c)""",
)
def f15(spark, d):
    c = read(spark, d, "conversations")
    link = F.concat(F.lit("https://x/"), "conv_id", F.lit("/"), "turn", F.when(F.col("turn") % 2 == 1, "?a=1").otherwise(""))
    urls = F.filter(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i <= (F.col("conv_id") + F.col("turn")) % 4, F.concat(F.lit("u"), i.cast("string")))), lambda u: u.isNotNull())
    return photos.photo_links(c.select(link.alias("permalink"), pick(["image", "carousel_album", "image", "video", "post"], F.col("turn")).alias("type"), urls.alias("media_urls")))


PEOPLE_SEEN, HOBBIES, COUPLES, SIGNS_SEEN = ["una", "varias", "ninguna", ""], ["ciclismo", "Cocina.", "N/A", "ninguna", " senderismo "], ["no", "sí", ""], ["ninguno", "Bar Pepe", "None", "SALIDA."]


@query(
    "f27_photo_answers",
    f"""WITH a AS (SELECT c_custkey AS photo, c_custkey % 9 = 8 AS other, {pick_sql(PEOPLE_SEEN, 'c_custkey')} AS p, {pick_sql(HOBBIES, 'c_nationkey')} AS h, {pick_sql(COUPLES, 'c_custkey')} AS c, {pick_sql(SIGNS_SEEN, 'c_custkey // 2')} AS v FROM customer),
    t AS (SELECT photo, CASE WHEN NOT other THEN nullif(p, '') END AS persons, CASE WHEN NOT other AND lower(h) NOT IN ('n/a', 'ninguna') THEN rtrim(lower(trim(h)), '.') END AS hobby, CASE WHEN NOT other THEN nullif(c, '') END AS couple,
    CASE WHEN NOT other AND lower(v) NOT IN ('ninguno', 'none') THEN rtrim(lower(v), '.') END AS visible_text FROM a) SELECT *, CASE WHEN persons IN ('ninguna', 'una') THEN hobby END AS inferred_hobby FROM t""",
)
def f27(spark, d):
    k = F.col("c_custkey")
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), v) for name, v in (("PERSONAS", pick(PEOPLE_SEEN, k)), ("aficion", pick(HOBBIES, F.col("c_nationkey"))), ("PAREJA", pick(COUPLES, k)), ("TEXTO_VISIBLE", pick(SIGNS_SEEN, F.expr("c_custkey div 2"))))))
    return answers.from_photos(read(spark, d, "customer").select(k.alias("photo"), F.when(k % 9 == 8, "sin formato").otherwise(lines).alias("answer")))


SEX_SAID, BANDS_SAID, JOBS_SAID = ["mujer", "otro", "hombre", ""], ["30-34", "85+", "31-33", "0-4"], ["activo", "parado", "rico"]


def model_answers(spark, d):
    """An answer a customer; every 13th isn't JSON."""
    k = F.col("c_custkey")
    age = F.when(k % 7 == 0, F.lit("true")).otherwise((k % 130).cast("string"))
    soft = F.concat(F.lit('[{"categoria": "aficion", "valor": " '), "c_mktsegment", F.lit(' ", "confianza": '), (k % 30 / 20).cast("string"), F.lit('}, {"categoria": "x", "valor": "", "confianza": 2}, {"categoria": "y", "valor": "v'), "c_nationkey", F.lit('"}]'))
    body = F.concat(F.lit('{"sexo": "'), pick(SEX_SAID, k), F.lit('", "edad": '), age, F.lit(', "situacion_laboral": "'), pick(JOBS_SAID, F.col("c_nationkey")), F.lit('", "edad_rango": {"valor": "'), pick(BANDS_SAID, k), F.lit('", "confianza": '), (k % 10 / 10).cast("string"), F.lit('}, "inferencias_blandas": '), soft, F.lit("}"))
    return read(spark, d, "customer").select(k.alias("profile_id"), F.when(k % 13 == 0, "not json").otherwise(body).alias("json"))


@query(
    "f29_model_answers",
    f"""WITH c AS (SELECT c_custkey AS profile_id, {pick_sql(SEX_SAID, 'c_custkey')} AS s, {pick_sql(BANDS_SAID, 'c_custkey')} AS b, {pick_sql(JOBS_SAID, 'c_nationkey')} AS j FROM customer WHERE c_custkey % 13 <> 0)
    SELECT profile_id, 'sexo' AS field, s AS value, NULL::DOUBLE AS confidence FROM c WHERE s IN ('mujer', 'hombre') UNION ALL SELECT profile_id, 'situacion_laboral', j, NULL FROM c WHERE j IN ('activo', 'parado')
    UNION ALL SELECT profile_id, 'edad', (profile_id % 130)::VARCHAR, NULL FROM c WHERE profile_id % 7 <> 0 AND profile_id % 130 BETWEEN 12 AND 100 UNION ALL SELECT profile_id, 'edad_rango', b, profile_id % 10 / 10.0::DOUBLE FROM c WHERE b <> '31-33' AND profile_id % 10 >= 7""",
)
def f29(spark, d):
    return answers.from_model(model_answers(spark, d)).select("profile_id", "field", "value", "confidence")


@query(
    "t06_soft_inferences",
    """SELECT c_custkey AS profile_id, 'aficion' AS category, c_mktsegment AS value, least(1, c_custkey % 30 / 20.0::DOUBLE) AS confidence FROM customer WHERE c_custkey % 13 <> 0
    UNION ALL SELECT c_custkey, 'y', 'v' || c_nationkey, 0.5 FROM customer WHERE c_custkey % 13 <> 0""",
)
def t06(spark, d):
    return answers.soft_inferences(model_answers(spark, d))


# ---- reference data


@query(
    "d05_stale_tables",
    """WITH v AS (SELECT 'c' || c_custkey AS name, max(o_orderdate)::DATE AS verified, any_value(CASE WHEN c_nationkey % 2 = 0 THEN 400 ELSE 100 END) AS days FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), t AS (SELECT max(o_orderdate)::DATE AS today FROM orders)
    SELECT name, verified::VARCHAR AS verified, date_diff('day', verified, today) AS age FROM v, t WHERE verified IS NOT NULL AND date_diff('day', verified, today) > days""",
)
def d05(spark, d):
    """Customers as tables, checked with each order."""
    o = read(spark, d, "orders")
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.max("o_orderdate")).alias("verified"))
    tables = read(spark, d, "customer").join(last, "c_custkey", "left").withColumn("name", F.concat(F.lit("c"), "c_custkey"))
    today = o.agg(F.to_date(F.max("o_orderdate"))).first()[0]
    return E.stale(tables, F.lit(today), F.when(F.col("c_nationkey") % 2 == 0, 400).otherwise(100)).withColumn("verified", F.col("verified").cast("string"))


def series_of(spark, d):
    """Official series, an answer (JSON) a customer's nation: spending by year, in all and by status."""
    spent = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("v"))
    both = spent.unionByName(spent.groupBy("c_nationkey", "y").agg(F.sum("v").alias("v")).withColumn("s", F.lit("Total")))
    province = F.concat(F.lit("N"), "c_nationkey")
    data = F.sort_array(F.collect_list(F.struct(F.col("y").alias("Anyo"), F.col("v").cast("double").alias("Valor"), (F.col("y") * 10).alias("Fecha"), F.lit(1).alias("FK_Periodo"))), asc=False)
    each = both.groupBy("c_nationkey", "s").agg(data.alias("Data")).withColumn("Nombre", F.concat("s", F.lit(". "), province))
    meta = F.array(F.struct(F.lit("Provincias").alias("T3_Variable"), province.alias("Nombre")), F.struct(F.lit("Sexo").alias("T3_Variable"), F.col("s").alias("Nombre")))
    each = each.withColumn("MetaData", F.when(F.col("c_nationkey") % 5 == 4, F.array_append(meta, F.struct(F.lit("Edad").alias("T3_Variable"), F.lit("x").alias("Nombre")))).otherwise(meta))
    return each.groupBy("c_nationkey").agg(F.to_json(F.collect_list(F.struct("Nombre", "MetaData", "Data"))).alias("json"))


SERIES_SQL = "WITH o AS (SELECT c_nationkey AS n, year(o_orderdate) AS y, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey), b AS (SELECT n, y, s, count(*)::DOUBLE AS v FROM o GROUP BY ALL UNION ALL SELECT n, y, 'Total', count(*) FROM o GROUP BY ALL)"


@query("s13_series_latest", SERIES_SQL + " SELECT s || '. N' || n AS name, arg_max(v, y) AS value FROM b GROUP BY n, s")
def s13(spark, d):
    s = E.long_series(series_of(spark, d))
    return E.latest(s, "name", "value", F.coalesce("fecha", F.col("anyo") * 100 + F.col("periodo")))


@query("g08_dimension_filter", SERIES_SQL + " SELECT 'N' || n AS province, arg_max(v, y) AS value FROM b WHERE s = 'Total' AND n % 5 <> 4 GROUP BY n")
def g08(spark, d):
    s = E.long_series(series_of(spark, d)).filter("variables['Sexo'] = 'Total' AND size(variables) = 2")
    return E.latest(s.withColumn("province", F.col("variables")["Provincias"]), "province", "value", "fecha")


# ---- models and pages


@query(
    "f30_prompts",
    f"""WITH {POSTS_SQL}, s AS (SELECT profile_id, seq, '[' || permalink || '] ' || substr(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), 1, 600) AS l FROM posts WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) <> ''),
    t AS (SELECT profile_id, string_agg(l, chr(10) ORDER BY seq) AS said FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY seq) <= 500) GROUP BY 1), c AS (SELECT 'p' || c_custkey AS profile_id, c_name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS full_name, CASE WHEN c_custkey % 4 = 0 THEN ' soy ' || c_nationkey ELSE '' END AS bio FROM customer)
    SELECT profile_id, md5('Nombre de usuario/handle: ' || c_name || coalesce(chr(10) || 'Nombre público mostrado por la cuenta: ' || full_name, '') || CASE WHEN bio <> '' THEN chr(10) || 'Biografía: ' || trim(bio) ELSE '' END || coalesce(chr(10) || chr(10) || 'Publicaciones:' || chr(10) || said, '')) AS prompt FROM c LEFT JOIN t USING (profile_id)""",
)
def f30(spark, d):
    k = F.col("c_custkey")
    profiles = read(spark, d, "customer").select(F.concat(F.lit("p"), k).alias("profile_id"), F.col("c_name").alias("username"), F.when(k % 3 > 0, F.col("c_mktsegment")).alias("full_name"), F.when(k % 4 == 0, F.concat(F.lit(" soy "), "c_nationkey")).otherwise("").alias("bio"))
    return PR.prompts(profiles, posts_of(spark, d)).select("profile_id", F.md5("prompt").alias("prompt"))


@query(
    "d09_summaries",
    """SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS verdict,
    CASE WHEN c_custkey % 11 = 0 OR c_custkey % 5 = 0 THEN '' ELSE c_name || '|n' || c_nationkey END AS conclusions FROM customer""",
)
def d09(spark, d):
    """Answers a customer: every 11th isn't JSON, every 7th has a number for its verdict, every 5th no list; lists hold blanks, numbers and nulls."""
    k = F.col("c_custkey")
    verdict = F.when(k % 7 == 0, "17").otherwise(F.concat(F.lit('" '), "c_mktsegment", F.lit(' "')))
    listed = F.when(k % 5 == 0, '"none"').otherwise(F.concat(F.lit('["'), "c_name", F.lit(' ", 5, "  ", null, {"a": 1}, "n'), "c_nationkey", F.lit('"]')))
    body = F.when(k % 11 == 0, "no answer").otherwise(F.concat(F.lit('{"veredicto": '), verdict, F.lit(', "conclusiones": '), listed, F.lit("}")))
    return PR.summaries(read(spark, d, "customer").select(k.alias("profile_id"), body.alias("json"))).select("profile_id", "verdict", F.array_join("conclusions", "|").alias("conclusions"))


@query("d13_answer_language", "SELECT doc_id, CASE WHEN lang IN ('es', 'en') THEN lang ELSE 'es' END AS lang FROM documents")
def d13(spark, d):
    return read(spark, d, "documents").select("doc_id", PR.language_of(F.col("lang")).alias("lang"))


@query("g17_answers_in_time", "SELECT vec_id AS photo, CASE WHEN vec_id % 3 = 0 THEN 'h' || label END AS hobby, NULL::VARCHAR AS never FROM embeddings")
def g17(spark, d):
    """Two models, one that answers for every third photo and one that is switched off."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("photo"), "label")
    said = e.filter("photo % 3 = 0").select("photo", F.concat(F.lit("h"), "label").alias("hobby"))
    out = PR.with_answers(e.select("photo"), said)
    return PR.with_answers(out, said.withColumnRenamed("hobby", "never"), enabled=False)


@query("p04_badges", f"WITH {NARROW_SQL} SELECT profile_id, category, CASE WHEN reduction_percent IS NULL THEN '' ELSE '-' || reduction_percent || '%' END || CASE WHEN step_no % 2 = 0 THEN CASE WHEN reduction_percent IS NULL THEN '' ELSE ' ' END || '~' || floor(step_no / 16.0 * 100 + 0.5)::INT || '%' ELSE '' END AS badges FROM n")
def p04(spark, d):
    """Badges of the steps of narrowing; every second has a confidence."""
    n = narrowing.narrowed(O.declared(posts_of(spark, d)))
    confidence = F.when(F.col("step_no") % 2 == 0, F.col("step_no") / 16)
    return n.select("profile_id", "category", F.array_join(PR.badges(F.col("reduction_percent"), confidence), " ").alias("badges"))


@query(
    "p05_map_message",
    """SELECT o_custkey AS profile_id, CASE WHEN o_custkey % 3 = 0 THEN 'redditNoPhotos' WHEN o_custkey % 7 = 0 THEN 'indexUnavailable' WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN 'noPhotos' WHEN count(*) FILTER (o_orderstatus = 'P') = 0 THEN 'noRepresentative' END AS message FROM orders GROUP BY 1""",
)
def p05(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("profile_id")).agg(F.count_if(F.col("o_orderstatus") != "F").alias("points"), F.count_if(F.col("o_orderstatus") == "P").alias("good"))
    k = F.col("profile_id")
    return o.select("profile_id", PR.map_message(F.when(k % 3 == 0, "reddit").otherwise("instagram"), k % 7 != 0, F.col("points"), F.col("good")).alias("message"))
