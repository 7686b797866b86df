"""Declared attributes: from posts to long-form findings (profile_id, field, value, source, confidence, evidence).

Every expression is a built-in; one pass over the posts gives all fields. Order is data: within a profile the post with
the smallest seq that says something about a field wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.functions import reference as R
from tracelens.functions import text as T
from tracelens.operators.shared import small

SCHEMA = "profile_id string, field string, value string, source string, confidence double, evidence array<string>"


def consented(profiles: DataFrame, consents: DataFrame, key: str = "profile_id") -> DataFrame:
    """Only the profiles whose owners have agreed; every plan over persons begins here. Who agreed is found once and goes to the tasks,
    if it isn't too much, so that the posts of a large profile are not brought together in one of them."""
    return profiles.join(small(consents.select(key).distinct(), "agreed"), key, "left_semi")


def location(text: Column, low: Column | None = None) -> Column:
    """(level, key) of the first "vivo en ...": a municipality, else a province, else a community (its province, if it has one only)."""
    only = {c: ps[0] for c, (_, ps) in R.COMMUNITIES.items() if len(ps) == 1}
    of_alias, of_single = (F.create_map(*[F.lit(x) for kv in t.items() for x in kv]) for t in (R.ALIASES, only))

    def at(level: str, key: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), key.alias("key"))

    def in_community(c: Column) -> Column:
        single = F.try_element_at(of_single, c)
        return F.when(single.isNotNull(), at("provincia", single)).when(c.isNotNull(), at("comunidad_autonoma", c))

    def found(keys: Column) -> Column:
        town, province, alias = keys["town"], keys["province"], keys["alias"]
        return F.when(town.isNotNull(), at("municipio", town)).when(province.isNotNull(), at("provincia", province)).otherwise(T.let(F.try_element_at(of_alias, alias), in_community))

    def keys(said: Column) -> Column:
        return F.struct(*(T.first_key(said, table).alias(name) for name, table in (("town", R.MUNICIPALITIES), ("province", R.PROVINCES), ("alias", R.ALIASES))))

    low = T.plain(text) if low is None else low
    return T.let(T.let(F.trim(T.captured(low, T.LIVES_IN, may=T.pieces_in(low))), keys), found)


def detectors(text: Column, special: bool = False, may: T.May = T.anything, low: Column | None = None) -> dict[str, Column]:
    """field -> value said in one text. special: also the two fields of special categories, where the person declares them. may: whether
    a text may match a pattern; low: the plain text, where it is known."""
    low = T.plain(text) if low is None else low
    study = T.plain(T.captured(text, T.STUDY, may=may))
    out = {
        "edad": T.age(text, may).cast("string"),
        "sexo": T.ordered(text, T.SEX, may),
        "estudios": T.first_key(study, R.STUDIES),
        "ocupacion": T.first_key(low, R.OCCUPATIONS),
        "universidad": T.captured(text, T.UNIVERSITY, may=may),
        "empresa": T.captured(text, T.COMPANY, may=may),
        "nacionalidad": T.ordered(text, T.NATIONALITY, may),
        "situacion_laboral": T.ordered(text, T.EMPLOYMENT, may),
        "lengua_materna": T.ordered(text, T.LANGUAGE, may),
        "signo_zodiacal": T.zodiac(text, low),
    }
    if special:
        out |= {"orientacion_sexual": T.orientation(text, may), "religion": T.religion(text, low)}
    return out


def household(partner: Column, alone: Column, children: Column, single_parent: Column) -> Column:
    return (
        F.when(single_parent | (children & alone), "monoparental")
        .when(alone, "unipersonal")
        .when(partner & children, "pareja_con_hijos")
        .when(partner, "pareja_sin_hijos")
    )


def declared(posts: DataFrame, special: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """Findings of all profiles. posts: profile_id, seq, permalink, text. only: those of some of the detectors' fields, and no other is looked for."""
    text, low, odd = F.col("text"), F.col("_low"), F.col("_odd")
    said = posts.select("profile_id", "seq", "permalink", "text").filter(F.coalesce(text, F.lit("")) != "").withColumns({"_low": F.lower(text), "_odd": T.is_odd(text)})
    may = T.pieces_in(low, odd)
    fields = detectors(text, special, may, F.col("_plain"))
    pairs = [F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields.items() if only is None or f in only]
    if only is None:
        place = T.let(location(text, F.col("_plain")), lambda p: F.concat_ws("|", p["level"], p["key"]))
        pairs.append(F.struct(F.lit("ubicacion").alias("field"), place.alias("value")))
    each = said.withColumn("_plain", T.bare(low)).select("profile_id", "seq", "permalink", F.explode(F.array(*pairs)).alias("f")).filter("f.value IS NOT NULL AND f.value <> ''")
    first = each.groupBy("profile_id", "f.field").agg(F.min(F.struct("seq", "f.value", "permalink")).alias("b"))
    is_place = F.col("field") == "ubicacion"
    first = first.select(
        "profile_id",
        F.when(is_place, F.substring_index("b.value", "|", 1)).otherwise(F.col("field")).alias("field"),
        F.when(is_place, F.substring_index("b.value", "|", -1)).otherwise(F.col("b.value")).alias("value"),
        F.array("b.permalink").alias("evidence"),
    )
    found = ["profile_id", "field", "value", F.lit("texto").alias("source"), F.lit(None).cast("double").alias("confidence"), "evidence"]
    if only is not None:
        return first.select(*found)
    hits = {k: may(p) & text.rlike(p) for k, p in T.HOUSEHOLD_SIGNALS.items()}
    seen = said.withColumns(hits).filter(" OR ".join(hits))
    home = seen.groupBy("profile_id").agg(*[F.bool_or(k).alias(k) for k in hits], F.array_sort(F.collect_list(F.struct("seq", "permalink"))).alias("e"))
    home = home.select(
        "profile_id",
        F.lit("tipo_hogar").alias("field"),
        household(F.col("partner"), F.col("alone"), F.col("children"), F.col("single_parent")).alias("value"),
        F.array_distinct(F.col("e.permalink")).alias("evidence"),
    ).filter("value IS NOT NULL")
    return first.unionByName(home).select(*found)


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per profile and field the finding of `first`, else that of `second`."""
    both = first.withColumn("_rank", F.lit(0)).unionByName(second.withColumn("_rank", F.lit(1)))
    rest = [c for c in first.columns if c not in ("profile_id", "field")]
    best = both.groupBy("profile_id", "field").agg(F.min_by(F.struct(*rest), "_rank").alias("b"))
    return best.select("profile_id", "field", *[F.col(f"b.{c}").alias(c) for c in rest])


def travel_posts(posts: DataFrame) -> DataFrame:
    """Permalinks of posts that speak of a journey."""
    return posts.filter(F.col("text").rlike(T.TRAVEL)).select("profile_id", "permalink").distinct()
