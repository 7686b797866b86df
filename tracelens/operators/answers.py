"""Answers of language models: untyped JSON in, validated findings out. Nothing here calls a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.functions import reference as R

LEAST_CONFIDENCE, MOST_SOFT = 0.7, 5
ENUMS = {
    "sexo": tuple(R.SEX), "nacionalidad": tuple(R.NATIONALITY), "situacion_laboral": tuple(R.EMPLOYMENT), "tipo_hogar": tuple(k for k in R.HOUSEHOLD if k != "otro"),
    "estado_civil": tuple(R.MARITAL), "lengua_materna": ("catalan", "euskera", "gallego", "valenciano"), "estudios": tuple(R.STUDIES), "ocupacion": tuple(R.OCCUPATIONS),
}
SOFT = "array<struct<categoria:string,valor:string,confianza:string>>"


def number(v: Column) -> Column:
    """A JSON number; null for true, false and words."""
    return F.when(v.rlike(r"^-?\d+(\.\d+)?$"), v).try_cast("double")


def clamped(v: Column, default: float = 0.5) -> Column:
    # least and greatest pass over nulls
    return F.when(number(v).isNull(), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number(v))))


def from_model(answers: DataFrame) -> DataFrame:
    """Findings of answers (profile_id, json); whatever is malformed, out of range or unknown is left out."""

    def at(path: str) -> Column:
        return F.get_json_object("json", f"$.{path}")

    age = number(at("edad"))
    band, sure = at("edad_rango.valor"), clamped(at("edad_rango.confianza"))
    none = F.lit(None).cast("double")

    def pair(field: str, value: Column, confidence: Column = none) -> Column:
        return F.struct(F.lit(field).alias("field"), value.alias("value"), confidence.alias("confidence"))

    pairs = [pair(f, F.when(at(f).isin(*keys), at(f))) for f, keys in ENUMS.items()]
    pairs.append(pair("edad", F.when(age.between(12, 100), age.cast("int").cast("string"))))
    pairs.append(pair("edad_rango", F.when(band.isin(*R.AGE_BANDS) & (sure >= LEAST_CONFIDENCE), band), sure))
    each = answers.select("profile_id", F.explode(F.array(*pairs)).alias("f")).filter("f.value IS NOT NULL")
    return each.select("profile_id", "f.field", "f.value", F.lit("ia").alias("source"), "f.confidence", F.array().cast("array<string>").alias("evidence"))


def soft_inferences(answers: DataFrame) -> DataFrame:
    """The first five of an answer's soft inferences, less those without a value."""
    listed = F.slice(F.from_json(F.get_json_object("json", "$.inferencias_blandas"), SOFT), 1, MOST_SOFT)
    each = answers.select("profile_id", F.explode(listed).alias("i")).filter("trim(i.valor) <> ''")
    return each.select("profile_id", F.col("i.categoria").alias("category"), F.trim("i.valor").alias("value"), clamped(F.col("i.confianza")).alias("confidence"))


# Answers that say that there is nothing.
NOTHING = ("ninguno", "ninguna", "none", "n/a", "no")


def from_photos(answers: DataFrame) -> DataFrame:
    """photo, persons, hobby, couple, visible_text, inferred_hobby of answers of four lines (photo, answer), each null where the line is absent
    or says nothing. A hobby is inferred where one person or none is seen."""

    def line(name: str, nothing: tuple[str, ...] = ()) -> Column:
        v = F.lower(F.rtrim(F.trim(F.nullif(F.regexp_extract("answer", rf"(?im)^{name}:[ \t]*([^\n]*)", 1), F.lit(""))), F.lit(".")))
        return F.when((v != "") & ~v.isin(*nothing), v) if nothing else F.when(v != "", v)

    a = answers.select("photo", line("PERSONAS").alias("persons"), line("AFICION", NOTHING).alias("hobby"), line("PAREJA").alias("couple"), line("TEXTO_VISIBLE", NOTHING).alias("visible_text"))
    return a.withColumn("inferred_hobby", F.when(F.col("persons").isin("ninguna", "una"), F.col("hobby")))
