"""Population narrowing: how many people share all that a profile has declared.

Each estimable finding has a share of the population; the shares multiply in a fixed order, so what remains after a step
is an ordered running product over the profile's steps. A value without a share passes the product on and is marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import reference as R


def risk(remaining: Column) -> Column:
    """Risk band of the unrounded number of people."""
    return (
        F.when(remaining.isNull(), "no_estimable")
        .when(remaining >= 100_000, "bajo")
        .when(remaining >= 1_000, "medio")
        .when(remaining >= 20, "alto")
        .otherwise("critico")
    )


def shares(findings: DataFrame, special: bool = False) -> DataFrame:
    """findings with step_no, category, location_level, proportion_of_step (null: can't be estimated)."""
    spark = findings.sparkSession
    w = Window.partitionBy("profile_id")  # a profile has a finding a field at most
    f = findings.withColumns({f"_{x}": F.max(F.when(F.col("field") == x, F.col("value"))).over(w) for x in ("sexo", "edad", "municipio", "provincia", "comunidad_autonoma")})
    f = f.join(R.places(spark).select(F.col("province").alias("_provincia"), F.col("community").alias("_of")), "_provincia", "left")
    f = f.withColumn("_community", F.coalesce("_comunidad_autonoma", "_of"))
    level = F.when(F.col("_municipio").isNotNull(), "municipio").when(F.col("_provincia").isNotNull(), "provincia").otherwise("comunidad_autonoma")
    is_place = F.col("field").isin("municipio", "provincia", "comunidad_autonoma")
    f = f.filter(~is_place | (F.col("field") == level)).filter((F.col("field") != "edad_rango") | F.col("_edad").isNull())
    if not special:
        f = f.filter(~F.col("field").isin(*R.SPECIAL_CATEGORIES))
    category = F.when(is_place, "ubicacion").when(F.col("field") == "edad_rango", "edad").otherwise(F.col("field"))
    steps = F.array(*map(F.lit, R.STEPS))
    f = f.withColumn("category", category).withColumn("step_no", F.array_position(steps, F.col("category")).cast("int")).filter("step_no > 0")
    f = f.withColumn("location_level", F.when(is_place, F.col("field")))
    key = F.when(F.col("field") == "signo_zodiacal", F.substring_index("value", " (", 1)).otherwise(F.col("value"))
    sexed = F.col("_sexo").isin(*R.SEX)
    given = F.when((F.col("field") == "estado_civil") & sexed, F.col("_sexo")).when(F.col("field") == "lengua_materna", F.coalesce("_community", F.lit("")))
    f = f.withColumn("_key", key).withColumn("_given", given)
    d = R.distributions(spark).select(F.col("field").alias("_f"), F.col("key").alias("_k"), F.col("given").alias("_g"), "p")
    f = f.join(d, (F.col("field") == F.col("_f")) & (F.col("_key") == F.col("_k")) & F.col("_given").eqNullSafe(F.col("_g")), "left")
    n = R.populations(spark).select(F.col("level").alias("_l"), F.col("key").alias("_pk"), "population")
    f = f.join(n, (F.col("field") == F.col("_l")) & (F.col("value") == F.col("_pk")), "left")
    p = F.when(is_place, F.col("population") / F.lit(float(R.TOTAL_POPULATION))).otherwise(F.col("p"))
    return f.select("profile_id", "step_no", "category", "value", "location_level", p.alias("share"), "source", "confidence", "evidence")


def running(share: Column, by: str, order: str) -> Column:
    """The product of the shares up to each row; a null share passes it on."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.product(F.coalesce(share, F.lit(1.0))).over(w)


def narrowed(findings: DataFrame, special: bool = False) -> DataFrame:
    """profile_id, step_no, category, value, location_level, remaining_population, risk_level, reduction_percent, proportion, ..."""
    left = F.lit(float(R.TOTAL_POPULATION)) * running(F.col("share"), "profile_id", "step_no")
    f = shares(findings, special).withColumn("_left", F.when(F.col("share").isNotNull(), left))
    return f.select(
        "profile_id",
        "step_no",
        "category",
        "value",
        "location_level",
        F.bround("_left", 0).cast("long").alias("remaining_population"),
        risk(F.col("_left")).alias("risk_level"),
        F.bround((1 - F.col("share")) * 100, 1).alias("reduction_percent"),
        F.when(F.col("location_level").isNull(), F.col("_left") / R.TOTAL_POPULATION).alias("proportion"),
        "source",
        "confidence",
        "evidence",
    )


def final_population(steps: DataFrame) -> DataFrame:
    """The last estimate of each profile; null where no step could be estimated."""
    last = F.max_by("remaining_population", F.when(F.col("remaining_population").isNotNull(), F.col("step_no")))
    return steps.groupBy("profile_id").agg(last.alias("final_population"), F.count("remaining_population").alias("estimated_steps"))
