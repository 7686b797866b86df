"""Official series to reference shares: latest values, shares, allocations, differences, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.operators.shared import stored


def latest(series: DataFrame, key: str, value: str, order: str | Column) -> DataFrame:
    """The value with the greatest order of each key."""
    return series.groupBy(key).agg(F.max_by(value, order).alias(value))


def shares(df: DataFrame, value: str, by: str | None = None, digits: int = 3) -> DataFrame:
    """value as a share of the total (of `by`), rounded."""
    if by:
        df, total = df.join(df.groupBy(by).agg(F.sum(value).alias("_total")), by), F.col("_total")
    else:
        total = F.lit(df.agg(F.sum(value)).first()[0])
    return df.withColumn("share", F.round(F.col(value) / total, digits)).drop("_total")


def completed(rounded: list[Column]) -> Column:
    """The last of a set of shares: what the rounded others leave of 1."""
    total = rounded[0]
    for c in rounded[1:]:
        total = total + c
    return F.lit(1.0) - total


def allocated(parts: DataFrame, totals: DataFrame, branch: str, value: str, total: str, population: float) -> DataFrame:
    """A branch's total, in proportion to its parts, as a share of the population."""
    sums = parts.groupBy(branch).agg(F.sum(value).alias("_sum"))
    out = parts.join(sums, branch).join(totals, branch)
    return out.withColumn("share", F.col(total) * F.col(value) / F.col("_sum") / F.lit(population)).drop("_sum")


def differences(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, old, new, kind: changed, gone or added; equal values are left out."""
    a, b = old.select(key, F.col(value).alias("old"), F.lit(True).alias("_a")), new.select(key, F.col(value).alias("new"), F.lit(True).alias("_b"))
    both = a.join(b, key, "full")
    kind = F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "added").otherwise("changed")
    return both.filter(~(F.col("_a").eqNullSafe(F.col("_b")) & F.col("old").eqNullSafe(F.col("new")))).select(key, "old", "new", kind.alias("kind"))


def upserted(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """New values where there are some, the old ones elsewhere; the old order (`ord`) stays, new keys come last."""
    both = old.select(key, F.col(value).alias("_o"), "ord").join(new.select(key, F.col(value).alias("_n")), key, "full")
    rows = both.select(key, F.coalesce("_n", "_o").alias(value), "ord")
    # numbers by ranges: each range counts on from the sum of those before it
    rows = rows.repartitionByRange(F.col("ord").asc_nulls_last(), key).sortWithinPartitions(F.col("ord").asc_nulls_last(), key)
    rows = stored(rows.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "upserted")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within_range = F.row_number().over(Window.partitionBy("_p").orderBy("_i"))
    return rows.join(ranges, "_p").select(key, value, (F.col("_before") + within_range - 1).alias("ord"))


def sample_names(names: DataFrame, col: str, parts: tuple[str, ...], n: int) -> DataFrame:
    """The first n names that hold one of the parts, whatever its case; of all names where none does."""
    low = F.lower(col)
    hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p.lower())) for p in parts], F.lit(False))
    each = names.select(col, F.coalesce(hit, F.lit(False)).alias("_hit")).distinct()
    some = each.agg(F.bool_or("_hit")).first()[0]
    return (each.filter("_hit") if some else each).select(col).orderBy(col).limit(n)


def within(check: Column, low: float, high: float, name: str) -> Column:
    """check where it is plausible, else an error."""
    return F.when(check.between(low, high), check).otherwise(F.raise_error(F.concat(F.lit(f"{name} is not plausible: "), check.cast("string"))))


def long_series(raw: DataFrame) -> DataFrame:
    """name, variables (map), value, fecha, anyo, periodo of nested series."""
    kind = "array<struct<Nombre:string,MetaData:array<struct<T3_Variable:string,Nombre:string>>,Data:array<struct<Valor:double,Fecha:bigint,Anyo:int,FK_Periodo:int>>>>"
    s = raw.select(F.explode(F.from_json("json", kind)).alias("s"))
    variables = F.map_from_entries(F.transform("s.MetaData", lambda m: F.struct(m["T3_Variable"], m["Nombre"])))
    return s.select(F.col("s.Nombre").alias("name"), variables.alias("variables"), F.explode("s.Data").alias("d")).select("name", "variables", F.col("d.Valor").alias("value"), F.col("d.Fecha").alias("fecha"), F.col("d.Anyo").alias("anyo"), F.col("d.FK_Periodo").alias("periodo"))


def stale(tables: DataFrame, today: Column, days: Column) -> DataFrame:
    """name, verified, age: the tables (name, verified) whose last check is more than `days` ago; one that was never checked isn't judged."""
    return tables.withColumn("age", F.datediff(today, F.col("verified")).cast("long")).filter(F.col("age") > days).select("name", "verified", "age")


def category_of(value: Column, rules: tuple[tuple[str, str], ...], other: str) -> Column:
    """The category of the first rule (pattern, category) that a value matches."""
    out = None
    for pattern, category in rules:
        hit = value.rlike(pattern)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(other)


def sums_by_category(rows: DataFrame, dimension: DataFrame, key: str, value: str, category: str = "category") -> DataFrame:
    """category, value: sums over the rows of each key's category. Rows are summed by key before they meet the dimension."""
    part = rows.groupBy(key).agg(F.sum(value).alias(value))
    return part.join(dimension.select(key, category), key).groupBy(category).agg(F.sum(value).alias(value))


def counts_by_category(rows: DataFrame, column: str, category: Column) -> DataFrame:
    """category, n: rows by the category of a column; each value of it is looked at once."""
    each = rows.groupBy(column).agg(F.count("*").alias("_c"))
    return each.groupBy(category.alias("category")).agg(F.sum("_c").alias("n"))


#: What those who have no work and seek none are.
INACTIVE = {"retired": 0.57, "students": 0.20, "others": 0.23}


def activity_shares(active: Column, unemployed: Column, inactive: dict[str, float] = INACTIVE) -> dict[str, Column]:
    """Shares of the population from the rate of activity and that of unemployment among the active."""
    return {"active": active * (1 - unemployed), "unemployed": active * unemployed} | {k: (1 - active) * p for k, p in inactive.items()}


def agrees(parts: DataFrame, value: str, total: Column | float, tolerance: float = 0.02) -> Column:
    """For agg(): whether the sum of the parts is a known total, within a share of it."""
    t = total if isinstance(total, Column) else F.lit(total)
    return (F.abs(F.sum(value) - t) <= tolerance * t).alias("agrees")


def age_band(age: Column, width: int = 5, open_from: int = 85) -> Column:
    """The band of an age: 40-44, 85+."""
    low = (F.floor(age / width) * width).cast("int")
    return F.when(age >= open_from, f"{open_from}+").otherwise(F.concat_ws("-", low, low + width - 1))


def years_of(bands: DataFrame, low: str, share: str, width: int = 5) -> DataFrame:
    """age, p: a band's share in equal parts, a row a year."""
    return bands.select(F.explode(F.sequence(low, F.col(low) + width - 1)).alias("age"), (F.col(share) / width).alias("p"))


def populations_of(parts: DataFrame, group: str, population: str) -> DataFrame:
    """group, parts, population: of each group how many parts it has and their people."""
    return parts.groupBy(group).agg(F.count("*").alias("parts"), F.sum(population).alias("population"))


def inverted(hierarchy: DataFrame, group: str, members: str, member: str) -> DataFrame:
    """member, group: of a table group -> array of members."""
    return hierarchy.select(F.explode(members).alias(member), group)


def share_of(rows: DataFrame, column: str, shares_: DataFrame) -> DataFrame:
    """rows with the share of their value, null where it isn't known. shares_: column, share."""
    return rows.join(shares_.select(column, "share"), column, "left")


def canonical(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """rows with `name`: the own name of a value (names: column, own), else the value in small letters."""
    return rows.join(names.select(column, "own"), column, "left").withColumn("name", F.coalesce("own", F.lower(column))).drop("own")


def found_in(ids: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """ids with `found`: whether they are in the other table."""
    there = have.select(F.col(key).alias("_k")).distinct()
    return ids.join(there, ids[key] == F.col("_k"), "left").withColumn("found", F.col("_k").isNotNull()).drop("_k")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the other table."""
    return rows.join(gone.select(key), key, "left_anti")


def segments(label: Column, sep: str = " ") -> Column:
    """The parts of a label."""
    return F.split(label, sep)


def scaled_percent(share: Column) -> Column:
    """A share in per cent with one decimal, halves to even, as charts show it."""
    return F.bround(share * 1000) / 10
