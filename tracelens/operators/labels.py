"""Labels and notes in a reader's language, from templates.

translations: lang, key, text. Keys are `attribute.<template>`, `value.<category>.<value>` and `note.<code>`. A template holds
places like {{value}}. What has no translation in the language is shown as the report has it, in its own language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(template: Column, values: Column) -> Column:
    """template with each {{name}} replaced by its value of a map; places without a value stay."""
    put = F.filter(F.map_entries(values), lambda e: e["value"].isNotNull())
    return F.aggregate(put, template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def template_key(category: Column, level: Column) -> Column:
    """A place has a template for each level, any other category one."""
    return F.when((category == "ubicacion") & (F.coalesce(level, F.lit("")) != ""), F.concat(F.lit("attribute.ubicacion_"), level)).otherwise(F.concat(F.lit("attribute."), category))


def labelled(steps: DataFrame, translations: DataFrame, languages: list[str]) -> DataFrame:
    """steps (category, location_level, value_raw, attribute_label, note_code, note, ...) once for each language, with label and shown_note.

    A step without a value or without a template keeps its attribute_label; a value without a translation (a proper name, a number) is put in as it is;
    a note without a code, or with an unknown one, stays."""
    each = steps.withColumn("lang", F.explode(F.array(*(F.lit(x) for x in dict.fromkeys(languages)))))
    t = translations.select("lang", "key", "text")

    def told(df: DataFrame, key: Column, name: str) -> DataFrame:
        k = t.withColumnsRenamed({"lang": "_l", "key": "_k", "text": name})
        return df.withColumn("_key", key).join(k, (F.col("lang") == F.col("_l")) & (F.col("_key") == F.col("_k")), "left").drop("_key", "_l", "_k")

    out = told(each, template_key(F.col("category"), F.col("location_level")), "_template")
    out = told(out, F.concat_ws(".", F.lit("value"), "category", "value_raw"), "_value")
    out = told(out, F.concat(F.lit("note."), F.col("note_code")), "_note")
    value = F.coalesce("_value", "value_raw")
    made = F.when((F.coalesce("value_raw", F.lit("")) != "") & F.col("_template").isNotNull(), filled(F.col("_template"), F.create_map(F.lit("value"), value)))
    return out.withColumn("label", F.coalesce(made, "attribute_label")).withColumn("shown_note", F.coalesce("_note", "note")).drop("_template", "_value", "_note")
