"""Exact duplicates: group by a 128-bit content hash, keep one stable id, compare bytes inside the groups.

Everything here is DataFrame operations.

Defined results: a null text counts as empty; a null id is the lowest id; rows that repeat both id and text all count
in group_size and all carry the same `kept`; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import salts, sized_broadcast, stored

#: Rows of one group that one part of it holds, and the most bytes of group keys that are broadcast.
ROWS_EACH = 4096
BROADCAST_BYTES = 32 << 20


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", rows_each: int = ROWS_EACH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    keep: "min" keeps the smallest id of each group of equal texts, "max" the largest.
    Only hashes travel for texts that are alone; texts of hash groups with more rows are compared with one
    representative, and a text that differs from it (a hash collision) is grouped by its own bytes.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_h", F.unhex(F.md5("_t")))
    sha = F.sha2("_t", 256).alias("_sha")
    groups = stored(rows.groupBy("_h").agg(F.count("*").alias("_n"), best("_id").alias("_rep")).filter("_n > 1"), "exact-groups")
    many = sized_broadcast(groups, groups.count(), 64, broadcast_bytes)
    alone = rows.join(many, "_h", "left_anti").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), sha)
    held = rows.join(many, "_h").withColumn("_parts", salts(F.col("_n"), rows_each))
    reps = held.filter(F.col("_id").eqNullSafe(F.col("_rep"))).groupBy("_h").agg(F.first("_t").alias("_rep_t"), F.first("_parts").alias("_p"))
    reps = reps.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_p") - 1))).drop("_p")
    # the class of a row: null for the representative's bytes, else its own text
    judged = stored(
        held.withColumn("_salt", F.pmod(F.xxhash64(F.col("_id")), F.col("_parts")).cast("int"))
        .join(reps, ["_h", "_salt"])
        .select("_id", "_h", "_salt", "_parts", F.when(F.col("_t") != F.col("_rep_t"), F.col("_t")).alias("_other"), sha),
        "exact-judged",
    )
    classes = judged.groupBy("_h", "_other").agg(best("_id").alias("keep_id"), F.count("*").alias("group_size"), F.first("_parts").alias("_p"))
    classes = classes.select(F.col("_h").alias("_ch"), F.col("_other").alias("_co"), "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("_cs"))
    grouped = judged.join(classes, (F.col("_h") == F.col("_ch")) & (F.col("_salt") == F.col("_cs")) & F.col("_other").eqNullSafe(F.col("_co"))).select("_id", "keep_id", "group_size", "_sha")
    return alone.unionByName(grouped).select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat both id and text, one."""
    judged = duplicate_groups(docs, id_col, text_col, keep).filter("group_size > 1").select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_gone_sha"), "kept")
    judged = stored(judged, "exact-copies")
    gone = judged.filter("NOT kept").distinct()
    again = judged.filter("kept").groupBy("_gone", "_gone_sha").count().filter("count > 1").drop("count")
    n = judged.count()

    def same(right: DataFrame):
        return F.col(id_col).eqNullSafe(right["_gone"]) & (F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) == right["_gone_sha"])

    gone = sized_broadcast(gone.drop("kept"), n, 160, broadcast_bytes)
    left = docs.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return left
    again = sized_broadcast(again, n, 160, broadcast_bytes)
    return left.join(again, same(again), "left_anti").unionByName(left.join(again, same(again), "left_semi").dropDuplicates([id_col, text_col]))
