"""Mixing sources to target weights by weighted fair queueing.

Each source shares a budget of words by its weight, up to MOST times its own size; what is above is shared again by weight
until none is above. Its documents are shuffled by hash, anew for each pass over them, and queue behind each other: the virtual finish time of a document is
the words of its source up to its end, divided by the source's target. Sorted by that time, the documents of all sources are
interleaved as their targets ask for, at every place of the order; at time 1 the budget is spent and the order ends. The
documents that are then in service, one a source at most, are cut there: a source gets its target to less than a word.

Running sums go by buckets: a bucket is a range of hashes of one source (then a range of finish times of all) with about
ROWS_EACH rows, its sum is aggregated before anything moves, and only sums meet across buckets. So a source of any size is
dealt over as many tasks as it has buckets. Texts don't travel: sizes and digests do.

Defined results: a null text has no words; documents without words, and sources without any, take nothing; null is a source of
its own, the last; null ids are a value like any other; rows that repeat id, text and source share what all of them take, the first pass over all
before the second; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import itertools
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracelens.llm.common import sized_broadcast, stored

#: Weights of the sources in the order of their names, repeating; words of the mix for each word there is; passes over a source at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
ROWS_EACH = 4096
BROADCAST_BYTES = 16 << 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bits of a document's hash, as a place in its source's order.
BITS = 60


def words_in(text):
    """Number of words: stretches without blank, \\t, \\n, \\v, \\f and \\r."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD.pattern)), F.lit(0)).cast("long")


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with rank, from 0, in an order over all rows: a range sort, and offsets of its parts."""
    low = (1 << 33) - 1
    df = stored(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "mix-ranks")
    part = F.shiftright("_m", 33)
    offsets = df.groupBy(part.alias("_p")).count()  # as many as the sort has tasks
    offsets = offsets.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_o"))
    return df.join(F.broadcast(offsets), part == F.col("_p")).withColumn("rank", F.col("_o") + F.col("_m").bitwiseAND(low)).drop("_m", "_p", "_o")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, n, rank, target: shares of share * all sizes by weight, none above most * its size.

    sizes: source, source_size, n. Each turn is one aggregate over the sources; the level only rises, so who is full stays full.
    """
    s = numbered(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    s = stored(s.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * most), "mix-sources")
    budget = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = F.col("most") < F.lit(level) * F.col("weight")
        r = s.agg(F.count_if(above).alias("full"), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)).alias("held"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("w")).first()
        if r["full"] == full or not r["w"]:
            break
        full, level = r["full"], (budget - r["held"]) / r["w"]
    share_of = F.lit(level) * F.col("weight")
    return s.withColumn("target", F.least(F.col("most").cast("double"), share_of)).select("source", "source_size", "n", "rank", "target")


def before_in(df: DataFrame, group: list[str], bucket: str, amount: str, order: list) -> DataFrame:
    """df with `before`: the amounts that come before each row in its group, by (bucket, order)."""
    sums = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_sum"), F.count("*").alias("_n"))
    sums = sums.withColumn("_off", F.sum("_sum").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)))
    sums = stored(sums.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate([*group, bucket])}), "mix-offsets")
    offsets = sized_broadcast(sums.drop("_sum", "_n"), sums.count(), 64, BROADCAST_BYTES)
    on = [df[c].eqNullSafe(offsets[f"_k{i}"]) for i, c in enumerate([*group, bucket])]
    joined = df.join(offsets, on).drop(*[f"_k{i}" for i in range(len(on))])
    w = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("before", F.coalesce(F.col("_off"), F.lit(0)) + F.coalesce(F.sum(amount).over(w), F.lit(0))).drop("_off")


def shuffled(documents: DataFrame, seed: int) -> DataFrame:
    """A row for each pass over each document: epoch, h (its place in the order of its source and pass), bucket."""
    passes = F.ceil(F.col("target") / F.col("source_size")).cast("int")
    p = documents.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), passes))))
    draw = F.md5(F.concat_ws(":", (F.lit(seed) + F.col("epoch")).cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), "digest"))
    p = p.withColumn("h", F.conv(F.substring(draw, 1, BITS // 4), 16, 10).cast("long"))
    parts = F.ceil(F.col("n") / F.lit(ROWS_EACH))
    return p.withColumn("bucket", F.col("epoch").cast("long") * F.lit(1 << 40) + F.shiftright(F.shiftright("h", 28) * parts, BITS - 28))


def queued(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: id, source, digest (of the text), size, copies, source_size, rank, target. pieces: the mix, in the order of
    position: id, source, digest, size, copies, epoch, finish, position (words before it in the mix), taken."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.md5(text).alias("digest"), words_in(text).alias("size"))
    groups = stored(rows.groupBy("id", "source", "digest", "size").agg(F.count("*").alias("copies")), "mix-documents")
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n"))
    of = stored(targets(sizes, weights, share, most), "mix-targets")
    known = sized_broadcast(of.withColumnRenamed("source", "_s"), of.count(), 96, BROADCAST_BYTES)
    documents = groups.join(known, groups["source"].eqNullSafe(known["_s"])).drop("_s")
    p = shuffled(documents, seed).withColumn("words", F.col("size") * F.col("copies"))
    p = before_in(p, ["rank"], "bucket", "words", ["h", "id", "digest"])
    # what is in service at time 1 is cut there
    p = p.withColumn("words", F.least(F.col("words"), F.floor("target") - F.col("before"))).filter("words > 0")
    p = p.withColumn("finish", F.least(F.lit(1.0), (F.col("before") + F.col("words")) / F.col("target"))).drop("before")
    p = stored(p, "mix-queue")
    parts = max(1, -(-p.count() // ROWS_EACH))
    p = p.withColumn("slot", F.floor(F.col("finish") * parts))
    p = before_in(p, [], "slot", "words", ["finish", "rank", "epoch", "h", "id", "digest"]).withColumnsRenamed({"before": "position", "words": "taken"})
    budget = of.agg(F.sum("source_size")).first()[0]
    p = p.filter(F.col("position") < F.lit(share * (budget or 0)))
    return documents.drop("n"), p.select("id", "source", "digest", "size", "copies", "rank", "epoch", "finish", "position", "taken")


def taken_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """id_col, size, source_size, target, taken: one row per row of docs."""
    documents, pieces = queued(docs, id_col, text_col, source_col, **how)
    mine = pieces.groupBy(*(F.col(c).alias(f"_{c}") for c in ("id", "rank", "digest"))).agg(F.collect_list("taken").alias("passes"))  # at most MOST passes
    on = documents["id"].eqNullSafe(mine["_id"]) & (documents["rank"] == mine["_rank"]) & (documents["digest"] == mine["_digest"])
    each = documents.join(mine, on, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    got = F.aggregate(F.coalesce("passes", F.array().cast("array<long>")), F.lit(0).cast("long"), lambda s, t: s + F.greatest(F.lit(0), F.least(F.col("size"), t - (F.col("copy") - 1) * F.col("size"))))
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", got.alias("taken"))


@F.pandas_udf(StringType())
def first_words(text: pd.Series, n: pd.Series) -> pd.Series:
    """Texts up to the end of their n-th word."""

    def head(t: str, k: int) -> str:
        return t[: next(itertools.islice(WORD.finditer(t), k - 1, None)).end()]

    return pd.Series([None if t is None else head(t, int(k)) for t, k in zip(text, n, strict=True)], dtype=object)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: position, id_col, source_col, epoch, taken and text, sorted by position over all parts. A text that is cut has its first
    `taken` words; documents that stand there more than once come one after the other."""
    _, p = queued(docs, id_col, text_col, source_col, **how)
    ahead = (F.col("copy") - 1) * F.col("size")
    p = p.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")).cast("long"))))
    p = p.select(F.col("id").alias("_id"), F.col("source").alias("_s"), F.col("digest").alias("_d"), "epoch", "size", (F.col("position") + ahead).alias("position"), F.least("size", F.col("taken") - ahead).alias("taken"))
    name = f"_{uuid.uuid4().hex}"
    plain = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), plain.alias(name)).withColumn("digest", F.md5(name)).dropDuplicates(["id", "source", "digest"])
    on = p["_id"].eqNullSafe(texts["id"]) & p["_s"].eqNullSafe(texts["source"]) & (p["_d"] == texts["digest"])
    cut = F.col("taken") < F.col("size")
    head = F.when(cut, first_words(F.when(cut, F.col(name)), F.col("taken"))).otherwise(F.col(name))  # only texts that are cut go to Python
    out = p.join(texts, on).select("position", F.col("id").alias(id_col), F.col("source").alias(source_col), "epoch", "taken", head.alias(text_col))
    return out.orderBy("position")
