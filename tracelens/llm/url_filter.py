"""URL rules, and a verdict for the rest from words of host and path.

A rule is host/path; it fits its host and all subdomains of it where the path begins with the rule's, and of the fitting
rules the longest decides (of equally long ones the first in the list). Other urls are judged by words: names in a host
are cut into words by unigram Viterbi (counts of all words of the pages and of the hyphenated parts of hosts), and multinomial
naive Bayes scores the words of host and path. A seed lexicon only starts it: addresses with one of its words are of the
class block, all others of the class allow, and ROUNDS turns of expectation and maximisation over all pages then move the
others: each address counts for either class by what the words said of it in the turn before, so that words seen beside
the seeds come to stand for the class, too. The verdict is what the last turn's words say.

Hot words and addresses: joins on words and addresses are plain joins, which adaptive execution splits where a key is hot,
and single letters, which stand in every name, are looked up in a table of at most 26 rows.

Defined results: a null url, or one without "://", has an empty host and path and, without words, the likelier class of
the two, allow where there are no pages of the class block; repeated rows give repeated rows; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import session_of, sized_broadcast, stored

#: (verdict, rule)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Words that mark unwanted sites.
SEEDS = ("casino", "bets", "pills", "spam", "adult", "porn", "ads", "viagra", "poker", "xxx")
LONGEST_WORD, ROUNDS = 20, 2
BROADCAST_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(addresses: DataFrame, rules=RULES) -> DataFrame:
    """addresses (host, path distinct) with rule and ruling, null where none fits."""
    spark = addresses.sparkSession
    listed = [(k, v, r, *r.split("/", 1)) for k, (v, r) in enumerate(rules)]
    known = spark.createDataFrame([(k, v, r, h, "/" + p) for k, v, r, h, p in listed], "_k int, ruling string, rule string, _h string, _p string")
    labels = F.split("host", r"\.")
    suffixes = addresses.withColumn("_h", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    fits = suffixes.join(sized_broadcast(known, len(listed), 256, BROADCAST_BYTES), "_h").filter(F.expr("startswith(path, _p)"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), -F.col("_k"), "rule", "ruling")).alias("b"))
    return addresses.join(best, ["host", "path"], "left").select("host", "path", F.col("b.rule").alias("rule"), F.col("b.ruling").alias("ruling"))


def names_of(host):
    """Runs of letters in a host."""
    return F.regexp_extract_all(host, F.lit("([a-z]+)"), F.lit(1))


def path_words(path):
    return F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))


def unigrams(pages: DataFrame, html_col: str | None, hosts: DataFrame) -> DataFrame:
    """word, n: counts of all lower-case words of the pages' text and of the words that hosts part with hyphens (a name
    without one may be several words and is no evidence)."""
    parted = F.filter(F.split("host", r"\."), lambda x: F.contains(x, F.lit("-")))
    parts = hosts.select(F.explode(names_of(F.array_join(parted, "-"))).alias("word"), F.col("n"))
    if html_col:
        plain = F.lower(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), "(?s)<[^>]*>", " "))
        parts = parts.unionByName(pages.select(F.explode(F.regexp_extract_all(plain, F.lit(r"([a-z]+)"), F.lit(1))).alias("word"), F.lit(1).cast("long").alias("n")))
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def segmented(names: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """name, words: the most probable cut of each name. A word of length l that was never seen has count 10^-l."""
    session_of(names)
    letters = {r["word"]: r["n"] for r in words.filter(F.length("word") == 1).collect()}  # at most 26
    spans = names.filter(F.length("name") > 1).select("name", F.explode(F.sequence(F.lit(1), F.length("name") - 1)).alias("i"))
    spans = spans.select("name", "i", F.explode(F.sequence(F.lit(2), F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("i") + 1))).alias("l"))
    spans = spans.withColumn("word", F.expr("substring(name, i, l)"))
    known = spans.join(words, "word").groupBy("name").agg(F.collect_list(F.struct("i", "l", "n")).alias("known"))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "words": [viterbi(x, [] if k is None else k, total, letters) for x, k in zip(b["name"], b["known"], strict=True)]})

    return names.join(known, "name", "left").select("name", "known").mapInPandas(run, "name string, words array<string>")


def viterbi(name: str, known, total: int, letters: dict[str, int] | None = None) -> list[str]:
    """known: counts n of the words of l letters that begin at the i-th; letters: counts of words of one."""
    counts = {(k["i"] - 1, k["l"]): k["n"] for k in known}
    if letters:
        counts |= {(i, 1): letters[c] for i, c in enumerate(name) if c in letters}
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * len(name)
    for i in range(len(name)):
        if best[i][0] == -math.inf:
            continue
        for w in range(1, min(LONGEST_WORD, len(name) - i) + 1):
            n = counts.get((i, w), 10.0**-w)
            s = best[i][0] + math.log(n / (total + 1))
            if s > best[i + w][0]:
                best[i + w] = (s, i)
    out, j = [], len(name)
    while j:
        i = best[j][1]
        out.append(name[i:j])
        j = i
    return out[::-1]


def weighed(held: DataFrame) -> tuple[DataFrame, float, int]:
    """word and w, how much it speaks for block; the prior; and the number of words. held: words, n, bad (share of block)."""
    docs = held.agg(F.sum(F.col("n") * F.col("bad")).alias("b"), F.sum("n").alias("n")).first()
    each = held.select("n", "bad", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.sum(F.col("n") * F.col("bad")).alias("b"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("a"))
    counts = stored(counts, "url-counts")
    sums = counts.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    b, a, v = sums["b"] or 0.0, sums["a"] or 0.0, sums["v"]
    bad, n = docs["b"] or 0.0, docs["n"] or 0
    prior = math.log((bad + 1) / (n - bad + 1)) if bad else -math.inf
    weight = F.log((F.col("b") + 1) / (b + v + 1)) - F.log((F.col("a") + 1) / (a + v + 1))
    return counts.select("word", weight.alias("w")), prior, v


def said_of(held: DataFrame, weights: DataFrame, prior: float, v: int) -> DataFrame:
    """host, path and odds: the log odds of block by the words of each address."""
    each = held.select("host", "path", F.explode_outer("words").alias("word"))
    said = each.join(sized_broadcast(weights, v, 48, BROADCAST_BYTES), "word", "left").groupBy("host", "path").agg(F.sum("w").alias("said"))
    return said.select("host", "path", (F.coalesce("said", F.lit(0.0)) + F.lit(prior)).alias("odds"))


def judged(pages: DataFrame, rules=RULES, seeds=SEEDS, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", rounds: int = ROUNDS) -> DataFrame:
    """id_col, host, path, rule, verdict, log_odds (of block; what the words alone say)."""
    rows = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    addresses = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n")), "url-addresses")
    hosts = addresses.groupBy("host").agg(F.sum("n").alias("n"))
    words = stored(unigrams(pages, html_col, hosts), "url-unigrams")
    total = words.agg(F.sum("n")).first()[0] or 0
    names = hosts.select(F.explode(names_of(F.col("host"))).alias("name")).distinct()
    cut = stored(segmented(names, words, total), "url-names")
    of_host = hosts.select("host", F.explode(names_of(F.col("host"))).alias("name")).join(sized_broadcast(cut, cut.count(), 96, BROADCAST_BYTES), "name")
    of_host = stored(of_host.groupBy("host").agg(F.flatten(F.collect_list("words")).alias("host_words")), "url-host-words")
    of_host = sized_broadcast(of_host, of_host.count(), 160, BROADCAST_BYTES)  # beyond that a skewed host is split by the join
    held = addresses.join(of_host, "host", "left").select("host", "path", "n", F.concat(F.coalesce("host_words", F.array().cast("array<string>")), path_words(F.col("path"))).alias("words"))
    seeded = F.coalesce(F.arrays_overlap("words", F.array(*map(F.lit, seeds))), F.lit(False))
    held = stored(held.withColumn("seeded", seeded).withColumn("bad", seeded.cast("double")), "url-words")
    weights = weighed(held)
    for _ in range(rounds):
        share = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("odds")))))
        now = held.drop("bad").join(said_of(held, *weights), ["host", "path"])
        held = stored(now.withColumn("bad", F.when(F.col("seeded"), 1.0).otherwise(share)).drop("odds"), "url-words")
        weights = weighed(held)
    out = ruled(addresses.select("host", "path"), rules).join(said_of(held, *weights), ["host", "path"])
    out = out.select("host", "path", "rule", F.coalesce("ruling", F.when(F.col("odds") > 0, "block").otherwise("allow")).alias("verdict"), F.col("odds").alias("log_odds"))
    return rows.join(out, ["host", "path"]).select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict", "log_odds")
