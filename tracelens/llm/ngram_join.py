"""Similarity join of documents on their sets of word n-grams, with adaptive multi-match prefixes.

All n-grams have one order: by the class of their frequency (a count sketch over all documents, on a log scale), then by
hash. Two sets of n_a and n_b n-grams with Jaccard similarity from 3/4 on share at least ceil(3 n / 4) of either, so among
the first n - ceil(3 n / 4) + l of each they share l. A document whose first n-grams are frequent would meet many others:
its l grows, with its prefix, by the estimated cost of its candidates, and a pair is a candidate only if it shares so many
n-grams (the smaller l of the two, or more where both prefixes are long enough for the pair's sizes) so early in both sets
as sets of their sizes must. Candidates are verified on the whole sets.

Equal sets are one node. Each n-gram has a representative, its smallest node, and every node is first compared with the
representatives of most of its n-grams, which finds most links of large groups of near copies in as many comparisons as
they have nodes; then every candidate pair that
is not in one component yet is verified, so that components are those of all links. The number of links is not counted.

Sets hold 64-bit hashes of the n-grams and nodes are 64-bit hashes of sets, which are trusted: different words, n-grams or
sets with one hash would count as the same (one pair of sets among 10**10 with a chance of about one half).

Defined results: words are stretches between blanks and \\t\\n\\v\\f\\r, A-Z lower-cased; a text of fewer words than n is one
n-gram; without words the set is empty and linked with nothing; a null text counts as empty; null ids stay null and take
the smallest other id of their component; rows that repeat are linked; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.common import components, doc_places, key_filter, mixed, ngram_hashes, passing, session_of, sized_broadcast, stored, without_ids, word_hashes

N, PERCENT = 5, 75
#: Counters of the sketch, and how many travel in one row.
WIDTH, PART = 1 << 20, 1 << 16
MOST_L, CHEAP = 4, 64.0
#: Representatives that a node is compared with in the first round.
STARS = 2


def sets_of(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """The set of each text: sorted distinct uint64 hashes of its n-grams."""
    h, counts = word_hashes(texts)
    at, who, _ = doc_places(counts, n)
    g = ngram_hashes(h, n)[at] if len(at) else np.zeros(0, np.uint64)
    size = np.bincount(who, minlength=len(texts))
    out, a, first = [], 0, 0
    for k, c in zip(size.tolist(), counts.tolist(), strict=True):
        out.append(np.unique(g[a : a + k]) if k else mixed(ngram_hashes(h[first : first + c], c) + np.uint64(c)) if c else g[:0])
        a += k
        first += c
    return out


def node_of(s: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h - ((h >> 63) << 64)


def needed(n):
    """Least overlap of a set of n with any similar one."""
    return (PERCENT * n + 99) // 100


class Order:
    """The common order of n-grams and the length of each document's prefix.

    A counter holds its n-gram's documents and a share of all others, the mean of all counters with its scatter. Counters
    within three standard deviations of the mean say nothing (class 0); above them classes double.
    """

    def __init__(self, counts: np.ndarray):
        mean = float(counts.sum()) / WIDTH
        noise = 3 * max(1.0, np.sqrt(mean))
        over = (counts - mean) / noise
        self.classes = np.where(over < 1, 0, 1 + np.log2(np.maximum(over, 1))).astype(np.uint64)
        #: estimated other documents of a frequent n-gram
        self.others = np.where(over < 1, 0.0, counts - mean).astype(np.float32)

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        slot = (s & np.uint64(WIDTH - 1)).astype(np.int64)
        order = np.argsort(self.classes[slot] << np.uint64(56) | s >> np.uint64(8), kind="stable")
        least = needed(len(s))
        others = self.others[slot[order]]
        first = len(s) - least + 1
        l, cost = 1, float(others[:first].sum())
        if cost > CHEAP:  # each more shared n-gram asked for leaves a quarter of the candidates, and lengthens the prefix
            price = [first - 1 + k + (cost + float(others[first : first - 1 + k].sum())) / 4 ** (k - 1) for k in range(1, min(MOST_L, least) + 1)]
            l = int(np.argmin(price)) + 1
        return s[order[: len(s) - least + l]], l


def sketched(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """(_row, _id, n, node) of every document, and the count sketch over the n-grams of all."""
    spark = session_of(docs)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        total = np.zeros(WIDTH, np.int64)
        for b in batches:
            sets = sets_of(b["_t"].tolist())
            if sets:
                np.add.at(total, (np.concatenate(sets) & np.uint64(WIDTH - 1)).astype(np.int64), 1)
            yield pd.DataFrame({"_row": b["_row"], "_id": b["_id"], "n": [len(s) for s in sets], "node": [node_of(s) for s in sets], "part": -1, "at": None, "counts": None})
        for part in range(WIDTH // PART):
            x = total[part * PART : (part + 1) * PART]
            at = np.flatnonzero(x)
            if len(at):
                yield pd.DataFrame({"_row": [-1], "_id": [None], "n": [0], "node": [0], "part": [part], "at": [at.astype("<u2").tobytes()], "counts": [x[at].astype("<u4").tobytes()]})

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    both = stored(rows.mapInPandas(run, "_row long, _id string, n long, node long, part int, at binary, counts binary"), "ngram-docs")

    def merge(table):
        x = np.zeros(PART, np.int64)
        for at, counts in zip(table["at"], table["counts"], strict=True):
            x[np.frombuffer(at, "<u2")] += np.frombuffer(counts, "<u4")
        return pd.DataFrame({"part": table["part"][:1], "counts": [x.astype("<i8").tobytes()]})

    # tasks' parts are summed in groups first, so that no task gets those of all
    parts = both.filter("part >= 0").select("part", "at", "counts", F.pmod(F.spark_partition_id(), F.lit(32)).alias("g"))

    def partly(table):
        out = merge(table)
        x = np.frombuffer(out["counts"][0], "<i8")
        at = np.flatnonzero(x)
        return pd.DataFrame({"part": table["part"][:1], "at": [at.astype("<u2").tobytes()], "counts": [x[at].astype("<u4").tobytes()]})

    parts = parts.groupBy("part", "g").applyInPandas(partly, "part int, at binary, counts binary").groupBy("part").applyInPandas(merge, "part int, counts binary")
    total = np.zeros(WIDTH, np.int64)
    for r in parts.collect():  # WIDTH counters, whatever the input
        total[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], "<i8")
    return both.filter("part < 0").select("_row", F.col("_id").cast(kind).alias("_id"), "n", "node"), total


def prefixes(docs: DataFrame, text_col: str, order, chosen=None) -> DataFrame:
    """(node, n, l, pos, token) for the prefix n-grams that pass the filter; pos counts from 1 in the common order."""

    def run(batches):
        for b in batches:
            seen, rows = set(), []
            for s in sets_of(b["_t"].tolist()):
                node = node_of(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    p, l = order.value.prefix(s)
                    at = np.arange(len(p)) if chosen is None else np.flatnonzero(passing(chosen.value, p))
                    if len(at):
                        rows.append((node, len(s), l, at.astype(np.int32) + 1, p[at].view(np.int64)))
            if rows:
                yield pd.DataFrame(rows, columns=["node", "n", "l", "pos", "token"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    out = texts.mapInPandas(run, "node long, n long, l int, pos array<int>, token array<long>")
    if chosen is None:
        return out.select(F.explode("token").alias("token"))
    return out.select("node", "n", "l", F.explode(F.arrays_zip("pos", "token")).alias("e")).select("node", "n", "l", "e.pos", "e.token")


def verified(docs: DataFrame, text_col: str, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar."""
    pairs = stored(pairs, f"{name}-pairs")
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), f"{name}-nodes")
    chosen = key_filter(nodes, nodes.count())

    def run(batches):
        for b in batches:
            rows = {}
            sets = sets_of(b["_t"].tolist())
            ids = np.array([node_of(s) for s in sets], np.int64)
            for k in np.flatnonzero(passing(chosen.value, ids.view(np.uint64))).tolist():
                rows[int(ids[k])] = sets[k].tobytes()
            if rows:
                yield pd.DataFrame({"key": list(rows), "s": list(rows.values())})

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    sets = texts.mapInPandas(run, "key long, s binary").join(nodes, "key", "left_semi").dropDuplicates(["key"])
    sets = stored(sets, f"{name}-sets")

    def judge(batches):
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield b.loc[keep, ["a", "b"]]

    a, b = sets.select(F.col("key").alias("a"), F.col("s").alias("x")), sets.select(F.col("key").alias("b"), F.col("s").alias("y"))
    return stored(pairs.join(b, "b").join(a, "a").select("a", "b", "x", "y").mapInPandas(judge, "a long, b long"), f"{name}-links")


def alike(n, m):
    """Sizes that a similar pair can have."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def overlap(n, m):
    """Least n-grams that similar sets of n and m share."""
    return F.ceil((n + m) * PERCENT / (100 + PERCENT))


def least_shared(n, l, m, k):
    """How many n-grams a pair must share at the beginnings of its sets: as many as asked for by MOST_L, if both prefixes
    are long enough for the overlap of sets of these sizes (they are for the smaller of l and k)."""
    o = overlap(n, m)
    return F.least(F.lit(MOST_L), o - F.ceil(n * PERCENT / 100) + l, o - F.ceil(m * PERCENT / 100) + k)


def early(n, i, l, m, j, k):
    """Whether an n-gram at places i and j counts for that: of sets that share o, the first c shared ones stand among the
    first n - o + c and m - o + c."""
    o, c = overlap(n, m), least_shared(n, l, m, k)
    return (i <= n - o + c) & (j <= m - o + c)


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id that can be reached by links)."""
    spark = session_of(docs)
    rows, counts = sketched(docs, id_col, text_col)
    order = spark.sparkContext.broadcast(Order(counts))
    tokens = prefixes(docs, text_col, order)
    keys = stored(tokens.groupBy(F.col("token").alias("key")).count().filter("count > 1").select("key"), "ngram-keys")
    bits = key_filter(keys, keys.count())
    met = prefixes(docs, text_col, order, bits).distinct()
    # the representative of an n-gram is the node in which the fewest rarer ones come before it; of several the one with
    # the smallest bits, so that n-grams of the same nodes have the same representative
    first_of = F.shiftleft(F.col("pos").cast("long"), 32) + F.shiftrightunsigned("node", 32)
    best = [F.min_by(x, first_of).alias(y) for x, y in (("node", "p"), ("n", "m"), ("l", "k"), ("pos", "j"))]
    pivots = met.groupBy("token").agg(*best, F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").drop("lo", "hi")
    shared = stored(met.join(pivots, "token"), "ngram-shared")
    sizes = rows.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("_id").alias("least"))
    sides = [F.col(c) for c in ("n", "pos", "l", "m", "j", "k")]
    stars = shared.filter("node != p").filter(alike(F.col("n"), F.col("m")) & early(*sides))
    asked = least_shared(F.col("n"), F.col("l"), F.col("m"), F.col("k"))
    stars = stars.groupBy("node", "p").agg(F.count("*").alias("c"), F.first(asked).alias("asked")).filter("c >= asked")
    # a node tries the representatives that it shares most with
    near = Window.partitionBy("node").orderBy(F.desc("c"), "p")
    stars = stars.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= STARS)
    stars = stored(stars.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct(), "ngram-stars")
    first = verified(docs, text_col, stars, "ngram-star")
    rest = left_pairs(shared.select("token", "node", "n", "l", "pos"), components(first, "ngram-roots"))
    second = verified(docs, text_col, rest.join(stars, ["a", "b"], "left_anti"), "ngram-rest")
    roots = components(first.unionByName(second), "ngram-roots")
    least = sizes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = least.join(ids, "root").select("node", "component_id")
    out = rows.join(ids, "node", "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


def left_pairs(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share enough of their prefixes, each once.

    The c-th n-gram that similar sets of n and m share stands among the first n - o + c and m - o + c (o: overlap()). A
    node further back in an n-gram than that allows with the smallest of those who have it leaves it, and the n-grams that
    only one component is left with go. A pair is made where the n-gram is its c-th, c being what least_shared() asks for:
    the lists of those before it have c - 1 in common.
    """
    at = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = [F.min("root").alias("r"), F.max("root").alias("s")]
    split = at.groupBy("token").agg(*several, F.min("n").alias("least_n")).filter("r < s").select("token", "least_n")
    n = F.col("n")
    room = n - overlap(n, F.greatest("least_n", F.ceil(n * PERCENT / 100)))
    left = stored(at.join(split, "token").filter(F.col("pos") <= room + MOST_L).drop("least_n"), "ngram-left")
    split = left.groupBy("token").agg(*several).filter("r < s").select("token")
    own = [F.first(c).alias(c) for c in ("n", "l", "root")]
    listed = left.join(split, "token", "left_semi").groupBy("node").agg(*own, F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("seen"))
    each = listed.select("node", "n", "l", "root", "seen", F.posexplode("seen").alias("i", "e"))
    each = each.select("node", "n", "l", "root", F.col("e.token").alias("token"), F.col("e.pos").alias("pos"), F.expr("slice(seen.token, 1, i)").alias("before"))
    a, b = (each.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "l", "root", "pos", "before"))) for x in "ab")
    sides = [F.col(c) for c in ("n_a", "pos_a", "l_a", "n_b", "pos_b", "l_b")]
    asked = least_shared(*(F.col(c) for c in ("n_a", "l_a", "n_b", "l_b")))
    met = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & alike(F.col("n_a"), F.col("n_b")) & early(*sides)
    met = met & (F.size(F.array_intersect("before_a", "before_b")) == asked - 1)
    return a.join(b, (a["token"] == b["token"]) & met).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not linked, by however many links, with one of a smaller id; with all their columns."""
    gone = linked(docs, id_col, text_col).filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return without_ids(docs, stored(gone, "ngram-gone"), id_col)
