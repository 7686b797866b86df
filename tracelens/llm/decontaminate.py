"""Benchmark items in training texts: word n-grams as seeds, Smith-Waterman alignment as the judge.

The benchmark is the query set: it is taken in blocks of at most BLOCK_ITEMS items and BLOCK_BYTES bytes, each block's seeds
go to all tasks, and all documents are read against each block. Every seed of an item counts, however many documents hold it, so that a
verdict on a document doesn't depend on the others: around each hit that shares enough words with the item, the window's
words are aligned with the item's. A copy that shares no n-gram with its item isn't found; with n=1 every shared word
starts an alignment, and as a leak shares words with its item, none is missed.

Scores: +2 for equal words, -1 for unequal ones and for gaps, divided by twice the item's words; a score from THRESHOLD
on is a leak. Words are A-Z lower-cased stretches between blanks and \\t\\n\\v\\f\\r, without signs at their edges.

Defined results: null and empty texts and items without words match nothing; items that repeat all match; of several
places of one item in a document the best is returned (ties: the first); empty tables give an empty result; other
columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import doc_places, ngram_hashes, session_of, stored, without_ids, word_hashes, words_of

N, THRESHOLD = 4, 0.5
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1


def seeds_of(text: str | None, n: int = N) -> np.ndarray:
    """Hashes of an item's n-grams; of a shorter item, of all its words at once."""
    h, counts = word_hashes([text], bare=True)
    return ngram_hashes(h, min(n, int(counts[0]))) if len(h) else h


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment: score, begin and end in doc, begin and end in item."""
    m, n = len(item), len(doc)
    rows = np.zeros((m + 1, n + 1), np.int32)
    slope = np.arange(n + 1) * GAP
    for i in range(1, m + 1):
        s = np.where(doc == item[i - 1], MATCH, MISMATCH)
        best = np.maximum(rows[i - 1] + GAP, 0)
        best[1:] = np.maximum(best[1:], rows[i - 1, :-1] + s)
        rows[i] = np.maximum.accumulate(best - slope) + slope
    i, j = np.unravel_index(int(rows.argmax()), rows.shape)
    score, ends = int(rows[i, j]), (int(j), int(i))
    while i and j and rows[i, j] > 0:
        v = rows[i, j]
        if v == rows[i - 1, j - 1] + (MATCH if doc[j - 1] == item[i - 1] else MISMATCH):
            i, j = i - 1, j - 1
        elif v == rows[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, int(j), ends[0], int(i), ends[1]


class Index:
    """Seeds of a block of items, sorted, with the items that have each."""

    def __init__(self, items: list[tuple[str, str | None]], n: int = N):
        self.n = n
        self.ids = [i for i, _ in items]
        self.words = [word_hashes([t], bare=True)[0] for _, t in items]
        # short items have seeds of their own length
        self.lengths = sorted({min(n, len(w)) for w in self.words if len(w)})
        pairs = sorted({(int(s), k) for k, (_, t) in enumerate(items) for s in seeds_of(t, n).tolist()})
        self.seeds = np.array([s for s, _ in pairs], np.uint64)
        self.items = np.array([k for _, k in pairs], np.int64)
        self.unique = np.unique(self.seeds)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.unique & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, counts: np.ndarray):
        """(text, place, seed) of all seeds in texts laid end to end."""
        who, place, seed = [], [], []
        for n in self.lengths:
            at, w, p = doc_places(counts, n)
            g = ngram_hashes(h, n)
            if not len(at):
                continue
            g = g[at]
            near = np.flatnonzero(self.bits[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
            near = near[np.isin(g[near], self.unique)]
            who.append(w[near])
            place.append(p[near])
            seed.append(g[near])
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(who), np.concatenate(place), np.concatenate(seed)

    def leaks(self, words: np.ndarray, places: np.ndarray, seeds: np.ndarray, threshold: float):
        """(item, score, begin, end, item begin, item end) of a text with these hits."""
        a, b = np.searchsorted(self.seeds, seeds), np.searchsorted(self.seeds, seeds, "right")
        k = np.repeat(np.arange(len(seeds)), b - a)
        items = self.items[np.repeat(a, b - a) + np.arange(len(k)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]
        at = places[k]
        order = np.lexsort((at, items))
        items, at = items[order], at[order]
        for item in np.unique(items).tolist():
            p, best = np.unique(at[items == item]), None
            size = len(self.words[item])
            i = 0
            while i < len(p):  # stretches of hits no further apart than the item is long
                j = i + 1
                while j < len(p) and p[j] - p[j - 1] <= size:
                    j += 1
                lo, hi = max(0, int(p[i]) - size), min(len(words), int(p[j - 1]) + size + self.n)
                # an alignment has at most as many equal words as words of the item occur
                if np.isin(self.words[item], words[lo:hi]).sum() >= threshold * size:
                    for c in range(lo, max(lo + 1, hi), 8 * size):  # long stretches in overlapping pieces
                        s, x, y, u, v = align(words[c : min(hi, c + 10 * size + self.n)], self.words[item])
                        if best is None or s > best[0]:
                            best = (s, c + x, c + y, u, v)
                i = j
            if best and best[0] >= threshold * MATCH * size:
                yield (item, best[0] / (MATCH * size), *best[1:])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, n: int = N) -> DataFrame:
    """id_col, item_col, score, start_word, end_word (in the document), item_start, item_end: one row per document row and item."""
    spark = session_of(docs)
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    # ids travel as text: as numbers beside nulls they would lose digits
    schema = "_id string, _item string, score double, start_word long, end_word long, item_start long, item_end long"
    out = None
    texts = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for items in blocks(texts, block_items, block_bytes):
        found = against(rows, items, schema, threshold, n)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumns({"_id": F.col("_id").cast(kind), "_item": F.col("_item").cast(item_kind)}).withColumnsRenamed({"_id": id_col, "_item": item_col})


def blocks(items: DataFrame, size: int, most_bytes: int):
    """The benchmark in blocks of items, streamed partition by partition to the driver; no more than a block is held. A block
    ends with its size-th item, or the one with which it reaches most_bytes."""
    held, n = [], 0
    for r in items.toLocalIterator():
        if words_of(r["t"]):
            held.append((r["i"], r["t"]))
            n += len(r["t"])
            if len(held) == size or n >= most_bytes:
                yield held
                held, n = [], 0
    if held:
        yield held


def against(rows: DataFrame, items: list, schema: str, threshold: float, n: int) -> DataFrame:
    chosen = rows.sparkSession.sparkContext.broadcast(Index(items, n))

    def run(batches):
        index = chosen.value
        for b in batches:
            h, counts = word_hashes(b["_t"].tolist(), bare=True)
            first = np.cumsum(counts) - counts
            who, place, seed = index.hits(h, counts)
            if not len(who):
                continue
            order = np.argsort(who, kind="stable")
            who, place, seed = who[order], place[order], seed[order]
            found, ids = [], b["_id"].tolist()
            texts, begins = np.unique(who, return_index=True)
            for t, i, j in zip(texts.tolist(), begins.tolist(), [*begins[1:].tolist(), len(who)], strict=True):
                words = h[first[t] : first[t] + counts[t]]
                found += [(ids[t], index.ids[k], *x) for k, *x in index.leaks(words, place[i:j], seed[i:j], threshold)]
            if found:
                yield pd.DataFrame(found, columns=["_id", "_item", "score", "start_word", "end_word", "item_start", "item_end"])

    return rows.mapInPandas(run, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item; rows with a null id are judged by their id like all others."""
    leaks = contaminated(docs, benchmark, threshold, id_col, text_col).select(id_col).distinct()
    return without_ids(docs, stored(leaks, "leaks"), id_col)
