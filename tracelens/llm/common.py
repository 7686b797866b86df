"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts can be long, so batches are short.
ARROW_ROWS = 512



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_of(df: DataFrame) -> SparkSession:
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "/tmp/checkpoints"


_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and lost executors cost a read.
    The tables stay until discard(), or the end of scratch(), as results are read from them lazily."""
    spark = session_of(df)
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, with its scheme."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tracelens-{name}-{uuid.uuid4().hex}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    _written.append(out)
    return out


def file_system(uri: str):
    """(pyarrow file system, path in it) of a place in the shared folder, for tasks that write or seek in files."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def discard(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that this process has stored; call it when the results that rest on them are written."""
    while len(_written) > since:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing rests on any more."""
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        known = [p for p in _written if p.rstrip("/").endswith(folder.rsplit("/", 1)[-1])]
        for p in known:  # only what this process has stored
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _written.remove(p)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Within, the shuffle files of a job are removed when it has ended, as what it made is stored. The setting is restored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables stored within are deleted at its end; what rests on them must be written before."""
    since = len(_written)
    try:
        yield
    finally:
        discard(spark, since)


def sized_broadcast(df: DataFrame, rows: int, width: int, most_bytes: int) -> DataFrame:
    """df with a broadcast hint if rows * width bytes fit the bound, else df as it is (a shuffled join)."""
    return F.broadcast(df) if rows * width <= most_bytes else df


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str, most_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs whose id (null is one, too) is not among the ids in the only column of gone, with all their columns."""
    name = f"_{uuid.uuid4().hex}"  # docs may have a column of any other name
    gone = sized_broadcast(gone.toDF(name), gone.count(), 16, most_bytes)
    return docs.join(gone, docs[id_col].eqNullSafe(gone[name]), "left_anti")


def salts(n, rows_each: int):
    """How many parts a group of n rows is split into."""
    return F.greatest(F.lit(1), F.ceil(n / F.lit(rows_each))).cast("int")


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: A-Z lower-cased, cut at blank and \\t \\n \\v \\f \\r (what bytes.split takes as white space)."""
    return (text or "").encode("utf-8", "replace").lower().split()


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Signs that a bare word sheds at its edges.
_SIGN = np.zeros(256, bool)
_SIGN[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
#: Bytes that are hashed at once: arrays of numbers for so many stay in a core's cache.
SEGMENT = 1 << 16


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            base = 0xD1342543DE82EF95
            for name, factor in (("up", base), ("down", pow(base, -1, 1 << 64))):
                table = np.full(n, factor, np.uint64)
                table[0] = 1
                setattr(cls, name, np.cumprod(table))
        return cls.up, cls.down


def _segment_hashes(x: np.ndarray, bare: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words in bytes that begin and end between words: differences of one running sum."""
    blank = _BLANK[x]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    s, e = start, end
    if bare and len(start):
        signed = np.flatnonzero(_SIGN[x[start]] | _SIGN[x[end - 1]])  # all others are bare
        core = np.flatnonzero(~(blank | _SIGN[x]))
        i, j = np.searchsorted(core, s[signed]), np.searchsorted(core, e[signed]) - 1
        some = i <= j
        a = s[signed]
        s, e = s.copy(), e.copy()
        s[signed], e[signed] = np.where(some, core[np.minimum(i, len(core) - 1)] if len(core) else a, a), np.where(some, core[j] + 1 if len(core) else a, a)
    up, down = _Powers.to(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((_LOWER[x].astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=total[1:])
    return start, mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _MULT)


def word_hashes(texts: list[str | None], bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """uint64 hashes of the words of all texts, one after the other, and the number of words of each.

    bare: words without the signs at their edges (a word of signs alone is an empty word).
    """
    blobs = [(t or "").encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(b) + 1 for b in blobs], np.int64)
    x = np.frombuffer(b" ".join(blobs), np.uint8)
    starts, hashes, a = [], [], 0
    while a < len(x):
        z = min(len(x), a + SEGMENT)
        while z < len(x) and not _BLANK[x[z]]:  # to the end of the word
            step = np.flatnonzero(_BLANK[x[z : z + 4096]])
            z += int(step[0]) if len(step) else min(4096, len(x) - z)
        at, h = _segment_hashes(x[a:z], bare)
        starts.append(at + a)
        hashes.append(h)
        a = z
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    who = np.searchsorted(np.cumsum(sizes), np.concatenate(starts), "right")
    return np.concatenate(hashes), np.bincount(who, minlength=len(texts))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive uint64 hashes of the n consecutive values that start at each place."""
    h = h.view(np.uint64)
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= _MULT
        out += h[i : len(h) - n + 1 + i]
    return mixed(out)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node that can be reached.

    Every turn points each node to its smallest neighbour, follows the pointers to their ends and goes on with the edges
    between different ends, all as joins over tables in the shared folder; a turn at least halves the nodes.
    """
    e = stored(edges.select("a", "b").filter("a != b").distinct(), name)
    turns = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        while True:
            y = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            up = stored(up.join(y, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), name)
            if up.filter("moved").isEmpty():
                break
            up = up.drop("moved")
        up = up.drop("moved")
        turns.append(up)
        a, b = (up.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        e = stored(e.join(a, "a").join(b, "b").filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), name)
    if not turns:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = turns[0]
    for up in turns[1:]:
        y = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(y, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return stored(out, name) if len(turns) > 1 else out


def doc_places(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: the places where n values begin that lie within one text, their text and their place in it."""
    first = np.cumsum(counts) - counts
    fit = np.maximum(counts - n + 1, 0)
    who = np.repeat(np.arange(len(counts)), fit)
    within = np.arange(int(fit.sum())) - np.repeat(np.cumsum(fit) - fit, fit)
    return first[who] + within, who, within


def passing(bits: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """True for keys whose low bits are set in a key_filter: it never misses a key and passes about 1 in 16 others."""
    if bits is None:
        return np.ones(len(keys), bool)
    at = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def key_filter(keys: DataFrame, n: int, most_bytes: int = 64 << 20):
    """A broadcast bitmap of the long column `key` (n rows) for passing(). It has 16 bits a key, fewer beyond most_bytes, so
    that other keys pass more and more often: with k keys in b bits a share of 1 - exp(-k / b). None, which passes all,
    where a bit would have two keys: what passes is joined with the keys in any case, so only the rows that travel differ.
    Parts of the filter are built by Spark and no part holds more than 2**19 bits."""
    spark = session_of(keys)
    size = min(1 << max(16, (n * 16 - 1).bit_length()) if n else 1 << 16, 1 << (most_bytes * 8).bit_length() - 1)
    if n > 2 * size:
        return spark.sparkContext.broadcast(None)
    part = min(size, 1 << 19)

    def run(table):
        import pandas as pd

        at = table["key"].to_numpy().astype(np.int64).view(np.uint64) & np.uint64(size - 1)
        bits = np.zeros(part, np.uint8)
        bits[(at & np.uint64(part - 1)).astype(np.int64)] = 1
        return pd.DataFrame({"part": [int(at[0]) // part], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    parts = keys.withColumn("part", F.expr(f"shiftright(key & {size - 1}L, {part.bit_length() - 1})")).groupBy("part").applyInPandas(run, "part long, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"] * part // 8 : (r["part"] + 1) * part // 8] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(out)


def sliding(x: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """best of every run of `width` values, by doubling."""
    have = 1
    out = x
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return best(out[:-rest], out[rest:]) if rest else out


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Places whose value is the smallest of some run of `window` values that holds them; equal smallest values all count.

    Which places of a run are chosen for it depends on the run alone, so equal runs choose equal places.
    Fewer values than `window` are one run.
    """
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    window = min(window, n)
    low = sliding(h, window)
    edge = np.zeros(window - 1, h.dtype)
    return np.flatnonzero(sliding(np.concatenate([edge, low, edge]), window, np.maximum) == h)
