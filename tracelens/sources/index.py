"""Building a vector index: one model a worker, unit vectors in parts, and what is known of each beside them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.operators.shared import file_system

PARTS = 16
#: Characters that a model gets at once (one text at least), so that what it holds beside them doesn't grow with the batch.
CHARS = 1 << 20
VECTORS = "vec_id long, embedding array<double>"


class LetterProjection:
    """A model that is small enough to check by hand: counts of a-z (A-Z alike), times a matrix of whole numbers."""

    def __init__(self, dimension: int = 16):
        i, j = np.arange(26)[:, None], np.arange(dimension)[None, :]
        self.matrix = ((7 * i + 13 * j + i * j) % 11 - 5).astype(np.float64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        raw = [t.encode() for t in texts]
        x = np.frombuffer(b"".join(raw), np.uint8) | 32
        row = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        letter = (x >= 97) & (x <= 122) & (np.frombuffer(b"".join(raw), np.uint8) < 128)
        counts = np.bincount(row[letter] * 26 + x[letter] - 97, minlength=26 * len(raw)).reshape(len(raw), 26)
        return counts @ self.matrix


def portions(texts: list, most: int) -> Iterator[slice]:
    """Consecutive parts of some texts, of `most` characters at most unless one text has more."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def embedded(items: DataFrame, model: Callable[[], Callable], input_col: str = "text", id_col: str = "vec_id") -> DataFrame:
    """(id_col, embedding): unit vectors of the items that the model can embed. The model is made once by each task and kept for all its
    batches; items whose input is null, or whose vector is all zeros, have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = model()
        for b in batches:
            ids, texts = b["_id"].to_numpy(), b["_in"].tolist()
            for part in portions(texts, CHARS):
                v = np.asarray(embed(texts[part]), np.float64)
                size = np.sqrt((v * v).sum(axis=1))
                keep = size > 0
                yield pd.DataFrame({"_id": ids[part][keep], "embedding": list(v[keep] / size[keep, None])})

    rows = items.filter(F.col(input_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(input_col).alias("_in"))
    return rows.mapInPandas(run, "_id long, embedding array<double>").withColumnRenamed("_id", id_col)


def build(items: DataFrame, path: str, model: Callable[[], Callable], files: DataFrame | None = None, columns: tuple[str, ...] = ("region", "lat", "lon"), parts: int = PARTS, input_col: str = "text") -> int:
    """Write an index of items (vec_id, input_col, columns): path/vectors in parts by id, path/sidecar (columns as CSV, of the rows
    that have a vector), path/about.json. files: (id) what has a file; others are left out. Returns the number of vectors."""
    if files is not None:
        items = items.join(files.select(F.col("id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    spark = items.sparkSession
    vectors = embedded(items, model, input_col).withColumn("part", F.pmod("vec_id", F.lit(parts)).cast("int"))
    vectors.repartition(parts, "part").write.partitionBy("part").parquet(f"{path}/vectors")
    known = spark.read.schema(VECTORS).parquet(f"{path}/vectors")
    items.select("vec_id", *columns).join(known.select("vec_id"), "vec_id", "left_semi").write.option("header", True).csv(f"{path}/sidecar")
    about = known.agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dimension")).first().asDict()
    where, base = file_system(path)
    with where.open_output_stream(f"{base}/about.json") as f:
        f.write(json.dumps(about | {"metric": "inner product", "parts": parts}).encode())
    return about["rows"]


def load(spark: SparkSession, path: str, columns: str = "region string, lat double, lon double") -> DataFrame:
    """vec_id, embedding and the sidecar's columns of an index; ValueError where it was not written to its end."""
    where, base = file_system(path)
    try:
        with where.open_input_stream(f"{base}/about.json") as f:
            about = json.loads(f.read())
    except FileNotFoundError:
        raise ValueError(f"no finished index at {path}") from None
    if not about["rows"]:
        return spark.createDataFrame([], f"{VECTORS}, {columns}")
    vectors = spark.read.schema(VECTORS).parquet(f"{path}/vectors")
    return vectors.join(spark.read.schema(f"vec_id long, {columns}").option("header", True).csv(f"{path}/sidecar"), "vec_id")
