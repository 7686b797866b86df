"""Places of photos: nearest neighbours, votes, dispersion, consensus."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions.text import plain
from tracelens.operators.shared import stored

EARTH_KM, SPREAD_KM, LEAST_LOCATED = 6371.0, 300.0, 3
HIGH, HIGH_PHOTOS, MODERATE, MODERATE_PHOTOS = 0.8, 2, 0.6, 4
#: Queries that go to all tasks at once; more are taken in blocks. Similarities that a task holds at once.
BLOCK, TILE = 20_000, 4_000_000


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column, eps: float = 1e-8) -> Column:
    size = F.sqrt(dot(v, v)) + eps
    return F.transform(v, lambda x: x.cast("double") / size)


def best_of(new: np.ndarray, vec: np.ndarray, sims: np.ndarray, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best k of each row of new similarities (to vec) and the k held so far; of equals those of the smallest vec_id."""
    rows, k = sims.shape
    every = np.concatenate([sims, new], axis=1)
    least = -np.partition(-every, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero(every >= least[:, None])  # those of the k-th similarity all count
    s, v = every[row, col], np.where(col < k, vecs[row, np.minimum(col, k - 1)], vec[np.maximum(col - k, 0)])
    order = np.lexsort((v, -s, row))
    row, s, v = row[order], s[order], v[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return s[keep].reshape(rows, k), v[keep].reshape(rows, k)


def nearest(queries: DataFrame, index: DataFrame, k: int = 15, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k index rows with the largest inner product, the smallest vec_id of equals.
    digits: similarities that are equal to so many decimals are equal (those of equal vectors may differ in their last bits).

    The queries are a stated set: they go to the tasks in blocks, each task keeps k rows of its part of the index for each
    query, and the parts' bests are ranked again. The index is read once a block and never moves.
    """
    spark, out, held = index.sparkSession, None, []

    def against(rows):
        ids = [r[0] for r in rows]
        shared = spark.sparkContext.broadcast(np.array([r[1] for r in rows], np.float64))

        def run(batches):
            q = shared.value
            sims, vecs = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
            for b in batches:
                m, vec = np.stack(b["embedding"].to_numpy()).astype(np.float64), b["vec_id"].to_numpy()
                step = max(1, TILE // (len(b) + k))
                for i in range(0, len(q), step):
                    new = q[i : i + step] @ m.T
                    s, v = best_of(new if digits is None else new.round(digits), vec, sims[i : i + step], vecs[i : i + step])
                    sims[i : i + step], vecs[i : i + step] = s, v
            at = np.flatnonzero(sims.reshape(-1) > -np.inf)
            if len(at):
                yield pd.DataFrame({"query_id": np.repeat(ids, k)[at], "vec_id": vecs.reshape(-1)[at], "similarity": sims.reshape(-1)[at]})

        return index.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, similarity double")

    for r in queries.select("query_id", "embedding").toLocalIterator():
        held.append(r)
        if len(held) == block:
            out = against(held) if out is None else out.unionByName(against(held))
            held = []
    if held or out is None:
        found = against(held) if held else spark.createDataFrame([], "query_id long, vec_id long, similarity double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def voted(neighbours: DataFrame, k: int) -> DataFrame:
    """query_id, region, votes, confidence, lat, lon, mean_similarity, spread_km, representative.

    neighbours: query_id, rank, similarity, region, lat, lon. The region with the most votes wins, of equal ones that of
    the nearest neighbour; the place is the mean of its voters; the spread is that of all neighbours around it.
    """
    n = neighbours.withColumn("region", F.coalesce("region", F.lit("desconocido")))
    votes = n.groupBy("query_id", "region").agg(F.count("*").alias("votes"), F.min("rank").alias("_r"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    win = votes.groupBy("query_id").agg(F.max(F.struct("votes", -F.col("_r"), "region", "lat", "lon")).alias("b")).select("query_id", "b.region", "b.votes", "b.lat", "b.lon")
    far = n.select("query_id", "similarity", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).join(win, "query_id")
    far = far.withColumn("_km", haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    out = far.groupBy("query_id", "region", "votes", "lat", "lon").agg(F.avg("similarity").alias("mean_similarity"), F.avg("_km").alias("_spread"), F.count("_km").alias("_located"))
    out = out.withColumn("spread_km", F.when(F.col("_located") >= LEAST_LOCATED, F.col("_spread")))
    return out.select(
        "query_id", "region", "votes", (F.col("votes") / k).alias("confidence"), "lat", "lon", "mean_similarity", "spread_km",
        (F.coalesce("spread_km", F.lit(0.0)) <= SPREAD_KM).alias("representative"),
    )


def in_cells(df: DataFrame, level: int, around: bool = False) -> DataFrame:
    """df (_lat, _lon) with the cell of each row in a grid of 2**level columns around the earth; around: once for each of the cells
    beside it, too."""
    size, columns = 360.0 / 2**level, 2**level
    x = F.pmod(F.floor((F.col("_lon") + 180) / size), F.lit(columns)).cast("long")
    y = F.floor((F.col("_lat") + 90) / size).cast("long")
    if not around:
        return df.withColumn("_cell", F.struct(x, y))
    beside = F.array(*(F.struct(F.pmod(x + i, F.lit(columns)), y + j) for j in (-1, 0, 1) for i in (-1, 0, 1)))
    return df.withColumn("_cell", F.explode(F.array_distinct(beside)))


def safe_km(lat: Column, level: int) -> Column:
    """All that is nearer than this to a place at `lat` lies in its cell or one beside it: a cell's height, or the way to the meridian a cell's width away."""
    width = math.radians(min(360.0 / 2**level, 90.0))
    return EARTH_KM * F.least(F.lit(width), F.asin(F.cos(F.radians(lat)) * math.sin(width))) * (1 - 1e-9)


def nearest_place(points: DataFrame, places: DataFrame, start: int | None = None) -> DataFrame:
    """point_id, region, km: of each point the place with the smallest distance, the first name of equals; a point or place
    without coordinates is infinitely far.

    Points meet the places of their own cell of a grid and of those beside it. Who finds one there that is nearer than anything outside can be is done, the others
    go on in a grid of cells of twice the size. The first grid (2**start columns) has about a place a cell, so a point is compared with a few places,
    and only points far from all of them reach the coarse grids. Points and places that share their coordinates are compared once.
    """
    p = points.select("point_id", F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"))
    where = F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    spots = places.select("region", F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon")).groupBy("_lat", "_lon").agg(F.min("region").alias("region"))
    spots = stored(spots, "places")
    n = spots.filter(where).count()
    level = start if start is not None else min(20, 1 + math.ceil(math.log(max(n, 1), 4)))
    left, found = p.filter(where).select("_lat", "_lon").distinct(), []
    while n:
        here = in_cells(spots.filter(where), level).select("_cell", "region", F.col("_lat").alias("_plat"), F.col("_lon").alias("_plon"))
        near = in_cells(left, level, around=True).join(here, "_cell")
        km = haversine_km(F.col("_lat"), F.col("_lon"), F.col("_plat"), F.col("_plon"))
        best = near.groupBy("_lat", "_lon").agg(F.min(F.struct(km.alias("km"), "region")).alias("b"))
        best = stored(left.join(best, ["_lat", "_lon"], "left"), "nearest")
        done = F.col("b.km") < safe_km(F.col("_lat"), level) if level > 1 else F.col("b").isNotNull()
        found.append(best.filter(F.coalesce(done, F.lit(False))))
        left = best.filter(~F.coalesce(done, F.lit(False))).select("_lat", "_lon")
        if level <= 1 or left.isEmpty():  # two columns: all cells are beside each other
            break
        level -= 1
    far = F.struct(F.lit(float("inf")).alias("km"), F.lit(spots.agg(F.min("region")).first()[0]).cast("string").alias("region"))
    if not found:
        return p.select("point_id", far["region"].alias("region"), far["km"].alias("km")) if not spots.isEmpty() else p.select("point_id", F.lit(None).cast("string").alias("region"), F.lit(None).cast("double").alias("km")).limit(0)
    all_found = reduce(DataFrame.unionByName, found)
    out = p.join(all_found, ["_lat", "_lon"], "left").withColumn("b", F.coalesce("b", far))
    return out.select("point_id", "b.region", "b.km")


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as a number; south and west are negative."""
    return (degrees + minutes / 60 + seconds / 3600) * F.when(ref.isin("S", "W"), -1).otherwise(1)


def resolved(regions: DataFrame, places: DataFrame, aliases: DataFrame, provinces: DataFrame, raw: str = "raw") -> DataFrame:
    """regions with level and key of the name in `raw`, whatever its case and accents: a province, else a community by any of its names (its
    province, if it has one only); null where it is neither."""
    p = provinces.select(F.col("key").alias("_p"))
    only = places.filter("provinces_in_community = 1").select(F.col("community").alias("_oc"), F.col("province").alias("_only"))
    r = regions.withColumn("_n", F.trim(plain(F.col(raw)))).join(p, F.col("_n") == F.col("_p"), "left")
    r = r.join(aliases.select(F.col("alias").alias("_a"), F.col("community").alias("_c")), F.col("_n") == F.col("_a"), "left").join(only, F.col("_c") == F.col("_oc"), "left")
    level = F.when(F.coalesce("_p", "_only").isNotNull(), "provincia").when(F.col("_c").isNotNull(), "comunidad_autonoma")
    return r.withColumns({"level": level, "key": F.coalesce("_p", "_only", "_c"), "community": F.col("_c")}).drop("_n", "_p", "_a", "_c", "_oc", "_only")


def consensus(estimates: DataFrame, places: DataFrame, aliases: DataFrame, provinces: DataFrame, travel: DataFrame | None = None) -> DataFrame:
    """profile_id, level, key, n_photos, confidence, evidence: the region in which enough photos agree.

    estimates: profile_id, seq, permalink, region (normalised), confidence, representative, is_avatar.
    """
    e = estimates.filter("representative AND NOT is_avatar")
    if travel is not None:
        e = e.join(travel, ["profile_id", "permalink"], "left_anti")
    e = e.join(provinces.select(F.col("key").alias("_p")), F.col("region") == F.col("_p"), "left")
    e = e.join(aliases.select("alias", F.col("community").alias("_c")), F.col("region") == F.col("alias"), "left")
    only = places.filter("provinces_in_community = 1").select(F.col("community").alias("_oc"), F.col("province").alias("_only"))
    e = e.join(only, F.col("_c") == F.col("_oc"), "left")
    e = e.withColumn("_province", F.coalesce("_p", "_only"))
    e = e.join(places.select(F.col("province").alias("_pp"), F.col("community").alias("_pc")), F.col("_province") == F.col("_pp"), "left")
    e = e.withColumn("community", F.coalesce("_pc", "_c")).filter("community IS NOT NULL")
    some = F.col("confidence") > MODERATE
    g = e.groupBy("profile_id", "community").agg(
        F.count_if(F.col("confidence") > HIGH).alias("high"),
        F.count_if(some).alias("n_photos"),
        F.avg(F.when(some, F.col("confidence"))).alias("confidence"),
        F.count_distinct(F.when(some, F.col("_province"))).alias("_n"),
        F.min(F.when(some, F.col("_province"))).alias("_one"),
        F.min(F.when(some, F.col("seq"))).alias("_first"),
        F.transform(F.array_sort(F.collect_list(F.when(some, F.struct("seq", "permalink")))), lambda x: x["permalink"]).alias("evidence"),
    )
    g = g.filter((F.col("high") >= HIGH_PHOTOS) | (F.col("n_photos") >= MODERATE_PHOTOS))
    w = Window.partitionBy("profile_id").orderBy(F.desc("n_photos"), F.desc("confidence"), "_first")
    best = g.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    single = F.col("_n") == 1
    return best.select("profile_id", F.when(single, "provincia").otherwise("comunidad_autonoma").alias("level"), F.when(single, F.col("_one")).otherwise(F.col("community")).alias("key"), "n_photos", "confidence", "evidence")
