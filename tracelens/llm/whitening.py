"""Whitening of vectors by an exact scatter matrix in residue numbers.

Entries become integers x = floor(scale * c) + shift. Their scatter, the sums and the count are one matrix product of the rows
(1, x) with themselves, which doubles can't hold exactly; so each task multiplies residues modulo several primes below
2**21 (blocks of 2048 rows: every sum stays below 2**53, so the products of doubles are exact), the residues of all tasks are
added by element in Spark, and Chinese remaindering gives the integers. Covariances follow in whole numbers,
(n * XX - S * S) / n**2, and are rounded once; double eigenvectors of that small matrix whiten the rows. As many primes are taken as the
count and the largest entry ask for. The driver holds d by d numbers, d the dimension, and nothing that grows with the rows.

Defined results: rows whose vector is null, is empty or holds null or non-finite entries go; so do those of another
dimension than most rows have (of equally frequent ones the larger stays); floor(scale * c) is cut off at 2**62 either way;
components whose eigenvalue is 0 to double precision (d * 2**-52 of the largest) can't be whitened and aren't returned,
so vectors that are all equal give no rows; a deviation beyond 2**63 - 1 is null; null ids stay null; rows that repeat count
and are returned as often as they stand there; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import session_of

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Primes stay below 2**PRIME_BITS; 2**(53 - 2 * PRIME_BITS) rows are multiplied at once.
PRIME_BITS = 21
ROWS_AT_ONCE = 1 << 53 - 2 * PRIME_BITS
LARGEST = float(1 << 62)


def primes() -> Iterator[int]:
    """The primes below 2**PRIME_BITS, the largest first."""
    return (p for p in range((1 << PRIME_BITS) - 1, 2, -2) if all(p % q for q in range(3, math.isqrt(p) + 1, 2)))


def enough_primes(bound: int) -> list[int]:
    """Primes whose product is over twice the bound."""
    out, product = [], 1
    for p in primes():
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    return out


def whole_numbers(residues: np.ndarray, moduli: list[int]) -> list[int]:
    """Chinese remaindering: the numbers, of either sign, with these residues (a row a prime)."""
    product = math.prod(moduli)
    parts = [product // p * pow(product // p, -1, p) for p in moduli]
    found = [sum(int(r) * part for r, part in zip(column, parts, strict=True)) % product for column in residues.T]
    return [x - product if x > product // 2 else x for x in found]


def residue_scatter(x: np.ndarray, moduli: list[int]) -> np.ndarray:
    """(primes, d, d): x.T @ x modulo each prime, exactly."""
    out = np.zeros((len(moduli), x.shape[1], x.shape[1]), np.int64)
    for k, p in enumerate(moduli):
        for i in range(0, len(x), ROWS_AT_ONCE):
            r = (x[i : i + ROWS_AT_ONCE] % p).astype(np.float64)
            out[k] = (out[k] + (r.T @ r).astype(np.int64)) % p
    return out


def sound_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows without null or non-finite entries, their lengths, where their entries begin, all entries as doubles)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(flat)], minlength=len(sizes)) if len(flat) else np.zeros(len(sizes))
    rows = np.flatnonzero((sizes > 0) & (bad == 0))
    return rows, sizes[rows], begins[rows], flat


def integers(column: pa.Array, d: int, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their x) of the sound rows of dimension d."""
    rows, sizes, begins, flat = sound_rows(column)
    rows, begins = rows[sizes == d], begins[sizes == d]
    c = flat[begins[:, None] + np.arange(d)]
    return rows, np.clip(np.floor(c * scale), -LARGEST, LARGEST).astype(np.int64) + shift


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, pa.Array]:
    """(x less the mean, as doubles; exact sums over dimensions of (n * x - S)**2)."""
    top = max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
    if n * top + max(map(abs, sums)) < 1 << 62:
        off = n * x - np.array(sums, np.int64)
    else:
        off = x.astype(object) * n - np.array(sums, object)
    widest = int(abs(off).max()) if off.size else 0
    if widest**2 * off.shape[1] < 1 << 63:
        total = pa.array((off.astype(np.int64) ** 2).sum(axis=1), pa.int64())
    else:
        total = pa.array([v if v < 1 << 63 else None for v in (sum(int(o) ** 2 for o in row) for row in off)], pa.int64())
    return (off / n).astype(np.float64), total


@dataclasses.dataclass
class Whitening:
    """What was fitted: count, sums, the exact scatter, eigenvalues, the projection (d, components) and the trace."""

    n: int
    d: int
    sums: list[int]
    scatter: list[list[int]]
    values: np.ndarray
    project: np.ndarray
    trace: float
    scale: int = SCALE
    shift: int = SHIFT


def bounds(vectors: DataFrame, vector_col: str, scale: int, shift: int) -> tuple[int, int, int]:
    """(dimension, rows, largest absolute x); zeros without rows."""

    def run(batches):
        for b in batches:
            rows, sizes, begins, flat = sound_rows(b.column("v"))
            if len(rows):
                x = np.abs(np.clip(np.floor(flat * scale), -LARGEST, LARGEST) + shift)
                x[~np.isfinite(x)] = 0  # of a row that goes
                d = np.unique(sizes)
                yield pa.RecordBatch.from_pydict({"d": d, "n": [int((sizes == k).sum()) for k in d], "top": np.full(len(d), x.max())}, pa.schema([("d", pa.int64()), ("n", pa.int64()), ("top", pa.float64())]))

    found = vectors.select(F.col(vector_col).alias("v")).mapInArrow(run, "d long, n long, top double").groupBy("d").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    best = found.agg(F.max(F.struct("n", "d", "top")).alias("m")).first()["m"]
    return (best["d"], best["n"], int(best["top"] * (1 + 2.0**-40)) + 1) if best else (0, 0, 0)


def summed(parts: DataFrame) -> dict[tuple[int, int], float]:
    """(k, at) to the sum of value; parts have as many of them as matrices have numbers, whatever the rows are."""
    return {(r["k"], r["at"]): r["value"] for r in parts.groupBy("k", "at").agg(F.sum("value").alias("value")).toLocalIterator()}


def fitted(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Fit on all sound rows of a table; None without any."""
    session_of(vectors)
    d, rows, top = bounds(vectors, vector_col, scale, shift)
    if not rows:
        return None
    moduli = enough_primes(rows * max(top, 1) ** 2)
    at = np.flatnonzero(np.triu(np.ones((d + 1, d + 1), bool)))

    def run(batches):
        total = None
        for b in batches:
            _, x = integers(b.column("v"), d, scale, shift)
            if len(x):
                part = residue_scatter(np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1), moduli)
                total = part if total is None else (total + part) % np.array(moduli)[:, None, None]
        if total is not None:
            upper = total.reshape(len(moduli), -1)[:, at]
            yield pa.RecordBatch.from_pydict({"k": np.repeat(np.arange(len(moduli)), len(at)), "at": np.tile(at, len(moduli)), "value": upper.ravel()})

    sums = summed(vectors.select(F.col(vector_col).alias("v")).mapInArrow(run, "k long, at long, value long"))
    residues = np.array([[sums[k, i] % p for i in at.tolist()] for k, p in enumerate(moduli)])
    whole = np.zeros((d + 1) ** 2, object)
    whole[at] = whole_numbers(residues, moduli)
    whole = whole.reshape(d + 1, d + 1)
    whole = np.triu(whole) + np.triu(whole, 1).T
    n, s = int(whole[0, 0]), [int(v) for v in whole[0, 1:]]
    scatter = [[int(v) for v in row[1:]] for row in whole[1:]]
    cov = np.array([[(n * scatter[i][j] - s[i] * s[j]) / n**2 for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    keep = min(components, int((values > d * 2.0**-52 * max(values[0], 0)).sum()))
    trace = sum(n * scatter[i][i] - s[i] ** 2 for i in range(d)) / n**2
    return Whitening(n, d, s, scatter, values[:keep], axes[:, :keep] / np.sqrt(values[:keep]), trace, scale, shift)


def identity_error(vectors: DataFrame, w: Whitening, vector_col: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened rows, less the identity. Rows are centred before they are multiplied."""
    keep = w.project.shape[1]

    def run(batches):
        total, line = np.zeros((keep, keep)), np.zeros(keep)
        for b in batches:
            _, x = integers(b.column("v"), w.d, w.scale, w.shift)
            if len(x):
                y = deviations(x, w.n, w.sums)[0] @ w.project
                total += y.T @ y
                line += y.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"k": np.repeat([0, 1], [keep * keep, keep]), "at": np.concatenate([np.arange(keep * keep), np.arange(keep)]), "value": np.concatenate([total.ravel(), line])})

    sums = summed(vectors.select(F.col(vector_col).alias("v")).mapInArrow(run, "k long, at long, value double"))
    mean = np.array([sums[1, i] for i in range(keep)]) / w.n
    cov = np.array([sums[0, i] for i in range(keep * keep)]).reshape(keep, keep) / w.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(keep)).max())


def transformed(vectors: DataFrame, w: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, deviation, whitened: an array of the components of each sound row."""
    session_of(vectors)

    def run(batches):
        for b in batches:
            rows, x = integers(b.column("v"), w.d, w.scale, w.shift)
            if len(rows):
                centred, total = deviations(x, w.n, w.sums)
                y = centred @ w.project
                lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), y.ravel())
                yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(rows)), total, lists], ["_id", "deviation", "whitened"])

    out = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("v")).mapInArrow(run, f"_id {dict(vectors.dtypes)[id_col]}, deviation long, whitened array<double>")
    return out.withColumnRenamed("_id", id_col)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error: a row for each sound row and component."""
    w = fitted(vectors, vector_col, components)
    if w is None or not w.project.shape[1]:
        schema = f"{id_col} {dict(vectors.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, w, vector_col)
    share = F.array(*(F.lit(float(v / w.trace)) for v in w.values))
    each = transformed(vectors, w, id_col, vector_col).select(id_col, "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        id_col, (F.col("_at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
