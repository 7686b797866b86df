"""A byte-level convolutional network for document quality, in numpy.

Each byte has a learned vector; filters over 8 bytes move by 4 bytes; their largest answers within overlapping chunks
(two halves of 256 bytes each, moving by one half) are pooled; the largest and the mean of all chunks of a document go
into one probability. Every byte of a document is read. The network is fitted on the driver on a bounded sample of
labelled rows (TRAIN_ROWS, those with the smallest hash of the id, texts of at most TRAIN_CHARS, and of these as many as
fit into TRAIN_BYTES; of an id that repeats, one text), the scoring is spread.

Defined results: a null text counts as empty and gets a score; without labels of both kinds every score is the share of
label 1 (0.5 without any label); null labels don't count; of rows that repeat an id in labels, each label counts once; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.common import session_of, stored

WIDTH, STEP, HALF = 8, 4, 256
DIM, FILTERS = 8, 24
TRAIN_ROWS, TRAIN_CHARS, TRAIN_BYTES, EPOCHS = 4000, 65536, 64 << 20, 8
#: Bytes that are put through the filters at once.
PIECE = 1 << 20
THRESHOLD = 0.7


def padded(text: str | None) -> np.ndarray:
    """The text's bytes, with zeros up to a whole number of halves (at least one)."""
    b = (text or "").encode("utf-8", "replace")
    out = np.zeros(max(1, -(-len(b) // HALF)) * HALF, np.uint8)
    out[: len(b)] = np.frombuffer(b, np.uint8)
    return out


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.5, (256, DIM)),
            "conv": r.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": r.normal(0, 0.1, 2 * FILTERS),
            "out_bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def answers(self, b: np.ndarray, first: np.ndarray, ahead: np.ndarray | None = None) -> np.ndarray:
        """Filter answers at each step of whole halves: (halves, steps in a half, filters). first: the halves with which
        documents begin; the last step of a document would reach into the next one and doesn't count. ahead: what
        follows b, where b is a piece of a longer text."""
        after = np.zeros(WIDTH, np.uint8)
        if ahead is not None:
            after[: len(ahead)] = ahead[:WIDTH]
        e = self.p["emb"][np.concatenate([b, after])].reshape(-1)
        n, row = len(b) // WIDTH, WIDTH * DIM
        out = np.empty((n, WIDTH // STEP, FILTERS), e.dtype)
        for k in range(WIDTH // STEP):
            a = k * STEP * DIM
            out[:, k] = e[a : a + n * row].reshape(n, row) @ self.p["conv"]
        out = out.reshape(len(b) // HALF, HALF // STEP, FILTERS)
        ends = (np.append(first[1:], len(out)) if ahead is None else first[1:]) - 1
        out[ends, -1] = -np.inf
        return out

    def halves(self, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Largest answer of each filter in each half; a text longer than PIECE goes in pieces, so that memory is bounded."""
        if len(b) <= PIECE:
            return self.answers(b, first).max(axis=1)
        parts = [self.answers(b[i : i + PIECE], first[:1], b[i + PIECE : i + PIECE + WIDTH] if i + PIECE < len(b) else None).max(axis=1) for i in range(0, len(b), PIECE)]
        return np.concatenate(parts)

    @staticmethod
    def joined(h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Chunks: each half with the next one of the same document (the last of a document, if not its only one, with the one before)."""
        nxt = np.arange(len(h)) + 1
        ends = np.append(first[1:], len(h)) - 1
        nxt[ends] = np.maximum(ends - 1, first)
        return nxt

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(docs))
        i = 0
        while i < len(docs):
            j, size = i, 0
            while j < len(docs) and (j == i or size + len(docs[j]) <= PIECE):
                size += len(docs[j])
                j += 1
            counts = np.array([len(d) // HALF for d in docs[i:j]])
            first = np.cumsum(counts) - counts
            h = self.halves(np.concatenate(docs[i:j]), first)
            c = np.maximum(np.maximum(h, h[self.joined(h, first)]) + self.p["bias"], 0)
            f = np.concatenate([np.maximum.reduceat(c, first), np.add.reduceat(c, first) / counts[:, None]], axis=1)
            out[i:j] = f.astype(np.float64) @ self.p["out"].astype(np.float64) + float(self.p["out_bias"][0])
            i = j
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))

    def gradients(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        b = np.concatenate(docs)
        counts = np.array([len(d) // HALF for d in docs])
        first, n = np.cumsum(counts) - counts, len(b) // HALF
        a = self.answers(b, first)
        best = a.argmax(axis=1)
        h = np.take_along_axis(a, best[:, None], 1)[:, 0]
        nxt = self.joined(h, first)
        from_next = h[nxt] > h
        raw = np.where(from_next, h[nxt], h) + self.p["bias"]
        c = np.maximum(raw, 0)
        top = np.maximum.reduceat(c, first)
        f = np.concatenate([top, np.add.reduceat(c, first) / counts[:, None]], axis=1)
        score = 1 / (1 + np.exp(-np.clip(f @ self.p["out"] + self.p["out_bias"], -40, 40)))
        d = ((score - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": f.T @ d, "out_bias": np.array([d.sum()], np.float32)}
        df = d[:, None] * self.p["out"]
        who = np.repeat(np.arange(len(docs)), counts)
        dc = df[who, FILTERS:] / counts[who][:, None]
        at_top = c == top[who]
        # the first chunk that has the top answer takes its gradient
        place = np.where(at_top, np.arange(n)[:, None], n)
        lead = np.minimum.reduceat(place, first)
        k = np.arange(FILTERS)[None].repeat(len(docs), 0)
        np.add.at(dc, (lead, k), df[:, :FILTERS])
        dc *= raw > 0
        g["bias"] = dc.sum(axis=0)
        source = np.where(from_next, nxt[:, None], np.arange(n)[:, None])
        dh = np.zeros_like(h)
        cols = np.arange(FILTERS)[None].repeat(n, 0)
        np.add.at(dh, (source, cols), dc)
        i, k = np.nonzero(dh)
        v = dh[i, k]
        start = i * HALF + best[i, k] * STEP
        seen = np.concatenate([b, np.zeros(WIDTH, np.uint8)])[start[:, None] + np.arange(WIDTH)]
        x = self.p["emb"][seen].reshape(len(i), -1)
        conv = np.zeros((FILTERS, WIDTH * DIM), np.float32)
        np.add.at(conv, k, x * v[:, None])
        g["conv"] = conv.T
        emb = np.zeros_like(self.p["emb"])
        np.add.at(emb, seen.reshape(-1), (self.p["conv"].T[k] * v[:, None]).reshape(-1, DIM))
        g["emb"] = emb
        return g

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Network:
        docs, y, r = [padded(t) for t in texts], np.array(labels, np.float32), np.random.default_rng(seed)
        share = np.clip(y.mean(), 0.02, 0.98)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for e in range(epochs):
            order = r.permutation(len(docs))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                g = self.gradients([docs[k] for k in at], y[at], weight[at])
                t += 1
                step = rate * (1 - e / epochs)
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Network | float:
    """The network fitted on at most `rows` labelled rows; without labels of both kinds their share."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows)
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).filter(F.length("_t") <= chars)
    held = text.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t"))
    held = stored(held, "quality-rows")
    sizes = held.select("_id", "_y", F.octet_length("_t").alias("n")).groupBy().agg(F.sum("n")).first()[0] or 0
    if sizes > TRAIN_BYTES:  # at most `rows` rows without their texts
        before = Window.orderBy(F.xxhash64("_id"), "_id", "_y").rowsBetween(Window.unboundedPreceding, 0)
        fit = held.select("_id", "_y", F.octet_length("_t").alias("n")).withColumn("n", F.sum("n").over(before)).filter(F.col("n") <= TRAIN_BYTES)
        held = held.join(F.broadcast(fit.drop("n")), ["_id", "_y"])
    got = sorted((r["_id"], r["_y"], r["_t"]) for r in held.collect())
    y = [int(x[1] > 0) for x in got]
    if len(set(y)) < 2:
        return y[0] if y else 0.5
    return Network().fit([x[2] for x in got], y)


def score(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, score, and the columns named in keep."""
    session_of(docs)
    if not isinstance(model, Network):
        return docs.select(id_col, *keep, F.lit(float(model)).alias("score"))

    def run(batches):
        for b in batches:
            scores = model.scores([padded(t) for t in b.column("_text_in").to_pylist()])
            rest = b.drop_columns(["_text_in"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(scores, pa.float64())], names=[*rest.schema.names, "_score_out"])

    rows = docs.select(id_col, *keep, F.col(text_col).alias("_text_in"))
    schema = rows.drop("_text_in").withColumn("_score_out", F.lit(0.0)).schema
    return rows.mapInArrow(run, schema).withColumnRenamed("_score_out", "score")


def held_out(id_col):
    """True for the rows that are kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """id_col, held_out, score, predicted (1 from `threshold` on)."""
    model = train(docs, labels.filter(~held_out(id_col)), "quality", id_col, text_col, rows)
    out = score(docs, model, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_only(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of at least `threshold`, with all their columns; learned as for classified()."""
    session_of(docs)
    model = train(docs, labels.filter(~held_out(id_col)), "quality", id_col, text_col)
    if not isinstance(model, Network):
        return docs.filter(F.lit(float(model)) >= threshold)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.scores([padded(t) for t in b.column(text_col).to_pylist()]) >= threshold))

    return docs.mapInArrow(run, docs.schema)
