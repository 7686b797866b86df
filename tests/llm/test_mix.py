"""Mixing, fill-in-middle and whitening against plain versions."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelens.llm import fill_middle, mixing, whitening

BIG = 2**60
NAMES = ["_id", "_s", "_d", "_t", "id", "source_size", "rank", "h", "n", "target", "digest", "size", "copies", "epoch", "bucket", "before", "taken", "v", "k", "at", "value", "h0", "form", "output", "component"]
DOC = "doc_id long, text string, source string"


# ---- mixing


def plain_targets(sizes, weights=mixing.WEIGHTS, share=mixing.SHARE, most=mixing.MOST):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (budget - sum(most * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        more = {s for s in rest if most * sizes[s] < level * w[s]}
        if not more:
            return {s: most * sizes[s] if s in full else min(most * sizes[s], level * w[s]) for s in names}
        full |= more


@pytest.fixture(scope="module")
def sources():
    r = random.Random(3)
    rows = []
    for source, n, longest in (("a", 150, 30), ("b", 20, 30), ("é", 40, 300), ("z", 3, 4000), (None, 25, 10), ("Ω", 1, 7), ("none", 4, 1)):
        for _ in range(n):
            words = 0 if source == "none" else r.randrange(0, longest)
            rows.append((BIG + len(rows), "".join(r.choice(["ab", "c\xa0d", "日本"]) + r.choice([" ", "\n", "\x0b "]) for _ in range(words)), source))
    rows += [rows[5]] * 40 + [(None, "a b c", "a"), (None, "d e", "b"), (BIG, None, "b"), (BIG + 1, "", None)]
    r.shuffle(rows)
    return rows


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_words_are_counted_as_stated(spark):
    texts = ["", None, " ", "a", " a\tb\x0bc ", "\xa0", "a b", "\x1cx"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.words_in(F.col("t"))).collect()
    assert [r[0] for r in got] == [size_of(t) for t in texts]


@pytest.mark.parametrize("rows_each", [4096, 7])
def test_mix_meets_its_targets(spark, sources, rows_each, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_EACH", rows_each)
    docs = spark.createDataFrame(sources, DOC).repartition(5)
    got = [r.asDict() for r in mixing.taken_of(docs.withColumn("_s", F.col("source"))).collect()]
    sizes = {}
    for _, t, s in sources:
        sizes[s] = sizes.get(s, 0) + size_of(t)
    want = plain_targets(sizes)
    taken = {}
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), size_of(t)) for i, t, _ in sources)
    by_size = {v: k for k, v in sizes.items()}
    assert len(by_size) == len(sizes)
    for r in got:
        s = by_size[r["source_size"]]
        assert abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes), (taken, want)
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    again = [r.asDict() for r in mixing.taken_of(docs.repartition(2).select("source", "text", "doc_id")).collect()]
    key = lambda r: tuple(map(str, r.values()))
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mix_is_one_interleaved_order(spark, sources, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_EACH", 16)
    docs = spark.createDataFrame(sources, DOC).repartition(3)
    out = mixing.mixed(docs).collect()
    at, seen, longest, clock = 0, {}, {}, 0.0
    sizes = {}
    for _, t, s in sources:
        sizes[s] = sizes.get(s, 0) + size_of(t)
        longest[s] = max(longest.get(s, 0), size_of(t))
    longest["a"] += 40 * max(size_of(t) for _, t, s in sources if s == "a")  # the repeated rows follow each other
    want = plain_targets(sizes)
    passes = {}
    for r in out:
        assert r["position"] == at and size_of(r["text"]) == r["taken"] > 0
        at += r["taken"]
        seen[r["source"]] = seen.get(r["source"], 0) + r["taken"]
        passes.setdefault((r["source"], r["epoch"]), set()).add(r["doc_id"])
        clock = max(clock, seen[r["source"]] / want[r["source"]])
        for s, n in seen.items():  # no source lags by more than a document
            assert n >= clock * want[s] - longest[s] - 1
    assert at <= 1.5 * sum(sizes.values()) < at + len(sizes) + 1
    assert {e for _, e in passes} == {1, 2}
    texts = {(i, s): t for i, t, s in sources}
    cut = [r for r in out if (r["doc_id"], r["source"]) in texts and r["text"] != texts[r["doc_id"], r["source"]]]
    assert len({r["source"] for r in cut}) == len(cut) <= len(sizes)
    assert all(texts[r["doc_id"], r["source"]].startswith(r["text"]) for r in cut)


def test_mix_of_odd_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert mixing.taken_of(none).count() == mixing.mixed(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a"), (None, "", "a")], DOC)
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.taken_of(blank).collect()] == [(0, 0, 0.0, 0)] * 3
    odd = spark.createDataFrame([(BIG + 1, "a b c d", "s"), (None, "e f", None)], DOC).withColumns({c: F.lit("x") for c in NAMES})
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.taken_of(odd).collect()}
    # 9 words by 2 and 5: null has 2.57, 's' 6.43
    assert got[BIG + 1][:2] == (4, 4) and abs(got[BIG + 1][2] - 45 / 7) < 1e-9 and got[BIG + 1][3] == 6 and got[None][3] == 2
    assert mixing.mixed(odd).columns == ["position", "doc_id", "source", "epoch", "taken", "text"]


# ---- fill-in-middle


def plain_cut(i, t):
    t = t or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    sha = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(sha[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(5)
    out = [None, "", "a", "<P>", "x<S", "P>", "ab<M>cd", "<", "S>y", "<<P", "日本語", "\n\n", "é", "a" * 5000, "𝒳" * 300, "áb"]
    for _ in range(400):
        out.append("".join(r.choice(["a", "Zz", " ", "é", "日", "𝒳", "<", "P>", "S>", "<M", "1", "\n", "\x00"]) for _ in range(r.randrange(0, 40))))
    return [(BIG + k, t) for k, t in enumerate(out)] + [(None, "one two three"), (BIG, "again here"), (-7, "minus seven")]


@pytest.mark.parametrize("block", [fill_middle.BLOCK, 64])
def test_cuts_equal_plain_ones(spark, odd_texts, block, monkeypatch):
    monkeypatch.setattr(fill_middle.blocks, "__defaults__", (block,))
    docs = spark.createDataFrame(odd_texts, "doc_id long, text string").coalesce(2).withColumns({c: F.lit(1) for c in NAMES})
    out = fill_middle.transformed(docs)
    got = out.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    texts = {}
    for i, t in odd_texts:
        texts.setdefault(i, []).append((plain_cut(i, t), t or ""))
    assert len(got) == len(odd_texts) and {r["form"] for r in got} == set(fill_middle.FORMS)
    for r in got:
        assert ((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]), r["again"]) in texts[r["doc_id"]]


def test_digests_of_texts(spark, odd_texts):
    docs = spark.createDataFrame(odd_texts, "doc_id long, text string")
    want = {(i, hashlib.sha256(plain_cut(i, t)[4].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd_texts}
    assert {(r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in fill_middle.digests(docs).collect()} == want
    assert fill_middle.digests(docs.limit(0)).count() == 0


def test_blocks_cover_slices_and_wide_offsets():
    texts = ["", "ab", "é日", "", "x" * 100, "c"]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["zz", *texts, "yy"]).slice(1, 6)):
        for most in (1, 3, 50, 10**6):
            found = [x[ends[k] : ends[k + 1]].tobytes().decode() for i, j, ends, x in fill_middle.blocks(column, most) for k in range(j - i)]
            assert found == texts


def test_long_text_is_cut_whole(spark):
    t = "word é " * 1_500_000
    got = fill_middle.transformed(spark.createDataFrame([(3, t)], "doc_id long, text string")).first()
    assert (got["n"], got["form"], got["prefix_chars"], got["middle_chars"], got["output"]) == plain_cut(3, t)


# ---- whitening


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_residues_give_whole_numbers():
    r = np.random.default_rng(1)
    x = r.integers(-(2**40), 2**40, (5000, 4))
    moduli = whitening.enough_primes(5000 * 2**80)
    assert len(set(moduli)) == len(moduli) and all(p < 2**whitening.PRIME_BITS for p in moduli)
    got = whitening.whole_numbers(whitening.residue_scatter(x, moduli).reshape(len(moduli), -1), moduli)
    big = x.astype(object)
    assert got == (big.T @ big).ravel().tolist()


def plain_whitening(rows, components=whitening.COMPONENTS):
    """Fractions all the way to the covariance."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    s = [sum(x[j] for _, x in kept) for j in range(d)]
    off = [[Fraction(x[j]) - Fraction(s[j], n) for j in range(d)] for _, x in kept]
    cov = np.array([[float(sum(o[a] * o[b] for o in off) / n) for b in range(d)] for a in range(d)])
    values, axes = np.linalg.eigh(cov)
    return kept, n, s, off, cov, values[::-1][:components], axes[:, ::-1][:, :components]


def test_whitening_against_fractions(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(120, 6)) @ r.normal(size=(6, 6)) + 3
    rows = [(BIG + k, v.astype(np.float32).tolist()) for k, v in enumerate(base)]
    rows += [rows[0], (None, rows[1][1]), (1, None), (2, []), (3, [None, *rows[2][1][1:]]), (4, [float("nan")] + rows[2][1][1:]), (5, rows[2][1][:5] + [float("-inf")])]
    kept, n, s, off, cov, values, axes = plain_whitening(rows)
    table = vectors_of(spark, rows).repartition(7).withColumns({c: F.lit(1) for c in NAMES})
    w = whitening.fitted(table)
    assert (w.n, w.sums) == (n, s)
    assert w.scatter == [[sum(x[a] * x[b] for _, x in kept) for b in range(6)] for a in range(6)]
    got = whitening.whitened(table).collect()
    assert len(got) == n * 6 and {g["n"] for g in got} == {n}
    assert len({g["identity_error"] for g in got}) == 1 and got[0]["identity_error"] < 1e-9
    dev = {i: sum((n * v - t) ** 2 for v, t in zip(x, s, strict=True)) for i, x in kept}
    assert all(g["deviation"] == dev[g["vec_id"]] for g in got)
    for g in got:
        assert abs(g["explained"] - values[g["component"] - 1] / np.trace(cov)) < 1e-9
    by_id = {(g["vec_id"], g["component"]): g["whitened"] for g in got}
    for k in range(6):
        want = np.array([[float(f) for f in o] for o in off]) @ axes[:, k] / math.sqrt(values[k])
        have = np.array([by_id[i, k + 1] for i, _ in kept])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
    assert [c for c, _ in whitening.whitened(table, components=2).dtypes] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert {g["component"] for g in whitening.whitened(table, components=2).collect()} == {1, 2}


def test_whitening_of_odd_tables(spark):
    none = vectors_of(spark, [])
    assert whitening.whitened(none).collect() == [] == whitening.whitened(vectors_of(spark, [(1, None), (2, [])])).collect()
    alike = vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert whitening.whitened(alike).collect() == []
    flat = vectors_of(spark, [(k, [float(k), 1.0, float(2 * k)]) for k in range(10)])  # of rank 1
    got = whitening.whitened(flat).collect()
    assert {g["component"] for g in got} == {1} and len(got) == 10 and got[0]["identity_error"] < 1e-9
    mixed = vectors_of(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 5.0]), (4, [1.0]), (5, [1.0, 2.0, 3.0])])
    assert {g["vec_id"] for g in whitening.whitened(mixed).collect()} == {1, 2, 3}
    huge = vectors_of(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [5.0, 2.0])])
    got = whitening.whitened(huge).collect()
    assert {(g["vec_id"], g["deviation"]) for g in got} == {(1, None), (2, None), (3, 640**2 + 192**2)} and {g["vec_id"] for g in got} == {1, 2, 3}


def test_doubles_alone_would_be_wrong():
    """The scatter of the stated integers is beyond 2**53, where a product of doubles is no longer exact."""
    x = np.random.default_rng(4).integers(999_900, 1_000_100, (20_000, 3))
    moduli = whitening.enough_primes(20_000 * 1_000_100**2)
    exact = x.astype(object).T @ x.astype(object)
    assert whitening.whole_numbers(whitening.residue_scatter(x, moduli).reshape(len(moduli), -1), moduli) == exact.ravel().tolist()
    f = x.astype(float)
    assert (f.T @ f).astype(object).ravel().tolist() != exact.ravel().tolist()
