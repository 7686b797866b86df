"""Whole documents: the classifier's query against a plain forward pass, and very long texts through every operator."""

import hashlib
import math

import numpy as np
import pytest

from tracelens.llm import decontaminate, exact_dedup, fill_middle, mixing, ngram_join, passages, pii, quality, sentencepiece_codec, suffix_dedup, token_store

public_tokenizers = pytest.importorskip("public_tokenizers")


def plain_score(p, text):
    """Loops over halves, steps and filters, as the docstring says it."""
    b = (text or "").encode()
    n = max(1, math.ceil(len(b) / quality.HALF))
    b = b + bytes(n * quality.HALF - len(b))
    halves = []
    for h in range(n):
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(h * quality.HALF, (h + 1) * quality.HALF, quality.STEP):
            if at + quality.WIDTH <= len(b):
                best = np.maximum(best, np.concatenate([p["emb"][x] for x in b[at : at + quality.WIDTH]]).astype(np.float64) @ p["conv"].astype(np.float64))
        halves.append(best)
    chunks = [np.maximum(np.maximum(halves[h], halves[h + 1 if h + 1 < n else max(h - 1, 0)]) + p["bias"], 0) for h in range(n)]
    f = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)])
    return 1 / (1 + math.exp(-(float(f @ p["out"].astype(np.float64)) + float(p["out_bias"][0]))))


def test_scores_of_the_query_equal_a_plain_forward_pass(spark):
    import random
    import zlib

    r = random.Random(3)
    good = lambda: " ".join(r.choice(["the", "river", "was", "quiet", "and", "people", "walked"]) for _ in range(r.randrange(5, 300)))
    bad = lambda: "".join(r.choice("$#@!xzq 019") for _ in range(r.randrange(5, 2000)))
    rows = [(k, good() if k % 2 else bad()) for k in range(80)] + [(200, None), (201, ""), (202, "é日" * 700), (203, "a" * 255), (204, "b" * 256), (205, "c" * 257), (206, good() * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.classified(docs, labels).collect()}
    model = quality.train(docs, labels.filter(~quality.held_out("doc_id")))
    right = 0
    for i, t in rows:
        assert abs(got[i]["score"] - plain_score(model.p, t)) < 1e-4
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i]["predicted"] == int(got[i]["score"] >= quality.THRESHOLD)
        right += i >= 80 or got[i]["predicted"] == i % 2
    assert right >= 0.95 * len(rows)


LONG = 400_000


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of some megabytes without repeats, its copy, one with the same passage in it, one without any blank."""
    import random

    r = random.Random(11)
    words = [f"{r.choice('abcdefgh')}{k:x}" for k in range(LONG)]
    long, passage = " ".join(words), " ".join(words[1000:1100])
    rows = [(1, long), (2, long), (3, f"begin {passage} end"), (4, "".join(words[:100_000])), (5, "short one")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", __import__("pyspark").sql.functions.lit("s")), rows


def test_long_texts_are_deduplicated_and_joined(spark, long_docs):
    docs, rows = long_docs
    kept = {r["doc_id"]: (r["kept"], r["group_size"]) for r in exact_dedup.duplicate_groups(docs).collect()}
    assert kept == {1: (False, 2), 2: (True, 2), 3: (True, 1), 4: (True, 1), 5: (True, 1)}
    linked = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(docs).collect()}
    assert linked[1] == linked[2] == (LONG - 4, 1) and linked[4] == (1, 4)
    gone = {r["doc_id"]: r for r in suffix_dedup.deduplicated(docs).collect()}
    assert gone[1]["n_removed"] == 0 and gone[2]["n_removed"] == gone[2]["n_bytes"] and gone[2]["n_spans"] == 1
    assert gone[3]["n_removed"] >= len(rows[2][1]) - len("begin  end") - 1 and gone[4]["n_removed"] == 0
    found = {(r["doc_id"], r["other_id"]): r["n_words"] for r in passages.shared_passages(docs.filter("doc_id IN (1, 3, 5)")).collect()}
    assert set(found.values()) <= set(range(100, 103)) and len(found) == 1


def test_long_texts_are_encoded_and_cut(spark, long_docs):
    docs, rows = long_docs
    pieces = {r["doc_id"]: r for r in sentencepiece_codec.digests(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert pieces[1]["ids_sha256"] == pieces[2]["ids_sha256"] and pieces[1]["decoded_sha256"] == hashlib.sha256(rows[0][1].encode()).hexdigest()
    files = token_store.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    tokens = {r["doc_id"]: r for r in token_store.read_tokens(files, token_store.digest, "n_tokens long, ids_crc32 long").collect()}
    assert tokens[1]["ids_crc32"] == tokens[2]["ids_crc32"] and tokens[2]["start"] == tokens[1]["n_tokens"]
    cut = {r["doc_id"]: r for r in fill_middle.digests(docs).collect()}
    assert all(cut[i]["restored_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in rows)
    mix = {r["doc_id"]: r for r in mixing.taken_of(docs).collect()}
    assert mix[1]["size"] == LONG and sum(r["taken"] for r in mix.values()) == math.floor(mix[1]["target"])


def test_long_texts_are_searched_whole(spark, long_docs):
    docs, rows = long_docs
    item = " ".join(rows[0][1].split()[-40:])  # the very end
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()} == {1, 2}
    told = spark.createDataFrame([(7, rows[0][1] + " write to me@site.org")], "doc_id long, text string")
    (r,) = pii.digests(told).collect()
    assert r["n_email"] == 1 and r["spans"].split(",")[-1] == f"email:{len(rows[0][1]) + 10}:{len(rows[0][1]) + 21}"
