"""Odd rows for all ten operators and the pipeline: large ids beside nulls, clashing names, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelens.llm import decontaminate, exact_dedup, ngram_join, passages, pii, quality, sentencepiece_codec, suffix_dedup, token_store, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
BIG = 2**60
ITEM = "the quick brown fox jumps over the lazy dog and then runs far away from here to sleep well"
NAMES = ["_gone", "_leak", "_id", "_t", "_own", "_row", "_text_in", "_score_out", "_h", "_part", "_ids", "key", "n", "node", "root", "token", "score", "spans", "start", "value", "gram", "count", "host", "path", "words", "verdict"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(BIG + 1, ITEM), (None, ITEM + " again"), (BIG + 3, ITEM), (BIG + 5, None), (None, None), (BIG + 7, "x " * 300), (BIG + 9, "mail a@b.cd now")]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumns({c: F.lit(1) for c in NAMES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(BIG + 1, 1), (BIG + 3, 1), (BIG + 7, 0), (None, 1)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(BIG + 11, ITEM), (None, ITEM), (BIG + 13, None)], "item_id long, text string")


def by_document(odd, labels):
    """Operators that return each row of the documents."""
    return {
        "suffix": suffix_dedup.deduplicated(odd), "pieces": sentencepiece_codec.digests(odd, PIECES), "encode": sentencepiece_codec.encode(odd, PIECES), "exact": exact_dedup.duplicate_groups(odd),
        "tokens": token_store.read_tokens(token_store.write_tokens(odd, BYTES, 2), token_store.digest, "n_tokens long, ids_crc32 long"), "pii": pii.digests(odd), "ngram": ngram_join.linked(odd), "quality": quality.classified(odd, labels),
    }


def test_large_ids_beside_nulls_and_clashing_names(odd, labels):
    want = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in odd.select("doc_id").collect())
    for name, out in by_document(odd, labels).items():
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out.select("doc_id").collect()) == want, name
    linked = {r["doc_id"]: r["component_id"] for r in ngram_join.linked(odd).filter("doc_id IS NOT NULL").collect()}
    assert linked[BIG + 1] == linked[BIG + 3] == BIG + 1 and linked[BIG + 5] == BIG + 5


def test_pairs_keep_large_ids(spark, odd, bench):
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, bench).collect()}
    assert got == {(d, i) for d in (BIG + 1, BIG + 3, None) for i in (BIG + 11, None)}
    long = " ".join(f"w{k}" for k in range(60))
    d = spark.createDataFrame([(BIG + 1, long), (BIG + 3, long + " more"), (None, "other " + long)], "doc_id long, text string").withColumns({c: F.lit(1) for c in NAMES})
    got = {x for r in passages.shared_passages(d).collect() for x in (r["doc_id"], r["other_id"])}
    assert got == {BIG + 1, BIG + 3, None}


def test_filters_with_clashing_names(odd, labels, bench):
    left = ngram_join.one_of_each(odd)
    assert left.columns == odd.columns and left.filter(F.col("doc_id") == BIG + 3).count() == 0 and left.filter("doc_id IS NULL").count() == 2
    clean = decontaminate.without_leaks(odd, bench)
    assert clean.columns == odd.columns and {r["doc_id"] for r in clean.collect()} == {BIG + 5, BIG + 7, BIG + 9}
    assert exact_dedup.without_duplicates(odd).columns == odd.columns and quality.good_only(odd, labels).columns == odd.columns


def test_pages_with_clashing_names_and_large_ids(spark):
    p = spark.createDataFrame([(BIG + 1, "http://a.org/es/1", "<p>a b</p>"), (None, None, None), (BIG + 3, "http://a.org/fr/1", "")], "page_id long, url string, html string")
    out = url_filter.judged(p.coalesce(1).withColumns({c: F.lit(1) for c in NAMES})).collect()
    assert sorted((r["page_id"] or 0, r["rule"], r["verdict"]) for r in out if r["rule"]) == [(BIG + 1, "org/es/", "block")]
    assert {r["page_id"] for r in out} == {BIG + 1, None, BIG + 3}


def test_empty_tables(odd, labels, bench):
    none = odd.filter("doc_id = 0")
    for name, out in by_document(none, labels).items():
        assert out.count() == 0, name
    assert decontaminate.contaminated(none, bench).count() == passages.shared_passages(none).count() == 0
    assert decontaminate.contaminated(odd, bench.filter("item_id = 0")).count() == 0
    assert quality.classified(odd, labels.filter("quality > 5")).count() == odd.count()


def test_pipeline_over_odd_and_empty_documents(spark, odd, bench, tmp_path):
    labels = spark.createDataFrame([(BIG + k, 1, 0) for k in (1, 3, 5, 7, 9)], "doc_id long, quality int, toxic int")
    more = ["lang", "source", "n_chars"]
    for name, docs in (("odd", odd), ("none", odd.filter("doc_id = 0"))):
        d = str(tmp_path / name)
        docs.withColumns({c: F.lit(1) for c in more}).write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).select("doc_id").collect()}
    assert got <= {BIG + 5, BIG + 7, BIG + 9, None} and {BIG + 7, BIG + 9} <= got
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def brute_leaks(rows, items, threshold):
    """All pairs by whole Smith-Waterman tables."""
    out = set()
    for i, t in rows:
        for k, item in items:
            a, b = item.lower().split(), t.lower().split()
            h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            top = 0
            for x in range(1, len(a) + 1):
                for y in range(1, len(b) + 1):
                    h[x][y] = max(0, h[x - 1][y - 1] + (2 if a[x - 1] == b[y - 1] else -1), h[x - 1][y] - 1, h[x][y - 1] - 1)
                    top = max(top, h[x][y])
            if top >= threshold * 2 * len(a):
                out.add((i, k))
    return out


def test_leaks_against_all_pairs(spark):
    import random

    r = random.Random(17)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randrange(6, 25)))) for k in range(25)]
    rows = []
    for i in range(120):
        w = r.choice(items)[1].split()
        w = [r.choice(vocabulary) if r.random() < 0.25 else x for x in w if r.random() > 0.06]
        rows.append((i, " ".join([r.choice(vocabulary) for _ in range(r.randrange(20))] + w + [r.choice(vocabulary) for _ in range(r.randrange(20))])))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(rows, items, decontaminate.THRESHOLD)
    exact = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(d, b, n=1).collect()}
    seeded = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(d, b).collect()}
    print("leaks", len(want), "recall with 4-grams", len(seeded & want) / len(want))
    assert exact == want and seeded <= want and len(seeded) >= 0.9 * len(want)
