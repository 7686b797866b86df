"""Exact copies, repeated byte strings, similar sets, shared passages: against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.llm import common, exact_dedup, ngram_join, passages, suffix_dedup


def test_exact_groups(docs, documents):
    n, best = Counter((r[1] or "") for r in documents), defaultdict(lambda: -1)
    for r in documents:
        best[r[1] or ""] = max(best[r[1] or ""], -1 if r[0] is None else r[0])
    got = exact_dedup.duplicate_groups(docs, keep="max", rows_each=2).collect()
    want = sorted((-1 if r[0] is None else r[0], best[r[1] or ""], n[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in documents)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_exact_groups_without_broadcast(docs, spark):
    a = exact_dedup.duplicate_groups(docs, keep="min").collect()
    b = exact_dedup.duplicate_groups(docs, keep="min", broadcast_bytes=0, rows_each=1).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_without_duplicates(docs, documents, no_docs):
    left = exact_dedup.without_duplicates(docs)
    assert left.columns == docs.columns
    texts = Counter((r["text"] or "") for r in left.collect())
    assert set(texts) == {r[1] or "" for r in documents} and max(texts.values()) == 1
    assert exact_dedup.without_duplicates(no_docs).count() == 0


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions

    monkeypatch.setattr(functions, "md5", lambda c: functions.lit("00112233445566778899aabbccddeeff"))
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b"), (6, "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.duplicate_groups(d, rows_each=2).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (5, 2), 5: (5, 2), 4: (6, 2), 6: (6, 2)}


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [None, 2])
def test_repeated_strings(clean_docs, clean, monkeypatch, hot):
    if hot:  # nearly every gram is split
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 10**9)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.deduplicated(clean_docs).collect()}
    assert got == brute_repeats([(r[0], r[1] or "") for r in clean], suffix_dedup.LENGTH)


def test_repeated_strings_edges(spark, no_docs):
    assert suffix_dedup.deduplicated(no_docs).count() == 0
    t = "q" * 130
    d = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t + "z"), (3, None)], "doc_id long, text string")
    got = sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in suffix_dedup.deduplicated(d, texts=True).collect())
    assert got == [(-1, 130, 129), (1, 130, 130), (1, 130, 130), (2, 131, 130), (3, 0, 0)]


@pytest.mark.parametrize("few", [0, 10**6])
def test_suffix_arrays(monkeypatch, few):
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    r = random.Random(3)
    for _ in range(150):
        blocks = []
        for _ in range(r.randrange(1, 7)):
            s = [r.randrange(1, r.choice([2, 3, 4, 20])) for _ in range(r.randrange(1, 50))]
            blocks.append(((s[: max(1, len(s) // 4)] * 8)[: len(s)] if r.random() < 0.4 else s) + [0])
        size = np.array([len(b) for b in blocks])
        base = np.cumsum(size) - size
        want = [o + i for b, o in zip(blocks, base.tolist(), strict=True) for i in sorted(range(len(b)), key=lambda i, b=b: b[i:])]
        assert suffix_dedup.suffix_arrays(np.array(sum(blocks, [])), base, size).tolist() == want


def shingles(t):
    w = common.words_of(t)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components(clean_docs, clean):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(clean_docs).collect()}
    assert got == brute_components([(r[0], r[1] or "") for r in clean])


def test_components_of_many_near_copies(spark):
    r = random.Random(5)
    rows, base = [], [[f"w{r.randrange(500)}" for _ in range(60)] for _ in range(6)]
    for i in range(240):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(w[r.randrange(0, 6) :])))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_components(rows)


def test_components_edges(spark, no_docs):
    assert ngram_join.linked(no_docs).count() == 0
    t = "one two three four five six"
    d = spark.createDataFrame([(5, t), (5, t), (None, t), (7, t), (8, None), (9, "")], "doc_id long, text string")
    got = sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in ngram_join.linked(d).collect())
    assert got == [(-1, 2, 5), (5, 2, 5), (5, 2, 5), (7, 2, 5), (8, 0, 8), (9, 0, 9)]


def test_prefixes_of_any_length_meet():
    """Similar sets share as many n-grams of their prefixes as the smaller l asks for, whatever the order and the ls."""
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(4, 60))
        a = r.choice(10**6, n, replace=False).astype(np.uint64)
        b = np.union1d(a[int(r.integers(0, n // 7 + 1)) :], r.integers(10**6, 2 * 10**6, int(r.integers(0, n // 7 + 1))).astype(np.uint64))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        ls = [min(int(r.integers(1, 5)), ngram_join.needed(len(x))) for x in (a, b)]
        p = [np.sort(x)[: len(x) - ngram_join.needed(len(x)) + l] for x, l in zip((a, b), ls, strict=True)]
        assert len(np.intersect1d(*p)) >= min(ls)


def test_passages(clean_docs, clean, no_docs):
    got = passages.shared_passages(clean_docs).collect()
    texts = {r[0]: common.words_of(r[1]) for r in clean}
    for r in got:
        a, b = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["other_id"]][r["other_start"] : r["other_end"]]
        assert len(set(a) & set(b)) >= 0.6 * len(set(a)) and r["n_words"] >= passages.LEAST and r["similarity"] >= passages.SIMILAR
    seen = {r["doc_id"] for r in got} | {r["other_id"] for r in got}
    assert {30, 31, 32} <= seen  # the shared passage, once with changed words
    assert {0, 25, 26} <= seen  # copies
    assert passages.shared_passages(no_docs).count() == 0


def test_chains_against_quadratic():
    r = np.random.default_rng(2)
    for _ in range(60):
        n = int(r.integers(1, 25))
        x, y = r.integers(0, 40, n), r.integers(0, 40, n)
        best = {}
        for i in np.lexsort((y, x)).tolist():
            best[i] = passages.WORTH + max([0.0] + [best[j] - passages.GAP * (x[i] - x[j] + y[i] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i]])
        found = passages.chains(x, y)
        assert all((np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all() for c in found)
        top = max(best, key=best.get)
        worth = [passages.WORTH * len(c) - passages.GAP * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]]) for c in found]
        if best[top] > passages.WORTH * (passages.MIN_SEEDS - 1) + 1e-9:
            assert abs(max(worth) - best[top]) < 1e-9


def test_components_helper(spark):
    e = spark.createDataFrame([(9, 8), (8, 7), (1, 2), (2, 3), (5, 3), (7, 7)] + [(k, k + 1) for k in range(20, 60)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(e, "t").collect()}
    assert got == {9: 7, 8: 7, 7: 7, 1: 1, 2: 1, 3: 1, 5: 1} | dict.fromkeys(range(20, 61), 20)
    assert common.components(e.filter("a < 0"), "t").count() == 0


def test_key_filter(spark):
    keys = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("key"))
    bits = common.key_filter(keys, keys.count()).value
    own = np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64)
    other = np.random.default_rng(1).integers(0, 2**63, 20000).astype(np.uint64)
    assert common.passing(bits, own).all() and common.passing(bits, other).mean() < 0.2
    assert common.key_filter(keys, 10**9, most_bytes=1024).value is None


def test_stored_tables_can_be_discarded(spark):
    import glob

    before = common.stored(spark.range(3), "gone")
    assert before.count() == 3 and glob.glob(f"{common.shared_dir(spark)}/tracelens-gone-*")
    common.discard(spark)
    assert not glob.glob(f"{common.shared_dir(spark)}/tracelens-gone-*")


def test_edited_passages_are_found(spark):
    """Single words replaced, at random, in passages of 50 words that stay SIMILAR: by the rate of edits, nearly all are found."""
    for rate, least in ((0.1, 1.0), (0.15, 0.97), (0.2, 0.9)):
        r = random.Random(11)
        rows, n = [], 100
        for k in range(n):
            words = [f"p{r.randrange(10**6)}" for _ in range(50)]
            edited = [f"q{r.randrange(10**6)}" if r.random() < rate else w for w in words]
            while sum(a == b for a, b in zip(words, edited, strict=True)) < 40:
                edited = [f"q{r.randrange(10**6)}" if r.random() < rate else w for w in words]
            for i, w in ((2 * k, words), (2 * k + 1, edited)):
                rows.append((i, " ".join([f"r{r.randrange(10**6)}" for _ in range(20)] + w + [f"r{r.randrange(10**6)}" for _ in range(20)])))
        got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert len({min(x["doc_id"], x["other_id"]) // 2 for x in got}) >= least * n, rate


def common_stretches(a: list[str], b: list[str], least: int) -> list[tuple[int, int]]:
    """Maximal stretches of a, of `least` words or more, that b holds too."""
    begin = {}
    for j in range(len(b) - least + 1):
        begin.setdefault(tuple(b[j : j + least]), j)
    hit = [i for i in range(len(a) - least + 1) if tuple(a[i : i + least]) in begin]
    return [(i, i + least) for i in hit]


def test_passages_of_frequent_lines(spark):
    """Lines of 15 to 30 words that many documents hold, in any order: whatever 40 words two documents share, both report
    (against all pairs), though most k-mers of it are represented by documents that hold one line of it."""
    rng = np.random.default_rng(61)
    lines = [[f"l{i}w{k}" for k in range(rng.integers(15, 31))] for i in range(14)]
    texts = []
    for d in range(90):
        words = []
        for i in rng.permutation(14)[: rng.integers(1, 4)]:
            words += lines[i] + [f"own{d}x{rng.integers(1 << 30)}" for _ in range(rng.integers(0, 2) * 30)]
        texts.append(words)
    two = [lines[0] + lines[1] + lines[2]]
    texts += [[f"p{d}x{k}" for k in range(50)] + two[0] + [f"q{d}x{k}" for k in range(50)] for d in range(2)]
    rows = [(d, " ".join(t)) for d, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for apart in (1, 5):
        covered = [np.zeros(len(t), bool) for t in texts]
        for r in passages.shared_passages(docs, apart=apart).collect():
            covered[r["doc_id"]][r["start_word"] : r["end_word"]] = True
            covered[r["other_id"]][r["other_start"] : r["other_end"]] = True
        shared = 0
        for d, t in enumerate(texts):
            for e, u in enumerate(texts):
                for i, j in common_stretches(t, u, passages.LEAST + apart - 1) if e != d else []:
                    shared += 1
                    assert covered[d][i:j].all(), (d, e, i, j)
        assert shared > 20 and covered[-1].any() and covered[-2].any()


def test_blocks_of_seeds():
    """What travels in blocks comes out as it went in; holders are the first of each seed; the filter misses no repeated seed."""
    rng = np.random.default_rng(12)
    x = rng.integers(0, 1 << 40, 500).astype(np.uint64)
    assert (passages.from_planes(passages.planes(x, 5), 5) == x).all() and len(passages.from_planes(b"", 4)) == 0
    h = np.sort(rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2))
    for buckets in (16, 1000, 1 << 20):
        bucket, within = passages.bucket_of(h, buckets)
        assert (np.diff(bucket) >= 0).all() and bucket[-1] < buckets and (within[1:] >= within[:-1])[bucket[1:] == bucket[:-1]].all()
    key, seed = np.sort(rng.integers(-20, 20, 3000)), rng.integers(0, 300, 3000).astype(np.uint64)
    place = rng.integers(0, 1000, 3000).astype(np.int32)
    first, plain = {}, []
    for k, p, s in zip(key.tolist(), place.tolist(), seed.tolist(), strict=True):
        o, y = first.setdefault(s, (k, p))
        plain += [(k, o, p, y)] if o != k else []
    holders, found = passages.Holders(), []
    for i in range(0, 3000, 700):
        found.append(holders.matches(key[i : i + 700], place[i : i + 700], seed[i : i + 700]))
    assert sorted(zip(*(np.concatenate(c).tolist() for c in zip(*found, strict=True)), strict=True)) == sorted(plain)
    blocks = passages.match_blocks(found, 8)
    pairs = {(r["key"], r["other"]) for _, t in blocks.groupby("bucket") for _, r in passages.chains_of(t).iterrows()}
    assert pairs == {(k, o) for k, o, _, _ in plain}


def test_filter_of_repeated_seeds(spark):
    rng = random.Random(5)
    shared = [f"s{k}" for k in range(30)]
    texts = [" ".join([*(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40))), *(shared if d % 3 else []), f"e{d}"]) for d in range(60)]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", "a b"]], "_t string").repartition(5)
    _, _, one = passages.seeds_of([" ".join(shared)])
    who, _, every = passages.seeds_of(texts)
    for most in (1 << 20, 1 << 7):  # of few bits others pass, too, but none is missed
        bits = passages.filter_of(rows, 1, 64, most).value
        assert passages.in_several(bits, one, 64).all()
        if most == 1 << 20:
            known = set(one.tolist())
            assert not passages.in_several(bits, np.array([s for s in every.tolist() if s not in known], np.uint64), 64).any()


def test_bare_words():
    """Bare words hash as words without signs at their edges; a word of signs alone as an empty one."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("aBé1-,.( \n") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", None, "...", "--a--"]
    h, counts = common.word_hashes(texts, bare=True)
    assert counts.tolist() == [len(common.words_of(t)) for t in texts]
    words = [w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for t in texts for w in common.words_of(t)]
    known = {}
    assert all(known.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True)) and len(set(known.values())) == len(known)
    plain, _ = common.word_hashes([w.decode("utf-8") for w in known if w])
    assert [known[w] for w in known if w] == plain.tolist()


def test_lowest_places():
    rng = np.random.default_rng(3)
    at = np.flatnonzero(rng.random(400) < 0.8)
    value = rng.integers(0, 1 << 63, len(at)).astype(np.uint64)
    chosen = set(passages.lowest(at, value, 5).tolist())
    for i in range(len(at) - 4):
        if at[i + 4] - at[i] == 4:
            assert i + int(value[i : i + 5].argmin()) in chosen


def test_two_passages_of_one_pair(spark):
    """Two passages of 45 words, 60 or 400 words apart, are found one by one, though their chain is less than SIMILAR."""
    for between in (60, 400):
        one, other = [f"s{k}" for k in range(45)], [f"t{k}" for k in range(45)]
        rows = [(d, " ".join([*one, *[f"d{d}x{k}" for k in range(between)], *other])) for d in range(2)]
        got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r["start_word"], r["end_word"], r["similarity"]) for r in got) == [(0, 45, 1.0), (45 + between, 90 + between, 1.0)]


def test_hot_representatives_are_spread(spark, monkeypatch):
    """The chains of one representative go to tasks in parts; what is found doesn't depend on their size."""
    rng = random.Random(8)
    shared = " ".join(f"s{rng.randrange(9999)}" for _ in range(60))
    rows = [(d, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(20)), shared, f"e{d}"])) for d in range(30)]
    docs = spark.createDataFrame([*rows, (None, shared), (99, None)], "doc_id long, text string")
    once = sorted(passages.shared_passages(docs).collect(), key=str)
    monkeypatch.setattr(passages, "ROWS_EACH", 4)
    assert sorted(passages.shared_passages(docs).collect(), key=str) == once
    assert len({r[c] for r in once for c in ("doc_id", "other_id")}) == 31


def test_alignments_beyond_ends():
    """Of many lanes side by side each has the best score of its own plain alignment, and as many equal words."""
    rng = np.random.default_rng(4)
    a = rng.integers(2, 6, (passages.MARGIN, 60)).astype(np.uint32) | 2
    b = np.where(rng.random(a.shape) < rng.random(60), a, rng.integers(10, 14, a.shape).astype(np.uint32) | 2)
    scores, i, j = passages.extended(a, b)
    same = passages.equal_in(scores, a, b, i, j)
    for k in range(60):
        best, row, top = 0, [-q for q in range(len(b) + 1)], (0, 0)
        for p in range(1, len(a) + 1):
            new = [row[0] - 1]
            for q in range(1, len(b) + 1):
                new.append(max(row[q] - 1, new[-1] - 1, row[q - 1] + (1 if a[p - 1, k] == b[q - 1, k] else -1)))
            row = new
            if max(row) > best:
                best, top = max(row), (p, row.index(max(row)))
            if max(row) < best - passages.DROP:
                break
        assert (i[k], j[k]) == top
        assert scores[i[k], j[k], k] == best
        assert max(i[k], j[k]) - best <= 2 * max(i[k], j[k]) - same[k] and same[k] >= best


def test_pieces_of_other_documents(spark):
    """Every k-mer that two documents share in an edited passage stands first in a document that holds this one only."""
    words = [f"p{k}" for k in range(53)]
    texts = [" ".join([f"a{i}", *words[k : k + 5], f"b{i}"]) for i, k in enumerate(range(0, 49, 6))]
    texts += [" ".join(words), " ".join(w if k % 6 < 5 else f"q{k}" for k, w in enumerate(words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = passages.shared_passages(docs).collect()
    assert {frozenset((r["doc_id"], r["other_id"])) for r in got} == {frozenset((9, 10))} and max(r["n_words"] for r in got) == 53


def test_pieces_that_many_documents_hold(spark):
    """As before, but with 20 holders of each piece: by all pairs, and only by these, the edited passage is found."""
    words = [f"p{k}" for k in range(53)]
    texts = [" ".join([f"a{i}x{n}", *words[k : k + 5], f"b{i}x{n}"]) for n in range(20) for i, k in enumerate(range(0, 49, 6))]
    texts += [" ".join(words), " ".join(w if k % 6 < 5 else f"q{k}" for k, w in enumerate(words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = passages.shared_passages(docs, all_pairs=len(texts)).collect()
    assert [({r["doc_id"], r["other_id"]}, r["n_words"]) for r in got] == [({180, 181}, 53)]


def test_all_matches_of_a_seed_come_in_parts(monkeypatch):
    """Texts of frequent seeds all meet, each pair once, and no more than HELD of them at a time."""
    key, seed = np.arange(60, dtype=np.int64), np.array([7] * 40 + [9] * 15 + [11, 12, 12, 13, 13], np.uint64)
    monkeypatch.setattr(passages, "HELD", 8)
    parts = list(passages.all_matches(key, np.zeros(60, np.int32), seed, 40))
    got = [(int(j), int(i)) for k, o, _, _ in parts for i, j in zip(k, o, strict=True)]
    assert len(got) == len(set(got)) == 40 * 39 // 2 + 15 * 14 // 2 + 2 and all(seed[i] == seed[j] and i < j for i, j in got)
    assert max(len(k) for k, *_ in parts) <= 8
    assert not list(passages.all_matches(key[:0], np.zeros(0, np.int32), seed[:0], 40)) + list(passages.all_matches(key[:1], np.zeros(1, np.int32), seed[:1], 40))


def test_repeated_words_are_one_passage(spark):
    """Runs of a repeated word meet side by side: documents of such runs share one passage, not one for each place."""
    own = [" ".join(f"{c}{k}" for k in range(20)) for c in "ab"]
    many = [(d, f"o{d} " + "r " * 60) for d in range(20)]  # held by more documents than are matched in pairs
    rows = [(0, own[0] + " x" * 500), (1, own[1] + " x" * 500), (2, "y z " * 200), (3, "y z " * 200)]
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((min(r["doc_id"], r["other_id"]), r["n_words"]) for r in got) == [(0, 500), (2, 400)]
    got = passages.shared_passages(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert len(got) == 19 and {r["n_words"] for r in got} == {60}


def test_look_loses_no_passage():
    """What is a passage by all bytes of its words can be one by the lowest, too."""
    rng = np.random.default_rng(7)
    a, b = [], []
    for rate in rng.random(600) * 0.4:
        u = rng.integers(2, 1 << 24, 85).astype(np.uint32)
        v = np.where(rng.random(85) < rate, rng.integers(2, 1 << 24, 85).astype(np.uint32), u)
        v[40:45] = u[40:45]
        v = np.delete(v, rng.integers(0, 40, rng.integers(0, 4)))
        a.append(u)
        b.append(v)
    x = [np.array([40])] * len(a)
    y = [np.array([len(v) - 45]) for v in b]
    good = {k for k, *_ in passages.judged_chains(a, b, x, y, passages.LEAST, passages.SIMILAR)}
    low = [[(w & 255) + np.uint32(2) for w in side] for side in (a, b)]
    hope = passages.hopeful(*low, x, y, passages.LEAST, passages.SIMILAR)
    assert 100 < len(good) < 600 and hope[sorted(good)].all() and not hope.all()


def test_words_that_are_not_there():
    """Chains with no passage about them go without an alignment, and none with one does."""
    rng = np.random.default_rng(9)
    a, b, x, y = [], [], [], []
    for rate in rng.random(900) * 0.8:
        u = rng.integers(2, 1 << 24, 85).astype(np.uint32)
        v = np.where(rng.random(85) < rate, rng.integers(2, 1 << 24, 85).astype(np.uint32), u)
        v[40:45] = u[40:45]
        v = np.delete(v, rng.integers(0, 40, rng.integers(0, 4)))
        at = [40] + ([50] if rng.random() < 0.3 and (v[len(v) - 35 : len(v) - 30] == u[50:55]).all() else [])
        cut = int(rng.integers(0, 41))  # texts begin and end anywhere
        a.append(u[cut:])
        b.append(v)
        x.append(np.array(at) - cut)
        y.append(np.array(at) + len(v) - 85)
    good = {k for k, *_ in passages.judged_chains(a, b, x, y, passages.LEAST, passages.SIMILAR)}
    (u, ua), (v, vb) = ((np.concatenate([(w & 255).astype(np.uint8) for w in side]), np.cumsum([len(w) for w in side])) for side in (a, b))
    first, last = (np.array([p[i] for p in x]) for i in (0, -1))
    left = passages.enough_in(u, ua, v, vb, first, last, passages.LEAST, passages.SIMILAR)
    assert 100 < len(good) < 600 and left[sorted(good)].all() and left.sum() < 800
    other = passages.enough_in(u, ua, rng.permutation(v), vb, np.minimum(first, ua[0] - 5), np.minimum(first, ua[0] - 5), passages.LEAST, passages.SIMILAR)
    assert other.mean() < 0.05


def test_chains_side_by_side():
    """Pairs whose matches are on one diagonal have the chains that each would have alone."""
    rng = np.random.default_rng(10)
    key, x = np.sort(rng.integers(0, 200, 1500)), rng.integers(0, 300, 1500).astype(np.int32)
    y = (x + rng.integers(0, 3, 200)[key] * rng.integers(0, 2, 1500)).astype(np.int32)
    t = passages.match_blocks([(key, key + 1000, x, y)], 1)
    got = sorted((r["key"], tuple(r["x"]), tuple(r["y"])) for _, r in passages.chains_of(t).iterrows())
    want = []
    for k in np.unique(key).tolist():
        _, u, v = passages.thinned(np.zeros(int((key == k).sum()), np.int64), x[key == k], y[key == k])
        for c in passages.chains(u, v):
            parts = np.split(np.array(c), np.flatnonzero(~passages.within_reach(u[c], v[c])) + 1)
            want += [(k, tuple(u[r]), tuple(v[r])) for r in parts]
    assert got == sorted(want)


def test_texts_stay_where_they_are_read(spark, monkeypatch):
    """Of more documents than are broadcast only words travel, those of documents in chains, and the passages are the same."""
    rng = random.Random(12)
    shared = " ".join(f"s{rng.randrange(9999)}" for _ in range(60))
    rows = [(d, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(20)), *([shared] if d % 2 else []), f"e{d}"])) for d in range(40)]
    docs = spark.createDataFrame([*rows, (None, shared), (99, None)], "doc_id long, text string")
    once = sorted(passages.shared_passages(docs).collect(), key=str)
    monkeypatch.setattr(passages, "WANTED_BYTES", 0)
    found = passages.shared_passages(docs)
    assert sorted(found.collect(), key=str) == once and len(once) >= 20
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()
