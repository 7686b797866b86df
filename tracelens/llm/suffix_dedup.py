"""Repeated byte strings, found with suffix arrays that are built by linear grouping.

Two strings of LENGTH bytes that are equal have the same smallest gram hash. So each document is cut into runs of starts
whose strings have the same smallest gram; a run's bytes travel under that gram, if the gram occurs more than once in all
documents, and all equal strings meet in one place. Equal stretches collapse to the earliest, those of one task before
they travel. The stretches that remain under a gram make one text, whose suffix array is built in two phases:

1. Suffixes are grouped by their longest Lyndon prefix: groups are taken from the highest down; each suffix of a group
   looks for the nearest smaller group before it (the previous-smaller pointer), and the suffixes pointed at move, by how
   often they are pointed at, to a new group right above their own.
2. Groups' orders are emitted from the smallest suffix up: the suffix before it, and in turn that one's previous smaller
   suffix, take the next places of their groups. No suffix is renamed again.

Many texts go through both phases side by side in numpy. Neighbours in the suffix array with LENGTH equal bytes are the
same string; of each, the one with the smallest document id, then the smallest start, stays.

Grams that occur in very many places (HOT of them at least, and one in 100,000 of all) are split by a second smallest
gram. Copies of one passage have both in common: their equal stretches collapse within each task before they travel, but
the stretches at the passage's ends differ and do meet, some 250 bytes for each document that holds it.

Defined results: texts are UTF-8 bytes, a null text is empty; texts shorter than LENGTH lose nothing; ids are integers,
a null id is the lowest; of rows with equal ids the order is by a hash of the text, and rows that repeat both id and text
count as one (each is returned); an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import key_filter, minimizers, mixed, passing, session_of, sliding, stored

LENGTH, GRAM = 100, 24
HOT, HOT_SHARE = 20_000, 100_000
#: Starts in one run at most (longer ones are cut), bytes of texts that are sorted at once, and rows of an output batch.
RUN, SORT_BYTES, ROWS = 256, 2 << 20, 20_000
#: Bytes of a group from which on it is cut again by other grams, and how often.
GROUP_BYTES, LEVELS = 1024, 3
#: Texts of one length from which on they are sorted side by side.
FEW = 32
NULL_ID = -(2**63)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)


# -- suffix arrays of many texts side by side ---------------------------------------------------------------------------


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def suffix_arrays(text: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffix arrays of the texts that lie at base, one after the other; each ends with its one smallest symbol.

    Side by side a step costs about as much for one text as for many, so few texts go one by one."""
    if len(text) < FEW * int(size.max()):
        return np.concatenate([np.array(suffix_array(text[b : b + n].tolist())) + b for b, n in zip(base.tolist(), size.tolist(), strict=True)])
    n = len(text)
    block = np.repeat(np.arange(len(base)), size)
    key = block * (int(text.max()) + 1) + text
    order = np.argsort(key, kind="stable")
    sa, slot = order.astype(np.int32), np.empty(n, np.int32)
    slot[order] = np.arange(n)
    opens = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    del key, block
    held = np.zeros(n, np.int32)  # suffixes in the group that begins at a slot
    held[opens] = np.diff(np.r_[opens, n])
    group = np.empty(n, np.int32)  # first slot of a suffix's group
    group[order] = np.repeat(opens, held[opens])
    del order
    smaller = np.arange(n, dtype=np.int32) - 1  # previous-smaller pointers, once known
    smaller[base] = -1
    _group(sa, slot, group, held, smaller, base, base + size - 1)
    return _emit(group, smaller, base, size)


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of one text by the same two phases, one suffix at a time."""
    n = len(text)
    sa = sorted(range(n), key=text.__getitem__)
    slot, group, held = [0] * n, [0] * n, [0] * n
    first = 0
    for i, s in enumerate(sa):
        slot[s] = i
        if i and text[s] != text[sa[i - 1]]:
            first = i
        group[s] = first
        held[first] += 1
    smaller = list(range(-1, n - 1))
    last = n - 1
    while last >= 0:
        first = group[sa[last]]
        times: dict[int, int] = {}
        for s in sorted(sa[first : last + 1]):
            p = smaller[s]
            while p >= 0 and group[p] >= first:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        for k in sorted(set(times.values()), reverse=True):
            lifted: dict[int, list[int]] = {}
            for p, c in times.items():
                if c == k:
                    lifted.setdefault(group[p], []).append(p)
            for g, ps in lifted.items():
                end = g + held[g]
                for p in ps:
                    end -= 1
                    q, i = sa[end], slot[p]
                    sa[i], slot[q], sa[end], slot[p] = q, i, p, end
                    group[p] = g + held[g] - len(ps)
                held[g] -= len(ps)
                held[end] = len(ps)
        last = first - 1
    out, placed, free = [-1] * n, [False] * n, list(range(n))
    out[0], placed[n - 1] = n - 1, True
    free[group[n - 1]] += 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]], placed[s] = s, True
            free[g] += 1
            s = smaller[s]
    return out


def _group(sa, slot, group, held, smaller, base, last) -> None:
    count, moved = np.zeros(len(sa), np.int32), np.zeros(len(sa), bool)
    low, last = base.copy(), last.copy()
    while len(last):
        first = group[sa[last]]
        members = sa[_ragged(first, last - first + 1)]
        at, here = smaller[members], group[members]
        open_ = np.flatnonzero((at >= 0) & (group[at] >= here))
        while len(open_):
            at[open_] = smaller[at[open_]]
            smaller[members[open_]] = at[open_]
            x = at[open_]
            open_ = open_[(x >= 0) & (group[x] >= here[open_])]
        smaller[members] = at
        at = at[at >= 0]
        if len(at):
            np.add.at(count, at, 1)
            seen = np.unique(at)
            times = count[seen]
            count[seen] = 0
            for k in range(int(times.max()), 0, -1):
                if len(chosen := seen[times == k]):
                    _lift(chosen, sa, slot, group, held, moved)
        last = first - 1
        on = last >= low
        last, low = last[on], low[on]


def _lift(chosen, sa, slot, group, held, moved) -> None:
    """Move the chosen suffixes to the ends of their groups' slots, as new groups there."""
    own = group[chosen]
    order = np.argsort(own, kind="stable")
    chosen, own = chosen[order], own[order]
    begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    groups, many = own[begin], np.diff(np.r_[begin, len(own)])
    new = groups + held[groups] - many
    target, start = _ragged(new, many), np.repeat(new, many)
    moved[chosen] = True
    there = sa[target]
    stay = ~moved[there]
    moved[chosen] = False
    out, into = there[stay], target[stay]
    coming = chosen[slot[chosen] < start]
    left = slot[coming]
    sa[into], slot[coming] = coming, into
    sa[left], slot[out] = out, left
    group[chosen] = start
    held[groups] -= many
    held[new] = many


def _emit(group, smaller, base, size) -> np.ndarray:
    n = len(group)
    sa, placed, free = np.full(n, -1, np.int32), np.zeros(n, bool), np.arange(n, dtype=np.int32)
    end = base + size
    first = end - 1  # the last symbol is the smallest suffix
    sa[base], placed[first] = first, True
    free[group[first]] += 1
    i, at, low = base.copy(), np.where(first > base, first - 1, -1), base.copy()
    while len(i):
        put = at >= 0
        put[put] = ~placed[at[put]]
        s = at[put]
        g = group[s]
        sa[free[g]] = s
        free[g] += 1
        placed[s] = True
        at[put] = smaller[s]
        go = np.flatnonzero(~put)
        if len(go):
            i[go] += 1
            live = i[go] < end[go]
            if not live.all():
                keep = np.ones(len(i), bool)
                keep[go[~live]] = False
                i, at, low, end, put = i[keep], at[keep], low[keep], end[keep], put[keep]
                go = np.flatnonzero(~put)
            nxt = sa[i[go]]
            at[go] = np.where(nxt > low[go], nxt - 1, -1)
    return sa


# -- repeats among stretches --------------------------------------------------------------------------------------------


def repeated_starts(groups: list[list[bytes]], length: int = LENGTH) -> list[np.ndarray]:
    """For each stretch, the starts of its strings of `length` bytes that are not the first of their kind in their group.

    The stretches of a group come in the order of their documents and starts.
    """
    flat = [s for g in groups for s in g]
    sizes = np.array([len(b) for b in flat], np.int64)
    per = np.array([len(g) for g in groups], np.int64)
    raw = np.frombuffer(b"\0".join(flat) + b"\0" * 8, np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = raw[: int(sizes.sum()) + len(flat)].astype(np.int64) + 2
    text[begin + sizes] = 1
    ends = np.cumsum(per) - 1
    text[(begin + sizes)[ends]] = 0
    lead = begin[np.cumsum(per) - per]
    total = np.diff(np.r_[lead, len(text)])
    sa = suffix_arrays(text, lead, total)
    whole = np.zeros(len(text), bool)
    fit = np.maximum(sizes - length + 1, 0)
    whole[_ragged(begin, fit)] = True
    order = sa[whole[sa]]
    words = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), strides=(1,))
    a, b = order[:-1], order[1:]
    block = np.repeat(np.arange(len(groups)), total)
    same = np.flatnonzero(block[a] == block[b])
    for k in [*range(0, length - 7, 8), length - 8]:
        same = same[words[a[same] + k] == words[b[same] + k]]
    joined = np.zeros(len(order), bool)
    joined[same + 1] = True
    kind = np.cumsum(~joined)
    # stretches lie in their order, so the first place of a kind is its first string
    by = np.lexsort((order, kind))
    later = np.r_[False, kind[by][1:] == kind[by][:-1]] if len(by) else np.zeros(0, bool)
    gone = np.zeros(len(text), bool)
    gone[order[by][later]] = True
    return [np.flatnonzero(gone[x : x + f]) for x, f in zip(begin.tolist(), fit.tolist(), strict=True)]


def spans_of(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """The maximal stretches that strings of `length` at sorted starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist(), strict=True))


# -- runs ---------------------------------------------------------------------------------------------------------------


def grams(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of the bytes at each place and the gram - 1 after it, by doubling."""
    out, have, rest, done = _BYTE[b], 1, gram, None
    length = 0
    power = _STEP
    while rest:
        if rest & 1:
            if done is None:
                done, length = out, have
            else:
                n = len(b) - length - have + 1
                done = done[:n] * power + out[length : length + n] if n > 0 else done[:0]
                length += have
        rest >>= 1
        if rest:
            n = len(out) - have
            out = out[:n] * power + out[have : have + n] if n > 0 else out[:0]
            have *= 2
            power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
    return mixed(done)


def chosen_grams(text: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The smallest gram of every string of `length` bytes, once for each place where it stands."""
    if len(text) < length:
        return np.zeros(0, np.uint64)
    g = grams(np.frombuffer(text, np.uint8), gram)
    return g[minimizers(g, length - gram + 1)]


def runs(text: bytes, hot: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first start, starts, whether the key is part of a hot one) of the runs of a text."""
    if len(text) < length:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z > 0
    g = grams(np.frombuffer(text, np.uint8), gram)
    low = sliding(g, length - gram + 1)
    split = np.isin(low, hot) if len(hot) else np.zeros(len(low), bool)
    if split.any():
        second = sliding(mixed(g + _STEP), length - gram + 1)
        low = np.where(split, mixed(low * _STEP + second), low)
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    many = np.diff(np.r_[first, len(low)])
    if many.max() > RUN:
        pieces = -(-many // RUN)
        within = _ragged(np.zeros(len(many), np.int64), pieces)
        first, many = np.repeat(first, pieces) + within * RUN, np.minimum(RUN, np.repeat(many, pieces) - within * RUN)
    return low[first], first, many, split[first]


def repeats_within(stretch: bytes, length: int = LENGTH, gram: int = GRAM) -> bool:
    """Whether a stretch can hold one of its own strings twice: what all its strings have in common stands in it again."""
    n = len(stretch) - length + 1
    return n > length - gram or n > 1 and stretch.find(stretch[n - 1 : length], n) >= 0


SPANS = "_id long, key long, start int, end int"


def removed_spans(docs: DataFrame) -> DataFrame:
    """(_id, key, start, end): stretches of repeated strings; they may overlap. docs: _id, key, _t."""
    spark = session_of(docs)
    def counted(batches):
        for b in batches:
            yield pd.DataFrame({"keys": [chosen_grams(t.encode("utf-8", "replace")).view(np.int64) for t in b["_t"]]})

    counts = docs.select("_t").mapInPandas(counted, "keys array<long>").select(F.explode("keys").alias("key")).groupBy("key").count()
    counts = stored(counts.filter("count > 1"), "repeat-grams")
    n = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("s")).first()
    often = max(HOT, n["s"] // HOT_SHARE)
    # at most HOT_SHARE keys can be as frequent as that
    hot = spark.sparkContext.broadcast(np.sort(np.array([r["key"] for r in counts.filter(F.col("count") >= often).select("key").collect()], np.int64).view(np.uint64)))
    bits = key_filter(counts.select("key"), n["n"])

    def cut(batches):
        best: dict[bytes, tuple] = {}
        for b in batches:
            out = []
            for i, k, t in zip(b["_id"].tolist(), b["key"].tolist(), b["_t"], strict=True):
                t = t.encode("utf-8", "replace")
                key, first, many, split = runs(t, hot.value)
                ok = split | passing(bits.value, key)  # parts of hot grams were not counted
                for x, a, m in zip(key[ok].view(np.int64).tolist(), first[ok].tolist(), many[ok].tolist(), strict=True):
                    stretch = t[a : a + m + LENGTH - 1]
                    name = hashlib.blake2b(stretch, digest_size=20).digest()  # nobody can make two stretches of one name
                    at = (i, k, a)
                    known = best.get(name)
                    if known is None or at < known:
                        if len(best) > 200_000:
                            best.clear()
                        best[name] = at
                        out.append((x, i, k, a, a + len(stretch), stretch))
                    elif at > known:  # an equal stretch stands earlier
                        out.append((x, i, k, a, a + len(stretch), None))
            if out:
                yield pd.DataFrame(out, columns=["gram", "_id", "key", "start", "end", "bytes"])

    # a task's later copies carry no bytes; they are removed as they are
    found = docs.mapInPandas(cut, "gram long, _id long, key long, start int, end int, bytes binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # copies without bytes don't meet: they are dealt by their document
    place = F.when(F.col("bytes").isNull(), F.xxhash64("key", "start")).otherwise(F.col("gram"))
    dealt = found.repartition(parts, place).sortWithinPartitions("gram", "_id", "key", "start")

    def judged(batches):
        gram, own, rows = None, {}, []
        groups, size = [[], []], [0, 0]  # small ones, and large ones, which take many steps and so go many together

        def close():
            nonlocal own
            found, copies = divided(own)
            rows.extend(copies)
            for g in found:
                n = sum(len(b) for b, _ in g)
                groups[n > GROUP_BYTES].append(g)
                size[n > GROUP_BYTES] += n
            own = {}

        def sort(which):
            for big in _by_size(groups[which]):
                flat = [x for g in big for x in g]
                for (_, (i, k, a)), s in zip(flat, repeated_starts([[b for b, _ in g] for g in big]), strict=True):
                    rows.extend((i, k, a + x, a + y) for x, y in spans_of(s))
            groups[which], size[which] = [], 0

        def full():
            nonlocal rows
            out, rows = rows, []
            return pd.DataFrame(out, columns=["_id", "key", "start", "end"])

        for b in batches:
            for x, i, k, a, e, stretch in zip(b["gram"].tolist(), b["_id"].tolist(), b["key"].tolist(), b["start"].tolist(), b["end"].tolist(), b["bytes"], strict=True):
                if stretch is None:
                    rows.append((i, k, a, e))
                    continue
                if x != gram:
                    close()
                    gram = x
                    for n in (0, 1):
                        if size[n] > SORT_BYTES:
                            sort(n)
                            if len(rows) >= ROWS:
                                yield full()
                if stretch not in own:
                    own[stretch] = (i, k, a)
                elif own[stretch] != (i, k, a):
                    rows.append((i, k, a, e))
            if len(rows) >= ROWS:
                yield full()
        close()
        sort(0)
        sort(1)
        if rows:
            yield full()

    return dealt.mapInPandas(judged, SPANS)


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common at their beginnings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is common, a[:high] isn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _furthest(parts: list[bytes]) -> list[int]:
    """For each string the most bytes that it has in common with another one: neighbours in their order have the most."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        n = _common(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def _level_grams(b: bytes, level: int) -> np.ndarray:
    """Gram hashes by which texts are cut at first, and anew at each further level."""
    g = grams(np.frombuffer(b, np.uint8))
    return mixed(g + np.uint64((0xD6E8FEB86659FD93 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)) if level else g


def trimmed(group: list[tuple[bytes, tuple[int, int, int]]], level: int) -> list[tuple[bytes, tuple[int, int, int]]]:
    """The group's stretches without the ends in which no string can equal one of another stretch.

    All strings of a group hold its gram. Where each stretch holds it once, equal strings of two stretches lie within what
    those have in common on both sides of it, and a stretch that has less than LENGTH in common with all others goes.
    """
    first = group[0][0]
    at = int(_level_grams(first, level).argmin())
    gram = first[at : at + GRAM]
    places = [b.find(gram) for b, _ in group]
    if any(p < 0 or b.find(gram, p + 1) >= 0 for p, (b, _) in zip(places, group, strict=True)):
        return group
    left = _furthest([b[:p][::-1] for p, (b, _) in zip(places, group, strict=True)])
    right = _furthest([b[p:] for p, (b, _) in zip(places, group, strict=True)])
    return [(b[p - x : p + y], (i, k, a + p - x)) for p, x, y, (b, (i, k, a)) in zip(places, left, right, group, strict=True) if x + y >= LENGTH]


def divided(own: dict[bytes, tuple[int, int, int]], level: int = 0) -> tuple[list[list[tuple[bytes, tuple[int, int, int]]]], list[tuple[int, int, int, int]]]:
    """The stretches under one gram, in their order, as groups to be sorted; and (id, key, start, end) of what is a copy.

    A large group is cut again by other smallest grams, as long as that makes it smaller: equal strings stay together,
    and what its stretches have in common becomes equal parts, of which the first stays.
    """
    copies: list[tuple[int, int, int, int]] = []
    if len(own) > 1:
        group, own = trimmed(list(own.items()), level), {}
        for part, at in group:  # stretches that are equal now: the first in the order stays
            if part in own:
                copies.append((at[0], at[1], at[2], at[2] + len(part)))
            else:
                own[part] = at
    if sum(map(len, own)) <= GROUP_BYTES or level == LEVELS:
        return ([list(own.items())] if len(own) > 1 or own and repeats_within(next(iter(own))) else []), copies
    parts: dict[int, dict[bytes, tuple[int, int, int]]] = {}
    groups = []
    for stretch, (i, k, a) in own.items():
        g = _level_grams(stretch, level + 1)
        low = sliding(g, LENGTH - GRAM + 1)
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        for x, f, e in zip(low[first].tolist(), first.tolist(), [*first[1:].tolist(), len(low)], strict=True):
            part = stretch[f : e + LENGTH - 1]
            held = parts.setdefault(x, {})
            if part in held:
                copies.append((i, k, a + f, a + f + len(part)))
            else:
                held[part] = (i, k, a + f)
    for held in parts.values():
        more, gone = divided(held, level + 1)
        groups += more
        copies += gone
    return groups, copies


def _by_size(groups: list) -> list[list]:
    """Groups of about equal size together, as they take about equally many steps."""
    out: dict[int, list] = {}
    for g in groups:
        out.setdefault(sum(len(b) for b, _ in g).bit_length() // 2, []).append(g)
    return list(out.values())


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256; with texts also the removed spans and the remaining bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    rows = docs.select(whole.alias("_id"), F.xxhash64(whole, text).alias("key"), text.alias("_t"))
    spans = removed_spans(rows).groupBy("_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = dict(docs.dtypes)[id_col]
    both = docs.select(F.col(id_col).cast("string").alias("_own"), whole.alias("_id"), F.xxhash64(whole, text).alias("key"), text.alias("_t")).join(spans, ["_id", "key"], "left").select("_own", "_t", "spans")

    def run(batches):
        for b in batches:
            out = []
            for t, s in zip(b["_t"], b["spans"], strict=True):
                t = t.encode("utf-8", "replace")
                gone, end, kept = [], 0, []
                for x, y in sorted((v["start"], v["end"]) for v in s) if s is not None else []:
                    if gone and x <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], y)
                    else:
                        gone.append([x, y])
                for x, y in gone:
                    kept.append(t[end:x])
                    end = y
                kept = b"".join([*kept, t[end:]])
                row = (len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
                out.append((*row, [{"start": x, "end": y} for x, y in gone], kept) if texts else row)
            more = ["spans", "kept"] if texts else []
            d = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *more])
            d.insert(0, "_own", b["_own"])
            yield d

    more = ", spans array<struct<start:int,end:int>>, kept binary" if texts else ""
    out = both.mapInPandas(run, f"_own string, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
    return out.withColumn("_own", F.col("_own").cast(kind)).withColumnRenamed("_own", id_col)
