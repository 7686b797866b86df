"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base spans are leftmost, non-overlapping matches of each kind's pattern that pass its check. They are the seeds, beside
secrets (SECRET: long runs of letters and digits mixed), which only the method knows as a kind. The words around each seed,
around each other token with a digit or an @, each run of digit groups (joined by blank, dot, bracket or hyphen) and each
address with its @ or dots written out are lexical patterns: one or two words on one side, one on both, and one word with
the value's shape. Patterns and the values seen in them form a graph. A pattern's confidence for a kind is the mean score of
its values (with SMOOTH added to the count), a value's score is the best confidence of its patterns (a seed's is 1); ROUNDS
turns of this are Spark joins and sums over the whole graph. Values whose score reaches ACCEPT become spans of that kind; of
those found that lie within a longer one, the longer one counts. Numbers in a card's or an address's form that fail its check
are no seeds and are never found, but speak against their patterns.

Defined results: a null or empty text has no spans; positions count code points, ends are exclusive; rows that repeat
give repeated rows; null ids stay null; an empty table gives an empty result; other columns play no part. A value of more
than LONG characters stands in the graph for itself by a digest.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import session_of, stored

#: The base kinds, in their order, and what the method finds beside them.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Domain from the @ on; the local part is what stands before it.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
#: A number begins where no digit stands before it: later starts within it would fail in the same way.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GROUPS = re.compile(r"(?<!\w)\(?[0-9]++(?:[\x20.()-]{1,3}+[0-9]++)++(?!\w)")
DIGIT_OR_AT = re.compile("[0-9@]")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]*[0-9])(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{32,128}+(?![A-Za-z0-9])")
#: name at host dot com, with or without brackets around the words
SPELT = re.compile(r"(?i)(?<!\w)[\w.+-]{1,64}+\s?(?:[(\[{]\s?at\s?[)\]}]|\sat\s)\s?[\w-]{1,64}+(?:\s?(?:[(\[{]\s?dot\s?[)\]}]|\sdot\s)\s?[\w-]{1,64}+)++")
WRITTEN = re.compile(r"(?i)\bdot\b")
SEPARATORS = re.compile("[^0-9]+")
TOKEN_END = re.compile(r"\s|\Z")
EDGE = "\"'()[]{}<>.,;:!?#$%&*|="
ROUNDS, ACCEPT, SMOOTH, SUPPORT = 3, 0.75, 1.0, 3
LONG = 200


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, @ and domain, found from each @ outwards."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > low and LOCAL_END.match(text, a - 1):
            a -= 1
        m = DOMAIN.match(text, at) if a < at else None
        if m:
            out.append((a, m.end()))
            low = m.end()
        else:
            low = at + 1  # no local part reaches over an @
        at = text.find("@", max(low, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in that order."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT_OR_AT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 14 <= len(d := SEPARATORS.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(SEPARATORS.sub("", m[0])) <= 15]
    return sorted(out)


def refuted(value: str) -> bool:
    """Whether a value has a base kind's form and fails its check: it counts in its patterns but is never found."""
    if IP.fullmatch(value):
        return all(len(p) <= 3 for p in value.split("."))
    return bool(CARD.fullmatch(value)) and 14 <= len(d := SEPARATORS.sub("", value)) <= 19 and not luhn(d)


def secrets(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of letters and digits mixed, that touch no base span."""
    out = [(m.start(), KINDS.index("secret"), m.end()) for m in SECRET.finditer(text)] if DIGIT_OR_AT.search(text) else []
    return [x for x in out if not any(a < x[2] and x[0] < b for a, _, b in taken)]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def tokens(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches without blanks that hold a digit or an @, without signs at their edges, and runs of digit groups; none
    touches a base span. Parts of a run of under 5 characters are no stretches of their own."""
    out, at = [], 0
    runs = [(m.start() + (m[0][0] == "(" and ")" not in m[0]), m.end()) for m in GROUPS.finditer(text)]
    if WRITTEN.search(text):
        runs = sorted(runs + [m.span() for m in SPELT.finditer(text)])
    bases, j = sorted((a, b) for a, _, b in taken), 0
    for a, b in runs:
        while j < len(bases) and bases[j][1] <= a:
            j += 1
        if j == len(bases) or bases[j][0] >= b:
            out.append((a, b))
    free, r = out[:], 0
    ends = iter(sorted((a, b) for a, _, b in taken))
    span = next(ends, None)
    while m := DIGIT_OR_AT.search(text, at):
        b = TOKEN_END.search(text, m.start()).start()
        a = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        at = b
        while span and span[1] <= a:
            span = next(ends, None)
        while a < b and text[a] in EDGE:
            a += 1
        while b > a and text[b - 1] in EDGE:
            b -= 1
        while r < len(free) and free[r][1] <= a:
            r += 1
        part = r < len(free) and free[r][0] < b and (b - a < 5 or free[r] == (a, b))
        if b > a and not part and not (span and span[0] < b):
            out.append((a, b))
    return sorted(out)


def shape(value: str) -> str:
    """A value's signs, with a for letters and 0 for digits, however many."""
    return re.sub("[0-9]+", "0", re.sub(r"[^\W\d_]+", "a", value[:LONG]))


def contexts(text: str, a: int, b: int) -> list[str]:
    """The lexical patterns around a stretch: two words or one before it, one on each side, two or one after it, and one word
    with the shape of the stretch."""

    def plain(words: list[str]) -> list[str]:
        return [re.sub("[0-9]+", "0", w.strip(EDGE).lower()) or w[:1] for w in words]

    left = plain(text[max(0, a - 80) : a].split()[-2:])
    right = plain(text[b : b + 80].split()[:2])
    last, first, form = " ".join(left[-1:]), " ".join(right[:1]), shape(text[a:b])
    return [f"{' '.join(left)} _", f"{last} _ {first}", f"_ {' '.join(right)}", f".. {last} _", f"_ {first} ..", f"{last} {form}", f"{form} {first}"]


def named(value: str) -> str:
    return value.lower() if len(value) <= LONG else hashlib.md5(value.encode(), usedforsecurity=False).hexdigest()


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row, id_col, base spans and every value with its patterns; one pass over the texts."""
    session_of(docs)
    span = "array<struct<start:int,kind:int,end:int>>"
    seen = "array<struct<start:int,kind:int,end:int,value:string,patterns:array<string>>>"

    def run(batches):
        for b in batches:
            base, values = [], []
            for t in b["_t"]:
                spans = base_spans(t)
                more = secrets(t, spans)
                found = [*spans, *more, *((x, -2 if refuted(t[x:y]) else -1, y) for x, y in tokens(t, sorted(spans + more)))]
                base.append([{"start": x, "kind": k, "end": y} for x, k, y in spans])
                values.append([{"start": x, "kind": k, "end": y, "value": named(t[x:y]), "patterns": contexts(t, x, y)} for x, k, y in found])
            yield pd.DataFrame({"_row": b["_row"], "_id": b["_id"], "base": base, "values": values})

    # ids travel as text: as numbers beside nulls they would lose digits
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    out = rows.mapInPandas(run, f"_row long, _id string, base {span}, values {seen}")
    return stored(out.withColumn("_id", F.col("_id").cast(dict(docs.dtypes)[id_col])), "pii")


def discovered(seen: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, support: int = SUPPORT) -> DataFrame:
    """(value, kind, score): values that high-confidence patterns vouch for. seen: value, kind (-1: no seed, -2: none and refuted), pattern."""
    edges = stored(seen.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-graph")
    size = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    seeds = edges.filter("kind >= 0").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    scores = seeds
    for _ in range(rounds):
        known = edges.select("pattern", "value").join(scores, "value")
        trust = known.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("m")).filter(F.col("m") >= support - 1)
        trust = trust.join(size, "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + SMOOTH)).alias("trust")).filter(F.col("trust") >= accept / 2)
        trust = stored(trust, "pii-patterns")
        found = edges.filter("kind = -1").join(trust, "pattern").groupBy("value", trust["kind"]).agg(F.max("trust").alias("score"))
        scores = stored(seeds.unionByName(found.filter(F.col("score") >= accept / 2)), "pii-scores")
    best = scores.filter(F.col("score") >= accept).groupBy("value").agg(F.max(F.struct("score", -F.col("kind"))).alias("b"))
    return best.select("value", (-F.col("b.col2")).cast("int").alias("kind"), F.col("b.score").alias("score"))


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """id_col, base and spans: arrays of (start, kind, end)."""
    rows = scanned(docs, id_col, text_col)
    each = rows.select("_row", F.explode("values").alias("v"))
    seen = each.select("v.value", "v.kind", F.explode("v.patterns").alias("pattern"))
    new = discovered(seen, rounds, accept)
    own = each.filter(F.col("v.kind") >= len(BASE)).select("_row", "v.start", "v.kind", "v.end")
    more = each.filter("v.kind = -1").select("_row", "v.start", "v.end", "v.value").join(new, "value")
    more = more.select("_row", "start", "kind", "end").unionByName(own).groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    longer = lambda s: lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])
    more = more.withColumn("more", F.filter("more", lambda s: ~F.exists("more", longer(s))))
    out = rows.select("_row", "_id", "base").join(more, "_row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return out.select(F.col("_id").alias(id_col), "base", spans.alias("spans"))


def span_text(spans):
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans (all, those of the method included)."""
    out = found_in(docs, id_col, text_col)

    def of_kind(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return out.select(id_col, *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def brute_sha(text: str) -> str:
    return hashlib.sha256(joined(base_spans(text)).encode()).hexdigest()
