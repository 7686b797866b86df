"""SentencePiece encoding and decoding with the alignment of every piece to the bytes of the source.

A model file gives the pieces with their scores and the compiled character map: a double array trie over UTF-8 prefixes
and a pool of replacements. Normalising takes the longest prefix that the map knows at each place and records, for each
normalised byte, the source byte it came from; pieces found on the normalised text are projected through that record.
Merging is by score, leftmost first. Text splits into parts between which no piece can reach, and parts are remembered.

Defined results: a null or empty text has no pieces (the end id alone, where one is asked for); ids outside the model
decode to nothing; other columns play no part; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import session_of

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: Most parts that a worker remembers.
MEMORY = 300_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        i += 1
        out |= (c & 127) << shift
        if c < 128:
            return out, i
        shift += 7


def _fields(b: bytes):
    """(number, value) of a protocol buffer message; values are ints or bytes."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            v, i = b[i : i + n], i + n
        yield key >> 3, v


class CharacterMap:
    """The compiled map: 4 bytes of length, that many bytes of double array units, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.pool = blob[4 + n :]

    def longest(self, b: bytes, i: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of b[i:] and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for j in range(i, len(b)):
            node ^= b[j]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != b[j]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                at = units[node] & 0x7FFFFFFF
                found = (j + 1 - i, self.pool[at : self.pool.index(b"\0", at)])
        return found


class Model:
    """A BPE model read from a .model file."""

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.rank: dict[str, tuple[float, int]] = {}
        charsmap, self.dummy, self.squeeze, self.escape, suffix, model_type, self.byte_fallback = b"", True, True, True, 0, 1, 0
        for number, v in _fields(blob):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, x in _fields(v):
                    if n == 1:
                        text = x.decode()
                    elif n == 2:
                        score = struct.unpack("<f", x)[0]
                    elif n == 3:
                        kind = x
                self.pieces.append(text)
                self.kinds.append(kind)
                if kind in (NORMAL, USER, UNUSED):
                    self.rank[text] = (score, len(self.pieces) - 1)
            elif number == 2:
                spec = dict(_fields(v))
                model_type, suffix, self.byte_fallback = spec.get(3, 1), spec.get(24, 0), spec.get(35, 0)
            elif number == 3:
                spec = dict(_fields(v))
                charsmap, self.dummy, self.squeeze, self.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if model_type != 2 or suffix or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("only BPE models with space as a prefix and without user-defined or unused pieces are supported")
        self.map = CharacterMap(charsmap)
        self.unk = self.kinds.index(UNKNOWN)
        self.eos = next((i for i, p in enumerate(self.pieces) if self.kinds[i] == CONTROL and p == "</s>"), -1)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.score = {p: r[0] for p, r in self.rank.items()}
        self.parts = _parts({p[i : i + 2] for p in self.rank for i in range(len(p) - 1)})
        self.out = [p.replace(SPACE, " ").encode() if k in (NORMAL, USER, UNUSED) else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.widths = np.array([0 if k in (CONTROL, UNKNOWN) else 1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)], np.int64)
        self.decimals = [b" %d" % i for i in range(len(self.pieces))]
        self.known: dict[str, bytes] = {}

    # -- normalising -------------------------------------------------------------------------------------------------

    def plain(self, text: str) -> bool:
        """True if normalising is blanks to SPACE and the leading one only."""
        return not self.map.units and not self.squeeze and self.escape

    def normalized(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the source byte it came from."""
        b = text.encode()
        if not b:
            return "", np.zeros(1, np.int64)
        mark = SPACE.encode() if self.escape else b" "
        if self.plain(text):
            body = np.frombuffer(b, np.uint8)
            width = np.where(body == 32, len(mark), 1)
            at = np.repeat(np.arange(len(b)), width)
            head = mark if self.dummy else b""
            return (head + b.replace(b" ", mark)).decode(), np.concatenate([np.zeros(len(head), np.int64), at, [len(b)]])
        out, at, i = [], [], 0
        while i < len(b):
            found = self.map.longest(b, i)
            if found:
                n, new = found
            else:
                c = b[i]
                n = 1 if c < 128 else 2 if c < 224 else 3 if c < 240 else 4
                new = b[i : i + n]
            out.append(new)
            at.append((i, n))
            i += n
        end = len(b)
        if self.squeeze:  # blanks at the ends go, runs of blanks become one
            while out and out[0].strip(b" ") == b"":
                out.pop(0)
                at.pop(0)
            kept, places, blank = [], [], True
            for new, (i, n) in zip(out, at, strict=True):
                if blank:
                    new = new.lstrip(b" ")
                while b"  " in new:
                    new = new.replace(b"  ", b" ")
                if new:
                    blank = new.endswith(b" ")
                    kept.append(new)
                    places.append((i, n))
            while kept and kept[-1].endswith(b" "):
                end = places[-1][0]
                kept[-1] = kept[-1].rstrip(b" ")
                if not kept[-1]:
                    kept.pop()
                    places.pop()
            out, at = kept, places
            if not out:
                return "", np.full(1, len(b), np.int64)
        head = mark if self.dummy else b""
        text, align = [head], [np.full(len(head), at[0][0], np.int64)]
        for new, (i, _) in zip(out, at, strict=True):
            new = new.replace(b" ", mark)
            text.append(new)
            align.append(np.full(len(new), i, np.int64))
        align.append(np.full(1, end, np.int64))
        return b"".join(text).decode(), np.concatenate(align)

    # -- pieces ------------------------------------------------------------------------------------------------------

    def _merged(self, part: str) -> list[str]:
        """Merge neighbours, the best score first and of equal ones the leftmost."""
        rank, score = self.rank, self.score.get
        if len(part) <= 200:
            s, none = list(part), float("-inf")
            r = [score(x + y, none) for x, y in zip(s, s[1:], strict=False)]
            while r and (best := max(r)) != none:
                i = r.index(best)
                s[i] += s.pop(i + 1)
                del r[i]
                if i:
                    r[i - 1] = score(s[i - 1] + s[i], none)
                if i < len(r):
                    r[i] = score(s[i] + s[i + 1], none)
            return s
        s, after, before = list(part), list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        after[-1] = -1
        heap = [(-r[0], i, s[i] + s[i + 1]) for i in range(len(s) - 1) if (r := rank.get(s[i] + s[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if s[i] is None or j < 0 or s[i] + s[j] != both:
                continue
            s[i], s[j] = both, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := rank.get(both + s[k]):
                    heapq.heappush(heap, (-r[0], i, both + s[k]))
            if (h := before[i]) >= 0 and (r := rank.get(s[h] + both)):
                heapq.heappush(heap, (-r[0], h, s[h] + both))
        return [x for x in s if x is not None]

    def part(self, part: str) -> list[int]:
        """Ids of a stretch of normalised text outside of which its pieces can't reach."""
        ids: list[int] = []
        for p in self._merged(part):
            r = self.rank.get(p)
            if r is not None:
                ids.append(r[1])
            elif self.byte_fallback:
                ids += [self.byte_ids[c] for c in p.encode()]
            else:
                ids.append(self.unk)
        return ids

    def remembered(self, parts: list[str]) -> list[bytes]:
        """For each part its ids as little-endian 16-bit or 32-bit integers."""
        known, out, kind = self.known, [], "H" if len(self.pieces) < 65536 else "I"
        for x in parts:
            got = known.get(x)
            if got is None:
                ids = self.part(x)
                got = struct.pack(f"<{len(ids)}{kind}", *ids)
                if len(x) <= 64:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[x] = got
            out.append(got)
        return out

    def encoded(self, text: str, end: bool = True) -> np.ndarray:
        """The ids."""
        if self.plain(text):
            norm = (SPACE if self.dummy else "") + text.replace(" ", SPACE) if text else ""
        else:
            norm = self.normalized(text)[0]
        ids = np.frombuffer(b"".join(self.remembered(self.parts.findall(norm))), "<u2" if len(self.pieces) < 65536 else "<u4")
        if not self.byte_fallback and len(ids):  # neighbouring unknown pieces are one
            ids = ids[np.r_[True, (ids[1:] != self.unk) | (ids[:-1] != self.unk)]]
        return np.append(ids, self.eos).astype(np.int32) if end else ids.astype(np.int32)

    def text_of(self, ids: list[int]) -> bytes:
        """Decimals joined by blanks."""
        return b"".join(map(self.decimals.__getitem__, ids))[1:]

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Begin and end byte in the source of each id; ids that stand for no bytes get the end twice."""
        norm, align = self.normalized(text)
        if norm and self.byte_fallback:
            width = self.widths[ids]
        else:
            raw, at, width = norm.encode(), 0, np.zeros(len(ids), np.int64)
            for k, i in enumerate(ids.tolist()):
                if self.kinds[i] == NORMAL:
                    width[k] = len(self.pieces[i].encode())
                elif i == self.unk:  # reaches to the next known piece
                    nxt = next((self.pieces[j].encode() for j in ids[k + 1 :].tolist() if self.kinds[j] == NORMAL), None)
                    width[k] = (raw.index(nxt, at + 1) if nxt else len(raw)) - at
                at += width[k]
        ends = np.cumsum(width)
        return np.stack([align[ends - width], align[ends]], axis=1)

    def decoded(self, ids: list[int]) -> str:
        """Text of the ids; bytes join into characters unless a control id stands between them."""
        runs: list[list[int]] = [[]]
        if self.controls.isdisjoint(ids[:-1]):
            runs = [ids[:-1] if ids and ids[-1] in self.controls else ids]
        else:
            for i in ids:
                runs.append([]) if i in self.controls else runs[-1].append(i)
        out, n, texts = self.out, len(self.out), []
        for k, run in enumerate(r for r in runs if r):
            b = b"".join([out[i] for i in run if 0 <= i < n])
            if not k and self.dummy and b[:1] == b" " and self.kinds[run[0]] == NORMAL:
                b = b[1:]
            texts.append(b.decode("utf-8", "one-by-one"))
        return "".join(texts)


def _one_by_one(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�", e.start + 1


__import__("codecs").register_error("one-by-one", _one_by_one)

def _parts(near: set[str]) -> re.Pattern:
    """Cuts a text where no piece can reach across: into runs of characters that are neighbours in some piece, however
    distantly, with the SPACE marks before them. near: the pairs of neighbours within pieces."""
    if any(p[0] != SPACE and p[1] == SPACE for p in near):
        return re.compile("(?s).+")
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            c = root[c]
        return c

    for a, b in near:
        if a != SPACE:
            root[find(a)] = find(b)
    runs: dict[str, list[str]] = {}
    for c in sorted(root):
        runs.setdefault(find(c), []).append(c)
    kinds = ["[" + "".join(map(re.escape, r)) + "]+" for r in runs.values()]
    return re.compile(f"(?s){SPACE}*(?:{'|'.join([*sorted(kinds, key=len, reverse=True), f'[^{SPACE}]'])})|{SPACE}+")


_models: dict[str, Model] = {}


def load(path: str) -> Model:
    """The model at a path that every worker can open; kept for the life of the worker."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Model(f.read())
    return _models[path]


def by_id(docs: DataFrame, id_col: str, text_col: str, run, columns: str) -> DataFrame:
    """run over batches of _id (as text, as numbers beside nulls would lose digits) and _t; id_col and the columns."""
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    out = rows.mapInPandas(run, f"_id string, {columns}")
    return out.withColumn("_id", F.col("_id").cast(dict(docs.dtypes)[id_col])).withColumnRenamed("_id", id_col)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """id_col, ids array<int>, begins and ends array<int> (source bytes of each id), decoded string."""
    session_of(docs)

    def run(batches):
        m = load(model_path)
        for b in batches:
            rows = []
            for i, t in zip(b["_id"], b["_t"], strict=True):
                ids = m.encoded(t, end)
                s = m.spans(t, ids)
                rows.append((i, ids, s[:, 0].astype(np.int32), s[:, 1].astype(np.int32), m.decoded(ids.tolist())))
            yield pd.DataFrame(rows, columns=["_id", "ids", "begins", "ends", "decoded"])

    return by_id(docs, id_col, text_col, run, "ids array<int>, begins array<int>, ends array<int>, decoded string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256, n_bytes (source bytes), covered_bytes (bytes that the pieces' spans cover),
    spans_sha256 (of the spans of all ids: begin and end as little-endian 32-bit integers); with_ids: and ids array<int>."""
    session_of(docs)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "covered_bytes", "spans_sha256", *["ids"] * with_ids]

    def run(batches):
        m = load(model_path)
        for b in batches:
            rows = []
            for t in b["_t"]:
                ids = m.encoded(t)
                s = m.spans(t, ids)
                listed = ids.tolist()
                back = m.decoded(listed)
                rows.append((len(ids), hashlib.sha256(m.text_of(listed)).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), len(t.encode()), int((s[:, 1] - s[:, 0]).sum()), hashlib.sha256(s.astype("<i4").tobytes()).hexdigest(), *[ids] * with_ids))
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "_id", b["_id"])
            yield out

    return by_id(docs, id_col, text_col, run, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, covered_bytes long, spans_sha256 string" + ", ids array<int>" * with_ids)
