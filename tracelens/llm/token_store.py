"""Token ids in a directly addressable binary format.

An id is cut into chunks of CHUNK bits, the lowest first. Level k holds the k-th chunk of every id that has one, and one
bit for each that says whether the id goes on in level k + 1. A rank directory counts the set bits before each block of
512, so that id i is found by one rank per level: three short reads in each, and no other part of the file is read.

File format (little-endian): magic b"DAC2", u32 CHUNK bits (8), u64 ids, u32 levels, u32 documents, and for each level the
u64 number of its entries; then, for each level, the chunks (u8), the bits (u64 words, lowest bit first, whole blocks) and
the directory (u64 for each block of 512 bits); then the documents' starts (u64, one more than documents) and their doc
ids (i64). A file holds whole documents. Files lie in the shared folder, and readers seek in them.

Texts are encoded where they lie; only the ids are dealt by ranges of the document id.

Defined results: a null or empty text has the end id alone; null doc ids stand first and are stored as -2**63; rows that
repeat are stored again; an empty table gives no files; other columns play no part.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import file_system, session_of, shared_path, stored

MAGIC, CHUNK, BLOCK = b"DAC2", 8, 512
NULL_ID = -(2**63)
#: Ids in a file, at least, before the next one begins (a document is never cut).
FILE_IDS = 1 << 20
#: Stretches that a worker remembers at most.
MEMORY = 600_000
#: Ranges of ids for each task, so that those which fall to one task are about as many for all.
PARTS_A_TASK = 4
#: Documents of an output batch of the reader.
ROWS = 4096


def level_bits(more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a bitmap and the count of set bits before each block of BLOCK."""
    packed = np.zeros((len(more) + BLOCK - 1) // BLOCK * BLOCK, np.uint8)
    packed[: len(more)] = more
    counts = packed.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
    return np.packbits(packed, bitorder="little").view("<u8"), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u8") if len(counts) else np.zeros(0, "<u8")


def pack(ids: np.ndarray, starts: np.ndarray, doc_ids: np.ndarray) -> bytes:
    levels, sizes, rest = [], [], ids.astype(np.uint32)
    while True:
        chunk, rest = (rest & ((1 << CHUNK) - 1)).astype(np.uint8), rest >> CHUNK
        more = rest > 0
        words, directory = level_bits(more)
        sizes.append(len(chunk))
        levels += [chunk.tobytes(), words.tobytes(), directory.tobytes()]
        rest = rest[more]
        if not len(rest):
            break
    head = MAGIC + struct.pack("<IQII", CHUNK, len(ids), len(sizes), len(doc_ids)) + struct.pack(f"<{len(sizes)}Q", *sizes)
    return b"".join([head, *levels, starts.astype("<u8").tobytes(), doc_ids.astype("<i8").tobytes()])


class TokenFile:
    """Random access to the ids of one file; read(n, offset) gives n of its bytes, and only what is asked for is read."""

    def __init__(self, read):
        self.read = read
        head = read(24, 0)
        chunk, self.n, levels, self.docs = struct.unpack_from("<IQII", head, 4)
        if head[:4] != MAGIC or chunk != CHUNK:
            raise ValueError("not a token file")
        at, self.levels = 24 + 8 * levels, []
        for n in struct.unpack(f"<{levels}Q", read(8 * levels, 24)):
            blocks = -(-n // BLOCK)
            self.levels.append((at, at + n, at + n + blocks * BLOCK // 8))
            at += n + blocks * (BLOCK // 8 + 8)
        self.index = at

    def starts(self) -> np.ndarray:
        """Where the documents begin, and the end of the last."""
        return np.frombuffer(self.read(8 * (self.docs + 1), self.index), "<u8").astype(np.int64)

    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self.read(8 * self.docs, self.index + 8 * (self.docs + 1)), "<i8")

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b: one rank per level, as neighbours in a level stay neighbours in the next."""
        out, who = np.zeros(b - a, np.uint32), None
        for k, (chunks, words, directory) in enumerate(self.levels):
            if a == b:
                break
            part = np.frombuffer(self.read(b - a, chunks + a), np.uint8).astype(np.uint32) << np.uint32(CHUNK * k)
            if who is None:
                out |= part
            else:
                out[who] |= part
            if k + 1 == len(self.levels):
                break
            block = a // BLOCK
            first = block * BLOCK
            bits = np.unpackbits(np.frombuffer(self.read(-(-(b - first) // 8), words + first // 8), np.uint8), bitorder="little")
            on = np.flatnonzero(bits[a - first : b - first])
            (before,) = struct.unpack("<Q", self.read(8, directory + 8 * block))
            a = before + int(np.count_nonzero(bits[: a - first]))
            b = a + len(on)
            who = on if who is None else who[on]
        return out

    def at(self, i: int) -> int:
        """The id at a place."""
        return int(self.slice(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        a, b = struct.unpack("<QQ", self.read(16, self.index + 8 * k))
        return self.slice(a, b)


#: White space as the byte-level pattern knows it, letters and other signs of common texts. A text is cut where that
#: pattern always cuts: after a run of letters before a sign or a blank, after a run of signs before a blank or (but for
#: an apostrophe) a letter, and around white space; stretches with any other character reach to the next white space.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!-@\\[-`{-~"
WORD = re.compile(f" ?[{_LETTERS}]+")
STRETCH = re.compile(f" ?[{_LETTERS}]++(?=[{_WS}{_SIGNS}]|\\Z)| ?[{_SIGNS}]++(?=[{_WS}]|\\Z|(?<!')[{_LETTERS}])| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def _byte_names() -> dict[int, str]:
    """The printable character by which byte-level vocabularies call each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}


class Encoder:
    """A tokenizers file; stretches of text between sure cuts are encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        pre, model = self.lib.pre_tokenizer, self.lib.get_vocab_size()
        #: Only the byte-level pattern without an added blank, and no normaliser, allow the cuts.
        self.cuts = self.lib.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and getattr(pre, "use_regex", True)
        self.kind = "=u2" if model <= 65536 else "=u4"
        self.code = "H" if model <= 65536 else "I"
        self.known = Memory(self)
        self.names = _byte_names()
        #: Added tokens are found in a text before anything else, so a text that holds one takes the whole path.
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]

    def fresh(self, part: str) -> bytes:
        """A run of letters is one word of the pattern and goes to the model alone; the rest takes the whole path."""
        if WORD.fullmatch(part):
            ids = [x.id for x in self.lib.model.tokenize(part.encode().decode("latin-1").translate(self.names))]
        else:
            ids = self.lib.encode(part, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def encoded(self, text: str) -> bytes:
        """The ids, as numbers of the type `kind`."""
        if not self.cuts or any(t in text for t in self.added):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.known.__getitem__, STRETCH.findall(text)))


class Memory(dict):
    """Ids of stretches; what is missing is encoded and remembered, in two halves: when the newer is full, the older goes."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, part: str) -> bytes:
        got = self.older.get(part)
        if got is None:
            got = self.encoder.fresh(part)
        if len(self) > MEMORY // 2:
            self.older = dict(self)
            self.clear()
        if len(part) <= 64:
            self[part] = got
        return got


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ranges_of(docs: DataFrame, id_col: str, parts: int) -> np.ndarray:
    """Ids that cut the documents into about equal parts, from one pass over the ids."""
    at = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), at, 20 * parts).alias("at")).first()["at"] if at else None
    return np.unique(np.array(found or [], np.int64))


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, bounds: np.ndarray, parts: int) -> DataFrame:
    """_id, _part, _ids and _wide: the ids of each text and the end id as little-endian unsigned integers of 16 bits, or of
    32 where _wide says so. Rows without an id have parts below 0, dealt by their place, so that they don't meet in one."""
    session_of(docs)

    def run(batches):
        enc = encoder(tokenizer_path)
        wide = enc.code == "I" or end_id > 0xFFFF
        end, kind = struct.pack("<I" if wide else "<H", end_id), np.dtype("<u4" if wide else "<u2")
        for b in batches:
            ids = [np.frombuffer(enc.encoded(t), enc.kind).astype(kind).tobytes() + end for t in b.column("_t").to_pylist()]
            key = b.column("_id").to_numpy(zero_copy_only=False)
            part = np.where(key == NULL_ID, b.column("_row").to_numpy(zero_copy_only=False) % parts - parts, np.searchsorted(bounds, key, "right"))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(part, pa.int32()), pa.array(ids, pa.binary()), pa.array([wide] * len(ids))], names=["_id", "_part", "_ids", "_wide"])

    text = F.coalesce(F.col(text_col), F.lit("")).alias("_t")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(F.monotonically_increasing_id()).alias("_row"), text)
    return rows.mapInArrow(run, "_id long, _part int, _ids binary, _wide boolean")


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Files in ascending order of id, and a table of them (part, file, first, n_ids, n_docs, path); first counts the ids of
    the same part before the file. A task that runs again writes files of other names; the table has those of one run."""
    spark = session_of(docs)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or PARTS_A_TASK * tasks
    folder = shared_path(spark, "token-files")

    def run(batches):
        system, at = file_system(folder)
        system.create_dir(at, recursive=True)
        run_, ids, docs_, starts, held, first, file, part = uuid.uuid4().hex, [], [], [0], 0, 0, 0, None

        def full():
            name = f"{part + parts:06d}-{file:06d}-{run_}.dac"
            with system.open_output_stream(f"{at}/{name}") as f:
                f.write(pack(np.concatenate(ids), np.array(starts), np.array(docs_, np.int64)))
            return pd.DataFrame({"part": [part], "file": [file], "first": [first], "n_ids": [held], "n_docs": [len(docs_)], "path": [f"{folder}/{name}"]})

        for b in batches:
            for i, x, wide, p in zip(b["_id"], b["_ids"], b["_wide"], b["_part"], strict=True):
                if p != part or held >= file_ids:
                    if docs_:
                        yield full()
                    first, file = (first + held, file + 1) if p == part else (0, 0)
                    part, ids, docs_, starts, held = p, [], [], [0], 0
                ids.append(np.frombuffer(x, "<u4" if wide else "<u2"))
                held += len(ids[-1])
                starts.append(held)
                docs_.append(i)
        if docs_:
            yield full()

    rows = encoded(docs, tokenizer_path, end_id, id_col, text_col, ranges_of(docs, id_col, parts), parts)
    rows = rows.repartition(tasks, "_part").sortWithinPartitions("_part", "_id", "_ids")
    return stored(rows.mapInPandas(run, "part int, file int, first long, n_ids long, n_docs long, path string"), "token-table")


def read_tokens(files: DataFrame, what=None, columns: str = "ids array<int>") -> DataFrame:
    """doc_id, start (ids of all documents before it) and, for each document, what(ids) as `columns`. Each document is
    looked up in its file by the directories; the file is not decoded as a whole."""
    spark = session_of(files)
    what = what or (lambda ids: (ids.astype(np.int32),))
    # one row a part, at most as many as the writer had parts; their running sum is the parts' starts
    sums = sorted((r["part"], r["n"], r["files"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("files")).collect())
    before = {p: int(s) for (p, *_), s in zip(sums, np.cumsum([0, *(n for _, n, _ in sums)]), strict=False)}
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for b in batches:
            for part, first, path in zip(b["part"], b["first"], b["path"], strict=True):
                system, at = file_system(path)
                with system.open_input_file(at) as source:
                    f = TokenFile(source.read_at)
                    ids, starts = f.doc_ids(), f.starts()
                    for i in range(0, f.docs, ROWS):
                        j = min(f.docs, i + ROWS)
                        out = pd.DataFrame([what(f.document(k)) for k in range(i, j)], columns=names)
                        out.insert(0, "start", before[part] + int(first) + starts[i:j])
                        out.insert(0, "doc_id", ids[i:j])
                        yield out

    few = min(sum(n for *_, n in sums), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = files.select("part", "first", "path").repartition(max(1, few)).mapInPandas(run, f"doc_id long, start long, {columns}")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def digest(ids: np.ndarray) -> tuple[int, int]:
    return len(ids), zlib.crc32(ids.astype("<u4").tobytes())
