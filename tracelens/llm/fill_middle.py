"""Fill-in-middle: texts are cut into prefix, middle and suffix at token boundaries and written in another order.

Tokens are runs of A-Z and a-z; every other code point is a token of its own. One kernel cuts all rows of an Arrow batch
together, on its UTF-8 buffers: a lookup gives the class of each byte, a mask of adjacent bytes says where a token begins,
its running sum less that at the document's start numbers the tokens of each document, and one searchsorted over the
running sum finds the byte of every cut. No text becomes a Python string. Batches are worked on in blocks of whole texts of
up to BLOCK bytes, a longer text in a block of its own: a block takes about 12 times its bytes.

Where a text is cut follows from its id alone (sha256 of salt, colon and the decimal id), so reruns and any partitioning
agree. Forms: psm writes <P>prefix<S>suffix<M>middle, spm writes <S>suffix<P>prefix<M>middle, plain is the text as it is.

Defined results: a null text counts as empty and is plain; a null id counts as no digits in the hash and stays null; rows
that repeat are cut alike; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import session_of

P, S, M = b"<P>", b"<S>", b"<M>"
FORMS = ("plain", "psm", "spm")
#: Percent of texts that are plain, and of the others that are spm.
PLAIN, SPM = 10, 20
BLOCK = 4 << 20

#: Class of a byte: 1 a letter, 2 within a code point, 0 any other.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:192] = 2


def cuts(x: np.ndarray, ends: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, ...]:
    """x: bytes of all texts; ends: 0 and where each text ends; draws: two numbers a text.

    (tokens of each text, byte of its first cut, of its second, code points of the prefix, of the middle).
    """
    kind = _CLASS[x]
    first = kind != 2  # of a code point
    letter = kind == 1
    begin = first.copy()
    begin[1:] &= ~(letter[1:] & letter[:-1])
    begin[ends[:-1][ends[:-1] < ends[1:]]] = True  # a text never goes on with the token of the one before
    run = np.concatenate([[0], np.cumsum(begin, dtype=np.int32)])  # tokens that begin before each byte
    base = run[ends[:-1]].astype(np.int64)
    n = run[ends[1:]] - base
    at = np.sort(draws % (n + 1), axis=0)
    byte = np.where(at == n, ends[1:], np.searchsorted(run, (base + at + 1).astype(np.int32)) - 1)
    points = np.concatenate([[0], np.cumsum(first, dtype=np.int32)])
    a, b = byte
    return n, a, b, points[a] - points[ends[:-1]], points[b] - points[a]


def marked(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts hold one of the marks."""
    out = np.zeros(len(ends) - 1, bool)
    if len(x) > 2:
        at = np.flatnonzero((x[:-2] == 60) & (x[2:] == 62))
        at = at[np.isin(x[at + 1], np.frombuffer(b"PSM", np.uint8))]
        row = np.searchsorted(ends[1:], at, "right")
        out[row[at + 2 < ends[row + 1]]] = True
    return out


def rearranged(x: np.ndarray, ends: np.ndarray, h: np.ndarray, plain: int, spm: int) -> tuple[np.ndarray, ...]:
    """(tokens, form, code points of prefix, of middle, ends of the outputs, bytes of the outputs) of texts; h: four numbers a text."""
    n, a, b, before, middle = cuts(x, ends, h[:2])
    form = np.where((n == 0) | marked(x, ends) | (h[2] % 100 >= 100 - plain), 0, np.where(h[3] % 100 < spm, 2, 1))
    p, s, m = (np.frombuffer(mark, np.uint8) for mark in (P, S, M))
    parts: list[np.ndarray] = []
    for f, i, j, k, z in zip(form.tolist(), ends[:-1].tolist(), a.tolist(), b.tolist(), ends[1:].tolist(), strict=True):
        parts += [x[i:z]] if f == 0 else [p, x[i:j], s, x[k:z], m, x[j:k]] if f == 1 else [s, x[k:z], p, x[i:j], m, x[j:k]]
    size = np.diff(ends) + np.where(form == 0, 0, len(P) + len(S) + len(M))
    out = np.concatenate(parts) if parts else x
    return n, form, before, middle, np.concatenate([[0], np.cumsum(size)]), out


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, ends, bytes) of runs of texts of up to `most` bytes, on the buffers of the column."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, j, ends[i : j + 1] - ends[i], data[ends[i] : ends[j]]
        i = j


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1", plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """id_col, n (tokens), form, prefix_chars, middle_chars (null if plain), output: one row a text, in one pass without shuffle."""
    session_of(docs)
    sha = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("_id"), *draws, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"_id {dict(docs.dtypes)[id_col]}, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches):
        names = pa.array(FORMS)
        for batch in batches:
            h = np.stack([batch.column(f"h{k}").to_numpy() for k in range(4)])
            for i, j, ends, x in blocks(batch.column("text")):
                n, form, before, middle, out_ends, out = rearranged(x, ends, h[:, i:j], plain, spm)
                is_plain = form == 0
                text = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(out_ends), pa.py_buffer(out)) if len(out) > 1 << 30 else pa.StringArray.from_buffers(j - i, pa.py_buffer(out_ends.astype(np.int32)), pa.py_buffer(out))
                columns = [batch.column("_id").slice(i, j - i), pa.array(n, pa.int64()), names.take(pa.array(form)), pa.array(before, pa.int64(), mask=is_plain), pa.array(middle, pa.int64(), mask=is_plain), text]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A text that is cut holds no mark, so the marks part the output uniquely."""
    parts = F.split(output, "<[PSM]>", -1)
    second, third = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    prefix, suffix = F.when(form == "psm", second).otherwise(third), F.when(form == "psm", third).otherwise(second)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars, and sha256 of the output and of the text that is rebuilt from it."""
    out = transformed(docs, id_col, text_col)
    again = restored(F.col("output"), F.col("form"))
    return out.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))
