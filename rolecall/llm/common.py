"""Batch helpers of the text operators: bounded pieces of Arrow batches, word hashes in numpy.

Texts arrive as Arrow string arrays. Words and shingles are hashed for a whole piece at once on
the UTF-8 buffer, without a Python object per word. A piece holds at most ``PIECE_BYTES`` of
text (or one document), whatever the number of rows in the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PIECE_BYTES = 4 << 20
_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that any bit range of a hash can be used."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def separators(ascii_ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which bytes end a word. Bytes from 0x80 on belong to letters outside ASCII."""
    table = np.zeros(256, bool)
    for low, high in ascii_ranges:
        table[low : high + 1] = True
    return table


#: ``[\x20\x09-\x0D]``
WHITE = separators([(0x09, 0x0D), (0x20, 0x20)])
#: ``[\x00-\x2F\x3A-\x60\x7B-\x7F]`` of lower-cased text
NOT_WORD = separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(table: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``limit`` bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(table.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < table.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
        yield table.slice(at, end - at)
        at = end


class Words(NamedTuple):
    """Words of many texts in order: byte range, row of the text, hash; words of row r are
    ``first[r]`` to ``first[r + 1]``."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.empty(n, np.uint64)
        p[0] = 1
        done = 1
        while done < n:
            step = min(done, n - done)
            p[done : done + step] = p[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        out.append(p)
    return out[0], out[1]


def words(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray = WHITE, letters: np.ndarray | None = None, keep: np.ndarray | None = None) -> Words:
    """Words between separator bytes. ``letters`` maps bytes beforehand (lower case);
    bytes outside ``keep`` do not count in the hash (punctuation on a word)."""
    if letters is not None:
        data = letters[data]
    n_rows = len(offsets) - 1
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, n = 0, len(data)
    begins = np.unique(offsets[:-1])
    while at < n:
        stop = min(at + _SEGMENT, n)
        if stop < n:  # cut only after a separator or between two texts
            seps = np.flatnonzero(ends_word[data[at:stop]])
            k = np.searchsorted(begins, stop, "right") - 1
            edge = max(int(seps[-1]) + 1 + at if len(seps) else at, int(begins[k]))
            if edge <= at:
                more = np.flatnonzero(ends_word[data[stop:]])
                after = int(begins[k + 1]) if k + 1 < len(begins) else n
                edge = min(int(more[0]) + stop + 1 if len(more) else n, after)
            stop = edge
        piece = data[at:stop]
        inside = ~ends_word[piece]
        before = np.empty(len(piece), bool)
        before[0] = False
        before[1:] = inside[:-1]
        lo, hi = np.searchsorted(begins, at), np.searchsorted(begins, stop)
        own = begins[lo:hi] - at
        before[own] = False
        start = np.flatnonzero(inside & ~before)
        after = np.empty(len(piece), bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[own[own > 0] - 1] = False
        end = np.flatnonzero(inside & ~after) + 1
        size = max(_SEGMENT, 1 << (len(piece) - 1).bit_length()) if len(piece) else _SEGMENT
        power, inverse = _powers(size)
        value = _letters()[piece] * power[: len(piece)]
        if keep is not None:
            value[~keep[piece]] = 0
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        h = (total[end] - total[start]) * inverse[start]
        if keep is None:
            h ^= (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        parts.append((start + at, end + at, mix(h)))
        at = stop
    if parts:
        start, end, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        start, end, h = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(start, end, row, h, np.searchsorted(row, np.arange(n_rows + 1)))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values; windows over the edge of a row are the caller's
    to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += h[j : j + n] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64))
    return mix(total)


def shingles(w: Words, k: int, whole_if_shorter: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, hash) of all ``k``-word shingles in order; a row with fewer words gives
    its whole sequence as one shingle if asked."""
    h = rolling(w.hash, k)
    at = np.flatnonzero(w.row[: len(h)] == w.row[k - 1 :][: len(h)])
    row, h = w.row[at], h[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k)) if whole_if_shorter else []
    if len(short):
        first = w.first[short]
        total = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            total[has] += w.hash[first[has] + j] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64))
        extra = mix(total ^ count[short].astype(np.uint64))
        row, at, h = np.concatenate([row, short]), np.concatenate([at, first]), np.concatenate([h, extra])
        order = np.argsort(at, kind="stable")
        row, at, h = row[order], at[order], h[order]
    return row, at, h


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts: one number, from which operators derive how many parts to deal."""
    from pyspark.sql import functions as F

    return df.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0


_MARK_BITS = 23


def only_marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` less most of those whose ``key`` is not in ``wanted``, so that a join with ``wanted``
    moves little. The filter is a bitmap of fixed size; where it is full, rows just pass."""
    from pyspark.sql import functions as F

    bitmap = marks(wanted.select(F.xxhash64(wanted[key])))

    @F.arrow_udf("boolean")
    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for h in batches:
            yield pa.array(is_marked(bitmap, h.to_numpy(zero_copy_only=False)))

    return rows.where(marked(F.xxhash64(rows[key])))


def marks(hashes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the 64-bit hashes in the only column; see :func:`is_marked`."""
    from pyspark.sql import functions as F

    slots = hashes.toDF("h").select(F.pmod("h", F.lit(1 << _MARK_BITS)).alias("s"))
    bits = slots.groupBy(F.shiftright("s", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 AS int))")).alias("bit"))
    filled = bits.toArrow()  # at most 2 ** (_MARK_BITS - 5) rows
    bitmap = np.zeros(1 << (_MARK_BITS - 5), np.uint32)
    bitmap[filled.column("word").to_numpy()] = filled.column("bit").to_numpy()
    return bitmap


def is_marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which int64 hashes may be among those of ``bitmap``: all that are, and a few others."""
    at = h & ((1 << _MARK_BITS) - 1)
    return (bitmap[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
