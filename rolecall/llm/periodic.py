r"""Periodic runs of words: an online sparse dynamic program over diagonals.

Position ``i`` and lag ``d`` lie on diagonal ``d``; the match length there is one more than at ``i - 1`` if word ``i``
equals word ``i - d``, else 0. A run of period ``d`` is a diagonal whose match length reaches
``length - d``; it is emitted where the diagonal ends. Few diagonals are ever active:

* a run of at least ``repeats`` (3) periods matches at least ``2 d`` words, so a lag becomes active only when its last ``W``
  words match, with ``W`` taken for each band of lags ``W / 2 <= d <= 3 W / 4`` (1 to 12 for 16 words);
* within a band only the nearest earlier occurrence at lag ``W / 2`` or more counts for a word: a nearer one ``d'`` beside a
  run's own lag ``d`` would give the window the periods ``d`` and ``d - d'``, together at most ``W``, and so by the
  periodicity lemma a period that divides ``d``.

So each word has at most one active lag in each band, also in a text that repeats one word throughout, and the
whole program takes ``n log n`` steps for each of ``log n`` bands. Bands are worked through in numpy, for all
positions in order. Of equal stretches the smallest period is kept.

Texts in which no window of 16 words occurs twice have no runs of 24 words; they are told by 64-bit
window hashes of a whole batch. All others are decided on exact words.

Defined cases: words are ``[^\x20\x09-\x0D]+``; null and empty texts have no words and no runs; rows
are judged one by one, so repeated rows or null ids do not matter; a very long text is one task's row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecall.llm.common import WHITE, pieces, rolling, utf8, words

LEAST = 24
REPEATS = 3
Run = tuple[int, int, int]  # start, length, period


def _ranks(ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(W, code of the window of W words that begins at each position), for growing W."""
    codes, size, n = ids, 1, len(ids)
    doubled = [(1, ids)]
    while 2 * size <= longest:
        codes = _pair(codes[: n - 2 * size + 1], codes[size : n - size + 1])
        size *= 2
        doubled.append((size, codes))
    width = 16
    while width <= longest:
        size, codes = next(x for x in reversed(doubled) if x[0] <= width)
        yield width, codes if size == width else _pair(codes[: n - width + 1], codes[width - size : n - size + 1])
        width = width * 3 // 2


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair, equal for equal pairs only."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _nearest(code: np.ndarray, low: int) -> np.ndarray:
    """Lag of the nearest earlier equal code at a distance of ``low`` or more; 0: none."""
    n = len(code)
    order = np.argsort(code, kind="stable")
    key = code[order].astype(np.int64) * (n + 1) + order  # ascending: by code, then position
    at = np.searchsorted(key, code.astype(np.int64) * (n + 1) + np.arange(n) - low, "right") - 1
    found = np.where(at >= 0, order[np.maximum(at, 0)], 0)
    ok = (at >= 0) & (code[found] == code) & (np.arange(n) - found >= low)
    return np.where(ok, np.arange(n) - found, 0)


def runs(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[Run]:
    """All runs of a sequence of word numbers, by start and period: longest stretches with smallest
    period ``d`` and a length of at least ``max(least, repeats * d)``; ``least`` is 24 or more, ``repeats`` 3 or more."""
    n = len(ids)
    best: dict[tuple[int, int], int] = {}
    for width, code in _ranks(ids, 2 * n // 3):
        bands = [(-(-width // 2), 3 * width // 4)]
        if width == 16:  # lags up to 8 match 16 words at least
            bands.append((1, 8))
        for low, high in bands:
            lag = _nearest(code, low)
            lag[lag > high] = 0
            # a diagonal: consecutive windows with the same active lag
            edge = np.flatnonzero(np.concatenate([[True], lag[1:] != lag[:-1], [True]]))
            first, last = edge[:-1], edge[1:]
            d = lag[first]
            length = last - first + width - 1 + d
            for k in np.flatnonzero((d > 0) & (length >= np.maximum(least, repeats * d))).tolist():
                p = int(d[k])
                start, end = _extended(ids, int(first[k]) - p, int(last[k]) + width - 1, p)
                best[start, end] = min(p, best.get((start, end), p))
    return sorted((s, e - s, p) for (s, e), p in best.items())


def _extended(ids: np.ndarray, start: int, end: int, p: int) -> tuple[int, int]:
    """The whole stretch of period ``p`` around one that has it."""
    while start > 0 and ids[start - 1] == ids[start - 1 + p]:
        start -= 1
    while end < len(ids) and ids[end] == ids[end - p]:
        end += 1
    return start, end


def collapsed(found: list[Run], n: int) -> np.ndarray:
    """Which words stay if every run keeps its first period only."""
    drop = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return np.cumsum(drop[:n]) == 0


def strongest(found: list[Run]) -> Run | None:
    """The run with the greatest length / period, compared exactly; then the first, then the shortest period."""
    best = None
    for r in sorted(found, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _may_repeat(texts: pa.Array, width: int = 16) -> np.ndarray:
    """Rows in which a window of ``width`` words may occur twice."""
    w = words(*utf8(texts), WHITE)
    h = rolling(w.hash, width)
    at = np.flatnonzero(w.row[: len(h)] == w.row[width - 1 :][: len(h)])
    row, h = w.row[at], h[at]
    order = np.lexsort((h, row))
    same = (row[order[1:]] == row[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
    out = np.zeros(len(texts), bool)
    out[row[order[1:][same]]] = True
    return out


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("best", _RUN), ("collapsed", pa.string())])
RESULT = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,best:struct<start:long,length:long,period:long>,collapsed:string>"


def _judged(raw: bytes, suspect: bool) -> tuple[int, list[Run], Run | None, str]:
    parts = raw.split()  # splits bytes at [\x20\x09-\x0D]
    found: list[Run] = []
    if suspect:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(x, len(number)) for x in parts), np.int64, len(parts))
        found = runs(ids)
        if found:
            keep = collapsed(found, len(parts))
            return len(parts), found, strongest(found), b" ".join(x for x, k in zip(parts, keep.tolist(), strict=True) if k).decode()
    return len(parts), found, None, b" ".join(parts).decode()


def periodic_runs(text: Column | str) -> Column:
    """Struct of the word count, all runs, the strongest run (null: none) and the text of the words that
    stay when every run keeps only its first period, joined by one space."""

    @F.arrow_udf(RESULT)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        as_run = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))
        for texts in batches:
            out = []
            for piece in pieces(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
                column = piece.column("t")
                rows = []
                for raw, suspect in zip(column.cast(pa.binary()), _may_repeat(column).tolist(), strict=True):
                    n, found, best, kept = _judged(raw.as_py() or b"", suspect)
                    rows.append({"n_words": n, "runs": [as_run(r) for r in found], "best": as_run(best), "collapsed": kept})
                out.append(pa.array(rows, _RESULT))
            yield pa.concat_arrays(out) if out else pa.array([], _RESULT)

    return find(F.col(text) if isinstance(text, str) else text)


def looped(text: Column | str, key: Column | str) -> Column:
    """The words of a text joined by one space; where crc32(decimal key) is divisible by 10, its end is a loop:
    from word ``a`` on, the next ``p`` words again and again. A null key leaves the text as it is."""
    import zlib

    @F.arrow_udf("string")
    def build(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, keys in batches:
            out = []
            for raw, number in zip(texts.cast(pa.binary()).to_pylist(), keys.to_pylist(), strict=True):
                parts = (raw or b"").split()
                n, h = len(parts), zlib.crc32(str(number).encode()) if number is not None else 1
                if h % 10 == 0 and n > 0:
                    g = h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    parts = parts[:a] + (parts[a : a + p] * (-(-(n - a) // p)))[: n - a]
                out.append(b" ".join(parts).decode())
            yield pa.array(out, pa.string())

    return build(F.col(text) if isinstance(text, str) else text, F.col(key) if isinstance(key, str) else key)
