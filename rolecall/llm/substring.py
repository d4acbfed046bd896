r"""Substring dedup: repeated passages found by fixed-block anchors.

A passage of ``width`` words that stands in two documents covers, in one of them, a whole aligned
block of ``(width + 1) // 2`` words. So the index holds the non-overlapping aligned blocks of every
document, and the rolling windows of that length of every document probe it (first exchange; keys
are 32 bits inside a range, so a few hits are false). Hits are then extended: around every hit,
the windows of ``width`` words that contain it are compared by their 64-bit hash, and the smallest
document that holds each is found (second exchange). The union of a document's windows that a
smaller document also holds are its maximal exact repeats, and those words go.

Both exchanges are :func:`exchange.shared_keys`, so a passage in a third of all documents arrives
once per piece of text and no pair of documents is ever listed.

Defined cases: words are ``[^\x20\x09-\x0D]+``, unchanged; a null or empty text has none; windows
are judged on the input; repeats inside one document stay; rows with one id are repeats of one
document and must have the same text; a row without id is kept whole and owns nothing. Other columns
pass through; ``n_words``, ``n_removed`` and ``kept`` are replaced where they exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import Words, pieces, rolling, text_bytes, utf8, words
from rolecall.llm.exchange import Entries, part_count, shared_keys, unpack
from rolecall.llm.storage import Staging

_FLAG = np.int32(-(2**31))


def _windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Global first words and hashes of the windows that stay inside one row."""
    h = rolling(w.hash, width)
    at = np.flatnonzero(w.row[: len(h)] == w.row[width - 1 :][: len(h)])
    return at, h[at]


def _marks(w: Words, places: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Which words the packed places of each row point at."""
    place, count = unpack(places, np.int32)
    at = np.repeat(w.first[:-1], count) + place
    marked = np.zeros(len(w.hash) + 1, bool)
    marked[at[at < np.repeat(w.first[1:], count)]] = True
    return marked[:-1]


def _forward(marked: np.ndarray, n: int) -> np.ndarray:
    """Words within ``n`` places from a mark on, itself included."""
    edge = np.zeros(len(marked) + n + 1, np.int32)
    at = np.flatnonzero(marked)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge)[: len(marked)] > 0


def repeated_places(docs: DataFrame, staging: Staging, width: int = 13, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``docs`` by id, (_id, packed first words of windows that a smaller document holds))."""
    block = (width + 1) // 2
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    parts = part_count(text_bytes(docs, text))

    def probes(piece: pa.RecordBatch) -> Entries:
        piece = piece.filter(piece.column("_id").is_valid())
        w = words(*utf8(piece.column("_text")))
        at, h = _windows(w, block)
        place = (at - w.first[w.row[at]]).astype(np.int32)
        place[place % block == 0] |= _FLAG  # an aligned block: it is in the index
        return Entries(h, piece.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)[w.row[at]], place)

    def extended(piece: pa.RecordBatch) -> Entries:
        piece = piece.filter(piece.column("_hits").is_valid())
        w = words(*utf8(piece.column("_text")))
        hit = _marks(w, piece.column("_hits"))
        near = _forward(hit[::-1], width - block + 1)[::-1]  # windows that contain a hit block
        at, h = _windows(w, width)
        inside = near[at]
        at, h = at[inside], h[inside]
        return Entries(h, piece.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)[w.row[at]], (at - w.first[w.row[at]]).astype(np.int32))

    def by_document(found: DataFrame, name: str) -> DataFrame:
        return staging.write(found.select(F.col("owner").alias("_owner"), F.col("places").alias("_hits")), name)

    hits = by_document(shared_keys(base, "_text", probes, parts, wide=False, leader_too=True, with_leader=False, flagged=True), "hits")
    near = base.join(hits, base["_id"] == hits["_owner"], "left").select("_id", "_text", "_hits")
    return base, by_document(shared_keys(near, "_text", extended, parts, with_leader=False), "repeats")


def drop_repeats(docs: DataFrame, staging: Staging, width: int = 13, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the words that stay, joined by one
    space."""
    _, repeats = repeated_places(docs, staging, width, id_col, text)
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    joined = docs.select(*columns).alias("d").join(repeats.alias("r"), F.col(f"d.{id_col}") == F.col("r._owner"), "left")

    @F.arrow_udf("struct<n_words:long,n_removed:long,kept:string>")
    def keep(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, hits in parts:
            done = [_kept(p, width) for p in pieces(pa.RecordBatch.from_arrays([texts, hits], ["text", "hits"]), "text")]
            yield pa.concat_arrays(done)

    out = joined.select(*[F.col(f"d.{c}").alias(c) for c in columns], keep(F.col(f"d.{text}"), F.col("r._hits")).alias("_k"))
    return out.select(*columns, "_k.n_words", "_k.n_removed", "_k.kept")


def _kept(piece: pa.RecordBatch, width: int) -> pa.Array:
    data, offsets = utf8(piece.column("text"))
    w = words(data, offsets)
    gone = _forward(_marks(w, piece.column("hits")), width)
    stay = np.flatnonzero(~gone)
    row = w.row[stay]
    last = np.ones(len(stay), bool)
    last[:-1] = row[1:] != row[:-1]
    stop = w.end[stay] + ~last  # with the separator byte behind it, except at a row's end
    edge = np.zeros(len(data) + 1, np.int8)
    edge[w.start[stay]] += 1
    np.subtract.at(edge, stop, 1)
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    data = data.copy()
    data[w.end[stay[~last]]] = 0x20
    size = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=size[1:])
    kept = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(size[offsets])), pa.py_buffer(data[inside])])
    total = np.diff(w.first)
    left = np.bincount(row, minlength=len(offsets) - 1) if len(row) else np.zeros(len(offsets) - 1, np.int64)
    return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(total - left, pa.int64()), kept.cast(pa.string())], ["n_words", "n_removed", "kept"])
