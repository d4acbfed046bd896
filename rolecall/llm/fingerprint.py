r"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range. So the sketch of a
union is the union of sketches, a sketch grows with its document, and the share of one
document's sketch that is found in another estimates containment however unequal the two are.

A fingerprint is a string ``shingles.check.sketch``: number of distinct shingles (hexadecimal), a check value over all
of them, and the retained hashes (48 bits each, ascending, base64). Equal texts have equal
fingerprints. Likeness is the Jaccard estimate from two sketches. Where both sketches are empty, which
happens to short texts, it is 1 if the two check values agree, else 0.

Defined cases: shingles are five words ``[^\x20\x09-\x0D]+``, unchanged; a text with fewer words is
one shingle; a null or empty text has none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import mix, pieces, shingles, text_bytes, utf8, words

SHINGLE = 5
FRACTION = 4  # one hash in so many is kept
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 10_000
_LOW = np.int64(-(2**63))


def sketches(texts: pa.Array, shingle: int = SHINGLE, fraction: int = FRACTION) -> tuple[list[np.ndarray], list[str]]:
    """Retained hashes and fingerprints of all texts."""
    row, _, h = shingles(words(*utf8(texts)), shingle)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h), out=total[1:])
    check = mix(total[first[1:]] - total[first[:-1]])
    kept = h < np.uint64((1 << 64) // fraction)
    small, at = h[kept], np.concatenate([[0], np.cumsum(kept)])[first]
    small &= np.uint64((1 << 48) - 1)
    out, names = [], []
    for r in range(len(texts)):
        s = np.sort(small[at[r] : at[r + 1]])
        out.append(s)
        packed = s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
        names.append(f"{first[r + 1] - first[r]:x}.{check[r]:016x}.{base64.b64encode(packed).decode()}")
    return out, names


def read_sketch(fingerprint: str) -> tuple[str, np.ndarray]:
    head, _, body = fingerprint.rpartition(".")
    raw = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return head, wide.reshape(-1).view(">u8").astype(np.uint64)


def _both(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _likeness(a: np.ndarray, b: np.ndarray, same: bool) -> float:
    if not len(a) and not len(b):
        return float(same)
    both = _both(a, b)
    return both / (len(a) + len(b) - both)


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two documents from their fingerprints."""
    (x, s), (y, t) = read_sketch(a), read_sketch(b)
    return _likeness(s, t, x == y)


def containment(a: str, b: str) -> float:
    """Estimated share of the first document's shingles that the second holds."""
    (x, s), (y, t) = read_sketch(a), read_sketch(b)
    return _both(s, t) / len(s) if len(s) else float(x == y)


def merge(a: str, b: str) -> str:
    """Fingerprint body of the union of two documents; counts and checks do not merge."""
    s = np.union1d(read_sketch(a)[1], read_sketch(b)[1])
    return "0.0." + base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def fingerprint(text: Column | str) -> Column:
    """Column with the fingerprint of ``text``."""

    @F.arrow_udf("string")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names: list[str] = []
            for piece in pieces(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
                names += sketches(piece.column("t"))[1]
            yield pa.array(names, pa.string())

    return make(F.col(text) if isinstance(text, str) else text)


def in_order_with_next(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(_bucket, _halo, _id, _text) such that inside a bucket, sorted by (_halo, _id, _text), every
    row that is no halo row is followed by the next document; the last one by the first.

    Bucket edges are ids from the table (approximate quantiles, a bounded list), so the only rows
    that two buckets need are those that carry an edge as id, and each text is shuffled once.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LOW))).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    n = int(min(MOST_BUCKETS, max(32, text_bytes(docs, text) // BUCKET_BYTES)))
    found = base.agg(F.min("_id").alias("low"), F.percentile_approx("_id", [i / n for i in range(1, n)], 20 * n).alias("cuts")).first()
    edges = np.array(sorted({found["low"], *found["cuts"]}) if found["low"] is not None else [0], np.int64)

    @F.arrow_udf("array<int>")
    def buckets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            at = np.searchsorted(edges, ids.to_numpy(zero_copy_only=False), "right") - 1
            edge = edges[at] == ids.to_numpy(zero_copy_only=False)
            yield pa.array([[b, (b - 1) % len(edges)] if e else [b] for b, e in zip(at.tolist(), edge.tolist(), strict=True)], pa.list_(pa.int32()))

    spread = base.select("_id", "_text", F.posexplode(buckets("_id")).alias("_halo", "_bucket"))
    return spread.repartition("_bucket").sortWithinPartitions("_bucket", "_halo", "_id", "_text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (the second half replaced by the start of the
    next document), and their likeness: (id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next).

    Rows with one id are taken in the order of their texts; a row without id comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            for piece in pieces(batch, "_text"):
                rows = pa.concat_batches([held, piece]) if held is not None else piece
                held = rows.slice(rows.num_rows - 1)
                if rows.num_rows > 1:
                    yield _edited(rows)

    def _edited(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column("_text")
        kept, names = sketches(texts)
        halo, bucket, ids = (rows.column(c).to_pylist() for c in ("_halo", "_bucket", "_id"))
        use = [r for r in range(rows.num_rows - 1) if not halo[r] and bucket[r] == bucket[r + 1]]
        plain = texts.to_pylist()
        half = [len(plain[r]) // 2 for r in use]
        edited = [plain[r][: len(plain[r]) - k] + plain[r + 1][:k] for r, k in zip(use, half, strict=True)]
        kept_2, names_2 = sketches(pa.array(edited, pa.string()))
        return pa.RecordBatch.from_pydict(
            {
                id_col: pa.array([None if ids[r] == _LOW else ids[r] for r in use], pa.int64()),
                "n_chars": pa.array([len(plain[r]) for r in use], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                "fingerprint": pa.array([names[r] for r in use], pa.string()),
                "edited_fingerprint": pa.array(names_2, pa.string()),
                "near_edited": pa.array([_likeness(kept[r], s, names[r] == m) for r, s, m in zip(use, kept_2, names_2, strict=True)], pa.float64()),
                "near_next": pa.array([_likeness(kept[r], kept[r + 1], names[r] == names[r + 1]) for r in use], pa.float64()),
            }
        )

    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order_with_next(docs, id_col, text).mapInArrow(run, schema)


