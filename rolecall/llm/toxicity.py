r"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on toxic and on ordinary text. A window of words is
compressed twice: with the ordinary dictionary, and with the ordinary one that the toxic one
follows (padding of equal length stands in its place in the first case, so that both see the
ordinary part at equal distances). The gap of the two lengths is what toxic text alone explains.
The toxic dictionary is trained on contrast: words of toxic samples that hold a byte n-gram far more
common in toxic than in ordinary samples, as most of a toxic text is ordinary. The gaps of a
document's windows are summed up in a few numbers, which a logistic curve turns into a score; it is
calibrated on documents that the dictionaries have not seen (two halves of the sample in turn,
weighted to the share of toxic documents among all labels), and shifted so that 0.7 is the
threshold with the best F1 there. The dictionaries in use are then trained on the whole sample.

The model is fitted in one place on a bounded sample: at most ``TOXIC_DOCS`` and ``ORDINARY_DOCS``,
taken by hash order of their ids from the labelled rows allowed. Everything else runs on the
executors over all windows of all texts. Ids, languages and sources are never inputs of a score.

Defined cases: a document with several labels is toxic if one of them is 1; labels without a
document, or null, are not used; a null, empty or wordless text has no window and gets the score of no
evidence; without a toxic or an ordinary sample every score is 0. Words are runs of letters.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import mix

TOXIC_DOCS, ORDINARY_DOCS = 1_500, 3_500
TOXIC_BYTES, ORDINARY_BYTES = 3_000, 112_000
WINDOW = 20
LEVEL = 12
GRAM = 6
THRESHOLD = 0.7
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPLIT = re.compile(r"[\x00-\x60\x7b-\x7f]+")
_TABLE = 1 << 22


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]  # of the features, the constant last
    cut: float


def word_list(text: str | None) -> list[str]:
    return [w for w in _SPLIT.split((text or "").translate(_FOLD)) if w]


def windows(text: str | None) -> list[bytes]:
    w = word_list(text)
    return [f" {' '.join(w[i : i + WINDOW])} ".encode() for i in range(0, len(w), WINDOW)]


def _grams(text: bytes) -> np.ndarray:
    """Table slots of all byte n-grams."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(b) - GRAM + 1)
    total = np.zeros(n, np.uint64)
    for j in range(GRAM):
        total |= b[j : j + n] << np.uint64(8 * j)
    return (mix(total) & np.uint64(_TABLE - 1)).astype(np.int64)


def _joined(text: str) -> bytes:
    return f" {' '.join(word_list(text))} ".encode()


def _document_counts(texts: list[str]) -> np.ndarray:
    count = np.zeros(_TABLE, np.int32)
    for t in texts:
        count[np.unique(_grams(_joined(t)))] += 1
    return count


def _telling_words(text: str, marked: np.ndarray) -> list[bytes]:
    """Words, with a space at both ends, that hold a marked n-gram."""
    b = _joined(text)
    seen = np.concatenate([[0], np.cumsum(marked[_grams(b)])])
    space = np.flatnonzero(np.frombuffer(b, np.uint8) == 32)
    start, end = space[:-1], space[1:] + 1
    last = np.clip(end - GRAM + 1, 0, len(seen) - 1)
    hit = (end - start >= GRAM) & (seen[last] > seen[np.minimum(start, len(seen) - 1)])
    return [b[s:e] for s, e in zip(start[hit].tolist(), end[hit].tolist(), strict=True)]


def _train(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    """The last ``size`` bytes of a trained dictionary: its best segments stand at the end."""
    try:
        return zstandard.train_dictionary(size + 300, samples, k=k, d=d).as_bytes()[-size:]
    except zstandard.ZstdError:  # too few samples to choose from: they are the dictionary
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    in_toxic, in_ordinary = _document_counts(toxic), _document_counts(ordinary)
    least = max(min(4, 1 + len(toxic) // 20), round(0.01 * len(toxic)))
    marked = (in_toxic >= least) & (in_toxic * len(ordinary) >= 6.0 * len(toxic) * (in_ordinary + 1))
    telling = [w for t in toxic for w in _telling_words(t, marked)]
    samples = [b"".join(telling[i : i + 6]) for i in range(0, len(telling), 6)]
    chosen = random.Random(7)
    plain = [w for t in ordinary for w in windows(t)]
    plain = chosen.sample(plain, min(len(plain), 60_000))
    return _train(ORDINARY_BYTES, plain, 48, 8), _train(TOXIC_BYTES, samples, 16, 6)


@lru_cache(maxsize=2)
def _compressors(ordinary: bytes, toxic: bytes):
    def build(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    return build(ordinary + bytes([1]) * len(toxic)), build(ordinary + toxic)


def features(text: str | None, ordinary: bytes, toxic: bytes) -> list[float]:
    one, two = _compressors(ordinary, toxic)
    gap = np.array([len(one.compress(w)) - len(two.compress(w)) for w in windows(text)], float)
    if not len(gap):
        return [0.0] * 8
    top = np.sort(gap)[::-1]
    over = np.maximum(gap, 0)
    return [top[0], top[:3].sum() / 3, gap.mean(), (gap >= 3).mean(), (gap >= 5).mean(), float(np.sqrt((over**2).mean())), float(np.log1p((gap >= 4).sum())), float(np.log1p(len(gap)))]


def calibrate(rows: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Weights of a logistic curve and the cut with the best F1."""
    mean, sd = rows.mean(0), rows.std(0) + 1e-9
    x = np.c_[(rows - mean) / sd, np.ones(len(rows))]
    w = np.zeros(x.shape[1])
    ridge = 0.1 * np.eye(len(w))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, x.T @ (weight * (toxic - p)) - ridge @ w)
    s = x @ w
    order = np.argsort(-s, kind="stable")
    right, taken = np.cumsum((toxic * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * right / (taken + (toxic * weight).sum())
    best = int(np.argmax(f1))
    cut = (s[order[best]] + s[order[min(best + 1, len(s) - 1)]]) / 2
    flat = [*(w[:-1] / sd), w[-1] - float((w[:-1] * mean / sd).sum())]
    return tuple(float(v) for v in flat), float(cut)


def fit(sample: list[tuple[str, int]], share: float) -> Model | None:
    """Fit on (text, label); ``share`` is the share of toxic documents to calibrate for."""
    label: dict[str, int] = {}
    for t, y in sample:
        label[t] = max(y, label.get(t, 0))
    by = [[t for t, y in label.items() if y == k] for k in (0, 1)]
    if len(by[0]) < 2 or len(by[1]) < 2:
        return None
    rows, toxic = [], []
    for half in (0, 1):
        o, t = dictionaries(by[1][1 - half :: 2], by[0][1 - half :: 2])
        for y in (0, 1):
            rows += [features(x, o, t) for x in by[y][half::2]]
            toxic += [y] * len(by[y][half::2])
    y = np.array(toxic, float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    o, t = dictionaries(by[1], by[0])
    return Model(o, t, *calibrate(np.array(rows), y, weight))


def score_of(text: str | None, m: Model) -> float:
    s = float(np.dot(features(text, m.ordinary, m.toxic), m.weights[:-1])) + m.weights[-1]
    return float(1 / (1 + np.exp(-np.clip(s - m.cut + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30))))


def fit_model(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Fit on labelled documents whose id is ``allowed`` (a condition on ``id_col``)."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(allowed)
    known = known.groupBy(id_col).agg(F.max(label).cast("int").alias("_y")).withColumn("_h", F.xxhash64(F.lit("toxicity"), id_col))
    n, share = known.agg(F.count("*"), F.avg("_y")).first()
    if not n:
        return None
    first = lambda y, most: known.where(F.col("_y") == y).orderBy("_h").limit(most).select(F.col(id_col).alias("_key"), "_y", "_h")
    # the sample has a fixed bound of rows, so it may go to every task
    chosen = first(1, TOXIC_DOCS).unionByName(first(0, ORDINARY_DOCS))
    taken = docs.select(id_col, text).join(F.broadcast(chosen), F.col(id_col) == F.col("_key")).where(F.col(text).isNotNull())
    rows = sorted((r["_h"], r[text], r["_y"]) for r in taken.select("_h", text, "_y").collect())
    return fit([(t, y) for _, t, y in rows], share)


def toxicity(text: Column | str, model: Model | None) -> Column:
    """Column with the score of ``text`` (0 to 1)."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([score_of(t.as_py(), model) for t in texts], pa.float64())

    return score(F.col(text) if isinstance(text, str) else text)


def held_out(id_col: str) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
