r"""Phrase collocation mining with mergeable Misra-Gries summaries.

A phrase is a run of words inside a piece of text; its count is per language. Only phrases
with ``least`` occurrences or more matter, and there are few of them, but nearly as many different
phrases as words. They are found in three passes:

1. **Words and pairs.** Every piece of the corpus is summarised (hash and count of each phrase), its summary
   is cut by hash range and shuffled, the mass of each part ahead of it. A hash partition
   knows its whole mass before it merges the first summary, so its Misra-Gries summary gets a capacity of
   ``mass // least + 1`` counters. Merging takes the (capacity + 1)-th largest count off all
   counters; what is taken off in all is less than ``least``, so every frequent phrase
   survives, whatever the order of the merges.
2. **Longer phrases**, the same way, of those alone whose pairs all survived.
3. **Exact counts** of the survivors: a task adds them up over all its text and sends packed rows by hash range, where
   they are totalled by the phrases themselves.

Survivors reach the tasks as bitmaps of fixed size. They let a few others through, and would let all
through if they were full; pass 3 counts these exactly and drops them, so results do not depend on it.

Cuts, scores, the containment test and ranks are joins and aggregates over the frequent
phrases alone. Scores are integer divisions of 38-digit decimals.

Defined cases: A-Z are lower-cased; a null text has no words, a null language is ``und``; pieces end at ``[.,;:!?\x0A-\x0D]``
and texts, words at ``[\x20\x09]``; repeated rows count each time; ties of the score go to the more
frequent phrase, then in byte order; an empty table gives no rows. Inside one task, equal
phrases are told by a 64-bit hash; between tasks, by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.llm.common import LOWER, mix, pieces, rolling, separators, text_bytes, utf8, words
from rolecall.llm.exchange import FAN, _pack, _ranges, part_count, unpack
from rolecall.llm.storage import Staging

_STOP = separators([(0x0A, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"]])
_BETWEEN = _STOP | separators([(0x09, 0x09), (0x20, 0x20)])
_SUMMARY = "part int, body int, mass long, keys binary, counts binary"
_BITS = 26
_BUCKETS = 256
#: Distinct phrases that a task counts before it sends them on.
_TALLY = 1 << 19


class Phrases:
    """Words of a piece of rows, and the hashed phrases of any length in it."""

    def __init__(self, piece: pa.RecordBatch) -> None:
        data, offsets = utf8(piece.column("_text"))
        self.data = LOWER[data]
        self.w = words(self.data, offsets, _BETWEEN)
        self.langs = piece.column("_lang").to_pylist()
        salt = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(self.langs)}
        self.salt = np.array([salt[x] for x in self.langs], np.uint64)
        # grows with every piece end and every row: equal for words that one phrase may hold
        self.segment = np.cumsum(_STOP[self.data])[self.w.start] + self.w.row

    def of_length(self, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first word, key) of all phrases of ``k`` words; ``allowed`` marks where pairs may begin."""
        h = rolling(self.w.hash, k)
        fits = self.segment[: len(h)] == self.segment[k - 1 :][: len(h)]
        if allowed is not None:
            for j in range(k - 1):
                fits &= allowed[j : j + len(h)]
        at = np.flatnonzero(fits)
        return at, mix(h[at] ^ self.salt[self.w.row[at]] ^ np.uint64(k))

    def starts(self, k: int, bitmap: np.ndarray) -> np.ndarray:
        """For each word, whether a phrase of ``k`` words in ``bitmap`` begins there."""
        at, key = self.of_length(k)
        out = np.zeros(len(self.w.hash), bool)
        out[at[marked(key, bitmap)]] = True
        return out

    def text(self, at: int, k: int) -> str:
        raw = self.data[self.w.start[at] : self.w.end[at + k - 1]].tobytes()
        return b" ".join(raw.split()).decode()


def marked(key: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = (key >> np.uint64(64 - _BITS)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """Which top bits occur among the keys: 2 ** 23 bytes, whatever the number of keys."""
    slot = F.shiftrightunsigned("key", 64 - _BITS) + 1
    filled = keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toArrow()
    out = np.zeros((1 << (_BITS - 15), 4096), np.uint8)  # at most 2 ** (_BITS - 15) rows
    for bucket, bits in zip(filled.column("bucket").to_pylist(), filled.column("bits").to_pylist(), strict=True):
        out[bucket - 1] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


class MisraGries:
    """Counters for at most ``capacity`` keys; a count falls short by ``error`` at most."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts.astype(np.int64)))
        self.n_waiting += len(keys)
        if self.n_waiting > max(self.capacity, 1 << 20):
            self.settle()

    def settle(self) -> None:
        parts = [(self.keys, self.counts), *self.waiting]
        self.keys, self.counts = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        self.waiting, self.n_waiting = [], 0
        over = len(self.keys) - self.capacity
        if over > 0:
            cut = int(np.partition(self.counts, over - 1)[over - 1])
            self.error += cut
            keep = self.counts > cut
            self.keys, self.counts = self.keys[keep], self.counts[keep] - cut

    def at_least(self, least: int) -> np.ndarray:
        """All keys whose true count may be ``least``."""
        self.settle()
        return self.keys[self.counts + self.error >= least]


def survivors(base: DataFrame, make: Callable[[Phrases], np.ndarray], parts: int, least: int, fan: int = FAN) -> DataFrame:
    """(key) of every phrase that may occur ``least`` times, and of some that do not. ``make`` lists
    the keys of all occurrences in a piece."""
    fine = -(-parts // fan) if parts > fan else 1
    coarse = -(-parts // fine)

    def rows(keys: np.ndarray, counts: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
        to = _ranges(keys, ranges)  # ascending, as the keys are
        at, first = np.unique(to, return_index=True)
        mass = np.add.reduceat(counts, first)
        n, none = len(at), np.zeros(len(at), np.int64)
        size = np.diff(np.append(first, len(keys)))
        empty = _pack(np.zeros(0, np.uint64), none)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.zeros(n), pa.int32()), pa.array(mass, pa.int64()), empty, empty], names=["part", "body", "mass", "keys", "counts"])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.ones(n), pa.int32()), pa.array(none, pa.int64()), _pack(keys, size), _pack(counts.astype(np.uint32), size)], names=["part", "body", "mass", "keys", "counts"])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                keys, counts = np.unique(make(Phrases(piece)), return_counts=True)
                if len(keys):
                    yield from rows(keys, counts, coarse)

    def deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = unpack(batch.column("keys"), np.uint64)[0], unpack(batch.column("counts"), np.uint32)[0]
            if len(keys):
                yield from rows(*summed(keys, counts.astype(np.int64)), coarse * fine)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = -1, 0, MisraGries(1)
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("part")[i].as_py() != part:
                    yield pa.RecordBatch.from_arrays([pa.array(summary.at_least(least).view(np.int64))], names=["key"])
                    part, mass, summary = batch.column("part")[i].as_py(), 0, MisraGries(1)
                if batch.column("body")[i].as_py() == 0:  # masses come first
                    mass += batch.column("mass")[i].as_py()
                    summary.capacity = mass // least + 1
                else:
                    one = batch.slice(i, 1)
                    summary.add(unpack(one.column("keys"), np.uint64)[0], unpack(one.column("counts"), np.uint32)[0])
        yield pa.RecordBatch.from_arrays([pa.array(summary.at_least(least).view(np.int64))], names=["key"])

    dealt = base.mapInArrow(summarise, _SUMMARY)
    if fine > 1:
        dealt = dealt.where("body = 1").repartition("part").mapInArrow(deal_again, _SUMMARY)
    return dealt.repartition(coarse * fine, "part").sortWithinPartitions("part", "body").mapInArrow(merge, "key long")


def frequent_phrases(docs: DataFrame, staging: Staging, least: int = 100, longest: int = 5, text: str = "text", lang: str = "lang", fan: int = FAN) -> DataFrame:
    """(lang, phrase, words, f): exact counts of all phrases of up to ``longest`` words with ``least``
    occurrences, and with ``words`` 0 the count of all words of the language."""
    base = docs.select(F.col(text).alias("_text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"))
    parts = part_count(text_bytes(docs, text))
    first = survivors(base, lambda p: np.concatenate([p.of_length(k)[1] for k in (1, 2)]), parts, least, fan)
    short = bitmap_of(staging.write(first, "short"))

    def longer(p: Phrases) -> np.ndarray:
        allowed = p.starts(2, short)
        return np.concatenate([np.zeros(0, np.uint64), *[p.of_length(k, allowed)[1] for k in range(3, longest + 1)]])

    long = bitmap_of(staging.write(survivors(base, longer, parts, least, fan), "long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(parts)
        for batch in batches:
            for piece in pieces(batch, "_text"):
                p = Phrases(piece)
                total = np.diff(p.w.first)
                for x in sorted(set(p.langs)):
                    tally.add(np.array([int(p.salt[p.langs.index(x)])], np.uint64), np.array([int(total[[y == x for y in p.langs]].sum())]), [(x, "", 0)].__getitem__)
                allowed = p.starts(2, short)
                for k in range(1, longest + 1):
                    at, key = p.of_length(k, allowed if k > 1 else None)
                    hit = marked(key, short if k < 3 else long)
                    key, where, times = np.unique(key[hit], return_index=True, return_counts=True)
                    at = at[hit][where]
                    tally.add(key, times, lambda i, at=at, k=k, p=p: (p.langs[p.w.row[at[i]]], p.text(int(at[i]), k), k))
                if len(tally.names) > _TALLY:
                    yield from tally.rows()
        yield from tally.rows()

    def total_up(table: pa.Table) -> pa.Table:
        flat = pa.table({c: pc.list_flatten(table.column(c)) for c in ("lang", "phrase", "words", "n")})
        out = flat.group_by(["lang", "phrase", "words"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "f"})
        return out.filter(pc.or_(pc.greater_equal(out.column("f"), least), pc.equal(out.column("words"), 0)))

    packed = base.mapInArrow(count, "part long, lang array<string>, phrase array<string>, words array<int>, n array<long>")
    return staging.write(packed.groupBy("part").applyInArrow(total_up, "lang string, phrase string, words int, f long"), "counts")


class Tally:
    """Counts of phrases by key; a phrase is spelt out when it is first met."""

    def __init__(self, parts: int) -> None:
        self.parts = parts
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted keys, and their places in the lists
        self.names: list[tuple[str, str, int]] = []
        self.counts = np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray, name: Callable[[int], tuple[str, str, int]]) -> None:
        """Add counts of distinct keys; ``name(i)`` spells the i-th."""
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        self.counts[self.at[place[known]]] += counts[known]
        new = np.flatnonzero(~known)
        if len(new):
            at = len(self.names) + np.arange(len(new))
            self.names += [name(i) for i in new.tolist()]
            self.counts = np.concatenate([self.counts, counts[new]])
            merged = np.argsort(np.concatenate([self.keys, keys[new]]), kind="stable")
            self.keys, self.at = np.concatenate([self.keys, keys[new]])[merged], np.concatenate([self.at, at])[merged]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row for each hash part, and a fresh start."""
        part = _ranges(self.keys, self.parts)  # ascending, as the keys are
        at, first = np.unique(part, return_index=True)
        offsets = pa.array(np.append(first, len(part)), pa.int32())
        names = [self.names[i] for i in self.at.tolist()]
        columns = [pa.array([x[c] for x in names], t) for c, t in enumerate((pa.string(), pa.string(), pa.int32()))]
        columns.append(pa.array(self.counts[self.at], pa.int64()))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.ListArray.from_arrays(offsets, c) for c in columns]], names=["part", "lang", "phrase", "words", "n"])
        self.clear()


def _first(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows of each language, numbered: of each bucket first, then of the language."""
    inside = Window.partitionBy("lang", "_bucket").orderBy(*order)
    some = df.withColumn("_bucket", F.pmod(F.xxhash64("phrase"), F.lit(_BUCKETS))).withColumn("rank", F.row_number().over(inside))
    some = some.where(F.col("rank") <= limit).drop("rank", "_bucket")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= limit)


def collocations(docs: DataFrame, staging: Staging, least: int = 100, longest: int = 5, cover: int = 100, limit: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, words, cut): the ``limit`` best phrases of each language. ``score`` is
    1000 times how much more often a phrase occurs than its two parts would meet by chance, for
    the cut that explains it best (``cut`` words in the first part). A phrase inside a longer one with
    ``cover`` percent of its occurrences is not listed."""
    counts = frequent_phrases(docs, staging, least, longest, text, lang)
    phrase = counts.where("words > 1").withColumnRenamed("f", "a")
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    single = F.split("phrase", " ")

    # a longer phrase holds a phrase of one word less with at least as many occurrences
    inner = phrase.where("words > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice(single, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(single, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    alone = phrase.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < cover * F.col("a"), F.lit(True))).drop("most")

    cut = alone.join(total, "lang").select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cut = cut.withColumn("_head", F.array_join(F.slice(single, F.lit(1), F.col("cut")), " ")).withColumn("_tail", F.array_join(F.slice(single, F.col("cut") + 1, F.col("words") - F.col("cut")), " "))
    head = counts.where("words > 0").select("lang", F.col("phrase").alias("_head"), F.col("f").alias("l"))
    tail = counts.where("words > 0").select("lang", F.col("phrase").alias("_tail"), F.col("f").alias("r"))
    cut = cut.join(head, ["lang", "_head"]).join(tail, ["lang", "_tail"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cut.withColumn("_over", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("_under", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("CAST(_over DIV _under AS long)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n", "words")).alias("b")).select("lang", "phrase", "b.*")
    ranked = _first(best, limit, F.desc("score"), F.desc("a"), F.asc("phrase"))
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words", "cut")
