r"""Benchmark decontamination by template canonicalisation.

Words lose punctuation and case, and numbers (digits, or number words of four languages), names (words with a
capital first letter of any script) and units
(listed words behind a number; one glued to it is a word of its own) become typed placeholders, so a question asked again with other
parameters keeps its template. Beside these typed windows every place has a plain one, of the words
themselves without case, for copies whatever their share of placeholders. Windows of ``WINDOW`` template words are hash-joined: the windows
of all benchmark items set bits in a bitmap of fixed size, documents send only windows whose
bits are set, and a join by hash decides. For every place where an item lies in a document the slots are
compared: a window stays if each of its fillers stands for the filler that most of that filler's slots at
the place stand for, or if its fillers are the item's own. An item counts as found when its consistent
windows cover at least ``COVER`` of it, or ``RUN`` words of it in a row at one place. With ``veto``, one filler that stands for two removes the whole
place; the queries do without.

Defined cases: words are ``[^\x20\x09-\x0D]+`` less everything but letters and digits, and a word
of which nothing is left is skipped; an item with fewer words than a window is one window; typed
windows with fewer than ``LITERALS`` (or, of a short item, half) literal words are not used, so an item made
of placeholders is found by its own words only; letters are lower-cased one by one (``ß`` is not ``SS``);
rows that share an id, and all rows without one, count as one document; the share is of the whole item or, if greater, of the part with typed windows; null or empty texts match nothing. Items with the same template
windows are each reported.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import LOWER, NOT_WORD, WHITE, Words, mix, pieces, rolling, utf8, words

WINDOW = 8
LITERALS = 5
COVER = 0.5
RUN = 13
#: Unit words.
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg t gram grams kilogram kilograms ounce ounces pound pounds ml l liter liters litre litres gallon gallons s sec second seconds minute minutes h hour hours day days week weeks month months year years c f degrees degree percent dollar dollars euro euros cent cents v w kw j kj pa hz".split()
#: Number words (English, German, French, Spanish) that are no common words of another kind.
NUMBERS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille "
    "dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa ciento mil"
).split()
#: A unit glued to a number.
_GLUED = r"(?i)([0-9])(" + "|".join(UNITS) + r")\b"
_BITS = 23
_PLAIN = np.uint64(0x5B1F9E37A6C2D481)
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x8CB92BA72F3D8DD7))


@lru_cache(maxsize=2)
def _hashes(listed: tuple[str, ...]) -> np.ndarray:
    return np.sort(words(*utf8(pa.array([" ".join(listed)])), WHITE, LOWER, ~NOT_WORD).hash)


def _is_one_of(h: np.ndarray, listed: list[str]) -> np.ndarray:
    known = _hashes(tuple(listed))
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _capital(data: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether the letter that begins at each byte is a capital, in any script."""
    first = data[head] if len(data) else np.zeros(0, np.uint8)
    out = (first >= 65) & (first <= 90)
    wide = np.flatnonzero(first >= 0xC3)
    if len(wide):
        b = [data[np.minimum(head[wide] + k, len(data) - 1)].astype(np.int64) for k in range(4)]
        tail = [x & 0x3F for x in b]
        two, three = (b[0] & 0x1F) << 6 | tail[1], (b[0] & 0x0F) << 12 | tail[1] << 6 | tail[2]
        four = (b[0] & 0x07) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]
        letters, back = np.unique(np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four)), return_inverse=True)
        out[wide] = np.array([chr(c).isupper() or chr(c).istitle() for c in letters.tolist()])[back]
    return out


def templates(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words with something left of them, their template hashes, and which are literal."""
    data, offsets = utf8(texts)
    w = words(data, offsets, WHITE, LOWER, ~NOT_WORD)
    keep = ~NOT_WORD[LOWER[data]]
    kept = np.concatenate([[0], np.cumsum(keep)])
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    n = kept[w.end] - kept[w.start]
    some = n > 0
    start, end, row, h, n = w.start[some], w.end[some], w.row[some], w.hash[some], n[some]
    number = ((digits[end] - digits[start]) == n) | _is_one_of(h, NUMBERS)
    at = np.flatnonzero(keep)
    head = at[np.searchsorted(at, start)] if len(at) else start
    name = _capital(data, head)
    unit = _is_one_of(h, UNITS)
    unit[1:] &= number[:-1] & (row[1:] == row[:-1])
    unit[:1] = False
    name &= ~unit
    shape = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, h)))
    return Words(start, end, row, h, np.searchsorted(row, np.arange(len(offsets)))), shape, ~(number | unit | name)


def plain(texts: pa.Array, w: Words) -> np.ndarray:
    """Hashes of the words of ``templates`` with letters beyond ASCII lower-cased too."""
    data, _ = utf8(texts)
    if not len(data) or data.max() < 0x80:
        return w.hash
    data, offsets = utf8(pc.utf8_lower(texts))
    low = words(data, offsets, WHITE, LOWER, ~NOT_WORD)
    kept = np.concatenate([[0], np.cumsum(~NOT_WORD[LOWER[data]])])
    return low.hash[kept[low.end] > kept[low.start]]


def _windows(w: Words, shape: np.ndarray, literal: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the usable windows."""
    h = rolling(shape, size)
    count = np.concatenate([[0], np.cumsum(literal)])
    ok = (w.row[: len(h)] == w.row[size - 1 :][: len(h)]) & (count[size:][: len(h)] - count[: len(h)] >= least)
    at = np.flatnonzero(ok)
    return at, mix(h[at] ^ np.uint64(size))


def _fillers(w: Words, literal: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """Fillers of each window's slots in order (0 for a literal word)."""
    slot = np.where(literal, 0, w.hash.view(np.int64))
    flat = slot[at[:, None] + np.arange(size)].reshape(-1) if len(at) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * size, pa.int32()), pa.array(flat, pa.int64()))


def _rows(key: pa.Array, w: Words, literal: np.ndarray, at: np.ndarray, h: np.ndarray, size: int, typed: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key.take(pa.array(w.row[at])), pa.array(h.view(np.int64)), pa.array((at - w.first[w.row[at]]).astype(np.int32)), _fillers(w, literal, at, size), pa.array(np.full(len(at), typed))], names=["key", "hash", "at", "slots", "typed"])


_ROWS = "key long, hash long, at int, slots array<long>, typed boolean"


def _both(texts: pa.Array) -> tuple[Words, list[tuple[np.ndarray, np.ndarray, bool]]]:
    """Words with (hashes, which are literal, typed) for typed and for plain windows."""
    texts = pc.replace_substring_regex(texts, _GLUED, r"\1 \2")
    w, shape, literal = templates(texts)
    return w, [(shape, literal, True), (plain(texts, w) ^ _PLAIN, np.ones(len(shape), bool), False)]


def _least(size: int) -> int:
    return LITERALS if size == WINDOW else -(-size // 2)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h >> np.uint64(64 - _BITS), (h >> np.uint64(8)) & np.uint64((1 << _BITS) - 1)]).astype(np.int64)


def item_windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(key, hash, at, slots, typed) of all windows of the benchmark."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                w, kinds = _both(piece.column("text"))
                length = np.diff(w.first)
                for size in sorted({min(WINDOW, int(n)) for n in length if n}):
                    for shape, literal, typed in kinds:
                        at, h = _windows(w, shape, literal, size, _least(size))
                        fit = (length[w.row[at]] == size) | ((size == WINDOW) & (length[w.row[at]] >= WINDOW))
                        yield _rows(piece.column("key"), w, literal, at[fit], h[fit], size, typed)

    return items.select(F.col(item_id).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(make, _ROWS)


def _consistent(windows: list[dict], veto: bool) -> list[dict]:
    """The windows of one place whose fillers agree."""
    votes = Counter((f, g) for _, f, g in {(x["at"] + k, f, g) for x in windows for k, (f, g) in enumerate(zip(x["f"], x["g"], strict=True)) if f})
    best: dict[int, int] = {}
    for (f, g), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
        best.setdefault(f, g)
    if veto:
        return windows if len(best) == len(votes) else []
    return [x for x in windows if x["f"] == x["g"] or all(best[f] == g for f, g in zip(x["f"], x["g"], strict=True) if f)]


def _longest(at: list[int]) -> int:
    """The most consecutive numbers among sorted distinct ones."""
    return max(Counter(x - k for k, x in enumerate(at)).values(), default=0)


def _covered(veto: bool):
    """Of the windows of one place: the words of the item that the consistent ones cover, and
    those that the typed ones of them cover, and the most words in a row."""
    kind = pa.struct([("words", pa.list_(pa.int32())), ("typed", pa.list_(pa.int32())), ("run", pa.int32())])

    @F.arrow_udf("struct<words:array<int>,typed:array<int>,run:int>")
    def covered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reach = lambda windows: sorted({x["at"] + k for x in windows for k in range(len(x["f"]))})
        for places in batches:
            kept = [_consistent(windows, veto) for windows in places.to_pylist()]
            yield pa.array([{"words": (at := reach(windows)), "typed": reach([x for x in windows if x["typed"]]), "run": _longest(at)} for windows in kept], kind)

    return covered


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", cover: float = COVER, run: int = RUN, veto: bool = True) -> DataFrame:
    """(id, item_id, share, word) of every benchmark item found in a document: the covered share
    of the item and the document's first word of the match."""
    index = item_windows(items, item_id, item_text)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_bits(b.column("hash").to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_pydict({"word": pa.array(at >> 5, pa.int64()), "bit": pa.array(np.left_shift(1, at & 31), pa.int64())})

    set_bits = index.select("hash").mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    filled = set_bits.toArrow()  # at most 2 ** (_BITS - 5) rows, whatever the benchmark's size
    bitmap = np.zeros(1 << (_BITS - 5), np.uint32)
    bitmap[filled.column("word").to_numpy()] = filled.column("bit").to_numpy()
    sizes = [r["n"] for r in index.select(F.size("slots").alias("n")).distinct().collect()]  # at most WINDOW values

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                w, kinds = _both(piece.column("text"))
                for size in sizes:
                    for shape, literal, typed in kinds:
                        at, h = _windows(w, shape, literal, size, _least(size))
                        bit = _bits(h)
                        hit = (bitmap[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool)
                        hit = hit[: len(h)] & hit[len(h) :]
                        if hit.any():
                            yield _rows(piece.column("key"), w, literal, at[hit], h[hit], size, typed)

    probes = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(probe, _ROWS)
    met = probes.alias("d").join(index.alias("i"), "hash").select(
        F.col("d.key").alias("doc"),
        F.col("i.key").alias("item"),
        (F.col("d.at") - F.col("i.at")).alias("offset"),
        F.struct(F.col("i.at").alias("at"), F.col("i.slots").alias("f"), F.transform(F.arrays_zip(F.col("i.slots").alias("f"), F.col("d.slots").alias("g")), lambda x: F.when(x["f"] != 0, x["g"]).otherwise(0)).alias("g"), F.col("i.typed").alias("typed")).alias("window"),
    )
    # of one place: at most two windows for each word of the item
    places = met.groupBy("doc", "item", "offset").agg(F.collect_set("window").alias("windows")).select("doc", "item", "offset", _covered(veto)("windows").alias("c")).select("doc", "item", "offset", "c.*").where(F.size("words") > 0)
    covered = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    places = places.groupBy("doc", "item").agg(covered("words").alias("covered"), covered("typed").alias("typed"), F.max("run").alias("run"), F.min(F.col("offset") + F.array_min("words")).alias("word"))
    end, start = F.col("at") + F.size("slots"), F.when(F.col("typed"), F.col("at"))
    lengths = index.groupBy(F.col("key").alias("item")).agg(F.max(end).alias("length"), (F.max(F.when(F.col("typed"), end)) - F.min(start)).alias("span"))
    share = places.join(lengths, "item").withColumn("share", F.greatest(F.col("covered") / F.col("length"), F.col("typed") / F.col("span")))
    return share.where((F.col("share") >= cover) | (F.col("run") >= run)).select(F.col("doc").alias(id_col), F.col("item").alias("item_id"), "share", F.col("word").cast("long").alias("word"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents in which a benchmark item is found. A row without id stays."""
    leaks = find_leaks(docs, items, id_col, text, **how).select(F.col(id_col).alias("_leak")).distinct()
    return docs.join(leaks, docs[id_col] == leaks["_leak"], "left_anti")
