"""Dealing keyed entries out by key hash in packed rows.

An operator that must bring equal keys together (window hashes, set signatures) has an entry for
nearly every word of the corpus. One Spark row per entry would spend most of the shuffle on row
headers. Here a task turns each piece of text (``common.PIECE_BYTES``) into one row per key range
that holds the piece's entries of that range as packed arrays, and Spark shuffles those rows by
range. Ranges are cut so that each holds about ``PART_BYTES`` of text, whatever the corpus size.

Before dealing, a piece is reduced: of a key that several owners in the piece share, only the
smallest owner's entries are dealt, and the others are settled on the spot. So a key that a third
of all documents hold arrives at its range once per piece.

Where there would be more than ``FAN`` ranges, entries are dealt in two hops (coarse ranges, then
the ranges of each), so that the number of packed rows grows with the input and not its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rolecall.llm.common import mix, pieces

PART_BYTES = 6 << 20
FAN = 2048
_NAMES = ["part", "keys", "owners", "places"]
_SCHEMA = "part int, keys binary, owners binary, places binary"


class Entries(NamedTuple):
    """Key hash, owner and place (word position, if the operator has places) of each entry."""

    key: np.ndarray  # uint64
    owner: np.ndarray  # int64
    place: np.ndarray  # int32


class Found(NamedTuple):
    """Entries whose key has several owners, with the smallest of them."""

    owner: np.ndarray
    leader: np.ndarray
    place: np.ndarray


def part_count(text_bytes: int, least: int = 32) -> int:
    return max(least, -(-text_bytes // PART_BYTES))


def _shared(key: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the entries whose key occurs more than once, sorted by (key, owner, place), and
    for each the smallest owner, the largest owner and whether any place has its top bit set."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    some = order[twice]
    some = some[np.lexsort((place[some], owner[some], key[some]))]
    if not len(some):
        return some, owner[some], owner[some], np.zeros(0, bool)
    head = np.flatnonzero(np.concatenate([[True], key[some[1:]] != key[some[:-1]]]))
    size = np.diff(np.append(head, len(some)))
    low, high = owner[some[head]], owner[some[head + size - 1]]
    flag = np.logical_or.reduceat(place[some] < 0, head)
    return some, np.repeat(low, size), np.repeat(high, size), np.repeat(flag, size)


def _pack(values: np.ndarray, count: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count * values.dtype.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def unpack(column: pa.ChunkedArray | pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All packed values in a row, and how many each row has; a null row has none."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    values, counts = [np.zeros(0, dtype)], [np.zeros(0, np.int64)]
    for c in chunks:
        c = c.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(c.buffers()[1], np.int64, len(c) + 1, c.offset * 8)
        body = c.buffers()[2]
        if body is not None and offsets[-1] > offsets[0]:
            values.append(np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]].copy().view(dtype))
        counts.append(np.diff(offsets) // np.dtype(dtype).itemsize)
    return np.concatenate(values), np.concatenate(counts)


def _ranges(key: np.ndarray, n: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _rows(e: Entries, part: np.ndarray, wide: bool) -> pa.RecordBatch:
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 65536 else part, kind="stable")
    at, count = np.unique(part[order], return_counts=True)
    key = e.key[order]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), _pack(key if wide else key.astype(np.uint32), count), _pack(e.owner[order], count), _pack(e.place[order], count)], names=_NAMES)


def shared_keys(
    rows: DataFrame,
    text: str,
    make: Callable[[pa.RecordBatch], Entries],
    parts: int,
    wide: bool = True,
    leader_too: bool = False,
    with_leader: bool = True,
    flagged: bool = False,
    fan: int = FAN,
) -> DataFrame:
    """(owner, leader, places) of every owner of a key that has several owners, one row per pair;
    ``leader`` is the smallest owner seen with the key (in the piece or among pieces) and
    ``places`` packs the int32 places, ascending. ``with_leader`` false: leader 0, one row per owner.

    ``make`` turns a piece of ``rows`` into entries. ``wide`` deals 64-bit keys; otherwise 32 bits
    inside a range, where a few false meetings are harmless. ``leader_too`` also lists the smallest
    owner itself. ``flagged`` lists a key only if one of its places had the top bit set.
    """
    fine = -(-parts // fan) if parts > fan else 1  # ranges in each coarse range
    coarse = -(-parts // fine)

    def listed(owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (low != high) if leader_too else owner > low

    def settled(e: Entries) -> tuple[Entries, Found]:
        some, low, high, _ = _shared(e.key, e.owner, e.place)
        local = listed(e.owner[some], low, high)
        found = Found(e.owner[some][local], low[local], e.place[some][local] & 0x7FFFFFFF)
        keep = np.ones(len(e.key), bool)
        later = some[e.owner[some] > low]
        keep[later] = False
        place = e.place.copy()
        if flagged and len(some):  # the flag of a settled entry goes over to the entry that stays
            order = np.flatnonzero(np.concatenate([[True], e.key[some[1:]] != e.key[some[:-1]]]))
            flag = np.logical_or.reduceat(e.place[some] < 0, order)
            place[some[order]] |= np.where(flag, np.int32(-(2**31)), np.int32(0))
        return Entries(e.key[keep], e.owner[keep], place[keep]), found

    def by_owner(f: Found, mark: int) -> pa.RecordBatch:
        """What was found, packed by the range of its owner; ``mark`` -1: in ranges below 0."""
        to = _ranges(mix(f.owner.view(np.uint64)), coarse)
        leader = f.leader if with_leader else np.zeros(len(f.owner), np.int64)
        rows = _rows(Entries(leader.view(np.uint64), f.owner, f.place.astype(np.int32)), to, True)
        return rows if mark > 0 else rows.set_column(0, "part", pc.subtract(pa.scalar(-1, pa.int32()), rows.column("part")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                e, found = settled(make(piece))
                if len(found.owner):
                    yield by_owner(found, -1)
                if len(e.key):
                    yield _rows(e, _ranges(e.key, coarse), wide or fine > 1)

    def deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            settled_row = pc.less(batch.column("part"), 0)
            yield batch.filter(settled_row)
            batch = batch.filter(pc.invert(settled_row))
            key = unpack(batch.column("keys"), np.uint64)[0]
            if len(key):
                yield _rows(Entries(key, unpack(batch.column("owners"), np.int64)[0], unpack(batch.column("places"), np.int32)[0]), _ranges(key, coarse * fine), wide)

    def meet(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:  # settled in a piece: only passed on to the range of its owner
            return table.set_column(0, "part", pa.array(np.full(table.num_rows, -1 - part), pa.int32()))
        key = unpack(table.column("keys"), np.uint64 if wide else np.uint32)[0]
        owner, place = unpack(table.column("owners"), np.int64)[0], unpack(table.column("places"), np.int32)[0]
        some, low, high, flag = _shared(key, owner, place)
        hit = listed(owner[some], low, high)
        if flagged:
            hit &= flag
        return pa.Table.from_batches([by_owner(Found(owner[some][hit], low[hit], place[some][hit] & 0x7FFFFFFF), 1)])

    def gather(table: pa.Table) -> pa.Table:
        leader, owner, place = (unpack(table.column(c), t)[0] for c, t in (("keys", np.int64), ("owners", np.int64), ("places", np.int32)))
        order = np.lexsort((place, leader, owner))
        leader, owner, place = leader[order], owner[order], place[order]
        pair = np.ones(len(owner), bool)
        pair[1:] = (owner[1:] != owner[:-1]) | (leader[1:] != leader[:-1])
        new = pair.copy()
        new[1:] |= place[1:] != place[:-1]
        head = np.flatnonzero(pair)
        count = np.add.reduceat(new.astype(np.int64), head) if len(head) else head
        return pa.table({"owner": owner[head], "leader": leader[head], "places": _pack(place[new], count)})

    dealt = rows.mapInArrow(deal, _SCHEMA)
    if fine > 1:
        dealt = dealt.repartition("part").mapInArrow(deal_again, _SCHEMA)
    met = dealt.groupBy("part").applyInArrow(meet, _SCHEMA)
    return met.groupBy("part").applyInArrow(gather, "owner long, leader long, places binary")
