r"""N-gram Jaccard join with PartEnum signatures.

Sets are cut into size bands such that similar sets lie in the same band or in neighbouring ones.
Inside a band two sets of the wanted similarity differ in at most ``k`` features. The feature domain is
partitioned into ``k + 1 + e`` parts by hash, so such sets agree in at least ``e + 1`` parts, and
every part's projection is a signature that they may share. Parts in which a set has no feature
would bring together all sets that are empty there; they give no signature, and a set with more
than ``e`` of them enumerates its subsets of ``e + 1`` empty parts instead, which two similar
sets that agree nowhere else must share.

The join never lists the pairs of a group:

1. equal sets fall into one class (its id is a hash of the set), so copies count once;
2. signatures are dealt by key range; of the classes that share one, each is paired with the smallest
   (:func:`candidates`) and tested against it, by short sketches that bound the difference of two sets from below, then exactly;
3. components of the links found so far are formed;
4. where classes that share a signature still lie in different components, blocks of their sketches are compared, and each
   class proposes one pair: with the closest class of another component. Proposals are tested and new components formed,
   ``ROUNDS`` times at most and as long as links turn up, so a round tests at most one pair a class. A group of near copies
   grows together in these rounds;
5. what is left of a group's pairs, in different components still and not ruled out by the sketches, is tested exactly. After
   that every pair that shares a signature is tested, ruled out or in one component.

Defined cases: words are ``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased; a text with fewer
words than a shingle is one shingle; a text without words has an empty set, is linked with nothing
and is its own component; a row without id takes part and may have a null component. Class ids
and features are 64-bit hashes; rows pass through with ``n_shingles`` and ``component_id``, which
replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import LOWER, WHITE, is_marked, marks, mix, only_marked, pieces, shingles, text_bytes, utf8, words
from rolecall.llm.exchange import FAN, _pack, _ranges, part_count, unpack
from rolecall.llm.graph import components
from rolecall.llm.storage import Staging

BLOCK = 512
ROUNDS = 2


def sets_of(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows in a row, where each row begins, class ids (0:
    empty set)."""
    w = words(*utf8(texts), WHITE, LOWER)
    row, _, h = shingles(w, n)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    size = np.diff(first)
    kind = mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64)).view(np.int64)
    return h, first, np.where(size > 0, np.where(kind == 0, 1, kind), 0)


def bands(largest: int, num: int) -> np.ndarray:
    """Largest size of each band, for a similarity of ``num`` percent."""
    out, low = [], 1
    while not out or out[-2 if len(out) > 1 else -1] < largest:
        out.append(low * 100 // num)
        low = out[-1] + 1
    return np.array([*out, low * 100 // num], np.int64)


def spare_parts(high: np.ndarray, num: int) -> np.ndarray:
    """How many parts beyond ``k + 1`` each band gets: as many as parts are likely empty for its
    smallest sets, so that enumerating empty parts stays rare; of small ``k``, no more than ``k``."""
    k = 2 * (100 - num) * high // (100 + num)
    low = np.concatenate([[1, 1], high[:-2] + 1])  # smallest set of the band before
    spare = np.full(len(high), 2.0)
    for _ in range(12):
        parts = k + 1 + spare
        empty = parts * np.exp(-low / parts)
        spare = np.minimum(np.ceil(empty + 4 * np.sqrt(empty) + 1), np.maximum(2, k))
    return spare.astype(np.int64)


def signatures(h: np.ndarray, first: np.ndarray, num: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, band) of all sets, for the band of each set and the next one."""
    size = np.diff(first)
    high = bands(int(size.max(initial=1)), num)
    own = np.searchsorted(high, size)
    rows, sigs, of_band = [], [], []
    for band in (own, own + 1):
        k = 2 * (100 - num) * high[band] // (100 + num)  # features in which two such sets may differ
        spare = spare_parts(high, num)[band]
        use = (k > 0) & (size > 0)  # k = 0: only equal sets, which are one class
        parts = np.where(use, k + 1 + spare, 0)
        start = np.concatenate([[0], np.cumsum(parts)])
        row = np.repeat(np.arange(len(size)), size)
        inside = use[row]
        f, r = h[inside], row[inside]
        slot = start[r] + (((f >> np.uint64(32)) * parts[r].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(start[-1], np.uint64)
        np.add.at(total, slot, mix(f ^ np.uint64(0x2545F4914F6CDD1D)))
        filled = np.bincount(slot, minlength=start[-1]) > 0
        owner = np.repeat(np.arange(len(size)), parts)
        part = np.arange(start[-1]) - start[owner]
        label = mix((band[owner] * 1_000_003 + part).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        rows.append(owner[filled])
        sigs.append(mix(total[filled] ^ label[filled]))
        of_band.append(band[owner[filled]])
        empty = np.bincount(owner[~filled], minlength=len(size)) if len(owner) else np.zeros(len(size), np.int64)
        for r in np.flatnonzero(empty > spare):
            gaps = label[start[r] : start[r + 1]][~filled[start[r] : start[r + 1]]]
            chosen = np.array(list(combinations(gaps.tolist(), int(spare[r]) + 1)), np.uint64)
            rows.append(np.full(len(chosen), r))
            sigs.append(mix(chosen.sum(axis=1, dtype=np.uint64) ^ np.uint64(0x94D049BB133111EB)))
            of_band.append(np.full(len(chosen), band[r]))
            assert len(chosen) == comb(int(empty[r]), int(spare[r]) + 1)
    return np.concatenate(rows), np.concatenate(sigs), np.concatenate(of_band)


def similar(a: np.ndarray, b: np.ndarray, num: int) -> bool:
    if 100 * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= num * (len(a) + len(b) - both)


def candidates(base: DataFrame, n: int, num: int, parts: int, fan: int = FAN) -> DataFrame:
    """(a, b): for each signature of several classes, its smallest class with each other one. A piece of
    text settles its own pairs first and sends a signature once; keys are 32 bits inside a range, where a false
    meeting only costs a test."""
    fine = -(-parts // fan) if parts > fan else 1
    coarse = -(-parts // fine)

    def stars(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First entry of each key, by (key, owner), and the distinct pairs of smallest and other owner."""
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        head = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        low = owner[np.flatnonzero(head)][np.cumsum(head) - 1] if len(key) else owner
        other = low != owner
        pair = np.unique(np.stack([low[other], owner[other]], axis=1), axis=0)
        return order[head], pair[:, 0], pair[:, 1]

    def rows(key: np.ndarray, owner: np.ndarray, part: np.ndarray, wide: bool) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")
        at, count = np.unique(part[order], return_counts=True)
        key = key[order] if wide else key[order].astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), _pack(key, count), _pack(owner[order], count)], names=["part", "keys", "owners"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                h, start, kind = sets_of(piece.column("_text"), n)
                _, once = np.unique(kind, return_index=True)
                once = np.sort(once[kind[once] != 0])  # of equal sets in a piece, one
                size = np.diff(start)[once]
                keep = np.repeat(start[once], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                row, sig, _ = signatures(h[keep], np.concatenate([[0], np.cumsum(size)]).astype(np.int64), num)
                first, a, b = stars(sig, kind[once][row])
                if len(a):  # settled here: passed on as they are
                    yield rows(a.view(np.uint64), b, -1 - _ranges(mix(b.view(np.uint64)), coarse), True)
                if len(first):
                    yield rows(sig[first], kind[once][row[first]], _ranges(sig[first], coarse), fine > 1)

    def deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            settled = batch.column("part").to_numpy() < 0
            yield batch.filter(pa.array(settled))
            batch = batch.filter(pa.array(~settled))
            key, owner = unpack(batch.column("keys"), np.uint64)[0], unpack(batch.column("owners"), np.int64)[0]
            if len(key):
                first, a, b = stars(key, owner)
                if len(a):
                    yield rows(a.view(np.uint64), b, -1 - _ranges(mix(b.view(np.uint64)), coarse * fine), True)
                yield rows(key[first], owner[first], _ranges(key[first], coarse * fine), False)

    def meet(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            a, b = unpack(table.column("keys"), np.int64)[0], unpack(table.column("owners"), np.int64)[0]
            pair = np.unique(np.stack([a, b], axis=1), axis=0)
            a, b = pair[:, 0], pair[:, 1]
        else:
            _, a, b = stars(unpack(table.column("keys"), np.uint32)[0], unpack(table.column("owners"), np.int64)[0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    schema = "part int, keys binary, owners binary"
    dealt = base.mapInArrow(deal, schema)
    if fine > 1:
        dealt = dealt.repartition("part").mapInArrow(deal_again, schema)
    return dealt.groupBy("part").applyInArrow(meet, "a long, b long").distinct()


def _classes(base: DataFrame, n: int) -> DataFrame:
    """(_id, _n, _class) of every row; class null: empty set."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                _, first, kind = sets_of(piece.column("_text"), n)
                yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(np.diff(first), pa.int64()), pa.array(kind, pa.int64(), mask=kind == 0)], names=["_id", "_n", "_class"])

    return base.mapInArrow(describe, "_id long, _n long, _class long")


def _sets(base: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(_class, _set) of the wanted (_id, _class): sorted 64-bit features, packed."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                h, first, kind = sets_of(piece.column("_text"), n)
                right = kind == piece.column("_class").to_numpy(zero_copy_only=False)
                packed = _pack(h, np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(kind), packed], names=["_class", "_set"]).filter(pa.array(right))

    return only_marked(base, "_id", wanted).join(wanted, "_id").select("_text", "_class").mapInArrow(build, "_class long, _set binary")


def _tested(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, staging: Staging, num: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar: by their sizes and sketches first, then exactly. Sketches meet pairs
    of fitting sizes in one band, sets only pairs that the sketches leave: few tests move few sets."""

    @F.arrow_udf("boolean")
    def near(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right, m, n in parts:
            out = [(np.frombuffer(x.as_py(), np.uint8) != np.frombuffer(y.as_py(), np.uint8)).sum() for x, y in zip(left, right, strict=True)]
            yield pa.array(np.array(out, np.int64) <= (100 - num) * (m.to_numpy() + n.to_numpy()) // (100 + num))

    @F.arrow_udf("boolean")
    def check(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in parts:
            yield pa.array([similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), num) for x, y in zip(left, right, strict=True)], pa.bool_())

    fit = F.least("m", "n") * 100 >= F.greatest("m", "n") * num
    sizes = only_marked(sketches.select("_class", "band", "size"), "_class", pairs.select(F.explode(F.array("a", "b")).alias("_class")))
    m, n = sizes.select(F.col("_class").alias("a"), "band", F.col("size").alias("m")), sizes.select(F.col("_class").alias("b"), "band", F.col("size").alias("n"))
    fitting = pairs.join(m, "a").join(n, ["b", "band"]).where(fit).groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("band", "m", "n")])
    fitting = staging.write(fitting, "fitting")
    shown = only_marked(sketches.select("_class", "band", "sketch"), "_class", fitting.select(F.explode(F.array("a", "b")).alias("_class")))
    one, two = shown.toDF("a", "band", "s"), shown.toDF("b", "band", "t")
    close = staging.write(fitting.join(one, ["a", "band"]).join(two, ["b", "band"]).where(near("s", "t", "m", "n")).select("a", "b"), "close")
    known = only_marked(sets, "_class", close.select(F.explode(F.array("a", "b")).alias("_class")))
    left, right = known.select(F.col("_class").alias("a"), F.col("_set").alias("_x")), known.select(F.col("_class").alias("b"), F.col("_set").alias("_y"))
    return close.join(left, "a").join(right, "b").where(check("_x", "_y")).select("a", "b")


def _sketched(sets: DataFrame, num: int) -> DataFrame:
    """(_class, band, size, sketch), two bands for each class."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, count = unpack(batch.column("_set"), np.uint64)
            for row, band, sketch in _sketches(h, np.concatenate([[0], np.cumsum(count)]), num):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("_class").take(at), pa.array(band, pa.int64()), pa.array(count, pa.int64()), sketch], names=["_class", "band", "size", "sketch"])

    return sets.mapInArrow(make, "_class long, band long, size long, sketch binary").where(F.length("sketch") > 0)


def _sketches(h: np.ndarray, first: np.ndarray, num: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, band, packed sketch) for the band of each set and the next. A sketch has one byte for
    each of ``4 k`` slots, a sum over the features that fall into the slot; two sets differ in at
    least as many features as their sketches differ in bytes."""
    size = np.diff(first)
    high = bands(int(size.max(initial=1)), num)
    own = np.searchsorted(high, size)
    row = np.repeat(np.arange(len(size)), size)
    out = []
    for band in (own, own + 1):
        slots = 4 * (2 * (100 - num) * high[band] // (100 + num))
        start = np.concatenate([[0], np.cumsum(slots)])
        inside = slots[row] > 0
        f, r = h[inside], row[inside]
        slot = start[r] + (((f >> np.uint64(32)) * slots[r].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(start[-1], np.uint8)
        np.add.at(total, slot, (mix(f) & np.uint64(255)).astype(np.uint8))
        out.append((np.arange(len(size)), band, _pack(total, slots)))
    return out


def _groups(sets: DataFrame, staging: Staging, num: int) -> DataFrame:
    """(sig, band, _class, n, lead) of all groups of three or more classes that share a signature; of
    groups with the same classes, one. Two classes alone were tested with each other."""

    shared: list[np.ndarray] = []

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, count = unpack(batch.column("_set"), np.uint64)
            row, sig, band = signatures(h, np.concatenate([[0], np.cumsum(count)]), num)
            for bitmap in shared:
                kept = is_marked(bitmap, sig.view(np.int64))
                row, sig, band = row[kept], sig[kept], band[kept]
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(band, pa.int64()), batch.column("_class").take(pa.array(row))], names=["sig", "band", "_class"])

    signed = sets.mapInArrow(sign, "sig long, band long, _class long")
    many = signed.groupBy("sig").agg(F.count("*").alias("n"), F.sum(F.shiftright("_class", 24)).alias("who"), F.min("_class").alias("lead")).where("n > 2")
    many = staging.write(many.groupBy("n", "who", "lead").agg(F.min("sig").alias("sig")).select("sig", "n", "lead"), "many")
    shared.append(marks(many.select("sig")))  # signed again, without signatures that no group has
    signed = sets.mapInArrow(sign, "sig long, band long, _class long")
    return staging.write(signed.join(many, "sig"), "groups")


def _near_pairs(groups: DataFrame, sketches: DataFrame, found: DataFrame, staging: Staging, num: int, parts: int, block: int, closest: bool) -> DataFrame:
    """(a, b, differ, sig): classes that share a signature, lie in different components ``found`` and may be
    similar by their sketches, which differ in ``differ`` bytes. With ``closest``, of each class only the closest pair
    in each task, and for each signature some pair if there is one. Groups with the same smallest class, which are much
    the same, meet in one task, block by block."""
    rooted = groups.join(found, groups["_class"] == found["node"], "left").select("sig", "band", "_class", "n", "lead", F.coalesce("root", "_class").alias("_root"))
    open_ = rooted.groupBy("sig").agg(F.min("_root").alias("lo"), F.max("_root").alias("hi")).where("lo <> hi").select("sig")
    member = rooted.join(open_, "sig").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    member = member.withColumn("mine", F.pmod(F.xxhash64("_class"), F.col("blocks")).cast("int"))
    member = member.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    two = (F.least("mine", "other"), F.greatest("mine", "other"))
    part = F.pmod(F.xxhash64("lead", *two), F.lit(parts))
    member = member.select("_class", "_root", "band", "mine", "sig", (F.col("mine") != F.col("other")).alias("cross"), F.xxhash64("sig", *two).alias("cell"), part.alias("part"))
    member = staging.write(member, "member")
    shown = only_marked(sketches, "_class", member.select("_class"))
    cells = member.join(shown, ["_class", "band"]).select("part", "cell", "cross", "mine", "_class", "_root", "sig", "size", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("cell")
        cell = table.column("cell").to_numpy()
        flat, width = unpack(table.column("sketch"), np.uint8)
        start = np.concatenate([[0], np.cumsum(width)])
        kind, root, mine, sig, size = (table.column(c).to_numpy() for c in ("_class", "_root", "mine", "sig", "size"))
        crossed = set(cell[np.flatnonzero(table.column("cross").to_numpy(zero_copy_only=False))].tolist())
        cuts = np.append(np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), len(cell))
        out = [np.zeros((0, 4), np.int64)]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo > 1 and root[lo:hi].min() != root[lo:hi].max():
                m = flat[start[lo] : start[hi]].reshape(hi - lo, -1)
                pair = _cell_pairs(m, kind[lo:hi], root[lo:hi], mine[lo:hi] if int(cell[lo]) in crossed else None, size[lo:hi], num, closest)
                out.append(np.column_stack([pair, np.full(len(pair), sig[lo])]))
        pair = np.concatenate(out)
        if closest and len(pair):
            by = np.lexsort((pair[:, 1], pair[:, 0], pair[:, 2]))  # the closest first
            pair = pair[by]
            # of each class, as the smaller and as the larger one, and of each signature
            pair = pair[np.unique(np.concatenate([np.unique(pair[:, c], return_index=True)[1] for c in (0, 1, 3)]))]
        else:
            pair = pair[np.unique(pair[:, :2], axis=0, return_index=True)[1]]
        return pa.table({c: pa.array(pair[:, i], pa.int64()) for i, c in enumerate(("a", "b", "differ", "sig"))})

    return cells.groupBy("part").applyInArrow(compare, "a long, b long, differ long, sig long")


def _cell_pairs(m: np.ndarray, kind: np.ndarray, root: np.ndarray, side: np.ndarray | None, size: np.ndarray, num: int, closest: bool) -> np.ndarray:
    """Rows (smaller class, larger class, differing bytes) of a cell: of one block, or of two if ``side`` tells them apart."""
    out = [np.zeros((0, 3), np.int64)]
    for x in range(len(kind)):
        ok = (root != root[x]) & (100 * np.minimum(size, size[x]) >= num * np.maximum(size, size[x]))
        if side is not None:
            ok &= side != side[x]
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        differ = (m[at] != m[x]).sum(axis=1)
        near = differ <= (100 - num) * (size[at] + size[x]) // (100 + num)
        at, differ = at[near], differ[near]
        if closest and len(at):
            first = np.lexsort((kind[at], differ))[:1]
            at, differ = at[first], differ[first]
        y = kind[at]
        out.append(np.stack([np.minimum(y, kind[x]), np.maximum(y, kind[x]), differ], axis=1))
    return np.concatenate(out)


def similar_components(docs: DataFrame, staging: Staging, n: int = 4, num: int = 85, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with ``n_shingles`` and ``component_id`` (smallest id reachable over pairs whose
    ``n``-word shingle sets have a Jaccard similarity of ``num`` percent or more)."""
    columns = [c for c in docs.columns if c not in ("n_shingles", "component_id")]
    known = component_ids(docs, staging, n, num, id_col, text, block)
    by_class = known.where("_class IS NOT NULL").groupBy("_class").agg(F.min("component_id").alias("component_id"))

    @F.arrow_udf("struct<n:long,kind:long>")
    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for piece in pieces(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
                _, first, kind = sets_of(piece.column("t"), n)
                out.append(pa.StructArray.from_arrays([pa.array(np.diff(first), pa.int64()), pa.array(kind, pa.int64(), mask=kind == 0)], ["n", "kind"]))
            yield pa.concat_arrays(out)

    own = docs.select(*columns, describe(F.col(text)).alias("_own"))
    joined = own.alias("d").join(by_class.alias("c"), F.col("d._own.kind") == F.col("c._class"), "left")
    return joined.select(*[F.col(f"d.{c}").alias(c) for c in columns], F.col("d._own.n").alias("n_shingles"), F.coalesce("c.component_id", f"d.{id_col}").alias("component_id"))


def component_ids(docs: DataFrame, staging: Staging, n: int = 4, num: int = 85, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(_id, _n, _class, component_id) of every row; no text is moved for it but that of one
    document of each class that shares a signature with another."""
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    parts = part_count(text_bytes(docs, text))
    info = staging.write(_classes(base, n), "classes")
    first = info.where("_class IS NOT NULL").groupBy("_class").agg(F.min("_id").alias("_id"))
    tried = staging.write(candidates(base, n, num, parts), "tried_first")
    wanted = tried.select(F.col("a").alias("_class")).union(tried.select("b")).distinct().join(first, "_class")
    sets = staging.write(_sets(base, wanted, n), "sets")
    sketches = staging.write(_sketched(sets, num), "sketches")
    links = staging.write(_tested(tried, sets, sketches, staging, num), "links_first")
    found = components(links, staging, "found_first")
    groups = _groups(sets, staging, num)
    for i in range(ROUNDS):
        # of all cells of a class, the closest pair
        near = staging.write(_near_pairs(groups, sketches, found, staging, num, parts, block, closest=True), f"near{i}")
        # a group without any such pair has none in later rounds either
        groups = staging.write(groups.join(near.select("sig").distinct(), "sig", "left_semi"), f"live{i}")
        ends = near.select("a", "b", "differ", F.explode(F.array("a", "b")).alias("own")).groupBy("own").agg(F.min(F.struct("differ", "a", "b")).alias("p"))
        best = staging.write(ends.select("p.a", "p.b").distinct().join(tried, ["a", "b"], "left_anti"), f"best{i}")
        more = staging.write(_tested(best, sets, sketches, staging, num), f"links{i}")
        tried, links = tried.unionByName(best), links.unionByName(more)
        if more.isEmpty():
            break
        found = components(links, staging, f"found{i}")
    rest = _near_pairs(groups, sketches, found, staging, num, parts, block, closest=False).select("a", "b").distinct()
    rest = staging.write(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    links = links.unionByName(staging.write(_tested(rest, sets, sketches, staging, num), "links_rest"))
    found = components(links, staging, "linked")
    least = first.join(found, first["_class"] == found["node"], "left").select("_class", "_id", F.coalesce("root", "_class").alias("root"))
    least = staging.write(least, "roots")
    least = least.join(least.groupBy("root").agg(F.min("_id").alias("component_id")), "root").select("_class", "component_id")
    for name in ("tried", "fitting", "close", "sets", "sketches", "links", "found", "many", "groups", "live", "near", "member", "best", "rest", "linked"):
        staging.drop(name)
    out = info.alias("i").join(least.alias("l"), F.col("i._class") == F.col("l._class"), "left")
    return out.select("i._id", "i._n", "i._class", F.coalesce("l.component_id", "i._id").alias("component_id"))
