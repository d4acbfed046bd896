"""Mixing sources to target weights by Pfair scheduling.

Every source's documents are put in a fixed pseudo-random order and cut into blocks of
``block_chars`` characters. Ideally all sources are read at once, each at its exact weight's share of
a slot, those left sharing the slots of one that has run out. Block j is released in the slot in which the
ideal mixture begins it and due when the ideal mixture has ended it; earliest deadline first among
released blocks fills every slot, and every block keeps its window, so at every slot each source is
less than one block away from its ideal. Only block numbers are scheduled in one place (whole-number
arithmetic, some bytes and microseconds a block), and there are at most about ``MOST_BLOCKS`` of them: beyond
``MOST_BLOCKS * block_chars`` characters (64 G) blocks grow with the data. Documents meet their slots on the executors.

With ``period`` a pattern of so many slots is repeated instead: weights are rounded to whole shares
of it, at least one each, and a new phase begins when a source runs out. No document is
left
out or repeated. Block numbers come from prefix sums of lengths in two levels (buckets of each
source, then documents of each bucket), so a source with a third of all rows is spread over many
tasks.

Defined cases: a null text has length 0; a null source counts as the source ''; a source without
a target weight gets the smallest one given; sources of weight 0 come after all others; equal rows lie next to each other; a document belongs
to the block that holds its first character, and one longer than a block leaves the following
blocks of its source empty. All columns pass through; ``mix_block``, ``mix_at``, ``mix_slot``
are replaced where they exist.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_CHARS = 16_384
BUCKET_ROWS = 8_192
MOST_SOURCES = 10_000
PART_BLOCKS = 64
MOST_BLOCKS = 1 << 22


def tempered(sizes: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Weights in proportion to a power of each source's size."""
    return {s: max(n, 1) ** power for s, n in sizes.items()}


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of the period, at least 1 each, by largest remainders."""
    free, total = period - len(weights), sum(weights.values())
    exact = {s: w / total * free for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def pattern(share: dict[str, int]) -> list[str]:
    """The source of every slot of one period: earliest deadline first among released blocks."""
    period = sum(share.values())
    waiting = [(0, s, 0) for s in share]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # (deadline, source, block)
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // share[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append(s)
        if j + 1 < share[s]:
            heapq.heappush(waiting, ((j + 1) * period // share[s], s, j + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> list[tuple[str, int, int, int, int, list[int]]]:
    """(source, first block, end block, first slot, period, slots of the source in a period) of
    every phase and source; a phase ends when a source has no block left for its slot."""
    left, done = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0)
    out, slot = [], 0
    while left:
        share = shares({s: weights[s] for s in left}, max(period, 2 * len(left)))
        order = pattern(share)
        whole = min(left[s] // share[s] for s in left)
        used = {s: whole * share[s] for s in left}
        length = whole * len(order)
        for s in order:
            if used[s] == left[s]:
                break
            used[s] += 1
            length += 1
        places: dict[str, list[int]] = {s: [] for s in left}
        for at, s in enumerate(order):
            places[s].append(at)
        out += [(s, done[s], done[s] + used[s], slot, len(order), places[s]) for s in left if used[s]]
        slot += length
        for s in used:
            done[s] += used[s]
            left[s] -= used[s]
        left = {s: n for s, n in left.items() if n}
    return out


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, np.ndarray]:
    """The slot of every block of every source, by exact weights."""
    if not all(weights[s] >= 0 for s in blocks):
        raise ValueError("weights must be 0 or more")
    names = sorted(s for s, n in blocks.items() if n and weights[s] > 0)
    exact = [Fraction(weights[s]) for s in names]
    whole = lcm(*(x.denominator for x in exact))
    weight, n = [int(x * whole) for x in exact], [blocks[s] for s in names]
    last = sorted(range(len(names)), key=lambda k: Fraction(n[k], weight[k]))
    ends = [Fraction(n[k], weight[k]) for k in last]  # when each source runs out
    gone, live = [0], [sum(weight)]  # blocks of sources run out, and weight of those left
    for k in last:
        gone.append(gone[-1] + n[k])
        live.append(live[-1] - weight[k])
    phase = [0] * len(names)

    def ideal(k: int, j: int) -> tuple[int, int]:
        """Whole slots, rounded down and up, after which the ideal mixture has read j blocks."""
        p = phase[k]
        if p < len(ends) and ends[p].numerator * weight[k] <= j * ends[p].denominator:
            p = phase[k] = bisect_right(ends, Fraction(j, weight[k]), p)
        full, part = divmod(j * live[p], weight[k])
        return gone[p] + full, gone[p] + full + (part > 0)

    out = [np.empty(x, np.int64) for x in n]
    waiting = [(0, k, 0) for k in range(len(names))]  # (release, source, block)
    ready: list[tuple[int, int, int, int]] = []  # (deadline, source, block, next release)
    for slot in range(sum(n)):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            release, deadline = ideal(k, j + 1)
            heapq.heappush(ready, (deadline, k, j, release))
        _, k, j, release = heapq.heappop(ready)
        out[k][j] = slot
        if j + 1 < n[k]:
            heapq.heappush(waiting, (release, k, j + 1))
    done = dict(zip(names, out, strict=True))
    rest = {s: x for s, x in blocks.items() if x and weights[s] == 0}
    if rest:
        done |= {s: x + sum(n) for s, x in schedule(rest, dict.fromkeys(rest, 1)).items()}
    return done


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_chars: int = BLOCK_CHARS,
    period: int | None = None,
    size: str | None = None,
) -> DataFrame:
    """``docs`` with ``mix_block`` (block of its source), ``mix_at`` (characters of its source
    before it) and ``mix_slot`` (place of the block in the mixture). ``size`` names a column with
    lengths to use in place of the text's. Without weights, sources are weighed by
    :func:`tempered` sizes."""
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("mix_block", "mix_at", "mix_slot")]
    length = F.coalesce(F.col(size) if size else F.char_length(text), F.lit(0)).cast("long")
    key = F.coalesce(F.col(source).cast("string"), F.lit(""))
    order = F.xxhash64(F.col(id_col), key)
    buckets = max(1, docs.count() // BUCKET_ROWS)
    bucket = F.pmod(order, F.lit(buckets))
    wide = docs.select(F.struct(*columns).alias("_row"), key.alias("_source"), bucket.alias("_bucket"), order.alias("_order"), F.col(id_col).alias("_id"), length.alias("_len"))
    sums = docs.select(key.alias("_source"), bucket.alias("_bucket"), length.alias("_len")).groupBy("_source", "_bucket").agg(F.sum("_len").alias("_len"))
    rows = sums.groupBy("_source").agg(F.sum("_len").alias("n")).orderBy("_source").collect()  # one row per source
    if period and len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; give them a common key first")
    total = {r["_source"]: r["n"] for r in rows}
    block_chars = max(block_chars, -(-sum(total.values()) // MOST_BLOCKS))
    weight = weights if weights is not None else tempered(total)
    weight = {s: weight.get(s, min(weight.values(), default=1.0)) for s in total}
    blocks = {s: n // block_chars + 1 for s, n in total.items()}
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_source", "_bucket", F.coalesce(F.sum("_len").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = wide.withColumn("_at", F.coalesce(F.sum("_len").over(inside), F.lit(0))).join(sums, ["_source", "_bucket"])
    placed = placed.withColumn("_at", F.col("_at") + F.col("_before")).withColumn("_block", F.floor(F.col("_at") / F.lit(block_chars)))
    if period:
        schema = T.StructType([T.StructField("_source", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("_first", "_end", "_slot", "_period")), T.StructField("_places", T.ArrayType(T.LongType()))])
        plan = spark.createDataFrame(phases(blocks, weight, period), schema)
        placed = placed.alias("p").join(plan.alias("q"), (F.col("p._source") == F.col("q._source")) & (F.col("_block") >= F.col("_first")) & (F.col("_block") < F.col("_end")))
        step = F.col("_block") - F.col("_first")
        share = F.size("_places")
        slot = F.col("_slot") + F.floor(step / share) * F.col("_period") + F.element_at("_places", (F.pmod(step, share) + 1).cast("int"))
    else:
        parts = [(s, k, x[k * PART_BLOCKS : (k + 1) * PART_BLOCKS]) for s, x in schedule(blocks, weight).items() for k in range(-(-len(x) // PART_BLOCKS))]
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()))
        columns_of = zip(*parts, strict=True) if parts else ([], [], [])
        plan = spark.createDataFrame(pa.table([pa.array(list(c), t) for c, t in zip(columns_of, kinds, strict=True)], names=["_source", "_part", "_places"]))
        placed = placed.withColumn("_part", F.floor(F.col("_block") / F.lit(PART_BLOCKS))).join(plan, ["_source", "_part"])
        slot = F.element_at("_places", (F.pmod("_block", F.lit(PART_BLOCKS)) + 1).cast("int"))
    return placed.select("_row.*", F.col("_block").alias("mix_block"), F.col("_at").alias("mix_at"), slot.alias("mix_slot"))
