"""Sharding by minimax contiguous partition.

The atoms are groups of equal texts, ordered by the SHA-256 of the text. The
smallest capacity under which a greedy sweep needs at most ``shards`` shards
is found by binary search, and the sequence is cut where that sweep cuts.

The search never sees all groups. It works on a summary of contiguous digest
ranges (4096 at first, by three hex digits; the digest spreads them evenly)
and splits only those ranges in which a cut may still fall into 256 each, until
these hold single groups. A cut leaves a handful of such ranges, so a round
brings some thousands of ranges to the driver at any size of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shuffle_width

#: Hex digits of the first summary, and those that each refinement adds.
FIRST, STEP = 3, 2


@dataclass(frozen=True)
class Segment:
    """A contiguous range of digests: those that start with ``prefix``."""

    prefix: str
    size: int
    first: str
    atomic: bool


def _sweep_whole(segments: list[Segment], capacity: int, shards: int) -> bool:
    """Greedy check that cuts between segments only."""
    used, load = 1, 0
    for s in segments:
        if s.size > capacity:
            return False
        if load + s.size > capacity:
            used, load = used + 1, 0
            if used > shards:
                return False
        load += s.size
    return True


def _sweep_cut(segments: list[Segment], capacity: int, shards: int) -> bool:
    """Greedy check that may cut anywhere inside a segment which isn't atomic: true wherever the exact check is."""
    used, load = 1, 0
    for s in segments:
        if s.atomic:
            if s.size > capacity:
                return False
            if load + s.size > capacity:
                used, load = used + 1, 0
            load += s.size
        else:
            load += s.size
            while load > capacity:
                used, load = used + 1, load - capacity
                if used > shards:
                    return False
        if used > shards:
            return False
    return True


def _smallest(feasible, low: int, high: int) -> int:
    while low < high:
        mid = (low + high) // 2
        if feasible(mid):
            high = mid
        else:
            low = mid + 1
    return low


def _uncertain(segments: list[Segment], low: int, high: int, shards: int) -> set[str]:
    """Segments that may hold a cut for some capacity from ``low`` to ``high``."""
    ends, total = [], 0
    for s in segments:
        total += s.size
        ends.append(total)
    largest = max((s.size for s in segments if not s.atomic), default=0)
    marked: set[str] = set()
    start_low = start_high = 0
    for _ in range(shards):
        # A cut lies at most one atom before start + capacity; an atom inside a segment is no larger than that segment.
        reach_low, reach_high = max(0, start_low + low - largest), start_high + high
        lo_cut, hi_cut = total, 0
        begin = 0
        for s, end in zip(segments, ends, strict=True):
            if end > reach_low and begin <= reach_high:
                if not s.atomic:
                    marked.add(s.prefix)
                lo_cut, hi_cut = min(lo_cut, begin), max(hi_cut, min(end, reach_high))
            begin = end
        start_low, start_high = min(lo_cut, total), min(max(hi_cut, start_low), total)
    return marked


def find_cuts(sizes: DataFrame, shards: int) -> tuple[int, list[str]]:
    """``sizes``: (_sha, _size) rows. Returns the smallest capacity and the first digest of shard 1, 2, ..."""

    def summary(df: DataFrame, digits: int) -> list[Segment]:
        rows = (
            df.groupBy(F.substring("_sha", 1, digits).alias("p"))
            .agg(F.sum("_size").alias("s"), F.min("_sha").alias("a"), F.max("_sha").alias("b"))
            .collect()
        )
        return sorted((Segment(r.p, r.s, r.a, r.a == r.b) for r in rows), key=lambda s: s.prefix)

    segments = summary(sizes, FIRST)
    if not segments:
        return 0, []
    total = sum(s.size for s in segments)
    while True:
        floor = max(-(-total // shards), max((s.size for s in segments if s.atomic), default=1))
        low = _smallest(lambda c: _sweep_cut(segments, c, shards), floor, total)
        high = _smallest(lambda c: _sweep_whole(segments, c, shards), low, total)
        marked = set() if low == high and all(s.atomic for s in segments) else _uncertain(segments, low, high, shards)
        if not marked:
            break
        parts = []
        for digits in sorted({len(p) for p in marked}):
            split = sorted(p for p in marked if len(p) == digits)
            parts += summary(sizes.where(F.substring("_sha", 1, digits).isin(split)), digits + STEP)
        segments = sorted([s for s in segments if s.prefix not in marked] + parts, key=lambda s: s.prefix)
    capacity = _smallest(lambda c: _sweep_whole(segments, c, shards), low, total)
    cuts, load = [], 0
    for s in segments:
        if load + s.size > capacity:
            cuts.append(s.first)
            load = 0
        load += s.size
    return capacity, cuts


def _shard_of(cuts: list[str]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(F.col("_sha") >= c, 1).otherwise(0)
    return out.cast("int")


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``<id_col>, size, text_crc32, law, shard, slot, grown_shard, text_sha256``.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has none and shares
    the group of the empty one. Equal texts share a shard, so a group larger
    than an even share makes its shard that large. ``slot`` counts from 0
    within a shard. With fewer groups than shards, later shards stay empty; an
    empty table gives no rows. Repeated rows each take a slot; rows with a null id
    too, and those of one text lie in one cell of its group. Other columns,
    whatever their names, aren't read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            F.sha2(text, 256).alias("_sha"),
        )
    )
    _, cuts = find_cuts(rows.select("_sha", "_size"), shards)
    # Slots: count rows in cells, give every cell its offset in the shard, number the rows inside a cell. A cell is a
    # digest range of a shard; a range above its fair share, as a large group of copies makes it, is split by id.
    width = max(4096, 4 * shuffle_width(spark))
    placed = rows.withColumn("shard", _shard_of(cuts)).withColumn("_range", F.conv(F.substring("_sha", 1, 3), 16, 10).cast("int"))
    counts = placed.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_c"))
    fair = max(64, -(-4 * rows.count() // width))
    # At most 4096 ranges and one more for each cut, so the broadcast has a fixed bound.
    ways = counts.select("shard", "_range", F.ceil(F.col("_c") / F.lit(fair)).cast("int").alias("_ways"))
    celled = placed.join(F.broadcast(ways), ["shard", "_range"]).withColumn("_cell", F.pmod(F.xxhash64("_id"), F.col("_ways")).cast("int"))
    cells = celled.groupBy("shard", "_range", "_cell").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("shard").orderBy("_range", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "_range", "_cell", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_range", "_cell").orderBy("_sha", "_id")
    return (
        celled.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "_range", "_cell"])
        .select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_offset") + F.col("_rank")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            F.col("_sha").alias("text_sha256"),
        )
    )
