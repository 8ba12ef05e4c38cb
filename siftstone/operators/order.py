"""Order without one task: row numbers, running sums and exact quantiles of whole columns.

Rows are dealt into contiguous ranges of the order; what the ranges before hold
is one row for each range, so only these are ever added up in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut

#: Bins of a histogram round, and distinct values that are fetched at the end of it.
BINS, FETCH = 4_096, 100_000


def _ranged(df: DataFrame, order: list[Column | str]) -> DataFrame:
    # Written, so that a row stays in its range in all that follows.
    return cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with row numbers 1, 2, ... in an order that leaves no ties."""
    return running_sum(df, [], order, F.lit(1), name)


def running_sum(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same ``keys`` up to each row in ``order``."""
    rows = _ranged(df, [*keys, *order])
    sums = rows.groupBy("_range", *keys).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", *keys, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.alias("r").join(offsets.alias("o"), [F.col("r._range") == F.col("o._range"), *[F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]])
    out = met.select("r.*", "o._before").withColumn(name, F.sum(value).over(inside) + F.col("_before"))
    return out.drop("_range", "_before")


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Exact percentiles of each column, linear between ranks; nulls and NaN don't count, null for a column without values.

    Each round is one aggregate for all columns: a histogram of the intervals
    that still hold a wanted rank. Once these hold few distinct values, they are
    fetched. No task and no buffer ever holds a column.
    """
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    one = df.agg(*[f(x[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    n = {c: one[f"n{i}"] for i, c in enumerate(columns)}
    wanted = {c: sorted({r for p in probabilities for r in (int(p * (n[c] - 1)), min(int(p * (n[c] - 1)) + 1, n[c] - 1))}) for c in columns if n[c]}
    #: Values of ranks, and open intervals: (column, low, high, rows before it, rows in it, ranks in it).
    value: dict[tuple[str, int], float] = {}
    open_ = [(c, one[f"a{i}"], one[f"b{i}"], 0, n[c], wanted[c]) for i, c in enumerate(columns) if n[c]]

    def settle(found: list) -> list:
        left = []
        for c, low, high, before, rows, ranks in found:
            if low == high:
                value.update({(c, r): low for r in ranks})
            else:
                left.append((c, low, high, before, rows, ranks))
        return left

    def tagged(intervals: list, bins: bool) -> DataFrame:
        marks = []
        for k, (c, low, high, *_) in enumerate(intervals):
            v = x[c]
            at = F.least(F.floor((v - F.lit(low)) / F.lit(high - low) * BINS), F.lit(BINS - 1)).cast("int") if bins else F.lit(0)
            marks.append(F.when((v >= F.lit(low)) & (v <= F.lit(high)), F.struct(F.lit(k).alias("k"), at.alias("at"), v.alias("v"))))
        return df.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.*")

    open_ = settle(open_)
    for _round in range(200):
        if not open_ or sum(rows for *_x, rows, _r in open_) <= FETCH:
            break
        histogram: dict[int, list] = {}
        for r in tagged(open_, True).groupBy("k", "at").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect():
            histogram.setdefault(r.k, []).append(r)
        smaller = []
        for k, (c, _low, _high, before, _rows, ranks) in enumerate(open_):
            for r in sorted(histogram[k], key=lambda r: r.at):
                mine = [q for q in ranks if before <= q < before + r.n]
                if mine:
                    smaller.append((c, r.a, r.b, before, r.n, mine))
                before += r.n
        open_ = settle(smaller)
    if open_:
        fetched: dict[int, list] = {}
        for r in tagged(open_, False).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).collect():
            fetched.setdefault(r.k, []).append((r.v, r.n))
        for k, (c, _low, _high, before, _rows, ranks) in enumerate(open_):
            todo = list(ranks)
            for v, m in sorted(fetched[k]):
                while todo and todo[0] < before + m:
                    value[c, todo.pop(0)] = v
                before += m
    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = []
        for p in probabilities:
            if not n[c]:
                out[c].append(None)
                continue
            at = p * (n[c] - 1)
            low, high = value[c, int(at)], value[c, min(int(at) + 1, n[c] - 1)]
            out[c].append(low + (high - low) * (at - int(at)))
    return out
