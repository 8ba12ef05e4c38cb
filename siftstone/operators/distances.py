"""Joins by distance: nearest centroid, nearest neighbours, radius.

Point-to-point work runs in blocks of numpy matrices. The side that every task
needs whole is broadcast only up to ``MAX_REFERENCE`` rows. Beyond that rows are
dealt to cells around pivots, and only those pairs of cells meet that the
triangle inequality leaves possible; memory stays bounded by the block size.
Sums over all pairs can't skip any, so there every two blocks meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import squared_distance, vector  # noqa: F401

#: Rows that may be broadcast or collected as a dense matrix.
MAX_REFERENCE = 20_000
#: Rows of a block, and the most cells.
BLOCK, MAX_CELLS = 2_000, 4_096
#: Terms of distance expressions that are compiled as plain arithmetic; beyond that numpy computes them.
MAX_TERMS = 200


def _by_differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j][:, None] - b[:, j][None, :]) ** 2
    return out


def pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows; those of near or equal rows are computed by differences, the others by a matrix product."""
    if a.shape[1] <= 4 or not len(a) or not len(b):
        return np.sqrt(_by_differences(a, b))
    middle = b.mean(axis=0)
    x, y = a - middle, b - middle
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = (-2 * x) @ y.T
    out += xx[:, None]
    out += yy[None, :]
    near = np.flatnonzero(out < 1e-5 * (xx.max() + yy.max()))
    if 8 * len(near) > out.size:
        return np.sqrt(_by_differences(a, b))
    i, j = np.divmod(near, len(b))
    out[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(out, out=out)


def bounded_rows(df: DataFrame, limit: int = MAX_REFERENCE) -> pd.DataFrame:
    """``df`` on the driver; an error if it has more than ``limit`` rows."""
    rows = df.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; sample them first")
    return rows


def centroids(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Mean of each label's points, noise (-1) left out: label, n and the features."""
    return df.where(F.col(label) != -1).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in features])


def centroid_array(df: DataFrame, label: str, features: list[str], limit: int = 10_000) -> list[tuple[int, list[float]]]:
    rows = centroids(df, label, features).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} clusters")
    return sorted((r[label], [float(r[f]) for f in features]) for r in rows)


def nearest_centroid(df: DataFrame, centres: list[tuple[int, list[float]]], features: list[str], label: str = "cluster", distance: str = "distance") -> DataFrame:
    """Each row with its nearest centre; ties go to the smaller label. Centres are literals: no join, no shuffle."""
    if len(centres) * len(features) > MAX_TERMS:
        names, points = np.array([k for k, _ in centres], np.int32), np.array([c for _, c in centres], float)

        @F.pandas_udf("struct<d: double, k: int>")
        def nearest(*columns: pd.Series) -> pd.DataFrame:
            d = pairwise(np.column_stack([c.to_numpy(float) for c in columns]), points)
            pick = d.argmin(axis=1)
            return pd.DataFrame({"d": d[np.arange(len(d)), pick], "k": names[pick]})

        found = df.withColumn("_best", nearest(*[F.col(f).cast("double") for f in features]))
        return found.withColumn(label, F.col("_best.k")).withColumn(distance, F.col("_best.d")).drop("_best")

    def away(c: list[float]) -> Column:  # plain arithmetic, which is compiled; functions over arrays are interpreted
        return F.sqrt(sum(((F.col(f) - F.lit(float(v))) * (F.col(f) - F.lit(float(v))) for f, v in zip(features, c, strict=True)), F.lit(0.0)))

    options = F.array(*[F.struct(away(c).alias("d"), F.lit(k).alias("k")) for k, c in centres])
    best = F.array_min(options)
    return df.withColumn("_best", best).withColumn(label, F.col("_best.k")).withColumn(distance, F.col("_best.d")).drop("_best")


def _blocks(df: DataFrame, id_col: str, columns: list[str]) -> tuple[DataFrame, int]:
    """Rows dealt by a hash of the id into blocks of about BLOCK rows, and the number of blocks."""
    blocks = max(1, -(-df.count() // BLOCK))
    return df.select(*columns, F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("_blk")), blocks


def meet_blocks(points: DataFrame, reference: DataFrame, id_col: str, columns: list[str], fn: Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]], schema: str, half: bool = False) -> DataFrame:
    """``fn(query rows, reference rows)`` for every two blocks, each in a task's group of its own; reference rows come in order of their id.

    ``half``: two blocks of one table meet once, not in both orders.
    """
    left, n = _blocks(points, id_col, columns)
    right, m = _blocks(reference, id_col, columns)
    fresh = [F.col(c).alias(c) for c in columns]  # new column ids: both sides may be one table
    left = left.select(*fresh, F.col("_blk").alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_b"))
    right = right.select(*fresh, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_a"), F.col("_blk").alias("_b"))
    if half:
        left, right = left.where("_a <= _b"), right.where("_a <= _b")
    names = [c.split(":")[0].split()[0] for c in schema.split(", ")]

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = list(fn(p[columns], q[columns].sort_values(id_col, ignore_index=True))) if len(p) and len(q) else []
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in names})

    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(meet, schema)


def per_point(
    points: DataFrame,
    reference: DataFrame,
    id_col: str,
    features: list[str],
    fn: Callable[[np.ndarray, pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    extra: list[str] | None = None,
) -> DataFrame:
    """Partial rows ``fn(distances, query rows, reference rows)`` of blocks of points against all of the reference.

    A reference of up to MAX_REFERENCE rows is broadcast and ``fn`` sees it
    whole. Beyond that every two blocks meet, ``fn`` runs for each of them, and
    the caller combines the partials of a point.
    """
    keep = list(dict.fromkeys([id_col, *(extra or []), *features]))

    against = _in_parts(features, fn)
    if reference.limit(MAX_REFERENCE + 1).count() > MAX_REFERENCE:
        return meet_blocks(points, reference, id_col, keep, against, schema)
    rows = reference.select(*keep).toPandas().sort_values(id_col, ignore_index=True)
    shared = points.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(shared.value):
                yield from against(pdf, shared.value)

    return points.select(*keep).mapInPandas(run, schema)


@dataclass(frozen=True)
class Cells:
    """Rows dealt to the cells of their nearest pivots; a cell of many rows has several blocks."""

    #: The kept columns, _cell and _sub (the block in the cell).
    rows: DataFrame
    pivots: np.ndarray
    #: Largest distance of a row from its pivot, and blocks, of each cell.
    radius: np.ndarray
    ways: np.ndarray

    def gaps(self) -> np.ndarray:
        """For each two cells a lower bound of the distance between their rows."""
        return pairwise(self.pivots, self.pivots) - self.radius[:, None] - self.radius[None, :]


def deal_cells(df: DataFrame, id_col: str, features: list[str], keep: list[str]) -> Cells:
    from .graph import cut
    from .sampling import uniform_sample

    n = df.count()
    m = max(1, min(MAX_CELLS, -(-n // BLOCK)))
    x = uniform_sample(df.select(id_col, *features), id_col, min(n, 20 * m, MAX_REFERENCE), 7).toPandas().sort_values(id_col)[features].to_numpy(float)
    pivots = x[np.linspace(0, len(x) - 1, min(m, len(x))).astype(int)] if len(x) else np.zeros((1, len(features)))
    for _ in range(5):
        near = pairwise(x, pivots).argmin(axis=1)
        pivots = np.array([x[near == j].mean(axis=0) if (near == j).any() else p for j, p in enumerate(pivots)])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = pairwise(pdf[features].to_numpy(float), pivots)
            pick = d.argmin(axis=1)
            yield pdf.assign(_cell=pick.astype("int32"), _away=d[np.arange(len(d)), pick])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    placed = cut(df.select(*keep).mapInPandas(place, f"{kinds}, _cell int, _away double"))
    radius, ways = np.zeros(len(pivots)), np.zeros(len(pivots), int)
    for r in placed.groupBy("_cell").agg(F.max("_away").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["_cell"]], ways[r["_cell"]] = r.r + 1e-9 * (1 + r.r), -(-r.n // BLOCK)
    deal = F.array(*[F.lit(int(max(w, 1))) for w in ways])[F.col("_cell")]
    return Cells(placed.drop("_away").withColumn("_sub", F.pmod(F.xxhash64(id_col), deal).cast("int")), pivots, radius, ways)


def meet_cells(cells: Cells, id_col: str, columns: list[str], allowed: np.ndarray, fn: Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``fn(query rows, reference rows)`` for the blocks of each two cells that are ``allowed`` (ordered pairs), each in a group of its own."""
    spark = cells.rows.sparkSession
    a, b = np.nonzero(allowed & (cells.ways[:, None] > 0) & (cells.ways[None, :] > 0))
    pairs = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "wa": cells.ways[a], "wb": cells.ways[b]}).astype("int32"), "a int, b int, wa int, wb int")
    pairs = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("wa") - 1)).alias("sa"), "wb").select("a", "sa", "b", F.explode(F.sequence(F.lit(0), F.col("wb") - 1)).alias("sb"))
    few = len(a) * int(max(cells.ways.max(initial=1), 1)) ** 2 < 1_000_000
    pairs = F.broadcast(pairs) if few else pairs
    rows = cells.rows
    fresh = [F.col(c).alias(c) for c in (*columns, "a", "sa", "b", "sb")]  # new column ids: both sides are one table
    left = rows.join(pairs, (F.col("_cell") == F.col("a")) & (F.col("_sub") == F.col("sa"))).select(*fresh)
    right = rows.join(pairs, (F.col("_cell") == F.col("b")) & (F.col("_sub") == F.col("sb"))).select(*fresh)
    names = [c.split(":")[0].split()[0] for c in schema.split(", ")]

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = list(fn(p[columns], q[columns].sort_values(id_col, ignore_index=True))) if len(p) and len(q) else []
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in names})

    keys = ["a", "sa", "b", "sb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)


def _in_parts(features: list[str], fn: Callable[[np.ndarray, pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]]:
    def against(pdf: pd.DataFrame, ref: pd.DataFrame) -> Iterator[pd.DataFrame]:
        m = ref[features].to_numpy(float)
        for lo in range(0, len(pdf), 512):
            part = pdf.iloc[lo : lo + 512]
            yield fn(pairwise(part[features].to_numpy(float), m), part, ref)

    return against


def within(df: DataFrame, id_col: str, features: list[str], eps: float, fn: Callable[[np.ndarray, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, extra: list[str] | None = None, cells: Cells | None = None) -> DataFrame:
    """Partial rows ``fn(distances, query rows, reference rows)`` that cover all pairs of rows within ``eps`` (and others).

    ``cells``: the rows as ``deal_cells`` has dealt them, where that was done before.
    """
    keep = list(dict.fromkeys([id_col, *(extra or []), *features]))
    if cells is None and df.limit(MAX_REFERENCE + 1).count() <= MAX_REFERENCE:
        return per_point(df, df, id_col, features, fn, schema, extra)
    cells = cells or deal_cells(df, id_col, features, keep)
    return meet_cells(cells, id_col, keep, cells.gaps() <= eps, _in_parts(features, fn), schema)


def _candidates(id_col: str, features: list[str], k: int, include_self: bool) -> Callable[[np.ndarray, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def best(d: np.ndarray, q: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        ids, others = q[id_col].to_numpy(), ref[id_col].to_numpy()
        if not include_self:
            d[ids[:, None] == others[None, :]] = np.inf
        m = min(k, d.shape[1])
        # All that may be among the k nearest, with exact distances: ties are decided by the caller.
        edge = np.partition(d, m - 1, axis=1)[:, m - 1] * (1 + 1e-9) + 1e-12
        i, j = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
        x, y = q[features].to_numpy(float), ref[features].to_numpy(float)
        away = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))
        order = np.lexsort((others[j], away, i))
        i, j, away = i[order], j[order], away[order]
        first = np.searchsorted(i, np.arange(len(ids)))
        kept = np.arange(len(i)) - first[i] < k
        return pd.DataFrame({"id": ids[i[kept]], "neighbour": others[j[kept]], "distance": away[kept]})

    return best


def knn(df: DataFrame, id_col: str, features: list[str], k: int, include_self: bool = False) -> DataFrame:
    """The ``k`` nearest neighbours of each row: ``id, neighbour, distance, rank`` (ties by id).

    Beyond MAX_REFERENCE rows, a row's own cell bounds the distance of its k-th
    neighbour; then its cell meets those that hold rows within that bound.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, neighbour {kind}, distance double"
    best = _candidates(id_col, features, k, include_self)
    order = Window.partitionBy("id").orderBy("distance", "neighbour")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if df.limit(MAX_REFERENCE + 1).count() <= MAX_REFERENCE:
        return ranked(per_point(df, df, id_col, features, best, schema))
    from .graph import cut

    keep = [id_col, *features]
    cells = deal_cells(df, id_col, features, keep)
    own = np.eye(len(cells.ways), dtype=bool)
    first = cut(ranked(meet_cells(cells, id_col, keep, own, _in_parts(features, best), schema)))
    far = first.groupBy("id").agg(F.max("distance").alias("u"), F.count(F.lit(1)).alias("c"))
    placed = cells.rows.select(F.col(id_col).alias("id"), "_cell").join(far, "id", "left")
    bound = np.zeros(len(cells.ways))
    for r in placed.groupBy("_cell").agg(F.max(F.when(F.coalesce("c", F.lit(0)) >= k, F.col("u")).otherwise(F.lit(float("inf")))).alias("u")).collect():
        bound[r["_cell"]] = r.u
    others = meet_cells(cells, id_col, keep, (cells.gaps() <= bound[:, None]) & ~own, _in_parts(features, best), schema)
    return ranked(first.drop("rank").unionByName(others))


def radius_pairs(df: DataFrame, id_col: str, features: list[str], eps: float, keep_self: bool = False) -> DataFrame:
    """Ordered pairs within ``eps``: ``id, neighbour, distance``."""
    kind = df.schema[id_col].dataType.simpleString()

    def near(d: np.ndarray, q: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        ids, others = q[id_col].to_numpy(), ref[id_col].to_numpy()
        i, j = np.nonzero(d <= eps * (1 + 1e-9) + 1e-12)
        if not keep_self:
            i, j = (v[ids[i] != others[j]] for v in (i, j))
        x, y = q[features].to_numpy(float), ref[features].to_numpy(float)
        away = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))
        ok = away <= eps
        return pd.DataFrame({"id": ids[i[ok]], "neighbour": others[j[ok]], "distance": away[ok]})

    return within(df, id_col, features, eps, near, f"id {kind}, neighbour {kind}, distance double")


def pair_block(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Distances between the centroids of each two clusters: a, b (a < b), distance. k rows meet k rows."""
    rows = centroid_array(df, label, features)
    pairs = [(a, b, float(np.linalg.norm(np.subtract(x, y)))) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :]]
    return df.sparkSession.createDataFrame(pairs, "a int, b int, distance double")


def label_column(name: str) -> Column:
    return F.col(name).cast("int")
