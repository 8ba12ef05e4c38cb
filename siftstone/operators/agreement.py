"""Agreement of two labelings from their contingency table.

The table is one equi-join on the row id and one aggregate; everything else
works on its k x k cells.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contingency(a: DataFrame, b: DataFrame, id_col: str = "row_id", label: str = "label", noise: bool = False) -> DataFrame:
    """(la, lb, n); pairs in which either is noise (-1) are left out unless ``noise``."""
    met = a.select(id_col, F.col(label).alias("la")).join(b.select(id_col, F.col(label).alias("lb")), id_col)
    if not noise:
        met = met.where("la <> -1 AND lb <> -1")
    return met.groupBy("la", "lb").agg(F.count(F.lit(1)).alias("n"))


def all_contingencies(runs: DataFrame, run: str = "run", id_col: str = "row_id", label: str = "label") -> DataFrame:
    """(ra, rb, la, lb, n) of each two runs ra < rb of a long label table, noise left out: one self-join on the row id."""
    left = runs.where(F.col(label) != -1).select(id_col, F.col(run).alias("ra"), F.col(label).alias("la"))
    right = runs.where(F.col(label) != -1).select(id_col, F.col(run).alias("rb"), F.col(label).alias("lb"))
    return left.join(right, id_col).where("ra < rb").groupBy("ra", "rb", "la", "lb").agg(F.count(F.lit(1)).alias("n"))


def scores(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ari, nmi, homogeneity, completeness, v_measure, fmi, purity for each group of ``keys``."""
    keys = keys or []
    if not keys:
        cells, keys = cells.withColumn("_k", F.lit(0)), ["_k"]
    rows = cells.groupBy(*keys, "la").agg(F.sum("n").alias("r"))
    cols = cells.groupBy(*keys, "lb").agg(F.sum("n").alias("c"), F.max("n").alias("top"))
    n = F.col("n").cast("double")
    by_cell = cells.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * (n - 1) / 2).alias("pairs"), F.sum(n * F.log(n)).alias("nln"))
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    by_row = rows.groupBy(*keys).agg(F.sum(r * (r - 1) / 2).alias("pa"), F.sum(r * F.log(r)).alias("rln"), F.count(F.lit(1)).alias("ka"))
    by_col = cols.groupBy(*keys).agg(F.sum(c * (c - 1) / 2).alias("pb"), F.sum(c * F.log(c)).alias("cln"), F.count(F.lit(1)).alias("kb"), F.sum("top").alias("best"))
    j = by_cell.join(by_row, keys).join(by_col, keys)
    total = F.col("n") * (F.col("n") - 1) / 2
    expected = F.when(total > 0, F.col("pa") * F.col("pb") / total).otherwise(F.lit(0.0))
    ha, hb = F.log("n") - F.col("rln") / F.col("n"), F.log("n") - F.col("cln") / F.col("n")
    mi = F.log("n") + (F.col("nln") - F.col("rln") - F.col("cln")) / F.col("n")
    top = (F.col("pa") + F.col("pb")) / 2 - expected
    j = j.withColumns(
        {
            "ari": F.when(F.abs(top) < 1e-12, F.lit(1.0)).otherwise((F.col("pairs") - expected) / F.when(F.abs(top) < 1e-12, F.lit(1.0)).otherwise(top)),
            "_mi": F.greatest(mi, F.lit(0.0)),
            "_ha": ha,
            "_hb": hb,
        }
    )
    share = lambda d: F.when(F.col(d) > 1e-12, F.col("_mi") / F.when(F.col(d) > 1e-12, F.col(d)).otherwise(F.lit(1.0))).otherwise(F.lit(1.0))
    j = j.withColumns({"homogeneity": share("_ha"), "completeness": share("_hb")})
    h, k = F.col("homogeneity"), F.col("completeness")
    both = F.col("_ha") + F.col("_hb")
    return j.select(
        *[x for x in keys if x != "_k"],
        "ari",
        F.when(both > 1e-12, 2 * F.col("_mi") / F.when(both > 1e-12, both).otherwise(F.lit(1.0))).otherwise(F.lit(1.0)).alias("nmi"),
        "homogeneity",
        "completeness",
        F.when(h + k > 0, 2 * h * k / F.when(h + k > 0, h + k).otherwise(F.lit(1.0))).otherwise(F.lit(0.0)).alias("v_measure"),
        F.when(F.col("pa") * F.col("pb") > 0, F.col("pairs") / F.sqrt(F.when(F.col("pa") * F.col("pb") > 0, F.col("pa") * F.col("pb")).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0)).alias("fmi"),
        (F.col("best") / F.col("n")).alias("purity"),
    )


#: Cells that may come to the driver.
MAX_CELLS = 1_000_000


def _collected(cells: DataFrame) -> list:
    rows = cells.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} pairs of clusters")
    return rows


def adjusted_mutual_information(cells: DataFrame) -> float:
    """AMI with the arithmetic mean; the expected information runs over the k x k margins on the driver."""
    rows = _collected(cells)
    if not rows:
        return 0.0
    la, lb = sorted({r.la for r in rows}), sorted({r.lb for r in rows})
    m = np.zeros((len(la), len(lb)))
    for r in rows:
        m[la.index(r.la), lb.index(r.lb)] = r.n
    n, a, b = m.sum(), m.sum(axis=1), m.sum(axis=0)
    if len(la) == len(lb) == 1:
        return 1.0
    entropy = lambda x: float(-(x / n * np.log(x / n)).sum())
    at = m > 0
    mi = float((m[at] / n * np.log(m[at] * n / np.outer(a, b)[at])).sum())
    lg = math.lgamma
    emi = 0.0
    for x in a:
        for y in b:
            for k in range(int(max(1, x + y - n)), int(min(x, y)) + 1):
                p = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1) - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1)
                emi += k / n * math.log(n * k / (x * y)) * math.exp(p)
    top = (entropy(a) + entropy(b)) / 2 - emi
    return (mi - emi) / top if abs(top) > 1e-15 else 1.0


def best_jaccard(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For each label of the first run its best matching label of the second: la, lb, jaccard (ties: smaller lb)."""
    keys = keys or []
    rows, cols = Window.partitionBy(*keys, "la"), Window.partitionBy(*keys, "lb")
    j = cells.withColumn("jaccard", F.col("n") / (F.sum("n").over(rows) + F.sum("n").over(cols) - F.col("n")))
    order = Window.partitionBy(*keys, "la").orderBy(F.desc("jaccard"), "lb")
    return j.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, "la", "lb", "jaccard")


def cluster_jaccard(cells: DataFrame) -> DataFrame:
    """Jaccard of clusters that bear the same id in both runs."""
    rows, cols = Window.partitionBy("la"), Window.partitionBy("lb")
    j = cells.withColumn("jaccard", F.col("n") / (F.sum("n").over(rows) + F.sum("n").over(cols) - F.col("n")))
    return j.where("la = lb").select(F.col("la").alias("label"), "jaccard")


def greedy_jaccard(cells: DataFrame) -> float:
    """Mean Jaccard of a greedy one-to-one matching, first run's labels in order (k x k cells on the driver)."""
    rows = _collected(cells)
    ra, rb, n = {}, {}, {}
    for r in rows:
        ra[r.la], rb[r.lb], n[r.la, r.lb] = ra.get(r.la, 0) + r.n, rb.get(r.lb, 0) + r.n, r.n
    free, got = set(rb), []
    for a in sorted(ra):
        best = max(((n.get((a, b), 0) / (ra[a] + rb[b] - n.get((a, b), 0)), -b) for b in free), default=(0.0, 0))
        got.append(best[0])
        if best[0] > 0:
            free.discard(-best[1])
    return float(np.mean(got)) if got else 0.0


def cluster_flow(a: DataFrame, b: DataFrame, id_col: str = "row_id", label: str = "label") -> DataFrame:
    """How many rows go from each cluster to each, and their share of the source: la, lb, n, share."""
    cells = contingency(a, b, id_col, label, noise=True)
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("la")))


def recovered(cells: DataFrame) -> DataFrame:
    """State of each cluster in the other run: recovered (Jaccard >= .5), partial (>= .25), lost."""
    return best_jaccard(cells).withColumn("state", F.when(F.col("jaccard") >= 0.5, "recovered").when(F.col("jaccard") >= 0.25, "partial").otherwise("lost"))
