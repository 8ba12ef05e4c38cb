"""Consensus of several labelings, from a long table (run, row_id, label).

Co-association is sparse: only pairs that share a cluster in some run have a
row. Rows with the same labels in all runs are one profile, and what is counted
over pairs of rows is counted over pairs of profiles. Steps that need a dense
matrix take at most ``DENSE`` rows or, beyond that, profiles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import agreement, clustering, distances, metrics
from .graph import cut

DENSE = 2_000
#: Profiles that meta-clustering takes.
META = 20_000
#: Rows of a profile in one list.
MEMBERS = 4_096
#: Rows of weights up to which they are broadcast.
BROADCAST_ROWS = 10_000


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` broadcast if it is small; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def coassociation(runs: DataFrame, weights: DataFrame | None = None, id_col: str = "row_id") -> DataFrame:
    """(i, j, c) with i < j: weighted share of runs in which both rows are in one cluster.

    Profiles meet by (run, label), and lists of at most about MEMBERS of their
    rows by profile: pairs of rows come out of the last step, so none is
    shuffled, and a condition on ``c`` leaves out profiles. With ``weights``
    (run, weight) the weights are scaled to sum 1; otherwise all runs weigh the same.
    """
    members, counted = profiles(runs.select("run", F.col(id_col).alias("_row"), "label"), "_row")  # the ids may be called pid
    rows = counted.select("pid", F.explode("labels").alias("l")).select("pid", "l.run", "l.label")
    if weights is None:
        n = runs.select("run").distinct().count()
        rows = rows.withColumn("w", F.lit(1.0 / max(n, 1)))
    else:
        total = float(weights.agg(F.sum("weight")).first()[0] or 1.0)
        rows = rows.join(_bounded(weights), "run").withColumn("w", F.col("weight") / F.lit(total))
    a = rows.select("run", "label", "w", F.col("pid").alias("p"))
    b = rows.select("run", "label", F.col("pid").alias("q"))
    pairs = a.join(b, ["run", "label"]).where("p <= q").groupBy("p", "q").agg(F.sum("w").alias("c"))
    ways = F.ceil(F.col("n") / F.lit(MEMBERS)).cast("int")
    lists = members.join(counted.select("pid", ways.alias("ways")), "pid").groupBy("pid", F.pmod(F.xxhash64("_row"), "ways").alias("part")).agg(F.collect_list("_row").alias("ids"))
    met = pairs.join(lists.select(F.col("pid").alias("p"), F.col("ids").alias("a")), "p").join(lists.select(F.col("pid").alias("q"), F.col("ids").alias("b")), "q")
    met = met.select("p", "q", "c", F.explode("a").alias("i"), "b").select("p", "q", "c", "i", F.explode("b").alias("j"))
    return met.where("p < q OR i < j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "c")


def cosampled_consensus(runs: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(i, j, c): runs in which both share a cluster over runs in which both were sampled."""
    a = runs.select("run", F.col("label").alias("la"), F.col(id_col).alias("i"))
    b = runs.select("run", F.col("label").alias("lb"), F.col(id_col).alias("j"))
    same = (F.col("la") == F.col("lb")) & (F.col("la") != -1)
    return a.join(b, "run").where("i < j").groupBy("i", "j").agg((F.sum(same.cast("int")) / F.count(F.lit(1))).alias("c"))


def profiles(runs: DataFrame, id_col: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Rows by what labels they have in all runs: (id, pid) and (pid, n, labels), labels being the (run, label) that aren't noise."""
    known = F.when(F.col("label") != -1, F.struct("run", "label"))
    rows = runs.groupBy(id_col).agg(F.sort_array(F.collect_list(known)).alias("labels"))
    counted = cut(rows.groupBy("labels").agg(F.count(F.lit(1)).alias("n")).withColumn("pid", F.monotonically_increasing_id()))
    return rows.join(counted.select("labels", "pid"), "labels").select(id_col, "pid"), counted


def profile_pairs(counted: DataFrame, n_runs: int) -> DataFrame:
    """(p, q, np, nq, c) for each two profiles (and each with itself, p = q) that share a cluster; c is their consensus."""
    rows = counted.select("pid", "n", F.explode("labels").alias("l"))
    a = rows.select(F.col("pid").alias("p"), F.col("n").alias("np"), "l")
    b = rows.select(F.col("pid").alias("q"), F.col("n").alias("nq"), "l")
    return a.join(b, "l").where("p <= q").groupBy("p", "q").agg(F.first("np").alias("np"), F.first("nq").alias("nq"), (F.count(F.lit(1)) / F.lit(float(n_runs))).alias("c"))


def pair_histogram(runs: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(c, n): how many pairs of rows have each consensus above 0; at most one row for each number of runs."""
    counted = profiles(runs, id_col)[1]
    pairs = profile_pairs(counted, runs.select("run").distinct().count())
    n = F.when(F.col("p") == F.col("q"), F.col("np") * (F.col("np") - 1) / 2).otherwise(F.col("np") * F.col("nq"))
    return pairs.groupBy("c").agg(F.sum(n.cast("long")).alias("n")).where("n > 0")


def pac(histogram: DataFrame, n_pairs: int, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Share of all pairs whose consensus is ambiguous, from (c, n). Pairs that aren't counted have consensus 0."""
    return histogram.agg((F.coalesce(F.sum(F.when((F.col("c") > low) & (F.col("c") < high), F.col("n"))), F.lit(0)) / F.lit(n_pairs)).alias("pac"))


def consensus_cdf(histogram: DataFrame, n_pairs: int, bins: int = 10) -> DataFrame:
    """Cumulative share of pairs by consensus bin, from (c, n)."""
    binned = histogram.groupBy(F.least(F.floor(F.col("c") * bins + 1e-9), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    missing = F.lit(n_pairs) - F.sum("n").over(Window.partitionBy(F.lit(0)))
    upto = F.sum("n").over(Window.orderBy("bin"))
    return binned.select("bin", ((upto + missing) / F.lit(n_pairs)).alias("cdf"))


def item_consensus(runs: DataFrame, labels: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Mean consensus of each row with the others of its cluster: row_id, label, consensus.

    A row shares a run's cluster with as many rows of its own cluster as the
    contingency of the two labelings says, so no pair is built.
    """
    n_runs = runs.select("run").distinct().count()
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    met = labels.select(id_col, F.col("label").alias("own")).join(runs.where("label <> -1").select(id_col, "run", "label"), id_col)
    cells = met.groupBy("own", "run", "label").agg(F.count(F.lit(1)).alias("m"))
    shared = met.join(cells, ["own", "run", "label"]).groupBy(F.col(id_col).alias("i")).agg((F.sum(F.col("m") - 1) / F.lit(float(n_runs))).alias("s"))
    return (
        labels.join(shared, F.col(id_col) == F.col("i"), "left")
        .join(sizes, "label")
        .select(id_col, "label", F.when(F.col("n") > 1, F.coalesce("s", F.lit(0.0)) / F.when(F.col("n") > 1, F.col("n") - 1).otherwise(F.lit(1))).otherwise(F.lit(1.0)).alias("consensus"))
    )


def ambiguous_items(items: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows whose consensus with their own cluster is below ``threshold``."""
    return items.where(F.col("consensus") < threshold)


def cluster_cohesion(items: DataFrame) -> DataFrame:
    """Mean consensus of the pairs in each cluster: label, cohesion."""
    return items.where("label <> -1").groupBy("label").agg(F.avg("consensus").alias("cohesion"))


def uncertainty(runs: DataFrame, n_rows: int, id_col: str = "row_id", threshold: float = 0.85) -> DataFrame:
    """Entropy of each row's co-associations over log2(n): row_id, uncertainty, uncertain. Rows that share a cluster with no other have none."""
    rows, counted = profiles(runs, id_col)
    pairs = profile_pairs(counted, runs.select("run").distinct().count())
    own = pairs.where("p = q").select("p", (F.col("np") - 1).alias("m"), "c")
    other = pairs.where("p < q")
    each = own.unionByName(other.select("p", F.col("nq").alias("m"), "c")).unionByName(other.select(F.col("q").alias("p"), F.col("np").alias("m"), "c")).where("m > 0")
    s = each.groupBy("p").agg((F.sum(F.col("c") * F.col("m")) + 1.0).alias("s"), F.sum(F.col("m") * F.col("c") * F.log2("c")).alias("cl"))
    # The diagonal's 1 belongs to the row's distribution.
    h = F.log2("s") - F.col("cl") / F.col("s")
    per = s.select(F.col("p").alias("pid"), (h / F.log2(F.lit(float(n_rows)))).alias("uncertainty"))
    return rows.join(per, "pid").select(id_col, "uncertainty").withColumn("uncertain", F.col("uncertainty") > threshold)


def majority(runs: DataFrame, least: float = 0.7, other: int = -2, id_col: str = "row_id") -> DataFrame:
    """Label of at least ``least`` of a row's runs (ties: smaller label), else ``other``."""
    votes = runs.groupBy(id_col, "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(id_col).agg(F.max(F.struct("n", -F.col("label"))).alias("top"), F.sum("n").alias("all")).select(
        id_col,
        F.when(F.col("top.n") / F.col("all") >= least, -F.col("top.col2")).otherwise(F.lit(other)).cast("int").alias("label"),
        (F.col("top.n") / F.col("all")).alias("support"),
    )


def align(runs: DataFrame, reference: str, id_col: str = "row_id") -> DataFrame:
    """Labels renamed to those of ``reference`` by greedy overlap, largest first; k x k cells per run go to the driver."""
    base = runs.where(F.col("run") == reference)
    cells = runs.where(F.col("run") != reference).alias("a").join(base.alias("b"), id_col).where("a.label <> -1 AND b.label <> -1").groupBy(F.col("a.run").alias("run"), F.col("a.label").alias("la"), F.col("b.label").alias("lb")).agg(F.count(F.lit(1)).alias("n"))
    rows = sorted(agreement._collected(cells), key=lambda r: (r.run, -r.n, r.la, r.lb))
    mapped: dict[str, dict[int, int]] = {}
    taken: dict[str, set[int]] = {}
    for r in rows:
        m, t = mapped.setdefault(r.run, {}), taken.setdefault(r.run, set())
        if r.la not in m and r.lb not in t:
            m[r.la] = r.lb
            t.add(r.lb)
    spark = runs.sparkSession
    table = spark.createDataFrame([(k, int(a), int(b)) for k, m in mapped.items() for a, b in m.items()], "run string, label int, _to int")
    spare = 10_000
    return runs.join(F.broadcast(table), ["run", "label"], "left").select("run", id_col, F.when(F.col("label") == -1, F.lit(-1)).when(F.col("run") == reference, F.col("label")).otherwise(F.coalesce("_to", F.col("label") + spare)).cast("int").alias("label"))


def voting(runs: DataFrame, weights: DataFrame | None = None, id_col: str = "row_id") -> DataFrame:
    """Weighted plurality of aligned labels; noise doesn't vote; ties go to the smaller label."""
    rows = runs.where("label <> -1")
    rows = rows.withColumn("weight", F.lit(1.0)) if weights is None else rows.join(_bounded(weights), "run")
    votes = rows.groupBy(id_col, "label").agg(F.sum("weight").alias("w"))
    best = votes.groupBy(id_col).agg(F.max_by("label", F.struct(F.round("w", 9), -F.col("label"))).alias("label"))
    return runs.select(id_col).distinct().join(best, id_col, "left").select(id_col, F.coalesce("label", F.lit(-1)).cast("int").alias("label"))


def evidence_majority(runs: DataFrame, weights: DataFrame | None = None, least: float = 0.5, id_col: str = "row_id") -> DataFrame:
    """Weighted plurality of aligned labels, -1 where its share of the weight is below ``least``."""
    rows = runs.withColumn("weight", F.lit(1.0)) if weights is None else runs.join(_bounded(weights), "run")
    votes = rows.groupBy(id_col, "label").agg(F.sum("weight").alias("w"))
    top = votes.groupBy(id_col).agg(F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("label")).alias("l"))).alias("t"), F.sum("w").alias("s"))
    return top.select(id_col, F.when(F.col("t.w") / F.col("s") < least, F.lit(-1)).otherwise(-F.col("t.l")).cast("int").alias("label"), (F.col("t.w") / F.col("s")).alias("confidence"))


def _dense(runs: DataFrame, weights: DataFrame | None, id_col: str) -> tuple[DataFrame, list, np.ndarray, np.ndarray]:
    """(id, pid) of the rows, the nodes' pids, their rows, and the nodes' consensus matrix with diagonal 1.

    Each row is a node where there are at most DENSE; beyond that rows with the
    same labels in all runs are one, and more than DENSE of these are an error.
    """
    ids = runs.select(id_col).distinct()
    if ids.limit(DENSE + 1).count() <= DENSE:
        place = ids.select(id_col, F.col(id_col).alias("pid"))
        nodes = sorted((r[0], 1.0) for r in ids.collect())
        pairs = coassociation(runs, weights, id_col).toPandas()
    else:
        place, counted = profiles(runs, id_col)
        nodes = sorted((r.pid, float(r.n)) for r in counted.select("pid", "n").limit(DENSE + 1).collect())
        if len(nodes) > DENSE:
            raise ValueError(f"more than {DENSE} different rows of labels; take fewer runs")
        long = counted.select("pid", F.explode("labels").alias("l")).select("pid", "l.run", "l.label")
        pairs = coassociation(long, weights, "pid").toPandas()
    at = {v: i for i, (v, _n) in enumerate(nodes)}
    c = np.eye(len(nodes))
    i, j = pairs.i.map(at).to_numpy(int), pairs.j.map(at).to_numpy(int)
    c[i, j] = c[j, i] = pairs.c
    return place, [v for v, _n in nodes], np.array([n for _v, n in nodes]), c


def _labels(place: DataFrame, nodes: list, label: np.ndarray, id_col: str) -> DataFrame:
    table = place.sparkSession.createDataFrame([(int(v), int(k)) for v, k in zip(nodes, label, strict=True)], "pid long, label int")
    return place.join(F.broadcast(table), "pid").select(id_col, "label")  # at most DENSE nodes


def evidence_accumulation(runs: DataFrame, k: int, method: str = "average", weights: DataFrame | None = None, id_col: str = "row_id") -> DataFrame:
    """Linkage of 1 - co-association, cut at k clusters."""
    place, nodes, size, c = _dense(runs, weights, id_col)
    return _labels(place, nodes, clustering.cut_tree(clustering.linkage(1 - c, method, size), len(nodes), k), id_col)


def spectral_consensus(runs: DataFrame, k: int, weights: DataFrame | None = None, id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """Spectral clustering with the co-association as affinity (CSPA)."""
    place, nodes, _size, c = _dense(runs, weights, id_col)
    return _labels(place, nodes, clustering.lloyd_local(clustering._embed_affinity(c, k), k, seed, 5)[1], id_col)


def cophenetic_correlation(runs: DataFrame, id_col: str = "row_id", weights: DataFrame | None = None) -> float:
    """Correlation of 1 - co-association with the heights at which average linkage joins the pairs."""
    _place, nodes, size, c = _dense(runs, weights, id_col)
    return cophenetic(1 - c, size)


def cophenetic(d: np.ndarray, size: np.ndarray | None = None) -> float:
    n = len(d)
    inside, height = {i: [i] for i in range(n)}, np.zeros((n, n))
    for step, (a, b, h, _s) in enumerate(clustering.linkage(d, "average", size)):
        one, two = inside.pop(a), inside.pop(b)
        height[np.ix_(one, two)] = h
        height[np.ix_(two, one)] = h
        inside[n + step] = one + two
    up = np.triu_indices(n, 1)
    x, y = d[up], height[up]
    w = np.ones(len(x))
    if size is not None:  # the rows of a node are at distance 0 and joined there
        x, y = np.append(x, 0.0), np.append(y, 0.0)
        w = np.append((size[:, None] * size[None, :])[up], (size * (size - 1) / 2).sum())
    if not w.sum():
        return 0.0
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    top, low = (w * (x - mx) * (y - my)).sum(), math.sqrt((w * (x - mx) ** 2).sum() * (w * (y - my) ** 2).sum())
    return float(top / low) if low > 0 else 0.0


def meta_clustering(runs: DataFrame, k: int, id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """k-means over one-hot labels of all runs: those of the profiles, weighted by their rows, as rows with the same labels are one point."""
    place, counted = profiles(runs, id_col)
    got = counted.select("pid", "n", F.transform("labels", lambda l: F.concat_ws("_", l["run"].cast("string"), l["label"].cast("string"))).alias("l")).limit(META + 1).toPandas().sort_values("pid")
    if len(got) > META:
        raise ValueError(f"more than {META} different rows of labels; take fewer runs")
    names = {v: i for i, v in enumerate(sorted({v for row in got.l for v in row}))}
    hot = np.zeros((len(got), max(len(names), 1)))
    for i, row in enumerate(got.l):
        hot[i, [names[v] for v in row]] = 1.0
    label = clustering.lloyd_weighted(hot, got.n.to_numpy(float), k, seed)
    table = runs.sparkSession.createDataFrame([(int(p), int(v)) for p, v in zip(got.pid, label, strict=True)], "pid long, label int")
    return place.join(F.broadcast(table), "pid").select(id_col, "label")  # at most META profiles


def hybrid_consensus(runs: DataFrame, k: int, id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """The better of average-link evidence and k-means in the co-association's leading components, by silhouette on 1 - C."""
    place, nodes, size, c = _dense(runs, None, id_col)
    one = clustering.cut_tree(clustering.linkage(1 - c, "average", size), len(nodes), k)
    values, vectors = np.linalg.eigh((m := c - c.mean(axis=0)) @ m.T)
    two = clustering.lloyd_local(vectors[:, -min(10, len(nodes)) :] * np.sqrt(np.maximum(values[-min(10, len(nodes)) :], 0)), k, seed, 5)[1]
    return _labels(place, nodes, max((one, two), key=lambda label: precomputed_silhouette(1 - c, label)), id_col)


def precomputed_silhouette(d: np.ndarray, label: np.ndarray) -> float:
    names, code = np.unique(label, return_inverse=True)
    if len(names) < 2:
        return -1.0
    size, at = np.bincount(code), np.arange(len(d))
    sums = np.stack([d[:, code == j].sum(axis=1) for j in range(len(names))], axis=1)
    a = sums[at, code] / np.maximum(size[code] - 1, 1)
    means = sums / size
    means[at, code] = np.inf
    b = means.min(axis=1)
    return float(np.where(size[code] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())


def best_cut(d: np.ndarray, ks: range) -> int:
    """k whose average-link cut has the best silhouette."""
    merges = clustering.linkage(d, "average")
    return max(ks, key=lambda k: (precomputed_silhouette(d, clustering.cut_tree(merges, len(d), k)), -k))


def diversity(runs: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Mean of 1 - max(ARI, 0) over pairs of runs, and the variance of their cluster counts, as one score."""
    ari = agreement.scores(agreement.all_contingencies(runs, "run", id_col), ["ra", "rb"])
    ks = runs.where("label <> -1").groupBy("run").agg(F.count_distinct("label").alias("k")).agg(F.var_pop("k").alias("v"))
    mean = ari.agg(F.avg(1 - F.greatest("ari", F.lit(0.0))).alias("d"))
    return mean.withColumn("j", F.lit(1)).join(ks.withColumn("j", F.lit(1)), "j").select((F.col("d") * 0.6 + F.least(F.col("v") / 20, F.lit(0.4))).alias("diversity"))


def softmax_weights(scores: DataFrame, score: str = "composite", temperature: float = 1.0, floor: float = 0.001) -> DataFrame:
    """run, weight: softmax of the scores, at least ``floor``, scaled to sum 1. One row for each run."""
    every = Window.partitionBy(F.lit(0))
    e = F.exp((F.col(score) - F.max(score).over(every)) / temperature)
    w = scores.withColumn("_e", e).withColumn("_w", F.greatest(F.col("_e") / F.sum("_e").over(every), F.lit(floor)))
    return w.select("run", (F.col("_w") / F.sum("_w").over(every)).alias("weight"))


def uniform_weights(runs: DataFrame) -> DataFrame:
    """run, weight: the same for all runs, summing to 1."""
    names = runs.select("run").distinct()
    return names.select("run", (1.0 / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).alias("weight"))


def diversity_boosted(runs: DataFrame, weights: DataFrame, bonus: float = 0.2, floor: float = 0.001, id_col: str = "row_id") -> DataFrame:
    """run, weight: each weight plus ``bonus`` times the run's mean of 1 - max(ARI, 0) to the others, scaled to sum 1. Fewer than three runs keep theirs."""
    if runs.select("run").distinct().limit(3).count() < 3:
        return weights
    ari = agreement.scores(agreement.all_contingencies(runs, "run", id_col), ["ra", "rb"]).select("ra", "rb", (1 - F.greatest("ari", F.lit(0.0))).alias("d"))
    away = ari.select(F.col("ra").alias("run"), "d").unionByName(ari.select(F.col("rb").alias("run"), "d")).groupBy("run").agg(F.avg("d").alias("d"))
    raised = weights.join(away, "run", "left").select("run", F.greatest(F.col("weight") + bonus * F.coalesce("d", F.lit(0.0)), F.lit(floor)).alias("_w"))
    return raised.select("run", (F.col("_w") / F.sum("_w").over(Window.partitionBy(F.lit(0)))).alias("weight"))


def estimate_k(runs: DataFrame, ks: range = range(2, 15), id_col: str = "row_id") -> DataFrame:
    """k, silhouette (on 1 - co-association) and whether it is the best, of average-link cuts."""
    _place, nodes, size, c = _dense(runs, None, id_col)
    merges = clustering.linkage(1 - c, "average", size)
    got = [(k, precomputed_silhouette(1 - c, clustering.cut_tree(merges, len(nodes), k))) for k in ks if k < len(nodes)]
    best = max(got, key=lambda r: (r[1], -r[0]), default=(None, None))[0]
    return runs.sparkSession.createDataFrame([(k, v, k == best) for k, v in got], "k int, silhouette double, best boolean")


def multi_resolution(df: DataFrame, runs: DataFrame, features: list[str], ks: tuple[int, ...] = (2, 3, 4, 5, 6, 8, 10, 12), id_col: str = "row_id") -> DataFrame:
    """k, silhouette (in the feature space) and whether it is the best, of the consensus at several k."""
    got = []
    for k in ks:
        labelled = df.drop("label").join(evidence_accumulation(runs, k, "average", None, id_col), id_col)
        got.append((k, float(metrics.silhouette(labelled, id_col, "label", features).first()[0] or 0.0)))
    best = max(got, key=lambda r: (r[1], -r[0]))[0]
    return df.sparkSession.createDataFrame([(k, v, k == best) for k, v in got], "k int, silhouette double, best boolean")


def multi_resolution_pac(runs_of_k: dict[int, DataFrame], id_col: str = "row_id") -> DataFrame:
    """k, pac, cophenetic and whether the PAC is the least, of several runs at each k."""
    got = []
    for k, runs in sorted(runs_of_k.items()):
        n = runs.select(id_col).distinct().count()
        got.append((k, float(pac(pair_histogram(runs, id_col), max(n * (n - 1) // 2, 1)).first()[0]), cophenetic_correlation(runs, id_col)))
    best = min(got, key=lambda r: (r[1], r[0]))[0]
    spark = next(iter(runs_of_k.values())).sparkSession
    return spark.createDataFrame([(k, p, c, k == best) for k, p, c in got], "k int, pac double, cophenetic double, best boolean")


def quality(silhouette: DataFrame, agreement_of_runs: DataFrame, diversity_score: DataFrame) -> DataFrame:
    """Parts of a consensus' quality: structure (silhouette on 0 to 1), mean agreement with the runs (ARI, at least 0), diversity, its bonus, and .4, .35, .25 of the first three as a score of 100."""
    one = silhouette.select(((F.coalesce("silhouette", F.lit(0.0)) + 1) / 2).alias("structure"), F.lit(1).alias("_j"))
    two = agreement_of_runs.agg(F.coalesce(F.avg(F.greatest("ari", F.lit(0.0))), F.lit(0.0)).alias("agreement")).withColumn("_j", F.lit(1))
    row = one.join(two, "_j").join(diversity_score.select("diversity", F.lit(1).alias("_j")), "_j").drop("_j")  # one row each
    score = (0.4 * F.col("structure") + 0.35 * F.col("agreement") + 0.25 * F.col("diversity")) * 100
    return row.withColumns({"diversity_bonus": F.col("diversity") * (1 - F.col("agreement")), "quality": F.least(score, F.lit(100.0))})


def cluster_confidence(consensus: DataFrame, runs: DataFrame, weights: DataFrame | None = None, id_col: str = "row_id") -> DataFrame:
    """label, confidence: mean over runs of the best Jaccard of each consensus cluster; grade at .7 and .4."""
    a = consensus.where("label <> -1").select(id_col, F.col("label").alias("la"))
    b = runs.where("label <> -1").select(id_col, "run", F.col("label").alias("lb"))
    best = agreement.best_jaccard(a.join(b, id_col).groupBy("run", "la", "lb").agg(F.count(F.lit(1)).alias("n")), ["run"])
    best = best.withColumn("w", F.lit(1.0)) if weights is None else best.join(_bounded(weights).withColumnRenamed("weight", "w"), "run")
    conf = best.groupBy(F.col("la").alias("label")).agg((F.sum(F.col("jaccard") * F.col("w")) / F.sum("w")).alias("confidence"))
    return conf.withColumn("grade", F.when(F.col("confidence") >= 0.7, "high").when(F.col("confidence") >= 0.4, "medium").otherwise("low"))


def bootstrap_consensus(runs: DataFrame, k: int, rounds: int = 10, share: float = 0.7, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Evidence from random subsets of the runs, accumulated once more."""
    names, rng, out = sorted(r.run for r in runs.select("run").distinct().collect()), np.random.default_rng(seed), None
    for i in range(rounds):
        use = [str(v) for v in rng.choice(names, max(1, int(len(names) * share)), replace=False)]
        one = evidence_accumulation(runs.where(F.col("run").isin(use)), k, "average", None, id_col).withColumn("run", F.lit(f"b{i}"))
        out = one if out is None else out.unionByName(one)
    return evidence_accumulation(out.select("run", id_col, "label"), k, "average", None, id_col)


def consensus_profile(df: DataFrame, id_col: str, label: str, features: list[str], top: int = 5) -> DataFrame:
    """For each cluster its ``top`` features by absolute z-score of the centroid: label, column_name, z, rank, name."""
    from .profile import long_form

    rows = long_form(df.where(F.col(label) != -1), features, [label])
    total = rows.groupBy("column_name").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = rows.groupBy(label, "column_name").agg(F.avg("value").alias("c")).join(F.broadcast(total), "column_name").withColumn("z", (F.col("c") - F.col("m")) / F.greatest("s", F.lit(1e-10)))
    order = Window.partitionBy(label).orderBy(F.desc(F.round(F.abs("z"), 9)), "column_name")
    return z.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(label, "column_name", "z", "rank", F.concat(F.when(F.col("z") >= 0, "High-").otherwise("Low-"), F.col("column_name")).alias("name"))


def to_points(pdf: pd.DataFrame, features: list[str]) -> np.ndarray:
    return pdf[features].to_numpy(float)


METHODS = {
    "eac_average": lambda runs, k, w: evidence_accumulation(runs, k, "average", w),
    "eac_single": lambda runs, k, w: evidence_accumulation(runs, k, "single", w),
    "eac_complete": lambda runs, k, w: evidence_accumulation(runs, k, "complete", w),
    "cspa": lambda runs, k, w: spectral_consensus(runs, k, None),
    "spectral": spectral_consensus,
    "voting": lambda runs, k, w: voting(align(runs, _first(runs))),
    "weighted_voting": lambda runs, k, w: voting(align(runs, _first(runs)), w),
    "meta": lambda runs, k, w: meta_clustering(runs, k),
    "bayesian": lambda runs, k, w: evidence_accumulation(runs, k, "average", w),
    "hybrid": lambda runs, k, w: hybrid_consensus(runs, k),
}


def _first(runs: DataFrame) -> str:
    return runs.agg(F.min("run")).first()[0]


def nearest_rows(df: DataFrame, id_col: str, features: list[str], k: int) -> DataFrame:
    return distances.knn(df, id_col, features, k)
