"""Queries over evaluation, stability, consensus and the statistics behind them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, clustering, consensus, metrics, preprocess, profile, ranking, sampling, stability
from ..sources import patterns
from .frames import CENTRES, CLEAN, DIST, FEATURES, POINTS, RUNS, every, noisy, points, read, rounded, runs
from .queries import _AGREE, _CO, _GAPS, _SIL, _gaps, _r, _u, query

# Metrics


@query(f"WITH {_SIL}, z AS (SELECT la, sum(s) AS s, sum(n) AS n FROM m WHERE la = lb GROUP BY la) SELECT {_r('avg(s / n)')} AS avg_intra_dist FROM z WHERE n > 1")
def metric_avg_intra(spark, d):
    return rounded(metrics.avg_intra_distance(noisy(spark, d), "row_id", "label", FEATURES))


@query(f"WITH {CENTRES}, w AS (SELECT label, sum(({DIST}) ** 2) AS s, count(*) AS n FROM q a JOIN c b USING (label) GROUP BY label) SELECT {_r('ln(sum(s / (2 * n)))')} AS log_wk FROM w WHERE n > 1")
def metric_dispersion(spark, d):
    return rounded(metrics.dispersion(noisy(spark, d), "label", FEATURES))


_LOGS = "logs AS (SELECT p_size AS k, CAST(p_partkey % 5 AS INTEGER) AS reference, ln(avg(p_retailprice) / p_size) AS lw FROM part GROUP BY p_size, p_partkey % 5)"


def _logs(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_size").alias("k"), (F.col("p_partkey") % 5).cast("int").alias("reference")).agg(F.log(F.avg("p_retailprice") / F.first("p_size")).alias("log_wk"))


_GAP = _LOGS + ", curve AS (SELECT k, avg(lw) FILTER (reference > 0) - max(lw) FILTER (reference = 0) AS gap, (stddev_pop(lw) FILTER (reference > 0)) * sqrt(1 + 1 / (count(lw) FILTER (reference > 0))) AS sk, max(lw) FILTER (reference = 0) AS log_wk, avg(lw) FILTER (reference > 0) AS log_wk_ref FROM logs GROUP BY k)"


@query(f"WITH {_GAP} SELECT k, {_r('gap')} AS gap, {_r('sk')} AS sk, {_r('log_wk')} AS log_wk, {_r('log_wk_ref')} AS log_wk_ref FROM curve")
def gap_curve(spark, d):
    return rounded(metrics.gap_curve(_logs(spark, d)))


@query(f"WITH {_GAP}, n AS (SELECT k, gap, lead(gap) OVER (ORDER BY k) - lead(sk) OVER (ORDER BY k) AS least FROM curve) SELECT coalesce(min(k) FILTER (gap >= least), arg_max(k, gap)) AS best_k FROM n")
def gap_best_k(spark, d):
    return metrics.gap_best_k(metrics.gap_curve(_logs(spark, d)))


@query()
def gap_statistic(spark, d):
    return metrics.gap_statistic(points(spark, d), "row_id", FEATURES, range(1, 4), 2)


_POISSON = []
_total, _p = 0.0, 0.36787944117144233
for _k in range(8):
    _total += _p
    _POISSON.append(repr(_total))
    _p /= _k + 1


@query(
    f"""WITH {_SIL}, s AS (SELECT row_id, (b - a) / greatest(a, b) AS s FROM ab), u AS (SELECT row_id, s, r, CAST('0x' || substr(md5(row_id || '-42-' || r), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM s, range(20) t(r)),
    w AS (SELECT r, s, {' + '.join(f'(u >= {t})::INT' for t in _POISSON)} AS w FROM u), draws AS (SELECT sum(s * w) / sum(w) AS m FROM w GROUP BY r)
    SELECT {_r('avg(m)')} AS mean, {_r('quantile_cont(m, 0.025)')} AS low, {_r('quantile_cont(m, 0.975)')} AS high, {_r('stddev_pop(m)')} AS std FROM draws"""
)
def silhouette_interval(spark, d):
    samples = metrics.silhouette_samples(noisy(spark, d), "row_id", "label", FEATURES)
    return rounded(metrics.silhouette_interval(samples, draws=20))


_DRAWN = f"s AS (SELECT * FROM p ORDER BY {_u('row_id', '42')}, row_id LIMIT 100)"
_UNIFORM = ", ".join(f"(SELECT min({f}) FROM p) + (SELECT max({f}) - min({f}) FROM p) * {_u('row_id', f'hopkins42-{i}')}" for i, f in enumerate(FEATURES))


@query(
    f"""WITH {POINTS}, {_DRAWN}, v AS (SELECT row_id, [{_UNIFORM}] AS e FROM s), nu AS (SELECT a.row_id, min({DIST}) AS u FROM v a CROSS JOIN p b GROUP BY 1),
    nw AS (SELECT a.row_id, min({DIST}) AS w FROM s a JOIN p b ON a.row_id <> b.row_id GROUP BY 1) SELECT {_r('sum(u ** 64) / (sum(u ** 64) + sum(w ** 64))', 5)} AS hopkins FROM nu JOIN nw USING (row_id)"""
)
def metric_hopkins(spark, d):
    h = metrics.hopkins(points(spark, d), "row_id", FEATURES, m=100)
    return rounded(spark.createDataFrame([(h,)], "hopkins double"), 5)


@query(
    f"""WITH {CLEAN}, r AS (SELECT * FROM q WHERE label <> -1), v AS (SELECT var_samp(f1) + 1e-6 AS a, var_samp(f2) + 1e-6 AS b, covar_samp(f1, f2) AS c FROM r), m AS (SELECT label, avg(f1) AS x, avg(f2) AS y FROM r GROUP BY label)
    SELECT s.label AS a, t.label AS b, {_r('sqrt(((s.x - t.x) ** 2 * v.b - 2 * (s.x - t.x) * (s.y - t.y) * v.c + (s.y - t.y) ** 2 * v.a) / (v.a * v.b - v.c * v.c))')} AS distance FROM m s JOIN m t ON s.label < t.label, v"""
)
def metric_separability(spark, d):
    return rounded(metrics.separability(metrics.clean(noisy(spark, d), "label"), "label", ["f1", "f2"]))


_NORM = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


@query(
    f"""WITH {CENTRES}, r AS (SELECT * FROM q WHERE label <> -1), t AS (SELECT [{every('var_pop({f})')}] AS v FROM r), g AS (SELECT label, [{every('var_pop({f})')}] AS v FROM r GROUP BY label),
    z AS (SELECT avg({_NORM.format(v='g.v')}) / any_value({_NORM.format(v='t.v')}) AS scat, sqrt(sum({_NORM.format(v='g.v')})) / count(*) AS sigma FROM g, t),
    mid AS (SELECT a.label AS i, b.label AS j, list_transform(list_zip(a.e, b.e), lambda x: (x[1] + x[2]) / 2) AS e FROM c a JOIN c b ON a.label <= b.label),
    n AS (SELECT b.i, b.j, count(*) FILTER ({DIST} <= sigma) AS n FROM r a JOIN mid b ON a.label IN (b.i, b.j), z GROUP BY b.i, b.j),
    d AS (SELECT coalesce(x.n / nullif(greatest(y.n, w.n), 0), 0) AS d FROM n x JOIN n y ON y.i = x.i AND y.j = x.i JOIN n w ON w.i = x.j AND w.j = x.j WHERE x.i < x.j) SELECT {_r('any_value(scat) + avg(d)')} AS s_dbw FROM d, z"""
)
def metric_s_dbw(spark, d):
    return rounded(spark.createDataFrame([(metrics.s_dbw(noisy(spark, d), "label", FEATURES),)], "s_dbw double"))


@query(
    f"""WITH {CLEAN}, d AS (SELECT a.row_id, a.label, a.label = b.label AS same, {DIST} AS d FROM q a JOIN q b ON a.row_id <> b.row_id AND a.label <> -1 AND b.label <> -1),
    k AS (SELECT row_id, label, d, row_number() OVER (PARTITION BY row_id ORDER BY d) AS r FROM d WHERE same), core AS (SELECT label, max(d) AS dens FROM k WHERE r <= 5 GROUP BY label), g AS (SELECT label, min(d) AS sep FROM d WHERE NOT same GROUP BY label),
    n AS (SELECT label, count(*) AS n FROM q WHERE label <> -1 GROUP BY label) SELECT {_r('sum(n * (sep - dens) / greatest(sep, dens)) / sum(n)')} AS dbcv FROM core JOIN g USING (label) JOIN n USING (label)"""
)
def metric_dbcv(spark, d):
    return rounded(metrics.dbcv(noisy(spark, d), "row_id", "label", FEATURES))


@query()
def clusterability(spark, d):
    return metrics.clusterability(points(spark, d), "row_id", FEATURES)


#: A metric, how it is made from the events of a type, its value on 0 to 1 and its weight, as the survey has them.
_SCORES = (
    ("silhouette", "avg(value) / 100", "(value + 1) / 2", 3.0),
    ("davies_bouldin", "stddev_pop(value) / 10", "greatest(0, 1 - value / 5)", 2.0),
    ("calinski_harabasz", "sum(value) / 100", "least(1, ln(1 + value) / ln(10001))", 2.0),
    ("dunn", "avg(value) / 50", "least(1, value)", 2.0),
    ("xie_beni", "avg(value) / 8", "greatest(0, 1 - value / 10)", 1.5),
    ("noise_ratio", "count_if(value > 10) / count(*)", "1 - value", 1.5),
    ("cluster_balance", "1 / (1 + stddev_pop(value))", "value", 1.0),
    ("size_entropy", "stddev_pop(value) / 20", "least(1, value / 3)", 1.0),
    ("avg_intra_dist", "avg(value) / 40", "greatest(0, 1 - least(1, value / 5))", 1.0),
    ("avg_inter_dist", "avg(value) / 12", "least(1, value / 5)", 1.0),
    ("inertia_ratio", "1 / (1 + avg(value))", "greatest(0, 1 - value)", 1.0),
)
_ALL_METRICS = "m AS (" + " UNION ALL ".join(f"SELECT event_type AS algorithm_id, '{n}' AS metric, {v} AS value FROM events GROUP BY 1" for n, v, _, _ in _SCORES) + ")"
_NORMED = "s AS (SELECT algorithm_id, CASE metric " + " ".join(f"WHEN '{n}' THEN {w}" for n, _, _, w in _SCORES) + " END AS w, CASE metric " + " ".join(f"WHEN '{n}' THEN {v}" for n, _, v, _ in _SCORES) + " END AS v FROM m)"


def _wide_metrics(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").alias("algorithm_id")).agg(*[F.expr(v).alias(n) for n, v, _, _ in _SCORES])


@query(
    f"""WITH {_ALL_METRICS}, {_NORMED}, c AS (SELECT algorithm_id, sum(w * v) / sum(w) * 100 AS composite FROM s GROUP BY 1)
    SELECT algorithm_id, {_r('composite', 4)} AS composite, CASE WHEN composite >= 85 THEN 'Excellent' WHEN composite >= 70 THEN 'Good' WHEN composite >= 50 THEN 'Fair' WHEN composite >= 30 THEN 'Poor' ELSE 'Very Poor' END AS grade FROM c"""
)
def composite_score(spark, d):
    long = _wide_metrics(spark, d).unpivot("algorithm_id", [n for n, _, _, _ in _SCORES], "metric", "value")
    return rounded(metrics.composite(long).withColumn("grade", metrics.grade(F.col("composite") / 100)), 4)


@query(
    f"""WITH {_ALL_METRICS}, {_NORMED}, c AS (SELECT algorithm_id, sum(w * v) / sum(w) * 100 AS c FROM s GROUP BY 1), x AS (SELECT algorithm_id, max(value) FILTER (metric = 'silhouette') AS s, max(value) FILTER (metric = 'davies_bouldin') AS d, max(value) FILTER (metric = 'noise_ratio') AS n, max(value) FILTER (metric = 'cluster_balance') AS b FROM m GROUP BY 1)
    SELECT algorithm_id, concat_ws(' ', printf('%s found %d clusters, composite %.1f of 100 (%s).', algorithm_id, 7, c, CASE WHEN c >= 80 THEN 'excellent' WHEN c >= 65 THEN 'good' WHEN c >= 45 THEN 'moderate' ELSE 'poor' END),
      printf('Silhouette %.3f: %s.', s, CASE WHEN s > 0.7 THEN 'dense, well separated clusters' WHEN s > 0.5 THEN 'fairly compact clusters' WHEN s > 0.25 THEN 'some structure with overlap' ELSE 'weak structure' END),
      printf('Davies-Bouldin %.3f: %s.', d, CASE WHEN d < 0.5 THEN 'excellent separation' WHEN d < 1 THEN 'acceptable separation' ELSE 'possible overlap' END),
      CASE WHEN n > 0.15 THEN printf('High noise: %.1f %%.', n * 100) WHEN n > 0 THEN printf('Noise: %.1f %%.', n * 100) END, CASE WHEN b < 0.1 THEN 'One cluster dominates.' END) AS text FROM c JOIN x USING (algorithm_id)"""
)
def interpretation(spark, d):
    wide = _wide_metrics(spark, d)
    long = wide.unpivot("algorithm_id", [n for n, _, _, _ in _SCORES], "metric", "value")
    return wide.join(metrics.composite(long), "algorithm_id").withColumn("k", F.lit(7)).select("algorithm_id", metrics.interpretation().alias("text"))


# Stability

_KINDS = "['bootstrap', 'gaussian', 'laplace', 'subset', 'feature_dropout']"
_TESTS = f"t AS (SELECT 'a' || (user_id % 4) AS algorithm, {_KINDS}[1 + event_id % 5] AS kind, CAST(event_id % 7 AS DOUBLE) / 10 AS level, value / 20 AS ari, value / 25 AS ami, value / 30 AS jaccard FROM events)"


def _tests(spark, d):
    kinds = F.expr(_KINDS.replace("[", "array(").replace("]", ")"))
    v = F.col("value")
    return read(spark, d, "events").select(
        F.concat(F.lit("a"), (F.col("user_id") % 4).cast("string")).alias("algorithm"), F.element_at(kinds, (1 + F.col("event_id") % 5).cast("int")).alias("kind"), ((F.col("event_id") % 7).cast("double") / 10).alias("level"),
        (v / 20).alias("ari"), (v / 25).alias("ami"), (v / 30).alias("jaccard"),
    )


@query(
    f"""WITH {_TESTS}, s AS (SELECT algorithm, avg(ari) AS a, stddev_pop(ari) AS d, avg(ami) AS m, avg(jaccard) AS p, count(*) AS n FROM t GROUP BY 1), g AS (SELECT *, 40 * greatest(a, 0) + 15 * greatest(1 - 3 * d, 0) + 25 * greatest(m, 0) + 20 * p AS score FROM s)
    SELECT algorithm, {_r('a')} AS mean_ari, {_r('d')} AS std_ari, {_r('m')} AS mean_ami, {_r('p')} AS persistence, n, {_r('score')} AS score, CASE WHEN score >= 80 THEN 'Highly Stable' WHEN score >= 65 THEN 'Stable' WHEN score >= 45 THEN 'Moderately Stable' WHEN score >= 25 THEN 'Unstable' ELSE 'Highly Unstable' END AS grade,
    CAST(row_number() OVER (ORDER BY score DESC, algorithm) AS INTEGER) AS rank FROM g"""
)
def stability_scorecard(spark, d):
    return rounded(stability.scorecard(_tests(spark, d)))


@query(f"WITH {_TESTS} SELECT algorithm, {_r('''avg(ari) FILTER (kind = 'bootstrap')''')} AS bootstrap_ari, {_r('''avg(ari) FILTER (kind = 'gaussian')''')} AS gaussian_ari, {_r('avg(ari)')} AS mean_ari, {_r('stddev_pop(ari)')} AS std_ari FROM t GROUP BY 1")
def stability_degradation(spark, d):
    return rounded(stability.degradation(_tests(spark, d)))


@query(f"WITH {_TESTS} SELECT algorithm, kind || ' ARI' AS axis, {_r('avg(ari)')} AS value FROM t GROUP BY ALL UNION ALL SELECT algorithm, 'persistence', {_r('avg(jaccard)')} FROM t GROUP BY 1")
def stability_radar(spark, d):
    return rounded(stability.radar(_tests(spark, d)))


@query(f"WITH {_TESTS} SELECT algorithm, {_r('min(ari)')} AS low, {_r('quantile_cont(ari, 0.25)')} AS q25, {_r('quantile_cont(ari, 0.5)')} AS median, {_r('quantile_cont(ari, 0.75)')} AS q75, {_r('max(ari)')} AS high FROM t GROUP BY 1")
def stability_box(spark, d):
    return rounded(stability.box(_tests(spark, d)))


@query(f"WITH {_TESTS} SELECT algorithm, level, {_r('avg(ari)')} AS mean_ari FROM t WHERE kind IN ('gaussian', 'laplace') GROUP BY ALL")
def stability_noise_curves(spark, d):
    return rounded(stability.noise_curves(_tests(spark, d)))


@query(f"WITH {_TESTS}, m AS (SELECT kind AS param, level, avg(ari) AS ari FROM t GROUP BY ALL) SELECT param, count(*) AS n, {_r('avg(ari)')} AS mean_ari, {_r('stddev_pop(ari)')} AS std_ari, stddev_pop(ari) > 0.1 AS is_sensitive FROM m GROUP BY 1")
def parameter_sensitivity(spark, d):
    return rounded(stability.sensitivity(_tests(spark, d).groupBy(F.col("kind").alias("param"), "level").agg(F.avg("ari").alias("ari"))))


@query(
    f"""WITH {_TESTS}, m AS (SELECT level, avg(ari) AS a FROM t GROUP BY 1), e AS (SELECT arg_min(a, level) AS i, arg_max(a, level) AS f, max(level) - min(level) AS w FROM m)
    SELECT {_r('i')} AS initial_ari, {_r('f')} AS final_ari, {_r('(i - f) / w')} AS degradation_rate, (i - f) / w < 1 AND f > 0.3 AS is_resilient FROM e"""
)
def stability_degradation_rate(spark, d):
    return rounded(stability.degradation_rate(_tests(spark, d)))


@query(
    f"""WITH {RUNS}, z AS (SELECT run, label, count(*) AS n FROM runs WHERE label <> -1 GROUP BY ALL), h AS (SELECT run, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h, count(*) AS k FROM z GROUP BY run)
    SELECT {_r('avg(h)')} AS mean_entropy, {_r('stddev_pop(h)')} AS std_entropy, {_r('avg(k)')} AS mean_k, {_r('stddev_pop(k)')} AS std_k, {_r('stddev_pop(h) / (avg(h) + 1e-10)')} AS entropy_cv, {_r('stddev_pop(k) / (avg(k) + 1e-10)')} AS k_cv, stddev_pop(k) < 1.5 AS stable_k FROM h"""
)
def label_entropy(spark, d):
    return rounded(stability.label_entropy(runs(spark, d)))


_ARI = _AGREE + ", y AS (SELECT ra, rb, (pp - ex) / ((pa + pb) / 2 - ex) AS ari FROM j)"


@query(f"WITH {_ARI} SELECT {_r('avg(ari)')} AS mean_ari, {_r('min(ari)')} AS min_ari, {_r('stddev_pop(ari)')} AS std_ari, stddev_pop(ari) > 0.2 AS is_multimodal FROM y")
def run_consistency(spark, d):
    return rounded(stability.consistency(runs(spark, d)))


@query(f"WITH {_ARI}, ks AS (SELECT run, count(DISTINCT label) AS k FROM runs WHERE label <> -1 GROUP BY run) SELECT {_r('ari')} AS ari, {_r('2 * mi / (ha + hb)')} AS nmi, a.k AS k_a, b.k AS k_b, a.k = b.k AS k_agreement, ari >= 0.5 AS is_stable FROM y JOIN j USING (ra, rb) JOIN ks a ON a.run = ra JOIN ks b ON b.run = rb WHERE ra = 'r0' AND rb = 'r1'")
def cross_dataset(spark, d):
    r = runs(spark, d)
    return rounded(stability.cross_dataset(r.where("run = 'r0'"), r.where("run = 'r1'")))


@query()
def stability_run(spark, d):
    """A whole test of a fit under each kind of perturbation."""
    p = points(spark, d)
    schedule = (("bootstrap", 1.0, 1), ("gaussian", 0.05, 1), ("laplace", 0.05, 1), ("feature_dropout", 0.1, 1), ("subset", 0.8, 1))
    return stability.compare(p, "row_id", FEATURES, {"kmeans": lambda t: clustering.kmeans(t, "row_id", FEATURES, 4, n_init=2)}, schedule)


for _kind, _level in (("bootstrap", "0.632"), ("subset", "0.9")):

    def _drawn(spark, d, kind=_kind):
        return stability.perturb(points(spark, d), "row_id", FEATURES, kind, 0.9, 5).select("row_id")

    _drawn.__name__ = f"perturb_{_kind}" + ("_wide" if _kind == "subset" else "")
    query(f"WITH {POINTS} SELECT row_id FROM p WHERE {_u('row_id', _kind + '5')} < {_level}")(_drawn)


def _laplace(f: str) -> str:
    u = f"({_u('row_id', f'laplace2{f}')} - 0.5)"
    return _r(f"{f} + 0.05 * d{f} * (-1 * sign({u}) * ln(greatest(1 - 2 * abs({u}), 1e-12)))") + f" AS {f}"


@query(f"WITH {POINTS}, s AS (SELECT {every('stddev_pop({f}) AS d{f}')} FROM p) SELECT row_id, {', '.join(map(_laplace, FEATURES))} FROM p, s")
def perturb_laplace(spark, d):
    return rounded(stability.perturb(points(spark, d).drop("label"), "row_id", FEATURES, "laplace", 0.05, 2))


#: Run 3 drops 12 of 64 columns from the 22nd on.
_GONE = {FEATURES[(21 + i) % 64] for i in range(12)}


@query(f"WITH {POINTS} SELECT row_id, {', '.join(_r('0.0' if f in _GONE else f) + f' AS {f}' for f in FEATURES)} FROM p")
def perturb_dropout(spark, d):
    return rounded(stability.perturb(points(spark, d).drop("label"), "row_id", FEATURES, "feature_dropout", 0.2, 3))


# Consensus


@query(f"WITH {_CO} SELECT {_r('c')} AS c, count(*) AS n FROM co GROUP BY 1")
def consensus_histogram(spark, d):
    return rounded(consensus.pair_histogram(runs(spark, d)))


_ITEMS = _CO + ", bo AS (SELECT i, j, c FROM co UNION ALL SELECT j, i, c FROM co), s AS (SELECT x.row_id, sum(c) AS s FROM p x JOIN bo ON bo.i = x.row_id JOIN p y ON bo.j = y.row_id AND x.label = y.label GROUP BY 1), z AS (SELECT label, count(*) AS n FROM p GROUP BY 1), ic AS (SELECT p.row_id, p.label, CASE WHEN n > 1 THEN coalesce(s, 0) / (n - 1) ELSE 1 END AS c FROM p JOIN z USING (label) LEFT JOIN s ON s.row_id = p.row_id)"


def _items(spark, d):
    return consensus.item_consensus(runs(spark, d), points(spark, d).select("row_id", "label"))


@query(f"WITH {_ITEMS} SELECT row_id, label, {_r('c')} AS consensus FROM ic WHERE round(c, 9) < 0.6")
def ambiguous_items(spark, d):
    return rounded(consensus.ambiguous_items(_items(spark, d).withColumn("consensus", F.round("consensus", 9)), 0.6))


@query(f"WITH {_ITEMS} SELECT label, {_r('avg(c)')} AS cohesion FROM ic GROUP BY label")
def cluster_cohesion(spark, d):
    return rounded(consensus.cluster_cohesion(_items(spark, d)))


@query(f"WITH {RUNS} SELECT run, {_r('1.0 / count(*) OVER ()')} AS weight FROM (SELECT DISTINCT run FROM runs)")
def uniform_weights(spark, d):
    return rounded(consensus.uniform_weights(runs(spark, d)))


@query(
    f"""WITH {_ARI}, o AS (SELECT ra AS run, 1 - greatest(ari, 0) AS d FROM y UNION ALL SELECT rb, 1 - greatest(ari, 0) FROM y), w AS (SELECT run, greatest(0.2 + 0.2 * avg(d), 0.001) AS w FROM o GROUP BY run)
    SELECT run, {_r('w / sum(w) OVER ()')} AS weight FROM w"""
)
def diversity_weights(spark, d):
    r = runs(spark, d)
    return rounded(consensus.diversity_boosted(r, consensus.uniform_weights(r)))


@query(
    f"""WITH {_ARI}, {_SIL.split('WITH ')[-1].replace(CLEAN + ', ', 'q AS (SELECT * REPLACE (CASE WHEN f3 > 0.15 THEN -1 ELSE label END AS label) FROM p), ')}, one AS (SELECT (avg((b - a) / greatest(a, b)) + 1) / 2 AS structure FROM ab), two AS (SELECT avg(greatest(ari, 0)) AS agreement FROM y WHERE ra = 'r0'),
    kv AS (SELECT var_pop(k) AS v FROM (SELECT run, count(DISTINCT label) AS k FROM runs WHERE label <> -1 GROUP BY 1)), three AS (SELECT avg(1 - greatest(ari, 0)) * 0.6 + least(any_value(v) / 20, 0.4) AS diversity FROM y, kv)
    SELECT {_r('structure')} AS structure, {_r('agreement')} AS agreement, {_r('diversity')} AS diversity, {_r('diversity * (1 - agreement)')} AS diversity_bonus, {_r('least((0.4 * structure + 0.35 * agreement + 0.25 * diversity) * 100, 100)')} AS quality FROM one, two, three"""
)
def consensus_quality(spark, d):
    r = runs(spark, d)
    ari = agreement.scores(agreement.all_contingencies(r), ["ra", "rb"]).where("ra = 'r0'")
    return rounded(consensus.quality(metrics.silhouette(noisy(spark, d), "row_id", "label", FEATURES), ari, consensus.diversity(r)))


@query()
def consensus_k(spark, d):
    return consensus.estimate_k(runs(spark, d), range(2, 6))


for _name in ("eac_average", "eac_single", "eac_complete", "cspa", "meta", "hybrid", "voting"):

    def _consensus(spark, d, name=_name):
        return consensus.METHODS[name](runs(spark, d), 4, None).select("row_id", "label")

    _consensus.__name__ = f"consensus_{_name}" if _name != "voting" else "consensus_aligned_voting"
    query()(_consensus)


# Preprocessing


@query("SELECT s_suppkey, round(percent_rank() OVER (ORDER BY s_acctbal), 6) + 0.0 AS s_acctbal FROM supplier")
def scale_quantile(spark, d):
    return rounded(preprocess.scale(read(spark, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"], "quantile_uniform"))


for _name in ("power", "box_cox", "quantile_normal"):

    def _scaled(spark, d, how=_name):
        return preprocess.scale(read(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price")), ["price"], how)

    _scaled.__name__ = f"scale_{_name}"
    query()(_scaled)


@query(
    f"""WITH {_GAPS}, b AS (SELECT p_partkey, price, coalesce(size, 0) AS size FROM g), w AS (SELECT covar_pop(size, price) / (var_pop(size) + 1e-3) AS w, avg(price) AS my, avg(size) AS mx FROM b WHERE price IS NOT NULL)
    SELECT p_partkey, {_r('coalesce(price, my + w * (size - mx))', 4)} AS price, {_r('size', 4)} AS size FROM b, w"""
)
def impute_iterative(spark, d):
    g = _gaps(spark, d).withColumn("size", F.coalesce("size", F.lit(0.0)))
    return rounded(preprocess.impute_iterative(g, ["price", "size"]), 4)


_PLANE = f"{POINTS}, s AS (SELECT avg(f1) AS mx, avg(f2) AS my, var_pop(f1) AS a, var_pop(f2) AS b, covar_pop(f1, f2) AS c, count(*) AS n FROM p)"


@query(
    f"""WITH {_PLANE}, v AS (SELECT *, cos(0.5 * atan2(2 * c, a - b)) AS x, sin(0.5 * atan2(2 * c, a - b)) AS y FROM s), u AS (SELECT *, CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS s1, CASE WHEN abs(y) >= abs(x) THEN sign(-y) ELSE sign(x) END AS s2 FROM v)
    SELECT row_id, {_r('s1 * ((f1 - mx) * x + (f2 - my) * y)')} AS PC1, {_r('s2 * ((f2 - my) * x - (f1 - mx) * y)')} AS PC2 FROM p, u"""
)
def project_pca(spark, d):
    return rounded(preprocess.pca(points(spark, d).select("row_id", "f1", "f2"), ["f1", "f2"], 2)[0])


@query(
    f"""WITH {_PLANE}, m AS (SELECT mx, my, a * n / (n - 1) + 1e-5 AS a, b * n / (n - 1) + 1e-5 AS b, c * n / (n - 1) AS c FROM s), r AS (SELECT *, sqrt(a * b - c * c) AS q, sqrt(a + b + 2 * sqrt(a * b - c * c)) AS t FROM m)
    SELECT row_id, {_r('((b + q) / t * (f1 - mx) - c / t * (f2 - my)) / q')} AS W1, {_r('((a + q) / t * (f2 - my) - c / t * (f1 - mx)) / q')} AS W2 FROM p, r"""
)
def project_whiten(spark, d):
    out = preprocess.whiten(points(spark, d).select("row_id", "f1", "f2"), ["f1", "f2"])
    return rounded(out.select("row_id", "W1", "W2"))


@query()
def outliers_isolation(spark, d):
    return preprocess.isolation_forest(points(spark, d), "row_id", FEATURES, trees=20)


def _away(m: str) -> str:
    return f"((f1 - {m}.mx) ** 2 * {m}.b - 2 * (f1 - {m}.mx) * (f2 - {m}.my) * {m}.c + (f2 - {m}.my) ** 2 * {m}.a) / ({m}.a * {m}.b - {m}.c ** 2)"


_MOMENTS = "avg(f1) AS mx, avg(f2) AS my, var_pop(f1) AS a, var_pop(f2) AS b, covar_pop(f1, f2) AS c"


@query(
    f"""WITH {POINTS}, m0 AS (SELECT {_MOMENTS} FROM p), d0 AS (SELECT p.*, sqrt({_away('m0')}) AS d FROM p, m0), m1 AS (SELECT {_MOMENTS} FROM d0 WHERE d <= (SELECT quantile_cont(d, 0.75) FROM d0)),
    d1 AS (SELECT p.*, sqrt({_away('m1')}) AS d FROM p, m1), m2 AS (SELECT {_MOMENTS} FROM d1 WHERE d <= (SELECT quantile_cont(d, 0.75) FROM d1)) SELECT row_id, {_r(f"sqrt({_away('m2')})")} AS mahalanobis FROM p, m2"""
)
def outliers_envelope(spark, d):
    return rounded(preprocess.robust_mahalanobis(points(spark, d).select("row_id", "f1", "f2"), ["f1", "f2"], support=0.75, rounds=2).select("row_id", "mahalanobis"))


@query(f"WITH {POINTS} SELECT count(*) AS n, 64 AS n_features FROM p")
def reduction_benchmark_size(spark, d):
    out = preprocess.reduction_benchmark(points(spark, d), "row_id", FEATURES, 2, neighbours=12, methods=("pca",))
    return out.select(F.col("n"), F.lit(len(FEATURES)).alias("n_features"))


@query()
def reduction_benchmark(spark, d):
    return preprocess.reduction_benchmark(points(spark, d), "row_id", FEATURES, 2, neighbours=12)


# Sources

_LABELS = {"blobs_isotropic": 5, "blobs_anisotropic": 5, "blobs_varied_sizes": 5, "moons": 2, "circles": 2, "swiss_roll": 5, "s_curve": 5, "blobs_with_noise": 6, "tight_with_outliers": 6, "nested_circles": 5, "hierarchical_blobs": 10, "unequal_density": 5,
           "elongated_clusters": 5, "heavily_overlapped": 5, "slightly_overlapped": 5, "halfmoons_rotated": 2, "donuts": 2, "blob_in_circle": 2, "stripes": 5, "random_uniform": 1, "galaxy_spiral": 5, "checkerboard": 2, "figure_eight": 2, "star_clusters": 5, "crescents": 2}


@query("SELECT name, 300::BIGINT AS n, labels::BIGINT AS labels, 7.65 AS extent, 0.0 AS mean_x, 0.0 AS mean_y FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _LABELS.items()) + ") t(name, labels)")
def pattern_catalogue(spark, d):
    """Each pattern has its rows, as many labels as its shape, and fills the same box around its mean."""
    out = None
    for name in patterns.PATTERNS:
        one = patterns.pattern(spark, name).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("extent"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out.select("name", "n", "labels", "extent", "mean_x", "mean_y"))


_RING = "2 * 3.141592653589793 * " + _u("i", "t42")


@query(f"SELECT i AS row_id, {_r(f'cos({_RING}) * (1 + 3.5 * (i % 4) / 3)')} AS x, {_r(f'sin({_RING}) * (1 + 3.5 * (i % 4) / 3)')} AS y, CAST(i % 4 AS INTEGER) AS label FROM range(300) r(i)")
def pattern_nested_circles(spark, d):
    return rounded(patterns.raw_pattern(spark, "nested_circles", 300, k=4, noise=0.0))


@query("SELECT name, n::BIGINT AS n, f::BIGINT AS n_features, k::BIGINT AS labels FROM (VALUES " + ", ".join(f"('{k}', {n}, {f}, {c})" for k, (n, f, c) in {"blobs_3": (1000, 5, 3), "blobs_7": (2000, 8, 7), "moons": (1000, 2, 2), "circles": (1000, 2, 2), "anisotropic": (1000, 2, 3), "iris_like": (150, 4, 3), "wine_like": (178, 13, 3), "cancer_like": (569, 30, 2), "high_dimensional": (1500, 20, 5), "noisy_blobs": (1200, 6, 4)}.items()) + ") t(name, n, f, k)")
def sample_datasets(spark, d):
    out = None
    for name in patterns.DATASETS:
        t = patterns.dataset(spark, name)
        one = t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.lit(len([c for c in t.columns if c.startswith("feature_")])).cast("long").alias("n_features"), F.count_distinct("true_label").alias("labels"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 10000::BIGINT AS n, 5::BIGINT AS labels, 20::BIGINT AS n_features")
def generated_table(spark, d):
    t = patterns.classification(spark, 10_000, 20, 15, 5)
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("labels"), F.lit(len([c for c in t.columns if c.startswith("feature_")])).cast("long").alias("n_features"))


# Runners and charts


@query(
    """WITH t AS (SELECT p_size AS n, sum(p_retailprice) / 1000 + p_size ** 1.5 AS seconds FROM part GROUP BY p_size), f AS (SELECT regr_slope(ln(seconds), ln(n)) AS b, regr_intercept(ln(seconds), ln(n)) AS a FROM t)
    SELECT round(b, 6) AS exponent, CASE WHEN b < 1.3 THEN 'linear' WHEN b < 1.6 THEN 'n log n' WHEN b < 2.3 THEN 'quadratic' WHEN b < 2.8 THEN 'above quadratic' ELSE 'steeper' END AS complexity, round(exp(a + b * ln(5000)), 4) AS predicted_seconds FROM f"""
)
def complexity_estimate(spark, d):
    from .registry import growth

    t = read(spark, d, "part").groupBy(F.col("p_size").alias("n")).agg((F.sum("p_retailprice") / 1000 + F.pow(F.first("p_size"), F.lit(1.5))).alias("seconds"))
    return growth(t, 5000).select(F.round("exponent", 6).alias("exponent"), "complexity", F.round("predicted_seconds", 4).alias("predicted_seconds"))


@query(
    f"""WITH {RUNS}, v AS (SELECT regexp_extract(run, '[0-9]') AS k, label, row_id FROM runs), x AS (SELECT k, round(value, 6) AS value FROM (SELECT CAST(k AS INTEGER) AS k, count(DISTINCT label) AS value FROM v GROUP BY 1))
    SELECT {_r('corr(rx, ry)')} AS spearman FROM (SELECT rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS rx, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS ry FROM x)"""
)
def curve_trend(spark, d):
    curve = runs(spark, d).groupBy(F.regexp_extract("run", "[0-9]", 0).cast("int").alias("k")).agg(F.count_distinct("label").alias("value"))
    return rounded(ranking.trend(curve, "k", "value").select("spearman"))


@query(
    f"""WITH {POINTS}, n AS (SELECT a.row_id, {DIST} AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY {DIST}, b.row_id) AS r FROM p a JOIN p b ON a.row_id <> b.row_id), k AS (SELECT d, row_number() OVER (ORDER BY d DESC, row_id) AS rank FROM n WHERE r = 5),
    b AS (SELECT min(d) AS a, max(d) AS z, count(*) AS n FROM k) SELECT {_r('greatest(arg_max(d, 1 - (rank - 1) / (n - 1) - (d - a) / (z - a)), 0.05)')} AS eps FROM k, b"""
)
def k_distance_knee(spark, d):
    curve = ranking.k_distance_curve(points(spark, d), "row_id", FEATURES, 5)
    return rounded(ranking.eps_by_knee(curve, "rank", "distance"))


@query("SELECT n AS number, '{\"k\": ' || k || ', \"seed\": ' || s || '}' AS params FROM (VALUES (0, 2, 1), (1, 2, 7), (2, 3, 1), (3, 3, 7), (4, 4, 1), (5, 4, 7)) t(n, k, s)")
def parameter_grid(spark, d):
    from ..functions.sql_functions import register

    register(spark)
    return spark.sql("""SELECT * FROM parameter_grid('{"k": [2, 3, 4], "seed": [1, 7]}')""")


@query(f"WITH {CENTRES} SELECT label, 'f' || i AS column_name, {_r('(e[i] - avg(e[i]) OVER (PARTITION BY i)) / stddev_pop(e[i]) OVER (PARTITION BY i)')} AS z FROM c, range(1, 65) t(i)")
def chart_centroid_heatmap(spark, d):
    return rounded(profile.centroid_heatmap(noisy(spark, d), "label", FEATURES))


@query(f"WITH {_SIL} SELECT la AS label, {_r('avg((b - a) / greatest(a, b))')} AS silhouette, count(*) AS n FROM ab GROUP BY la")
def chart_silhouette_bars(spark, d):
    s = metrics.silhouette_samples(noisy(spark, d), "row_id", "label", FEATURES)
    return rounded(s.groupBy("label").agg(F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("n")))


@query("WITH b AS (SELECT min(value) AS a, max(value) AS z FROM events), h AS (SELECT least(floor((value - a) / (z - a) * 20), 19) AS bin, count(*) AS n FROM events, b GROUP BY 1) SELECT CAST(bin AS INTEGER) AS bin, round(a + bin * (z - a) / 20, 6) AS low, round(a + (bin + 1) * (z - a) / 20, 6) AS high, n FROM h, b")
def chart_histogram(spark, d):
    return rounded(profile.histogram(read(spark, d, "events"), "value", 20))


@query(f"WITH {POINTS} SELECT row_id FROM p ORDER BY {_u('row_id', '42')}, row_id LIMIT 200")
def chart_scatter_sample(spark, d):
    return sampling.uniform_sample(points(spark, d), "row_id", 200).select("row_id")
