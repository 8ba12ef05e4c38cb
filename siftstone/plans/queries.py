"""Queries over the operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import hash_uniform
from ..operators import agreement, consensus, distances, metrics, preprocess, profile, ranking, sampling, stability
from .frames import CENTRES, CLEAN, DIMS, DIST, FEATURES, LINE, LONG_LINE, POINTS, RUNS, every, noisy, points, read, rounded, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


# Scans, filters, sampling


@query(
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {_r('sum(l_quantity)', 2)} AS sum_qty, {_r('sum(l_extendedprice * (1 - l_discount))', 2)} AS sum_disc_price,
    {_r('avg(l_discount)')} AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-01-01' GROUP BY ALL"""
)
def scan_lineitem_pricing(spark, d):
    rows = read(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-01-01").cast("timestamp"))
    out = rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc")
    )
    return out


@query(f"WITH {CLEAN} SELECT row_id, label FROM q WHERE label <> -1")
def filter_noise(spark, d):
    return metrics.clean(noisy(spark, d), "label").select("row_id", "label")


@query(
    "SELECT column_name, round(missing_share, 6) AS missing_share, n_unique, missing_share >= 0.99 OR n_unique <= 1 AS dropped FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, 1 - count({c}) / count(*) AS missing_share, count(DISTINCT {c}) AS n_unique FROM part" for c in ("p_brand", "p_type", "p_size", "p_retailprice"))
    + ")"
)
def drop_columns(spark, d):
    return rounded(profile.dropped_columns(read(spark, d, "part").select("p_brand", "p_type", "p_size", "p_retailprice")))


@query(f"WITH {RUNS}, s AS (SELECT run, count(DISTINCT CASE WHEN label <> -1 THEN label END) AS k, count(*) FILTER (label = -1) / count(*) AS noise FROM runs GROUP BY run) SELECT run, k, {_r('noise')} AS noise, CASE WHEN k < 2 OR noise > 0.8 THEN 'FAILED' ELSE 'OK' END AS status FROM s")
def degenerate_runs(spark, d):
    s = runs(spark, d).groupBy("run").agg(F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("k"), (F.count_if(F.col("label") == -1) / F.count(F.lit(1))).alias("noise"))
    return rounded(s.withColumn("status", ranking.degenerate(F.col("k"), F.col("noise"))))


@query(f"WITH {RUNS} SELECT run, row_id, label FROM runs WHERE run IN ('r1', 'r3')")
def filter_runs(spark, d):
    return runs(spark, d).where(F.col("run").isin("r1", "r3")).select("run", "row_id", "label")


def _u(key: str, seed: str) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '-{seed}'), 1, 8) AS BIGINT) / 4294967296.0)"


@query(f"SELECT c_custkey FROM customer ORDER BY {_u('c_custkey', '42')}, c_custkey LIMIT 100")
def sample_uniform(spark, d):
    return sampling.uniform_sample(read(spark, d, "customer"), "c_custkey", 100).select("c_custkey")


@query(
    f"""WITH s AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_u('c_custkey', '42')}, c_custkey) AS r,
    count(*) OVER (PARTITION BY c_mktsegment) AS m, count(*) OVER () AS n FROM customer)
    SELECT c_custkey, c_mktsegment FROM s WHERE r <= greatest(1, floor(200 * m / n))"""
)
def sample_stratified(spark, d):
    return sampling.stratified_sample(read(spark, d, "customer"), "c_custkey", "c_mktsegment", 200).select("c_custkey", "c_mktsegment")


@query(
    f"""WITH {POINTS}, k AS (SELECT a.row_id, {DIST} AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY {DIST}, b.row_id) AS r FROM p a JOIN p b ON a.row_id <> b.row_id),
    w AS (SELECT row_id, avg(d) AS w FROM k WHERE r <= 10 GROUP BY row_id)
    SELECT row_id FROM w ORDER BY ln(greatest({_u('row_id', '42')}, 1e-12)) / w DESC, row_id LIMIT 60"""
)
def sample_density(spark, d):
    return sampling.density_sample(points(spark, d), "row_id", FEATURES, 60).select("row_id")


@query(f"WITH {CENTRES} SELECT DISTINCT first_value(a.row_id) OVER (PARTITION BY b.label ORDER BY {DIST}, a.row_id) AS row_id FROM q a CROSS JOIN c b QUALIFY true")
def sample_coreset(spark, d):
    rows = noisy(spark, d)
    return sampling.coreset_sample(rows, "row_id", FEATURES, distances.centroid_array(rows, "label", FEATURES)).select("row_id")


@query(f"WITH {POINTS}, m AS (SELECT *, f1 - avg(f1) OVER () AS x, f2 - avg(f2) OVER () AS y FROM p), s AS (SELECT *, greatest(max(abs(x)) OVER (), max(abs(y)) OVER ()) AS widest FROM m) SELECT row_id, {_r('x / widest * 7.65')} AS x, {_r('y / widest * 7.65')} AS y FROM s")
def pattern_normalise(spark, d):
    from ..sources.patterns import normalise

    return rounded(normalise(points(spark, d).select("row_id", F.col("f1").alias("x"), F.col("f2").alias("y")), "x", "y"))


@query(
    f"""SELECT i AS row_id, {_r("cos(t) * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END + CASE WHEN i % 2 = 0 THEN 0 ELSE 1 END")} AS x,
    {_r("sin(t) * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END + CASE WHEN i % 2 = 0 THEN 0 ELSE 0.5 END")} AS y, CAST(i % 2 AS INTEGER) AS label
    FROM (SELECT i, 3.141592653589793 * {_u('i', 't42')} AS t FROM range(300) r(i))"""
)
def pattern_moons(spark, d):
    from ..sources.patterns import raw_pattern

    return rounded(raw_pattern(spark, "moons", 300, noise=0.0))


# Joins by distance


@query(
    f"""WITH {CENTRES}, d AS (SELECT a.row_id, b.label AS cluster, {DIST} AS distance, row_number() OVER (PARTITION BY a.row_id ORDER BY {DIST}, b.label) AS r FROM p a CROSS JOIN c b)
    SELECT row_id, cluster, {_r('distance')} AS distance FROM d WHERE r = 1"""
)
def join_nearest_centroid(spark, d):
    centres = distances.centroid_array(noisy(spark, d), "label", FEATURES)
    return rounded(distances.nearest_centroid(points(spark, d), centres, FEATURES).select("row_id", "cluster", "distance"))


@query(
    f"""WITH {POINTS}, d AS (SELECT a.row_id AS id, b.row_id AS neighbour, {DIST} AS distance, row_number() OVER (PARTITION BY a.row_id ORDER BY {DIST}, b.row_id) AS rank FROM p a JOIN p b ON a.row_id <> b.row_id)
    SELECT id, neighbour, {_r('distance')} AS distance, CAST(rank AS INTEGER) AS rank FROM d WHERE rank <= 5"""
)
def join_knn(spark, d):
    return rounded(distances.knn(points(spark, d), "row_id", FEATURES, 5))


@query(f"WITH {POINTS} SELECT a.row_id AS id, b.row_id AS neighbour, {_r(DIST)} AS distance FROM p a JOIN p b ON a.row_id <> b.row_id WHERE {DIST} <= 1.1")
def join_radius(spark, d):
    return rounded(distances.radius_pairs(points(spark, d), "row_id", FEATURES, 1.1))


@query(f"WITH {CENTRES} SELECT a.label AS a, b.label AS b, {_r(DIST)} AS distance FROM c a JOIN c b ON a.label < b.label")
def join_centroids(spark, d):
    return rounded(distances.pair_block(noisy(spark, d), "label", FEATURES))


@query(f"WITH {RUNS} SELECT a.label AS la, b.label AS lb, count(*) AS n FROM runs a JOIN runs b USING (row_id) WHERE a.run = 'r1' AND b.run = 'r2' AND a.label <> -1 AND b.label <> -1 GROUP BY ALL")
def join_contingency(spark, d):
    r = runs(spark, d)
    return agreement.contingency(r.where("run = 'r1'"), r.where("run = 'r2'"))


@query(f"WITH {RUNS}, f AS (SELECT a.label AS la, b.label AS lb, count(*) AS n FROM runs a JOIN runs b USING (row_id) WHERE a.run = 'r0' AND b.run = 'r4' GROUP BY ALL) SELECT la, lb, n, {_r('n / sum(n) OVER (PARTITION BY la)')} AS share FROM f")
def cluster_flow(spark, d):
    r = runs(spark, d)
    return rounded(agreement.cluster_flow(r.where("run = 'r0'"), r.where("run = 'r4'")))


# Aggregates


@query(
    f"""WITH {LONG_LINE}, s AS (SELECT column_name, count(*) AS n, count(value) AS n_present, count(DISTINCT value) AS n_unique, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
      quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75, skewness(value) AS skew, kurtosis(value) AS kurtosis FROM l GROUP BY column_name),
    o AS (SELECT l.column_name, count(*) FILTER (value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)) AS n_outliers FROM l JOIN s USING (column_name) GROUP BY 1)
    SELECT column_name, n, n_unique, {_r('mean', 4)} AS mean, {_r('std', 4)} AS std, {_r('min', 4)} AS min, {_r('max', 4)} AS max, {_r('q25', 4)} AS q25, {_r('median', 4)} AS median, {_r('q75', 4)} AS q75, {_r('skew', 4)} AS skew, {_r('kurtosis', 4)} AS kurtosis,
      n_outliers, n - n_present AS n_missing, n_unique <= 1 AS is_constant, n_unique = 2 AS is_binary, n_unique <= 20 AS is_categorical FROM s JOIN o USING (column_name)"""
)
def profile_columns(spark, d):
    return rounded(profile.column_profile(read(spark, d, "lineitem").select(*LINE), LINE).drop("n_present", "missing_pct"), 4)


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def profile_top_values(spark, d):
    return profile.top_values(read(spark, d, "part"), "p_brand")


@query("SELECT count(*) AS n_rows, 3 AS n_columns, CAST(0 AS BIGINT) AS n_missing, count(*) - (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part)) AS n_duplicates FROM part")
def profile_table(spark, d):
    return profile.table_profile(read(spark, d, "part").select("p_brand", "p_type", "p_size"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(spark, d):
    return read(spark, d, "part").select("p_brand", "p_type").dropDuplicates()


@query(
    "SELECT a, b, round(r, 6) + 0.0 AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(LINE) for b in LINE[i + 1 :]) + ")"
)
def correlation_pairs(spark, d):
    return rounded(profile.correlation_pairs(read(spark, d, "lineitem").select(*LINE), LINE))


@query(
    f"""WITH {CLEAN}, s AS (SELECT label, count(*) AS n FROM q GROUP BY label), r AS (SELECT * FROM s WHERE label <> -1)
    SELECT (SELECT count(*) FROM r) AS k, (SELECT sum(n) FROM s)::BIGINT AS n_rows, coalesce((SELECT n FROM s WHERE label = -1), 0) AS n_noise, {_r("coalesce((SELECT n FROM s WHERE label = -1), 0) / (SELECT sum(n) FROM s)")} AS noise_ratio,
    min(n) AS min_size, max(n) AS max_size, {_r('avg(n)')} AS mean_size, {_r('stddev_pop(n)')} AS std_size, {_r('min(n) / max(n)')} AS balance,
    {_r('ln(sum(n)) / ln(2) - sum(n * ln(n)) / sum(n) / ln(2)')} AS entropy_bits, {_r('ln(sum(n)) - sum(n * ln(n)) / sum(n)')} AS entropy_nats FROM r"""
)
def cluster_sizes(spark, d):
    return rounded(metrics.size_stats(noisy(spark, d), "label"))


@query(
    f"""WITH {CENTRES}, m AS (SELECT a.label, {DIST} AS d FROM q a JOIN c b USING (label)),
    t AS (SELECT a.label, b.label AS nearest, {DIST} AS d, row_number() OVER (PARTITION BY a.label ORDER BY {DIST}, b.label) AS r FROM c a JOIN c b ON a.label <> b.label),
    s AS (SELECT label, count(*) AS n, avg(d) AS mean_dist, max(d) AS max_dist, stddev_pop(d) AS std_dist FROM m GROUP BY label)
    SELECT label, n, {_r('n / (SELECT count(*) FROM q WHERE label <> -1)')} AS share, {_r('mean_dist')} AS mean_dist, {_r('max_dist')} AS max_dist, {_r('std_dist')} AS std_dist, nearest, {_r('t.d')} AS nearest_distance FROM s JOIN t USING (label) WHERE r = 1"""
)
def cluster_statistics(spark, d):
    return rounded(metrics.cluster_statistics(noisy(spark, d), "label", FEATURES))


_LONG_POINTS = CLEAN + ", l AS (" + " UNION ALL ".join(f"SELECT label, '{f}' AS column_name, {f} AS value FROM q WHERE label <> -1" for f in FEATURES) + ")"


@query(f"WITH {_LONG_POINTS} SELECT label, column_name, {_r('avg(value)')} AS mean, {_r('stddev_pop(value)')} AS std, {_r('min(value)')} AS min, {_r('max(value)')} AS max, {_r('median(value)')} AS median FROM l GROUP BY ALL")
def cluster_profiler(spark, d):
    return rounded(metrics.cluster_profiler(noisy(spark, d), "label", FEATURES))


@query(
    f"""WITH {_LONG_POINTS}, t AS (SELECT column_name, avg(value) AS m, stddev_pop(value) AS s FROM l GROUP BY 1), z AS (SELECT label, column_name, (avg(value) - any_value(m)) / any_value(s) AS z FROM l JOIN t USING (column_name) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(abs(z), 9) DESC, column_name) AS rank FROM z)
    SELECT label, column_name, {_r('z')} AS z, CAST(rank AS INTEGER) AS rank, CASE WHEN z >= 0 THEN 'High-' ELSE 'Low-' END || column_name AS name FROM r WHERE rank <= 3"""
)
def consensus_profile(spark, d):
    return rounded(consensus.consensus_profile(noisy(spark, d), "row_id", "label", FEATURES, 3))


@query(
    f"""WITH {_LONG_POINTS}, g AS (SELECT column_name, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM l GROUP BY ALL), t AS (SELECT column_name, avg(value) AS m0, var_pop(value) * count(*) AS tss, count(*) AS n0 FROM l GROUP BY 1),
    a AS (SELECT column_name, sum(n * (m - m0) ** 2) AS ssb, sum(n * v) AS ssw, any_value(tss) AS tss, any_value(n0) AS n0, count(*) AS k FROM g JOIN t USING (column_name) GROUP BY 1)
    SELECT column_name, {_r('ssb / tss')} AS importance, {_r('(ssb / (k - 1)) / (ssw / (n0 - k))', 4)} AS f_stat FROM a"""
)
def feature_importance(spark, d):
    rows = noisy(spark, d)
    return profile.variance_importance(rows, "label", FEATURES).withColumn("importance", F.round("importance", 6)).join(profile.anova_f(rows, "label", FEATURES).withColumn("f_stat", F.round("f_stat", 4)), "column_name")


@query(
    """WITH l AS (SELECT 'l_quantity' AS column_name, l_linenumber AS label, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_discount', l_linenumber, l_discount FROM lineitem),
    k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY column_name, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY column_name, value) AS t FROM l WINDOW w AS (PARTITION BY column_name ORDER BY value)),
    s AS (SELECT column_name, label, sum(r) AS r, count(*) AS m FROM k GROUP BY ALL), u AS (SELECT column_name, count(*)::DOUBLE AS n, sum(t * t - 1)::DOUBLE AS ties FROM k GROUP BY 1)
    SELECT column_name, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 3) + 0.0 AS h_stat FROM (SELECT column_name, sum(r * r / m) AS q FROM s GROUP BY 1) JOIN u USING (column_name)"""
)
def kruskal_wallis(spark, d):
    rows = read(spark, d, "lineitem")
    return rounded(profile.kruskal_h(rows, "l_linenumber", ["l_quantity", "l_discount"]), 3)


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) + 0.0 AS mean, round(stddev_samp(o_totalprice), 4) + 0.0 AS std, count(o_totalprice) AS n, round(max(o_totalprice), 4) AS max, round(min(o_totalprice), 4) AS min FROM orders GROUP BY 1 ORDER BY mean DESC, 1 LIMIT 10")
def leaderboard(spark, d):
    return ranking.leaderboard(read(spark, d, "orders"), "o_orderpriority", "o_totalprice")


_CONTEST = "s AS (SELECT event_type AS algorithm_id, user_id AS dataset, avg(value) AS score FROM events GROUP BY ALL)"


def _contest(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").alias("algorithm_id"), F.col("user_id").alias("dataset")).agg(F.avg("value").alias("score"))


@query(f"WITH {_CONTEST}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC NULLS LAST, algorithm_id) AS r FROM s) SELECT algorithm_id, count(*) FILTER (r = 1) AS wins, count(*) AS contests, {_r('count(*) FILTER (r = 1) / count(*)')} AS win_rate FROM r GROUP BY 1")
def win_rates(spark, d):
    return rounded(ranking.win_rates(_contest(spark, d), "algorithm_id", "dataset", "score"))


@query(f"WITH {_CONTEST} SELECT a.algorithm_id AS a, b.algorithm_id AS b, count(*) FILTER (a.score > b.score) AS wins, count(*) AS contests FROM s a JOIN s b ON a.dataset = b.dataset AND a.algorithm_id <> b.algorithm_id GROUP BY ALL")
def win_matrix(spark, d):
    return ranking.win_matrix(_contest(spark, d), "algorithm_id", "dataset", "score")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 10) AS slow, round(count(*) FILTER (value > 10) / count(*), 6) + 0.0 AS rate FROM events GROUP BY 1")
def batch_summary(spark, d):
    e = read(spark, d, "events")
    return rounded(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 10).alias("slow"), (F.count_if(F.col("value") > 10) / F.count(F.lit(1))).alias("rate")))


# Ranking and order


@query("SELECT s_suppkey, s_acctbal, CAST(row_number() OVER (ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS INTEGER) AS rank FROM supplier")
def rank_suppliers(spark, d):
    return ranking.rank_by(read(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey")


_CURVE = "v AS (SELECT p_size AS k, count(*) * 1000.0 / (p_size + 3) AS cost FROM part GROUP BY p_size)"


def _curve(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_size").alias("k")).agg(F.count(F.lit(1)).alias("_n")).select("k", (F.col("_n") * F.lit(1000.0) / (F.col("k") + 3)).alias("cost"))


@query(f"WITH {_CURVE}, e AS (SELECT k, lag(cost) OVER w - 2 * cost + lead(cost) OVER w AS d FROM v WINDOW w AS (ORDER BY k)) SELECT k AS best_k FROM e WHERE d IS NOT NULL ORDER BY d DESC, k LIMIT 1")
def elbow_k(spark, d):
    return ranking.elbow(_curve(spark, d), "k", "cost")


@query(
    f"""WITH {_CURVE}, b AS (SELECT min(k) AS k0, max(k) AS k1, min(cost) AS s0, max(cost) AS s1, arg_min(cost, k) AS sf, arg_max(cost, k) AS sl FROM v)
    SELECT k AS best_k FROM v, b ORDER BY CASE WHEN sl >= sf THEN (cost - s0) / (s1 - s0) - (k - k0) / (k1 - k0) ELSE 1 - (k - k0) / (k1 - k0) - (cost - s0) / (s1 - s0) END DESC, k LIMIT 1"""
)
def kneedle_k(spark, d):
    return ranking.kneedle(_curve(spark, d), "k", "cost")


@query(f"WITH {_CURVE} SELECT arg_max(k, cost) AS best_k FROM v")
def silhouette_best_k(spark, d):
    return _curve(spark, d).agg(F.max_by("k", "cost").alias("best_k"))


@query(
    f"""WITH {POINTS}, n AS (SELECT a.row_id, {DIST} AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY {DIST}, b.row_id) AS r FROM p a JOIN p b ON a.row_id <> b.row_id),
    k AS (SELECT d, row_number() OVER (ORDER BY d DESC, row_id) AS rank FROM n WHERE r = 5), e AS (SELECT rank, d - 2 * lead(d, 1) OVER w + lead(d, 2) OVER w AS s, lead(d, 1) OVER w AS eps FROM k WINDOW w AS (ORDER BY rank))
    SELECT round(greatest(eps, 0.05), 6) AS eps FROM e WHERE s IS NOT NULL ORDER BY s DESC, rank LIMIT 1"""
)
def k_distance_eps(spark, d):
    near = distances.knn(points(spark, d), "row_id", FEATURES, 5).where("rank = 5").select(F.col("id").alias("row_id"), "distance")
    curve = ranking.rank_by(near, "distance", "row_id")
    return rounded(ranking.eps_by_second_difference(curve, "rank", "distance"))


@query(f"WITH {CLEAN}, s AS (SELECT label, count(*) AS n FROM q WHERE label <> -1 GROUP BY 1), m AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS new FROM s) SELECT row_id, CAST(coalesce(new, -1) AS INTEGER) AS label FROM q LEFT JOIN m USING (label)")
def relabel_by_size(spark, d):
    return ranking.relabel_by_size(noisy(spark, d).select("row_id", "label"), "label").select("row_id", F.col("label").cast("int").alias("label"))


@query(f"WITH {CLEAN}, s AS (SELECT label, min(row_id) AS f FROM q WHERE label <> -1 GROUP BY 1), m AS (SELECT label, row_number() OVER (ORDER BY f) - 1 AS new FROM s) SELECT row_id, CAST(coalesce(new, -1) AS INTEGER) AS label FROM q LEFT JOIN m USING (label)")
def canonical_labels(spark, d):
    return ranking.canonical_labels(noisy(spark, d).select("row_id", "label"), "row_id", "label").select("row_id", F.col("label").cast("int").alias("label"))


_FINGER = RUNS + """, two AS (SELECT run, row_id, label FROM runs UNION ALL SELECT 'r9', row_id, 20 - label FROM runs WHERE run = 'r0'),
    fst AS (SELECT run, label, min(row_id) AS f FROM two WHERE label <> -1 GROUP BY ALL), m AS (SELECT run, label, row_number() OVER (PARTITION BY run ORDER BY f) - 1 AS new FROM fst),
    s AS (SELECT two.run, sum(CAST(CAST('0x' || substr(md5(row_id || ':' || coalesce(new, -1)), 1, 12) AS BIGINT) AS HUGEINT)) AS s FROM two LEFT JOIN m ON two.run = m.run AND two.label = m.label GROUP BY 1),
    p2 AS (SELECT run, substr(md5(CAST(s AS VARCHAR)), 1, 16) AS fingerprint FROM s)"""


@query(f"WITH {_FINGER} SELECT run, fingerprint, min(run) OVER (PARTITION BY fingerprint) AS first_run FROM p2")
def deduplicate_runs(spark, d):
    r = runs(spark, d)
    both = r.unionByName(r.where("run = 'r0'").select(F.lit("r9").alias("run"), "row_id", (20 - F.col("label")).alias("label")))
    return ranking.fingerprints(both, "row_id", "label", "run")


@query(
    f"""WITH {POINTS}, q AS (SELECT row_id, CASE WHEN label = 9 AND row_id % 7 <> 0 THEN 8 ELSE label END AS label FROM p), z AS (SELECT label, count(*) AS n FROM q GROUP BY 1), big AS (SELECT min(label) AS b FROM z WHERE n >= 20),
    x AS (SELECT row_id, CASE WHEN n < 20 AND b IS NOT NULL THEN b ELSE label END AS label FROM q JOIN z USING (label), big), s AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS new FROM x GROUP BY label)
    SELECT row_id, CAST(new AS INTEGER) AS label FROM x JOIN s USING (label)"""
)
def merge_small_clusters(spark, d):
    q = points(spark, d).select("row_id", F.when((F.col("label") == 9) & (F.col("row_id") % 7 != 0), 8).otherwise(F.col("label")).alias("label"))
    return ranking.merge_small(q, "label", 20).select("row_id", F.col("label").cast("int").alias("label"))


@query("SELECT event_type, n, round(seconds, 4) AS seconds, round(sum(seconds) OVER (ORDER BY event_type), 4) AS elapsed FROM (SELECT event_type, count(*) AS n, sum(value) AS seconds FROM events GROUP BY 1)")
def execution_timeline(spark, d):
    t = read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("seconds"))
    return rounded(ranking.timeline(t, "event_type", "seconds"), 4)


@query(
    """WITH l AS (SELECT *, s_acctbal - lag(s_acctbal) OVER w AS a, s_suppkey - lag(s_suppkey) OVER w AS b, lag(s_acctbal) OVER w AS la, lag(s_suppkey) OVER w AS lb FROM supplier WINDOW w AS (ORDER BY s_suppkey))
    SELECT 's_suppkey' AS column_name, count(DISTINCT s_suppkey) / count(*) > 0.95 AS id_like, false AS constant, false AS skewed, kurtosis(s_suppkey) < -0.5 AS maybe_bimodal, avg((b > 0)::INT) > 0.98 OR avg((b < 0)::INT) > 0.98 AS monotonic, abs(corr(s_suppkey, lb)) > 0.85 AS autocorrelated FROM l
    UNION ALL SELECT 's_acctbal', count(DISTINCT s_acctbal) / count(*) > 0.95, count(DISTINCT s_acctbal) <= 1, abs(skewness(s_acctbal)) > 2.5, kurtosis(s_acctbal) < -0.5, avg((a > 0)::INT) > 0.98 OR avg((a < 0)::INT) > 0.98, abs(corr(s_acctbal, la)) > 0.85 FROM l"""
)
def smart_types(spark, d):
    return profile.smart_types(read(spark, d, "supplier"), ["s_suppkey", "s_acctbal"], "s_suppkey")


# Preprocessing

_GAPS = "g AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size FROM part)"


def _gaps(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("price"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_size").cast("double")).alias("size"))


for _name, _price, _size in (
    ("mean", "(SELECT avg(price) FROM g)", "(SELECT avg(size) FROM g)"),
    ("median", "(SELECT median(price) FROM g)", "(SELECT median(size) FROM g)"),
    ("mode", "(SELECT price FROM g WHERE price IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "(SELECT size FROM g WHERE size IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
    ("constant", "0", "0"),
):

    def _fill(spark, d, how=_name):
        return rounded(preprocess.impute(_gaps(spark, d), ["price", "size"], how))

    _fill.__name__ = f"impute_{_name}"
    query(f"WITH {_GAPS} SELECT p_partkey, {_r(f'coalesce(price, {_price})')} AS price, {_r(f'coalesce(size, {_size})')} AS size FROM g")(_fill)


@query(
    f"""WITH {POINTS}, g AS (SELECT row_id, CASE WHEN row_id % 9 <> 0 THEN f1 END AS f1, e[2:{DIMS}] AS e FROM p),
    d AS (SELECT a.row_id, b.row_id AS other, b.f1, {DIST} * sqrt({DIMS} / {DIMS - 1}.0) AS d FROM g a JOIN g b ON b.f1 IS NOT NULL WHERE a.f1 IS NULL), k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, other) AS r FROM d)
    SELECT g.row_id, {_r('coalesce(g.f1, v)')} AS f1 FROM g LEFT JOIN (SELECT row_id, sum(f1 / d) / sum(1 / d) AS v FROM k WHERE r <= 5 GROUP BY 1) USING (row_id)"""
)
def impute_knn(spark, d):
    g = points(spark, d).withColumn("f1", F.when(F.col("row_id") % 9 != 0, F.col("f1")))
    return rounded(preprocess.impute_knn(g, "row_id", FEATURES).select("row_id", "f1"))


@query(f"WITH {_GAPS} SELECT p_partkey, price, size FROM g WHERE price IS NOT NULL AND size IS NOT NULL")
def drop_null_rows(spark, d):
    return preprocess.drop_null_rows(_gaps(spark, d), ["price", "size"])


@query("WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS d, avg(l_quantity) AS m2, stddev_pop(l_quantity) AS d2 FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, s WHERE abs((l_extendedprice - m) / d) > 1.7 OR abs((l_quantity - m2) / d2) > 1.7")
def outliers_zscore(spark, d):
    rows = read(spark, d, "lineitem")
    return rows.where(preprocess.zscore_mask(rows, ["l_extendedprice", "l_quantity"], 1.7)).select("l_orderkey", "l_linenumber", "l_extendedprice")


_FENCES = every("quantile_cont({f}, .25) AS a{f}, quantile_cont({f}, .75) AS b{f}")
_BEYOND = every("{f} < a{f} - 1.5 * (b{f} - a{f}) OR {f} > b{f} + 1.5 * (b{f} - a{f})", " OR ")


@query(f"WITH {POINTS}, s AS (SELECT {_FENCES} FROM p) SELECT row_id, {_BEYOND} AS __outlier__ FROM p, s")
def outliers_iqr_flag(spark, d):
    p = points(spark, d)
    return preprocess.apply_outliers(p, preprocess.iqr_mask(p, FEATURES), FEATURES, "flag").select("row_id", "__outlier__")


@query(
    f"""WITH {POINTS}, n AS (SELECT a.row_id AS id, b.row_id AS nb, {DIST} AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY {DIST}, b.row_id) AS r FROM p a JOIN p b ON a.row_id <> b.row_id),
    k AS (SELECT * FROM n WHERE r <= 20), kd AS (SELECT id, max(d) AS kd FROM k GROUP BY 1), l AS (SELECT k.id, 1 / (avg(greatest(k.d, kd.kd)) + 1e-10) AS lrd FROM k JOIN kd ON k.nb = kd.id GROUP BY 1)
    SELECT k.id, round(avg(o.lrd) / any_value(m.lrd), 5) + 0.0 AS lof FROM k JOIN l o ON k.nb = o.id JOIN l m ON k.id = m.id GROUP BY k.id"""
)
def outliers_lof(spark, d):
    return rounded(preprocess.lof(points(spark, d), "row_id", FEATURES, 20), 5)


_ENDS = every("quantile_cont({f}, .01) AS a{f}, quantile_cont({f}, .99) AS b{f}")
_CLIPPED = every("round(least(greatest({f}, a{f}), b{f}), 6) + 0.0 AS {f}")


@query(f"WITH {POINTS}, s AS (SELECT {_ENDS} FROM p) SELECT row_id, {_CLIPPED} FROM p, s")
def outliers_clip(spark, d):
    return rounded(preprocess.clip_all(points(spark, d).drop("label"), FEATURES))


@query(
    f"""WITH {POINTS}, s AS (SELECT avg(f1) AS a, avg(f2) AS b, var_pop(f1) AS va, var_pop(f2) AS vb, covar_pop(f1, f2) AS c FROM p)
    SELECT row_id, {_r('sqrt(((f1 - a) ** 2 * vb - 2 * (f1 - a) * (f2 - b) * c + (f2 - b) ** 2 * va) / (va * vb - c * c))')} AS mahalanobis FROM p, s"""
)
def outliers_mahalanobis(spark, d):
    return rounded(preprocess.mahalanobis(points(spark, d).select("row_id", "f1", "f2"), ["f1", "f2"]).select("row_id", "mahalanobis"))


_SCALES = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "maxabs": ("0", "max(abs({c}))"),
    "robust": ("median({c})", "quantile_cont({c}, .9) - quantile_cont({c}, .1)"),
}
for _name, (_centre, _spread) in _SCALES.items():

    def _scale(spark, d, how=_name):
        rows = read(spark, d, "customer").select("c_custkey", "c_acctbal")
        return rounded(preprocess.scale(rows, ["c_acctbal"], how))

    _scale.__name__ = f"scale_{_name}"
    query(f"WITH s AS (SELECT {_centre.format(c='c_acctbal')} AS m, {_spread.format(c='c_acctbal')} AS d FROM customer) SELECT c_custkey, {_r('(c_acctbal - m) / d')} AS c_acctbal FROM customer, s")(_scale)


@query(
    """WITH s AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS d, min(s_acctbal) AS a, max(s_acctbal) AS b, max(abs(s_acctbal)) AS x, median(s_acctbal) AS q, quantile_cont(s_acctbal, .9) - quantile_cont(s_acctbal, .1) AS w FROM supplier)
    SELECT s_suppkey, s_acctbal AS original, round((s_acctbal - m) / d, 6) + 0.0 AS standard, round((s_acctbal - a) / (b - a), 6) + 0.0 AS minmax, round(s_acctbal / x, 6) + 0.0 AS maxabs, round((s_acctbal - q) / w, 6) + 0.0 AS robust FROM supplier, s"""
)
def compare_scalers(spark, d):
    return rounded(preprocess.compare_scalers(read(spark, d, "supplier"), "s_suppkey", "s_acctbal"))


@query(
    "SELECT o_orderkey, " + ", ".join(f"CAST(coalesce(o_orderstatus = '{v}', false) AS INTEGER) AS o_orderstatus_{v}" for v in "FOP") + " FROM orders"
)
def encode_one_hot(spark, d):
    return preprocess.encode(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("SELECT 'l_discount' AS column_name, var_pop(l_discount) > 0.01 AS kept FROM lineitem UNION ALL SELECT 'l_quantity', var_pop(l_quantity) > 0.01 FROM lineitem UNION ALL SELECT 'l_tax', var_pop(l_tax) > 0.01 FROM lineitem")
def select_variance(spark, d):
    names = ["l_discount", "l_quantity", "l_tax"]
    kept = preprocess.select_variance(read(spark, d, "lineitem"), names)
    return spark.createDataFrame([(n, n in kept) for n in names], "column_name string, kept boolean")


@query("SELECT 'l_quantity' AS column_name, true AS kept UNION ALL SELECT 'l_extendedprice', (SELECT abs(corr(l_quantity, l_extendedprice)) <= 0.5 FROM lineitem) UNION ALL SELECT 'l_tax', (SELECT abs(corr(l_quantity, l_tax)) <= 0.5 FROM lineitem)")
def select_correlation(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_tax"]
    kept = preprocess.select_uncorrelated(read(spark, d, "lineitem"), names, 0.5)
    return spark.createDataFrame([(n, n in kept) for n in names], "column_name string, kept boolean")


#: The operator multiplies each two of the first ten columns.
_PRODUCTS = ", ".join(f"round({a} * {b}, 6) + 0.0 AS {a}_x_{b}" for i, a in enumerate(FEATURES[:10]) for b in FEATURES[i + 1 : 10])


@query(f"WITH {POINTS} SELECT row_id, {_PRODUCTS} FROM p")
def interactions(spark, d):
    return rounded(preprocess.interactions(points(spark, d).drop("label"), FEATURES).drop(*FEATURES))


@query("SELECT 'l_quantity' AS column_name, round(1 / (1 - corr(l_quantity, l_extendedprice) ** 2), 4) AS vif FROM lineitem UNION ALL SELECT 'l_extendedprice', round(1 / (1 - corr(l_quantity, l_extendedprice) ** 2), 4) FROM lineitem")
def variance_inflation(spark, d):
    v = preprocess.vif(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(spark.createDataFrame(list(v.items()), "column_name string, vif double"), 4)


@query(
    f"""WITH {POINTS}, k AS (SELECT a.row_id AS id, {DIST} AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY {DIST}, b.row_id) AS r FROM p a JOIN p b ON a.row_id <> b.row_id), w AS (SELECT id, avg(d) AS w FROM k WHERE r <= 10 GROUP BY 1)
    SELECT id, {_r('w * count(*) OVER () / sum(w) OVER ()')} AS weight FROM w"""
)
def sample_weights(spark, d):
    return rounded(preprocess.sample_weights(points(spark, d), "row_id", FEATURES))


# Metrics

_PAIRS = CLEAN + f", d AS (SELECT a.row_id, a.label AS la, b.label AS lb, {DIST} AS d FROM q a JOIN q b ON a.label <> -1 AND b.label <> -1)"
_SIL = _PAIRS + """, m AS (SELECT row_id, la, lb, sum(d) AS s, count(*) AS n FROM d GROUP BY ALL), ab AS (SELECT row_id, la, max(CASE WHEN la = lb THEN s / (n - 1) END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM m GROUP BY ALL)"""


@query(f"WITH {_SIL} SELECT row_id AS id, la AS label, {_r('a')} AS a, {_r('b')} AS b, {_r('(b - a) / greatest(a, b)')} AS silhouette FROM ab")
def metric_silhouette_samples(spark, d):
    return rounded(metrics.silhouette_samples(noisy(spark, d), "row_id", "label", FEATURES))


@query(f"WITH {_SIL} SELECT {_r('avg((b - a) / greatest(a, b))')} AS silhouette FROM ab")
def metric_silhouette(spark, d):
    return rounded(metrics.silhouette(noisy(spark, d), "row_id", "label", FEATURES))


@query(
    f"""WITH {CENTRES}, e AS (SELECT a.label, ({DIST}) ** 2 AS d2 FROM q a JOIN c b USING (label)), s AS (SELECT label, count(*) AS n, avg(sqrt(d2)) AS r, sum(d2) AS w FROM e GROUP BY 1),
    g AS (SELECT a.label AS a, b.label AS b, {DIST} AS d FROM c a JOIN c b ON a.label <> b.label), db AS (SELECT a, max((x.r + y.r) / d) AS v FROM g JOIN s x ON x.label = a JOIN s y ON y.label = b GROUP BY 1),
    t AS (SELECT [{every('avg({f})')}] AS e FROM q WHERE label <> -1), bt AS (SELECT sum(c.n * list_distance(c.e, t.e) ** 2) AS ssb FROM c, t), z AS (SELECT sum(w) AS w, sum(n) AS n, count(*) AS k FROM s)
    SELECT {_r('(SELECT avg(v) FROM db)')} AS davies_bouldin, {_r('ssb / (k - 1) / (w / (n - k))', 4)} AS calinski_harabasz, {_r('w / (n * (SELECT min(d) FROM g) ** 2)', 4)} AS xie_beni, {_r('w', 4)} AS inertia FROM z, bt"""
)
def metric_centroids(spark, d):
    m = metrics.centroid_metrics(noisy(spark, d), "label", FEATURES)
    row = (round(m["davies_bouldin"], 6), round(m["calinski_harabasz"], 4), round(m["xie_beni"], 4), round(m["inertia"], 4))
    return spark.createDataFrame([row], "davies_bouldin double, calinski_harabasz double, xie_beni double, inertia double")


@query(f"WITH {_PAIRS} SELECT {_r('min(CASE WHEN la <> lb THEN d END) / max(CASE WHEN la = lb THEN d END)')} AS dunn FROM d")
def metric_dunn(spark, d):
    return rounded(metrics.dunn(noisy(spark, d), "row_id", "label", FEATURES))


@query(
    f"""WITH {CLEAN}, n AS (SELECT a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.row_id ORDER BY {DIST}, b.row_id) + 1 AS r FROM q a JOIN q b ON a.row_id <> b.row_id AND a.label <> -1 AND b.label <> -1)
    SELECT {_r('sum(CASE WHEN la <> lb THEN 1.0 / r ELSE 0 END)', 4)} AS connectivity FROM n WHERE r <= 10"""
)
def metric_connectivity(spark, d):
    return rounded(metrics.connectivity(noisy(spark, d), "row_id", "label", FEATURES), 4)


@query(
    f"""WITH {CENTRES}, e AS (SELECT a.label, {DIST} AS d FROM q a JOIN c b USING (label)), r AS (SELECT label, quantile_cont(d, .95) AS r FROM e GROUP BY 1)
    SELECT a.label AS a, b.label AS b, {_r(f'greatest(0, 1 - {DIST} / (x.r + y.r))')} AS overlap FROM c a JOIN c b ON a.label < b.label JOIN r x ON x.label = a.label JOIN r y ON y.label = b.label"""
)
def metric_overlap(spark, d):
    return rounded(metrics.overlap(noisy(spark, d), "label", FEATURES))


_AGREE = RUNS + """, x AS (SELECT a.run AS ra, b.run AS rb, a.label AS la, b.label AS lb, count(*)::DOUBLE AS n FROM runs a JOIN runs b ON a.row_id = b.row_id AND a.run < b.run WHERE a.label <> -1 AND b.label <> -1 GROUP BY ALL),
    r AS (SELECT ra, rb, sum(s * (s - 1) / 2) AS pa, sum(s * ln(s)) AS sl FROM (SELECT ra, rb, la, sum(n) AS s FROM x GROUP BY ALL) GROUP BY ALL), k AS (SELECT ra, rb, sum(s * (s - 1) / 2) AS pb, sum(s * ln(s)) AS tl, sum(m) AS best FROM (SELECT ra, rb, lb, sum(n) AS s, max(n) AS m FROM x GROUP BY ALL) GROUP BY ALL),
    t AS (SELECT ra, rb, sum(n) AS n, sum(n * (n - 1) / 2) AS pp, sum(n * ln(n)) AS nl FROM x GROUP BY ALL),
    j AS (SELECT *, pa * pb / (n * (n - 1) / 2) AS ex, ln(n) - sl / n AS ha, ln(n) - tl / n AS hb, greatest(ln(n) + (nl - sl - tl) / n, 0) AS mi FROM t JOIN r USING (ra, rb) JOIN k USING (ra, rb))"""


@query(
    f"""WITH {_AGREE} SELECT ra, rb, {_r('(pp - ex) / ((pa + pb) / 2 - ex)')} AS ari, {_r('2 * mi / (ha + hb)')} AS nmi, {_r('mi / ha')} AS homogeneity, {_r('mi / hb')} AS completeness,
    {_r('2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb)')} AS v_measure, {_r('pp / sqrt(pa * pb)')} AS fmi, {_r('best / n')} AS purity FROM j"""
)
def agreement_matrix(spark, d):
    return rounded(agreement.scores(agreement.all_contingencies(runs(spark, d)), ["ra", "rb"]))


_CELLS = RUNS + ", x AS (SELECT a.label AS la, b.label AS lb, count(*) AS n FROM runs a JOIN runs b USING (row_id) WHERE a.run = 'r1' AND b.run = 'r4' AND a.label <> -1 AND b.label <> -1 GROUP BY ALL), u AS (SELECT la, lb, n / (sum(n) OVER (PARTITION BY la) + sum(n) OVER (PARTITION BY lb) - n) AS jaccard FROM x)"


def _cells(spark, d):
    r = runs(spark, d)
    return agreement.contingency(r.where("run = 'r1'"), r.where("run = 'r4'"))


@query(f"WITH {_CELLS} SELECT la AS label, {_r('jaccard')} AS jaccard FROM u WHERE la = lb")
def cluster_jaccard(spark, d):
    return rounded(agreement.cluster_jaccard(_cells(spark, d)))


@query(f"WITH {_CELLS} SELECT la, lb, {_r('jaccard')} AS jaccard, CASE WHEN jaccard >= 0.5 THEN 'recovered' WHEN jaccard >= 0.25 THEN 'partial' ELSE 'lost' END AS state FROM u QUALIFY row_number() OVER (PARTITION BY la ORDER BY jaccard DESC, lb) = 1")
def cluster_map(spark, d):
    return rounded(agreement.recovered(_cells(spark, d)))


_METRICS = "m AS (SELECT event_type AS algorithm_id, 'silhouette' AS metric, avg(value) / 100 AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'davies_bouldin', stddev_pop(value) / 10 FROM events GROUP BY 1 UNION ALL SELECT event_type, 'calinski_harabasz', sum(value) / 100 FROM events GROUP BY 1)"


def _metrics(spark, d):
    e = read(spark, d, "events").groupBy(F.col("event_type").alias("algorithm_id")).agg((F.avg("value") / 100).alias("silhouette"), (F.stddev_pop("value") / 10).alias("davies_bouldin"), (F.sum("value") / 100).alias("calinski_harabasz"))
    return e


@query(
    f"""WITH {_METRICS}, w AS (SELECT algorithm_id, max(CASE metric WHEN 'silhouette' THEN value END) AS a, max(CASE metric WHEN 'davies_bouldin' THEN value END) AS b FROM m GROUP BY 1)
    SELECT algorithm_id FROM w p WHERE NOT EXISTS (SELECT 1 FROM w q WHERE q.a >= p.a AND q.b <= p.b AND (q.a > p.a OR q.b < p.b))"""
)
def pareto_front(spark, d):
    return metrics.pareto(_metrics(spark, d), "algorithm_id", ["silhouette"], ["davies_bouldin"]).select("algorithm_id")


# Consensus and stability

_CO = RUNS + ", co AS (SELECT a.row_id AS i, b.row_id AS j, count(*) / 5.0 AS c FROM runs a JOIN runs b ON a.run = b.run AND a.label = b.label AND a.row_id < b.row_id WHERE a.label <> -1 GROUP BY ALL)"


@query(f"WITH {_CO} SELECT i, j, {_r('c')} AS c FROM co WHERE c > 0.5")
def coassociation(spark, d):
    return rounded(consensus.coassociation(runs(spark, d)).where("c > 0.5"))


@query(f"WITH {_CO}, n AS (SELECT count(*) * (count(*) - 1) / 2 AS n FROM p) SELECT {_r('count(*) FILTER (c > 0.1 AND c < 0.9) / (SELECT n FROM n)')} AS pac FROM co")
def consensus_pac(spark, d):
    r = runs(spark, d)
    n = r.select("row_id").distinct().count()
    return rounded(consensus.pac(consensus.pair_histogram(r), n * (n - 1) // 2))


@query(
    f"""WITH {_CO}, n AS (SELECT count(*) * (count(*) - 1) / 2 AS n FROM p), b AS (SELECT CAST(least(floor(c * 10 + 1e-9), 9) AS INTEGER) AS bin, count(*) AS m FROM co GROUP BY 1)
    SELECT bin, {_r('(sum(m) OVER (ORDER BY bin) + n - sum(m) OVER ()) / n')} AS cdf FROM b, n"""
)
def consensus_cdf(spark, d):
    r = runs(spark, d)
    n = r.select("row_id").distinct().count()
    return rounded(consensus.consensus_cdf(consensus.pair_histogram(r), n * (n - 1) // 2))


@query(
    f"""WITH {_CO}, bo AS (SELECT i, j, c FROM co UNION ALL SELECT j, i, c FROM co), s AS (SELECT x.row_id, any_value(x.label) AS label, sum(c) AS s FROM p x JOIN bo ON bo.i = x.row_id JOIN p y ON bo.j = y.row_id AND x.label = y.label GROUP BY 1), z AS (SELECT label, count(*) AS n FROM p GROUP BY 1)
    SELECT p.row_id, p.label, {_r('CASE WHEN n > 1 THEN coalesce(s, 0) / (n - 1) ELSE 1 END')} AS consensus FROM p JOIN z USING (label) LEFT JOIN s ON s.row_id = p.row_id"""
)
def item_consensus(spark, d):
    return rounded(consensus.item_consensus(runs(spark, d), points(spark, d).select("row_id", "label")))


@query(
    f"""WITH {_CO}, bo AS (SELECT i, c FROM co UNION ALL SELECT j, c FROM co UNION ALL SELECT row_id, 1.0 FROM p), s AS (SELECT i, sum(c) AS s, sum(c * log2(c)) AS l FROM bo GROUP BY 1)
    SELECT i AS row_id, {_r('(log2(s) - l / s) / log2((SELECT count(*) FROM p))')} AS uncertainty, (log2(s) - l / s) / log2((SELECT count(*) FROM p)) > 0.85 AS uncertain FROM s WHERE i IN (SELECT i FROM co UNION SELECT j FROM co)"""
)
def consensus_uncertainty(spark, d):
    r = runs(spark, d)
    return rounded(consensus.uncertainty(r, r.select("row_id").distinct().count()))


_VOTES = RUNS + ", v AS (SELECT row_id, label, count(*) AS n FROM runs GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY row_id) AS m, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, label) AS r FROM v)"


@query(f"WITH {_VOTES} SELECT row_id, CAST(CASE WHEN n / m >= 0.6 THEN label ELSE -2 END AS INTEGER) AS label, {_r('n / m')} AS support FROM t WHERE r = 1")
def stability_consensus(spark, d):
    return rounded(consensus.majority(runs(spark, d), 0.6))


@query(f"WITH {_VOTES} SELECT row_id, CAST(CASE WHEN n / m < 0.5 THEN -1 ELSE label END AS INTEGER) AS label, {_r('n / m')} AS confidence FROM t WHERE r = 1")
def evidence_majority(spark, d):
    return rounded(consensus.evidence_majority(runs(spark, d)))


@query(f"WITH {RUNS}, v AS (SELECT row_id, label, count(*) AS n FROM runs WHERE label <> -1 GROUP BY ALL) SELECT row_id, CAST(label AS INTEGER) AS label FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, label) = 1")
def consensus_voting(spark, d):
    return consensus.voting(runs(spark, d))


@query(f"WITH {RUNS}, s AS (SELECT run, count(*) FILTER (label <> -1) / 100.0 AS x FROM runs GROUP BY run), e AS (SELECT run, exp(x - max(x) OVER ()) AS e FROM s), w AS (SELECT run, greatest(e / sum(e) OVER (), 0.001) AS w FROM e) SELECT run, {_r('w / sum(w) OVER ()')} AS weight FROM w")
def softmax_weights(spark, d):
    s = runs(spark, d).groupBy("run").agg((F.count_if(F.col("label") != -1) / 100.0).alias("composite"))
    return rounded(consensus.softmax_weights(s))


@query(
    f"""WITH {_AGREE}, a AS (SELECT avg(1 - greatest((pp - ex) / ((pa + pb) / 2 - ex), 0)) AS d FROM j), k2 AS (SELECT var_pop(k) AS v FROM (SELECT run, count(DISTINCT label) AS k FROM runs WHERE label <> -1 GROUP BY 1)) SELECT {_r('d * 0.6 + least(v / 20, 0.4)')} AS diversity FROM a, k2"""
)
def ensemble_diversity(spark, d):
    return rounded(consensus.diversity(runs(spark, d)))


_CONF = RUNS + ", x AS (SELECT b.run, a.label AS la, b.label AS lb, count(*) AS n FROM runs a JOIN runs b USING (row_id) WHERE a.run = 'r0' AND a.label <> -1 AND b.label <> -1 GROUP BY ALL), u AS (SELECT run, la, lb, n / (sum(n) OVER (PARTITION BY run, la) + sum(n) OVER (PARTITION BY run, lb) - n) AS j FROM x), m AS (SELECT run, la, max(j) AS j FROM u GROUP BY ALL)"


@query(f"WITH {_CONF}, c AS (SELECT la AS label, avg(j) AS confidence FROM m GROUP BY 1) SELECT label, {_r('confidence')} AS confidence, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS grade FROM c")
def cluster_confidence(spark, d):
    r = runs(spark, d)
    return rounded(consensus.cluster_confidence(r.where("run = 'r0'").select("row_id", "label"), r))


@query(f"WITH {_CONF} SELECT la, {_r('avg(j)')} AS mean_jaccard, {_r('stddev_pop(j)')} AS std_jaccard, {_r('avg((j >= 0.6)::INT)')} AS survival FROM m GROUP BY la")
def cluster_persistence(spark, d):
    r = runs(spark, d)
    a = r.where("run = 'r0' AND label <> -1").select("row_id", F.col("label").alias("la"))
    b = r.where("label <> -1").select("row_id", "run", F.col("label").alias("lb"))
    return rounded(stability.persistence(a.join(b, "row_id").groupBy("run", "la", "lb").agg(F.count(F.lit(1)).alias("n"))))


@query(f"WITH {RUNS}, x AS (SELECT a.label AS la, b.label AS lb, count(*) AS n FROM runs a JOIN runs b USING (row_id) WHERE a.run = 'r0' AND b.run = 'r1' GROUP BY ALL) SELECT la, {_r('1 - max(n) / sum(n)')} AS rate FROM x GROUP BY la")
def migration_rate(spark, d):
    return rounded(stability.migration(runs(spark, d), "r0", "r1"))


_REGIME = "g AS (SELECT event_type AS kind, value / 20 AS ari, value / 25 AS ami, value / 22 AS nmi, CAST(user_id % 5 AS DOUBLE) / 10 AS level FROM events)"


def _regime(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select(F.col("event_type").alias("kind"), (v / 20).alias("ari"), (v / 25).alias("ami"), (v / 22).alias("nmi"), ((F.col("user_id") % 5).cast("double") / 10).alias("level"), (v / 30).alias("jaccard"))


@query(f"WITH {_REGIME} SELECT kind, round(avg(ari), 4) AS mean_ari, round(avg(ami), 4) AS mean_ami, round(avg(nmi), 4) AS mean_nmi, count(*) AS n FROM g GROUP BY 1")
def stability_by_regime(spark, d):
    return stability.by_regime(_regime(spark, d))


@query(
    f"""WITH {_REGIME}, m AS (SELECT level, avg(ari) AS ari FROM g GROUP BY 1), s AS (SELECT level, ari, (level - lag(level) OVER w) * (ari + lag(ari) OVER w) / 2 AS a, first(ari) OVER w AS z FROM m WINDOW w AS (ORDER BY level))
    SELECT {_r('sum(a)')} AS auc, min(CASE WHEN ari < z / 2 THEN level END) AS half_level FROM s"""
)
def noise_response(spark, d):
    return rounded(stability.noise_response(_regime(spark, d)))


@query("WITH g AS (SELECT value / 20 AS ari, value / 25 AS ami, value / 30 AS j FROM events), s AS (SELECT avg(ari) AS a, stddev_pop(ari) AS d, avg(ami) AS m, avg(j) AS p FROM g), t AS (SELECT *, 40 * greatest(a, 0) + 15 * greatest(1 - 3 * d, 0) + 25 * greatest(m, 0) + 20 * p AS score FROM s) SELECT round(a, 6) AS mean_ari, round(d, 6) AS std_ari, round(m, 6) AS mean_ami, round(p, 6) AS persistence, round(score, 6) AS score, CASE WHEN score >= 80 THEN 'Highly Stable' WHEN score >= 65 THEN 'Stable' WHEN score >= 45 THEN 'Moderately Stable' WHEN score >= 25 THEN 'Unstable' ELSE 'Highly Unstable' END AS grade FROM t")
def stability_score(spark, d):
    return rounded(stability.stability_score(_regime(spark, d)))


@query(f"WITH {POINTS} SELECT row_id FROM p WHERE {_u('row_id', 'subset3')} < 0.8")
def perturb_subset(spark, d):
    return stability.perturb(points(spark, d), "row_id", FEATURES, "subset", 0.8, 3).select("row_id")


def _noise(f: str) -> str:
    u, v = _u("row_id", f"gaussian1{f}a"), _u("row_id", f"gaussian1{f}b")
    return _r(f"{f} + 0.1 * d{f} * (sqrt(-2 * ln(greatest({u}, 1e-12))) * cos(2 * 3.141592653589793 * {v}))") + f" AS {f}"


@query(f"WITH {POINTS}, s AS (SELECT {every('stddev_pop({f}) AS d{f}')} FROM p) SELECT row_id, {', '.join(map(_noise, FEATURES))} FROM p, s")
def perturb_gaussian(spark, d):
    return rounded(stability.perturb(points(spark, d).drop("label"), "row_id", FEATURES, "gaussian", 0.1, 1))


@query(f"SELECT c_custkey, {_r(_u('c_custkey', '7'))} AS u FROM customer")
def hashed_uniform(spark, d):
    return rounded(read(spark, d, "customer").select("c_custkey", hash_uniform(F.col("c_custkey"), 7).alias("u")))


# Whole fits: what they converge to depends on seeds and sums, so rows are checked by tests and not by SQL.


def _fit(name: str, **params):
    def run(spark, d):
        from .registry import REGISTRY

        a = REGISTRY[name]
        return a.fit(points(spark, d), "row_id", FEATURES, **{**a.defaults, **params}).select(F.col("id").alias("row_id"), "label")

    run.__name__ = f"fit_{name}"
    query()(run)


for _name in (
    "kmeans kmeans_pp minibatch_kmeans bisecting_kmeans repeated_bisecting kmedoids clara k_harmonic_means agglomerative_ward agglomerative_complete agglomerative_average agglomerative_single diana_divisive "
    "gmm_full gmm_tied gmm_diag gmm_spherical spectral_kmeans spectral_discretize spectral_cluster_qr sparse_spectral spectral_biclustering spectral_coclustering projected_kmeans autoencoder_kmeans isomap_kmeans "
    "lle_kmeans fuzzy_cmeans possibilistic_cmeans ensemble_voting random_subspace_ensemble online_gmm"
).split():
    _fit(_name, k=5)
for _name, _params in {
    "kmeans_auto": {"k_max": 8}, "xmeans": {"k_max": 8}, "gmeans": {"k_max": 8}, "dip_means": {"k_max": 6}, "birch": {"threshold": 0.5, "k": 5}, "optics": {}, "hdbscan": {}, "mean_shift": {}, "denclue": {"h": 0.78},
    "bgmm": {"k": 6}, "affinity_propagation": {"preference": -4.0}, "som_clustering": {"rounds": 5}, "umap_hdbscan": {}, "robust_cc": {}, "clique_subspace": {"share": 0.1}, "sting_grid": {"cells": 6, "share": 0.01},
}.items():
    _fit(_name, **_params)


# Density clustering has one right answer.

_EPS = POINTS + f""", e AS (SELECT a.row_id AS i, b.row_id AS j FROM p a JOIN p b ON {DIST} <= 1.17), core AS (SELECT i FROM e GROUP BY 1 HAVING count(*) >= 5),
  ce AS (SELECT i, j FROM e WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
  reach(i, c) AS (SELECT i, i FROM core UNION SELECT ce.j, reach.c FROM reach JOIN ce ON ce.i = reach.i), comp AS (SELECT i, min(c) AS c FROM reach GROUP BY 1),
  lab AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS label FROM (SELECT DISTINCT c FROM comp)),
  bord AS (SELECT e.i, min(c) AS c FROM e JOIN comp ON e.j = comp.i WHERE e.i NOT IN (SELECT i FROM core) GROUP BY 1), al AS (SELECT * FROM comp UNION ALL SELECT * FROM bord)"""


@query(f"WITH RECURSIVE {_EPS} SELECT p.row_id, CAST(coalesce(lab.label, -1) AS INTEGER) AS label FROM p LEFT JOIN al ON al.i = p.row_id LEFT JOIN lab ON lab.c = al.c")
def fit_dbscan(spark, d):
    from ..operators import clustering

    return clustering.dbscan(points(spark, d), "row_id", FEATURES, 1.17, 5).select(F.col("id").alias("row_id"), "label")


@query(
    f"""WITH RECURSIVE {POINTS}, e AS (SELECT a.row_id AS i, b.row_id AS j FROM p a JOIN p b ON {DIST} <= 1.08), reach(i, c) AS (SELECT row_id, row_id FROM p UNION SELECT e.j, reach.c FROM reach JOIN e ON e.i = reach.i),
    comp AS (SELECT i, min(c) AS c FROM reach GROUP BY 1), lab AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS label FROM (SELECT DISTINCT c FROM comp)) SELECT i AS row_id, CAST(label AS INTEGER) AS label FROM comp JOIN lab USING (c)"""
)
def fit_threshold_clustering(spark, d):
    from ..operators import clustering

    return clustering.threshold_clustering(points(spark, d), "row_id", FEATURES, 1.08).select(F.col("id").alias("row_id"), "label")


@query(f"WITH {POINTS} SELECT a.row_id AS id, {_r(f'avg(exp(-1 * ({DIST}) ** 2 / 0.5))')} AS density FROM p a CROSS JOIN p b GROUP BY 1")
def kernel_density(spark, d):
    from ..operators import clustering

    return rounded(clustering.kernel_density(points(spark, d), "row_id", FEATURES, 0.5))


@query(
    f"""WITH {CENTRES}, d AS (SELECT a.* EXCLUDE (label), b.label, row_number() OVER (PARTITION BY a.row_id ORDER BY {DIST}, b.label) AS r FROM p a CROSS JOIN c b)
    SELECT label, count(*) AS n, {every('round(avg({f}), 6) + 0.0 AS {f}')} FROM d WHERE r = 1 GROUP BY label"""
)
def kmeans_step(spark, d):
    centres = distances.centroid_array(noisy(spark, d), "label", FEATURES)
    near = distances.nearest_centroid(points(spark, d), centres, FEATURES, "label", "_d")
    return rounded(near.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in FEATURES]))


def _centre_frame(spark, labels, centres):
    return spark.createDataFrame([(int(k), *map(float, v)) for k, v in zip(labels, centres, strict=True)], "label int, " + every("{f} double"))


@query(
    f"""WITH {CENTRES}, m AS (SELECT a.row_id, b.label, 1 / ({DIST}) ** 2 AS u, a.* EXCLUDE (label, row_id) FROM p a CROSS JOIN c b), w AS (SELECT *, (u / sum(u) OVER (PARTITION BY row_id)) ** 2 AS w FROM m)
    SELECT label, {every('round(sum(w * {f}) / sum(w), 6) + 0.0 AS {f}')} FROM w GROUP BY label"""
)
def fuzzy_step(spark, d):
    import numpy as np

    from ..operators import clustering

    centres = distances.centroid_array(noisy(spark, d), "label", FEATURES)
    new = clustering.fuzzy_step(points(spark, d), FEATURES, np.array([c for _, c in centres]))
    return rounded(_centre_frame(spark, [k for k, _ in centres], new))


@query(
    f"""WITH {CENTRES}, d AS (SELECT a.* EXCLUDE (label), b.label, row_number() OVER (PARTITION BY a.row_id ORDER BY {DIST}, b.label) AS r FROM p a CROSS JOIN c b)
    SELECT label, {every('round(avg({f}), 6) + 0.0 AS {f}')} FROM d WHERE r = 1 GROUP BY label"""
)
def federated_step(spark, d):
    import numpy as np

    from ..operators import clustering

    centres = distances.centroid_array(noisy(spark, d), "label", FEATURES)
    rows = points(spark, d).withColumn("client", F.col("row_id") % 3)
    new = clustering.federated_kmeans(rows, "client", FEATURES, np.array([c for _, c in centres]), rounds=1)
    return rounded(_centre_frame(spark, [k for k, _ in centres], new))


# The other modules of queries register themselves here.
from . import fit_queries, quality_queries  # noqa: E402, F401
