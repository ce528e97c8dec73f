"""Queries over distances, partitions, samples and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.operators import gower, metrics, neighbours, sampling
from tenderloom.plans.domain import Domain, hash32
from tenderloom.plans.matrix_jobs import rounded
from tenderloom.plans.registry import job
from tenderloom.plans.sql import PAIR_DISTANCE, sql

LABELS = [0, 1, 2, 3, 4]
MEDOIDS = [
    {"cluster": 0, "u_log_budget": 0.40, "u_km": 0.05, "u_n_items": 0.05, "u_acctbal": 0.05, "modality": "Otros"},
    {"cluster": 1, "u_log_budget": 0.45, "u_km": 0.12, "u_n_items": 0.08, "u_acctbal": 0.12, "modality": "Catalogo Electronico"},
    {"cluster": 2, "u_log_budget": 0.48, "u_km": 0.18, "u_n_items": 0.02, "u_acctbal": 0.20, "modality": "Otros"},
]
_MEDOID_SQL = " UNION ALL ".join(
    f"SELECT {m['cluster']} AS m, {m['u_log_budget']} AS u1, {m['u_km']} AS u2, {m['u_n_items']} AS u3, {m['u_acctbal']} AS u4, '{m['modality']}' AS modality"
    for m in MEDOIDS
)
SIL = {
    "d_real": "SELECT * FROM d_axes WHERE cluster <> -1",
    "d_tot": f"SELECT a.ocid, a.cluster, b.cluster AS other, sum({PAIR_DISTANCE}) AS s, count(*) AS n FROM d_real a, d_real b GROUP BY 1, 2, 3",
    "d_sil": """SELECT ocid, cluster, a, b, CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM (
        SELECT ocid, cluster, max(CASE WHEN other = cluster THEN n END) AS size, max(CASE WHEN other = cluster AND n > 1 THEN s / (n - 1) END) AS a,
        min(CASE WHEN other <> cluster THEN s / n END) AS b FROM d_tot GROUP BY 1, 2)""",
}


@job("gower_medoid_assign", sql("""SELECT ocid, m AS cluster, round(d, 6) AS distance FROM (SELECT ocid, m, d, row_number() OVER (PARTITION BY ocid ORDER BY d, m) AS r FROM (
     SELECT a.ocid, b.m, """ + PAIR_DISTANCE + f""" AS d FROM d_axes a, ({_MEDOID_SQL}) b)) WHERE r = 1"""))
def gower_medoid_assign(d: Domain) -> DataFrame:
    """Nearest of the fixed references under the mixed distance, without a shuffle."""
    near = gower.nearest_reference(d.framed().drop("cluster"), MEDOIDS, d.FRAME_AXES, "modality", d.FRAME_PENALTY)
    return rounded(near, ["ocid", "cluster"], ["distance"])


@job("silhouette_rows", sql("SELECT ocid, cluster, round(a, 6) AS a, round(b, 6) AS b, round(silhouette, 6) AS silhouette FROM d_sil", **SIL))
def silhouette_rows(d: Domain) -> DataFrame:
    """Per-row silhouette from running sums; noise has none."""
    rows = gower.silhouette_rows(d.framed(True), [], "ocid", "cluster", LABELS, **d.frame_options())
    return rounded(rows, ["ocid", "cluster"], ["a", "b", "silhouette"])


@job("silhouette_gower", sql("""SELECT 5 AS groups, round(100.0 * (SELECT avg((cluster = -1)::INT) FROM d_axes), 6) AS noise_pct, round(avg(silhouette), 8) AS silhouette FROM d_sil""", **SIL))
def silhouette_gower(d: Domain) -> DataFrame:
    """The arbiter silhouette of a partition."""
    s = gower.silhouette(d.framed(True), [], "ocid", "cluster", LABELS, **d.frame_options())
    return s.select("groups", F.round("noise_pct", 6).alias("noise_pct"), F.round("silhouette", 8).alias("silhouette"))


@job("dispersion_within", sql("SELECT round(sum(w), 4) AS dispersion FROM (SELECT cluster, sum(s) / (2 * any_value(n)) AS w FROM d_tot WHERE other = cluster GROUP BY 1)", **SIL))
def dispersion_within(d: Domain) -> DataFrame:
    return rounded(gower.dispersion_within(d.framed(True), [], "ocid", "cluster", **d.frame_options()), [], ["dispersion"], 4)


@job("group_mean_distances", sql("SELECT cluster, other, round(sum(s) / (any_value(n) * count(*)), 6) AS mean_distance FROM d_tot GROUP BY 1, 2", **SIL))
def group_mean_distances(d: Domain) -> DataFrame:
    """Mean distance between every two groups in one aggregation."""
    rows = d.framed(True).filter(F.col("cluster") != -1)
    table = gower.between_groups(rows, "cluster", len(LABELS), d.FRAME_AXES, "modality", d.FRAME_PENALTY)
    mean = F.col("total") / (F.col("size_a") * F.col("size_b"))
    return table.select(F.col("a").alias("cluster"), F.col("b").alias("other"), F.round(mean, 6).alias("mean_distance"))


_CENT = {
    "d_real": "SELECT * FROM d_axes WHERE cluster <> -1",
    "d_cen": "SELECT cluster, count(*) AS n, avg(u1) AS m1, avg(u2) AS m2, avg(u3) AS m3, avg(u4) AS m4 FROM d_real GROUP BY 1",
    "d_spread": "SELECT cluster, avg(sqrt(pow(u1 - m1, 2) + pow(u2 - m2, 2) + pow(u3 - m3, 2) + pow(u4 - m4, 2))) AS s FROM d_real JOIN d_cen USING (cluster) GROUP BY 1",
}


@job("davies_bouldin", sql("""SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT a.cluster, max((sa.s + sb.s) /
     sqrt(pow(a.m1 - b.m1, 2) + pow(a.m2 - b.m2, 2) + pow(a.m3 - b.m3, 2) + pow(a.m4 - b.m4, 2))) AS w
     FROM d_cen a JOIN d_cen b ON a.cluster <> b.cluster JOIN d_spread sa ON sa.cluster = a.cluster JOIN d_spread sb ON sb.cluster = b.cluster GROUP BY 1)""", **_CENT))
def davies_bouldin(d: Domain) -> DataFrame:
    return rounded(metrics.davies_bouldin(d.framed(True), [], "cluster", d.FRAME_AXES), [], ["davies_bouldin"])


@job("calinski_harabasz", sql("""SELECT round(b / 4.0 / (w / (n - 5)), 5) AS calinski_harabasz FROM (
     SELECT sum(c.n * (pow(m1 - a1, 2) + pow(m2 - a2, 2) + pow(m3 - a3, 2) + pow(m4 - a4, 2))) AS b FROM d_cen c,
       (SELECT avg(u1) AS a1, avg(u2) AS a2, avg(u3) AS a3, avg(u4) AS a4 FROM d_real)),
     (SELECT sum(pow(u1 - m1, 2) + pow(u2 - m2, 2) + pow(u3 - m3, 2) + pow(u4 - m4, 2)) AS w, count(*) AS n FROM d_real JOIN d_cen USING (cluster))""", **_CENT))
def calinski_harabasz(d: Domain) -> DataFrame:
    return rounded(metrics.calinski_harabasz(d.framed(True), [], "cluster", d.FRAME_AXES), [], ["calinski_harabasz"], 5)


@job("coverage", sql("SELECT round(100.0 * avg((cluster <> -1)::INT), 6) AS coverage FROM d_noisy"))
def coverage(d: Domain) -> DataFrame:
    return rounded(metrics.coverage(d.frame(True), [], "cluster"), [], ["coverage"])


_SIZES = {"d_size": "SELECT cluster, count(*) AS n, count(*) / (sum(count(*)) OVER ()) AS p FROM d_noisy WHERE cluster <> -1 GROUP BY 1"}


@job("size_entropy", sql("SELECT count(*) AS groups, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy FROM d_size", **_SIZES))
def size_entropy(d: Domain) -> DataFrame:
    return rounded(metrics.size_entropy(d.frame(True), [], "cluster"), ["groups"], ["entropy"])


@job("partition_balance", sql("""SELECT count(*) AS groups, round(100 * max(p), 1) AS largest_pct, round(100 * sum(p) FILTER (r <= 2), 1) AS two_largest_pct,
     min(n) AS smallest, count(*) FILTER (p < 0.01) AS groups_below_1pct, round(-sum(p * ln(p)) / ln(count(*)), 3) AS entropy
     FROM (SELECT *, row_number() OVER (ORDER BY n DESC, cluster) AS r FROM d_size)""", **_SIZES))
def partition_balance(d: Domain) -> DataFrame:
    return metrics.partition_balance(d.frame(True), [], "cluster")


@job("adjusted_rand", sql("""SELECT round((s - a * b / t) / ((a + b) / 2 - a * b / t), 8) AS ari FROM
     (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT count(*) AS n FROM d_noisy WHERE cluster <> -1 GROUP BY cluster, modality)),
     (SELECT sum(n * (n - 1) / 2.0) AS a FROM (SELECT count(*) AS n FROM d_noisy WHERE cluster <> -1 GROUP BY cluster)),
     (SELECT sum(n * (n - 1) / 2.0) AS b FROM (SELECT count(*) AS n FROM d_noisy WHERE cluster <> -1 GROUP BY modality)),
     (SELECT count(*) * (count(*) - 1) / 2.0 AS t FROM d_noisy WHERE cluster <> -1)"""))
def adjusted_rand(d: Domain) -> DataFrame:
    """Agreement of a partition with the modality."""
    return rounded(metrics.adjusted_rand(d.frame(True), [], "cluster", "modality"), [], ["ari"], 8)


_SAMPLE = {"d_smp": "SELECT * FROM d_axes ORDER BY (ocid * 2654435761) % 4294967296, ocid LIMIT 1000"}


@job("fixed_size_sample", sql("SELECT ocid FROM d_smp", **_SAMPLE))
def fixed_size_sample(d: Domain) -> DataFrame:
    """A thousand open tenders by hash order."""
    return sampling.fixed_size(d.frame(), "ocid", 1000, hashed=hash32(F.col("ocid"))).select("ocid")


@job("share_sample", sql(" UNION ALL ".join(f"SELECT {r} AS repeat, count(*) AS n, sum(ocid) AS ids FROM d_tender WHERE ((ocid * 2654435761 + {r * 40503}) % 4294967296) % 100 < 80" for r in range(3))))
def share_sample(d: Domain) -> DataFrame:
    """Three repeats of an 80 % subsample."""
    rows = d.tenders()
    parts = [
        sampling.share(rows, "ocid", r, hashed=hash32(F.col("ocid"), r)).agg(
            F.lit(r).alias("repeat"), F.count("*").alias("n"), F.sum("ocid").alias("ids")
        )
        for r in range(3)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@job("stratified_sample", sql("""SELECT ocid, cluster FROM (SELECT f.ocid, f.cluster, row_number() OVER (PARTITION BY f.cluster ORDER BY (f.ocid * 2654435761) % 4294967296, f.ocid) AS r, q
     FROM d_noisy f JOIN (SELECT cluster, least(greatest(round(500.0 * count(*) / (sum(count(*)) OVER ())), 60), count(*)) AS q FROM d_noisy GROUP BY 1) s USING (cluster)) WHERE r <= q"""))
def stratified_sample(d: Domain) -> DataFrame:
    """About 500 tenders by group share, at least 60 of each group."""
    return sampling.stratified(d.frame(True), "cluster", "ocid", 500, 60, hashed=hash32(F.col("ocid"))).select("ocid", "cluster")


@job("random_labels", sql(" UNION ALL ".join(f"SELECT {k} AS k, ((ocid * 2654435761 + {k * 40503}) % 4294967296) % {k} AS cluster, count(*) AS n FROM d_tender GROUP BY 2" for k in range(2, 21))))
def random_labels(d: Domain) -> DataFrame:
    """Group sizes of uniform random labels for 2 to 20 groups."""
    labelled = d.tenders().select("ocid", F.explode(F.sequence(F.lit(2), F.lit(20))).alias("k"))
    value = F.pmod(F.col("ocid") * F.lit(2654435761) + F.col("k") * F.lit(40503), F.lit(4294967296))
    return labelled.withColumn("cluster", F.pmod(value, F.col("k"))).groupBy("k", "cluster").agg(F.count("*").alias("n"))


@job("knn_distance", sql(f"""SELECT ocid AS id, round(d, 6) AS distance FROM (SELECT a.ocid, {PAIR_DISTANCE} AS d, row_number() OVER (PARTITION BY a.ocid ORDER BY {PAIR_DISTANCE}, b.ocid) AS r
     FROM d_smp a JOIN d_smp b ON a.ocid <> b.ocid) WHERE r = 10""", **_SAMPLE))
def knn_distance(d: Domain) -> DataFrame:
    """Tenth-neighbour distance over the declared sample."""
    sample = sampling.fixed_size(d.framed(), "ocid", 1000, hashed=hash32(F.col("ocid")))
    return rounded(neighbours.knn_distance(neighbours.sample_pairs(sample, "ocid", **d.frame_options())), ["id"], ["distance"])


@job("eps_candidates", sql(f"""SELECT round(quantile_cont(d, 0.05), 6) AS p5, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.15), 6) AS p15,
     round(quantile_cont(d, 0.2), 6) AS p20 FROM (SELECT a.ocid, {PAIR_DISTANCE} AS d, row_number() OVER (PARTITION BY a.ocid ORDER BY {PAIR_DISTANCE}, b.ocid) AS r
     FROM d_smp a JOIN d_smp b ON a.ocid <> b.ocid) WHERE r = 10""", **_SAMPLE))
def eps_candidates(d: Domain) -> DataFrame:
    """Radii for the density family."""
    sample = sampling.fixed_size(d.framed(), "ocid", 1000, hashed=hash32(F.col("ocid")))
    knn = neighbours.knn_distance(neighbours.sample_pairs(sample, "ocid", **d.frame_options()))
    return rounded(neighbours.eps_candidates(knn), [], ["p5", "p10", "p15", "p20"])


_TENTH = f"""(SELECT a.ocid, {PAIR_DISTANCE} AS d, row_number() OVER (PARTITION BY a.ocid ORDER BY {PAIR_DISTANCE}, b.ocid) AS r
     FROM d_axes a JOIN d_axes b ON a.ocid <> b.ocid"""


@job("knn_distance_all", sql(f"SELECT ocid AS id, round(d, 6) AS distance FROM {_TENTH} WHERE a.ocid % 50 = 0) WHERE r = 10"))
def knn_distance_all(d: Domain) -> DataFrame:
    """Tenth-neighbour distance over all open tenders, of every fiftieth id."""
    knn = neighbours.kth_distance(d.framed(), "ocid", 10, **d.frame_options())
    return rounded(knn.filter("id % 50 = 0"), ["id"], ["distance"])


@job("eps_candidates_all", sql(f"""SELECT round(quantile_cont(d, 0.05), 6) AS p5, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.15), 6) AS p15,
     round(quantile_cont(d, 0.2), 6) AS p20 FROM {_TENTH}) WHERE r = 10"""))
def eps_candidates_all(d: Domain) -> DataFrame:
    """Radii for the density family, from all open tenders."""
    knn = neighbours.kth_distance(d.framed(), "ocid", 10, **d.frame_options())
    return rounded(neighbours.eps_candidates(knn), [], ["p5", "p10", "p15", "p20"])
