"""Queries over model-selection reports.

The report rows (algorithm, k, supplier and partition metrics) are aggregates over all
orders, shaped like a comparison run: priorities stand for algorithms, years for k and
market segments for suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.text import after_marker
from tenderloom.operators import gower, metrics, prepare, sampling, selection
from tenderloom.plans.domain import Domain, hash32
from tenderloom.plans.matrix_jobs import rounded
from tenderloom.plans.metric_jobs import LABELS
from tenderloom.plans.registry import job
from tenderloom.plans.sql import PAIR_DISTANCE, sql

ALGORITHM = {"1-URGENT": "kprototypes", "2-HIGH": "kmeans", "3-MEDIUM": "hierarchical", "4-NOT SPECIFIED": "kmedoids", "5-LOW": "density"}
SUPPLIERS = 5
_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{a}'" for p, a in ALGORITHM.items()) + " END"
_METRICS = """CASE WHEN count(*) % 13 <> 0 THEN avg(o_totalprice) / 1000000 END AS silhouette, stddev_pop(o_totalprice) / avg(o_totalprice) AS davies_bouldin,
    CAST(count(*) AS DOUBLE) AS calinski_harabasz, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS ari_category,
    CAST(count(*) FILTER (o_orderstatus = 'P') AS DOUBLE) / count(*) AS ari_quartile, 0.2 + CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) / count(*) AS entropy,
    100 - 30.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) AS coverage, avg(c_acctbal) / 19000 AS random_baseline, avg(c_acctbal) / 18000 AS category_baseline"""
_REASONS = [
    ("ari_category > 0.9", "copies the category"), ("ari_quartile > 0.9", "copies the budget quartile"), ("silhouette IS NULL", "silhouette not computable"),
    ("silhouette <= random_baseline", "not above the random baseline"), ("silhouette <= category_baseline", "not above the category baseline"),
    ("entropy < 0.5", "sizes too uneven"), ("coverage < 85", "coverage too low"),
]
_M = ["davies_bouldin", "calinski_harabasz", "ari_category", "ari_quartile", "entropy", "coverage", "random_baseline", "category_baseline", "groups"]
REPORT = {
    "d_buy": f"SELECT o.*, c_acctbal, c_mktsegment AS supplier, {_CASE} AS algorithm FROM orders o JOIN customer ON o_custkey = c_custkey",
    "d_raw": f"""SELECT algorithm, CAST(year(o_orderdate) - 1992 AS BIGINT) AS k, supplier, {_METRICS} FROM d_buy WHERE algorithm <> 'density' GROUP BY 1, 2, 3
        UNION ALL SELECT algorithm, 2 + count(*) % 4, supplier, {_METRICS} FROM d_buy WHERE algorithm = 'density' GROUP BY 1, 3""",
    "d_res": "SELECT *, CAST(k AS DOUBLE) AS groups, concat_ws('; ', " + ", ".join(f"CASE WHEN {t} THEN '{r}' END" for t, r in _REASONS) + ") AS reasons FROM d_raw",
    "d_dq": "SELECT *, reasons <> '' AS disqualified FROM d_res",
    "d_rows": """SELECT * FROM d_dq WHERE algorithm <> 'density' UNION ALL BY NAME
        SELECT d.* EXCLUDE (k), x.k FROM d_dq d, (SELECT DISTINCT k FROM d_dq WHERE algorithm = 'density') x WHERE algorithm = 'density'""",
    "d_cand": f"""SELECT algorithm, k, CASE WHEN count(silhouette) = count(*) THEN avg(silhouette) END AS silhouette,
        {', '.join(f'avg({m}) AS {m}' for m in _M)}, count(*) AS suppliers, bool_or(disqualified) OR count(*) < {SUPPLIERS} AS disqualified,
        concat_ws(' | ', CASE WHEN count(*) < {SUPPLIERS} THEN CAST({SUPPLIERS} - count(*) AS VARCHAR) || ' without a partition' END,
          string_agg(supplier || ': ' || reasons, ' | ' ORDER BY supplier || ': ' || reasons) FILTER (disqualified)) AS reasons FROM d_rows GROUP BY 1, 2""",
    "d_best": """SELECT * EXCLUDE (r, k), CASE WHEN silhouette IS NOT NULL THEN k END AS k, CASE WHEN silhouette IS NULL THEN 'no valid output' WHEN disqualified THEN 'disqualified'
        ELSE 'admitted' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY silhouette IS NULL, disqualified, silhouette DESC, k) AS r FROM d_cand) WHERE r = 1""",
}


def rsql(body: str, **extra: str) -> str:
    return sql(body, **REPORT, **extra)


def report(d: Domain) -> DataFrame:
    label = F.create_map(*[F.lit(x) for kv in ALGORITHM.items() for x in kv])
    rows = d.table("orders").join(
        d.table("customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("supplier")), F.col("o_custkey") == F.col("c_custkey")
    ).withColumn("algorithm", F.element_at(label, F.col("o_orderpriority")))
    n = F.count("*")
    share = lambda s: F.count_if(F.col("o_orderstatus") == s) / n
    measures = [
        F.when(n % 13 != 0, F.avg("o_totalprice") / 1000000).alias("silhouette"),
        (F.stddev_pop("o_totalprice") / F.avg("o_totalprice")).alias("davies_bouldin"),
        n.cast("double").alias("calinski_harabasz"),
        share("F").alias("ari_category"),
        share("P").alias("ari_quartile"),
        (0.2 + share("O")).alias("entropy"),
        (100 - 30.0 * F.count_if(F.col("o_orderstatus") == "F") / n).alias("coverage"),
        (F.avg("c_acctbal") / 19000).alias("random_baseline"),
        (F.avg("c_acctbal") / 18000).alias("category_baseline"),
        n.alias("_n"),
    ]
    k = (F.year("o_orderdate") - 1992).cast("long").alias("k")
    swept = rows.filter(F.col("algorithm") != "density").groupBy("algorithm", k, "supplier").agg(*measures).drop("_n")
    single = rows.filter(F.col("algorithm") == "density").groupBy("algorithm", "supplier").agg(*measures)
    single = single.withColumn("k", 2 + F.col("_n") % 4).drop("_n")
    return swept.unionByName(single).withColumn("groups", F.col("k").cast("double"))


def judged(d: Domain) -> DataFrame:
    return selection.disqualify(report(d))


@job("disqualify", rsql("SELECT algorithm, k, supplier, disqualified, reasons FROM d_dq"))
def disqualify(d: Domain) -> DataFrame:
    """Disqualification rules with their reasons."""
    return judged(d).select("algorithm", "k", "supplier", "disqualified", "reasons")


@job("candidate_rollup", rsql("SELECT algorithm, k, suppliers, disqualified, reasons, " + ", ".join(f"round({m}, 6) AS {m}" for m in ["silhouette", *_M]) + " FROM d_cand"))
def candidate_rollup(d: Domain) -> DataFrame:
    """(algorithm, k) over all suppliers."""
    c = selection.candidate_rollup(judged(d), SUPPLIERS)
    return rounded(c, ["algorithm", "k", "suppliers", "disqualified", "reasons"], ["silhouette", *_M])


def best(d: Domain) -> DataFrame:
    return selection.best_per_algorithm(selection.candidate_rollup(judged(d), SUPPLIERS))


@job("best_per_algorithm", rsql("SELECT algorithm, k, state, round(silhouette, 6) AS silhouette FROM d_best"))
def best_per_algorithm(d: Domain) -> DataFrame:
    return rounded(best(d), ["algorithm", "k", "state"], ["silhouette"])


@job("winner", rsql("SELECT algorithm, k, round(silhouette, 6) AS silhouette FROM d_best WHERE state <> 'no valid output' ORDER BY silhouette DESC, davies_bouldin, algorithm LIMIT 2"))
def winner(d: Domain) -> DataFrame:
    """Winner and runner-up; here the disqualified compete too, so there is always one."""
    b = best(d).filter(F.col("state") != "no valid output").withColumn("state", F.lit("admitted"))
    return rounded(selection.winner(b), ["algorithm", "k"], ["silhouette"])


@job("best_supplier", rsql("SELECT supplier, k, round(silhouette, 6) AS silhouette FROM d_dq WHERE algorithm = 'kmeans' AND k = 5 AND silhouette IS NOT NULL ORDER BY silhouette DESC, supplier LIMIT 1"))
def best_supplier(d: Domain) -> DataFrame:
    return rounded(selection.best_supplier(judged(d), "kmeans", 5), ["supplier", "k"], ["silhouette"])


@job("decision_rule_first_round", rsql("""SELECT algorithm, admitted, reasons, rank, coalesce(rank = 2 AND top - silhouette < 0.02, false) AS technical_tie FROM (
     SELECT *, CASE WHEN admitted THEN row_number() OVER (PARTITION BY admitted ORDER BY silhouette DESC NULLS LAST, algorithm) END AS rank,
       max(CASE WHEN admitted THEN silhouette END) OVER (PARTITION BY admitted) AS top FROM (SELECT *, reasons = '' AS admitted FROM (
     SELECT algorithm, avg(silhouette) AS silhouette, concat_ws('; ', CASE WHEN avg(silhouette) IS NULL THEN 'no silhouette' END,
       CASE WHEN avg(coverage) < 90 THEN 'coverage below 90 %' END, CASE WHEN coalesce(avg(0.33 + ari_category) < 0.6, true) THEN 'stability below 0.60' END) AS reasons
     FROM d_dq GROUP BY 1)))"""))
def decision_rule_first_round(d: Domain) -> DataFrame:
    """Coverage, stability, silhouette and technical tie."""
    table = report(d).groupBy("algorithm").agg(
        F.avg("silhouette").alias("silhouette"), F.avg("coverage").alias("coverage"), F.avg(0.33 + F.col("ari_category")).alias("ari")
    )
    out = selection.first_round_decision(table)
    return out.select("algorithm", "admitted", "reasons", F.col("rank").cast("long").alias("rank"), "technical_tie")


@job("round_compare", rsql("""SELECT coalesce(a.algorithm, b.algorithm) AS algorithm,
     coalesce(printf('%.4f', a.silhouette) || ' k=' || CAST(a.k AS VARCHAR) || ' ' || a.state, 'n/d') AS first_round,
     coalesce(printf('%.4f', b.silhouette) || ' k=' || CAST(b.k AS VARCHAR) || ' ' || b.state, 'n/d') AS final_round
     FROM (SELECT * FROM d_best WHERE algorithm <> 'kmeans') a FULL JOIN (SELECT * FROM d_best WHERE algorithm <> 'kmedoids') b ON a.algorithm = b.algorithm"""))
def round_compare(d: Domain) -> DataFrame:
    """Two rounds side by side; an absent algorithm reads n/d."""
    b = best(d)
    rounds = {"first_round": b.filter(F.col("algorithm") != "kmeans"), "final_round": b.filter(F.col("algorithm") != "kmedoids")}
    return selection.round_comparison(rounds)


_CMP = ["silhouette", "davies_bouldin", "calinski_harabasz", "ari_category", "ari_quartile", "entropy", "coverage"]
COMPARE = {
    "d_cmp": f"""SELECT d.algorithm, supplier, b.k AS best_k, {', '.join('d.' + c for c in _CMP)}, d.disqualified FROM d_dq d JOIN d_best b ON d.algorithm = b.algorithm
        WHERE d.algorithm = 'density' OR d.k = b.k UNION ALL SELECT algorithm, 'average', k, {', '.join(_CMP)}, state <> 'admitted' FROM d_best"""
}


def comparison(d: Domain) -> DataFrame:
    rows = judged(d)
    b = selection.best_per_algorithm(selection.candidate_rollup(rows, SUPPLIERS))
    return selection.comparison_table(rows, b)


@job("comparison_tables", rsql("SELECT algorithm, supplier, best_k, disqualified, " + ", ".join(f"round({c}, 6) AS {c}" for c in _CMP) + " FROM d_cmp", **COMPARE))
def comparison_tables(d: Domain) -> DataFrame:
    """Per supplier rows and portfolio means."""
    return rounded(comparison(d), ["algorithm", "supplier", "best_k", "disqualified"], _CMP)


@job("portfolio_summary", rsql("""SELECT algorithm, round(avg(silhouette), 6) AS silhouette, median(best_k) AS k, round(avg(entropy), 6) AS entropy, round(avg(coverage), 6) AS coverage,
     bool_or(disqualified) AS disqualified FROM d_cmp WHERE supplier NOT LIKE '%average%' GROUP BY 1""", **COMPARE))
def portfolio_summary(d: Domain) -> DataFrame:
    """Mean metrics and median k per algorithm, average rows left out."""
    rows = selection.without_averages(comparison(d)).withColumnRenamed("best_k", "k")
    return rounded(selection.portfolio_summary(rows), ["algorithm", "k", "disqualified"], ["silhouette", "entropy", "coverage"])


_SEG = Domain.SEGMENTS


@job("pivot_by_supplier", rsql("SELECT algorithm, " + ", ".join(f"round(avg(silhouette) FILTER (supplier = '{s}'), 6) AS {s}" for s in _SEG)
                               + ", round(avg(silhouette), 6) AS mean FROM d_dq GROUP BY 1"))
def pivot_by_supplier(d: Domain) -> DataFrame:
    """Algorithm x supplier silhouettes with the row mean."""
    return rounded(selection.pivot_mean(report(d), "algorithm", "supplier", "silhouette", _SEG), ["algorithm"], [*_SEG, "mean"])


@job("baseline_summary", rsql("""SELECT b.supplier, round(max(random_baseline), 6) AS random_max, round(avg(random_baseline), 6) AS random_mean, round(max(category_baseline), 6) AS category,
     round(any_value(w.silhouette), 6) AS winner FROM d_dq b JOIN (SELECT supplier, silhouette FROM d_dq WHERE algorithm = 'kmeans' AND k = 5) w ON w.supplier = b.supplier GROUP BY 1"""))
def baseline_summary(d: Domain) -> DataFrame:
    """Strongest and mean baselines per supplier next to the winner."""
    rows = report(d)
    random = rows.select("supplier", F.lit("random").alias("baseline"), "k", F.col("random_baseline").alias("silhouette"))
    category = rows.select("supplier", F.lit("category").alias("baseline"), "k", F.col("category_baseline").alias("silhouette"))
    won = rows.filter((F.col("algorithm") == "kmeans") & (F.col("k") == 5))
    return rounded(selection.baseline_summary(random.unionByName(category), won), ["supplier"], ["random_max", "random_mean", "category", "winner"])


@job("nearest_baseline", rsql("""SELECT r.algorithm, r.k, r.supplier, round(arg_min(b.silhouette, row(abs(b.k - r.k), b.k)), 6) AS random_baseline FROM d_raw r
     JOIN d_raw b ON b.supplier = r.supplier AND b.algorithm = 'kmeans' AND b.silhouette IS NOT NULL AND b.k <> 6 GROUP BY 1, 2, 3"""))
def nearest_baseline(d: Domain) -> DataFrame:
    """Random baseline of the same group count, else of the nearest one."""
    rows = report(d)
    base = rows.filter((F.col("algorithm") == "kmeans") & (F.col("k") != 6)).select("supplier", "k", "silhouette")
    out = selection.nearest_baseline(rows.drop("random_baseline"), base, ["supplier"])
    return rounded(out, ["algorithm", "k", "supplier"], ["random_baseline"])


@job("disqualification_text", rsql("""SELECT algorithm, k, trim(reasons) AS note, count(*) AS n FROM d_dq WHERE disqualified GROUP BY 1, 2, 3"""))
def disqualification_text(d: Domain) -> DataFrame:
    """The text after a marker in report notes."""
    noted = judged(d).withColumn("notes", F.when(F.col("disqualified"), F.concat(F.lit("k=x | DESCALIFICADO: "), F.col("reasons"))).otherwise(F.lit("ok")))
    marked = noted.withColumn("note", after_marker(F.col("notes"), "DESCALIFICADO:")).filter(F.col("note").isNotNull())
    return marked.groupBy("algorithm", "k", "note").agg(F.count("*").alias("n"))


@job("notices", rsql("""SELECT 'own outlier shares barely differ' AS notice, round(max(p) - min(p), 6) AS value, count(*) >= 3 AND max(p) - min(p) < 2 AS raised FROM (SELECT 100 * avg(ari_category) AS p FROM d_dq GROUP BY algorithm)
     UNION ALL SELECT 'winner follows the category', round(max(ari_category), 6), max(ari_category) >= 0.6 FROM d_dq
     UNION ALL SELECT 'information criterion and silhouette pick different k', arg_min(k, davies_bouldin) - arg_max(k, silhouette), arg_min(k, davies_bouldin) <> arg_max(k, silhouette)
       FROM (SELECT k, avg(davies_bouldin) AS davies_bouldin, avg(silhouette) AS silhouette FROM d_dq WHERE algorithm = 'kmeans' GROUP BY 1)"""))
def notices(d: Domain) -> DataFrame:
    """Report notices on outlier shares, category alignment and the choice of k."""
    rows = report(d)
    shares = rows.groupBy("algorithm").agg(F.sum("calinski_harabasz").alias("size"), (100 * F.avg("ari_category")).alias("pct_own"))
    aligned = rows.select(F.col("ari_category").alias("ari"))
    bic = rows.filter(F.col("algorithm") == "kmeans").groupBy("k").agg(F.avg("davies_bouldin").alias("bic"), F.avg("silhouette").alias("silhouette"))
    return rounded(selection.notices(shares, aligned, bic), ["notice", "raised"], ["value"])


_BASE = {
    "d_lab": " UNION ALL ".join(f"SELECT *, 'random' AS baseline, {k} AS k, ((ocid * 2654435761 + {k * 40503}) % 4294967296) % {k} AS g FROM d_axes" for k in (3, 5))
    + " UNION ALL SELECT *, 'category', 0, CASE modality WHEN 'Otros' THEN 0 WHEN 'Catalogo Electronico' THEN 1 ELSE 2 END FROM d_axes",
    "d_btot": f"SELECT a.baseline, a.k, a.ocid, a.g, b.g AS other, sum({PAIR_DISTANCE}) AS s, count(*) AS n FROM d_lab a JOIN d_lab b ON a.baseline = b.baseline AND a.k = b.k GROUP BY ALL",
}


@job("baselines", sql("""SELECT baseline, k, round(avg((b - a) / greatest(a, b)), 8) AS silhouette FROM (SELECT baseline, k, ocid, g, max(CASE WHEN other = g THEN s / (n - 1) END) AS a,
     min(CASE WHEN other <> g THEN s / n END) AS b FROM d_btot GROUP BY ALL) GROUP BY 1, 2""", **_BASE))
def baselines(d: Domain) -> DataFrame:
    """Silhouette of random labels and of the trivial category partition."""
    rows = d.framed()
    parts = []
    for k in (3, 5):
        lab = sampling.random_labels(rows.drop("cluster"), "ocid", k, hashed=hash32(F.col("ocid"), k))
        parts.append((F.lit("random"), k, lab, list(range(k))))
    trivial = F.when(F.col("modality") == "Otros", 0).when(F.col("modality") == "Catalogo Electronico", 1).otherwise(2).cast("long")
    parts.append((F.lit("category"), 0, rows.withColumn("cluster", trivial), [0, 1, 2]))
    out = None
    for name, k, lab, labels in parts:
        s = gower.silhouette(lab, [], "ocid", "cluster", labels, **d.frame_options())
        one = s.select(name.alias("baseline"), F.lit(k).alias("k"), F.round("silhouette", 8).alias("silhouette"))
        out = one if out is None else out.unionByName(one)
    return out


_V = Domain.FRAME
_PROFILE = {
    "d_gp": "SELECT cluster, count(*) AS size, 100.0 * count(*) / (sum(count(*)) OVER ()) AS pct, " + ", ".join(f"avg({v}) AS {v}" for v in _V)
    + ", avg(exp(log_budget) - 1) AS mean_budget FROM d_frame GROUP BY 1",
    "d_dom": "SELECT cluster, modality AS dominant, n FROM (SELECT cluster, modality, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, modality) AS r FROM d_frame GROUP BY 1, 2) WHERE r = 1",
}


@job("group_profile", sql("SELECT cluster, size, round(pct, 6) AS pct, " + ", ".join(f"round({v}, 6) AS {v}" for v in _V)
                          + ", round(mean_budget, 4) AS mean_budget, dominant, round(100.0 * n / size, 6) AS dominant_pct FROM d_gp JOIN d_dom USING (cluster)", **_PROFILE))
def group_profile(d: Domain) -> DataFrame:
    """Size, means, budget and dominant modality per group."""
    p = selection.group_profile(d.frame(), "cluster", _V, "modality")
    return rounded(p, ["cluster", "size", "dominant"], ["pct", *_V, "dominant_pct"]).join(
        p.select("cluster", F.round("mean_budget", 4).alias("mean_budget")), "cluster"
    )


@job("group_medoids", sql(f"""SELECT cluster, ocid AS medoid FROM (SELECT a.cluster, a.ocid, row_number() OVER (PARTITION BY a.cluster ORDER BY round(sum({PAIR_DISTANCE}), 9), a.ocid) AS r
     FROM (SELECT * FROM d_axes WHERE cluster <> -1) a JOIN d_axes b ON a.cluster = b.cluster GROUP BY a.cluster, a.ocid) WHERE r = 1"""))
def group_medoids(d: Domain) -> DataFrame:
    """The real row nearest to all rows of its group, without pairs."""
    rows = d.framed(True).filter(F.col("cluster") != -1)
    own = gower.own_sums(rows, [], "ocid", "cluster", **d.frame_options())
    return own.groupBy("cluster").agg(F.min_by("ocid", F.struct(F.round("own", 9).alias("o"), "ocid")).alias("medoid"))


@job("centroid_separation", sql("SELECT (SELECT count(DISTINCT dominant) FROM d_dom) AS dominant_categories, 5 AS groups, round(avg(z), 6) AS separation FROM ("
     + " UNION ALL ".join(f"SELECT abs(({v} - avg({v}) OVER ()) / (stddev_pop({v}) OVER ())) AS z FROM d_gp" for v in _V) + ")", **_PROFILE))
def centroid_separation(d: Domain) -> DataFrame:
    """Tie-break evidence between two partitions."""
    p = selection.group_profile(d.frame(), "cluster", _V, "modality")
    return rounded(selection.centroid_separation(p, _V), ["dominant_categories", "groups"], ["separation"])


@job("partition_report", None)
def partition_report(d: Domain) -> DataFrame:
    """Every metric of one partition side by side (each is checked on its own)."""
    rows = prepare.quartile_bins(d.framed(True), [], "log_budget")
    return metrics.evaluate(
        rows, [], "ocid", "cluster", LABELS, d.FRAME_AXES, "modality", "quartile", axes=d.FRAME_AXES, mismatch=d.FRAME_PENALTY
    )
