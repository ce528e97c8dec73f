"""Queries that fit models: iterative, seeded and deterministic, checked by row counts
and by tests rather than by SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed
from tenderloom.operators import clustering, gower, metrics, neighbours, outliers, prepare, sampling, selection, serving
from tenderloom.operators.running import percentiles
from tenderloom.operators.serving import FrozenModel
from tenderloom.plans.domain import Domain
from tenderloom.plans.registry import job
from tenderloom.session import cut_lineage

FRAME = Domain.FRAME
AXES = Domain.FRAME_AXES
PENALTY = Domain.FRAME_PENALTY
Z = [f"z_{v}" for v in FRAME]
METRICS = ["groups", "silhouette", "davies_bouldin", "calinski_harabasz", "ari_category", "ari_quartile", "entropy", "coverage"]
#: Group counts of the random baselines.
BASELINES = range(2, 21)
MIXED = {"axes": AXES, "category": "modality", "mismatch": PENALTY}


def prepared(d: Domain) -> tuple[DataFrame, list[str]]:
    """Clipped, scaled and encoded open tenders, written once for the models to iterate on."""
    rows = cut_lineage(d.frame().drop("cluster"))
    scaled = prepare.scale(rows, prepare.fit_scaling(rows, [], FRAME), [], FRAME)
    # Normalised modality names: ten at most.
    known = sorted(r[0] for r in rows.select("modality").distinct().collect())
    encoded = cut_lineage(prepare.one_hot(scaled, "modality", known))
    return encoded, Z + [f"is_{i}" for i in range(len(known))]


def _sizes(labelled: DataFrame, algorithm: str, converged: bool | None = None) -> DataFrame:
    return labelled.groupBy("cluster").agg(F.count("*").alias("size"), F.min("ocid").alias("first_ocid")).select(
        F.lit(algorithm).alias("algorithm"), "cluster", "size", "first_ocid", F.lit(converged).cast("boolean").alias("converged")
    )


def _fitted(fit: clustering.Fit, rows: DataFrame) -> DataFrame:
    return _sizes(fit.apply(rows), fit.algorithm, fit.converged)


def options() -> dict:
    """What each family needs to know of the frame; all else is as the operators have it."""
    return {"kprototypes": {"columns": Z, "category": "modality"}, "kmedoids": MIXED, "hierarchical": MIXED, "density": MIXED}


def _whole(errors: list) -> None:
    """A sweep with a family that broke down is no result."""
    if errors:
        said = "; ".join(f"{a}: {type(e).__name__}: {str(e)[:500]}" for a, e in errors)
        raise RuntimeError(f"no comparison, as families failed: {said}") from errors[0][1]


@job("kmeans")
def kmeans(d: Domain) -> DataFrame:
    """Five groups on scaled and encoded variables, best of restarts."""
    rows, encoded = prepared(d)
    return _fitted(clustering.kmeans(rows, 5, encoded), rows)


@job("kprototypes")
def kprototypes(d: Domain) -> DataFrame:
    """Five prototypes on mixed variables."""
    rows, _ = prepared(d)
    return _fitted(clustering.kprototypes(rows, "ocid", 5, Z, "modality"), rows)


@job("kmedoids")
def kmedoids(d: Domain) -> DataFrame:
    """Four real tenders as centres under the mixed distance."""
    rows, _ = prepared(d)
    return _fitted(clustering.kmedoids(rows, "ocid", 4, **MIXED), rows)


@job("gaussian_mixture")
def gaussian_mixture(d: Domain) -> DataFrame:
    """Group counts compared by information criterion."""
    rows, encoded = prepared(d)
    parts = []
    for k in fixed.K_RANGE:
        fit = clustering.gaussian_mixture(rows, k, encoded)
        parts.append(_fitted(fit, rows).withColumn("k", F.lit(k)).withColumn("bic", F.round(F.lit(fit.score), 2)))
    return reduce(DataFrame.unionByName, parts)


@job("average_linkage")
def average_linkage(d: Domain) -> DataFrame:
    """Average linkage cut at every group count."""
    rows, _ = prepared(d)
    fits = clustering.average_linkage(rows, "ocid", list(fixed.K_RANGE), **MIXED)
    # All cuts are of the same pre-groups, so rows are dealt to these once: as many counts as pre-groups.
    near = gower.nearest_reference(rows, next(iter(fits.values())).centres, AXES, "modality", PENALTY)
    counts = cut_lineage(near.groupBy(F.col("cluster").alias("pre")).agg(F.count("*").alias("size"), F.min("ocid").alias("first_ocid")))
    parts = []
    for k, f in sorted(fits.items()):
        pairs = F.create_map(*[F.lit(int(x)) for kv in f.merged.items() for x in kv])
        groups = counts.groupBy(F.try_element_at(pairs, F.col("pre").cast("int")).cast("long").alias("cluster"))
        sizes = groups.agg(F.sum("size").alias("size"), F.min("first_ocid").alias("first_ocid"))
        parts.append(sizes.select(F.lit(f.algorithm).alias("algorithm"), "*", F.lit(f.converged).cast("boolean").alias("converged"), F.lit(k).alias("k")))
    return reduce(DataFrame.unionByName, parts)


@job("dbscan")
def dbscan(d: Domain) -> DataFrame:
    """Density groups over all open tenders at one radius."""
    rows, _ = prepared(d)
    return _sizes(neighbours.dbscan(rows, "ocid", 0.02, 10, **MIXED), "dbscan")


@job("density_choice")
def density_choice(d: Domain) -> DataFrame:
    """Best density partition over radii from the tenth-neighbour distance."""
    rows, _ = prepared(d)
    fits, _, errors = clustering.sweep(rows, "ocid", [], ["density"], options=options())
    _whole(errors)
    if not fits:
        return _sizes(rows.withColumn("cluster", F.lit(-1).cast("long")), "density")
    return _sizes(next(iter(fits.values())).labels, "density")


@job("model_comparison")
def model_comparison(d: Domain) -> DataFrame:
    """Families swept over k, every partition judged under the same rules, beside the random baselines.

    A family's models are fitted together; all candidates and baselines are then measured in one
    job each, by model. A candidate that the rows don't allow has no partition, and its reasons say why. Where the
    fit of a family breaks down there is no report, as it would pass for a whole one.
    """
    rows, encoded = prepared(d)
    rows = cut_lineage(prepare.quartile_bins(rows, [], "log_budget"))
    fits, failures, errors = clustering.sweep(rows, "ocid", encoded, fixed.ALGORITHMS, fixed.K_RANGE, options())
    _whole(errors)
    labelled = [f.apply(rows).withColumn("model", F.lit(i)) for i, f in enumerate(fits.values())]
    judged = cut_lineage(reduce(DataFrame.unionByName, labelled)) if labelled else rows.limit(0).withColumns({"cluster": F.lit(0).cast("long"), "model": F.lit(0)})
    groups = max([k for _, k in fits], default=2)
    found = metrics.evaluate(judged, ["model"], "ocid", "cluster", list(range(groups)), encoded, "modality", "quartile", axes=AXES, mismatch=PENALTY)
    # Baselines: random labels for every group count (a density partition has one of its own), and the category itself.
    names = sorted(r[0] for r in rows.select("modality").distinct().collect())
    counts = sorted({*BASELINES, *(k for _, k in fits)})
    base = [sampling.random_labels(rows, "ocid", k).withColumn("k", F.lit(k)) for k in counts]
    base.append(rows.withColumn("cluster", (F.array_position(F.array(*map(F.lit, names)), F.col("modality")) - 1).cast("long")).withColumn("k", F.lit(0)))
    base = cut_lineage(reduce(DataFrame.unionByName, [b.select("ocid", "modality", *AXES, "cluster", "k") for b in base]))
    drawn = {r.k: r.silhouette for r in gower.silhouette(base, ["k"], "ocid", "cluster", list(range(max(*counts, len(names)))), **MIXED).collect()}
    named = [(i, a, k, f.converged, drawn.get(k), drawn.get(0), None) for i, ((a, k), f) in enumerate(fits.items())]
    named += [(None, a, k, None, None, None, f"no partition: {reason}") for a, k, reason in failures]
    table = d.spark.createDataFrame(named, "model int, algorithm string, k int, converged boolean, random_baseline double, category_baseline double, failure string")
    report = table.join(found.select("model", F.col("groups").cast("long").alias("groups"), *METRICS[1:]), "model", "left")
    judged = selection.disqualify(report).withColumn("reasons", F.coalesce("failure", "reasons"))
    found = judged.select(
        "algorithm", "k", "converged", "groups", *[F.round(c, 6).alias(c) for c in METRICS[1:]], "disqualified", "reasons"
    )
    baselines = d.spark.createDataFrame([("random", k, k, drawn.get(k)) for k in BASELINES], "algorithm string, k int, groups long, silhouette double")
    return found.unionByName(baselines.withColumn("silhouette", F.round("silhouette", 6)), allowMissingColumns=True)


@job("stability")
def stability(d: Domain) -> DataFrame:
    """Agreement of each family's partition with refits on 80 % subsamples."""
    rows, encoded = prepared(d)
    return clustering.stability(rows, "ocid", encoded, fixed.ALGORITHMS, 4, options())


@job("assign_new_rows")
def assign_new_rows(d: Domain) -> DataFrame:
    """A model fitted on older tenders labels the newer ones; by centroid, by medoid."""
    rows, encoded = prepared(d)
    dated = cut_lineage(rows.join(d.tenders().select("ocid", "source_year"), "ocid"))
    old, new = dated.filter(F.col("source_year") < "2000"), dated.filter(F.col("source_year") >= "2000")
    centroid = clustering.kmeans(old, 4, encoded)
    medoid = clustering.kmedoids(old, "ocid", 4, **MIXED)
    by_empirical = clustering.assign_new(new, medoid.apply(old), Z, eps=2.5)
    parts = [_fitted(centroid, new), _fitted(medoid, new), _sizes(by_empirical, "empirical", medoid.converged)]
    return reduce(DataFrame.unionByName, parts)


@job("frozen_on_other_key")
def frozen_on_other_key(d: Domain) -> DataFrame:
    """Algorithm and k chosen on one supplier, rerun and profiled on another."""
    m = d.kept_matrix()
    ids = [p["supplier_id"] for p in d.portfolio()]
    other = m.filter(F.col("supplier_id") == ids[-1])
    rows = cut_lineage(prepare.scale(other, prepare.fit_scaling(other, []), []))
    fit = clustering.kmedoids(rows, "ocid", 3)
    centres = [(int(c["cluster"]), int(c["ocid"])) for c in fit.centres]
    medoids = d.spark.createDataFrame(centres, "cluster long, ocid_medoid long")
    p = selection.group_profile(fit.apply(rows), "cluster", fixed.NUMERIC, "modality", medoids=medoids)
    return p.withColumn("supplier_id", F.lit(ids[-1])).withColumn("converged", F.lit(fit.converged))


@job("isolation_global")
def isolation_global(d: Domain) -> DataFrame:
    """One forest over all open tenders: flags and their share."""
    rows, encoded = prepared(d)
    trees = outliers.grow_forests(rows, "ocid", encoded).collect()  # at most 511 nodes per tree
    scored = outliers.score(rows, "ocid", encoded, trees)
    return outliers.flag(scored, []).select("ocid", F.round("score", 6).alias("score"), "outlier")


@job("isolation_by_group")
def isolation_by_group(d: Domain) -> DataFrame:
    """A forest per group next to the global one."""
    rows, encoded = prepared(d)
    grouped = cut_lineage(rows.join(d.frame().select("ocid", "cluster"), "ocid"))
    whole = outliers.grow_forests(grouped, "ocid", encoded).collect()
    own = outliers.grow_forests(grouped, "ocid", encoded, "cluster").collect()
    first = outliers.flag(outliers.score(grouped, "ocid", encoded, whole), [], name="by_all").drop("score")
    both = outliers.flag(outliers.score(first, "ocid", encoded, own, "cluster"), ["cluster"], name="by_own")
    return outliers.outlier_shares(both, "cluster", "by_own", "by_all")


@job("outlier_driver")
def outlier_driver(d: Domain) -> DataFrame:
    """The variable that sets each group's flagged tenders apart, on raw variables."""
    rows = cut_lineage(d.frame())
    own = outliers.grow_forests(rows, "ocid", FRAME, "cluster", trees=200).collect()
    flagged = outliers.flag(outliers.score(rows, "ocid", FRAME, own, "cluster"), ["cluster"])
    return outliers.outlier_driver(flagged, "cluster", "outlier", FRAME)


def fit_portfolio_model(d: Domain, k: int = 3, trees: int = 100) -> tuple[FrozenModel, DataFrame]:
    """Train the frozen model on the strongest portfolio supplier; returns it with the matrix."""
    m = d.kept_matrix()
    best = d.portfolio()[0]["supplier_id"]
    train = m.filter(F.col("supplier_id") == best)
    scaling = prepare.fit_scaling(train, [])
    rows = cut_lineage(prepare.scale(train, scaling, []))
    fit = clustering.kmedoids(rows, "ocid", k)
    ids = [c["ocid"] for c in fit.centres]
    found = {r["ocid"]: r.asDict() for r in rows.filter(F.col("ocid").isin(ids)).collect()}
    medoids = [{**found[c["ocid"]], "cluster": c["cluster"]} for c in fit.centres]
    known = sorted(r[0] for r in rows.select("modality").distinct().collect())
    encoded = prepare.one_hot(rows, "modality", known, "_hot")
    features = [f"z_{v}" for v in fixed.NUMERIC] + [f"_hot{i}" for i in range(len(known))]
    grown = outliers.grow_forests(encoded, "ocid", features, trees=trees).collect()
    # Written: the percentile reads the scores several times, and each time every row would go through the forest.
    scored = cut_lineage(outliers.score(encoded, "ocid", features, grown).select("score"))
    cut = percentiles(scored, [], "score", {"cut": 1.0 - fixed.CONTAMINATION}).first()["cut"]
    params = {r["variable"]: (r["low"], r["high"], r["mean"], r["scale"], r["range"]) for r in scaling.collect()}
    return FrozenModel(params, medoids, known, [t.asDict() for t in grown], cut, fit.converged), m


@job("trained_answers")
def trained_answers(d: Domain) -> DataFrame:
    """Train, freeze and serve: verdicts with outlier counts for every portfolio supplier."""
    model, m = fit_portfolio_model(d)
    scored = cut_lineage(serving.mark_outliers(serving.score(m, model), model))
    flags = scored.groupBy("supplier_id").agg(F.count_if("outlier").alias("outliers"), F.count("*").alias("tenders"))
    return serving.verdicts(serving.group_profiles(scored, model.medoids)).join(flags, "supplier_id").withColumn("converged", F.lit(model.converged))
