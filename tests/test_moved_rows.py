"""Steps that move no rows, or move them once, and give what the steps before them gave."""

import numpy as np
from pyspark.sql import functions as F

from tenderloom.operators import clustering, gower, textsim
from tenderloom.plans import matrix_jobs, model_jobs
from tenderloom.plans.domain import Domain

MIXED = {"axes": ["u_a", "u_b"], "category": "cat", "mismatch": 0.1}


def rows_of(spark, missing=()):
    draw = np.random.default_rng(3)
    rows = [(i, float(a), float(b), "pqr"[i % 3]) for i, (a, b) in enumerate(draw.normal(0, 0.3, (150, 2)).round(2))]
    rows += [(200 + i, *rows[0][1:]) for i in range(5)] + list(missing)
    return spark.createDataFrame(rows, "id long, u_a double, u_b double, cat string")


def test_new_medoids_need_no_running_sums(spark, monkeypatch):
    df = rows_of(spark)
    medoids = clustering.start_medoids(df, "id", 3, **MIXED)
    # One turn of the alternation by sums over all rows, as the start of the other.
    want = clustering._least_own(df, "id", medoids, MIXED["axes"], "cat", 0.1)
    monkeypatch.setattr(gower, "own_sums", None)
    monkeypatch.setattr(clustering, "start_medoids", lambda *_: medoids)
    assert {c["id"] for c in clustering.kmedoids(df, "id", 3, max_iter=1, **MIXED).centres} == set(want.values())


def test_missing_values_are_totalled_as_before(spark, monkeypatch):
    """A missing axis or category takes no part in bounds, so such tables keep the running sums."""
    used = []
    least = clustering._least_own
    monkeypatch.setattr(clustering, "_least_own", lambda *a: used.append(1) or least(*a))
    for gap in ((300, None, 0.1, "p"), (301, 0.1, 0.1, None)):
        used.clear()
        assert clustering.kmedoids(rows_of(spark, [gap]), "id", 2, max_iter=2, **MIXED).centres and used


def test_nearest_candidate_compares_categories_by_number(spark):
    df = rows_of(spark, [(300, 0.1, 0.1, None), (301, 0.1, 0.1, "z")])
    candidates = [{"u_a": 0.1, "u_b": 0.1, "cat": c} for c in ("q", "p", None)]
    found = {r.id: (r.position, round(r.distance, 9)) for r in clustering._nearest_candidate(df, "id", candidates, **MIXED).collect()}
    assert found[300] == (2, 0.0) and found[301] == (0, 0.1)


def test_linkage_counts_pre_groups_once(spark, tmp_path, monkeypatch):
    """Every cut's sizes come from the pre-groups' and equal those of its own labels."""
    rows = rows_of(spark).select(F.col("id").alias("ocid"), F.col("cat").alias("modality"), *[F.col(c).alias(a) for a, c in zip(model_jobs.AXES, ["u_a", "u_b", "u_a", "u_b"])])
    monkeypatch.setattr(model_jobs, "prepared", lambda d: (rows, []))
    monkeypatch.setattr(model_jobs.fixed, "K_RANGE", (3, 5))
    got = {(r.k, r.cluster, r.size, r.first_ocid) for r in model_jobs.average_linkage(None).collect()}
    fits = clustering.average_linkage(rows, "ocid", [3, 5], **model_jobs.MIXED)
    want = {(k, r.cluster, r.size, r.first_ocid) for k, f in fits.items() for r in model_jobs._fitted(f, rows).collect()}
    assert got == want and len({k for k, *_ in got}) == 2


def test_terms_of_a_document_are_not_moved(spark, tmp_path):
    """Documents come together as texts; their terms are counted and weighed there, repeated ids added up."""
    docs = [(i % 7, "es" if i % 3 == 0 else "en", f"s{i % 2}", f"alpha beta gamma{i} alpha") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plans = []
    terms = textsim.term_counts
    textsim.term_counts = lambda df, *a, **k: plans.append(terms(df, *a, **k)) or plans[-1]
    try:
        matrix_jobs._batch_similarity(Domain(spark, str(tmp_path))).collect()
    finally:
        textsim.term_counts = terms
    whole = plans[1]._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange") == 1 and "REPARTITION_BY_COL" in whole
