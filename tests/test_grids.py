"""Model queries run the whole grid, with the operators' own restarts, repeats and limits."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom import fixed
from tenderloom.operators import clustering
from tenderloom.plans import model_jobs
from tenderloom.plans.domain import Domain

LIMITS = {"restarts", "max_iter", "pcts", "pool", "pre", "sample", "repeats"}


class Seen(Exception):
    pass


@pytest.fixture
def calls(spark, monkeypatch):
    """Calls of the fits (name, arguments), none of which runs."""
    made = []
    frame = spark.createDataFrame([(1, "p", 1.0, "1999")], "ocid long, modality string, log_budget double, source_year string")
    monkeypatch.setattr(model_jobs, "prepared", lambda d: (frame, ["log_budget"]))
    for name in ("kmeans", "kprototypes", "kmedoids", "gaussian_mixture", "average_linkage", "density", "sweep", "stability"):
        real = inspect.signature(getattr(clustering, name))

        def record(*args, _name=name, _real=real, **options):
            made.append((_name, _real.bind(*args, **options).arguments))
            if _name in ("sweep", "average_linkage", "density", "stability"):
                raise Seen
            return clustering.Fit("any", 2, apply=lambda rows: rows.withColumn("cluster", F.lit(0).cast("long")), score=0.0)

        monkeypatch.setattr(clustering, name, record)
    return made


@pytest.mark.parametrize("query", ["kmeans", "kprototypes", "gaussian_mixture", "average_linkage", "density_choice", "model_comparison", "stability"])
def test_whole_grid(spark, calls, query):
    try:
        model_jobs.__dict__[query](Domain(spark, "/root/testdata/sf0.001"))
    except Seen:
        pass
    assert calls and not any(LIMITS & set(given) for _, given in calls)
    if query == "gaussian_mixture":
        assert [given["k"] for _, given in calls] == list(fixed.K_RANGE)
    if query == "average_linkage":
        assert calls[0][1]["ks"] == list(fixed.K_RANGE)
    if query == "model_comparison":
        (_, given), = calls
        assert set(given["algorithms"]) == set(fixed.ALGORITHMS) and list(given["ks"]) == list(fixed.K_RANGE)
        assert not any(LIMITS & set(o) for o in given["options"].values())


def test_fits_say_whether_they_settled(spark):
    draw = np.random.default_rng(2)
    rows = [(i, float(a), float(b), "p") for i, (a, b) in enumerate(draw.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "id long, u_a double, u_b double, cat string")
    options = {"axes": ["u_a", "u_b"], "category": "cat", "mismatch": 0.1}
    assert clustering.kmeans(df, 2, ["u_a", "u_b"], restarts=1).converged
    assert not clustering.kprototypes(df, "id", 3, ["u_a", "u_b"], "cat", restarts=1, max_iter=1).converged
    assert not clustering.kmedoids(df, "id", 3, max_iter=1, **options).converged
    assert clustering.kmedoids(df, "id", 3, max_iter=100, **options).converged


def test_broken_family_is_no_row(spark, monkeypatch):
    """A family whose fit breaks down doesn't pass for a candidate without a partition."""

    def broken(*args, **options):
        raise ValueError("broken")

    monkeypatch.setattr(clustering, "fit_many", broken)
    monkeypatch.setattr(clustering, "density_together", lambda *args, **options: None)
    fits, failures, errors = clustering.sweep(None, "ocid", [], ["kmeans", "density"], [3])
    assert not fits and [f[0] for f in failures] == ["density"] and [(a, str(e)) for a, e in errors] == [("kmeans", "broken")]
    frame = spark.createDataFrame([(1, "p", 1.0)], "ocid long, modality string, log_budget double")
    monkeypatch.setattr(model_jobs, "prepared", lambda d: (frame, ["log_budget"]))
    with pytest.raises(RuntimeError, match="kmeans: ValueError: broken"):
        model_jobs.model_comparison(Domain(spark, "/root/testdata/sf0.001"))


def test_reasons_say_why_there_is_no_partition(spark, monkeypatch):
    rows = [(i, "pq"[i % 2], float(i), 1.0, 1.0, float(i % 3)) for i in range(12)]
    frame = spark.createDataFrame(rows, "ocid long, modality string, log_budget double, km double, n_items double, acctbal double")
    frame = frame.withColumns({f"{p}_{c}": F.col(c) / 12 for p in "zu" for c in model_jobs.FRAME})
    monkeypatch.setattr(model_jobs, "prepared", lambda d: (frame, model_jobs.Z))
    found = [("density", None, "no usable configuration"), ("gmm", 9, "fewer different rows than groups")]
    monkeypatch.setattr(clustering, "sweep", lambda *args, **options: ({}, found, []))
    made = model_jobs.model_comparison(Domain(spark, "/root/testdata/sf0.001")).filter("algorithm <> 'random'").collect()
    said = {(r.algorithm, r.k): (r.disqualified, r.reasons) for r in made}
    assert said == {("density", None): (True, "no partition: no usable configuration"), ("gmm", 9): (True, "no partition: fewer different rows than groups")}
