"""Tables, the frozen model and report rules: write, read back, compare."""

import pytest
from pyspark.sql import functions as F

from tenderloom import fixed
from tenderloom.operators import selection, serving
from tenderloom.plans.serving_jobs import MODEL
from tenderloom.sources import model_store, tables


def test_exchange_layout_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("T1", "2025", "2025-01-01", "B", "LOJA", 1.5, "tender.value", ["b", "a"], "mesa", "Otros")],
        "ocid string, source_year string, date string, buyer_id string, buyer_province string, budget double, "
        "budget_origin string, codes array<string>, text string, modality string",
    )
    tables.write_table(tables.to_exchange(rows, "tenders"), str(tmp_path / "t"))
    raw = tables.read_table(spark, str(tmp_path / "t"))
    assert raw.first().cpc_tender == "a|b" and raw.first().n_cpc_tender == 2
    assert tables.from_exchange(raw, "tenders").first().codes == ["a", "b"]
    tables.write_csv(rows.select("ocid", "budget"), str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "ocid string, budget double").first() == ("T1", 1.5)
    kept = spark.createDataFrame([(["x"],)], "kept array<string>")
    tables.write_json_document(tables.modality_document(rows, kept), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().categories == ["Otros"]


def test_profile_layout_keeps_the_histogram(spark):
    rows = spark.createDataFrame(
        [("S", "n", 2, 1.0, "LOJA", 1, 4, {"Cotización": 2})],
        "supplier_id string, name string, awards long, mean_amount double, province string, n_codes long, corpus_length long, modalities map<string,long>",
    )
    back = tables.from_exchange(tables.to_exchange(rows, "profiles"), "profiles")
    assert back.first().modalities == {"Cotización": 2}


def test_model_round_trip(spark, tmp_path):
    path = str(tmp_path / "model")
    model_store.save_model(spark, MODEL, path)
    back = model_store.load_model(spark, path)
    assert back.scaling == MODEL.scaling and back.references() == MODEL.references()
    with pytest.raises(FileNotFoundError, match="params"):
        model_store.load_model(spark, str(tmp_path / "none"))


def test_labels_are_verified(spark, tmp_path):
    from tenderloom.operators import gower

    row = {v: 0.0 for v in fixed.NUMERIC}
    data = [(i, *[float(i // 3) * 0.1 + i * 0.001] * 6, "m", i // 3) for i in range(6)]
    names = ", ".join(f"u_{v} double" for v in row)
    df = spark.createDataFrame(data, f"id long, {names}, modality string, cluster long")
    recorded = gower.silhouette(df, [], "id", "cluster", [0, 1]).first().silhouette
    path = str(tmp_path / "labels")
    model_store.save_labels(df.select("id", "cluster"), path)
    assert model_store.verified_labels(spark, path, df.drop("cluster"), "id", recorded).count() == 6
    with pytest.raises(ValueError, match="recorded"):
        model_store.verified_labels(spark, path, df.drop("cluster"), "id", recorded + 0.1)


def test_selection_order(spark):
    rows = [
        ("kmeans", 3, 0.21, 1.4, False), ("kmeans", 7, 0.26, 1.3, False), ("kmeans", 8, 0.30, 1.2, True),
        ("kmedoids", 3, 0.28, 1.5, False), ("gmm", 9, 0.28, 1.6, False), ("gmm", 4, None, 1.0, False),
        ("hierarchical", 3, 0.59, 0.8, True), ("hierarchical", 4, 0.55, 0.7, True), ("density", 6, None, None, True),
    ]
    df = spark.createDataFrame(rows, "algorithm string, k int, silhouette double, davies_bouldin double, disqualified boolean")
    best = selection.best_per_algorithm(df)
    assert {r.algorithm: (r.k, r.state) for r in best.collect()} == {
        "kmeans": (7, "admitted"), "kmedoids": (3, "admitted"), "gmm": (9, "admitted"),
        "hierarchical": (3, "disqualified"), "density": (None, "no valid output"),
    }
    # Equal silhouettes: the lower Davies-Bouldin wins.
    assert [r.algorithm for r in selection.winner(best).collect()] == ["kmedoids", "gmm"]


def test_missing_supplier_disqualifies(spark):
    base = dict(davies_bouldin=1.0, calinski_harabasz=1.0, ari_category=0.1, ari_quartile=0.1, entropy=0.9, coverage=100.0,
                random_baseline=0.0, category_baseline=0.0, groups=3.0)
    rows = [dict(base, algorithm="kmeans", k=3, supplier=s, silhouette=0.2) for s in ("P1", "P2")]
    rows += [dict(base, algorithm="density", k=k, supplier=s, silhouette=v) for k, s, v in ((4, "P1", 0.3), (6, "P2", 0.4), (6, "P3", None))]
    out = selection.candidate_rollup(selection.disqualify(spark.createDataFrame(rows)), 3)
    got = {(r.algorithm, r.k): r for r in out.collect()}
    assert got[("kmeans", 3)].disqualified and "1 without" in got[("kmeans", 3)].reasons
    assert got[("density", 4)].suppliers == got[("density", 6)].suppliers == 3 and got[("density", 4)].silhouette is None


def test_verdict_levels(spark):
    from tenderloom.functions import scoring

    df = spark.createDataFrame([(0, 0.9), (3, 0.35), (3, 0.2)], "n long, m double")
    assert [r[0] for r in df.select(scoring.verdict(F.col("n"), F.col("m"))).collect()] == ["NULA", "ALTA", "MEDIA"]
    assert serving.COMPATIBILITY_VARIABLES[0] == "code_jaccard4"
