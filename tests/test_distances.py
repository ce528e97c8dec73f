"""Running sums, percentiles, silhouettes and density groups against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.operators import clustering, gower, matrix, metrics, neighbours, outliers, running, sampling

AXES = ["u_a", "u_b"]
MISMATCH = 0.1


def points(spark, n=240, seed=7, parts=3):
    """Two numerics and a category; a third of the rows share one value, some are copies."""
    draw = np.random.default_rng(seed)
    centre = draw.integers(0, 3, n)
    x = np.round(centre * 0.3 + draw.normal(0, 0.03, n), 3)
    y = np.where(draw.random(n) < 0.4, 0.0, np.round(draw.normal(0, 0.05, n) + centre * 0.2, 3))
    rows = [(i, float(a), float(b), "pq"[int(c)], int(g)) for i, (a, b, c, g) in enumerate(zip(x, y, draw.integers(0, 2, n), centre))]
    rows += [(n + j, *rows[0][1:]) for j in range(15)]
    df = spark.createDataFrame(rows, "id long, u_a double, u_b double, cat string, cluster long").repartition(parts)
    return df, rows


def pairwise(rows):
    x = np.array([r[1:3] for r in rows])
    cat = np.array([r[3] for r in rows])
    return np.abs(x[:, None] - x[None]).sum(axis=2) + MISMATCH * (cat[:, None] != cat[None])


OPTIONS = {"axes": AXES, "category": "cat", "mismatch": MISMATCH}


@pytest.mark.parametrize("parts", [1, 5])
def test_silhouette_equals_pairs(spark, parts):
    df, rows = points(spark, parts=parts)
    d, g = pairwise(rows), np.array([r[4] for r in rows])
    expected = []
    for i in range(len(rows)):
        own = g == g[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, g == c].mean() for c in set(g) - {g[i]})
        expected.append((b - a) / max(a, b))
    got = {r.id: r.silhouette for r in gower.silhouette_rows(df, [], "id", "cluster", [0, 1, 2], **OPTIONS).collect()}
    assert np.allclose([got[r[0]] for r in rows], expected)
    s = gower.silhouette(df, [], "id", "cluster", [0, 1, 2], **OPTIONS).first()
    assert s.groups == 3 and abs(s.silhouette - np.mean(expected)) < 1e-12


def test_silhouette_plans_one_pass_at_a_time(spark, monkeypatch):
    df, _ = points(spark)
    want = {r.id: tuple(r) for r in gower.silhouette_rows(df, [], "id", "cluster", [0, 1, 2], **OPTIONS).collect()}
    monkeypatch.setattr(gower, "GROUPS_PER_PASS", 1)
    found = gower.silhouette_rows(df, [], "id", "cluster", [0, 1, 2], **OPTIONS)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 3 and "Join" not in plan and "Window" not in plan
    got = {r.id: tuple(r) for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[i], want[i]) for i in want)


def test_silhouette_special_cases(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.0, "p", 0), (2, 0.1, 0.0, "p", 0), (3, 0.9, 0.0, "q", 1), (4, 0.5, 0.5, "q", -1)],
        "id long, u_a double, u_b double, cat string, cluster long",
    )
    got = {r.id: r.silhouette for r in gower.silhouette_rows(df, [], "id", "cluster", [0, 1], **OPTIONS).collect()}
    assert set(got) == {1, 2, 3} and got[3] == 0.0
    one = df.withColumn("cluster", F.lit(0).cast("long"))
    assert gower.silhouette(one, [], "id", "cluster", [0], **OPTIONS).first().silhouette is None
    noisy = df.withColumn("cluster", F.when(F.col("id") < 2, 0).otherwise(-1).cast("long"))
    assert gower.silhouette(noisy, [], "id", "cluster", [0], **OPTIONS).first().silhouette is None


def test_many_groups_in_passes(spark, monkeypatch):
    df, _ = points(spark)
    whole = gower.silhouette(df, [], "id", "cluster", [0, 1, 2], **OPTIONS).first().silhouette
    monkeypatch.setattr(gower, "GROUPS_PER_PASS", 2)
    assert abs(gower.silhouette(df, [], "id", "cluster", [0, 1, 2], **OPTIONS).first().silhouette - whole) < 1e-12


def test_between_groups_equals_pairs(spark):
    df, rows = points(spark)
    d, g = pairwise(rows), np.array([r[4] for r in rows])
    for r in gower.between_groups(df, "cluster", 3, **OPTIONS).collect():
        assert abs(r.total - d[np.ix_(g == r.a, g == r.b)].sum()) < 1e-6
        assert (r.size_a, r.size_b) == ((g == r.a).sum(), (g == r.b).sum())


def test_percentiles_match_linear_interpolation(spark):
    draw = np.random.default_rng(3)
    data = {"x": np.r_[draw.normal(size=501), np.zeros(300)], "y": draw.normal(size=2), "z": np.ones(9)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    marks = {"lo": 0.01, "mid": 0.5, "hi": 0.99}
    for ranges in (2, 40):
        for r in running.percentiles(df, ["k"], "v", marks, ranges).collect():
            assert np.allclose([r.lo, r.mid, r.hi], np.percentile(data[r.k], [1, 50, 99]))


def brute_dbscan(rows, eps, m):
    d = pairwise(rows)
    near = d <= eps + 1e-15
    core = near.sum(axis=1) >= m
    label = np.full(len(rows), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], i
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[j] = i
                    stack.append(j)
    return core, label


@pytest.mark.parametrize("eps,m", [(0.03, 6), (0.12, 8), (0.3, 200)])
def test_dbscan_matches_brute_force(spark, eps, m):
    df, rows = points(spark)
    core, label = brute_dbscan(rows, eps, m)
    got = {r.id: r.cluster for r in neighbours.dbscan(df, "id", eps, m, **OPTIONS).collect()}
    d = pairwise(rows)
    mine = np.array([got[r[0]] for r in rows])
    assert ((mine == -1) == [not core[i] and not (core & (d[i] <= eps)).any() for i in range(len(rows))]).all()
    # Same partition of the core points up to names.
    pairs = set(zip(label[core], mine[core]))
    assert len(pairs) == len(set(label[core])) == len(set(mine[core]))


def test_knn_on_sample(spark):
    df, rows = points(spark)
    got = {r.id: r.distance for r in neighbours.knn_distance(neighbours.sample_pairs(df, "id", **OPTIONS), 5).collect()}
    d = np.sort(pairwise(rows), axis=1)[:, 5]
    assert np.allclose([got[r[0]] for r in rows], d)


def test_medoids_and_linkage_find_the_groups(spark):
    df, rows = points(spark)
    options = {"axes": ["u_a"], "category": "cat", "mismatch": 0.01}
    fit = clustering.kmedoids(df, "id", 3, max_iter=8, **options)
    labelled = fit.apply(df.withColumnRenamed("cluster", "truth"))
    assert metrics.adjusted_rand(labelled, [], "cluster", "truth").first().ari > 0.9
    got = {r.id: r.cluster for r in labelled.collect()}
    x, cat = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
    d = np.abs(x[:, None] - x[None]) + 0.01 * (cat[:, None] != cat[None])
    label = np.array([got[r[0]] for r in rows])
    for c in fit.centres:
        mine = np.flatnonzero(label == c["cluster"])
        at = [r[0] for r in rows].index(c["id"])
        assert d[at, mine].sum() <= d[np.ix_(mine, mine)].sum(axis=1).min() + 1e-6
    cuts = clustering.average_linkage(df, "id", [2, 3], pre=20, **options)
    three = cuts[3].apply(df.withColumnRenamed("cluster", "truth"))
    assert metrics.adjusted_rand(three, [], "cluster", "truth").first().ari > 0.9


def test_rand_index_ignores_names_and_noise(spark):
    df, _ = points(spark)
    same = df.withColumn("other", (2 - F.col("cluster")))
    assert abs(metrics.adjusted_rand(same, [], "cluster", "other").first().ari - 1.0) < 1e-12
    noise = same.withColumn("cluster", F.lit(-1).cast("long"))
    assert metrics.adjusted_rand(noise, [], "cluster", "other").collect() in ([], [(None,)])


def test_buyer_activity_counts_each_award_once(spark):
    tender = spark.createDataFrame([("t1", "b", "x"), ("t1", "b", "y"), ("t2", "b", "y"), ("t3", "c", "x")], "ocid string, buyer_id string, code string")
    award = spark.createDataFrame(
        [("b", "x", 1), ("b", "y", 1), ("b", "x", 2), ("b", "y", 2), ("b", "z", 3), ("b", "y", 4), ("d", "x", 5)],
        "buyer_id string, code string, award_uid long",
    )
    assert {r.ocid: r.activity for r in matrix.buyer_activity(tender, award).collect()} == {"t1": 3, "t2": 3}


def test_samples_do_not_depend_on_partitions(spark):
    df, _ = points(spark)
    pick = lambda d: {r.id for r in sampling.fixed_size(d, "id", 40).collect()}
    assert pick(df) == pick(df.repartition(7)) and len(pick(df)) == 40
    s = sampling.stratified(df, "cluster", "id", 30, 5).groupBy("cluster").count().collect()
    assert all(r["count"] >= 5 for r in s)


def test_isolation_forest_finds_a_far_row(spark):
    draw = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(draw.normal(size=(400, 2)))] + [(999, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    trees = outliers.grow_forests(df, "id", ["a", "b"], trees=40).collect()
    flagged = outliers.flag(outliers.score(df, "id", ["a", "b"], trees), []).collect()
    top = max(flagged, key=lambda r: r.score)
    assert top.id == 999 and top.outlier and 15 <= sum(r.outlier for r in flagged) <= 25
