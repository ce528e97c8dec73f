import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import toxicity
from tenderloom.llm.queries import op7_toxicity

FOLDER = "/root/testdata/sf0.1"


def loss(rows, grade, weight, weights, thresholds):
    score = np.array([weights[r].sum() for r in rows])
    border = np.concatenate([[-np.inf], thresholds, [np.inf]])
    cdf = lambda z: 1 / (1 + np.exp(-z))
    chance = cdf(border[grade + 1] - score) - cdf(border[grade] - score)
    return -(weight / weight.sum() * np.log(chance)).sum() + toxicity.RIDGE / 2 * (weights**2).sum()


def test_fit_is_a_minimum():
    rng = np.random.default_rng(2)
    rows = [sorted(set(rng.integers(0, 6, 3))) for _ in range(400)]
    truth = np.array([2.0, 1.0, 0.0, -1.0, 0.5, 1.5])
    noisy = np.array([truth[r].sum() for r in rows]) + rng.logistic(size=400)
    grade = np.digitize(noisy, [1.0, 2.5, 4.0])
    weight = rng.random(400) + 0.5
    weights, thresholds = toxicity.ordinal_fit(rows, grade, weight, 6)
    assert (np.diff(thresholds) > 0).all()
    best = loss(rows, grade, weight, weights, thresholds)
    for _ in range(200):
        other = loss(rows, grade, weight, weights + rng.normal(0, 0.1, 6), np.sort(thresholds + rng.normal(0, 0.1, 3)))
        assert best <= other + 1e-6
    assert np.corrcoef(weights, truth)[0, 1] > 0.95


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    model = toxicity.fit(docs, labels.filter(half == 0))
    out = toxicity.severities(docs, model).drop("toxic").join(labels.filter(half == 1), "doc_id")
    r = out.groupBy("toxic").agg(F.avg((F.col("p_toxic") >= 0.5).cast("int")).alias("share"), F.avg("expected_severity").alias("mean")).collect()
    found = {x.toxic: x for x in r}
    assert found[1].share > 0.85 and found[0].share < 0.01
    assert found[1].mean > 1 > 0.2 > found[0].mean


def test_probabilities_agree(spark):
    model = toxicity.Severity({"=bad": 3.0, "^worse": 2.0}, [1.0, 3.0, 4.5])
    rows = [(1, "BAD, bad!", 9), (2, "worsening bad", 9), (3, None, 9), (4, "", 9), (4, "", 9), (5, "fine " * 50000 + "bad", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = toxicity.severities(df.select("doc_id", "text"), model).collect()
    score = {1: 3.0, 2: 5.0, 3: 0.0, 4: 0.0, 5: 3.0}
    assert len(got) == 6
    for r in got:
        above = [1 / (1 + np.exp(t - score[r.doc_id])) for t in model.thresholds]
        each = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        assert r.expected_severity == pytest.approx(sum(above)) and r.grade == int(np.argmax(each)) and r.toxic == (above[0] >= 0.5)


@pytest.mark.parametrize("kinds", [[], [0], [1], [None]])
def test_without_both_labels_nothing_is_rejected(spark, tmp_path, kinds):
    docs = spark.createDataFrame([(i, "some bad words here", 1) for i in range(8)] + [(None, None, 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 0, k) for k in kinds for i in range(8)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = op7_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 9 and not any(r.toxic for r in got)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert op7_toxicity(spark, str(tmp_path)).count() == 0


def test_counts_leave_a_task_in_parts():
    rows = [(i % 2, " ".join(f"{'abcdefghij'[(i + k) % 10] * 4}{'xyz'[k % 3] * (i % 7)}" for k in range(20))) for i in range(300)]
    whole = list(toxicity._counts(iter(rows), 1 << 30))
    parts = list(toxicity._counts(iter(rows), 100))
    largest = max(len({f for w in t.split() for f in toxicity.features(w)}) for _, t in rows)
    assert len(whole) == 1 and len(parts) > 2 and max(len(p["feature"]) for p in parts) <= 100 + largest
    added = {}
    for p in parts:
        for f, toxic, clean in zip(p["feature"], p["toxic"], p["clean"]):
            old = added.get(f, (0, 0))
            added[f] = old[0] + toxic, old[1] + clean
    assert added == {f: (a, b) for f, a, b in zip(*whole[0].values())}
