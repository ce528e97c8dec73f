"""The frozen model and label vectors as small Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderloom import fixed
from tenderloom.operators import gower
from tenderloom.operators.serving import FrozenModel

_PARTS = {
    "params": "variable string, low double, high double, mean double, scale double, range double",
    "medoids": "cluster long, ocid string, modality string, "
    + ", ".join(f"z_{v} double" for v in fixed.NUMERIC),
    "categories": "category string",
    "trees": "forest string, tree int, node int, feature int, cut double, depth double, sample long",
    "threshold": "threshold double",
}


def save_model(spark: SparkSession, model: FrozenModel, path: str) -> None:
    rows = {
        "params": [(v, *map(float, model.scaling[v])) for v in fixed.NUMERIC],
        "medoids": [
            (int(m["cluster"]), str(m["ocid"]), m["modality"], *[float(m[f"z_{v}"]) for v in fixed.NUMERIC])
            for m in model.medoids
        ],
        "categories": [(c,) for c in model.categories],
        "trees": [
            (t["forest"], t["tree"], t["node"], t["feature"], t["cut"], t["depth"], int(t["sample"]))
            for t in model.trees
        ],
        "threshold": [(model.threshold,)] if model.threshold is not None else [],
    }
    for part, schema in _PARTS.items():
        spark.createDataFrame(rows[part], schema).write.mode("overwrite").parquet(f"{path}/{part}")


def load_model(spark: SparkSession, path: str) -> FrozenModel:
    """Read the model; missing tables and missing required fields are named in the error."""
    tables, missing = {}, []
    for part, schema in _PARTS.items():
        try:
            tables[part] = [r.asDict() for r in spark.read.schema(schema).parquet(f"{path}/{part}").collect()]
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            missing.append(part)
    if missing:
        raise FileNotFoundError(f"model tables missing under {path}: {', '.join(missing)}")
    scaling = {r["variable"]: (r["low"], r["high"], r["mean"], r["scale"], r["range"]) for r in tables["params"]}
    absent = [v for v in fixed.NUMERIC if v not in scaling or None in scaling[v]]
    if absent or not tables["medoids"]:
        raise ValueError(f"model under {path} lacks {absent or 'medoids'}; fit it again")
    cut = tables["threshold"][0]["threshold"] if tables["threshold"] else None
    return FrozenModel(
        scaling=scaling,
        medoids=tables["medoids"],
        categories=[r["category"] for r in tables["categories"]],
        trees=tables["trees"],
        threshold=cut,
    )


def save_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").parquet(path)


def verified_labels(
    spark: SparkSession, path: str, prepared: DataFrame, row_id: str, recorded: float, tolerance: float = 1e-4
) -> DataFrame:
    """Saved labels joined to the prepared rows, refused when their silhouette has moved."""
    joined = prepared.join(spark.read.parquet(path), row_id)
    names = gower.labels_of(joined, "cluster")
    found = gower.silhouette(joined, [], row_id, "cluster", names).first()["silhouette"]
    if found is None or abs(found - recorded) > tolerance:
        raise ValueError(f"labels under {path} score {found}, recorded {recorded}")
    return joined
