"""Parquet, CSV and JSON tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: column names of the exchange tables and the names used here ----
EXCHANGE = {
    "profiles": {
        "proveedor_id": "supplier_id",
        "nombre": "name",
        "num_adjudicaciones": "awards",
        "monto_promedio_ganado": "mean_amount",
        "provincia": "province",
        "n_cpc_historicos": "n_codes",
        "len_corpus": "corpus_length",
        "modalidades_hist_json": "modalities",
    },
    "buyer_codes": {"buyer_id": "buyer_id", "cpc": "code", "award_uid": "award_uid"},
    "supplier_buyer": {"proveedor_id": "supplier_id", "buyer_id": "buyer_id", "n_awards": "n_awards"},
    "tenders": {
        "ocid": "ocid",
        "anio_archivo": "source_year",
        "fecha": "date",
        "buyer_id": "buyer_id",
        "provincia_buyer": "buyer_province",
        "presupuesto": "budget",
        "origen_presupuesto": "budget_origin",
        "cpc_tender": "codes",
        "n_cpc_tender": "n_codes",
        "texto_items": "text",
        "modalidad_norm": "modality",
    },
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def to_exchange(df: DataFrame, kind: str) -> DataFrame:
    """Rename to the exchange layout; code arrays are joined, the histogram becomes JSON."""
    out = df
    if kind == "tenders":
        out = out.withColumn("n_codes", F.size("codes")).withColumn(
            "codes", F.array_join(F.sort_array("codes"), "|")
        )
    if kind == "profiles":
        out = out.withColumn("modalities", F.to_json("modalities"))
    return out.select(*[F.col(here).alias(there) for there, here in EXCHANGE[kind].items()])


def from_exchange(df: DataFrame, kind: str) -> DataFrame:
    """Read the exchange layout back into arrays and maps."""
    out = df.select(*[F.col(there).alias(here) for there, here in EXCHANGE[kind].items()])
    if kind == "tenders":
        codes = F.array_remove(F.split("codes", r"\|"), "")
        out = out.withColumn("codes", codes).drop("n_codes")
    if kind == "profiles":
        out = out.withColumn("modalities", F.from_json("modalities", "map<string,long>"))
    return out


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a stated schema, so ids stay text."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """Rows of a report table as JSON lines."""
    df.write.mode("overwrite").json(path)


def modality_document(tenders: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: the kept names and the categories in use."""
    return tenders.agg(F.sort_array(F.collect_set("modality")).alias("categories")).withColumn(
        "kept", kept.scalar()
    )
