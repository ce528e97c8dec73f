"""Open tenders: extraction, discard reasons, deduplication, modality names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed
from tenderloom.functions import nested
from tenderloom.functions.text import collapse_catalogue, is_catalogue, normalise_modality
from tenderloom.operators.choose import keep_last_read


def open_processes(releases: DataFrame) -> DataFrame:
    """Active processes with the columns the final method needs, one row per release."""
    value, lots = F.col("tender.value.amount"), nested.amount_sum(F.col("tender.lots"))
    amount, origin = nested.budget(value, lots)
    return releases.filter(F.col("tender.status") == "active").select(
        "ocid",
        "source_year",
        "position",
        F.substring("date", 1, 10).alias("date"),
        F.nullif(F.col("buyer.id"), F.lit("")).alias("buyer_id"),
        nested.role_region(F.col("parties"), ["buyer"]).alias("buyer_province"),
        amount.alias("budget"),
        origin.alias("budget_origin"),
        nested.main_codes(F.col("tender.items")).alias("codes"),
        F.array_join(nested.item_texts(F.col("tender.items")), " ").alias("text"),
        F.col("tender.procurementMethodDetails").alias("raw_modality"),
    )


def with_reason(processes: DataFrame) -> DataFrame:
    """First reason for which a process cannot be used, null when usable."""
    return processes.withColumn(
        "reason",
        nested.first_failure(
            [
                ("sin_buyer", F.col("buyer_id").isNull()),
                ("sin_presupuesto", F.col("budget").isNull()),
            ]
        ),
    )


def discard_counts(processes: DataFrame) -> DataFrame:
    return (
        with_reason(processes)
        .filter(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count("*").alias("n"))
    )


def kept_modalities(processes: DataFrame, n: int = fixed.KEPT_MODALITIES) -> DataFrame:
    """One row, one array: the n most frequent non-catalogue names.

    Nulls are filled before counting, so the other-label may be among them.
    """
    name = F.coalesce("raw_modality", F.lit(fixed.OTHER_MODALITY))
    counts = (
        processes.filter(~is_catalogue(F.col("raw_modality")))
        .groupBy(name.alias("name"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "name")
        .limit(n)
    )
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "name")))
    return counts.agg(F.transform(ordered, lambda e: e["name"]).alias("kept"))


def active_tenders(processes: DataFrame) -> DataFrame:
    """Usable open processes, last version each, with their normalised modality."""
    usable = with_reason(processes).filter(F.col("reason").isNull()).drop("reason")
    latest = keep_last_read(usable)
    return (
        latest.withColumn("_kept", kept_modalities(latest).scalar())
        .withColumn("modality", normalise_modality(F.col("raw_modality"), F.col("_kept")))
        .drop("_kept", "raw_modality", "position")
    )


def first_round_processes(releases: DataFrame) -> DataFrame:
    """Active processes under the first round's fallbacks, with the discard reason."""
    items, items_origin = nested.process_items()
    amount, amount_origin = nested.process_amount(
        F.col("tender.value.amount"),
        nested.amount_sum(F.col("tender.lots")),
        nested.amount_sum(F.col("awards")),
    )
    rows = (
        releases.filter(F.col("tender.status") == "active")
        .withColumn("_items", items)
        .select(
            F.coalesce("ocid", "id").alias("ocid"),
            F.col("buyer.id").alias("buyer_id"),
            collapse_catalogue(F.col("tender.procurementMethodDetails")).alias("modality"),
            nested.role_region(F.col("parties"), ["buyer", "procuringEntity"], True).alias(
                "buyer_province"
            ),
            F.size("_items").alias("n_items"),
            items_origin.alias("items_origin"),
            nested.process_text(F.col("_items")).alias("text"),
            nested.all_codes(F.col("_items")).alias("codes"),
            amount.alias("amount"),
            amount_origin.alias("amount_origin"),
        )
    )
    return rows.withColumn(
        "reason",
        nested.first_failure(
            [
                ("sin_modalidad", F.col("modality").isNull()),
                ("sin_provincia_comprador", F.col("buyer_province").isNull()),
                ("sin_items", F.col("n_items") == 0),
                ("sin_texto", F.trim("text") == ""),
                ("sin_cpc", F.size("codes") == 0),
                ("sin_monto", F.col("amount").isNull()),
            ]
        ),
    )
