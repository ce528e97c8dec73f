"""Supplier history: facts, profiles, eligibility and choice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed
from tenderloom.functions import nested
from tenderloom.functions.text import is_catalogue, normalise_modality
from tenderloom.operators.choose import first_by, mode
from tenderloom.session import cut_lineage


@dataclass
class History:
    """Award facts as flat tables; sources differ, the jobs below do not.

    lines           one row per award and named supplier (a supplier named twice
                    in an award gives two rows, an award without supplier one
                    row with a null supplier_id): supplier_id, supplier_name,
                    region, buyer_id, modality, amount; award_uid where an award may
                    have several lines
    items           one row per awarded item and named supplier: supplier_id, code, text
                    (either may be null)
    buyer_codes     buyer_id, code, award_uid   (awards without supplier included)
    """

    lines: DataFrame
    items: DataFrame
    buyer_codes: DataFrame

    @property
    def supplier_codes(self) -> DataFrame:
        return self.items.filter(F.col("code").isNotNull()).select("supplier_id", "code")

    @property
    def supplier_texts(self) -> DataFrame:
        return self.items.filter(F.col("text").isNotNull()).select("supplier_id", "text")


def history(releases: DataFrame) -> History:
    """Facts out of nested releases; everything is row-local explodes."""
    # An award is known by where it was read, else by all it says.
    read = ["position"] if "position" in releases.columns else []
    award = releases.select(
        "ocid",
        "source_year",
        "date",
        *read,
        F.nullif(F.col("buyer.id"), F.lit("")).alias("buyer_id"),
        F.nullif(F.col("tender.procurementMethodDetails"), F.lit("")).alias("modality"),
        nested.supplier_regions(F.col("parties")).alias("regions"),
        F.posexplode("awards").alias("award_pos", "award"),
    ).withColumn("codes", nested.main_codes(F.col("award.items")))
    said = ["source_year", *read] if read else ["source_year", "ocid", "date", "award"]
    award = award.withColumn("award_uid", F.sha2(F.to_json(F.struct(*said, "award_pos")), 256))
    named = award.select(
        "*",
        F.explode_outer(F.filter("award.suppliers", lambda s: s["id"] != "")).alias("supplier"),
    ).withColumn("supplier_id", F.col("supplier.id"))
    lines = named.select(
        "ocid",
        "supplier_id",
        F.nullif(F.trim("supplier.name"), F.lit("")).alias("supplier_name"),
        nested.region_of(F.col("regions"), F.col("supplier_id")).alias("region"),
        "buyer_id",
        "modality",
        F.col("award.value.amount").alias("amount"),
        "award_uid",
    )
    known = named.filter(F.col("supplier_id").isNotNull())
    return History(
        lines=lines,
        items=known.select("supplier_id", F.explode("award.items").alias("item")).select(
            "supplier_id",
            F.nullif(F.col("item.classification.id"), F.lit("")).alias("code"),
            F.nullif(F.col("item.description"), F.lit("")).alias("text"),
        ),
        buyer_codes=award.filter(F.col("buyer_id").isNotNull()).select(
            "buyer_id", F.explode("codes").alias("code"), "award_uid"
        ),
    )


def supplier_cells(lines: DataFrame) -> DataFrame:
    """One pass over the lines; every profile column is rolled up from these cells."""
    return (
        lines.filter(F.col("supplier_id").isNotNull())
        .groupBy("supplier_id", "supplier_name", "region", "modality")
        .agg(
            F.count("*").alias("n"),
            F.sum("amount").alias("amount"),
            F.count("amount").alias("n_amount"),
        )
    )


def modality_histogram(cells: DataFrame) -> DataFrame:
    """Map modality -> awards per supplier (the names are a short catalogue)."""
    label = F.coalesce("modality", F.lit(fixed.NO_DATA))
    counts = cells.groupBy("supplier_id", label.alias("modality")).agg(F.sum("n").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("modality", "n")))
    return counts.groupBy("supplier_id").agg(F.map_from_entries(entries).alias("modalities"))


def profiles(h: History) -> DataFrame:
    """One row per supplier.

    The code set and the corpus stay as the rows of ``supplier_codes`` and
    ``supplier_texts``; only their sizes are here, so no supplier's whole history
    is ever gathered in one place.
    """
    # Written once: totals, names, regions and modalities are rolled up from them.
    cells = cut_lineage(supplier_cells(h.lines))
    totals = cells.groupBy("supplier_id").agg(
        F.sum("n").alias("awards"),
        F.try_divide(F.sum("amount"), F.sum("n_amount")).alias("mean_amount"),
    )
    # One pass over the items: distinct codes first, sizes rolled up from them.
    items = (
        h.items.groupBy("supplier_id", "code")
        .agg(F.sum(F.length("text")).alias("chars"), F.count("text").alias("texts"))
        .groupBy("supplier_id")
        .agg(
            F.count("code").alias("n_codes"),
            (F.sum("chars") + F.sum("texts") - 1).alias("corpus_length"),
        )
    )
    return (
        totals.join(mode(cells, ["supplier_id"], "supplier_name", "name", "n").drop("name_n"), "supplier_id", "left")
        .join(mode(cells, ["supplier_id"], "region", "province", "n").drop("province_n"), "supplier_id", "left")
        .join(items, "supplier_id", "left")
        .join(modality_histogram(cells), "supplier_id", "left")
        .select(
            "supplier_id",
            "name",
            "awards",
            "mean_amount",
            "province",
            F.coalesce("n_codes", F.lit(0)).alias("n_codes"),
            F.coalesce("corpus_length", F.lit(0)).alias("corpus_length"),
            "modalities",
        )
    )


def corpus_rows(texts: DataFrame, order: list[str]) -> DataFrame:
    """The ordered corpus as sorted rows; readers concatenate as they stream."""
    return texts.orderBy("supplier_id", *order, "text")


def supplier_buyer_counts(lines: DataFrame) -> DataFrame:
    return (
        lines.filter(F.col("supplier_id").isNotNull() & F.col("buyer_id").isNotNull())
        .groupBy("supplier_id", "buyer_id")
        .agg(F.count("*").alias("n_awards"))
    )


def buyer_code_facts(h: History) -> DataFrame:
    return h.buyer_codes.distinct()


def run_counters(h: History, profile: DataFrame) -> DataFrame:
    """Counters of a profile run, one row; an award with several suppliers counts once."""
    awards = h.lines.dropDuplicates(["award_uid"]) if "award_uid" in h.lines.columns else h.lines
    lines = awards.agg(
        F.count_if(F.col("supplier_id").isNull()).alias("awards_without_supplier"),
        F.count_if(F.col("amount").isNull()).alias("lines_without_amount"),
    )
    return profile.agg(
        F.count("*").alias("suppliers"),
        F.count("province").alias("with_province"),
        F.count_if(F.col("corpus_length") > 0).alias("with_corpus"),
        F.count("mean_amount").alias("with_amount"),
    ).select("*", *[lines.select(c).scalar().alias(c) for c in lines.columns])


def eligible(
    profile: DataFrame,
    provinces: list[str] | None = None,
    competitive: list[str] | None = None,
    min_competitive: int = fixed.MIN_COMPETITIVE_AWARDS,
    min_codes: int = fixed.MIN_CODES,
    max_catalogue: float = fixed.MAX_CATALOGUE_SHARE,
) -> DataFrame:
    """Suppliers with a competitive, varied and complete history."""
    competitive = competitive or fixed.COMPETITIVE_MODALITIES
    entries = F.map_entries("modalities")

    def total(entry_filter):
        return F.aggregate(
            F.filter(entries, entry_filter), F.lit(0).cast("long"), lambda acc, e: acc + e["value"]
        )

    return (
        profile.filter(
            F.col("province").isin(*(provinces or list(fixed.PROVINCES)))
            & (F.col("corpus_length") > 0)
            & F.col("mean_amount").isNotNull()
            & (F.col("n_codes") >= min_codes)
        )
        .withColumn("competitive_awards", total(lambda e: e["key"].isin(*competitive)))
        .withColumn(
            "catalogue_share", F.try_divide(total(lambda e: is_catalogue(e["key"])), F.col("awards"))
        )
        .filter(
            (F.col("catalogue_share") < max_catalogue)
            & (F.col("competitive_awards") >= min_competitive)
        )
    )


def normalised_modalities(profile: DataFrame, kept: DataFrame) -> DataFrame:
    """A supplier's modality counts under the tenders' own normalised names."""
    return (
        profile.withColumn("_kept", kept.scalar())
        .select("supplier_id", "_kept", F.explode("modalities").alias("raw", "n"))
        .groupBy("supplier_id", normalise_modality(F.col("raw"), F.col("_kept")).alias("modality"))
        .agg(F.sum("n").alias("n"))
    )


def pick_distinct_provinces(
    candidates: DataFrame, n: int = 3, priority: list[str] | None = None
) -> DataFrame:
    """Best supplier of n different provinces, the priority provinces first."""
    order = [F.col("competitive_awards").desc(), F.col("supplier_id")]
    best = first_by(candidates, ["province"], order)
    rank = F.lit(0)
    for at, name in enumerate(priority or fixed.PRIORITY_PROVINCES):
        rank = F.when(F.col("province") == name, at - 1000).otherwise(rank)
    chosen = best.withColumn("_first", rank).orderBy("_first", *order).limit(n).drop("_first")
    return chosen.orderBy(*order)


def top_two_lists(candidates: DataFrame, n: int = 8) -> DataFrame:
    """Union of the n largest by awards and by non-catalogue awards, order kept.

    ``candidates``: supplier_id, awards, catalogue_awards, already filtered.
    """
    other = F.col("awards") - F.col("catalogue_awards")

    def ranked(measure, base):
        top = candidates.orderBy(measure.desc(), "supplier_id").limit(n)
        # n rows at most: numbering them in one place is the size of the report.
        return top.agg(
            F.sort_array(F.collect_list(F.struct((-measure).alias("m"), "supplier_id"))).alias("r")
        ).select(F.posexplode("r").alias("pos", "r")).select(
            (F.col("pos") + base).alias("position"), F.col("r.supplier_id").alias("supplier_id")
        )

    return (
        ranked(F.col("awards"), 0)
        .unionByName(ranked(other, n))
        .groupBy("supplier_id")
        .agg(F.min("position").alias("position"))
    )


def lookup_by_digits(profile: DataFrame, digits: str) -> DataFrame:
    """The profile whose compound id carries these 13 digits; largest first."""
    from tenderloom.functions.text import tax_id

    return (
        profile.filter(tax_id(F.col("supplier_id")) == digits)
        .orderBy(F.col("awards").desc(), "supplier_id")
        .limit(1)
    )


def lookup_by_name(profile: DataFrame, text: str) -> DataFrame:
    """First profile whose name contains the text, ignoring case."""
    found = F.contains(F.upper("name"), F.lit(text.upper().replace(" S.A.", "").strip()))
    return profile.filter(found).orderBy(F.col("awards").desc(), "supplier_id").limit(1)
