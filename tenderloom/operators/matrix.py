"""The interaction matrix: every chosen supplier against every open tender.

Everything per tender is computed once with one column per supplier, joined on the
tender and only then opened into (supplier, tender) rows, so the number of shuffles
does not grow with the number of suppliers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.codes import char_prefix, digit_prefix
from tenderloom.functions.geo import haversine_km
from tenderloom.operators import textsim

SUPPLIERS_PER_PASS = 32


@dataclass
class Market:
    """What the tenders and the history offer to any supplier.

    tenders         ocid, buyer_id, buyer_province, budget, modality (+ extras)
    tender_codes    ocid, buyer_id, code
    tender_terms    ocid, token, tf
    buyer_codes     buyer_id, code and what names the award, one column or several (may repeat)
    supplier_buyer  supplier_id, buyer_id, n_awards
    supplier_codes  supplier_id, code
    supplier_terms  supplier_id, token, tf
    provinces       province, lat, lon
    """

    tenders: DataFrame
    tender_codes: DataFrame
    tender_terms: DataFrame
    buyer_codes: DataFrame
    supplier_buyer: DataFrame
    supplier_codes: DataFrame
    supplier_terms: DataFrame
    provinces: DataFrame


def buyer_activity(tender_codes: DataFrame, buyer_codes: DataFrame) -> DataFrame:
    """(ocid, activity): distinct awards of the tender's buyer sharing a full code.

    Tenders and awards with equal code sets are collapsed first, so copies meet
    once with a weight. A pair of sets sharing several codes is kept only at its
    smallest shared code, so no second deduplication is needed. Any columns of
    ``buyer_codes`` beside buyer and code name the award.
    """
    award = [c for c in buyer_codes.columns if c not in ("buyer_id", "code")]
    tender_sets = tender_codes.groupBy("ocid", "buyer_id").agg(
        F.sort_array(F.collect_set("code")).alias("codes")
    )
    award_sets = (
        buyer_codes.groupBy(*award, "buyer_id")
        .agg(F.sort_array(F.collect_set("code")).alias("award_codes"))
        .groupBy("buyer_id", "award_codes")
        .agg(F.count("*").alias("n"))
    )
    left = tender_sets.select("buyer_id", "codes").distinct()
    # With each code of an award go the smaller ones, mostly none.
    opened = award_sets.select("buyer_id", "n", F.posexplode("award_codes").alias("at", "code"), "award_codes")
    opened = opened.select("buyer_id", "n", "code", F.slice("award_codes", F.lit(1), F.col("at")).alias("smaller"))
    pairs = (
        left.select("*", F.explode("codes").alias("code"))
        .join(opened, ["buyer_id", "code"])
        .filter(~F.arrays_overlap("codes", "smaller"))
    )
    by_set = pairs.groupBy("buyer_id", "codes").agg(F.sum("n").alias("activity"))
    return tender_sets.join(by_set, ["buyer_id", "codes"]).select("ocid", "activity")


def prefix_overlap(
    tender_codes: DataFrame, supplier_codes: DataFrame, suppliers: list[str], n: int = 4
) -> DataFrame:
    """(ocid, jaccards): overlap of n-character code prefixes by supplier position."""
    mine = (
        supplier_codes.filter(F.col("supplier_id").isin(*suppliers))
        .select("supplier_id", char_prefix(F.col("code"), n).alias("prefix"))
        .filter(F.col("prefix").isNotNull())
        .distinct()
    )
    flags = mine.groupBy("prefix").agg(
        *[
            F.max((F.col("supplier_id") == s).cast("int")).alias(f"f{i}")
            for i, s in enumerate(suppliers)
        ]
    )
    sizes = mine.agg(
        F.array(
            *[F.count_if(F.col("supplier_id") == s) for s in suppliers]
        ).alias("sizes")
    ).scalar()
    prefixes = (
        tender_codes.select("ocid", char_prefix(F.col("code"), n).alias("prefix"))
        .filter(F.col("prefix").isNotNull())
        .distinct()
    )
    # Prefixes of n characters of the few suppliers' codes: 10,000 of four digits at most.
    shared = prefixes.join(F.broadcast(flags), "prefix", "left").groupBy("ocid").agg(
        F.count("*").alias("n"),
        *[F.sum(F.coalesce(f"f{i}", F.lit(0))).alias(f"m{i}") for i in range(len(suppliers))],
    )
    return shared.withColumn("_sizes", sizes).select(
        "ocid",
        F.array(
            *[
                F.coalesce(
                    F.try_divide(F.col(f"m{i}"), F.col("n") + F.col("_sizes")[i] - F.col(f"m{i}")),
                    F.lit(0.0),
                )
                for i in range(len(suppliers))
            ]
        ).alias("jaccards"),
    )


def distance_medians(tenders: DataFrame, provinces: DataFrame, portfolio: list[dict]) -> DataFrame:
    """One array: each supplier's median distance to the tenders of known province."""
    # At most one row per province.
    counts = tenders.groupBy("buyer_province").agg(F.count("*").alias("n"))
    located = counts.join(F.broadcast(provinces), F.col("buyer_province") == F.col("province"))
    return located.agg(
        F.array(
            *[F.coalesce(F.percentile(_km(p), 0.5, F.col("n")), F.lit(0.0)) for p in portfolio]
        ).alias("medians")
    )


def _km(supplier: dict):
    return haversine_km(
        F.lit(supplier["lat"]), F.lit(supplier["lon"]), F.col("lat"), F.col("lon")
    )


def portfolio_rows(chosen: DataFrame, provinces: DataFrame) -> list[dict]:
    """The chosen suppliers as parameters of the job (a short, caller-sized list)."""
    located = chosen.join(F.broadcast(provinces), "province")
    rows = located.select("supplier_id", "province", "mean_amount", "awards", "n_codes", "lat", "lon")
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: (-r["awards"], r["supplier_id"]))


def interaction_matrix(market: Market, portfolio: list[dict], carry: list[str] | None = None) -> DataFrame:
    """One row per (supplier, tender) with six numeric variables and the modality.

    Longer lists are split into passes, so any number of suppliers works.
    """
    chunks = [
        portfolio[i : i + SUPPLIERS_PER_PASS] for i in range(0, len(portfolio), SUPPLIERS_PER_PASS)
    ]
    return reduce(DataFrame.unionByName, [_one_pass(market, c, carry or []) for c in chunks])


def _one_pass(market: Market, portfolio: list[dict], carry: list[str]) -> DataFrame:
    ids = [p["supplier_id"] for p in portfolio]
    n_tenders = market.tenders.agg(F.count("*"))
    sims = textsim.similarities(market.tender_terms, n_tenders, market.supplier_terms, ids)
    overlap = prefix_overlap(market.tender_codes, market.supplier_codes, ids)
    activity = buyer_activity(market.tender_codes, market.buyer_codes)
    known_buyers = (
        market.supplier_buyer.filter(F.col("supplier_id").isin(*ids))
        .groupBy("buyer_id")
        .agg(
            F.array(
                *[
                    F.coalesce(
                        F.sum(F.when(F.col("supplier_id") == s, F.col("n_awards"))),
                        F.lit(0).cast("long"),
                    )
                    for s in ids
                ]
            ).alias("dealings")
        )
    )
    medians = distance_medians(market.tenders, market.provinces, portfolio).scalar()
    located = market.tenders.join(
        F.broadcast(market.provinces.withColumnRenamed("province", "buyer_province")),
        "buyer_province",
        "left",
    )
    wide = (
        located.join(known_buyers, "buyer_id", "left")
        .join(overlap, "ocid", "left")
        .join(sims, "ocid", "left")
        .join(activity, "ocid", "left")
        .withColumn("_medians", medians)
    )
    log_budget = F.log1p("budget")

    def at(array: str, i: int, kind: str = "double"):
        return F.coalesce(F.get(array, F.lit(i)), F.lit(0)).cast(kind)

    per_supplier = [
        F.struct(
            F.lit(p["supplier_id"]).alias("supplier_id"),
            F.coalesce(_km(p), F.get("_medians", F.lit(i))).alias("distance_km"),
            at("jaccards", i).alias("code_jaccard4"),
            at("sims", i).alias("text_sim"),
            (log_budget - F.log1p(F.lit(float(p["mean_amount"])))).alias("budget_deviation"),
            F.log1p(at("dealings", i)).alias("buyer_affinity"),
        )
        for i, p in enumerate(portfolio)
    ]
    return wide.select(
        "ocid",
        F.coalesce("activity", F.lit(0)).cast("double").alias("buyer_code_activity"),
        log_budget.alias("log_budget"),
        F.col("lat").isNull().alias("imputed_distance"),
        "modality",
        *carry,
        F.explode(F.array(*per_supplier)).alias("s"),
    ).select(
        "s.supplier_id", "ocid", *[f"s.{c}" for c in
        ["distance_km", "code_jaccard4", "text_sim", "budget_deviation"]],
        "buyer_code_activity", "s.buyer_affinity", "log_budget", "modality", "imputed_distance",
        *carry,
    )


def matrix_summary(matrix: DataFrame) -> DataFrame:
    """Run metadata per supplier: non-zero shares, means, extremes."""
    nonzero = lambda c: 100.0 * F.avg((F.col(c) > 0).cast("double"))
    return matrix.groupBy("supplier_id").agg(
        F.count("*").alias("tenders"),
        F.count_if("imputed_distance").alias("unknown_provinces"),
        F.max(F.when(F.col("imputed_distance"), F.col("distance_km"))).alias("median_distance"),
        nonzero("code_jaccard4").alias("pct_jaccard_nonzero"),
        F.avg("code_jaccard4").alias("mean_jaccard"),
        F.avg("text_sim").alias("mean_similarity"),
        nonzero("buyer_affinity").alias("pct_affinity_nonzero"),
        F.avg("buyer_affinity").alias("mean_affinity"),
        F.max("buyer_affinity").alias("max_affinity"),
        F.count_if(F.col("buyer_affinity") > 0).alias("known_buyer_tenders"),
    )


def code_depth(
    tender_codes: DataFrame, supplier_codes: DataFrame, depth: int = 5
) -> DataFrame:
    """(ocid, supplier_id, score): mean over codes, repeats included, of the deepest
    prefix level whose every shorter prefix also matches, over ``depth``.

    Only supplier-tender pairs sharing a first digit appear; the rest score 0.
    ``supplier_codes`` holds the few suppliers under diagnosis.
    """
    # Level n counts for a code only when levels 1..n all match, and a shared
    # n-prefix implies the shorter ones, so the deepest match is a count of levels.
    levels = F.explode(
        F.array_compact(F.array(*[digit_prefix(F.col("code"), n) for n in range(1, depth + 1)]))
    )
    mine = supplier_codes.select("supplier_id", levels.alias("prefix")).distinct()
    totals = tender_codes.groupBy("ocid").agg(F.count("*").alias("n_codes"))
    matched = (
        tender_codes.select("ocid", levels.alias("prefix"))
        # Prefixes of ``depth`` digits at most: 111,110 a supplier for five, whatever the tables.
        .join(F.broadcast(mine), "prefix")
        .groupBy("ocid", "supplier_id")
        .agg(F.count("*").alias("levels"))
    )
    return matched.join(totals, "ocid").select(
        "ocid", "supplier_id", (F.col("levels") / (depth * F.col("n_codes"))).alias("score")
    )


def buyer_prefix_activity(
    completed_codes: DataFrame, supplier_codes: DataFrame, n: int = 3
) -> DataFrame:
    """(buyer_id, processes): completed processes of a buyer sharing an n-digit prefix
    with one supplier. ``completed_codes``: ocid, buyer_id, code."""
    mine = supplier_codes.select(digit_prefix(F.col("code"), n).alias("prefix")).filter(
        F.col("prefix").isNotNull()
    ).distinct()
    return (
        completed_codes.select("ocid", "buyer_id", digit_prefix(F.col("code"), n).alias("prefix"))
        .join(mine, "prefix", "left_semi")
        .select("buyer_id", "ocid")
        .distinct()
        .groupBy("buyer_id")
        .agg(F.count("*").alias("processes"))
    )
