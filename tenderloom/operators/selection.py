"""Choosing a model: baselines, disqualification, roll-ups and reports.

All inputs here are report tables with a few hundred rows at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderloom import fixed


def nearest_baseline(metrics: DataFrame, baselines: DataFrame, by: list[str]) -> DataFrame:
    """Add ``random_baseline`` for the partition's group count, else the nearest one.

    ``baselines``: by, k, silhouette.
    """
    listed = baselines.filter(F.col("silhouette").isNotNull()).groupBy(*by).agg(
        F.collect_list(F.struct("k", F.col("silhouette").alias("s"))).alias("_b")
    )
    joined = metrics.join(listed, by, "left") if by else metrics.withColumn("_b", listed.scalar())
    closest = F.array_min(
        F.transform("_b", lambda b: F.struct(F.abs(b["k"] - F.col("groups")).alias("gap"), b["k"].alias("k"), b["s"].alias("s")))
    )
    return joined.withColumn("random_baseline", closest["s"]).drop("_b")


def disqualify(metrics: DataFrame) -> DataFrame:
    """Add ``disqualified`` and ``reasons`` from the partition metrics.

    Needs silhouette, ari_category, ari_quartile, entropy, coverage,
    random_baseline and category_baseline.
    """
    s = F.col("silhouette")
    checks: list[tuple[Column, str]] = [
        (F.col("ari_category") > fixed.MAX_COPY_ARI, "copies the category"),
        (F.col("ari_quartile") > fixed.MAX_COPY_ARI, "copies the budget quartile"),
        (s.isNull(), "silhouette not computable"),
        (s <= F.col("random_baseline"), "not above the random baseline"),
        (s <= F.col("category_baseline"), "not above the category baseline"),
        (F.col("entropy") < fixed.MIN_ENTROPY, "sizes too uneven"),
        (F.col("coverage") < fixed.MIN_COVERAGE, "coverage too low"),
    ]
    reasons = F.concat_ws("; ", *[F.when(test, text) for test, text in checks])
    return metrics.withColumn("reasons", reasons).withColumn("disqualified", F.col("reasons") != "")


def candidate_rollup(results: DataFrame, suppliers: int) -> DataFrame:
    """One row per (algorithm, k) over all suppliers.

    Missing in any supplier or disqualified in any supplier disqualifies; the mean
    silhouette is null when any is null. A density row has no k of its own: each
    supplier's single result stands for every group count seen.
    """
    density = results.filter(F.col("algorithm") == "density")
    ks = density.select("k").distinct()
    # Both sides are a handful of report rows: one per supplier, one per group count.
    spread = density.drop("k").join(ks.withColumn("algorithm", F.lit("density")), "algorithm")
    rows = results.filter(F.col("algorithm") != "density").unionByName(spread)
    missing = F.lit(suppliers) - F.count("*")
    named = F.sort_array(
        F.collect_list(
            F.when(F.col("disqualified"), F.concat_ws(": ", "supplier", "reasons"))
        )
    )
    parts = F.array_join(
        F.concat(
            F.when(missing > 0, F.array(F.concat(missing.cast("string"), F.lit(" without a partition")))).otherwise(
                F.array().cast("array<string>")
            ),
            named,
        ),
        " | ",
    )
    means = ["davies_bouldin", "calinski_harabasz", "ari_category", "ari_quartile", "entropy", "coverage",
             "random_baseline", "category_baseline", "groups"]
    return rows.groupBy("algorithm", "k").agg(
        F.when(F.count("silhouette") == F.count("*"), F.avg("silhouette")).alias("silhouette"),
        *[F.avg(c).alias(c) for c in means],
        F.count("*").alias("suppliers"),
        (F.bool_or("disqualified") | (missing > 0)).alias("disqualified"),
        parts.alias("reasons"),
    )


def best_per_algorithm(candidates: DataFrame) -> DataFrame:
    """Best k of each algorithm among the admitted, else the best disqualified one."""
    usable = F.col("silhouette").isNotNull()
    # One row per (algorithm, k).
    window = Window.partitionBy("algorithm").orderBy(
        (~usable).cast("int"), F.col("disqualified").cast("int"), F.col("silhouette").desc(), "k"
    )
    best = candidates.withColumn("_r", F.row_number().over(window)).filter("_r = 1").drop("_r")
    state = (
        F.when(~usable, "no valid output").when(F.col("disqualified"), "disqualified").otherwise("admitted")
    )
    return best.withColumn("state", state).withColumn("k", F.when(usable, F.col("k")))


def winner(best: DataFrame, n: int = 2) -> DataFrame:
    """Winner and runner-up: silhouette down, Davies-Bouldin up."""
    return (
        best.filter(F.col("state") == "admitted")
        .orderBy(F.col("silhouette").desc(), F.col("davies_bouldin"), "algorithm")
        .limit(n)
    )


def best_supplier(results: DataFrame, algorithm: str, k: int | None) -> DataFrame:
    """The supplier on which the winning configuration scores highest."""
    rows = results.filter(F.col("algorithm") == algorithm)
    if k is not None and algorithm != "density":
        rows = rows.filter(F.col("k") == k)
    return rows.filter(F.col("silhouette").isNotNull()).orderBy(F.col("silhouette").desc(), "supplier").limit(1)


def first_round_decision(table: DataFrame) -> DataFrame:
    """Add admission, reasons, rank and tie flag under the first round's rule.

    ``table``: algorithm, silhouette, coverage, ari (stability).
    """
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("silhouette").isNull(), "no silhouette"),
        F.when(F.col("coverage") < fixed.FIRST_ROUND_MIN_COVERAGE, "coverage below 90 %"),
        F.when(F.coalesce(F.col("ari") < fixed.FIRST_ROUND_MIN_ARI, F.lit(True)), "stability below 0.60"),
    )
    marked = table.withColumn("reasons", reasons).withColumn("admitted", F.col("reasons") == "")
    # Six algorithms.
    window = Window.partitionBy("admitted").orderBy(F.col("silhouette").desc_nulls_last(), "algorithm")
    ranked = marked.withColumn("rank", F.when(F.col("admitted"), F.row_number().over(window)))
    top = F.max(F.when(F.col("admitted"), F.col("silhouette"))).over(Window.partitionBy("admitted"))
    gap = top - F.col("silhouette")
    return ranked.withColumn(
        "technical_tie", F.coalesce((F.col("rank") == 2) & (gap < fixed.FIRST_ROUND_TIE), F.lit(False))
    )


def portfolio_summary(comparison: DataFrame) -> DataFrame:
    """Per algorithm: mean silhouette, median k, mean entropy and coverage, any failure."""
    return comparison.groupBy("algorithm").agg(
        F.avg("silhouette").alias("silhouette"),
        F.median("k").alias("k"),
        F.avg("entropy").alias("entropy"),
        F.avg("coverage").alias("coverage"),
        F.bool_or("disqualified").alias("disqualified"),
    )


def pivot_mean(table: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """row x column grid with the row mean."""
    grid = table.groupBy(row).pivot(column, columns).agg(F.avg(value))
    means = table.groupBy(row).agg(F.avg(value).alias("mean"))
    return grid.join(means, row)


def baseline_summary(baselines: DataFrame, winning: DataFrame) -> DataFrame:
    """Per supplier: strongest and mean random baseline, category baseline, winner.

    ``baselines``: supplier, baseline, k, silhouette; ``winning``: supplier, silhouette.
    """
    random = F.col("baseline") == "random"
    table = baselines.groupBy("supplier").agg(
        F.max(F.when(random, F.col("silhouette"))).alias("random_max"),
        F.avg(F.when(random, F.col("silhouette"))).alias("random_mean"),
        F.max(F.when(~random, F.col("silhouette"))).alias("category"),
    )
    return table.join(winning.select("supplier", F.col("silhouette").alias("winner")), "supplier")


def round_comparison(rounds: dict[str, DataFrame]) -> DataFrame:
    """Rounds side by side by algorithm; an absent algorithm reads n/d."""
    sides = []
    for name, table in rounds.items():
        text = F.concat(
            F.format_string("%.4f", "silhouette"), F.lit(" k="),
            F.coalesce(F.col("k").cast("int").cast("string"), F.lit("n/d")), F.lit(" "), F.col("state"),
        )
        sides.append(table.select("algorithm", F.coalesce(text, F.lit("n/d")).alias(name)))
    merged = reduce(lambda a, b: a.join(b, "algorithm", "full"), sides)
    return merged.select("algorithm", *[F.coalesce(n, F.lit("n/d")).alias(n) for n in rounds])


def comparison_table(results: DataFrame, best: DataFrame, average: str = "average") -> DataFrame:
    """Per supplier rows at each algorithm's best k, then the portfolio mean rows."""
    chosen = best.select("algorithm", F.col("k").alias("best_k"), "state")
    columns = ["silhouette", "davies_bouldin", "calinski_harabasz", "ari_category", "ari_quartile", "entropy",
               "coverage"]
    own = results.join(chosen, "algorithm").filter(
        (F.col("algorithm") == "density") | (F.col("k") == F.col("best_k"))
    ).select("algorithm", "supplier", "best_k", *columns, "disqualified")
    means = best.select(
        "algorithm", F.lit(average).alias("supplier"), F.col("k").alias("best_k"), *columns,
        (F.col("state") != "admitted").alias("disqualified"),
    )
    return own.unionByName(means)


def without_averages(comparison: DataFrame, average: str = "average") -> DataFrame:
    return comparison.filter(~F.contains(F.col("supplier"), F.lit(average)))


def notices(shares: DataFrame, ari_category: DataFrame, bic: DataFrame) -> DataFrame:
    """Three report checks, one row each: (notice, value, raised).

    ``shares``: size, pct_own; ``ari_category``: ari; ``bic``: k, bic, silhouette.
    """
    large = shares.filter((F.col("size") >= 30) & F.col("pct_own").isNotNull())
    spread = large.agg(
        F.lit("own outlier shares barely differ").alias("notice"),
        (F.max("pct_own") - F.min("pct_own")).alias("value"),
        ((F.count("*") >= 3) & (F.max("pct_own") - F.min("pct_own") < 2.0)).alias("raised"),
    )
    aligned = ari_category.agg(
        F.lit("winner follows the category").alias("notice"),
        F.max("ari").alias("value"),
        (F.max("ari") >= 0.60).alias("raised"),
    )
    by_bic, by_silhouette = F.min_by("k", "bic"), F.max_by("k", "silhouette")
    disagree = bic.agg(
        F.lit("information criterion and silhouette pick different k").alias("notice"),
        (by_bic - by_silhouette).cast("double").alias("value"),
        (by_bic != by_silhouette).alias("raised"),
    )
    return spread.unionByName(aligned).unionByName(disagree)


def group_profile(
    partition: DataFrame, label: str, variables: list[str], category: str, log_budget: str = "log_budget",
    by: list[str] | None = None, medoids: DataFrame | None = None,
) -> DataFrame:
    """Per group: size, share, variable means, mean budget, dominant category and medoid."""
    from tenderloom.operators.choose import mode

    by = by or []
    keys = [*by, label]
    stats = partition.groupBy(*keys).agg(
        F.count("*").alias("size"),
        *[F.avg(v).alias(v) for v in variables],
        F.avg(F.expm1(log_budget)).alias("mean_budget"),
    )
    # One row per group.
    whole = Window.partitionBy(*by)
    dominant = mode(partition, keys, category, "dominant")
    out = stats.withColumn("pct", 100.0 * F.col("size") / F.sum("size").over(whole)).join(dominant, keys)
    out = out.withColumn("dominant_pct", 100.0 * F.col("dominant_n") / F.col("size")).drop("dominant_n")
    return out.join(medoids, keys, "left") if medoids is not None else out


def centroid_separation(profile: DataFrame, variables: list[str]) -> DataFrame:
    """Mean |z| of group means across groups and the number of distinct dominant categories."""
    long = profile.unpivot(["size"], variables, "variable", "value")
    stats = long.groupBy("variable").agg(F.avg("value").alias("m"),
                                         F.stddev_pop("value").alias("sd"))
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    z = long.join(F.broadcast(stats), "variable").agg(
        F.avg(F.abs((F.col("value") - F.col("m")) / sd)).alias("separation")
    )
    return profile.agg(
        F.countDistinct("dominant").alias("dominant_categories"), F.count("*").alias("groups")
    ).withColumn("separation", z.scalar())
