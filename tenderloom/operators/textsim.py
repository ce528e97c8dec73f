"""Text similarity between supplier corpora and tenders.

Weights: 1 + ln(tf), idf ln((1+N)/(1+df)) + 1, unit length. The supplier's corpus
is one more document, so idf and the vocabulary depend on the supplier; each
supplier has its own column rather than its own pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed
from tenderloom.functions.text import plain_tokens, tokens


def term_counts(docs: DataFrame, doc: str, text: str, plain: bool = False) -> DataFrame:
    """(doc, token, tf) over whole texts; several rows per document add up."""
    words = plain_tokens if plain else tokens
    return (
        docs.select(doc, F.explode(words(F.col(text))).alias("token"))
        .groupBy(doc, "token")
        .agg(F.count("*").alias("tf"))
    )


def damped(tf: Column) -> Column:
    return F.lit(1.0) + F.log(tf)


def smooth_idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1)) + 1


def term_stats(terms: DataFrame) -> DataFrame:
    return terms.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def vocabulary(
    stats: DataFrame, size: int = fixed.VOCABULARY, min_df: int = 2, total: str = "total"
) -> DataFrame:
    """The ``size`` most used tokens; ties go to the smaller token."""
    return stats.filter(F.col("df") >= min_df).orderBy(F.col(total).desc(), "token").limit(size)


def supplier_vocabularies(
    tender_terms: DataFrame,
    n_tenders: DataFrame,
    supplier_terms: DataFrame,
    suppliers: list[str],
    size: int = fixed.VOCABULARY,
    min_df: int = 2,
    shared: bool = False,
) -> DataFrame:
    """(position, token, idf, weight): at most ``size`` tokens per supplier.

    ``weight`` is the supplier's unit-length weight, null for tokens it lacks.
    ``shared`` fits all corpora at once instead of one supplier at a time.
    """
    own = supplier_terms.filter(F.col("supplier_id").isin(*suppliers)).groupBy("token").agg(
        *[
            F.sum(F.when(F.col("supplier_id") == s, F.col("tf"))).alias(f"tf{i}")
            for i, s in enumerate(suppliers)
        ]
    )
    merged = term_stats(tender_terms).join(own, "token", "full")
    zero = F.lit(0).cast("long")
    base_df, base_total = F.coalesce("df", zero), F.coalesce("total", zero)
    present = [F.col(f"tf{i}").isNotNull().cast("long") for i in range(len(suppliers))]
    used = [F.coalesce(f"tf{i}", zero) for i in range(len(suppliers))]
    n_docs = n_tenders.scalar()
    if shared:
        df, total = (reduce(lambda a, b: a + b, extra, base) for extra, base in ((present, base_df), (used, base_total)))
        stats = merged.select(
            "token", df.alias("df"), total.alias("total"), F.array(*[f"tf{i}" for i in range(len(suppliers))]).alias("tfs")
        )
        vocab = vocabulary(stats, size, min_df).select(
            "token", smooth_idf(n_docs + len(suppliers), F.col("df")).alias("idf"), F.posexplode("tfs").alias("position", "tf")
        )
    else:
        parts = []
        for i in range(len(suppliers)):
            stats = merged.select(
                "token",
                (base_df + present[i]).alias("df"),
                (base_total + used[i]).alias("total"),
                F.col(f"tf{i}").alias("tf"),
            )
            kept = vocabulary(stats, size, min_df)
            idf = smooth_idf(n_docs + 1, F.col("df"))
            parts.append(kept.select("token", idf.alias("idf"), F.lit(i).alias("position"), "tf"))
        vocab = reduce(DataFrame.unionByName, parts)
    vocab = vocab.withColumn(
        "raw", F.when(F.col("tf").isNotNull(), damped(F.col("tf")) * F.col("idf"))
    )
    norms = vocab.groupBy("position").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    # One row per supplier position.
    return vocab.join(F.broadcast(norms), "position").select(
        "position", "token", "idf", F.try_divide("raw", "norm").alias("weight")
    )


def similarities(
    tender_terms: DataFrame,
    n_tenders: DataFrame,
    supplier_terms: DataFrame,
    suppliers: list[str],
    size: int = fixed.VOCABULARY,
    min_df: int = 2,
    shared: bool = False,
    doc: str = "ocid",
) -> DataFrame:
    """(doc, sims): cosine with each supplier by position; documents without a
    vocabulary token are absent and count as 0."""
    vocab = supplier_vocabularies(
        tender_terms, n_tenders, supplier_terms, suppliers, size, min_df, shared
    )
    at = [F.col("position") == i for i in range(len(suppliers))]
    wide = vocab.groupBy("token").agg(
        *[F.max(F.when(p, F.col("idf"))).alias(f"idf{i}") for i, p in enumerate(at)],
        *[F.max(F.when(p, F.col("weight"))).alias(f"w{i}") for i, p in enumerate(at)],
    )
    # At most size x suppliers rows, both fixed by the caller.
    scored = tender_terms.join(F.broadcast(wide), "token")
    sums = []
    for i in range(len(suppliers)):
        w = damped(F.col("tf")) * F.col(f"idf{i}")
        sums += [F.sum(w * w).alias(f"nn{i}"), F.sum(w * F.col(f"w{i}")).alias(f"dot{i}")]
    per_doc = scored.groupBy(doc).agg(*sums)
    cosines = [
        F.coalesce(F.try_divide(F.col(f"dot{i}"), F.sqrt(f"nn{i}")), F.lit(0.0))
        for i in range(len(suppliers))
    ]
    return per_doc.select(doc, F.array(*cosines).alias("sims"))
