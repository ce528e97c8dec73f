"""Queries over the interaction matrix, its variables and their diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed
from tenderloom.functions.geo import province_distances
from tenderloom.operators import matrix, prepare, textsim
from tenderloom.plans.domain import Domain
from tenderloom.plans.registry import job
from tenderloom.plans.sql import TOKENS, km, sql
from tenderloom.session import cut_lineage

NUM = fixed.NUMERIC
BY = ["supplier_id"]


def rounded(df: DataFrame, keep: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[F.round(v, digits).alias(v) for v in values])


def rsql(keep: list[str], values: list[str], table: str, digits: int = 6) -> str:
    return "SELECT " + ", ".join(keep + [f"round({v}, {digits}) AS {v}" for v in values]) + f" FROM {table}"


@job(
    "province_distance_table",
    sql(f"SELECT a.province AS from_province, b.province AS to_province, round({km('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS km FROM d_prov a, d_prov b"),
)
def province_distance_table(d: Domain) -> DataFrame:
    """Every province pair once, by a row-local explode over the dimension."""
    return rounded(province_distances(d.provinces()), ["from_province", "to_province"], ["km"])


@job("distance_feature", sql(rsql(["supplier_id", "ocid", "imputed"], ["distance_km"], "d_dist")))
def distance_feature(d: Domain) -> DataFrame:
    """Distance of the portfolio to every open tender; unknown places take the median."""
    m = d.matrix().withColumnRenamed("imputed_distance", "imputed")
    return rounded(m, ["supplier_id", "ocid", "imputed"], ["distance_km"])


@job("code_jaccard", sql("SELECT ocid, string_agg(CAST(round(coalesce(jaccard, 0) * 1000000, 0) AS BIGINT), ',' ORDER BY p.awards DESC, p.supplier_id) AS jaccards "
                         "FROM (SELECT DISTINCT ocid FROM d_tpre) t CROSS JOIN d_pick p LEFT JOIN d_jac USING (ocid, supplier_id) GROUP BY 1"))
def code_jaccard(d: Domain) -> DataFrame:
    """Four-character code overlap of the portfolio with every open tender."""
    m = d.market()
    ids = [p["supplier_id"] for p in d.portfolio()]
    wide = matrix.prefix_overlap(m.tender_codes, m.supplier_codes, ids)
    millionths = F.transform("jaccards", lambda j: F.round(j * 1000000, 0).cast("long").cast("string"))
    return wide.select("ocid", F.array_join(millionths, ",").alias("jaccards"))


@job("buyer_affinity", sql("SELECT p.supplier_id, t.ocid, round(ln(1 + coalesce(n_awards, 0)), 6) AS buyer_affinity FROM d_tender t CROSS JOIN d_pick p "
                           "LEFT JOIN d_pair b ON b.buyer_id = t.buyer_id AND b.supplier_id = p.supplier_id"))
def buyer_affinity(d: Domain) -> DataFrame:
    return rounded(d.matrix(), ["supplier_id", "ocid"], ["buyer_affinity"])


@job("budget_deviation", sql("""SELECT ocid, round(ln(1 + budget) - ln(1 + m), 6) AS from_mean, round(ln(1 + budget) - ln(1 + md), 6) AS from_median,
     round(exp(ln(1 + budget)) - 1, 2) AS budget FROM d_tender, (SELECT avg(amount) AS m, median(amount) AS md FROM d_line
     WHERE supplier_id = (SELECT supplier_id FROM d_pick ORDER BY awards DESC, supplier_id LIMIT 1))"""))
def budget_deviation(d: Domain) -> DataFrame:
    """Log budget against the mean (final rule) and the median (first round) won amount."""
    from tenderloom.operators.running import medians

    top = d.portfolio()[0]["supplier_id"]
    mine = d.history().lines.filter(F.col("supplier_id") == top)
    log_budget = F.log1p("budget")
    return (
        d.tenders()
        .withColumn("_mean", mine.agg(F.avg("amount")).scalar())
        .withColumn("_median", medians(mine, [], "amount").scalar())
        .select(
            "ocid",
            F.round(log_budget - F.log1p("_mean"), 6).alias("from_mean"),
            F.round(log_budget - F.log1p("_median"), 6).alias("from_median"),
            F.round(F.expm1(log_budget), 2).alias("budget"),
        )
    )


_DOCS = {
    "d_dterm": f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY 1, 2",
    "d_dstat": "SELECT token, count(*) AS df, sum(tf) AS total FROM d_dterm GROUP BY 1",
}


@job("tfidf_terms", sql("""SELECT token, df, CAST(total AS BIGINT) AS total, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 6) AS idf
     FROM d_dstat WHERE df >= 2 ORDER BY total DESC, token LIMIT 5000""", **_DOCS))
def tfidf_terms(d: Domain) -> DataFrame:
    """Vocabulary of the whole documents: frequencies and inverse document frequency."""
    docs = d.table("documents")
    terms = textsim.term_counts(docs.select("doc_id", "text"), "doc_id", "text")
    kept = textsim.vocabulary(textsim.term_stats(terms))
    idf = textsim.smooth_idf(docs.agg(F.count("*")).scalar(), F.col("df"))
    return kept.select("token", "df", "total", F.round(idf, 6).alias("idf"))


@job("tfidf_cosine", sql(rsql(["supplier_id", "ocid"], ["sim"], "d_sim WHERE sim > 0")))
def tfidf_cosine(d: Domain) -> DataFrame:
    """Corpus against every tender, each supplier with its own vocabulary and idf."""
    m = d.market()
    ids = [p["supplier_id"] for p in d.portfolio()]
    n = m.tenders.agg(F.count("*"))
    wide = textsim.similarities(m.tender_terms, n, m.supplier_terms, ids)
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, ids)).alias("id"), F.col("sims").alias("s")))
    return wide.select("ocid", pairs.alias("e")).select(
        F.col("e.id").alias("supplier_id"), "ocid", F.round("e.s", 6).alias("sim")
    ).filter(F.col("e.s") > 0)


_PLAIN = "regexp_extract_all(lower(strip_accents(lower(text))), '[\\p{L}\\p{N}_]{2,}')"
_STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)
_LANGS = {
    "d_bterm": f"SELECT source, doc_id, lang, token, count(*) AS tf FROM (SELECT source, doc_id, lang, unnest({_PLAIN}) AS token FROM documents) "
               f"WHERE token NOT IN ({_STOP}) GROUP BY ALL",
    "d_cterm": "SELECT source AS supplier_id, token, sum(tf) AS tf FROM d_bterm WHERE lang = 'es' GROUP BY 1, 2",
    "d_oterm": "SELECT doc_id, token, tf FROM d_bterm WHERE lang <> 'es'",
    "d_bvoc": """SELECT token, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM (SELECT token, count(*) AS df, sum(tf) AS total FROM
        (SELECT token, tf FROM d_oterm UNION ALL SELECT token, tf FROM d_cterm) GROUP BY 1),
        (SELECT (SELECT count(*) FROM documents WHERE lang <> 'es') + (SELECT count(DISTINCT source) FROM documents WHERE lang = 'es') AS n)
        ORDER BY total DESC, token LIMIT 5000""",
    "d_bsup": "SELECT supplier_id, token, idf, (1 + ln(tf)) * idf AS w, sqrt(sum(pow((1 + ln(tf)) * idf, 2)) OVER (PARTITION BY supplier_id)) AS norm FROM d_cterm JOIN d_bvoc USING (token)",
    "d_bnorm": "SELECT doc_id, sqrt(sum(pow((1 + ln(tf)) * idf, 2))) AS norm FROM d_oterm JOIN d_bvoc USING (token) GROUP BY 1",
    "d_bsim": """SELECT s.supplier_id, t.doc_id, sum((1 + ln(t.tf)) * s.idf * s.w / s.norm) / any_value(n.norm) AS sim
        FROM d_oterm t JOIN d_bsup s USING (token) JOIN d_bnorm n ON n.doc_id = t.doc_id GROUP BY 1, 2""",
}


def _batch_similarity(d: Domain) -> DataFrame:
    docs = d.table("documents")
    corpora = docs.filter(F.col("lang") == "es")
    tenders = docs.filter(F.col("lang") != "es")
    # The sources of the corpora are the batch: a short list of names.
    ids = sorted(r[0] for r in corpora.select("source").distinct().collect())
    own = textsim.term_counts(corpora.select(F.col("source").alias("supplier_id"), "text"), "supplier_id", "text", plain=True)
    # The texts of a document come together, not its terms: they are counted and weighed where it lies.
    terms = textsim.term_counts(tenders.select("doc_id", "text").repartition("doc_id"), "doc_id", "text", plain=True)
    wide = textsim.similarities(terms, tenders.agg(F.count("*")), own, ids, min_df=1, shared=True, doc="doc_id")
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, ids)).alias("id"), F.col("sims").alias("s")))
    return wide.select("doc_id", pairs.alias("e")).select(F.col("e.id").alias("supplier_id"), "doc_id", F.col("e.s").alias("sim"))


@job("tfidf_batch", sql(rsql(["supplier_id", "doc_id"], ["sim"], "d_bsim WHERE sim > 0"), **_LANGS))
def tfidf_batch(d: Domain) -> DataFrame:
    """All corpora against all documents in one fit, accents and stop words removed."""
    return rounded(_batch_similarity(d).filter(F.col("sim") > 0), ["supplier_id", "doc_id"], ["sim"])


@job("similarity_diagnostics", sql("""SELECT supplier_id, round(avg(sim), 6) AS mean, round(quantile_cont(sim, 0.9), 6) AS p90, round(max(sim), 6) AS max,
     round(stddev_pop(sim) / nullif(avg(sim), 0), 6) AS cv FROM (SELECT s.supplier_id, coalesce(b.sim, 0) AS sim
     FROM (SELECT DISTINCT source AS supplier_id FROM documents WHERE lang = 'es') s
     CROSS JOIN (SELECT doc_id FROM documents WHERE lang <> 'es') t LEFT JOIN d_bsim b ON b.supplier_id = s.supplier_id AND b.doc_id = t.doc_id)
     GROUP BY 1""", **_LANGS))
def similarity_diagnostics(d: Domain) -> DataFrame:
    """Mean, p90, maximum and variation of each corpus's similarities with all documents, zeros included."""
    from tenderloom.operators.running import percentiles

    found = cut_lineage(_batch_similarity(d).filter(F.col("sim") > 0))
    # Pairs without a common term are zeros: one row per corpus that stands for all of them.
    docs = d.table("documents")
    corpora = docs.filter(F.col("lang") == "es").select(F.col("source").alias("supplier_id")).distinct()
    n = docs.filter(F.col("lang") != "es").count()
    some = corpora.join(found.groupBy("supplier_id").agg(F.count("*").alias("some")), "supplier_id", "left")
    zeros = some.select("supplier_id", F.lit(0.0).alias("sim"), (F.lit(n) - F.coalesce("some", F.lit(0))).alias("rows"))
    sims = found.select("supplier_id", "sim", F.lit(1).cast("long").alias("rows")).unionByName(zeros.filter("rows > 0"))
    mean, square = F.sum("sim") / n, F.sum(F.col("sim") * F.col("sim")) / n
    stats = sims.groupBy("supplier_id").agg(
        mean.alias("mean"), F.max("sim").alias("max"), F.try_divide(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), mean).alias("cv")
    )
    joined = stats.join(percentiles(sims, BY, "sim", {"p90": 0.9}, weight="rows"), "supplier_id")
    return rounded(joined, BY, ["mean", "p90", "max", "cv"])


_DEPTH = {
    "d_depth": "SELECT t.ocid, s.supplier_id, avg(CASE WHEN l5 THEN 1.0 WHEN l4 THEN 0.8 WHEN l3 THEN 0.6 WHEN l2 THEN 0.4 WHEN l1 THEN 0.2 ELSE 0 END) AS score FROM ("
    + "SELECT t.ocid, s.supplier_id, "
    + ", ".join(f"substr(t.code, 1, {n}) IN (SELECT substr(h.code, 1, {n}) FROM d_mine h WHERE h.supplier_id = s.supplier_id) AS l{n}" for n in range(1, 6))
    + " FROM d_openitem t, (SELECT DISTINCT supplier_id FROM d_mine) s) t, (SELECT 1) q, (SELECT 1) z GROUP BY ALL",
    "d_mine": "SELECT supplier_id, code FROM d_histitem WHERE supplier_id IN (SELECT supplier_id FROM d_pick)",
}
_DEPTH["d_depth"] = _DEPTH["d_depth"].replace("SELECT t.ocid, s.supplier_id, avg", "SELECT t.ocid, t.supplier_id, avg", 1).replace(
    ", (SELECT 1) q, (SELECT 1) z GROUP BY ALL", " GROUP BY ALL"
)


@job("depth_diagnostics", sql("""SELECT supplier_id, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
     round(100 * avg(CASE WHEN score > 0.6 + 1e-9 THEN 1 ELSE 0 END), 4) AS above FROM d_depth GROUP BY 1""", **_DEPTH))
def depth_diagnostics(d: Domain) -> DataFrame:
    """Mean, deviation and share above .6 of the code match, per portfolio supplier."""
    m = d.market()
    ids = [p["supplier_id"] for p in d.portfolio()]
    mine = m.supplier_codes.filter(F.col("supplier_id").isin(*ids))
    scores = matrix.code_depth(m.tender_codes, mine)
    # Unmatched tenders with codes score 0: their number completes the moments.
    n = m.tender_codes.agg(F.countDistinct("ocid")).scalar()
    stats = scores.groupBy("supplier_id").agg(
        F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss"),
        F.count_if(F.col("score") > 0.6 + 1e-9).alias("high"),
    ).withColumn("n", n)
    mean = F.col("s") / F.col("n")
    return stats.select(
        "supplier_id", F.round(mean, 6).alias("mean"),
        F.round(F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))), 6).alias("std"),
        F.round(100.0 * F.col("high") / F.col("n"), 4).alias("above"),
    )


@job("interaction_matrix", sql(rsql(["supplier_id", "ocid", "modality", "imputed_distance"], [*NUM, "log_budget"], "d_matrix")))
def interaction_matrix(d: Domain) -> DataFrame:
    """Portfolio x open tenders with all variables."""
    return rounded(d.matrix(), ["supplier_id", "ocid", "modality", "imputed_distance"], [*NUM, "log_budget"])


@job("matrix_summary", sql("""SELECT supplier_id, count(*) AS tenders, count(*) FILTER (imputed_distance) AS unknown_provinces,
     round(max(distance_km) FILTER (imputed_distance), 6) AS median_distance, round(100 * avg((code_jaccard4 > 0)::INT), 6) AS pct_jaccard_nonzero,
     round(avg(code_jaccard4), 6) AS mean_jaccard, round(avg(text_sim), 6) AS mean_similarity, round(100 * avg((buyer_affinity > 0)::INT), 6) AS pct_affinity_nonzero,
     round(avg(buyer_affinity), 6) AS mean_affinity, round(max(buyer_affinity), 6) AS max_affinity,
     count(*) FILTER (buyer_affinity > 0) AS known_buyer_tenders FROM d_matrix GROUP BY 1"""))
def matrix_summary(d: Domain) -> DataFrame:
    s = matrix.matrix_summary(d.matrix())
    whole = ["supplier_id", "tenders", "unknown_provinces", "known_buyer_tenders"]
    return rounded(s, whole, [c for c in s.columns if c not in whole])


_LONG = " UNION ALL ".join(
    f"SELECT supplier_id, ocid, modality, '{v}' AS variable, CAST({v} AS DOUBLE) AS value FROM d_matrix" for v in NUM
)
_PREP = {
    "d_long": _LONG,
    "d_lim": "SELECT supplier_id, variable, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM d_long GROUP BY 1, 2",
    "d_clip": "SELECT l.*, low, high, least(greatest(value, low), high) AS c FROM d_long l JOIN d_lim USING (supplier_id, variable)",
    "d_fit": """SELECT supplier_id, variable, low, high, mean, CASE WHEN scale > 1e-12 AND span > 0 THEN scale ELSE 1 END AS scale,
        CASE WHEN span = 0 THEN 1 ELSE span / scale END AS range FROM (SELECT supplier_id, variable, any_value(low) AS low, any_value(high) AS high,
        avg(c) AS mean, stddev_pop(c) AS scale, max(c) - min(c) AS span FROM d_clip GROUP BY 1, 2)""",
}


@job("winsor_counts", sql("SELECT supplier_id, variable, count(*) FILTER (value < low OR value > high) AS clipped FROM d_clip GROUP BY 1, 2", **_PREP))
def winsor_counts(d: Domain) -> DataFrame:
    """Rows outside the exact 1st and 99th percentiles."""
    m = d.kept_matrix()
    return prepare.clip_counts(m, prepare.clip_limits(m, BY), BY)


@job("scaling_parameters", sql(rsql(["supplier_id", "variable"], ["low", "high", "mean", "scale", "range"], "d_fit"), **_PREP))
def scaling_parameters(d: Domain) -> DataFrame:
    """Limits, mean, population deviation and range per supplier and variable."""
    return rounded(prepare.fit_scaling(d.kept_matrix(), BY), [*BY, "variable"], ["low", "high", "mean", "scale", "range"])


@job("winsor_scale", sql("SELECT supplier_id, ocid, " + ", ".join(f"round(max(CASE WHEN variable = '{v}' THEN (c - mean) / scale END), 5) AS z_{v}" for v in NUM)
                         + " FROM d_clip c JOIN d_fit f USING (supplier_id, variable) GROUP BY 1, 2", **_PREP))
def winsor_scale(d: Domain) -> DataFrame:
    """Clipped and standardised variables of every row."""
    m = d.kept_matrix()
    scaled = prepare.scale(m, prepare.fit_scaling(m, BY), BY)
    return rounded(scaled, [*BY, "ocid"], [f"z_{v}" for v in NUM], 5)


@job("one_hot", sql("SELECT ocid, " + ", ".join(f"CASE WHEN modality = '{c}' THEN 1.0 ELSE 0.0 END AS is_{i}" for i, c in enumerate(sorted(["Catalogo Electronico", "Otros", "1-URGENT 1995"])))
                    + " FROM d_tender"))
def one_hot(d: Domain) -> DataFrame:
    """Indicators of known categories; the others are all zeros."""
    known = ["Catalogo Electronico", "Otros", "1-URGENT 1995"]
    return prepare.one_hot(d.tenders().select("ocid", "modality"), "modality", known).drop("modality")


_PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]
_CORR = {
    "d_corr": " UNION ALL ".join(
        f"SELECT supplier_id, '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) ELSE 0 END AS r, "
        f"stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 AS varies FROM d_matrix GROUP BY 1" for a, b in _PAIRS)
}


@job("corr_matrix", sql(rsql(["supplier_id", "a", "b", "varies"], ["r"], "d_corr"), **_CORR))
def corr_matrix(d: Domain) -> DataFrame:
    """Pearson for all fifteen pairs in one aggregation."""
    return rounded(prepare.correlations(d.matrix(), BY), [*BY, "a", "b", "varies"], ["r"])


@job("collinear_pairs", """WITH m AS (SELECT ln(1 + o_totalprice) AS x, 2 * ln(1 + o_totalprice) + 1 AS y, o_totalprice AS z, 0.0 AS k FROM orders)
     SELECT 'collinear' AS kind, 'x' AS a, 'y' AS b, round(corr(x, y), 6) AS r FROM m UNION ALL SELECT 'redundant', 'x', 'y', round(corr(x, y), 6) FROM m""")
def collinear_pairs(d: Domain) -> DataFrame:
    """Redundant and collinear variable pairs; constants never count."""
    x = F.log1p("o_totalprice")
    rows = d.table("orders").select(x.alias("x"), (2 * x + 1).alias("y"), F.col("o_totalprice").alias("z"), F.lit(0.0).alias("k"))
    corr = prepare.correlations(rows, [], ["x", "y", "z", "k"])
    found = prepare.collinear_pairs(corr).select(F.lit("collinear").alias("kind"), "a", "b", F.round("r", 6).alias("r"))
    near = prepare.redundant_pairs(corr).select(F.lit("redundant").alias("kind"), "a", "b", F.round("r", 6).alias("r"))
    return found.unionByName(near)


_ETA = {
    **_PREP,
    "d_eta": """SELECT supplier_id, variable, CASE WHEN any_value(vt) > 0 THEN sum(n * pow(m - mt, 2)) / any_value(nt * vt) END AS eta2 FROM
        (SELECT supplier_id, variable, modality, count(*) AS n, avg(value) AS m FROM d_long GROUP BY 1, 2, 3) g
        JOIN (SELECT supplier_id, variable, count(*) AS nt, avg(value) AS mt, var_pop(value) AS vt FROM d_long GROUP BY 1, 2) w
        USING (supplier_id, variable) GROUP BY 1, 2""",
}


@job("eta_squared", sql(rsql(["supplier_id", "variable"], ["eta2"], "d_eta"), **_ETA))
def eta_squared(d: Domain) -> DataFrame:
    """Share of each variable's variance explained by the modality."""
    return rounded(prepare.eta_squared(d.kept_matrix(), BY, "modality"), [*BY, "variable"], ["eta2"])


@job("variable_diagnostics", sql("""SELECT supplier_id, variable, round(dominant, 6) AS dominant_share, CASE WHEN span = 0 THEN 'constant'
     WHEN dominant >= 0.98 THEN 'nearly constant' WHEN eta2 >= 0.99 THEN 'recoded category' END AS finding FROM (
     SELECT supplier_id, variable, max(n) / sum(n) AS dominant, max(hi) - min(lo) AS span FROM (SELECT supplier_id, variable, round(value, 6) AS v, count(*) AS n,
     min(value) AS lo, max(value) AS hi FROM d_long GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN d_eta USING (supplier_id, variable)""", **_ETA))
def variable_diagnostics(d: Domain) -> DataFrame:
    """Constant, nearly constant and recoded variables."""
    return prepare.variable_diagnostics(d.kept_matrix(), BY, "modality").select(
        *BY, "variable", F.round("dominant_share", 6).alias("dominant_share"), "finding"
    )


@job("quartile_bins", sql("""SELECT ocid, (CASE WHEN v <= q1 THEN 0 WHEN v <= q2 THEN 1 WHEN v <= q3 THEN 2 ELSE 3 END) AS quartile
     FROM (SELECT ocid, ln(1 + budget) AS v FROM d_tender), (SELECT quantile_cont(ln(1 + budget), 0.25) AS q1, quantile_cont(ln(1 + budget), 0.5) AS q2,
     quantile_cont(ln(1 + budget), 0.75) AS q3 FROM d_tender)"""))
def quartile_bins(d: Domain) -> DataFrame:
    """Budget quartile of every tender; equal budgets share a bin."""
    rows = d.tenders().select("ocid", F.log1p("budget").alias("v"))
    return prepare.quartile_bins(rows, [], "v").select("ocid", "quartile")
