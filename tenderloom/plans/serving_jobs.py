"""Queries that answer suppliers with a fixed model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed
from tenderloom.functions import scoring, text
from tenderloom.operators import profiles, serving
from tenderloom.operators.serving import FrozenModel
from tenderloom.plans.domain import VALID_PROVINCES, Domain
from tenderloom.plans.registry import job
from tenderloom.plans.sql import sql
from tenderloom.session import cut_lineage

NUM = fixed.NUMERIC
# The frozen parameters of these queries: limits, mean, scale and range per variable,
# and three reference tenders.
LIMITS = {
    "distance_km": (0.0, 700.0, 250.0, 150.0),
    "code_jaccard4": (0.0, 0.2, 0.03, 0.04),
    "text_sim": (0.0, 1.0, 0.6, 0.15),
    "budget_deviation": (-3.0, 3.0, 1.0, 1.0),
    "buyer_code_activity": (0.0, 3.0, 0.1, 0.4),
    "buyer_affinity": (0.0, 2.0, 0.3, 0.4),
}
SCALING = {v: (lo, hi, m, s, (hi - lo) / s) for v, (lo, hi, m, s) in LIMITS.items()}
REFERENCES = [
    (0, 101, "Otros", (-1.0, 0.4, 0.5, 0.3, -0.25, -0.75)),
    (1, 202, "Catalogo Electronico", (0.2, -0.5, 0.9, 0.8, -0.25, 1.0)),
    (2, 303, "Otros", (1.1, -0.2, -0.4, -0.6, -0.25, -0.75)),
]
MODEL = FrozenModel(
    scaling=SCALING,
    medoids=[
        {"cluster": c, "ocid": o, "modality": m, **{f"z_{v}": z for v, z in zip(NUM, zs)}} for c, o, m, zs in REFERENCES
    ],
)

_Z = ", ".join(f"(least(greatest({v}, {lo}), {hi}) - {m}) / {s} AS z{i}" for i, (v, (lo, hi, m, s)) in enumerate(LIMITS.items()))
_REF = " UNION ALL ".join(
    f"SELECT {c} AS cluster, '{m}' AS ref_modality, " + ", ".join(f"{z} AS r{i}" for i, z in enumerate(zs)) for c, _, m, zs in REFERENCES
)
_GOWER = " + ".join(f"abs(z{i} - r{i}) / {SCALING[v][4]!r}" for i, v in enumerate(NUM))
SERVE = {
    "d_near": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id, ocid ORDER BY distance, cluster) AS nearest FROM (
        SELECT z.*, cluster, ({_GOWER} + CASE WHEN modality = ref_modality THEN 0 ELSE 1.0 / 3 END) / (6 + 1.0 / 3) AS distance
        FROM (SELECT *, {_Z} FROM d_matrix) z, ({_REF}) r)) WHERE nearest = 1""",
    "d_scored": """SELECT *, round(CASE WHEN hi > lo THEN 1 - (distance - lo) / (hi - lo) ELSE 1 END, 4) AS affinity,
        round(0.5 * least(greatest(code_jaccard4, 0), 1) + 0.5 * least(greatest(text_sim, 0), 1), 4) AS compatibility,
        CASE WHEN code_jaccard4 > 0 AND text_sim >= 0.15 THEN 'Rubro y descripción' WHEN code_jaccard4 > 0 THEN 'Mismo rubro'
          WHEN text_sim >= 0.15 THEN 'Descripción similar' WHEN buyer_affinity > 0 THEN 'Comprador conocido' ELSE 'Coincidencia débil' END AS reason
        FROM (SELECT *, min(distance) OVER (PARTITION BY supplier_id) AS lo, max(distance) OVER (PARTITION BY supplier_id) AS hi FROM d_near)""",
    "d_group": """SELECT supplier_id, cluster, count(*) AS size, round(avg(affinity), 4) AS mean_affinity, round(avg(compatibility), 4) AS mean_compatibility,
        max(compatibility) AS max_compatibility, count(*) FILTER (compatibility >= 0.15) AS opportunities, """
    + ", ".join(f"round(avg({v}), 4) AS {v}" for v in NUM)
    + " FROM d_scored GROUP BY 1, 2",
    "d_scaled": "SELECT *, " + ", ".join(
        f"CASE WHEN max({v}) OVER w > min({v}) OVER w THEN ({v} - min({v}) OVER w) / (max({v}) OVER w - min({v}) OVER w) ELSE 0 END AS n{i}"
        for i, v in enumerate(serving.COMPATIBILITY_VARIABLES)
    ) + " FROM d_group WINDOW w AS (PARTITION BY supplier_id)",
    "d_index": "SELECT *, round((n0 + n1 + n2) / 3, 4) AS group_index, row_number() OVER (PARTITION BY supplier_id ORDER BY round((n0 + n1 + n2) / 3, 4) DESC, cluster) AS group_rank FROM d_scaled",
    "d_top": "SELECT supplier_id, cluster FROM d_index WHERE group_rank = 1",
    "d_verdict": """SELECT supplier_id, cluster, opportunities, round(m, 4) AS mean_compatibility, CASE WHEN opportunities = 0 THEN 'NULA'
        WHEN m >= 0.35 THEN 'ALTA' WHEN m >= 0.15 THEN 'MEDIA' ELSE 'BAJA' END AS verdict FROM (
        SELECT supplier_id, cluster, count(*) FILTER (compatibility >= 0.15) AS opportunities,
        coalesce(avg(compatibility) FILTER (compatibility >= 0.15), avg(compatibility)) AS m FROM d_scored JOIN d_top USING (supplier_id, cluster) GROUP BY 1, 2)""",
    "d_opp": "SELECT s.* FROM d_scored s JOIN d_top t ON s.supplier_id = t.supplier_id AND s.cluster = t.cluster WHERE compatibility >= 0.15",
}


def ssql(body: str, **extra: str) -> str:
    return sql(body, **SERVE, **extra)


def scored(d: Domain, carry: list[str] | None = None) -> DataFrame:
    """Scored rows, written once: ranking reads them again when the groups are known."""
    return cut_lineage(serving.score(d.matrix(carry), MODEL))


@job("analyze_supplier", ssql("SELECT supplier_id, cluster, opportunities, mean_compatibility, verdict FROM d_verdict"))
def analyze_supplier(d: Domain) -> DataFrame:
    """Verdict of every portfolio supplier over all open tenders, one plan."""
    return serving.analyse(d.matrix(), MODEL)


@job("actionable_group_by_mean", ssql("SELECT supplier_id, arg_min(cluster, row(-mean_compatibility, cluster)) AS cluster FROM d_group GROUP BY 1"))
def actionable_group_by_mean(d: Domain) -> DataFrame:
    """The other definition of the group to act on: highest mean compatibility."""
    profile = serving.group_profiles(serving.score(d.matrix(), MODEL))
    return serving.actionable_groups(profile, by_mean=True)


@job("scored_tenders", ssql("SELECT supplier_id, ocid, cluster, affinity, compatibility, reason FROM d_scored"))
def scored_tenders(d: Domain) -> DataFrame:
    """Group, typicality, compatibility and reason of every supplier-tender row."""
    return serving.with_affinity(scored(d)).select("supplier_id", "ocid", "cluster", "affinity", "compatibility", "reason")


@job("group_index", ssql("""SELECT supplier_id, cluster, size, round(100.0 * size / sum(size) OVER (PARTITION BY supplier_id), 1) AS pct, mean_affinity, mean_compatibility,
     max_compatibility, opportunities, group_index, group_rank, CASE WHEN group_rank = 1 THEN 'Nicho definido' WHEN distance_km < 120 THEN 'Cercanía geográfica'
     ELSE 'Mercado general' END AS role FROM d_index"""))
def group_index(d: Domain) -> DataFrame:
    """Group profiles with their index, rank and role."""
    g = serving.group_profiles(serving.with_affinity(scored(d)))
    return g.select("supplier_id", "cluster", "size", "pct", "mean_affinity", "mean_compatibility", "max_compatibility",
                    "opportunities", "group_index", F.col("group_rank").cast("long").alias("group_rank"), "role")


@job("tender_levels", ssql("""SELECT supplier_id, CASE WHEN compatibility >= 0.35 THEN 'alta' WHEN compatibility >= 0.15 THEN 'media' WHEN compatibility >= 0.05 THEN 'baja'
     ELSE 'mínima' END AS level, reason, count(*) AS n FROM d_scored GROUP BY 1, 2, 3"""))
def tender_levels(d: Domain) -> DataFrame:
    """Tenders per compatibility level and reason."""
    rows = serving.score(d.matrix(), MODEL)
    return rows.groupBy("supplier_id", scoring.tender_level(F.col("compatibility")).alias("level"), "reason").agg(F.count("*").alias("n"))


@job("kpis", ssql("""SELECT supplier_id, coalesce(o, 0) AS opportunities, round(coalesce(b, 0), 2) AS budget, best_match, tenders, (SELECT max(date) FROM d_tender) AS cutoff
     FROM (SELECT supplier_id, max(compatibility) AS best_match, count(*) AS tenders FROM d_scored GROUP BY 1)
     LEFT JOIN (SELECT supplier_id, count(*) AS o, sum(exp(log_budget) - 1) AS b FROM d_opp GROUP BY 1) USING (supplier_id)"""))
def kpis(d: Domain) -> DataFrame:
    """Headline numbers per supplier."""
    s = scored(d)
    chosen = serving.opportunities(s, serving.actionable_groups(serving.group_profiles(s)))
    k = serving.kpis(s, chosen, d.tenders().agg(F.max("date")))
    return k.select("supplier_id", "opportunities", F.round("budget", 2).alias("budget"), "best_match", "tenders", "cutoff")


@job("ranked_opportunities", ssql("""SELECT supplier_id, ocid, compatibility, rank FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id
     ORDER BY compatibility DESC, ocid) AS rank FROM d_opp) WHERE rank <= 300"""))
def ranked_opportunities(d: Domain) -> DataFrame:
    """Best 300 opportunities per supplier."""
    s = scored(d)
    top = serving.opportunities(s, serving.actionable_groups(serving.group_profiles(s)), 300)
    return top.select("supplier_id", "ocid", "compatibility", F.col("rank").cast("long").alias("rank"))


_TEXT = {"d_text": "SELECT ocid, string_agg(text, ' ' ORDER BY text) AS text FROM d_openitem GROUP BY 1"}


def _with_text(d: Domain, s: DataFrame) -> DataFrame:
    # A tender's own item texts: one document, as its release carries it.
    items = d.items().join(d.open_processes().select("ocid"), "ocid", "left_semi")
    texts = items.groupBy("ocid").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))
    return s.join(texts, "ocid", "left").withColumn("text", F.coalesce("text", F.lit("")))


@job("opportunity_listing", ssql("""SELECT supplier_id, substr(coalesce(text, ''), 1, 62) AS subject, reason, compatibility,
     upper(substr(buyer_province, 1, 1)) || lower(substr(buyer_province, 2)) AS province, t.modality, round(t.budget, 2) AS budget,
     'ORD-' || CAST(o.ocid AS VARCHAR) AS process_code FROM d_opp o JOIN d_tender t USING (ocid) LEFT JOIN d_text USING (ocid)""", **_TEXT))
def opportunity_listing(d: Domain) -> DataFrame:
    """The opportunities as a supplier reads them."""
    s = scored(d, ["buyer_province", "budget", "buyer_id"])
    chosen = serving.opportunities(s, serving.actionable_groups(serving.group_profiles(s)))
    named = _with_text(d, chosen).withColumn(
        "ocid", F.concat_ws("-", F.lit("ocds-t1-ORD"), F.col("ocid").cast("string"), F.col("buyer_id").cast("string"))
    )
    return serving.listing(named, "text", "buyer_province")


@job("rest_of_market", ssql("SELECT supplier_id, ocid, compatibility FROM d_scored WHERE (supplier_id, ocid) NOT IN (SELECT (supplier_id, ocid) FROM d_opp)"))
def rest_of_market(d: Domain) -> DataFrame:
    """Everything that is not an opportunity."""
    s = scored(d)
    chosen = serving.opportunities(s, serving.actionable_groups(serving.group_profiles(s)))
    return serving.rest_of_market(s, chosen).select("supplier_id", "ocid", "compatibility")


@job("example_texts", ssql("""SELECT supplier_id, cluster, position, example FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id, cluster ORDER BY c DESC, o, k) AS position FROM (
     SELECT supplier_id, cluster, upper(example) AS k, max(compatibility) AS c, arg_min(ocid, row(-compatibility, ocid)) AS o, arg_min(example, row(-compatibility, ocid)) AS example
     FROM (SELECT s.*, regexp_replace(substr(trim(substr(text, 1, 90)), 1, 52), ',+$', '') AS example FROM d_scored s JOIN d_text USING (ocid)) WHERE example <> '' GROUP BY 1, 2, 3)) WHERE position <= 3""", **_TEXT))
def example_texts(d: Domain) -> DataFrame:
    """Three distinct example texts per group."""
    ex = serving.example_texts(_with_text(d, scored(d)), "text")
    return ex.select("supplier_id", "cluster", F.col("position").cast("long").alias("position"), "example")


_TYPED = {
    "d_typed": "SELECT CASE WHEN c_nationkey = 0 THEN c_name ELSE 'id ' || lpad(CAST(c_custkey AS VARCHAR), 13, '0') || '-' END AS query FROM customer",
    "d_status": """SELECT query, supplier_id, CASE WHEN length(digits) <> 13 THEN 'invalid' WHEN supplier_id IS NULL THEN 'unknown'
        WHEN province = 'NATION_24' OR mean_amount IS NULL THEN 'insufficient' ELSE 'ready' END AS status
        FROM (SELECT query, regexp_replace(query, '[^0-9]', '', 'g') AS digits FROM d_typed) LEFT JOIN d_profile ON substr(supplier_id, 3, 13) = digits""",
}


def typed(d: Domain) -> DataFrame:
    return d.table("customer").select(
        F.when(F.col("c_nationkey") == 0, F.col("c_name"))
        .otherwise(F.concat(F.lit("id "), F.lpad(F.col("c_custkey").cast("string"), 13, "0"), F.lit("-")))
        .alias("query")
    )


@job("answer_status", ssql("SELECT query, supplier_id, status FROM d_status", **_TYPED))
def answer_status(d: Domain) -> DataFrame:
    """What each typed id leads to: an answer, exploration, or an error."""
    return serving.answer_status(typed(d), profiles.profiles(d.history()), VALID_PROVINCES)


@job("verdict_regression", ssql("""SELECT query, CASE WHEN status = 'ready' THEN 'MEDIA' ELSE 'EXPLORACION' END AS expected, coalesce(verdict, 'EXPLORACION') AS obtained,
     coalesce(opportunities, 0) AS opportunities, coalesce(mean_compatibility, 0) AS mean_compatibility,
     coalesce(verdict, 'EXPLORACION') = CASE WHEN status = 'ready' THEN 'MEDIA' ELSE 'EXPLORACION' END AS matches
     FROM d_status LEFT JOIN d_verdict USING (supplier_id)""", **_TYPED))
def verdict_regression(d: Domain) -> DataFrame:
    """Expected against obtained verdicts for every typed id."""
    statuses = serving.answer_status(typed(d), profiles.profiles(d.history()), VALID_PROVINCES)
    expected = statuses.select("query", F.when(F.col("status") == "ready", "MEDIA").otherwise("EXPLORACION").alias("expected"))
    found = serving.analyse(d.matrix(), MODEL)
    return serving.verdict_regression(expected, statuses.select("query", "supplier_id"), found)


@job("reference_groups", ssql("""SELECT cluster, size, group_rank, mean_compatibility FROM d_index WHERE supplier_id = (SELECT supplier_id FROM d_pick
     ORDER BY competitive_awards DESC, supplier_id LIMIT 1 OFFSET 1)"""))
def reference_groups(d: Domain) -> DataFrame:
    """The exploration answer: group profile of the second example supplier."""
    from tenderloom.operators import matrix
    from tenderloom.plans.domain import PRIORITY

    chosen = cut_lineage(profiles.pick_distinct_provinces(d.eligible(stored=True), 3, PRIORITY))
    ids = [r[0] for r in chosen.select("supplier_id").collect()]  # three rows by definition
    second = ids[1] if len(ids) > 1 else ids[0]
    portfolio = matrix.portfolio_rows(chosen.filter(F.col("supplier_id") == second), d.provinces())
    s = serving.score(matrix.interaction_matrix(d.market(), portfolio), MODEL)
    return serving.group_profiles(s).select("cluster", "size", F.col("group_rank").cast("long").alias("group_rank"), "mean_compatibility")


@job("portal_codes", sql("""SELECT ocid, CASE WHEN ocid % 2 = 0 THEN 'ORD.' || CAST(buyer_id AS VARCHAR) || '-X' ELSE 'no-match-' || CAST(ocid AS VARCHAR) END AS code FROM d_tender"""))
def portal_codes(d: Domain) -> DataFrame:
    """Portal code out of a process id; ids of another shape stay whole."""
    key = F.col("ocid").cast("string")
    raw = F.when(F.col("ocid") % 2 == 0, F.concat(F.lit("ocds-a1b2-ORD."), F.col("buyer_id").cast("string"), F.lit("-X-"), key)).otherwise(
        F.concat(F.lit("no-match-"), key)
    )
    return d.tenders().select("ocid", text.portal_code(raw).alias("code"))


