"""The same domain in portable SQL, used only to check results."""

from __future__ import annotations

import re

COMPETITIVE = "substr(modality, 1, 1) IN ('1', '2', '3') AND modality NOT LIKE 'Cat%'"
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 6371.0088 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))"
    )


CTES = {
    "d_prov": """SELECT n_name AS province, -4.0 + 0.2 * n_nationkey AS lat,
        -81.0 + 0.25 * ((n_nationkey * 7) % 25) AS lon FROM nation WHERE n_nationkey <> 24""",
    "d_sup": """SELECT s_suppkey, 'S-' || lpad(CAST(s_suppkey AS VARCHAR), 13, '0') || '-' || CAST(s_nationkey AS VARCHAR)
        AS supplier_id, s_name AS supplier_name, n_name AS region
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "d_proc": """SELECT o_orderkey AS ocid, o_orderstatus AS status, o_custkey AS buyer_id, n_name AS buyer_province,
        o_totalprice AS budget, c_acctbal, c_mktsegment,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'Catálogo Electrónico ' || CAST(year(o_orderdate) AS VARCHAR)
             WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority || ' ' || CAST(year(o_orderdate) AS VARCHAR) END
             AS raw_modality,
        strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(year(o_orderdate) AS VARCHAR) AS source_year
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "d_part": """SELECT p_partkey, lpad(split_part(p_brand, '#', 2), 2, '0') || lpad(CAST(p_size AS VARCHAR), 2, '0')
        || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS code, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part""",
    "d_item": """SELECT l_orderkey AS ocid, l_suppkey, code, text, l_extendedprice * (1 - l_discount) AS amount
        FROM lineitem JOIN d_part ON l_partkey = p_partkey""",
    "d_past": "SELECT * FROM d_proc WHERE status <> 'O'",
    "d_line": """SELECT p.ocid, supplier_id, supplier_name, region, buyer_id, raw_modality AS modality, amount
        FROM (SELECT l_orderkey, l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS amount
              FROM lineitem GROUP BY 1, 2) a JOIN d_past p ON l_orderkey = p.ocid JOIN d_sup ON l_suppkey = s_suppkey""",
    "d_histitem": """SELECT i.*, buyer_id, supplier_id FROM d_item i JOIN d_past p ON i.ocid = p.ocid
        JOIN d_sup ON l_suppkey = s_suppkey""",
    "d_open": "SELECT * FROM d_proc WHERE status = 'O' AND budget > 0",
    "d_kept": """SELECT coalesce(raw_modality, 'Otros') AS name FROM d_open
        WHERE coalesce(raw_modality, '') NOT LIKE 'Catálogo%' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8""",
    "d_tender": """SELECT ocid, buyer_id, buyer_province, budget, date, source_year, c_acctbal, c_mktsegment,
        CASE WHEN raw_modality LIKE 'Catálogo%' THEN 'Catalogo Electronico'
             WHEN coalesce(raw_modality, 'Otros') IN (SELECT name FROM d_kept) THEN coalesce(raw_modality, 'Otros')
             ELSE 'Otros' END AS modality FROM d_open""",
    "d_openitem": "SELECT i.*, buyer_id FROM d_item i JOIN d_tender t ON i.ocid = t.ocid",
    "d_profile": f"""SELECT supplier_id, any_value(supplier_name) AS name, count(*) AS awards, avg(amount) AS mean_amount,
        any_value(region) AS province,
        count(*) FILTER ({COMPETITIVE}) AS competitive_awards,
        count(*) FILTER (modality LIKE 'Catálogo%') AS catalogue_awards,
        (SELECT count(DISTINCT code) FROM d_histitem h WHERE h.supplier_id = l.supplier_id) AS n_codes,
        (SELECT sum(length(text)) + count(*) - 1 FROM d_histitem h WHERE h.supplier_id = l.supplier_id) AS corpus_length
        FROM d_line l GROUP BY supplier_id""",
    "d_elig": """SELECT *, catalogue_awards / awards AS catalogue_share FROM d_profile
        WHERE province <> 'NATION_24' AND corpus_length > 0 AND mean_amount IS NOT NULL AND n_codes >= 5
        AND catalogue_awards / awards < 0.6 AND competitive_awards >= 30""",
    "d_pick": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY province
        ORDER BY competitive_awards DESC, supplier_id) AS r FROM d_elig) WHERE r = 1
        ORDER BY CASE province WHEN 'NATION_9' THEN 0 WHEN 'NATION_17' THEN 1 ELSE 2 END,
        competitive_awards DESC, supplier_id LIMIT 3""",
    "d_km": f"""SELECT s.supplier_id, t.ocid, {km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km
        FROM d_pick s JOIN d_prov a ON s.province = a.province, d_tender t LEFT JOIN d_prov b ON t.buyer_province = b.province""",
    "d_dist": """SELECT supplier_id, ocid, km IS NULL AS imputed,
        coalesce(km, median(km) OVER (PARTITION BY supplier_id)) AS distance_km FROM d_km""",
    "d_tpre": "SELECT DISTINCT ocid, substr(code, 1, 4) AS prefix FROM d_openitem",
    "d_spre": """SELECT DISTINCT supplier_id, substr(code, 1, 4) AS prefix FROM d_histitem
        WHERE supplier_id IN (SELECT supplier_id FROM d_pick)""",
    "d_jac": """SELECT s.supplier_id, t.ocid, count(*) / (tn.n + sn.n - count(*)) AS jaccard
        FROM d_tpre t JOIN d_spre s USING (prefix)
        JOIN (SELECT ocid, count(*) AS n FROM d_tpre GROUP BY 1) tn ON tn.ocid = t.ocid
        JOIN (SELECT supplier_id, count(*) AS n FROM d_spre GROUP BY 1) sn ON sn.supplier_id = s.supplier_id
        GROUP BY s.supplier_id, t.ocid, tn.n, sn.n""",
    "d_terms": f"""SELECT ocid, token, count(*) AS tf FROM (SELECT ocid, unnest({TOKENS.format('text')}) AS token
        FROM d_openitem) GROUP BY 1, 2""",
    "d_sterms": f"""SELECT supplier_id, token, count(*) AS tf FROM (SELECT supplier_id,
        unnest({TOKENS.format('text')}) AS token FROM d_histitem
        WHERE supplier_id IN (SELECT supplier_id FROM d_pick)) GROUP BY 1, 2""",
    "d_vocab": """SELECT supplier_id, token, df, ln((n_docs + 2.0) / (df + 1)) + 1 AS idf, stf FROM (
        SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY total DESC, token) AS r FROM (
          SELECT p.supplier_id, a.token, coalesce(t.df, 0) + CASE WHEN s.tf IS NULL THEN 0 ELSE 1 END AS df,
            coalesce(t.total, 0) + coalesce(s.tf, 0) AS total, s.tf AS stf, (SELECT count(*) FROM d_tender) AS n_docs
          FROM d_pick p, (SELECT token FROM d_terms UNION SELECT token FROM d_sterms) a
          LEFT JOIN (SELECT token, count(*) AS df, sum(tf) AS total FROM d_terms GROUP BY 1) t ON t.token = a.token
          LEFT JOIN d_sterms s ON s.token = a.token AND s.supplier_id = p.supplier_id)
        WHERE df >= 2) WHERE r <= 5000""",
    "d_sim": """SELECT v.supplier_id, t.ocid, sum((1 + ln(t.tf)) * v.idf * coalesce((1 + ln(v.stf)) * v.idf, 0))
        / sqrt(sum(pow((1 + ln(t.tf)) * v.idf, 2))) / any_value(n.norm) AS sim
        FROM d_terms t JOIN d_vocab v USING (token)
        JOIN (SELECT supplier_id, sqrt(sum(pow((1 + ln(stf)) * idf, 2))) AS norm FROM d_vocab GROUP BY 1) n
          ON n.supplier_id = v.supplier_id
        GROUP BY v.supplier_id, t.ocid""",
    "d_act": """SELECT t.ocid, count(DISTINCT (h.ocid, h.l_suppkey)) AS activity FROM d_openitem t
        JOIN d_histitem h ON h.buyer_id = t.buyer_id AND h.code = t.code GROUP BY 1""",
    "d_pair": "SELECT supplier_id, buyer_id, count(*) AS n_awards FROM d_line GROUP BY 1, 2",
    "d_matrix": """SELECT d.supplier_id, d.ocid, d.distance_km, coalesce(j.jaccard, 0) AS code_jaccard4,
        coalesce(s.sim, 0) AS text_sim, ln(1 + t.budget) - ln(1 + p.mean_amount) AS budget_deviation,
        coalesce(a.activity, 0) AS buyer_code_activity, ln(1 + coalesce(b.n_awards, 0)) AS buyer_affinity,
        ln(1 + t.budget) AS log_budget, t.modality, d.imputed AS imputed_distance
        FROM d_dist d JOIN d_tender t ON t.ocid = d.ocid JOIN d_pick p ON p.supplier_id = d.supplier_id
        LEFT JOIN d_jac j ON j.ocid = d.ocid AND j.supplier_id = d.supplier_id
        LEFT JOIN d_sim s ON s.ocid = d.ocid AND s.supplier_id = d.supplier_id
        LEFT JOIN d_act a ON a.ocid = d.ocid
        LEFT JOIN d_pair b ON b.buyer_id = t.buyer_id AND b.supplier_id = d.supplier_id""",
    "d_frame": f"""SELECT t.ocid, ln(1 + budget) AS log_budget,
        coalesce({km('-4.0', '-81.0', 'lat', 'lon')}, 0) AS km, CAST(coalesce(n, 0) AS DOUBLE) AS n_items,
        c_acctbal AS acctbal, modality,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
          WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS cluster
        FROM d_tender t LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON c.l_orderkey = t.ocid
        LEFT JOIN d_prov ON buyer_province = province""",
    "d_noisy": "SELECT * REPLACE (CASE WHEN acctbal < 0 THEN -1 ELSE cluster END AS cluster) FROM d_frame",
    "d_axes": """SELECT f.*, log_budget / (s1 * (4 + 1.0 / 3)) AS u1, km / (s2 * (4 + 1.0 / 3)) AS u2,
        n_items / (s3 * (4 + 1.0 / 3)) AS u3, acctbal / (s4 * (4 + 1.0 / 3)) AS u4
        FROM d_noisy f, (SELECT max(log_budget) - min(log_budget) AS s1, max(km) - min(km) AS s2,
          max(n_items) - min(n_items) AS s3, max(acctbal) - min(acctbal) AS s4 FROM d_frame)""",
}
PAIR_DISTANCE = (
    "abs(a.u1 - b.u1) + abs(a.u2 - b.u2) + abs(a.u3 - b.u3) + abs(a.u4 - b.u4) + "
    "CASE WHEN a.modality = b.modality THEN 0 ELSE (1.0 / 3) / (4 + 1.0 / 3) END"
)


def sql(body: str, **extra: str) -> str:
    """Prefix a body with the common tables it uses, in dependency order."""
    known = {**CTES, **extra}
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bd_\w+\b", text):
            if name in known and name not in order:
                need(known[name])
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + body
