"""Queries over releases, history, profiles and open tenders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed
from tenderloom.functions import codes as code_fn
from tenderloom.functions import nested, text
from tenderloom.operators import choose, coverage, matrix, prepare, profiles, running, tenders
from tenderloom.plans.domain import PRIORITY, VALID_PROVINCES, Domain
from tenderloom.plans.registry import job
from tenderloom.plans.sql import sql
from tenderloom.sources import releases


def line_releases(d: Domain) -> DataFrame:
    """One small release per order line, rendered as JSON in all three package shapes.

    Fields go missing by the line's own flags, so every fallback is exercised.
    """
    lines = d.table("lineitem").join(
        d.table("part").select("p_partkey", d.code().alias("code"), "p_name", "p_type"),
        F.col("l_partkey") == F.col("p_partkey"),
    )
    buyers = d.processes()
    rows = lines.join(buyers, F.col("l_orderkey") == F.col("ocid"))
    flag, status = F.col("l_returnflag"), F.col("status")
    item = F.struct(
        F.col("p_name").alias("description"),
        F.struct(F.col("code").alias("id"), F.col("p_type").alias("description")).alias("classification"),
        F.when(F.col("l_quantity") > 40, F.array(F.struct(F.substring("code", 1, 5).alias("id")))).alias(
            "additionalClassifications"
        ),
    )
    release = F.struct(
        F.col("ocid").cast("string").alias("ocid"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.struct(F.col("buyer_id").cast("string").alias("id")).alias("buyer"),
        F.array(
            F.struct(
                F.col("l_suppkey").cast("string").alias("id"),
                F.array(F.lit("supplier")).alias("roles"),
                F.struct(F.when(flag != "A", F.lit(" Cañar  del   Sur ")).alias("region")).alias("address"),
            ),
            F.struct(
                F.col("buyer_id").cast("string").alias("id"),
                F.array(F.lit("buyer")).alias("roles"),
                F.struct(F.lower("buyer_province").alias("region")).alias("address"),
            ),
        ).alias("parties"),
        F.struct(
            F.when(status == "O", "active").when(status == "F", "complete").alias("status"),
            F.col("raw_modality").alias("procurementMethodDetails"),
            F.when(flag == "N", F.concat(F.lit("  "), F.col("p_type"))).alias("title"),
            F.struct(F.when(flag != "R", F.col("l_tax") * 1000).alias("amount")).alias("value"),
            F.when(
                F.col("l_linenumber") <= 4,
                F.array(
                    F.struct(F.struct(F.col("l_quantity").alias("amount")).alias("value")),
                    F.struct(F.struct(F.col("l_discount").alias("amount")).alias("value")),
                ),
            ).alias("lots"),
            F.when(flag != "R", F.array(item)).alias("items"),
            F.when(
                F.col("l_linestatus") == "O", F.struct(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("endDate"))
            ).alias("tenderPeriod"),
            F.when(F.col("l_quantity") > 25, F.array(F.struct(F.col("l_suppkey").cast("string").alias("id")))).alias("tenderers"),
        ).alias("tender"),
        F.when(
            status != "O",
            F.array(
                F.struct(
                    F.struct(F.when(flag != "N", F.col("l_extendedprice")).alias("amount")).alias("value"),
                    F.array(F.struct(F.col("l_suppkey").cast("string").alias("id"))).alias("suppliers"),
                    F.array(item).alias("items"),
                )
            ),
        ).alias("awards"),
        F.when(
            F.col("l_linenumber") % 3 == 0, F.struct(F.struct(F.struct(F.col("budget").alias("amount")).alias("amount")).alias("budget"))
        ).alias("planning"),
    )
    line = (
        F.when(flag == "A", F.to_json(F.struct(F.array(release).alias("releases"))))
        .when(flag == "N", F.to_json(F.struct(release.alias("compiledRelease"))))
        .otherwise(F.to_json(release))
    )
    rendered = rows.select(line.alias("line"), "l_linenumber", "l_suppkey", "l_partkey", "source_year")
    return releases.parse_lines(rendered, "line", ["l_linenumber", "l_suppkey", "l_partkey", "source_year"])


LINE_SQL = {
    "d_rel": """SELECT p.ocid, p.status, p.buyer_id, p.buyer_province, p.raw_modality, p.budget, p.source_year, l.*, d.code,
        d.p_name, d.p_type FROM lineitem l JOIN (SELECT *, lpad(split_part(p_brand, '#', 2), 2, '0') ||
        lpad(CAST(p_size AS VARCHAR), 2, '0') || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS code FROM part) d
        ON l_partkey = p_partkey JOIN d_proc p ON l_orderkey = p.ocid"""
}


@job(
    "release_roundtrip_scan",
    sql(
        """SELECT CAST(ocid AS VARCHAR) AS ocid, l_linenumber AS line, l_suppkey AS supplier, l_partkey AS part,
        CASE status WHEN 'O' THEN 'active' WHEN 'F' THEN 'complete' END AS status,
        CASE WHEN l_returnflag <> 'R' THEN 'tender.items' WHEN status <> 'O' THEN 'awards.items' ELSE 'sin_items' END AS items_origin,
        CASE WHEN l_returnflag <> 'R' OR status <> 'O' THEN CASE WHEN l_quantity > 40 THEN code || '|' || substr(code, 1, 5) ELSE code END ELSE '' END AS codes,
        trim(CASE WHEN l_returnflag = 'N' THEN p_type || ' ' ELSE '' END ||
          CASE WHEN l_returnflag <> 'R' OR status <> 'O' THEN p_name || ' ' || p_type ELSE '' END) AS text,
        CASE WHEN status <> 'O' THEN 1 ELSE 0 END AS awards, upper(buyer_province) AS buyer_province,
        CASE WHEN l_returnflag <> 'A' THEN 'CANAR DEL SUR' END AS supplier_region FROM d_rel""",
        **LINE_SQL,
    ),
)
def release_roundtrip_scan(d: Domain) -> DataFrame:
    """Parse, unwrap and flatten releases of all three package shapes."""
    items, origin = nested.process_items()
    rows = line_releases(d).withColumn("_items", items)
    return rows.select(
        "ocid",
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_partkey").alias("part"),
        F.col("tender.status").alias("status"),
        origin.alias("items_origin"),
        F.array_join(nested.all_codes(F.col("_items")), "|").alias("codes"),
        nested.process_text(F.col("_items")).alias("text"),
        F.coalesce(F.size("awards"), F.lit(0)).alias("awards"),
        nested.role_region(F.col("parties"), ["buyer"]).alias("buyer_province"),
        nested.region_of(nested.supplier_regions(F.col("parties")), F.col("l_suppkey").cast("string")).alias("supplier_region"),
    )


_PRESENCE = [
    "1=1", "l_returnflag <> 'A'", "1=1", "status <> 'O'", "status <> 'O' AND l_returnflag <> 'N'", "status <> 'O'",
    "status <> 'O'", "1=1", "1=1", "l_returnflag <> 'R'", "l_returnflag <> 'R'", "l_returnflag <> 'R'",
    "l_linenumber % 3 = 0", "raw_modality IS NOT NULL", "status <> 'P'", "l_linestatus = 'O'", "l_quantity > 25", "1=0",
]
_COVER_SQL = " UNION ALL ".join(
    f"SELECT source_year, '{f}' AS field, count(*) AS total, count(*) FILTER ({p}) AS filled, "
    f"round(100.0 * count(*) FILTER ({p}) / count(*), 2) AS pct FROM d_rel GROUP BY 1"
    for f, p in zip(fixed.AUDITED_FIELDS, _PRESENCE)
)


@job("presence_coverage", sql(_COVER_SQL, **LINE_SQL))
def presence_coverage(d: Domain) -> DataFrame:
    """Field x year presence over every release."""
    present = coverage.field_presence(line_releases(d), ["source_year"])
    return coverage.coverage(present)


@job(
    "coverage_grid",
    sql(
        "SELECT field, "
        + ", ".join(f"max(pct) FILTER (source_year = '{y}') AS y{y}" for y in range(1995, 2002))
        + f" FROM ({_COVER_SQL}) GROUP BY field",
        **LINE_SQL,
    ),
)
def coverage_grid(d: Domain) -> DataFrame:
    """The same audit as a field x year grid."""
    years = [str(y) for y in range(1995, 2002)]
    cover = coverage.coverage(coverage.field_presence(line_releases(d), ["source_year"]))
    grid = coverage.coverage_grid(cover, "source_year", years)
    return grid.select("field", *[F.col(y).alias(f"y{y}") for y in years])


@job(
    "alt_key_discovery",
    """SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events)
       WHERE (contains(lower(key), 'budget') OR contains(lower(key), 'estimat') OR contains(lower(key), 'k')) AND key <> 'budget'
       GROUP BY 1""",
)
def alt_key_discovery(d: Domain) -> DataFrame:
    """Keys of a JSON object column that look like a budget."""
    return releases.budget_like_keys(d.table("events"), "props", ["budget", "estimat", "k"], ["budget"])


@job(
    "open_on_date",
    """SELECT o_orderstatus AS status, count(*) FILTER (strftime(l_shipdate, '%Y-%m-%d') >= '2000-01-01' AND l_linestatus = 'O')
       AS still_open, count(*) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def open_on_date(d: Domain) -> DataFrame:
    """Lines whose deadline has not passed on a given day, per process status."""
    end = F.when(F.col("l_linestatus") == "O", F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = d.table("lineitem").select("l_orderkey", nested.still_open(end, F.lit("2000-01-01")).alias("open"))
    orders = d.table("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("status").agg(
        F.count_if("open").alias("still_open"), F.count("*").alias("total")
    )


@job(
    "run_inventory",
    sql(
        """SELECT n AS rows, c AS categories, c + 4 AS encoded_columns, n * n AS cells, round(n * n * 8 / 1073741824.0, 3) AS float64_gb,
        round(n * n * 4 / 1073741824.0, 3) AS float32_gb, round(n * (n - 1) / 2.0 * 8 / 1073741824.0, 3) AS condensed_gb
        FROM (SELECT count(*) AS n, count(DISTINCT modality) AS c FROM d_frame)"""
    ),
)
def run_inventory(d: Domain) -> DataFrame:
    """Rows, categories and what a pairwise matrix over them would take."""
    return coverage.matrix_inventory(d.frame(), "modality", 4)


@job(
    "run_counters",
    sql(
        """SELECT (SELECT count(*) FROM d_profile) AS suppliers, (SELECT count(province) FROM d_profile) AS with_province,
        (SELECT count(*) FROM d_profile WHERE corpus_length > 0) AS with_corpus, (SELECT count(mean_amount) FROM d_profile) AS with_amount,
        0 AS awards_without_supplier, (SELECT count(*) - count(amount) FROM d_line) AS lines_without_amount"""
    ),
)
def run_counters(d: Domain) -> DataFrame:
    """Counters of a profile build."""
    h = d.history()
    return profiles.run_counters(h, profiles.profiles(h))


@job(
    "union_years_distinct",
    "SELECT DISTINCT o_custkey AS buyer_id, o_orderpriority AS modality FROM orders",
)
def union_years_distinct(d: Domain) -> DataFrame:
    """All year slices concatenated, then distinct rows."""
    orders = d.table("orders")
    year = F.year("o_orderdate")
    slices = [year < 1993, *(year == y for y in range(1993, 1998)), year > 1997, year.isNull()]
    every = reduce(DataFrame.unionByName, [orders.filter(s) for s in slices])
    return every.select(F.col("o_custkey").alias("buyer_id"), F.col("o_orderpriority").alias("modality")).distinct()


@job(
    "budget_fallback",
    sql(
        """SELECT status, reason, first_origin, final_origin, count(*) AS n, round(sum(first_amount), 2) AS first_sum,
        round(sum(final_amount), 2) AS final_sum FROM (
        SELECT CASE status WHEN 'O' THEN 'active' WHEN 'F' THEN 'complete' END AS status,
          CASE WHEN raw_modality IS NULL THEN 'sin_modalidad' WHEN final_amount IS NULL THEN 'sin_presupuesto' END AS reason, * EXCLUDE (status)
        FROM (SELECT *,
          CASE WHEN value > 0 THEN value WHEN lots > 0 THEN lots WHEN awarded > 0 THEN awarded END AS first_amount,
          CASE WHEN value > 0 THEN 'tender.value' WHEN lots > 0 THEN 'tender.lots' WHEN awarded > 0 THEN 'awards.value' ELSE 'sin_monto' END AS first_origin,
          CASE WHEN coalesce(value, lots) > 0 THEN coalesce(value, lots) END AS final_amount,
          CASE WHEN coalesce(value, lots) > 0 THEN CASE WHEN value IS NOT NULL THEN 'tender.value' ELSE 'tender.lots' END END AS final_origin
          FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_tax * 1000 END AS value,
            CASE WHEN l_linenumber <= 4 THEN l_quantity + l_discount END AS lots,
            CASE WHEN status <> 'O' AND l_returnflag <> 'N' THEN l_extendedprice END AS awarded FROM d_rel)))
        GROUP BY 1, 2, 3, 4""",
        **LINE_SQL,
    ),
)
def budget_fallback(d: Domain) -> DataFrame:
    """Both budget rules over every release, with origin and first failing check."""
    value, lots = F.col("tender.value.amount"), nested.amount_sum(F.col("tender.lots"))
    awarded = nested.amount_sum(F.col("awards"))
    first, first_origin = nested.process_amount(value, lots, awarded)
    final, final_origin = nested.budget(value, lots)
    rows = line_releases(d).select(
        F.col("tender.status").alias("status"),
        nested.first_failure(
            [
                ("sin_modalidad", F.col("tender.procurementMethodDetails").isNull()),
                ("sin_presupuesto", final.isNull()),
            ]
        ).alias("reason"),
        first.alias("first"), first_origin.alias("first_origin"),
        final.alias("final"), final_origin.alias("final_origin"),
    )
    return rows.groupBy("status", "reason", "first_origin", "final_origin").agg(
        F.count("*").alias("n"), F.round(F.sum("first"), 2).alias("first_sum"), F.round(F.sum("final"), 2).alias("final_sum")
    )


@job(
    "province_normalise",
    """SELECT name, count(*) AS n FROM (SELECT nullif(trim(regexp_replace(upper(strip_accents(trim(word))), '\\s+', ' ', 'g')), '') AS name
       FROM (SELECT unnest(string_split(replace(text, 'ß', 's'), '.')) AS word FROM documents)) GROUP BY 1""",
)
def province_normalise(d: Domain) -> DataFrame:
    """The place-name normaliser over every sentence of the multilingual documents."""
    words = d.table("documents").select(
        F.explode(F.split(F.regexp_replace("text", "ß", "s"), r"\.")).alias("word")
    )
    return words.groupBy(text.province_name(F.col("word")).alias("name")).agg(F.count("*").alias("n"))


@job(
    "modality_normalise",
    sql(
        """SELECT raw_modality, CASE WHEN raw_modality LIKE 'Catálogo%' THEN 'Catalogo Electronico'
        WHEN coalesce(raw_modality, 'Otros') IN (SELECT name FROM d_kept) THEN coalesce(raw_modality, 'Otros') ELSE 'Otros' END AS modality,
        CASE WHEN raw_modality LIKE 'Catálogo%' THEN 'Catálogo Electrónico' ELSE raw_modality END AS first_round, count(*) AS n
        FROM d_open GROUP BY 1, 2, 3"""
    ),
)
def modality_normalise(d: Domain) -> DataFrame:
    """Raw modality names under both normalisers."""
    rows = d.open_processes()
    kept = tenders.kept_modalities(rows).scalar()
    return (
        rows.withColumn("_kept", kept)
        .select(
            "raw_modality",
            text.normalise_modality(F.col("raw_modality"), F.col("_kept")).alias("modality"),
            text.collapse_catalogue(F.col("raw_modality")).alias("first_round"),
        )
        .groupBy("raw_modality", "modality", "first_round")
        .agg(F.count("*").alias("n"))
    )


@job(
    "top_modalities",
    sql("SELECT name, CAST(row_number() OVER (ORDER BY n DESC, name) AS BIGINT) AS position FROM (SELECT coalesce(raw_modality, 'Otros') AS name, count(*) AS n FROM d_open "
        "WHERE coalesce(raw_modality, '') NOT LIKE 'Catálogo%' GROUP BY 1 ORDER BY n DESC, name LIMIT 8)"),
)
def top_modalities(d: Domain) -> DataFrame:
    """The eight kept modality names in order."""
    kept = tenders.kept_modalities(d.open_processes())
    return kept.select(F.posexplode("kept").alias("position", "name")).select(
        "name", (F.col("position") + 1).cast("long").alias("position")
    )


@job(
    "code_prefixes",
    """SELECT p_partkey, substr(c, 1, 3) AS digits3, CASE WHEN length(c) >= 13 THEN substr(c, 1, 13) END AS digits13,
       substr(c, 1, 4) AS chars4, 2 AS parts, 1 AS shared FROM (SELECT p_partkey, lpad(split_part(p_brand, '#', 2), 2, '0') ||
       lpad(CAST(p_size AS VARCHAR), 2, '0') || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS c FROM part)""",
)
def code_prefixes(d: Domain) -> DataFrame:
    """Prefix rules and set operations on item codes."""
    rows = d.table("part").select("p_partkey", d.code().alias("code"))
    joined = F.concat(F.col("code"), F.lit("||"), F.substring("code", 1, 5))
    dotted = F.concat_ws(".", F.substring("code", 1, 2), F.substring("code", 3, 100))
    parsed = code_fn.split_codes(joined)
    return rows.select(
        "p_partkey",
        code_fn.digit_prefix(dotted, 3).alias("digits3"),
        code_fn.digit_prefix(dotted, 13).alias("digits13"),
        code_fn.char_prefix(F.col("code")).alias("chars4"),
        F.size(parsed).alias("parts"),
        F.size(code_fn.prefix_set(parsed)).alias("shared"),
    )


@job(
    "supplier_profile",
    sql(
        """SELECT supplier_id, name, awards, round(mean_amount, 4) AS mean_amount, province, n_codes, CAST(corpus_length AS BIGINT) AS corpus_length,
        (SELECT string_agg(m || '=' || n, ',' ORDER BY m) FROM (SELECT coalesce(modality, '(sin dato)') AS m, count(*) AS n FROM d_line l
          WHERE l.supplier_id = p.supplier_id GROUP BY 1)) AS modalities FROM d_profile p"""
    ),
)
def supplier_profile(d: Domain) -> DataFrame:
    """Award counts, means, sets, modes and histogram per supplier."""
    rows = profiles.profiles(d.history())
    entries = F.transform(
        F.array_sort(F.map_entries("modalities")),
        lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")),
    )
    return rows.select(
        "supplier_id", "name", "awards", F.round("mean_amount", 4).alias("mean_amount"), "province", "n_codes",
        "corpus_length", F.array_join(entries, ",").alias("modalities"),
    )


@job(
    "supplier_corpus",
    sql("SELECT supplier_id, ocid, text FROM d_histitem"),
)
def supplier_corpus(d: Domain) -> DataFrame:
    """The suppliers' item texts in reading order, as rows."""
    past = d.processes().filter(F.col("status") != "O").select("ocid")
    rows = d.items().join(past, "ocid").join(
        d.suppliers().select("s_suppkey", "supplier_id"), F.col("l_suppkey") == F.col("s_suppkey")
    ).select("supplier_id", "ocid", "text")
    return profiles.corpus_rows(rows, ["ocid"])


@job("supplier_buyer_counts", sql("SELECT supplier_id, buyer_id, n_awards FROM d_pair"))
def supplier_buyer_counts(d: Domain) -> DataFrame:
    return profiles.supplier_buyer_counts(d.history().lines)


@job(
    "buyer_code_triples",
    sql("SELECT DISTINCT buyer_id, code, CAST(ocid AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) AS award_uid FROM d_histitem"),
)
def buyer_code_triples(d: Domain) -> DataFrame:
    return profiles.buyer_code_facts(d.history())


@job(
    "latest_by_date",
    """SELECT ocid, date, position FROM (SELECT l_orderkey AS ocid, strftime(l_shipdate, '%Y-%m-%d') AS date,
       CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS position, row_number() OVER (PARTITION BY l_orderkey
       ORDER BY l_shipdate DESC, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS r FROM lineitem) WHERE r = 1""",
)
def latest_by_date(d: Domain) -> DataFrame:
    """One version per process: the latest date, the earlier read on a tie."""
    return choose.keep_latest_date(_versions(d)).select("ocid", "date", "position")


def _versions(d: Domain) -> DataFrame:
    return d.table("lineitem").select(
        F.col("l_orderkey").alias("ocid"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.lit("all").alias("source_year"),
        (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("position"),
    )


@job(
    "last_read",
    """SELECT ocid, year AS source_year, position FROM (SELECT l_orderkey AS ocid, CAST(year(l_shipdate) AS VARCHAR) AS year,
       CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS position, row_number() OVER (PARTITION BY l_orderkey
       ORDER BY year(l_shipdate) DESC, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey DESC) AS r FROM lineitem) WHERE r = 1""",
)
def last_read(d: Domain) -> DataFrame:
    """One version per process: the last one read."""
    rows = _versions(d).withColumn("source_year", F.substring("date", 1, 4))
    return choose.keep_last_read(rows).select("ocid", "source_year", "position")


@job("active_tenders", sql("SELECT ocid, buyer_id, buyer_province, budget, modality, date, source_year FROM d_tender"))
def active_tenders(d: Domain) -> DataFrame:
    """Usable open tenders with their normalised modality."""
    rows = d.open_processes().withColumn("position", F.col("ocid"))
    return tenders.active_tenders(rows).select(
        "ocid", "buyer_id", "buyer_province", "budget", "modality", "date", "source_year"
    )


@job(
    "status_modality_histogram",
    sql("""SELECT source_year, 'status' AS kind, status AS value, count(*) AS n FROM d_proc GROUP BY 1, 3
        UNION ALL SELECT source_year, 'modality', coalesce(raw_modality, '(sin dato)'), count(*) FROM d_proc GROUP BY 1, 3"""),
)
def status_modality_histogram(d: Domain) -> DataFrame:
    rows = d.processes()
    out = []
    for kind, column in (("status", "status"), ("modality", "raw_modality")):
        h = choose.histogram(rows, ["source_year"], column)
        out.append(h.select("source_year", F.lit(kind).alias("kind"), F.col(column).alias("value"), "n"))
    return out[0].unionByName(out[1])


@job(
    "modality_ratio",
    sql("""SELECT coalesce(raw_modality, '(sin dato)') AS raw_modality, count(*) FILTER (l_quantity > 25) AS with_flag, count(*) AS total,
        round(100.0 * count(*) FILTER (l_quantity > 25) / count(*), 2) AS pct FROM lineitem JOIN d_proc ON l_orderkey = ocid GROUP BY 1"""),
)
def modality_ratio(d: Domain) -> DataFrame:
    """Share of lines with bidders, per modality."""
    lines = d.table("lineitem").select("l_orderkey", (F.col("l_quantity") > 25).alias("has"))
    rows = lines.join(d.processes(), F.col("l_orderkey") == F.col("ocid"))
    return coverage.ratio_by(rows, "raw_modality", "has")


@job(
    "top_modalities_by_year",
    sql("""SELECT source_year, raw_modality, n, rank FROM (SELECT source_year, coalesce(raw_modality, '(sin dato)') AS raw_modality, count(*) AS n,
        row_number() OVER (PARTITION BY source_year ORDER BY count(*) DESC, coalesce(raw_modality, '(sin dato)')) AS rank
        FROM d_proc GROUP BY 1, 2) WHERE rank <= 10"""),
)
def top_modalities_by_year(d: Domain) -> DataFrame:
    top = choose.top_values(d.processes(), "raw_modality", 10, ["source_year"])
    return top.select("source_year", "raw_modality", "n", F.col("rank").cast("long").alias("rank"))


_FULL = {
    "d_full": """SELECT p.ocid, supplier_id, region, buyer_id, raw_modality, amount FROM (SELECT l_orderkey, l_suppkey,
        sum(l_extendedprice * (1 - l_discount)) AS amount FROM lineitem GROUP BY 1, 2) a JOIN d_proc p ON l_orderkey = p.ocid
        AND status = 'F' JOIN d_sup ON l_suppkey = s_suppkey"""
}


@job(
    "history_complete_only",
    sql("""SELECT supplier_id, count(*) AS processes, round(median(amount), 6) AS median_amount, any_value(region) AS province,
        count(*) FILTER (raw_modality LIKE 'Catálogo%') AS catalogue_awards FROM d_full GROUP BY 1""", **_FULL),
)
def history_complete_only(d: Domain) -> DataFrame:
    """First-round history: completed processes only, exact medians of positive amounts."""
    lines = d.history(("F",)).lines
    counts = lines.groupBy("supplier_id").agg(
        F.count("*").alias("processes"), F.count_if(text.is_catalogue(F.col("modality"))).alias("catalogue_awards")
    )
    medians = running.medians(lines.filter(F.col("amount") > 0), ["supplier_id"], "amount", "median_amount")
    province = choose.mode(lines, ["supplier_id"], "region", "province").drop("province_n")
    return counts.join(medians, "supplier_id").join(province, "supplier_id", "left").select(
        "supplier_id", "processes", F.round("median_amount", 6).alias("median_amount"), "province", "catalogue_awards"
    )


@job(
    "smallest_record",
    sql("""SELECT ocid, items, bytes FROM (SELECT ocid, (SELECT count(*) FROM lineitem WHERE l_orderkey = ocid) AS items,
        length(coalesce(raw_modality, '')) + length(buyer_province) AS bytes FROM d_proc) ORDER BY items, bytes, ocid LIMIT 1"""),
)
def smallest_record(d: Domain) -> DataFrame:
    """The process with the fewest items, then the shortest text."""
    counts = d.table("lineitem").groupBy(F.col("l_orderkey").alias("ocid")).agg(F.count("*").alias("n"))
    rows = d.processes().join(counts, "ocid", "left").select(
        "ocid", F.coalesce("n", F.lit(0)).alias("items"),
        (F.length(F.coalesce("raw_modality", F.lit(""))) + F.length("buyer_province")).alias("bytes"),
    )
    return choose.smallest(rows, [F.col("items"), F.col("bytes"), F.col("ocid")], ["ocid", "items", "bytes"])


@job(
    "first_distinct_regions",
    sql("SELECT buyer_province, min(ocid) AS first_seen FROM d_proc GROUP BY 1 ORDER BY 2 LIMIT 10"),
)
def first_distinct_regions(d: Domain) -> DataFrame:
    return choose.first_distinct(d.processes(), "buyer_province", F.col("ocid"))


@job(
    "eligible_suppliers",
    sql("""SELECT supplier_id, province, awards, n_codes, competitive_awards, round(catalogue_share, 6) AS catalogue_share FROM d_elig"""),
)
def eligible_suppliers(d: Domain) -> DataFrame:
    return d.eligible().select(
        "supplier_id", "province", "awards", "n_codes", "competitive_awards",
        F.round("catalogue_share", 6).alias("catalogue_share"),
    )


@job(
    "normalised_supplier_modalities",
    sql("""SELECT supplier_id, CASE WHEN modality LIKE 'Catálogo%' THEN 'Catalogo Electronico'
        WHEN coalesce(modality, '(sin dato)') IN (SELECT name FROM d_kept) THEN modality ELSE 'Otros' END AS modality, count(*) AS n
        FROM d_line GROUP BY 1, 2"""),
)
def normalised_supplier_modalities(d: Domain) -> DataFrame:
    """Each supplier's history under the tenders' normalised modality names."""
    kept = tenders.kept_modalities(d.open_processes())
    return profiles.normalised_modalities(profiles.profiles(d.history()), kept)


@job(
    "pick_distinct_provinces",
    sql("""SELECT 'P' || CAST(row_number() OVER (ORDER BY competitive_awards DESC, supplier_id) AS VARCHAR) AS alias, substr(supplier_id, 3, 13) AS tax_id,
        province, competitive_awards FROM d_pick"""),
)
def pick_distinct_provinces(d: Domain) -> DataFrame:
    """The example suppliers: best of three provinces, with alias and short id."""
    chosen = profiles.pick_distinct_provinces(d.eligible(), 3, PRIORITY)
    entry = F.struct(
        (-F.col("competitive_awards")).alias("m"), "supplier_id", "province", "competitive_awards"
    )
    # Three rows by definition.
    listed = chosen.agg(F.sort_array(F.collect_list(entry)).alias("s")).select(F.posexplode("s").alias("pos", "s"))
    return listed.select(
        F.concat(F.lit("P"), F.col("pos") + 1).alias("alias"),
        text.tax_id(F.col("s.supplier_id")).alias("tax_id"),
        "s.province",
        "s.competitive_awards",
    )


_CAND = {
    **_FULL,
    "d_cand": """SELECT supplier_id, count(*) AS awards, count(*) FILTER (raw_modality LIKE 'Catálogo%') AS catalogue_awards
        FROM d_full f WHERE region <> 'NATION_24' GROUP BY 1 HAVING (SELECT count(DISTINCT code) FROM d_histitem h
        JOIN d_proc USING (ocid) WHERE status = 'F' AND h.supplier_id = f.supplier_id) >= 5""",
}


def candidates(d: Domain) -> DataFrame:
    """Completed-history suppliers with a place, texts, five codes and amounts."""
    h = d.history(("F",))
    cells = profiles.supplier_cells(h.lines)
    counts = cells.groupBy("supplier_id").agg(
        F.sum("n").alias("awards"),
        F.sum(F.when(text.is_catalogue(F.col("modality")), F.col("n")).otherwise(0)).alias("catalogue_awards"),
        F.bool_or(F.col("region").isin(*VALID_PROVINCES)).alias("placed"),
        F.sum("n_amount").alias("amounts"),
    )
    codes = h.supplier_codes.distinct().groupBy("supplier_id").agg(F.count("*").alias("n_codes"))
    return counts.join(codes, "supplier_id").filter(
        F.col("placed") & (F.col("amounts") > 0) & (F.col("n_codes") >= fixed.MIN_CODES)
    ).select("supplier_id", "awards", "catalogue_awards")


@job(
    "candidate_two_lists",
    sql("""SELECT supplier_id, CAST(min(position) AS BIGINT) AS position FROM (
        SELECT supplier_id, row_number() OVER (ORDER BY awards DESC, supplier_id) - 1 AS position FROM d_cand QUALIFY position < 8
        UNION ALL SELECT supplier_id, row_number() OVER (ORDER BY awards - catalogue_awards DESC, supplier_id) + 7 AS position
        FROM d_cand QUALIFY position < 16) GROUP BY 1""", **_CAND),
)
def candidate_two_lists(d: Domain) -> DataFrame:
    """Two top-eight lists merged in order."""
    return profiles.top_two_lists(candidates(d)).select("supplier_id", F.col("position").cast("long").alias("position"))


@job(
    "lookup_supplier",
    sql("""SELECT 'id' AS kind, supplier_id, name, awards FROM (SELECT * FROM d_profile WHERE supplier_id LIKE 'S-0000000000003-%' ORDER BY awards DESC LIMIT 1)
        UNION ALL SELECT 'name', supplier_id, name, awards FROM (SELECT * FROM d_profile WHERE contains(upper(name), 'SUPPLIER#00000000') ORDER BY awards DESC, supplier_id LIMIT 1)"""),
)
def lookup_supplier(d: Domain) -> DataFrame:
    """Lookup by 13 digits and by part of a name."""
    rows = profiles.profiles(d.history())
    keep = ["supplier_id", "name", "awards"]
    by_id = profiles.lookup_by_digits(rows, "0000000000003").select(F.lit("id").alias("kind"), *keep)
    by_name = profiles.lookup_by_name(rows, "supplier#00000000 S.A.").select(F.lit("name").alias("kind"), *keep)
    return by_id.unionByName(by_name)


@job(
    "amount_percentiles",
    sql("""SELECT supplier_id, round(quantile_cont(amount, 0.01), 6) AS p01, round(quantile_cont(amount, 0.5), 6) AS p50,
        round(quantile_cont(amount, 0.9), 6) AS p90, round(quantile_cont(amount, 0.99), 6) AS p99 FROM d_line GROUP BY 1"""),
)
def amount_percentiles(d: Domain) -> DataFrame:
    """Exact percentiles of won amounts per supplier."""
    marks = {"p01": 0.01, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    rows = running.percentiles(d.history().lines, ["supplier_id"], "amount", marks)
    return rows.select("supplier_id", *[F.round(m, 6).alias(m) for m in marks])


@job(
    "describe",
    sql(" UNION ALL ".join(
        f"SELECT '{v}' AS variable, count(*) AS n, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std, round(min({v}), 4) AS min, "
        f"round(max({v}), 4) AS max, round(quantile_cont({v}, 0.5), 4) AS p50, round(quantile_cont({v}, 0.9), 4) AS p90, "
        f"round(quantile_cont({v}, 0.99), 4) AS p99 FROM d_frame" for v in Domain.FRAME)),
)
def describe(d: Domain) -> DataFrame:
    rows = prepare.summary(d.frame(), [], Domain.FRAME)
    return rows.select("variable", "n", *[F.round(c, 4).alias(c) for c in ["mean", "std", "min", "max", "p50", "p90", "p99"]])


@job(
    "buyer_activity",
    sql("SELECT ocid, activity FROM d_act"),
)
def buyer_activity(d: Domain) -> DataFrame:
    """Distinct past awards of each tender's buyer sharing a full code."""
    m = d.market()
    return matrix.buyer_activity(m.tender_codes, m.buyer_codes)


@job(
    "buyer_activity_prefix",
    sql("""SELECT buyer_id, count(DISTINCT i.ocid) AS processes FROM d_item i JOIN d_proc p ON i.ocid = p.ocid AND status = 'F'
        WHERE substr(code, 1, 3) IN (SELECT substr(code, 1, 3) FROM d_histitem JOIN d_proc USING (ocid) WHERE status = 'F'
        AND supplier_id = (SELECT supplier_id FROM d_cand ORDER BY awards DESC, supplier_id LIMIT 1)) GROUP BY 1""", **_CAND),
)
def buyer_activity_prefix(d: Domain) -> DataFrame:
    """Completed processes per buyer that share a code prefix with one supplier."""
    h = d.history(("F",))
    top = candidates(d).orderBy(F.col("awards").desc(), "supplier_id").limit(1).select("supplier_id")
    mine = h.supplier_codes.join(top, "supplier_id", "left_semi")
    past = d.processes().filter(F.col("status") == "F").select("ocid", "buyer_id")
    return matrix.buyer_prefix_activity(d.items().join(past, "ocid"), mine)


@job(
    "code_depth_match",
    sql("""SELECT ocid, supplier_id, round(sum(CASE WHEN l5 THEN 5 WHEN l4 THEN 4 WHEN l3 THEN 3 WHEN l2 THEN 2 WHEN l1 THEN 1 ELSE 0 END) / 5.0 / count(*), 6) AS score
        FROM (SELECT t.ocid, s.supplier_id, """
        + ", ".join(f"substr(t.code, 1, {n}) IN (SELECT substr(h.code, 1, {n}) FROM d_mine h WHERE h.supplier_id = s.supplier_id) AS l{n}" for n in range(1, 6))
        + """ FROM d_openitem t, (SELECT DISTINCT supplier_id FROM d_mine) s) GROUP BY 1, 2 HAVING score > 0""",
        d_mine="SELECT supplier_id, code FROM d_histitem WHERE supplier_id IN (SELECT supplier_id FROM d_pick)"),
)
def code_depth_match(d: Domain) -> DataFrame:
    """Hierarchical code match of the portfolio with every open tender."""
    m = d.market()
    ids = [p["supplier_id"] for p in d.portfolio()]
    mine = m.supplier_codes.filter(F.col("supplier_id").isin(*ids))
    scores = matrix.code_depth(m.tender_codes, mine)
    return scores.select("ocid", "supplier_id", F.round("score", 6).alias("score"))


