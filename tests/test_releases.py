"""Release files: package shapes, bad lines, history and open tenders on small fixtures."""

import gzip
import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tenderloom.functions import nested, text
from tenderloom.operators import choose, coverage, profiles, tenders
from tenderloom.sources import releases


def item(code, description=None, extra=()):
    out = {"classification": {"id": code, "description": "clase"}}
    if description:
        out["description"] = description
    if extra:
        out["additionalClassifications"] = [{"id": e} for e in extra]
    return out


AWARDED = {
    "ocid": "ocds-x1-A-1", "date": "2024-03-01T00:00:00-05:00", "buyer": {"id": "B1"},
    "parties": [
        {"id": "S1", "roles": ["supplier"], "address": {"region": "Guayas"}},
        {"id": "S1", "roles": ["supplier"], "address": {"region": "  cañar "}},
        {"id": "B1", "roles": ["buyer"]},
        {"id": "B1", "roles": ["buyer"], "address": {"region": "Los  Ríos"}},
    ],
    "tender": {"status": "complete", "procurementMethodDetails": "Licitación"},
    "awards": [
        {"value": {"amount": 100}, "suppliers": [{"id": "S1", "name": " Uno "}, {"id": "S1", "name": "Uno"}],
         "items": [item(111110, "papel bond"), item("111110", "papel fino")]},
        {"value": {"amount": 0}, "suppliers": [{"id": "S2", "name": "Dos"}], "items": []},
        {"suppliers": [], "items": [item("222220")]},
        {"suppliers": [{"id": "S2"}], "items": [item("333330", "tinta")]},
    ],
    "planning": {"budget": {"amount": {"amount": 5}}},
}


def tender(ocid, **kw):
    base = {
        "ocid": ocid, "date": "2025-01-01", "buyer": {"id": "B1"},
        "parties": [{"id": "B1", "roles": ["buyer"], "address": {"region": "Sto Domingo de los Tsáchilas"}}],
        "tender": {"status": "active", "procurementMethodDetails": "Cotización", "value": {"amount": 10.0},
                   "items": [item("1111", "mesa", ["2222"]), item("1111", "silla")]},
    }
    base["tender"].update(kw.pop("tender", {}))
    base.update(kw)
    return base


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("releases")

    def write(name, lines):
        with gzip.open(folder / name, "wt", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")

    write("2024.jsonl.gz", ["", json.dumps({"releases": [AWARDED]}), "   "])
    write("2025.jsonl.gz", [
        json.dumps({"compiledRelease": tender("T1")}),
        json.dumps(tender("T2", tender={"value": None, "lots": [{"value": {"amount": 3}}, {"value": {"amount": 4}}]})),
        json.dumps(tender("T3", tender={"value": {"amount": 0}, "lots": [{"value": {"amount": 9}}]})),
        json.dumps(tender("T4", buyer=None)),
        json.dumps(tender("T5", tender={"procurementMethodDetails": "Catálogo electrónico - X"})),
    ])
    write("2026.jsonl.gz", [json.dumps({"releases": [tender("T1", date="2026-02-02", tender={"value": {"amount": 77}})]})])
    (folder / "bad.jsonl").write_text(json.dumps(AWARDED) + '\n{"ocid": "broken", "tender": {\n')
    return folder


def test_three_shapes_and_years(spark, files):
    rows = releases.read_releases(spark, [str(files / f"{y}.jsonl.gz") for y in (2024, 2025, 2026)], partitions=3)
    got = {(r.source_year, r.ocid) for r in rows.collect()}
    assert ("2024", "ocds-x1-A-1") in got and ("2026", "T1") in got and len(got) == 7


def test_bad_lines(spark, files):
    path = str(files / "bad.jsonl")
    with pytest.raises((PySparkException, Py4JJavaError)):
        releases.read_releases(spark, path).collect()
    assert releases.read_releases(spark, path, "DROPMALFORMED").count() == 1
    kept = releases.read_releases(spark, path, "PERMISSIVE").cache()
    assert kept.filter("_corrupt_record is not null").count() == 1
    with pytest.raises(PySparkException):
        releases.read_releases(spark, str(files / "absent.jsonl.gz")).collect()


def test_history_and_profiles(spark, files):
    h = profiles.history(releases.read_releases(spark, str(files / "2024.jsonl.gz")))
    got = {r.supplier_id: r for r in profiles.profiles(h).collect()}
    one, two = got["S1"], got["S2"]
    # Named twice in one award: counted twice, last usable region, one distinct code.
    assert (one.awards, one.mean_amount, one.province, one.n_codes, one.name) == (2, 100.0, "CANAR", 1, "Uno")
    assert one.corpus_length == len("papel bond papel fino papel bond papel fino")
    assert one.modalities == {"Licitación": 2}
    # A zero amount counts in the mean, a missing one does not.
    assert (two.awards, two.mean_amount, two.province, two.n_codes) == (2, 0.0, None, 1)
    facts = {(r.buyer_id, r.code) for r in profiles.buyer_code_facts(h).collect()}
    assert facts == {("B1", "111110"), ("B1", "222220"), ("B1", "333330")}
    assert {(r.supplier_id, r.n_awards) for r in profiles.supplier_buyer_counts(h.lines).collect()} == {("S1", 2), ("S2", 2)}
    c = profiles.run_counters(h, profiles.profiles(h)).first()
    assert (c.suppliers, c.with_province, c.awards_without_supplier) == (2, 1, 1)


def test_open_tenders(spark, files):
    rows = releases.read_releases(spark, [str(files / f"{y}.jsonl.gz") for y in (2025, 2026)])
    p = tenders.open_processes(rows)
    assert {r.reason: r.n for r in tenders.discard_counts(p).collect()} == {"sin_buyer": 1, "sin_presupuesto": 1}
    got = {r.ocid: r for r in tenders.active_tenders(p).collect()}
    assert set(got) == {"T1", "T2", "T5"}
    assert (got["T1"].budget, got["T1"].source_year) == (77.0, "2026")
    assert (got["T2"].budget, got["T2"].budget_origin) == (7.0, "tender.lots")
    assert got["T5"].modality == "Catalogo Electronico" and got["T1"].modality == "Cotización"
    assert got["T1"].buyer_province == "STO DOMINGO DE LOS TSACHILAS" and got["T1"].text == "mesa silla"
    first = {r.ocid: r for r in tenders.first_round_processes(rows.filter("source_year = '2025'")).collect()}
    assert first["T3"].amount == 9.0 and first["T3"].amount_origin == "tender.lots"
    assert first["T1"].codes == ["1111", "2222", "1111"]
    assert first["T1"].buyer_province == "SANTO DOMINGO DE LOS TSACHILAS"
    assert first["T5"].modality == "Catálogo Electrónico" and first["T1"].reason is None


def test_presence(spark, files):
    rows = releases.read_releases(spark, str(files / "2024.jsonl.gz"))
    cover = {r.field: r.filled for r in coverage.coverage(coverage.field_presence(rows, ["source_year"])).collect()}
    assert cover["planning.budget"] == 1 and cover["tender.value.amount"] == 0
    assert cover["parties[].address.region (buyer)"] == 1 and cover["bids.details[]"] == 0


def test_latest_versions(spark):
    rows = spark.createDataFrame(
        [("a", "2024-01-01", "2024", 1), ("a", "2024-01-01", "2024", 2), ("a", "2023-01-01", "2025", 3), (None, "x", "2024", 4), (None, "y", "2024", 5)],
        "ocid string, date string, source_year string, position long",
    )
    # Lines with neither an ocid nor an id are skipped; an id stands in for an ocid.
    assert {(r.ocid, r.position) for r in choose.keep_latest_date(rows).collect()} == {("a", 1)}
    named = rows.withColumn("id", F.when(F.col("position") >= 4, F.lit("r1")).otherwise(F.lit("")))
    assert {(r.ocid, r.position) for r in choose.keep_latest_date(named).collect()} == {("a", 1), (None, 5)}
    assert {(r.ocid, r.position) for r in choose.keep_last_read(rows).collect()} == {("a", 3), (None, 5)}


def test_kept_modalities_fill_nulls_and_break_ties(spark):
    names = [n for i, n in enumerate("abcdefghij") for _ in range(2 if i < 7 else 1)] + [None] * 5 + ["Catálogo Z"] * 9
    rows = spark.createDataFrame([(n,) for n in names], "raw_modality string")
    kept = tenders.kept_modalities(rows).first().kept
    assert kept == ["Otros", "a", "b", "c", "d", "e", "f", "g"]


def test_text_rules(spark):
    df = spark.createDataFrame([("  Cañaŕ  del  Sur ", "EC-RUC-0991410465001-77", "ocds-5wno2w-SIE-X-2024-1-77")], "a string, b string, c string")
    r = df.select(
        text.province_name(F.col("a")).alias("p"), text.known_province(F.lit(" Caniar ")).alias("k"), text.known_province(F.lit("Lima")).alias("u"),
        text.tax_id(F.col("b")).alias("t"), text.portal_code(F.col("c")).alias("c"), text.portal_code(F.lit("zz")).alias("z"),
        text.query_digits(F.lit("0991-410465-001")).alias("d"), text.query_digits(F.lit("12")).alias("n"),
        text.plain_tokens(F.lit("Adquisición de MÉDICOS y el año 5")).alias("w"), text.is_catalogue(F.lit(None).cast("string")).alias("i"),
        text.after_marker(F.lit("x DESCALIFICADO: poco "), "DESCALIFICADO:").alias("m"),
        nested.still_open(F.lit("2026-01-05T00:00"), F.lit("2026-01-05")).alias("o"),
    ).first()
    assert r.p == "CANAR DEL SUR" and r.k == "CANAR" and r.u is None
    assert r.t == "0991410465001" and r.c == "SIE-X-2024-1" and r.z == "zz" and r.d == "0991410465001" and r.n is None
    assert r.w == ["medicos", "ano"] and r.i is False and r.m == "poco" and r.o is True
