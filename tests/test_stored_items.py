"""The matrix reads item lines that were written once, and these are the lines themselves."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tenderloom.operators import matrix
from tenderloom.plans import domain as domain_module
from tenderloom.plans.domain import Domain


@pytest.fixture
def domain(spark, tmp_path):
    """Some processes, with repeated keys, orders without budget, lines without part or order."""
    day = datetime(1999, 5, 1)
    tables = {
        "nation": ([(k, f"NATION_{k}") for k in range(25)], "n_nationkey long, n_name string"),
        "supplier": ([(s, f"Supplier {s}", s % 25) for s in range(8)], "s_suppkey long, s_name string, s_nationkey long"),
        "customer": ([(c, c % 25, 10.0 * c, "BUILDING") for c in [0, 1, 2, 3, 3]], "c_custkey long, c_nationkey long, c_acctbal double, c_mktsegment string"),
        "orders": (
            [(o, o % 4, "OFP"[o % 3], None if o % 7 == 0 else 100.0 + o, day, "1-URGENT") for o in [*range(30), 5, 6]] + [(None, 1, "O", 1.0, day, "5-LOW")],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        ),
        "part": ([(p, f"part {p}", "TYPE", f"Brand#{p % 5}", p % 50) for p in [*range(12), 4]], "p_partkey long, p_name string, p_type string, p_brand string, p_size int"),
        "lineitem": (
            [(i % 33, i % 9, i % 14, 5.0 * i, 0.1) for i in range(120)] + [(None, 1, 1, 1.0, 0.0), (3, 1, None, 1.0, 0.0)],
            "l_orderkey long, l_suppkey long, l_partkey long, l_extendedprice double, l_discount double",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return Domain(spark, str(tmp_path))


def counted(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stored_items_are_the_joined_lines(domain):
    past, stored = domain.history(), domain.history(stored=True)
    assert counted(past.items) == counted(stored.items) and past.items.count()
    assert counted(past.buyer_codes) == counted(stored.buyer_codes)
    owned = domain.items().join(domain.open_processes().select("ocid", "buyer_id"), "ocid").select("ocid", "buyer_id", "code")
    assert counted(owned) == counted(domain.market().tender_codes) and owned.count()


def test_market_joins_no_lines_again(domain):
    m = domain.market()
    for df in (m.tender_codes, m.tender_terms, m.buyer_codes, m.supplier_codes, m.supplier_terms):
        assert "l_partkey" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_prefixes_are_met_without_moving_the_tenders_codes(domain):
    """A first digit is shared by a share of all tenders: no task is given all of them."""
    m = domain.market()
    mine = m.supplier_codes.filter(F.col("supplier_id").isNotNull())
    plan = matrix.code_depth(m.tender_codes, mine)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_what_is_grouped_by_process_is_not_moved(domain):
    """Stored lines lie in buckets by process, with repeated parts and processes as lists."""
    m = domain.market()
    awards = m.buyer_codes.groupBy("ocid", "l_suppkey", "buyer_id").agg(F.collect_set("code"))
    for df in (m.tender_terms, awards, domain.awards(("F", "P"), stored=True)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    past, stored = (domain.history(stored=s).lines for s in (False, True))
    assert counted(past) == counted(stored) and past.count()


def test_activity_of_awards_with_several_codes(spark, domain):
    """An award that shares several codes with a tender counts once; copies of awards and tenders count each."""
    m = domain.market()
    tenders, awards = {}, {}
    for r in m.tender_codes.collect():
        tenders.setdefault((r.ocid, r.buyer_id), set()).add(r.code)
    for r in m.buyer_codes.collect():
        awards.setdefault((r.ocid, r.l_suppkey, r.buyer_id), set()).add(r.code)
    assert any(len(c) > 1 for c in awards.values())
    found = {t: sum(t[1] == a[2] and bool(codes & c) for a, c in awards.items()) for t, codes in tenders.items()}
    want = sorted((t[0], n) for t, n in found.items() if n)
    assert sorted(map(tuple, matrix.buyer_activity(m.tender_codes, m.buyer_codes).collect())) == want and want


def test_parts_are_not_broadcast_to_the_lines(domain, monkeypatch):
    """A small file of parts can be large in memory: the driver never holds them all."""
    written = []
    monkeypatch.setattr(domain_module, "cut_lineage", lambda df, by=None: written.append(df) or df)
    domain.stored_lines()
    plan = written[-1]._jdf.queryExecution().executedPlan().toString()
    parts = [line for line in plan.split("\n") if "Join [l_partkey" in line]
    assert parts and all("SortMergeJoin" in line for line in parts)
