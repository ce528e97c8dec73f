"""The star schema read as suppliers, buyers, tenders and awards.

Orders are processes (status O is open, the rest is history), customers are buyers,
nations are provinces, an award is an (order, supplier) pair and a part is an item
whose code is brand, size and part number.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.functions.geo import haversine_km
from tenderloom.functions.text import normalise_modality
from tenderloom.operators import matrix, profiles, tenders, textsim
from tenderloom.operators.profiles import History
from tenderloom.session import cut_lineage

YEARS = range(1995, 2002)
COMPETITIVE = [f"{p} {y}" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM") for y in YEARS]
VALID_PROVINCES = [f"NATION_{k}" for k in range(24)]
PRIORITY = ["NATION_9", "NATION_17"]


def hash32(key: Column, salt: int = 0) -> Column:
    """An arithmetic hash both engines compute alike."""
    return F.pmod(key * F.lit(2654435761) + F.lit(salt * 40503), F.lit(4294967296))


class Domain:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    @cache
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cache
    def nations(self) -> DataFrame:
        return self.table("nation")

    @cache
    def provinces(self) -> DataFrame:
        """Coordinates by arithmetic on the key; the last nation has none."""
        k = F.col("n_nationkey")
        return self.nations().filter(k != 24).select(
            F.col("n_name").alias("province"),
            (F.lit(-4.0) + F.lit(0.2) * k).alias("lat"),
            (F.lit(-81.0) + F.lit(0.25) * F.pmod(k * 7, F.lit(25))).alias("lon"),
        )

    def supplier_id(self) -> Column:
        return F.concat_ws(
            "-", F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 13, "0"),
            F.col("s_nationkey").cast("string"),
        )

    @cache
    def suppliers(self) -> DataFrame:
        # 25 nations at every scale. Written, so that its size is known: the lines aren't moved to meet a small table.
        return cut_lineage(self.table("supplier").join(
            F.broadcast(self.nations()), F.col("s_nationkey") == F.col("n_nationkey")
        ).select("s_suppkey", self.supplier_id().alias("supplier_id"), F.col("s_name").alias("supplier_name"),
                 F.col("n_name").alias("region")))

    def modality(self) -> Column:
        year = F.year("o_orderdate").cast("string")
        p = F.col("o_orderpriority")
        return F.when(p == "5-LOW", F.concat(F.lit("Catálogo Electrónico "), year)).when(
            p != "4-NOT SPECIFIED", F.concat_ws(" ", p, year)
        )

    @cache
    def processes(self) -> DataFrame:
        buyers = self.table("customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
        names = self.nations().select("n_nationkey", F.col("n_name").alias("buyer_province"))
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("ocid"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_custkey").alias("buyer_id"),
            F.col("o_totalprice").alias("budget"),
            self.modality().alias("raw_modality"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.year("o_orderdate").cast("string").alias("source_year"),
        )
        # The nations last: the customers' own size tells whether orders have to move.
        owned = orders.join(buyers, F.col("buyer_id") == F.col("c_custkey")).join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey"))
        return owned.select(*orders.columns, "buyer_province", "c_acctbal", "c_mktsegment")

    def code(self) -> Column:
        return F.concat(
            F.lpad(F.substring_index("p_brand", "#", -1), 2, "0"),
            F.lpad(F.col("p_size").cast("string"), 2, "0"),
            F.lpad(F.col("p_partkey").cast("string"), 9, "0"),
        )

    def parts(self) -> DataFrame:
        return self.table("part").select(
            "p_partkey", self.code().alias("code"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text")
        )

    @cache
    def items(self) -> DataFrame:
        """One row per line: ocid, supplier key, code, text, amount."""
        parts = self.parts()
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("ocid"), "l_suppkey", "l_partkey",
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
        )
        return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")

    @cache
    def stored_lines(self) -> DataFrame:
        """Every line with its part's and its process's rows, written once in buckets by process: the matrix
        reads them many times, and what it groups by process isn't moved again.

        Rows of a repeated key are a list, so a line stays one row: ocid, l_suppkey, amount, parts (code, text),
        owners (status, buyer_id, raw_modality, open).
        """
        is_open = (F.col("status") == "O") & (F.col("budget") > 0)
        owners = self.processes().groupBy("ocid").agg(
            F.collect_list(F.struct("status", "buyer_id", "raw_modality", is_open.alias("open"))).alias("owners")
        )
        parts = self.parts().groupBy("p_partkey").agg(F.collect_list(F.struct("code", "text")).alias("parts"))
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("ocid"), "l_suppkey", "l_partkey",
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
        ).filter("ocid IS NOT NULL")
        # Not broadcast: the parts' file says little of what their codes and texts take in memory, some 30 times as much.
        named = lines.join(parts.hint("merge"), F.col("l_partkey") == F.col("p_partkey"), "left").drop("l_partkey", "p_partkey")
        return cut_lineage(named.join(owners, "ocid"), "ocid")

    @cache
    def stored_items(self) -> DataFrame:
        """The stored lines by part and process: ocid, l_suppkey, code, text, status, buyer_id, open."""
        owned = self.stored_lines().select("ocid", "l_suppkey", "parts", F.inline("owners"))
        return owned.select("ocid", "l_suppkey", "status", "buyer_id", "open", F.inline("parts"))

    def awards(self, statuses: tuple[str, ...], stored: bool = False) -> DataFrame:
        """ocid, l_suppkey, amount, buyer_id and raw_modality of each award."""
        award = ["ocid", "l_suppkey"]
        if stored:
            # Lines of a process carry the same owners.
            rows = self.stored_lines().groupBy(*award).agg(F.sum("amount").alias("amount"), F.first("owners").alias("owners"))
            return rows.select(*award, "amount", F.inline("owners")).filter(F.col("status").isin(*statuses)).drop("status", "open")
        past = self.processes().filter(F.col("status").isin(*statuses)).select("ocid", "buyer_id", "raw_modality")
        return (
            self.table("lineitem")
            .select(F.col("l_orderkey").alias("ocid"), "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
            # Lines of a process lie together, so the join below moves no award again.
            .repartition("ocid")
            .groupBy(*award)
            .agg(F.sum("amount").alias("amount"))
            .join(past, "ocid")
        )

    @cache
    def history(self, statuses: tuple[str, ...] = ("F", "P"), stored: bool = False) -> History:
        suppliers = self.suppliers()
        awards = self.awards(statuses, stored).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        if stored:
            items = self.stored_items().filter(F.col("status").isin(*statuses))
        else:
            past = self.processes().filter(F.col("status").isin(*statuses)).select("ocid", "buyer_id")
            items = self.items().join(past, "ocid")
        named = items.join(suppliers.select("s_suppkey", "supplier_id"), F.col("l_suppkey") == F.col("s_suppkey"))
        return History(
            lines=awards.select(
                "ocid", "supplier_id", "supplier_name", "region", "buyer_id",
                F.col("raw_modality").alias("modality"), "amount",
            ),
            items=named.select("supplier_id", "code", "text"),
            buyer_codes=items.select(
                "buyer_id", "code", F.concat_ws("/", "ocid", "l_suppkey").alias("award_uid")
            ),
        )

    @cache
    def open_processes(self) -> DataFrame:
        return self.processes().filter((F.col("status") == "O") & (F.col("budget") > 0))

    @cache
    def tenders(self) -> DataFrame:
        rows = self.open_processes()
        kept = tenders.kept_modalities(rows)
        return rows.withColumn("_kept", kept.scalar()).withColumn(
            "modality", normalise_modality(F.col("raw_modality"), F.col("_kept"))
        ).drop("_kept", "raw_modality")

    def eligible(self, stored: bool = False) -> DataFrame:
        return profiles.eligible(profiles.profiles(self.history(stored=stored)), VALID_PROVINCES, COMPETITIVE)

    @cache
    def portfolio(self, n: int = 3) -> list[dict]:
        chosen = profiles.pick_distinct_provinces(self.eligible(stored=True), n, PRIORITY)
        return matrix.portfolio_rows(chosen, self.provinces())

    @cache
    def market(self) -> matrix.Market:
        h = self.history(stored=True)
        open_rows = self.tenders()
        # Terms and codes are counted where the lines of a tender lie.
        items = self.stored_items().filter("open")
        return matrix.Market(
            tenders=open_rows,
            tender_codes=items.select("ocid", "buyer_id", "code"),
            tender_terms=textsim.term_counts(items.select("ocid", "text"), "ocid", "text"),
            # Repeats and all: what an award's codes are is settled where its set is built, beside its lines.
            buyer_codes=self.stored_items().filter(F.col("status").isin("F", "P")).select("buyer_id", "code", "ocid", "l_suppkey"),
            supplier_buyer=profiles.supplier_buyer_counts(h.lines),
            supplier_codes=h.supplier_codes,
            supplier_terms=textsim.term_counts(h.supplier_texts, "supplier_id", "text"),
            provinces=self.provinces(),
        )

    def matrix(self, carry: list[str] | None = None) -> DataFrame:
        return matrix.interaction_matrix(self.market(), self.portfolio(), carry)

    def kept_matrix(self) -> DataFrame:
        """The matrix written once for jobs that read it several times."""
        return cut_lineage(self.matrix())

    # ---- a light frame over the open processes for the metric and model jobs ----
    FRAME = ["log_budget", "km", "n_items", "acctbal"]
    FRAME_AXES = [f"u_{v}" for v in FRAME]
    FRAME_PENALTY = (1 / 3) / (4 + 1 / 3)
    SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

    def frame(self, noise: bool = False) -> DataFrame:
        """Four numerics, the modality and a group per open process.

        Distance is to the first province; ``noise`` puts buyers in debt outside all
        groups.
        """
        counts = self.table("lineitem").groupBy(F.col("l_orderkey").alias("ocid")).agg(F.count("*").alias("n"))
        rows = self.tenders().join(counts, "ocid", "left").join(
            F.broadcast(self.provinces().withColumnRenamed("province", "buyer_province")), "buyer_province", "left"
        )
        segment = F.array_position(F.array(*map(F.lit, self.SEGMENTS)), F.col("c_mktsegment")) - 1
        label = F.when(F.col("c_acctbal") < 0, -1).otherwise(segment) if noise else segment
        km = haversine_km(F.lit(-4.0), F.lit(-81.0), F.col("lat"), F.col("lon"))
        return rows.select(
            "ocid",
            F.log1p("budget").alias("log_budget"),
            F.coalesce(km, F.lit(0.0)).alias("km"),
            F.coalesce("n", F.lit(0)).cast("double").alias("n_items"),
            F.col("c_acctbal").alias("acctbal"),
            "modality",
            label.cast("long").alias("cluster"),
        )

    def framed(self, noise: bool = False) -> DataFrame:
        """The frame with its distance axes (range-scaled, not clipped), written once."""
        rows = cut_lineage(self.frame(noise))
        spans = rows.agg(F.struct(*[(F.max(v) - F.min(v)).alias(v) for v in self.FRAME])).scalar()
        total = len(self.FRAME) + 1 / 3
        scaled = rows.withColumn("_span", spans)
        framed = scaled.select(
            *rows.columns,
            *[
                (F.col(v) / F.when(F.col(f"_span.{v}") == 0, 1.0).otherwise(F.col(f"_span.{v}")) / F.lit(total)).alias(f"u_{v}")
                for v in self.FRAME
            ],
        )
        return framed

    def frame_options(self) -> dict:
        return {"axes": self.FRAME_AXES, "category": "modality", "mismatch": self.FRAME_PENALTY}
