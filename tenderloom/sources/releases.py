"""Release files: explicit schema, package unwrapping, malformed-line policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The subset of an open-contracting release that the jobs read. Codes may be
# numbers and a budget may be an object or a bare number, so both are read as text.
_ITEM = (
    "struct<description:string,classification:struct<id:string,description:string>,"
    "additionalClassifications:array<struct<id:string>>>"
)
_FIELD_TYPES = {
    "ocid": "string",
    "id": "string",
    "date": "string",
    "buyer": "struct<id:string,name:string>",
    "parties": "array<struct<id:string,name:string,roles:array<string>,"
    "address:struct<region:string>>>",
    "tender": "struct<status:string,procurementMethodDetails:string,title:string,"
    "description:string,value:struct<amount:double>,"
    "lots:array<struct<value:struct<amount:double>>>,"
    f"items:array<{_ITEM}>,tenderPeriod:struct<endDate:string>,"
    "tenderers:array<struct<id:string>>>",
    "awards": "array<struct<value:struct<amount:double>,"
    f"suppliers:array<struct<id:string,name:string>>,items:array<{_ITEM}>>>",
    "planning": "struct<budget:string>",
    "bids": "struct<details:array<struct<id:string>>>",
}
FIELDS = list(_FIELD_TYPES)
RELEASE = ", ".join(f"{name} {kind}" for name, kind in _FIELD_TYPES.items())
RELEASE_STRUCT = "struct<" + ",".join(f"{n}:{k}" for n, k in _FIELD_TYPES.items()) + ">"
PACKAGE = f"{RELEASE}, releases array<{RELEASE_STRUCT}>, compiledRelease {RELEASE_STRUCT}"


def unwrap(package: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """First release of a package, else its compiled release, else the line itself."""
    keep = keep or []
    release = F.coalesce(
        F.get("releases", F.lit(0)), F.col("compiledRelease"), F.struct(*FIELDS)
    )
    return package.select(*keep, release.alias("r")).select(*keep, "r.*")


def read_releases(
    spark: SparkSession,
    paths: str | list[str],
    mode: str = "FAILFAST",
    partitions: int | None = None,
) -> DataFrame:
    """Releases of one or more ``{year}.jsonl.gz`` files with their source year.

    ``FAILFAST`` stops at a bad line, ``DROPMALFORMED`` skips it and
    ``PERMISSIVE`` keeps it in ``_corrupt_record``. Missing paths raise, blank lines do
    not count. A gzip file is one task, so ``partitions`` spreads the rows right after
    parsing. ``position`` orders the lines as they stand in the files: a block of a file is
    read by one task, in order.
    """
    year = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})", 1).alias("source_year")
    position = F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    ).alias("position")
    keep = ["source_year", "position"]
    if mode == "FAILFAST":
        lines = spark.read.schema(PACKAGE).option("mode", mode).json(paths).select("*", year, position)
    else:
        # Whether a line is bad must not depend on the columns a query happens to use,
        # so the whole line is parsed as an expression.
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
        parsed = F.from_json("value", PACKAGE + ", _corrupt_record string", options)
        text = spark.read.text(paths).select("value", year, position).filter(F.trim("value") != "")
        lines = text.select("source_year", "position", parsed.alias("p")).select("source_year", "position", "p.*")
        if mode == "DROPMALFORMED":
            lines = lines.filter(F.col("_corrupt_record").isNull())
        else:
            keep.append("_corrupt_record")
    releases = unwrap(lines, keep)
    return releases.repartition(partitions) if partitions else releases


def parse_lines(lines: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """Releases out of a text column holding one JSON package per row."""
    keep = keep or []
    parsed = F.from_json(F.col(column), PACKAGE, {"mode": "FAILFAST"})
    return unwrap(lines.select(*keep, parsed.alias("p")).select(*keep, "p.*"), keep)


def budget_like_keys(objects: DataFrame, column: str, patterns: list[str], skip: list[str]) -> DataFrame:
    """Key names in a JSON object column that look like a budget, with their counts."""
    key = F.lower("key")
    wanted: Column = F.lit(False)
    for p in patterns:
        wanted = wanted | F.contains(key, F.lit(p))
    return (
        objects.select(F.explode(F.map_keys(F.from_json(column, "map<string,string>"))).alias("key"))
        .filter(wanted & ~F.col("key").isin(*skip))
        .groupBy("key")
        .agg(F.count("*").alias("n"))
    )
