"""Secret scan by corpus-wide ownership of candidates, with DataFrame functions only.

Base kinds are patterns with a length check. The method adds further candidates: formats of
known providers and random-looking values in credentials' places. Every candidate's hash is
counted over the whole corpus by distinct repositories and owners: a value that more than
WIDE owners, or repositories, hold is a copied example, any other is one owner's and looks live. Added candidates
count only if they look live; base spans stay, and are told apart in n_live.

Null and empty texts have no spans. Null repositories and owners are one of their own. A value
that a third of the documents hold is first counted per owner, so no task sees all its rows.
Repeated rows get equal results, and rows with the same id stay apart. Spans of different kinds
may overlap; they are ordered by start, then kind, then end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenderloom.llm import spans
from tenderloom.session import cut_lineage

KINDS = ["assign", "access", "hex", "provider", "private", "url", "bearer"]
BASE = 3
#: A value that more owners, or more repositories, than this hold is an example.
WIDE = 2
#: Different characters that an added candidate needs, to look random.
VARIETY = 8
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A match ends at its run's end, so a match that begins inside a run would have begun with it.
PATTERNS = [
    ASSIGN,
    r"AKIA[A-Z0-9]{16,}",
    r"[0-9a-f]{24,}",
    r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk[-_][A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})",
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}",
    r"://[^\s/:@]{1,80}:[^\s/@]{6,}(?=@)",
    r"(?i:bearer|authorization:)\x20{1,3}[A-Za-z0-9._~+/-]{20,}",
]


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """docs with `found`: all candidate spans of the base kinds and the added ones."""
    clean = spans.plain(F.col(text))

    def all_kinds(t):
        each = []
        for kind, pattern in enumerate(PATTERNS):
            found = spans.find(t, pattern, kind)
            if kind == 0:
                found = F.filter(found, lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6)
            elif kind >= BASE:
                found = F.filter(found, lambda s: F.size(F.array_distinct(F.split(s["value"], ""))) >= VARIETY)
            each.append(found)
        return F.concat(*each)

    return docs.withColumn("found", spans.bound(clean, all_kinds))


def value_name(span):
    """The name of a candidate's value; an assignment's is what is assigned."""
    value = F.when(span["kind"] == 0, F.regexp_extract(span["value"], ASSIGN, 1)).otherwise(span["value"])
    return F.sha2(value, 256)


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """name, repositories, owners: in how many distinct ones each candidate value is found."""
    seen = found.select(F.explode(F.array_distinct(F.transform("found", value_name))).alias("name"), F.col(repository).alias("r"), F.col(owner).alias("o"))
    seen = seen.select("name", F.coalesce(F.col("r").cast("string"), F.lit("")).alias("r"), F.coalesce(F.col("o").cast("string"), F.lit("")).alias("o")).distinct()
    by_owner = seen.groupBy("name", "o").agg(F.count("*").alias("n"))
    wide = by_owner.groupBy("name").agg(F.count("*").alias("owners"))
    repositories = seen.select("name", "r").distinct().groupBy("name").agg(F.count("*").alias("repositories"))
    return wide.join(repositories, "name")


def scan(docs: DataFrame, key: str, text: str, repository: str, owner: str) -> DataFrame:
    """Per row: key, base (spans), all (base and live added spans), n_live (base spans that look live)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(repository).alias("repository"), F.col(owner).alias("owner"))
    found = candidates(rows, "text").drop("text")
    # Rows are numbered so that equal ids stay apart.
    found = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))
    some = found.filter(F.size("found") > 0)
    owned = ownership(some, "repository", "owner")
    each = some.select("row", F.explode("found").alias("span")).withColumn("name", value_name(F.col("span")))
    judged = each.join(owned, "name").select("row", "span", ((F.col("owners") <= WIDE) & (F.col("repositories") <= WIDE)).alias("live"))
    order = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    kept = judged.filter((F.col("span.kind") < BASE) | F.col("live")).withColumn("span", order(F.col("span")))
    per_row = kept.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("all"), F.count_if((F.col("span.kind") < BASE) & F.col("live")).alias("n_live"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    out = found.select("row", "key").join(per_row, "row", "left")
    out = out.select(F.col("key").alias(key), F.coalesce("all", none).alias("all"), F.coalesce("n_live", F.lit(0)).alias("n_live"))
    return out.withColumn("base", F.filter("all", lambda s: s["kind"] < BASE))
