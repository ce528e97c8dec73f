"""A corpus pipeline: toxicity, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last keep the columns of documents; n_chars
follows the text. A stage begins by removing the temporary tables of the stage before, whose
result is written by then.

Columns beside doc_id, text and n_chars pass through unchanged, whatever their names: a stage holds
the row in one column beside its own. Null and empty texts pass all stages but packing, where they
are one piece with the end id. Rows without an id, and rows that share one, are judged by their own
texts. Of equal or near texts the smallest id stays, of rows with the same id the first text in
order; rows that are equal in id and text are one document. Ties and repeats are thus decided by
values alone. An empty table stays empty, and long texts are read whole.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderloom.llm import ngram_join, packing, pii, substring_dedup, toxicity
from tenderloom.llm.common import broadcast_if_few
from tenderloom.llm.queries import UNIT, WINDOW, token_pieces
from tenderloom.session import cut_lineage, recorded_tables, remove_tables

#: Near duplicates: five words a shingle, a likeness of 0.8 or more.
SHINGLE, PERCENT = 5, 80


_left: list[str] = []


def held(docs: DataFrame) -> DataFrame:
    """The whole row in one column, doc, beside its id and text, so that no name of a column matters."""
    return docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text")


def stage(f):
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_tables(spark, _left)
        _left.clear()
        with recorded_tables() as paths:
            made = f(spark, docs, sf_dir)
        _left.extend(paths)
        return made

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity model doesn't call them toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # The text is read out of the row, not held beside it a second time.
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    return toxicity.severities(rows, model, "doc.text").filter(~F.col("toxic")).select("doc.*")


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    groups = ngram_join.join(docs, SHINGLE, PERCENT, counted=False)
    # Of a component the first row by id and text stays; rows without an id come last.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    firsts = groups.filter("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("stays"))
    gone = groups.join(firsts, "component").filter(order != F.col("stays")).select(F.col("doc_id").alias("id"), "digest").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.unhex(F.md5(F.coalesce("text", F.lit("")))) == F.col("digest"))
    kept = held(docs).join(broadcast_if_few(cut_lineage(gone)), same, "left_anti")
    # Rows with the same id and text are one document.
    once = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return (kept if once else kept.dropDuplicates(["doc_id", "text"])).select("doc.*")


@stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that are found elsewhere; a document that loses all its words goes."""
    found, parts = substring_dedup.repeats(docs, "doc_id", "text")
    texts = found.filter("n_removed > 0").select("doc_id", "name", F.col("n_words") - F.col("n_removed")).distinct()
    changed = cut_lineage(texts.toDF("id", "name", "left").join(parts, "name", "left"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.unhex(F.md5(F.coalesce("text", F.lit("")))) == F.col("name"))
    kept = held(docs).join(changed, same, "left").filter("left IS NULL OR left > 0")
    return with_text(kept, docs.columns, F.when(F.col("left").isNull(), F.col("text")).otherwise(F.col("kept")))


@stage
def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    # Written once: the fit and the result read it.
    found = cut_lineage(pii.candidates(held(docs), "text"))
    model = pii.fit(found)
    return with_text(found, docs.columns, pii.redact(F.col("text"), pii.selected(model)))


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    keys = ["doc_id", "start", "length", "ids_crc32"]
    return packing.pack(pieces, keys, "length", WINDOW, UNIT).select(*keys, "doc_tokens", "sequence_id", "offset")


def with_text(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of doc with another text, and n_chars as it has."""
    new = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long")}
    return rows.withColumn("new", text).select(*(new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in columns))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each),
    ("substring_dedup", without_repeats),
    ("pii", redacted),
    ("packing", packed),
]

#: Fitted models and the word-piece vocabulary have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in STAGES:
        docs = cut_lineage(f(spark, docs, sf_dir))
    return docs


JOBS = {"pipeline": run}
CHECKS: dict[str, str] = {}
