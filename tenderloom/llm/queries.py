"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderloom.llm import bpe, chat, maxscore, ngram_join, packing, pii, quality, rtree, secrets, sketch, spans, substring_dedup, toxicity, trie
from tenderloom.llm.common import table, text_or_empty
from tenderloom.session import parallelism

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def job(f: Callable[[SparkSession, str], DataFrame]):
    JOBS[f.__name__] = f
    return f


@job
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, folder, "documents").select("doc_id", text_or_empty("text").alias("text"))
    ids = docs.select("doc_id", bpe.encode(F.col("text"), path).alias("ids"))
    back = ids.select("doc_id", "ids", bpe.decode(F.col("ids"), path).alias("decoded"))
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Window, rounding unit and end id of the packing query.
WINDOW, UNIT, END_ID = 2048, 8, 1


def token_pieces(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece of each document: doc_id, start, length, ids_crc32, doc_tokens."""
    ids = docs.select("doc_id", packing.tokenize(text_or_empty("text"), path, END_ID).alias("ids"))
    cut = ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("doc_tokens"), packing.cut(F.col("ids"), WINDOW).alias("piece"))
    # Every document has a piece; the outer form only spares a filter that would cut twice.
    return cut.select("doc_id", "doc_tokens", F.explode_outer("piece").alias("piece")).select("doc_id", "piece.*", "doc_tokens")


@job
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = token_pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    packed = packing.pack(pieces, ["doc_id", "start", "length", "ids_crc32"], "length", WINDOW, UNIT)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@job
def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
        F.lit(planted).alias("text"),
    )
    parted = turns.unionByName(extra).withColumn("parts", chat.text_parts(text_or_empty("text")))
    made = chat.format_conversations(parted, "conv_id", "turn", "role", "parts")
    read = made.withColumn("read", chat.read_back(F.col("formatted"), F.col("turns")))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    read = read.withColumn("loss", F.array_join(F.transform("read", lambda t: t["loss"]), ""))
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", line), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for c in chat.CONTROL:
        sql = f"replace({sql}, '{c}', '{c[0]}\\{c[1:]}')"
    return sql


CHECKS["op9_chat"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{chat.LOSS_ROLE}'), '') AS loss,
    sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {len(chat.START + chat.MESSAGE + chat.END)})::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars
FROM whole
"""


@job
def op8_sketch(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = sketch.edited_likeness(docs, "doc_id", "text", max(parallelism(spark), 1))
    return made.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch.fingerprint(F.col("sketch")).alias("fingerprint"),
        sketch.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketch.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketch.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


CHECKS["op8_sketch"] = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text,
    coalesce(lead(text) OVER ordered, CASE WHEN lead(doc_id) OVER ordered IS NULL THEN first(text) OVER ordered END, '') AS next_text
  FROM documents WINDOW ordered AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), edits AS (
  SELECT doc_id, text, next_text,
    left(text, length(text) - length(text) // 3) || left(next_text, length(text) // 3) AS edited
  FROM texts
), versions AS (
  SELECT doc_id, 'own' AS version, text FROM edits UNION ALL
  SELECT doc_id, 'edited', edited FROM edits UNION ALL
  SELECT doc_id, 'next', next_text FROM edits
), words AS (
  SELECT doc_id, version, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM versions
), hashed AS (
  SELECT doc_id, version, list_distinct(list_transform(
    CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - {sketch.SHINGLE} + 1, 1) + 1) END,
    lambda i: left(md5(array_to_string(w[i:i + {sketch.SHINGLE - 1}], ' ')), 16))) AS h
  FROM words
), kept AS (
  SELECT doc_id, version, list_sort(CASE WHEN len(list_filter(h, lambda x: x < '{sketch.BOUND}')) > 0
    THEN list_filter(h, lambda x: x < '{sketch.BOUND}') ELSE list_sort(h)[1:1] END) AS s
  FROM hashed
), wide AS (
  SELECT e.doc_id, e.text, e.edited, a.s AS own, b.s AS other, c.s AS following
  FROM edits e JOIN kept a ON a.doc_id = e.doc_id AND a.version = 'own'
  JOIN kept b ON b.doc_id = e.doc_id AND b.version = 'edited'
  JOIN kept c ON c.doc_id = e.doc_id AND c.version = 'next'
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  coalesce(array_to_string(own, ''), '') AS fingerprint, coalesce(array_to_string(other, ''), '') AS edited_fingerprint,
  CASE WHEN len(own) + len(other) = 0 THEN 1.0::DOUBLE
    ELSE len(list_intersect(own, other))::DOUBLE / len(list_distinct(own || other)) END AS near_edited,
  CASE WHEN len(own) + len(following) = 0 THEN 1.0::DOUBLE
    ELSE len(list_intersect(own, following))::DOUBLE / len(list_distinct(own || following)) END AS near_next
FROM wide
"""


@job
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.severities(docs.select("doc_id", "text"), model).select("doc_id", "expected_severity", "grade", "p_toxic", "toxic")


@job
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    made = quality.assess(table(spark, folder, "documents"), table(spark, folder, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return made.select("doc_id", *counts, "base_failed", "kept", "perplexity")


@job
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"), counted=False).select("doc_id", "n_shingles", "component_id")


CHECKS["op4_ngram_join"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(list_transform(
    CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 2, 1) + 1) END,
    lambda i: array_to_string(w[i:i + 2], ' '))) AS s
  FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM pairs WHERE 100 * common >= 90 * (n + m - common)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


@job
def op4_ngram_links(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents")).select("doc_id", "n_links")


CHECKS["op4_ngram_links"] = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(
    CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 2, 1) + 1) END,
    lambda i: array_to_string(w[i:i + 2], ' ')))) AS s
  FROM words
), named AS (SELECT s, min(doc_id) AS id FROM sets GROUP BY s),
shingles AS (SELECT id, len(s) AS n, unnest(s) AS shingle FROM named),
pairs AS (
  SELECT a.id AS a, b.id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.id <> b.id
  GROUP BY a.id, b.id
), links AS (SELECT a, count(*) AS n_links FROM pairs WHERE 100 * common >= 90 * (n + m - common) GROUP BY a)
SELECT doc_id, coalesce(n_links, 0)::BIGINT AS n_links FROM sets JOIN named USING (s) LEFT JOIN links ON a = id
"""


@job
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = substring_dedup.repeats(table(spark, folder, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


CHECKS["op10_substring_dedup"] = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i + 34], ' '))) AS t
  FROM words WHERE len(w) >= 35
), again AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN again ON windows.t = again.t),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM words),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS t, count(*) AS n
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id
)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""


@job
def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    # The table names no repositories, so each document is one.
    made = secrets.scan(docs, "doc_id", "text", "doc_id", "source")
    base = F.col("base")
    return made.select(
        "doc_id",
        spans.count(base, 0).alias("n_assign"),
        spans.count(base, 1).alias("n_access"),
        spans.count(base, 2).alias("n_hex"),
        F.sha2(spans.listing(base, secrets.KINDS), 256).alias("base_sha256"),
        spans.listing(F.col("all"), secrets.KINDS).alias("spans"),
        "n_live",
    )


@job
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    made = pii.detect(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")
    base = F.col("base")
    return made.select(
        "doc_id",
        *(spans.count(base, k).alias(f"n_{pii.KINDS[k]}") for k in range(pii.BASE)),
        F.sha2(spans.listing(base, pii.KINDS), 256).alias("base_sha256"),
        spans.listing(F.col("all"), pii.KINDS).alias("spans"),
    )


#: Rows of embeddings that ask, as its queries say.
ASKING = "vec_id % 50 = 0"


@job
def op11_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    return maxscore.top(table(spark, folder, "embeddings"), "vec_id", "embedding", F.expr(ASKING), 5)


#: Usable rows of embeddings as integers, and the inner product of a.x and b.x.
VECTORS_SQL = """v AS (
  SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""
PRODUCT_SQL = "coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::BIGINT"

CHECKS["op11_maxscore"] = f"""
WITH {VECTORS_SQL}, scored AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, {PRODUCT_SQL} AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@job
def op13_rtree(spark: SparkSession, folder: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(table(spark, folder, "embeddings"), "vec_id", "embedding", noisy, F.expr(ASKING))


CHECKS["op13_rtree"] = f"""
WITH {VECTORS_SQL}, noisy AS (
  SELECT vec_id, r, x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL
), scored AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, {PRODUCT_SQL} AS score
  FROM noisy a JOIN noisy b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT r, anchor_id, other, vec_id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
  row_number() OVER (PARTITION BY p.r, p.other ORDER BY n.score DESC, n.vec_id NULLS LAST, n.other)::INTEGER AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.r = p.r AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


@job
def op12_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.trie(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")


CHECKS["op12_trie"] = """
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS donor,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, y: CASE WHEN y >= 0 THEN xor(crc, y) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered)
), turns AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.donor AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.pos > c.h
), rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, md5(strlen(role) || ':' || role || text) AS turn,
    len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words
  FROM turns
), paths AS (
  SELECT conv_id, depth, words, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
  FROM paths JOIN lengths USING (conv_id) GROUP BY path, depth
), linked AS (
  SELECT n.*, p.path AS parent_path, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN nodes p ON n.depth = p.depth + 1 AND left(n.path, 32 * p.depth) = p.path AND n.depth > 0
), children AS (SELECT parent_path AS path, count(*) AS n_children FROM linked WHERE parent_path IS NOT NULL GROUP BY 1),
subtree AS (
  SELECT a.path, sum(CASE WHEN c.path IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM nodes n JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN children c ON c.path = n.path GROUP BY a.path
)
SELECT l.conv_id, l.depth::BIGINT AS depth, l.parent_conv_id, l.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, l.ends_sha256
FROM linked l LEFT JOIN children c ON c.path = l.path JOIN subtree s ON s.path = l.path
"""
