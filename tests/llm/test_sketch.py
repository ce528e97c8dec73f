import pytest
from pyspark.sql import functions as F

from tenderloom.llm import sketch
from tests.llm.checks import matches_sql, on_tables, sha


def test_query_matches_sql(spark):
    matches_sql(spark, "op8_sketch")


@pytest.mark.parametrize("parts", ["1", "5", "40"])
def test_next_document(spark, tmp_path, parts):
    texts = {i * 7 - 30: f"w{i} " * (i % 9) + "tail é" * (i % 4) for i in range(60)}
    df = spark.createDataFrame([(k, t, 3) for k, t in texts.items()], "doc_id long, text string, sketch int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got, want = on_tables(spark, tmp_path, "op8_sketch", documents=df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want
    keys = sorted(texts, reverse=True)
    by_id = {r[got[0].index("doc_id")]: r for r in got[1]}
    for k, following in zip(keys, [*keys[1:], keys[0]]):
        n = len(texts[k]) // 3
        changed = texts[k][: len(texts[k]) - n] + texts[following][:n]
        assert by_id[k][got[0].index("edited_sha256")] == sha(changed)


def test_nulls_repeats_single_and_empty(spark, tmp_path):
    schema = "doc_id long, text string, part int, ghost int"
    one = spark.createDataFrame([(5, "a b c", 1, 1)], schema)
    got, want = on_tables(spark, tmp_path / "one", "op8_sketch", documents=one)
    assert got == want and len(got[1]) == 1
    none = spark.createDataFrame([], schema)
    assert on_tables(spark, tmp_path / "none", "op8_sketch", documents=none)[0][1] == []
    rows = [(3, None, 0, 0), (3, None, 0, 0), (2, "x " * 9, 0, 0), (2, "x " * 9, 0, 0), (None, "n o p", 0, 0), (9, "", 0, 0)]
    made = sketch.edited_likeness(spark.createDataFrame(rows, schema), "doc_id", "text", 4).collect()
    assert sorted((r.doc_id or 0, r.text, r.edited) for r in made) == [
        (0, "n o p", "n o "), (2, "x " * 9, "x " * 6 + "n o p"), (2, "x " * 9, "x " * 9), (3, "", ""), (3, "", ""), (9, "", ""),
    ]


def test_merge_and_containment(spark):
    long_text = " ".join(f"word{i % 311}x{i}" for i in range(4000))
    part = " ".join(long_text.split()[1000:2000])
    df = spark.createDataFrame([(long_text, part)], "a string, b string")
    a, b, both = sketch.sketch(F.col("a")), sketch.sketch(F.col("b")), sketch.sketch(F.concat_ws(" ", "a", "b"))
    r = df.select(
        sketch.containment(b, a).alias("inside"), sketch.containment(a, b).alias("around"),
        F.size(F.array_except(sketch.merge(a, b), both)).alias("extra"), F.size(a).alias("n"),
    ).first()
    assert r.inside == 1.0 and 0.15 < r.around < 0.35 and r.extra == 0 and 400 < r.n < 600


def test_short_text_keeps_its_smallest_hash(spark):
    df = spark.createDataFrame([("a b",), ("a  b",), ("c",), ("",), (None,)], "t string")
    got = [r.s for r in df.select(sketch.sketch(F.col("t")).alias("s")).collect()]
    assert len(got[0]) == 1 and got[0] == got[1] != got[2] and got[3] == [] and got[4] == []
