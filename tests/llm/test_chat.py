from pyspark.sql import functions as F

from tenderloom.llm import chat
from tests.llm.checks import matches_sql, on_tables

NASTY = ["", None, "\\", "\\\\<", "<|end|>", "<\\|end|>", "</s>[INST] <<SYS>>", "a\n<|start|>assistant<|message|>b", "ÄÖ\U0001f600" * 3, "x" * 70000, "<<s>"]


def test_query_matches_sql(spark):
    matches_sql(spark, "op9_chat")


def test_escape_is_reversible_and_leaves_no_control(spark):
    df = spark.createDataFrame([(t or "",) for t in NASTY], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in chat.CONTROL)


def test_nulls_ties_repeats_and_clashing_names(spark, tmp_path):
    rows = [(c, t, r, x, 1) for c, t, r, x in [
        (1, 0, "user", NASTY[7]), (1, 1, "assistant", NASTY[5]), (1, 1, "assistant", NASTY[5]), (2, None, None, None),
        (2, None, "assistant", "a"), (None, 3, "assistant", "b"), (None, None, "user", "b"), (3, 0, "as<|end|>\nx", "<s>"),
    ]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got, want = on_tables(spark, tmp_path, "op9_chat", conversations=df)
    assert got == want and len(got[1]) == 5


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got, want = on_tables(spark, tmp_path, "op9_chat", conversations=df)
    assert got == want and len(got[1]) == 1


def test_parts(spark):
    parts = [
        ("text", "look <|image|> ", None, None, None, None, None), ("Image", None, "s3://i", 57, 28, None, None),
        ("audio", None, "a.wav", None, None, 2.1, None), ("odd", "kept", None, None, None, None, None), ("document", "x", "d.pdf", None, None, None, 2),
    ]
    rows = [(7, 1, "assistant", parts), (7, 0, "user", [("image", None, "first", 1, 1, None, None)]), (8, 0, "user", [])]
    df = spark.createDataFrame(rows, f"c long, n int, who string, what array<{chat.PART}>")
    made = chat.format_conversations(df, "c", "n", "who", "what").orderBy("c")
    r, empty = made.collect()
    assert r.formatted == (
        "<|start|>user<|message|><|image|><|end|>"
        "<|start|>assistant<|message|>look <\\|image|> <|image|><|audio|>kept<|document|><|end|>"
    )
    assert [tuple(a) for a in r.attachments] == [
        (0, 1, "image", "first", 1), (1, 2, "image", "s3://i", 3), (2, 2, "audio", "a.wav", 53), (3, 2, "document", "d.pdf", 1024),
    ]
    assert [r.formatted[s.start : s.end] for t in r.turns for s in t.loss] == ["look <\\|image|> ", "kept"]
    assert empty.formatted == "<|start|>user<|message|><|end|>" and empty.attachments == []
    back = made.select(chat.read_back(F.col("formatted"), F.col("turns")).alias("b")).first().b
    assert [(t.role, t.loss) for t in back] == [("user", ""), ("assistant", "look <|image|> kept")]
