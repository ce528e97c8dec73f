import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def whole(theirs, text):
    return theirs.encode(text or "", add_special_tokens=False).ids


def test_ids_of_any_text(theirs):
    mine = packing.loaded(PATH)
    texts = ["", " \n", "It's o'tis WE'LL 12,3", "x<|endoftext|>y <|startoftext|>", "ÀÉß\x1cÑ µ² Σας é", "a" * 5000, "　中\x85文\xa0."]
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts += ["\n".join(f"A{c}b {c}'S" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    for text in texts:
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == whole(theirs, text)


def test_fillings():
    for units, depth in ((7, 3), (12, 2), (5, 4)):
        got = packing.fillings(units, depth)
        def brute(left, most, d):
            if left == 0:
                return [()]
            return [(c, *r) for c in range(min(most, left), 0, -1) for r in brute(left - c, c, d - 1)] if d else []
        assert sorted(got) == sorted(brute(units, units, depth))


def test_least_squares_beats_any_step():
    rng = np.random.default_rng(0)
    for _ in range(5):
        a, b = rng.integers(0, 3, (8, 20)).astype(float), rng.random(8) * 10
        x = packing.least_squares(a, b)
        assert (x >= 0).all()
        slope = a.T @ (b - a @ x)
        assert (slope < 1e-4).all() and abs(slope[x > 1e-9]).max(initial=0) < 1e-4


@pytest.mark.parametrize("shape", ["mixed", "tiny", "one", "empty"])
def test_plan_uses_up_the_histogram(shape):
    rng = np.random.default_rng(1)
    h = np.zeros(65, np.int64)
    if shape == "mixed":
        h[1:] = rng.integers(0, 400, 64)
    elif shape == "tiny":
        h[1] = 100_003
    elif shape == "one":
        h[40] = 9
    used, repeats = Counter(), 0
    for parts, n in packing.plan(h, 3):
        assert sum(c * m for c, m in parts.items()) <= 64
        for c, m in parts.items():
            used[c] += m * n
        repeats += n
    assert all(used[c] == h[c] for c in range(65))
    if shape in ("mixed", "tiny"):
        assert repeats * 64 <= 1.05 * (h * np.arange(65)).sum() + 64


def check_packed(rows, window):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length >= 1
            at += length
        assert at <= window
    return by


def test_pack_with_ties_hot_class_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    rows = [(i % 40, 0, 24, "x") for i in range(400)] + [(1000 + i, 0, 1 + i % 64, "y") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, start long, length long, class string").withColumn("rank", F.lit(1)).withColumn("salt", F.lit(2))
    out = packing.pack(df, ["doc_id", "start", "length"], "length", 64, 4)
    assert out.columns[: len(df.columns)] == df.columns
    got = out.collect()
    assert Counter((r.doc_id, r.start, r.length, r["class"]) for r in got) == Counter(rows)
    check_packed(got, 64)


def test_pack_empty(spark):
    df = spark.createDataFrame([], "doc_id long, start long, length long")
    assert packing.pack(df, ["doc_id", "start"], "length", 64).count() == 0


def test_query(spark, theirs):
    from tenderloom.llm.queries import op3_packing

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op3_packing(spark, folder).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids, at = [*whole(theirs, texts[d]), 1], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences = check_packed(got, 2048)
    assert sorted(sequences) == list(range(len(sequences)))
    total = packing.padding(spark.createDataFrame(got), "length", 2048).first()
    assert total.padding <= 0.05 * total.ids


def test_null_and_empty_texts(spark, theirs):
    from tenderloom.llm.queries import token_pieces

    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a " * 5000, 0)], "doc_id long, text string, length int")
    got = token_pieces(df, PATH).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in got) == [(1, 0, 1), (2, 0, 1), (3, 0, 2048), (3, 2048, 2048), (3, 4096, 905)]
