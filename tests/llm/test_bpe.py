import hashlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n  x", "don't they'll 's", "a<|endoftext|> b<|endoftext|>", "É\x85\x1c ß 中文字 \U0001f600́",
    " " * 3000 + "z", "ab" * 5000, "abcabc1234  \t\r\n?!", "a", "a",
]


@pytest.fixture(scope="module")
def both():
    return bpe.loaded(PATH), Tokenizer.from_file(PATH)


def same(both, text):
    mine, theirs = both
    want = theirs.encode(text, add_special_tokens=False).ids
    got = mine.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert mine.decode(got) == theirs.decode(want, skip_special_tokens=False)


def test_texts(both):
    for text in TEXTS:
        same(both, text or "")


def test_every_code_point(both):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 997):
        same(both, "\n".join(f"a{c}1{c} {c}" for c in points[k : k + 97]))


def test_random_letters(both):
    rng = np.random.default_rng(3)
    letters = np.array(list("aabtheingsdlo '\né一_0"))
    for _ in range(800):
        same(both, "".join(rng.choice(letters, rng.integers(1, 70))))


def test_every_token_alone_is_made_by_the_merges(both):
    mine, theirs = both
    for name in mine.token[256::37]:
        text = name.decode("utf-8", "ignore")
        if text.encode() == name:
            same(both, text)


def test_full_memory_changes_nothing(monkeypatch):
    small = bpe.ByteBpe(PATH)
    small.pieces.most = small._compatible.most = 2
    for text in TEXTS:
        assert small.encode(text or "") == bpe.loaded(PATH).encode(text or "")


def test_broken_bytes_and_unknown_ids(both):
    mine, theirs = both
    half = np.array([mine.id_of[0xC3]], "<u4").tobytes()
    assert mine.decode(half) == "�"
    assert mine.decode(np.array([10**6, mine.id_of[ord("a")]], "<u4").tobytes()) == "a"


def test_columns(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = df.select("doc_id", bpe.encode(F.col("text"), PATH).alias("ids"))
    out = out.select("doc_id", "ids", bpe.decode(F.col("ids"), PATH).alias("back"))
    theirs = Tokenizer.from_file(PATH)
    for r in out.collect():
        text = TEXTS[r.doc_id] or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
        assert r.back == text
    assert df.limit(0).select(bpe.encode(F.col("text"), PATH).alias("x")).count() == 0


def test_query(spark):
    from tenderloom.llm.queries import op1_bpe

    folder = "/root/testdata/sf0.001"
    theirs = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op1_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
