import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import quality

FOLDER = "/root/testdata/sf0.01"


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered)


TEXTS = ["", " \n\t", "a b", "x " * 30, "a b c d e f g h\n" * 2, "a b c d e f g h i a b c d e f g h", "é# ü\n\n \n é# ü\né# ü", "l\rl\nl\rl\n\x85\n\x85", "w " * 20000]


def test_base_counts():
    rng = np.random.default_rng(4)
    texts = TEXTS + ["".join(rng.choice(list("ab \n#"), 300)) for _ in range(60)] + ["".join(rng.choice(["aa ", "b ", "\n"], 200)) for _ in range(30)]
    got = quality.base_counts(texts)
    for i, t in enumerate(texts):
        assert tuple(int(got[n][i]) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(t)


def brute_model(texts):
    """Interpolated modified Kneser-Ney over characters, written out."""
    n = quality.ORDER
    tables = [Counter() for _ in range(n + 1)]
    for t in texts:
        t = quality.normal(t)
        tables[n].update(t[i : i + n] for i in range(len(t) - n + 1))
    for k in range(n - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    cuts = [None, *(quality._discounts(Counter(tables[k].values())) for k in range(1, n + 1))]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(tables[1]) + 1)
        context = [c for h, c in tables[k].items() if h[:-1] == g[:-1]]
        if not context:
            return p(g[1:])
        d = lambda c: cuts[k][min(c, 3) - 1] if c else 0
        own = tables[k].get(g, 0)
        return (own - d(own)) / sum(context) + sum(map(d, context)) / sum(context) * p(g[1:])

    return p


def test_model_against_brute_force(spark):
    texts = ["the cat sat on the mat and the dog sat on the log by the big old frog in a bog of fog and so on we go " + f"again {i % 3}" for i in range(7)]
    texts += ["another thing entirely with a good many other words in it so that it is long enough to be counted here twice " * 2]
    df = spark.createDataFrame([(0, t) for t in texts], "language int, text string")
    model = quality.fit(df)
    p = brute_model(texts)
    for t in ["the cat sat", "fog frog dog bzz", "zq!"]:
        codes, ends = quality.codes_of([quality.normal(t)])
        starts = quality.starts_of(ends, len(codes))
        got = model.log_p(codes, starts, 0)
        want = [math.log(p(quality.normal(t)[s : s + quality.ORDER])) for s in starts]
        assert np.allclose(got, want, atol=1e-3), list(zip(got, want))


def test_counting_splits_large_alphabets():
    text = "".join(chr(0x4E00 + i) for i in range(6000)) * 2
    codes, ends = quality.codes_of([text])
    got = Counter()
    for rows, n in quality.count_grams(codes, quality.starts_of(ends, len(codes))):
        for g, k in zip(quality.strings(rows), n):
            got[str(g)] += int(k)
    assert got == Counter(text[i : i + 5] for i in range(len(text) - 4))


@pytest.fixture(scope="module")
def assessed(spark):
    from tenderloom.llm.queries import op5_quality

    return op5_quality(spark, FOLDER).cache()


def test_query_counts(spark, assessed):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = assessed.collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_good_documents_stay_and_junk_goes(spark, assessed):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    r = {x.quality: x.kept for x in assessed.filter(~F.col("base_failed")).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert r[1] > 0.98 and r[0] < 0.2


def test_nulls_repeats_and_clashing_names(spark):
    good = "some plain words that are long enough to be a text of twenty words or more as the base rules ask for it now"
    rows = [(1, None, None, 1), (2, "", "en", 1), (3, good, None, 1), (3, good, None, 1), (None, good, "en", 1), (4, "a " * 90000, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language int").withColumn("log_p", F.lit("x"))
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id or 0, r.n_words, r.kept) for r in quality.assess(df, labels).collect())
    assert [g[:2] for g in got] == [(0, 24), (1, 0), (2, 0), (3, 24), (3, 24), (4, 90000)]
    assert not any(k for d, _, k in got if d in (1, 2, 4))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.assess(df, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
