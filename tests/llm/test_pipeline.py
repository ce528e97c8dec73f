import re

import pytest

import corpus_pipeline
from tests.llm import test_pii, test_substring_dedup
from tests.llm.test_packing import check_packed

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """docs before and after each stage."""
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(corpus_pipeline.cut_lineage(stage(spark, docs[-1], FOLDER)))
    return docs


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert before.columns == after.columns and dict(before.dtypes) == dict(after.dtypes)


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, after = rows(stages[0]), rows(stages[1])
    assert all(before[d] == r for d, r in after.items())
    clean, toxic = ([d in after for d in before if labels.get(d) == k] for k in (0, 1))
    assert sum(clean) > 0.97 * len(clean) and sum(toxic) < 0.4 * len(toxic)  # 51 labels; some roots occur in two documents


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])

    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = {d: shingles(r.text) for d, r in before.items()}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    assert set(after) == {d for d in ids if root(d) == d}
    assert all(before[d] == r for d, r in after.items())


def test_repeats_go(stages):
    before, after = rows(stages[2]), rows(stages[3])
    ids = sorted(before)
    want = dict(zip(ids, test_substring_dedup.brute([before[d].text for d in ids])))
    assert set(after) == {d for d in ids if want[d][1] < want[d][0] or not want[d][1]}
    for d, r in after.items():
        assert r.text == before[d].text if not want[d][1] else test_substring_dedup.sha(r.text) == want[d][2]
        assert r.n_chars == len(r.text)


def test_personal_data_goes(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    names = "|".join(k.upper() for k in corpus_pipeline.pii.KINDS)
    for d, r in after.items():
        base = test_pii.brute_base(before[d].text)
        assert (r.text == before[d].text) or re.search(rf"\[({names})\]", r.text)
        assert not base or r.text != before[d].text
        assert not test_pii.brute_base(r.text)


def test_packing_covers_all(stages):
    docs, pieces = rows(stages[4]), stages[5].collect()
    check_packed(pieces, 2048)
    for d in docs:
        own = sorted((p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == d)
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][0] + own[-1][1] == own[-1][2]


#: Names of columns that stages use beside a document's own.
CLASHING = ["doc", "id", "name", "left", "kept", "new", "base", "loose", "found", "toxic", "score", "grade", "p_toxic", "severity", "set", "digest", "stays", "component", "node", "row", "key"]


def clashing(spark, rows):
    """Documents (id, text) with an extra column of each name, of several types."""
    made = [(i, t, "en", "s", len(t or ""), *[f"{n}-{i}-{t}"[:40] if k % 2 else k + (i or 0) for k, n in enumerate(CLASHING)]) for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} {'string' if k % 2 else 'long'}" for k, n in enumerate(CLASHING)))


def extras(df, by):
    return sorted((tuple(str(r[c]) for c in (by, *CLASHING)) for r in df.collect()))


LONG = " ".join(f"w{i % 7000}" for i in range(9000))
ODD = [(0, None), (1, ""), (2, "a b c"), (3, "a b c"), (4, LONG), (5, LONG + " more"), (6, "mail me@x.yz now"), (7, " ".join(["rep"] * 80)), (2, "a b c"), (None, None), (None, "z")]


def test_each_stage_keeps_extra_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing(spark, ODD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = corpus_pipeline.cut_lineage(stage(spark, docs, str(tmp_path)))
        assert made.columns == docs.columns and made.dtypes == docs.dtypes
        assert set(extras(made, "doc_id")) <= set(extras(docs, "doc_id"))
        docs = made
    assert {r.doc_id for r in docs.collect()} == {0, 1, 2, 4, 6, None} and docs.count() == 7


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, tmp_path):
    near = " ".join(f"x{i}" for i in range(60))
    rows = [(1, near), (2, near + " y"), (2, "something of its own that no other document has"), (None, near + " z"), (None, "also of its own, without an id")]
    made = corpus_pipeline.one_of_each(spark, clashing(spark, rows), str(tmp_path))
    assert sorted(r.text for r in made.collect()) == sorted([near, rows[2][1], rows[4][1]])


def test_nulls_repeats_extra_columns_and_empty(spark, tmp_path):
    df = clashing(spark, ODD)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == {0, 1, 2, 4, 6, None}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
