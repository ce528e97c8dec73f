"""n_links counts every link of a set, also those that its component doesn't need."""

from itertools import combinations

import numpy as np
import pytest

from tenderloom.llm import ngram_join
from tests.llm.checks import matches_sql
from tests.llm.test_ngram_join import edited_family


def test_query_matches_sql(spark):
    matches_sql(spark, "op4_ngram_links")


def brute(rows):
    sets = {k: frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) for k, w in ((k, t.split()) for k, t in rows.items())}
    links = dict.fromkeys(set(sets.values()), 0)
    for x, y in combinations(links, 2):
        if 100 * len(x & y) >= 90 * len(x | y):
            links[x] += 1
            links[y] += 1
    return {k: links[s] for k, s in sets.items()}


@pytest.mark.parametrize("part", [None, 7])
def test_links_inside_components(spark, monkeypatch, part):
    if part:
        monkeypatch.setattr(ngram_join, "PART_SETS", part)
        monkeypatch.setattr(ngram_join, "COLUMNS", 50)
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(200)])
    texts = []
    for size in (5, 20, 60, 150):
        texts += edited_family(rng, size, 25, max(1, size // 25), vocabulary)
    chain = list(rng.choice(vocabulary, 200))
    for i in range(30):  # neighbours link, ends don't
        chain[5 * i] = f"step{i}"
        texts.append(" ".join(chain))
    texts += texts[:5]
    rows = dict(enumerate(texts))
    got = {r.doc_id: r.n_links for r in ngram_join.join(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and max(want.values()) > 10
