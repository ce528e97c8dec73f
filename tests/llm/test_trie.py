"""The prefix trie against a written-out one."""

import random
import zlib

import pytest

from tenderloom.llm import trie
from tests.llm.checks import matches_sql, on_tables, sha

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n int, head string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = turns.get(donor, [])[:h] + ts[h:]
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    words = lambda path: len([w for w in path[-1][1].replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]) if path else 0
    totals = {}
    for path in sorted(members, key=len, reverse=True):
        below = [totals[c] for c in children.get(path, [])]
        totals[path] = (sum(b[0] for b in below) or 1, (len(members[path]) - 1) * words(path) + sum(b[1] for b in below))
    out = []
    for path, convs in members.items():
        ends = sorted(c for c in convs if len(whole[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children.get(path, [])), *totals[path], sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    made = trie.trie(df, "conv_id", "turn", "role", "text")
    assert made.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, made.collect()), key=repr)


def random_rows(seed, convs, hot=0.5):
    rng = random.Random(seed)
    common = [("user", rng.choice("abc") + " b") for _ in range(6)]
    rows = []
    for c in rng.sample(range(-30, 300), convs):
        n = rng.randrange(1, 8)
        start = rng.randrange(0, 7) if rng.random() < hot else 0
        for t, (role, text) in enumerate((common[:start] + [(rng.choice(["user", "assistant"]), rng.choice(["", "a", "a  b\n", "c d e"])) for _ in range(8)])[:n]):
            rows.append((c, t, role, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit,segment", [(4096, 4096), (10, 4096), (10, 3), (4096, 1), (1, 2)])
def test_any_limits(spark, monkeypatch, limit, segment):
    monkeypatch.setattr(trie, "CONTAINER_TURNS", limit)
    monkeypatch.setattr(trie, "SEGMENT_TURNS", segment)
    rows = random_rows(limit + segment, 60)
    assert got(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "CONTAINER_TURNS", 50)
    monkeypatch.setattr(trie, "SEGMENT_TURNS", 64)
    long = [(7, t, "user", f"w{t % 3} x") for t in range(300)] + [(27, t, "user", f"w{t % 3} x") for t in range(299)]
    rows = [(None, 0, "user", "lost"), (3, None, None, None), (3, None, None, None), (3, 0, "", "a\tb\x0bc"), (3, 0, "", "a\tb\x0bc"), (3, 0, None, " é " * 9000)]
    rows += [(20, 0, "user", "hi there"), (20, 1, "assistant", None), (21, 0, "user", "hi there"), (41, 0, "a", "bc"), (42, 0, "ab", "c"), *long]
    # Equal turn numbers are ordered by digest, which a written-out order by text need not follow; only equal rows tie here, or turns of one path.
    mine = got(spark, rows)
    assert {(r[1], r[3]) for r in mine if r[1] == 0} == {(0, len({r[0] for r in rows if r[0] is not None}))}
    plain = [r for r in rows if r[0] != 3]
    assert got(spark, plain) == brute(plain)


def test_empty_and_single(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
    assert got(spark, [(5, 1, "user", "x y")]) == brute([(5, 1, "user", "x y")])


def test_a_conversation_over_many_tasks(spark):
    rows = [(1, t // 2, "user", f"{t // 2 % 7}") for t in range(5000)] + random_rows(3, 20)
    assert got(spark, rows) == brute(rows)


def test_sql(spark, tmp_path):
    matches_sql(spark, "op12_trie")
    rows = [(*r, "x", 1, "y") for r in random_rows(9, 40)] + [(77, None, None, None, None, None, None), (None, 1, "user", "x", None, None, None)]
    got_rows, want = on_tables(spark, tmp_path, "op12_trie", conversations=spark.createDataFrame(rows, SCHEMA))
    assert got_rows == want
