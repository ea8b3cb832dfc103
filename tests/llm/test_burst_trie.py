"""Burst tries against a brute-force trie over every prefix."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ledgerloom.llm import burst_trie, registry

SCHEMA = "conv_id long, turn long, role string, text string, path string, head string, node int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(donor, [])[:h] + turns[h:])
        for d in range(len(built[c]) + 1):
            nodes[built[c][:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    out, sums = [], {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves = sum(sums[q][0] for q in children[p]) if children[p] else 1
        saved = sum(sums[q][1] for q in children[p]) + (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
        sums[p] = (leaves, saved)
        ends = ",".join(str(c) for c in sorted(nodes[p]) if built[c] == p)
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made_up(seed, n=300, words=2, most=9):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 900), n):
        for k in range(r.choice((1, 1, 2, 3, r.randint(1, most)))):
            rows.append((c, r.choice((k, k, None)), r.choice(("user", "assistant", None)), r.choice((None, "", "é日" * r.randint(1, words), "b" * r.randint(1, words))), "x", "y", 1))
    hot = [(k, "user", f"hot {k}") for k in range(7)]
    rows += [(2000 + c, t, role, text, "x", "y", 1) for c in range(120) for t, role, text in hot]  # one frequent conversation
    rows += [(3000, t, "user", f"deep {t}", "x", "y", 1) for t in range(200)]  # a long one, and its beginnings
    rows += [(3000 + c, t, "user", f"deep {t}", "x", "y", 1) for c in range(1, 60) for t in range(c * 3)]
    rows += [(None, 1, "user", "nobody's", "x", "y", 1), (5, 0, "user", "twice", "x", "y", 1), (5, 0, "user", "twice", "x", "y", 1)]
    return rows


@pytest.mark.parametrize("burst", [3, 40, 700, 1 << 40])
def test_equals_brute_force(spark, burst):
    rows = made_up(burst % 97)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(burst_trie.shared_prefixes(df, burst)) == sorted(brute(rows), key=str)


def test_pieces_of_a_frequent_end(spark, monkeypatch):
    monkeypatch.setattr(burst_trie, "PIECE", 7)
    rows = [(c, 0, "user", "same" if c % 3 else "other", "x", "y", 1) for c in range(0, 4000, 9)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert got(burst_trie.shared_prefixes(df, 100)) == sorted(brute(rows), key=str)


def test_turnless_and_empty(spark, tmp_path):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "gone", "x", "y", 1)]  # its first turns are another's, who is absent
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert got(registry.queries()["op12_burst_tries"](spark, str(tmp_path))) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert burst_trie.shared_prefixes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_over_the_given_table(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(path).collect()]
    assert got(registry.queries()["op12_burst_tries"](spark, "/root/testdata/sf0.001")) == sorted(brute(rows), key=str)
