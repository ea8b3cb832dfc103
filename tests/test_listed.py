"""Listed values against the chain of replaces."""

from __future__ import annotations

import random

import pytest

from ledgerloom.operators import listed


def chain(text, values):
    for v in sorted({v for v in values if len(v.encode()) >= 8}, key=lambda v: (-len(v), v)):
        text = text.replace(v, listed.MARK)
    return text


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_chain(monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(listed, "STEP", r.choice((5, 64, 1 << 20)))
    word = lambda: "".join(r.choices(("ab", "ba", "é", "RED", "ACTED", ":env", "]x"), k=r.randint(2, 7)))
    values = [word() for _ in range(300)] + ["ACTED:env]", "x[REDACTED", "short"]
    (part,) = listed.tables(values)
    table = listed.Table(part)
    for _ in range(200):
        text = "".join(r.choice((word(), r.choice(values), " ")) for _ in range(r.randint(0, 12)))
        assert table.clean(text) == chain(text, values)


def test_many_values_over_texts(spark, monkeypatch):
    monkeypatch.setattr(listed, "TABLE_BYTES", 1 << 20)
    values = [f"value-{k:06d}-{'x' * (k % 30)}" for k in range(100_000)]
    texts = [None, "", "tiny", *(f"say {values[k * 7919 % 100_000]} and {values[k]}! " * 3 for k in range(60))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    assert len(list(listed.tables(values))) > 1
    got = {r.k: r.text for r in listed.redact_listed(df, "text", values).collect()}
    assert got[0] is None and got[1] == "" and got[2] == "tiny"
    for k in range(60):
        mine = [values[k * 7919 % 100_000], values[k]]
        near = {v for v in values if any(v in m for m in mine)}
        assert got[k + 3] == chain(texts[k + 3], near)
    assert listed.redact_listed(df, "text", ["short"]).collect() == df.collect()
