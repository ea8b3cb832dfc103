"""Trees that grow, and consistency proofs, against plain recursion."""

from __future__ import annotations

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import integrity


def leaf(k):
    return hashlib.sha256(f"leaf {k}".encode()).hexdigest()


def join(a, b):
    return hashlib.sha256(b"\x01" + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()


def root(lo, hi):
    if hi - lo == 1:
        return leaf(lo)
    k = 1 << ((hi - lo - 1).bit_length() - 1)
    return join(root(lo, lo + k), root(lo + k, hi))


def leaves(spark, lo, hi):
    return spark.createDataFrame([(k, leaf(k)) for k in range(lo, hi)], "log_index long, event_hash string").repartition(3)


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_appending_equals_building(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(integrity, "CHUNK_BITS", bits)
    path, size = str(tmp_path / "tree"), 0
    for step in (1, 2, 5, 1, 30, 64) if bits > 1 else (3, 6):
        before = integrity.stored_nodes(spark, path).count()
        assert integrity.append_leaves(spark, leaves(spark, size, size + step), path) == size + step
        new = integrity.stored_nodes(spark, path).count() - before
        size += step
        assert new <= 2 * step + size.bit_length()  # not the old ones again
        assert integrity.stored_root(spark, path) == root(0, size)
    got = {(r.level, r.idx): r.hash for r in integrity.stored_nodes(spark, path).collect()}
    assert got == {(k, i): root(i << k, i + 1 << k) for k in range(size.bit_length()) for i in range(size >> k)}
    assert integrity.stored_nodes(spark, path).count() == len(got)


def test_a_dead_append_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "tree")
    integrity.append_leaves(spark, leaves(spark, 0, 10), path)
    real = integrity._folded
    monkeypatch.setattr(integrity, "_folded", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        integrity.append_leaves(spark, leaves(spark, 10, 20), path)
    assert integrity.stored_tree(spark, path)[0] == 10 and integrity.stored_root(spark, path) == root(0, 10)
    monkeypatch.setattr(integrity, "_folded", real)
    with pytest.raises(ValueError, match="do not follow"):
        integrity.append_leaves(spark, leaves(spark, 11, 20), path)
    assert integrity.append_leaves(spark, leaves(spark, 10, 20), path) == 20 and integrity.stored_root(spark, path) == root(0, 20)
    assert integrity.append_leaves(spark, leaves(spark, 0, 0), path) == 20


def brute_proof(m, lo, hi, whole=True):
    n = hi - lo
    if m == n:
        return [] if whole else [root(lo, hi)]
    k = 1 << ((n - 1).bit_length() - 1)
    return brute_proof(m, lo, lo + k, whole) + [root(lo + k, hi)] if m <= k else brute_proof(m - k, lo + k, hi, False) + [root(lo, lo + k)]


def test_consistency_proofs_of_all_sizes(spark):
    n = 70
    nodes = integrity.merkle_build(leaves(spark, 0, n)).cache()
    pairs = [(a, b) for a, b in itertools.product(range(1, n + 1), repeat=2) if a <= b]
    wanted = spark.createDataFrame([(a, b, root(0, a), root(0, b)) for a, b in pairs], "first_size long, second_size long, first_root string, second_root string").repartition(4)
    proofs = integrity.consistency_proofs(nodes, wanted).cache()
    rows = integrity.verify_consistency(proofs).collect()
    assert len(rows) == len(pairs) and {r.status for r in rows} == {"consistent"}
    assert all(list(r.proof) == brute_proof(r.first_size, 0, r.second_size) for r in rows)
    # One hash changed, one left out, one more, or another root: none passes.
    other = F.sha2(F.lit("other"), 256)
    changed = proofs.where("size(proof) > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.size("proof") - 1))).withColumn("proof", F.transform("proof", lambda h, i: F.when(i == F.col("k"), other).otherwise(h)))
    shorter = proofs.where("size(proof) > 0").withColumn("proof", F.slice("proof", F.lit(1), F.size("proof") - 1))
    longer = proofs.withColumn("proof", F.concat("proof", F.array(other)))
    roots = proofs.withColumn("first_root", other).unionByName(proofs.withColumn("second_root", other))
    for bad in (changed, shorter, longer, roots):
        assert integrity.verify_consistency(bad).where("status = 'consistent'").count() == 0
    odd = spark.createDataFrame([(5, 3, "a", "b"), (0, 3, "a", "b")], "first_size long, second_size long, first_root string, second_root string").withColumn("proof", F.array().cast("array<string>"))
    assert {r.status for r in integrity.verify_consistency(odd).collect()} == {"sizes out of order"}


def test_low_levels_of_proofs_make_no_row_a_level(spark):
    """Over more than one chunk and several sizes, repeated requests and further columns included; a row for each level used to go through two shuffles."""
    n = 5000
    leaves = spark.range(n).select(F.col("id").alias("log_index"), F.sha2(F.col("id").cast("string"), 256).alias("event_hash")).cache()
    nodes = integrity.merkle_build(leaves).cache()
    sizes = spark.createDataFrame([(1,), (7,), (4096,), (4097,), (4999,), (n,)], "tree_size long")
    wanted = leaves.where("log_index % 97 IN (0, 1) OR log_index > 4090 AND log_index < 4100 OR log_index < 8 OR log_index > 4990").join(F.broadcast(sizes)).where("log_index < tree_size")
    proofs = integrity.inclusion_proofs(nodes, wanted.union(wanted.where("log_index = 4")))
    assert wanted.where("log_index = 4").count() == 5
    got = integrity.verify_inclusion(proofs.join(integrity.root_at_size(nodes, sizes), "tree_size")).groupBy("status").count().collect()
    assert [(r.status, r["count"]) for r in got] == [("verified", wanted.count() + 5)]
    one = integrity.inclusion_proofs(nodes, wanted.where("tree_size = 4096"))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(") == 3  # two of the layers of the tree, one of requests, none of levels


def test_a_tamper_scan_has_more_tasks_for_more_rows(spark, monkeypatch):
    """The tasks used to be as many as the session sets, however long the log."""
    monkeypatch.setattr(integrity, "SCAN_ROWS", 100, raising=False)
    leaves = spark.range(2000).select(F.col("id").alias("log_index"), F.col("id").cast("string").alias("event_hash"))
    bad = leaves.where("log_index <> 3").withColumn("event_hash", F.when(F.col("log_index") == 1, "x").otherwise(F.col("event_hash"))).union(leaves.where("log_index = 2"))
    out = integrity.tamper_scan(bad, leaves.select(F.col("log_index").alias("idx"), F.col("event_hash").alias("hash")))
    assert sorted(map(tuple, out.collect())) == [(1, "leaf differs"), (2, "duplicate"), (3, "missing")]
    assert "RepartitionByExpression [log_index" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "], 20" in plan
