"""Exact dedup by a tree merge of sorted digest runs (DataFrame functions only).

Method: documents fall into runs by a hash of their id. A run is sorted by digest, and equal
digests, neighbours now, merge into one row: digest, the identifier to keep and how many members.
Then 2^FAN_BITS runs at a time exchange their rows in rounds. In each round every one of these
partners gets the rows of all of them in one part of the digests' range, merges them in sorted
order and keeps the best identifier of equal digests. So runs become fewer and ranges narrower,
and as many pieces of about equal size are left in every round; after the last one a piece holds
its range of all documents. The winners go back down the same tree to the documents. A digest
merges only where byte length and a second hash agree too, at every level. As a document joins its
own run's row only, no key of any join or merge holds more than a run's share of a group of
copies, whatever its size.

Plan of a round: an exchange by piece, a sort within it, and a sort aggregate, which streams over
neighbours and holds one row at a time.

Defined results: a null text counts as empty; a null doc_id ranks below all others; where several
rows hold the identifier that stays, one of them stays; extra columns pass through
``drop_copies`` unchanged; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FAN_BITS = 4
#: Mean documents a run.
RUN_ROWS = 16_384
KEY = ["_digest", "_bytes", "_check"]
#: Bits of a digest that tell pieces apart, at most.
HEAD_BITS = 32


def normal_text() -> Column:
    return F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)


def with_digests(docs: DataFrame) -> DataFrame:
    normal = docs.withColumn("_normal", normal_text())
    return normal.withColumns({"_digest": F.unhex(F.sha2("_normal", 256)), "_bytes": F.octet_length("_normal"), "_check": F.xxhash64("_normal")}).drop("_normal")


def in_round(rows: DataFrame, level: int) -> DataFrame:
    """rows with the number of their piece in a round: the runs merged so far, and the part of the digests' range."""
    part = F.shiftright("_head", HEAD_BITS - FAN_BITS * level) if level else F.lit(0)
    return rows.withColumn("_piece", F.shiftleft("_run", FAN_BITS * level) + part)


def merged(rows: DataFrame, keep: str) -> DataFrame:
    """Each piece sorted by digest, equal neighbours as one row with the best identifier."""
    best, own = F.max if keep == "largest" else F.min, ["_piece", "_run", "_head", *KEY]
    in_order = rows.repartition("_piece").sortWithinPartitions(*own)
    return in_order.groupBy(*own).agg(best("_best").alias("_best"), F.sum("group_size").alias("group_size"))


def _resolved(docs: DataFrame, keep: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, _digest; one row a document."""
    levels, rows = 2, docs.count()
    while rows > RUN_ROWS << (FAN_BITS * levels) and FAN_BITS * (levels + 1) <= HEAD_BITS:
        levels += 1
    row = F.monotonically_increasing_id()
    marked = with_digests(docs.select("doc_id", "text")).select("doc_id", *KEY, row.alias("_row"))
    run = F.pmod(F.xxhash64(F.coalesce("doc_id", "_row")), F.lit(1 << (FAN_BITS * levels)))
    head = F.conv(F.hex(F.substring("_digest", 1, HEAD_BITS // 8)), 16, 10).cast("long")
    digests = cut(marked.withColumns({"_run": run, "_head": head}))

    # Rows with an id before those without, whichever end is kept; the row's number tells equal ids apart.
    known_id = F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()
    leaf = digests.withColumns({"_best": F.struct(known_id.alias("rank"), "doc_id", "_row"), "group_size": F.lit(1).cast("long")})
    runs = [cut(merged(in_round(leaf, 0), keep))]
    for level in range(1, levels + 1):
        runs.append(cut(merged(in_round(runs[-1].withColumn("_run", F.shiftright("_run", FAN_BITS)), level), keep)))
    known = runs.pop().select("_piece", *KEY, "_best", "group_size")
    for level in range(levels, 0, -1):
        below = in_round(runs.pop().withColumnRenamed("_piece", "_below").withColumn("_run", F.shiftright("_run", FAN_BITS)), level)
        known = below.select("_below", "_piece", *KEY).join(known, ["_piece", *KEY]).drop("_piece").withColumnRenamed("_below", "_piece")
    out = in_round(digests, 0).join(known, ["_piece", *KEY])
    return out.select("doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), "_digest")


def resolve(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row a document. keep: which identifier of equal texts stays, largest or smallest."""
    return _resolved(docs, keep).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, all columns. Decided without texts, which move once, to meet the decision."""
    holds = _resolved(docs, keep).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stay = cut(holds.groupBy(F.col("doc_id").alias("_keep_id"), F.col("_digest").alias("_keep_digest")).agg(F.count(F.lit(1)).alias("_rows")))
    marked = docs.withColumn("_digest", F.unhex(F.sha2(normal_text(), 256)))

    def held(some: DataFrame) -> DataFrame:
        return marked.join(some.hint("shuffle_hash"), marked["doc_id"].eqNullSafe(some["_keep_id"]) & (marked["_digest"] == some["_keep_digest"]), "left_semi")

    # Only rows that repeat both id and text have to be counted out.
    once = Window.partitionBy("doc_id", "_digest").orderBy("_digest")
    repeated = held(stay.where("_rows > 1")).withColumn("_nth", F.row_number().over(once)).where("_nth = 1").drop("_nth")
    return held(stay.where("_rows = 1")).unionByName(repeated).select(*docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size,
       doc_id IS NOT DISTINCT FROM keep_id AND row_number() OVER (PARTITION BY d.text_sha256, doc_id) = 1 AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
