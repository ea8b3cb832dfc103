"""Model names inside opaque signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode_base64(text: Column) -> Column:
    """Standard base64, else trimmed and padded anew, else null."""
    bare = F.regexp_replace(F.trim(text), "=+$", "")
    padded = F.rpad(bare, F.ceil(F.length(bare) / 4).cast("int") * 4, F.lit("="))
    return F.coalesce(F.try_to_binary(text, F.lit("base64")), F.try_to_binary(padded, F.lit("base64")))


def ascii_runs(data: Column, least: int = 4) -> Column:
    """Distinct runs of printable ASCII, in order."""
    return F.array_distinct(F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit(f"[\\x20-\\x7e]{{{least},}}"), F.lit(0)))


def variant_by_priority(runs: Column, patterns: Sequence[str]) -> Column:
    """The match of the first pattern that any run has."""

    def first(pattern: str) -> Column:
        return F.get(F.filter(F.transform(runs, lambda run: F.regexp_extract(run, pattern, 0)), lambda x: x != ""), F.lit(0))

    return F.coalesce(*map(first, patterns))


def turn_variant(blocks: DataFrame, *turn: str, order: str = "block_index", variant: str = "variant") -> DataFrame:
    """One row a turn: the first block with a variant names it; null where none has one."""
    return blocks.groupBy(*turn).agg(F.min_by(variant, F.when(F.col(variant).isNotNull(), F.col(order))).alias("variant"))
