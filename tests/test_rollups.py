"""Roll-ups that grow against a scan."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerloom.operators import rollups
from ledgerloom.sources.index_store import Store


def test_ranges_equal_a_scan_and_late_rows_change_their_days(spark, tmp_path):
    r, root = random.Random(3), str(tmp_path / "root")
    rows = [(f"s{r.randint(0, 60)}", r.choice("ab"), r.randint(-3, 9) * rollups.DAY_MS + r.randint(0, rollups.DAY_MS - 1), r.randint(0, 5)) for _ in range(900)]
    rows += [(None, "a", 5, 1), ("s1", "a", None, 1)]
    late = [(f"s{r.randint(40, 99)}", "a", 4 * rollups.DAY_MS + k, 2) for k in range(50)]
    schema = "session_id string, action_type string, event_ms long, settled_energy long"
    first = rollups.update_daily(spark, spark.createDataFrame(rows, schema).repartition(4), root)
    second = rollups.update_daily(spark, spark.createDataFrame(late, schema), root)
    changed = [b for b, runs in second.tables["daily"]["parts"].items() if runs != first.tables["daily"]["parts"].get(b)]
    assert changed == ["4"]
    every = [x for x in rows + late if x[0] is not None and x[2] is not None]
    for low, high in ((None, None), (4, 4), (-3, 2), (8, 30)):
        mine = [x for x in every if (low is None or x[2] // rollups.DAY_MS >= low) and (high is None or x[2] // rollups.DAY_MS <= high)]
        want = {k: (len(g := [x for x in mine if x[1] == k]), sum(x[3] for x in g), min(x[2] for x in g), max(x[2] for x in g), len({x[0] for x in g})) for k in {x[1] for x in mine}}
        assert {x.action_type: tuple(x)[1:] for x in rollups.totals(spark, root, low, high).collect()} == want
    numbers = [x.number for x in Store(spark, root, rollups.DEALS).read(second, "sessions", rollups.NAMES).collect()]
    assert len(numbers) == len(set(numbers)) == len({x[0] for x in every})
    by_day = rollups.totals(spark, root, by=("day",)).where(F.col("day") == 4).first()
    assert by_day.sessions == len({x[0] for x in every if x[2] // rollups.DAY_MS == 4})
