"""Lifecycle hooks: what stays of each, and that its name is read once."""

from __future__ import annotations

import json

from ledgerloom.functions import normalize


def test_fields_by_hook_and_few_parses(spark):
    raws = [{"hook_event_name": h, "agent_type": "x", "agent_id": "1", "source": "s", "message": "m\u00e9", "content": "abc"} for h in (*normalize.LIFECYCLE, "Other")]
    df = spark.createDataFrame([("\ufeff" + json.dumps(r),) for r in raws] + [("{}",), (None,)], "raw string")
    out = normalize.normalize_lifecycle(df, "raw", "agent")
    assert out.columns == ["raw", "event_type", "target", "metadata", "byte_len", "source"]
    got = {r.event_type: (r.target, r.metadata, r.byte_len) for r in out.collect()}
    assert set(got) == {v[0] for v in normalize.LIFECYCLE.values()}
    assert got["session_start"] == ("session:SessionStart", {"source": "s"}, None)
    assert got["subagent_stop"] == ("subagent:x", {"agent_type": "x", "agent_id": "1"}, None)
    assert got["stop_failure"] == ("session:StopFailure:unknown", {}, None)
    assert got["elicitation_result"][2] == 3 and got["message_display"][2] == 3
    plan = out.select("event_type", "byte_len")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") <= 4  # one for each hook, several times over, before
