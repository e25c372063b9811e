"""The rate limit on a client without pauses, and on odd keys."""

from pyspark.sql import functions as F

from berrak.streaming import stream
from tests.base.test_audit import limited


def test_hot_client_without_pauses(spark):
    n = 60_000
    events = spark.range(n).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("user_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"))
    got = stream.rate_limit(events, "user_id", "ts", 3, 86_400.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan
    allowed = {r.event_id: r.allowed for r in got.collect()}
    hot = [k for k in range(n) if k % 3]
    assert len(allowed) == n and [allowed[k] for k in hot] == limited([k * 600.0 for k in hot], 3, 86_400.0)
    assert all(allowed[k] for k in range(0, n, 3))


def test_null_keys_and_times(spark):
    rows = [(1, None, 0), (2, None, 1), (3, None, 2), (4, "a", None), (5, "a", 0), (6, "a", None), (7, "a", 1), (8, "a", 10)]
    events = spark.createDataFrame(rows, "event_id long, user string, s long").select("event_id", "user", F.timestamp_seconds("s").alias("ts"))
    got = {r.event_id: r.allowed for r in stream.rate_limit(events, "user", "ts", 1, 10.0).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 7: False, 8: True}
