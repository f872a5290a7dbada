"""All active posts act as triggers, whoever wrote them: brute force over a small table of events."""

from datetime import datetime

from lumenreel.plans import registry


def test_market_match(spark, tmp_path):
    rows = [(i, u, ("click", "purchase", "view")[i % 3], 5.0 if i % 7 == 0 else 20.0, '{"k": %d}' % (i % 4), datetime(2024, 1, 1)) for i, u in enumerate([3, 20, 21, 500, 1499] * 10, 1990)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    active = [(i, u, t, i % 4) for i, u, t, v, _, _ in rows if t != "view" and v >= 10]
    want = {(i, j, k) for i, u, t, k in active for j, w, s, m in active if k == m and u != w and t != s and not (i < 2000 and j < 2000)}
    got = [tuple(r) for r in registry.QUERIES["market_match"](spark, str(tmp_path)).select("trigger_id", "recipient_id", "showtime_id").collect()]
    users = {i: u for i, u, _, _ in active}
    assert {users[i] for i, _, _ in want} >= {20, 500}
    assert len(got) == len(set(got)) and set(got) == want
