"""Pairs of posts leave the join as they are made; only those of notified posts are looked up."""

from lumenreel.operators import jobs as J
from lumenreel.plans import registry


def test_pairs_are_not_shuffled(spark, tmp_path):
    """1,500 posts on each side of one showtime are 4,500,000 pairs, less those of early posts and of one user."""
    rows = spark.range(1_900, 4_900).selectExpr("id AS event_id", "id % 1000 AS user_id", "if(id % 2 = 0, 'click', 'purchase') AS event_type", "20.0D AS value", "'{\"k\": 7}' AS props", "timestamp'2024-01-01' AS ts")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        n = registry.QUERIES["market_match"](spark, str(tmp_path)).count()
        assert written() - before < 5_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Users are even or odd as their posts are, so none is on both sides.
    assert n == 2 * (1_500 * 1_500 - 50 * 50)


def test_only_noticed_pairs_go(spark):
    """Posts that were noticed of others still meet each other; keys that are null match nothing."""
    posts = spark.createDataFrame([(i, i, 1, "BUY" if i % 2 else "SELL", "ACTIVE") for i in range(1, 7)] + [(None, 9, 1, "BUY", "ACTIVE")], "post_id long, user_id long, showtime_id long, type string, status string")
    told = {(1, 2), (1, 2), (3, 4), (2, 3), (6, 1)}
    notified = spark.createDataFrame([*told, (1, 2), (None, 4)], "trigger_id long, recipient_id long")
    got = [tuple(r)[:2] for r in J.matches(posts, posts, notified).collect()]
    both = [(a, b) for a in (1, 3, 5, None) for b in (2, 4, 6)]
    want = {p for p in both + [(b, a) for a, b in both] if p not in told}
    assert len(got) == len(want) and set(got) == want
