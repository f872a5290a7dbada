"""Keys that are far apart, as large tables have them: SQL over a few rows."""

from datetime import datetime

import pytest

from lumenreel.plans import registry

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def by_sql(name, folder, *tables):
    """Columns in order of their names and rows of a query's SQL."""
    con = pytest.importorskip("duckdb").connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    cursor = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    return sorted(names), sorted((tuple(v for _, v in sorted(zip(names, r, strict=True))) for r in cursor.fetchall()), key=repr)


def by_spark(spark, name, folder):
    df = registry.QUERIES[name](spark, str(folder))
    return sorted(df.columns), sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_a_little_dearer_but_far_later_part_goes(spark, tmp_path):
    prices = [(1998, "a", 999.8), (106999, "a", 999.9), (5, "b", 900.0), (90005, "b", 900.1), (7, "c", None), (8, "d", 1.0), (9, "d", None), (10, "d", 1.0), (100011, "d", 1.1)]
    spark.createDataFrame([(k, n, "Brand#1", "SMALL", 1, p) for k, n, p in prices], PART).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = by_spark(spark, "merge_duplicates", tmp_path)
    assert got == by_sql("merge_duplicates", tmp_path, "part")
    assert dict((n, k) for k, _, n in got[1]) == {"a": 1998, "b": 90005, "c": None, "d": 8}


@pytest.fixture(scope="module")
def shared_ids(spark, tmp_path_factory):
    """User 2's wants of films 102 and 105 have the ids of user 1's wants of films 1000102 and 1000105; film 105 goes to film 3."""
    folder = tmp_path_factory.mktemp("shared")
    brands = {3: 1, 105: 1, 102: 2, 1000105: 3, 1000102: 4}
    spark.createDataFrame([(k, f"film {k}", f"Brand#{b}", "SMALL", 1, 1.0) for k, b in brands.items()], PART).write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(1, 1, "O"), (2, 2, "O")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{folder}/orders.parquet")
    lines = [(u, k, s, n, f, "O", datetime(1992 + n, 5, 1)) for u, k in ((1, 1000105), (1, 1000102), (2, 3), (2, 105), (2, 102)) for s in (1, 2) for n in range(10) for f in "ANR"]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{folder}/lineitem.parquet")
    events = [(1, 1, "view", 1.0, '{"k": 1}', datetime(2024, 1, 1))]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, props string, ts timestamp_ntz").write.parquet(f"{folder}/events.parquet")
    return folder


def decided(result):
    """Rows without the user and film of an id, which SQL takes from any of the rows that share it."""
    names, rows = result
    at = [i for i, n in enumerate(names) if n not in ("user_id", "movie_id")]
    return [names[i] for i in at], sorted((tuple(r[i] for i in at) for r in rows), key=repr)


def test_wants_that_are_left_with_one_id_are_one(spark, shared_ids):
    got = by_spark(spark, "merge_flow_wants", shared_ids)
    assert decided(got) == decided(by_sql("merge_flow_wants", shared_ids, "part", "orders", "lineitem"))
    assert {(r[2], r[3], r[1]) for r in got[1]} <= {(1, 2000102, 1000102), (2, 2000102, 102), (1, 2000105, 1000105), (2, 2000003, 3)} and len(got[1]) == 3


def test_watches_that_are_left_with_one_id_are_one(spark, shared_ids):
    got = by_spark(spark, "merge_flow_watches", shared_ids)
    assert decided(got) == decided(by_sql("merge_flow_watches", shared_ids, "part", "orders", "lineitem"))
    assert len(got[1]) == 1


def test_deliveries_follow_the_want_of_their_user(spark, shared_ids):
    got = by_spark(spark, "merge_flow_deliveries", shared_ids)
    assert got == by_sql("merge_flow_deliveries", shared_ids, "part", "orders", "lineitem")
    assert {r[1] for r in got[1]} >= {2000003, 2000105}
