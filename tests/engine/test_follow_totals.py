"""Deliveries of follows in total: as many as there are rows, without a row for each film of each follow."""

from pyspark.sql import functions as F

from lumenreel.operators import jobs as J
from lumenreel.plans import registry


def test_totals_of_rows(spark):
    frame = spark.createDataFrame
    stored, asked = frame([(1, "a"), (2, "b")], "user_id long, person_id string"), frame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "c"), (4, "d"), (5, "b"), (None, "b")], "user_id long, person_id string")
    credits, shown = frame([("a", 10), ("a", 11), ("a", 11), ("b", 9), ("b", 10), ("c", 99)], "person_id string, movie_id long"), frame([(9,), (10,), (10,), (11,)], "movie_id long")
    users = frame([(1, "x"), (2, None), (5, "m"), (5, "n")], "user_id long, email string")
    rows = J.follow_people(stored, asked, credits, shown, users)[1]
    want = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("movie_id").alias("first_movie"), F.max("sent_to").alias("sent_to"))
    got = J.told_totals(stored, asked, credits, shown, users)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert {tuple(r) for r in got.collect()} >= {(1, 2, 9, "x"), (2, 2, 10, ""), (5, 4, 9, "n")}


def test_no_row_for_each_film_of_each_follow(spark, tmp_path):
    """300 users follow ten people with 1,000 films each: what is shuffled does not hold the 2,000,000 pairs."""
    part = spark.range(20_000).selectExpr("id AS p_partkey", "'n' AS p_name", "concat('Brand#', (id div 2) % 10) AS p_brand", "'SMALL' AS p_type", "1 AS p_size", "1.0D AS p_retailprice")
    lines = spark.range(30_000).selectExpr("if(id < 20000, 0, (id - 20000) % 300) AS l_orderkey", "if(id < 20000, id, (id - 20000) div 300 % 10 * 2) AS l_partkey", "1L AS l_suppkey", "1 AS l_linenumber", "'N' AS l_returnflag", "'O' AS l_linestatus", "timestamp_ntz'1999-01-01' AS l_shipdate")
    orders = spark.range(300).selectExpr("id AS o_orderkey", "id AS o_custkey")
    customers = spark.range(300).selectExpr("id AS c_custkey", "concat('user ', id) AS c_name", "1.0D AS c_acctbal", "'BUILDING' AS c_mktsegment")
    for name, table in {"part": part, "lineitem": lines, "orders": orders, "customer": customers}.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        rows = registry.QUERIES["follow_deliveries"](spark, str(tmp_path)).collect()
        assert written() - before < 6_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 200 and {(r.n, r.first_movie) for r in rows} == {(20_000, 0)} and all(r.sent_to == f"user {r.user_id}" for r in rows)
