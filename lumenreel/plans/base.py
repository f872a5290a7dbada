"""Reading tables, the roles they play, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The moment at which registered queries look at showtimes (lineitem, orders) and at posts (events).
NOW, EVENTS_NOW = "1998-06-01", "2024-01-15 12:00:00"


def ny_sql(utc: str) -> str:
    """DuckDB SQL for New York's clock: daylight saving from the first Sunday of April to the last of October (the years to 2006)."""
    spans = []
    for year in range(1992, 2007):
        first = next(d for d in range(1, 8) if date(year, 4, d).weekday() == 6)
        last = next(d for d in range(31, 24, -1) if date(year, 10, d).weekday() == 6)
        spans.append(f"{utc} >= TIMESTAMP '{year}-04-{first:02d} 07:00:00' AND {utc} < TIMESTAMP '{year}-10-{last} 06:00:00'")
    return f"({utc} - INTERVAL (CASE WHEN {' OR '.join(spans)} THEN 4 ELSE 5 END) HOUR)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("movie_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("person"), F.col("p_type").alias("genre"), F.col("p_size").alias("runtime"), F.col("p_retailprice").alias("price"))


def showtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("movie_id"), F.col("l_suppkey").alias("theater_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("start"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("format"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"))


def wants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user, movie) of what customers ordered."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"))
    return showtimes(spark, sf_dir).select("order_id", "movie_id").join(orders, "order_id").select("user_id", "movie_id").distinct()


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUY posts (clicks) and SELL posts (purchases); the showtime is the key within props; low values are closed."""
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "purchase"))
    return rows.select(F.col("event_id").alias("post_id"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("showtime_id"), F.when(F.col("event_type") == "click", F.lit("BUY")).otherwise(F.lit("SELL")).alias("type"), F.when(F.col("value") >= 10, F.lit("ACTIVE")).otherwise(F.lit("CLOSED")).alias("status"), F.col("ts").cast("timestamp_ntz").alias("updated_at"), "value")
