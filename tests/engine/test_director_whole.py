"""Due films of every user: brute force over the smallest tables."""

import pandas as pd

from lumenreel.plans import registry
from lumenreel.plans.base import NOW


def test_director_transition(spark, sf):
    read = lambda n, c: pd.read_parquet(f"{sf}/{n}.parquet", columns=c)
    lines = read("lineitem", ["l_orderkey", "l_partkey", "l_shipdate", "l_linestatus"]).merge(read("orders", ["o_orderkey", "o_custkey"]), left_on="l_orderkey", right_on="o_orderkey")
    up = lines[(pd.to_datetime(lines.l_shipdate) > NOW) & (lines.l_linestatus == "O")]
    shown, wanted = set(up.l_partkey), set(zip(lines.o_custkey, lines.l_partkey, strict=True))
    person = dict(read("part", ["p_partkey", "p_brand"]).itertuples(index=False))
    users = read("customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    email = {r.c_custkey: r.c_name for r in users.itertuples() if r.c_acctbal >= 0 and r.c_mktsegment != "MACHINERY"}
    follows = {(u, person[m]) for u, m in wanted if u in email}
    want = {(u, p, m, email[u]) for u, p in follows for m in shown if person[m] == p and (u, m) not in wanted}
    got = [tuple(r) for r in registry.QUERIES["director_transition"](spark, sf).select("user_id", "person_id", "movie_id", "email").collect()]
    assert max(u for u, *_ in want) > 40
    assert len(got) == len(set(got)) and set(got) == want
