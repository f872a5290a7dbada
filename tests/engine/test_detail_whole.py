"""Upcoming showtimes of all years by local day: brute force over the smallest tables."""

from collections import Counter
from datetime import datetime
from zoneinfo import ZoneInfo

import pandas as pd

from lumenreel.operators.predicates import ZONE
from lumenreel.plans import registry
from lumenreel.plans.base import NOW


def test_detail_by_day(spark, sf):
    rows = pd.read_parquet(f"{sf}/lineitem.parquet", columns=["l_partkey", "l_shipdate", "l_linestatus"])
    local = lambda t: pd.Timestamp(t).to_pydatetime().replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(ZONE)).strftime("%Y-%m-%d")
    want = Counter((m, local(t)) for m, t, s in rows.itertuples(index=False) if s == "O" and pd.Timestamp(t) > datetime.fromisoformat(NOW))
    got = registry.QUERIES["detail_by_day"](spark, sf).select("movie_id", "day", "n").collect()
    assert max(day for _, day in want) >= "2001"
    assert len(got) == len(want) and {(r.movie_id, r.day): r.n for r in got} == want
