"""Statistics of a run, counted while its rows are written: no scan of their own."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """``rows`` that count themselves as they pass; each of ``counts`` is an aggregate. The observation has them once an action is done."""
    seen = Observation()
    return rows.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen


def run(scraped: DataFrame, parse: Callable[[DataFrame], DataFrame], dedupe: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], source: str) -> dict:
    """One ingest of a source: raw, parsed, failed, deduplicated and written rows, and how long it took.

    ``parse`` adds ``start``, null where a row's time could not be read; rows pass
    through once, and what fails to be written leaves success false with the error.
    """
    began = time.monotonic()
    raw, raw_seen = observed(scraped, n=F.count(F.lit(1)))
    parsed, parsed_seen = observed(parse(raw), good=F.count_if(F.col("start").isNotNull()), bad=F.count_if(F.col("start").isNull()))
    kept, kept_seen = observed(dedupe(parsed.filter(F.col("start").isNotNull())), n=F.count(F.lit(1)))
    done = {"source": source, "success": True, "error": None}
    try:
        write(kept)
    except Exception as e:  # noqa: BLE001  (a failed source is a row of the report, the run goes on)
        return done | {"success": False, "error": str(e).split("\n")[0], "seconds": round(time.monotonic() - began, 3)}
    good = parsed_seen.get
    return done | {"raw": raw_seen.get["n"], "parsed": good["good"], "failed": good["bad"], "written": kept_seen.get["n"], "seconds": round(time.monotonic() - began, 3)}
