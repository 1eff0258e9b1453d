"""Candidate selection: which searches to run next, given regions, ranges and a log of past searches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.functions import map_fingerprint, rename_keys
from tarnfield.operators.relations import cooldown_candidates, resolve_symbols, small

EVERYWHERE = "global"
COOLDOWN_MINUTES = 43_200
SEARCHES_PER_REGION = 5


def _location(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(EVERYWHERE))


def candidate_table(symbols: DataFrame, symbol: str, names: DataFrame, name: str, key: str, segments: DataFrame, history: DataFrame, now: str, renames: Mapping[str, str], minutes: int = COOLDOWN_MINUTES, per_region: int = SEARCHES_PER_REGION) -> DataFrame:
    """(location, filters, fingerprint): the first segments of each region that were not searched lately.

    ``segments``: a small table of filter columns; nulls are no filters. ``history``: location_id, filters (a map, its
    keys renamed by ``renames``), used_at. Every region meets every segment: that product is the result before the limit.
    """
    regions = resolve_symbols(symbols, names, symbol, name, key).select(_location("resolved").alias("location")).distinct()
    filters = F.map_filter(F.create_map(*[x for c in segments.columns for x in (F.lit(c), F.col(c).cast("bigint"))]), lambda k, v: v.isNotNull())
    options = segments.select(filters.alias("filters")).withColumn("fingerprint", map_fingerprint("filters"))
    pool = regions.crossJoin(small(options))
    log = history.select(_location("location_id").alias("location"), map_fingerprint(rename_keys("filters", renames)).alias("fingerprint"), "used_at")
    return cooldown_candidates(pool, log, ["location", "fingerprint"], "used_at", now, minutes, ["location"], per_region, "fingerprint").select("location", "filters", "fingerprint")
