"""Regions: boundaries by id, prefix scans, and the level of an id."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels that an id of so many digits can have, the likelier first.
LEVELS_BY_LENGTH = {2: ["state"], 5: ["county", "zcta", "uac"], 7: ["place"], 8: ["mpo"], 10: ["cousub"]}


def boundary(regions: DataFrame, geoid: str) -> DataFrame:
    """The region with an id; the predicate reaches the scan."""
    return regions.where(F.col("geoid") == geoid)


def with_prefix(regions: DataFrame, prefix: str, level: str) -> DataFrame:
    return regions.where((F.col("geolevel") == level) & F.col("geoid").startswith(prefix)).select("geoid")


def geolevel_of(regions: DataFrame, geoid: str) -> str | None:
    """The level at which a region with the id exists; an id of other characters than digits is an error."""
    if not re.fullmatch(r"\d{2,10}", geoid):
        raise ValueError(f"no region id: {geoid!r}")
    for level in LEVELS_BY_LENGTH.get(len(geoid), []):
        if not regions.where((F.col("geoid") == geoid) & (F.col("geolevel") == level)).limit(1).isEmpty():
            return level
    return None
