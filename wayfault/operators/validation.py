"""Checks that raise, and the tables of violations behind them.  Each check is one aggregated job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    pass


def _none(df: DataFrame, message: str) -> None:
    first = df.limit(3).collect()
    if first:
        raise ValidationError(f"{message}: {[r.asDict() for r in first]}")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are null or not unique, with their number of rows."""
    null = " OR ".join(f"`{k}` IS NULL" for k in keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 OR {null}")


def require_key(df: DataFrame, keys: list[str]) -> DataFrame:
    _none(key_violations(df, keys), f"{keys} is no key")
    return df


def lost_and_gained(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in only one of two tables, with ``side``."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("lost")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("gained")))


def require_same_keys(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    if not after.limit(1).count():
        raise ValidationError("the result is empty")
    _none(lost_and_gained(before, after, keys), "keys have changed")
    return after


def foreign_key_violations(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.select(*keys).distinct().join(parent, keys, "left_anti")


def require_foreign_key(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    _none(foreign_key_violations(child, parent, keys), f"{keys} without a parent")
    return child


def require_disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    _none(a.select(*keys).join(b, keys, "left_semi"), "tables that should be disjoint share keys")


def require_domain(df: DataFrame, column: str, allowed: DataFrame, value: str) -> DataFrame:
    """All values (nulls too) of a column are among the allowed ones."""
    found = df.select(F.col(column).alias("_v")).distinct()
    _none(found.join(allowed.select(F.col(value).alias("_a")).distinct(), F.col("_v").eqNullSafe(F.col("_a")), "left_anti"), f"unexpected values of {column}")
    return df


def fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: number of rows, and the sum of 48 bits of the MD5 of each row's texts, which does not depend on their order; nulls differ from empty texts."""
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\x00")) for k in keys])
    part = F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("hash"))


def require_unchanged(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    if fingerprint(before, keys).first() != fingerprint(after, keys).first():
        raise ValidationError(f"{keys} have changed")
    return after


def require_columns(df: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """Columns that must be there, with their types where these matter."""
    have = dict(df.dtypes)
    missing = [c for c in columns if c not in have]
    wrong = [f"{c}: {have[c]}, not {t}" for c, t in columns.items() if t and c in have and have[c] != t]
    if missing or wrong:
        raise ValidationError(f"missing: {missing}; of another type: {wrong}")
    return df


def with_crs(df: DataFrame, column: str, crs: str) -> DataFrame:
    """Note the coordinate system of a geometry column in its metadata."""
    return df.withMetadata(column, {**df.schema[column].metadata, "crs": crs})


def require_crs(df: DataFrame, column: str, crs: str | None = None, projected: bool = False) -> DataFrame:
    own = df.schema[column].metadata.get("crs")
    if not own or (crs and own != crs) or (projected and not own.startswith("LAEA")):
        raise ValidationError(f"the coordinate system of {column} is {own}")
    return df
