"""Row-wise and set operations on tables of edges: filters, projections, defaults, orders and set algebra on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfault.operators.validation import require_columns

EDGE = ["u", "v", "key"]


# -- filters
def in_region(edges: DataFrame, flag: str = "_intersects_region_") -> DataFrame:
    require_columns(edges, {flag: "boolean"})
    return edges.where(F.col(flag))


def major_roads(edges: DataFrame, max_class: int = 4) -> DataFrame:
    """Edges of classes 0 to ``max_class`` in the region; missing columns are an error."""
    require_columns(edges, {"roadclass": None, "_intersects_region_": "boolean"})
    return in_region(edges.where(F.col("roadclass").between(0, max_class)))


def without_rail(df: DataFrame, column: str, pattern: str = ".*RAILROAD.*") -> DataFrame:
    """Rows whose owner does not match from its start, ignoring case; unknown owners stay."""
    return df.where(~F.coalesce(F.col(column), F.lit("")).rlike(f"(?is)^{pattern}"))


# -- projections
def add_prefix(df: DataFrame, prefix: str, keys: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """All columns but the keys prefixed, without those to drop, if there."""
    df = df.drop(*drop)
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def rounded(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """Columns rounded, those that there are."""
    return df.withColumns({c: F.round(c, digits) for c in columns if c in df.columns})


def search_text(*parts: str | Column) -> Column:
    """Texts to search a row by, one after the other; unknown ones are left out."""
    return F.concat_ws(" ", *parts)


def measures(df: DataFrame, keys: list[str], chosen: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Keys and measures under their names: a column each, where a condition holds (null: everywhere)."""
    return df.select(*keys, *[(F.when(F.expr(where), F.col(c)) if where else F.col(c)).alias(name) for name, (c, where) in chosen.items()])


def select_except(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def with_defaults(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls become empty texts, zeros, or empty lists, by the columns' types."""
    out, chosen = {}, columns or df.columns
    for name, kind in df.dtypes:
        if name not in chosen:
            continue
        if kind == "string":
            out[name] = F.coalesce(name, F.lit(""))
        elif kind.startswith("array"):
            out[name] = F.coalesce(name, F.array().cast(kind))
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            out[name] = F.coalesce(name, F.lit(0).cast(kind))
    return df.withColumns(out) if out else df


def as_number(text: Column) -> Column:
    """A text as a number, null where it is none."""
    return text.try_cast("double")


def literal_list(text: Column) -> Column:
    """A list of whole numbers written out, such as ``[1, 2]`` or ``(1, 2)``; null if it is no such list."""
    return F.from_json(F.translate(F.trim(text), "()", "[]"), "array<bigint>", {"mode": "PERMISSIVE"})


# -- orders
def index_sorted(df: DataFrame, keys: list[str] = EDGE) -> DataFrame:
    return df.orderBy(*keys)


def first_of_each(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``by`` and the first values of ``order``: one aggregation, no sort."""
    return df.groupBy(by).agg(F.min(F.struct(*order)).alias("_e")).select(by, "_e.*")


def row_numbers(df: DataFrame, by: list[str], order: list[Column | str], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


# -- set algebra on keys
def minus(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def either(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).union(b.select(*keys)).distinct()


def one_way(edges: DataFrame) -> DataFrame:
    """Node pairs whose reverse is no edge."""
    pairs = edges.select("u", "v").distinct()
    return minus(pairs, pairs.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"])


# -- joins on the key, graphs as tables, views
def with_columns_of(edges: DataFrame, other: DataFrame, columns: list[str], keys: list[str] = EDGE) -> DataFrame:
    """Edges that are in both tables, with columns of the other."""
    return edges.join(other.select(*keys, *columns), keys)


def adjacency(edges: DataFrame, attributes: list[str]) -> DataFrame:
    """``u, adjacent``: of each node the edges that leave it, as an array."""
    return edges.groupBy("u").agg(F.collect_list(F.struct("v", "key", *attributes)).alias("adjacent"))


def from_adjacency(nodes: DataFrame) -> DataFrame:
    return nodes.select("u", F.explode("adjacent").alias("_e")).select("u", "_e.*")


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Tables under names that SQL can use."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
