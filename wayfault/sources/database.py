"""Load of result tables into a database: staged in parallel, then put in place with keys and references in one transaction.

Spark's writers commit each partition for itself, so rows go to staging tables first; a single connection then replaces the tables, adds primary and foreign
keys, clusters where the database can, and commits.  A failure leaves the former tables as they were.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfault.operators.validation import require_foreign_key, require_key

EDGE = ["u", "v", "key"]
PATH = ["path_u", "path_v", "path_key"]


@dataclass
class Table:
    """A table with its key and references (columns, to which table, its columns)."""

    name: str
    key: list[str]
    references: list[tuple[list[str], str, list[str]]] = field(default_factory=list)


REDUNDANCY = [
    Table("roadways", EDGE), Table("detours_info", EDGE, [(EDGE, "roadways", EDGE)]),
    Table("base_paths", [*EDGE, "path_edge_index"], [(EDGE, "detours_info", EDGE), (PATH, "roadways", EDGE)]),
    Table("detour_paths", [*EDGE, "path_edge_index"], [(EDGE, "detours_info", EDGE), (PATH, "roadways", EDGE)]),
]


def wkt(df: DataFrame) -> DataFrame:
    """``df`` with lines as well-known text, and other lists and structs as JSON."""
    def plain(f: T.StructField):
        c = F.col(f"`{f.name}`")
        k = f.dataType
        if isinstance(k, T.ArrayType) and isinstance(k.elementType, T.StructType) and k.elementType.names == ["x", "y"]:
            return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(c, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")")).alias(f.name)
        return F.to_json(c).alias(f.name) if isinstance(k, (T.ArrayType, T.StructType, T.MapType)) else c

    return df.select(*[plain(f) for f in df.schema.fields])


def checked(tables: dict[str, DataFrame], layout: list[Table]) -> None:
    """Keys and references hold before anything is written."""
    for t in layout:
        require_key(tables[t.name], t.key)
        for columns, other, theirs in t.references:
            parent = tables[other].select(*[F.col(b).alias(a) for a, b in zip(columns, theirs, strict=True)])
            require_foreign_key(tables[t.name], parent, columns)


def statements(layout: list[Table], schema: str, dialect: str) -> list[str]:
    """What the one transaction runs: former tables go (children first), staged ones take their names, keys and references are added."""
    q = lambda n: f'"{n}"'
    listed = lambda cs: ", ".join(map(q, cs))
    at = lambda n: f"{q(schema)}.{q(n)}"
    out = []
    for t in reversed(layout):
        out.append(f"DROP TABLE IF EXISTS {at(t.name)}")
    for t in layout:
        out.append(f"RENAME TABLE {at(t.name + '_staged')} TO {q(t.name)}" if dialect == "derby" else f"ALTER TABLE {at(t.name + '_staged')} RENAME TO {q(t.name)}")
        out += [f"ALTER TABLE {at(t.name)} ALTER COLUMN {q(c)} {'NOT NULL' if dialect == 'derby' else 'SET NOT NULL'}" for c in t.key]
        out.append(f"ALTER TABLE {at(t.name)} ADD CONSTRAINT {q(t.name + '_pk')} PRIMARY KEY ({listed(t.key)})")
    for t in layout:
        for n, (columns, other, theirs) in enumerate(t.references):
            out.append(f"ALTER TABLE {at(t.name)} ADD CONSTRAINT {q(f'{t.name}_fk{n}')} FOREIGN KEY ({listed(columns)}) REFERENCES {at(other)} ({listed(theirs)})")
    if dialect == "postgresql":
        out += [f"CLUSTER {at(t.name)} USING {q(t.name + '_pk')}" for t in layout]
    return out


def _existing(con, schema: str, names: list[str]) -> list[str]:
    found, rows = set(), con.getMetaData().getTables(None, schema, "%", None)
    while rows.next():
        found.add(rows.getString("TABLE_NAME"))
    return [n for n in names if n in found]


def load(spark: SparkSession, tables: dict[str, DataFrame], url: str, schema: str, properties: dict[str, str] | None = None, layout: list[Table] = REDUNDANCY) -> None:
    """Check, stage in parallel (each table clustered by its key), and put in place in one transaction."""
    properties = properties or {}
    checked(tables, layout)
    for t in layout:
        staged = wkt(tables[t.name]).repartitionByRange(*t.key).sortWithinPartitions(*t.key)
        staged.write.mode("overwrite").jdbc(url, f'"{schema}"."{t.name}_staged"', properties=properties)
    run(spark, url, schema, layout, properties)


def run(spark: SparkSession, url: str, schema: str, layout: list[Table], properties: dict[str, str]) -> None:
    dialect = url.split(":")[1]
    given = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    con = spark._jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        con.setAutoCommit(False)
        here = set(_existing(con, schema, [t.name for t in layout]))
        try:
            s = con.createStatement()
            for sql in statements(layout, schema, dialect):
                if sql.startswith("DROP TABLE IF EXISTS"):
                    name = sql.rsplit(".", 1)[1].strip('"')
                    if name not in here:
                        continue
                    sql = sql.replace("IF EXISTS ", "")
                s.executeUpdate(sql)
            con.commit()
        except Exception:
            con.rollback()
            raise
    finally:
        con.close()
