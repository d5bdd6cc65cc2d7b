"""Line deduplication by site-relative frequency.

Pages are grouped by host.  A line's ratio is the number of the host's pages that contain it over the number of the host's
pages; lines above ``ratio`` are boilerplate of the site and are dropped from all its pages.  Lines are compared without
the white space around them; blank lines are never counted or dropped.

A line of one page only is no repetition, whatever its ratio, so ``min_copies`` pages must contain it; no number of pages is too small otherwise.

Lines are counted as 128-bit hashes, once a page, summed before the shuffle.  A host has at most (lines of a page on
average / ``ratio``) boilerplate lines, so its list is small whatever its number of pages.  Lists of hosts that hold
a large share of all pages, at most 256 of them, are broadcast if they have no more than ``BROADCAST`` lines together; larger ones are repeated for
``SALTS`` classes of pages.  Pages of other hosts meet theirs in a join.

Defined results: a null or empty text stays as it is, with no lines; a null or empty host is no site, its pages stay as they are;
repeated rows count as
pages of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfault.llm.common import HOT_SHARE, lookup, materialise

RATIO = 0.3
MIN_COPIES = 2
BROADCAST = 1 << 20  # lines of 16 bytes
SALTS = 64
BLANK = " \t\n\x0b\x0c\r"


def visible_lines(html: Column) -> Column:
    """Text of a page with scripts, styles, comments and tags as line ends."""
    return F.regexp_replace(html, r"(?s)<(?:!--.*?-->|script.*?</script>|style.*?</style>|[^>]*>)", "\n")


def line_key(line: Column) -> Column:
    """Two independent 64-bit hashes."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def line_keys(text: Column) -> Column:
    """Array of structs ``line, key`` of the lines of a text; the key is null for a blank line."""
    bare = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.btrim(x, F.lit(BLANK)).alias("bare")))
    return F.transform(bare, lambda x: F.struct(x["line"].alias("line"), F.when(x["bare"] != "", line_key(x["bare"])).alias("key")))


def drop_boilerplate(pages: DataFrame, id_col: str = "page_id", host: str | Column = "host", text: str | Column = "text", ratio: float = RATIO, min_copies: int = MIN_COPIES) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text`` of every row."""
    at = lambda c: F.col(c) if isinstance(c, str) else c
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(at(host).cast("string"), F.lit("")).alias("host"), at(text).cast("string").alias("text"))
    rows = rows.withColumn("lines", line_keys(F.col("text")))
    hashed = rows.select("host", F.array_distinct(F.filter("lines.key", lambda k: k.isNotNull())).alias("keys"))
    totals = materialise(hashed.groupBy("host").agg(F.count(F.lit(1)).alias("total")), "hosts")
    counted = hashed.where("host <> ''").select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    over = counted.where(F.col("n") >= min_copies).join(totals, "host").where(F.col("n") > ratio * F.col("total"))
    lists = over.groupBy("host").agg(F.collect_list("key").alias("boilerplate"))
    sites = materialise(totals.join(lists, "host", "left"), "sites")
    n_rows = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    hot = F.col("total") >= max(1000, n_rows * HOT_SHARE)
    listed = sites.where(hot).agg(F.coalesce(F.sum(F.size("boilerplate")), F.lit(0))).first()[0]
    if listed <= BROADCAST:
        found = lookup(rows, sites, "host", "total", n_rows)
    else:
        salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0))))
        spread = rows.join(F.broadcast(sites.where(hot).select("host", F.lit(SALTS).alias("salts"))), "host", "left")
        found = spread.withColumn("salt", F.pmod(F.xxhash64("page_id", "text"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts").join(salted, ["host", "salt"]).drop("salt")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    found = found.withColumn("boilerplate", F.coalesce("boilerplate", none))
    found = found.withColumn("kept", F.filter("lines", lambda x: x["key"].isNull() | ~F.array_contains("boilerplate", x["key"])))
    full = F.filter("lines", lambda x: x["key"].isNotNull())
    return found.select(
        "page_id", "host", F.coalesce(F.size(full), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.size("boilerplate") == 0, F.col("text")).otherwise(F.array_join(F.col("kept.line"), "\n")).alias("text"),
    )
