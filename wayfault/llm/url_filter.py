"""URL rules by a sort-merge range join, in DataFrame functions only.

A rule is a host and a path prefix; it fits its host and all subdomains.  Canonical keys reverse the labels of a
host (``www.example.com`` is ``com.example.www``), and a rule becomes the interval of keys that begin with
its reversed host, a mark that ends the host, and its path.  A url has one point for each host suffix that has a rule: that suffix
reversed, the mark, the url's path.  Rules and points are merged in key order; intervals of prefixes are nested or disjoint,
so the rules that can be active at a point are the last one that started and those around it: its stack.  Each rule's stack is
made beforehand, from the rules alone; the sweep carries the last one along.  The innermost rule of the stack that the point's key begins with is the
longest that fits.

Urls none of whose suffixes has a rule never enter the sweep: the suffixes of up to ``FEW`` rules' hosts, a number that is counted first, are tested in
place; more of them are met in a join.  The sweep runs apart for each reversed suffix, as no interval reaches beyond its own, and for each of as many classes of rows as
the suffix has blocks of ``ROWS`` points, with the suffix's rules repeated in each, so that neither a suffix nor a url shared by all rows is one task's work.  A block has at
least ``PER_RULE`` points for each of the suffix's rules, so repeating them adds little.

Defined results: a null url or one without ``://`` has an empty host and path, which no rule fits; rows without an id and repeated rows
are judged like others; a rule with a null host or path is ignored; of rules with equal host and path a block wins;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfault.llm.common import lower_ascii, place, positional

ROWS = 1000
PER_RULE = 16
FEW = 10_000
SPREAD = 1 << 16
DEFAULT = "allow"
#: Ends the reversed host in a key; no host or path has it at that place, and it sorts before their characters.
MARK = "\x01"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    return lower_ascii(F.coalesce(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def suffixes(host: Column, most: int) -> Column:
    """The host and its parent domains of at most ``most`` labels, each with its labels reversed."""
    labels = F.slice(F.reverse(F.split(host, r"\.")), 1, most)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, F.lit(1), i), "."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``suffix, path, stack``: each rule with the rules around it and itself, outermost first.

    The rules around a rule are those whose path is a prefix of its own; a stack is no longer than a path.
    """
    host = lower_ascii(F.col("host").cast("string"))
    clean = rules.where("host is not null and path is not null").groupBy(host.alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    own = clean.select(reversed_host(F.col("host")).alias("suffix"), "path", F.concat("host", "path").alias("rule"), "verdict")
    prefixes = own.select("suffix", F.col("path").alias("inner"), F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("path"))
    around = prefixes.join(own, ["suffix", "path"])
    return around.groupBy("suffix", "inner").agg(F.array_sort(F.collect_list(F.struct(key(F.col("suffix"), F.col("path")).alias("key"), "rule", "verdict"))).alias("stack")).withColumnRenamed("inner", "path")


def key(suffix: Column, path: Column) -> Column:
    return F.concat(suffix, F.lit(MARK), path)


STACK = "array<struct<key:string,rule:string,verdict:string>>"


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, salts: int = 1) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; ``rules`` has host, path, verdict (allow or block).

    ``rule`` is null and the verdict ``default`` where no rule fits; ``salts``: the least number of classes of rows that a suffix is swept in.
    """
    url, own = F.col("url"), positional(pages)
    base = own.select(F.col(place(pages, id_col)).cast("long").alias("page_id"), F.col(place(pages, url_col)).cast("string").alias("url"))
    rows = base.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    stacks = rule_stacks(rules)
    known = stacks.groupBy("suffix").agg(F.count(F.lit(1)).alias("rules"))
    n_known, most = known.agg(F.count(F.lit(1)), F.max(F.size(F.split("suffix", r"\.")))).first()
    without = [F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")]
    if not n_known:
        return rows.select("page_id", "host", "path", *without)
    near = suffixes(F.col("host"), most)
    if n_known <= FEW:
        listed = [r.suffix for r in known.collect()]
        near = F.filter(near, lambda s: s.isin(listed))
    rows = rows.withColumn("near", near).withColumn("row", F.monotonically_increasing_id())
    points = rows.where(F.size("near") > 0).select("row", "page_id", "host", "path", F.explode("near").alias("suffix"))
    counted = points.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))
    classes = known.join(counted, "suffix", "left").select("suffix", F.greatest(F.lit(salts), F.ceil(F.coalesce("n", F.lit(0)) / F.greatest(F.lit(ROWS), F.col("rules") * PER_RULE))).cast("int").alias("classes"))
    if n_known <= FEW:  # a number for each rule's host, taken to the driver and put into the plan as one constant
        many = {r.suffix: r.classes for r in classes.collect() if r.classes > 1}
        size = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("suffix")), F.lit(1)) if many else F.lit(1)
        points, starts = points.withColumn("classes", size), stacks.withColumn("classes", size)
    else:
        # suffixes without a rule are spread, and pass the sweep without meeting one
        points = points.join(classes, "suffix", "left").withColumn("classes", F.coalesce("classes", F.lit(SPREAD)))
        starts = stacks.join(classes, "suffix")
    points = points.select("suffix", F.pmod(F.xxhash64("row"), F.col("classes")).cast("int").alias("salt"), key(F.col("suffix"), F.col("path")).alias("key"), F.lit(None).cast(STACK).alias("stack"), "row", "page_id", "host", "path")
    starts = starts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("classes") - 1)))
    starts = starts.select("suffix", "salt", key(F.col("suffix"), F.col("path")).alias("key"), "stack", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    # a rule that starts at a point's key comes before it: nulls of ``row`` sort first
    sweep = Window.partitionBy("suffix", "salt").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = starts.unionByName(points).withColumn("started", F.last("stack", ignorenulls=True).over(sweep)).where("row is not null")
    active = F.filter("started", lambda r: F.startswith(F.col("key"), r["key"]))
    innermost = F.try_element_at(active, F.lit(-1))
    best = swept.select("row", "page_id", "host", "path", F.when(innermost.isNotNull(), F.struct(F.length(innermost["rule"]).alias("n"), innermost["rule"].alias("rule"), innermost["verdict"].alias("verdict"))).alias("fit"))
    one = best.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("fit").alias("fit"))
    judged = one.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
    if n_known <= FEW:
        return judged.unionByName(rows.where(F.size("near") == 0).select("page_id", "host", "path", *without))
    return judged
