"""Network simplification: chains of edges between endpoints become one edge; checks and way slices of the result.

A node is an endpoint unless it has exactly two neighbours and either one edge in and one out, or two in and two out (Boeing 2017).  Chains are
ranked by pointer jumping over edges, a logarithmic number of joins in the longest chain; a ring without an endpoint begins at its smallest node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfault.operators.components import components
from wayfault.operators.scratch import cut
from wayfault.operators.spans import runs

EDGE = ["u", "v", "key"]
TOLERANCE = 1e-6
ALIGNMENT = 1e-12


def endpoints(base: DataFrame) -> DataFrame:
    """``node_id`` of the endpoints of ``u, v, key`` edges."""
    ends = base.select(F.col("u").alias("node_id"), F.col("v").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(base.select("v", "u", F.lit(0), F.lit(1)))
    stats = ends.groupBy("node_id").agg(F.countDistinct("other").alias("n"), F.sum("o").alias("o"), F.sum("i").alias("i"), F.max((F.col("node_id") == F.col("other")).cast("int")).alias("loop"))
    inner = (F.col("n") == 2) & (F.col("loop") == 0) & (((F.col("o") == 1) & (F.col("i") == 1)) | ((F.col("o") == 2) & (F.col("i") == 2)))
    marked = cut(stats.select("node_id", (~inner).alias("end")))
    labels = components(marked.select("node_id"), base)
    rings = labels.join(marked, "node_id").groupBy("component").agg(F.max(F.col("end").cast("int")).alias("any")).where("any = 0").select(F.col("component").alias("node_id"))
    return marked.where("end").select("node_id").union(rings)


def chains(base: DataFrame) -> DataFrame:
    """``base`` edges with ``head_u, head_v, head_key`` (the first edge of the chain) and ``pos``."""
    ends = cut(endpoints(base))
    rows = base.select(*EDGE, F.struct(*[F.col(c) for c in EDGE]).alias("e"))
    inner = rows.join(ends.withColumnRenamed("node_id", "u"), "u", "left_anti").select(F.col("e").alias("e"), F.col("u").alias("via"), F.col("v").alias("to"))
    before = rows.select(F.col("e").alias("p"), F.col("u").alias("of"), F.col("v").alias("via_p"))
    link = inner.join(before, (F.col("via") == F.col("via_p")) & (F.col("of") != F.col("to"))).select("e", "p")
    jump = cut(rows.select("e").join(link, "e", "left").select("e", F.col("p").alias("anc"), F.when(F.col("p").isNotNull(), 1).otherwise(0).cast("long").alias("pos"), F.coalesce("p", "e").alias("head")))
    while not jump.where("anc IS NOT NULL").isEmpty():
        far = jump.select(F.col("e").alias("a"), F.col("anc").alias("anc2"), F.col("pos").alias("pos2"), F.col("head").alias("head2"))
        grown = jump.join(far, F.col("anc") == F.col("a"), "left")
        jump = cut(grown.select("e", F.col("anc2").alias("anc"), (F.col("pos") + F.coalesce("pos2", F.lit(0))).alias("pos"), F.coalesce("head2", "head").alias("head")))
    return base.withColumn("_e", F.struct(*[F.col(c) for c in EDGE])).join(jump, F.col("_e") == F.col("e")).select(base["*"], "head", "pos")


def simplify(base: DataFrame, nodes: DataFrame, tags: tuple[str, ...] = ("osmid", "ref", "name", "bridge", "tunnel")) -> DataFrame:
    """``u, v, key, length, merged_edges, geometry`` and the distinct values of each tag, in order along the edge."""
    tags = tuple(t for t in tags if t in base.columns)
    at = nodes.select(F.col("node_id").alias("_n"), F.struct("x", "y").alias("_p"))
    rows = chains(base).join(at.withColumnsRenamed({"_n": "u", "_p": "pu"}), "u", "left").join(at.withColumnsRenamed({"_n": "v", "_p": "pv"}), "v", "left")
    item = F.struct("pos", "u", "v", "length", "pu", "pv", *tags)
    out = rows.groupBy("head").agg(F.collect_list(item).alias("_raw"), F.sum("length").alias("length"))
    out = out.withColumn("_s", F.array_sort("_raw", lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)))
    out = out.select(
        F.col("_s")[0]["u"].alias("u"), F.element_at("_s", -1)["v"].alias("v"), "head", "length", F.transform("_s", lambda s: F.struct(s["u"].alias("u"), s["v"].alias("v"))).alias("merged_edges"),
        F.concat(F.array(F.col("_s")[0]["pu"]), F.transform("_s", lambda s: s["pv"])).alias("geometry"),
        *[F.array_distinct(F.filter(F.col(f"_s.{t}"), lambda x: x.isNotNull())).alias(t) for t in tags],
    )
    return out.withColumn("key", F.row_number().over(Window.partitionBy("u", "v").orderBy("head")).cast("long") - 1).drop("head").select("u", "v", "key", "length", "merged_edges", "geometry", *tags)


def alignment_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``u, v, key, problem`` of edges whose chain, ends, number of vertices, or vertex places do not fit."""
    m, g = F.col("merged_edges"), F.col("geometry")
    breaks = F.exists(F.sequence(F.lit(1), F.greatest(F.size(m) - 1, F.lit(1))), lambda i: (i < F.size(m)) & (F.get(m, i)["u"] != F.get(m, i - 1)["v"]))
    problems = F.array(
        F.when(F.coalesce(F.size(m), F.lit(0)) < 1, "no base edges"), F.when(breaks, "broken chain"), F.when((F.get(m, F.lit(0))["u"] != F.col("u")) | (F.try_element_at(m, F.lit(-1))["v"] != F.col("v")), "ends differ"),
        F.when(F.size(g) != F.size(m) + 1, "number of vertices"),
    )
    direct = edges.select(*EDGE, F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))
    vertices = edges.select(*EDGE, F.posexplode(F.concat(F.array(F.get(m, F.lit(0))["u"]), F.transform(m, lambda e: e["v"]))).alias("i", "node_id"), g.alias("g")).withColumn("p", F.get("g", F.col("i")))
    placed = vertices.join(nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny")), "node_id", "left")
    off = placed.where("p IS NULL OR nx IS NULL OR abs(p.x - nx) > 1e-12 OR abs(p.y - ny) > 1e-12").select(*EDGE).distinct().withColumn("problem", F.lit("vertex is not at its node"))
    return direct.unionByName(off)


def oriented(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lines of two points that run against their edge are turned."""
    start = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    rows = edges.join(start, "u", "left")
    first, last = F.col("geometry")[0], F.element_at("geometry", -1)
    near = lambda p: (F.abs(p["x"] - F.col("_x")) <= ALIGNMENT) & (F.abs(p["y"] - F.col("_y")) <= ALIGNMENT)
    flip = (F.size("geometry") == 2) & ~near(first) & near(last)
    return rows.withColumn("geometry", F.when(flip, F.reverse("geometry")).otherwise(F.col("geometry"))).select(*edges.columns)


CHOICE = "struct<osmid:bigint,length:double,ref:string,name:string,bridge_tag:string,tunnel_tag:string>"
STEP = "struct<osmid:bigint,ref:string,name:string,bridge_tag:string,tunnel_tag:string,mu:bigint,mv:bigint,start:double,end:double,start_idx:int,end_idx:int>"


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def chosen_way(choices: Column, seen: Column, last: Column, where: Column) -> Column:
    """The way of a base pair: bridges go before others; of several those seen before on the edge, then the last one; else the first bridge."""
    def pick(some: Column, also) -> Column:
        return F.when(F.size(some) > 1, F.filter(some, also)).otherwise(some)

    def decide(bridges: Column) -> Column:
        left = let(F.when(F.size(bridges) > 0, bridges).otherwise(choices), lambda c: pick(c, lambda w: F.array_contains(seen, w["osmid"])))
        left = let(left, lambda c: pick(c, lambda w: F.coalesce(w["osmid"] == last, F.lit(False))))
        return let(left, lambda c: let(F.when(F.size(c) > 0, c).otherwise(F.slice(bridges, 1, 1)), one))

    def one(left: Column) -> Column:
        none = F.raise_error(F.concat(F.lit("no way for "), where))
        many = F.raise_error(F.concat(F.lit("more than one way for "), where))
        return F.when(F.size(left) == 0, none).when(F.size(F.array_distinct(F.transform(left, lambda w: w["osmid"]))) > 1, many).otherwise(left[0])

    return let(F.filter(choices, lambda w: w["bridge_tag"].isNotNull()), decide)


def steps_along(items: Column, where: Column) -> Column:
    """The chosen way of each base pair of an edge with lengths and vertices before and after it (array of ``STEP``).

    A pair whose vertices are in one place must have no length, and adds neither a vertex nor a length.
    """
    state = f"struct<seen:array<bigint>,along:double,idx:int,steps:array<{STEP}>>"
    empty = F.from_json(F.lit('{"seen":[],"along":0.0,"idx":0,"steps":[]}'), state)

    def step(acc: Column, it: Column) -> Column:
        def add(w: Column) -> Column:
            bad = it["same"] & (w["length"] >= TOLERANCE)
            along = F.when(bad, F.raise_error(F.concat(F.lit("a repeated vertex has a length: "), where)).cast("double")).when(it["same"], acc["along"]).otherwise(acc["along"] + w["length"])
            idx = F.when(it["same"], acc["idx"]).otherwise(acc["idx"] + 1)
            new = F.struct(
                w["osmid"].alias("osmid"), w["ref"].alias("ref"), w["name"].alias("name"), w["bridge_tag"].alias("bridge_tag"), w["tunnel_tag"].alias("tunnel_tag"), it["mu"].alias("mu"), it["mv"].alias("mv"),
                acc["along"].alias("start"), along.alias("end"), acc["idx"].alias("start_idx"), idx.alias("end_idx"),
            ).cast(STEP)
            return F.struct(F.array_append(acc["seen"], w["osmid"]).alias("seen"), along.alias("along"), idx.cast("int").alias("idx"), F.array_append(acc["steps"], new).alias("steps")).cast(state)

        return let(chosen_way(it["choices"], acc["seen"], F.try_element_at(acc["steps"], F.lit(-1))["osmid"], where), add)

    return F.aggregate(items, empty, step, lambda acc: acc["steps"])


def way_slices(edges: DataFrame, base: DataFrame) -> DataFrame:
    """Way slices along each edge: ``u, v, key, coord_idx, way_along``; ``coord_idx`` are the vertices that stay, repeated ones having gone.

    The way of a base pair depends on the ways before it, so an edge's pairs are folded in order (``steps_along``); runs of one way are then a slice.  A bridge
    tag counts unless it is "no", a tunnel tag if it is "yes", in any case of letters.  Edges whose ways are ambiguous or missing, whose lengths do not
    add up, or that lose a bridge with the slices of no length, are errors.
    """
    own = edges.select(*EDGE, F.col("length").alias("edge_length"), F.col("osmid").alias("_osmids"), F.col("geometry").alias("_g"), F.posexplode("merged_edges").alias("pos", "_m"))
    own = own.select(*EDGE, "edge_length", "_osmids", "pos", F.col("_m.u").alias("mu"), F.col("_m.v").alias("mv"), F.coalesce(F.get("_g", F.col("pos")) == F.get("_g", F.col("pos") + 1), F.lit(False)).alias("same"))
    bridge, tunnel = F.col("bridge"), F.col("tunnel")
    tags = (F.when(F.lower(bridge) != "no", bridge).alias("bridge_tag"), F.when(F.lower(tunnel) == "yes", "yes").alias("tunnel_tag"))
    ways = base.select(F.col("u").alias("mu"), F.col("v").alias("mv"), F.struct(F.col("osmid").cast("long").alias("osmid"), "length", "ref", "name", *tags).cast(CHOICE).alias("way"))
    rows = own.join(ways, ["mu", "mv"], "left").repartition(*EDGE)  # one exchange for both groupings
    rows = rows.withColumn("way", F.when(F.array_contains("_osmids", F.col("way.osmid")), F.col("way")))
    pairs = rows.groupBy(*EDGE, "edge_length", "pos", "mu", "mv", "same").agg(F.array_sort(F.collect_list("way")).alias("choices"))
    whole = pairs.groupBy(*EDGE, "edge_length").agg(F.array_sort(F.collect_list(F.struct("pos", "mu", "mv", "same", "choices"))).alias("_items"))
    where = F.concat_ws(" ", F.lit("edge"), "u", "v", "key")
    total = F.col("edge_length")
    at = whole.withColumn("_steps", F.when(total == 0, F.from_json(F.lit("[]"), f"array<{STEP}>")).otherwise(steps_along(F.col("_items"), where)))
    # runs of one way
    share = lambda x: F.round(x / total, 15)
    own_runs = runs(F.col("_steps"), lambda s: s["osmid"])

    def slice_of(r: Column) -> Column:
        first, last = r[0], F.element_at(r, -1)
        end = F.when((last["end"] > total) & (last["end"] < total * (1 + TOLERANCE)), F.lit(1.0)).otherwise(share(last["end"]))
        return F.struct(
            share(first["start"]).alias("start_ratio_along"), end.alias("end_ratio_along"), first["start_idx"].alias("start_coord_idx"), last["end_idx"].alias("end_coord_idx"), first["osmid"].alias("osmid"),
            first["ref"].alias("ref"), first["name"].alias("name"), first["bridge_tag"].alias("bridge_tag"), first["tunnel_tag"].alias("tunnel_tag"),
            F.concat(F.array(first["mu"]), F.transform(r, lambda s: s["mv"])).alias("osm_nodes"),
        )

    at = at.withColumn("_all", F.when(F.size("_steps") > 0, F.transform(own_runs, slice_of)).otherwise(F.transform(F.slice(own_runs, 1, 0), slice_of)))
    kept = F.filter("_all", lambda s: s["start_coord_idx"] < s["end_coord_idx"])
    bridges = lambda c: F.array_distinct(F.transform(F.filter(c, lambda s: s["bridge_tag"].isNotNull()), lambda s: s["osmid"]))
    along = F.coalesce(F.try_element_at("_steps", F.lit(-1))["end"], F.lit(0.0))
    problem = F.when(F.abs(along - total) > TOLERANCE, F.concat(F.lit("lengths of ways and edge differ: "), where)).when(F.size(bridges(F.col("_all"))) > F.size(bridges(kept)), F.concat(F.lit("a bridge has no length: "), where))
    places = F.filter(F.transform("_items", lambda it: F.when(~it["same"], it["pos"] + 1)), lambda p: p.isNotNull())
    coords = F.when(F.size("_steps") > 0, F.concat(F.array(F.lit(0)), places)).otherwise(F.array().cast("array<int>"))
    return at.select(*EDGE, coords.alias("coord_idx"), F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(kept).alias("way_along"))
