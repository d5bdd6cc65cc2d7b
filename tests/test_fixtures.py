"""Hand-made inputs with known results, and operators without SQL against brute force."""

import itertools
import random
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wayfault.functions import geometry as G
from wayfault.functions import scalars as S
from wayfault.operators import centrality, components, flood, fusion, intervals, matching, paths, simplify, spans, validation
from wayfault.operators import linear_reference as lrs
from wayfault.sources import sinks


def one(spark, column, **values):
    """Value of a column expression over one row of typed literals."""
    row = spark.range(1).select(*[F.expr(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_merged_intervals(spark):
    t = lambda s: None if s is None else datetime.fromisoformat(f"2024-01-01T{s}:00")
    rows = [("A", "a", "10:00", "11:00"), ("A", "b", "10:30", "12:00"), ("A", "c", "12:00", "12:30"), ("A", "d", "14:00", "14:00"), ("A", "e", "15:00", "15:45"), ("B", "f", "09:00", None), ("C", "g", "08:00", "18:00"), ("C", "h", "09:00", "10:00"), ("C", "i", "17:00", "19:00")]
    df = spark.createDataFrame([(k, i, t(a), t(b)) for k, i, a, b in rows], "k string, id string, s timestamp_ntz, e timestamp_ntz")
    got = {r.k: (",".join(r.ids), r.n_intervals, r.hours) for r in intervals.outage_hours(df, ["k"], "s", "e", "id").collect()}
    assert got == {"A": ("a,b,c,e", 2, 3.25), "C": ("g,h,i", 1, 11.0)}


@pytest.mark.parametrize(
    ("category", "description", "kept"),
    [("WEATHER HAZARD", "any", True), ("construction", "Flood repair", True), ("maintenance", "work on Washout Road", False), ("maintenance", "Washout Rd washout repair", True), ("maintenance", "washout rd and washout road", True), ("incident", "flood", False)],
)
def test_relevance(spark, category, description, kept):
    assert one(spark, S.relevant_event(F.lit(category), F.lit(description))) is kept


def test_road_class(spark):
    def run(highways, services=None):
        arr = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<string>") if x is not None else F.lit(None).cast("array<string>")
        r = one(spark, S.road_class(arr(highways), arr(services)))
        return r.edge_min_roadclass, r.edge_max_roadclass, r.edge_highest_highway_type, r.edge_lowest_highway_type

    assert run(["motorway_link"]) == (0, 0, "motorway_link", "motorway_link")
    assert run(["secondary", "primary_link"]) == (2, 3, "primary_link", "secondary")
    assert run(["living_street"])[0] == 5
    assert run(["service"], ["driveway"])[0] == 8 and run(["service"], None)[0] == 7 and run(["service"], [None])[0] == 7
    assert run(["footway"]) == (None, None, None, None) and run([]) == (None, None, None, None)


def test_best_name(spark):
    e = spark.createDataFrame([(1, 4, None, "Elm", "residential"), (1, 2, "US 9", "Main", "primary"), (1, 0, None, None, "motorway"), (2, 0, None, None, "motorway"), (2, 2, "US 9", "Main", "primary"), (3, 2, "US 9", "Main", "primary")], "k int, edge_min_roadclass int, ref string, name string, edge_highest_highway_type string")
    assert {r.k: r.best_name for r in S.best_name(e, ["k"]).collect()} == {1: "US 9/Main", 2: "US 9/Main", 3: "US 9/Main"}
    omitted = {r.k: r.best_name for r in S.best_name(e.withColumn("o", F.lit("US 9/Main")), ["k"], "o").collect()}
    assert omitted == {1: "Elm", 2: "<motorway>", 3: None}


def test_tags(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, S.bridge_value(arr("no", None))) is None and one(spark, S.bridge_value(arr("viaduct", "yes"))) == "yes" and one(spark, S.bridge_value(arr("no", "viaduct"))) == "viaduct"
    assert one(spark, S.is_paved(F.lit(None).cast("array<string>"))) and not one(spark, S.is_paved(arr("asphalt", "Gravel"))) and one(spark, S.is_paved(arr("concrete")))
    assert one(spark, S.last_ref(arr("A", "", "B", None))) == "B" and one(spark, S.first_name(arr(None, "", "x", "y"))) == "x"


def test_units(spark):
    m = lambda v, u: one(spark, S.length_to_meters(F.lit(v).cast("double"), F.lit(u).cast("string")))
    assert m(10, "FT") == pytest.approx(3.048) and m(1, "miles") == pytest.approx(1609.344) and m(-9999, "M") is None and m(5, "NP") is None
    with pytest.raises(Exception, match="unknown unit"):
        m(5, "LY")
    assert one(spark, S.velocity_to_mps(F.lit(-8888.0), F.lit("FPS"))) is None


def test_region_names(spark):
    r = one(spark, S.region_name_parts(F.lit("/x/nonservice-roadways-buffer-10mi-county-36001_us-250101.osm.pbf")))
    assert (r.prefix, r.buffer_mi, r.geolevel, r.geoid) == ("nonservice-roadways-", 10, "county", "36001")
    r = one(spark, S.region_name_parts(F.lit("state-36")))
    assert (r.prefix, r.buffer_mi, r.geolevel, r.geoid, r.region) == (None, 0, "state", "36", "state-36")
    with pytest.raises(Exception, match="unknown county"):
        one(spark, S.county_code(F.lit("36002")))


def way(spark, tags, idx):
    cols = "start_ratio_along double, end_ratio_along double, start_coord_idx int, end_coord_idx int, osmid long, ref string, name string, bridge_tag string, osm_nodes array<bigint>"
    items = [(0.0, 1.0, a, b, i, None, None, t, [i, i + 1]) for i, (t, (a, b)) in enumerate(zip(tags, idx, strict=True))]
    line = [(float(i), 0.0) for i in range(6)]
    return spark.createDataFrame([(1, 2, 0, line, items)], f"u long, v long, key long, geometry array<struct<x:double,y:double>>, way_along array<struct<{cols.replace(' ', ':').replace(',:', ',')}>>")


def test_spans(spark):
    e = way(spark, [None, "yes", "viaduct", "no"], [(0, 1), (1, 2), (2, 3), (3, 5)])
    assert [(r.span_idx, r.start_coord_idx, r.end_coord_idx, len(r.geometry)) for r in spans.bridge_spans(e).collect()] == [(0, 1, 3, 3)]
    assert sorted((r.span_idx, r.start_coord_idx, r.end_coord_idx) for r in spans.nonbridge_spans(e).collect()) == [(0, 0, 1), (1, 3, 5)]


@pytest.mark.parametrize(
    "line, parts",
    [
        ([(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 3)]), ([(0, 0), (2, 0), (2, 2), (1, -1), (5, -1)], [(0, 2), (2, 4)]), ([(0, 0), (1, 0), (0, 0)], [(0, 1), (1, 2)]),
        ([(0, 0), (1, 0), (1, 1), (0, 0)], [(0, 2), (2, 3)]), ([(0, 0), (1, 0), (1, 1), (0, 0), (-1, 0)], [(0, 2), (2, 4)]),
    ],
)
def test_simple_ranges(line, parts):
    """A ring is no simple part: it is split before it closes."""
    assert spans.simple_ranges(line) == parts


# -- networks
def graph(seed, n=14, m=34, parallels=True):
    rng = random.Random(seed)
    edges = {}
    while len(edges) < m:
        u, v = rng.sample(range(n), 2)
        edges[u, v, rng.randrange(2) if parallels else 0] = rng.randrange(1, 9)
    return edges


def frame(spark, edges):
    return spark.createDataFrame([(*k, w) for k, w in edges.items()], "u long, v long, key long, travel_time long")


def all_paths(edges):
    """Distances by Floyd and Warshall, and numbers of shortest paths over node pairs (cheapest parallels count once)."""
    nodes = sorted({n for u, v, _ in edges for n in (u, v)})
    low = {}
    for (u, v, _), w in edges.items():
        low[u, v] = min(w, low.get((u, v), 1e9))
    dist = {(a, b): 0 if a == b else low.get((a, b), 1e9) for a in nodes for b in nodes}
    for k, a, b in itertools.product(nodes, repeat=3):
        dist[a, b] = min(dist[a, b], dist[a, k] + dist[k, b])
    count = {}
    for s in nodes:
        count[s, s] = 1
        for t in sorted(nodes, key=lambda t: dist[s, t]):
            if t != s and dist[s, t] < 1e9:
                count[s, t] = sum(count.get((s, u), 0) for u in nodes if (u, t) in low and dist[s, u] + low[u, t] == dist[s, t])
    return nodes, low, dist, count


@pytest.mark.parametrize("seed", range(3))
def test_centrality(spark, seed):
    edges = graph(seed)
    nodes, low, dist, count = all_paths(edges)
    n = len(nodes)
    df = frame(spark, edges)
    sums = centrality.path_sums(df)
    between = {r.node_id: r.node_betweenness_centrality for r in centrality.node_betweenness(df, sums).collect()}
    close = {r.node_id: r.closeness_centrality for r in centrality.closeness(df, sums).collect()}
    edge = {(r.u, r.v, r.key): r.edge_betweenness_centrality for r in centrality.edge_betweenness(df, sums).collect()}
    ok = lambda s, t: s != t and dist[s, t] < 1e9
    for x in nodes:
        want = sum(count[s, x] * count[x, t] / count[s, t] for s in nodes for t in nodes if x not in (s, t) and ok(s, t) and dist[s, x] + dist[x, t] == dist[s, t])
        assert between[x] == pytest.approx(want / ((n - 1) * (n - 2)))
        far = [dist[s, x] for s in nodes if ok(s, x)]
        assert close[x] == pytest.approx(len(far) / sum(far) * len(far) / (n - 1) if far else 0)
    for (u, v, k), w in edges.items():
        ties = sum(edges.get((u, v, q)) == low[u, v] for q in range(2))
        want = sum(count[s, u] * count[v, t] / count[s, t] for s in nodes for t in nodes if ok(s, t) and dist[s, u] < 1e9 and dist[v, t] < 1e9 and dist[s, u] + low[u, v] + dist[v, t] == dist[s, t])
        assert edge[u, v, k] == pytest.approx(want / ties / (n * (n - 1)) if w == low[u, v] else 0)


def test_small_centrality(spark):
    df = frame(spark, {(1, 2, 0): 1, (2, 3, 0): 1})
    sums = centrality.path_sums(df)
    assert {r.node_id: round(r.closeness_centrality, 6) for r in centrality.closeness(df, sums).collect()} == {1: 0, 2: 0.5, 3: 0.666667}
    assert {r.node_id: r.node_betweenness_centrality for r in centrality.node_betweenness(df, sums).collect()} == {1: 0, 2: 0.5, 3: 0}
    assert {(r.u, r.v): round(r.edge_betweenness_centrality, 6) for r in centrality.edge_betweenness(df, sums).collect()} == {(1, 2): 0.333333, (2, 3): 0.333333}
    with pytest.raises(ValueError, match="not one of"):
        centrality.metric(df, "laplacian")
    with pytest.raises(ValueError, match="max_edges"):
        centrality.path_sums(df, max_edges=1)


def test_louvain():
    clique = lambda a: [(x, y, 5.0) for x in range(a, a + 4) for y in range(a, a + 4) if x != y]
    got = centrality.louvain([*clique(0), *clique(10), (3, 10, 1.0)])
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(10, 14)}) == 1 and got[0] != got[10]


@pytest.mark.parametrize("seed", range(2))
def test_shortest_paths(spark, seed):
    edges = graph(seed)
    nodes, _, dist, _ = all_paths(edges)
    q = [(f"{a}>{b}", a, b) for a in nodes[:4] for b in nodes if a != b]
    got = {r["query"]: r for r in paths.shortest_paths(frame(spark, edges), spark.createDataFrame(q, "query string, origin long, destination long")).collect()}
    for name, a, b in q:
        if dist[a, b] >= 1e9:
            assert name not in got
            continue
        r = got[name]
        chain = [(e.u, e.v, e.key) for e in r.path]
        assert r.cost == dist[a, b] == sum(edges[e] for e in chain)
        assert chain[0][0] == a and chain[-1][1] == b and all(x[1] == y[0] for x, y in zip(chain, chain[1:], strict=False))


def test_detour(spark):
    rows = [(1, 2, 0, 10.0, 0.1, "A", True), (1, 3, 0, 8.0, 0.2, "B", True), (3, 2, 0, 8.0, 0.2, "C", True)]
    cols = "u long, v long, key long, travel_time double, length_mi double, name string, is_paved boolean"

    def run(rows):
        e = spark.createDataFrame(rows, cols).withColumn("ref", F.lit(None).cast("string"))
        return paths.redundancy(e, e.where("u = 1 AND v = 2")).first()

    r = run(rows)
    assert (r.base_sec, r.base_mi, r.detour_sec, r.detour_mi, r.difference_sec, r.difference_miles, r.ratio) == (10, 0.1, 16, 0.4, 6, 0.3, 1.6)
    r = run(rows[:2])
    assert (r.base_sec, r.detour_sec, r.difference_sec, r.ratio) == (10, None, None, None)
    r = run([*rows[:2], (*rows[2][:6], False)])  # an unpaved road is no detour
    assert r.detour_sec is None


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    nodes = sorted({x for e in edges for x in e} | {999})
    label = {x: x for x in nodes}
    for _ in nodes:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    got = components.components(spark.createDataFrame([(x,) for x in nodes], "node_id long"), spark.createDataFrame(edges, "u long, v long"))
    assert {r.node_id: r.component for r in got.collect()} == label


def test_pruned_bridges(spark):
    key = "u long, v long, key long"
    pruned, left = flood.prune_bridges(spark.createDataFrame([(1, 2, 0)], key), spark.createDataFrame([(4, 5, 0)], key), spark.createDataFrame([(2, 3, 0), (3, 4, 0)], key))
    assert sorted(map(tuple, pruned.collect())) == [(2, 3, 0), (3, 4, 0)] and left.count() == 0


def brute_impacts(edges, surface, bridges, levels):
    """The level loop over sets, for graphs with few edges."""
    def apart(nodes, pairs):
        label = {x: x for x in nodes}
        for _ in nodes:
            for u, v, _ in pairs:
                if u in label and v in label:
                    label[u] = label[v] = min(label[u], label[v])
        sizes = defaultdict(int)
        for c in label.values():
            sizes[c] += 1
        best = min(sizes, key=lambda c: (-sizes[c], c))
        return {x for x, c in label.items() if c != best}

    und = lambda es: {(min(u, v), max(u, v), k) for u, v, k in es}
    s, b = set(surface), set(bridges) - set(surface)
    nodes = {x for u, v, _ in edges for x in (u, v)}
    g, out, reasons = und(edges), {}, {}
    first = apart(nodes, g)
    isolated = {e: -1 for e in edges if e[0] in first}
    nodes -= first
    g = {e for e in g if e[0] not in first}
    for level in sorted(set(levels.values())):
        flooded = {e for e, x in levels.items() if x == level}
        s -= flooded
        un, vn = {e[0] for e in flooded} - {e[0] for e in s}, {e[1] for e in flooded} - {e[1] for e in s}
        pruned = set()
        while p := {e for e in b if e[0] in vn or e[1] in un}:
            b -= p
            pruned |= p
            un |= {e[0] for e in p} - {e[0] for e in b | s}
            vn |= {e[1] for e in p} - {e[1] for e in b | s}
        for e in flooded:
            reasons[e] = ("FLOODED", level)
        for e in pruned:
            reasons[e] = ("BRIDGE_FUNCTIONALLY_DISCONNECTED", level)
        g -= und(flooded | pruned)
        for e in s | b:
            if e[0] in apart(nodes, g):
                isolated.setdefault(e, level)
    for e in edges:
        out[e] = (*reasons.get(e, ("NOT_IMPACTED", None)), isolated.get(e))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_impacts(spark, seed):
    rng = random.Random(seed)
    edges = list(graph(seed, 16, 30, parallels=False))
    bridges = {e for e in edges if rng.random() < 0.35}
    surface = [e for e in edges if e not in bridges]
    levels = {e: rng.choice([4, 11, 14]) for e in surface if rng.random() < 0.4}
    key = "u long, v long, key long"
    df = lambda rows, s=key: spark.createDataFrame(list(rows), s)
    got = flood.impacts(df(edges), df(surface), df(bridges), df([(*e, 0, x) for e, x in levels.items()], f"{key}, span_idx int, level int"))
    assert {(r.u, r.v, r.key): (r.nonfunctional_reason, r.nonfunctional_risk_level, r.isolated_edge_risk_level) for r in got.collect()} == brute_impacts(edges, surface, bridges, levels)


def test_simplify(spark):
    # 1 - 2 - 3 two-way, 3 -> 4 -> 5 one-way, a ring 10 -> 11 -> 12 -> 10
    pairs = [(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 5), (10, 11), (11, 12), (12, 10), (3, 6), (6, 3)]
    base = spark.createDataFrame([(u, v, 0, u + v, float(u + v), None, None, None, None) for u, v in pairs], "u long, v long, key long, osmid long, length double, bridge string, tunnel string, ref string, name string")
    nodes = spark.createDataFrame([(x, float(x), 0.0) for p in pairs for x in p], "node_id long, x double, y double").distinct()
    s = simplify.simplify(base, nodes)
    assert {(r.u, r.v, r.key): (r.length, [tuple(m) for m in r.merged_edges], [p.x for p in r.geometry]) for r in s.collect()} == {
        (1, 3, 0): (8, [(1, 2), (2, 3)], [1, 2, 3]), (3, 1, 0): (8, [(3, 2), (2, 1)], [3, 2, 1]), (3, 5, 0): (16, [(3, 4), (4, 5)], [3, 4, 5]),
        (10, 10, 0): (66, [(10, 11), (11, 12), (12, 10)], [10, 11, 12, 10]), (3, 6, 0): (9, [(3, 6)], [3, 6]), (6, 3, 0): (9, [(6, 3)], [6, 3]),
    }
    assert simplify.alignment_violations(s, nodes).count() == 0
    assert {r.problem for r in simplify.alignment_violations(s.withColumn("u", F.col("u") + 1), nodes).collect()} == {"ends differ"}
    flipped = s.withColumn("geometry", F.reverse("geometry"))
    assert simplify.alignment_violations(simplify.oriented(flipped, nodes).where("size(geometry) = 2"), nodes).count() == 0


def sliced(spark, ways, pairs, length, geometry=None, osmids=None):
    """Way slices of one edge 0 - 1 - … from base rows ``(at, osmid, length, bridge, tunnel)``."""
    n = len(pairs)
    base = spark.createDataFrame([(i, i + 1, 0, o, x, None, None, b, t) for i, o, x, b, t in ways], "u long, v long, key long, osmid long, length double, ref string, name string, bridge string, tunnel string")
    line = geometry or [(float(i), 0.0) for i in range(n + 1)]
    row = (0, n, 0, length, pairs, line, osmids or sorted({w[1] for w in ways}))
    edges = spark.createDataFrame([row], "u long, v long, key long, length double, merged_edges array<struct<u:bigint,v:bigint>>, geometry array<struct<x:double,y:double>>, osmid array<bigint>")
    (r,) = simplify.way_slices(edges, base).collect()
    return r.coord_idx, [(s.osmid, s.start_coord_idx, s.end_coord_idx, s.bridge_tag, s.tunnel_tag) for s in r.way_along], r.way_along


def test_way_slices(spark):
    three = [(0, 1), (1, 2), (2, 3)]
    ways = [(0, 7, 1.0, None, None), (1, 7, 1.0, None, None), (1, 8, 1.0, "yes", None), (2, 7, 1.0, None, None), (2, 9, 1.0, None, None)]
    coords, slices, rows = sliced(spark, ways, three, 3.0)
    assert coords == [0, 1, 2, 3] and slices == [(7, 0, 1, None, None), (8, 1, 2, "yes", None), (7, 2, 3, None, None)]  # the bridge, then the way seen before
    assert [(s.start_ratio_along, s.end_ratio_along, s.osm_nodes) for s in rows] == [(0.0, pytest.approx(1 / 3), [0, 1]), (pytest.approx(1 / 3), pytest.approx(2 / 3), [1, 2]), (pytest.approx(2 / 3), 1.0, [2, 3])]
    with pytest.raises(Exception, match="lengths of ways and edge differ"):
        sliced(spark, ways, three, 4.0)
    assert sliced(spark, ways, three, 0.0)[:2] == ([], [])
    seen_twice = sliced(spark, [*ways, (2, 8, 1.0, None, None)], three, 3.0)  # both were seen before, the last way goes on
    assert seen_twice[1] == [(7, 0, 1, None, None), (8, 1, 3, "yes", None)]
    with pytest.raises(Exception, match="no way"):  # nothing tells the first two apart
        sliced(spark, [(0, 7, 1.0, None, None), (0, 9, 1.0, None, None), *ways[1:]], three, 3.0)
    with pytest.raises(Exception, match="no way"):
        sliced(spark, ways[:3], three, 3.0)


def test_way_slices_tags_and_repeated_vertices(spark):
    two = [(0, 1), (1, 2)]
    plain = [(0, 7, 1.0, "No", "YES"), (1, 8, 1.0, "Viaduct", "no")]
    assert sliced(spark, plain, two, 2.0)[1] == [(7, 0, 1, None, "yes"), (8, 1, 2, "Viaduct", None)]
    three, line = [(0, 1), (1, 2), (2, 3)], [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (2.0, 0.0)]
    ways = [(0, 7, 1.0, None, None), (1, 7, 0.0, None, None), (2, 7, 1.0, None, None)]
    coords, slices, rows = sliced(spark, ways, three, 2.0, line)
    assert coords == [0, 1, 3] and slices == [(7, 0, 2, None, None)] and rows[0].osm_nodes == [0, 1, 2, 3]
    with pytest.raises(Exception, match="repeated vertex"):
        sliced(spark, [ways[0], (1, 7, 0.5, None, None), ways[2]], three, 2.0, line)
    with pytest.raises(Exception, match="bridge has no length"):
        sliced(spark, [ways[0], (1, 8, 0.0, "yes", None), ways[2]], three, 2.0, line)


# -- linear reference, matching
def test_overlap_and_points(spark):
    m = spark.createDataFrame([(1, "R", 5.0, 3.0)], "_idx_ long, route_id string, min_from_mi double, max_to_mi double")
    ev = lambda *r: spark.createDataFrame([("R", *x, None) for x in r], "event_route_id string, from_measure double, to_measure double, to_date string")
    for width in (None, 0.7):
        assert [r.overlap_mi for r in lrs.overlap_join(m, ev((2.0, 4.0), (5.0, 6.0)), width).collect()] == [1.0]
    p = spark.createDataFrame([("R", 5.0, None), ("R", 5.1, None)], "event_route_id string, measure double, to_date string")
    assert [r.measure for r in lrs.point_join(m, p).collect()] == [5.0]


def test_best_route_and_fill(spark):
    cols = "u long, v long, key long, route_id string, reversed_input boolean, from_mi double, to_mi double, ratio_covered double, score double"
    em = spark.createDataFrame([(1, 2, 0, "P", False, 1.0, 2.0, 0.7, 0.7), (1, 2, 0, "Q", False, 0.0, 1.0, 0.9, 0.7), (1, 2, 0, "Q", False, 1.0, 2.0, 0.5, 0.7)], cols)
    best = lrs.best_route(em)
    assert [(r.route_id, round(r.penalty, 6)) for r in best.collect()] == [("P", 0.3)]
    edges = spark.createDataFrame([(1, 2, 0), (2, 1, 0), (3, 4, 0)], "u long, v long, key long")
    got = {(r.u, r.v): (r.route_id, r.min_from_mi, r.max_to_mi, r.score, r.reversed_input, r.match_type) for r in lrs.fill_reverse(best, edges).collect()}
    assert got == {(1, 2): ("P", 1.0, 2.0, 0.7, False, "direct"), (2, 1): ("P", 2.0, 1.0, None, True, "filled_reverse")}


@pytest.mark.parametrize(("legs", "chain"), [([[1, 2, 3], [3, 4, 5]], [1, 2, 3, 4, 5]), ([[1, 2, 3], [4, 5]], [1, 2, 3, 4, 5]), ([[1, 2, 3, 2], [3, 2, 6]], [1, 2, 3, 2, 6]), ([[1, 2], [], [2, 3]], [1, 2, 3])])
def test_chains(spark, legs, chain):
    df = spark.createDataFrame([(1, 0, i, n) for i, n in enumerate(legs)], "trace_id long, matching_idx int, leg_idx int, nodes array<bigint>")
    assert matching.node_chains(df).first().nodes == chain


def test_matcher(spark):
    streets = [(i, i + 1) for i in range(5)] + [(i + 1, i) for i in range(5)]
    e = spark.createDataFrame([(u, v, 0, u * 100.0, 0.0, v * 100.0, 0.0) for u, v in streets] + [(50, 51, 0, 9000.0, 0.0, 9100.0, 0.0)], "u long, v long, key long, x1 double, y1 double, x2 double, y2 double")
    pts = [(1, i, x, 3.0) for i, x in enumerate([20.0, 150.0, 260.0, 390.0])] + [(2, 0, 350.0, -2.0), (2, 1, 120.0, 1.0), (3, 0, 20.0, 0.0), (3, 1, 9020.0, 0.0), (4, 0, 5e5, 5e5)]
    got = defaultdict(list)
    for r in matching.match(spark.createDataFrame(pts, "trace_id long, idx int, x double, y double"), e).orderBy("trace_id", "idx").collect():
        got[r.trace_id].append(r)
    assert [(r.u, r.v, r.matching_idx, r.waypoint_idx) for r in got[1]] == [(0, 1, 0, 0), (1, 2, 0, 1), (2, 3, 0, 2), (3, 4, 0, 3)]
    assert got[1][1].nodes == [0, 1, 2] and got[1][0].nodes is None and got[1][0].confidence == pytest.approx(1)
    assert [(r.u, r.v) for r in got[2]] == [(4, 3), (2, 1)] and got[2][1].nodes == [4, 3, 2, 1]
    assert [(r.matching_idx, r.waypoint_idx) for r in got[3]] == [(0, 0), (1, 0)] and 4 not in got


def test_frechet(spark):
    def far(p, q):
        return ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5

    def brute(a, b):
        if len(a) == 1 or len(b) == 1:
            return max(far(p, q) for p in a for q in b)
        return max(far(a[-1], b[-1]), min(brute(a[:-1], b), brute(a, b[:-1]), brute(a[:-1], b[:-1])))

    rng = random.Random(3)
    cases = [([(0, 0), (1, 0)], [(0, 1), (1, 1)]), ([(0, 0), (5, 0)], [(0, 0), (2, 4), (5, 0)])]
    cases += [tuple([(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(1, 6))] for _ in "ab") for _ in range(20)]
    to = lambda line: [(float(x), float(y)) for x, y in line]
    df = spark.createDataFrame([(i, to(a), to(b)) for i, (a, b) in enumerate(cases)] + [(99, [], to(cases[0][0])), (100, None, to(cases[0][0]))], "i int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    got = {r.i: r.frechet for r in matching.frechet(df, "a", "b").collect()}
    assert got.pop(99) is None and got.pop(100) is None
    assert got == {i: pytest.approx(brute(a, b)) for i, (a, b) in enumerate(cases)}


def test_responses(spark):
    body = '{"code":"Ok","tracepoints":[{"location":[1.0,2.0],"distance":0.5,"matchings_index":0,"waypoint_index":0},null,{"location":[1.1,2.0],"distance":0.1,"matchings_index":0,"waypoint_index":1}],"matchings":[{"confidence":0.8,"legs":[{"annotation":{"nodes":[5,6],"distance":[3.0],"duration":[1.0]}}]}]}'
    points, legs, matchings, errors = matching.parse_responses(spark.createDataFrame([(1, body), (2, '{"code":"NoMatch","message":"none"}'), (3, "<html>")], "trace_id long, body string"))
    assert [(r.idx, r.matching_idx, r.x) for r in points.orderBy("idx").collect()] == [(0, 0, 1.0), (1, None, None), (2, 0, 1.1)]
    assert legs.first().nodes == [5, 6] and matchings.first().confidence == 0.8 and {(r.trace_id, r.code) for r in errors.collect()} == {(2, "NoMatch"), (3, "unreadable")}
    assert matching.structure_violations(points, legs).count() == 0


# -- geometry
def test_polygons(spark):
    ring = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    hole = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
    from wayfault.operators.spatial_join import polygon_literal

    poly = polygon_literal([ring, hole])
    at = lambda x, y, b=False: one(spark, G.in_polygon(F.lit(float(x)), F.lit(float(y)), poly, b))
    assert at(1, 1) and not at(5, 5) and not at(10, 5) and at(10, 5, True) and at(4, 5, True) and not at(11, 5, True)
    line = lambda *p: F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in p])
    assert one(spark, G.line_intersects_polygon(line((-5, 5), (15, 5)), poly)) and not one(spark, G.line_intersects_polygon(line((4.5, 5), (5.5, 5)), poly))
    assert one(spark, G.distance(F.lit(3.0), F.lit(4.0), line((0, 0), (0, 0)))) == 5


def test_sphere(spark):
    assert one(spark, G.sphere_distance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))) == pytest.approx(10018754.17, abs=0.01)
    assert one(spark, G.sphere_distance(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(90.0))) is None


# -- validation, fusion, sinks
def test_validation(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, x string")
    assert {(r.k, r.n) for r in validation.key_violations(df, ["k"]).collect()} == {(2, 2), (None, 1)}
    with pytest.raises(validation.ValidationError, match="no key"):
        validation.require_key(df, ["k"])
    with pytest.raises(validation.ValidationError, match="changed"):
        validation.require_same_keys(df, df.where("k = 1"), ["k"])
    with pytest.raises(validation.ValidationError, match="missing"):
        validation.require_columns(df, {"y": None})
    with pytest.raises(validation.ValidationError, match="unexpected"):
        validation.require_domain(df, "x", df.where("x <> 'd'"), "x")
    with pytest.raises(validation.ValidationError, match="share"):
        validation.require_disjoint(df, df, ["x"])
    with pytest.raises(validation.ValidationError, match="coordinate"):
        validation.require_crs(validation.with_crs(df, "x", "EPSG:4326"), "x", projected=True)
    with pytest.raises(Exception, match="unexpected flood zone"):
        flood.require_ranks(spark.createDataFrame([("ZZ", None)], "fld_zone string, zone_subty string")).collect()


def test_fusion_rejects_duplicates(spark):
    e = spark.createDataFrame([(1, 2, 0), (2, 1, 0)], "u long, v long, key long")
    with pytest.raises(validation.ValidationError):
        fusion.fuse(e, {"x": e.union(e)})
    assert fusion.fuse(e, {"x": e.where("u = 1").withColumn("y", F.lit(5))}).where("x_y = 5").count() == 1


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok', float("nan")), (2, None, 1.5)], "a int, b string, c double")
    assert sorted(r.value for r in sinks.csv_lines(df).collect()) == ['1,"say ""hi"", ok",', "2,,1.5"]
    sinks.write_csv(df, f"{tmp_path}/x")
    assert spark.read.text(f"{tmp_path}/x-header").first().value == '"a","b","c"'


def test_load_tables(spark):
    e = spark.createDataFrame([(1, 2, 0), (2, 3, 0)], "u long, v long, key long")
    p = spark.createDataFrame([(1, 2, 0, 0, 2, 3, 0)], "u long, v long, key long, path_edge_index int, path_u long, path_v long, path_key long")
    written = {}
    sinks.load_tables(e, e.limit(1), p, p, lambda name, df: written.update({name: df.count()}))
    assert written == {"roadways": 2, "detours_info": 1, "base_paths": 1, "detour_paths": 1}
    with pytest.raises(validation.ValidationError, match="parent"):
        sinks.load_tables(e, e, p.withColumn("path_v", F.lit(9).cast("long")), p, lambda *_: None)


def test_ellipsoid_and_clipping(spark):
    import numpy as np

    from wayfault.functions import exact_geometry as X

    d = X.vincenty(*np.array([[0.0, 0, 0, 1], [0, 0, 1, 0], [5, 5, 5, 5], [-73.9, 42.6, -73.8, 42.7], [0, 0, 179.9, 0.1]]).T)
    assert d[0] == pytest.approx(110574.389, abs=0.01) and d[1] == pytest.approx(111319.491, abs=0.01) and d[2] == 0
    assert d[3] == pytest.approx(13799, abs=30) and 19.9e6 < d[4] < 20.1e6
    line = F.array(G.point(F.lit(0), F.lit(0)), G.point(F.lit(0), F.lit(1)), G.point(F.lit(1), F.lit(1)))
    assert one(spark, X.ellipsoid_length(line)) == pytest.approx(110574.389 + 111302.649, abs=0.01)
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    assert X.clip_line([(-1, 2), (5, 2)], [square, [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]]) == [[(0, 2), (1, 2)], [(3, 2), (4, 2)]]
    assert X.clip_line([(-1, 0), (5, 0)], [square]) == [[(0, 0), (4, 0)]] and X.clip_line([(5, 5), (6, 6)], [square]) == []
    for mask in ([(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)], [(2, 2), (2, 6), (6, 6), (6, 2), (2, 2)]):
        assert sorted(X.clip_ring(square, mask)[:-1]) == [(2, 2), (2, 4), (4, 2), (4, 4)]
    assert X.clip_ring(square, [(5, 5), (6, 5), (6, 6), (5, 5)]) == []
