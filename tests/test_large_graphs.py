"""What large tables need: work and rows are shared by traces, and networks are taken by components."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfault.operators import centrality, components, matching, paths
from wayfault.operators import network_parts as T

SIDE = 8


def lattice(spark):
    pairs = [((i, j), (i + a, j + b)) for i in range(SIDE) for j in range(SIDE) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= i + a < SIDE and 0 <= j + b < SIDE]
    rows = [(a * 100 + b, c * 100 + d, 0, a * 100.0, b * 100.0, c * 100.0, d * 100.0) for (a, b), (c, d) in pairs]
    return spark.createDataFrame(rows, "u long, v long, key long, x1 double, y1 double, x2 double, y2 double")


def traces(numbers):
    """Ten kinds of trace, each with a turn; the traces of a kind are equal."""
    at = lambda k, i: (80.0 + k + 80 * min(i, 4), 100.0 * (k % 3) + 80 * max(i - 4, 0) + i % 3)
    return [(n, i, *at(n % 10, i)) for n in numbers for i in range(7)]


POINTS = "trace_id long, idx int, x double, y double"


def test_equal_and_neighbouring_traces(spark):
    """Many traces together are matched as each is alone."""
    streets = lattice(spark).cache()
    rows = lambda numbers: matching.match(spark.createDataFrame(traces(numbers), POINTS), streets, reach=300.0).collect()
    together = defaultdict(list)
    for r in rows(range(40)):
        together[r.trace_id].append(tuple(r)[1:])
    assert sorted(together) == list(range(40)) and all(len(r) == 7 for r in together.values())
    for kind in (0, 3, 7):
        alone = sorted(tuple(r)[1:] for r in rows([kind]))
        assert all(sorted(together[n]) == alone for n in range(kind, 40, 10))


def test_surroundings_once_a_group(spark, monkeypatch):
    """Traces of the same cells have one copy of the streets, or one for each bounded part."""
    streets = lattice(spark)
    found = matching.candidates(spark.createDataFrame(traces(range(0, 400, 10)), POINTS), streets)
    size = found.count()
    groups = matching.decoding_groups(found, 300.0)
    assert groups.select(*matching.GROUP).distinct().count() == 1
    assert matching.surroundings(groups, streets, 300.0).count() <= streets.count()
    monkeypatch.setattr(matching, "AT_ONCE", size // 4)
    parts = {r[0] for r in matching.decoding_groups(found, 300.0).select("_part").distinct().collect()}
    assert len(parts) > 1 and max(parts) <= 4


def test_routes_searched_once_a_group(spark, monkeypatch):
    """A route from a node is searched once for all traces of a group, not once a trace and step."""
    streets = lattice(spark).withColumn("length", F.lit(100.0))
    found = matching.candidates(spark.createDataFrame(traces(range(10)), POINTS), streets.drop("length")).toArrow()
    calls, search = [], matching._distances
    monkeypatch.setattr(matching, "_distances", lambda start, out, limit: calls.append((start, limit)) or search(start, out, limit))
    rows = matching.decoded(found, streets.select("u", "v", "length").toArrow(), 5.0, 10.0)
    assert len(rows) == 70 and len(calls) == len(set(calls))
    assert len({start for start, _ in calls}) <= SIDE * SIDE and len(calls) < 3 * SIDE * SIDE


def blocks(seed, number=9, size=6):
    """Edges within blocks of nodes that are strewn over all numbers, with parallels, loops and ways without return."""
    rnd = random.Random(seed)
    names = rnd.sample(range(1000), number * size)
    out = {}
    for k in range(number):
        own = names[k * size : (k + 1) * size]
        for _ in range(2 * size):
            out[rnd.choice(own), rnd.choice(own), rnd.randrange(2)] = rnd.randrange(1, 9)
    return out


def edges_of(spark, edges):
    return spark.createDataFrame([(*k, w) for k, w in edges.items()], "u long, v long, key long, travel_time long")


@pytest.mark.parametrize("seed", range(2))
def test_labels(spark, seed):
    """Contracted runs and rounds name components as rounds alone do; chains span all runs."""
    names = random.Random(seed).sample(range(5000), 120)
    chain = {(a, b, 0): 1 for a, b in zip(names, names[1:], strict=False)} if seed else {}
    df = edges_of(spark, blocks(seed) | chain)
    want = components.components(centrality._nodes(df), df)
    assert sorted(map(tuple, T.labels(df).select("node_id", "component").collect())) == sorted(map(tuple, want.collect()))


def test_forest():
    u, v = np.array([5, 9, 7, 2, 4]), np.array([9, 7, 8, 3, 4])
    nodes, roots = T.forest(u, v)
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {5: 5, 9: 5, 7: 5, 8: 5, 2: 2, 3: 2, 4: 4}


@pytest.mark.parametrize("dense", [512, 3])
def test_closeness_beyond_max_edges(spark, monkeypatch, dense):
    """A graph of many small components may have more node pairs than ``max_edges``; sums are those of single sources."""
    df = edges_of(spark, blocks(5))
    want = {tuple(r) for r in centrality.path_sums(df).where("kind IN ('far', 'reach')").collect()}
    pairs = df.select("u", "v").distinct().count()
    with pytest.raises(ValueError, match="max_edges"):
        centrality.path_sums(df, max_edges=pairs - 1)
    monkeypatch.setattr(T, "DENSE", dense)
    limit = 1 if dense == 512 else pairs
    assert {tuple(r) for r in centrality.distance_sums(df, max_edges=limit).collect()} == want
    if dense == 3:
        with pytest.raises(ValueError, match="max_edges"):
            centrality.distance_sums(df, max_edges=1)


def asked(spark, edges, seed):
    nodes = sorted({n for u, v, _ in edges for n in (u, v)})
    pairs = {(a, b) for a, b in zip(nodes, random.Random(seed).sample(nodes, len(nodes)), strict=True)} | {(v, u) for u, v, _ in edges} | {(5000, 5000), (5000, nodes[0]), (nodes[0], 5000)}
    return spark.createDataFrame([(f"{a}>{b}", a, b) for a, b in sorted(pairs)], "query string, origin long, destination long")


def test_path_costs(spark, monkeypatch):
    """Costs within components are those of the rounds, which are used for components with negative costs only, and for queries that begin there."""
    edges = blocks(7)
    edges |= {(2001, 2002, 0): 5, (2002, 2003, 0): -2, (2001, 2003, 0): 4}
    df, q = edges_of(spark, edges).cache(), asked(spark, edges, 7).cache()
    want = sorted((r["query"], r.cost) for r in paths.shortest_paths(df, q).collect())
    rounds, seen = paths.shortest_paths, []
    monkeypatch.setattr(paths, "shortest_paths", lambda e, q, c: seen.append({(r.origin, r.destination) for r in q.collect()}) or rounds(e, q, c))
    assert sorted((r["query"], r.cost) for r in paths.path_costs(df, q).collect()) == want
    assert len(seen) == 1 and seen[0] and all(2001 <= a <= 2003 for a, _ in seen[0])


@pytest.mark.parametrize("dense", [512, 4, 0])
def test_costs_of_a_part(monkeypatch, dense):
    """All pairs in small components and single origins in larger ones give the same costs as plain relaxation."""
    monkeypatch.setattr(T, "DENSE", dense)
    edges = {(u, v): float(w) for (u, v, _), w in (blocks(3, 4, 3) | {(u + 2000, v + 2000, k): w for (u, v, k), w in blocks(4, 3, 8).items()}).items()}
    u, v, w = (np.array(x) for x in zip(*[(*k, c) for k, c in edges.items()], strict=True))
    _, roots = T.forest(u, v)
    nodes = np.unique(np.concatenate([u, v]))
    far = {(a, b): 0.0 if a == b else np.inf for a in nodes.tolist() for b in nodes.tolist()}
    for _ in nodes:
        for (a, b), c in edges.items():
            for s in nodes.tolist():
                far[s, b] = min(far[s, b], far[s, a] + c)
    o, d = (np.array(x) for x in zip(*far, strict=True))
    got = paths._costs(np.append(o, -1), np.append(d, nodes[0]), u, v, w, roots[np.searchsorted(nodes, u)])
    assert got.tolist() == [*far.values(), np.inf]
