"""Spatial joins on repeated shapes, bent and slanting lines and polygons of any shape, against single tests."""

import math

import pytest

from wayfault.functions import exact_geometry as X
from wayfault.functions import overlay as V
from wayfault.operators import spatial_join as J
from wayfault.plans import events_queries as E
from wayfault.plans import registry

LINE = "array<struct<x:double,y:double>>"
BOX = [(10, 10), (30, 10), (30, 20), (10, 20), (10, 10)]
TRIANGLE = [(40, 0), (80, 0), (40, 60), (40, 0)]
real = lambda line: [(float(x), float(y)) for x, y in line]
BOX, TRIANGLE = real(BOX), real(TRIANGLE)
POLYGONS = [(1, [BOX]), (2, [BOX]), (3, [TRIANGLE]), (4, [[(x + 35, y) for x, y in BOX]])]
LINES = [(1, [(0, 0), (30, 30)]), (2, [(0, 0), (30, 30)]), (3, [(0, 15), (90, 15)]), (4, [(0, 40), (50, 50), (60, 5), (70, 5)]), (5, [(8, 24), (14, 22)]), (6, [(0, 26), (26, 0)]), (7, [(9, 3), (9, 30)])]
LINES = [(k, real(line)) for k, line in LINES]
POINTS = [(k, float(x), float(y)) for k, (x, y) in enumerate([(x, y) for x in range(0, 90, 5) for y in range(0, 65, 5)] * 2)]


def frames(spark):
    return (
        spark.createDataFrame(LINES, f"line_id long, line {LINE}"),
        spark.createDataFrame(POLYGONS, f"box_id long, polygon array<{LINE}>"),
        spark.createDataFrame(POINTS, "event_id long, x double, y double"),
    )


def away(p, line):
    def one(a, b):
        (ax, ay), (bx, by) = a, b
        t = max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return math.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay))

    return min(one(a, b) for a, b in zip(line, line[1:], strict=False))


def test_near_points(spark):
    """Points by the first line that is near to them are those of all pairs, and so are the kinds of two passes."""
    lines, _, points = frames(spark)
    want = {(k, e): away((x, y), line) for k, line in LINES for e, x, y in POINTS if away((x, y), line) <= 4}
    got = {(r.line_id, r.event_id): r.distance for r in J.within_distance(lines, points, 4.0, ["line_id"], ["event_id"]).collect()}
    assert got == pytest.approx(want)
    assert sorted(r.event_id for r in J.near_points(lines, points, 4.0, ["event_id"]).collect()) == sorted({e for _, e in want})
    first, second = lines.where("line_id < 4"), lines.where("line_id >= 4")
    kinds = J.two_pass_kinds(first, second, points, 4.0, ["event_id"])
    pairs = J.two_pass_pairs(first, second, points, 4.0, ["line_id"], ["event_id"])
    assert sorted(map(tuple, kinds.collect())) == sorted(map(tuple, pairs.select("event_id", "road_span_type").distinct().collect()))


def test_distances_are_rounded_once_for_equal_places(spark, sf):
    """Rounding stands below the expansion of points of one place, and gives the rounded distances of all pairs."""
    lines, _, points = frames(spark)
    rounded = J.within_distance(lines, points, 4.0, ["line_id"], ["event_id"], digits=2)
    want = sorted((r.line_id, r.event_id, round(r.distance, 2)) for r in J.within_distance(lines, points, 4.0, ["line_id"], ["event_id"]).collect())
    assert sorted((r.line_id, r.event_id, r.distance) for r in rounded.collect()) == want
    plan = E.dwithin(registry.Data(spark, sf))._jdf.queryExecution().executedPlan().toString().splitlines()
    expanded = next(i for i, row in enumerate(plan) if "Generate explode(_points" in row)
    assert not any("round(" in row for row in plan[:expanded]) and any("round(" in row for row in plan[expanded:])


def test_boxes_are_not_exchanged(spark, sf):
    """A line's box follows from its segment, so it is made after the exchange and is not written with it."""
    plan = E.dwithin(registry.Data(spark, sf))._jdf.queryExecution().executedPlan().toString().splitlines()
    exchange = next(i for i, row in enumerate(plan) if "Exchange hashpartitioning(_cx" in row)
    assert any(" AS _x0#" in row for row in plan[:exchange]) and not any(" AS _x0#" in row for row in plan[exchange:])


@pytest.mark.parametrize("boundary", [False, True])
def test_points_in_polygons(spark, boundary, monkeypatch):
    """Small files may hold large polygons, so nothing is broadcast; arrays of equal shapes stay short."""
    monkeypatch.setattr(J, "COPIES", 1)
    _, polygons, points = frames(spark)
    got = J.points_in_polygons(points, polygons, 25.0, boundary)
    edge = lambda p, rings: any(away(p, r) == 0 for r in rings)
    want = {(e, k) for e, x, y in POINTS for k, rings in POLYGONS if X.inside((x, y), rings) and (boundary or not edge((x, y), rings))}
    assert {(r.event_id, r.box_id) for r in got.collect()} == want and got.count() == len(want)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_lines_in_polygons(spark):
    """Pairs, counts and lengths of equal lines and equal polygons, with boxes tested by arithmetic and others by their edges."""
    lines, polygons, _ = frames(spark)
    args = (lines, polygons, 25.0, ["line_id"], ["box_id"])
    length = lambda part: sum(math.dist(a, b) for a, b in zip(part, part[1:], strict=False))
    want = {(k, b): sum(map(length, X.clip_line(line, rings))) for k, line in LINES for b, rings in POLYGONS}
    pairs = sorted((r.line_id, r.box_id) for r in J.lines_in_polygons(*args).collect())
    assert pairs == sorted(k for k, n in want.items() if n > 0)  # none of these only touch
    assert {r.line_id: r.n for r in J.polygons_per_line(*args).collect()} == {k: sum(p[0] == k for p in pairs) for k, _ in pairs}
    assert {(r.line_id, r.box_id): r.length for r in J.lengths_in_polygons(*args).collect()} == pytest.approx({k: n for k, n in want.items() if n > 0})


def test_costly_shapes_are_made_once(spark, sf, monkeypatch):
    """Equal boxes are one shape, whatever the number of their rows."""
    rows = spark.createDataFrame(POLYGONS * 3, f"box_id long, polygon array<{LINE}>")
    equal = J.shapes(rows, ["polygon"], ["box_id"], "_boxes")
    assert equal.count() == 3
    back = J.expanded(equal.withColumn("area", X.parts_area(X.make_valid("polygon"))), "_boxes")
    assert sorted((r.box_id, r.area) for r in back.collect()) == sorted((k, V.area([p])) for k, p in POLYGONS * 3)
