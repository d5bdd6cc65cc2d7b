"""Polygon overlay against counts of unit squares, projection and places along lines against published or known values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfault.functions import exact_geometry as X
from wayfault.functions import geometry as G
from wayfault.functions import overlay as O

U = [(0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10), (0, 0)]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def squares(b):
    return {(i, j) for i in range(b[0], b[2]) for j in range(b[1], b[3])}


@pytest.mark.parametrize("seed", range(8))
def test_boxes(seed):
    rng = random.Random(seed)
    boxes = [(x := rng.randrange(30), y := rng.randrange(30), x + rng.randrange(1, 10), y + rng.randrange(1, 10)) for _ in range(rng.randrange(1, 60))]
    covered = set().union(*map(squares, boxes))
    assert O.area(O.union([[box(*b)] for b in boxes])) == pytest.approx(len(covered))
    inside = {c for c in squares((0, 0, 10, 10)) if not (3 <= c[0] < 7 and c[1] >= 3)}
    for b in boxes[:8]:
        assert O.area(O.intersection([box(*b)], [U])) == pytest.approx(len(squares(b) & inside))
        assert O.area(O.difference([box(*b)], [U])) == pytest.approx(len(squares(b) - inside))


def test_parts_holes_and_repair():
    two = O.intersection([box(-1, 5, 11, 7)], [U])
    assert len(two) == 2 and O.area(two) == 12 and all(O.ring_area(p[0]) > 0 for p in two)
    (ring,) = O.difference([box(0, 0, 10, 10)], [box(3, 3, 5, 5)])
    assert len(ring) == 2 and O.ring_area(ring[1]) == -4
    bow = O.make_valid([[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]])
    assert len(bow) == 2 and [O.area([p]) for p in bow] == [1, 1]
    assert O.union([[box(0, 0, 1, 1)], [box(1, 0, 2, 1)]]) == [[box(0, 0, 2, 1)]] or O.area(O.union([[box(0, 0, 1, 1)], [box(1, 0, 2, 1)]])) == 2
    assert O.intersection([box(0, 0, 1, 1)], [box(5, 5, 6, 6)]) == [] and O.union([]) == []
    assert O.area(O.buffered([[box(0, 0, 50, 80)]], 5)) == pytest.approx(50 * 80 + 2 * 130 * 5 + 32 * math.sin(2 * math.pi / 64) * 25)


def test_masks_of_any_shape(spark):
    poly = lambda rings: F.array(*[F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in r]) for r in rings])
    row = spark.range(1).select(X.polygon_intersection(poly([box(-1, 5, 11, 7)]), poly([U])).alias("p"), X.polygon_intersection(poly([box(20, 20, 21, 21)]), poly([U])).alias("none"))
    got = row.select(F.size("p"), X.parts_area(F.col("p")), F.size("none"), X.parts_centroid(F.col("p"))["x"]).first()
    assert tuple(got) == (2, 12.0, 0, 5.0)
    with pytest.raises(ValueError, match="convex"):
        X.clip_ring(box(0, 0, 1, 1), U)


def test_ellipsoidal_projection(spark):
    """The worked example of Snyder (1987), page 333, on the ellipsoid of Clarke 1866."""
    laea = G.EqualArea(-100, 40, 6378206.4, 0.00676866)
    p = spark.range(1).select(laea.forward(F.lit(-110.0), F.lit(30.0)).alias("p")).first().p
    assert (p.x, p.y) == (pytest.approx(-965932.1, abs=0.1), pytest.approx(-1056814.9, abs=0.1))
    back = spark.range(1).select(laea.inverse(F.lit(p.x), F.lit(p.y)).alias("p")).first().p
    assert (back.x, back.y) == (pytest.approx(-110, abs=1e-9), pytest.approx(30, abs=1e-9))
    origin = spark.range(1).select(laea.inverse(F.lit(0.0), F.lit(0.0)).alias("p")).first().p
    assert (origin.x, origin.y) == (-100, pytest.approx(40, abs=1e-9))


def test_places_along_a_bend(spark):
    line = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (3, 0), (3, 4), (3, 4), (0, 4))])
    rows = spark.createDataFrame([(1.0, -1.0), (4.0, 2.0), (1.0, 9.0), (-1.0, -1.0)], "x double, y double")
    assert [r[0] for r in rows.select(G.locate(F.col("x"), F.col("y"), line)).collect()] == [1, 5, 9, 0]
    at = [tuple(r[0]) for r in spark.createDataFrame([(s,) for s in (0.0, 0.3, 0.5, 1.0, 2.0)], "s double").select(G.interpolate(line, F.col("s"))).collect()]
    assert at == [(0, 0), (3, 0), (3, 2), (0, 4), (0, 4)]
