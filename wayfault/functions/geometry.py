"""Planar and spherical geometry on columns.

A line is an array of structs ``x, y``; a polygon is an array of rings (closed lines), the first the outer one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the sphere's radius in metres.
RADIUS = 6378137.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segments(line: Column) -> Column:
    """Array of structs ``a, b`` of consecutive points; of a line of one point, a segment of no length."""
    n = F.size(line)
    pairs = F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(line, F.least(F.lit(2), n), F.greatest(n - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(n > 0, pairs)


def foot(px: Column, py: Column, s: Column) -> Column:
    """Point of segment ``s`` nearest to (px, py), and where it is along it: struct ``d2, t, x, y``."""
    ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    dot = (px - ax) * dx + (py - ay) * dy
    t = F.when((len2 == 0) | (dot <= 0), 0.0).when(dot >= len2, 1.0).otherwise(dot / len2)
    x = F.when(t == 0, ax).when(t == 1, bx).otherwise(ax + t * dx)
    y = F.when(t == 0, ay).when(t == 1, by).otherwise(ay + t * dy)
    cross = (px - ax) * dy - (py - ay) * dx
    d2 = F.when((t > 0) & (t < 1), cross * cross / len2).otherwise((px - x) * (px - x) + (py - y) * (py - y))
    return F.struct(d2.alias("d2"), t.alias("t"), x.alias("x"), y.alias("y"))


def nearest(px: Column, py: Column, line: Column) -> Column:
    """The foot of the point on the line: struct ``d2, t, x, y``; of equally near ones the first along a segment."""
    return F.array_min(F.transform(segments(line), lambda s: foot(px, py, s)))


def distance(px: Column, py: Column, line: Column) -> Column:
    return F.sqrt(nearest(px, py, line)["d2"])


def shortest_line(px: Column, py: Column, line: Column) -> Column:
    """From the nearest point of the line to the point."""
    at = nearest(px, py, line)
    return F.array(point(at["x"], at["y"]), point(px, py))


def planar_length(line: Column) -> Column:
    return F.aggregate(F.transform(segments(line), lambda s: F.sqrt((s["b"]["x"] - s["a"]["x"]) * (s["b"]["x"] - s["a"]["x"]) + (s["b"]["y"] - s["a"]["y"]) * (s["b"]["y"] - s["a"]["y"]))), F.lit(0.0), lambda a, x: a + x)


def _length(s: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    return F.sqrt(dx * dx + dy * dy)


def locate(px: Column, py: Column, line: Column) -> Column:
    """Distance along a line of the foot of the point; of equally near places the first."""
    start = F.struct(F.lit(0.0).alias("before"), F.lit(float("inf")).alias("d2"), F.lit(None).cast("double").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        near = foot(px, py, s)
        closer = near["d2"] < acc["d2"]
        return F.struct(
            (acc["before"] + _length(s)).alias("before"), F.when(closer, near["d2"]).otherwise(acc["d2"]).alias("d2"),
            F.when(closer, acc["before"] + near["t"] * _length(s)).otherwise(acc["at"]).alias("at"),
        )

    return F.aggregate(segments(line), start, step, lambda acc: acc["at"])


def interpolate(line: Column, share: Column) -> Column:
    """Point of a line at a share of its length, from 0 to 1."""
    target = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * planar_length(line)
    start = F.struct(F.lit(0.0).alias("before"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def step(acc: Column, s: Column) -> Column:
        length = _length(s)
        here = acc["x"].isNull() & (acc["before"] + length >= target) & (length > 0)
        t = F.when(length > 0, (target - acc["before"]) / length).otherwise(0.0)
        put = lambda c: F.when(here, s["a"][c] + (s["b"][c] - s["a"][c]) * t).otherwise(acc[c]).alias(c)
        return F.struct((acc["before"] + length).alias("before"), put("x"), put("y"))

    last = F.element_at(line, -1)
    return F.aggregate(segments(line), start, step, lambda acc: point(F.coalesce(acc["x"], last["x"]), F.coalesce(acc["y"], last["y"])))


def substring(line: Column, start: Column, end: Column) -> Column:
    """Points from index ``start`` to ``end`` (both from 0, inclusive); null if fewer than two."""
    return F.when(end > start, F.slice(line, start + 1, end - start + 1))


def reverse_line(line: Column) -> Column:
    return F.reverse(line)


def bounds(line: Column) -> Column:
    """Struct ``min_x, min_y, max_x, max_y``."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def crosses_odd(px: Column, py: Column, ring: Column) -> Column:
    """Whether a ray to the right crosses an odd number of segments (an array of them)."""
    return F.size(F.filter(ring, lambda s: ((s["a"]["y"] > py) != (s["b"]["y"] > py)) & (px < (s["b"]["x"] - s["a"]["x"]) * (py - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"]))) % 2 == 1


def on_segments(px: Column, py: Column, ring: Column) -> Column:
    def on(s: Column) -> Column:
        a, b = s["a"], s["b"]
        box = px.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & py.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        return box & ((px - a["x"]) * (b["y"] - a["y"]) == (py - a["y"]) * (b["x"] - a["x"]))

    return F.exists(ring, on)


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point is inside a ring, by the number of edges that a ray to the right crosses; its lower and left borders count as inside."""
    return crosses_odd(px, py, segments(ring))


def on_ring(px: Column, py: Column, ring: Column) -> Column:
    return on_segments(px, py, segments(ring))


def rings_of(polygon: Column) -> Column:
    """The segments of each ring, for ``in_rings``: made once for each polygon, not for each point."""
    return F.transform(polygon, segments)


def in_rings(px: Column, py: Column, rings: Column, boundary: bool = False) -> Column:
    """``in_polygon`` on the segments of the rings."""
    holes = F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: crosses_odd(px, py, r))
    edge = F.exists(rings, lambda r: on_segments(px, py, r))
    inside = crosses_odd(px, py, rings[0]) & ~holes
    return (inside | edge) if boundary else (inside & ~edge)


def in_polygon(px: Column, py: Column, polygon: Column, boundary: bool = False) -> Column:
    """Inside the outer ring and no hole; ``boundary``: points on a ring count (intersects), else not (within)."""
    return in_rings(px, py, rings_of(polygon), boundary)


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def segments_cross(s: Column, t: Column) -> Column:
    """Whether two segments have a point in common."""
    d1, d2, d3, d4 = _turn(t["a"], t["b"], s["a"]), _turn(t["a"], t["b"], s["b"]), _turn(s["a"], s["b"], t["a"]), _turn(s["a"], s["b"], t["b"])
    inside = lambda p, q: (p["x"].between(F.least(q["a"]["x"], q["b"]["x"]), F.greatest(q["a"]["x"], q["b"]["x"]))) & (p["y"].between(F.least(q["a"]["y"], q["b"]["y"]), F.greatest(q["a"]["y"], q["b"]["y"])))
    touch = ((d1 == 0) & inside(s["a"], t)) | ((d2 == 0) & inside(s["b"], t)) | ((d3 == 0) & inside(t["a"], s)) | ((d4 == 0) & inside(t["b"], s))
    return ((d1 * d2 < 0) & (d3 * d4 < 0)) | touch


def line_intersects_polygon(line: Column, polygon: Column) -> Column:
    crossing = F.exists(segments(line), lambda s: F.exists(polygon, lambda r: F.exists(segments(r), lambda q: segments_cross(s, q))))
    return crossing | in_polygon(line[0]["x"], line[0]["y"], polygon, boundary=True)


# -- sphere and projection
def sphere_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle distance in metres of two points in degrees."""
    a, b = F.radians(y1), F.radians(y2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return F.when(h.isNotNull(), 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def sphere_length(line: Column) -> Column:
    return F.aggregate(F.transform(segments(line), lambda s: sphere_distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])), F.lit(0.0), lambda a, x: a + x)


def cumulative_sphere(line: Column) -> Column:
    """Distance along the line at each of its points."""
    return F.transform(line, lambda _, i: F.aggregate(F.transform(segments(F.slice(line, F.lit(1), i + 1)), lambda s: sphere_distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])), F.lit(0.0), lambda a, x: a + x))


#: Flattening of WGS 84, on the semi-major axis ``RADIUS``.
FLATTENING = 1 / 298.257223563


class EqualArea:
    """Azimuthal equal-area projection of an ellipsoid about a centre (Snyder 1987, pages 187-190), in metres."""

    def __init__(self, lon0: float, lat0: float, axis: float = RADIUS, e2: float = FLATTENING * (2 - FLATTENING)):
        self.lon0, self.axis, self.e2, self.e = lon0, axis, e2, math.sqrt(e2)
        p = math.radians(lat0)
        self.whole = self._q(1.0, math.log((1 - self.e) / (1 + self.e)))
        b = math.asin(max(-1.0, min(1.0, self._q(math.sin(p), math.log((1 - self.e * math.sin(p)) / (1 + self.e * math.sin(p)))) / self.whole)))
        self.sin_b, self.cos_b = math.sin(b), math.cos(b)
        self.radius = axis * math.sqrt(self.whole / 2)
        pole = math.isclose(abs(lat0), 90)
        self.stretch = 1.0 if pole else axis * math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2) / (self.radius * self.cos_b)

    def _q(self, sine, log):
        return (1 - self.e2) * (sine / (1 - self.e2 * sine * sine) - log / (2 * self.e))

    def forward(self, x: Column, y: Column) -> Column:
        lam, sine = F.radians(x - self.lon0), F.sin(F.radians(y))
        b = F.asin(F.greatest(F.least(self._q(sine, F.log((1 - self.e * sine) / (1 + self.e * sine))) / self.whole, F.lit(1.0)), F.lit(-1.0)))
        k = self.radius * F.sqrt(2 / (1 + self.sin_b * F.sin(b) + self.cos_b * F.cos(b) * F.cos(lam)))
        return point(k * self.stretch * F.cos(b) * F.sin(lam), k / self.stretch * (self.cos_b * F.sin(b) - self.sin_b * F.cos(b) * F.cos(lam)))

    def inverse(self, x: Column, y: Column) -> Column:
        east, north = x / self.stretch, y * self.stretch
        rho = F.sqrt(east * east + north * north)
        c = 2 * F.asin(F.least(rho / (2 * self.radius), F.lit(1.0)))
        sine = F.when(rho == 0, self.sin_b).otherwise(F.cos(c) * self.sin_b + north * F.sin(c) * self.cos_b / rho)
        lam = F.when(rho == 0, 0.0).otherwise(F.atan2(east * F.sin(c), rho * self.cos_b * F.cos(c) - north * self.sin_b * F.sin(c)))
        e2, b, q = self.e2, F.asin(F.greatest(F.least(sine, F.lit(1.0)), F.lit(-1.0))), self.whole * sine
        # authalic to geodetic latitude: the series, then one step of Newton's method
        phi = b + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * b) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * b) + 761 * e2**3 / 45360 * F.sin(6 * b)
        s = F.sin(phi)
        off = q / (1 - e2) - s / (1 - e2 * s * s) + F.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e)
        step = F.when(F.cos(phi) > 1e-9, F.pow(1 - e2 * s * s, 2) / (2 * F.cos(phi)) * off).otherwise(0.0)
        return point(self.lon0 + F.degrees(lam), F.degrees(phi + step))


def laea(x: Column, y: Column, lon0: float, lat0: float) -> Column:
    """Metres east and north of a centre, equal-area, on the ellipsoid."""
    return EqualArea(lon0, lat0).forward(x, y)


def laea_inverse(x: Column, y: Column, lon0: float, lat0: float) -> Column:
    return EqualArea(lon0, lat0).inverse(x, y)


def project_line(line: Column, lon0: float, lat0: float) -> Column:
    return F.transform(line, lambda p: laea(p["x"], p["y"], lon0, lat0))


def unproject_line(line: Column, lon0: float, lat0: float) -> Column:
    return F.transform(line, lambda p: laea_inverse(p["x"], p["y"], lon0, lat0))


def within_miles(px: Column, py: Column, polygon: Column, miles: float) -> Column:
    """Whether a projected point is inside a projected polygon's buffer: in it, or so near to a ring."""
    near = F.array_min(F.transform(polygon, lambda r: nearest(px, py, r)["d2"]))
    metres = miles * 1609.344
    return in_polygon(px, py, polygon, boundary=True) | (near <= metres * metres)


# -- grid
def cell(v: Column, width: float) -> Column:
    return F.floor(v / width).cast("long")


def cells_of_box(min_x: Column, min_y: Column, max_x: Column, max_y: Column, width: float) -> Column:
    """Array of structs ``cx, cy``: the cells that a box touches."""
    xs, ys = F.sequence(cell(min_x, width), cell(max_x, width)), F.sequence(cell(min_y, width), cell(max_y, width))
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def cells_of_line(line: Column, width: float, margin: float = 0.0) -> Column:
    """Cells that come within ``margin`` of the boxes of a line's segments."""
    lo, hi = F.least, F.greatest
    each = F.transform(segments(line), lambda s: cells_of_box(lo(s["a"]["x"], s["b"]["x"]) - margin, lo(s["a"]["y"], s["b"]["y"]) - margin, hi(s["a"]["x"], s["b"]["x"]) + margin, hi(s["a"]["y"], s["b"]["y"]) + margin, width))
    return F.array_distinct(F.flatten(each))
