"""Geometry that expressions cannot hold: ellipsoidal distances, clipping, unions and buffers, as Arrow batches of numpy or per shape.

Lines and polygons are as in ``geometry``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfault.functions import overlay as V

#: Semi-major axis (m) and flattening of WGS 84.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
LINE = "array<struct<x:double,y:double>>"
POLYGON = f"array<{LINE}>"
PARTS = f"array<{POLYGON}>"
ARROW_PARTS = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def vincenty(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Ellipsoidal distances in metres (Vincenty 1975); points nearly opposite each other, where it does not converge, go by way of a third point."""
    b = AXIS * (1 - FLATTENING)
    lon = np.radians((x2 - x1 + 540) % 360 - 180)
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(y))) for y in (y1, y2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, done = lon.copy(), np.zeros(lon.shape, bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.sqrt((c2 * sl) ** 2 + (c1 * s2 - s1 * c2 * cl) ** 2)
            cos_s = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, c1 * c2 * sl / np.where(sin_s == 0, 1, sin_s))
            cos2a = 1 - sin_a**2
            mid = np.where(cos2a == 0, 0.0, cos_s - 2 * s1 * s2 / np.where(cos2a == 0, 1, cos2a))
            c = FLATTENING / 16 * cos2a * (4 + FLATTENING * (4 - 3 * cos2a))
            new = lon + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if (done | np.isnan(lam)).all():
                break
        k = cos2a * (AXIS**2 - b**2) / b**2
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        delta = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
        out = b * big * (sigma - delta)
    stuck = ~done & ~np.isnan(lon)
    if stuck.any():
        third = np.where(y1[stuck] + y2[stuck] >= 0, 90.0, -90.0)
        out[stuck] = vincenty(x1[stuck], y1[stuck], x1[stuck], third) + vincenty(x2[stuck], third, x2[stuck], y2[stuck])
    return out


def ellipsoid_distance(x1: Column | str, y1: Column | str, x2: Column | str, y2: Column | str) -> Column:
    """Metres between two points in degrees; null if a coordinate is."""
    return F.pandas_udf(_ellipsoid_distance, "double")(x1, y1, x2, y2)


def _ellipsoid_distance(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    return pd.Series(vincenty(*(s.to_numpy(dtype=float) for s in (x1, y1, x2, y2))))


def _points(line) -> list[tuple[float, float]]:
    return [(p["x"], p["y"]) for p in line]


def ellipsoid_length(lines: Column | str) -> Column:
    """Metres along a line in degrees; null for a null line."""
    return F.pandas_udf(_ellipsoid_length, "double")(lines)


def _ellipsoid_length(lines: pd.Series) -> pd.Series:
    sizes = [max(0, len(x) - 1) if x is not None else 0 for x in lines]
    pairs = [(*a, *b) for x in lines if x is not None for p in [_points(x)] for a, b in zip(p, p[1:], strict=False)]
    d = vincenty(*np.array(pairs, float).reshape(-1, 4).T) if pairs else np.zeros(0)
    sums = np.concatenate([[0], np.cumsum(d)])
    ends = np.cumsum(sizes)
    out = sums[ends] - sums[ends - sizes]
    return pd.Series([v if x is not None else None for v, x in zip(out, lines, strict=True)], dtype="float64")


def inside(p: tuple[float, float], polygon: list[list[tuple[float, float]]]) -> bool:
    """Inside or on the border: an odd number of crossings over all rings."""
    odd = False
    for ring in polygon:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            cross = (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
            if cross == 0 and min(ax, bx) <= p[0] <= max(ax, bx) and min(ay, by) <= p[1] <= max(ay, by):
                return True
            if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def clip_line(line: list[tuple[float, float]], polygon: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Parts of a line in a polygon: segments are cut at the rings, and pieces kept whose middle is inside."""
    parts: list[list[tuple[float, float]]] = []
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        dx, dy, ts = bx - ax, by - ay, {0.0, 1.0}
        for ring in polygon:
            for (cx, cy), (ex, ey) in zip(ring, ring[1:], strict=False):
                fx, fy = ex - cx, ey - cy
                den = dx * fy - dy * fx
                if den:
                    t, s = ((cx - ax) * fy - (cy - ay) * fx) / den, ((cx - ax) * dy - (cy - ay) * dx) / den
                    if 0 < t < 1 and -1e-12 <= s <= 1 + 1e-12:
                        ts.add(t)
                elif (cx - ax) * dy == (cy - ay) * dx and (dx or dy):  # along the border
                    for qx, qy in ((cx, cy), (ex, ey)):
                        t = ((qx - ax) * dx + (qy - ay) * dy) / (dx * dx + dy * dy)
                        if 0 < t < 1:
                            ts.add(t)
        cuts = sorted(ts)
        for a, b in zip(cuts, cuts[1:], strict=False):
            p, q = (ax + dx * a, ay + dy * a), (ax + dx * b, ay + dy * b)
            if p != q and inside(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2), polygon):
                if parts and parts[-1][-1] == p:
                    parts[-1].append(q)
                else:
                    parts.append([p, q])
    return parts


def convex(ring: list[tuple[float, float]]) -> bool:
    p = np.asarray(ring[:-1], float)
    d = np.roll(p, -1, axis=0) - p
    turn = d[:, 0] * np.roll(d, -1, axis=0)[:, 1] - d[:, 1] * np.roll(d, -1, axis=0)[:, 0]
    # turns of one sign, and round only once
    angles = np.abs(np.arctan2(turn, (d * np.roll(d, -1, axis=0)).sum(axis=1))).sum()
    return bool(((turn >= 0).all() or (turn <= 0).all()) and angles < 2 * np.pi + 1e-6)


def clip_ring(ring: list[tuple[float, float]], mask: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """A ring clipped by a convex ring (Sutherland and Hodgman); closed, empty if nothing is left.  A mask that is not convex is an error."""
    if not convex(mask):
        raise ValueError("the mask is not convex")
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(mask, mask[1:], strict=False))
    edges = list(zip(mask, mask[1:], strict=False)) if area > 0 else [(b, a) for a, b in zip(mask, mask[1:], strict=False)][::-1]
    out = ring[:-1]
    for a, b in edges:
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        kept = []
        for p, q in zip(out[-1:] + out[:-1], out, strict=True):
            sp, sq = side(p), side(q)
            if (sp < 0) != (sq < 0):
                t = sp / (sp - sq)
                kept.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
            if sq >= 0:
                kept.append(q)
        out = kept
    return [*out, out[0]] if len(out) > 2 else []


def _dicts(line: list[tuple[float, float]]) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in line]


def line_intersection(lines: Column | str, polygons: Column | str) -> Column:
    """Parts of each line in its polygon."""
    return F.pandas_udf(_line_intersection, f"array<{LINE}>")(lines, polygons)


def _line_intersection(lines: pd.Series, polygons: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else [_dicts(p) for p in clip_line(_points(a), [_points(r) for r in b])] for a, b in zip(lines, polygons, strict=True)])


def _rings(polygon) -> list[list[tuple[float, float]]]:
    return [_points(r) for r in polygon]


def _parts(polygons: list[list[list[tuple[float, float]]]]) -> list[list[list[dict]]]:
    return [[_dicts(r) for r in p] for p in polygons]


def _clip(polygon: list[list[tuple[float, float]]], mask: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    box = lambda r: (min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r))
    a, b = box(polygon[0]), box(mask[0])
    if a[2] < b[0] or a[0] > b[2] or a[3] < b[1] or a[1] > b[3]:
        return []
    if len(polygon) == len(mask) == 1 and convex(mask[0]) and convex(polygon[0]):
        left = clip_ring(polygon[0], mask[0])
        return [[left]] if left and V.ring_area(left) else []
    return V.intersection(polygon, mask)


def polygon_intersection(polygons: Column | str, masks: Column | str) -> Column:
    """What each polygon and its mask, polygons of any shape, have in common: an array of polygons, empty if they share no area."""
    return F.pandas_udf(_polygon_intersection, PARTS)(polygons, masks)


def _polygon_intersection(polygons: pd.Series, masks: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or m is None else _parts(_clip(_rings(p), _rings(m))) if len(p) and len(m) else [] for p, m in zip(polygons, masks, strict=True)])


def make_valid(polygons: Column | str) -> Column:
    """The inside of a polygon whose rings may cross themselves, as an array of polygons that do not."""
    return F.pandas_udf(_make_valid, PARTS)(polygons)


def _make_valid(polygons: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else _parts(V.make_valid(_rings(p))) for p in polygons])


def buffer(polygons: Column | str, distance: Column | str) -> Column:
    """The region within a distance of a polygon, with round joins: an array of polygons."""
    return F.pandas_udf(_buffer, PARTS)(polygons, distance)


def _buffer(polygons: pd.Series, distance: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or pd.isna(d) else _parts(V.buffered([_rings(p)], float(d))) for p, d in zip(polygons, distance, strict=True)])


def union_polygons(df: DataFrame, keys: list[str], column: str = "polygon", at_once: int = 64) -> DataFrame:
    """``keys, parts``: the union of the polygons of each key, an array of polygons.

    Neighbours first: polygons are sorted along x and united ``at_once`` at a time, in rounds, so a task holds that many and inner borders vanish early.
    """
    from pyspark.sql import Window

    left = lambda c: F.array_min(F.flatten(F.transform(F.col(c), lambda p: F.transform(p[0], lambda q: q["x"]))))
    rows = df.where(F.col(column).isNotNull() & (F.size(column) > 0)).select(*keys, F.array(F.col(column)).alias("parts"))
    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + f", parts {PARTS}"

    def unite(group: pa.Table) -> pa.Table:
        made = V.union([_rings(p) for parts in group.column("parts").to_pylist() for p in parts])
        first = group.slice(0, 1).select(keys)
        return pa.table([*first.columns, pa.array([_parts(made)], ARROW_PARTS)], names=[*keys, "parts"])

    while True:
        order = Window.partitionBy(*keys).orderBy(left("parts"))
        dealt = rows.withColumn("_block", F.floor((F.row_number().over(order) - 1) / at_once))
        from wayfault.operators.scratch import cut

        rows = cut(dealt.groupBy(*keys, "_block").applyInArrow(unite, schema))
        if rows.groupBy(*keys).count().where("count > 1").isEmpty():
            return rows


def noded_lines(lines: DataFrame, keys: list[str], width: float, column: str = "line") -> DataFrame:
    """``keys, ax, ay, bx, by``: the distinct pieces of the lines of each key, cut where they meet; the union of lines.

    Segments are first cut at the cells of a grid, and each cell's pieces are cut at each other in a task of their own.
    """
    from wayfault.functions import geometry as G

    s = lines.select(*keys, F.explode(G.segments(F.col(column))).alias("s")).select(*keys, *[F.col(f"s.{p}.{c}").alias(p + c) for p in "ab" for c in "xy"])

    def at_grid(rows: DataFrame, c: str) -> DataFrame:
        """Segments cut at the grid's lines across one axis."""
        a, b = F.col("a" + c), F.col("b" + c)
        low, high = F.least(a, b), F.greatest(a, b)
        between = F.filter(F.transform(F.sequence(F.floor(low / width) + 1, F.floor(high / width) + 1), lambda k: (k * width - a) / (b - a)), lambda t: (t > 0) & (t < 1))
        ts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.when(a != b, between).otherwise(F.array().cast("array<double>"))))
        n = F.size("_t")
        pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get("_t", i).alias("f"), F.get("_t", i + 1).alias("g")))
        put = lambda t, d: F.when(F.col(t) == 0, F.col("a" + d)).when(F.col(t) == 1, F.col("b" + d)).otherwise(F.col("a" + d) + F.col(t) * (F.col("b" + d) - F.col("a" + d)))
        rows = rows.withColumn("_t", ts).select("*", F.explode(pairs).alias("_p")).select("*", "_p.f", "_p.g")
        return rows.select(*keys, put("f", "x").alias("_ax"), put("f", "y").alias("_ay"), put("g", "x").alias("_bx"), put("g", "y").alias("_by")).withColumnsRenamed({f"_{p}{d}": p + d for p in "ab" for d in "xy"})

    pieces = at_grid(at_grid(s, "x"), "y")
    middle = lambda c: F.floor((F.col("a" + c) + F.col("b" + c)) / 2 / width).alias("_c" + c)
    celled = pieces.select("*", middle("x"), middle("y"))
    kinds = dict(lines.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ax double, ay double, bx double, by double"

    def cut_cell(group: pd.DataFrame) -> pd.DataFrame:
        seg = group[["ax", "ay", "bx", "by"]].to_numpy(float)
        flip = (seg[:, 0] > seg[:, 2]) | ((seg[:, 0] == seg[:, 2]) & (seg[:, 1] > seg[:, 3]))
        seg[flip] = seg[flip][:, [2, 3, 0, 1]]
        made = V.noded(np.unique(seg, axis=0), width * V.GRID)
        out = pd.DataFrame(made, columns=["ax", "ay", "bx", "by"])
        for n, k in enumerate(keys):
            out.insert(n, k, group.iloc[0][k])
        return out

    return celled.groupBy(*keys, "_cx", "_cy").applyInPandas(cut_cell, schema)


def polygon_area(polygon: Column) -> Column:
    """Planar area of a polygon: the outer ring's without the others'."""
    ring = lambda r: F.abs(F.aggregate(F.zip_with(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda acc, v: acc + v)) / 2
    holes = F.aggregate(F.transform(F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0))), ring), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(polygon) > 0, ring(polygon[0]) - holes).otherwise(0.0)


def parts_area(parts: Column) -> Column:
    """Planar area of an array of polygons."""
    return F.aggregate(F.transform(parts, polygon_area), F.lit(0.0), lambda acc, v: acc + v)


def parts_centroid(parts: Column) -> Column:
    """Centroid of an array of polygons, struct ``x, y``: where the projection of a region is centred."""
    ring = lambda r, sign: F.struct((sign * F.abs(ring_area(r))).alias("w"), centroid(r).alias("c"))
    rings = F.flatten(F.transform(parts, lambda p: F.transform(p, lambda r, i: ring(r, F.when(i == 0, 1.0).otherwise(-1.0)))))
    total = F.aggregate(rings, F.lit(0.0), lambda acc, r: acc + r["w"])
    mean = lambda c: F.aggregate(rings, F.lit(0.0), lambda acc, r: acc + r["w"] * r["c"][c]) / total
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def ring_area(ring: Column) -> Column:
    """Signed planar area of a ring."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.aggregate(F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda acc, v: acc + v) / 2


def centroid(ring: Column) -> Column:
    """Centroid of a ring, struct ``x, y``: where a region's own projection is centred."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    parts = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("w"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["w"])
    mean = lambda c: F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["w"] * p[c]) / (3 * total)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))
