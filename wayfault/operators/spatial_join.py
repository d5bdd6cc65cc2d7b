"""Spatial joins on a grid: an equi-join on cells, then boxes, then the exact test.

Lines are listed under the cells within the distance of a segment's box, straight ones with their segment's coordinates as plain columns; a point has one
cell.  So a pair of line and point meets exactly once, the box test and the exact one are arithmetic inside generated code, and no
cross join is needed.  Rows of equal shape are joined as one and expanded afterwards (``shapes``).  Polygons and cells are much larger than the files that they come
from, so joins are by sorting and never broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfault.functions import exact_geometry as X
from wayfault.functions import geometry as G
from wayfault.operators.scratch import cut
from wayfault.operators.validation import require_disjoint

#: Rows of equal shape in one array.
COPIES = 1024


def segment_rows(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """``keys`` and ``ax, ay, bx, by`` of each segment of the lines."""
    rows = lines.select(*keys, F.explode(G.segments(F.col(line))).alias("_s"))
    return rows.select(*keys, *[F.col(f"_s.{p}.{c}").alias(p + c) for p in "ab" for c in "xy"])


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over all shuffle partitions: a join multiplies rows and shapes cost much work, so the size of the input must not decide the number of tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def shapes(rows: DataFrame, shape: list[str], payload: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """Distinct values of the columns ``shape``, each with the array ``name`` of its rows' other columns: what depends on the shape is done once for all of them.

    A shape of more than ``COPIES`` rows has several arrays, so none grows with the data.  Dealt by ``by``, columns of ``shape``, over all shuffle partitions.
    """
    by = by or []
    hashed = rows.select(*shape, *payload, F.xxhash64(*shape).alias("_hash"))
    # dealt and numbered by the hash, which needs one exchange; equal hashes of unlike shapes only share the numbering
    place = F.row_number().over(Window.partitionBy(*by, "_hash").orderBy("_hash"))
    numbered = dealt(hashed, *(by or ["_hash"])).withColumn("_block", F.floor((place - 1) / COPIES))
    others = [c for c in shape if c not in by]
    return numbered.groupBy(*by, "_hash", "_block", *others).agg(F.collect_list(F.struct(*payload)).alias(name)).select(*shape, name)


def expanded(rows: DataFrame, *names: str) -> DataFrame:
    """The inverse of ``shapes``: a row for each combination of the arrays' members, with their columns."""
    for name in names:
        kept = [c for c in rows.columns if c != name]
        rows = rows.select(*kept, F.explode(name).alias(name)).select(*kept, f"{name}.*")
    return rows


def _celled(rows: DataFrame, cells: Column) -> DataFrame:
    return rows.withColumn("_cell", F.explode(cells)).select("*", F.col("_cell.cx").alias("_cx"), F.col("_cell.cy").alias("_cy")).drop("_cell")


def _near(lines: DataFrame, limit: float, width: float, line_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells ``_cx, _cy`` of the straight lines, with their segment's coordinates and its box, and of the bent ones, with the segments ``_s`` that come near to the cell and their box."""
    sides = lambda s, c: (F.least(s["a"][c], s["b"][c]) - limit, F.greatest(s["a"][c], s["b"][c]) + limit)
    box = lambda x, y: dict(zip(("_x0", "_x1", "_y0", "_y1"), (*x, *y), strict=True))
    rows = lines.select(*line_keys, "line").where(F.size("line") > 0)
    one = G.segments(F.col("line"))[0]
    straight = rows.where(F.size("line") <= 2).select(*line_keys, one.alias("_one"))
    straight = straight.select(*line_keys, *[F.col(f"_one.{p}.{c}").alias(p + c) for p in "ab" for c in "xy"])
    plain = {p: {c: F.col(p + c) for c in "xy"} for p in "ab"}
    bounds = box(sides(plain, "x"), sides(plain, "y"))
    met = _celled(straight, G.cells_of_box(bounds["_x0"], bounds["_y0"], bounds["_x1"], bounds["_y1"], width))
    straight = dealt(met, "_cx", "_cy").withColumns(bounds)  # boxes are made after the exchange, which so has less to write
    bent = _celled(rows.where(F.size("line") > 2), G.cells_of_line(F.col("line"), width, limit))

    def touches(s: Column) -> Column:
        (x0, x1), (y0, y1) = sides(s, "x"), sides(s, "y")
        return F.col("_cx").between(G.cell(x0, width), G.cell(x1, width)) & F.col("_cy").between(G.cell(y0, width), G.cell(y1, width))

    bent = bent.withColumn("_s", F.filter(G.segments(F.col("line")), touches)).drop("line")
    every = lambda c: (F.array_min(F.transform("_s", lambda s: sides(s, c)[0])), F.array_max(F.transform("_s", lambda s: sides(s, c)[1])))
    return straight, bent.withColumns(box(every("x"), every("y")))


def _foot(bent: bool) -> Column:
    """Foot of the point ``x, y`` on the line in its cell; of equally near segments the first along its own counts."""
    x, y = F.col("x"), F.col("y")
    return F.array_min(F.transform("_s", lambda s: G.foot(x, y, s))) if bent else G.foot(x, y, {p: {c: F.col(p + c) for c in "xy"} for p in "ab"})


def _apart() -> Column:
    """Squared distance of the point ``x, y`` to the segment of a straight line: ``d2`` of its foot, without the foot, as each candidate is tested by it."""
    x, y, ax, ay, bx, by = (F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by"))
    dx, dy = bx - ax, by - ay
    along, len2, cross = (x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy, (x - ax) * dy - (y - ay) * dx
    return F.when((len2 == 0) | (along <= 0), (x - ax) * (x - ax) + (y - ay) * (y - ay)).when(along >= len2, (x - bx) * (x - bx) + (y - by) * (y - by)).otherwise(cross * cross / len2)


def _in_box() -> Column:
    return F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1"))


def _kinds(lines: DataFrame) -> list[bool]:
    """Straight lines (False), and bent ones (True) if there are any, so that the join is not planned twice for none."""
    return [False] if lines.where(F.size("line") > 2).isEmpty() else [False, True]


def _repeated(rows: DataFrame, keys: list[str]) -> bool:
    """Whether some key has several rows; keys are small beside what a join makes of them."""
    return not rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()


def _point_cells(points: DataFrame, point_keys: list[str], width: float) -> DataFrame:
    cells = points.select(*point_keys, "x", "y", G.cell(F.col("x"), width).alias("_cx"), G.cell(F.col("y"), width).alias("_cy"))
    return shapes(cells, ["_cx", "_cy", "x", "y"], point_keys, "_points", ["_cx", "_cy"])


def within_distance(lines: DataFrame, points: DataFrame, limit: float, line_keys: list[str], point_keys: list[str], width: float | None = None, digits: int | None = None) -> DataFrame:
    """Pairs of a line (column ``line``) and a point (``x, y``) at most ``limit`` apart, with ``distance`` (rounded to ``digits``, if given) and ``shortest_line``.

    A point and the segments that come near to its cell meet once, so a pair is complete where it is found and is not shuffled; pairs are
    grouped only where several rows have the same key.  Rounding is costly beside the rest, so it is done before points of one place are expanded.
    """
    distance = F.sqrt("_near.d2") if digits is None else F.round(F.sqrt("_near.d2"), digits)
    width = width or 4 * limit
    b = _point_cells(points, point_keys, width)
    found = []
    for bent in _kinds(lines):
        a, foot = _near(lines, limit, width, line_keys)[bent], _foot(bent)
        met = a.hint("merge").join(b, ["_cx", "_cy"]).where(_in_box())
        # of a straight line the distance is generated code on columns
        near = met.where(_apart() <= limit * limit).select(*line_keys, "_points", foot.alias("_near"), "x", "y") if not bent else met.select(*line_keys, "_points", foot.alias("_near"), "x", "y").where(F.col("_near.d2") <= limit * limit)
        shortest = F.array(G.point(F.col("_near.x"), F.col("_near.y")), G.point(F.col("x"), F.col("y")))
        found.append(near.select(*line_keys, distance.alias("distance"), shortest.alias("shortest_line"), F.col("_near").alias("_at"), "_points"))
    pairs = expanded(reduce(DataFrame.unionByName, found), "_points")
    out = [*line_keys, *point_keys, "distance", "shortest_line"]
    if not (_repeated(lines, line_keys) or _repeated(points, point_keys)):
        return pairs.select(*out)
    best = pairs.groupBy(*line_keys, *point_keys).agg(F.min_by(F.struct("distance", "shortest_line"), F.struct("_at", "shortest_line")).alias("_best"))
    return best.select(*line_keys, *point_keys, "_best.*")


def near_points(lines: DataFrame, points: DataFrame, limit: float, point_keys: list[str], width: float | None = None) -> DataFrame:
    """Keys of the points with a line at most ``limit`` apart, each once: a point is settled by the first such line, so the pairs are never made."""
    width = width or 4 * limit
    b = _point_cells(points, point_keys, width)
    rows, cells = _near(lines, limit, width, []), ["_cx", "_cy"]

    def beside(a: DataFrame, kind: bool) -> Column:
        on = F.lit(True)
        for c in cells:
            on = on & (b[c] == F.col(f"a.{c}"))
        return on & _in_box() & ((_foot(True)["d2"] if kind else _apart()) <= limit * limit)

    found = [b.join(rows[kind].alias("a").hint("merge"), beside(rows[kind], kind), "left_semi").select("_points") for kind in _kinds(lines)]
    return expanded(reduce(DataFrame.unionByName, found), "_points").distinct()


def _is_box(polygon: Column, b: Column) -> Column:
    """Whether a polygon is the box of its ring, of some width and height: four corners in turn."""
    ring = polygon[0]
    corner = lambda p: ((p["x"] == b["min_x"]) | (p["x"] == b["max_x"])) & ((p["y"] == b["min_y"]) | (p["y"] == b["max_y"]))
    turns = F.forall(G.segments(ring), lambda s: (s["a"]["x"] == s["b"]["x"]) != (s["a"]["y"] == s["b"]["y"]))
    sides = lambda i, j: F.get(ring, i)[j] == F.get(ring, i + 1)[j]
    closed = F.get(ring, 0) == F.get(ring, 4)
    return (F.size(polygon) == 1) & (F.size(ring) == 5) & closed & F.forall(ring, corner) & turns & (sides(0, "x") != sides(1, "x")) & (b["min_x"] < b["max_x"]) & (b["min_y"] < b["max_y"])


def points_in_polygons(points: DataFrame, polygons: DataFrame, width: float, boundary: bool = False) -> DataFrame:
    """Points (``x, y``) joined with the polygons (column ``polygon``) that they are in; ``boundary`` as in ``in_polygon``.

    Equal places and equal polygons are tested once and expanded; a box needs no test but that of its bounds.
    """
    payload = [c for c in points.columns if c not in ("x", "y")]
    cells = points.withColumns({"_cx": G.cell(F.col("x"), width), "_cy": G.cell(F.col("y"), width)})
    b = shapes(cells, ["_cx", "_cy", "x", "y"], payload, "_points", ["_cx", "_cy"])
    a = shapes(polygons, ["polygon"], [c for c in polygons.columns if c != "polygon"], "_polygons").withColumn("_b", G.bounds(F.col("polygon")[0]))
    a = a.withColumn("_rings", F.when(~F.coalesce(_is_box(F.col("polygon"), F.col("_b")), F.lit(False)), G.rings_of(F.col("polygon")))).select("polygon", "_polygons", "_rings", "_b.*")
    a = cut(a)
    boxes_only = a.where("_rings IS NOT NULL").isEmpty()
    a = _celled(a, G.cells_of_box(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), width))
    inside = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    strict = (F.col("x") > F.col("min_x")) & (F.col("x") < F.col("max_x")) & (F.col("y") > F.col("min_y")) & (F.col("y") < F.col("max_y"))
    boxed, other = (b.join(part.hint("merge"), ["_cx", "_cy"]).where(inside) for part in (a.where("_rings IS NULL"), a.where("_rings IS NOT NULL")))
    boxed = boxed if boundary else boxed.where(strict)
    other = other.where(G.in_rings(F.col("x"), F.col("y"), F.col("_rings"), boundary))
    met = (boxed if boxes_only else boxed.unionByName(other)).select("x", "y", "polygon", "_points", "_polygons")
    return expanded(met, "_points", "_polygons").select(*points.columns, *polygons.columns)


def _met(lines: DataFrame, polygons: DataFrame, width: float, line_keys: list[str], polygon_keys: list[str]) -> DataFrame:
    """``line, polygon`` that have a point in common, each pair of shapes once, with the keys ``_lines`` and ``_polygons``."""
    a = shapes(polygons, ["polygon"], polygon_keys, "_polygons").withColumn("_b", G.bounds(F.col("polygon")[0]))
    a = cut(a.select("polygon", "_polygons", "_b.*", F.coalesce(_is_box(F.col("polygon"), F.col("_b")), F.lit(False)).alias("_box")))
    boxes_only = a.where("NOT _box").isEmpty()
    a = _celled(a, G.cells_of_box(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), width))
    s = shapes(lines, ["line"], line_keys, "_lines")
    s = segment_rows(s, ["line", "_lines"]).withColumns({"_x0": F.least("ax", "bx"), "_y0": F.least("ay", "by"), "_x1": F.greatest("ax", "bx"), "_y1": F.greatest("ay", "by")})
    b = _celled(s, G.cells_of_box(F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"), width))
    boxes = (F.col("_x0") <= F.col("max_x")) & (F.col("_x1") >= F.col("min_x")) & (F.col("_y0") <= F.col("max_y")) & (F.col("_y1") >= F.col("min_y"))
    # of the cells that a segment and a polygon share the lowest one reports them
    lowest = (F.col("_cx") == G.cell(F.greatest("_x0", "min_x"), width)) & (F.col("_cy") == G.cell(F.greatest("_y0", "min_y"), width))
    met = dealt(b, "_cx", "_cy").hint("merge").join(dealt(a, "_cx", "_cy"), ["_cx", "_cy"]).where(boxes & lowest)
    segment = F.array(G.point(F.col("ax"), F.col("ay")), G.point(F.col("bx"), F.col("by")))
    # a box whose bounds meet a segment's is met unless all its corners are on one side of the segment
    turns = [(F.col("bx") - F.col("ax")) * (F.col(y) - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col(x) - F.col("ax")) for x in ("min_x", "max_x") for y in ("min_y", "max_y")]
    boxed = met.where(F.col("_box") & (F.least(*turns) <= 0) & (F.greatest(*turns) >= 0))
    met = boxed if boxes_only else boxed.unionByName(met.where(~F.col("_box")).where(G.line_intersects_polygon(segment, F.col("polygon"))))
    met = met.select("line", "polygon", "_lines", "_polygons")
    return reduce(DataFrame.unionByName, [met.where(F.size("line") > 2).distinct() if bent else met.where(F.size("line") <= 2) for bent in _kinds(lines)])  # a bent line's segments report it each


def lines_in_polygons(lines: DataFrame, polygons: DataFrame, width: float, line_keys: list[str], polygon_keys: list[str]) -> DataFrame:
    """Distinct pairs of a line (``line``) and a polygon that have a point in common; polygons are cut into cells of ``width``.

    Equal lines and equal polygons are tested once: segments are joined, and both boxes tested, before the exact test.
    """
    pairs = expanded(_met(lines, polygons, width, line_keys, polygon_keys), "_lines", "_polygons").select(*line_keys, *polygon_keys)
    return pairs.distinct() if _repeated(lines, line_keys) or _repeated(polygons, polygon_keys) else pairs


def polygons_per_line(lines: DataFrame, polygons: DataFrame, width: float, line_keys: list[str], polygon_keys: list[str]) -> DataFrame:
    """``line_keys, n``: the number of polygons that each line meets, where there are any, counted without listing the pairs of equal polygons."""
    if _repeated(lines, line_keys) or _repeated(polygons, polygon_keys):
        return lines_in_polygons(lines, polygons, width, line_keys, polygon_keys).groupBy(*line_keys).agg(F.count(F.lit(1)).alias("n"))
    met = _met(lines, polygons, width, line_keys, polygon_keys).select("_lines", F.size("_polygons").alias("_n"))
    return expanded(met, "_lines").groupBy(*line_keys).agg(F.sum("_n").alias("n"))


def lengths_in_polygons(lines: DataFrame, polygons: DataFrame, width: float, line_keys: list[str], polygon_keys: list[str]) -> DataFrame:
    """Keys and ``length`` of what each line has in each polygon, where that is more than points; cut once for equal lines and equal polygons."""
    parts = _met(lines, polygons, width, line_keys, polygon_keys).withColumn("_parts", X.line_intersection("line", "polygon")).where(F.size("_parts") > 0)
    length = F.aggregate(F.transform("_parts", G.planar_length), F.lit(0.0), lambda a, x: a + x)
    got = expanded(parts.select(length.alias("length"), "_lines", "_polygons"), "_lines", "_polygons").select(*line_keys, *polygon_keys, "length")
    if not (_repeated(lines, line_keys) or _repeated(polygons, polygon_keys)):
        return got
    return got.groupBy(*line_keys, *polygon_keys).agg(F.sum("length").alias("length"))


def quadrats(polygons: DataFrame, width: float) -> DataFrame:
    """A row for each cell of a polygon's bounding box: the subdivided spatial index."""
    rows = polygons.withColumn("_b", G.bounds(F.col("polygon")[0]))
    cells = G.cells_of_box(F.col("_b.min_x"), F.col("_b.min_y"), F.col("_b.max_x"), F.col("_b.max_y"), width)
    return rows.withColumn("_c", F.explode(cells)).withColumns({"cx": F.col("_c.cx"), "cy": F.col("_c.cy")}).drop("_b", "_c")


def two_pass_pairs(first: DataFrame, second: DataFrame, points: DataFrame, limit: float, line_keys: list[str], point_keys: list[str]) -> DataFrame:
    """Pairs with the first kind of lines; points without any are tried on the second kind.  ``road_span_type`` tells which."""
    a = within_distance(first, points, limit, line_keys, point_keys).withColumn("road_span_type", F.lit("NONBRIDGE"))
    rest = points.join(near_points(first, points, limit, point_keys), point_keys, "left_anti")
    b = within_distance(second, rest, limit, line_keys, point_keys).withColumn("road_span_type", F.lit("BRIDGE"))
    return a.unionByName(b)


def two_pass_kinds(first: DataFrame, second: DataFrame, points: DataFrame, limit: float, point_keys: list[str]) -> DataFrame:
    """``point_keys, road_span_type`` of the points that ``two_pass_pairs`` pairs, each once, without making the pairs."""
    a = cut(near_points(first, points, limit, point_keys))
    b = near_points(second, points.join(a, point_keys, "left_anti"), limit, point_keys)
    return a.withColumn("road_span_type", F.lit("NONBRIDGE")).unionByName(b.withColumn("road_span_type", F.lit("BRIDGE")))


def checked_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Union of tables that share no key; else an error."""
    require_disjoint(a, b, keys)
    return a.unionByName(b)


def pairing_summary(points: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``points`` with ``was_paired`` and ``paired_with``: the type of lines paired with, or BOTH."""
    types = pairs.groupBy(key).agg(F.collect_set("road_span_type").alias("_types"))
    out = points.join(types, key, "left")
    return out.withColumn("was_paired", F.col("_types").isNotNull()).withColumn("paired_with", F.when(F.size("_types") > 1, "BOTH").when(F.size("_types") == 1, F.col("_types")[0])).drop("_types")


def clip(points: DataFrame, region: Column, boundary: bool = False, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Points in one region (a polygon literal); a bounding box is tested first, so that it can reach the scan."""
    if box:
        points = points.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))
    return points.where(G.in_polygon(F.col("x"), F.col("y"), region, boundary))


def polygon_literal(rings: list[list[tuple[float, float]]]) -> Column:
    return F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in r]) for r in rings])
