"""Polygons and lines on a lattice of squares: covers, points inside, cells met, covered area.

A shape's edges are walked through the squares they touch. A row of squares then holds squares that an
edge cuts and, between them, runs that lie wholly inside or outside; how many edges pass to the left of a
square's corner says which. So only points in cut squares meet edges, and only those of their square.

Coordinates are divided by the size of a square and shifted by irrational parts of one, so that lattice
lines are whole numbers and no edge between round coordinates runs along them or through a corner.

For points inside, squares are halved along each axis until they are no wider and no higher than the
polygon, so that many small or thin polygons do not share one square; a point is looked up once for each of
the few forms of squares in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.session import cut as cut_table

SIZE = 0.05   # degrees
BLOCK = 16    # squares of a run that are kept as one piece
HALVINGS = 24  # at most, of a square along one axis
SUBCELLS = 32  # parts of a cell per axis in which edges of two footprints meet

XY = ("x1", "y1", "x2", "y2")
SHIFT = (2 ** 0.5 - 1, 3 ** 0.5 - 1)


def ring_edges(shapes: DataFrame, key: str) -> DataFrame:
    """(key, x1, y1, x2, y2) of every ring; ``rings`` is array<array<struct<x, y>>>, holes included."""
    r = shapes.select(key, F.explode("rings").alias("r")).where(F.size("r") >= 3)
    nxt = lambda i: F.element_at("r", F.when(i == F.size("r"), 1).otherwise(i + 1))
    return _pairs(r, key, F.transform(F.sequence(F.lit(1), F.size("r")), lambda i: F.struct(F.element_at("r", i).alias("a"), nxt(i).alias("b"))))


def line_edges(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep.., x1, y1, x2, y2) of every line; ``vertices`` is array<struct<x, y>>."""
    d = lines.where(F.size("vertices") >= 2)
    v = F.transform(F.sequence(F.lit(1), F.size("vertices") - 1), lambda i: F.struct(F.element_at("vertices", i).alias("a"), F.element_at("vertices", i + 1).alias("b")))
    return _pairs(d, list(keep), v)


def _pairs(df: DataFrame, keep: str | list[str], pairs: Column) -> DataFrame:
    keep = [keep] if isinstance(keep, str) else keep
    e = df.select(*keep, F.explode(pairs).alias("s"))
    return e.select(*keep, F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def _on_lattice(c: str, axis: int, size: float | Column) -> Column:
    return F.col(c) / size + SHIFT[axis]


def _scaled(edges: DataFrame, size: float) -> DataFrame:
    return edges.withColumns({c: _on_lattice(c, k % 2, size) for k, c in enumerate(XY)})


def _x_at(y: Column) -> Column:
    """Where an edge crosses a parallel; null for an edge along it."""
    return F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))


def _y_at(x: Column) -> Column:
    return F.col("y1") + (F.col("y2") - F.col("y1")) * (x - F.col("x1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0))


def _rows(scaled: DataFrame) -> DataFrame:
    """One row per edge and row ``j`` of squares that it touches."""
    return scaled.withColumn("j", F.explode(F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2")))))


def squares_touched(scaled: DataFrame) -> DataFrame:
    """One row per scaled edge and square (i, j) that it touches; a long edge costs its length, not its box."""
    return _squares(_rows(scaled))


def _squares(d: DataFrame) -> DataFrame:
    lo, hi, j = F.least("y1", "y2"), F.greatest("y1", "y2"), F.col("j")
    a, b = F.coalesce(_x_at(F.greatest(lo, j)), F.col("x1")), F.coalesce(_x_at(F.least(hi, j + 1)), F.col("x2"))
    w, e = F.greatest(F.least(a, b), F.least("x1", "x2")), F.least(F.greatest(a, b), F.greatest("x1", "x2"))
    return d.withColumn("i", F.explode(F.sequence(F.floor(w), F.floor(e))))


def cover(scaled: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Squares of each polygon: (keys.., i, j, odd, edge..) where it is cut, and (keys.., lvl, k, j) wholly inside.

    ``odd`` tells whether the corner of a cut square lies inside. Inside pieces are single squares
    (lvl 1) or blocks of ``BLOCK`` in a row. Windows run along one row of one polygon.
    """
    here = [*keys, "j"]
    # rows grow into many squares, so the partition count is stated; all that follows goes by polygon and row
    rows = _rows(scaled).repartition(int(scaled.sparkSession.conf.get("spark.sql.shuffle.partitions")), *here)
    touched = _squares(rows)
    left = F.greatest("y1", "y2") > F.col("j")
    passed = (rows.where((F.least("y1", "y2") <= F.col("j")) & left)
              .select(*here, F.ceil(_x_at(F.col("j").cast("double"))).alias("i"), F.lit(1).alias("n"), F.lit(0).alias("is_cut")))
    cut = touched.select(*here, "i").distinct()
    marks = (passed.unionByName(cut.select(*here, "i", F.lit(0).alias("n"), F.lit(1).alias("is_cut")))
             .unionByName(cut.select(*here, (F.col("i") + 1).alias("i"), F.lit(0).alias("n"), F.lit(0).alias("is_cut")))
             .groupBy(*here, "i").agg(F.sum("n").alias("n"), F.max("is_cut").alias("is_cut")))
    row = Window.partitionBy(*here).orderBy("i")
    d = marks.withColumn("odd", F.sum("n").over(row.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1).withColumn(
        "stop", F.min(F.when(F.col("is_cut") == 1, F.col("i"))).over(row.rowsBetween(1, Window.unboundedFollowing)))
    parity = d.where("is_cut = 1").select(*here, "i", "odd")
    runs = d.where((F.col("is_cut") == 0) & F.col("odd") & (F.col("stop") > F.col("i")))
    # a mark between two cut squares begins the only run there
    runs = runs.groupBy(*here, "stop").agg(F.min("i").alias("start"))
    a, b = F.ceil(F.col("start") / BLOCK), F.floor(F.col("stop") / BLOCK)
    span = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
    whole = runs.select(*here, F.lit(BLOCK).alias("lvl"), F.explode(span(a, b)).alias("k"))
    ones = F.when(a < b, F.concat(span(F.col("start"), a * BLOCK), span(b * BLOCK, F.col("stop")))).otherwise(span(F.col("start"), F.col("stop")))
    inside = whole.unionByName(runs.select(*here, F.lit(1).alias("lvl"), F.explode(ones).alias("k")))
    return touched.join(parity, [*here, "i"]), inside


def _halvings(edges: DataFrame, key: str, size: float) -> DataFrame:
    """(key, hx, hy): how often squares are halved along each axis to be no larger than the polygon."""
    def times(a: str) -> Column:
        n = F.ceil(F.log2(F.lit(size) / F.nullif(F.max(a) - F.min(a), F.lit(0.0))))
        return F.coalesce(F.least(F.greatest(n, F.lit(0)), F.lit(HALVINGS)), F.lit(0)).cast("int")

    return edges.groupBy(key).agg(times("x1").alias("hx"), times("y1").alias("hy"))


def _fitted(size: float) -> list[Column]:
    return [F.lit(size) / F.pow(F.lit(2.0), F.col(h)) for h in ("hx", "hy")]


def fitted_cover(edges: DataFrame, key: str, size: float = SIZE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`cover` with squares (hx, hy, i, j) no larger than their polygon, and the distinct (hx, hy)."""
    halved, sizes = _halvings(edges, key, size), _fitted(size)
    scaled = edges.join(halved, key).withColumns({c: _on_lattice(c, k % 2, sizes[k % 2]) for k, c in enumerate(XY)})
    return *cover(scaled, [key, "hx", "hy"]), halved.select("hx", "hy").distinct()


def points_in_polygons(points: DataFrame, shapes: DataFrame, key: str = "cell_id", shape: str = "admin_id", size: float = SIZE) -> DataFrame:
    """(key, shape) for points (key, lon, lat) inside polygons.

    A point in an inside square needs no edge. In a cut square the edges between the square's corner and
    the point are counted, first up its left side and then across.
    """
    form = ["hx", "hy"]
    cut, inside, forms = fitted_cover(ring_edges(shapes.select(F.col(shape).alias("_shape"), "rings"), "_shape"), "_shape", size)
    sizes = _fitted(size)
    # forms of squares are no more than (HALVINGS + 1) squared, however many polygons there are
    p = points.select(F.col(key).alias("_point"), "lon", "lat").crossJoin(F.broadcast(forms))
    p = p.select("_point", *form, *[_on_lattice(c, k, sizes[k]).alias(v) for k, (c, v) in enumerate((("lon", "px"), ("lat", "py")))]).withColumn("i", F.floor("px")).withColumn("j", F.floor("py"))
    by_level = p.select("_point", *form, "j", F.explode(F.array(*[F.struct(F.lit(v).alias("lvl"), F.floor(F.col("i") / v).alias("k")) for v in (1, BLOCK)])).alias("s")).select("_point", *form, "j", "s.*")
    sure = by_level.join(inside, [*form, "lvl", "k", "j"]).select("_point", "_shape")
    y, x, i, j = _y_at(F.col("i").cast("double")), _x_at(F.col("py")), F.col("i"), F.col("j")
    up = ((F.col("x1") > i) != (F.col("x2") > i)) & (y > j) & (y <= F.col("py"))
    across = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (x > i) & (x <= F.col("px"))
    near = (p.join(cut, [*form, "i", "j"]).groupBy("_point", "_shape").agg(F.count_if(up).alias("u"), F.count_if(across).alias("a"), F.max(F.col("odd").cast("int")).alias("o"))
            .where((F.col("u") + F.col("a") + F.col("o")) % 2 == 1).select("_point", "_shape"))
    return sure.unionByName(near).select(F.col("_point").alias(key), F.col("_shape").alias(shape))


def segment_meets_box(x1, y1, x2, y2, w, s, e, n) -> Column:
    """Whether a segment meets a closed box: an end inside, or the line separates box corners within its span."""
    inside = x1.between(w, e) & y1.between(s, n) | x2.between(w, e) & y2.between(s, n)
    overlap = (F.least(x1, x2) <= e) & (F.greatest(x1, x2) >= w) & (F.least(y1, y2) <= n) & (F.greatest(y1, y2) >= s)
    side = lambda x, y: (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    corners = [side(w, s), side(w, n), side(e, s), side(e, n)]
    return inside | (overlap & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0))


def cell_boxes(cells: DataFrame) -> DataFrame:
    return cells.select("cell_id", F.col("sw_lon").alias("w"), F.col("sw_lat").alias("s"), (F.col("sw_lon") + F.col("step_lon")).alias("e"),
                        (F.col("sw_lat") + F.col("step_lat")).alias("n"))


def edges_on_cells(edges: DataFrame, cells: DataFrame, keep: list[str], size: float = SIZE) -> DataFrame:
    """(cell_id, keep..) for each edge that meets the box of a cell; both sides are keyed by squares."""
    packed = edges.select(F.struct(*keep).alias("_keep"), F.struct(*XY).alias("own"), *XY)
    own = squares_touched(_scaled(packed, size)).withColumns({c: F.col(f"own.{c}") for c in XY}).drop("own")
    box = cell_boxes(cells)
    f = lambda c, axis: F.floor(_on_lattice(c, axis, size))
    box = box.withColumn("i", F.explode(F.sequence(f("w", 0), f("e", 0)))).withColumn("j", F.explode(F.sequence(f("s", 1), f("n", 1))))
    hit = own.join(box, ["i", "j"]).where(segment_meets_box(*[F.col(c) for c in (*XY, "w", "s", "e", "n")]))
    return hit.select("cell_id", "_keep").distinct().select("cell_id", "_keep.*")


def cells_of_shapes(shapes: DataFrame, cells: DataFrame, key: str = "aoi_id", size: float = SIZE) -> DataFrame:
    """(key, cell_id) of every cell that a polygon (``rings``) or a line (``vertices``) meets.

    A cell meets a shape when an edge meets its box or, for a polygon, its corner lies inside. A row has
    rings, vertices or both; null and too short ones meet nothing. Holes are left out.
    """
    edges, polygon = None, None
    if "rings" in shapes.columns:
        polygon = shapes.where("rings is not null")
        edges = ring_edges(polygon, key)
    if "vertices" in shapes.columns:
        lines = line_edges(shapes.where("vertices is not null"), key)
        edges = lines if edges is None else edges.unionByName(lines)
    if edges is None:
        raise ValueError("shapes need rings or vertices")
    out = edges_on_cells(edges, cells, [key], size).select(key, "cell_id")
    if polygon is not None:
        corner = cells.select("cell_id", F.col("sw_lon").alias("lon"), F.col("sw_lat").alias("lat"))
        out = out.unionByName(points_in_polygons(corner, polygon, "cell_id", key, size).select(key, "cell_id"))
    return out.distinct()


def inner_points(shapes: DataFrame, key: str = "admin_id") -> DataFrame:
    """(key, lon, lat) of a point inside each polygon, also a concave one or one with holes.

    A parallel halfway between the vertices next to the middle of the polygon's height is cut by its
    edges; the point is the middle of the widest stretch inside (the leftmost of equal ones).
    """
    e = ring_edges(shapes, key)
    box = e.groupBy(key).agg(((F.min("y1") + F.max("y1")) / 2).alias("mid"))
    near = e.join(box, key).groupBy(key).agg(F.max(F.when(F.col("y1") <= F.col("mid"), F.col("y1"))).alias("lo"), F.min(F.when(F.col("y1") > F.col("mid"), F.col("y1"))).alias("hi"))
    line = near.select(key, ((F.col("lo") + F.col("hi")) / 2).alias("lat"))
    cuts = e.join(line, key).where((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))).select(key, "lat", _x_at(F.col("lat")).alias("x"))
    w = Window.partitionBy(key).orderBy("x")
    spans = cuts.withColumn("r", F.row_number().over(w)).withColumn("to", F.lead("x").over(w)).where("r % 2 = 1 and to is not null")
    best = spans.groupBy(key, "lat").agg(F.max(F.struct((F.col("to") - F.col("x")).alias("width"), (-F.col("x")).alias("neg"), "to")).alias("b"))
    return best.select(key, ((F.col("b.to") - F.col("b.neg")) / 2).alias("lon"), "lat")


def covered_share(footprints: DataFrame, cells: DataFrame, key: str = "building_id", size: float = 0.01) -> DataFrame:
    """Per cell the number of footprints (key, rings) that meet it and the exact share they cover together.

    A sweep along the parallel: a cell is cut into strips at every end of an edge, every crossing of two
    footprints' edges and of an edge with the cell's upper and lower side. Inside a strip edges do not
    cross, so the length covered at its middle times its width is its covered area. Edges meet only in
    the same part of a cell (SUBCELLS an axis), strips are met by the numbers of their ends, and the
    windows run along one cell's ends and within one strip. Footprints of equal rings are swept once.
    """
    # footprints with the same rings cover the same: one of them goes through the sweep, the others are counted
    whole_rings = footprints.where("rings is not null").groupBy(key).agg(F.flatten(F.array_sort(F.collect_list("rings"))).alias("rings"))
    footprints = cut_table(whole_rings.groupBy("rings").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("same")))
    meets = cut_table(cells_of_shapes(footprints, cells, key, size))
    boxes = cell_boxes(cells)
    count = meets.join(footprints.select(key, "same"), key).groupBy("cell_id").agg(F.sum("same").alias("building_count"))
    e = meets.join(ring_edges(footprints, key), key).join(boxes, "cell_id").where("x1 <> x2")
    turned = F.col("x1") > F.col("x2")
    e = e.select("cell_id", key, "w", "s", "e", "n", *[F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"))],
                 *[F.when(turned, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("x1", "x2"), ("y1", "y2"))])
    e = cut_table(e.withColumn("lo", F.greatest("x1", "w")).withColumn("hi", F.least("x2", "e")).where("lo < hi"))

    within = lambda x: x.isNotNull() & (x > F.col("lo")) & (x < F.col("hi"))
    sides = F.array_compact(F.array(F.col("w"), F.col("e"), F.col("lo"), F.col("hi"), *[F.when(within(_x_at(F.col(y))), _x_at(F.col(y))) for y in ("s", "n")]))
    ends = e.select("cell_id", F.explode(F.array_distinct(sides)).alias("x"))
    part = lambda v, a, b: F.least(F.greatest(F.floor((v - F.col(a)) / (F.col(b) - F.col(a)) * SUBCELLS), F.lit(0)), F.lit(SUBCELLS - 1))
    ya, yb = _y_at(F.col("lo")), _y_at(F.col("hi"))
    inside = e.withColumn("ya", F.least(ya, yb)).withColumn("yb", F.greatest(ya, yb)).where("ya <= n and yb >= s")
    parts = (inside.withColumn("pi", F.explode(F.sequence(part(F.col("lo"), "w", "e"), part(F.col("hi"), "w", "e"))))
             .withColumn("pj", F.explode(F.sequence(part(F.col("ya"), "s", "n"), part(F.col("yb"), "s", "n")))))
    one = lambda t: parts.select("cell_id", "pi", "pj", F.col(key).alias(f"k{t}"), *[F.col(c).alias(f"{c}{t}") for c in (*XY, "lo", "hi")])
    slope = lambda t: (F.col(f"y2{t}") - F.col(f"y1{t}")) / (F.col(f"x2{t}") - F.col(f"x1{t}"))
    both = one("a").join(one("b"), ["cell_id", "pi", "pj"]).where("ka < kb")
    cross = F.col("x1a") + (F.col("y1b") + slope("b") * (F.col("x1a") - F.col("x1b")) - F.col("y1a")) / F.nullif(slope("a") - slope("b"), F.lit(0.0))
    both = both.withColumn("x", cross).where((F.col("x") > F.greatest("loa", "lob")) & (F.col("x") < F.least("hia", "hib")))
    xs = ends.unionByName(both.select("cell_id", "x")).distinct()
    w = Window.partitionBy("cell_id").orderBy("x")
    xs = cut_table(xs.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("x").over(w)))

    ranked = (e.join(xs.select("cell_id", F.col("x").alias("lo"), F.col("r").alias("ra")), ["cell_id", "lo"])
              .join(xs.select("cell_id", F.col("x").alias("hi"), F.col("r").alias("rb")), ["cell_id", "hi"]))
    strips = ranked.withColumn("r", F.explode(F.sequence(F.col("ra"), F.col("rb") - 1))).join(xs.select("cell_id", "r", "x", "next"), ["cell_id", "r"])
    y = F.least(F.greatest(_y_at((F.col("x") + F.col("next")) / 2), F.col("s")), F.col("n"))
    d = strips.select("cell_id", "r", key, (F.col("next") - F.col("x")).alias("width"), y.alias("y"), ((F.col("e") - F.col("w")) * (F.col("n") - F.col("s"))).alias("whole"))
    of = Window.partitionBy("cell_id", "r", key).orderBy("y")
    d = d.withColumn("k", F.row_number().over(of)).withColumn("to", F.lead("y").over(of)).where("k % 2 = 1 and to > y")
    before = F.max("to").over(Window.partitionBy("cell_id", "r").orderBy("y", "to").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("to") - F.greatest(F.col("y"), F.coalesce(before, F.col("y"))), F.lit(0.0))
    area = d.withColumn("fresh", fresh).groupBy("cell_id").agg((F.sum(F.col("fresh") * F.col("width")) / F.max("whole")).alias("share"))
    out = cells.select("cell_id").join(count, "cell_id", "left").join(area, "cell_id", "left")
    return out.select("cell_id", F.coalesce("building_count", F.lit(0)).alias("building_count"), F.coalesce("share", F.lit(0.0)).alias("building_share"))
