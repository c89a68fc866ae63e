"""Delaunay triangles of each frame, and from them the Voronoi ridges, neighbours and boundary, relationally.

A Voronoi vertex is a triangle's circumcentre; a finite ridge joins the circumcentres of the two triangles at an
edge; an edge with one triangle has an infinite ridge.  So the tessellation is computed once, tile by tile, and
everything after it is joins and aggregates."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.sources.settled import settled

Point = tuple[float, float]
#: Points a tile of a frame has at most; a frame with fewer is one tile.
TILE = 2000
#: Tiles are halved at most so often.
_DEEPEST = 30
#: Two corners nearer than this part of a tile's side leave a circle undecided.
_NEAR = 1e-6


def _turn(a: Point, b: Point, c: Point) -> float:
    """Positive if c lies to the left of the line from a to b; its sign is exact."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    det = left - right
    if abs(det) > 4e-16 * (abs(left) + abs(right)) * 2:
        return det
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(x), Fraction(y)) for x, y in (a, b, c))
    exact = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (exact > 0) - (exact < 0)


def _in_circle(a: Point, b: Point, c: Point, p: Point) -> float:
    """Positive if p lies inside the circle through a, b, c (in left turn); its sign is exact.

    Of four points on one circle the first by coordinates counts as inside the circle of the others, as if it were lifted a
    little less; so every set of points has one triangulation, and its triangles are those of each part of it that has their
    corners.  A square is cut from its first corner to its last."""
    ax, ay, bx, by, cx, cy = a[0] - p[0], a[1] - p[1], b[0] - p[0], b[1] - p[1], c[0] - p[0], c[1] - p[1]
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    bc, ca, ab = bx * cy - by * cx, cx * ay - cy * ax, ax * by - ay * bx
    det = a2 * bc + b2 * ca + c2 * ab
    size = a2 * (abs(bx * cy) + abs(by * cx)) + b2 * (abs(cx * ay) + abs(cy * ax)) + c2 * (abs(ax * by) + abs(ay * bx))
    if abs(det) > 2e-15 * size:
        return det
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(q[0]) - Fraction(p[0]), Fraction(q[1]) - Fraction(p[1])) for q in (a, b, c))
    exact = (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx)
    if exact:
        return 1 if exact > 0 else -1
    first = min(a, b, c, p)
    if first == p:
        return 1
    return -(_turn(p, b, c) if first == a else _turn(a, p, c) if first == b else _turn(a, b, p))


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of three indices, in left turn) of distinct points by insertion.

    Points are taken along a snake through cells, so the triangle that holds the next point is a few steps from the
    last one.  From there the triangles whose circle holds the point are found over shared edges; they go, and their
    outline is joined to it.  About constant work a point."""
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), np.int64)
    low, high = points.min(axis=0), points.max(axis=0)
    size = float(max(high - low)) or 1.0
    (mx, my), far = ((low + high) / 2).tolist(), 1e6 * size
    xy: list[Point] = [*map(tuple, points.tolist()), (mx - far, my - far), (mx + far, my - far), (mx, my + far)]
    tri = [(n, n + 1, n + 2)]
    #: the triangle on the other side of each directed edge, by its corners in turn
    owner = {(n, n + 1): 0, (n + 1, n + 2): 0, (n + 2, n): 0}
    band = np.floor((points[:, 0] - low[0]) / size * np.sqrt(n) / 2).astype(int)
    order = np.lexsort((np.where(band % 2 == 0, points[:, 1], -points[:, 1]), band))
    last = 0
    for i in order.tolist():
        p = xy[i]
        at, seen = last, 0
        while True:
            a, b, c = tri[at]
            for u, v in ((a, b), (b, c), (c, a)):
                if _turn(xy[u], xy[v], p) < 0 and (v, u) in owner:
                    at = owner[v, u]
                    break
            else:
                break
            seen += 1
            if seen > len(tri):  # never in exact arithmetic
                break
        bad, todo, outline = {at}, [at], []
        while todo:
            a, b, c = tri[todo.pop()]
            for u, v in ((a, b), (b, c), (c, a)):
                over = owner.get((v, u))
                if over in bad:
                    continue
                if over is not None and _in_circle(*(xy[k] for k in tri[over]), p) > 0:
                    bad.add(over)
                    todo.append(over)
                else:
                    outline.append((u, v))
        inner = [(u, v) for u, v in outline if owner.get((v, u)) not in bad]
        for t in bad:
            a, b, c = tri[t]
            for e in ((a, b), (b, c), (c, a)):
                del owner[e]
        free = list(bad)
        for u, v in inner:
            if free:
                t = free.pop()
                tri[t] = (u, v, i)
            else:
                t = len(tri)
                tri.append((u, v, i))
            owner[u, v] = owner[v, i] = owner[i, u] = t
            last = t
    out = np.array(tri, np.int64).reshape(-1, 3)
    return out[(out < n).all(axis=1)]


def _circles_within(xy: np.ndarray, t: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Whether the circles of triangles lie inside a box (lowest and highest row, lowest and highest column), for sure."""
    a, b, c = (xy[t[:, m]] for m in range(3))
    b, c = b - a, c - a
    with np.errstate(all="ignore"):
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        b2, c2 = (b * b).sum(axis=1), (c * c).sum(axis=1)
        centre = np.stack([(c[:, 1] * b2 - b[:, 1] * c2) / d, (b[:, 0] * c2 - c[:, 0] * b2) / d], axis=1)
        radius = np.hypot(*centre.T)
        least = np.sqrt(np.minimum(np.minimum(b2, c2), ((b - c) ** 2).sum(axis=1)))
    side = max([x for x in (box[1] - box[0], box[3] - box[2]) if np.isfinite(x)], default=np.ptp(xy, axis=0).max(initial=1.0))
    slack = _NEAR * side
    centre = centre + a
    inside = np.isfinite(radius) & (least > _NEAR * side)
    for k in range(2):
        inside &= (centre[:, k] - radius > box[2 * k] + slack) & (centre[:, k] + radius < box[2 * k + 1] - slack)
    return inside


Edge = tuple[int, int]


def _merge(xy: np.ndarray, settled_left: set[Edge], box: tuple[float, float, float, float] | None) -> tuple[np.ndarray, set[Edge], np.ndarray]:
    """Triangles of a tile that are final, the outline of all that is final, and which points are still open.

    ``settled_left`` is the outline of what its parts have made final, which lies to the left of these edges.  Its edges
    are edges of the triangulation of the open points too; what lies beyond them is left out here.  A triangle is final
    if no other tile can have a point in its circle (``box`` is the tile's area); the whole frame has no ``box``."""
    t = delaunay(xy)
    edges = [[(a, b), (b, c), (c, a)] for a, b, c in t.tolist()]
    owner = {e: k for k, own in enumerate(edges) for e in own}
    gone = {owner[e] for e in settled_left if e in owner}
    todo = list(gone)
    while todo:
        for u, v in edges[todo.pop()]:
            over = owner.get((v, u))
            if over is not None and over not in gone and (u, v) not in settled_left:
                gone.add(over)
                todo.append(over)
    true = np.array([k for k in range(len(t)) if k not in gone], np.int64)
    final = true if box is None else true[_circles_within(xy, t[true], box)]
    every = settled_left | {e for k in final.tolist() for e in edges[k]}
    outline = {(u, v) for u, v in every if (v, u) not in every}
    touched, open_ = np.zeros(len(xy), bool), np.zeros(len(xy), bool)
    touched[[x for e in every for x in e]] = True
    open_[[x for e in outline for x in e]] = True
    return t[final], outline, open_ | ~touched


#: Rows that go from tiles to the next: open points, the outline of what is final, and final triangles.
_POINT, _EDGE, _FINAL = range(3)
_CORNERS = [f"{c}{m}" for m in range(3) for c in ("id", "image", "row", "col")]


def _tiles(p: DataFrame, height: float | None, tile: int) -> tuple[DataFrame, int]:
    """Points (frame, id, row, col) with their images, and the deepest tile's depth.

    Adds the frame's square (``__r0, __c0, __side``) and each point's tile: ``__depth`` halvings, ``__ci, __cj``.  A tile is
    halved while it has more than ``tile`` points; points are counted at all depths that the largest frame asks for at
    once, and again deeper where that is not enough.  Frames with repeated places are left out."""
    shifts, h = ((0,), 0.0) if height is None else ((-1, 0, 1), float(height))
    places = p.groupBy("frame", "row", "col").agg(F.count("*").alias("n"))
    box = places.groupBy("frame").agg(F.max("n").alias("n"), F.count("*").alias("m"), *[f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("low", F.min), ("high", F.max))]).where(F.col("n") == 1)
    side = F.greatest(F.col("high_row") - F.col("low_row") + 2 * h, F.col("high_col") - F.col("low_col"))
    box = settled(box.select("frame", (F.col("m") * len(shifts)).alias("__n"), (F.col("low_row") - h).alias("__r0"), F.col("low_col").alias("__c0"), F.when(side > 0, side).otherwise(1.0).alias("__side")))
    p = p.join(box, "frame").withColumn("image", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumn("row", F.col("row") + F.col("image") * h)
    cell = lambda c, low, depth: F.least(F.floor((F.col(c) - F.col(low)) / F.col("__side") * F.pow(F.lit(2.0), depth)), F.pow(F.lit(2.0), depth) - 1).cast("long")
    p = p.withColumn("__fi", cell("row", "__r0", F.lit(float(_DEEPEST)))).withColumn("__fj", cell("col", "__c0", F.lit(float(_DEEPEST))))
    whole = p.where(F.col("__n") <= tile).withColumn("__depth", F.lit(0))
    rest, done = p.where(F.col("__n") > tile), whole
    # the depth of even tiles and three more; then on where points crowd
    depth = deepest = 0
    most = box.agg(F.max("__n").alias("n")).first()["n"] or 0
    while most > tile and depth < _DEEPEST:
        step = min(_DEEPEST, depth + 3 + int(np.ceil(np.log(most / tile) / np.log(4))))
        at = lambda d: (F.shiftright("__fi", _DEEPEST - d), F.shiftright("__fj", _DEEPEST - d))
        cells = rest.groupBy("frame", *[x.alias(n) for x, n in zip(at(step), ("__i", "__j"))]).agg(F.count("*").alias("__m"))
        for d in range(step - 1, depth, -1):
            up = Window.partitionBy("frame", F.shiftright("__i", step - d), F.shiftright("__j", step - d))
            cells = cells.withColumn(f"__m{d}", F.sum("__m").over(up))
        found = F.coalesce(*[F.when(F.col(f"__m{d}") <= tile, d) for d in range(depth + 1, step)], F.when((F.col("__m") <= tile) | F.lit(step == _DEEPEST), step))
        cells = settled(cells.select("frame", "__i", "__j", "__m", found.alias("__depth")))
        placed = rest.drop("__depth").withColumn("__i", at(step)[0]).withColumn("__j", at(step)[1]).join(cells.drop("__m"), ["frame", "__i", "__j"]).drop("__i", "__j")
        done = done.unionByName(placed.where(F.col("__depth").isNotNull()))
        rest = placed.where(F.col("__depth").isNull())
        seen = cells.agg(F.max("__depth").alias("d"), F.max(F.when(F.col("__depth").isNull(), F.col("__m"))).alias("n")).first()
        most, depth, deepest = seen["n"] or 0, step, max(deepest, seen["d"] or 0)
    up = lambda c: F.expr(f"shiftright({c}, {_DEEPEST} - __depth)")
    return done.withColumn("__ci", up("__fi")).withColumn("__cj", up("__fj")).drop("__n", "__fi", "__fj"), deepest


def triangulate(points: DataFrame, height: float | None = None, by: str = "frame", key: str = "region_id", tile: int = TILE) -> DataFrame:
    """``frame, i, j, k`` and the corners' coordinates: the Delaunay triangles of each frame.

    With ``height`` rows wrap: each point also stands one height above and below.  Corners then carry the point's id
    and their image (-1, 0, 1), and triangles without an original corner are left out.  Frames with fewer than three
    points or with repeated points have none.

    Tiles of at most ``tile`` points are triangulated apart.  Triangles whose circles lie inside their tile are final.  Four
    tiles at a time are then joined: only points that final triangles don't surround yet, and the outline of what is
    final, go on, which is about the root of a tile's points.  So no task has a large frame; on points that all lie
    along one curve nothing is final before the end, and a task has them all."""
    kinds = dict(points.dtypes)
    p = points.select(F.col(by).alias("frame"), F.col(key).alias("id"), F.col("row").cast("double").alias("row"), F.col("col").cast("double").alias("col"))
    schema = f"frame {kinds[by]}, kind int, r0 double, c0 double, side double, depth int, ci long, cj long, " + ", ".join(f"id{m} {kinds[key]}, image{m} int, row{m} double, col{m} double" for m in range(3))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        given = pdf[pdf["kind"] == _POINT].sort_values(["row0", "col0"])
        xy = given[["row0", "col0"]].to_numpy(float)
        ids, image = given["id0"].to_numpy(), given["image0"].to_numpy()
        at = {x: n for n, x in enumerate(zip(ids.tolist(), image.tolist()))}
        e = pdf[pdf["kind"] == _EDGE]
        edges = {(at[a], at[b]) for a, b in zip(zip(e["id0"].tolist(), e["image0"].tolist()), zip(e["id1"].tolist(), e["image1"].tolist()))}
        head = pdf.iloc[0]
        depth, ci, cj = int(head["depth"]), int(head["ci"]), int(head["cj"])
        box = None
        if depth:
            unit, last = head["side"] / 2**depth, 2**depth - 1
            edge = lambda low, k, n, open_: open_ if n == k else low + n * unit
            box = (edge(head["r0"], 0, ci, -np.inf), edge(head["r0"], last + 1, ci + 1, np.inf), edge(head["c0"], 0, cj, -np.inf), edge(head["c0"], last + 1, cj + 1, np.inf))
        t, outline, open_ = _merge(xy, edges, box)
        t = t[(image[t] == 0).any(axis=1)] if len(t) else t
        parts = [(_FINAL, t)]
        if depth:
            more, still = np.array(sorted(outline), np.int64).reshape(-1, 2), np.flatnonzero(open_)
            parts += [(_EDGE, more[:, [0, 1, 0]]), (_POINT, np.stack([still] * 3, axis=1))]
        k = np.concatenate([c for _, c in parts]).astype(np.int64)
        n = len(k)
        made = {"frame": [head["frame"]] * n, "kind": np.repeat([x for x, _ in parts], [len(c) for _, c in parts])}
        made |= {c: np.full(n, x) for c, x in (("r0", head["r0"]), ("c0", head["c0"]), ("side", head["side"]), ("depth", depth - 1), ("ci", ci // 2), ("cj", cj // 2))}
        for m in range(3):
            made |= {f"id{m}": ids[k[:, m]], f"image{m}": image[k[:, m]], f"row{m}": xy[k[:, m], 0], f"col{m}": xy[k[:, m], 1]}
        return pd.DataFrame(made)[names]

    # what a row has fewer of than three repeats its first, so that nothing is missing
    corners = [F.col(c).alias(f"{c}{m}") for m in range(3) for c in ("id", "image", "row", "col")]
    tiled, deepest = _tiles(p, height, tile)
    state = tiled.select("frame", F.lit(_POINT).alias("kind"), F.col("__r0").alias("r0"), F.col("__c0").alias("c0"), F.col("__side").alias("side"), F.col("__depth").alias("depth"), F.col("__ci").alias("ci"), F.col("__cj").alias("cj"), *corners)
    triangles = ["frame", *_CORNERS]
    if deepest:
        state = settled(state)
    out = None
    for depth in range(deepest, -1, -1):
        here = state.where(F.col("depth") == depth).groupBy("frame", "ci", "cj").applyInPandas(run, schema)
        if depth:
            here = settled(here)
            state = state.where(F.col("depth") < depth).unionByName(here.where(F.col("kind") != _FINAL))
        final = here.where(F.col("kind") == _FINAL).select(*triangles)
        out = final if out is None else out.unionByName(final)
    return out.withColumns(circumcircle())


def circumcircle() -> dict[str, Column]:
    """Circumcentre, circumradius and area of rows with corners row0..2, col0..2, relative to the first corner."""
    b = [F.col(f"{c}1") - F.col(f"{c}0") for c in ("row", "col")]
    c = [F.col(f"{x}2") - F.col(f"{x}0") for x in ("row", "col")]
    d = 2 * (b[0] * c[1] - b[1] * c[0])
    b2, c2 = b[0] * b[0] + b[1] * b[1], c[0] * c[0] + c[1] * c[1]
    dr, dc = F.try_divide(c[1] * b2 - b[1] * c2, d), F.try_divide(b[0] * c2 - c[0] * b2, d)
    return {"cc_row": F.col("row0") + dr, "cc_col": F.col("col0") + dc, "circumradius": F.hypot(dr, dc), "area": F.abs(d) / 4}


def _corners(triangles: DataFrame) -> DataFrame:
    """One row for each corner of each triangle."""
    corner = lambda m: F.struct(F.col(f"id{m}").alias("id"), F.col(f"image{m}").alias("image"), F.col(f"row{m}").alias("row"), F.col(f"col{m}").alias("col"))
    return triangles.select("frame", "cc_row", "cc_col", F.explode(F.array(*map(corner, range(3)))).alias("p")).select("frame", "cc_row", "cc_col", "p.*")


def ridges(triangles: DataFrame) -> DataFrame:
    """``frame, src, dst, theta, ridge_len2, finite``: both directions of every Delaunay edge at an original point.

    ``ridge_len2`` is the squared distance of the circumcentres of the edge's two triangles, null for an infinite
    ridge.  Across the seam ``dst`` is the point's own id."""
    corner = lambda m: F.struct(F.col(f"id{m}").alias("id"), F.col(f"image{m}").alias("image"), F.col(f"row{m}").alias("row"), F.col(f"col{m}").alias("col"))
    pairs = [(0, 1), (1, 0), (1, 2), (2, 1), (0, 2), (2, 0)]
    directed = triangles.select("frame", "cc_row", "cc_col", F.explode(F.array(*[F.struct(corner(a).alias("a"), corner(b).alias("b")) for a, b in pairs])).alias("e")).where(F.col("e.a.image") == 0)
    grouped = directed.groupBy("frame", F.col("e.a.id").alias("src"), F.col("e.b.id").alias("dst"), F.col("e.b.image").alias("image")).agg(
        F.first(F.atan2(F.col("e.b.row") - F.col("e.a.row"), F.col("e.b.col") - F.col("e.a.col"))).alias("theta"),
        F.count("*").alias("n"),
        F.max("cc_row").alias("r1"),
        F.min("cc_row").alias("r0"),
        F.max("cc_col").alias("c_max"),
        F.min("cc_col").alias("c_min"),
    )
    # two circumcentres: their columns differ by the range of columns whichever way rows go
    len2 = F.pow(F.col("r1") - F.col("r0"), F.lit(2)) + F.pow(F.col("c_max") - F.col("c_min"), F.lit(2))
    return grouped.select("frame", "src", "dst", "theta", F.when(F.col("n") == 2, len2).alias("ridge_len2"), (F.col("n") == 2).alias("finite"))


def boundary(points: DataFrame, triangles: DataFrame, height: float, width: float, periodic: bool, by: str = "frame", key: str = "region_id") -> DataFrame:
    """``frame, region_id, boundary``: cells that are unbounded or have a vertex outside the image (pixel edges are at
    -0.5 and size - 0.5; with ``periodic`` rows never are).  Points without triangles are all boundary, and so are
    frames of fewer than four points."""
    outside = (F.col("cc_col") < -0.5) | (F.col("cc_col") > width - 0.5)
    if not periodic:
        outside = outside | (F.col("cc_row") < -0.5) | (F.col("cc_row") > height - 0.5)
    own = _corners(triangles).where(F.col("image") == 0).groupBy("frame", F.col("id").alias("region_id")).agg(F.bool_or(outside).alias("out"))
    open_ = ridges(triangles).groupBy("frame", F.col("src").alias("region_id")).agg(F.bool_or(~F.col("finite")).alias("open"))
    few = points.groupBy(F.col(by).alias("frame")).agg((F.count("*") < 4).alias("few"))
    every = points.select(F.col(by).alias("frame"), F.col(key).alias("region_id"))
    joined = every.join(own, ["frame", "region_id"], "left").join(open_, ["frame", "region_id"], "left").join(few, "frame")
    flagged = F.coalesce(F.col("out") | F.col("open"), F.lit(True)) | F.col("few")
    return joined.select("frame", "region_id", flagged.alias("boundary"))


def neighbours(triangles: DataFrame) -> DataFrame:
    """``frame, src, dst``: distinct Delaunay neighbours by id; a point is never its own."""
    return ridges(triangles).where(F.col("src") != F.col("dst")).select("frame", "src", "dst").distinct()
