"""Interpolation between scattered samples, on the triangles of their places.

Triangles stand in cells about as large as themselves, so that a point meets few of them whatever their sizes; what a point
needs comes along with its triangle.  Linear values are weighted corners.  Cubic ones first need a slope at every sample: the
slopes for which the curves along all edges bend least, found by rounds that send each sample's slope to its neighbours."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.operators.geometry import TILE, triangulate
from meshlark.operators.stats import finite
from meshlark.sources.settled import settled

#: How far outside a triangle, in parts of its height, a point still counts as on its edge.
EDGE = 1e-9
#: Rounds of the slopes; each divides the error by 3.7 at least.
ROUNDS = 18


def samples_of(field: DataFrame) -> DataFrame:
    """``field, x, y, u, v`` with finite numbers only; of samples at one place the least counts."""
    known = field.where(finite("u") & finite("v") & finite("x") & finite("y"))
    number = lambda c: F.col(c).cast("double") + F.lit(0.0)  # noqa: E731  no negative zeros
    return known.groupBy("field", number("x").alias("x"), number("y").alias("y")).agg(F.min(F.struct(F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))).alias("s")).select("field", "x", "y", "s.u", "s.v")


def mesh(samples: DataFrame, tile: int = TILE) -> DataFrame:
    """``field`` and corners ``x0, y0 ... x2, y2`` of the triangles of the samples' places."""
    places = samples.select("field", F.concat_ws(" ", "x", "y").alias("place"), F.col("y").alias("row"), F.col("x").alias("col"))
    made = triangulate(places, by="field", key="place", tile=tile)
    return made.select(F.col("frame").alias("field"), *[F.col(f"{a}{m}").alias(f"{b}{m}") for m in range(3) for a, b in (("col", "x"), ("row", "y"))])


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def weights(x: Column, y: Column, prefix: str = "") -> list[Column]:
    """The weights of a triangle's corners at a place: they sum to 1, and are not negative inside."""
    c = lambda n: F.col(f"{prefix}{n}")
    whole = _cross(c("x1") - c("x0"), c("y1") - c("y0"), c("x2") - c("x0"), c("y2") - c("y0"))
    one = _cross(x - c("x0"), y - c("y0"), c("x2") - c("x0"), c("y2") - c("y0")) / whole
    two = _cross(c("x1") - c("x0"), c("y1") - c("y0"), x - c("x0"), y - c("y0")) / whole
    return [1 - one - two, one, two]


def locate(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """``points`` (field, point, x, y) with ``t``, the triangle that holds them and its further columns, and their weights
    ``b0, b1, b2`` in it.  Points outside of all triangles are left out; on an edge one of its triangles holds them.

    A triangle stands in the cells that its bounding box meets, four at most, on a level whose cells are as large as it.
    Points look at the levels that their field has."""
    low, high = (lambda a: F.least(*[F.col(f"{a}{m}") for m in range(3)])), (lambda a: F.greatest(*[F.col(f"{a}{m}") for m in range(3)]))
    flat = _cross(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("x2") - F.col("x0"), F.col("y2") - F.col("y0")) == 0
    size = F.greatest(high("x") - low("x"), high("y") - low("y"))
    level = F.ceil(F.log2(size)).cast("int")
    at = lambda v, level: F.floor(v / F.pow(F.lit(2.0), level))
    boxed = triangles.where(~flat).withColumn("level", level)
    span = lambda a: F.explode(F.sequence(at(low(a), F.col("level")), at(high(a), F.col("level"))))
    listed = boxed.select("field", "level", F.struct(*[c for c in triangles.columns if c != "field"]).alias("t"), span("x").alias("cx"), *[F.col(f"y{m}") for m in range(3)])
    listed = listed.select("field", "level", "t", "cx", span("y").alias("cy"))
    levels = boxed.groupBy("field").agg(F.collect_set("level").alias("levels"))
    probes = points.join(levels, "field").select(*points.columns, F.explode("levels").alias("level"))
    probes = probes.withColumn("cx", at(F.col("x"), F.col("level"))).withColumn("cy", at(F.col("y"), F.col("level")))
    b = weights(F.col("x"), F.col("y"), "t.")
    met = probes.join(listed, ["field", "level", "cx", "cy"]).withColumns({f"b{m}": w for m, w in enumerate(b)})
    depth = F.least("b0", "b1", "b2")
    held = met.where(depth >= -EDGE).groupBy(*points.columns).agg(F.max_by(F.struct("t", "b0", "b1", "b2"), F.struct(depth, *[F.col(f"t.{a}{m}") for m in range(3) for a in "xy"])).alias("h"))
    return held.select(*points.columns, "h.*")


def with_corners(triangles: DataFrame, values: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Adds the ``names`` of the samples at a triangle's corners, numbered by corner."""
    for m in range(3):
        own = values.select("field", F.col("x").alias(f"x{m}"), F.col("y").alias(f"y{m}"), *[F.col(c).alias(f"{c}{m}") for c in names])
        triangles = triangles.join(own, ["field", f"x{m}", f"y{m}"])
    return triangles


def _zero_outside(points: DataFrame, found: DataFrame) -> DataFrame:
    keys = ["field", "point", "x", "y"]
    return points.select(*keys).join(found, keys, "left").fillna(0.0, ["u", "v"])


def linear(points: DataFrame, field: DataFrame, tile: int = TILE) -> DataFrame:
    """Velocity at points (field, point, x, y), linear on the triangles of a field's finite samples, which bridge what is
    missing; outside of them it is 0.  A grid's cells are cut from their lower left to their upper right corners."""
    samples = settled(samples_of(field))
    triangles = with_corners(mesh(samples, tile), samples, ("u", "v"))
    at = locate(points.select("field", "point", "x", "y"), triangles)
    value = lambda c: sum((F.col(f"b{m}") * F.col(f"t.{c}{m}") for m in range(1, 3)), F.col("b0") * F.col(f"t.{c}0"))
    return _zero_outside(points, at.select("field", "point", "x", "y", value("u").alias("u"), value("v").alias("v")))


def edges_of(triangles: DataFrame) -> DataFrame:
    """``field, x, y, ox, oy``: each edge of a mesh, from both of its ends."""
    end = lambda a, b: F.struct(F.col(f"x{a}").alias("x"), F.col(f"y{a}").alias("y"), F.col(f"x{b}").alias("ox"), F.col(f"y{b}").alias("oy"))
    return triangles.select("field", F.explode(F.array(*[end(a, b) for a, b in permutations(range(3), 2)])).alias("e")).select("field", "e.*").distinct()


def slopes(samples: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``field, x, y`` and ``u_x, u_y, v_x, v_y``: at each sample the slopes for which the cubic curves along the edges bend least.

    The bending of an edge is the integral of its squared second derivative over its length.  At its least, a sample's slope
    g obeys  sum 2 (g . e) e / |e|^3 = sum (3 df - g' . e) e / |e|^3  over its edges e, where df is the rise along the edge and g' the
    slope at its other end.  Half of the left side bounds the part of the neighbours, so solving for g again and again
    converges; Chebyshev's steps for that bound take about half of the rounds.  A round is one join and one sum."""
    other = samples.select("field", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("u").alias("ou"), F.col("v").alias("ov"))
    ex, ey = F.col("ox") - F.col("x"), F.col("oy") - F.col("y")
    cube = F.pow(ex * ex + ey * ey, F.lit(1.5))
    rises = edges.join(other, ["field", "ox", "oy"]).join(samples, ["field", "x", "y"])
    links = settled(rises.select("field", "x", "y", "ox", "oy", ex.alias("ex"), ey.alias("ey"), cube.alias("cube"), (F.col("ou") - F.col("u")).alias("du"), (F.col("ov") - F.col("v")).alias("dv")))
    ex, ey, cube = F.col("ex"), F.col("ey"), F.col("cube")
    keys = ["field", "x", "y"]
    matrix = [F.sum(2 * p * q / cube).alias(n) for n, p, q in (("xx", ex, ex), ("xy", ex, ey), ("yy", ey, ey))]
    fixed = [F.sum(3 * F.col(f"d{c}") * e / cube).alias(f"{c}{n}") for c in "uv" for n, e in (("x", ex), ("y", ey))]
    system = links.groupBy(*keys).agg(*matrix, *fixed)
    names = [f"{c}_{n}" for c in "uv" for n in "xy"]
    start = system.select("*", *[F.lit(0.0).alias(n) for n in names], *[F.lit(0.0).alias(f"{n}_before") for n in names])
    state = settled(start)
    # eigenvalues of a round lie within -1/2 and 1/2
    radius, step = 0.5, 1.0
    for k in range(rounds):
        step = 1.0 if k == 0 else 1 / (1 - radius * radius / 2) if k == 1 else 1 / (1 - radius * radius * step / 4)
        told = state.select("field", F.col("x").alias("ox"), F.col("y").alias("oy"), *[F.col(n).alias(f"o{n}") for n in names])
        along = lambda c: F.col(f"o{c}_x") * ex + F.col(f"o{c}_y") * ey
        sums = links.join(told, ["field", "ox", "oy"]).groupBy(*keys).agg(*[F.sum(along(c) * e / cube).alias(f"s{c}{n}") for c in "uv" for n, e in (("x", ex), ("y", ey))])
        det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
        right = lambda c, n: F.col(f"{c}{n}") - F.col(f"s{c}{n}")
        solved = {f"{c}_x": (right(c, "x") * F.col("yy") - right(c, "y") * F.col("xy")) / det for c in "uv"} | {f"{c}_y": (right(c, "y") * F.col("xx") - right(c, "x") * F.col("xy")) / det for c in "uv"}
        moved = [(F.lit(step) * (solved[n] - F.col(f"{n}_before")) + F.col(f"{n}_before")).alias(n) for n in names]
        state = settled(state.join(sums, keys).select(*[c for c in system.columns], *moved, *[F.col(n).alias(f"{n}_before") for n in names]))
    return state.select(*keys, *names)


def _apexes(triangles: DataFrame) -> DataFrame:
    """Adds for each corner m ``nx{m}, ny{m}``: the third corner of the triangle beyond the edge opposite to it, null at the rim."""
    corner = lambda m: F.struct(F.col(f"x{m}").alias("x"), F.col(f"y{m}").alias("y"))
    edge = lambda a, b: F.struct(F.least(corner(a), corner(b)).alias("p"), F.greatest(corner(a), corner(b)).alias("q"))
    sides = triangles.select("field", F.explode(F.array(*[F.struct(edge((m + 1) % 3, (m + 2) % 3).alias("e"), corner(m).alias("apex")) for m in range(3)])).alias("s")).select("field", "s.*")
    both = sides.groupBy("field", "e").agg(F.min("apex").alias("one"), F.max("apex").alias("two"))
    for m in range(3):
        beyond = both.select("field", F.col("e").alias(f"e{m}"), F.col("one").alias(f"one{m}"), F.col("two").alias(f"two{m}"))
        third = F.when(F.col(f"one{m}") == corner(m), F.col(f"two{m}")).otherwise(F.col(f"one{m}"))
        third = F.when(F.col(f"one{m}") != F.col(f"two{m}"), third)
        triangles = triangles.withColumn(f"e{m}", edge((m + 1) % 3, (m + 2) % 3)).join(beyond, ["field", f"e{m}"]).withColumn(f"nx{m}", third["x"]).withColumn(f"ny{m}", third["y"]).drop(f"e{m}", f"one{m}", f"two{m}")
    return triangles


def _patch(value: Callable[[int], Column], slope: Callable[[int], tuple[Column, Column]], place: Callable[[int], tuple[Column, Column]], turn: Callable[[int], Column], b: list[Column]) -> Column:
    """A Clough-Tocher patch at weights ``b``: a cubic on each third of a triangle, smooth inside and to its neighbours.

    ``turn(m)`` says how the slope across the edge opposite to corner m leans along it.  Coefficients are Bezier's: ``at[p, q]``
    lies a third of the way from corner p to q, ``mid[p]`` around corner p towards the centre."""
    at, mid, low, inner = {}, [], {}, []
    for p, q in permutations(range(3), 2):
        (px, py), (qx, qy), (gx, gy) = place(p), place(q), slope(p)
        at[p, q] = value(p) + (gx * (qx - px) + gy * (qy - py)) / 3
    for p in range(3):
        mid.append((value(p) + at[p, (p + 1) % 3] + at[p, (p + 2) % 3]) / 3)
    for m in range(3):
        p, q = (m + 1) % 3, (m + 2) % 3
        third = value(q) - 3 * at[q, p] + 3 * at[p, q] - value(p)
        low[m] = (turn(m) * third + 2 * at[p, q] - value(p) - at[q, p] + mid[p] + mid[q]) / 2
    for p in range(3):
        inner.append((mid[p] + low[(p + 1) % 3] + low[(p + 2) % 3]) / 3)
    centre = (inner[0] + inner[1] + inner[2]) / 3
    least = F.least(*b)
    w, c = [x - least for x in b], 3 * least
    out = c * c * c * centre
    for p in range(3):
        q, r = (p + 1) % 3, (p + 2) % 3
        out = out + w[p] * w[p] * (w[p] * value(p) + 3 * (w[q] * at[p, q] + w[r] * at[p, r] + c * mid[p])) + 3 * w[p] * c * c * inner[p] + 6 * w[q] * w[r] * c * low[p]
    return out


def cubic(points: DataFrame, field: DataFrame, tile: int = TILE, rounds: int = ROUNDS) -> DataFrame:
    """Velocity at points (field, point, x, y), smooth and cubic on the triangles of a field's finite samples, with slopes
    that bend least; outside of the triangles it is 0."""
    samples = settled(samples_of(field))
    triangles = settled(mesh(samples, tile))
    steep = slopes(samples, edges_of(triangles), rounds)
    known = samples.join(steep, ["field", "x", "y"])
    full = _apexes(with_corners(triangles, known, ("u", "v", "u_x", "u_y", "v_x", "v_y")))
    here = locate(points.select("field", "point", "x", "y"), full)
    t = lambda n, m: F.col(f"t.{n}{m}")

    def turn(m: int) -> Column:
        """From the weights of the centre of the triangle beyond the edge; at the rim the slope is perpendicular in weights."""
        p, q = (m + 1) % 3, (m + 2) % 3
        cx, cy = (t("x", p) + t("x", q) + t("nx", m)) / 3, (t("y", p) + t("y", q) + t("ny", m)) / 3
        w = weights(cx, cy, "t.")
        return F.coalesce((2 * w[q] + w[p] - 1) / (2 - 3 * w[q] - 3 * w[p]), F.lit(-0.5))

    b = [F.col(f"b{m}") for m in range(3)]
    value = lambda c: _patch(lambda m: t(c, m), lambda m: (t(f"{c}_x", m), t(f"{c}_y", m)), lambda m: (t("x", m), t("y", m)), turn, b)
    return _zero_outside(points, here.select("field", "point", "x", "y", value("u").alias("u"), value("v").alias("v")))


def planes(field: DataFrame, tile: int = TILE) -> DataFrame:
    """``field, t``: for each triangle of a field's samples what is linear in x and y on it, as (constant, x, y): the
    weights ``b0, b1, b2`` of its corners and the velocities ``u, v``."""
    samples = settled(samples_of(field))
    t = with_corners(mesh(samples, tile), samples, ("u", "v"))
    whole = _cross(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("x2") - F.col("x0"), F.col("y2") - F.col("y0"))
    terms = []
    for m in range(3):
        p, q = (m + 1) % 3, (m + 2) % 3
        px, py, qx, qy = F.col(f"x{p}"), F.col(f"y{p}"), F.col(f"x{q}"), F.col(f"y{q}")
        terms.append([_cross(px, py, qx, qy) / whole, (py - qy) / whole, (qx - px) / whole])
    value = lambda c: [sum((F.col(f"{c}{m}") * terms[m][k] for m in range(1, 3)), F.col(f"{c}0") * terms[0][k]) for k in range(3)]
    named = {f"b{m}": terms[m] for m in range(3)} | {c: value(c) for c in "uv"}
    return t.where(whole != 0).select("field", F.struct(*[F.array(*v).alias(n) for n, v in named.items()]).alias("t"))
