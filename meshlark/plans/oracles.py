"""The registered queries as SQL that another engine can run over the same tables, written apart from the plans."""

from __future__ import annotations

import math

SIDE = 1000.0
TURN = repr(2 * math.pi)


def _with(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


def _r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


EMB = "emb AS (SELECT label AS frame, vec_id AS id, (CAST(embedding[1] AS DOUBLE) + 1) * 500 AS r, (CAST(embedding[2] AS DOUBLE) + 1) * 500 AS c FROM embeddings)"
WIDE = "emb AS (SELECT label AS frame, vec_id AS id, ((CAST(embedding[1] AS DOUBLE) + 1) * 500 - 250) * 2 AS r, ((CAST(embedding[2] AS DOUBLE) + 1) * 500 - 250) * 2 AS c FROM embeddings)"
EV = "ev AS (SELECT CAST(day(ts) AS INT) AS frame, event_id AS id, CAST(hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS INT) AS DOUBLE) AS r, CAST(user_id AS DOUBLE) AS c, abs(value) AS v FROM events)"



def _triangles(points: str, own: str) -> str:
    """Of the points to the left of a directed edge the one that sees it at the widest angle makes a triangle with it, if no
    point to the right lies in the circle; points within rounding of the edge's line are on neither side."""
    return f"""seen AS (
  SELECT a.frame, a.id AS a, b.id AS b, p.id AS p, (b.r - a.r) * (p.c - a.c) - (b.c - a.c) * (p.r - a.r) AS side,
    (p.r - a.r) * (p.r - b.r) + (p.c - a.c) * (p.c - b.c) AS dot
  FROM {points} a JOIN {points} b ON a.frame = b.frame AND a.id <> b.id JOIN {points} p ON p.frame = a.frame AND p.id <> a.id AND p.id <> b.id WHERE {own}),
apex AS (
  SELECT frame, a, b, min_by(p, dot / side) FILTER (side > 1e-9) AS p, min(dot / side) FILTER (side > 1e-9) AS low, max(dot / side) FILTER (side < -1e-9) AS high, count(*) FILTER (abs(side) <= 1e-9 AND dot < 0) AS on_it
  FROM seen GROUP BY frame, a, b),
trip AS (SELECT DISTINCT frame, list_sort([a, b, p]) AS t FROM apex WHERE p IS NOT NULL AND on_it = 0 AND (high IS NULL OR low >= high)),
circ AS (
  SELECT trip.frame, t[1] AS i, t[2] AS j, t[3] AS k, a.r AS r0, a.c AS c0, b.r AS r1, b.c AS c1, c.r AS r2, c.c AS c2,
    2 * ((b.r - a.r) * (c.c - a.c) - (b.c - a.c) * (c.r - a.r)) AS d, (b.r - a.r) ** 2 + (b.c - a.c) ** 2 AS lb, (c.r - a.r) ** 2 + (c.c - a.c) ** 2 AS lc
  FROM trip JOIN {points} a ON a.frame = trip.frame AND a.id = t[1] JOIN {points} b ON b.frame = trip.frame AND b.id = t[2] JOIN {points} c ON c.frame = trip.frame AND c.id = t[3]),
cc AS (SELECT *, r0 + ((c2 - c0) * lb - (c1 - c0) * lc) / d AS ccr, c0 + ((r1 - r0) * lc - (r2 - r0) * lb) / d AS ccc FROM circ),
tri AS (SELECT *, sqrt((r0 - ccr) ** 2 + (c0 - ccc) ** 2) AS rad, abs(d) / 4 AS area FROM cc)"""


TRI = _triangles("emb", "true")
EDGE = """half AS (
  SELECT frame, i AS a, j AS b, r0 AS ra, c0 AS ca, r1 AS rb, c1 AS cb, ccr, ccc FROM tri
  UNION ALL SELECT frame, j, k, r1, c1, r2, c2, ccr, ccc FROM tri UNION ALL SELECT frame, i, k, r0, c0, r2, c2, ccr, ccc FROM tri),
edge AS (
  SELECT frame, a, b, any_value(ra) AS ra, any_value(ca) AS ca, any_value(rb) AS rb, any_value(cb) AS cb, count(*) AS n,
    (max(ccr) - min(ccr)) ** 2 + (max(ccc) - min(ccc)) ** 2 AS w FROM half GROUP BY ALL),
both_ AS (
  SELECT frame, a AS src, b AS dst, atan2(rb - ra, cb - ca) AS th, n, w FROM edge
  UNION ALL SELECT frame, b, a, atan2(ra - rb, ca - cb), n, w FROM edge)"""
PSI = """psi AS (
  SELECT e.frame, e.id, e.r, e.c, coalesce(sum(w * cos(6 * th)) FILTER (n = 2 AND w > 0) / sum(w) FILTER (n = 2 AND w > 0), 0) AS re,
    coalesce(sum(w * sin(6 * th)) FILTER (n = 2 AND w > 0) / sum(w) FILTER (n = 2 AND w > 0), 0) AS im
  FROM emb e LEFT JOIN both_ b ON b.frame = e.frame AND b.src = e.id GROUP BY e.frame, e.id, e.r, e.c)"""
BOUND = """bound AS (
  SELECT e.frame, e.id, count(*) OVER (PARTITION BY e.frame) < 4
    OR NOT EXISTS (SELECT 1 FROM half h WHERE h.frame = e.frame AND e.id IN (h.a, h.b))
    OR EXISTS (SELECT 1 FROM tri t WHERE t.frame = e.frame AND e.id IN (t.i, t.j, t.k) AND (ccc < -0.5 OR ccc > 999.5 OR ccr < -0.5 OR ccr > 999.5))
    OR EXISTS (SELECT 1 FROM both_ b WHERE b.frame = e.frame AND b.src = e.id AND b.n = 1) AS flag
  FROM emb e)"""


# rows that wrap: three images of each point, numbered 3 id + 0, 1, 2, and triangles with at least one original corner
IMAGES = "em3 AS (SELECT frame, id * 3 + i AS id, r + (i - 1) * 1000 AS r, c FROM emb CROSS JOIN range(3) g(i))"
TRI3 = _triangles("em3", "a.id % 3 = 1")
EDGE3 = EDGE.replace("both_ AS", "both3 AS") + ",\nboth_ AS (SELECT frame, src // 3 AS src, dst // 3 AS dst, th, n, w FROM both3 WHERE src % 3 = 1)"
_FLAT, _WRAPPED = "(a.r - b.r) ** 2", "least(abs(a.r - b.r), 1000 - abs(a.r - b.r)) ** 2"


def _smoothed(source: str, k: int, self_: int, rows: str = _FLAT) -> str:
    return f"""ok AS (SELECT frame, id, r, c, v FROM {source} WHERE v IS NOT NULL),
near AS (SELECT a.frame, a.id, a.v, b.v AS o, row_number() OVER (PARTITION BY a.frame, a.id ORDER BY {rows} + (a.c - b.c) ** 2, b.id) AS k
  FROM ok a JOIN ok b ON a.frame = b.frame AND a.id <> b.id),
sm AS (SELECT frame, id, (sum(o) + {self_} * any_value(v)) / (count(*) + {self_}) AS s FROM near WHERE k <= {k} GROUP BY ALL)"""


# the t and F tails by Simpson's rule over the incomplete beta integral (after t = sin(x)^2, which smooths its ends)
def _beta(x: str, a: str, b: str, n: int = 2000) -> str:
    return f"""(SELECT asin(sqrt({x})) / {3 * n} * sum(CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * 2 * CASE WHEN i = 0 AND 2 * ({a}) - 1 < 1e-9 THEN exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}))
    WHEN i = 0 THEN 0 ELSE exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + (2 * ({a}) - 1) * ln(sin(asin(sqrt({x})) * i / {n})) + (2 * ({b}) - 1) * ln(cos(asin(sqrt({x})) * i / {n}))) END)
  FROM range({n + 1}) g(i))"""


PEARSON = f"""pe AS (SELECT frame, count(*) AS n, corr(r, v) AS rr FROM ev GROUP BY frame),
pt AS (SELECT frame, rr, n - 2 AS df, (n - 2) / ((n - 2) + rr * rr * (n - 2) / (1 - rr * rr)) AS x FROM pe),
pear AS (SELECT frame, rr, {_beta("x", "df / 2.0", "0.5")} AS p FROM pt)"""
ANOVA = f"""gr AS (SELECT frame, floor(r / 3600) AS b, count(*) AS m, avg(v) AS mu, var_pop(v) AS vp FROM ev GROUP BY ALL HAVING count(*) >= 2),
wh AS (SELECT frame, sum(m) AS n, count(*) AS k, sum(m * mu) / sum(m) AS g, sum(m * vp) AS w FROM gr GROUP BY frame),
be AS (SELECT gr.frame, sum(m * (mu - g) ** 2) AS bt FROM gr JOIN wh USING (frame) GROUP BY gr.frame),
ft AS (SELECT frame, (bt / (k - 1)) / (w / (n - k)) AS f, k - 1 AS d1, n - k AS d2 FROM wh JOIN be USING (frame)),
an AS (SELECT frame, f, {_beta("d2 / (d2 + d1 * f)", "d2 / 2.0", "d1 / 2.0")} AS p FROM ft)"""


def _bh(source: str, p: str, name: str) -> str:
    return f"""{name}_r AS (SELECT *, row_number() OVER (ORDER BY {p}) AS rk, count({p}) OVER () AS m FROM {source} WHERE {p} IS NOT NULL),
{name} AS (SELECT *, least(1, min({p} * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM {name}_r)"""


def _said(q: str, none: str, yes: str, no: str) -> str:
    return f"CASE WHEN {q} IS NULL THEN '{none}' WHEN {q} <= 0.5 THEN '{yes} (BH-adjusted q-value ≤ 0.5).' ELSE '{no} (BH-adjusted q-value > 0.5).' END"


HARMONIC = f"""mu AS (SELECT frame, avg(v) AS m FROM ev GROUP BY frame),
ph AS (SELECT frame, cos(r * {TURN} / 86400) AS c, sin(r * {TURN} / 86400) AS s, v - m AS y FROM ev JOIN mu USING (frame)),
su AS (SELECT frame, count(*) AS n, avg(c) AS mc, avg(s) AS ms, avg(y) AS my, covar_pop(c, c) AS a, covar_pop(c, s) AS b, covar_pop(s, s) AS d, covar_pop(c, y) AS p, covar_pop(s, y) AS q FROM ph GROUP BY frame),
co AS (SELECT *, (p * d - q * b) / (a * d - b * b) AS b1, (q * a - p * b) / (a * d - b * b) AS b2 FROM su),
rs AS (SELECT frame, any_value(n) AS n, any_value(b1) AS b1, any_value(b2) AS b2, sum((y - my - b1 * (c - mc) - b2 * (s - ms)) ** 2) AS rss, sum(y * y) AS tss FROM ph JOIN co USING (frame) GROUP BY frame),
hf AS (SELECT *, (tss - rss) / 2 / (rss / (n - 3)) AS f FROM rs),
ha AS (SELECT *, pow(1 + 2 * f / (n - 3), -(n - 3) / 2.0) AS p FROM hf)"""

LI = f"li AS (SELECT l_returnflag || l_linestatus AS frame, (1 - l_tax) * cos(l_discount * {20 * 3.141592653589793!r}) AS re, (1 - l_tax) * sin(l_discount * {20 * 3.141592653589793!r}) AS im, l_quantity AS w FROM lineitem)"


def _complex(weight: str) -> str:
    return _with(
        LI,
        f"s AS (SELECT frame, sum({weight} * re) AS re, sum({weight} * im) AS im, sum({weight}) AS w, sum({weight} * sqrt(re * re + im * im)) AS m FROM li GROUP BY frame)",
        f"a AS (SELECT *, atan2(im / w, re / w) / 6 AS o FROM s)",
        select=f"""SELECT frame, {_r("re / w", "mean_real")}, {_r("im / w", "mean_imag")}, {_r("sqrt(re * re + im * im) / w", "resultant_magnitude")},
          {_r(f"CASE WHEN o < 0 THEN o + {TURN} / 6 ELSE o END", "orientation_radians")}, {_r(f"degrees(CASE WHEN o < 0 THEN o + {TURN} / 6 ELSE o END)", "orientation_degrees")},
          {_r("sqrt(re * re + im * im) / m", "phase_coherence")} FROM a""",
    )


G6 = lambda top, step, rows="(x.r - y.r) ** 2": f"""fr AS (SELECT frame, count(*) AS n, avg(re * re + im * im) AS p2, sqrt(1000000.0 / count(*)) AS a FROM psi GROUP BY frame),
fw AS (SELECT *, least({top} * a, 500) AS top, least({step} * a, least({top} * a, 500)) AS w FROM fr),
ed AS (SELECT frame, a, p2, top, w, unnest(range(CAST(ceil((top + w / 2) / w - 1e-12) AS INT))) * w AS lo FROM fw),
ed2 AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY lo) - 1 AS bin, coalesce(lead(lo) OVER (PARTITION BY frame ORDER BY lo), CASE WHEN lo < top THEN top END) AS hi FROM ed),
bins AS (SELECT * FROM ed2 WHERE hi IS NOT NULL),
pr AS (SELECT x.frame, sqrt({rows} + (x.c - y.c) ** 2) AS d, x.re * y.re + x.im * y.im AS g FROM psi x JOIN psi y ON x.frame = y.frame AND x.id < y.id),
pb AS (SELECT pr.frame, least(floor(d / w), mb) AS bin, g FROM pr JOIN fw USING (frame) JOIN (SELECT frame, max(bin) AS mb FROM bins GROUP BY frame) USING (frame) WHERE d <= top),
ag AS (SELECT frame, bin, avg(g) AS g, count(*) AS n FROM pb GROUP BY ALL),
cu AS (SELECT b.frame, b.bin, (lo + hi) / 2 AS r, g, g / p2 AS gn, coalesce(n, 0) AS n, a FROM bins b LEFT JOIN ag ON ag.frame = b.frame AND ag.bin = b.bin)"""  # noqa: E731

GRID = "grid AS (SELECT event_type AS frame, CAST(hour(ts) AS INT) AS r, CAST(day(ts) - 1 AS INT) AS c, count(*) AS n FROM events GROUP BY ALL)"
DENSE = "dense AS (SELECT f.frame, a.i AS r, b.i AS c, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM (SELECT DISTINCT frame FROM grid) f CROSS JOIN range(24) a(i) CROSS JOIN range(30) b(i) LEFT JOIN grid g ON g.frame = f.frame AND g.r = a.i AND g.c = b.i)"
# reachability of foreground pixels; the first and the last hour touch
COMP = """fg AS (SELECT frame, r, c, r * 30 + c AS id FROM grid WHERE n >= 4),
nb AS (SELECT a.frame, a.id AS x, b.id AS y FROM fg a JOIN fg b ON a.frame = b.frame AND abs(a.c - b.c) <= 1 AND (abs(a.r - b.r) <= 1 OR abs(a.r - b.r) = 23)),
rc AS (SELECT frame, id AS x, id AS y FROM fg UNION SELECT rc.frame, rc.x, nb.y FROM rc JOIN nb ON nb.frame = rc.frame AND nb.x = rc.y),
ro AS (SELECT frame, x AS id, min(y) AS root FROM rc GROUP BY ALL),
lb AS (SELECT ro.frame, fg.r, fg.c, ro.root, CAST(dense_rank() OVER (PARTITION BY ro.frame ORDER BY root) AS INT) AS label FROM ro JOIN fg ON fg.frame = ro.frame AND fg.id = ro.id),
wr AS (SELECT DISTINCT a.frame, a.label FROM lb a JOIN lb b ON a.frame = b.frame AND a.label = b.label AND a.r = 0 AND b.r = 23 AND abs(a.c - b.c) <= 1),
rg AS (SELECT lb.frame, lb.label, count(*) AS area, avg(CASE WHEN wr.label IS NOT NULL AND r >= 12 THEN r - 24 ELSE r END) AS mr, avg(c) AS mc, bool_or(c IN (0, 29)) AS border
  FROM lb LEFT JOIN wr ON wr.frame = lb.frame AND wr.label = lb.label GROUP BY ALL)"""


def _dft(source: str) -> str:
    return f"""sp AS (SELECT frame, a.i - 12 AS fr, b.i - 15 AS fc, sum(v * cos({TURN} * ((a.i - 12) * r / 24.0 + (b.i - 15) * c / 30.0))) AS re,
  -sum(v * sin({TURN} * ((a.i - 12) * r / 24.0 + (b.i - 15) * c / 30.0))) AS im
  FROM {source} CROSS JOIN range(24) a(i) CROSS JOIN range(30) b(i) GROUP BY ALL)"""


HANN = f"""wn AS (SELECT d.frame, d.r, d.c, (v - m) * (0.5 - 0.5 * cos({TURN} * d.r / 23)) * (0.5 - 0.5 * cos({TURN} * d.c / 29)) AS v FROM dense d JOIN (SELECT frame, avg(v) AS m FROM dense GROUP BY frame) USING (frame)),
pw AS (SELECT sum(((0.5 - 0.5 * cos({TURN} * a.i / 23)) * (0.5 - 0.5 * cos({TURN} * b.i / 29))) ** 2) AS w FROM range(24) a(i) CROSS JOIN range(30) b(i))"""
BAND = "bs AS (SELECT frame, fr, fc, (re * re + im * im) / w AS i, sqrt((fr / 24.0) ** 2 + (fc / 30.0) ** 2) AS rad FROM sp CROSS JOIN pw)"
V1 = "v1 AS (SELECT *, CASE WHEN fr = 0 AND fc = 0 THEN 0 ELSE re * re + im * im END AS i FROM sp)"
TOP = "tb AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round(i, 3) DESC, fr, fc) AS rank FROM v1 WHERE fr <> 0 OR fc <> 0)"
PIV = "fd AS (SELECT CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS INT) AS field, floor((l_quantity - 1) / 10) AS x, CAST(l_linenumber AS DOUBLE) AS y, avg(l_discount) - 0.05 AS u, avg(l_tax) - 0.04 AS v, count(*) AS n FROM lineitem GROUP BY ALL)"
POINTS = "pt AS (SELECT field, CAST(x * 10 + y AS INT) AS point, x + 0.3 AS x, y + 0.4 AS y FROM fd)"
DRIFTED = """fc AS (SELECT field, x, y, CASE WHEN n >= 12 THEN u END AS u, CASE WHEN n >= 12 THEN v END AS v FROM fd),
emb AS (SELECT field AS frame, CAST(x * 10 + y AS INT) AS id, y + 4 * v AS r, x + 4 * u AS c, u, v FROM fc WHERE u IS NOT NULL)"""
HELD = """held AS (
  SELECT pt.field, pt.point, pt.x, pt.y, t.*, ((pt.x - c0) * (r2 - r0) - (pt.y - r0) * (c2 - c0)) / w AS b1, ((c1 - c0) * (pt.y - r0) - (r1 - r0) * (pt.x - c0)) / w AS b2, 1 - b1 - b2 AS b0
  FROM pt JOIN (SELECT *, (c1 - c0) * (r2 - r0) - (r1 - r0) * (c2 - c0) AS w FROM tri) t ON t.frame = pt.field
  WHERE least(b0, b1, b2) >= -1e-9 QUALIFY row_number() OVER (PARTITION BY pt.field, pt.point ORDER BY least(b0, b1, b2) DESC, i, j, k) = 1)"""
# rounds of slopes; the error halves at least with each
SLOPES = """side AS (SELECT frame, i AS a, j AS b, k AS apex FROM tri UNION ALL SELECT frame, j, k, i FROM tri UNION ALL SELECT frame, i, k, j FROM tri),
link AS (
  SELECT e.frame, e.a, e.b, q.c - p.c AS ex, q.r - p.r AS ey, ((q.c - p.c) ** 2 + (q.r - p.r) ** 2) ** 1.5 AS l3, q.u - p.u AS du, q.v - p.v AS dv
  FROM (SELECT DISTINCT frame, a, b FROM side UNION SELECT frame, b, a FROM side) e JOIN emb p ON p.frame = e.frame AND p.id = e.a JOIN emb q ON q.frame = e.frame AND q.id = e.b),
mat AS (SELECT frame, a, sum(2 * ex * ex / l3) AS xx, sum(2 * ex * ey / l3) AS xy, sum(2 * ey * ey / l3) AS yy FROM link GROUP BY ALL),
gr AS (
  SELECT 0 AS n, frame, a AS id, 0.0::DOUBLE AS ux, 0.0::DOUBLE AS uy, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy FROM mat
  UNION ALL
  SELECT n + 1, frame, a, (tx * yy - ty * xy) / (xx * yy - xy * xy), (ty * xx - tx * xy) / (xx * yy - xy * xy), (sx * yy - sy * xy) / (xx * yy - xy * xy), (sy * xx - sx * xy) / (xx * yy - xy * xy)
  FROM (
    SELECT gr.n, link.frame, link.a, any_value(xx) AS xx, any_value(xy) AS xy, any_value(yy) AS yy, sum((3 * du - ux * ex - uy * ey) * ex / l3) AS tx, sum((3 * du - ux * ex - uy * ey) * ey / l3) AS ty,
      sum((3 * dv - vx * ex - vy * ey) * ex / l3) AS sx, sum((3 * dv - vx * ex - vy * ey) * ey / l3) AS sy
    FROM gr JOIN link ON link.frame = gr.frame AND link.b = gr.id JOIN mat ON mat.frame = link.frame AND mat.a = link.a WHERE gr.n < 40 GROUP BY gr.n, link.frame, link.a)),
slope AS (SELECT e.frame, e.id, e.r, e.c, e.u, e.v, ux, uy, vx, vy FROM gr JOIN emb e ON e.frame = gr.frame AND e.id = gr.id WHERE n = 40)"""


# On a grid many points share a circle.  Its triangles fan out from the first of them, by y and x: a triangle holds if its
# circle has no sample inside, begins with its first corner, and has none beyond the edge between the others.
GRIDDED = """tr AS (
  SELECT a.field, a.y AS ay, a.x AS ax, b.y AS by_, b.x AS bx, c.y AS cy, c.x AS cx, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS w,
    a.u AS au, a.v AS av, b.u AS bu, b.v AS bv, c.u AS cu, c.v AS cv,
    ((c.y - a.y) * ((b.x - a.x) ** 2 + (b.y - a.y) ** 2) - (b.y - a.y) * ((c.x - a.x) ** 2 + (c.y - a.y) ** 2)) / (2 * w) AS mx,
    ((b.x - a.x) * ((c.x - a.x) ** 2 + (c.y - a.y) ** 2) - (c.x - a.x) * ((b.x - a.x) ** 2 + (b.y - a.y) ** 2)) / (2 * w) AS my
  FROM fd a JOIN fd b ON a.field = b.field AND (b.y, b.x) > (a.y, a.x) JOIN fd c ON c.field = a.field AND (c.y, c.x) > (b.y, b.x)
  WHERE (b.x - a.x) * (c.y - a.y) <> (b.y - a.y) * (c.x - a.x)),
near AS (
  SELECT pt.field, pt.point, pt.x, pt.y, tr.* EXCLUDE (field), ((pt.x - ax) * (cy - ay) - (pt.y - ay) * (cx - ax)) / w AS p1, ((bx - ax) * (pt.y - ay) - (by_ - ay) * (pt.x - ax)) / w AS p2
  FROM pt JOIN tr ON tr.field = pt.field WHERE least(1 - p1 - p2, p1, p2) >= -1e-9),
ring AS (
  SELECT n.field, n.point, n.ay, n.ax, n.by_, n.bx, n.cy, n.cx, any_value(au + p1 * (bu - au) + p2 * (cu - au)) AS u, any_value(av + p1 * (bv - av) + p2 * (cv - av)) AS v,
    min((s.x - ax - mx) ** 2 + (s.y - ay - my) ** 2 - mx ** 2 - my ** 2) AS gap, min({'y': s.y, 'x': s.x}) FILTER (abs((s.x - ax - mx) ** 2 + (s.y - ay - my) ** 2 - mx ** 2 - my ** 2) < 1e-9) AS first,
    count(*) FILTER (abs((s.x - ax - mx) ** 2 + (s.y - ay - my) ** 2 - mx ** 2 - my ** 2) < 1e-9 AND ((cx - bx) * (s.y - by_) - (cy - by_) * (s.x - bx)) * ((cx - bx) * (ay - by_) - (cy - by_) * (ax - bx)) < -1e-9) AS beyond
  FROM near n JOIN fd s ON s.field = n.field GROUP BY ALL),
lin AS (SELECT field, point, u, v FROM ring WHERE gap > -1e-9 AND first.y = ay AND first.x = ax AND beyond = 0 QUALIFY row_number() OVER (PARTITION BY field, point ORDER BY ay, ax, by_, bx, cy, cx) = 1)"""


def _smooth_patch(value: str) -> str:
    """The cubic's value at weights b0, b1, b2 of a triangle with corners s0, s1, s2 and leanings g0, g1, g2."""
    f = [f"s{m}.{value}" for m in range(3)]
    q = {(a, b): f"({f[a]} + (s{a}.{value}x * (s{b}.c - s{a}.c) + s{a}.{value}y * (s{b}.r - s{a}.r)) / 3)" for a in range(3) for b in range(3) if a != b}
    e = [f"(({f[a]} + {q[a, (a + 1) % 3]} + {q[a, (a + 2) % 3]}) / 3)" for a in range(3)]
    h = []
    for m in range(3):
        a, b = (m + 1) % 3, (m + 2) % 3
        h.append(f"((g{m} * ({f[b]} - 3 * {q[b, a]} + 3 * {q[a, b]} - {f[a]}) + 2 * {q[a, b]} - {f[a]} - {q[b, a]} + {e[a]} + {e[b]}) / 2)")
    i = [f"(({e[a]} + {h[(a + 1) % 3]} + {h[(a + 2) % 3]}) / 3)" for a in range(3)]
    w = [f"(b{m} - z)" for m in range(3)]
    terms = [f"27 * z ** 3 * ({i[0]} + {i[1]} + {i[2]}) / 3"]
    for a in range(3):
        b, c = (a + 1) % 3, (a + 2) % 3
        terms.append(f"{w[a]} ** 3 * {f[a]} + 3 * {w[a]} ** 2 * ({w[b]} * {q[a, b]} + {w[c]} * {q[a, c]} + 3 * z * {e[a]}) + 27 * {w[a]} * z * z * {i[a]} + 18 * {w[b]} * {w[c]} * z * {h[a]}")
    return " + ".join(terms)


def _leaning(m: int) -> str:
    """How the slope across the edge opposite to corner m leans, from the centre of the triangle beyond."""
    c, r = f"(({'+'.join(f'c{x}' for x in range(3) if x != m)} + o{m}.c) / 3)", f"(({'+'.join(f'r{x}' for x in range(3) if x != m)} + o{m}.r) / 3)"
    w1, w2 = f"((({c} - c0) * (r2 - r0) - ({r} - r0) * (c2 - c0)) / w)", f"(((c1 - c0) * ({r} - r0) - (r1 - r0) * ({c} - c0)) / w)"
    w = [f"(1 - {w1} - {w2})", w1, w2]
    a, b = w[(m + 1) % 3], w[(m + 2) % 3]
    return f"coalesce((2 * {b} + {a} - 1) / (2 - 3 * {b} - 3 * {a}), -0.5) AS g{m}"


def _bicubic() -> str:
    ends = [("j", "k", "i"), ("i", "k", "j"), ("i", "j", "k")]
    beyond = " ".join(f"LEFT JOIN side d{m} ON d{m}.frame = held.frame AND d{m}.a = held.{a} AND d{m}.b = held.{b} AND d{m}.apex <> held.{own} LEFT JOIN emb o{m} ON o{m}.frame = held.frame AND o{m}.id = d{m}.apex" for m, (a, b, own) in enumerate(ends))
    corners = " ".join(f"JOIN slope s{m} ON s{m}.frame = lean.frame AND s{m}.id = lean.{k}" for m, k in enumerate("ijk"))
    return _with(
        PIV, POINTS, DRIFTED, TRI, HELD, SLOPES,
        f"lean AS (SELECT held.*, least(b0, b1, b2) AS z, {', '.join(_leaning(m) for m in range(3))} FROM held {beyond})",
        f"cub AS (SELECT lean.field, lean.point, {_smooth_patch('u')} AS u, {_smooth_patch('v')} AS v FROM lean {corners})",
        select=f"SELECT pt.field, pt.point, {_r('pt.x', 'x', 5)}, {_r('pt.y', 'y', 5)}, {_r('coalesce(u, 0)', 'u', 5)}, {_r('coalesce(v, 0)', 'v', 5)} FROM pt LEFT JOIN cub ON cub.field = pt.field AND cub.point = pt.point",
    )


def _scattered() -> str:
    corners = " ".join(f"JOIN emb s{m} ON s{m}.frame = held.frame AND s{m}.id = held.{k}" for m, k in enumerate("ijk"))
    value = lambda c: " + ".join(f"b{m} * s{m}.{c}" for m in range(3))
    return _with(
        PIV, POINTS, DRIFTED, TRI, HELD, f"lin AS (SELECT held.field, held.point, {value('u')} AS u, {value('v')} AS v FROM held {corners})",
        select=f"SELECT pt.field, pt.point, {_r('pt.x', 'x')}, {_r('pt.y', 'y')}, {_r('coalesce(u, 0)', 'u')}, {_r('coalesce(v, 0)', 'v')} FROM pt LEFT JOIN lin ON lin.field = pt.field AND lin.point = pt.point",
    )


POLYGON = ((3.0, 2.0), (20.0, 4.0), (26.0, 15.0), (12.0, 21.0), (5.0, 13.0))


def _in_polygon(x: str, y: str) -> str:
    tests = [f"CASE WHEN ({y1} <= {y}) <> ({y2} <= {y}) AND {x} < {x1}::DOUBLE + ({y} - {y1}::DOUBLE) * {(x2 - x1) / (y2 - y1)!r}::DOUBLE THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]])]
    return f"({' + '.join(tests)}) % 2 = 1"


MONTHS = "fd AS (SELECT CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS INT) AS field, floor((l_quantity - 1) / 10) AS x, CAST(l_linenumber AS DOUBLE) AS y, (avg(l_discount) - 0.05) * 100 AS u, (avg(l_tax) - 0.04) * 100 AS v FROM lineitem GROUP BY ALL)"
# field by field in order; each row of the recursion is one vertex
EVOLVE = """ys AS (SELECT field, row_number() OVER (ORDER BY field) AS n FROM (SELECT DISTINCT field FROM fd)),
way AS (
  SELECT * FROM (VALUES (0::BIGINT, 0, 0.5::DOUBLE, 1.5::DOUBLE), (0, 1, 3.2, 2.0), (0, 2, 2.0, 6.1)) t(step, vertex, x, y)
  UNION ALL
  SELECT step + 1, vertex, least(greatest(x + m.u, 0), 4), (y + m.v) - 8 * floor((y + m.v) / 8)
  FROM way JOIN ys ON ys.n = way.step + 1, LATERAL (SELECT first(fd.u ORDER BY (way.x - fd.x) ** 2 + (way.y - fd.y) ** 2, fd.x, fd.y) AS u, first(fd.v ORDER BY (way.x - fd.x) ** 2 + (way.y - fd.y) ** 2, fd.x, fd.y) AS v FROM fd WHERE fd.field = ys.field) m)"""


def _bootstrap(replicates: int, seed: int) -> str:
    terms = {"n": "1.0", "mag": "m", "area": "1.0", "area_mag": "m", "re": "re", "im": "im", "c": "cos(ph)", "s": "sin(ph)", "cc": "cos(ph) ** 2", "cs": "cos(ph) * sin(ph)", "ss": "sin(ph) ** 2", "yc": "m * cos(ph)", "ys": "m * sin(ph)", "yy": "m * m"}
    again = ", ".join(f"sum({t}) AS {t}" for t in terms)
    return _with(
        EMB, TRI, EDGE, PSI,
        f"bl AS (SELECT frame, floor(r / 100) AS br, floor(col / 100) AS bc, {', '.join(f'sum({v}) AS {t}' for t, v in terms.items())} FROM (SELECT frame, r, psi.c AS col, re, im, sqrt(re * re + im * im) AS m, r * {TURN} / 1000 AS ph FROM psi) GROUP BY frame, floor(r / 100), floor(col / 100))",
        "bn AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY br, bc) - 1 AS block, count(*) OVER (PARTITION BY frame) AS occupied FROM bl)",
        f"""dr AS (SELECT frame, replicate, CAST('0x' || substr(md5('{seed}:' || frame || ':' || replicate || ':' || draw), 1, 15) AS BIGINT) % occupied AS block
          FROM (SELECT frame, occupied, replicate, unnest(range(occupied)) AS draw FROM (SELECT DISTINCT frame, occupied FROM bn) CROSS JOIN range({replicates}) q(replicate)))""",
        f"su AS (SELECT dr.frame, replicate, {again} FROM dr JOIN bn ON bn.frame = dr.frame AND bn.block = dr.block GROUP BY ALL UNION ALL SELECT frame, -1, {again} FROM bn GROUP BY frame)",
        "fo AS (SELECT *, cc - c * c / n AS fa, cs - c * s / n AS fb, ss - s * s / n AS fd, yc - c * mag / n AS fp, ys - s * mag / n AS fq, yy - mag * mag / n AS ft FROM su)",
        """me AS (SELECT frame, replicate, 'cell_mean_psi_magnitude' AS metric, mag / n AS v FROM fo UNION ALL SELECT frame, replicate, 'area_weighted_mean_psi_magnitude', area_mag / area FROM fo
          UNION ALL SELECT frame, replicate, 'phase_coherence_cell', CASE WHEN mag > 0 THEN sqrt(re * re + im * im) / mag END FROM fo
          UNION ALL SELECT frame, replicate, 'harmonic_r_squared_raw', CASE WHEN n >= 4 AND ft > 1e-10 * yy AND fa * fd - fb * fb > 1e-12 * n * n
            THEN greatest(0, least(1, (fp * (fp * fd - fq * fb) + fq * (fq * fa - fp * fb)) / (fa * fd - fb * fb) / ft)) END FROM fo)""",
        select=f"""SELECT CAST(me.frame AS BIGINT) AS frame, metric, {_r('any_value(v) FILTER (replicate = -1)', 'estimate')}, {_r('quantile_cont(v, 0.025) FILTER (replicate >= 0)', 'confidence_low')},
          {_r('quantile_cont(v, 0.975) FILTER (replicate >= 0)', 'confidence_high')}, CAST(any_value(occupied) AS INT) AS occupied_blocks, {replicates} AS replicates
          FROM me JOIN (SELECT DISTINCT frame, occupied FROM bn) o ON o.frame = me.frame GROUP BY me.frame, metric""",
    )


def _evolve() -> str:
    return _with(MONTHS, EVOLVE, select=f"SELECT CAST(step AS INT) AS step, CAST(vertex AS INT) AS vertex, {_r('x', 'x', 5)}, {_r('y', 'y', 5)} FROM way")


def _defects() -> str:
    return _with(
        EMB, TRI, EDGE, BOUND,
        "zz AS (SELECT frame, id, flag, (SELECT count(*) FROM both_ b WHERE b.frame = o.frame AND b.src = o.id) AS z, NOT flag AND NOT EXISTS (SELECT 1 FROM both_ b JOIN bound p ON p.frame = b.frame AND p.id = b.dst WHERE b.frame = o.frame AND b.src = o.id AND p.flag) AS inner_ FROM bound o)",
        "df AS (SELECT * FROM zz WHERE inner_ AND z <> 6)",
        "mt AS (SELECT b.frame, b.src, bool_or(sign(6 - d.z) = -sign(6 - e.z)) AS opp FROM both_ b JOIN df d ON d.frame = b.frame AND d.id = b.src JOIN df e ON e.frame = b.frame AND e.id = b.dst GROUP BY ALL)",
        select=f"""SELECT z.frame, count(*) FILTER (inner_) AS interior_regions, {_r("avg(z.z) FILTER (inner_)", "mean_coordination")},
  {", ".join(_r(f"avg(CASE WHEN {t} THEN 1.0 ELSE 0 END) FILTER (inner_)", n) for t, n in (("z.z <= 4", "fraction_z4_or_less"), ("z.z = 5", "fraction_z5"), ("z.z = 6", "fraction_z6"), ("z.z = 7", "fraction_z7"), ("z.z >= 8", "fraction_z8_or_more"), ("z.z <> 6", "defect_fraction")))},
  {_r("avg(abs(6 - z.z)) FILTER (inner_)", "mean_abs_charge")}, {_r("avg(6 - z.z) FILTER (inner_)", "net_charge_per_region")},
  {_r("avg(CASE WHEN mt.src IS NOT NULL THEN 1.0 ELSE 0 END) FILTER (inner_ AND z.z <> 6)", "defect_neighbor_fraction")},
  {_r("avg(CASE WHEN opp THEN 1.0 ELSE 0 END) FILTER (inner_ AND z.z <> 6)", "dislocation_fraction")}
  FROM zz z LEFT JOIN mt ON mt.frame = z.frame AND mt.src = z.id GROUP BY z.frame""",
    )


_QC = [(f"{a}(area)", f"raw_area_{n}") for a, n in (("min", "min"), ("median", "median"), ("avg", "mean"), ("max", "max"))]
_KEPT = [(f"{a}(area) FILTER (kept)", f"retained_area_{n}") for a, n in (("min", "min"), ("median", "median"), ("avg", "mean"), ("max", "max"))]
_DECAY = "lg AS (SELECT *, lag(gn) OVER w AS g0, lag(r) OVER w AS r0, coalesce(max(CAST(r >= a AND gn < 0.05 AS INT)) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS st FROM cu WHERE gn IS NOT NULL AND r >= 0.75 * a WINDOW w AS (PARTITION BY frame ORDER BY r))"

PCROP = f"""bx AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM dense WHERE {_in_polygon("c", "r")}),
pc AS (SELECT frame, r - r0 AS r, c - c0 AS c, CASE WHEN {_in_polygon("c", "r")} THEN v ELSE 0 END AS v FROM dense, bx WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1)"""

ORACLE_SQL: dict[str, str] = {
    "polygon_crop": _with(GRID, DENSE, PCROP, select='SELECT frame, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, v AS value FROM pc'),
    "polygon_fourier": _with(GRID, DENSE, PCROP,
        f"sp AS (SELECT frame, a.i - 9 AS fr, b.i - 11 AS fc, sum(v * cos({TURN} * ((a.i - 9) * r / 19.0 + (b.i - 11) * c / 23.0))) AS re, sum(v * sin({TURN} * ((a.i - 9) * r / 19.0 + (b.i - 11) * c / 23.0))) AS im FROM pc CROSS JOIN range(19) a(i) CROSS JOIN range(23) b(i) GROUP BY ALL)",
        V1, select=f"SELECT frame, {_r('CASE WHEN avg(i) > 0 THEN max(i) / avg(i) ELSE 0 END', 'metric')} FROM v1 GROUP BY frame"),
    "centroid_impulses": _with(GRID, COMP, "im AS (SELECT DISTINCT frame, round_even(mr - 24 * floor(mr / 24), 0) AS r, round_even(mc, 0) AS c FROM rg)", select=f'SELECT frame, CAST(r AS INT) AS "row", CAST(c AS INT) AS col FROM im WHERE r BETWEEN 0 AND 23 AND c BETWEEN 0 AND 29 AND {_in_polygon("c", "r")}'),
    "pad_center": _with(GRID, DENSE, select='SELECT f.frame, CAST(a.i AS INT) AS "row", CAST(b.i AS INT) AS col, coalesce(v, 0) AS value FROM (SELECT DISTINCT frame FROM dense) f CROSS JOIN range(29) a(i) CROSS JOIN range(32) b(i) LEFT JOIN dense d ON d.frame = f.frame AND d.r + 2 = a.i AND d.c + 1 = b.i'),
    "polygon_display": _with(PIV, select="SELECT field, x, (y + 3) - 7 * floor((y + 3) / 7) AS shown_y, y - 7 * floor(y / 7) AS back_y FROM fd"),
    "harmonic_daily": _with(EV, HARMONIC, _bh("ha", "p", "hq"), select=f"""SELECT frame, 'value' AS basis, {_r("b1", "cosine_coefficient")}, {_r("b2", "sine_coefficient")}, {_r("sqrt(b1 * b1 + b2 * b2)", "amplitude")},
      {_r(f"CASE WHEN atan2(b2, b1) < 0 THEN atan2(b2, b1) + {TURN} ELSE atan2(b2, b1) END * 86400 / {TURN}", "peak_row", 2)}, {_r("1 - rss / tss", "r_squared")}, {_r("f", "f_statistic")}, {_r("p", "p_value")}, {_r("q", "q_value")} FROM hq"""),
    "anova_daily": _with(EV, ANOVA, _bh("an", "p", "aq"), select=f"SELECT frame, {_r('f', 'anova_f_statistic')}, {_r('p', 'anova_p_value')}, {_r('q', 'anova_q_value_bh')} FROM aq"),
    "pearson_daily": _with(EV, PEARSON, _bh("pear", "p", "pq"), select=f"SELECT frame, {_r('rr', 'correlation')}, {_r('p', 'correlation_p_value')}, {_r('q', 'correlation_q_value_bh')} FROM pq"),
    "conclusions": _with(EV, PEARSON, ANOVA, _bh("pear", "p", "pq"), _bh("an", "p", "aq"), select=f"""SELECT pq.frame,
      {_said("pq.q", "Pearson test not performed (insufficient or constant data).", "Evidence of a linear association", "Failed to reject no linear association")} AS pearson_conclusion,
      {_said("aq.q", "ANOVA not performed (insufficient or constant groups).", "Evidence that at least one row-bin mean differs", "Failed to reject equality of row-bin means")} AS anova_conclusion FROM pq JOIN aq ON pq.frame = aq.frame"""),
    "row_bins": _with(EV, select=f"""SELECT f.frame, CAST(b.i AS INT) AS bin, {_r("(b.i + 0.5) * 5000", "bin_center")}, {_r("avg(v)", "bin_mean")}, count(v) AS bin_count
      FROM (SELECT DISTINCT frame FROM ev) f CROSS JOIN range(18) b(i) LEFT JOIN ev ON ev.frame = f.frame AND floor(ev.r / 5000) = b.i GROUP BY f.frame, b.i"""),
    "complex_summary_cell": _complex("1.0"),
    "complex_summary_area": _complex("w"),
    "area_summary": f"SELECT l_returnflag AS frame, {_r('min(l_extendedprice)', 'area_min', 4)}, {_r('median(l_extendedprice)', 'area_median', 4)}, {_r('avg(l_extendedprice)', 'area_mean', 4)}, {_r('max(l_extendedprice)', 'area_max', 4)} FROM lineitem GROUP BY 1",
    "finite_and_weighted_means": f"SELECT l_linenumber AS frame, {_r('avg(l_discount)', 'mean_value')}, {_r('sum(l_discount * l_quantity) / sum(l_quantity)', 'weighted_value')} FROM lineitem GROUP BY 1",
    "delaunay_triangles": _with(EMB, TRI, select=f"SELECT frame, i, j, k, {_r('rad', 'circumradius', 3)}, {_r('area', 'area', 3)} FROM tri"),
    "voronoi_psi6": _with(EMB, TRI, EDGE, PSI, select=f"SELECT frame, id AS region_id, {_r('re', 're', 5)}, {_r('im', 'im', 5)}, {_r('sqrt(re * re + im * im)', 'psi_mag', 5)} FROM psi"),
    "voronoi_boundary": _with(EMB, TRI, EDGE, BOUND, select="SELECT frame, id AS region_id, flag AS boundary FROM bound"),
    "voronoi_neighbours": _with(EMB, TRI, EDGE, select="SELECT frame, src, dst FROM both_"),
    "coordination_defects": _defects(),
    "spacing_qc": _with(
        WIDE, TRI,
        "nn AS (SELECT a.frame, a.id, any_value(a.r) AS r, any_value(a.c) AS c, min(sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2)) AS d FROM emb a JOIN emb b ON a.frame = b.frame AND a.id <> b.id GROUP BY ALL)",
        "md AS (SELECT frame, median(d) AS m, 3 * median(d) AS g, count(*) AS n FROM nn GROUP BY frame HAVING count(*) >= 10)",
        "inn AS (SELECT nn.frame, median(d) AS mid, stddev_pop(d) / avg(d) AS cv, any_value(n) AS n FROM nn JOIN md USING (frame) WHERE r > g AND r < 1000 - g AND c > g AND c < 1000 - g GROUP BY nn.frame HAVING count(*) >= 10)",
        "ho AS (SELECT tri.frame, sum(area) AS t, coalesce(sum(area) FILTER (rad > m), 0) AS h FROM tri JOIN md USING (frame) WHERE (r0 + r1 + r2) / 3 > g AND (r0 + r1 + r2) / 3 < 1000 - g AND (c0 + c1 + c2) / 3 > g AND (c0 + c1 + c2) / 3 < 1000 - g GROUP BY tri.frame)",
        select=f"SELECT f.frame, {_r('mid', 'median_nn_distance_pixels')}, {_r('cv', 'nn_distance_cv')}, {_r('mid / sqrt(1000000.0 / n)', 'nn_distance_ratio')}, {_r('CASE WHEN inn.frame IS NOT NULL AND t > 0 THEN h / t END', 'hole_area_fraction')} FROM (SELECT DISTINCT frame FROM emb) f LEFT JOIN inn ON inn.frame = f.frame LEFT JOIN ho ON ho.frame = f.frame",
    ),
    "knn_smooth": _with(EMB, TRI, EDGE, PSI, "src AS (SELECT frame, id, r, c, sqrt(re * re + im * im) AS v FROM psi)", _smoothed("src", 6, 0), select=f"SELECT frame, id AS region_id, {_r('s', 'smoothed', 5)} FROM sm"),
    "boundary_excluded_smooth": _with(EMB, TRI, EDGE, PSI, BOUND, "src AS (SELECT p.frame, p.id, r, c, CASE WHEN NOT flag THEN sqrt(re * re + im * im) END AS v FROM psi p JOIN bound b ON b.frame = p.frame AND b.id = p.id)", _smoothed("src", 3, 1),
        select=f"SELECT src.frame, src.id AS region_id, {_r('coalesce(s, v)', 'smoothed', 5)} FROM src LEFT JOIN sm ON sm.frame = src.frame AND sm.id = src.id"),
    "voronoi_psi6_periodic": _with(EMB, IMAGES, TRI3, EDGE3, PSI, select=f"SELECT frame, id AS region_id, {_r('re', 're', 5)}, {_r('im', 'im', 5)}, {_r('sqrt(re * re + im * im)', 'psi_mag', 5)} FROM psi"),
    "voronoi_neighbours_periodic": _with(EMB, IMAGES, TRI3, EDGE3, select="SELECT DISTINCT frame, src, dst FROM both_ WHERE src <> dst"),
    "knn_smooth_periodic": _with(EMB, IMAGES, TRI3, EDGE3, PSI, "src AS (SELECT frame, id, r, c, sqrt(re * re + im * im) AS v FROM psi)", _smoothed("src", 6, 0, _WRAPPED), select=f"SELECT frame, id AS region_id, {_r('s', 'smoothed', 5)} FROM sm"),
    "g6_curve_periodic": _with(EMB, IMAGES, TRI3, EDGE3, PSI, G6(15.0, 0.25, "least(abs(x.r - y.r), 1000 - abs(x.r - y.r)) ** 2"), select=f"SELECT frame, CAST(bin AS INT) AS bin, {_r('r', 'r', 5)}, {_r('g', 'g6', 5)}, {_r('gn', 'g6_normalized', 5)}, n AS pairs, {_r('a', 'spacing', 5)} FROM cu"),
    "pairs_in_range": _with(EMB, select=f"SELECT a.frame, a.id AS i, b.id AS j, {_r('sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2)', 'distance')} FROM emb a JOIN emb b ON a.frame = b.frame AND a.id < b.id WHERE (a.r - b.r) ** 2 + (a.c - b.c) ** 2 <= 625"),
    "pairs_in_range_wrapped": _with(EV, "w AS (SELECT a.frame, a.id AS i, b.id AS j, sqrt(least(abs(a.r - b.r) / 60, 1440 - abs(a.r - b.r) / 60) ** 2 + (a.c - b.c) ** 2) AS d FROM ev a JOIN ev b ON a.frame = b.frame AND a.id < b.id)", select=f"SELECT frame, i, j, {_r('d', 'distance')} FROM w WHERE d <= 20"),
    "g6_curve": _with(EMB, TRI, EDGE, PSI, G6(4.0, 0.25), select=f"SELECT frame, CAST(bin AS INT) AS bin, {_r('r', 'r', 5)}, {_r('g', 'g6', 5)}, {_r('gn', 'g6_normalized', 5)}, n AS pairs, {_r('a', 'spacing', 5)} FROM cu"),
    "decay_lengths": _with(
        EMB, TRI, EDGE, PSI, G6(4.0, 0.5), _DECAY,
        "fx AS (SELECT frame, arg_min(CASE WHEN g0 IS NULL THEN r ELSE r0 + (exp(-1) - g0) * (r - r0) / (gn - g0) END, r) AS xi, arg_min(g0 IS NULL, r) AS ub FROM lg WHERE gn < exp(-1) GROUP BY frame)",
        "ff AS (SELECT frame, count(*) AS n, regr_slope(ln(gn), r) AS es, regr_r2(ln(gn), r) AS e2, regr_slope(ln(gn), ln(r)) AS ps, regr_r2(ln(gn), ln(r)) AS p2 FROM lg WHERE r >= a AND st = 0 AND gn > 0 GROUP BY frame HAVING count(*) >= 3)",
        select=f"SELECT f.frame, {_r('a', 'spacing', 3)}, {_r('xi', 'xi_1e_pixels', 3)}, coalesce(ub, false) AS xi_1e_is_upper_bound, {_r('CASE WHEN es < 0 THEN -1 / es END', 'exp_xi_pixels', 3)}, {_r('ff.e2', 'exp_r_squared', 3)}, {_r('-ps', 'power_eta', 3)}, {_r('ff.p2', 'power_r_squared', 3)}, {_r('xi / a', 'xi_1e_spacings', 3)} FROM fr f LEFT JOIN fx ON fx.frame = f.frame LEFT JOIN ff ON ff.frame = f.frame",
    ),
    "components_grid": _with(GRID, COMP, select=f"SELECT frame, label, area, {_r('mr - 24 * floor(mr / 24)', 'row')}, {_r('mc', 'col')} FROM rg".replace("AS row", 'AS "row"')),
    "component_filter_qc": _with(GRID, COMP, "kp AS (SELECT *, area >= 2 AND area <= 40 AND NOT border AS kept FROM rg)", select=f"""SELECT frame, CAST(sum(area) AS BIGINT) AS raw_foreground_pixels, CAST(coalesce(sum(area) FILTER (kept), 0) AS BIGINT) AS retained_foreground_pixels, count(*) AS raw_component_count,
      count(*) FILTER (kept) AS retained_component_count, count(*) FILTER (NOT kept) AS rejected_any_count, count(*) FILTER (area < 2) AS rejected_min_area_count, count(*) FILTER (area > 40) AS rejected_max_area_count, count(*) FILTER (border) AS rejected_border_count,
      {", ".join(f"{e} AS {n}" if n.endswith(("min", "max")) else _r(e, n) for e, n in _QC + _KEPT)} FROM kp GROUP BY frame"""),
    "border_filter": _with(GRID, COMP, select="SELECT frame, label, border AS rejected_border, CASE WHEN NOT border THEN CAST(row_number() OVER (PARTITION BY frame, border ORDER BY label) AS INT) ELSE 0 END AS new_label FROM rg"),
    "label_map": _with(GRID, COMP, select='SELECT lb.frame, r AS "row", c AS col, lb.label, area FROM lb JOIN rg ON rg.frame = lb.frame AND rg.label = lb.label'),
    "roll_rows": _with(GRID, select='SELECT frame, (r + 7) % 24 AS "row", c AS col, n FROM grid'),
    "rectangle_crop": _with(GRID, DENSE, select='SELECT frame, CAST(r - 7 AS INT) AS "row", CAST(c - 10 AS INT) AS col, v AS value FROM dense WHERE r >= 7 AND r < 17 AND c >= 10 AND c < 20'),
    "roi_stats": _with(GRID, f"ar AS (SELECT count(*) AS n FROM range(24) a(i) CROSS JOIN range(30) b(i) WHERE {_in_polygon('b.i', 'a.i')})",
        select=f"SELECT grid.frame, {_r(f'avg(grid.n) FILTER (grid.n >= 4 AND {_in_polygon("c", "r")})', 'average')}, any_value(ar.n) AS geometric_pixels, count(*) FILTER (grid.n >= 4 AND {_in_polygon('c', 'r')}) AS valid_pixels FROM grid CROSS JOIN ar GROUP BY grid.frame"),
    "dft_v1_top_bins": _with(GRID, DENSE, _dft("dense"), V1, TOP, select=f"SELECT frame, CAST(rank AS INT) AS rank, CAST(fr AS INT) AS fr, CAST(fc AS INT) AS fc, {_r('i', 'intensity', 3)}, {_r('sqrt(fr * fr + fc * fc)', 'distance', 3)} FROM tb WHERE rank <= 10"),
    "dft_v1_mean_distance": _with(GRID, DENSE, _dft("dense"), V1, TOP, select=f"SELECT frame, {_r('avg(sqrt(fr * fr + fc * fc))', 'mean_distance')} FROM tb WHERE rank <= 10 GROUP BY frame"),
    "dft_v1_metric": _with(GRID, DENSE, _dft("dense"), V1, select=f"SELECT frame, {_r('CASE WHEN avg(i) > 0 THEN max(i) / avg(i) ELSE 0 END', 'metric')} FROM v1 GROUP BY frame"),
    "dft_v2_band": _with(GRID, DENSE, HANN, _dft("wn"), BAND, select=f"""SELECT frame, {_r("max(i) FILTER (rad BETWEEN 0.08 AND 0.3)", "eligible_max")}, {_r("avg(i) FILTER (rad BETWEEN 0.08 AND 0.3)", "eligible_mean")}, {_r("max(i) FILTER (rad BETWEEN 0.08 AND 0.3) / avg(i) FILTER (rad BETWEEN 0.08 AND 0.3)", "metric")},
      {_r("sum(i) FILTER (rad > 0 AND rad < 0.08) / sum(i) FILTER (rad > 0)", "low_frequency_power_fraction")}, {_r("sum(i) FILTER (rad BETWEEN 0.08 AND 0.3) / sum(i) FILTER (rad > 0)", "eligible_power_fraction")} FROM bs GROUP BY frame"""),
    "dft_v2_pairs": _with(GRID, DENSE, HANN, _dft("wn"), BAND,
        "cj AS (SELECT *, (12 - fr) % 24 - 12 AS tr, (15 - fc) % 30 - 15 AS tc FROM bs WHERE rad BETWEEN 0.08 AND 0.3)",
        "cn AS (SELECT frame, CASE WHEN (fr, fc) <= (tr, tc) THEN fr ELSE tr END AS fr, CASE WHEN (fr, fc) <= (tr, tc) THEN fc ELSE tc END AS fc, sum(i) AS t, avg(i) AS m, count(*) AS n FROM cj GROUP BY ALL)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round(t, 6) DESC, fr, fc) AS k, sqrt((fr / 24.0) ** 2 + (fc / 30.0) ** 2) AS rad FROM cn WHERE t > 0)",
        select=f"SELECT frame, CAST(k AS INT) AS rank, CAST(fr AS INT) AS fr, CAST(fc AS INT) AS fc, {_r('rad', 'radial', 5)}, {_r('1 / rad', 'wavelength', 5)}, {_r('m', 'mean_intensity', 5)}, {_r('t', 'total_power', 5)}, n AS member_count FROM rk WHERE k <= 5"),
    "radial_profile": _with(GRID, DENSE, HANN, _dft("wn"), BAND, select=f"""SELECT f.frame, CAST(b.i AS INT) AS bin, {_r("(b.i + 0.5) / 30.0", "center", 5)}, {_r("avg(bs.i)", "mean_intensity", 5)}, {_r("coalesce(sum(bs.i), 0)", "total_power", 5)}, count(bs.i) AS n
      FROM (SELECT DISTINCT frame FROM bs) f CROSS JOIN range(22) b(i) LEFT JOIN bs ON bs.frame = f.frame AND rad > 0 AND floor(rad * 30 + 1e-9) = b.i GROUP BY f.frame, b.i"""),
    "reconstruct": _with(GRID, DENSE, _dft("dense"), V1, TOP,
        f"iv AS (SELECT frame, a.i AS r, b.i AS c, sum(re * cos({TURN} * (fr * a.i / 24.0 + fc * b.i / 30.0)) - im * sin({TURN} * (fr * a.i / 24.0 + fc * b.i / 30.0))) AS x, sum(re * sin({TURN} * (fr * a.i / 24.0 + fc * b.i / 30.0)) + im * cos({TURN} * (fr * a.i / 24.0 + fc * b.i / 30.0))) AS y FROM tb CROSS JOIN range(24) a(i) CROSS JOIN range(30) b(i) WHERE rank <= 4 GROUP BY ALL)",
        select=f'SELECT frame, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, {_r("sqrt(x * x + y * y) / max(sqrt(x * x + y * y)) OVER (PARTITION BY frame)", "value", 5)} FROM iv'),
    "piv_nearest": _with(PIV, POINTS, select=f"SELECT pt.field, point, {_r('pt.x', 'x')}, {_r('pt.y', 'y')}, {_r('first(u ORDER BY (pt.x - fd.x) ** 2 + (pt.y - fd.y) ** 2, fd.x, fd.y)', 'u')}, {_r('first(v ORDER BY (pt.x - fd.x) ** 2 + (pt.y - fd.y) ** 2, fd.x, fd.y)', 'v')} FROM pt JOIN fd ON fd.field = pt.field GROUP BY pt.field, point, pt.x, pt.y"),
    "piv_inverse_distance": _with(PIV, POINTS, select=f"SELECT pt.field, point, {_r('pt.x', 'x')}, {_r('pt.y', 'y')}, {_r('sum(u / ((pt.x - fd.x) ** 2 + (pt.y - fd.y) ** 2)) / sum(1 / ((pt.x - fd.x) ** 2 + (pt.y - fd.y) ** 2))', 'u')}, {_r('sum(v / ((pt.x - fd.x) ** 2 + (pt.y - fd.y) ** 2)) / sum(1 / ((pt.x - fd.x) ** 2 + (pt.y - fd.y) ** 2))', 'v')} FROM pt JOIN fd ON fd.field = pt.field GROUP BY pt.field, point, pt.x, pt.y"),
    # all points lie 0.3 and 0.4 into their cell, so in its upper triangle: u = a + 0.4 (c - a) + 0.3 (d - c); cells span the next x and y of the field
    "piv_scattered": _scattered(),
    "piv_bicubic": _bicubic(),
    "piv_bilinear": _with(PIV, POINTS, GRIDDED, select=f"SELECT pt.field, pt.point, {_r('pt.x', 'x', 10)}, {_r('pt.y', 'y', 10)}, {_r('coalesce(u, 0)', 'u', 10)}, {_r('coalesce(v, 0)', 'v', 10)} FROM pt LEFT JOIN lin ON lin.field = pt.field AND lin.point = pt.point"),
    "bootstrap_ci": _bootstrap(200, 7),
    "roi_evolve": _evolve(),
    "piv_percentiles": _with(PIV, "sp AS (SELECT quantile_cont(sqrt(u * u + v * v), 0.02) AS lo, quantile_cont(sqrt(u * u + v * v), 0.98) AS hi FROM fd)", select=f"SELECT {_r('lo', 'low')}, {_r('CASE WHEN hi <= lo THEN lo + 1 ELSE hi END', 'high')} FROM sp"),
    "piv_quiver": _with(PIV, "rk AS (SELECT *, dense_rank() OVER (PARTITION BY field ORDER BY x) - 1 AS ix, dense_rank() OVER (PARTITION BY field ORDER BY y) - 1 AS iy FROM fd)", select=f"SELECT field, x, y, {_r('u', 'u')}, {_r('v', 'v')} FROM rk WHERE ix % 2 = 0 AND iy % 2 = 0"),
    "missing_timepoints": """WITH d AS (SELECT DISTINCT date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS t FROM orders), e AS (SELECT min(t) AS a, max(t) AS b FROM d)
      SELECT CAST(i AS INT) AS timepoint FROM e, range(e.a, e.b + 1) g(i) WHERE i NOT IN (SELECT t FROM d)""",
    "duplicate_timepoints": "SELECT CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS timepoint, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
}
