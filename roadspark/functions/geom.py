"""Planar geometry on arrays of points as Column expressions. A ring repeats its first point at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def sides(line: Column) -> Column:
    """Consecutive points as structs of a and b."""
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def line_length(line: Column) -> Column:
    return _sum(F.transform(sides(line), lambda s: distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def signed_area(ring: Column) -> Column:
    return _sum(F.transform(sides(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2.0


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def on_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether the point is on one of the sides, ends included."""

    def on(s: Column) -> Column:
        a, b = s["a"], s["b"]
        flat = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return flat & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(sides(ring), on)


def centroid(ring: Column) -> Column:
    """The centre of mass of a ring."""
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    part = lambda c: _sum(F.transform(sides(ring), lambda s: (s["a"][c] + s["b"][c]) * cross(s)))
    return F.struct(F.try_divide(part("x"), signed_area(ring) * 6.0).alias("x"), F.try_divide(part("y"), signed_area(ring) * 6.0).alias("y"))


def bounds(line: Column) -> Column:
    x, y = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether the point is inside, by the parity of the sides that a ray crosses; of points on the ring, which
    :func:`on_ring` tells, some count as inside."""

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        at = a["x"] + F.coalesce(F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"]), F.lit(0.0))
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.size(F.filter(sides(ring), crosses)) % 2 == 1


def segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    """From a point to the segment between a and b."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return distance(x, y, a["x"] + t * dx, a["y"] + t * dy)


def line_distance(x: Column, y: Column, line: Column) -> Column:
    return F.array_min(F.transform(sides(line), lambda s: segment_distance(x, y, s["a"], s["b"])))


def polygon_distance(x: Column, y: Column, ring: Column) -> Column:
    return F.when(contains(ring, x, y), 0.0).otherwise(line_distance(x, y, ring))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _within(a: Column, b: Column, p: Column) -> Column:
    return p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def segments_meet(p: Column, q: Column, a: Column, b: Column) -> Column:
    s = [F.signum(_turn(*t)) for t in ((p, q, a), (p, q, b), (a, b, p), (a, b, q))]
    proper = (s[0] * s[1] < 0) & (s[2] * s[3] < 0)
    on = [(s[i] == 0) & _within(*t) for i, t in enumerate(((p, q, a), (p, q, b), (a, b, p), (a, b, q)))]
    return proper | on[0] | on[1] | on[2] | on[3]


def lines_meet(one: Column, two: Column) -> Column:
    return F.exists(sides(one), lambda s: F.exists(sides(two), lambda t: segments_meet(s["a"], s["b"], t["a"], t["b"])))


def meets_polygon(line: Column, ring: Column) -> Column:
    """Whether a line or ring shares a point with the polygon."""
    first = F.try_element_at(line, F.lit(1))
    return contains(ring, first["x"], first["y"]) | lines_meet(line, ring)


def polygons_meet(one: Column, two: Column) -> Column:
    """Whether two polygons share a point, one inside the other included."""
    first = F.try_element_at(two, F.lit(1))
    return meets_polygon(one, two) | contains(one, first["x"], first["y"])


def any_contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether the point is inside one of the rings."""
    return F.exists(rings, lambda r: contains(r, x, y))


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> Column:
    """Degrees (WGS 84) as a point in metres of a transverse Mercator zone, by Krueger's series to the third order."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    terms = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    sine, dl = F.sin(F.radians(lat)), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(terms, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return point(500000.0 + 0.9996 * radius * east, (1e7 if south else 0.0) + 0.9996 * radius * north)


def great_circle(line: Column) -> Column:
    """Length in metres of a line in degrees, on a sphere of 6,371,009 m."""

    def side(s: Column) -> Column:
        a, b = s["a"], s["b"]
        h = F.sin(F.radians(b["y"] - a["y"]) / 2) ** 2 + F.cos(F.radians(a["y"])) * F.cos(F.radians(b["y"])) * F.sin(F.radians(b["x"] - a["x"]) / 2) ** 2
        return 2 * 6371009.0 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))

    return _sum(F.transform(sides(line), side))


def shifted(line: Column, dx: Column, dy: Column) -> Column:
    return F.transform(line, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def canonical(line: Column) -> Column:
    """The same value for a line and its reverse; null stays null."""
    return F.when(line.isNotNull(), F.least(line, F.reverse(line)))


def straight(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.array(point(ax, ay), point(bx, by))


def shape_text(line: Column) -> Column:
    """"x,y x,y"."""
    return F.array_join(F.transform(line, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")


def clipped_length(line: Column, ring: Column) -> Column:
    """Length of a line inside a polygon: each side is cut where it crosses the ring, pieces with an inner middle count."""

    def cuts(s: Column) -> Column:
        a, b = s["a"], s["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]

        def at(t: Column) -> Column:
            ex, ey = t["b"]["x"] - t["a"]["x"], t["b"]["y"] - t["a"]["y"]
            den = dx * ey - dy * ex
            u = F.try_divide((t["a"]["x"] - a["x"]) * ey - (t["a"]["y"] - a["y"]) * ex, den)
            v = F.try_divide((t["a"]["x"] - a["x"]) * dy - (t["a"]["y"] - a["y"]) * dx, den)
            return F.when(u.between(0, 1) & v.between(0, 1), u)

        found = F.filter(F.transform(sides(ring), at), lambda u: u.isNotNull())
        return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), found)))

    def inside(s: Column) -> Column:
        a, b = s["a"], s["b"]
        marks = cuts(s)
        n = F.size(marks)
        pieces = F.zip_with(F.slice(marks, 1, n - 1), F.slice(marks, 2, n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        mid = lambda w, c: a[c] + (w["p"] + w["q"]) / 2.0 * (b[c] - a[c])
        kept = F.transform(pieces, lambda w: F.when(contains(ring, mid(w, "x"), mid(w, "y")), w["q"] - w["p"]).otherwise(0.0))
        return _sum(kept) * distance(a["x"], a["y"], b["x"], b["y"])

    return _sum(F.transform(sides(line), inside))
