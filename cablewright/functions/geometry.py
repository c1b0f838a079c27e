"""Plane geometry as Columns. A point is a pair of Columns (x, y); whole-number inputs give exact signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def point(prefix: str, alias: str | None = None) -> Point:
    """The columns <prefix>x and <prefix>y, of a DataFrame alias if one is given."""
    at = f"{alias}." if alias else ""
    return F.col(f"{at}{prefix}x"), F.col(f"{at}{prefix}y")


def cross(p: Point, q: Point) -> Column:
    """Cross product of two vectors."""
    return p[0] * q[1] - p[1] * q[0]


def dot(p: Point, q: Point) -> Column:
    return p[0] * q[0] + p[1] * q[1]


def minus(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1]


def orientation(a: Point, b: Point, c: Point) -> Column:
    """Twice the signed area of a, b, c: positive if counter-clockwise."""
    return cross(minus(b, a), minus(c, a))


def ccw(a: Point, b: Point, c: Point) -> Column:
    return orientation(a, b, c) > 0


def cw(a: Point, b: Point, c: Point) -> Column:
    return orientation(a, b, c) < 0


def d2(a: Point, b: Point) -> Column:
    """Squared distance."""
    v = minus(a, b)
    return dot(v, v)


def distance(a: Point, b: Point) -> Column:
    return F.sqrt(d2(a, b).cast("double"))


def bbox_overlap(u: Point, v: Point, s: Point, t: Point) -> Column:
    """Whether the bounding boxes of segments uv and st meet: the cheap test, to stand first."""
    out = None
    for k in (0, 1):
        term = (F.greatest(u[k], v[k]) >= F.least(s[k], t[k])) & (F.greatest(s[k], t[k]) >= F.least(u[k], v[k]))
        out = term if out is None else out & term
    return out


def is_crossing(u: Point, v: Point, s: Point, t: Point, touch: bool = True, bbox: bool = True) -> Column:
    """Whether segments cross. Parallel ones never do; `touch` counts an end on the other segment."""
    a, b = orientation(u, v, s), orientation(u, v, t)
    c, d = orientation(s, t, u), orientation(s, t, v)
    sides = lambda x, y: F.signum(x.cast("double")) * F.signum(y.cast("double"))
    parallel = cross(minus(v, u), minus(t, s)) == 0
    met = (sides(a, b) <= 0) & (sides(c, d) <= 0) if touch else (sides(a, b) < 0) & (sides(c, d) < 0)
    test = ~parallel & met
    return bbox_overlap(u, v, s, t) & test if bbox else test


def convex_pair(u: Point, v: Point, s: Point, t: Point) -> Column:
    """Whether the triangles on either side of uv, with apices s and t, form a strictly convex quadrilateral."""
    side = lambda a, b, c: F.signum(orientation(a, b, c).cast("double"))
    return (side(u, v, s) * side(u, v, t) < 0) & (side(s, t, u) * side(s, t, v) < 0)


def same_side(l1: Point, l2: Point, a: Point, b: Point, touch: bool = True) -> Column:
    """Whether a and b lie on one side of the line l1 l2; a point on the line counts as `touch` says."""
    s = F.signum(orientation(l1, l2, a).cast("double")) * F.signum(orientation(l1, l2, b).cast("double"))
    return s >= 0 if touch else s > 0


def blocks(root: Point, u: Point, v: Point, s: Point, t: Point) -> Column:
    """Whether edge st stands between the root and both ends of uv: convex with uv, and across from the root."""
    return convex_pair(u, v, s, t) & ~same_side(u, v, root, s)


def distance_to_line(p: Point, u: Point, v: Point) -> Column:
    """Distance of p to the line uv; NaN where u and v coincide, as no line is given then."""
    d = distance(u, v)
    return F.when(d == 0, F.lit(float("nan"))).otherwise(F.abs(orientation(u, v, p).cast("double")) / F.nullif(d, F.lit(0.0)))


def angle(a: Point, pivot: Point, b: Point) -> Column:
    """Signed angle from a to b about the pivot, in (-pi, pi]."""
    p, q = minus(a, pivot), minus(b, pivot)
    return F.atan2(cross(p, q).cast("double"), dot(p, q).cast("double"))


def aspect_ratio(u: Point, v: Point, t: Point) -> Column:
    """Longest side over the height on it, times half the root of 3: 1 for an equilateral triangle, null if flat."""
    longest = F.greatest(d2(u, v), d2(v, t), d2(t, u)).cast("double")
    area2 = F.abs(orientation(u, v, t).cast("double"))
    return F.when(area2 > 0, longest * F.lit(3**0.5 / 2) / area2)


def rotate(p: Point, degrees: Column) -> Point:
    """Counter-clockwise about the origin."""
    r = F.radians(degrees)
    return p[0] * F.cos(r) - p[1] * F.sin(r), p[0] * F.sin(r) + p[1] * F.cos(r)


def rank_within(rank: Column, low: Column, high: Column, wraps: Column, touch: bool = True) -> Column:
    """Whether a rank of angles lies between two others; `wraps` if the span passes the cut at pi."""
    inside = (rank >= low) & (rank <= high) if touch else (rank > low) & (rank < high)
    outside = (rank <= low) | (rank >= high) if touch else (rank < low) | (rank > high)
    return F.when(wraps, outside).otherwise(inside)


def blockage(arc: Column, extra: bool = False) -> Column:
    """Weight factor of an edge that spans `arc` as seen from its root."""
    import math

    base = F.lit(math.pi) / (F.lit(math.pi) - arc)
    return base + 4 * arc / F.lit(math.pi) if extra else base


def about_corner(p: Point, a: Point, o: Point, b: Point, margin: float = 1e-3) -> tuple[Column, Column]:
    """Whether a point lies inside the angle a-o-b, and whether outside it; within the margin of its legs it is neither."""
    whole, part = angle(a, o, b), angle(a, o, p)
    inside = F.when(whole >= 0, (part > margin) & (part < whole - margin)).otherwise((part < -margin) & (part > whole + margin))
    outside = F.when(whole >= 0, (part < -margin) | (part > whole + margin)).otherwise((part > margin) | (part < whole - margin))
    return inside, outside


def bunch_split(p: Point, a: Point, o: Point, b: Point, margin: float = 1e-3) -> Column:
    """An aggregate: whether some points lie inside the angle a-o-b and others outside it."""
    inside, outside = about_corner(p, a, o, b, margin)
    return F.bool_or(inside) & F.bool_or(outside)


def opposite_sides(p: Point, u: Point, v: Point, margin: float = 0.0) -> Column:
    """An aggregate: whether points lie on both sides of the line uv, those within `margin` of it left out."""
    far = distance_to_line(p, u, v) > margin
    side = F.when(far, F.signum(orientation(u, v, p).cast("double")))
    return (F.min(side) < 0) & (F.max(side) > 0)
