"""Court geometry as Column expressions. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hoopflow import fixed as K


def _c(v) -> Column:
    if isinstance(v, Column):
        return v
    return F.col(v) if isinstance(v, str) else F.lit(float(v))


def r4(c) -> Column:
    """Half-up rounding to 4 digits; the same formula is cheap in any SQL engine."""
    return F.floor(_c(c) * 10000 + 0.5) / 10000


def rnd(c, digits: int) -> Column:
    """Half-even rounding; ``rint`` stays in generated code, unlike decimal rounding."""
    return F.rint(_c(c) * 10 ** digits) / 10 ** digits


def basket_side(x) -> Column:
    return F.when(_c(x) < K.HALF_X, "left").otherwise("right")


def flip(x, y) -> tuple[Column, Column]:
    """Mirror through the court centre. Always mirrors; the caller decides when."""
    return K.LENGTH - _c(x), K.WIDTH - _c(y)


def flip_velocity(vx, vy) -> tuple[Column, Column]:
    return -_c(vx), -_c(vy)


def dist(ax, ay, bx, by) -> Column:
    """Euclidean distance by sqrt, which is exactly rounded, hence portable."""
    dx, dy = _c(ax) - _c(bx), _c(ay) - _c(by)
    return F.sqrt(dx * dx + dy * dy)


def polar(x, y, rim=K.RIM) -> tuple[Column, Column]:
    """Distance to the rim and signed angle (degrees) from the +x axis."""
    dx, dy = _c(x) - rim[0], _c(y) - rim[1]
    return F.sqrt(dx * dx + dy * dy), F.degrees(F.atan2(dy, dx))


def corner_band(x, y) -> Column:
    return ((_c(y) <= K.CORNER_Y_LO) | (_c(y) >= K.CORNER_Y_HI)) & (_c(x) <= K.CORNER_X)


def is_three(x, y) -> Column:
    return corner_band(x, y) | (polar(x, y)[0] >= K.ARC_R)


def in_paint(x, y) -> Column:
    return _c(y).between(K.PAINT_Y_LO, K.PAINT_Y_HI) & (_c(x) <= K.PAINT_X)


def crossed_halfcourt(x) -> Column:
    return _c(x) <= K.HALF_X


def on_court(x, y, margin: float = 5.0) -> Column:
    return (_c(x).between(-margin, K.LENGTH + margin)
            & _c(y).between(-margin, K.WIDTH + margin))


def zone(x, y, d=None, ang=None) -> Column:
    """Shot zone of a canonical (attack-left) location; NULL position gives NULL.

    ``d, ang`` may carry an already computed polar position.
    """
    if d is None:
        d, ang = polar(x, y)
    side = F.when(ang > 30, "left").when(ang < -30, "right").otherwise("center")
    return (F.when(_c(x).isNull() | _c(y).isNull(), F.lit(None).cast("string"))
            .when(_c(x) > K.HALF_X, "backcourt")
            .when(corner_band(x, y),
                  F.when(_c(y) > K.RIM[1], "corner_three_left").otherwise("corner_three_right"))
            .when(d >= K.ARC_R, F.concat(F.lit("above_break_three_"), side))
            .when(d <= K.RESTRICTED_R, "restricted_area")
            .when(in_paint(x, y), "paint_non_ra")
            .otherwise(F.concat(F.lit("mid_range_"), side)))


def speed(vx, vy) -> Column:
    return F.sqrt(_c(vx) * _c(vx) + _c(vy) * _c(vy))


def heading(vx, vy) -> Column:
    """Velocity heading in degrees; NULL when too slow to mean anything."""
    return F.when(speed(vx, vy) >= K.HEADING_SPEED, F.degrees(F.atan2(_c(vy), _c(vx))))


def heading_source(vx, vy) -> Column:
    return (F.when(speed(vx, vy) >= K.HEADING_SPEED, "velocity_heading")
            .otherwise("velocity_heading_unavailable"))


def _safe_cos(ax, ay, bx, by) -> Column:
    na, nb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    return F.when((na >= 1e-6) & (nb >= 1e-6), (ax * bx + ay * by) / (na * nb))


def pressure(px, py, dx, dy, rim=K.RIM) -> Column:
    """exp(-d/4), scaled up to 1.5x for a defender on the rim side."""
    tx, ty = rim[0] - _c(px), rim[1] - _c(py)
    ex, ey = _c(dx) - _c(px), _c(dy) - _c(py)
    align = F.greatest(F.lit(0.0), F.coalesce(_safe_cos(tx, ty, ex, ey), F.lit(0.0)))
    return F.exp(-F.sqrt(ex * ex + ey * ey) / K.PRESSURE_LEN) * (1 + 0.5 * align)


def angle_between(ax, ay, bx, by) -> Column:
    """Angle of two vectors in degrees, 0 when either is degenerate."""
    c = _safe_cos(_c(ax), _c(ay), _c(bx), _c(by))
    ang = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))))
    return F.when(c.isNotNull(), ang).otherwise(0.0)


def point_segment(px, py, ax, ay, bx, by) -> Column:
    """Distance from p to the segment a-b."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    ux, uy = bx - ax, by - ay
    den = ux * ux + uy * uy
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * ux + (py - ay) * uy) / den))
    t = F.when(den < 1e-9, F.lit(0.0)).otherwise(t)
    qx, qy = px - (ax + t * ux), py - (ay + t * uy)
    return F.sqrt(qx * qx + qy * qy)


def facing(heading_deg, dx, dy) -> Column:
    """cos(angle) between a heading and a direction; 0 when unknown."""
    h, n = F.radians(_c(heading_deg)), F.sqrt(_c(dx) * _c(dx) + _c(dy) * _c(dy))
    val = F.cos(h) * (_c(dx) / n) + F.sin(h) * (_c(dy) / n)
    return F.when(_c(heading_deg).isNull() | (n < 1e-6), F.lit(0.0)).otherwise(val)


def box_foot(x1, y1, x2, y2) -> tuple[Column, Column]:
    return (_c(x1) + _c(x2)) / 2, _c(y2)


def box_center(x1, y1, x2, y2) -> tuple[Column, Column]:
    return (_c(x1) + _c(x2)) / 2, (_c(y1) + _c(y2)) / 2


def h_at(h, i: int) -> Column:
    """Element i (row-major, 0-8) of a homography held as array<double> of 9."""
    return F.element_at(_c(h), i + 1)


def project(h, x, y) -> tuple[Column, Column]:
    """Apply a 3x3 homography to a point."""
    x, y = _c(x), _c(y)
    w = h_at(h, 6) * x + h_at(h, 7) * y + h_at(h, 8)
    return ((h_at(h, 0) * x + h_at(h, 1) * y + h_at(h, 2)) / w,
            (h_at(h, 3) * x + h_at(h, 4) * y + h_at(h, 5)) / w)


def invert_h(h) -> Column:
    """Inverse of a homography, scaled by its determinant; NULL when singular."""
    a, b, c, d, e, f, g, i, j = (h_at(h, n) for n in range(9))
    adj = [e * j - f * i, c * i - b * j, b * f - c * e,
           f * g - d * j, a * j - c * g, c * d - a * f,
           d * i - e * g, b * g - a * i, a * e - b * d]
    det = a * adj[0] + b * adj[3] + c * adj[6]
    return F.when(F.abs(det) > 1e-300, F.array(*[m / det for m in adj]))


def hist_distance(a, b) -> Column:
    """Bhattacharyya distance of two histograms held as arrays."""
    bc = F.aggregate(F.zip_with(_c(a), _c(b), lambda p, q: F.sqrt(p * q)),
                     F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - bc))
