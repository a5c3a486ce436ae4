"""Geometry and geodesy as column expressions, all of them inside whole-stage code generation.

Points are (lon, lat) in degrees or (x, y); an affine is a struct of a, b, c, d, e, f, which maps
(x, y) to (a x + b y + c, d x + e y + f); a ring is an array of arrays [x, y], open or closed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Metres a degree of longitude at the equator and of latitude; earth's radius in feet; feet a metre.
LON_M, LAT_M, RADIUS_FT, FEET = 111_320.0, 110_540.0, 20_925_524.0, 3.280839895
#: The scale ratios that aren't outliers (same, half and double scale).
SCALE_BANDS = ((0.75, 1.25), (0.4, 0.6), (1.8, 2.2))


def meters_between(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Flat-earth distance, with longitudes shrunk at the middle latitude."""
    return F.hypot((lon_a - lon_b) * LON_M * F.cos(F.radians((lat_a + lat_b) / 2)), (lat_a - lat_b) * LAT_M)


def haversine_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    half = lambda x, y: F.sin((F.radians(y) - F.radians(x)) / 2)
    h = half(lat_a, lat_b) * half(lat_a, lat_b) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(lon_a, lon_b) * half(lon_a, lon_b)
    return 2 * RADIUS_FT / FEET * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def wrap_degrees(d: Column) -> Column:
    """d folded to [-180, 180)."""
    return F.pmod(d + 180, F.lit(360.0)) - 180


def wrap_radians(d: Column) -> Column:
    """d folded to [-pi, pi)."""
    return F.pmod(d + F.pi(), 2 * F.pi()) - F.pi()


def angle_difference(a: Column, b: Column) -> Column:
    """Signed difference of bearings, in (-180, 180]."""
    return 180 - F.pmod(180 - (a - b), F.lit(360.0))


def axis_difference(a: Column, b: Column) -> Column:
    """Signed difference of undirected bearings, in [-90, 90)."""
    return F.pmod(a - b + 90, F.lit(180.0)) - 90


def folded_log2_distance(a: Column, b: Column) -> Column:
    """Distance of two positions on a circle of length 1."""
    d = F.pmod(F.abs(a - b), F.lit(1.0))
    return F.least(d, 1 - d)


def is_scale_outlier(ratio: Column, bands=SCALE_BANDS) -> Column:
    inside = F.lit(False)
    for low, high in bands:
        inside = inside | ratio.between(low, high)
    return ~inside


def edge_class(x: Column, y: Column, band: float = 0.25) -> Column:
    """T, B, L, R or two of them for a point by its shares of width and height; center if it is near no edge."""
    mark = lambda near, letter: F.when(near, F.lit(letter)).otherwise(F.lit(""))
    found = F.concat(mark(y < band, "T"), mark(y > 1 - band, "B"), mark(x < band, "L"), mark(x > 1 - band, "R"))
    return F.when(found == "", F.lit("center")).otherwise(found)


def box_gap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Gap of two boxes (x0, y0, x1, y1), 0 where they touch."""
    side = lambda i: F.greatest(F.lit(0.0), F.greatest(a[i], b[i]) - F.least(a[i + 2], b[i + 2]))
    return F.hypot(side(0), side(1))


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    common, whole = side(0) * side(1), area(a) + area(b)
    return F.when(whole - common > 0, common / (whole - common)).otherwise(F.lit(0.0))


def affine(a, b, c, d, e, f) -> Column:
    names = zip("abcdef", (a, b, c, d, e, f))
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in names])


def apply_affine(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["b"] * y + m["c"], m["d"] * x + m["e"] * y + m["f"]


def compose(m: Column, n: Column) -> Column:
    """The affine that applies n, then m."""
    row = lambda p, q, r: (p * n["a"] + q * n["d"], p * n["b"] + q * n["e"], p * n["c"] + q * n["f"] + r)
    return affine(*row(m["a"], m["b"], m["c"]), *row(m["d"], m["e"], m["f"]))


def invert_affine(m: Column) -> Column:
    """The inverse; null where the affine is flat."""
    det = m["a"] * m["e"] - m["b"] * m["d"]
    det = F.when(det != 0, det)
    return F.when(det.isNotNull(), affine(m["e"] / det, -m["b"] / det, (m["b"] * m["f"] - m["e"] * m["c"]) / det, -m["d"] / det, m["a"] / det, (m["d"] * m["c"] - m["a"] * m["f"]) / det))


def bilinear(corners: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Point at shares u of width and v of height within corners [TL, TR, BR, BL], each [x, y]."""
    at = lambda i: corners[0][i] * (1 - u) * (1 - v) + corners[1][i] * u * (1 - v) + corners[2][i] * u * v + corners[3][i] * (1 - u) * v
    return at(0), at(1)


def line_crossing(xa: Column, ya: Column, dir_a: Column, xb: Column, yb: Column, dir_b: Column, reach: float = 3.0) -> Column:
    """Struct (x, y) where two lines cross, given a point and a direction of each.

    Null where they are nearly parallel, the points less than 1 apart, or the crossing further than reach times that from either.
    """
    det = F.sin(dir_b - dir_a)
    t = ((xb - xa) * F.sin(dir_b) - (yb - ya) * F.cos(dir_b)) / F.when(F.abs(det) >= 0.1, det)
    x, y, apart = xa + t * F.cos(dir_a), ya + t * F.sin(dir_a), F.hypot(xb - xa, yb - ya)
    near = (apart >= 1) & (F.hypot(x - xa, y - ya) <= reach * apart) & (F.hypot(x - xb, y - yb) <= reach * apart)
    return F.when(near, F.struct(x.alias("x"), y.alias("y")))


def _sides(ring: Column, of) -> Column:
    """Sum of of(p, q) over a ring's sides, the closing one included."""
    n = F.size(ring)
    each = F.transform(ring, lambda p, i: of(p, F.element_at(ring, (F.pmod(i + 1, F.greatest(n, F.lit(1))) + 1).cast("int"))))
    return F.aggregate(each, F.lit(0.0), lambda t, x: t + x)


def ring_area(ring: Column) -> Column:
    return F.abs(_sides(ring, lambda p, q: p[0] * q[1] - q[0] * p[1])) / 2


def ring_length(ring: Column) -> Column:
    return _sides(ring, lambda p, q: F.hypot(q[0] - p[0], q[1] - p[1]))


def compactness(ring: Column) -> Column:
    """4 pi area / length squared: 1 for a circle; null for a ring of no length."""
    return 4 * F.pi() * ring_area(ring) / F.when(ring_length(ring) > 0, ring_length(ring) * ring_length(ring))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point crosses an odd number of sides."""
    hit = lambda p, q: F.when(((p[1] > y) != (q[1] > y)) & (x < (q[0] - p[0]) * (y - p[1]) / F.when(q[1] != p[1], q[1] - p[1]) + p[0]), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.pmod(_sides(ring, hit), F.lit(2.0)) == 1


def quad_rotation(polygon: Column) -> Column:
    """Degrees of a quad's first side off the nearest axis, in [0, 45]."""
    angle = F.pmod(F.abs(F.degrees(F.atan2(polygon[1][1] - polygon[0][1], polygon[1][0] - polygon[0][0]))), F.lit(90.0))
    return F.least(angle, 90 - angle)


def residual_bucket(feet: Column) -> Column:
    """The viewer's bands; the scorer's differ (see plans.scoring)."""
    return F.when(feet <= 25, "good").when(feet <= 100, "ok").when(feet <= 200, "poor").when(feet.isNotNull(), "disaster")


#: earth's radius in miles, feet a degree of latitude, metres a degree where one figure serves both axes.
RADIUS_MILES, DEGREE_FT, DEGREE_M = 3958.8, math.pi * RADIUS_FT / 180, 111_320.0
#: Ratios of a fitted scale to a broad prior, and of a prior to its volume's median, that are taken as plausible and as half scale.
BROAD_RATIO, HALF_RATIO = (0.1, 6.0), (math.sqrt(0.125), 0.63)
#: Rotations (degrees) at which a sheet's text would stand on its head.
UPSIDE_DOWN = (112.0, 247.0)
#: Expected worth of publishing a pose, by its control points (up to 1, up to 3, more) and whether its verification is at least zero.
KEEP_PRIOR = ((0.00, 0.69), (0.25, 0.68), (0.57, 0.94))
#: Least verification, and the sigma of position (m) and angle (degrees) it earns.
SIGMAS = ((1.3, 5.0, 0.6), (1.1, 9.0, 1.2), (0.9, 18.0, 2.5))
WEAK_SIGMA = (35.0, 5.0)


def segment_distance_m(x1: Column, y1: Column, x2: Column, y2: Column, lon: Column, lat: Column) -> Column:
    """Metres from a point to a segment, in a flat frame about the point."""
    k = LON_M * F.cos(F.radians(lat))
    ax, ay, bx, by = (x1 - lon) * k, (y1 - lat) * LAT_M, (x2 - lon) * k, (y2 - lat) * LAT_M
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(length, F.lit(0.0)))))
    return F.hypot(ax + t * dx, ay + t * dy)


def ring_area_m2(ring: Column) -> Column:
    """Area of a ring of [lon, lat], in a flat frame at its mean latitude."""
    mean = F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[1]) / F.size(ring)
    k = LON_M * F.cos(F.radians(mean))
    return F.abs(_sides(ring, lambda p, q: p[0] * q[1] - q[0] * p[1])) * k * LAT_M / 2


def region_m_per_px(rings: Column, width: Column, height: Column) -> Column:
    """Scale at which rings of [lon, lat] fill a sheet; null without area or sheet."""
    total = F.aggregate(F.filter(rings, lambda r: F.size(r) >= 3), F.lit(0.0), lambda t, r: t + ring_area_m2(r))
    return F.when((total > 0) & (width > 0) & (height > 0), F.sqrt(total / (width * height)))


def region_prior_px_per_ft(rings: Column, width: Column, height: Column, panel: Column) -> Column:
    """Pixels a foot that the regions of a page suggest; a panel is taken as one of them on the mean."""
    scale = region_m_per_px(rings, width, height) / F.when(panel & (F.size(rings) > 1), F.sqrt(F.size(rings))).otherwise(1.0)
    return F.when(scale > 0, 1 / (scale * FEET))


def broad_scale_plausible(fitted: Column, prior: Column) -> Column:
    return (fitted / prior).between(*BROAD_RATIO)


def region_relative_scale(prior: Column, median: Column) -> Column:
    ratio = prior / median
    return F.when((ratio >= HALF_RATIO[0]) & (ratio < HALF_RATIO[1]), 0.5).otherwise(1.0)


def project(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of a point, with one figure for a degree."""
    return (lon - lon0) * F.cos(F.radians(lat0)) * DEGREE_M, (lat - lat0) * DEGREE_M


def unproject(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    return lon0 + x / (F.cos(F.radians(lat0)) * DEGREE_M), lat0 + y / DEGREE_M


def local_xy(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of a frame's origin, with a figure for each axis."""
    return (lon - lon0) * LON_M * F.cos(F.radians(lat0)), (lat - lat0) * LAT_M


def point_bounds(lon: Column, lat: Column, radius_m: Column) -> tuple[Column, ...]:
    """(west, east, south, north) of a circle."""
    dx, dy = radius_m / F.greatest(LON_M * F.cos(F.radians(lat)), F.lit(1e-6)), radius_m / LAT_M
    return lon - dx, lon + dx, lat - dy, lat + dy


def north_angle(m: Column) -> Column:
    """Where an affine to (lon, lat) has north: degrees clockwise from the image's right, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(m["e"], m["d"])), F.lit(360.0))


def scale_deg_per_px(m: Column) -> Column:
    return F.hypot(m["d"], m["e"])


def deg_per_px_to_px_per_ft(scale: Column) -> Column:
    return 1 / (scale * DEGREE_FT)


def px_per_ft_to_deg_per_px(scale: Column) -> Column:
    return 1 / (scale * DEGREE_FT)


def px_per_ft(m: Column) -> Column:
    return deg_per_px_to_px_per_ft(scale_deg_per_px(m))


def distortion(m: Column) -> tuple[Column, Column]:
    """Degrees that an affine's axes are off a right angle, and the ratio of their scales; rounded to 2 and 3 places, halves to even."""
    k = F.cos(F.radians(m["f"]))
    ux, uy, vx, vy = m["a"] * k, m["d"], m["b"] * k, m["e"]
    u, v = F.hypot(ux, uy), F.hypot(vx, vy)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / F.nullif(u * v, F.lit(0.0))))
    return F.bround(F.when((u > 0) & (v > 0), F.degrees(F.acos(cosine)) - 90).otherwise(0.0), 2), F.bround(F.when(v > 0, u / F.nullif(v, F.lit(0.0))).otherwise(1.0), 3)


def sample_grid(width: Column, height: Column, n: int = 7) -> Column:
    """n times n points [x, y] at even shares of a sheet, row by row, none on its edges."""
    at = F.array(*[F.lit((k + 1) / (n + 1)) for k in range(n)])
    return F.flatten(F.transform(at, lambda v: F.transform(at, lambda u: F.array(u * width, v * height))))


def affine_through(scale: Column, rotation: Column, x: Column, y: Column, lon: Column, lat: Column, cos_phi: Column) -> Column:
    """The affine of a scale and rotation (radians) that puts a pixel at a place."""
    a, b = scale * F.cos(rotation), scale * F.sin(rotation)
    return affine(a / cos_phi, b / cos_phi, lon - a / cos_phi * x - b / cos_phi * y, b, -a, lat - b * x + a * y)


def relaxed_threshold(confidence: Column, least: Column, base: Column, floor: Column) -> Column:
    """A size floor that falls by a power law from base at the least confidence to floor at 1."""
    power = F.ln(floor / base) / F.ln(least)
    return F.when((confidence <= least) | (floor >= base), base).otherwise(base * F.pow(least / F.least(confidence, F.lit(1.0)), power))


def note_m_per_px(feet: Column, px_per_inch: Column) -> Column:
    return feet * 0.3048 / px_per_inch


def expected_px_per_ft(px_per_inch: Column, feet: Column) -> Column:
    return px_per_inch / feet


def text_angle(m: Column) -> Column:
    """Degrees of a pose's x axis off east, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(m["d"] * LAT_M, m["a"] * LON_M * F.cos(F.radians(m["f"])))), F.lit(360.0))


def is_upside_down(m: Column) -> Column:
    return text_angle(m).between(*UPSIDE_DOWN)


def pose_scale_log2(m: Column) -> Column:
    """log2 of a pose's metres a pixel."""
    return F.log2(F.greatest(F.hypot(m["a"] * LON_M * F.cos(F.radians(m["f"])), m["d"] * LAT_M), F.lit(1e-12)))


def pose_center(m: Column, width: Column, height: Column) -> tuple[Column, Column]:
    return apply_affine(m, width / 2, height / 2)


def keep_prior(points: Column, verification: Column) -> Column:
    sure = F.coalesce(verification >= 0, F.lit(False))
    low, middle, high = (F.when(sure, b).otherwise(a) for a, b in KEEP_PRIOR)
    return F.when(points <= 1, low).when(points <= 3, middle).otherwise(high)


def overlap_share(iou: Column, soft: Column, hard: Column) -> Column:
    """0 up to soft, 1 from hard, and straight between."""
    return F.when(iou <= soft, 0.0).when(iou >= hard, 1.0).otherwise((iou - soft) / (hard - soft))


def overlap_cost(iou: Column, soft: Column, hard: Column) -> Column:
    """0 up to soft, prohibitive from hard, and by the square between."""
    part = (iou - soft) / (hard - soft)
    return F.when(iou <= soft, 0.0).when(iou >= hard, 1e6).otherwise(part * part)


def measurement_sigmas(verification: Column, synthetic: Column, one_sided: Column) -> tuple[Column, Column]:
    """Sigmas of a measured join's position (m) and angle (radians)."""
    position, angle = F.lit(WEAK_SIGMA[0]), F.lit(WEAK_SIGMA[1])
    for least, p, a in reversed(SIGMAS):
        position, angle = F.when(verification >= least, p).otherwise(position), F.when(verification >= least, a).otherwise(angle)
    factor = F.when(synthetic, 1.5).otherwise(1.0) * F.when(one_sided, 1.5).otherwise(1.0)
    return position * factor, F.radians(angle * factor)


def corners_m_per_px(corners: Column, width: Column, height: Column) -> Column:
    """Mean scale of a sheet's top and left side by its corners [TL, TR, BR, BL]."""
    k = LON_M * F.cos(F.radians(F.aggregate(corners, F.lit(0.0), lambda t, p: t + p[1]) / F.size(corners)))
    side = lambda i: F.hypot((corners[i][0] - corners[0][0]) * k, (corners[i][1] - corners[0][1]) * LAT_M)
    return (side(1) / width + side(3) / height) / 2


def page_affine(corners: Column, width: Column, height: Column) -> Column:
    """The affine of a sheet by its corners TL, TR, BL; null without them or its size."""
    step = lambda i, k, size: (corners[i][k] - corners[0][k]) / size
    there = (F.size(corners) == 4) & (width > 0) & (height > 0)
    return F.when(there, affine(step(1, 0, width), step(3, 0, height), corners[0][0], step(1, 1, width), step(3, 1, height), corners[0][1]))


def affine_to_pose(m: Column, lon0: Column, lat0: Column) -> Column:
    """Struct (x, y, theta) of a pose in a volume's frame: metres right and down of its origin, radians clockwise."""
    kx = LON_M * F.cos(F.radians(lat0))
    return F.struct((kx * (m["c"] - lon0)).alias("x"), (-LAT_M * (m["f"] - lat0)).alias("y"), F.atan2(-LAT_M * m["d"], kx * m["a"]).alias("theta"))


def pose_to_affine(pose: Column, scale: Column, lon0: Column, lat0: Column) -> Column:
    kx, c, s = LON_M * F.cos(F.radians(lat0)), F.cos(pose["theta"]), F.sin(pose["theta"])
    return affine(scale * c / kx, -scale * s / kx, pose["x"] / kx + lon0, -scale * s / LAT_M, -scale * c / LAT_M, -pose["y"] / LAT_M + lat0)


def relative_pose(anchor: Column, target: Column) -> Column:
    """The target's pose in the anchor's frame."""
    x, y, c, s = target["x"] - anchor["x"], target["y"] - anchor["y"], F.cos(anchor["theta"]), F.sin(anchor["theta"])
    return F.struct((c * x + s * y).alias("x"), (c * y - s * x).alias("y"), wrap_radians(target["theta"] - anchor["theta"]).alias("theta"))


def page_axes(psi: Column) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """East and north of a sheet's up and right directions, for its bearing in degrees."""
    up = F.sin(F.radians(psi)), F.cos(F.radians(psi))
    return up, (up[1], -up[0])


def pose_world(east: Column, north: Column, psi: Column, log_scale: Column, x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Metres east and north of a pixel under a pose of the sheet's centre, bearing and log of pixels a metre."""
    up, right = page_axes(psi)
    above, beside = (height / 2 - y) / F.exp(log_scale), (x - width / 2) / F.exp(log_scale)
    return east + above * up[0] + beside * right[0], north + above * up[1] + beside * right[1]


def ring_bbox(ring: Column) -> tuple[Column, ...]:
    """(x0, y0, x1, y1) of a ring's points."""
    axis = lambda i: F.transform(ring, lambda p: p[i])
    return F.array_min(axis(0)), F.array_min(axis(1)), F.array_max(axis(0)), F.array_max(axis(1))


def ring_sides(ring: Column) -> Column:
    """Lengths of a ring's sides, the closing one last."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.hypot(F.element_at(ring, (F.pmod(i + 1, n) + 1).cast("int"))[0] - p[0], F.element_at(ring, (F.pmod(i + 1, n) + 1).cast("int"))[1] - p[1]))


def distance_miles(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    return haversine_m(lon_a, lat_a, lon_b, lat_b) * (RADIUS_MILES * FEET / RADIUS_FT)


def circle(lon: Column, lat: Column, radius_m: Column, steps: int = 64) -> Column:
    """A closed ring of [lon, lat] about a point."""
    at = F.sequence(F.lit(0), F.lit(steps))
    turn = lambda i: i * (2 * math.pi / steps)
    return F.transform(at, lambda i: F.array(lon + radius_m * F.cos(turn(i)) / (LON_M * F.cos(F.radians(lat))), lat + radius_m * F.sin(turn(i)) / LAT_M))


def through_corners(corners: Column, width: Column, height: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The place of a pixel by a sheet's corners."""
    return bilinear(corners, x / width, y / height)


def unrotated(angle: Column, x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A pixel of a sheet that was turned by 90 degrees counterclockwise (angle 90) or clockwise (270), on the sheet as it was (width by height)."""
    return F.when(angle == 90, width - 1 - y).when(angle == 270, y).otherwise(x), F.when(angle == 90, x).when(angle == 270, height - 1 - x).otherwise(y)
