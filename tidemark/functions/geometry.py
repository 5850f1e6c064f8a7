"""Column functions on boxes and rings, all in built-in expressions.

A ring is array<struct<x:double,y:double>>, open or closed; a box is four
doubles x1, y1, x2, y2. Missing values are null and stay null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def finite(c: Column) -> Column:
    """NaN and infinities become null: inside the engine missing means null."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), c)


# rings

def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The box as an open ring, anticlockwise from its lower left corner."""
    return F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))


def flat_to_ring(seg: Column) -> Column:
    """[x0, y0, x1, y1, ...] as a ring."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(seg) / 2).cast("int") - 1), lambda i: point(seg[2 * i], seg[2 * i + 1]))


def ring_to_flat(ring: Column) -> Column:
    return F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))


def open_ring(ring: Column) -> Column:
    """Without the closing point, if there is one."""
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)


def closed(ring: Column) -> Column:
    """The ring with its first point again at the end."""
    same = F.element_at(ring, 1) == F.element_at(ring, -1)
    return F.when(same & (F.size(ring) > 1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def _turned(ring: Column) -> Column:
    """Each point's successor, the first point after the last."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def _edge_sum(ring: Column, each) -> Column:
    terms = F.zip_with(ring, _turned(ring), each)
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def signed_area(ring: Column) -> Column:
    return _edge_sum(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def ring_area(ring: Column) -> Column:
    """Shoelace area, never negative; fewer than three points: 0."""
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(signed_area(ring)))


def ring_perimeter(ring: Column) -> Column:
    return _edge_sum(ring, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])))


def ring_centroid(ring: Column) -> Column:
    """Centre of area, as a point; of a ring without area the mean of its points."""

    def centre(a: Column) -> Column:
        cx = _edge_sum(ring, lambda p, q: (p["x"] + q["x"]) * (p["x"] * q["y"] - q["x"] * p["y"]))
        cy = _edge_sum(ring, lambda p, q: (p["y"] + q["y"]) * (p["x"] * q["y"] - q["x"] * p["y"]))
        n = F.size(ring)
        mx = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["x"]) / n
        my = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["y"]) / n
        return F.when(a == 0, point(mx, my)).otherwise(point(cx / (6 * a), cy / (6 * a)))

    return let(signed_area(ring), centre)


def ring_moments(ring: Column) -> Column:
    """Major axis, minor axis and orientation (degrees in [0, 180)) of the ellipse of equal second moments."""

    def axes(c: Column, a: Column) -> Column:
        local = F.transform(ring, lambda p: point(p["x"] - c["x"], p["y"] - c["y"]))

        def found(r: Column) -> Column:
            cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
            xx = _edge_sum(r, lambda p, q: (p["x"] * p["x"] + p["x"] * q["x"] + q["x"] * q["x"]) * cross(p, q)) / (12 * a)
            yy = _edge_sum(r, lambda p, q: (p["y"] * p["y"] + p["y"] * q["y"] + q["y"] * q["y"]) * cross(p, q)) / (12 * a)
            xy = _edge_sum(r, lambda p, q: (p["x"] * q["y"] + 2 * p["x"] * p["y"] + 2 * q["x"] * q["y"] + q["x"] * p["y"]) * cross(p, q)) / (24 * a)
            spread = F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)
            angle = F.pmod(F.degrees(F.atan2(2 * xy, xx - yy) / 2), F.lit(180.0))
            return F.struct((2 * F.sqrt(2 * (xx + yy + spread))).alias("major"), (2 * F.sqrt(F.greatest(2 * (xx + yy - spread), F.lit(0.0)))).alias("minor"), angle.alias("orientation"))

        return let(local, found)

    return let(ring_centroid(ring), lambda c: let(signed_area(ring), lambda a: F.when(a != 0, axes(c, a))))


def ring_box(ring: Column) -> Column:
    """struct<x1,y1,x2,y2>."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def ring_edges(ring: Column) -> Column:
    """array<struct<ax,ay,bx,by>>: the edges, the last one back to the first point."""
    return F.zip_with(ring, _turned(ring), lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))


def in_ring(edges: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside, by the crossings of a ray to the right; borders belong to the side of larger coordinates."""

    def crossed(e: Column) -> Column:
        return F.when((e["ay"] > y) != (e["by"] > y), x < e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])).otherwise(False)

    return F.size(F.filter(edges, crossed)) % 2 == 1


def on_ring(edges: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on an edge, exactly."""

    def meets(e: Column) -> Column:
        between = (x >= F.least(e["ax"], e["bx"])) & (x <= F.greatest(e["ax"], e["bx"])) & (y >= F.least(e["ay"], e["by"])) & (y <= F.greatest(e["ay"], e["by"]))
        return between & ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"]))

    return F.exists(edges, meets)


def edge_distance(edges: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the nearest edge; null without edges."""

    def one(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.least(F.greatest(((x - e["ax"]) * dx + (y - e["ay"]) * dy) / long, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return let(t, lambda t: F.hypot(x - e["ax"] - t * dx, y - e["ay"] - t * dy))

    return F.array_min(F.transform(edges, one))


def edge_meets_box(edges: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether an edge has a point in a box, its borders included: the parts of the edge inside both strips overlap."""

    def inside(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
        d = b - a
        near, far = F.least((low - a) / d, (high - a) / d), F.greatest((low - a) / d, (high - a) / d)
        level = (a >= low) & (a <= high)
        return F.when(d != 0, near).when(level, 0.0).otherwise(2.0), F.when(d != 0, far).when(level, 1.0).otherwise(-1.0)

    def one(e: Column) -> Column:
        (xa, xb), (ya, yb) = inside(e["ax"], e["bx"], x1, x2), inside(e["ay"], e["by"], y1, y2)
        return F.greatest(xa, ya, F.lit(0.0)) <= F.least(xb, yb, F.lit(1.0))

    return F.exists(edges, one)


def usable_ring(ring: Column) -> Column:
    """At least three distinct points and an area. A ring that crosses itself passes here: outlines.checked() finds those."""
    return (F.size(F.array_distinct(ring)) >= 3) & (ring_area(ring) > 0)


def expanded(ring: Column, by: Column) -> Column:
    """Every point moved away from the median point by a distance."""
    mid = lambda axis: let(F.array_sort(F.transform(ring, lambda p: p[axis])), lambda s: let(F.size(s), lambda n: (s[F.floor((n - 1) / 2).cast("int")] + s[F.floor(n / 2).cast("int")]) / 2))

    def moved(cx: Column, cy: Column) -> Column:
        return F.transform(ring, lambda p: let(F.atan2(p["y"] - cy, p["x"] - cx), lambda t: let(F.hypot(p["x"] - cx, p["y"] - cy) + by, lambda r: point(cx + r * F.cos(t), cy + r * F.sin(t)))))

    return let(mid("x"), lambda cx: let(mid("y"), lambda cy: moved(cx, cy)))


#: Whole-picture turns (rot90 is clockwise) and mirrors, as functions of (x, y, width, height). Fixed names: files carry them.
VARIANTS = {
    "orig": lambda x, y, w, h: (x, y),
    "hflip": lambda x, y, w, h: (w - x, y),
    "vflip": lambda x, y, w, h: (x, h - y),
    "rot90": lambda x, y, w, h: (h - y, x),
    "rot180": lambda x, y, w, h: (w - x, h - y),
    "rot270": lambda x, y, w, h: (y, w - x),
    "transpose": lambda x, y, w, h: (y, x),
    "antitranspose": lambda x, y, w, h: (h - y, w - x),
}
#: Those that swap width and height.
SWAPPING = ("rot90", "rot270", "transpose", "antitranspose")


def turned_ring(ring: Column, variant: Column, w: Column, h: Column) -> Column:
    def one(p: Column) -> Column:
        out = None
        for name, f in VARIANTS.items():
            q = point(*f(p["x"], p["y"], w, h))
            out = F.when(variant == name, q) if out is None else out.when(variant == name, q)
        return out

    return F.transform(ring, one)


def axis_ends(centre: Column, length: Column, degrees: Column) -> Column:
    """Both ends of an axis through a point."""
    dx, dy = F.cos(F.radians(degrees)) * length / 2, F.sin(F.radians(degrees)) * length / 2
    return F.array(point(centre["x"] - dx, centre["y"] - dy), point(centre["x"] + dx, centre["y"] + dy))


# boxes

def box_overlap(a: tuple, b: tuple) -> Column:
    """Area of the intersection of two boxes (x1, y1, x2, y2)."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area(a: tuple) -> Column:
    return F.greatest(a[2] - a[0], F.lit(0.0)) * F.greatest(a[3] - a[1], F.lit(0.0))


def box_iou(a: tuple, b: tuple) -> Column:
    """Intersection over union; no intersection: 0."""
    inter = box_overlap(a, b)
    return F.when(inter > 0, inter / (box_area(a) + box_area(b) - inter)).otherwise(F.lit(0.0))


def normalised_box(det: Column) -> Column:
    """Corners of a detection: bbox_xyxy if given, else bbox by its bbox_format or source, x y w h by default."""
    xyxy = F.lower(F.coalesce(det["bbox_format"], det["source"], F.lit(""))).contains("xyxy")
    b = det["bbox"]
    corner = F.struct(b[0].alias("x1"), b[1].alias("y1"), F.when(xyxy, b[2]).otherwise(b[0] + b[2]).alias("x2"), F.when(xyxy, b[3]).otherwise(b[1] + b[3]).alias("y2"))
    g = det["bbox_xyxy"]
    given = F.struct(g[0].alias("x1"), g[1].alias("y1"), g[2].alias("x2"), g[3].alias("y2"))
    return F.when(g.isNotNull(), given).otherwise(corner)


# similarity of two objects

def log_ratio(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return F.abs(F.log((a + eps) / (b + eps)))


def axial_difference(a: Column, b: Column) -> Column:
    """Difference of two undirected angles in degrees, 0 to 90."""
    return let(F.pmod(a - b, F.lit(180.0)), lambda d: F.least(d, 180.0 - d))


#: Weights of a pair's score.
WEIGHTS = {"distance": 0.30, "area": 0.25, "volume": 0.35, "orientation": 0.10}


def pair_score(distance: Column, areas: tuple, volumes: tuple, angles: tuple, radius: float, weights: dict[str, float] = WEIGHTS) -> Column:
    """Likeness of two objects, 0 to 1; a missing volume or orientation counts half."""
    volume = F.when(volumes[0].isNull() | volumes[1].isNull(), 0.5).otherwise(F.exp(-log_ratio(*volumes)))
    angle = F.when(angles[0].isNull() | angles[1].isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - axial_difference(*angles) / 90))
    parts = {"distance": F.greatest(F.lit(0.0), 1 - distance / radius), "area": F.exp(-log_ratio(*areas)), "volume": volume, "orientation": angle}
    total = F.lit(0.0)
    for name, value in parts.items():
        total = total + weights[name] * value
    return total


# pixels and places: six conventions, kept apart

def corner_to_world(col: Column, row: Column, x0: Column, y0: Column, px: Column, py: Column) -> Column:
    """Corner of a 0-based cell."""
    return point(x0 + col * px, y0 + row * py)


def world_to_corner(x: Column, y: Column, x0: Column, y0: Column, px: Column, py: Column) -> Column:
    """Inverse of corner_to_world(), fractions kept: (col, row)."""
    return point((x - x0) / px, (y - y0) / py)


def centre_to_world(col: Column, row: Column, x0: Column, y0: Column, px: Column, py: Column) -> Column:
    """Centre of a 0-based cell."""
    return point(x0 + (col + 0.5) * px, y0 + (row + 0.5) * py)


def half_pixel_to_world(x: Column, y: Column, x0: Column, ytop: Column, px: Column, py: Column) -> Column:
    """1-based, half a pixel in; py is positive here."""
    return point(x0 + (x - 0.5) * px, ytop - (y - 0.5) * py)


def world_to_half_pixel(x: Column, y: Column, x0: Column, ytop: Column, px: Column, py: Column) -> Column:
    """1-based whole pixel, rounding halves to even; not the inverse of half_pixel_to_world()."""
    return point(1 + F.bround(F.abs(x - x0) / px), 1 + F.bround(F.abs(y - ytop) / py))


def whole_pixel_to_world(x: Column, y: Column, x0: Column, ytop: Column, px: Column, py: Column) -> Column:
    """1-based, whole pixels in; py is positive here."""
    return point(x0 + (x - 1) * px, ytop - (y - 1) * py)


def whole_pixel_to_limits(x: Column, y: Column, west: Column, north: Column, cell_lon: Column, cell_lat: Column) -> Column:
    """whole_pixel_to_world() on a raster in degrees: its limits of longitude and latitude and its cells' extents take the plane's place."""
    return F.struct((west + (x - 1) * cell_lon).alias("lon"), (north - (y - 1) * cell_lat).alias("lat"))


def world_to_ratio(x: Column, y: Column, bounds: tuple, width: Column, height: Column) -> Column:
    """1-based share of the bounds' extent (xmin, ymin, xmax, ymax), y downwards."""
    return point(1 + width * (x - bounds[0]) / (bounds[2] - bounds[0]), 1 + height * (bounds[3] - y) / (bounds[3] - bounds[1]))


# UTM zone 29 north on GRS80, by the published series in the flattening

_A, _F = 6378137.0, 1 / 298.257222101
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_to_lonlat(x: Column, y: Column, meridian: float = -9.0) -> Column:
    """struct<lon,lat> in degrees from easting and northing."""
    xi, eta = y / (_R * 0.9996), (x - 500000.0) / (_R * 0.9996)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + meridian
    return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))


def lonlat_to_utm(lon: Column, lat: Column, meridian: float = -9.0) -> Column:
    """point of easting and northing from degrees: the inverse of utm_to_lonlat()."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi1, eta1 = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    xi, eta = xi1, eta1
    for j, a in enumerate(_ALPHA, 1):
        xi = xi + a * F.sin(2 * j * xi1) * F.cosh(2 * j * eta1)
        eta = eta + a * F.cos(2 * j * xi1) * F.sinh(2 * j * eta1)
    return point(500000.0 + _R * 0.9996 * eta, _R * 0.9996 * xi)
