"""Rectangles, rings, tile grids, affine transforms and Web Mercator as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.pixel import col

HALF = 20037508.342789244  # half the width of the Web Mercator world, in metres
RADIUS = 6378137.0
TILE = 256


def rect_intersects(minx, miny, maxx, maxy, x0, y0, x1, y1) -> Column:
    """Bounding boxes meet, borders included. Where x0 > x1 the second box crosses the antimeridian and counts as two."""
    a, b, c, d = (col(v) for v in (minx, miny, maxx, maxy))
    p, q, r, s = (col(v) for v in (x0, y0, x1, y1))
    across = (a <= r) & (c >= p)
    return F.when(p <= r, across).otherwise((c >= p) | (a <= r)) & (b <= s) & (d >= q)


def rect_filter(minx, miny, maxx, maxy, bbox) -> Column:
    """The same for one known box: comparisons with literals, which reach the Parquet scan."""
    x0, y0, x1, y1 = map(float, bbox)
    tall = (col(miny) <= y1) & (col(maxy) >= y0)
    wide = (col(minx) <= x1) & (col(maxx) >= x0) if x0 <= x1 else (col(maxx) >= x0) | (col(minx) <= x1)
    return wide & tall


def _edges(ring) -> Column:
    n = F.size(ring)
    return F.arrays_zip(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))).alias("p"), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))).alias("q"))


def ring_contains(ring, x, y) -> Column:
    """Even-odd rule: the point lies in the closed ring."""
    ring, x, y = col(ring), col(x), col(y)

    def crosses(e):
        p, q = e["p"], e["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"]))

    return F.aggregate(_edges(ring), F.lit(False), lambda acc, e: acc != F.coalesce(crosses(e), F.lit(False)))


def edges_meet_rect(ring, x0, y0, x1, y1) -> Column:
    """An edge of the ring has a point in the closed rectangle."""
    ring, x0, y0, x1, y1 = (col(v) for v in (ring, x0, y0, x1, y1))

    def cuts(e):
        """The edge's parameter range inside both slabs is not empty (Liang-Barsky)."""
        p, dx, dy = e["p"], e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        tx = [F.try_divide(v - p["x"], dx) for v in (x0, x1)]
        ty = [F.try_divide(v - p["y"], dy) for v in (y0, y1)]
        low = F.greatest(F.lit(0.0), F.least(*tx), F.least(*ty))
        high = F.least(F.lit(1.0), F.greatest(*tx), F.greatest(*ty))
        return (low <= high) & ((dx != 0) | p["x"].between(x0, x1)) & ((dy != 0) | p["y"].between(y0, y1))

    return F.exists(_edges(ring), cuts)


def ring_meets_rect(ring, x0, y0, x1, y1) -> Column:
    """A polygon and a rectangle share a point: a vertex inside, a corner inside, or edges that cross."""
    ring, x0, y0, x1, y1 = (col(v) for v in (ring, x0, y0, x1, y1))
    vertex = F.exists(ring, lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1))
    return vertex | ring_contains(ring, x0, y0) | edges_meet_rect(ring, x0, y0, x1, y1)


def rect_ring(minx, miny, maxx, maxy) -> Column:
    """The closed ring W S, W N, E N, E S, W S."""
    a, b, c, d = (col(v).cast("double") for v in (minx, miny, maxx, maxy))
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((a, b), (a, d), (c, d), (c, b), (a, b))])


def rect_wkt(x0, y0, x1, y1) -> Column:
    """The same as text; reversed edges are swapped."""
    w, e = F.least(col(x0), col(x1)), F.greatest(col(x0), col(x1))
    s, n = F.least(col(y0), col(y1)), F.greatest(col(y0), col(y1))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in ((w, s), (w, n), (e, n), (e, s), (w, s))]), F.lit("))"))


def wkt_ring(wkt) -> Column:
    """The outer ring of POLYGON text; NULL for other or malformed text."""
    body = F.regexp_extract(col(wkt), r"(?i)^\s*POLYGON\s*\(\s*\(([^()]*)\)\s*\)\s*$", 1)
    numbers = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    ring = F.transform(numbers, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y")))
    good = (body != "") & F.forall(numbers, lambda p: F.size(p) == 2) & F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.when(good, ring)


def ring_bbox(ring) -> Column:
    xs, ys = F.transform(col(ring), lambda p: p["x"]), F.transform(col(ring), lambda p: p["y"])
    return F.when(col(ring).isNotNull(), F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")))


def ring_geojson(ring) -> Column:
    coords = F.transform(col(ring), lambda p: F.array(p["x"], p["y"]))
    return F.when(col(ring).isNotNull(), F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(coords).alias("coordinates"))))


def curve_key(x, y, bits: int = 16) -> Column:
    """Place of a point in degrees on a Z-order curve of 2^bits cells each way: points that are close in both directions
    have keys that are mostly close."""
    top = float(2**bits - 1)
    cell = lambda v, low, width: F.greatest(F.lit(0.0), F.least(F.lit(top), F.floor((col(v).cast("double") - low) / width * 2**bits))).cast("long")

    def spread(v):
        """The bits of v at every second place."""
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(cell(x, -180.0, 360.0)).bitwiseOR(F.shiftleft(spread(cell(y, -90.0, 180.0)), 1))


# -- affine transforms: struct(ox, pw, rr, oy, cr, ph) ---------------------------------------------------------------
def pixel_to_world(gt, c, r) -> Column:
    gt, c, r = col(gt), col(c), col(r)
    return F.struct((gt["ox"] + gt["pw"] * c + gt["rr"] * r).alias("x"), (gt["oy"] + gt["cr"] * c + gt["ph"] * r).alias("y"))


def world_to_pixel(gt, x, y) -> Column:
    gt, dx, dy = col(gt), col(x) - col(gt)["ox"], col(y) - col(gt)["oy"]
    det = gt["pw"] * gt["ph"] - gt["rr"] * gt["cr"]
    return F.when(det != 0, F.struct(F.try_divide(gt["ph"] * dx - gt["rr"] * dy, det).alias("col"), F.try_divide(gt["pw"] * dy - gt["cr"] * dx, det).alias("row")))


# -- tiles ------------------------------------------------------------------------------------------------------------
def tile_bounds(z, x, y) -> Column:
    span = F.lit(2 * HALF) / F.pow(F.lit(2.0), col(z))
    west, north = F.lit(-HALF) + col(x) * span, F.lit(HALF) - col(y) * span
    return F.struct(west.alias("minx"), (north - span).alias("miny"), (west + span).alias("maxx"), north.alias("maxy"))


def pixel_centre(bounds, px, py, size: int = TILE) -> Column:
    b = col(bounds)
    dx, dy = (b["maxx"] - b["minx"]) / size, (b["maxy"] - b["miny"]) / size
    return F.struct((b["minx"] + (col(px) + 0.5) * dx).alias("x"), (b["maxy"] - (col(py) + 0.5) * dy).alias("y"))


def mercator_to_lonlat(x, y) -> Column:
    return F.struct(F.degrees(col(x) / RADIUS).alias("x"), F.degrees(2 * F.atan(F.exp(col(y) / RADIUS)) - F.lit(1.5707963267948966)).alias("y"))


def lonlat_to_mercator(lon, lat) -> Column:
    lat = F.least(F.greatest(col(lat).cast("double"), F.lit(-85.0511287798066)), F.lit(85.0511287798066))
    return F.struct((F.radians(col(lon).cast("double")) * RADIUS).alias("x"), (F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * RADIUS).alias("y"))


def tile_lonlat(z, x, y) -> Column:
    """Bounds of a tile in degrees."""
    n = F.pow(F.lit(2.0), col(z))
    lat = lambda v: F.degrees(2 * F.atan(F.exp(F.lit(3.141592653589793) * (1 - 2 * v / n))) - F.lit(1.5707963267948966))
    return F.struct((col(x) * 360 / n - 180).alias("minx"), lat(col(y) + 1).alias("miny"), ((col(x) + 1) * 360 / n - 180).alias("maxx"), lat(col(y)).alias("maxy"))


def source_window(corners, width, height) -> Column:
    """struct(c0, r0, c1, r1) of the source pixels under four corners (array of struct(col, row)); NULL where there are none."""
    cs, rs = F.transform(col(corners), lambda p: p["col"]), F.transform(col(corners), lambda p: p["row"])
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0)), col(top)).cast("int")
    c0, c1 = clamp(F.floor(F.array_min(cs)), width), clamp(F.ceil(F.array_max(cs)) + 1, width)
    r0, r1 = clamp(F.floor(F.array_min(rs)), height), clamp(F.ceil(F.array_max(rs)) + 1, height)
    return F.when((c0 < c1) & (r0 < r1), F.struct(c0.alias("c0"), r0.alias("r0"), c1.alias("c1"), r1.alias("r1")))


def bilinear(pixels, w, h, c, r) -> Column:
    """Sample of a row-major array at (column, row), edges clamped; NULL where a needed pixel is no data."""
    p, w, h = col(pixels), col(w), col(h)
    c = F.least(F.greatest(col(c).cast("double"), F.lit(0.0)), (w - 1).cast("double"))
    r = F.least(F.greatest(col(r).cast("double"), F.lit(0.0)), (h - 1).cast("double"))
    c0, r0 = F.floor(c).cast("int"), F.floor(r).cast("int")
    c1, r1 = F.least(c0 + 1, (w - 1).cast("int")), F.least(r0 + 1, (h - 1).cast("int"))
    fc, fr = c - c0, r - r0
    at = lambda x, y: F.nanvl(F.get(p, (y * w + x).cast("int")).cast("double"), F.lit(None).cast("double"))
    top = at(c0, r0) * (1 - fc) + at(c1, r0) * fc
    low = at(c0, r1) * (1 - fc) + at(c1, r1) * fc
    return top * (1 - fr) + low * fr
