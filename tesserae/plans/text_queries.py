"""Queries over strings, identifiers, requests and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import crs, spatial, text
from tesserae.operators import params
from tesserae.plans.book import query
from tesserae.plans.fixtures import view

SLUG = "CASE WHEN trim(regexp_replace(lower(regexp_replace({0}, '[^A-Za-z0-9_\\s-]', '', 'g')), '[-_\\s]+', '-', 'g'), '-') = '' THEN 'service' ELSE trim(regexp_replace(lower(regexp_replace({0}, '[^A-Za-z0-9_\\s-]', '', 'g')), '[-_\\s]+', '-', 'g'), '-') END"
MESSY = "concat('  My_', p_name, ' -- (', p_brand, ')! ', CASE WHEN p_partkey % 50 = 0 THEN 'é' ELSE '' END)"


@query(f"SELECT p_partkey, {SLUG.format(MESSY)} AS slug, {SLUG.format('p_dot')} AS other FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN '..é..' ELSE p_type END AS p_dot FROM part)")
def slugs(s, d):
    p = view(s, d, "part").withColumn("m", F.expr(MESSY)).withColumn("o", F.expr("CASE WHEN p_partkey % 2 = 0 THEN '..é..' ELSE p_type END"))
    return p.select("p_partkey", text.slugify("m").alias("slug"), text.slugify("o").alias("other"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN {SLUG.format('c_name')} ELSE concat(substr(concat('abcdef', CAST(c_custkey AS VARCHAR)), 1, 8), '-scale-band') END AS slug FROM customer")
def default_slugs(s, d):
    c = view(s, d, "customer").select("c_custkey", F.concat(F.lit("abcdef"), F.col("c_custkey").cast("string")).alias("id"), F.lit("scale_band").alias("f"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("own"))
    return c.select("c_custkey", text.default_slug("id", "f", "own").alias("slug"))


@query("SELECT scene_id, CASE WHEN scene_id % 5 = 0 THEN 'explicit' ELSE strftime(acquired_at, '%Y-%m') END AS month FROM fx_footprints WHERE acquired_at IS NOT NULL")
def month_keys(s, d):
    f = view(s, d, "fx_footprints").where("acquired_at IS NOT NULL").withColumn("e", F.expr("CASE WHEN scene_id % 5 = 0 THEN 'explicit' ELSE '' END"))
    return f.select("scene_id", text.month_key("acquired_at", "e").alias("month"))


@query("""SELECT scene_id, band_role, concat('services/7/scenes/', CAST(scene_id AS VARCHAR), '/', band_role, '_x.', CASE WHEN scene_id % 2 = 0 THEN 'TIFF' ELSE 'tif' END) AS key FROM fx_assets""")
def object_keys(s, d):
    a = view(s, d, "fx_assets").withColumn("f", F.expr("CASE WHEN scene_id % 2 = 0 THEN 'dir.d/up.load.TIFF' ELSE 'plain' END"))
    return a.select("scene_id", "band_role", text.object_key(F.lit(7), "scene_id", F.concat("band_role", F.lit(" x")), "f").alias("key"))


@query("SELECT scene_id, deleted_at + INTERVAL 7 DAY AS purge_at FROM fx_scene_deletions")
def purge_times(s, d):
    return view(s, d, "fx_scene_deletions").select("scene_id", text.purge_time("deleted_at", 7).alias("purge_at"))


@query("SELECT o_orderkey, concat_ws(':', CASE WHEN CAST(o_custkey AS VARCHAR) < 'b' THEN concat(CAST(o_custkey AS VARCHAR), ',b') ELSE concat('b,', CAST(o_custkey AS VARCHAR)) END, '3', CAST(o_orderkey % 8 AS VARCHAR), '2', CASE WHEN o_orderkey % 2 = 0 THEN '4' ELSE '1' END, coalesce(o_orderpriority, ''), 'png') AS key FROM orders")
def tile_keys(s, d):
    o = view(s, d, "orders").withColumn("band", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 4 END"))
    return o.select("o_orderkey", text.tile_key(F.array(F.lit("b"), F.col("o_custkey").cast("string")), F.lit(3), F.col("o_orderkey") % 8, F.lit(2), "band", "o_orderpriority").alias("key"))


@query("SELECT scene_id, band_index, CASE format WHEN 'cog' THEN 'image/tiff; application=geotiff; profile=cloud-optimized' ELSE 'application/vnd+zarr' END AS media FROM fx_assets")
def media_types(s, d):
    return view(s, d, "fx_assets").select("scene_id", "band_index", text.media_type("format").alias("media"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE CAST(epoch(date_trunc('second', ts)) AS DOUBLE) END AS seconds FROM events")
def epoch_seconds(s, d):
    e = view(s, d, "events").withColumn("t", F.when(F.col("event_id") % 10 == 0, "junk").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))))
    return e.select("event_id", text.epoch_seconds("t").alias("seconds"))


@query("""WITH u AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN replace(url, 'http://', 's3://') WHEN 1 THEN concat(url, '.tif') WHEN 2 THEN concat(replace(url, 'http://', 'https://'), '.h5') ELSE 'ftp://x' END AS u FROM pages)
  SELECT page_id, CASE WHEN u LIKE 's3://%' THEN 's3' WHEN u LIKE 'https://%' THEN 'https' END AS scheme, CASE WHEN u LIKE 's3://%' OR u LIKE 'https://%' THEN regexp_extract(u, '://([^/]*)', 1) END AS bucket,
  CASE WHEN u LIKE 's3://%' OR u LIKE 'https://%' THEN regexp_extract(u, '://[^/]*/(.*)$', 1) END AS key, CASE WHEN u LIKE 's3://%' OR u LIKE 'https://%' THEN CASE WHEN u LIKE '%.tif' THEN 'cog' WHEN u LIKE '%.h5' THEN 'hdf5' ELSE 'unknown' END END AS ref_format,
  CASE WHEN u LIKE 's3://%' OR u LIKE 'https://%' THEN NULL WHEN u LIKE 'http://%' THEN 'http is not permitted' ELSE 'unknown scheme' END AS error FROM u""")
def storage_uris(s, d):
    u = F.expr("CASE page_id % 4 WHEN 0 THEN replace(url, 'http://', 's3://') WHEN 1 THEN concat(url, '.tif') WHEN 2 THEN concat(replace(url, 'http://', 'https://'), '.h5') ELSE 'ftp://x' END")
    return view(s, d, "pages").select("page_id", text.storage_uri(u).alias("u")).select("page_id", "u.*")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN NULL WHEN 2 THEN ts ELSE NULL END AS since, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts ELSE NULL END AS until, CASE WHEN event_id % 4 = 3 THEN 'unreadable datetime: yesterday' END AS error FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def datetime_intervals(s, d):
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = view(s, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, t).when(F.col("event_id") % 4 == 1, F.concat(F.lit("../"), t)).when(F.col("event_id") % 4 == 2, F.concat(t, F.lit("/.."))).otherwise("yesterday").alias("t"))
    i = e.withColumn("i", text.interval("t"))
    return i.select("event_id", F.col("i.start").cast("timestamp_ntz").alias("since"), F.col("i.end").cast("timestamp_ntz").alias("until"), F.col("i.error").alias("error"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE CAST(s_suppkey AS DOUBLE) END AS x0, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 2.0 END AS y0, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE CAST(s_suppkey + 5 AS DOUBLE) END AS x1, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 4.0 END AS y1 FROM supplier")
def request_boxes(s, d):
    k = F.col("s_suppkey")
    b = F.when(k % 3 == 0, F.array(k, F.lit(2), k + 5, F.lit(4))).when(k % 3 == 1, F.array(k, F.lit(2), F.lit(-9), k + 5, F.lit(4), F.lit(9))).otherwise(F.array(k))
    return view(s, d, "supplier").select("s_suppkey", text.request_bbox(b).alias("b")).select("s_suppkey", *[F.col(f"b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 15.5 WHEN 1 THEN 20.0 WHEN 2 THEN 30.0 WHEN 3 THEN 40.0 END AS ceiling FROM supplier")
def cloud_ceilings(s, d):
    q = F.expr("""CASE s_suppkey % 5 WHEN 0 THEN '{"eo:cloud_cover": {"lte": 15.5}}' WHEN 1 THEN '{"eo:cloud_cover": {"<=": 20}}' ELSE '{}' END""")
    c = F.expr("""CASE s_suppkey % 5 WHEN 0 THEN '{"op": "<=", "args": [{"property": "eo:cloud_cover"}, 99]}' WHEN 2 THEN '{"op": "<=", "args": [{"property": "eo:cloud_cover"}, 30]}'
      WHEN 3 THEN '{"op": "and", "args": [{"op": "=", "args": [{"property": "id"}, 1]}, {"op": "lte", "args": [{"property": "eo:cloud_cover"}, 40]}]}' END""")
    return view(s, d, "supplier").select("s_suppkey", text.cloud_ceiling_column(q, c).alias("ceiling"))


@query("SELECT point_id, CASE WHEN point_id % 3 < 2 THEN round(lon, 4) END AS lon, CASE WHEN point_id % 3 < 2 THEN round(lat, 4) END AS lat FROM fx_points")
def point_texts(s, d):
    lon, lat = F.format_string("%.4f", F.col("lon").cast("double")), F.format_string("%.4f", F.col("lat").cast("double"))
    t = F.when(F.col("point_id") % 3 == 0, F.concat(lon, F.lit(","), lat)).when(F.col("point_id") % 3 == 1, F.concat(F.lit("POINT("), lon, F.lit(" "), lat, F.lit(")"))).otherwise("nowhere")
    return view(s, d, "fx_points").select("point_id", text.point(t).alias("p")).select("point_id", F.round("p.lon", 4).alias("lon"), F.round("p.lat", 4).alias("lat"))


@query("SELECT scene_id, CASE WHEN scene_id % 6 = 0 THEN NULL ELSE 5 END AS n, CASE WHEN scene_id % 6 = 0 THEN NULL ELSE round(minx, 4) END AS minx, CASE WHEN scene_id % 6 = 0 THEN NULL ELSE round(miny, 4) END AS miny, CASE WHEN scene_id % 6 = 0 THEN NULL ELSE round(maxx, 4) END AS maxx, CASE WHEN scene_id % 6 = 0 THEN NULL ELSE round(maxy, 4) END AS maxy FROM fx_footprints")
def wkt_rings(s, d):
    w = F.when(F.col("scene_id") % 6 == 0, F.lit("POINT (1 2)")).otherwise(spatial.rect_wkt("minx", "miny", "maxx", "maxy"))
    f = view(s, d, "fx_footprints").select("scene_id", spatial.wkt_ring(w).alias("ring")).withColumn("b", spatial.ring_bbox("ring"))
    return f.select("scene_id", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("n"), *[F.round(F.col(f"b.{c}"), 4).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


@query("SELECT scene_id FROM fx_footprints WHERE maxx >= 170 AND maxy >= -40 AND miny <= 40 UNION SELECT scene_id FROM fx_footprints WHERE minx <= -170 AND maxy >= -40 AND miny <= 40")
def antimeridian_box(s, d):
    return view(s, d, "fx_footprints").where(spatial.rect_filter("minx", "miny", "maxx", "maxy", (170, -40, -170, 40))).select("scene_id")


# a triangle W S, W N, E S and a rectangle meet where the rectangle's lower left corner, clamped to the box, lies under the slope
TRIANGLE = "greatest(minx, 0) <= least(maxx, 60) AND greatest(miny, -30) <= least(maxy, 30) AND (greatest(minx, 0) - minx) / (maxx - minx) + (greatest(miny, -30) - miny) / (maxy - miny) <= 1"


@query(f"SELECT scene_id FROM fx_footprints WHERE {TRIANGLE}")
def polygon_box(s, d):
    ring = F.array(*[F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in (("minx", "miny"), ("minx", "maxy"), ("maxx", "miny"), ("minx", "miny"))])
    box = [F.lit(v) for v in (0.0, -30.0, 60.0, 30.0)]
    f = view(s, d, "fx_footprints").where(spatial.rect_filter("minx", "miny", "maxx", "maxy", (0, -30, 60, 30)))
    return f.withColumn("ring", ring).where(spatial.ring_meets_rect("ring", *box)).select("scene_id")


@query("""SELECT z, x, y, round(x * 2 * 20037508.342789244e0 / 8 - 20037508.342789244e0, 3) AS minx, round(20037508.342789244e0 - y * 2 * 20037508.342789244e0 / 8, 3) AS maxy, round(x * 2 * 20037508.342789244e0 / 8 - 20037508.342789244e0 + 10.5 * 2 * 20037508.342789244e0 / 8 / 256, 3) AS cx,
  round(x * 360.0 / 8 - 180, 6) AS west, round(degrees(2 * atan(exp(pi() * (1 - 2 * y / 8.0))) - pi() / 2), 6) AS north FROM fx_tiles""")
def tile_grid(s, d):
    t = view(s, d, "fx_tiles").withColumn("b", spatial.tile_bounds("z", "x", "y")).withColumn("l", spatial.tile_lonlat("z", "x", "y"))
    return t.select("z", "x", "y", F.round("b.minx", 3).alias("minx"), F.round("b.maxy", 3).alias("maxy"), F.round(spatial.pixel_centre("b", F.lit(10), F.lit(3))["x"], 3).alias("cx"), F.round("l.minx", 6).alias("west"), F.round("l.maxy", 6).alias("north"))


GT = "ox:double,pw:double,rr:double,oy:double,cr:double,ph:double"


@query("""SELECT point_id, round(10 + 2 * c + 0.5 * r, 4) AS wx, round(50 + 0.25 * c - 3 * r, 4) AS wy, round(c, 4) AS c, round(r, 4) AS r FROM (SELECT point_id, lon AS c, lat AS r FROM fx_points)""")
def affine(s, d):
    gt = F.struct(*[F.lit(v).alias(n) for n, v in zip(("ox", "pw", "rr", "oy", "cr", "ph"), (10.0, 2.0, 0.5, 50.0, 0.25, -3.0), strict=True)])
    p = view(s, d, "fx_points").withColumn("gt", gt).withColumn("w", spatial.pixel_to_world("gt", F.col("lon").cast("double"), F.col("lat").cast("double")))
    b = p.withColumn("p", spatial.world_to_pixel("gt", F.col("w.x"), F.col("w.y")))
    return b.select("point_id", F.round("w.x", 4).alias("wx"), F.round("w.y", 4).alias("wy"), F.round("p.col", 4).alias("c"), F.round("p.row", 4).alias("r"))


@query("""WITH p AS (SELECT point_id, lon, least(greatest(CAST(lat AS DOUBLE), -85.0511287798066), 85.0511287798066) AS lat FROM fx_points)
  SELECT point_id, round(radians(lon) * 6378137, 2) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 2) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM p""")
def web_mercator(s, d):
    """Latitudes beyond the square of the map lie on its edge."""
    p = view(s, d, "fx_points").withColumn("m", spatial.lonlat_to_mercator("lon", "lat")).withColumn("b", spatial.mercator_to_lonlat(F.col("m.x"), F.col("m.y")))
    return p.select("point_id", F.round("m.x", 2).alias("x"), F.round("m.y", 2).alias("y"), F.round("b.x", 6).alias("lon"), F.round("b.y", 6).alias("lat"))


def _utm_sql() -> str:
    """Forward projection to the point's own zone, in SQL."""
    sums = {n: " + ".join(f"({c!r}) * {a}({2 * j} * xi) * {b}({2 * j} * eta)" for j, c in enumerate(crs._ALPHA, 1)) for n, a, b in (("x", "cos", "sinh"), ("y", "sin", "cosh"))}
    return f"""WITH p AS (SELECT point_id, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat FROM fx_points), z AS (SELECT *, least(CAST(floor((lon + 180) / 6) AS INT) + 1, 60) AS zone FROM p),
  s AS (SELECT *, radians(lon - (zone * 6 - 183)) AS d, greatest(least(sin(radians(lat)), 0.99999999), -0.99999999) AS sine FROM z),
  t AS (SELECT *, sinh(atanh(sine) - {crs._E!r} * atanh({crs._E!r} * sine)) AS t FROM s), e AS (SELECT *, atan2(t, cos(d)) AS xi, asinh(sin(d) / sqrt(t * t + cos(d) * cos(d))) AS eta FROM t)
  SELECT point_id, concat('EPSG:32', CASE WHEN lat < 0 THEN '7' ELSE '6' END, lpad(CAST(zone AS VARCHAR), 2, '0')) AS system, round((eta + {sums["x"]}) * {crs._R!r} + 500000, 3) AS x,
    round((xi + {sums["y"]}) * {crs._R!r} + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS y, round(lon, 7) AS lon, round(lat, 7) AS lat FROM e WHERE abs(lat) < 89.99
  UNION ALL SELECT point_id, NULL, NULL, NULL, NULL, round(lat, 7) FROM p WHERE abs(lat) >= 89.99"""


@query(_utm_sql())
def utm_coordinates(s, d):
    """Every point in its own UTM zone and back; at the poles, where longitudes have no meaning, the latitude alone."""
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    zone = F.least(F.floor((lon + 180) / 6).cast("int") + 1, F.lit(60))
    code = F.concat(F.when(lat < 0, "EPSG:327").otherwise("EPSG:326"), F.lpad(zone.cast("string"), 2, "0"))
    p = view(s, d, "fx_points").select("point_id", lat.alias("given"), code.alias("system"), crs.utm_forward(lon, lat, code).alias("m"))
    p = p.withColumn("b", crs.utm_inverse("m.x", "m.y", "system"))
    known = lambda c, n: F.when(F.abs("given") < 89.99, F.round(c, n))
    return p.select("point_id", F.when(F.abs("given") < 89.99, F.col("system")).alias("system"), known("m.x", 3).alias("x"), known("m.y", 3).alias("y"), known("b.x", 7).alias("lon"), F.round("b.y", 7).alias("lat"))


SYSTEMS = ["EPSG:32633", "EPSG:32733", "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96", "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=40 +lon_0=-97", "+proj=laea +lat_0=52 +lon_0=10", "+proj=eqdc +lat_1=20 +lat_2=60 +lat_0=40 +lon_0=-96", "+proj=sinu +lon_0=0", "+proj=merc +lat_ts=20 +lon_0=10"]


@query("SELECT point_id, round(CAST(l AS DOUBLE), 6) AS lon, round(CAST(a AS DOUBLE), 6) AS lat FROM (SELECT point_id, CASE point_id % 8 WHEN 0 THEN 15 WHEN 1 THEN 15 WHEN 2 THEN -96 WHEN 3 THEN -97 WHEN 4 THEN 10 WHEN 5 THEN -96 WHEN 6 THEN 0 ELSE 10 END + lon / 100 AS l, CASE WHEN point_id % 8 = 1 THEN -40 ELSE 40 END + lat / 10 AS a FROM fx_points)")
def projected_round_trip(s, d):
    base = "CASE point_id % 8 WHEN 0 THEN 15 WHEN 1 THEN 15 WHEN 2 THEN -96 WHEN 3 THEN -97 WHEN 4 THEN 10 WHEN 5 THEN -96 WHEN 6 THEN 0 ELSE 10 END + lon / 100"
    p = view(s, d, "fx_points").withColumn("l", F.expr(base)).withColumn("a", F.expr("CASE WHEN point_id % 8 = 1 THEN -40 ELSE 40 END + lat / 10")).withColumn("crs", F.get(F.array(*map(F.lit, SYSTEMS)), (F.col("point_id") % 8).cast("int")))
    out = p.withColumn("m", crs.reproject("EPSG:4326", "crs", "l", "a")).withColumn("b", crs.reproject("crs", "EPSG:4326", F.col("m.x"), F.col("m.y")))
    return out.select("point_id", F.round("b.x", 6).alias("lon"), F.round("b.y", 6).alias("lat"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'EPSG:32633' WHEN 1 THEN concat('+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23.0 +lon_0=-96.0 +x_0=0.0 +y_0=', CAST(CAST(s_suppkey AS DOUBLE) AS VARCHAR), ' +ellps=WGS84 +units=m +no_defs') WHEN 2 THEN 'EPSG:4269' END AS crs FROM supplier""")
def crs_definitions(s, d):
    from tesserae.sources.geotiff import KEYS

    k = F.col("s_suppkey")
    values = {
        "projected": F.when(k % 4 == 0, 32633).when(k % 4 == 1, 32767), "geographic": F.when(k % 4 == 2, 4269), "method": F.when(k % 4 == 1, 11).when(k % 4 == 3, 99), "lat1": F.lit(29.5), "lat2": F.lit(45.5), "false_lat": F.lit(23.0), "false_lon": F.lit(-96.0), "northing": k.cast("double"),
    }
    fields = [f.strip().split(" ") for f in KEYS.split(",")]
    keys = F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])
    return view(s, d, "supplier").select("s_suppkey", crs.crs_text(keys).alias("crs"))


@query("""WITH p AS (SELECT point_id, CAST(lon AS DOUBLE) AS x, CAST(lat AS DOUBLE) AS y FROM fx_points), c AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS i FROM p WHERE x + 2 <= 180 AND y + 1 <= 90)
  SELECT point_id, i, x + CASE WHEN i IN (1, 2) THEN 2 ELSE 0 END AS x, y + CASE WHEN i IN (2, 3) THEN 1 ELSE 0 END AS y FROM c UNION ALL SELECT point_id, NULL, NULL, NULL FROM p WHERE x + 2 > 180 OR y + 1 > 90""")
def footprint_rings(s, d):
    at = lambda dx, dy: F.struct((F.col("lon") + dx).cast("double").alias("x"), (F.col("lat") + dy).cast("double").alias("y"))
    r = crs.footprint_ring(F.array(at(0, 0), at(2, 0), at(2, 1), at(0, 1)))
    return view(s, d, "fx_points").select("point_id", F.posexplode_outer(r).alias("i", "p")).select("point_id", "i", "p.x", "p.y")


@query("""SELECT point_id, c0, r0, c1, r1 FROM (SELECT point_id, CAST(least(greatest(floor(lon), 0), 100) AS INT) AS c0, CAST(least(greatest(floor(lat), 0), 50) AS INT) AS r0, CAST(least(greatest(ceil(lon + 20.5) + 1, 0), 100) AS INT) AS c1, CAST(least(greatest(ceil(lat + 10.5) + 1, 0), 50) AS INT) AS r1 FROM (SELECT point_id, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat FROM fx_points)) WHERE c0 < c1 AND r0 < r1""")
def source_windows(s, d):
    at = lambda dx, dy: F.struct((F.col("lon") + dx).cast("double").alias("col"), (F.col("lat") + dy).cast("double").alias("row"))
    w = spatial.source_window(F.array(at(0, 0), at(20.5, 10.5)), F.lit(100), F.lit(50))
    return view(s, d, "fx_points").select("point_id", w.alias("w")).where("w IS NOT NULL").select("point_id", "w.*")


@query("""WITH p AS (SELECT vec_id, embedding AS e, (vec_id % 70) / 10.0 AS c, (vec_id % 63) / 9.0 AS r FROM embeddings), q AS (SELECT *, CAST(floor(least(c, 7)) AS INT) AS c0, CAST(floor(least(r, 7)) AS INT) AS r0 FROM p), k AS (SELECT *, least(c0 + 1, 7) AS c1, least(r0 + 1, 7) AS r1, c - c0 AS fc, r - r0 AS fr FROM q)
  SELECT vec_id, round((CAST(e[r0 * 8 + c0 + 1] AS DOUBLE) * (1 - fc) + CAST(e[r0 * 8 + c1 + 1] AS DOUBLE) * fc) * (1 - fr) + (CAST(e[r1 * 8 + c0 + 1] AS DOUBLE) * (1 - fc) + CAST(e[r1 * 8 + c1 + 1] AS DOUBLE) * fc) * fr, 5) AS v FROM k""")
def bilinear_samples(s, d):
    e = view(s, d, "embeddings")
    v = spatial.bilinear("embedding", F.lit(8), F.lit(8), (F.col("vec_id") % 70) / 10.0, (F.col("vec_id") % 63) / 9.0)
    return e.select("vec_id", F.round(v, 5).alias("v"))


# -- parameters ------------------------------------------------------------------------------------------------------
K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


@query(f"""SELECT event_id AS job_id, 'k' AS name, CASE WHEN {K} < 10 THEN 'must be >= 10.0' ELSE 'must be <= 90.0' END AS message FROM events WHERE {K} < 10 OR {K} > 90 UNION ALL SELECT event_id, 'need', 'missing' FROM events""")
def parameter_violations(s, d):
    from tesserae.operators.models import SPEC_SCHEMA

    specs = s.createDataFrame([("p", "k", "number", True, None, 10.0, 90.0, "input"), ("p", "need", "string", True, None, None, None, "input"), ("p", "soft", "boolean", False, None, None, None, "input"), ("p", "out", "output_json", True, None, None, None, "output")], SPEC_SCHEMA)
    jobs = view(s, d, "events").select(F.col("event_id").alias("job_id"), F.lit("p").alias("process_id"), F.col("props").alias("params_json"))
    return params.violations(jobs, specs)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, '1' AS a, CASE WHEN event_id % 2 = 0 THEN '9' ELSE '2' END AS b FROM events")
def merged_parameters(s, d):
    e = view(s, d, "events").select(
        "event_id", F.create_map(F.lit("a"), F.lit("1"), F.lit("k"), F.lit("0")).alias("defaults"), F.create_map(F.lit("b"), F.lit("2")).alias("stored"),
        F.map_concat(F.from_json("props", "map<string,string>"), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.lit("9"), F.lit("format"), F.lit("png"))).otherwise(F.create_map().cast("map<string,string>"))).alias("query"),
    )
    m = e.select("event_id", params.merged("defaults", "stored", params.overrides("query")).alias("m"))
    return m.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'number' ELSE 'string' END AS kind FROM supplier")
def override_types(s, d):
    v = F.get(F.array(*map(F.lit, ["12", "1.5", "1e3", "red"])), (F.col("s_suppkey") % 4).cast("int"))
    return view(s, d, "supplier").select("s_suppkey", params.override_type(v).alias("kind"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 1 END AS red, CASE WHEN s_suppkey % 3 < 2 THEN 2 END AS nir, CASE WHEN s_suppkey % 3 = 2 THEN 7 END AS swir FROM supplier")
def band_maps(s, d):
    p = F.get(F.array(*map(F.lit, ['{"red_band": 4}', "{}", '{"band_map": {"swir": 7}}'])), (F.col("s_suppkey") % 3).cast("int"))
    f = F.when(F.col("s_suppkey") % 3 < 2, "ndvi").otherwise("own")
    m = view(s, d, "supplier").select("s_suppkey", params.band_map(f, p).alias("m"))
    return m.select("s_suppkey", *[F.col("m")[b].alias(b) for b in ("red", "nir", "swir")])
