"""Queries over pixels: band maths, colour and mosaics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import pixel
from tesserae.operators import mosaic, tiles, zonal
from tesserae.plans.book import query
from tesserae.plans.fixtures import view

EPS = "1.1920929e-07"


def _mosaic(reducer):
    def run(s, d):
        px = view(s, d, "fx_px").withColumn("layer_order", F.col("layer_id"))
        return mosaic.reduce_layers(px, reducer).select("tile_id", "idx", F.round("v", 5).alias("v"))

    return run


for _name, _sql in {"first": "arg_min(v, layer_id) FILTER (WHERE v IS NOT NULL)", "mean": "avg(CAST(v AS DOUBLE))", "max": "max(v)", "min": "min(v)", "sum": "sum(CAST(v AS DOUBLE))"}.items():
    query(f"SELECT tile_id, idx, round({_sql}, 5) AS v FROM fx_px GROUP BY tile_id, idx", f"mosaic_{_name}")(_mosaic(_name))


@query("SELECT tile_id, layer_id, round(min(CAST(v AS DOUBLE)), 6) AS low, round(max(CAST(v AS DOUBLE)), 6) AS high, count(v) AS n FROM fx_px GROUP BY tile_id, layer_id")
def band_range(s, d):
    return mosaic.band_range(view(s, d, "fx_px"), by=("tile_id", "layer_id")).select("tile_id", "layer_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query("""WITH k AS (SELECT tile_id, idx, layer_id % 3 AS band_key, min(v) AS v FROM fx_px GROUP BY 1, 2, 3), w AS (SELECT tile_id FROM k WHERE band_key IN (0, 1) GROUP BY tile_id HAVING count(DISTINCT band_key) = 2)
  SELECT tile_id, idx, round(min(v) FILTER (WHERE band_key = 0), 5) AS b0, round(min(v) FILTER (WHERE band_key = 1), 5) AS b1 FROM k WHERE tile_id IN (SELECT tile_id FROM w) AND band_key IN (0, 1) GROUP BY 1, 2""")
def aligned_bands(s, d):
    k = view(s, d, "fx_px").withColumn("band_key", F.col("layer_id") % 3).groupBy("tile_id", "idx", "band_key").agg(F.min("v").alias("v"))
    return mosaic.aligned(k, [0, 1]).select("tile_id", "idx", F.round("0", 5).alias("b0"), F.round("1", 5).alias("b1"))


@query("SELECT scene_id, CAST(row_number() OVER (PARTITION BY service_id ORDER BY acquired_at DESC NULLS LAST, scene_id) AS INT) AS layer_order FROM fx_footprints")
def layer_order(s, d):
    return view(s, d, "fx_footprints").withColumn("tile_id", F.col("service_id")).select("scene_id", mosaic.layer_order().alias("layer_order"))


NDVI = f"CASE WHEN abs(nir + red) < {EPS} THEN {{}} ELSE round((nir - red) / (nir + red), 6) END"


@query(f"SELECT l_orderkey, l_linenumber, tile_id, red, nir, {NDVI.format('NULL')} AS as_null, {NDVI.format('0.0')} AS as_zero FROM fx_bands")
def ndvi(s, d):
    b = view(s, d, "fx_bands")
    return b.select("l_orderkey", "l_linenumber", "tile_id", "red", "nir", F.round(pixel.ndvi("red", "nir"), 6).alias("as_null"), F.round(pixel.ndvi("red", "nir", "zero"), 6).alias("as_zero"))


@query(f"""SELECT l_orderkey, l_linenumber, tile_id, round(red + nir, 6) AS added, round(red - nir, 6) AS subtracted, round(red * nir, 6) AS multiplied, CASE WHEN abs(nir) >= {EPS} THEN round(red / nir, 6) END AS divided,
  round(sqrt(red), 6) AS root, CASE WHEN nir > 0 THEN round(ln(nir), 6) END AS logged, round(abs(red - 0.05), 6) AS size, round(red * 2.5, 6) AS scaled, CASE WHEN abs(nir + red) >= {EPS} THEN round(sqrt(abs((nir - red) / (nir + red))) * 2 + 1, 6) END AS nested FROM fx_bands""")
def band_maths(s, d):
    ndvi_rule = {"op": "div", "left": {"op": "sub", "left": {"band": 2}, "right": {"band": 1}}, "right": {"op": "add", "left": {"band": 2}, "right": {"band": 1}}}
    nested = {"op": "add", "left": {"op": "mul", "left": {"op": "sqrt", "value": {"op": "abs", "value": ndvi_rule}}, "right": {"literal": 2}}, "right": {"literal": 1}}
    two = lambda op: F.round(pixel.binary(op, "red", "nir", strict=False), 6)
    return view(s, d, "fx_bands").select(
        "l_orderkey", "l_linenumber", "tile_id", two("add").alias("added"), two("sub").alias("subtracted"), two("mul").alias("multiplied"), two("div").alias("divided"), F.round(pixel.unary("sqrt", "red"), 6).alias("root"),
        F.round(pixel.unary("log", "nir"), 6).alias("logged"), F.round(pixel.unary("abs", F.col("red") - 0.05), 6).alias("size"), F.round(pixel.scale("red", 2.5), 6).alias("scaled"),
        F.round(pixel.band_math(nested, {1: "red", 2: "nir"}, strict=False), 6).alias("nested"),
    )


NORM = """SELECT layer_id, idx, v, min(CAST(v AS DOUBLE)) OVER (PARTITION BY layer_id) AS lo, max(CAST(v AS DOUBLE)) OVER (PARTITION BY layer_id) AS hi FROM fx_px"""
UNIT = f"(SELECT layer_id, idx, CASE WHEN v IS NULL THEN NULL WHEN hi - lo < {EPS} THEN 0.0 ELSE (v - lo) / (hi - lo) END AS t FROM ({NORM}))"


@query(f"SELECT layer_id, idx, round(t, 6) AS t FROM {UNIT}")
def normalised(s, d):
    return view(s, d, "fx_px").select("layer_id", "idx", F.round(pixel.normalise("v", ["layer_id"]), 6).alias("t"))


def _rgba(s, d, colour):
    px = view(s, d, "fx_px").select("layer_id", "idx", F.round(pixel.normalise("v", ["layer_id"]), 9).alias("t"))
    return px.withColumn("c", colour(F.col("t"))).select("layer_id", "idx", *[F.col(f"c.{k}").alias(k) for k in "rgba"])


U9 = f"(SELECT layer_id, idx, round(t, 9) AS t FROM {UNIT})"
SHOWN = "CAST(CASE WHEN t IS NULL THEN 0 ELSE {} END AS INT)"


@query(f"SELECT layer_id, idx, {', '.join(SHOWN.format('round(t * 255)') + f' AS {k}' for k in 'rgb')}, {SHOWN.format('255')} AS a FROM {U9}")
def grayscale(s, d):
    return _rgba(s, d, pixel.grayscale)


def ramp_cases(stops) -> list[str]:
    """Red, green and blue of t."""
    part = lambda i, k: f"WHEN t <= {0.25 * (i + 1)} THEN round({stops[i][k]} + ({stops[i + 1][k] - stops[i][k]}) * (t - {0.25 * i}) / 0.25)"
    return [f"CASE {' '.join(part(i, k) for i in range(4))} END" for k in range(3)]


def ramp_sql(stops):
    shown = [f"{SHOWN.format(c)} AS {k}" for k, c in zip("rgb", ramp_cases(stops), strict=True)]
    return f"SELECT layer_id, idx, {', '.join(shown)}, {SHOWN.format('255')} AS a FROM {U9}"


for _name, _stops in pixel.RAMPS.items():
    query(ramp_sql(_stops), f"pseudocolor_{_name}")(lambda s, d, n=_name: _rgba(s, d, lambda t: pixel.pseudocolor(t, n)))

LUT = [(0, 0, 0, 255), (10, 20, 30, 200), (255, 128, 0, 100)]


@query(f"""WITH l AS (SELECT i, CAST(floor(i * 2 / 255.0 + 0.5) AS INT) AS e FROM range(256) AS r(i)) SELECT p.layer_id, p.idx, CASE WHEN t IS NULL THEN 0 ELSE [0, 10, 255][e + 1] END AS r, CASE WHEN t IS NULL THEN 0 ELSE [0, 20, 128][e + 1] END AS g,
  CASE WHEN t IS NULL THEN 0 ELSE [0, 30, 0][e + 1] END AS b, CASE WHEN t IS NULL THEN 0 ELSE [255, 200, 100][e + 1] END AS a FROM {U9} p LEFT JOIN l ON l.i = round(p.t * 255)""")
def user_lut(s, d):
    return _rgba(s, d, lambda t: pixel.lut(t, LUT))


@query("""SELECT s_suppkey, CASE s_suppkey % 9 WHEN 0 THEN 'viridis' WHEN 1 THEN 'plasma' WHEN 2 THEN 'viridis' WHEN 3 THEN 'turbo' WHEN 4 THEN 'lut' WHEN 6 THEN 'viridis' ELSE 'grayscale' END AS name FROM supplier""")
def colormap_names(s, d):
    specs = ["viridis", "PLASMA", "pseudocolor", '{"colormap": "pseudocolor", "ramp": "turbo"}', '{"colormap": "lut", "entries": [[0, 0, 0, 255], [9, 9, 9, 255]]}', '{"colormap": "lut", "entries": [[0, 0, 0, 255]]}', '{"colormap": "pseudocolor"}', "nonsense", '{"colormap": "other"}']
    c = F.get(F.array(*map(F.lit, specs)), (F.col("s_suppkey") % 9).cast("int"))
    return view(s, d, "supplier").select("s_suppkey", pixel.colormap_name(c).alias("name"))


@query(f"""WITH c AS (SELECT tile_id, idx, arg_min(v, layer_id) FILTER (WHERE v IS NOT NULL AND layer_id % 2 = 0) AS r0, arg_min(v, layer_id) FILTER (WHERE v IS NOT NULL AND layer_id % 2 = 1) AS g0 FROM fx_px GROUP BY 1, 2),
  n AS (SELECT *, min(CAST(r0 AS DOUBLE)) OVER w AS rl, max(CAST(r0 AS DOUBLE)) OVER w AS rh, min(CAST(g0 AS DOUBLE)) OVER w AS gl, max(CAST(g0 AS DOUBLE)) OVER w AS gh FROM c WINDOW w AS (PARTITION BY tile_id))
  SELECT tile_id, idx, CAST(coalesce(CASE WHEN rh - rl < {EPS} THEN 0 ELSE round((r0 - rl) / (rh - rl) * 255) END, 0) AS INT) AS r, CAST(coalesce(CASE WHEN gh - gl < {EPS} THEN 0 ELSE round((g0 - gl) / (gh - gl) * 255) END, 0) AS INT) AS g, 0 AS b, 255 AS a FROM n""")
def rgb_composite(s, d):
    px = view(s, d, "fx_px").groupBy("tile_id", "idx").agg(pixel.first_valid(F.when(F.col("layer_id") % 2 == 0, F.col("v")), "layer_id").alias("r0"), pixel.first_valid(F.when(F.col("layer_id") % 2 == 1, F.col("v")), "layer_id").alias("g0"))
    return px.withColumn("c", pixel.rgb({"r": "r0", "g": "g0"}, ["tile_id"])).select("tile_id", "idx", *[F.col(f"c.{k}").alias(k) for k in "rgba"])


@query(f"""WITH b AS (SELECT tile_id, l_orderkey * 10 + l_linenumber AS idx, min(CASE WHEN abs(nir + red) >= {EPS} THEN (nir - red) / (nir + red) END) AS v FROM fx_bands GROUP BY 1, 2),
  n AS (SELECT *, min(v) OVER (PARTITION BY tile_id) AS lo, max(v) OVER (PARTITION BY tile_id) AS hi FROM b) SELECT tile_id, idx, CAST(CASE WHEN v IS NULL THEN 0 WHEN hi - lo < {EPS} THEN 0 ELSE round(round((v - lo) / (hi - lo), 9) * 255) END AS INT) AS g, CASE WHEN v IS NULL THEN 0 ELSE 255 END AS a FROM n""")
def rule_tile(s, d):
    b = view(s, d, "fx_bands").withColumn("v", pixel.ndvi("red", "nir")).groupBy("tile_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx")).agg(F.min("v").alias("v"))
    wide = b.withColumn("t", F.round(pixel.normalise("v", ["tile_id"]), 9))
    return wide.withColumn("c", pixel.grayscale("t")).select("tile_id", "idx", F.col("c.g").alias("g"), F.col("c.a").alias("a"))


@query(f"""WITH m AS (SELECT tile_id AS x, idx, avg(CAST(v AS DOUBLE)) AS v FROM fx_px WHERE layer_id % 4 = 1 GROUP BY 1, 2), n AS (SELECT *, min(v) OVER (PARTITION BY x) AS lo, max(v) OVER (PARTITION BY x) AS hi FROM m),
  u AS (SELECT x, idx, CASE WHEN v IS NULL THEN NULL WHEN hi - lo < {EPS} THEN 0.0 ELSE (v - lo) / (hi - lo) END AS t FROM n)
  SELECT 3 AS z, x, 0 AS y, idx, {", ".join(SHOWN.format(c) + f" AS {k}" for k, c in zip("rgb", ramp_cases(pixel.RAMPS["viridis"]), strict=True))}, {SHOWN.format("255")} AS a FROM u""")
def mosaic_tile(s, d):
    layers = view(s, d, "fx_px").select(F.lit(3).alias("z"), F.col("tile_id").alias("x"), F.lit(0).alias("y"), "idx", F.col("layer_id").alias("layer_order"), "v", (F.col("layer_id") % 4).alias("service_id"))
    return tiles.mosaic_tile(layers, "mean", "viridis", {"service_id": 1})


STATS = "count(v) AS count, coalesce(round(sum(v), 4), 0) AS sum, coalesce(round(avg(v), 4), 0) AS mean, round(min(v), 4) AS min, round(max(v), 4) AS max"


def _rounded(df, *keys):
    return df.select(*keys, "count", *[F.round(c, 4).alias(c) for c in ("sum", "mean", "min", "max")])


@query(f"SELECT label AS tile_id, {STATS} FROM (SELECT tile_id AS label, CAST(v AS DOUBLE) AS v FROM fx_px) GROUP BY label")
def zonal_statistics(s, d):
    return _rounded(zonal.overall(view(s, d, "fx_px"), "v", ["tile_id"]), "tile_id")


@query(f"SELECT z.zone_id, {STATS} FROM fx_zones z LEFT JOIN (SELECT lon, lat, value AS v FROM fx_points) p ON p.lon >= z.minx AND p.lon < z.maxx AND p.lat >= z.miny AND p.lat < z.maxy GROUP BY z.zone_id")
def zone_statistics(s, d):
    return _rounded(zonal.by_zone(view(s, d, "fx_points"), view(s, d, "fx_zones")), "zone_id")


@query("""WITH z AS (SELECT zone_id, minx + 36 AS cx, miny + 18 AS cy FROM fx_zones), p AS (SELECT CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat, CAST(value AS DOUBLE) AS value FROM fx_points)
  SELECT zone_id, count(value) AS n, round(coalesce(sum(value), 0), 4) AS total, min(value) AS low, max(value) AS high FROM z LEFT JOIN p ON abs(lon - cx) * 17.993 + abs(lat - cy) * 35.987 < 35.987 * 17.993 GROUP BY zone_id""")
def polygon_statistics(s, d):
    """Zones as rings of four corners."""
    z = view(s, d, "fx_zones").select("zone_id", (F.col("minx") + 36).cast("double").alias("x"), (F.col("miny") + 18).cast("double").alias("y"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    ring = F.array(*[corner(dx, dy) for dx, dy in ((-35.987, 0), (0, 17.993), (35.987, 0), (0, -17.993), (-35.987, 0))])
    got = zonal.by_zone(view(s, d, "fx_points"), z.select("zone_id", ring.alias("ring")))
    return got.select("zone_id", F.col("count").alias("n"), F.round("sum", 4).alias("total"), F.col("min").alias("low"), F.col("max").alias("high"))



@query("SELECT vec_id, len(embedding) AS count, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS mean FROM embeddings")
def mean_values(s, d):
    return zonal.means(view(s, d, "embeddings").withColumnRenamed("embedding", "values")).select("vec_id", F.col("count").cast("long").alias("count"), F.round("mean", 6).alias("mean"))


@query("""WITH n AS (SELECT tile_id AS asset_id, idx, layer_id, v, row_number() OVER (PARTITION BY tile_id ORDER BY layer_id, idx) - 1 AS pos, greatest(1, count(*) OVER (PARTITION BY tile_id) // 100) AS step FROM fx_px WHERE v IS NOT NULL)
  SELECT asset_id, layer_id AS row, idx AS col, round(v, 5) AS v FROM n WHERE pos % step = 0 AND pos // step < 100""")
def band_samples(s, d):
    px = view(s, d, "fx_px").select(F.col("tile_id").alias("asset_id"), F.lit(1).alias("band"), F.col("layer_id").alias("row"), F.col("idx").alias("col"), "v")
    return zonal.band_samples(px, 1, 100).select("asset_id", "row", "col", F.round("v", 5).alias("v"))
