"""Literal expectations of the scalar functions."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import crs, pixel, spatial, text
from tesserae.operators import models, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_slugs(spark):
    assert one(spark, text.slugify(F.lit("My NDVI_Service!"))) == "my-ndvi-service"
    assert one(spark, text.slugify(F.lit("--é--"))) == "service"


@pytest.mark.parametrize(("uri", "error", "fmt"), [("s3://external-bucket/path/to/scene.tif", None, "cog"), ("https://data.example.org/a.nc", None, "netcdf"), ("http://x/y.tif", "http is not permitted", None), ("s3://bucket-only", "bucket without key", None), ("", "empty", None), ("s3://b/a\x01b", "control characters", None), ("ftp://x", "unknown scheme", None)])
def test_storage_uris(spark, uri, error, fmt):
    u = one(spark, text.storage_uri(F.lit(uri)))
    assert (u.error, u.ref_format) == (error, fmt)


def test_split_uri_and_month(spark):
    assert tuple(one(spark, text.split_uri(F.lit("s3://b/k/x.tif"), "d"))) == ("b", "k/x.tif")
    assert tuple(one(spark, text.split_uri(F.lit("/k/x.tif"), "d"))) == ("d", "k/x.tif")
    assert one(spark, text.month_key(F.lit("2024-07-15").cast("timestamp"))) == "2024-07"


def test_search_requests():
    r = search.search_request({"bbox": [1, 2, 3, 4, 5, 6], "datetime": "2024-01-01T00:00:00Z/..", "query": {"eo:cloud_cover": {"lte": 15.5}}, "limit": 5})
    assert r["bbox"] == (1, 2, 4, 5) and r["since"] == datetime(2024, 1, 1) and r["until"] is None and r["cloud_max"] == 15.5
    assert search.search_request({"bbox": [1, 2]})["bbox"] is None
    f = {"op": "and", "args": [{"op": "<=", "args": [{"property": "eo:cloud_cover"}, 20]}]}
    assert search.search_request({"filter": f})["cloud_max"] == 20
    with pytest.raises(ValueError, match="unsupported"):
        search.search_request({"filter": {"op": "or", "args": []}})
    with pytest.raises(ValueError):
        search.search_request({"datetime": "yesterday"})
    assert search.effective_limit(None) == 10 and search.effective_limit(99_999) == 10_000


def test_wkt(spark):
    ring = spatial.wkt_ring(F.lit("POLYGON ((-10 -5, -10 5, 10 5, 10 -5, -10 -5))"))
    assert tuple(one(spark, spatial.ring_bbox(ring))) == (-10, -5, 10, 5) and len(one(spark, ring)) == 5
    assert one(spark, spatial.wkt_ring(F.lit("POINT (1 2)"))) is None and one(spark, spatial.wkt_ring(F.lit("POLYGON ((1 x, 2 3))"))) is None
    assert one(spark, spatial.ring_geojson(ring)).startswith('{"type":"Polygon","coordinates":[[[-10.0,-5.0]')
    assert one(spark, spatial.rect_wkt(F.lit(2.0), F.lit(4.0), F.lit(1.0), F.lit(3.0))) == "POLYGON ((1.0 3.0, 1.0 4.0, 2.0 4.0, 2.0 3.0, 1.0 3.0))"


def test_band_maths(spark):
    rule = {"op": "div", "left": {"op": "sub", "left": {"band": 2}, "right": {"band": 1}}, "right": {"op": "add", "left": {"band": 2}, "right": {"band": 1}}}
    df = spark.createDataFrame([(0.2, 0.6), (0.0, 0.0), (float("nan"), 1.0)], "b1 double, b2 double")
    got = [r[0] for r in df.select(pixel.band_math(rule, {1: "b1", 2: "b2"}, strict=False)).collect()]
    assert got[0] == pytest.approx(0.5) and got[1] is None and got[2] is None
    with pytest.raises(Exception, match="division by zero"):
        df.select(pixel.band_math(rule, {1: "b1", 2: "b2"})).collect()
    for bad in ({"band": 0}, {"band": 9}, {"literal": math.inf}, {"op": "pow"}, {"op": "add", "left": {"op": "colormap", "value": {"band": 1}}, "right": {"band": 1}}):
        with pytest.raises(ValueError):
            pixel.band_math(bad, {1: "b1"})
    assert pixel.band_refs(rule) == [2, 1]
    deep = {"band": 1}
    for _ in range(30):
        deep = {"op": "div", "left": deep, "right": {"op": "add", "left": deep and {"band": 2}, "right": {"literal": 1}}}
    assert df.select(pixel.band_math(deep, {1: "b1", 2: "b2"}, strict=False)).count() == 3


def test_colours(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (0.5,)], "t double")
    grey = [tuple(r[0]) for r in df.select(pixel.grayscale("t")).collect()]
    assert grey == [(0, 0, 0, 255), (255, 255, 255, 255), (0, 0, 0, 0), (128, 128, 128, 255)]
    ends = [tuple(r[0]) for r in df.select(pixel.pseudocolor("t", "turbo")).collect()]
    assert ends[0] == (48, 18, 59, 255) and ends[1] == (122, 4, 3, 255) and ends[2] == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        pixel.full_lut([(0, 0, 0, 0)])
    px = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 10.0, 20.0, 0.0)], "tile int, idx int, r double, g double, b double")
    assert [tuple(r[0]) for r in px.select(pixel.rgb({"r": "r", "g": "g", "b": "b"}, ["tile"])).collect()] == [(0, 0, 0, 255), (255, 255, 0, 255)]


def test_bilinear(spark):
    p = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)])
    assert one(spark, spatial.bilinear(p, F.lit(2), F.lit(2), F.lit(0.0), F.lit(0.0))) == 1
    assert one(spark, spatial.bilinear(p, F.lit(2), F.lit(2), F.lit(1.0), F.lit(1.0))) == 4
    assert one(spark, spatial.bilinear(p, F.lit(2), F.lit(2), F.lit(0.5), F.lit(0.5))) == 2.5


SYSTEMS = {
    "EPSG:3857": ((-170, 170), (-80, 80)), "EPSG:32633": ((12, 18), (-10, 80)), "EPSG:32733": ((12, 18), (-80, 0)), "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96": ((-125, -65), (24, 50)),
    "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=40 +lon_0=-97": ((-120, -70), (20, 60)), "+proj=lcc +lat_1=46.5 +lat_0=46.5 +lon_0=3 +k_0=0.99988": ((-5, 10), (40, 52)), "+proj=eqdc +lat_1=20 +lat_2=60 +lat_0=40 +lon_0=-96": ((-120, -70), (10, 70)),
    "+proj=laea +lat_0=52 +lon_0=10": ((-20, 40), (35, 70)), "+proj=laea +lat_0=90 +lon_0=0": ((-170, 170), (40, 89)), "+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45": ((-170, 130), (50, 89)), "+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=0": ((-170, 170), (-89, -50)),
    "+proj=sinu +lon_0=0": ((-170, 170), (-80, 80)), "+proj=merc +lat_ts=20 +lon_0=10": ((-160, 180), (-80, 80)), "+proj=tmerc +lat_0=0 +lon_0=9 +k=1 +x_0=3500000 +y_0=0 +a=6377397.155 +rf=299.1528128": ((6, 12), (45, 55)),
}


@pytest.mark.parametrize("name", SYSTEMS)
def test_projection_round_trip(name):
    r = np.random.default_rng(0)
    lon, lat = (r.uniform(*x, 300) for x in SYSTEMS[name])
    back = crs.transform(name, "EPSG:4326", *crs.transform("EPSG:4326", name, lon, lat))
    assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9


def test_utm_corners_and_unknown_systems():
    x, y = crs.transform("EPSG:32633", "EPSG:4326", np.array([500000.0, 501000.0]), np.array([5000000.0, 4999000.0]))
    assert ((x > 13) & (x < 17)).all() and ((y > 44) & (y < 46)).all()
    with pytest.raises(ValueError):
        crs.projection("EPSG:9999")


def test_tile_models(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.0, 1.0], [0.5, 0.6, 0.0, None])], "x int, red array<double>, nir array<double>")
    v = models.apply_tiles(df, models.Ndvi(), width=2).first().values
    assert v[0] > 0.5 and v[2] is None and v[3] is None
    with pytest.raises(ValueError):
        models.apply_tiles(df.drop("nir"), models.Ndvi(), width=2)


def test_utm_zones_equal_the_general_projection(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tesserae.functions import crs

    r = np.random.default_rng(5)
    rows = []
    for zone in (1, 17, 33, 60):
        for south in (False, True):
            for _ in range(40):
                lon = zone * 6 - 183 + float(r.uniform(-5, 5))
                rows.append((f"EPSG:32{7 if south else 6}{zone:02d}", lon - 360 if lon > 180 else lon + 360 if lon < -180 else lon, float(r.uniform(-84, 84))))
    df = spark.createDataFrame(rows, "code string, lon double, lat double").withColumn("m", crs.utm_forward("lon", "lat", "code")).withColumn("b", crs.utm_inverse("m.x", "m.y", "code"))
    for x in df.select("*", F.col("m.x").alias("x"), F.col("m.y").alias("y"), F.col("b.x").alias("u"), F.col("b.y").alias("v")).collect():
        a, b = crs.transform("EPSG:4326", x.code, np.array([x.lon]), np.array([x.lat]))
        assert abs(x.x - a[0]) < 1e-5 and abs(x.y - b[0]) < 1e-5
        assert abs((x.u - x.lon + 180) % 360 - 180) < 1e-9 and abs(x.v - x.lat) < 1e-9
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
