"""Range joins, zones, samples, alignment, rules, jobs and purges against plain Python."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import pixel
from tesserae.operators import catalog, models, mosaic, ranges, search, tiles, zonal
from tesserae.sources import geotiff
from tesserae.streaming import feeds
from tests.test_sources import tiff

BOX = "minx double, miny double, maxx double, maxy double"


def boxes(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        size, x, y = r.choice([0, 0.01, 1, 7, 30, 100, 350]), r.uniform(-180, 180), r.uniform(-90, 90)
        x2 = x + size * r.random()
        out.append((i, x, y, x2 - 360 if x2 > 180 else x2, min(90.0, y + size * r.random())))
    return [*out, (n, -180.0, -90.0, 180.0, 90.0), (n + 1, 0.0, 0.0, 0.0, 0.0), (n + 2, 170.0, -10.0, -170.0, 10.0), (n + 3, 1.0, 5.0, 2.0, 4.0)]


def meets(p, q):
    parts = lambda b: [(b[1], b[3])] if b[1] <= b[3] else [(b[1], 180), (-180, b[3])]
    return p[2] <= p[4] and q[2] <= q[4] and p[2] <= q[4] and p[4] >= q[2] and any(i[0] <= j[1] and i[1] >= j[0] for i in parts(p) for j in parts(q))


def test_rect_join_against_brute_force(spark):
    left, right = boxes(1, 120), boxes(2, 120)
    a, b = spark.createDataFrame(left + left[:3], f"a int, {BOX}"), spark.createDataFrame(right, f"b int, {BOX}")
    df = ranges.rect_join(a, b)
    assert sorted((x.a, x.b) for x in df.collect()) == sorted((p[0], q[0]) for p in left + left[:3] for q in right if meets(p, q))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ranges.rect_join(a, b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates_are_a_small_multiple_of_the_pairs(spark):
    """Also where all boxes lie in one place, where sizes differ a thousandfold, and for ten times the rows."""
    r = random.Random(3)

    def table(name, n, sizes, spread):
        rows = []
        for i in range(n):
            x, y, s = r.uniform(-spread, spread), r.uniform(-spread, spread) / 2, r.choice(sizes)
            rows.append((i, x, y, x + s, y + s))
        return spark.createDataFrame(rows, f"{name} int, {BOX}")

    for sizes, spread in (([2.0], 150), ([0.02, 20.0], 100), ([0.001], 0.05)):
        for n in (300, 3000):
            points, boxes_ = table("p", n, [0.0], spread), table("q", n, sizes, spread)
            found, tried = ranges.rect_join(points, boxes_).count(), ranges.candidates(points, boxes_).count()
            assert tried <= 16 * found + 300, (sizes, n, tried, found)
            keys = ranges.candidates(boxes_, boxes_.withColumnRenamed("q", "o")).groupBy("met").count().collect()
            assert sum(k["count"] for k in keys) <= 16 * ranges.rect_join(boxes_, boxes_.withColumnRenamed("q", "o")).count() + 300


def test_polygons_test_only_points_near_their_border(spark):
    r = random.Random(8)
    points = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(4000)] + [(4000, 0.0, 0.0), (4001, None, 1.0)]
    rings = []
    for z in range(12):
        x, y, s = r.uniform(-120, 120), r.uniform(-50, 50), r.choice([3, 30, 60])
        corners = [(x + s * r.uniform(0.6, 1) * np.cos(a), y + s / 2 * r.uniform(0.6, 1) * np.sin(a)) for a in np.linspace(0, 2 * np.pi, r.choice([3, 5, 24]), endpoint=False)]
        rings.append((z, [(float(a), float(b)) for a, b in [*corners, corners[0]]]))

    def holds(ring, x, y):
        return sum((p[1] > y) != (q[1] > y) and x < p[0] + (y - p[1]) * (q[0] - p[0]) / (q[1] - p[1]) for p, q in zip(ring, ring[1:], strict=False)) % 2 == 1

    p = spark.createDataFrame(points, "p int, lon double, lat double")
    z = spark.createDataFrame([*rings, (99, None)], "zone_id int, ring array<struct<x:double,y:double>>")
    want = sorted((i, k) for i, x, y in points if x is not None for k, ring in rings if holds(ring, x, y))
    assert sorted((x.p, x.zone_id) for x in ranges.points_in_polygons(p, z).collect()) == want
    cover = ranges.polygon_cover(z)
    tested = ranges.points_in_polygons(p, z.where("zone_id < 0")).count() + sum(
        1 for c in cover.where("NOT inside").collect() for i, x, y in points if x is not None
        and c.cx == (x + 180) * 2**c.level // 360 and c.cy == (y + 180) * 2**c.level // 360)
    assert len(want) > 300 and tested < 0.75 * len(want)
    stats = zonal.by_zone(p.withColumn("value", F.lit(1.0)), z)
    assert {r.zone_id: r["count"] for r in stats.collect()} == {**{k: sum(w[1] == k for w in want) for k, _ in rings}, 99: 0}


def test_zones_count_repeated_samples(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0, 2.0), (1, 1.0, 1.0, 4.0), (2, 10.0, 1.0, 9.0), (3, 0.0, 0.0, 1.0)], "point_id int, lon double, lat double, value double")
    zones = spark.createDataFrame([(7, 0.0, 0.0, 10.0, 10.0), (8, 10.0, 0.0, 20.0, 10.0), (9, 50.0, 50.0, 60.0, 60.0)], f"zone_id int, {BOX}")
    got = {r.zone_id: (r["count"], r["sum"]) for r in zonal.by_zone(points, zones).collect()}
    assert got == {7: (3, 7.0), 8: (1, 9.0), 9: (0, 0.0)}


@pytest.mark.parametrize("most", [1, 7, 50, 4096])
def test_band_samples_against_brute_force(spark, most):
    r = random.Random(most)
    rows = [(a, 1, y, x, None if r.random() < 0.2 else float(r.randrange(9))) for a in range(3) for y in range(12) for x in range(9) if r.random() < 0.8]
    got = sorted(tuple(x) for x in zonal.band_samples(spark.createDataFrame(rows, "asset_id int, band int, row int, col int, v double"), 1, most, nodata=3.0).collect())
    want = []
    for a in range(3):
        good = sorted(x for x in rows if x[0] == a and x[4] is not None and x[4] != 3.0)
        step = max(1, len(good) // most)
        want += good[::step][:most]
    assert got == sorted(want)


def _rasters(spark, seed=2):
    """Chips of 7 x 5 pixels of four rasters in three systems, some pixels and one chip without data, and their headers."""
    r = np.random.default_rng(seed)
    made, heads, cut = {}, [], []
    places = {"a": ("EPSG:4326", 10.0, 0.7, 50.0, 0.0), "b": ("EPSG:3857", 1_200_000.0, 60_000.0, 6_500_000.0, 0.0), "c": ("EPSG:32633", 200_000.0, 40_000.0, 5_600_000.0, 0.0), "d": ("EPSG:4326", 8.0, 0.6, 48.0, 0.1)}
    for k, (name, x, step, y, turn) in places.items():
        v = r.random((17, 23))
        v[r.random((17, 23)) < 0.05] = np.nan
        made[k] = v
        heads.append((k, 23, 17, 7, 5, (x, step, turn * step, y, turn * step, -step), name))
        for cy in range(4):
            for cx in range(4):
                part = v[cy * 5 : cy * 5 + 5, cx * 7 : cx * 7 + 7]
                if (k, cx, cy) != ("a", 2, 1):
                    cut.append((k, 1, cx, cy, part.shape[1], part.shape[0], part.astype("f4").ravel().tolist()))
        if k == "a":
            made[k][5:10, 14:21] = np.nan
    headers = spark.createDataFrame(heads, "uri string, width long, height long, tile_w int, tile_h int, gt struct<ox:double,pw:double,rr:double,oy:double,cr:double,ph:double>, crs string")
    return made, {h[0]: h for h in heads}, headers, spark.createDataFrame(cut, "asset_id string, band int, chip_x int, chip_y int, w int, h int, pixels array<float>")


def _sampled(v, head, z, x, y, size):
    """One tile of one raster, pixel by pixel."""
    from tesserae.functions import crs

    out = np.full(size * size, np.nan)
    ox, pw, rr, oy, cr, ph = head[5]
    half = 20037508.342789244
    span = 2 * half / 2**z
    for i in range(size * size):
        mx, my = -half + x * span + (i % size + 0.5) * span / size, half - y * span - (i // size + 0.5) * span / size
        u, w = (float(c[0]) for c in crs.transform("EPSG:3857", head[6], np.array([mx]), np.array([my])))
        det = pw * ph - rr * cr
        c, r = (ph * (u - ox) - rr * (w - oy)) / det - 0.5, (pw * (w - oy) - cr * (u - ox)) / det - 0.5
        if -0.5 <= c <= 22.5 and -0.5 <= r <= 16.5:
            c, r = min(max(c, 0), 22), min(max(r, 0), 16)
            c0, r0 = int(c), int(r)
            c1, r1 = min(c0 + 1, 22), min(r0 + 1, 16)
            near = v[[r0, r0, r1, r1], [c0, c1, c0, c1]].astype("f4").astype(float)
            out[i] = (near[0] * (1 - c + c0) + near[1] * (c - c0)) * (1 - r + r0) + (near[2] * (1 - c + c0) + near[3] * (c - c0)) * (r - r0)
    return out


@pytest.mark.parametrize("at_once", [1, 256])
def test_warp_against_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(tiles, "WINDOWS", at_once)
    made, heads, headers, chips = _rasters(spark)
    size, asked = 24, [(5, 16, 10), (5, 17, 10), (5, 17, 11), (4, 8, 5), (6, 34, 21), (2, 0, 0)]
    req = spark.createDataFrame([(*t, k, 1) for t in asked for k in made] + [(5, 17, 10, "a", 1)], "z int, x int, y int, asset_id string, band int")
    got = {}
    for r in tiles.warp(req, headers, chips, size).collect():
        got.setdefault((r.z, r.x, r.y, r.asset_id), {})[r.idx] = np.nan if r.v is None else r.v
    assert len(got) == len(asked) * 4 and all(len(v) == size * size for v in got.values())
    some = 0
    for t in asked:
        for k, v in made.items():
            want = _sampled(v, heads[k], *t, size)
            have = np.array([got[*t, k][i] for i in range(size * size)])
            assert np.allclose(have, want, atol=1e-6, equal_nan=True), (t, k)
            some += np.isfinite(want).sum()
    assert some > 2000


@pytest.mark.parametrize("reducer", ["first", "mean", "max", "min", "sum"])
def test_mosaics_of_blocks_equal_those_of_pixels(spark, reducer):
    _, _, headers, chips = _rasters(spark)
    req = spark.createDataFrame([(*t, k, 1, i) for t in ((4, 8, 5), (5, 17, 11)) for i, k in enumerate("dbac")], "z int, x int, y int, asset_id string, band int, layer_order int")
    blocks = tiles.warp_blocks(req, headers, chips, 16, keep=("layer_order",))
    long = tiles.warp(req, headers, chips, 16).join(req, ["z", "x", "y", "asset_id", "band"])
    want = {(r.x, r.idx): r.v for r in mosaic.reduce_layers(long, reducer, by=("z", "x", "y", "idx")).collect() if r.v is not None}
    arrays = tiles.mosaic_blocks(blocks, 16, reducer, layers=2)
    got = {(r.x, i): v for r in arrays.collect() for i, v in enumerate(r["values"]) if v is not None and v == v}
    assert got.keys() == want.keys() and len(want) > 200 and all(got[k] == pytest.approx(want[k]) for k in want)
    for name in ("turbo", "grayscale"):
        pictures = {r.x: r.png for r in tiles.drawn(arrays, name, 16).collect()}
        coloured = tiles.images(tiles.mosaic_tile(long, reducer, name), 16)
        assert pictures == {r.x: r.png for r in coloured.collect()}


def test_points_at_one_place_are_sampled_once(spark, monkeypatch):
    from tesserae.functions import crs

    made, heads, headers, chips = _rasters(spark)
    r = random.Random(5)
    spots = [(r.uniform(7, 27), r.uniform(36, 51)) for _ in range(60)]
    points = spark.createDataFrame([(40 * k + i, *spot) for k, spot in enumerate(spots) for i in range(30)], "point_id int, lon double, lat double")
    scenes = spark.createDataFrame([(i, k, -20.0, 20.0, 60.0, 70.0) for i, k in enumerate("abcd")], "scene_id int, asset_id string, minx double, miny double, maxx double, maxy double")
    asked, join = [], tiles.ranges.point_scenes
    monkeypatch.setattr(tiles.ranges, "point_scenes", lambda p, f: asked.append(p.count()) or join(p, f))
    got = {(x.point_id, x.scene_id): x.value for x in tiles.point_values(points, scenes, headers, chips).collect()}
    want = {}
    for k, (lon, lat) in enumerate(spots):
        for i, name in enumerate("abcd"):
            ox, pw, rr, oy, cr, ph = heads[name][5]
            u, w = (float(c[0]) for c in crs.transform("EPSG:4326", heads[name][6], np.array([lon]), np.array([lat])))
            det = pw * ph - rr * cr
            c, row = (ph * (u - ox) - rr * (w - oy)) / det - 0.5, (pw * (w - oy) - cr * (u - ox)) / det - 0.5
            if -0.5 <= c <= 22.5 and -0.5 <= row <= 16.5:
                c, row = min(max(c, 0), 22), min(max(row, 0), 16)
                c0, r0 = int(c), int(row)
                near = made[name][np.ix_([r0, min(r0 + 1, 16)], [c0, min(c0 + 1, 22)])].astype("f4").astype(float)
                v = np.array([1 - row + r0, row - r0]) @ near @ np.array([1 - c + c0, c - c0])
                want |= {(40 * k + n, i): None if np.isnan(near).any() else pytest.approx(v, abs=1e-6) for n in range(30)}
    assert asked == [len(spots)]
    assert got == want and sum(v is not None for v in want.values()) > 1000


def test_absent_bands(spark):
    px = spark.createDataFrame([(1, 0, "red", 1.0), (1, 0, "nir", 2.0), (2, 0, "red", 3.0)], "tile_id int, idx int, band_key string, v double")
    assert [tuple(r) for r in mosaic.aligned(px, ["red", "nir"]).collect()] == [(1, 0, 1.0, 2.0)]
    assert [tuple(r) for r in mosaic.aligned(px.where("tile_id = 1"), ["red", "nir"], strict=True).collect()] == [(1, 0, 1.0, 2.0)]
    with pytest.raises(Exception, match="tile 2 lacks one of the bands"):
        mosaic.aligned(px, ["red", "nir"], strict=True).collect()


def test_rules_with_mosaics(spark):
    rows = [(3, 0, 0, i, k, float(i * (k + 1)), k % 2) for i in range(4) for k in range(3)]
    layers = spark.createDataFrame(rows, "z int, x int, y int, idx int, layer_order int, v double, service_id int")
    rule = {"op": "mosaic", "reducer": "sum", "service_filter": {"service_id": 0}}
    for given in (rule, json.dumps(rule)):
        assert sorted((r.idx, r.g) for r in tiles.rule_tile(layers, given, {1: "v"}).collect()) == [(0, 0), (1, 85), (2, 170), (3, 255)]
    with pytest.raises(ValueError, match="object"):
        tiles.rule_tile(layers, {"op": "mosaic", "service_filter": 3}, {1: "v"})
    with pytest.raises(ValueError, match="needs a value"):
        tiles.rule_tile(layers, {"op": "mosaic"}, {1: "v", 2: "v"})
    with pytest.raises(ValueError, match="outermost"):
        pixel.band_math({"op": "abs", "value": rule}, {1: "v"})


def test_mosaics_inside_rules(spark):
    r = random.Random(6)
    rows = [(t, i, k, None if r.random() < 0.3 else r.uniform(1, 9), r.uniform(1, 9), r.randrange(3)) for t in range(2) for i in range(12) for k in range(6)]
    layers = spark.createDataFrame(rows, "tile_id int, idx int, layer_order int, a double, b double, service_id int")
    ratio = {"op": "div", "left": {"band": 1}, "right": {"band": 2}}
    high = {"op": "mosaic", "reducer": "max", "service_filter": {"service_id": 0}, "value": ratio}
    first = {"op": "mosaic", "reducer": "first", "value": {"band": 1}}
    # how far each layer lies above the first, in the mean: a mosaic inside a mosaic
    above = {"op": "mosaic", "reducer": "mean", "service_filter": {"service_id": 1}, "value": {"op": "sub", "left": {"band": 1}, "right": first}}
    rule = {"op": "add", "left": {"op": "mul", "left": high, "right": {"literal": 2}}, "right": {"op": "sub", "left": above, "right": high}}
    want = {}
    for t in range(2):
        for i in range(12):
            own = [x for x in rows if x[:2] == (t, i)]
            h = max((x[3] / x[4] for x in own if x[3] is not None and x[5] == 0), default=None)
            f = next((x[3] for x in own if x[3] is not None), None)
            d = [x[3] - f for x in own if x[3] is not None and x[5] == 1]
            want[t, i] = None if h is None or not d else pytest.approx(2 * h + sum(d) / len(d) - h)
    got = {(x.tile_id, x.idx): x.v for x in mosaic.rule_values(layers, rule, {1: "a", 2: "b"}).collect()}
    assert got == want and sum(v is not None for v in got.values()) > 5
    assert len(pixel.mosaics_of(rule)) == 3
    plan = mosaic.rule_values(layers, {"op": "sub", "left": high, "right": first}, {1: "a", 2: "b"})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # mosaics that do not hold each other are one aggregate
    with pytest.raises(ValueError, match="mosaic around it"):
        mosaic.rule_values(layers, {"op": "add", "left": high, "right": {"band": 1}}, {1: "a", 2: "b"})
    with pytest.raises(ValueError, match="unknown reducer"):
        mosaic.rule_values(layers, {**first, "reducer": "median"}, {1: "a", 2: "b"})


def test_job_parameters(spark, tmp_path):
    inputs = spark.createDataFrame([(1, 1, 2.0), (1, 2, 6.0), (2, 1, 2.0), (2, 2, 6.0)], "job_id int, band int, value double")
    jobs = [(1, "zonal-stats", '{"band": 1}'), (2, "zonal_stats", '{"band": 2}'), (3, "zonal_stats", None), (4, "zonal_stats", '{"band": "x"}'), (5, "zonal_stats", '{"other": 1}'), (6, "mean-values", '{"values": [1, 2, 6]}'), (7, "mean-values", '{"values": []}'), (8, "none", "{}"), (9, "zonal_stats", "no json")]
    table = spark.createDataFrame(jobs, "job_id int, process_id string, params_json string")
    got = {r.job_id: r for r in models.run_jobs(table, inputs).collect()}
    number = lambda i, k: json.loads(got[i].document)[k]
    assert len(got) == 9 and (number(1, "mean"), number(2, "mean"), number(3, "count"), number(6, "mean"), number(6, "count")) == (2.0, 6.0, 0, 3.0, 3)
    assert got[4].error == "band must be a positive band index" and got[5].error == "other unknown parameter" and "list of numbers" in got[7].error and got[8].error == "unknown process" and "object" in got[9].error
    out, status = str(tmp_path / "out"), str(tmp_path / "status")
    feeds.run_batch(table, inputs, out, status=status)
    events = {}
    for r in spark.read.json(status).collect():
        events.setdefault(r.job_id, []).append((r.seq, r.state, r.progress))
    assert sorted(events[1]) == [(1, "running", 0.1), (2, "running", 0.5), (3, "succeeded", 1.0)] and sorted(events[4])[-1] == (3, "failed", 1.0)
    given = spark.createDataFrame([(1, "running", 0.1), (2, "running", None)], "seq int, state string, progress double")
    assert sorted(r.progress for r in feeds.status_events(given).collect()) == [0.1, 0.5]


def test_model_metadata(spark):
    described = {r.id: r for r in models.descriptions(spark, models.BUILT_IN).collect()}
    assert described["ndvi"].kind == "tile" and described["zonal-stats"].kind == "batch" and list(described["zonal-stats"].inputs) == ["band"]
    custom = models.descriptions(spark, [models.Ndvi()], "custom")
    listed = models.listed(models.descriptions(spark, models.BUILT_IN).unionByName(custom)).collect()
    assert [r.id for r in listed] == sorted(described) and {r.id: r.origin for r in listed}["ndvi"] == "custom"
    specs = {(r.process_id, r.name): r for r in models.specifications(spark, models.BUILT_IN).collect()}
    assert specs["scale_band", "factor"].minimum == 0.0 and specs["zonal-stats", "band"].default_value == "1" and not specs["mean-values", "values"].required


def test_files_that_cannot_be_read_give_a_reason(spark):
    good = tiff(np.arange(256, dtype=np.uint8).reshape(16, 16, 1))
    odd = bytearray(tiff(np.arange(256, dtype=np.uint8).reshape(16, 16, 1), deflate=True))
    at = odd.index(b"\x03\x01\x03\x00\x01\x00\x00\x00\x08\x00")
    odd[at + 8] = 5  # a codec that is not read
    broken = bytearray(tiff(np.zeros((16, 16, 1), np.uint8), deflate=True))
    broken[8:12] = b"\xff\xff\xff\xff"
    rows = geotiff.chips(spark.createDataFrame([("good", good), ("odd", bytes(odd)), ("broken", bytes(broken)), ("none", b"xx")], "uri string, content binary")).collect()
    assert {r.asset_id: r.error is None for r in rows} == {"good": True, "odd": False, "broken": False, "none": False} and len(rows) == 4


def test_batches_that_run_again_replace_their_tiles(spark, tmp_path):
    req = spark.createDataFrame([(1, 3, x, 0, 1, "", "png") for x in range(3)], "service_id long, z int, x int, y int, band int, render_rule string, format string")
    empty = spark.createDataFrame([], "tile_key string, png binary, rendered_at timestamp")
    render = lambda df: df.select("tile_key", F.lit(b"x").alias("png"))
    for batch_id in (0, 0, 1):
        feeds.materialise(req, empty, render, str(tmp_path / "t"), datetime(2024, 1, 1), batch_id)
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("batch_id").count().collect()) == [3, 3]


def test_purge_runs_by_itself(spark, tmp_path):
    ran = []
    q = feeds.purge_stream(spark, str(tmp_path / "cp"), lambda: ran.append(1), seconds=1)
    for _ in range(60):
        if ran:
            break
        q.awaitTermination(1)
    q.stop()
    assert ran


def test_services_are_purged_with_what_hangs_on_them(spark):
    services = spark.createDataFrame([(1,), (2,)], "id int")
    virtual = spark.createDataFrame([(10, 1, None), (11, 5, 1), (12, 2, None), (13, 2, 2)], "id int, service_id int, parent_service_id int")
    scenes = spark.createDataFrame([(100, 1), (101, 1), (102, 2)], "scene_id int, service_id int")
    tombs = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 29))], "service_id int, deleted_at timestamp")
    scene_tombs = spark.createDataFrame([(100, datetime(2024, 1, 1)), (102, datetime(2024, 1, 1))], "scene_id int, deleted_at timestamp")
    now = datetime(2024, 1, 30)
    got = catalog.purge_services(catalog.purgeable(tombs, now), services, virtual, scenes, {"scenes": scenes}, tombs, scene_tombs, now)
    ids = lambda name, key: sorted(r[key] for r in got[name].collect())
    assert ids("services", "id") == [2] and ids("virtual", "id") == [12, 13] and ids("scenes", "scene_id") == [102]
    assert {r.service_id: r.purged_at is not None for r in got["service_tombstones"].collect()} == {1: True, 2: False}
    assert {r.scene_id: r.purged_at is not None for r in got["scene_tombstones"].collect()} == {100: True, 102: False}


def test_tile_functions_on_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, r.random(32).astype("f4").tolist() if i % 3 else [None, *r.random(7).astype("f4").tolist()], {"factor": str(i)} if i % 2 else None) for i in range(9)]
    table = spark.createDataFrame(rows, "id int, band array<float>, p map<string,string>")

    class OneByOne(models.TileModel):
        id, required_bands = "one", ["band"]

        def compute_tile(self, bands, params, tile):
            return bands["band"] * float(params["factor"]) + tile["id"]

    class Wrong(OneByOne):
        def compute_tile(self, bands, params, tile):
            return bands["band"][:1]

    for at_once in (1 << 22, 8):
        monkeypatch.setattr(models, "BLOCK_PIXELS", at_once)
        for model, add in ((models.ScaleBand(), False), (OneByOne(), True)):
            got = {x.id: x["values"] for x in models.apply_tiles(table, model, {"factor": "10"}, width=8, params_col="p").collect()}
            for i, band, p in rows:
                factor = float(p["factor"]) if p else 10.0
                assert got[i] == [None if v is None else pytest.approx(v * factor + i * add, rel=1e-5) for v in band]
    with pytest.raises(Exception, match="shape"):
        models.apply_tiles(table.where("id % 3 > 0"), Wrong(), {"factor": "1"}, width=8).collect()
    with pytest.raises(Exception, match="missing or of different sizes"):
        pair = spark.createDataFrame([(1, [1.0] * 8, [1.0] * 16), (2, None, [1.0] * 8)], "id int, red array<float>, nir array<float>")
        models.apply_tiles(pair, models.Ndvi(), width=8).collect()


def test_layers_under_nothing_open_are_not_sampled(spark, monkeypatch):
    _, _, headers, chips = _rasters(spark)
    monkeypatch.setattr(tiles, "NEAR", 3)
    monkeypatch.setattr(tiles, "ASKED", 2)
    names = "dbac" * 6
    heads = headers.crossJoin(spark.range(6)).withColumn("uri", F.concat("uri", F.lit("_"), F.col("id").cast("string"))).drop("id")
    copies = chips.crossJoin(spark.range(6)).withColumn("asset_id", F.concat("asset_id", F.lit("_"), F.col("id").cast("string"))).drop("id")
    rows = [(*t, f"{k}_{i // 4}", 1, i + 1) for t in ((4, 8, 5), (5, 17, 11), (5, 17, 10)) for i, k in enumerate(names)]
    req = spark.createDataFrame(rows, "z int, x int, y int, asset_id string, band int, layer_order int")
    every = tiles.mosaic_blocks(tiles.warp_blocks(req, heads, copies, 16, keep=("layer_order",)), 16, "first")
    asked, warp = [], tiles.warp_blocks
    monkeypatch.setattr(tiles, "warp_blocks", lambda r, *a: asked.append(r.count()) or warp(r, *a))
    some = tiles.first_mosaic(req, heads, copies, 16)
    of = lambda df: {(r.z, r.x, r.y): [None if v is None or v != v else v for v in r["values"]] for r in df.collect()}
    assert of(some) == of(every) and len(of(every)) == 3
    assert asked[0] == 9 and sum(asked) < len(rows) - 9


def test_line_sums_and_samples_of_blocks(spark):
    _, _, headers, chips = _rasters(spark)
    req = spark.createDataFrame([(*t, k, 1) for t in ((4, 8, 5), (5, 17, 11)) for k in "abcd"], "z int, x int, y int, asset_id string, band int")
    blocks = tiles.warp_blocks(req, headers, chips, 16)
    want, long = {}, {}
    for r in tiles.warp(req, headers, chips, 16).where("v IS NOT NULL").collect():
        long[r.z, r.x, r.asset_id, r.idx] = r.v
        want.setdefault((r.z, r.x, r.asset_id, r.idx // 16), []).append((r.idx % 16, r.v))
    assert {(r.z, r.x, r.asset_id, r.idx): r.v for r in tiles.samples(blocks, 16).collect()} == long and len(long) > 200
    got = {(r.z, r.x, r.asset_id, r.line): (r.n, r.first, r.total, r.moment) for r in tiles.line_sums(blocks).collect()}
    assert got == {k: (len(v), min(v)[0], pytest.approx(sum(x for _, x in v)), pytest.approx(sum(x * (i + 1) for i, x in v))) for k, v in want.items()}


def test_equal_boxes_and_places_meet_once(spark, monkeypatch):
    r = random.Random(3)
    spots = [(r.uniform(-180, 180), r.uniform(-80, 80)) for _ in range(40)]
    corners = [(x, y, x + r.choice([3, 30, -20]), y + 20) for x, y in ((r.uniform(-180, 160), r.uniform(-80, 60)) for _ in range(50))]
    points = [(i % 150, *spots[i % 40]) for i in range(200)] + [(900, None, 1.0)]
    scenes = [(i, *corners[i * 7 % 50]) for i in range(300)]
    p = spark.createDataFrame(points, "point_id int, lon double, lat double")
    f = spark.createDataFrame(scenes, "scene_id int, minx double, miny double, maxx double, maxy double")
    want = {(x.point_id, x.n, x.first_scene) for x in ranges.point_scenes(p, f).groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.min("scene_id").alias("first_scene")).collect()}
    asked, join = [], ranges.point_scenes
    monkeypatch.setattr(ranges, "point_scenes", lambda a, b, m: asked.append((a.where("lon IS NOT NULL").count(), b.count())) or join(a, b, m))
    assert {tuple(x) for x in ranges.point_counts(p, f).select("point_id", "n", "first_scene").collect()} == want and len(want) > 100
    assert asked == [(40, 50)]


def _odd_search_rows(spark, seed):
    r = random.Random(seed)
    day = lambda: r.choice([None, *[datetime(1996, 1, 1) + timedelta(days=r.randrange(9), microseconds=r.randrange(3))] * 6])

    def box(sizes):
        x, y, w, h = r.uniform(-180, 180), r.uniform(-90, 80), r.choice(sizes), r.choice(sizes)
        x, y = (round(x), round(y)) if r.random() < 0.3 else (x, y)
        c = x + w if x + w <= 180 else x + w - 360
        return r.choice([(x, y, c, y + h)] * 30 + [(None, y, c, y + h), (x, y + 1, c, y), (x, y, x, y)])

    scenes = [(i, i % 7, *map(lambda v: v if v is None else float(v), box([0.01, 2, 9, 40, 300])), day(), r.choice([None, float(r.randrange(101))]), "2020-01") for i in range(700)]
    scenes += [(s[0] + 1000, *s[1:]) for s in scenes[:60]] + scenes[:20]
    asked = [(i % 95, *map(lambda v: v if v is None else float(v), box([0.5, 20, 60, 350])), r.choice([None, day()]), r.choice([None, day()]), r.choice([None, float(r.randrange(101))]), r.choice([None, 0, 1, 3, 500])) for i in range(100)]
    f = spark.createDataFrame(scenes, "scene_id long, service_id long, minx double, miny double, maxx double, maxy double, acquired_at timestamp, cloud_cover double, acq_month string")
    q = spark.createDataFrame(asked, "request_id long, x0 double, y0 double, x1 double, y1 double, since timestamp, until timestamp, cloud_max double, max_items int")
    return f, q, spark.createDataFrame([(3,)], "service_id long"), spark.createDataFrame([(5,), (1007,)], "scene_id long")


def _listed_search(f, q, gone, dead):
    """Every pair, then ranked."""
    full = lambda df: df.where("minx IS NOT NULL")
    scenes = full(search.distinct_scenes(search.live(f, gone, dead)))
    asked = full(q.selectExpr("request_id", "x0 AS minx", "y0 AS miny", "x1 AS maxx", "y1 AS maxy", "since", "until", "cloud_max", "max_items"))
    pairs = ranges.rect_join(asked, scenes).where(search.overlaps_time("acquired_at", "acquired_at", "since", "until") & search.cloud_at_most("cloud_cover", "cloud_max"))
    w = Window.partitionBy("request_id")
    ranked = pairs.withColumn("rank", F.row_number().over(w.orderBy(*search.newest_first()))).withColumn("m", F.count(F.lit(1)).over(w))
    return ranked.where("rank <= coalesce(max_items, 10)").select("request_id", "rank", "scene_id", "m")


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_search_on_odd_boxes(spark, monkeypatch, seed):
    from tesserae.operators import ranked

    f, q, gone, dead = _odd_search_rows(spark, seed)
    once = q.dropDuplicates(["request_id"]).cache()  # rows with one id are ranked together, in an order that ties leave open
    want = sorted(tuple(r) for r in _listed_search(f, once, gone, dead).collect())
    assert len(want) > 500
    assert sorted(tuple(r) for r in search.batch_search(f, once, gone, dead).collect()) == want
    assert search.batch_search(f.limit(0), once, gone, dead).count() == search.batch_search(f, q.limit(0), gone, dead).count() == 0
    monkeypatch.setattr(ranked, "PART", 16)  # many parts of a cell
    assert sorted(tuple(r) for r in search.batch_search(f, once, gone, dead).collect()) == want
    both = {(r.request_id, r.number_matched) for r in search.batch_search(f, q, gone, dead).collect()}
    assert both <= {(r.request_id, r.m) for r in _listed_search(f, q, gone, dead).collect()} and len(both) > 50


def test_batch_search_lists_no_pairs(spark):
    from tesserae.operators import ranked

    scenes = spark.range(3000).selectExpr("id AS scene_id", "0D AS minx", "0D AS miny", "9D AS maxx", "9D AS maxy", "timestamp_seconds(id) AS acquired_at", "1D AS cloud_cover")
    asked = spark.range(50).selectExpr("id AS request_id", "1D AS minx", "1D AS miny", "8D AS maxx", "8D AS maxy", "timestamp_seconds(id) AS since", "CAST(NULL AS timestamp) AS until", "2D AS cloud_max", "4 AS top", "4 AS most")
    rows = ranked.first_matches(asked, scenes).collect()
    assert len(rows) == 200  # of 148 775 pairs
    assert {(r.request_id, r.n) for r in rows if r.n} == {(i, 3000 - i) for i in range(50)}
    assert {r.scene_id for r in rows} == {2996, 2997, 2998, 2999}


def test_blocks_of_scenes_count_on(monkeypatch):
    from tesserae.operators import ranked

    monkeypatch.setattr(ranked, "BLOCK", 7)
    n = 40
    rows = {c: np.zeros(n) for c in ("a", "miny", "cloud", "minx")} | {c: np.ones(n) for c in ("c", "maxy", "maxx")}
    rows |= {"since": np.arange(n)[::-1].copy(), "until": np.arange(n)[::-1].copy(), "piece": np.zeros(n, np.int32), "begins_x": np.ones(n, bool), "begins_y": np.ones(n, bool), "scene_id": np.arange(n), "key": np.arange(n)[::-1].copy()}
    part = ranked.Part([pa.RecordBatch.from_pydict({k: v[x:y] for k, v in rows.items()}) for x, y in ((0, 13), (13, 40))])
    asked = {c: [0.0] * 3 for c in ("a", "miny", "minx")} | {c: [1.0] * 3 for c in ("c", "maxy", "maxx", "cloud")} | {"since": [0, 5, 99], "until": [99, 30, 99], "piece": [0] * 3, "begins_x": [True] * 3, "begins_y": [True] * 3, "request_id": ["p", "q", "r"], "top": [9] * 3, "most": [9] * 3}
    out = pa.Table.from_batches(part.answers(pa.RecordBatch.from_pydict(asked))).to_pylist()
    assert [r["scene_id"] for r in out if r["request_id"] == "p"] == list(range(9)) and [r["scene_id"] for r in out if r["request_id"] == "q"] == list(range(9, 18))
    assert {r["request_id"]: r["n"] for r in out if r["n"]} == {"p": 40, "q": 26}
