"""Raster files and the lake: written by helpers here, read by the library."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import spatial
from tesserae.operators import tiles
from tesserae.sources import geotiff, tables


def tiff(pixels, order="<", tile=16, deflate=False, predictor=False, gt=(10.0, 0.5, 40.0, 0.5), keys=(), at_end=0):
    """A tiled TIFF of (rows, columns, bands) samples."""
    h, w, bands = pixels.shape
    kind = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    chunks = []
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            c = np.zeros((tile, tile, bands), pixels.dtype)
            part = pixels[y : y + tile, x : x + tile]
            c[: part.shape[0], : part.shape[1]] = part
            if predictor:
                c = np.concatenate((c[:, :1], np.diff(c, axis=1)), axis=1)
            raw = c.astype(pixels.dtype.newbyteorder(order)).tobytes()
            chunks.append(zlib.compress(raw) if deflate else raw)
    body, offsets = bytearray(b"\0" * 8 + b"\0" * at_end), []
    for c in chunks:
        offsets.append(len(body))
        body += c
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [pixels.dtype.itemsize * 8] * bands), 259: (3, [8 if deflate else 1]), 277: (3, [bands]), 317: (3, [2 if predictor else 1]), 322: (3, [tile]), 323: (3, [tile]), 324: (4, offsets), 325: (4, [len(c) for c in chunks]), 339: (3, [kind] * bands), 33550: (12, [gt[1], gt[3], 0.0]), 33922: (12, [0.0, 0.0, 0.0, gt[0], gt[2], 0.0])}
    if keys:
        doubles, entries = [], []
        for k, v in keys:
            if isinstance(v, float):
                entries += [k, 34736, 1, len(doubles)]
                doubles.append(v)
            else:
                entries += [k, 0, 1, v]
        tags[34735] = (3, [1, 1, 0, len(keys), *entries])
        if doubles:
            tags[34736] = (12, doubles)
    code = {3: "H", 4: "I", 12: "d"}
    placed = {}
    for t, (k, v) in tags.items():
        data = struct.pack(order + code[k] * len(v), *v)
        if len(data) > 4:
            placed[t] = struct.pack(order + "I", len(body))
            body += data
        else:
            placed[t] = data.ljust(4, b"\0")
    ifd = len(body)
    body += struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHI", t, k, len(v)) + placed[t] for t, (k, v) in sorted(tags.items())) + b"\0" * 4
    body[:8] = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", ifd)
    return bytes(body)


def files(spark, named):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in named.items()], "uri string, content binary")


@pytest.mark.parametrize("order", ["<", ">"])
def test_all_sample_types(spark, order):
    r = np.random.default_rng(0)
    named, want = {}, {}
    for t in ("u1", "i1", "u2", "i2", "u4", "i4", "f4", "f8"):
        a = (r.random((20, 24, 3)) * 100).astype(t)
        named[t], want[t] = tiff(a, order), a
    rows = geotiff.pixels(geotiff.chips(files(spark, named)), 16, 16).collect()
    assert len(rows) == 8 * 20 * 24 * 3
    for x in rows:
        assert x.v == np.float32(want[x.asset_id][x.row, x.col, x.band - 1])


def test_deflate_predictor_and_nodata(spark):
    a = np.arange(64 * 2, dtype="u2").reshape(8, 8, 2)
    rows = geotiff.pixels(geotiff.chips(files(spark, {"x": tiff(a, deflate=True, predictor=True)}), nodata=5), 16, 16).collect()
    assert {(r.row, r.col, r.band): r.v for r in rows} == {(i, j, b + 1): (None if a[i, j, b] == 5 else float(a[i, j, b])) for i in range(8) for j in range(8) for b in range(2)}


def test_headers_and_errors(spark):
    a = np.zeros((20, 10, 1), "f4")
    utm = tiff(a, gt=(500000.0, 10.0, 5000000.0, 10.0), keys=[(3072, 32633)])
    albers = tiff(a, gt=(0.0, 1000.0, 2000000.0, 1000.0), keys=[(3072, 32767), (3075, 11), (3078, 29.5), (3079, 45.5), (3085, 23.0), (3084, -96.0)])
    late = tiff(a, at_end=geotiff.HEADER_BYTES)
    f = files(spark, {"utm": utm, "albers": albers, "late": late, "junk": b"not a picture"})
    h = geotiff.headers(f.withColumn("content", F.substring("content", 1, geotiff.HEADER_BYTES)))
    rows = {r.uri: r for r in geotiff.inspected(h).collect()}
    assert "outside" in rows["late"].error and "not a TIFF" in rows["junk"].error
    assert (rows["utm"].width, rows["utm"].height, rows["utm"].band_count, rows["utm"].dtype, rows["utm"].crs) == (10, 20, 1, "f32", "EPSG:32633")
    assert rows["utm"].gt.oy == 5000000 and rows["utm"].gt.ph == -10
    assert len(rows["utm"].ring) == 5 and all(13 < p.x < 17 and 44 < p.y < 46 for p in rows["utm"].ring)
    assert rows["albers"].crs.startswith("+proj=aea") and all(-125 < p.x < -65 and 24 < p.y < 50 for p in rows["albers"].ring)


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(np.ones((4, 4, 1), "u1")))
    (tmp_path / "b.txt").write_text("x")
    got = geotiff.files(spark, str(tmp_path), header_only=True, pattern="*.tif").collect()
    assert len(got) == 1 and got[0].uri.endswith("a.tif") and len(got[0].content) <= geotiff.HEADER_BYTES


def big_tiff(pixels, tile=16):
    """The same as a big TIFF, little-endian."""
    h, w, bands = pixels.shape
    chunks = [np.ascontiguousarray(np.pad(pixels[y : y + tile, x : x + tile], ((0, max(0, y + tile - h)), (0, max(0, x + tile - w)), (0, 0)))).tobytes() for y in range(0, h, tile) for x in range(0, w, tile)]
    body, offsets = bytearray(16), []
    for c in chunks:
        offsets.append(len(body))
        body += c
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [pixels.dtype.itemsize * 8]), 259: (3, [1]), 277: (3, [bands]), 322: (3, [tile]), 323: (3, [tile]), 324: (16, offsets), 325: (16, [len(c) for c in chunks]), 339: (3, [3])}
    placed = {}
    for t, (k, v) in tags.items():
        data = struct.pack("<" + {3: "H", 4: "I", 16: "Q"}[k] * len(v), *v)
        placed[t] = data.ljust(8, b"\0") if len(data) <= 8 else struct.pack("<Q", len(body))
        body += data if len(data) > 8 else b""
    at = len(body)
    body += struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQ", t, k, len(v)) + placed[t] for t, (k, v) in sorted(tags.items())) + bytes(8)
    body[:16] = b"II+\0" + struct.pack("<HHQ", 8, 0, at)
    return bytes(body)


def test_ranges_give_the_same_chips_as_whole_files(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(1)
    (tmp_path / "deep").mkdir()
    for i in range(5):
        a = r.integers(0, 200, (40 + i, 50, 1 + i % 3)).astype(("u1", "f4")[i % 2])
        (tmp_path / "deep" / f"{i}.tif").write_bytes(tiff(a, "<>"[i % 2], deflate=i > 2, predictor=i == 3))
    (tmp_path / "big.tif").write_bytes(big_tiff(r.random((40, 50, 2)).astype("f4")))
    (tmp_path / "note.txt").write_text("no raster")
    whole = geotiff.chips(geotiff.files(spark, f"{tmp_path}/*").unionByName(geotiff.files(spark, f"{tmp_path}/deep")).where("uri LIKE '%.tif'").dropDuplicates(["uri"]), nodata=7)
    monkeypatch.setattr(geotiff, "TASK_BYTES", 4096)
    index = geotiff.scan(spark, str(tmp_path), "index", "*.tif")
    ranged = geotiff.read_chips(index, nodata=7)
    key = lambda x: (x.asset_id.split("/")[-1], x.band, x.chip_x, x.chip_y)
    rows = lambda df: sorted((*key(x), x.w, x.h, np.array(x.pixels, "f4").tobytes(), x.error) for x in df.collect())
    assert rows(ranged) == rows(whole) and len(rows(whole)) > 100
    # one file's chips are decoded in several tasks
    assert ranged.rdd.getNumPartitions() > 5
    one = geotiff.read_chips(index.where("uri LIKE '%big.tif'")).withColumn("task", F.spark_partition_id())
    assert one.select("task").distinct().count() > 3


def test_a_file_of_more_than_two_gigabytes(spark, tmp_path):
    """Only the ranges that are asked for are read: head, tables and chips, of a sparse file."""
    a = (np.arange(64 * 64).reshape(64, 64, 1) % 251).astype("u1")
    data = bytearray(tiff(a, tile=16))
    (at,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<H", data, at)
    far = 2_500_000_000
    for i in range(n):  # the chips move behind two and a half gigabytes
        tag, _, count, where = struct.unpack_from("<HHII", data, at + 2 + 12 * i)
        if tag == 324:
            moved = [o + far for o in struct.unpack_from(f"<{count}I", data, where)]
            old = struct.unpack_from(f"<{count}I", data, where)
            struct.pack_into(f"<{count}I", data, where, *moved)
    path = tmp_path / "large.tif"
    with open(path, "wb") as f:
        f.write(data)
        for o in old:
            f.seek(o + far)
            f.write(data[o : o + 256])
    assert path.stat().st_size > far
    header = geotiff.scan(spark, str(path)).first()
    assert (header.width, header.height, header.error) == (64, 64, None) and header.bytes_read <= 2 * geotiff.PAGE
    index = geotiff.scan(spark, str(path), "index")
    assert index.count() == 16 and index.agg(F.sum("n_bytes")).first()[0] == 64 * 64
    got = {(r.row, r.col): r.v for r in geotiff.pixels(geotiff.read_chips(index), 16, 16).collect()}
    assert got == {(y, x): float(a[y, x, 0]) for y in range(64) for x in range(64)}


def test_every_odd_file_is_a_row(spark, tmp_path):
    good = tiff((np.arange(1024) % 255).astype("u1").reshape(32, 32, 1))
    r = np.random.default_rng(0)
    names = {"good": good, "empty": b"", "short": good[:40], "text": b"II*\0 nothing else", "half": good[:-60], "cut": good[: len(good) // 2]}

    def without(tag, value=None):
        """The entry of a tag renamed, or with another value."""
        out = bytearray(good)
        (at,) = struct.unpack_from("<I", out, 4)
        for i in range(struct.unpack_from("<H", out, at)[0]):
            if struct.unpack_from("<H", out, at + 2 + 12 * i)[0] == tag:
                struct.pack_into("<H" if value is None else "<I", out, at + 2 + 12 * i + (0 if value is None else 8), 65000 if value is None else value)
        return bytes(out)

    names |= {"no sizes": without(325), "no offsets": without(324), "zero bands": without(277, 0), "no width": without(256), "zero width": without(256, 0), "flat chips": without(323, 0), "codec": without(259, 5), "kind": without(339, 9), "vast": without(256, 2**31)}
    for i in range(40):  # some bytes overwritten at random
        odd = bytearray(good)
        for k in r.integers(0, len(odd), 30) if i % 2 else r.integers(len(odd) - 260, len(odd), 6):
            odd[k] = int(r.integers(0, 256))
        names[f"noise {i}"] = bytes(odd)
    for k, v in names.items():
        (tmp_path / f"{k}.tif").write_bytes(v)
    for rows in (geotiff.chips(files(spark, names)).collect(), geotiff.read_chips(geotiff.scan(spark, str(tmp_path), "index")).collect()):
        by = {}
        for x in rows:
            by.setdefault(x.asset_id.split("/")[-1].removesuffix(".tif"), []).append(x)
        assert set(by) == set(names) and all(x.error is None for x in by["good"]) and len(by["good"]) == 4
        for k in names:
            if k != "good" and not k.startswith("noise"):
                assert any(x.error for x in by[k]), k
            assert all((x.error is None) == (x.pixels is not None) for x in by[k])
    heads = {x.uri.split("/")[-1].removesuffix(".tif"): x for x in geotiff.scan(spark, str(tmp_path)).collect()}
    assert set(heads) == set(names) and heads["good"].width == 32 and heads["empty"].error and heads["text"].error


def test_warp_of_a_plane(spark):
    """A raster whose value is its column stays linear in longitude after warping."""
    a = np.tile(np.arange(32, dtype="f4")[None, :, None], (32, 1, 1))
    f = files(spark, {"x": tiff(a, gt=(0.0, 1.0, 40.0, 1.0), keys=[(2048, 4326)])})
    h = geotiff.inspected(geotiff.headers(f))
    req = spark.createDataFrame([(3, 4, 3, "x", 1), (3, 4, 3, "x", 1), (3, 0, 0, "x", 1)], "z int, x int, y int, asset_id string, band int")
    got = tiles.warp(req, h, geotiff.chips(f), 16).collect()
    assert len(got) == 512 and not any(r.v is not None for r in got if r.x == 0)  # the repeated request counts once
    for r in got:
        lon = (r.idx % 16 + 0.5) * 45 / 16
        if r.v is not None:
            assert r.v == pytest.approx(min(max(lon - 0.5, 0), 31), abs=1e-4)
    assert any(r.v is not None for r in got) and any(r.v is None for r in got)


def test_footprint_lake(spark, tmp_path):
    scenes = spark.sql("SELECT 1L AS scene_id, 7L AS service_id, 'POLYGON ((-1 -1, -1 1, 1 1, 1 -1, -1 -1))' AS wkt, TIMESTAMP '2024-07-15' AS acquired_at, 10D AS cloud_cover UNION ALL SELECT 2L, 7L, 'POLYGON ((5 5, 5 6, 6 6, 6 5, 5 5))', NULL, NULL")
    assets = spark.createDataFrame([(1, "data", 1, "cog", "s3://b/1"), (2, "data", 1, "cog", "s3://b/2")], "scene_id long, band_role string, band_index int, format string, storage_uri string")
    base = str(tmp_path / "lake")
    tables.append_footprints(tables.footprint_rows(scenes, assets), base)
    tables.append_footprints(tables.footprint_rows(scenes.where("scene_id = 1"), assets), base)
    got = tables.footprints(spark, base)
    assert got.count() == 3 and {r.acq_month for r in got.select("acq_month").collect()} == {"2024-07", None}
    assert got.where(spatial.rect_filter("minx", "miny", "maxx", "maxy", (-2, -2, 2, 2))).count() == 2


def test_results_and_cubes(spark, tmp_path):
    rows = tables.result_rows(spark.createDataFrame([(1, "p", 2.0)], "job_id long, process_id string, mean double"), "json")
    for _ in range(2):
        tables.write_results(rows, str(tmp_path / "out"))
    got = spark.read.text(str(tmp_path / "out")).collect()
    assert len(got) == 1 and '"output_kind":"json"' in got[0].value
    cube = spark.range(300).selectExpr("'t' AS variable", "id AS d0", "0L AS d1", "cast(id AS double) AS value")
    assert tables.cube_document(cube, "t", {"d0": None}, ["d0", "d1"]).first().values == '"truncated"'
    assert tables.cube_document(cube.where("d0 < 3"), "t", {"d0": None}, ["d0", "d1"]).first().values == "[0.0,1.0,2.0]"
    with pytest.raises(ValueError):
        tables.cube_document(cube, "nope", {}, ["d0", "d1"])


def test_png():
    data = tiles.png(bytes(range(16)), 2, 2)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8]) == b"\0" + bytes(range(8)) + b"\0" + bytes(range(8, 16))
    with pytest.raises(ValueError):
        tiles.png(b"x", 1, 1)


def _lake(spark, n=20_000):
    """Footprints of three months and none, all over the world."""
    return spark.range(n).selectExpr(
        "id AS scene_id", "id % 7 AS service_id", "(id * 7919 % 35900) / 100D - 180 AS minx", "(id * 104729 % 17900) / 100D - 90 AS miny", "cast(null AS double) AS cloud_cover",
        "CASE WHEN id % 4 < 3 THEN concat('2024-0', id % 4 + 1) END AS acq_month").selectExpr("*", "minx + 1 AS maxx", "miny + 1 AS maxy")


def test_small_boxes_touch_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    base, rows = str(tmp_path / "lake"), _lake(spark)
    tables.append_footprints(rows, base, group_rows=100)
    groups, touched = 0, 0
    box = (10.0, 20.0, 25.0, 30.0)
    for f in (tmp_path / "lake").rglob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        names = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            s = {c: meta.row_group(g).column(names[c]).statistics for c in ("minx", "miny", "maxx", "maxy")}
            groups += 1
            touched += s["minx"].min <= box[2] and s["maxx"].max >= box[0] and s["miny"].min <= box[3] and s["maxy"].max >= box[1]
    assert groups >= 190 and touched <= 0.15 * groups
    where = spatial.rect_filter("minx", "miny", "maxx", "maxy", box)
    got = tables.footprints(spark, base).where(where)
    assert sorted(r.scene_id for r in got.collect()) == sorted(r.scene_id for r in rows.where(where).collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(minx" in plan


def test_purge_rewrites_the_months_touched_and_no_others(spark, tmp_path, monkeypatch):
    base, work, rows = str(tmp_path / "lake"), str(tmp_path / "work"), _lake(spark, 400)
    tables.append_footprints(rows, base)
    # all of 2024-02 and some of the undated ones
    due = rows.where("acq_month = '2024-02' OR (acq_month IS NULL AND scene_id < 100)").select("scene_id")
    want = sorted(r.scene_id for r in rows.join(due, "scene_id", "left_anti").collect())
    scenes = lambda: sorted(r.scene_id for r in spark.read.parquet(base).collect())
    times = lambda m: {f.name: f.stat().st_mtime_ns for f in (tmp_path / "lake" / f"acq_month={m}").glob("*.parquet")}
    before = {m: times(m) for m in ("2024-01", "2024-03")}
    # a run that ends before the swap leaves the lake as it was; the next one ends it, whatever it is asked for
    with monkeypatch.context() as m:
        m.setattr(tables, "_finish_purge", lambda *a: [])
        tables.purge_footprints(spark, base, due, work)
    assert scenes() == list(range(400)) and (tmp_path / "work" / "months").exists()
    none = rows.where("false")
    assert sorted(map(str, tables.purge_footprints(spark, base, none, work))) == ["2024-02", "None"]
    assert scenes() == want and not (tmp_path / "work").exists() and not (tmp_path / "lake" / "acq_month=2024-02").exists()
    assert {m: times(m) for m in before} == before
    assert tables.purge_footprints(spark, base, due, work) == [] and scenes() == want
    # a run that ended in the midst of writing its work leaves no list, and counts for nothing
    (tmp_path / "work" / "kept").mkdir(parents=True)
    assert tables.purge_footprints(spark, base, rows.where("scene_id = 0").select("scene_id"), work) == ["2024-01"] and scenes() == want[1:]
