"""Queries do the whole job on tables that are larger than the smallest test tables, or lie elsewhere in them."""

import json
import math
import shutil

import duckdb
import pytest

from tesserae.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def test_search_counts_beyond_the_largest_limit(spark, sf, tmp_path):
    for t in ("customer", "events"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    orders = spark.range(1, 150_001).selectExpr("id AS o_orderkey", "id % 150 + 1 AS o_custkey", "timestamp_ntz'1997-01-01 00:00:00' AS o_orderdate")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES["search_counts"]).fetchall()
    assert want[0][0] > 10_000
    assert [(r.number_matched, r.number_returned) for r in QUERIES["search_counts"](spark, str(tmp_path)).collect()] == want


@pytest.fixture(scope="module")
def rasters(spark, sf, tmp_path_factory):
    """A folder whose rasters all have a vec_id of 60 or more, and their pixels."""
    d = tmp_path_factory.mktemp("rasters")
    for t in ("customer", "orders"):
        shutil.copy(f"{sf}/{t}.parquet", f"{d}/{t}.parquet")
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id BETWEEN 60 AND 69 OR vec_id > 490").write.parquet(f"{d}/embeddings.parquet")
    return str(d), {r.vec_id: r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}


def place(vec_id, lon, lat):
    """Column and row of a point in a raster, None outside of it."""
    c, r = (lon - ((vec_id * 37) % 300 - 150)) / 3 - 0.5, (((vec_id * 53) % 120 - 40) - lat) / 3 - 0.5
    return (c, r) if -0.5 <= c <= 7.5 and -0.5 <= r <= 7.5 else None


def test_point_coverage_has_every_raster(spark, rasters):
    d, vectors = rasters
    want = {}
    for k in (r.c_custkey for r in spark.read.parquet(f"{d}/customer.parquet").collect()):
        lon, lat = ((k * 71) % 3600) / 10 - 180, ((k * 43) % 1800) / 10 - 90
        for i in vectors:
            if abs(lat) < 85 and place(i, lon, lat):
                want.setdefault(k, set()).add(f"{i}_band_1")
    got = {r.point_id: set(json.loads(r.document)["ranges"]) for r in QUERIES["point_coverage"](spark, d).collect()}
    assert got and got == want


def test_tile_pyramid_draws_every_raster(spark, rasters):
    from tesserae.operators import tiles
    from tesserae.plans import workload_queries as w

    d, vectors = rasters
    asked = {(r.o_orderkey % 8, r.o_orderkey // 8 % 8) for r in spark.read.parquet(f"{d}/orders.parquet").collect()}
    rows = []
    for x, y in asked:
        for idx in range(w.SIZE**2):
            lon = (x + (idx % w.SIZE + 0.5) / w.SIZE) * 45 - 180
            lat = math.degrees(2 * math.atan(math.exp(math.pi * (1 - 2 * (y + (idx // w.SIZE + 0.5) / w.SIZE) / 8))) - math.pi / 2)
            for i in sorted(vectors):  # undated scenes lie by their number
                at = place(i, lon, lat)
                if at:
                    c, r = (min(max(v, 0), 7) for v in at)
                    c0, r0 = int(c), int(r)
                    e, c1, r1 = vectors[i], min(c0 + 1, 7), min(r0 + 1, 7)
                    v = (e[r0 * 8 + c0] * (1 - c + c0) + e[r0 * 8 + c1] * (c - c0)) * (1 - r + r0) + (e[r1 * 8 + c0] * (1 - c + c0) + e[r1 * 8 + c1] * (c - c0)) * (r - r0)
                    rows.append((3, x, y, idx, 1, float(v)))
                    break
            else:
                rows.append((3, x, y, idx, 1, None))
    drawn = {(x, y) for _, x, y, _, _, v in rows if v is not None}
    flat = spark.createDataFrame([r for r in rows if r[1:3] in drawn], "z int, x int, y int, idx int, layer_order int, v double")
    pictures = tiles.images(tiles.mosaic_tile(flat, "first", "viridis"), w.SIZE)
    want = {(r.x, r.y): r.sha for r in pictures.selectExpr("x", "y", "sha2(png, 256) AS sha").collect()}
    got = {(r.x, r.y): r.sha256 for r in QUERIES["tile_pyramid"](spark, d).collect()}
    assert drawn and set(got) == asked and {k: got[k] for k in drawn} == want
    assert len({got[k] for k in asked - drawn}) == 1
