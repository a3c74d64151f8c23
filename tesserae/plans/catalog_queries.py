"""Queries over catalogue tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tesserae.operators import catalog, ranges, search
from tesserae.plans.book import query
from tesserae.plans.fixtures import view
from tesserae.sources import tables

LIVE = "NOT EXISTS (SELECT 1 FROM fx_service_deletions d WHERE d.service_id = f.service_id) AND NOT EXISTS (SELECT 1 FROM fx_scene_deletions d WHERE d.scene_id = f.scene_id)"
WINDOW = """f.maxx >= -100 AND f.minx <= 100 AND f.maxy >= -50 AND f.miny <= 50 AND (f.acquired_at IS NULL OR f.acquired_at >= TIMESTAMP '1996-01-01 00:00:00')
  AND (f.acquired_at IS NULL OR f.acquired_at <= TIMESTAMP '1998-12-31 00:00:00') AND (f.cloud_cover IS NULL OR f.cloud_cover <= 60)"""
REQUEST = {"bbox": (-100, -50, 100, 50), "since": datetime(1996, 1, 1), "until": datetime(1998, 12, 31), "cloud_max": 60}


def _tombs(s, d):
    return view(s, d, "fx_service_deletions"), view(s, d, "fx_scene_deletions")


@query(f"SELECT scene_id, service_id, acquired_at, cloud_cover, count(*) OVER () AS number_matched FROM fx_footprints f WHERE {WINDOW} AND {LIVE} ORDER BY acquired_at DESC NULLS LAST, scene_id LIMIT 50")
def catalog_search(s, d):
    return search.search(view(s, d, "fx_footprints"), *_tombs(s, d), **REQUEST, limit=50).select("scene_id", "service_id", "acquired_at", "cloud_cover", "number_matched")


@query(f"WITH m AS (SELECT count(*) AS n FROM fx_footprints f WHERE {WINDOW} AND {LIVE}) SELECT n AS number_matched, least(n, 10) AS number_returned FROM m")
def search_counts(s, d):
    return search.counts(search.matching(view(s, d, "fx_footprints"), *_tombs(s, d), **REQUEST), None)


@query(f"SELECT scene_id, service_id FROM fx_footprints f WHERE f.service_id IN (1, 2, 3, 5, 8, 13, 21, 34) AND {LIVE}")
def collection_filter(s, d):
    return search.live(view(s, d, "fx_footprints").where(search.in_collections("service_id", [1, 2, 3, 5, 8, 13, 21, 34])), *_tombs(s, d)).select("scene_id", "service_id")


@query(f"SELECT f.scene_id, f.service_id FROM fx_footprints f WHERE {LIVE}")
def live_scenes(s, d):
    return search.live(view(s, d, "fx_footprints"), *_tombs(s, d)).select("scene_id", "service_id")


@query(f"""WITH p AS (SELECT r.request_id, f.scene_id, r.max_items, row_number() OVER (PARTITION BY r.request_id ORDER BY f.acquired_at DESC NULLS LAST, f.scene_id) AS n, count(*) OVER (PARTITION BY r.request_id) AS m
  FROM fx_requests r JOIN fx_footprints f ON f.minx <= r.x1 AND f.maxx >= r.x0 AND f.miny <= r.y1 AND f.maxy >= r.y0 AND (f.acquired_at IS NULL OR (f.acquired_at >= r.since AND f.acquired_at <= r.until)) AND (f.cloud_cover IS NULL OR f.cloud_cover <= r.cloud_max) WHERE {LIVE})
  SELECT request_id, CAST(n AS INT) AS rank, scene_id, m AS number_matched FROM p WHERE n <= max_items""")
def batch_search(s, d):
    return search.batch_search(view(s, d, "fx_footprints"), view(s, d, "fx_requests"), *_tombs(s, d))


@query("SELECT service_id, arg_min(scene_id, scene_id) FILTER (WHERE n = 1) AS scene_id FROM (SELECT service_id, scene_id, row_number() OVER (PARTITION BY service_id ORDER BY created_at DESC, scene_id) AS n FROM fx_footprints) GROUP BY service_id")
def latest_scenes(s, d):
    return catalog.latest_scene(view(s, d, "fx_footprints")).select("service_id", "scene_id")


PRIMARY = "(SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY (band_role = 'data') DESC, created_at, band_index) AS k FROM fx_assets)"


@query(f"SELECT scene_id, band_role, band_index, format FROM {PRIMARY} WHERE k = 1")
def primary_assets(s, d):
    return catalog.primary_asset(view(s, d, "fx_assets")).select("scene_id", "band_role", "band_index", "format")


@query(f"SELECT l.service_id, l.scene_id, p.band_role FROM (SELECT service_id, scene_id, row_number() OVER (PARTITION BY service_id ORDER BY created_at DESC, scene_id) AS n FROM fx_footprints) l JOIN {PRIMARY} p ON p.scene_id = l.scene_id AND p.k = 1 WHERE l.n = 1")
def default_assets(s, d):
    return catalog.default_asset(view(s, d, "fx_footprints"), view(s, d, "fx_assets")).select("service_id", "scene_id", "band_role")


@query("SELECT f.scene_id, coalesce(string_agg(a.band_role, ',' ORDER BY a.created_at, a.band_role, a.band_index), '') AS roles, count(a.scene_id) AS n FROM fx_footprints f LEFT JOIN fx_assets a ON a.scene_id = f.scene_id GROUP BY f.scene_id")
def enriched_scenes(s, d):
    e = catalog.scenes_with_assets(view(s, d, "fx_footprints"), view(s, d, "fx_assets"))
    return e.select("scene_id", F.array_join(F.transform("assets", lambda a: a["band_role"]), ",").alias("roles"), F.size("assets").cast("long").alias("n"))


@query(f"""SELECT v.id, coalesce(v.parent_service_id, v.service_id) AS parent_id, p.name AS parent_name, a.scene_id, a.band_role FROM fx_virtual v JOIN fx_services p ON p.id = coalesce(v.parent_service_id, v.service_id)
  LEFT JOIN (SELECT l.service_id, l.scene_id, p.band_role FROM (SELECT service_id, scene_id, row_number() OVER (PARTITION BY service_id ORDER BY created_at DESC, scene_id) AS n FROM fx_footprints) l JOIN {PRIMARY} p ON p.scene_id = l.scene_id AND p.k = 1 WHERE l.n = 1) a
  ON a.service_id = p.id WHERE v.deleted_at IS NULL""")
def virtual_parents(s, d):
    defaults = catalog.default_asset(view(s, d, "fx_footprints"), view(s, d, "fx_assets"))
    return catalog.with_parent(view(s, d, "fx_virtual"), view(s, d, "fx_services"), defaults).select("id", "parent_id", "parent_name", "scene_id", "band_role")


@query("""WITH r AS (SELECT scene_id AS request_id, scene_id, unnest(['red', 'green', 'blue']) AS band_role, unnest(['r', 'g', 'b']) AS channel FROM fx_footprints)
  SELECT r.request_id, r.scene_id, r.channel, r.band_role, a.band_index, a.band_index IS NULL AS missing FROM r LEFT JOIN fx_assets a ON a.scene_id = r.scene_id AND a.band_role = r.band_role""")
def composite_roles(s, d):
    r = view(s, d, "fx_footprints").select(F.col("scene_id").alias("request_id"), "scene_id", F.lit("red, green,blue,nir").alias("bands"))
    return catalog.composite_roles(r, view(s, d, "fx_assets"))


@query("SELECT slug, count(*) AS n FROM (SELECT slug FROM fx_virtual WHERE deleted_at IS NULL UNION ALL SELECT slug FROM fx_services) GROUP BY slug")
def slug_namespace(s, d):
    return catalog.slug_namespace(view(s, d, "fx_services"), view(s, d, "fx_virtual")).groupBy("slug").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, slug FROM (SELECT p_partkey, concat('svc-', CAST(p_partkey % 90 AS VARCHAR)) AS slug FROM part) WHERE slug IN (SELECT slug FROM fx_services UNION SELECT slug FROM fx_virtual WHERE deleted_at IS NULL)")
def taken_slugs(s, d):
    c = view(s, d, "part").select("p_partkey", F.concat(F.lit("svc-"), (F.col("p_partkey") % 90).cast("string")).alias("slug"))
    return catalog.slug_exists(c, view(s, d, "fx_services"), view(s, d, "fx_virtual")).select("p_partkey", "slug")


@query("SELECT CAST(id AS VARCHAR) AS id, slug, name, 'base' AS kind FROM fx_services UNION ALL SELECT CAST(id AS VARCHAR), slug, NULL, service_kind FROM fx_virtual WHERE deleted_at IS NULL")
def service_list(s, d):
    return catalog.service_list(view(s, d, "fx_services"), view(s, d, "fx_virtual")).select("id", "slug", "name", "kind")


@query("""WITH a AS (SELECT scene_id, arg_min(format, created_at * 1.0) AS format FROM (SELECT scene_id, format, row_number() OVER (PARTITION BY scene_id ORDER BY created_at, band_index) AS created_at FROM fx_assets) GROUP BY scene_id),
  f AS (SELECT s.service_id, a.format, row_number() OVER (PARTITION BY s.service_id ORDER BY s.created_at, s.scene_id) AS n, count(*) OVER (PARTITION BY s.service_id) AS m FROM fx_footprints s LEFT JOIN a ON a.scene_id = s.scene_id)
  SELECT v.id AS service_id, f.format, coalesce(f.m, 0) AS n_scenes FROM fx_services v LEFT JOIN f ON f.service_id = v.id AND f.n = 1""")
def services_with_scenes(s, d):
    return catalog.services_of_scenes(view(s, d, "fx_services"), view(s, d, "fx_footprints"), view(s, d, "fx_assets")).select("service_id", "format", "n_scenes")


@query("SELECT a.scene_id, a.band_index, a.band_role FROM fx_assets a JOIN fx_footprints f ON f.scene_id = a.scene_id WHERE f.cloud_cover < 5")
def scene_assets(s, d):
    return catalog.assets_of(view(s, d, "fx_footprints").where("cloud_cover < 5"), view(s, d, "fx_assets")).select("scene_id", "band_index", "band_role")


@query("SELECT scene_id, band_index FROM fx_assets WHERE format = 'cog'")
def renderable_assets(s, d):
    return catalog.renderable(view(s, d, "fx_assets")).select("scene_id", "band_index")


@query("SELECT scene_id, band_role, count(*) AS n FROM (SELECT l_orderkey AS scene_id, CASE l_linenumber WHEN 1 THEN 'data' ELSE 'other' END AS band_role FROM lineitem) GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_roles(s, d):
    a = view(s, d, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.when(F.col("l_linenumber") == 1, "data").otherwise("other").alias("band_role"))
    return catalog.duplicate_roles(a)


@query("""WITH c AS (SELECT s_suppkey AS id, concat('svc-', CAST(s_suppkey % 20 AS VARCHAR)) AS base, row_number() OVER (PARTITION BY s_suppkey % 20 ORDER BY s_suppkey) AS k FROM supplier),
  t AS (SELECT DISTINCT base, i, CASE WHEN i = 0 THEN base ELSE concat(base, '-', CAST(i AS VARCHAR)) END AS slug FROM c, range(51) AS r(i)),
  f AS (SELECT base, slug, row_number() OVER (PARTITION BY base ORDER BY i) AS k FROM t WHERE slug NOT IN (SELECT slug FROM fx_services))
  SELECT c.id, c.base, f.slug, CASE WHEN f.slug IS NULL THEN 'no free slug' END AS error FROM c LEFT JOIN f ON f.base = c.base AND f.k = c.k""")
def unique_slugs(s, d):
    c = view(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("svc-"), (F.col("s_suppkey") % 20).cast("string")).alias("base"))
    return catalog.unique_slugs(c, view(s, d, "fx_services")).select("id", "base", "slug", "error")


@query("""WITH n AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 5 ELSE 1000000000 + s_suppkey END AS id, concat('svc-', CAST(s_suppkey % 50 AS VARCHAR)) AS base FROM supplier),
  g AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM n WHERE id NOT IN (SELECT id FROM fx_services)),
  t AS (SELECT DISTINCT base, i, CASE WHEN i = 0 THEN base ELSE concat(base, '-', CAST(i AS VARCHAR)) END AS slug FROM g, range(51) AS r(i)),
  f AS (SELECT base, slug, row_number() OVER (PARTITION BY base ORDER BY i) AS k FROM t WHERE slug NOT IN (SELECT slug FROM fx_services UNION SELECT slug FROM fx_virtual WHERE deleted_at IS NULL))
  SELECT g.id, f.slug FROM g LEFT JOIN f ON f.base = g.base AND f.k = g.k""")
def created_services(s, d):
    """A third of the ids exist already; of the others many want slugs that are taken, or the same one."""
    k = F.col("s_suppkey")
    new = view(s, d, "supplier").select(F.when(k % 3 == 0, k + 5).otherwise(k + 1_000_000_000).alias("id"), F.concat(F.lit("SVC _"), (k % 50).cast("string")).alias("name"))
    return catalog.create_services(new, view(s, d, "fx_services"), view(s, d, "fx_virtual")).select("id", "slug")


@query("""WITH r AS (SELECT s_suppkey AS service_id, concat('out-', CAST(s_suppkey % 13 AS VARCHAR)) AS slug FROM supplier), l AS (SELECT id FROM fx_services v WHERE NOT EXISTS (SELECT 1 FROM fx_service_deletions x WHERE x.service_id = v.id)),
  n AS (SELECT r.*, row_number() OVER (PARTITION BY slug ORDER BY service_id) AS k FROM r)
  SELECT n.service_id, n.slug, CASE WHEN l.id IS NULL THEN 'unknown service' WHEN n.k > 1 THEN 'duplicate slug' END AS error FROM n LEFT JOIN l ON l.id = n.service_id""")
def attached_functions(s, d):
    r = view(s, d, "supplier").select(F.col("s_suppkey").alias("service_id"), F.lit("ndvi").alias("function_id"), F.concat(F.lit("OUT "), (F.col("s_suppkey") % 13).cast("string")).alias("custom_slug"))
    return catalog.attach_functions(r, view(s, d, "fx_services"), view(s, d, "fx_service_deletions"), view(s, d, "fx_virtual")).select("service_id", "slug", "error")


@query("""WITH n AS (SELECT s_suppkey AS id, concat('svc-', CAST(s_suppkey % 70 AS VARCHAR)) AS slug, row_number() OVER (PARTITION BY s_suppkey % 70 ORDER BY s_suppkey) AS k FROM supplier)
  SELECT id, slug, 'output' AS service_kind, CASE WHEN k > 1 OR slug IN (SELECT slug FROM fx_services UNION SELECT slug FROM fx_virtual WHERE deleted_at IS NULL) THEN 'duplicate slug' END AS error FROM n""")
def output_services(s, d):
    new = view(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("svc-"), (F.col("s_suppkey") % 70).cast("string")).alias("slug"))
    return catalog.register_outputs(new, view(s, d, "fx_services"), view(s, d, "fx_virtual"))


@query("""SELECT scene_id, concat_ws('; ', CASE WHEN scene_id % 5 = 0 THEN 'blank geometry' END, CASE WHEN scene_id % 7 = 0 THEN 'scene differs' END, CASE WHEN service_id % 11 = 0 THEN 'service differs' END, CASE WHEN scene_id % 3 = 0 THEN 'no asset' END) AS what
  FROM fx_footprints WHERE scene_id % 5 = 0 OR scene_id % 7 = 0 OR service_id % 11 = 0 OR scene_id % 3 = 0""")
def rejected_footprints(s, d):
    f = view(s, d, "fx_footprints").select(
        "scene_id", "service_id", F.when(F.col("scene_id") % 5 == 0, "  ").otherwise("POLYGON").alias("wkt"), F.when(F.col("scene_id") % 7 == 0, F.lit(-1)).otherwise(F.col("scene_id")).alias("fp_scene_id"),
        F.when(F.col("service_id") % 11 == 0, F.lit(None)).otherwise(F.col("service_id")).alias("fp_service_id"), (F.col("scene_id") % 3).alias("n_assets"),
    )
    return catalog.rejected(f).select("scene_id", F.array_join("violations", "; ").alias("what"))


@query("SELECT f.scene_id FROM fx_footprints f JOIN fx_services v ON v.id = f.service_id WHERE NOT EXISTS (SELECT 1 FROM fx_service_deletions x WHERE x.service_id = f.service_id)")
def addable_scenes(s, d):
    return catalog.addable_scenes(view(s, d, "fx_footprints"), view(s, d, "fx_services"), view(s, d, "fx_service_deletions")).select("scene_id")


@query("""SELECT l_orderkey AS scene_id, string_agg(concat(CASE WHEN l_linenumber = 1 THEN 'data' ELSE l_returnflag END, '@', CAST(l_partkey AS VARCHAR)), ',' ORDER BY l_linenumber, CASE WHEN l_linenumber = 1 THEN 'data' ELSE l_returnflag END, CAST(l_partkey AS VARCHAR)) AS files FROM lineitem GROUP BY l_orderkey""")
def assembled_scenes(s, d):
    u = view(s, d, "lineitem").select(F.lit(1).alias("service_id"), F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("position"), F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("band_role"), F.col("l_partkey").cast("string").alias("uri"), F.lit("w").alias("wkt"))
    a = catalog.assemble_scenes(u)
    return a.select("scene_id", F.array_join(F.transform("assets", lambda x: F.concat(x["band_role"], F.lit("@"), x["uri"])), ",").alias("files"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'icechunk' ELSE 'cog' END AS format, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 3 ELSE 1 END AS band_count,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN 'POLYGON HERE' ELSE 'POLYGON ((-180.0 -90.0, -180.0 90.0, 180.0 90.0, 180.0 -90.0, -180.0 -90.0))' END AS wkt, CASE WHEN c_custkey % 5 = 0 THEN 'http is not permitted' END AS error FROM customer""")
def registered_references(s, d):
    uri = F.concat(F.when(F.col("c_custkey") % 5 == 0, "http://h/").otherwise("https://h/"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, ".NC4").otherwise(".tif"))
    refs = view(s, d, "customer").select("c_custkey", uri.alias("uri"))
    heads = refs.where("c_custkey % 2 = 0").select("uri", F.lit("POLYGON HERE").alias("wkt"), F.lit(3).alias("band_count"))
    return catalog.register_references(refs, heads).select("c_custkey", "format", "band_count", "wkt", "error")


@query("""WITH n AS (SELECT scene_id FROM fx_footprints WHERE scene_id % 4 = 0) SELECT scene_id, deleted_at, 'old' AS reason FROM fx_scene_deletions
  UNION ALL SELECT scene_id, TIMESTAMP '2024-02-01 00:00:00', 'new' FROM n WHERE scene_id NOT IN (SELECT scene_id FROM fx_scene_deletions)""")
def deleted_scenes(s, d):
    t = view(s, d, "fx_scene_deletions").withColumn("reason", F.lit("old"))
    return catalog.delete_scenes(view(s, d, "fx_footprints").where("scene_id % 4 = 0"), t, datetime(2024, 2, 1), "new")


GONE = "SELECT id AS service_id FROM fx_services WHERE id % 3 = 0"


@query(f"""WITH g AS ({GONE}), n AS (SELECT TIMESTAMP '2024-02-01 00:00:00' AS t),
  s AS (SELECT service_id, deleted_at FROM fx_service_deletions), f AS (SELECT scene_id, deleted_at FROM fx_scene_deletions)
  SELECT 'service' AS what, service_id AS id, deleted_at FROM s UNION ALL SELECT 'service', service_id, t FROM g, n WHERE service_id NOT IN (SELECT service_id FROM s)
  UNION ALL SELECT 'scene', scene_id, deleted_at FROM f UNION ALL SELECT DISTINCT 'scene', p.scene_id, t FROM fx_footprints p JOIN g ON g.service_id = p.service_id, n WHERE p.scene_id NOT IN (SELECT scene_id FROM f)
  UNION ALL SELECT 'virtual', v.id, CASE WHEN v.deleted_at IS NULL AND coalesce(v.parent_service_id, v.service_id) IN (SELECT service_id FROM g) THEN t ELSE v.deleted_at END FROM fx_virtual v, n""")
def deleted_services(s, d):
    ids = view(s, d, "fx_services").where("id % 3 = 0").select(F.col("id").alias("service_id"))
    a, b, c = catalog.delete_services(ids, view(s, d, "fx_footprints"), view(s, d, "fx_virtual"), *_tombs(s, d), datetime(2024, 2, 1))
    rows = lambda df, what, key: df.select(F.lit(what).alias("what"), F.col(key).cast("long").alias("id"), "deleted_at")
    return rows(a, "service", "service_id").union(rows(b, "scene", "scene_id")).union(rows(c, "virtual", "id"))


DUE = "SELECT scene_id, deleted_at FROM fx_scene_deletions WHERE deleted_at + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY deleted_at, scene_id LIMIT 20"


@query(DUE)
def purge_selection(s, d):
    return catalog.purgeable(view(s, d, "fx_scene_deletions"), datetime(2024, 1, 20)).select("scene_id", "deleted_at")


@query(f"""WITH g AS (SELECT scene_id FROM ({DUE})) SELECT 'footprint' AS what, CAST(scene_id AS VARCHAR) AS name FROM fx_footprints WHERE scene_id NOT IN (SELECT scene_id FROM g)
  UNION ALL SELECT 'asset', concat(scene_id, '/', band_role) FROM fx_assets WHERE scene_id NOT IN (SELECT scene_id FROM g) UNION ALL SELECT 'stamped', CAST(scene_id AS VARCHAR) FROM g
  UNION ALL SELECT 'object', concat('s3://b/', scene_id, '/', band_role) FROM fx_assets WHERE scene_id IN (SELECT scene_id FROM g)""")
def purged(s, d):
    own = F.concat_ws("/", F.col("scene_id").cast("string"), "band_role")
    assets = view(s, d, "fx_assets").withColumn("storage_uri", F.concat(F.lit("s3://b/"), own))
    t = view(s, d, "fx_scene_deletions")
    kept, stamped, uris = catalog.purge(catalog.purgeable(t, datetime(2024, 1, 20)), {"footprints": view(s, d, "fx_footprints"), "assets": assets}, assets, t, datetime(2024, 1, 20))
    rows = lambda df, what, name: df.select(F.lit(what).alias("what"), name.cast("string").alias("name"))
    out = rows(kept["footprints"], "footprint", F.col("scene_id")).union(rows(kept["assets"], "asset", own))
    return out.union(rows(stamped.where("purged_at IS NOT NULL"), "stamped", F.col("scene_id"))).union(rows(uris, "object", F.col("storage_uri")))


TILE_BOX = """SELECT z, x, y, x * 360.0 / 8 - 180 AS a, (x + 1) * 360.0 / 8 - 180 AS c, degrees(2 * atan(exp(pi() * (1 - 2 * (y + 1) / 8.0))) - pi() / 2) AS b, degrees(2 * atan(exp(pi() * (1 - 2 * y / 8.0))) - pi() / 2) AS e FROM fx_tiles"""


@query(f"WITH t AS ({TILE_BOX}) SELECT t.z, t.x, t.y, count(*) AS n, min(f.scene_id) AS first_scene FROM t JOIN fx_footprints f ON f.minx <= t.c AND f.maxx >= t.a AND f.miny <= t.e AND f.maxy >= t.b GROUP BY 1, 2, 3")
def tile_scenes(s, d):
    return ranges.tile_scenes(view(s, d, "fx_tiles"), view(s, d, "fx_footprints")).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("scene_id").alias("first_scene"))


@query("SELECT p.point_id, count(*) AS n, min(f.scene_id) AS first_scene FROM fx_points p JOIN fx_footprints f ON f.minx <= p.lon + 0.001 AND f.maxx >= p.lon - 0.001 AND f.miny <= p.lat + 0.001 AND f.maxy >= p.lat - 0.001 GROUP BY 1")
def point_scenes(s, d):
    return ranges.point_counts(view(s, d, "fx_points"), view(s, d, "fx_footprints"))


@query("""SELECT scene_id, concat('POLYGON ((', CAST(minx AS VARCHAR), ' ', CAST(miny AS VARCHAR)) AS wkt_start, strftime(acquired_at, '%Y-%m') AS acq_month, coalesce(strftime(acquired_at, '%Y-%m'), 'k') AS partition_key, round(minx, 6) AS minx, round(maxy, 6) AS maxy,
  (SELECT count(*) FROM fx_assets a WHERE a.scene_id = f.scene_id) AS n_assets FROM fx_footprints f WHERE scene_id IN (SELECT scene_id FROM fx_assets)""")
def footprint_lake_rows(s, d):
    from tesserae.functions.spatial import rect_wkt

    f = view(s, d, "fx_footprints").withColumn("wkt", rect_wkt("minx", "miny", "maxx", "maxy")).withColumn("key", F.when(F.col("acquired_at").isNull(), "k"))
    a = view(s, d, "fx_assets").withColumn("storage_uri", F.lit("s3://b/k"))
    rows = tables.footprint_rows(f, a, "key")
    return rows.select("scene_id", F.regexp_extract("wkt", "^([^,]*)", 1).alias("wkt_start"), "acq_month", "partition_key", F.round("minx", 6).alias("minx"), F.round("maxy", 6).alias("maxy"), F.size("assets").cast("long").alias("n_assets"))


@query("""SELECT scene_id, CAST(service_id AS VARCHAR) AS collection, strftime(acquired_at, '%Y-%m-%dT%H:%M:%SZ') AS dt, round(minx, 6) AS west, round(maxy, 6) AS north, cloud_cover AS cloud FROM fx_footprints""")
def stac_items(s, d):
    from tesserae.functions.spatial import rect_ring

    f = view(s, d, "fx_footprints").withColumn("ring", rect_ring("minx", "miny", "maxx", "maxy"))
    i = f.select("scene_id", search.item("service_id", "scene_id", "ring", "acquired_at", "cloud_cover", F.lit("data"), F.lit("s3://b/k.tif"), F.lit("cog")).alias("j"))
    g = lambda p: F.get_json_object("j", p)
    return i.select("scene_id", g("$.collection").alias("collection"), g("$.properties.datetime").alias("dt"), F.round(g("$.bbox[0]").cast("double"), 6).alias("west"), F.round(g("$.bbox[3]").cast("double"), 6).alias("north"), g("$.properties['eo:cloud_cover']").cast("double").alias("cloud"))


@query("""SELECT 'service' AS kind, id FROM fx_services WHERE id NOT IN (SELECT service_id FROM fx_service_deletions)
  UNION ALL SELECT 'virtual', id FROM fx_virtual WHERE service_id NOT IN (SELECT service_id FROM fx_service_deletions) AND coalesce(parent_service_id, -1) NOT IN (SELECT service_id FROM fx_service_deletions)
  UNION ALL SELECT 'footprint', scene_id FROM fx_footprints WHERE service_id NOT IN (SELECT service_id FROM fx_service_deletions)
  UNION ALL SELECT 'purged scene', scene_id FROM fx_scene_deletions WHERE scene_id IN (SELECT scene_id FROM fx_footprints WHERE service_id IN (SELECT service_id FROM fx_service_deletions))
  UNION ALL SELECT 'purged service', service_id FROM fx_service_deletions""")
def purged_services(s, d):
    tombs, scenes = view(s, d, "fx_service_deletions"), view(s, d, "fx_footprints")
    due = catalog.purgeable(tombs, datetime(2024, 1, 30), most=2**31 - 1)
    got = catalog.purge_services(due, view(s, d, "fx_services"), view(s, d, "fx_virtual"), scenes, {"footprints": scenes}, tombs, view(s, d, "fx_scene_deletions"), datetime(2024, 1, 30))
    rows = [("service", got["services"], "id"), ("virtual", got["virtual"], "id"), ("footprint", got["footprints"], "scene_id"), ("purged scene", got["scene_tombstones"].where("purged_at IS NOT NULL"), "scene_id"), ("purged service", got["service_tombstones"].where("purged_at IS NOT NULL"), "service_id")]
    parts = [t.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id")) for kind, t, key in rows]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
