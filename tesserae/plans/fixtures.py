"""Views over the test tables that play the catalogue's and the rasters' part, in Spark's and DuckDB's SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "fx_footprints": """SELECT o_orderkey AS scene_id, o_custkey AS service_id, ((o_orderkey * 37) % 3500) / 1e1 - 175 AS minx, ((o_orderkey * 53) % 1600) / 1e1 - 80 AS miny,
      ((o_orderkey * 37) % 3500) / 1e1 - 174 + (o_orderkey % 7) AS maxx, ((o_orderkey * 53) % 1600) / 1e1 - 79 + (o_orderkey % 5) AS maxy,
      CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS acquired_at, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) END AS cloud_cover, o_orderdate AS created_at FROM orders""",
    "fx_assets": """SELECT l_orderkey AS scene_id, l_linenumber AS band_index,
      CASE l_linenumber WHEN 1 THEN 'data' WHEN 2 THEN 'blue' WHEN 3 THEN 'green' WHEN 4 THEN 'red' WHEN 5 THEN 'nir' WHEN 6 THEN 'swir1' ELSE 'swir2' END AS band_role,
      CASE WHEN min(l_suppkey) % 10 = 0 THEN 'icechunk' ELSE 'cog' END AS format, min(l_shipdate) AS created_at FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "fx_scene_deletions": "SELECT event_id AS scene_id, ts AS deleted_at FROM events WHERE event_type = 'error'",
    "fx_service_deletions": "SELECT c_custkey AS service_id, TIMESTAMP '2024-01-15 00:00:00' AS deleted_at FROM customer WHERE c_acctbal < 0",
    "fx_bands": "SELECT l_suppkey AS tile_id, l_orderkey, l_linenumber, l_tax AS red, l_discount AS nir FROM lineitem",
    "fx_zones": """SELECT n_nationkey AS zone_id, (n_nationkey % 5) * 72 - 180e0 AS minx, floor(n_nationkey / 5e0) * 36 - 90e0 AS miny, (n_nationkey % 5) * 72 - 108e0 AS maxx, floor(n_nationkey / 5e0) * 36 - 54e0 AS maxy FROM nation""",
    "fx_points": "SELECT c_custkey AS point_id, ((c_custkey * 71) % 3600) / 1e1 - 180 AS lon, ((c_custkey * 43) % 1800) / 1e1 - 90 AS lat, c_acctbal AS value FROM customer",
    "fx_tiles": "SELECT DISTINCT 3 AS z, CAST(o_orderkey % 8 AS INT) AS x, CAST(floor(o_orderkey / 8e0) % 8 AS INT) AS y FROM orders",
    "fx_job_events": """SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS state, props AS params_json FROM events""",
    "fx_services": "SELECT c_custkey AS id, c_name AS name, concat('svc-', CAST(c_custkey % 40 AS VARCHAR(9))) AS slug, CASE WHEN c_nationkey % 4 = 0 THEN 'icechunk' ELSE 'cog' END AS format FROM customer",
    "fx_virtual": """SELECT s_suppkey AS id, concat('svc-', CAST(s_suppkey % 60 AS VARCHAR(9)), CASE WHEN s_suppkey % 3 = 0 THEN '-ndvi' ELSE '' END) AS slug,
      CASE WHEN s_suppkey % 2 = 0 THEN 'attached' ELSE 'output' END AS service_kind, s_suppkey AS service_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 1 ELSE NULL END AS parent_service_id,
      CASE WHEN s_acctbal < 0 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE NULL END AS deleted_at FROM supplier""",
    "fx_requests": """SELECT s_suppkey AS request_id, ((s_suppkey * 37) % 3500) / 1e1 - 175 AS x0, ((s_suppkey * 53) % 1600) / 1e1 - 80 AS y0, ((s_suppkey * 37) % 3500) / 1e1 - 145 AS x1, ((s_suppkey * 53) % 1600) / 1e1 - 60 AS y1,
      TIMESTAMP '1996-01-01 00:00:00' AS since, TIMESTAMP '1999-06-30 00:00:00' AS until, CAST(s_suppkey % 60 + 20 AS DOUBLE) AS cloud_max, CAST(s_suppkey % 7 + 3 AS INT) AS max_items FROM supplier""",
}
_PX = "SELECT vec_id AS layer_id, label AS tile_id, i AS idx, CASE WHEN (vec_id * 7 + i) % 11 = 0 THEN NULL ELSE v END AS v FROM"
SPARK_PX = f"{_PX} (SELECT vec_id, label, posexplode(embedding) AS (i, v) FROM embeddings)"
DUCK_PX = f"{_PX} (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a table of the given folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = SPARK_PX if name == "fx_px" else VIEWS[name].replace("VARCHAR(9)", "STRING")
    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **{t: view(spark, sf_dir, t) for t in used})


def oracle(sql: str) -> str:
    """The SQL with the views it names as common table expressions."""
    names = [n for n in [*VIEWS, "fx_px"] if re.search(rf"\b{n}\b", sql)]
    ctes = ",\n".join(f"{n} AS ({DUCK_PX if n == 'fx_px' else VIEWS[n]})" for n in names)
    if not ctes:
        return sql
    body = sql.strip()
    return f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"
