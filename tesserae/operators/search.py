"""Catalogue search: predicates, one row per scene, order, limit, counts and items."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import spatial, text
from tesserae.functions.pixel import col

DEFAULT_LIMIT, MAX_LIMIT = 10, 10_000


def effective_limit(n: int | None) -> int:
    return min(DEFAULT_LIMIT if n is None else n, MAX_LIMIT)


def overlaps_time(start, end, since, until) -> Column:
    """Scenes without dates match every interval; an open side matches everything."""
    since, until = (F.lit(v) if v is None or isinstance(v, datetime) else col(v) for v in (since, until))
    return (since.isNull() | col(end).isNull() | (col(end) >= since)) & (until.isNull() | col(start).isNull() | (col(start) <= until))


def cloud_at_most(cloud, ceiling) -> Column:
    c = F.lit(ceiling) if ceiling is None or isinstance(ceiling, (int, float)) else col(ceiling)
    return c.isNull() | col(cloud).isNull() | (col(cloud) <= c)


def in_collections(service, wanted: Sequence | None) -> Column:
    return F.lit(True) if wanted is None else col(service).isin(list(wanted)) if wanted else F.lit(False)


def months_between(column: str, since, until) -> Column:
    """Partition predicate that goes with overlaps_time: undated files always stay."""
    out = F.lit(True)
    if since is not None:
        out = out & (F.col(column) >= since.strftime("%Y-%m"))
    if until is not None:
        out = out & (F.col(column) <= until.strftime("%Y-%m"))
    return F.col(column).isNull() | out


def live(scenes: DataFrame, service_deletions: DataFrame, scene_deletions: DataFrame) -> DataFrame:
    """Rows whose service and scene have no tombstone."""
    gone = service_deletions.select("service_id")
    return scenes.join(gone, "service_id", "left_anti").join(scene_deletions.select("scene_id"), "scene_id", "left_anti")


def newest_first() -> list[Column]:
    return [F.col("acquired_at").desc_nulls_last(), F.col("scene_id").asc()]


def distinct_scenes(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(["scene_id"])


def matching(footprints: DataFrame, service_deletions: DataFrame, scene_deletions: DataFrame, bbox=None, since=None, until=None, cloud_max=None, collections=None) -> DataFrame:
    """All scenes that match, without order or limit. Predicates are literals and reach the scan."""
    where = overlaps_time("acquired_at", "acquired_at", since, until) & cloud_at_most("cloud_cover", cloud_max) & in_collections("service_id", collections)
    if bbox is not None:
        where = where & spatial.rect_filter("minx", "miny", "maxx", "maxy", bbox)
    if "acq_month" in footprints.columns and isinstance(since, datetime | None) and isinstance(until, datetime | None):
        where = where & months_between("acq_month", since, until)
    return distinct_scenes(live(footprints.where(where), service_deletions, scene_deletions))


def search(footprints: DataFrame, service_deletions: DataFrame, scene_deletions: DataFrame, bbox=None, since=None, until=None, cloud_max=None, collections=None, limit: int | None = None) -> DataFrame:
    """Scenes that match, newest first, with the number matched before the limit."""
    return limited(matching(footprints, service_deletions, scene_deletions, bbox, since, until, cloud_max, collections), limit)


def limited(found: DataFrame, limit: int | None) -> DataFrame:
    """The first rows in search order and number_matched, counted apart so that only the limited rows are sorted."""
    matched = found.agg(F.count(F.lit(1)).alias("number_matched"))  # one row
    return found.orderBy(*newest_first()).limit(effective_limit(limit)).join(F.broadcast(matched))


def search_request(request: dict) -> dict:
    """Keyword arguments of search() from a request: bbox, datetime, query, filter, collections, limit. Unreadable parts raise."""
    out: dict = {"collections": request.get("collections"), "limit": request.get("limit"), "cloud_max": text.cloud_ceiling(request.get("query"), request.get("filter"))}
    b = request.get("bbox")
    out["bbox"] = None if b is None else (b[0], b[1], b[3], b[4]) if len(b) == 6 else tuple(b) if len(b) == 4 else None
    when = request.get("datetime")
    parts = [None if p in ("..", "") else datetime.fromisoformat(p.replace("Z", "+00:00")).replace(tzinfo=None) for p in when.split("/")] if when else [None]
    if len(parts) > 2:
        raise ValueError(f"unreadable datetime: {when}")
    out["since"], out["until"] = parts[0], parts[-1]
    return out


def batch_search(footprints: DataFrame, requests: DataFrame, service_deletions: DataFrame, scene_deletions: DataFrame) -> DataFrame:
    """search() for a table of requests: request_id, x0, y0, x1, y1, since, until, cloud_max, max_items."""
    from tesserae.operators import ranked, ranges

    boxed = lambda df: df.where(~F.exists(F.array(*[F.col(c).cast("double") for c in ranges._BOX]), lambda x: x.isNull()))
    scenes = boxed(distinct_scenes(live(footprints, service_deletions, scene_deletions))).select("scene_id", *ranges._BOX, "acquired_at", "cloud_cover")
    top = F.least(F.coalesce("max_items", F.lit(DEFAULT_LIMIT)), F.lit(MAX_LIMIT))
    asked = requests.select("request_id", F.col("x0").alias("minx"), F.col("y0").alias("miny"), F.col("x1").alias("maxx"), F.col("y1").alias("maxy"), "since", "until", "cloud_max", top.cast("int").alias("top"))
    w = Window.partitionBy("request_id")
    asked = boxed(asked).withColumn("most", F.greatest(F.max("top").over(w), F.lit(1)))  # rows with one id are ranked together
    found = ranked.first_matches(asked, scenes, footprints)
    order = w.orderBy(F.desc("key"), F.asc("scene_id"))
    every = found.withColumn("rank", F.row_number().over(order)).withColumn("number_matched", F.sum("n").over(w))
    return every.where(F.col("rank") <= F.col("top")).select("request_id", "rank", "scene_id", "number_matched")


def item(service, scene, ring, acquired_at, cloud, role, uri, fmt) -> Column:
    """A STAC item as JSON text."""
    b = spatial.ring_bbox(ring)
    when = F.date_format(col(acquired_at), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.lit("1.0.0").alias("stac_version"), col(scene).cast("string").alias("id"), col(service).cast("string").alias("collection"),
        F.array(b["minx"], b["miny"], b["maxx"], b["maxy"]).alias("bbox"), F.from_json(spatial.ring_geojson(ring), "type string, coordinates array<array<array<double>>>").alias("geometry"),
        F.struct(when.alias("datetime"), col(cloud).alias("eo:cloud_cover")).alias("properties"), F.map_from_arrays(F.array(col(role)), F.array(F.struct(col(uri).alias("href"), text.media_type(fmt).alias("type")))).alias("assets"),
    ))


def counts(found: DataFrame, limit: int | None) -> DataFrame:
    """number_matched before the limit and number_returned after it; found holds every match."""
    n = found.agg(F.count(F.lit(1)).alias("number_matched"))
    return n.withColumn("number_returned", F.least("number_matched", F.lit(effective_limit(limit)).cast("long")))
