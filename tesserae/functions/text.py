"""Strings, identifiers, dates and requests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.pixel import col

#: File extensions by format.
EXTENSIONS = {"netcdf": ["nc", "nc4", "netcdf"], "hdf5": ["h5", "hdf5", "he5"], "cog": ["tif", "tiff", "cog", "geotiff"]}
#: Media types of assets by format.
MEDIA_TYPES = {"cog": "image/tiff; application=geotiff; profile=cloud-optimized", "icechunk": "application/vnd+zarr"}


def slugify(text) -> Column:
    """ASCII letters and digits in lower case, runs of '-', '_' and blanks as one '-'; 'service' where nothing is left."""
    s = F.regexp_replace(col(text), r"[^A-Za-z0-9_\s-]", "")
    s = F.regexp_replace(F.lower(F.regexp_replace(s, r"[-_\s]+", "-")), "^-+|-+$", "")
    return F.when(s == "", "service").otherwise(s)


def default_slug(service_id, function_id, custom=None) -> Column:
    own = slugify(F.concat(F.substring(col(service_id).cast("string"), 1, 8), F.lit("-"), F.translate(col(function_id), "_", "-")))
    return own if custom is None else F.when(col(custom).isNotNull(), slugify(custom)).otherwise(own)


def month_key(acquired_at, explicit=None) -> Column:
    """The explicit key if there is one, else the month of acquisition, else the current month."""
    month = F.date_format(F.coalesce(col(acquired_at).cast("timestamp"), F.current_timestamp()), "yyyy-MM")
    return month if explicit is None else F.when(F.coalesce(col(explicit), F.lit("")) != "", col(explicit)).otherwise(month)


def object_key(service_id, scene_id, band_role, filename) -> Column:
    base = F.regexp_extract(col(filename), "([^/]*)$", 1)
    ext = F.regexp_extract(base, r"\.([^.]+)$", 1)
    name = F.concat(col(band_role), F.lit("."), F.when(ext == "", "tif").otherwise(ext))
    name = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), "[^A-Za-z0-9._-]", "_")
    return F.concat(F.lit("services/"), col(service_id).cast("string"), F.lit("/scenes/"), col(scene_id).cast("string"), F.lit("/"), F.when(name == "", "upload.tif").otherwise(name))


def purge_time(deleted_at, days: int) -> Column:
    return col(deleted_at) + F.make_dt_interval(F.lit(int(days)))


def tile_key(ids, z, x, y, band=None, rule=None, fmt="png") -> Column:
    """What makes two tile requests the same."""
    return F.concat_ws(
        ":", F.array_join(F.array_sort(col(ids).cast("array<string>")), ","), *[col(c).cast("string") for c in (z, x, y)],
        F.coalesce(col(band), F.lit(1)).cast("string") if band is not None else F.lit("1"), F.coalesce(col(rule), F.lit("")) if rule is not None else F.lit(""), F.lit(fmt) if fmt in ("png", "webp", "jpeg") else col(fmt),
    )


def media_type(fmt) -> Column:
    out = None
    for name, media in MEDIA_TYPES.items():
        out = F.when(col(fmt) == name, media) if out is None else out.when(col(fmt) == name, media)
    return out.otherwise("application/octet-stream")


def epoch_seconds(text) -> Column:
    """Seconds since 1970 of a date and time, 0 where it cannot be read."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(col(text))).cast("double"), F.lit(0.0))


def reference_format(uri) -> Column:
    ext = F.lower(F.regexp_extract(col(uri), r"\.([A-Za-z0-9]+)$", 1))
    out = None
    for name, known in EXTENSIONS.items():
        out = F.when(ext.isin(known), name) if out is None else out.when(ext.isin(known), name)
    return out.otherwise("unknown")


def storage_uri(uri) -> Column:
    """struct(scheme, bucket, key, ref_format, error) of a storage location."""
    u = F.regexp_replace(col(uri), r"^\s+|\s+$", "")
    s3, https = u.startswith("s3://"), u.startswith("https://")
    rest = F.when(s3, F.substring(u, 6, 1 << 30)).when(https, F.substring(u, 9, 1 << 30))
    error = (
        F.when(F.coalesce(u, F.lit("")) == "", "empty").when(u.rlike(r"[\x00-\x1f\x7f-\x9f]"), "control characters").when(s3 & ~rest.contains("/"), "bucket without key")
        .when(https & (rest == ""), "no host").when(u.startswith("http://"), "http is not permitted").when(~(s3 | https), "unknown scheme")
    )
    fine = error.isNull()
    return F.struct(
        F.when(fine, F.when(s3, "s3").otherwise("https")).alias("scheme"), F.when(fine, F.regexp_extract(rest, "^([^/]*)", 1)).alias("bucket"),
        F.when(fine, F.regexp_extract(rest, "^[^/]*/(.*)$", 1)).alias("key"), F.when(fine, reference_format(u)).alias("ref_format"), error.alias("error"),
    )


def split_uri(uri, default_bucket: str) -> Column:
    """struct(bucket, key): of an s3 location, or the default bucket and the text as key."""
    u = col(uri)
    s3 = u.startswith("s3://")
    return F.struct(
        F.when(s3, F.regexp_extract(u, "^s3://([^/]*)", 1)).otherwise(default_bucket).alias("bucket"), F.when(s3, F.regexp_extract(u, "^s3://[^/]*/(.*)$", 1)).otherwise(F.regexp_replace(u, "^/+", "")).alias("key"),
    )


def interval(text) -> Column:
    """struct(start, end, error) of an instant or an interval 'a/b' with '..' for an open end."""
    parts = F.split(col(text), "/")
    side = lambda i: F.when(~F.get(parts, F.lit(i)).isin("..", ""), F.try_to_timestamp(F.get(parts, F.lit(i))))
    one = F.size(parts) == 1
    bad = col(text).isNotNull() & F.exists(parts, lambda p: ~p.isin("..", "") & F.try_to_timestamp(p).isNull()) | (F.size(parts) > 2)
    return F.struct(
        F.when(~bad, side(0)).alias("start"), F.when(~bad, F.when(one, side(0)).otherwise(side(1))).alias("end"), F.when(bad, F.concat(F.lit("unreadable datetime: "), col(text))).alias("error"),
    )


def request_bbox(b) -> Column:
    """struct(x0, y0, x1, y1) of 4 numbers, or of 6 without the heights; NULL otherwise."""
    b = col(b)
    at = lambda i: F.get(b, F.lit(i)).cast("double")
    names = ("x0", "y0", "x1", "y1")
    return F.when(F.size(b) == 6, F.struct(*[at(i).alias(n) for i, n in zip((0, 1, 3, 4), names, strict=True)])).when(F.size(b) == 4, F.struct(*[at(i).alias(n) for i, n in zip((0, 1, 2, 3), names, strict=True)]))


def cloud_ceiling(query: dict | None, cql: dict | None) -> float | None:
    """The cloud-cover ceiling of a search request: the query's lte or <=, else the first of a CQL2 filter, depth first."""
    own = (query or {}).get("eo:cloud_cover") or {}
    for key in ("lte", "<="):
        if own.get(key) is not None:
            return float(own[key])

    def walk(node):
        op, args = node.get("op"), node.get("args", [])
        if op == "and":
            return next((x for x in map(walk, args) if x is not None), None)
        if op in ("<=", "lte"):
            return float(args[1]) if args[0] == {"property": "eo:cloud_cover"} else None
        raise ValueError(f"unsupported filter operator {op!r}")

    return walk(cql) if cql else None


def cloud_ceiling_column(query_json, cql_json=None) -> Column:
    """The same for a table of requests: query text first, then a filter that is a comparison or an 'and' of some."""
    q = lambda p: F.get_json_object(col(query_json), p).cast("double")
    out = [q("$['eo:cloud_cover'].lte"), q("$['eo:cloud_cover']['<=']")]
    if cql_json is not None:
        c = "op string, args array<string>"
        top = F.from_json(col(cql_json), c)
        value = lambda s: F.when(s["op"].isin("<=", "lte") & (F.get_json_object(F.get(s["args"], F.lit(0)), "$.property") == "eo:cloud_cover"), F.get(s["args"], F.lit(1)).cast("double"))
        nested = F.transform(F.when(top["op"] == "and", top["args"]), lambda x: value(F.from_json(x, c)))
        out += [value(top), F.get(F.filter(nested, lambda x: x.isNotNull()), F.lit(0))]
    return F.coalesce(*out)


def point(text) -> Column:
    """struct(lon, lat) of 'lon,lat' or 'POINT(lon lat)'; NULL otherwise."""
    n = r"([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)"
    pair, wkt = rf"^\s*{n}\s*,\s*{n}\s*$", rf"(?i)^\s*POINT\s*\(\s*{n}\s+{n}\s*\)\s*$"
    take = lambda i: F.when(col(text).rlike(pair), F.regexp_extract(col(text), pair, i)).when(col(text).rlike(wkt), F.regexp_extract(col(text), wkt, i)).try_cast("double")
    return F.when(take(1).isNotNull() & take(2).isNotNull(), F.struct(take(1).alias("lon"), take(2).alias("lat")))
