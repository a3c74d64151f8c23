"""Statistics of samples, overall and by zone, and samples of a band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.pixel import finite
from tesserae.operators import ranges


def statistics(value) -> list[Column]:
    """count, sum, mean, min and max of the finite values: 0, 0 and 0.0 without any, and then no extremes."""
    v = finite(value).cast("double")
    total, n = F.coalesce(F.sum(v), F.lit(0.0)), F.count(v)
    return [n.alias("count"), total.alias("sum"), F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")]


def overall(samples: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    return samples.groupBy(*(by or [])).agg(*statistics(value))


def by_zone(points: DataFrame, zones: DataFrame, value: str = "value") -> DataFrame:
    """Statistics of the points (lon, lat, value) in each zone, repeated ones as often as they are; zones have a box or a ring.

    Without a ring a zone's west and south borders belong to it and the others do not, so that zones that share a border
    share no point.
    """
    if "ring" in zones.columns:
        pairs = ranges.points_in_polygons(points, zones.select("zone_id", "ring"))
    else:
        p = points.withColumns({"minx": F.col("lon").cast("double"), "maxx": F.col("lon").cast("double"), "miny": F.col("lat").cast("double"), "maxy": F.col("lat").cast("double")})
        west_south = (F.col("lon") >= F.col("minx")) & (F.col("lon") < F.col("maxx")) & (F.col("lat") >= F.col("miny")) & (F.col("lat") < F.col("maxy"))
        pairs = ranges.rect_join(p, zones).where(west_south)
    found = pairs.groupBy("zone_id").agg(*statistics(value))
    empty = {"count": F.lit(0).cast("long"), "sum": F.lit(0.0), "mean": F.lit(0.0)}
    return zones.select("zone_id").join(found, "zone_id", "left").select("zone_id", *[F.coalesce(F.col(c), empty[c]).alias(c) if c in empty else F.col(c) for c in ("count", "sum", "mean", "min", "max")])


def means(lists: DataFrame, values: str = "values") -> DataFrame:
    """count and mean of each row's array of numbers."""
    good = F.filter(F.col(values).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x))
    n = F.size(good)
    return lists.withColumns({"count": n, "mean": F.coalesce(F.try_divide(F.aggregate(good, F.lit(0.0), lambda a, x: a + x), n), F.lit(0.0))})


def band_samples(pixels: DataFrame, band: int, most: int = 4096, nodata: float | None = None) -> DataFrame:
    """Every step-th valid pixel (asset_id, band, row, col, v) of a band, at most `most` of each asset."""
    good = pixels.where((F.col("band") == band) & finite("v").isNotNull() & (F.lit(True) if nodata is None else F.col("v") != nodata))
    # places from the counts of rows: no task sorts more than one row of pixels
    above = Window.partitionBy("asset_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = good.groupBy("asset_id", "row").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("asset_id", "row", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("asset_id")).alias("total"))
    placed = good.withColumn("k", F.row_number().over(Window.partitionBy("asset_id", "row").orderBy("col")) - 1).join(rows, ["asset_id", "row"])
    pos, step = F.col("before") + F.col("k"), F.greatest(F.lit(1), F.floor(F.col("total") / most))
    return placed.where((pos % step == 0) & (F.floor(pos / step) < most)).select("asset_id", "band", "row", "col", "v")
