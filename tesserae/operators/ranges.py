"""Range joins of rectangles and points on a quadtree of grid cells: equality on cells, then the exact predicate.

A box has a level of its own: the finest whose cells are as large as the box, so that it covers two cells each way. Two boxes
meet at the coarser of their levels, where the larger box is at its own level: boxes in their own cells meet the others'
own cells and ancestors, and ancestors never meet ancestors. Which ancestors are needed is known from the levels that the
other side has, found by one small aggregate of each side. So the candidates of a pair of boxes lie within about the larger
one's size of each other, however unlike the sizes are and however dense the data.

Of the cells that both cover, the one that holds the lower left corner of their overlap gives the pair: once, without a
later search for doubles, and rows that repeat stay as often as they are. Cells with many boxes are joined as shuffled
partitions, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import spatial

#: Degrees of the one cell of level 0; each level halves it, and boxes below the finest cell lie at the finest level.
WORLD, FINEST = 360.0, 20
_BOX = ("minx", "miny", "maxx", "maxy")


def _cell(x: Column, level: Column) -> Column:
    return F.floor((x + 180.0) * F.pow(F.lit(2.0), level) / WORLD)


def _parts(df: DataFrame, prefix: str) -> DataFrame:
    """The rows with their level; boxes that cross the antimeridian are two parts; the box's columns get the prefix."""
    x, y = F.col("minx").cast("double"), F.col("maxx").cast("double")
    part = lambda n, a, c: F.struct(F.lit(n).alias("part"), a.alias("a"), c.alias("c"))
    parts = F.when(x <= y, F.array(part(0, x, y))).otherwise(F.array(part(0, x, F.lit(180.0)), part(1, F.lit(-180.0), y)))
    named = [F.col(c).alias(f"{prefix}{c}") if c in _BOX else F.col(c) for c in df.columns]
    out = df.withColumn("_p", F.explode(parts)).select(*named, *[F.col(f"_p.{c}").alias(f"{prefix}{c}") for c in ("part", "a", "c")])
    low, high = F.col(f"{prefix}miny").cast("double"), F.col(f"{prefix}maxy").cast("double")
    size = F.greatest(F.col(f"{prefix}c") - F.col(f"{prefix}a"), high - low)
    level = F.when(size > 0, F.least(F.greatest(F.floor(F.log2(WORLD / size)), F.lit(0)), F.lit(FINEST))).otherwise(FINEST).cast("int")
    return out.where(low <= high).withColumn(f"{prefix}level", level)


def _levels(parts: DataFrame, prefix: str) -> Column:
    """The levels that the rows have, as one value: at most FINEST + 1 numbers."""
    return parts.agg(F.coalesce(F.collect_set(f"{prefix}level"), F.array().cast("array<int>")).alias("levels")).scalar()


def _listed(parts: DataFrame, prefix: str, others: Column) -> DataFrame:
    """The rows under the cells where they can meet the other side: (met, level, cx, cy).

    met tells whose own level it is: the left's (a box of the right is there at its own level too, or above it), or the
    right's alone.
    """
    own, level = F.col(f"{prefix}level"), F.col("_others")
    above = F.filter(level, lambda k: k < own)
    one = lambda met, k: F.struct(F.lit(met).alias("met"), k.alias("level"))
    if prefix == "l_":
        at = F.concat(F.when(F.array_max(level) >= own, F.array(one("l", own))).otherwise(F.array()), F.transform(above, lambda k: one("r", k)))
    else:
        at = F.concat(
            F.when(F.array_contains(level, own), F.array(one("l", own))).otherwise(F.array()), F.transform(above, lambda k: one("l", k)),
            F.when(F.array_max(level) > own, F.array(one("r", own))).otherwise(F.array()),
        )
    low, high, a, c = (F.col(f"{prefix}{n}") for n in ("miny", "maxy", "a", "c"))
    low, high = low.cast("double"), high.cast("double")
    at_level = parts.withColumn("_others", others).withColumn("_at", F.explode(at)).drop("_others").select("*", F.col("_at.met").alias("met"), F.col("_at.level").alias("level")).drop("_at")
    k = F.col("level")
    across = at_level.withColumn("cx", F.explode(F.sequence(_cell(a, k), _cell(c, k))))
    return across.withColumn("cy", F.explode(F.sequence(_cell(low, k), _cell(high, k))))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows under a common cell, before the exact predicate."""
    a, b = _parts(left, "l_"), _parts(right, "r_")
    return _listed(a, "l_", _levels(b, "r_")).join(_listed(b, "r_", _levels(a, "l_")), ["met", "level", "cx", "cy"])


def rect_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows whose boxes (minx, miny, maxx, maxy) meet, once each; the right side's box keeps its names, the left's
    get l_."""
    met = candidates(left, right)
    meet = (F.col("l_a") <= F.col("r_c")) & (F.col("l_c") >= F.col("r_a")) & (F.col("l_miny") <= F.col("r_maxy")) & (F.col("l_maxy") >= F.col("r_miny"))
    corner = lambda x, y: _cell(F.greatest(F.col(x).cast("double"), F.col(y).cast("double")), F.col("level"))
    first_cell = (corner("l_a", "r_a") == F.col("cx")) & (corner("l_miny", "r_miny") == F.col("cy"))
    # of several parts of the boxes that meet, the first pair counts
    l_cross, r_cross = F.col("l_minx") > F.col("l_maxx"), F.col("r_minx") > F.col("r_maxx")
    first_part = (
        F.when(l_cross & r_cross, (F.col("l_part") == 0) & (F.col("r_part") == 0))
        .when(l_cross, (F.col("l_part") == 0) | (F.col("r_maxx") < F.col("l_minx"))).when(r_cross, (F.col("r_part") == 0) | (F.col("l_maxx") < F.col("r_minx"))).otherwise(True)
    )
    out = met.where(meet & first_cell & first_part)
    names = [f"l_{c}" if c in _BOX else c for c in left.columns]
    return out.select(*names, *[F.col(f"r_{c}").alias(c) if c in _BOX else F.col(c) for c in right.columns])


def polygon_cover(polygons: DataFrame, steps: tuple = (2, 2, 1)) -> DataFrame:
    """The polygons (column ring, in degrees) under cells that share a point with them: level, cx, cy, and whether the cell
    lies inside, so that points in it need no test.

    The first cells are steps[0] levels below the polygon's own, 5 x 5 of its extent at most with the default; those on the
    border are split by the further steps, so that the cells inside stay few and those on the border small.
    """
    box = polygons.withColumn("_b", spatial.ring_bbox("ring")).where(F.col("_b.minx").isNotNull())
    size = F.greatest(F.col("_b.maxx") - F.col("_b.minx"), F.col("_b.maxy") - F.col("_b.miny"))
    own = F.when(size > 0, F.greatest(F.floor(F.log2(WORLD / size)), F.lit(0))).otherwise(FINEST)
    k = F.col("level")
    cells = box.withColumn("level", F.least(own + steps[0], F.lit(FINEST)).cast("int"))
    cells = cells.withColumn("cx", F.explode(F.sequence(_cell(F.col("_b.minx"), k), _cell(F.col("_b.maxx"), k))))
    cells = cells.withColumn("cy", F.explode(F.sequence(_cell(F.col("_b.miny"), k), _cell(F.col("_b.maxy"), k)))).drop("_b")
    cells = _classified(cells.withColumn("inside", F.lit(False)))
    for step in steps[1:]:
        down = F.least(F.lit(step), FINEST - k)
        many = F.pow(F.lit(2), down).cast("long")
        part = lambda c: F.explode(F.when(F.col("inside"), F.array(F.col(c))).otherwise(F.sequence(F.col(c) * many, F.col(c) * many + many - 1)))  # noqa: B023, E731
        split = cells.withColumn("_cx", part("cx")).withColumn("_cy", part("cy"))
        split = split.withColumn("level", F.when(F.col("inside"), k).otherwise(k + down).cast("int")).drop("cx", "cy").withColumnsRenamed({"_cx": "cx", "_cy": "cy"})
        cells = _classified(split)
    return cells


def _classified(cells: DataFrame) -> DataFrame:
    """The cells that share a point with their ring, and whether they lie inside; those known to do are not looked at."""
    step = F.lit(WORLD) / F.pow(F.lit(2.0), F.col("level"))
    x0, y0 = F.col("cx") * step - 180, F.col("cy") * step - 180
    known = cells.withColumn("_known", F.col("inside"))
    border = known.withColumn("inside", F.col("_known") | ~spatial.edges_meet_rect("ring", x0, y0, x0 + step, y0 + step))
    return border.where(F.col("_known") | ~F.col("inside") | spatial.ring_contains("ring", x0, y0)).drop("_known")


def points_in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Pairs of points (lon, lat) and the polygons (ring) that hold them; only points in cells on a border are tested.

    Column names must differ but for the box columns, of which the polygons' stay."""
    cover = polygon_cover(polygons)
    levels = cover.agg(F.coalesce(F.collect_set("level"), F.array().cast("array<int>")).alias("levels")).scalar()
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    at = points.drop(*_BOX).where(lon.isNotNull() & lat.isNotNull()).withColumn("_levels", levels).withColumn("level", F.explode("_levels")).drop("_levels")
    at = at.withColumns({"cx": _cell(lon, F.col("level")), "cy": _cell(lat, F.col("level"))})
    met = at.join(cover, ["level", "cx", "cy"])
    return met.where(F.col("inside") | spatial.ring_contains("ring", lon, lat)).drop("level", "cx", "cy", "inside")


def tile_scenes(tiles: DataFrame, footprints: DataFrame) -> DataFrame:
    """Scenes under each tile (z, x, y). With a ring column, polygons are tested exactly."""
    b = spatial.tile_lonlat("z", "x", "y")
    boxed = tiles.withColumn("_b", b).select("z", "x", "y", F.concat_ws("/", "z", "x", "y").alias("tile"), *[F.col(f"_b.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")])
    out = rect_join(boxed.dropDuplicates(["tile"]), footprints)
    if "ring" in footprints.columns:
        out = out.where(spatial.ring_meets_rect("ring", "l_minx", "l_miny", "l_maxx", "l_maxy"))
    return out


def point_scenes(points: DataFrame, footprints: DataFrame, margin: float = 0.001) -> DataFrame:
    """Scenes whose box lies within margin degrees of each point (point_id, lon, lat)."""
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    boxed = points.withColumns({"minx": lon - margin, "miny": lat - margin, "maxx": lon + margin, "maxy": lat + margin})
    return rect_join(boxed, footprints)


def point_counts(points: DataFrame, footprints: DataFrame, margin: float = 0.001) -> DataFrame:
    """point_id, n and first_scene: how many scenes point_scenes gives each point, and the smallest scene_id.

    Equal boxes are counted before the join and each place is joined once, so that pairs grow with different boxes and places,
    not with scenes and points.
    """
    boxes = footprints.groupBy(*_BOX).agg(F.count(F.lit(1)).alias("n"), F.min("scene_id").alias("first_scene"))
    met = point_scenes(points.select("lon", "lat").distinct(), boxes, margin).groupBy("lon", "lat").agg(F.sum("n").alias("n"), F.min("first_scene").alias("first_scene"))
    return points.select("point_id", "lon", "lat").join(met, ["lon", "lat"]).groupBy("point_id").agg(F.sum("n").alias("n"), F.min("first_scene").alias("first_scene"))
