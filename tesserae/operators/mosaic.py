"""Mosaics of layers and alignment of bands, in long form: one row per tile, layer and pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import pixel
from tesserae.functions.pixel import REDUCERS, finite, first_valid


def layer_order() -> Column:
    """1, 2, ... of a tile's layers, newest first."""
    return F.row_number().over(Window.partitionBy("tile_id").orderBy(F.col("acquired_at").desc_nulls_last(), F.col("scene_id")))


def same_size(pixels: DataFrame) -> DataFrame:
    """Without the layers whose size differs from the first layer's (columns tile_id, layer_order, width, height)."""
    first = pixels.groupBy("tile_id").agg(F.min_by(F.struct("width", "height"), "layer_order").alias("_size"))
    return pixels.join(first, "tile_id").where((F.col("width") == F.col("_size.width")) & (F.col("height") == F.col("_size.height"))).drop("_size")


def reduce_layers(pixels: DataFrame, reducer: str, value: str = "v", by: tuple = ("tile_id", "idx"), order: str = "layer_order") -> DataFrame:
    """One value per pixel: first (in layer order), mean, max, min or sum of the finite values; NULL without any."""
    if reducer == "first":
        out = first_valid(value, order)
    elif reducer in REDUCERS:
        out = REDUCERS[reducer](value)
    else:
        raise ValueError(f"unknown reducer {reducer!r}")
    return pixels.groupBy(*by).agg(out.alias(value))


def rule_values(layers: DataFrame, rule: dict, bands: dict, by: tuple = ("tile_id", "idx"), strict: bool = True, order: str = "layer_order") -> DataFrame:
    """by and v: a rule whose mosaics, {"op": "mosaic", "reducer": ..., "service_filter": {column: value}, "value": rule}, are
    operands like any other, over rows of layers (band columns, filter columns and, for the reducer "first", the order).

    Equal mosaics are computed once, and all mosaics that do not hold each other in one aggregate, each over its own layers;
    one inside another is computed first and joined to the layers by pixel. Pixels where no mosaic has a layer are no rows.
    """
    if pixel.has_bare_band(rule):
        raise ValueError("a band of several layers needs a mosaic around it")
    found = pixel.mosaics_of(rule)
    names = {pixel.rule_key(m): f"_mosaic{k}" for k, m in enumerate(found)}
    level: dict[str, int] = {}
    for m in found:
        inner = [pixel.rule_key(x) for x in pixel.mosaics_of(m["value"])] if isinstance(m.get("value"), dict) else []
        level[pixel.rule_key(m)] = 1 + max((level[k] for k in inner), default=0)

    def kept(m: dict) -> Column:
        wanted = m.get("service_filter") or {}
        if not isinstance(wanted, dict):
            raise ValueError("a mosaic's service_filter must be an object")
        out = F.lit(True)
        for name, value in wanted.items():
            out = out & F.coalesce(F.col(name) == value, F.lit(False))
        return out

    def reduced(m: dict) -> Column:
        if "value" not in m and len(bands) != 1:
            raise ValueError("a mosaic of several bands needs a value")
        v = pixel.band_math(m.get("value") or {"band": next(iter(bands))}, bands, strict, mosaics=names)
        v, reducer = F.when(kept(m), v), m.get("reducer", "first")
        if reducer != "first" and reducer not in REDUCERS:
            raise ValueError(f"unknown reducer {reducer!r}")
        return first_valid(v, order) if reducer == "first" else REDUCERS[reducer](v)

    if all(level[pixel.rule_key(m)] == 1 for m in found):
        some = F.lit(False)
        for m in found:
            some = some | kept(m)
        layers = layers.where(some)
    for n in range(1, max(level.values()) + 1):
        own = [reduced(m).alias(names[pixel.rule_key(m)]) for m in found if level[pixel.rule_key(m)] == n]
        before = [F.first(names[k]).alias(names[k]) for k, at in level.items() if at < n]
        out = layers.groupBy(*by).agg(*own, *before)
        layers = layers.drop(*names.values()).join(out, list(by))
    return out.select(*by, pixel.band_math(rule, bands, strict, mosaics=names).alias("v"))


def band_range(pixels: DataFrame, value: str = "v", by: tuple = ("tile_id",)) -> DataFrame:
    v = finite(value).cast("double")
    return pixels.groupBy(*by).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n"))


def aligned(pixels: DataFrame, keys: list, by: tuple = ("tile_id", "idx"), band: str = "band_key", value: str = "v", strict: bool = False) -> DataFrame:
    """One column per wanted band and one row per pixel; a tile without any is no row.

    A tile that has some of the bands but not all ends the job with an error if strict; else it is no row either, and
    missing_bands() tells what it lacks.
    """
    wanted = pixels.where(F.col(band).isin(keys))
    wide = wanted.groupBy(*by).pivot(band, keys).agg(F.first(value, ignorenulls=True))
    there = wanted.groupBy(by[0]).agg(F.count_distinct(F.col(band)).alias("_n"))
    if strict:
        lacking = F.raise_error(F.concat(F.lit("tile "), F.col(by[0]).cast("string"), F.lit(f" lacks one of the bands {keys}")))
        checked = wide.join(there, by[0]).withColumn("_n", F.when(F.col("_n") < len(keys), lacking).otherwise(F.lit("")))
        return checked.where("_n = ''").drop("_n")
    return wide.join(there.where(F.col("_n") == len(keys)).select(by[0]), by[0], "left_semi")


def missing_bands(pixels: DataFrame, keys: list, by: str = "tile_id", band: str = "band_key") -> DataFrame:
    """The tiles that have some but not all of the bands, and what they lack."""
    there = pixels.where(F.col(band).isin(keys)).groupBy(by).agg(F.collect_set(F.col(band).cast("string")).alias("_have"))
    lack = F.array_except(F.array(*[F.lit(str(k)) for k in keys]), "_have")
    return there.select(by, lack.alias("missing")).where(F.size("missing") > 0)
