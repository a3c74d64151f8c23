"""Catalogue tables, the footprint lake, cubes and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import spatial, text

ASSETS = "array<struct<id:string,band_role:string,band_index:int,format:string,storage_uri:string,crs:string>>"
INLINE_CELLS = 256


def catalog_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """services, scenes, assets, virtual_services or a tombstone table, also as a view of its name."""
    df = spark.read.parquet(f"{base}/{name}")
    df.createOrReplaceTempView(name)
    return df


def footprints(spark: SparkSession, base: str) -> DataFrame:
    """The footprint lake; asset lists that were imported as text are parsed."""
    df = spark.read.parquet(base)
    return df.withColumn("assets", F.from_json("assets_json", ASSETS)).drop("assets_json") if "assets_json" in df.columns else df


def footprint_rows(scenes: DataFrame, assets: DataFrame, explicit_key=None) -> DataFrame:
    """Lake rows of scenes (service_id, scene_id, wkt, acquired_at, cloud_cover) with their assets embedded."""
    listed = assets.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("band_role", "band_index", "format", "storage_uri"))).alias("assets"))
    ring = spatial.wkt_ring("wkt")
    out = scenes.join(listed, "scene_id").withColumn("ring", ring).withColumn("_b", spatial.ring_bbox("ring"))
    return out.select(
        "scene_id", "service_id", "wkt", "ring", *[F.col(f"_b.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")], "cloud_cover", F.col("acquired_at").alias("temporal_start"), F.col("acquired_at").alias("temporal_end"), "acquired_at",
        text.month_key("acquired_at", explicit_key).alias("partition_key"), F.date_format("acquired_at", "yyyy-MM").alias("acq_month"), "assets", F.current_timestamp().alias("inserted_at"),
    )


def append_footprints(rows: DataFrame, base: str, group_rows: int = 20_000) -> None:
    """New files under their month; nothing is rewritten.

    Within a month, files and their row groups (of group_rows rows) follow a space-filling curve through the middles of the
    boxes, so that a search for a small box reads the few groups whose statistics meet it.
    """
    middle = lambda a, b: (F.col(a).cast("double") + F.col(b).cast("double")) / 2
    keyed = rows.withColumn("_curve", spatial.curve_key(middle("minx", "maxx"), middle("miny", "maxy")))
    laid = keyed.repartitionByRange("acq_month", "_curve").sortWithinPartitions("acq_month", "_curve").drop("_curve")
    laid.write.mode("append").option("parquet.block.row.count.limit", group_rows).partitionBy("acq_month").parquet(base)


def purge_footprints(spark: SparkSession, base: str, due: DataFrame, work: str) -> list[str | None]:
    """Rewrites the months of the lake that hold scenes of due (scene_id) without them, and no other; returns those months.

    What stays of these months is written to work first, with the list of them; then their folders are replaced. A run that
    ended between the steps leaves the lake as it was or with some months replaced, and the next call on the same work folder
    ends it, before it looks at due: while work is there, it holds all that the lake may lack.
    """
    done = _finish_purge(spark, base, work)
    lake = spark.read.parquet(base)
    ids = due.select("scene_id").distinct()
    months = [r.acq_month for r in lake.join(ids, "scene_id", "left_semi").select("acq_month").distinct().collect()]  # one row a month
    if not months:
        return done
    named = [m for m in months if m is not None]
    touched = F.col("acq_month").isin(named) | (F.col("acq_month").isNull() if None in months else F.lit(False))
    lake.where(touched).join(ids, "scene_id", "left_anti").write.mode("overwrite").partitionBy("acq_month").parquet(f"{work}/kept")
    spark.createDataFrame([(m,) for m in months], "acq_month string").coalesce(1).write.mode("overwrite").json(f"{work}/months")
    return done + _finish_purge(spark, base, work)


def _finish_purge(spark: SparkSession, base: str, work: str) -> list[str | None]:
    """Replaces the months that work lists, if it is complete, and deletes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(work).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(path(f"{work}/months/_SUCCESS")):
        return []
    months = [r.acq_month for r in spark.read.schema("acq_month string").json(f"{work}/months").collect()]
    kept = spark.read.schema(spark.read.parquet(base).schema).parquet(f"{work}/kept")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("acq_month").parquet(base)
    left = {r.acq_month for r in kept.select("acq_month").distinct().collect()}
    for m in months:
        if m not in left:  # nothing of the month stays
            system.delete(path(f"{base}/acq_month={'__HIVE_DEFAULT_PARTITION__' if m is None else m}"), True)
    # the list goes first: without it a rest of work counts for nothing
    system.delete(path(f"{work}/months"), True)
    system.delete(path(work), True)
    spark.catalog.refreshByPath(base)
    return months


def cube_slice(cube: DataFrame, variable, fixed: dict, dims: list[str], value: str = "value") -> DataFrame:
    """Cells of one variable at the fixed indices; dimensions that are not named are taken at 0."""
    return cube.where((F.col("variable") == variable) & _at(fixed, dims)).select(*dims, value)


def _at(fixed: dict, dims: list[str]) -> Column:
    out = F.lit(True)
    for d in dims:
        if fixed.get(d, 0) is not None:
            out = out & (F.col(d) == fixed.get(d, 0))
    return out


def cube_document(cube: DataFrame, variable, fixed: dict, dims: list[str], value: str = "value") -> DataFrame:
    """n_cells and the values in order of the free dimensions (those fixed to None), or 'truncated' above 256 cells."""
    if not cube.where(F.col("variable") == variable).limit(1).count():
        raise ValueError(f"no variable {variable!r}")
    cells = cube_slice(cube, variable, fixed, dims, value)
    free = [d for d in dims if fixed.get(d, 0) is None]
    n = cells.agg(F.count(F.lit(1)).alias("n_cells"), *[F.countDistinct(d).alias(f"n_{d}") for d in free])
    # only as many cells travel as may be shown
    shown = cells.orderBy(*free).limit(INLINE_CELLS) if free else cells.limit(INLINE_CELLS)
    listed = shown.agg(F.transform(F.array_sort(F.collect_list(F.struct(*free, value))), lambda s: s[value]).alias("values"))
    return n.join(F.broadcast(listed)).withColumn("values", F.when(F.col("n_cells") <= INLINE_CELLS, F.to_json("values")).otherwise(F.lit('"truncated"')))


def result_rows(results: DataFrame, kind: str, template: str = "result.json", subpath: str = "outputs", bucket: str = "results") -> DataFrame:
    """job_id, process_id and payload columns -> object key, location and the enriched JSON document."""
    key = F.concat_ws("/", F.lit(subpath.strip("/")), F.col("job_id").cast("string"), F.lit(template))
    url = F.concat(F.lit(f"s3://{bucket}/"), key)
    return results.select("job_id", key.alias("object_key"), url.alias("result_url"), F.to_json(F.struct(*[F.col(c) for c in results.columns], F.lit(kind).alias("output_kind"), url.alias("result_url"))).alias("document"))


def write_results(rows: DataFrame, base: str) -> None:
    """One folder of JSON text per job; writing a job again replaces its folder alone."""
    rows.select("job_id", F.col("document").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").text(base)
