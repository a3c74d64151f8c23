"""Structured Streaming jobs that keep the catalogue and its derived tables current.

Every sink is idempotent: batches are written under keys (job id, tile key, scene id), so a batch that runs again after a
failure leaves the same state.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import text
from tesserae.operators import catalog, models
from tesserae.sources import geotiff, tables

PROGRESS = {"pending": 0.0, "running": 0.5, "succeeded": 1.0, "failed": 1.0}
#: Of a job that has been taken up and not been handed to its process yet.
STARTED = 0.1
STATUS_DAYS, TILE_SECONDS = 7, 3600


# -- S1: new footprints ------------------------------------------------------------------------------------------------
def new_footprints(spark: SparkSession, base: str, schema: T.StructType, assets: DataFrame, files_per_trigger: int = 100) -> DataFrame:
    """A stream of newly written footprints with their scene's assets.

    assets may be a stream too: a footprint then waits in the join's state for assets that come later. With a table, the
    assets there are when the footprint's batch runs count.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(base)
    return notified(stream, assets)


def notified(footprints: DataFrame, assets: DataFrame) -> DataFrame:
    """The batch twin: one row per footprint and asset."""
    return footprints.select("scene_id", "service_id", "acq_month").join(assets.drop("service_id"), "scene_id")


def matched_footprints(footprints: DataFrame, assets: DataFrame, days: int = STATUS_DAYS) -> DataFrame:
    """scene_id, service_id, acq_month and the asset's columns, as a stream: a row as soon as a footprint and an asset of its
    scene have both come, in whichever order and however many batches apart, within so many days.

    footprints and assets are streams (or tables, for one batch). A scene's footprints and assets wait in a state that
    expires; the RocksDB state store is needed, as for status_stream().
    """
    from pyspark.sql.streaming import StatefulProcessor

    own = [f for f in assets.schema.fields if f.name not in ("scene_id", "service_id")]
    names = [f.name for f in own]
    print_fields = ["service_id", "acq_month"]
    prints = footprints.select("scene_id", *print_fields).withColumn("is_asset", F.lit(False))
    both = prints.unionByName(assets.select("scene_id", *names).withColumn("is_asset", F.lit(True)), allowMissingColumns=True)
    footprint_state = T.StructType([footprints.schema[c] for c in print_fields])
    ttl = days * 86_400_000

    def plain(row, fields) -> tuple:
        """A row of pandas as the types of the state have it."""
        whole = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)
        out = []
        for v, f in zip(row, fields, strict=True):
            if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
                out.append(None)
            else:
                out.append(int(v) if isinstance(f.dataType, whole) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v)
        return tuple(out)

    class Match(StatefulProcessor):
        def init(self, handle):
            self.footprints = handle.getListState("footprints", footprint_state, ttlDurationMs=ttl)
            self.assets = handle.getListState("assets", T.StructType(own), ttlDurationMs=ttl)

        def handleInputRows(self, key, rows, timer_values):  # noqa: N802
            old_prints, old_assets = list(self.footprints.get()), list(self.assets.get())
            new_prints, new_assets = [], []
            for pdf in rows:
                is_asset = pdf["is_asset"].astype(bool)
                new_prints += [plain(r, footprint_state) for r in pdf.loc[~is_asset, print_fields].itertuples(index=False)]
                new_assets += [plain(r, own) for r in pdf.loc[is_asset, names].itertuples(index=False)]
            if new_prints:
                self.footprints.appendList(new_prints)
            if new_assets:
                self.assets.appendList(new_assets)
            pairs = [(f, a) for f in new_prints for a in [*old_assets, *new_assets]] + [(f, a) for f in old_prints for a in new_assets]
            yield pd.DataFrame([(key[0], *f, *a) for f, a in pairs], columns=["scene_id", *print_fields, *names])

        def close(self):
            pass

    schema = T.StructType([footprints.schema["scene_id"], *footprint_state.fields, *own])
    return both.groupBy("scene_id").transformWithStateInPandas(Match(), schema, "Append", "ProcessingTime")


# -- S2: derived header rows -----------------------------------------------------------------------------------------
def reactions(assets: DataFrame) -> DataFrame:
    """What a new asset calls for: its header, a cube's metadata, or a warning."""
    return assets.withColumn("reaction", F.when(F.col("format") == "cog", "header").when(F.col("format") == "icechunk", "metadata").otherwise("unknown format"))


def refresh_headers(batch: DataFrame, files: DataFrame, base: str) -> None:
    """Header rows of the batch's images, appended under scene_id; scenes that are there already are replaced."""
    wanted = reactions(batch).where("reaction = 'header'").select("scene_id", F.col("storage_uri").alias("uri"))
    rows = geotiff.headers(files.join(wanted.select("uri").distinct(), "uri", "left_semi")).join(wanted.distinct(), "uri")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_id").parquet(base)


# -- S3: jobs --------------------------------------------------------------------------------------------------------
JOBS = "job_id string, process_id string, params_json string, submitted_at timestamp"


def job_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(JOBS).json(path)


def run_batch(batch: DataFrame, inputs: DataFrame, base: str, known: list | None = None, status: str | None = None) -> None:
    """Runs the batch's jobs, one DataFrame job per process, and writes results and errors by job.

    status names a folder for the jobs' status events, one folder per job too: taken up, handed over, and ended.
    """
    if status:
        _write_status(batch.select("job_id", *_event(1, "running", STARTED)), status)
    rows = models.run_jobs(batch, inputs, known)
    if status:
        _write_status(batch.select("job_id", F.explode(F.array(F.struct(*_event(1, "running", STARTED)), F.struct(*_event(2, "running", PROGRESS["running"])))).alias("e")).select("job_id", "e.*"), status)
    document = F.coalesce("document", F.to_json(F.struct("job_id", "process_id", "error")))
    tables.write_results(rows.withColumn("document", document), base)
    if status:
        state = F.when(F.col("error").isNull(), "succeeded").otherwise("failed")
        steps = F.array(F.struct(*_event(1, "running", STARTED)), F.struct(*_event(2, "running", PROGRESS["running"])), F.struct(*_event(3, state, 1.0, F.col("result_url"), F.col("error"))))
        _write_status(rows.select("job_id", F.explode(steps).alias("e")).select("job_id", "e.*"), status)


def _event(seq: int, state, progress: float, result_url=None, error=None) -> list:
    text_or = lambda c: F.lit(None).cast("string") if c is None else c
    return [F.lit(seq).cast("long").alias("seq"), F.current_timestamp().alias("ts"), (F.lit(state) if isinstance(state, str) else state).alias("state"), F.lit(progress).alias("progress"), text_or(result_url).alias("result_url"), text_or(error).alias("error")]


def _write_status(events: DataFrame, base: str) -> None:
    events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").json(base)


def start(stream: DataFrame, each: Callable[[DataFrame], None], checkpoint: str):
    """Runs each() on every micro-batch until the input is exhausted."""
    return stream.writeStream.foreachBatch(lambda df, _: each(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- S4: job status ----------------------------------------------------------------------------------------------------
STATUS = "job_id long, seq long, ts timestamp, state string, progress double, result_url string, error string"


def status_events(events: DataFrame) -> DataFrame:
    """Events with their progress, or where they have none, that of their state."""
    given, out = F.col("progress").cast("double") if "progress" in events.columns else F.lit(None).cast("double"), F.lit(None).cast("double")
    for state, value in PROGRESS.items():
        out = F.when(F.col("state") == state, value).otherwise(out)
    return events.withColumn("progress", F.coalesce(given, out))


def latest_status(events: DataFrame, now=None, days: int = STATUS_DAYS) -> DataFrame:
    """The last event of each job (by time, then number); none older than the retention where now is given."""
    rest = [c for c in events.columns if c != "job_id"]
    last = events.groupBy("job_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("s")).select("job_id", "s.*")
    return last if now is None else last.where(F.col("ts") > F.lit(now).cast(events.schema["ts"].dataType) - F.make_dt_interval(F.lit(days)))


def status_stream(events: DataFrame, days: int = STATUS_DAYS) -> DataFrame:
    """The same as a stateful stream: the latest event per job, in a state that expires.

    Needs the RocksDB state store; with trigger(availableNow=True) set spark.sql.streaming.noDataMicroBatches.enabled=false.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Latest(StatefulProcessor):
        def init(self, handle):
            self.state = handle.getValueState("latest", "ts timestamp, seq long, state string, progress double", ttlDurationMs=days * 86_400_000)

        def handleInputRows(self, key, rows, timer_values):  # noqa: N802
            best = self.state.get() if self.state.exists() else None
            for pdf in rows:
                for r in pdf[["ts", "seq", "state", "progress"]].itertuples(index=False):
                    own = (pd.Timestamp(r[0]), int(r[1]), r[2], float(r[3]))
                    if best is None or own[:2] > (pd.Timestamp(best[0]), int(best[1])):
                        best = own
            self.state.update((pd.Timestamp(best[0]).to_pydatetime(), int(best[1]), best[2], float(best[3])))
            yield pd.DataFrame([(key[0], *best)], columns=["job_id", "ts", "seq", "state", "progress"])

        def close(self):
            pass

    keyed = events.select("job_id", "seq", "ts", "state", "progress").groupBy("job_id")
    return keyed.transformWithStateInPandas(Latest(), "job_id long, ts timestamp, seq long, state string, progress double", "Update", "ProcessingTime")


# -- S5: tiles -----------------------------------------------------------------------------------------------------------
def due_tiles(requests: DataFrame, rendered: DataFrame, now, ttl: int = TILE_SECONDS) -> DataFrame:
    """Distinct requests whose tile was not rendered within ttl seconds."""
    keyed = requests.withColumn("tile_key", text.tile_key(F.array(F.col("service_id")), "z", "x", "y", "band", "render_rule", "format")).dropDuplicates(["tile_key"])
    fresh = rendered.where(F.col("rendered_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl))).select("tile_key")
    return keyed.join(fresh, "tile_key", "left_anti")


#: Buckets of tile keys in the table of rendered tiles.
KEY_BUCKETS = 64


def _laid_out(tiles: DataFrame) -> DataFrame:
    """With the hour of rendering and a bucket of the key, by which rendered tiles are stored."""
    return tiles.withColumns({"rendered_hour": F.date_format("rendered_at", "yyyy-MM-dd-HH"), "bucket": F.pmod(F.xxhash64("tile_key"), F.lit(KEY_BUCKETS)).cast("int")})


def rendered_tiles(spark: SparkSession, base: str, now, ttl: int = TILE_SECONDS) -> DataFrame:
    """tile_key and rendered_at of the tiles that may still be fresh: only the folders of the last hours are read."""
    since = (now - timedelta(seconds=ttl)).strftime("%Y-%m-%d-%H")
    return spark.read.parquet(base).where(F.col("rendered_hour") >= since).select("tile_key", "rendered_at")


def by_neighbourhood(due: DataFrame, k: int = 3) -> DataFrame:
    """The tiles with those of the same 2^k x 2^k neighbourhood (column block) side by side, so that chips which neighbours
    share are met in one task."""
    block = F.struct("z", F.shiftright("x", k).alias("x"), F.shiftright("y", k).alias("y"))
    return due.withColumn("block", block).repartition("block").sortWithinPartitions("block", "x", "y")


def materialise(batch: DataFrame, rendered: DataFrame, render: Callable[[DataFrame], DataFrame], base: str, now, batch_id: int | None = None) -> None:
    """Renders what is due (render: requests with tile_key -> tile_key, png) and writes it with its time, by hour and bucket of
    the key (see rendered_tiles).

    With the batch_id that foreachBatch hands over, a batch that runs again replaces what it wrote; without, rows are
    appended.
    """
    out = _laid_out(render(by_neighbourhood(due_tiles(batch, rendered, now))).withColumn("rendered_at", F.lit(now).cast("timestamp")))
    if batch_id is None:
        out.write.mode("append").partitionBy("rendered_hour", "bucket").parquet(base)
    else:
        out = out.withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rendered_hour", "batch_id", "bucket").parquet(base)


# -- S6: purge -----------------------------------------------------------------------------------------------------------
def purge_tick(tombstones: DataFrame, lake: dict[str, DataFrame], assets: DataFrame, now, days: int = 7) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """One periodic run: selects what is due and purges it (see catalog.purge)."""
    return catalog.purge(catalog.purgeable(tombstones, now, days), lake, assets, tombstones, now)


def purge_lake_tick(spark: SparkSession, base: str, tombstones: DataFrame, work: str, now, days: int = 7) -> list:
    """One periodic run on the footprint lake itself: rewrites the months of what is due, no others, and names them."""
    return tables.purge_footprints(spark, base, catalog.purgeable(tombstones, now, days), work)


def purge_stream(spark: SparkSession, checkpoint: str, run: Callable[[], None], seconds: int = 3600):
    """A query whose trigger calls run(), which reads the catalogue anew and writes what purge_tick() gives, every so many
    seconds."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda df, _: run()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
