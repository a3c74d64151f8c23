"""Processing models: tile functions on named bands, batch processes on tables, and their descriptions."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import params as params_module
from tesserae.operators import zonal
from tesserae.sources import tables

#: Pixels of each band that a tile function gets at once.
BLOCK_PIXELS = 1 << 22
SPEC_SCHEMA = "process_id string, name string, type string, required boolean, default_value string, minimum double, maximum double, direction string"


class TileModel(ABC):
    """One tile in, one tile of the same shape out.

    A model gives compute_tile(), for one tile of each band, or compute_block(), for arrays of (tiles, rows, columns).
    """

    id: str
    version = "1"
    required_bands: list[str] = []

    def parameters(self) -> list[dict]:
        return []

    def compute_tile(self, bands: dict[str, np.ndarray], params: dict, tile: dict) -> np.ndarray:
        raise NotImplementedError(f"{self.id} computes neither tiles nor blocks")

    def compute_block(self, bands: dict[str, np.ndarray], params: list[dict], tiles: pa.RecordBatch) -> np.ndarray:
        """params: those of each tile; tiles: the other columns of the rows."""
        shape = next(iter(bands.values())).shape[1:]
        out = np.empty((len(params), *shape), np.float32)
        for k, (given, tile) in enumerate(zip(params, tiles.to_pylist(), strict=True)):
            got = np.asarray(self.compute_tile({b: v[k] for b, v in bands.items()}, given, tile))
            if got.shape != shape:
                raise ValueError(f"{self.id} returned a tile of shape {got.shape}")
            out[k] = got
        return out


class BatchModel(ABC):
    """A table and parameters in, a table of results out.

    run() gets the rows of all jobs of the process: job_id, params (a map of text: the job's own over the defaults) and the
    input's columns, which are null in the one row of a job without input.
    """

    id: str
    version = "1"

    def parameters(self) -> list[dict]:
        return []

    @abstractmethod
    def run(self, inputs: DataFrame, params: dict) -> DataFrame: ...


class Ndvi(TileModel):
    id, required_bands = "ndvi", ["red", "nir"]

    def parameters(self):
        return [{"name": n, "type": "band", "required": False, "default_value": d} for n, d in (("red_band", "1"), ("nir_band", "2"))]

    def compute_block(self, bands, params, tiles):
        red, nir = bands["red"].astype(np.float64), bands["nir"].astype(np.float64)
        total = nir + red
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.abs(total) < 1.1920929e-07, np.nan, (nir - red) / total).astype(np.float32)


class ScaleBand(TileModel):
    id, required_bands = "scale_band", ["band"]

    def parameters(self):
        return [{"name": "factor", "type": "number", "required": False, "default_value": "1.0", "minimum": 0.0}]

    def compute_block(self, bands, params, tiles):
        factors = np.array([float(p.get("factor", 1.0)) for p in params], np.float32)
        return bands["band"] * factors[:, None, None]


class ZonalStatistics(BatchModel):
    id = "zonal-stats"

    def parameters(self):
        return [{"name": "band", "type": "band", "required": False, "default_value": "1"}]

    def run(self, inputs, params):
        if "band" in inputs.columns:
            inputs = inputs.withColumn("value", F.when(F.col("band") == F.col("params")["band"].try_cast("int"), F.col("value")))
        return zonal.overall(inputs, "value", ["job_id"])


class MeanValues(BatchModel):
    id = "mean-values"

    def parameters(self):
        return [{"name": "values", "type": "number_list", "required": False}]

    def run(self, inputs, params):
        """The mean of the values that a job's parameters list, else of its input's."""
        rows = inputs.groupBy("job_id").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.any_value(F.col("params")["values"]).alias("_given"))
        listed = zonal.means(rows.withColumn("_given", F.from_json("_given", "array<double>")), "_given")
        own = F.col("_given").isNotNull()
        return listed.select("job_id", F.when(own, F.col("count")).otherwise(F.col("n")).cast("long").alias("count"), F.when(own, F.col("mean")).otherwise(F.col("m")).alias("mean"))


BUILT_IN = [Ndvi(), ScaleBand(), ZonalStatistics(), MeanValues()]


def process_key(name: str) -> str:
    """Dashes and underscores are the same in process names."""
    return name.replace("_", "-")


def registry(models=None) -> dict:
    return {process_key(m.id): m for m in (*BUILT_IN, *(models or []))}


def descriptions(spark: SparkSession, models: list, origin: str = "builtin") -> DataFrame:
    rows = [(m.id, m.version, "tile" if isinstance(m, TileModel) else "batch", origin, [p["name"] for p in m.parameters()]) for m in models]
    return spark.createDataFrame(rows, "id string, version string, kind string, origin string, inputs array<string>")


def listed(descriptions: DataFrame) -> DataFrame:
    """One row per id, custom models before built-in ones, in order of id."""
    w = Window.partitionBy("id").orderBy(F.desc(F.col("origin") == "custom"))
    return descriptions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy("id")


def specifications(spark: SparkSession, models: list) -> DataFrame:
    """Parameter specifications as rows for params.violations."""
    rows = [(m.id, p["name"], p["type"], bool(p.get("required")), p.get("default_value"), p.get("minimum"), p.get("maximum"), p.get("direction", "input")) for m in models for p in m.parameters()]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def apply_tiles(tiles: DataFrame, model: TileModel, params: dict | None = None, width: int = 256, out: str = "values", params_col: str | None = None) -> DataFrame:
    """The model on every row; each required band is an array column. A wrong shape or a missing band is an error.

    Bands are read from the Arrow buffers as blocks of tiles of one size, BLOCK_PIXELS at a time; missing pixels are NaN there,
    and NULL again in the result. params_col names a map column whose entries go over params, row by row.
    """
    lacking = [b for b in model.required_bands if b not in tiles.columns]
    if lacking:
        raise ValueError(f"{model.id} needs the bands {lacking}")
    keep = [c for c in tiles.columns if c not in model.required_bands]
    own = dict(params or {})

    def block(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
        bands = {}
        for b in model.required_bands:
            column = batch.column(b)
            bands[b] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1, width)
        n = batch.num_rows
        given = [{**own, **dict(p or [])} for p in batch.column(params_col).to_pylist()] if params_col else [own] * n
        others = batch.select(keep)
        got = np.asarray(model.compute_block(bands, given, others), np.float32)
        if got.shape != (n, size // width, width):
            raise ValueError(f"{model.id} returned tiles of shape {got.shape}")
        flat = got.reshape(-1)
        values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(flat, mask=np.isnan(flat)))
        return pa.RecordBatch.from_arrays([*others.columns, values], names=[*keep, out])

    def run(batches):
        for batch in batches:
            sizes = [batch.column(b).value_lengths().to_numpy(zero_copy_only=False) for b in model.required_bands]
            if any((s != sizes[0]).any() for s in sizes):  # a band that is missing has no length
                raise ValueError(f"{model.id}: a tile's bands are missing or of different sizes")
            at = 0
            while at < batch.num_rows:
                size = int(sizes[0][at])
                if size % width:
                    raise ValueError(f"{model.id}: a tile of {size} pixels is not {width} wide")
                to = min(batch.num_rows, at + max(1, BLOCK_PIXELS // max(size, 1)))
                other = np.flatnonzero(sizes[0][at:to] != size)
                to = at + int(other[0]) if len(other) else to
                yield block(batch.slice(at, to - at), size)
                at = to

    schema = tiles.select(*keep).schema.add(out, T.ArrayType(T.FloatType()))
    return tiles.select(*keep, *[F.col(b).cast("array<float>").alias(b) for b in model.required_bands]).mapInArrow(run, schema)


def virtual_tiles(requests: DataFrame, band_tiles: DataFrame, models=None, width: int = 256) -> DataFrame:
    """Tiles of attached functions: request_id, values, error.

    requests: request_id, function_id, scene_id (the parent's default scene), defaults and overrides (maps of text; the
    latter win) and bands, a map of the function's band names to band numbers. band_tiles: scene_id, band, values. Each
    function runs once over all its requests; a band that the scene lacks, or an unknown function, is an error row.
    """
    known = {k: m for k, m in registry(models).items() if isinstance(m, TileModel)}
    keyed = requests.withColumn("_f", F.translate("function_id", "_", "-")).withColumn("_params", params_module.merged("defaults", params_module.overrides("overrides")))
    empty = F.lit(None).cast("array<float>").alias("values")
    parts = [keyed.where(~F.col("_f").isin(list(known))).select("request_id", empty, F.lit("unknown function").alias("error"))]
    for name, model in known.items():
        own = keyed.where(F.col("_f") == name).select("request_id", "scene_id", "_params", "bands")
        for b in model.required_bands:
            tile = band_tiles.select("scene_id", F.col("band").alias("_band"), F.col("values").alias(b))
            own = own.withColumn("_band", F.col("bands")[b]).join(tile, ["scene_id", "_band"], "left").drop("_band")
        lacking = F.lit(False)
        for b in model.required_bands:
            lacking = lacking | F.col(b).isNull()
        parts.append(own.where(lacking).select("request_id", empty, F.lit("missing band").alias("error")))
        done = apply_tiles(own.where(~lacking).drop("bands", "scene_id"), model, width=width, params_col="_params")
        parts.append(done.select("request_id", "values", F.lit(None).cast("string").alias("error")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_jobs(jobs: DataFrame, inputs: DataFrame, models=None) -> DataFrame:
    """Result rows (job_id, process_id, object_key, result_url, document, error) of a table of jobs.

    Jobs are grouped by process, and each process runs once over the rows of all its jobs, each with its own parameters
    (params_json, where jobs have it) over the process's defaults. A process that is not known, and parameters that its
    specification does not allow, give an error row.
    """
    known = {k: m for k, m in registry(models).items() if isinstance(m, BatchModel)}
    given = F.coalesce("params_json", F.lit("{}")) if "params_json" in jobs.columns else F.lit("{}")
    keyed = jobs.select("job_id", "process_id", F.translate("process_id", "_", "-").alias("_p"), given.alias("params_json"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("object_key", "result_url", "document")]
    parts = [keyed.where(~F.col("_p").isin(list(known))).select("job_id", "process_id", *nothing, F.lit("unknown process").alias("error"))]
    specs = specifications(jobs.sparkSession, list(known.values())).withColumn("process_id", F.translate("process_id", "_", "-"))
    asked = keyed.where(F.col("_p").isin(list(known)))
    unread = F.from_json("params_json", "map<string,string>").isNull()
    wrong = params_module.violations(asked.where(~unread).select("job_id", F.col("_p").alias("process_id"), "params_json"), specs)
    wrong = wrong.unionByName(asked.where(unread).select("job_id", F.lit("params").alias("name"), F.lit("must be an object").alias("message")))
    wrong = wrong.groupBy("job_id").agg(F.concat_ws("; ", F.array_sort(F.collect_set(F.concat_ws(" ", "name", "message")))).alias("error"))
    checked = asked.join(wrong, "job_id", "left")
    parts.append(checked.where("error IS NOT NULL").select("job_id", "process_id", *nothing, "error"))
    for name, model in known.items():
        defaults = {p["name"]: p["default_value"] for p in model.parameters() if p.get("default_value") is not None}
        default = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]) if defaults else F.create_map().cast("map<string,string>")
        own = checked.where((F.col("_p") == name) & F.col("error").isNull()).select("job_id", "process_id", params_module.merged(default, F.from_json("params_json", "map<string,string>")).alias("params"))
        result = model.run(own.drop("process_id").join(inputs, "job_id", "left"), defaults).join(own.drop("params"), "job_id")
        parts.append(tables.result_rows(result, "json").join(own, "job_id").select("job_id", "process_id", "object_key", "result_url", "document", F.lit(None).cast("string").alias("error")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
