"""Parameters of processing models: validation, merging and band maps over tables of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.pixel import col

#: spec rows: process_id, name, type, required, default_value (text), minimum, maximum, direction ('input' or 'output')
TYPES = ["band", "band_name", "number", "string", "boolean", "service", "string_list", "number_list"]


def _fails(kind: Column, value: Column) -> Column:
    """What is wrong with a value (JSON text) of a type; NULL if nothing."""
    v = F.try_parse_json(value)
    of = F.schema_of_variant(v)
    number = of.isin("BIGINT", "DOUBLE") | of.startswith("DECIMAL")
    blank = F.trim(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))) == ""
    items = F.try_variant_get(v, "$", "array<variant>")
    item_kinds = F.transform(items, F.schema_of_variant)
    numeric = lambda t: t.isin("BIGINT", "DOUBLE") | t.startswith("DECIMAL")
    return (
        F.when((kind == "band") & ~((of == "BIGINT") & (F.try_variant_get(v, "$", "bigint") >= 1)), "must be a positive band index")
        .when((kind == "band_name") & ((of != "STRING") | blank), "must be a band name").when((kind == "number") & ~number, "must be a number").when((kind == "string") & (of != "STRING"), "must be a string")
        .when((kind == "boolean") & (of != "BOOLEAN"), "must be true or false").when((kind == "service") & ((of != "STRING") | blank), "must name a service")
        .when((kind == "string_list") & (items.isNull() | F.exists(item_kinds, lambda t: t != "STRING")), "must be a list of strings")
        .when((kind == "number_list") & (items.isNull() | (F.size(items) == 0) | F.exists(item_kinds, lambda t: ~numeric(t))), "must be a list of numbers, not empty")
    )


def violations(jobs: DataFrame, specs: DataFrame, allow_unknown: bool = False) -> DataFrame:
    """job_id, name, message: one row for each thing wrong with a job's parameters (job_id, process_id, params_json)."""
    given = jobs.select("job_id", "process_id", F.explode_outer(F.from_json("params_json", "map<string,string>")).alias("name", "value"))
    raw = jobs.select("job_id", "process_id", "params_json", F.map_keys(F.from_json("params_json", "map<string,string>")).alias("keys"))
    inputs = specs.where("direction = 'input'")
    each = raw.join(F.broadcast(inputs), "process_id")  # specifications are a short, declared list
    has = F.array_contains("keys", F.col("name"))
    text = F.to_json(F.variant_get(F.try_parse_json("params_json"), F.lit("$"), "map<string,variant>")[F.col("name")])
    null = has & (F.coalesce(text, F.lit("null")) == "null")
    value = text.try_cast("double")
    message = (
        F.when(~F.coalesce(has, F.lit(False)), F.when(F.col("required") & F.col("default_value").isNull(), "missing")).when(null, F.when(F.col("required"), "must not be null"))
        .otherwise(F.coalesce(
            _fails(F.col("type"), text), F.when((F.col("type") == "number") & (value < F.col("minimum")), F.concat(F.lit("must be >= "), F.col("minimum").cast("string"))),
            F.when((F.col("type") == "number") & (value > F.col("maximum")), F.concat(F.lit("must be <= "), F.col("maximum").cast("string"))),
        ))
    )
    out = each.select("job_id", "name", message.alias("message")).where("message IS NOT NULL")
    if allow_unknown:
        return out
    unknown = given.where("name IS NOT NULL").join(F.broadcast(inputs.select("process_id", "name")), ["process_id", "name"], "left_anti")
    return out.unionByName(unknown.select("job_id", "name", F.lit("unknown parameter").alias("message")))


def _over(low: Column, high: Column) -> Column:
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)


def merged(*maps) -> Column:
    """Maps of text, later ones over earlier ones."""
    filled = [F.coalesce(col(m), F.create_map().cast("map<string,string>")) for m in maps]
    out = filled[0]
    for m in filled[1:]:
        out = _over(out, m)
    return out


def override_type(value) -> Column:
    """integer, number or string: what a query parameter's text is read as."""
    v = col(value)
    return F.when(v.try_cast("bigint").isNotNull() & v.rlike(r"^\s*[+-]?\d+\s*$"), "integer").when(v.try_cast("double").isNotNull(), "number").otherwise("string")


def overrides(query) -> Column:
    """A request's query parameters without format and colormap."""
    return F.map_filter(col(query), lambda k, _: ~k.isin("format", "colormap"))


def band_map(function_id, params_json) -> Column:
    """map of logical band -> band number: NDVI's two bands by parameter, those of others from band_map."""
    p = F.from_json(col(params_json), "red_band int, nir_band int, band_map map<string,int>")
    ndvi = F.create_map(F.lit("red"), F.coalesce(p["red_band"], F.lit(1)), F.lit("nir"), F.coalesce(p["nir_band"], F.lit(2)))
    return F.when(col(function_id) == "ndvi", ndvi).otherwise(F.coalesce(p["band_map"], F.create_map().cast("map<string,int>")))
