"""Catalogue tables: enrichment, validation, naming, creation, deletion and purge as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text

MAX_SUFFIX = 50
PURGE_BATCH = 20


# -- reading ----------------------------------------------------------------------------------------------------------
def asset_list() -> Column:
    return F.array_sort(F.collect_list(F.struct("created_at", "band_role", "band_index", "format")))


def scenes_with_assets(scenes: DataFrame, assets: DataFrame) -> DataFrame:
    """Each scene with its assets, oldest first."""
    listed = assets.groupBy("scene_id").agg(asset_list().alias("assets"))
    return scenes.join(listed, "scene_id", "left").withColumn("assets", F.coalesce("assets", F.array().cast(listed.schema["assets"].dataType)))


def latest_scene(scenes: DataFrame) -> DataFrame:
    w = Window.partitionBy("service_id").orderBy(F.desc("created_at"), "scene_id")
    return scenes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def primary_asset(assets: DataFrame) -> DataFrame:
    """The asset with role data, else the oldest one, of each scene."""
    w = Window.partitionBy("scene_id").orderBy(F.desc(F.col("band_role") == "data"), "created_at", "band_index")
    return assets.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def default_asset(scenes: DataFrame, assets: DataFrame) -> DataFrame:
    """The primary asset of the latest scene of each service."""
    return latest_scene(scenes).select("service_id", "scene_id").join(primary_asset(assets).drop("service_id"), "scene_id")


def with_parent(virtual: DataFrame, services: DataFrame, defaults: DataFrame) -> DataFrame:
    """Active virtual services with their parent and the parent's default asset."""
    parent = F.coalesce("parent_service_id", "service_id")
    own = virtual.where("deleted_at IS NULL").withColumn("parent_id", parent)
    named = services.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return own.join(named, "parent_id").join(defaults.select(F.col("service_id").alias("parent_id"), "scene_id", "band_role", "format"), "parent_id", "left")


def composite_roles(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """request_id, scene_id, bands ('red,green,blue') -> channel r, g, b by position, and whether the role exists."""
    roles = requests.select("request_id", "scene_id", F.posexplode(F.split("bands", ",")).alias("pos", "band_role")).where("pos < 3")
    roles = roles.withColumn("band_role", F.trim("band_role")).withColumn("channel", F.element_at(F.array(*map(F.lit, "rgb")), F.col("pos") + 1))
    found = roles.join(assets.select("scene_id", "band_role", "band_index"), ["scene_id", "band_role"], "left")
    return found.select("request_id", "scene_id", "channel", "band_role", "band_index", F.col("band_index").isNull().alias("missing"))


def slug_namespace(services: DataFrame, virtual: DataFrame) -> DataFrame:
    """All taken slugs: of base services, deleted ones too, and of active virtual ones."""
    return services.select("slug").union(virtual.where("deleted_at IS NULL").select("slug"))


def slug_exists(candidates: DataFrame, services: DataFrame, virtual: DataFrame) -> DataFrame:
    return candidates.join(slug_namespace(services, virtual), "slug", "left_semi")


def service_list(services: DataFrame, virtual: DataFrame) -> DataFrame:
    base = services.select(F.col("id").cast("string").alias("id"), "slug", "name", F.lit("base").alias("kind"))
    other = virtual.where("deleted_at IS NULL").select(F.col("id").cast("string").alias("id"), "slug", F.col("service_kind").alias("kind"))
    return base.unionByName(other, allowMissingColumns=True)


def services_of_scenes(services: DataFrame, scenes: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per service with its format (the first asset's) and number of scenes; services without scenes too."""
    first = assets.groupBy("scene_id").agg(F.min_by("format", F.struct("created_at", "band_index")).alias("format"))
    own = scenes.join(first, "scene_id", "left").groupBy("service_id").agg(F.min_by("format", F.struct("created_at", "scene_id")).alias("format"), F.count(F.lit(1)).alias("n_scenes"))
    return services.select(F.col("id").alias("service_id")).join(own, "service_id", "left").withColumn("n_scenes", F.coalesce("n_scenes", F.lit(0).cast("long")))


def assets_of(scenes: DataFrame, assets: DataFrame) -> DataFrame:
    return scenes.select("scene_id").join(assets, "scene_id")


def renderable(assets: DataFrame) -> DataFrame:
    return assets.where(F.col("format") == "cog")


# -- naming -----------------------------------------------------------------------------------------------------------
def unique_slugs(candidates: DataFrame, taken: DataFrame, key: str = "id", base: str = "base") -> DataFrame:
    """slug of each candidate: base, base-1, ... the first that is free, in order of key; error beyond 50."""
    w = Window.partitionBy(base).orderBy(key)
    ranked = candidates.withColumn("_k", F.row_number().over(w))
    tries = candidates.select(base).distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(MAX_SUFFIX))))
    tries = tries.withColumn("slug", F.when(F.col("_i") == 0, F.col(base)).otherwise(F.concat_ws("-", base, F.col("_i").cast("string"))))
    free = tries.join(taken.select("slug"), "slug", "left_anti").withColumn("_k", F.row_number().over(Window.partitionBy(base).orderBy("_i")))
    out = ranked.join(free.select(base, "_k", "slug"), [base, "_k"], "left")
    return out.withColumn("error", F.when(F.col("slug").isNull(), "no free slug")).drop("_k")


def attach_functions(requests: DataFrame, services: DataFrame, service_deletions: DataFrame, virtual: DataFrame) -> DataFrame:
    """service_id, function_id, custom_slug -> slug and error: unknown service or duplicate slug."""
    named = requests.withColumn("slug", text.default_slug("service_id", "function_id", "custom_slug"))
    known = services.select(F.col("id").alias("service_id"), F.lit(True).alias("_live")).join(service_deletions.select("service_id"), "service_id", "left_anti")
    taken = slug_namespace(services, virtual).distinct().withColumn("_taken", F.lit(True))
    w = Window.partitionBy("slug").orderBy("service_id", "function_id")
    out = named.join(known, "service_id", "left").join(taken, "slug", "left").withColumn("_n", F.row_number().over(w))
    error = F.when(F.col("_live").isNull(), "unknown service").when(F.col("_taken").isNotNull() | (F.col("_n") > 1), "duplicate slug")
    return out.withColumn("error", error).drop("_live", "_taken", "_n")


# -- writing ----------------------------------------------------------------------------------------------------------
def create_services(new: DataFrame, services: DataFrame, virtual: DataFrame) -> DataFrame:
    """Rows to append: ids that exist already are left out, slugs are made unique."""
    fresh = new.join(services.select("id"), "id", "left_anti").dropDuplicates(["id"]).withColumn("base", text.slugify("name"))
    return unique_slugs(fresh, slug_namespace(services, virtual)).drop("base")


def register_outputs(new: DataFrame, services: DataFrame, virtual: DataFrame) -> DataFrame:
    """id, slug -> rows of output services, and an error where the slug is taken."""
    taken = slug_namespace(services, virtual).distinct().withColumn("_taken", F.lit(True))
    w = Window.partitionBy("slug").orderBy("id")
    out = new.withColumn("_n", F.row_number().over(w)).join(taken, "slug", "left")
    return out.select("id", "slug", F.lit("output").alias("service_kind"), F.when(F.col("_taken").isNotNull() | (F.col("_n") > 1), "duplicate slug").alias("error"))


def violations(rows: DataFrame) -> DataFrame:
    """Footprints to append (wkt, scene_id, service_id, fp_scene_id, fp_service_id, n_assets) with what is wrong with them."""
    rules = [
        F.when(F.trim(F.coalesce("wkt", F.lit(""))) == "", "blank geometry"), F.when(~F.col("fp_scene_id").eqNullSafe(F.col("scene_id")), "scene differs"),
        F.when(~F.col("fp_service_id").eqNullSafe(F.col("service_id")), "service differs"), F.when(F.coalesce("n_assets", F.lit(0)) < 1, "no asset"),
    ]
    return rows.withColumn("violations", F.array_compact(F.array(*rules)))


def accepted(rows: DataFrame) -> DataFrame:
    return violations(rows).where(F.size("violations") == 0).drop("violations")


def rejected(rows: DataFrame) -> DataFrame:
    return violations(rows).where(F.size("violations") > 0)


def duplicate_roles(assets: DataFrame) -> DataFrame:
    """(scene_id, band_role) that occur more than once."""
    return assets.groupBy("scene_id", "band_role").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def addable_scenes(scenes: DataFrame, services: DataFrame, service_deletions: DataFrame) -> DataFrame:
    """Scenes whose service exists and is not deleted."""
    known = services.select(F.col("id").alias("service_id")).join(service_deletions.select("service_id"), "service_id", "left_anti")
    return scenes.join(known, "service_id", "left_semi")


def assemble_scenes(uploads: DataFrame) -> DataFrame:
    """Uploaded band files (service_id, scene_id, position, band_role, uri, wkt) as scenes; a plain file has role data."""
    role = F.when(F.coalesce("band_role", F.lit("")) == "", "data").otherwise(F.col("band_role"))
    listed = F.array_sort(F.collect_list(F.struct("position", role.alias("band_role"), "uri")))
    return uploads.where("uri IS NOT NULL").groupBy("service_id", "scene_id").agg(listed.alias("assets"), F.min_by("wkt", "position").alias("wkt")).where(F.size("assets") > 0)


def register_references(references: DataFrame, headers: DataFrame) -> DataFrame:
    """uri references with format, extent and band count: cubes get the world and no bands, images their header's or the world."""
    from tesserae.functions.spatial import rect_wkt

    parsed = references.withColumn("_u", text.storage_uri("uri"))
    cube = F.col("_u.ref_format").isin("netcdf", "hdf5")
    world = rect_wkt(F.lit(-180.0), F.lit(-90.0), F.lit(180.0), F.lit(90.0))
    out = parsed.join(headers.select("uri", F.col("wkt").alias("_wkt"), F.col("band_count").alias("_bands")), "uri", "left")
    fine = F.col("_u.error").isNull()
    return out.select(
        *references.columns, F.when(fine, F.when(cube, "icechunk").otherwise("cog")).alias("format"), F.when(fine, F.when(cube, world).otherwise(F.coalesce("_wkt", world))).alias("wkt"),
        F.when(fine, F.when(cube, 0).otherwise(F.coalesce("_bands", F.lit(1)))).cast("int").alias("band_count"), F.col("_u.error").alias("error"),
    )


def delete_scenes(ids: DataFrame, tombstones: DataFrame, now, reason: str | None = None) -> DataFrame:
    """Tombstones after deleting: one per scene, the earliest deletion stands."""
    fresh = ids.select("scene_id").distinct().join(tombstones.select("scene_id"), "scene_id", "left_anti")
    return tombstones.unionByName(fresh.select("scene_id", F.lit(now).cast(tombstones.schema["deleted_at"].dataType).alias("deleted_at"), F.lit(reason).alias("reason")), allowMissingColumns=True)


def delete_services(ids: DataFrame, scenes: DataFrame, virtual: DataFrame, service_tombs: DataFrame, scene_tombs: DataFrame, now, reason: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Service tombstones, scene tombstones (all scenes of the services too) and virtual services after deleting."""
    fresh = ids.select("service_id").distinct().join(service_tombs.select("service_id"), "service_id", "left_anti")
    services = service_tombs.unionByName(fresh.select("service_id", F.lit(now).cast(service_tombs.schema["deleted_at"].dataType).alias("deleted_at"), F.lit(reason).alias("reason")), allowMissingColumns=True)
    below = scenes.join(ids.select("service_id"), "service_id", "left_semi").select("scene_id")
    hit = ids.select(F.col("service_id").alias("_s")).distinct()
    marked = virtual.join(hit, F.coalesce("parent_service_id", "service_id") == F.col("_s"), "left")
    marked = marked.withColumn("deleted_at", F.when(F.col("_s").isNotNull() & F.col("deleted_at").isNull(), F.lit(now).cast(virtual.schema["deleted_at"].dataType)).otherwise(F.col("deleted_at"))).drop("_s")
    return services, delete_scenes(below, scene_tombs, now, reason), marked


def purgeable(tombstones: DataFrame, now, days: int = 7, most: int = PURGE_BATCH) -> DataFrame:
    """The oldest tombstones whose retention is over and that are not purged yet."""
    due = tombstones.where((text.purge_time("deleted_at", days) <= F.lit(now).cast(tombstones.schema["deleted_at"].dataType)) & (F.col("purged_at").isNull() if "purged_at" in tombstones.columns else F.lit(True)))
    return due.orderBy("deleted_at", tombstones.columns[0]).limit(most)


def purge(due: DataFrame, tables: dict[str, DataFrame], assets: DataFrame, tombstones: DataFrame, now) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Tables without the purged scenes, tombstones stamped, and the storage locations to delete."""
    ids = due.select("scene_id")
    uris = assets.join(ids, "scene_id", "left_semi").select("scene_id", "storage_uri")
    kept = {name: t.join(ids, "scene_id", "left_anti") for name, t in tables.items()}
    stamped = tombstones.join(ids.withColumn("_due", F.lit(True)), "scene_id", "left")
    before = F.col("purged_at") if "purged_at" in tombstones.columns else F.lit(None).cast("timestamp")
    stamped = stamped.withColumn("purged_at", F.when(F.col("_due"), F.lit(now).cast("timestamp")).otherwise(before.cast("timestamp"))).drop("_due")
    return kept, stamped, uris


def purge_services(due: DataFrame, services: DataFrame, virtual: DataFrame, scenes: DataFrame, tables: dict[str, DataFrame], service_tombs: DataFrame, scene_tombs: DataFrame, now) -> dict[str, DataFrame]:
    """The catalogue after services whose retention is over are purged: services and virtual (those of the services and those
    attached to them go), every table of scenes (column scene_id) without the services' scenes, and both kinds of tombstones,
    stamped. due: service_id, from purgeable(). services: id; scenes: scene_id, service_id."""
    ids = due.select("service_id").distinct()
    hit = ids.select(F.col("service_id").alias("_s"))
    gone = scenes.join(ids, "service_id", "left_semi").select("scene_id").distinct()

    def stamped(tombs: DataFrame, key: str, what: DataFrame) -> DataFrame:
        before = F.col("purged_at").cast("timestamp") if "purged_at" in tombs.columns else F.lit(None).cast("timestamp")
        marked = tombs.join(what.withColumn("_due", F.lit(True)), key, "left")
        return marked.withColumn("purged_at", F.when(F.col("_due"), F.lit(now).cast("timestamp")).otherwise(before)).drop("_due")

    return {
        "services": services.join(hit, F.col("id") == F.col("_s"), "left_anti"),
        "virtual": virtual.join(hit, F.col("service_id") == F.col("_s"), "left_anti").join(hit, F.col("parent_service_id") == F.col("_s"), "left_anti"),
        **{name: t.join(gone, "scene_id", "left_anti") for name, t in tables.items()},
        "service_tombstones": stamped(service_tombs, "service_id", ids), "scene_tombstones": stamped(scene_tombs, "scene_id", gone),
    }
