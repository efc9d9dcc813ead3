"""Model metadata, parameter counts and training-exposure disclosures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import exposure_label

# Fixed value: the counting method that needs no recount.
CURRENT_METHOD = "embedding_excluded_parameters_v1"


def with_metadata(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """Display metadata by model key; its counts win as a pair when either is set.

    Column-wise coalescing would mix a total from one source with an active count from the
    other, so one condition decides for both counts and their method.
    """
    known = metadata.select(
        "model_key",
        "display_name",
        "short_name",
        F.col("total_params").alias("_total"),
        F.col("active_params").alias("_active"),
        F.col("parameter_count_method").alias("_method"),
        F.col("training_exposure").alias("_exposure"),
    )
    pair = F.coalesce("_total", "_active").isNotNull()

    def chosen(stored: str, measured: str) -> Column:
        return F.when(pair, F.col(stored)).otherwise(F.col(measured)).alias(measured)

    replaced = ("total_params", "active_params", "parameter_count_method", "training_exposure")
    rest = [c for c in results.columns if c not in replaced]
    return results.join(known, "model_key", "left").select(
        *rest,
        "display_name",
        "short_name",
        chosen("_total", "total_params"),
        chosen("_active", "active_params"),
        chosen("_method", "parameter_count_method"),
        F.coalesce("_exposure", "training_exposure").alias("training_exposure"),
    )


def registry_by_model(registry: DataFrame) -> DataFrame:
    """(model_key, registered) from disclosure groups keyed by lists of model ids."""
    return registry.select(
        F.explode("model_ids").alias("model_key"), F.col("training_exposure").alias("registered")
    )


def with_registry(metadata: DataFrame, registry: DataFrame) -> DataFrame:
    """A registry group fills the exposure of models that declare none."""
    return (
        metadata.join(registry_by_model(registry), "model_key", "left")
        .withColumn("training_exposure", F.coalesce("training_exposure", "registered"))
        .drop("registered")
    )


def exposure_bridge(models: DataFrame) -> DataFrame:
    """One row per disclosed (model, benchmark)."""
    return models.select("model_key", F.explode("training_exposure").alias("entry")).select(
        "model_key", "entry.*"
    )


def exposures_in_scope(bridge: DataFrame, scope: DataFrame) -> DataFrame:
    return bridge.join(scope.select("benchmark_id"), "benchmark_id", "left_semi")


def exposure_coverage(models: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct disclosed benchmarks of each category against its size."""
    sizes = members.groupBy("category").agg(F.count(F.lit(1)).alias("scope_size"))
    return (
        exposure_bridge(models)
        .select("model_key", "benchmark_id")
        .join(members.select("category", "benchmark_id"), "benchmark_id")
        .groupBy("category", "model_key")
        .agg(F.count_distinct("benchmark_id").alias("known"))
        .join(sizes, "category")
    )


def labelled(models: DataFrame) -> DataFrame:
    return models.withColumn("exposure", exposure_label(F.col("training_exposure")))


def needs_recount(total: Column, active: Column, method: Column) -> Column:
    """Equal or nearly equal counts taken with an older method."""
    gap = total - active
    old = ~method.eqNullSafe(F.lit(CURRENT_METHOD))
    return F.coalesce(old & (gap >= 0) & (gap <= F.floor(total / 100)), F.lit(False))


def reconciled_counts(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """Displayed counts per model; conflict when runs disagree and metadata is silent."""
    columns = ("model_key", "total_params", "active_params", "parameter_count_method")
    measured = results.select(*columns).distinct().groupBy("model_key").agg(
        F.count_distinct(F.struct("total_params", "active_params")).alias("pairs"),
        F.min(F.struct("total_params", "active_params", "parameter_count_method")).alias("one"),
    )
    set_by_hand = F.coalesce("m_total", "m_active").isNotNull()
    known = metadata.select(
        "model_key",
        F.col("total_params").alias("m_total"),
        F.col("active_params").alias("m_active"),
        F.col("parameter_count_method").alias("m_method"),
    )
    joined = measured.join(known, "model_key", "left")
    total = F.when(set_by_hand, F.col("m_total")).otherwise(F.col("one.total_params"))
    active = F.when(set_by_hand, F.col("m_active")).otherwise(F.col("one.active_params"))
    method = F.when(set_by_hand, F.col("m_method")).otherwise(F.col("one.parameter_count_method"))
    conflict = ~set_by_hand & (F.col("pairs") > 1)
    return joined.select(
        "model_key",
        conflict.alias("conflict"),
        F.when(~conflict, total).alias("total_params"),
        F.when(~conflict, active).alias("active_params"),
        F.coalesce(~conflict & needs_recount(total, active, method), F.lit(False)).alias(
            "recount"
        ),
    )
