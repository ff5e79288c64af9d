"""Writers, and readers of what they wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.text import classify_model
from gaugeframe.functions.timeparse import ts_digits
from gaugeframe.operators.clean import mask_target
from gaugeframe.schemas import TARGET
from gaugeframe.sources.reports import scan_validation_metadata


def window_json(target: Column, ts: Column, samples: Column) -> Column:
    """The document text of a window; a window without a time has a null one."""
    entries = F.transform(samples, lambda s: F.concat(F.lit('"'), s["key"], F.lit('":'), F.to_json(s["v"])))
    head = F.concat(
        F.lit('{"QoE":'),
        F.coalesce(target.cast("string"), F.lit("null")),
        F.lit(',"timestamp":'),
        F.coalesce(ts_digits(ts), F.lit("null")),
    )
    return F.concat(head, F.when(F.size(samples) > 0, F.lit(",")).otherwise(F.lit("")), F.array_join(entries, ","), F.lit("}"))


def sink_windows_json(windows: DataFrame, path: str, per_window: bool = False) -> None:
    """Write window documents as JSON lines.

    ``per_window`` puts every window in a folder named by its time, which makes one file
    per row: meant for exports, not for large tables. Keep large tables in Parquet.
    """
    text = windows.select(
        window_json(F.col(TARGET), F.col("ts"), F.col("samples")).alias("value"), ts_digits(F.col("ts")).alias("window")
    )
    if per_window:
        text.write.partitionBy("window").text(path)
    else:
        text.select("value").write.text(path)


#: Files per document of the validation metadata.
MANIFEST_FILES = 10_000


def sink_validation_pair(
    windows: DataFrame, path: str, created: str | None = None, layout: str = "new", ratio: float | None = None, seed: int | None = None
) -> None:
    """Write the windows with the target, without it, and the metadata documents.

    A metadata document states creation time, format, sample ratio and seed, and maps files to held-out
    targets; there is one per ``MANIFEST_FILES`` files, each in a file of its own, which
    ``scan_validation_metadata`` reads. Of windows with one file name the largest target is stated.
    """
    windows.write.parquet(f"{path}/ground_truth")
    mask_target(windows).drop(f"{TARGET}_truth").write.parquet(f"{path}/inference")
    known = windows.where(F.col(TARGET).isNotNull() & F.col("file").isNotNull()).groupBy("file").agg(F.max(TARGET).alias("ground_truth_qoe"))
    shards = max(-(-windows.count() // MANIFEST_FILES), 1)
    head = {
        "creation_timestamp": ts_digits(F.current_timestamp()) if created is None else F.lit(created), "format": F.lit(layout),
        "sample_ratio": F.lit(ratio).cast("double"), "random_seed": F.lit(seed).cast("long"),
    }
    listed = known.groupBy(F.pmod(F.xxhash64("file"), F.lit(shards)).alias("shard")).agg(
        F.map_from_entries(F.collect_list(F.struct("file", F.struct("ground_truth_qoe")))).alias("files")
    )
    document = F.to_json(F.struct(*[value.alias(name) for name, value in head.items()], "files"), {"ignoreNullFields": "false"})
    listed.select("shard", document.alias("value")).write.partitionBy("shard").text(f"{path}/validation_metadata")


def load_validation_pair(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ground truth windows, masked windows, metadata)."""
    metadata = scan_validation_metadata(spark, f"{path}/validation_metadata").select("file", "ground_truth_qoe")
    return spark.read.parquet(f"{path}/ground_truth"), spark.read.parquet(f"{path}/inference"), metadata


def sink_results_csv(summary: DataFrame, details: DataFrame, path: str) -> None:
    """Summary of all models with their types, and the predictions in one folder per model."""
    typed = summary.withColumn("model_type", classify_model(F.col("model")))
    first = ["model", "model_type"]
    typed.select(*first, *[c for c in summary.columns if c not in first]).write.option("header", True).csv(f"{path}/validation_summary")
    details.write.option("header", True).partitionBy("model").csv(f"{path}/detailed_results")


def append_experiments(runs: DataFrame, path: str) -> None:
    """Append finished configurations to the run table."""
    runs.write.mode("append").parquet(path)


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("col STRING, pos INT, min DOUBLE, max DOUBLE").parquet(path)


def dataset_disk_usage(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Number and total size of the files below a folder; only the listing is read."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return listing.agg(
        F.count("length").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes")
    )
