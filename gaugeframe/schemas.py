"""Fixed names and schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

TARGET = "QoE"
TIMESTAMP = "timestamp"
META_KEYS = (TARGET, TIMESTAMP)

# The order of the metrics inside one flattened sub-sample, by file layout.
METRICS = {
    "new": ("throughput", "packets_lost", "packet_loss_rate", "jitter", "speed"),
    "legacy": ("packet_loss_rate", "jitter", "throughput", "speed"),
}

# The order in which the per-window statistics follow the flattened metrics.
STAT_METRICS = {
    "new": ("packet_loss_rate", "jitter", "throughput", "speed", "packets_lost"),
    "legacy": ("packet_loss_rate", "jitter", "throughput", "speed"),
}
STATS = ("mean", "std", "min", "max")

# The metrics of a flat record and of a collapsed window.
FLAT_METRICS = ("packet_loss_rate", "jitter", "throughput", "speed")

# Sub-samples per window, and the time format of file names and keys.
SAMPLES_PER_WINDOW = 5
TS_FORMAT = "yyyyMMddHHmmss"


def sample_type(layout: str = "new") -> T.StructType:
    values = T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS[layout]])
    return T.StructType([T.StructField("key", T.StringType()), T.StructField("v", values)])


def feature_names(layout: str = "new", n_samples: int = SAMPLES_PER_WINDOW, stats: bool = False) -> list[str]:
    """f0..fK, followed by <metric>_<stat> when ``stats`` is set."""
    names = [f"f{i}" for i in range(n_samples * len(METRICS[layout]))]
    if stats:
        names += [f"{m}_{s}" for m in STAT_METRICS[layout] for s in STATS]
    return names


# Flat record files. Everything is read as text first and coerced afterwards.
FLAT_SCHEMA = ", ".join(
    f"{c} STRING" for c in (*FLAT_METRICS, TARGET, TIMESTAMP, "hour", "minute", "day_of_week")
)

RESULTS_SCHEMA = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in ("Model", "Model Type", "MSE", "MAE", "R2", "Inference Latency (ms)")
    ]
)

EXPERIMENT_SCHEMA = T.StructType(
    [
        T.StructField("model_type", T.StringType()),
        T.StructField("seq_length", T.IntegerType()),
        T.StructField("hidden_units", T.IntegerType()),
        T.StructField("num_layers", T.IntegerType()),
        T.StructField("dropout_rate", T.DoubleType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("bidirectional", T.BooleanType()),
        T.StructField("num_heads", T.IntegerType()),
        T.StructField("ff_dim", T.IntegerType()),
        T.StructField("test_loss", T.StringType()),
        T.StructField("run_output", T.StringType()),
    ]
)

IMPORTANCE_SCHEMA = (
    "model_name STRING, model_type STRING, "
    "feature_importance ARRAY<STRUCT<feature: STRING, weight: DOUBLE>>, "
    "bias DOUBLE, feature_count INT, sequence_length INT"
)
