"""Readers for measurement-window JSON.

A window document has the keys ``QoE`` and ``timestamp`` plus one key per sub-sample, named
by a 14-digit time that differs in every file. Schema inference would make a field per key,
so documents are read as text and parsed to a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.numeric import exact_round, try_double
from gaugeframe.functions.timeparse import parse_ts, ts_digits
from gaugeframe.schemas import FLAT_METRICS, FLAT_SCHEMA, META_KEYS, METRICS, TARGET, TIMESTAMP


def scan_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """(file, value) for every ``*.json`` below a folder; pass the folder, not a glob."""
    reader = spark.read.format("text").option("wholetext", not one_per_line)
    if not one_per_line:
        reader = reader.option("pathGlobFilter", "*.json")
    return reader.load(path).select(F.col("_metadata.file_name").alias("file"), "value")


def with_document(df: DataFrame, value: str = "value", doc: str = "doc") -> DataFrame:
    """Parse the text to a map in document order; broken JSON gives NULL."""
    return df.withColumn(doc, F.from_json(value, "map<string,string>"))


def drop_meta_keys(doc: Column) -> Column:
    """Only the sub-sample entries of a document."""
    return F.map_filter(doc, lambda k, _: ~k.isin(*META_KEYS))


def doc_value(doc: Column, key: str) -> Column:
    return F.try_element_at(doc, F.lit(key))


def _samples(doc: Column, metrics: tuple[str, ...]) -> Column:
    """The typed sub-samples in document order; entries that are not objects are none."""
    fields = ", ".join(f"{m} STRING" for m in metrics)

    def typed(entry: Column) -> Column:
        raw = F.from_json(entry["value"], fields)
        return F.struct(
            entry["key"].alias("key"),
            F.struct(*[try_double(raw[m]).alias(m) for m in metrics]).alias("v"),
        )

    objects = F.filter(F.map_entries(drop_meta_keys(doc)), lambda e: F.startswith(F.ltrim(e["value"]), F.lit("{")))
    return F.transform(objects, typed)


def _variant_samples(variant: Column, metrics: tuple[str, ...]) -> Column:
    """The same from a parsed variant, whose keys come sorted; a value that is not an object becomes NULL."""
    fields = ", ".join(f"{m}: DOUBLE" for m in metrics)
    entries = F.map_entries(F.try_variant_get(variant, "$", f"MAP<STRING, STRUCT<{fields}>>"))
    missing = F.lit(None).cast("double")

    def typed(entry: Column) -> Column:
        values = [F.nanvl(entry["value"][m], missing).alias(m) for m in metrics]
        return F.struct(entry["key"].alias("key"), F.struct(*values).alias("v"))

    return F.transform(F.filter(entries, lambda e: ~e["key"].isin(*META_KEYS) & e["value"].isNotNull()), typed)


def to_windows(docs: DataFrame, layout: str = "new", value: str = "value") -> DataFrame:
    """Typed windows from document texts; sub-samples ordered by key as text.

    A document is parsed once, to a variant. The few texts a variant does not take (a bare
    NaN, a repeated key) are parsed through a map instead; broken JSON gives NULLs.
    """
    metrics = METRICS[layout]
    parsed = docs.withColumn("_v", F.try_parse_json(value))
    variant, doc = F.col("_v"), F.from_json(value, "map<string,string>")
    fast = variant.isNotNull()
    staged = parsed.select(
        *[c for c in docs.columns if c not in ("doc", value)],
        F.when(fast, F.try_variant_get(variant, f"$.{TIMESTAMP}", "string")).otherwise(doc_value(doc, TIMESTAMP)).alias("ts_raw"),
        F.when(fast, F.try_variant_get(variant, f"$.{TARGET}", "double"))
        .otherwise(doc_value(doc, TARGET).try_cast("double"))
        .alias("_target"),
        F.array_sort(F.when(fast, _variant_samples(variant, metrics)).otherwise(_samples(doc, metrics))).alias("samples"),
    )
    return staged.select(
        *[c for c in docs.columns if c not in ("doc", value)],
        "ts_raw",
        parse_ts(F.col("ts_raw")).alias("ts"),
        F.nanvl("_target", F.lit(None).cast("double")).alias(TARGET),
        "samples",
    )


def scan_windows(
    spark: SparkSession, path: str, layout: str = "new", one_per_line: bool = False
) -> DataFrame:
    """Typed windows of a folder (file, ts_raw, ts, QoE, samples).

    A document that shares its file with others is named by its own time, as its file would be.
    """
    found = to_windows(scan_documents(spark, path, one_per_line), layout)
    if not one_per_line:
        return found
    return found.withColumn("file", F.coalesce(F.concat(ts_digits(F.col("ts")), F.lit(".json")), "file"))


def scan_windows_legacy(spark: SparkSession, path: str) -> DataFrame:
    """The four-metric layout."""
    return scan_windows(spark, path, "legacy")


def sample_means(samples: Column, metric: str) -> Column:
    """Mean of the present values of one metric, NULL without any."""
    values = F.filter(F.transform(samples, lambda s: s["v"][metric]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), F.size(values))


def collapse_documents(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """One flat row per window: means of the four metrics rounded to 2 digits.

    Missing fields and entries that are not objects are skipped.
    """
    keep = [c for c in docs.columns if c not in (doc, "value")]
    averaged = docs.withColumn("_samples", _samples(F.col(doc), FLAT_METRICS)).select(
        *keep,
        doc_value(F.col(doc), TIMESTAMP).alias("ts_raw"),
        try_double(doc_value(F.col(doc), TARGET)).alias(TARGET),
        *[sample_means(F.col("_samples"), m).alias(f"_{m}") for m in FLAT_METRICS],
    )
    return averaged.select(
        *keep,
        "ts_raw",
        parse_ts(F.col("ts_raw")).alias("ts"),
        TARGET,
        *[exact_round(F.col(f"_{m}"), 2).alias(m) for m in FLAT_METRICS],
    )


def scan_windows_mean(spark: SparkSession, path: str) -> DataFrame:
    return collapse_documents(with_document(scan_documents(spark, path)))


def to_flat(df: DataFrame) -> DataFrame:
    """Coerce flat records read as text: numbers, timestamp, optional time fields.

    Missing ``hour``, ``minute`` and ``day_of_week`` are derived from the timestamp.
    """
    ts = parse_ts(F.col(TIMESTAMP))
    given = lambda name: F.col(name).try_cast("int")
    keep = [c for c in df.columns if c == "file"]
    return df.select(
        *keep,
        *[try_double(F.col(m)).alias(m) for m in FLAT_METRICS],
        try_double(F.col(TARGET)).alias(TARGET),
        ts.alias("ts"),
        F.coalesce(given("hour"), F.hour(ts)).alias("hour"),
        F.coalesce(given("minute"), F.minute(ts)).alias("minute"),
        F.coalesce(given("day_of_week"), F.weekday(ts)).alias("day_of_week"),
    )


def flat_from_text(df: DataFrame, value: str = "value") -> DataFrame:
    keep = [c for c in df.columns if c != value]
    return df.select(*keep, F.from_json(value, FLAT_SCHEMA).alias("_r")).select(*keep, "_r.*")


def scan_flat(spark: SparkSession, path: str) -> DataFrame:
    """Flat JSON records of a folder, one per file."""
    raw = (
        spark.read.schema(FLAT_SCHEMA)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .select("*", F.col("_metadata.file_name").alias("file"))
    )
    return to_flat(raw)


def scan_inference_record(spark: SparkSession, path: str, augmented: bool = False) -> DataFrame:
    """New records to score: the four metrics, collapsed first if they come as windows."""
    rows = scan_windows_mean(spark, path) if augmented else scan_flat(spark, path)
    return rows.select("file", "ts", *FLAT_METRICS)
