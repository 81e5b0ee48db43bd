"""Sinks: the monthly statistics table, reports, audit records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ref

# Columns whose content must not reach the audit log, only the first 16 digits of its hash.
HASHED = ("filename", "client_ip", "message", "sql", "prompt")
STATISTICS = (
    "dataset_id string, session_id string, project_id string, column_name string, profiled_at timestamp, data_type string, "
    "semantic_type string, kind string, total_rows bigint, null_count bigint, unique_count bigint, null_rate double, "
    "completeness double, mean double, stddev double, min_val double, max_val double, p25 double, p50 double, p75 double, "
    "skewness double, is_constant boolean, is_high_cardinality boolean, yyyymm int"
)


def statistics_rows(
    columns: DataFrame, dataset_id: str, session_id: str, project_id: str = "", profiled_at: Column | None = None
) -> DataFrame:
    """Rows of the statistics table from a column profile."""
    at = (profiled_at if profiled_at is not None else F.current_timestamp()).cast("timestamp")
    return columns.select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(session_id).alias("session_id"),
        F.lit(project_id).alias("project_id"), "column_name", at.alias("profiled_at"), "data_type",
        "semantic_type", "kind", "total_rows", "null_count", "unique_count", "null_rate", "completeness",
        "mean", "stddev", "min_val", "max_val", "p25", "p50", "p75", "skewness", "is_constant", "is_high_cardinality",
        F.date_format(at, "yyyyMM").cast("int").alias("yyyymm"),
    )


def append_statistics(rows: DataFrame, folder: str) -> None:
    """Appends to ``folder/rows``, partitioned by month; a dataset's rows lie together."""
    (
        rows.repartition("yyyymm")
        .sortWithinPartitions("dataset_id", "column_name")
        .write.mode("append").partitionBy("yyyymm").parquet(f"{folder}/rows")
    )


def delete_dataset(spark: SparkSession, folder: str, dataset_id: str) -> None:
    """Marks all rows written so far for a dataset as deleted (an appended marker, nothing is rewritten)."""
    marker = spark.range(1).select(F.lit(dataset_id).alias("dataset_id"), F.current_timestamp().alias("deleted_at"))
    marker.write.mode("append").parquet(f"{folder}/deleted")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_statistics(spark: SparkSession, folder: str, keep_months: int = 12) -> DataFrame:
    """Live rows: not deleted and not older than the retention; old months are pruned unread."""
    oldest = F.date_format(F.add_months(F.current_date(), -keep_months), "yyyyMM").cast("int")
    rows = spark.read.schema(STATISTICS).parquet(f"{folder}/rows").where(F.col("yyyymm") >= oldest)
    if not _exists(spark, f"{folder}/deleted"):
        return rows
    deleted = (
        spark.read.parquet(f"{folder}/deleted").groupBy(F.col("dataset_id").alias("_id"))
        .agg(F.max("deleted_at").alias("_at"))
    )
    return rows.join(
        deleted, (rows.dataset_id == F.col("_id")) & (rows.profiled_at <= F.col("_at")), "left_anti"
    )


def compact_statistics(spark: SparkSession, folder: str, target: str, keep_months: int = 12) -> None:
    """Live rows rewritten to a new folder, after which the old one may be dropped."""
    append_statistics(read_statistics(spark, folder, keep_months), target)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.json(folder)


def write_report(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Every section of a report below one folder."""
    for name, df in tables.items():
        writer = df.write.format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{folder}/{name}")


def audit_records(df: DataFrame, occurred_at: Column | None = None) -> DataFrame:
    """``audit_id, event_type, occurred_at, record``: null fields dropped, private fields hashed."""
    at = occurred_at if occurred_at is not None else F.current_timestamp()
    fields = []
    for name in df.columns:
        if name == "event_type":
            continue
        if name in HASHED:
            fields.append(F.substring(F.sha2(ref(name).cast("string"), 256), 1, 16).alias(f"{name}_hash"))
        else:
            fields.append(ref(name))
    return df.select(
        F.expr("uuid()").alias("audit_id"),
        F.coalesce("event_type", F.lit("unknown")).alias("event_type"),
        at.alias("occurred_at"),
        F.to_json(F.struct(*fields)).alias("record"),
    )


def append_audit(records: DataFrame, folder: str) -> None:
    records.withColumn("day", F.to_date("occurred_at")).write.mode("append").partitionBy("day").parquet(folder)
