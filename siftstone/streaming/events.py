"""Event streams: decode, route, deduplicate, count, track status, profile.

The functions on top take and return streaming (or batch) DataFrames. The
``run_*`` functions drive one available-now pass over a folder of files and
return what the sink holds; their checkpoints lie in the shared folder.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import number, ref
from ..session import new_folder
from ..sources.files import stream_dataset

UPLOADED = (
    "event_id string, event_type string, correlation_id string, causation_id string, occurred_at string, "
    "dataset_id string, storage_key string, filename string, size_bytes bigint, mime_type string"
)
REQUIRED = ("dataset_id", "storage_key")


# ── transformations ─────────────────────────────────────────────────────────


def decode_values(df: DataFrame, value: str, schema: str, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Binary messages to columns plus ``problem`` (null when usable).

    A zero byte and a four-byte schema number may precede the JSON text: number
    0 is JSON. Other numbers mean Avro, which needs the spark-avro package;
    without it they are set aside like unreadable messages.
    """
    raw = ref(value)
    framed = F.hex(F.substring(raw, 1, 1)) == "00"
    number_hex = F.hex(F.substring(raw, 2, 4))
    body = F.when(framed, F.expr(f"substring(`{value}`, 6)")).otherwise(raw)
    parsed = F.from_json(body.cast("string"), schema, {"mode": "PERMISSIVE"})
    out = df.withColumn("_parsed", parsed).withColumn("_avro", framed & (number_hex != "00000000"))
    missing = F.lit(False)
    for name in required:
        missing = missing | F.coalesce(F.col(f"_parsed.{name}") == "", F.lit(True))
    problem = (
        F.when(F.col("_avro"), "avro schema")
        .when(F.to_json("_parsed").isNull() | (F.to_json("_parsed") == "{}"), "unreadable")
        .when(missing, "missing field")
    )
    keep = [ref(c) for c in df.columns if c != value]
    return out.select(*keep, F.col(value), "_parsed.*", problem.alias("problem"))


def route_events(events: DataFrame, topics: Mapping[str, str] = fixed.EVENT_TOPICS) -> DataFrame:
    """Adds ``topic`` and ``partition_key``; event types without a topic are dropped."""
    routes = events.sparkSession.createDataFrame(list(topics.items()), "event_type string, topic string")
    have = set(events.columns)
    keys = [ref(c).cast("string") for c in ("dataset_id", "conversation_id", "correlation_id") if c in have]
    # the route table has one row per event type (sixteen)
    return events.join(F.broadcast(routes), "event_type").withColumn("partition_key", F.coalesce(*keys))


def deduplicate(events: DataFrame, key: str = "event_id", ts: str = "occurred_at", delay: str = "1 hour") -> DataFrame:
    """At-least-once delivery made exactly-once within the delay; state is dropped after it."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def rate_windows(
    requests: DataFrame, client: str, ts: str, window: str = "1 minute", limit: int = 60, delay: str = "10 minutes"
) -> DataFrame:
    """Requests per client and tumbling window, flagged beyond the limit."""
    return (
        requests.withWatermark(ts, delay)
        .groupBy(ref(client).alias("client"), F.window(ref(ts), window).alias("w"))
        .agg(F.count("*").alias("requests"))
        .select(
            "client", F.col("w.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("over_limit")
        )
    )


def metrics_windows(runs: DataFrame, ts: str, window: str = "15 seconds", delay: str = "1 minute") -> DataFrame:
    """Runs, slow runs and total duration per agent and window."""
    return (
        runs.withWatermark(ts, delay)
        .groupBy("agent", F.window(ref(ts), window).alias("w"))
        .agg(
            F.count("*").alias("runs"),
            F.count_if(F.col("duration_ms") > fixed.SLOW_AGENT_MS).alias("slow_runs"),
            F.sum("duration_ms").alias("total_ms"),
        )
        .select("agent", F.col("w.start").alias("window_start"), "runs", "slow_runs", "total_ms")
    )


def latest_status(events: DataFrame, entity: str, status: str, ts: str, event_id: str, keep: str = "7 days") -> DataFrame:
    """Last status per entity and period of ``keep``: ``entity, status, at``. Late events cannot overwrite newer ones.

    State older than ``keep`` is dropped by the watermark; a reader takes the row with the largest ``at`` per entity (``last_of``).
    """
    at = F.struct(ref(ts).alias("ts"), ref(event_id).alias("event_id"))
    return events.withWatermark(ts, keep).groupBy(ref(entity), F.window(ref(ts), keep).alias("_period")).agg(
        F.max_by(ref(status), at).alias("status"), F.max(at).alias("at")
    ).drop("_period")


def last_of(rows: DataFrame, entity: str) -> DataFrame:
    """The newest of the written status rows per entity."""
    return rows.groupBy(ref(entity)).agg(F.max_by("status", "at").alias("status"), F.max("at.ts").alias("updated_at"))


def progress_of(stage: Column) -> Column:
    """Progress percent by finished stage."""
    return F.when(stage == "PROFILING_COMPLETE", 35).when(stage == "CLEANING_COMPLETE", 65)


def due_jobs(events: DataFrame, ready: DataFrame, topic: str = "analytics.cleaning-complete") -> DataFrame:
    """Finished cleaning starts the analysis, unless the dataset is ready already."""
    return events.where((F.col("topic") == topic) & F.col("dataset_id").isNotNull()).join(
        ready.select("dataset_id").distinct(), "dataset_id", "left_anti"
    )


def running_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mergeable statistics per column: counts, moments, range, distinct estimate, quantile sketch."""
    narrow = df.select(*[number(df, c).alias(c) for c in columns])
    long = narrow.unpivot([], [ref(c) for c in columns], "column_name", "value")
    v = F.col("value")
    return long.groupBy("column_name").agg(
        F.count("*").alias("row_count"),
        F.count(v).alias("non_null_count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("stddev"),
        F.min(v).alias("min_val"),
        F.max(v).alias("max_val"),
        F.approx_count_distinct(v).alias("distinct_estimate"),
        F.expr("kll_sketch_agg_double(value)").alias("sketch"),
    )


def sketch_quantile(sketch: str, share: float) -> Column:
    return F.expr(f"kll_sketch_get_quantile_double({sketch}, {float(share)}D)")


def read_kafka(spark: SparkSession, servers: str, topics: Sequence[str], per_batch: int = 100_000) -> DataFrame:
    """Kafka topics from the earliest offset (needs the spark-sql-kafka package on the cluster)."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", per_batch)
        .load()
    )


# ── sinks ───────────────────────────────────────────────────────────────────


def append_to(stream: DataFrame, folder: str, partition_by: Sequence[str] = ()) -> None:
    """One available-now pass into Parquet files (exactly once through the sink's log)."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start(f"{folder}/data").awaitTermination()


def update_to(stream: DataFrame, folder: str, mode: str = "update") -> None:
    """One available-now pass; each batch has its own folder, so a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch={number}")

    (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    )


def consume(
    stream: DataFrame, name: str, handler: Callable[[DataFrame, int], None], folder: str, mode: str = "append", available_now: bool = False
):
    """A named consumer with its own checkpoint. Two consumers of one source are two calls.

    With ``available_now`` it ends when it has read what is there.
    """
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").foreachBatch(handler)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def retried(
    handler: Callable[[DataFrame, int], None], dead_letters: str, attempts: int = 3, wait_seconds: float = 1.0
) -> Callable[[DataFrame, int], None]:
    """A handler that is tried ``attempts`` times, waiting twice as long each time; then the batch is set aside and the stream goes on.

    Set-aside rows go to the Parquet folder ``dead_letters`` with the batch number and the error; a batch that is run again replaces its own.
    """

    def handle(batch: DataFrame, number: int) -> None:
        for attempt in range(1, attempts + 1):
            try:
                return handler(batch, number)
            except Exception as exc:  # noqa: BLE001
                error = f"{type(exc).__name__}: {str(exc)[:500]}"
                if attempt < attempts:
                    time.sleep(wait_seconds * 2 ** (attempt - 1))
        batch.withColumn("error", F.lit(error)).write.mode("overwrite").parquet(f"{dead_letters.rstrip('/')}/batch={number}")

    return handle


def newest(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """Last written row per key over all batches."""
    rows = spark.read.parquet(f"{folder}/data")
    fields = [c for c in rows.columns if c not in {*keys, "batch"}]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("_n")).select(*keys, "_n.*")


# ── runs over a folder of event files ───────────────────────────────────────


def _events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema
    stream = stream_dataset(spark, folder, schema, name_filter=f"{name}.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def run_profile(spark: SparkSession, folder: str, name: str, columns: Sequence[str]) -> DataFrame:
    out = new_folder(spark, "stream-profile")
    update_to(running_profile(_events(spark, folder, name), columns), out, "complete")
    return newest(spark, out, ["column_name"])


def run_rate_windows(spark: SparkSession, folder: str, window: str, limit: int) -> DataFrame:
    out = new_folder(spark, "stream-rate")
    update_to(rate_windows(_events(spark, folder), "event_type", "ts", window, limit), out)
    return newest(spark, out, ["client", "window_start"])


def run_metrics_windows(spark: SparkSession, folder: str) -> DataFrame:
    runs = _events(spark, folder).select(
        "ts", F.col("event_type").alias("agent"), (F.col("value") * 150).alias("duration_ms")
    )
    out = new_folder(spark, "stream-metrics")
    update_to(metrics_windows(runs, "ts"), out)
    return newest(spark, out, ["agent", "window_start"])


STATUS_OF = {
    "signup": "uploaded", "click": "profiling", "view": "profiled", "purchase": "cleaning", "error": "failed",
}
_TYPE_OF = {
    "signup": "DatasetUploaded", "click": "ProfilingCompleted", "view": "CleaningCompleted", "purchase": "MessageAdded",
}


def mapped(column: str, values: Mapping[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out


def run_latest_status(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder).select(
        "event_id", "ts", F.col("user_id").alias("dataset_id"), mapped("event_type", STATUS_OF, "failed").alias("status")
    )
    out = new_folder(spark, "stream-status")
    update_to(latest_status(events, "dataset_id", "status", "ts", "event_id"), out)
    return last_of(spark.read.parquet(f"{out}/data"), "dataset_id").select("dataset_id", "status")


def run_two_consumers(spark: SparkSession, folder: str) -> DataFrame:
    """Two consumers of the same events, each with all of them: ``consumer, event_id, event_type``."""
    out = new_folder(spark, "stream-fan-out")

    def writer(name):
        def write(batch: DataFrame, number: int) -> None:
            rows = batch.select(F.lit(name).alias("consumer"), "event_id", "event_type")
            retried(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/data/consumer_name={name}/batch={n}"), f"{out}/dead")(rows, number)

        return write

    running = [consume(_events(spark, folder), f"{name}-{out.rsplit('-', 1)[-1]}", writer(name), out, available_now=True) for name in ("notify", "index")]
    for query in running:
        query.awaitTermination()
    return spark.read.parquet(f"{out}/data").select("consumer", "event_id", "event_type")


def run_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Every event delivered twice, kept once."""
    twice = _events(spark, folder).unionAll(_events(spark, folder))
    out = new_folder(spark, "stream-dedup")
    append_to(deduplicate(twice, "event_id", "ts"), out)
    return spark.read.parquet(f"{out}/data")


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select(
        "event_id", "ts", F.col("user_id").cast("string").alias("dataset_id"),
        mapped("event_type", _TYPE_OF, "SomethingElse").alias("event_type"),
    )


def run_routed(spark: SparkSession, folder: str) -> DataFrame:
    out = new_folder(spark, "stream-routed")
    append_to(route_events(_typed(spark, folder)), out, ["topic"])
    return spark.read.parquet(f"{out}/data")


def run_triggered(spark: SparkSession, folder: str) -> DataFrame:
    """Datasets below 50 are ready; the others start a job for every finished cleaning."""
    ready = (
        spark.read.parquet(f"{folder.rstrip('/')}/events.parquet").where("user_id < 50")
        .select(F.col("user_id").cast("string").alias("dataset_id"))
    )
    out = new_folder(spark, "stream-due")
    append_to(due_jobs(route_events(_typed(spark, folder)), ready), out)
    return spark.read.parquet(f"{out}/data").groupBy("dataset_id").agg(F.count("*").alias("triggers"))


def run_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """JSON messages, some framed, errors unreadable: accepted ones and dead letters."""
    body = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("event_id"), F.lit("DatasetUploaded").alias("event_type"),
            F.col("user_id").cast("string").alias("dataset_id"), F.col("props").alias("storage_key"),
        )
    )
    message = (
        F.when(F.col("event_type") == "error", F.lit("not json").cast("binary"))
        .when(F.col("event_type") == "view", F.concat(F.unhex(F.lit("0000000000")), body.cast("binary")))
        .otherwise(body.cast("binary"))
    )
    messages = _events(spark, folder).select(message.alias("value"))
    decoded = decode_values(messages, "value", UPLOADED)
    outcome = F.when(F.col("problem").isNull(), "accepted").otherwise("dead letter")
    out = new_folder(spark, "stream-decoded")
    append_to(decoded.withColumn("outcome", outcome), out, ["outcome"])
    return spark.read.parquet(f"{out}/data").groupBy("outcome").agg(F.count("*").alias("events"))
