"""Operational tables: usage and cost, run metrics, lifecycle checks, fact-table summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import join_null_safe, ref
from .ordered import cut_points, previous_rows, with_bucket

# USD per million tokens (input, output), and the price of an unlisted model.
PRICES = {
    "anthropic.claude-sonnet-4-5": (3.00, 15.00),
    "anthropic.claude-haiku-4-5": (0.25, 1.25),
    "amazon.titan-embed-text-v2:0": (0.02, 0.00),
}
DEFAULT_PRICE = (3.00, 15.00)


def price_table(spark, prices: Mapping[str, tuple[float, float]] = PRICES) -> DataFrame:
    return spark.createDataFrame(
        [(m, float(i), float(o)) for m, (i, o) in prices.items()],
        "model string, input_price double, output_price double",
    )


def priced_calls(calls: DataFrame, prices: DataFrame | None = None, default=DEFAULT_PRICE) -> DataFrame:
    """Adds ``cost_usd`` to calls with model, input_tokens and output_tokens.

    The price list (one row per model) is broadcast by Spark when its size allows.
    """
    prices = prices if prices is not None else price_table(calls.sparkSession)
    joined = calls.join(prices, "model", "left")
    cost = (
        F.col("input_tokens") * F.coalesce("input_price", F.lit(default[0]))
        + F.col("output_tokens") * F.coalesce("output_price", F.lit(default[1]))
    ) / 1_000_000
    return joined.withColumn("cost_usd", cost).drop("input_price", "output_price")


def usage_by(calls: DataFrame, by: Sequence[str], threshold_usd: float | None = None) -> DataFrame:
    """Calls, tokens and cost per model, session or both; optional threshold flag."""
    out = calls.groupBy(*[ref(c) for c in by]).agg(
        F.count("*").alias("call_count"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )
    if threshold_usd is not None:
        out = out.withColumn("over_threshold", F.col("cost_usd") >= threshold_usd)
    return out


def duration_bucket(ms: Column, bounds: Sequence[int]) -> Column:
    """Upper bound of the fixed histogram bucket, null beyond the last one."""
    out = F.lit(None).cast("int")
    for bound in reversed(bounds):
        out = F.when(ms <= bound, bound).otherwise(out)
    return out


def run_metrics(runs: DataFrame, by: Sequence[str] = ("agent",)) -> DataFrame:
    """Counts by outcome, duration, tokens, cost and slow runs.

    ``runs``: agent, success, duration_ms, tokens, cost_usd.
    """
    return runs.groupBy(*[ref(c) for c in by]).agg(
        F.count("*").alias("runs"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.sum("duration_ms").alias("total_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.percentile_approx("duration_ms", 0.95, 100_000).alias("p95_ms"),
        F.sum("tokens").alias("total_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.count_if(F.col("duration_ms") > fixed.SLOW_AGENT_MS).alias("slow_runs"),
    )


def duration_histogram(runs: DataFrame, by: Sequence[str] = ("agent", "success"), bounds=None) -> DataFrame:
    """Observations per fixed duration bucket (cumulative counts are a sum away)."""
    bounds = bounds or fixed.AGENT_DURATION_BUCKETS
    return runs.groupBy(
        *[ref(c) for c in by], duration_bucket(F.col("duration_ms"), bounds).alias("le_ms")
    ).agg(F.count("*").alias("observations"))


def run_reports(runs: DataFrame, run_id: str = "run_id") -> DataFrame:
    """One row per run: outcome, totals, names of failed agents, cost alert."""
    totals = runs.groupBy(ref(run_id)).agg(
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.sum("duration_ms").alias("total_ms"),
        F.sum("tokens").alias("total_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.sort_array(F.collect_set(F.when(F.col("success"), F.col("agent")))).alias("succeeded_agents"),
        F.sort_array(F.collect_set(F.when(~F.col("success"), F.col("agent")))).alias("failed_agents"),
    )
    return totals.withColumns(
        {
            "status": F.when(F.col("failed") == 0, "success")
            .when(F.col("succeeded") > 0, "partial")
            .otherwise("failure"),
            "cost_alert": F.col("cost_usd") >= fixed.COST_ALERT_USD,
        }
    )


def transition_table(spark, transitions=fixed.DATASET_TRANSITIONS) -> DataFrame:
    return spark.createDataFrame(transitions, "prev_status string, status string")


def illegal_transitions(
    events: DataFrame,
    entity: str,
    status: str,
    ts: str,
    event_id: str,
    transitions=fixed.DATASET_TRANSITIONS,
    initial: str | None = None,
    task_rows: int | None = None,
) -> DataFrame:
    """Status changes that the lifecycle does not allow.

    The previous status is found per (entity, time slice); one row per slice
    hands the last status on, so an entity with very many events is split.
    With ``initial`` the first status of an entity must be that one. A repeated
    status is no change.
    """
    data = events.select(
        ref(entity).alias("entity"), ref(status).alias("status"),
        F.unix_micros(ref(ts).cast("timestamp")).alias("at"), ref(event_id).alias("event_id"),
    )
    cuts = cut_points(data, "at", data.count(), task_rows)
    placed = with_bucket(data, "at", cuts)
    steps = previous_rows(placed, ["entity"], F.col("_bucket"), ["at", "event_id"], ["status"]).drop("_bucket")
    allowed = F.lit(False)
    for before, after in transitions:
        allowed = allowed | ((F.col("prev_status") == before) & (F.col("status") == after))
    first = F.col("prev_status").isNull()
    bad = ~first & (F.col("prev_status") != F.col("status")) & ~F.coalesce(allowed, F.lit(False))
    if initial is not None:
        bad = bad | (first & (F.col("status") != initial))
    return steps.where(bad).select("entity", "event_id", "prev_status", "status")


def latest_status(events: DataFrame, entity: str, status: str, ts: str, event_id: str) -> DataFrame:
    """Last status per entity; out-of-order events do no harm."""
    order = F.struct(ref(ts), ref(event_id))
    return events.groupBy(ref(entity).alias("entity")).agg(
        F.max_by(ref(status), order).alias("status"), F.max(ref(ts)).alias("updated_at")
    )


def stale_jobs(
    latest: DataFrame, now: Column, hours: float = 2.0, running: Sequence[str] = ("profiling", "cleaning")
) -> DataFrame:
    """Jobs that have been running for longer than allowed, to be marked failed."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 3.6e9
    return latest.where(F.col("status").isin(list(running)) & (age > hours)).select(
        "entity", F.col("status").alias("stalled_in"), F.lit("failed").alias("status"),
        F.lit("Pipeline stalled — auto-recovered by watchdog").alias("reason"),
    )


def evaluation_summary(results: DataFrame, floor: float = 0.80, by: Sequence[str] = ("suite",)) -> DataFrame:
    """Cases, pass rate and average score per suite; ``ok`` is the gate."""
    passed = F.count_if("passed")
    return results.groupBy(*[ref(c) for c in by]).agg(
        F.count("*").alias("total_cases"),
        passed.alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.round(passed / F.count("*"), 4).alias("pass_rate"),
        F.round(F.avg("score"), 4).alias("avg_score"),
        (passed / F.count("*") >= floor).alias("ok"),
    )


def cache_hit_rate(requests: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Share of requests whose key was seen before: 1 − distinct keys / requests."""
    from ..functions.columns import content_key

    counted = requests.groupBy(content_key(*keys).alias("k")).agg(F.count("*").alias("n"))
    return counted.agg(
        F.sum("n").alias("requests"),
        F.count("*").alias("misses"),
        (F.sum("n") - F.count("*")).alias("hits"),
        F.round((F.sum("n") - F.count("*")) / F.sum("n"), 4).alias("hit_rate"),
    )


def requests_over_limit(
    requests: DataFrame,
    client: str,
    ts: str,
    limit: int = 60,
    window_seconds: int = 60,
) -> DataFrame:
    """Sliding request counter: every (client, second) whose trailing window exceeds the limit.

    Requests are first counted per client and second. The window runs per
    (client, slice of an hour or ten windows); the seconds that the next slice
    still sees are copied into it, so one busy client spreads over many tasks.
    """
    slice_seconds = max(3600, 10 * window_seconds)
    second = F.unix_seconds(ref(ts).cast("timestamp"))
    counted = requests.groupBy(ref(client).alias("client"), second.alias("second")).agg(
        F.count("*").alias("requests")
    )
    home = F.floor(F.col("second") / slice_seconds)
    reach = F.floor((F.col("second") + window_seconds - 1) / slice_seconds)
    spread = counted.withColumn("_home", home).withColumn("_slice", F.explode(F.sequence(home, reach)))
    trailing = Window.partitionBy("client", "_slice").orderBy("second").rangeBetween(-(window_seconds - 1), 0)
    return (
        spread.withColumn("in_window", F.sum("requests").over(trailing))
        .where(F.col("_slice") == F.col("_home"))
        .where(F.col("in_window") > limit)
        .select("client", "second", "requests", "in_window")
    )


def idle_window_counts(requests: DataFrame, client: str, ts: str, idle: str = "60 seconds", slice_seconds: int = 3600) -> DataFrame:
    """The other counter: a window that ends only after an idle minute (a session window).

    Requests are counted per client and instant; gaps and sessions are found per (client, slice of an hour), and one row per slice
    carries the running session on, so one busy client spreads over many tasks.
    """
    at = F.unix_micros(ref(ts).cast("timestamp"))
    counted = requests.where(ref(ts).isNotNull()).groupBy(ref(client).alias("client"), at.alias("at")).agg(F.count("*").alias("n"))
    slice_ = F.floor(F.col("at") / (slice_seconds * 1_000_000))
    gaps = previous_rows(counted, ["client"], slice_, ["at"], ["at"])
    gap = F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {idle})")
    opens = F.col("prev_at").isNull() | (F.col("at") - F.col("prev_at") >= gap)
    marked = gaps.withColumns({"_slice": slice_, "_opened": F.when(opens, F.col("at"))})
    inside = Window.partitionBy("client", "_slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("client").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("client", "_slice").agg(F.max("_opened").alias("_opened")).select("client", "_slice", F.max("_opened").over(earlier).alias("_carried"))
    joined = join_null_safe(marked.withColumn("_own", F.max("_opened").over(inside)), carried, ["client", "_slice"], "left")
    return joined.groupBy("client", F.coalesce("_own", "_carried").alias("start")).agg(F.sum("n").alias("requests")).select(
        "client", F.floor(F.col("start") / 1_000_000).alias("start_second"), "requests"
    )


# ── summaries of the statistics table ───────────────────────────────────────


def dataset_summary(stats: DataFrame) -> DataFrame:
    return stats.groupBy("dataset_id").agg(
        F.round(F.avg("completeness"), 4).alias("avg_completeness"),
        F.round(F.avg("null_rate"), 4).alias("avg_null_rate"),
        F.count("*").alias("column_count"),
        F.count_if(F.col("kind") == "numeric").alias("numeric_column_count"),
    )


def project_benchmark(stats: DataFrame) -> DataFrame:
    """Completeness over all datasets of a project (averages of averages are avoided)."""
    return stats.groupBy("project_id").agg(
        F.round(F.avg("completeness"), 4).alias("project_avg_completeness"),
        F.round(F.min("completeness"), 4).alias("project_min_completeness"),
        F.round(F.max("completeness"), 4).alias("project_max_completeness"),
        F.count_distinct("dataset_id").alias("dataset_count"),
    )


def compared_to_project(stats: DataFrame) -> DataFrame:
    """Each dataset's completeness minus the average of its project."""
    datasets = stats.groupBy("project_id", "dataset_id").agg(F.avg("completeness").alias("c"))
    projects = stats.groupBy("project_id").agg(F.avg("completeness").alias("p"))
    return datasets.join(projects, "project_id").select(
        "project_id", "dataset_id", F.round(F.col("c") - F.col("p"), 4).alias("difference")
    )


def high_null_columns(stats: DataFrame, threshold: float = 0.20) -> DataFrame:
    return stats.where(F.col("null_rate") > threshold).orderBy(F.desc("null_rate"), "column_name").select(
        "dataset_id", "column_name", "null_rate", "semantic_type", "unique_count"
    )


def best_runs(runs: DataFrame, by: Sequence[str] = ("target",), score: str = "score") -> DataFrame:
    """Best model run per target."""
    order = F.struct(ref(score), F.col("run_id"))
    best = F.max_by(F.struct(*runs.columns), order)
    return runs.groupBy(*[ref(c) for c in by]).agg(best.alias("b")).select("b.*")
