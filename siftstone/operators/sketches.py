"""Statistics that merge: a row per column and run, with sketches of its distinct values and of its distribution as binary columns.

The rows of many runs, months or projects are put together without reading any data again. Distinct counts come from HyperLogLog sketches
(relative standard error 0.4 %), quantiles from KLL sketches (rank error about 0.4 %); counts, sums, bounds and moments are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import kind_of, number, ref
from .statistics import SCAN_AGGREGATES, SHARES

#: Sizes of the sketches: 2 ** DISTINCT_BITS registers, and KLL's k.
DISTINCT_BITS, QUANTILE_K = 16, 800
SCHEMA = (
    "dataset_id string, project_id string, run_id string, yyyymm int, column_name string, kind string, total_rows long, non_null_count long, total_sum double, "
    "mean double, m2 double, min_val double, max_val double, distinct_sketch binary, quantile_sketch binary"
)
_KEYS = ("dataset_id", "project_id", "run_id", "yyyymm", "column_name")


def sketch_columns(
    df: DataFrame, dataset_id: str = "", project_id: str = "", run_id: str = "", yyyymm: int = 0, columns: Sequence[str] | None = None
) -> DataFrame:
    """A row per column, in the layout of ``SCHEMA``. No value is shuffled: a task hands on one row."""
    fields = [f for f in df.schema if columns is None or f.name in columns]
    each, out = max(1, SCAN_AGGREGATES // 8), None
    for begin in range(0, len(fields), each):
        aggregates, structs = [F.count("*").alias("_rows")], []
        for i, field in enumerate(fields[begin : begin + each]):
            kind = kind_of(field.dataType)
            value = number(df, field.name) if kind == "numeric" else ref(field.name)
            found = {"non_null_count": F.count(value), "distinct_sketch": F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), DISTINCT_BITS)}
            if kind == "numeric":
                v = value.cast("double")
                found |= {
                    "total_sum": F.sum(v), "mean": F.avg(v), "m2": F.var_pop(v), "min_val": F.min(v), "max_val": F.max(v),
                    "quantile_sketch": F.call_function("kll_sketch_agg_double", v, F.lit(QUANTILE_K)),
                }
            aggregates += [e.alias(f"{n}__{i}") for n, e in found.items()]
            have = lambda n, t: (F.col(f"{n}__{i}") if n in found else F.lit(None)).cast(t)  # noqa: B023, E731
            structs.append(F.struct(
                F.lit(field.name).alias("column_name"), F.lit(kind).alias("kind"), F.col("_rows").alias("total_rows"), have("non_null_count", "long").alias("non_null_count"),
                *[have(n, "double").alias(n) for n in ("total_sum", "mean")], (have("m2", "double") * have("non_null_count", "double")).alias("m2"),
                *[have(n, "double").alias(n) for n in ("min_val", "max_val")], *[have(n, "binary").alias(n) for n in ("distinct_sketch", "quantile_sketch")],
            ))
        part = df.agg(*aggregates).select(F.inline(F.array(*structs)))
        out = part if out is None else out.unionAll(part)
    keys = [F.lit(dataset_id).alias("dataset_id"), F.lit(project_id).alias("project_id"), F.lit(run_id).alias("run_id"), F.lit(yyyymm).alias("yyyymm")]
    return out.select(*keys, *out.columns)


def append_sketches(rows: DataFrame, folder: str) -> None:
    """Appends runs to the table in ``folder``, partitioned by month."""
    rows.repartition("yyyymm").write.mode("append").partitionBy("yyyymm").parquet(folder)


def read_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def merge_sketches(rows: DataFrame, by: Sequence[str] = ("project_id", "yyyymm", "column_name")) -> DataFrame:
    """One row per group of runs: ``by``, the exact counts and moments, and the merged sketches. Merged rows merge again."""
    n, mean = F.col("non_null_count"), F.col("mean")
    grouped = rows.groupBy(*by).agg(
        F.max("kind").alias("kind"), F.sum("total_rows").alias("total_rows"), F.sum(n).alias("non_null_count"), F.sum("total_sum").alias("total_sum"),
        F.sum("m2").alias("_within"), F.sum(n * mean * mean).alias("_square"), F.min("min_val").alias("min_val"), F.max("max_val").alias("max_val"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.call_function("kll_merge_agg_double", F.col("quantile_sketch")).alias("quantile_sketch"),
    )
    average = F.col("total_sum") / F.nullif(n, F.lit(0))
    spread = F.col("_within") + F.greatest(F.col("_square") - n * average * average, F.lit(0.0))
    out = grouped.withColumns({"mean": average, "m2": spread})
    # a sketch of no numbers is none
    empty = F.when((F.col("kind") == "numeric") & (n > 0), F.col("quantile_sketch"))
    return out.withColumn("quantile_sketch", empty).select(*by, *[c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] not in {*by, *_KEYS}])


def sketched_statistics(rows: DataFrame, shares: Sequence[float] = SHARES) -> DataFrame:
    """Readable statistics of sketch rows: null rate, distinct estimate, moments and ``q``, the estimated quantiles."""
    n, total = F.col("non_null_count"), F.col("total_rows")
    keys = [c for c in rows.columns if c in _KEYS]
    quantiles = F.call_function("kll_sketch_get_quantile_double", F.col("quantile_sketch"), F.array(*[F.lit(float(s)) for s in shares]))
    estimate = F.coalesce(F.hll_sketch_estimate("distinct_sketch"), F.lit(0))
    return rows.select(
        *keys, "kind", "total_rows", "non_null_count", (total - n).alias("null_count"),
        F.coalesce(F.round((total - n) / F.nullif(total, F.lit(0)), 6), F.lit(0.0)).alias("null_rate"), F.least(estimate, n).alias("unique_estimate"),
        "total_sum", "mean", F.when(n > 0, F.sqrt(F.col("m2") / n)).alias("stddev_pop"), F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("stddev_samp"),
        "min_val", "max_val", F.when((F.col("kind") == "numeric") & (n > 0), quantiles).alias("q"),
    )
