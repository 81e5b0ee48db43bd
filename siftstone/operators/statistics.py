"""Column statistics, value distributions and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    LONG_TEXT, as_text, is_temporal, kind_of, long_form, number, numeric_columns, ref, value_key,
)
from .ordered import cut_points, running_total
from .quantiles import column_quantiles, counted_quantiles, shared_cuts

SHARES = [0.05, 0.25, 0.50, 0.75, 0.95]


def sample_skewness(g1: Column, n: Column) -> Column:
    """Sample-corrected skewness from the population form."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Sample-corrected excess kurtosis from the population form."""
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def _storage(df: DataFrame, column: str) -> str:
    """How distinct values are kept: 'long', 'time', 'double' or 'text'."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.IntegralType):
        return "long"
    if isinstance(dtype, T.BooleanType) or is_temporal(dtype):
        return "time"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    return "text"


def _as_long(df: DataFrame, column: str) -> Column:
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.DateType):
        return F.unix_date(ref(column)).cast("long")
    if is_temporal(dtype):
        return F.unix_micros(ref(column).cast("timestamp"))
    return ref(column).cast("long")


_STORES = {
    "long": ("vl", _as_long),
    "time": ("vl", _as_long),
    "double": ("vd", number),
    "text": ("vs", lambda df, c: value_key(as_text(df, c))),
}


def value_relation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, vl, vd, vs, n``: the distinct values of every column with their counts.

    One narrow scan and one shuffle per storage type, equal values merging
    map-side. Distinct counts, percentiles, entropy and samples all read this
    relation; within one plan Spark reuses its exchange.
    """
    columns = list(columns or df.columns)
    types = {"vl": "long", "vd": "double", "vs": "string"}
    parts = []
    for store, (slot, value) in _STORES.items():
        names = [c for c in columns if _storage(df, c) == store]
        if names:
            counted = (
                long_form(df, names, value)
                .where(F.col("value").isNotNull())
                .groupBy("column_name", "value")
                .agg(F.count("*").alias("n"))
            )
            parts.append(
                counted.select(
                    "column_name",
                    *[(F.col("value") if t == slot else F.lit(None)).cast(types[t]).alias(t) for t in types],
                    "n",
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def numeric_values(relation: DataFrame) -> DataFrame:
    """``column_name, v, n`` of a value relation of numeric columns."""
    v = F.coalesce(F.col("vl").cast("double"), F.col("vd"), F.col("vs").try_cast("double"))
    return relation.select("column_name", v.alias("v"), "n")


def counted_moments(values: DataFrame, quartiles: DataFrame | None = None, multiplier: float = 1.5) -> DataFrame:
    """Moments and entropy from ``column_name, v, n``: sums first, then sums of centred powers.

    With ``quartiles`` (``column_name, q``) also the fences and the number of
    values outside them, in the same second pass.
    """
    n, v = F.col("n"), F.col("v")
    base = values.groupBy("column_name").agg(
        F.sum(n).alias("non_null_count"),
        F.count("*").alias("unique_count"),
        F.sum(n * F.log2("n")).alias("nlogn"),
        F.sum(n * v).alias("total_sum"),
        F.min(v).alias("min_val"),
        F.max(v).alias("max_val"),
        F.sum(F.when(v == 0, n).otherwise(0)).alias("zero_count"),
        F.sum(F.when(v < 0, n).otherwise(0)).alias("negative_count"),
    ).withColumn("mean", F.col("total_sum") / F.col("non_null_count"))
    guides = base.select("column_name", "mean")
    fences = {"iqr": None, "tukey_lower": None, "tukey_upper": None}
    if quartiles is not None:
        q = F.col("q")
        iqr = q[1] - q[0]
        fences = {
            "iqr": F.round(iqr, 6),
            "tukey_lower": F.round(q[0] - multiplier * iqr, 6),
            "tukey_upper": F.round(q[1] + multiplier * iqr, 6),
        }
        bounds = quartiles.select("column_name", *[e.alias(name) for name, e in fences.items()])
        guides = guides.join(F.broadcast(bounds), "column_name")
    else:
        guides = guides.withColumns({name: F.lit(None).cast("double") for name in fences})
    d = v - F.col("mean")
    outside = (v < F.col("tukey_lower")) | (v > F.col("tukey_upper"))
    powers = (
        values.join(F.broadcast(guides), "column_name")
        .groupBy("column_name", *fences)
        .agg(
            F.sum(n * d * d).alias("m2"),
            F.sum(n * d * d * d).alias("m3"),
            F.sum(n * d * d * d * d).alias("m4"),
            F.sum(F.when(outside, n).otherwise(0)).alias("outlier_count_iqr"),
        )
    )
    count, m2 = F.col("non_null_count"), F.col("m2")
    var_samp = F.when(count > 1, m2 / (count - 1))
    spread = F.nullif(m2, F.lit(0.0))
    return base.join(F.broadcast(powers), "column_name").select(
        *base.columns,
        *fences,
        "outlier_count_iqr",
        (m2 / count).alias("var_pop"),
        F.sqrt(m2 / count).alias("stddev_pop"),
        var_samp.alias("var_samp"),
        F.sqrt(var_samp).alias("stddev_samp"),
        (F.sqrt(count.cast("double")) * F.col("m3") / F.pow(spread, F.lit(1.5))).alias("g1"),
        (count * F.col("m4") / (spread * spread) - 3).alias("g2"),
    )


#: Aggregates of one scan; the code that Spark generates for many more is too long to be compiled, and then runs several times slower.
SCAN_AGGREGATES = 24


def _one_scan_rows(df: DataFrame, columns: Sequence[str], named) -> DataFrame:
    """``column_name`` and the aggregates that ``named(value)`` names, a few columns a scan (a scan reads only its columns)."""
    each = max(1, SCAN_AGGREGATES // len(named(F.lit(0.0))))
    out = None
    for begin in range(0, len(columns), each):
        aggregates, structs = [], []
        for i, column in enumerate(columns[begin : begin + each]):
            found = named(number(df, column))
            aggregates += [expr.alias(f"{name}__{i}") for name, expr in found.items()]
            structs.append(F.struct(F.lit(column).alias("column_name"), *[F.col(f"{name}__{i}").alias(name) for name in found]))
        part = df.agg(*aggregates).select(F.inline(F.array(*structs)))
        out = part if out is None else out.unionAll(part)
    return out


def narrow_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name`` with counts, sum, bounds and moments from narrow scans; only one partial row per task is shuffled."""
    counts = _one_scan_rows(df, columns, lambda v: {
        "non_null_count": F.count(v), "total_sum": F.sum(v), "min_val": F.min(v), "max_val": F.max(v),
        "zero_count": F.count_if(v == 0), "negative_count": F.count_if(v < 0),
    })
    centred = _one_scan_rows(df, columns, lambda v: {
        "mean": F.avg(v), "var_pop": F.var_pop(v), "stddev_pop": F.stddev_pop(v), "var_samp": F.var_samp(v), "stddev_samp": F.stddev_samp(v),
        "g1": F.skewness(v), "g2": F.kurtosis(v),
    })
    return counts.join(F.broadcast(centred), "column_name")


def value_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, total_rows, non_null_count, mean, stddev…, min_val, max_val`` from one scan
    without a shuffle of values."""
    aggregates, structs = [F.count("*").alias("_rows")], []
    for i, column in enumerate(columns):
        v = number(df, column)
        named = {
            "non_null_count": F.count(v), "mean": F.avg(v), "stddev_pop": F.stddev_pop(v),
            "stddev_samp": F.stddev_samp(v), "min_val": F.min(v), "max_val": F.max(v),
        }
        aggregates += [expr.alias(f"{name}__{i}") for name, expr in named.items()]
        structs.append(
            F.struct(
                F.lit(column).alias("column_name"),
                F.col("_rows").alias("total_rows"),
                *[F.col(f"{name}__{i}").alias(name) for name in named],
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*structs)))


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """``column_name, unique_count`` of the non-null values of all columns."""
    if approx:
        wide = df.agg(*[F.approx_count_distinct(ref(c), 0.01).alias(f"u{i}") for i, c in enumerate(columns)])
        pairs = [
            F.struct(F.lit(c).alias("column_name"), F.col(f"u{i}").alias("unique_count"))
            for i, c in enumerate(columns)
        ]
        return wide.select(F.inline(F.array(*pairs)))
    counted = value_relation(df, columns).groupBy("column_name").agg(F.count("*").alias("unique_count"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(F.broadcast(counted), "column_name", "left").fillna(0, ["unique_count"])


def column_statistics(
    df: DataFrame,
    columns: Sequence[str] | str | None = None,
    approx: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Descriptive statistics, one row per numeric column.

    Exact: counts, sums and moments come from one scan, distinct counts and percentiles
    from the value-count relation of the columns. ``approx``: one scan with sketches for percentiles and distinct counts, no
    shuffle of values.
    """
    columns = [columns] if isinstance(columns, str) else list(columns or numeric_columns(df))
    rows = df.count() if rows is None else rows
    if approx:
        base = _approximate_moments(df, columns)
        quantiles = column_quantiles(df, columns, SHARES, approx=True)
    else:
        values = numeric_values(value_relation(df, columns))
        base = narrow_moments(df, columns)
        quantiles = counted_quantiles(values, ["column_name"], SHARES, shared_cuts(df, columns, rows), distinct=True)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    q = F.col("q")
    iqr = q[3] - q[1]
    n, total = F.coalesce(F.col("non_null_count"), F.lit(0)), F.lit(rows).cast("long")
    zero = F.nullif(total, F.lit(0).cast("long"))
    return (
        names.join(F.broadcast(base), "column_name", "left")
        .join(F.broadcast(quantiles), "column_name", "left")
        .select(
            "column_name",
            total.alias("total_rows"),
            n.alias("non_null_count"),
            (total - n).alias("null_count"),
            F.round((total - n) / zero, 6).alias("null_rate"),
            F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
            F.round(F.col("unique_count") / F.nullif(n, F.lit(0)), 6).alias("cardinality_ratio"),
            "mean",
            q[2].alias("median"),
            F.col("stddev_pop").alias("stddev"),
            F.col("var_pop").alias("variance"),
            "min_val",
            "max_val",
            (F.col("max_val") - F.col("min_val")).alias("range_val"),
            "total_sum",
            q[0].alias("p5"),
            q[1].alias("p25"),
            q[2].alias("p50"),
            q[3].alias("p75"),
            q[4].alias("p95"),
            iqr.alias("iqr"),
            (q[1] - 1.5 * iqr).alias("tukey_lower_fence"),
            (q[3] + 1.5 * iqr).alias("tukey_upper_fence"),
            sample_skewness(F.col("g1"), n).alias("skewness"),
            sample_kurtosis(F.col("g2"), n).alias("kurtosis"),
            F.round(F.col("stddev_pop") / F.nullif(F.abs("mean"), F.lit(0.0)), 6).alias(
                "coefficient_of_variation"
            ),
            F.coalesce("zero_count", F.lit(0)).alias("zero_count"),
            F.coalesce("negative_count", F.lit(0)).alias("negative_count"),
            F.current_timestamp().alias("computed_at"),
        )
    )


def _approximate_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = long_form(df, columns, number)
    v = F.col("value")
    return values.groupBy("column_name").agg(
        F.count(v).alias("non_null_count"), F.approx_count_distinct(v, 0.01).alias("unique_count"),
        F.sum(v).alias("total_sum"), F.min(v).alias("min_val"), F.max(v).alias("max_val"),
        F.count_if(v == 0).alias("zero_count"), F.count_if(v < 0).alias("negative_count"),
        F.avg(v).alias("mean"), F.var_pop(v).alias("var_pop"), F.stddev_pop(v).alias("stddev_pop"),
        F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"),
    )


def _keyed_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, key, n``: one row per distinct value, long texts by digest."""
    pairs = long_form(df, columns, lambda d, c: value_key(as_text(d, c)))
    return (
        pairs.where(F.col("value").isNotNull())
        .groupBy("column_name", F.col("value").alias("key"))
        .agg(F.count("*").alias("n"))
    )


def restore_values(df: DataFrame, keyed: DataFrame) -> DataFrame:
    """Adds ``value`` to a small keyed relation (``column_name, key, …``).

    Short values are their own key. Digests are looked up in one more scan of
    the text columns; the digest side holds a few rows per column.
    """
    texts = [f.name for f in df.schema if kind_of(f.dataType) in ("text", "unknown")]
    if not texts:
        return keyed.withColumn("value", F.col("key"))
    is_digest = F.length("key") > LONG_TEXT
    digests = keyed.where(is_digest).select("column_name", "key").distinct()
    whole = (
        long_form(df, texts, as_text)
        .where(F.length("value") > LONG_TEXT)
        .withColumn("key", value_key(F.col("value")))
        .join(F.broadcast(digests), ["column_name", "key"], "left_semi")
        .groupBy("column_name", "key")
        .agg(F.min("value").alias("_whole"))
    )
    return keyed.join(F.broadcast(whole), ["column_name", "key"], "left").select(
        *[F.col(c) for c in keyed.columns], F.coalesce("_whole", "key").alias("value")
    )


def top_value_counts(df: DataFrame, columns: Sequence[str], top_n: int = 20) -> DataFrame:
    """Most frequent values of each column with their share of the non-null rows.

    Also gives ``pct_of_top``: the share among the listed values only. The rank
    filter keeps at most ``top_n`` rows per column and task before the shuffle.
    """
    counted = _keyed_counts(df, columns)
    totals = counted.groupBy("column_name").agg(F.sum("n").alias("_total"))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("key"))
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    listed = Window.partitionBy("column_name")
    return restore_values(df, top).join(F.broadcast(totals), "column_name").select(
        "column_name",
        "value",
        F.col("n").alias("count"),
        F.round(F.col("n") / F.col("_total"), 6).alias("pct"),
        F.round(F.col("n") / F.sum("n").over(listed), 6).alias("pct_of_top"),
        "rank",
    )


def value_distribution(df: DataFrame, column: str, top_n: int = 20) -> DataFrame:
    """Top values with share, cumulative count and rank (ties broken by value).

    The cumulative window runs over the ``top_n`` listed rows only.
    """
    counted = _keyed_counts(df, [column])
    total = counted.agg(F.sum("n")).scalar()
    top = counted.orderBy(F.desc("n"), F.asc("key")).limit(top_n)
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("key"))
    running = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rank = F.rank().over(Window.partitionBy("column_name").orderBy(F.desc("n")))
    listed = top.select("*", running.alias("cumulative_count"), rank.alias("frequency_rank"))
    return restore_values(df, listed).withColumn("_total", total).select(
        "value",
        F.col("n").alias("frequency"),
        F.round(F.col("n") / F.col("_total"), 6).alias("relative_frequency"),
        F.round(100.0 * F.col("n") / F.col("_total"), 2).alias("percentage"),
        "cumulative_count",
        F.round(100.0 * F.col("cumulative_count") / F.col("_total"), 2).alias("cumulative_pct"),
        "frequency_rank",
    )


def histogram(df: DataFrame, columns: Sequence[str] | str, bins: int | None = 20) -> DataFrame:
    """Equal-width bins of many columns, empty bins included.

    With ``bins=None`` the number follows the data: min(20, max(5, distinct)).
    Minimum and maximum (one row per column) meet the values by column name.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    bounds = value_ranges(df, columns).select("column_name", "min_val", "max_val", "non_null_count")
    if bins is None:
        bounds = bounds.join(F.broadcast(distinct_counts(df, columns)), "column_name").withColumn(
            "bins", F.least(F.lit(20), F.greatest(F.lit(5), F.col("unique_count"))).cast("int")
        ).drop("unique_count")
    else:
        bounds = bounds.withColumn("bins", F.lit(int(bins)))
    bounds = bounds.withColumn("width", (F.col("max_val") - F.col("min_val")) / F.col("bins"))
    values = long_form(df, columns, number).where(F.col("value").isNotNull())
    position = F.floor((F.col("value") - F.col("min_val")) / F.nullif(F.col("width"), F.lit(0.0)))
    counted = (
        values.join(F.broadcast(bounds), "column_name")
        .select(
            "column_name",
            F.least(F.coalesce(position, F.lit(0)), F.col("bins") - 1).cast("int").alias("bin_index"),
        )
        .groupBy("column_name", "bin_index")
        .agg(F.count("*").alias("frequency"))
    )
    slots = bounds.where(F.col("non_null_count") > 0).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin_index")
    )
    start = F.col("min_val") + F.col("bin_index") * F.col("width")
    frequency = F.coalesce(F.col("frequency"), F.lit(0))
    return slots.join(F.broadcast(counted), ["column_name", "bin_index"], "left").select(
        "column_name",
        "bin_index",
        start.alias("bin_start"),
        (F.col("min_val") + (F.col("bin_index") + 1) * F.col("width")).alias("bin_end"),
        frequency.alias("frequency"),
        F.round(frequency / F.col("non_null_count"), 6).alias("relative_frequency"),
        F.round(100.0 * frequency / F.col("non_null_count"), 2).alias("percentage"),
    )


def outlier_counts(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Fences and the number of values outside them, one row per column."""
    values = numeric_values(value_relation(df, columns))
    quartiles = counted_quantiles(values, ["column_name"], [0.25, 0.75], shared_cuts(df, columns, df.count()))
    return counted_moments(values, quartiles, multiplier).select(
        "column_name", "iqr", "tukey_lower", "tukey_upper", "outlier_count_iqr"
    )


def gini(df: DataFrame, column: str, task_rows: int | None = None) -> DataFrame:
    """Gini coefficient of the absolute values, one row.

    Equal values are one row after the first aggregate; the rank of each value
    comes from a bucketed running total, never from a window over the table.
    """
    counted = (
        df.select(F.abs(number(df, column)).alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy("v")
        .agg(F.count("*").alias("c"))
    )
    cuts = cut_points(counted, "v", counted.count(), task_rows)
    ranked = running_total(counted, "v", "c", cuts, name="before")
    weighted = F.sum(F.col("v") * F.col("c") * (2 * F.col("before") + F.col("c")))
    n, total = F.sum("c"), F.sum(F.col("v") * F.col("c"))
    return ranked.agg(weighted.alias("w"), n.alias("n"), total.alias("t")).select(
        F.lit(column).alias("column_name"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        F.when((F.col("n") < 2) | F.col("n").isNull() | (F.col("t") == 0), F.lit(0.0))
        .otherwise(F.round((F.col("w") - F.col("n") * F.col("t")) / (F.col("n") * F.col("t")), 6))
        .alias("gini"),
    )


def entropy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shannon entropy (bits), its share of log2(k) and the top-3 coverage per column."""
    return entropy_of_counts(value_relation(df, columns))


def entropy_of_counts(counted: DataFrame) -> DataFrame:
    """The same from a relation with ``column_name, n`` (one row per distinct value)."""
    totals = counted.groupBy("column_name").agg(
        F.sum("n").alias("total"),
        F.count("*").alias("categories"),
        F.sum(F.col("n") * F.log2("n")).alias("nlogn"),
    )
    return spread_of_totals(totals, counted)


def spread_of_totals(totals: DataFrame, counted: DataFrame) -> DataFrame:
    """Entropy and coverage from ``column_name, total, categories, nlogn`` and the value counts."""
    order = Window.partitionBy("column_name").orderBy(F.desc("n"))
    top3 = (
        counted.select("column_name", "n")
        .withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= 3)
        .groupBy("column_name")
        .agg(F.sum("n").alias("top3"))
    )
    raw = F.abs(F.log2("total") - F.col("nlogn") / F.col("total"))
    return totals.join(F.broadcast(top3), "column_name").select(
        "column_name",
        "categories",
        F.round(raw, 6).alias("entropy"),
        F.when(F.col("categories") <= 1, F.lit(0.0))
        .otherwise(F.round(raw / F.log2(F.col("categories").cast("double")), 6))
        .alias("normalised_entropy"),
        F.round(F.col("top3") / F.col("total"), 6).alias("top3_coverage"),
    )
