"""Correlation, trends, hypothesis tests and distribution fit."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distributions as dist
from ..functions.columns import moment, number, numeric_columns, ref
from ..session import cut_lineage
from .ordered import cut_points, running_total

# Pairs per aggregate: keeps the generated code and the aggregation buffer small.
PAIRS_PER_SCAN = 250


def strength(r: Column) -> Column:
    size = F.abs(r)
    return (
        F.when(size >= 0.90, "very_strong")
        .when(size >= 0.70, "strong")
        .when(size >= 0.50, "moderate")
        .when(size >= 0.30, "weak")
        .otherwise("negligible")
    )


def direction(r: Column) -> Column:
    return F.when(r > 0, "positive").otherwise("negative")


def pair_correlations(df: DataFrame, columns: Sequence[str], listwise: bool = False) -> DataFrame:
    """``col_a, col_b, r, n`` for every pair with col_a < col_b.

    One aggregate computes up to 250 pairs, so twenty columns need one scan.
    Nulls are left out per pair, or per row with ``listwise``.
    """
    columns = sorted(columns)
    pairs = list(combinations(columns, 2))
    data = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    if listwise:
        data = data.dropna()
    at = {c: f"v{i}" for i, c in enumerate(columns)}
    parts = []
    for begin in range(0, len(pairs), PAIRS_PER_SCAN):
        block = pairs[begin : begin + PAIRS_PER_SCAN]
        aggregates, structs = [], []
        for i, (a, b) in enumerate(block):
            aggregates += [
                F.corr(at[a], at[b]).alias(f"r{i}"),
                F.regr_count(F.col(at[a]), F.col(at[b])).alias(f"n{i}"),
            ]
            structs.append(
                F.struct(
                    F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                    F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"),
                )
            )
        parts.append(data.agg(*aggregates).select(F.inline(F.array(*structs))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.where(F.col("r").isNotNull() & ~F.isnan("r"))


def correlations(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    min_abs_r: float = 0.3,
    max_pairs: int | None = None,
    listwise: bool = False,
    method: str = "pearson",
) -> DataFrame:
    """Pairs with |r| of at least ``min_abs_r``; only the strongest ``max_pairs``, if given."""
    columns = list(columns or numeric_columns(df))
    if method == "spearman":
        found = spearman(df, columns)
    elif method == "pearson":
        found = pair_correlations(df, columns, listwise)
    else:
        raise ValueError(f"unsupported method: {method!r}")
    strong = found.where(F.abs("r") >= min_abs_r)
    if max_pairs is not None:
        strong = strong.orderBy(F.desc(F.abs("r")), "col_a", "col_b").limit(max_pairs)
    return strong.select(
        "col_a", "col_b", F.round("r", 6).alias("r"), F.col("n").alias("sample_size"),
        strength(F.col("r")).alias("strength"), direction(F.col("r")).alias("direction"),
    )


#: Ranks of so many distinct values are broadcast; of more they are joined by a shuffle.
BROADCAST_VALUES = 500_000


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of complete rows.

    Equal values share their mean rank, which follows from running counts of the distinct values; a value of any frequency is
    one row there. The rows then look their ranks up column by column.
    """
    columns = sorted(columns)
    ranked = cut_lineage(df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)]).dropna())
    complete, rows = ranked, ranked.count()
    lookups = []
    for i in range(len(columns)):
        # counted from the rows themselves, not behind the other columns' joins
        counted = complete.groupBy(f"v{i}").agg(F.count("*").alias("n"))
        before = running_total(counted, f"v{i}", "n", cut_points(complete, f"v{i}", rows))
        ranks = cut_lineage(before.select(F.col(f"v{i}").alias("_v"), (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{i:04d}")))
        lookups.append((ranks.count(), i, ranks))
    for distinct, i, ranks in sorted(lookups, key=lambda x: x[:2]):  # few values first: those rows are not shuffled
        ranks = F.broadcast(ranks) if distinct <= BROADCAST_VALUES else ranks
        ranked = ranked.join(ranks, F.col(f"v{i}") == F.col("_v")).drop("_v", f"v{i}")
    found = pair_correlations(ranked, [f"r{i:04d}" for i in range(len(columns))])
    names = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (f"r{i:04d}", c)])
    return found.withColumns({"col_a": names[F.col("col_a")], "col_b": names[F.col("col_b")]})


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, min_abs_r: float = 0.3) -> DataFrame:
    """Upper triangle with r², strength, direction and rank."""
    found = pair_correlations(df, list(columns or numeric_columns(df)))
    size = F.abs("r")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("abs_r"))
    return (
        found.where(size >= min_abs_r)
        .select(
            "col_a",
            "col_b",
            F.round("r", 6).alias("r"),
            F.round(F.col("r") * F.col("r"), 6).alias("r_squared"),
            strength(F.col("r")).alias("strength"),
            direction(F.col("r")).alias("direction"),
            size.alias("abs_r"),
            F.lit(False).alias("is_mirror"),
        )
        .withColumn("strength_rank", F.rank().over(order))
    )


def linear_trend(df: DataFrame, ts: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares trend over days, one row per series; series under 3 points are left out."""
    by = list(by)
    day = F.datediff(moment(df, ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    data = df.select(*[ref(c) for c in by], day.alias("x"), number(df, value).alias("y")).dropna(
        subset=["x", "y"]
    )
    fitted = data.groupBy(*by).agg(
        F.regr_slope("y", "x").alias("b"),
        F.regr_intercept("y", "x").alias("a"),
        F.regr_r2("y", "x").alias("r2"),
        F.var_pop("y").alias("vy"),
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
        F.count("*").alias("data_points"),
    )
    first = F.col("a") + F.col("b") * F.col("x0")
    last = F.col("a") + F.col("b") * F.col("x1")
    r2 = F.when(F.col("vy") == 0, F.lit(0.0)).otherwise(F.col("r2"))
    slope = F.col("b")
    return fitted.where((F.col("data_points") >= 3) & slope.isNotNull()).select(
        *by,
        F.round(slope, 8).alias("slope"),
        F.round(r2, 6).alias("r_squared"),
        F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("flat").alias("direction"),
        F.when(first != 0, F.round((last - first) / F.abs(first) * 100, 2))
        .otherwise(F.lit(0.0))
        .alias("pct_change"),
        "data_points",
        (r2 > 0.5).alias("is_significant"),
    )


@F.pandas_udf(T.DoubleType())
def _student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([dist.student_two_sided(a, b) for a, b in zip(t, df)])


@F.pandas_udf(T.DoubleType())
def _chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([dist.chi_square_tail(a, b) for a, b in zip(x, df)])


def welch_t_test(df: DataFrame, numeric: str, group: str) -> DataFrame:
    """Welch's t-test of the first two groups (in group order); no row for fewer than two."""
    groups = (
        df.where(ref(group).isNotNull())
        .groupBy(ref(group).cast("string").alias("g"))
        .agg(
            F.avg(number(df, numeric)).alias("m"),
            F.var_samp(number(df, numeric)).alias("v"),
            F.count(number(df, numeric)).alias("n"),
        )
        .orderBy("g")
        .limit(2)
    )
    both = groups.agg(F.sort_array(F.collect_list(F.struct("g", "m", "v", "n"))).alias("s"))
    a, b = F.col("s")[0], F.col("s")[1]
    sa, sb = a["v"] / a["n"], b["v"] / b["n"]
    scored = both.where(F.size("s") == 2).select(
        ((a["m"] - b["m"]) / F.sqrt(sa + sb)).alias("t"),
        ((sa + sb) * (sa + sb) / (sa * sa / (a["n"] - 1) + sb * sb / (b["n"] - 1))).alias("dof"),
        F.array(a["g"], b["g"]).alias("groups"),
    )
    p = F.col("p")
    return scored.withColumn("p", _student_p("t", "dof")).select(
        F.lit("Welch's t-test").alias("test"),
        F.round("t", 6).alias("t_statistic"),
        F.round("dof", 4).alias("dof"),
        F.round(p, 6).alias("p_value"),
        (p < 0.05).alias("significant"),
        "groups",
    )


def chi_square(df: DataFrame, col_a: str, col_b: str) -> DataFrame:
    """Chi-square test of independence (Yates correction for a 2×2 table).

    Uses sum(O²/(R·C)), which only needs the cells that occur, so the full
    table of category pairs is never formed.
    """
    cells = (
        df.where(ref(col_a).isNotNull() & ref(col_b).isNotNull())
        .groupBy(ref(col_a).alias("a"), ref(col_b).alias("b"))
        .agg(F.count("*").cast("double").alias("o"))
    )
    by_a = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    by_b = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    joined = cells.join(by_a, "a").join(by_b, "b")
    n = cells.agg(F.sum("o")).scalar()
    rows = by_a.agg(F.struct(F.count("*").alias("k"), F.sum(1 / F.col("ra")).alias("inv"))).scalar()
    cols = by_b.agg(F.struct(F.count("*").alias("k"), F.sum(1 / F.col("cb")).alias("inv"))).scalar()
    parts = (
        joined.withColumn("n", n)
        .agg(
            F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("s"),
            F.max(F.abs(F.col("o") - F.col("ra") * F.col("cb") / F.col("n"))).alias("gap"),
            F.max("n").alias("n"),
        )
        .withColumn("rows", rows)
        .withColumn("cols", cols)
    )
    left = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    yates = left * left * F.col("n") * F.col("rows")["inv"] * F.col("cols")["inv"]
    dof = (F.col("rows")["k"] - 1) * (F.col("cols")["k"] - 1)
    scored = parts.select(
        F.when(dof == 1, yates).otherwise(F.col("n") * (F.col("s") - 1)).alias("x"), dof.alias("dof")
    ).where(F.col("dof") > 0)
    p = F.col("p")
    return scored.withColumn("p", _chi_square_p("x", F.col("dof").cast("double"))).select(
        F.lit("Chi-square").alias("test"),
        F.round("x", 6).alias("chi2"),
        F.round(p, 6).alias("p_value"),
        "dof",
        (p < 0.05).alias("significant"),
    )


def mape(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute percentage error; zero actuals are left out."""
    a, p = number(df, actual), number(df, predicted)
    return df.groupBy(*[ref(c) for c in by]).agg(
        F.round(F.avg(F.when(a != 0, F.abs((a - p) / a))), 6).alias("mape")
    )


#: Values between two points at which a distribution is computed first, and values looked at together.
GAP_STEP, GAP_ROWS = 256, 250_000


def _joined(batches, rows: int):
    """Tables of about so many rows from smaller Arrow batches."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _widest_gaps(cdf, v: np.ndarray, below: np.ndarray, upto: np.ndarray) -> tuple[float, float]:
    """How far the empirical distribution (from ``below`` to ``upto`` at each of the sorted values ``v``) rises above another one, and how far it stays below it.

    Both curves rise, so that their values at two points bound every gap in between; only where a bound exceeds what is found, the distribution is computed at
    each value.
    """
    edges = np.unique(np.append(np.arange(0, len(v), GAP_STEP), len(v) - 1))
    at = cdf(v[edges])
    over, under = float((upto[edges] - at).max()), float((at - below[edges]).max())
    wide = (upto[edges[1:]] - at[:-1] > over - 1e-9) | (at[1:] - below[edges[:-1]] > under - 1e-9)
    inner = np.concatenate([edges[:0], *[np.arange(edges[k] + 1, edges[k + 1]) for k in np.flatnonzero(wide)]])
    if len(inner):
        at = cdf(v[inner])
        over, under = max(over, float((upto[inner] - at).max())), max(under, float((at - below[inner]).max()))
    return over, under


def fit_distribution(df: DataFrame, column: str, task_rows: int | None = None) -> DataFrame:
    """Best of normal, exponential, log-normal, gamma and beta by the KS statistic.

    Parameters are the likeliest ones; they follow from means, mean logarithms and bounds (two aggregates), for gamma and beta by Newton steps on
    those. The beta lies between the least and the greatest value, which themselves have no likelihood under it. Values are
    dealt out to ranges of about a task's share and counted there; the CDFs run on those, where bounds between some values leave out
    most others, and only the widest gaps of a range are collected. One row with the ``parameters`` of the chosen one; 'unknown' under 30 values.
    """
    spark = df.sparkSession
    data = df.select(number(df, column).alias("v")).where(F.col("v").isNotNull())
    s = data.agg(
        F.count("*").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("sd"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.avg(F.when(F.col("v") > 0, F.ln("v"))).alias("log_mean"),
        F.stddev_pop(F.when(F.col("v") > 0, F.ln("v"))).alias("log_sd"),
    ).first()
    schema = "distribution string, ks_statistic double, p_value double, is_good_fit boolean, parameters map<string, double>"
    if s.n < 30:
        return spark.createDataFrame([("unknown", None, None, False, None)], schema)
    models: dict[str, dict] = {}
    if s.sd > 0:
        models["norm"] = {"mean": s.mean, "stddev": s.sd}
        models["expon"] = {"loc": s.lo, "scale": s.mean - s.lo}
        if s.lo > 0 and s.log_sd:
            models["lognorm"] = {"log_mean": s.log_mean, "log_stddev": s.log_sd}
            shape = dist.gamma_shape(s.mean, s.log_mean)
            if shape:
                models["gamma"] = {"shape": shape, "scale": s.mean / shape, "loc": 0.0}
        width = s.hi - s.lo
        m, v = (s.mean - s.lo) / width, (s.sd / width) ** 2
        common = m * (1 - m) / v - 1
        if common > 0 and 0 < m < 1:
            share = (F.col("v") - F.lit(s.lo)) / F.lit(width)
            logs = data.where((share > 0) & (share < 1)).agg(F.avg(F.ln(share)).alias("x"), F.avg(F.ln(1 - share)).alias("rest")).first()
            if logs.x is not None:
                a, b = dist.beta_shapes(logs.x, logs.rest, m * common, (1 - m) * common)
                models["beta"] = {"a": a, "b": b, "loc": s.lo, "scale": width}
    if not models:
        return spark.createDataFrame([("unknown", None, None, False, None)], schema)
    names = list(models)

    n = float(s.n)

    # cut by the rows: no more of them, and no more distinct values, lie between two cuts than a task holds
    cuts = np.array(cut_points(data, "v", s.n, task_rows), float)

    def counted(batches):
        """Equal values of some rows are one, so that a frequent value is few rows."""
        for part in _joined(batches, GAP_ROWS):
            v, c = np.unique(part["v"].to_numpy(), return_counts=True)
            bucket = np.searchsorted(cuts, v, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(v), pa.array(c.astype(np.int64))], names=["bucket", "v", "c"])

    def widest(batches):
        """Per bucket its rows, and the widest gaps above and below as if it were the first one; an earlier row adds to the first and takes from the second."""

        def found(bucket, held):
            rows = pa.Table.from_batches(held)
            v, place = np.unique(rows["v"].to_numpy(), return_inverse=True)
            upto = np.cumsum(np.bincount(place, rows["c"].to_numpy()))
            below, above = np.append(0.0, upto[:-1]) / n, upto / n
            gaps = [_widest_gaps(lambda x, name=name: dist.cdf(name, x, models[name]), v, below, above) for name in names]
            columns = [pa.array([bucket]), pa.array([int(upto[-1])]), pa.array([[g[0] for g in gaps]]), pa.array([[g[1] for g in gaps]])]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "rows", "over", "under"])

        current, held = None, []
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            starts = np.flatnonzero(np.diff(buckets, prepend=-1))
            for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(buckets)]):
                if held and buckets[x] != current:
                    yield found(current, held)
                    held = []
                current = int(buckets[x])
                held.append(batch.slice(x, y - x))
        if held:
            yield found(current, held)

    dealt = data.mapInArrow(counted, "bucket int, v double, c long").repartition(len(cuts) + 1, "bucket").sortWithinPartitions("bucket")
    row, earlier = dict.fromkeys(names, -math.inf), 0
    found = dealt.mapInArrow(widest, "bucket long, rows long, over array<double>, under array<double>").collect()  # a row per range
    for r in sorted(found, key=lambda r: r.bucket):
        row = {name: max(row[name], r.over[i] + earlier / n, r.under[i] - earlier / n) for i, name in enumerate(names)}
        earlier += r.rows
    best = min(names, key=lambda name: row[name])
    p = dist.kolmogorov_tail(row[best], n)
    return spark.createDataFrame(
        [(best, round(row[best], 6), round(p, 6), p > 0.05, {k: float(v) for k, v in models[best].items()})], schema
    )
