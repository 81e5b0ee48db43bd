"""Cleaning: whitespace, duplicates, type coercion, missing values, outlier clipping."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import blank_to_null, kind_of, number, parse_datetime, parse_number, ref, strip
from ..session import cut_lineage
from .quantiles import column_quantiles
from .statistics import top_value_counts

HIGH_NULL_RATE = 0.80
#: Up to here every whole number is a double.
EXACT_DOUBLE = 2**53
TO_NUMBER = ("currency", "numeric_measure", "numeric_count", "percentage")
TO_DATETIME = ("date", "datetime")
STEP = "step_no int, action string, `column` string, rows_affected long, description string"


@dataclass(frozen=True)
class Cleaned:
    """The cleaned rows, the steps taken and a one-row report."""

    data: DataFrame
    steps: DataFrame
    report: DataFrame


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if kind_of(f.dataType) == "text"]


def strip_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: strip(ref(c)) for c in _text_columns(df)})


def normalise_nulls(df: DataFrame) -> DataFrame:
    """Texts such as 'N/A' become null."""
    return df.withColumns({c: blank_to_null(ref(c)) for c in _text_columns(df)})


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row duplicates; equal rows merge map-side before the shuffle."""
    return df.dropDuplicates()


def coerce_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Text columns with a numeric or date type are parsed; unreadable values become null."""
    parsed = {}
    for c in _text_columns(df):
        if types.get(c) in TO_NUMBER:
            parsed[c] = parse_number(ref(c))
        elif types.get(c) in TO_DATETIME:
            parsed[c] = parse_datetime(ref(c))
    return df.withColumns(parsed) if parsed else df


def null_counts(df: DataFrame) -> dict[str, int]:
    """Rows (key ``None``) and nulls per column, NaN counted as null; one row is read."""
    missing = [
        F.count_if((number(df, f.name) if kind_of(f.dataType) == "numeric" else ref(f.name)).isNull())
        for f in df.schema
    ]
    row = df.agg(F.count("*"), *missing).first()
    return {None: row[0], **dict(zip(df.columns, row[1:]))}


def fill_values(df: DataFrame, columns, rows: int | None = None) -> dict[str, object]:
    """Median of numeric and most frequent value of text columns; one row per column is read."""
    kinds = {c: kind_of(df.schema[c].dataType) for c in columns}
    numeric = [c for c, k in kinds.items() if k == "numeric"]
    text = [c for c, k in kinds.items() if k == "text"]
    fill: dict[str, object] = {}
    if numeric:
        for r in column_quantiles(df, numeric, [0.5], rows=rows).collect():
            if r.q and r.q[0] is not None:
                fill[r.column_name] = r.q[0]
    if text:
        fill.update(dict.fromkeys(text, ""))
        fill.update({r.column_name: r.value for r in top_value_counts(df, text, 1).collect()})
    return fill


def impute(df: DataFrame, fill: Mapping[str, object]) -> DataFrame:
    """Nulls (and NaN) filled in the column's own type, so that present values stay as they are.

    A fractional fill turns a column of whole numbers into doubles, unless it holds values that a double cannot: then the fill is
    rounded.
    """
    numeric = [c for c in fill if kind_of(df.schema[c].dataType) == "numeric"]
    fractional = [c for c in numeric if _is_whole(df, c) and float(fill[c]) != math.floor(float(fill[c]))]
    wide = {}
    if fractional:
        beyond = df.agg(*[F.max(F.abs(ref(c).cast("decimal(38,0)"))).alias(str(i)) for i, c in enumerate(fractional)]).first()
        wide = {c: (beyond[i] or 0) <= EXACT_DOUBLE for i, c in enumerate(fractional)}
    filled = {}
    for c, v in fill.items():
        dtype = df.schema[c].dataType
        if c not in numeric:
            filled[c] = F.coalesce(ref(c), F.lit(v))
        elif wide.get(c):
            filled[c] = F.coalesce(number(df, c), F.lit(v).cast("double"))
        else:
            own = F.round(F.lit(float(v))).cast(dtype) if _is_whole(df, c) else F.lit(float(v)).cast(dtype)
            filled[c] = F.when(number(df, c).isNull(), own).otherwise(ref(c))
    return df.withColumns(filled) if filled else df


def _is_whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def clip_bounds(df: DataFrame, columns, multiplier: float = 3.0) -> dict[str, tuple[float, float]]:
    out = {}
    for r in column_quantiles(df, columns, [0.25, 0.75]).collect():
        if r.q and r.q[0] is not None:
            iqr = r.q[1] - r.q[0]
            out[r.column_name] = (r.q[0] - multiplier * iqr, r.q[1] + multiplier * iqr)
    return out


def clip(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values beyond the bounds move to the bound, all others stay as they are; nulls stay null.

    The column keeps its type: whole numbers move to the whole number next inside the bound.
    """
    clipped = {}
    for c, (low, high) in bounds.items():
        v, dtype = number(df, c), df.schema[c].dataType
        first, last = (math.ceil(low), math.floor(high)) if _is_whole(df, c) else (low, high)
        clipped[c] = F.when(v < low, F.lit(first).cast(dtype)).when(v > high, F.lit(last).cast(dtype)).otherwise(ref(c))
    return df.withColumns(clipped) if clipped else df


def clean(
    df: DataFrame,
    types: Mapping[str, str],
    dedup: bool = True,
    coerce: bool = True,
    impute_missing: bool = True,
    clip_outliers: bool = False,
    null_tokens: bool = False,
    high_null_rate: float = HIGH_NULL_RATE,
    clip_multiplier: float = 3.0,
) -> Cleaned:
    """Strip, deduplicate, coerce, drop or fill, optionally clip.

    The null rate of the raw column decides what is dropped or filled; medians
    and modes are taken after deduplication and coercion. Deduplicated rows are written once
    to the checkpoint folder, as counts, medians and the result all read them; without
    deduplication nothing is written.
    """
    steps: list[tuple] = []

    def note(action, column, rows, text):
        steps.append((len(steps) + 1, action, column, int(rows), text))

    raw = normalise_nulls(df) if null_tokens else df
    before = null_counts(raw)
    rows_before = before[None]
    work = strip_text(raw)
    if dedup:
        work = cut_lineage(drop_duplicates(work))
    stripped_nulls = null_counts(work)
    rows_after = stripped_nulls[None]
    if dedup and rows_before > rows_after:
        removed = rows_before - rows_after
        note("remove_duplicates", None, removed,
             f"Removed {removed:,} duplicate rows ({removed / rows_before * 100:.1f}% of dataset).")
    if coerce:
        texts = [c for c in _text_columns(work) if types.get(c) in TO_NUMBER + TO_DATETIME]
        work = coerce_types(work, types)
        for c in texts:
            kept = rows_after - stripped_nulls[c]
            if types[c] in TO_NUMBER:
                note("coerce_to_float", c, kept,
                     f"Coerced '{c}' from string to float (removed currency symbols).")
            else:
                note("coerce_to_datetime", c, kept, f"Coerced '{c}' from string to datetime.")
    if impute_missing:
        rate = {c: before[c] / rows_before if rows_before else 0.0 for c in work.columns}
        sparse = [c for c in work.columns if rate[c] >= high_null_rate]
        work = work.drop(*sparse)
        for c in sparse:
            note("drop_column_high_null", c, 0,
                 f"Dropped column '{c}' ({rate[c] * 100:.0f}% nulls — exceeds threshold).")
        gaps = [
            c for c in work.columns
            if rate[c] > 0 and kind_of(work.schema[c].dataType) in ("numeric", "text")
        ]
        if gaps:
            # only parsing adds nulls to those counted after stripping
            missing = null_counts(work) if coerce and texts else stripped_nulls
            fill = fill_values(work, gaps, rows_after)
            for c in gaps:
                if c in fill:
                    numeric = kind_of(work.schema[c].dataType) == "numeric"
                    note("impute_median" if numeric else "impute_mode", c, missing[c],
                         f"Imputed missing values in '{c}' with column {'median' if numeric else 'mode'}.")
            work = impute(work, fill)
    if clip_outliers:
        numeric = [f.name for f in work.schema if kind_of(f.dataType) == "numeric"]
        bounds = clip_bounds(work, numeric, clip_multiplier) if numeric else {}
        if bounds:
            outside = work.agg(
                *[F.count_if((number(work, c) < lo) | (number(work, c) > hi)).alias(c) for c, (lo, hi) in bounds.items()]
            ).first()
            bounds = {c: b for c, b in bounds.items() if outside[c]}
            for c, (lo, hi) in bounds.items():
                note("clip_outlier", c, outside[c],
                     f"Clipped {outside[c]:,} extreme outliers in '{c}' to [{lo:.4g}, {hi:.4g}].")
            work = clip(work, bounds)
    spark = df.sparkSession
    imputed = [s[2] for s in steps if s[1].startswith("impute")]
    dropped = [s[2] for s in steps if s[1] == "drop_column_high_null"]
    report = spark.createDataFrame(
        [(rows_before, rows_after, len(df.columns), len(work.columns), rows_before - rows_after,
          len(dropped), imputed, dropped)],
        "rows_before long, rows_after long, columns_before int, columns_after int, rows_removed long, "
        "columns_removed int, imputed_columns array<string>, dropped_columns array<string>",
    )
    return Cleaned(work, spark.createDataFrame(steps, STEP), report)
