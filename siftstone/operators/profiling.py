"""Whole-table profile and semantic types."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.columns import grade, is_temporal, kind_of, number, ref, row_fingerprint
from ..session import cut_lineage
from .quantiles import counted_quantiles, shared_cuts
from .sketches import sketch_columns, sketched_statistics
from .statistics import (
    SHARES, narrow_moments, numeric_values, restore_values, spread_of_totals, value_relation,
)


@dataclass(frozen=True)
class TableProfile:
    """``columns``: one row per column; ``table``: one row."""

    columns: DataFrame
    table: DataFrame


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: ``row_count, duplicate_count``. Only 16-byte fingerprints are shuffled."""
    prints = df.select(row_fingerprint(df.columns, df).alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    return prints.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"),
    )


def _wide(df: DataFrame) -> DataFrame:
    """Counts, text lengths and date ranges of every column in one scan without a shuffle."""
    aggregates, structs = [F.count("*").alias("_rows")], []
    for i, field in enumerate(df.schema):
        kind = kind_of(field.dataType)
        value = number(df, field.name) if kind == "numeric" else ref(field.name)
        named = {"non_null_count": F.count(value)}
        if kind == "text":
            length = F.char_length(ref(field.name))
            named.update(
                min_length=F.min(length), max_length=F.max(length), avg_length=F.round(F.avg(length), 2),
                has_whitespace=F.max(ref(field.name).rlike(r"(?U)^\s|\s$")),
            )
        elif kind == "datetime":
            named.update(min_date=F.min(ref(field.name)).cast("string"), max_date=F.max(ref(field.name)).cast("string"))
        aggregates += [e.alias(f"{n}__{i}") for n, e in named.items()]
        have = lambda n, t: (F.col(f"{n}__{i}") if n in named else F.lit(None)).cast(t).alias(n)
        structs.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.lit(kind).alias("kind"),
                F.col("_rows").alias("total_rows"),
                have("non_null_count", "long"),
                have("min_length", "int"), have("max_length", "int"), have("avg_length", "double"),
                have("has_whitespace", "boolean"), have("min_date", "string"), have("max_date", "string"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*structs)))


def _shown(df: DataFrame) -> Column:
    """Text of a value-relation row; dates and booleans are turned back by column."""
    text = F.coalesce(F.col("vs"), F.col("vd").cast("string"), F.col("vl").cast("string"))
    for field in df.schema:
        here = F.col("column_name") == field.name
        if isinstance(field.dataType, T.DateType):
            text = F.when(here, F.date_from_unix_date(F.col("vl").cast("int")).cast("string")).otherwise(text)
        elif is_temporal(field.dataType):
            text = F.when(here, F.timestamp_micros("vl").cast("string")).otherwise(text)
        elif isinstance(field.dataType, T.BooleanType):
            text = F.when(here, (F.col("vl") == 1).cast("string")).otherwise(text)
    return text


def sample_values(df: DataFrame, counted: DataFrame, size: int = 5) -> DataFrame:
    """Up to five values per column, chosen by hash so that reruns agree."""
    order = Window.partitionBy("column_name").orderBy(F.xxhash64("vl", "vd", "vs"), "vl", "vd", "vs")
    few = (
        counted.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= size)
        .select("column_name", _shown(df).alias("key"), "_r")
    )
    return (
        restore_values(df, few)
        .groupBy("column_name")
        .agg(F.sort_array(F.collect_list(F.struct("_r", "value"))).alias("s"))
        .select("column_name", F.col("s.value").alias("sample_values"))
    )


def _counted_totals(relation: DataFrame) -> DataFrame:
    return relation.groupBy("column_name").agg(
        F.sum("n").alias("total"), F.count("*").alias("categories"), F.sum(F.col("n") * F.log2("n")).alias("nlogn")
    )


def _fences(df: DataFrame, quantiles: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Fences of each column from its quartiles, and in one scan the values outside; one row per column is read."""
    found = []
    for r in quantiles.collect():
        iqr = r.q[3] - r.q[1]
        found.append((r.column_name, round(iqr, 6), round(r.q[1] - multiplier * iqr, 6), round(r.q[3] + multiplier * iqr, 6)))
    outside = df.agg(F.lit(0), *[F.count_if((number(df, c) < low) | (number(df, c) > high)) for c, _, low, high in found]).first()
    rows = [(*f, outside[i]) for i, f in enumerate(found, 1)]
    return df.sparkSession.createDataFrame(rows, "column_name string, iqr double, tukey_lower double, tukey_upper double, outlier_count_iqr long")


def _sketched_columns(df: DataFrame) -> DataFrame:
    """The column rows from one pass of mergeable aggregates; what needs every value's count (entropy, samples, values outside the fences, shape) stays null."""
    known = sketched_statistics(sketch_columns(df)).select("column_name", F.col("unique_estimate").alias("categories"), "mean", "stddev_samp", "min_val", "max_val", "q")
    iqr = F.col("q")[3] - F.col("q")[1]
    nulls = {c: F.lit(None).cast("double") for c in ("skewness", "kurtosis", "entropy", "normalised_entropy", "top3_coverage")}
    return _wide(df).join(F.broadcast(known), "column_name", "left").withColumns({
        "stddev": F.col("stddev_samp"), "variance": F.col("stddev_samp") * F.col("stddev_samp"), "iqr": F.round(iqr, 6),
        "tukey_lower": F.round(F.col("q")[1] - 1.5 * iqr, 6), "tukey_upper": F.round(F.col("q")[3] + 1.5 * iqr, 6),
        "outlier_count_iqr": F.lit(None).cast("long"), "sample_values": F.lit(None).cast("array<string>"), **nulls,
    })


def profile_columns(df: DataFrame, samples: bool = True, approx: bool = False) -> DataFrame:
    """One row per column: completeness, distinct values, moments, percentiles,
    lengths, date range, entropy and sample values.

    Narrow scans give counts, moments, lengths, ranges and values outside the fences; distinct counts, percentiles, entropy
    and samples are read from the value relation, which is written once to the checkpoint folder.
    So is the result (one row per column), as scores, cards and chunks read it
    again. The joins match tables of one row per column.

    ``approx``: distinct counts and percentiles come from sketches, in narrow scans that shuffle no values; entropy, shape, samples and
    values outside the fences stay null.
    """
    if approx:
        return _column_rows(_sketched_columns(df))
    numeric = [f.name for f in df.schema if kind_of(f.dataType) == "numeric"]
    others = [c for c in df.columns if c not in numeric]
    relations = [cut_lineage(value_relation(df, names)) for names in (numeric, others) if names]
    counted = relations[0].unionAll(relations[1]) if len(relations) == 2 else relations[0]
    totals = []
    if numeric:
        values = numeric_values(relations[0])
        quantiles = counted_quantiles(values, ["column_name"], SHARES, shared_cuts(df, numeric, df.count()))
        quantiles = cut_lineage(quantiles.repartition(1))
        totals.append(_counted_totals(relations[0]))
        spread = narrow_moments(df, numeric).join(F.broadcast(_fences(df, quantiles)), "column_name", "left")
    if others:
        totals.append(_counted_totals(relations[-1]))
    all_totals = totals[0].unionAll(totals[1]) if len(totals) == 2 else totals[0]
    out = _wide(df).join(F.broadcast(spread_of_totals(all_totals, counted)), "column_name", "left")
    if samples:
        out = out.join(F.broadcast(sample_values(df, counted)), "column_name", "left")
    else:
        out = out.withColumn("sample_values", F.lit(None).cast("array<string>"))
    if numeric:
        moments = spread.select(
            "column_name", "mean", F.col("stddev_samp").alias("stddev"), F.col("var_samp").alias("variance"),
            "min_val", "max_val", F.col("g1").alias("skewness"), F.col("g2").alias("kurtosis"),
            "iqr", "tukey_lower", "tukey_upper", "outlier_count_iqr",
        )
        for part in (moments, quantiles):
            out = out.join(F.broadcast(part), "column_name", "left")
    else:
        empty = dict.fromkeys(
            ("mean", "stddev", "variance", "min_val", "max_val", "skewness", "kurtosis", "iqr", "tukey_lower",
             "tukey_upper"), "double")
        empty |= {"q": "array<double>", "outlier_count_iqr": "long"}
        out = out.withColumns({n: F.lit(None).cast(t) for n, t in empty.items()})
    return _column_rows(out)


def _column_rows(out: DataFrame) -> DataFrame:
    q, rows, n = F.col("q"), F.col("total_rows"), F.col("non_null_count")
    distinct = F.coalesce(F.col("categories"), F.lit(0))
    ratio = F.coalesce(distinct / F.nullif(n, F.lit(0)), F.lit(0.0))
    result = out.select(
        "ordinal", "column_name", "data_type", "kind", "total_rows", "non_null_count",
        (rows - n).alias("null_count"),
        F.coalesce(F.round((rows - n) / F.nullif(rows, F.lit(0)), 6), F.lit(0.0)).alias("null_rate"),
        F.coalesce(F.round(n / F.nullif(rows, F.lit(0)), 6), F.lit(1.0)).alias("completeness"),
        distinct.alias("unique_count"),
        F.round(ratio, 6).alias("cardinality_ratio"),
        (ratio > 0.5).alias("is_high_cardinality"),
        (distinct == 1).alias("is_constant"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        *[F.round(c, 6).alias(c) for c in ("mean", "stddev", "variance")],
        "min_val", "max_val",
        *[F.round(q[i], 6).alias(name) for i, name in enumerate(("p05", "p25", "p50", "p75", "p95"))],
        F.round("skewness", 6).alias("skewness"),
        F.round("kurtosis", 6).alias("kurtosis"),
        F.round(F.abs(F.col("stddev") / F.nullif(F.col("mean"), F.lit(0.0))), 6).alias("cv"),
        "iqr", "tukey_lower", "tukey_upper", "outlier_count_iqr",
        "entropy", "normalised_entropy", "top3_coverage",
        "min_length", "max_length", "avg_length", "has_whitespace", "min_date", "max_date",
    )
    return cut_lineage(result.coalesce(1))


def summarise_profile(columns: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row about the table from the column rows and the duplicate count."""
    totals = columns.agg(
        F.count("*").alias("column_count"),
        F.sum("null_count").alias("missing_cells"),
        F.sum("total_rows").alias("_cells"),
        F.bool_or(F.col("kind") == "datetime").alias("has_time_series"),
    )
    d = duplicates.agg(F.struct(F.first("row_count").alias("r"), F.first("duplicate_count").alias("d"))).scalar()
    scored = totals.withColumn("_d", d).select(
        F.col("_d.r").alias("row_count"),
        "column_count",
        F.col("_d.d").alias("duplicate_count"),
        "missing_cells",
        F.coalesce(F.round(1 - F.col("missing_cells") / F.nullif(F.col("_cells"), F.lit(0)), 6), F.lit(1.0)).alias(
            "completeness_score"
        ),
        F.coalesce(F.round(1 - F.col("_d.d") / F.nullif(F.col("_d.r"), F.lit(0)), 6), F.lit(1.0)).alias(
            "consistency_score"
        ),
        "has_time_series",
    )
    overall = F.round((F.col("completeness_score") + F.col("consistency_score")) / 2, 4)
    return scored.withColumn("overall_quality", overall).withColumn(
        "quality_grade", grade(F.col("overall_quality"))
    )


def profile_table(df: DataFrame, match: str = "substring", approx: bool = False) -> TableProfile:
    """Profile with semantic types. The column rows are computed at once, the table row when read. ``approx``: see ``profile_columns``."""
    columns = infer_semantic_types(profile_columns(df, approx=approx), match)
    return TableProfile(columns, summarise_profile(columns, duplicate_rows(df)))


# ── semantic types ──────────────────────────────────────────────────────────

_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _mentions(name: Column, words: Sequence[str], match: str) -> Column:
    if match == "substring":
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(name, F.lit(word))
        return hit
    if match != "token":
        raise ValueError(f"match must be 'substring' or 'token', not {match!r}")
    tokens = F.split(name, r"[^\p{L}\p{N}%$£€]+")
    return F.arrays_overlap(tokens, F.array(*[F.lit(w.strip("_")) for w in words]))


def infer_semantic_types(columns: DataFrame, match: str = "substring") -> DataFrame:
    """Adds ``semantic_type, confidence, needs_review`` to profile rows.

    Works on one row per column; needs column_name, data_type, kind,
    sample_values, unique_count, total_rows and null_count.
    """
    name, dtype, kind = F.lower("column_name"), F.col("data_type"), F.col("kind")
    says = lambda words: _mentions(name, words, match)
    integer = dtype.isin(*_INTEGERS)
    filled = F.greatest(F.col("total_rows") - F.col("null_count"), F.lit(1))
    few = F.col("unique_count") / filled <= 0.05
    text = kind == "text"
    rules = [
        (dtype == "date", "date", 1.0),
        (kind == "datetime", "datetime", 1.0),
        (kind == "boolean", "boolean", 1.0),
        (says(fixed.EMAIL_WORDS) & F.contains(F.concat_ws(" ", "sample_values"), F.lit("@")), "email", 0.95),
        (says(fixed.PHONE_WORDS), "phone", 0.85),
        (says(fixed.PERCENT_WORDS), "percentage", 0.85),
        (says(fixed.CURRENCY_WORDS), "currency", 0.90),
        (integer & says(fixed.COUNT_WORDS), "numeric_count", 0.85),
        (integer & says(fixed.ID_WORDS), "identifier", 0.80),
        (integer, "numeric_count", 0.70),
        ((kind == "numeric") & says(fixed.COUNT_WORDS), "numeric_count", 0.80),
        (kind == "numeric", "numeric_measure", 0.75),
        (text & says(fixed.DATE_WORDS), "datetime", 0.70),
        (text & says(fixed.ID_WORDS), "identifier", 0.75),
        (text & few, "categorical", 0.80),
        (text, "free_text", 0.50),
    ]
    which, confidence = F.when(*_case(rules[0], 1)), F.when(*_case(rules[0], 2))
    for rule in rules[1:]:
        which, confidence = which.when(*_case(rule, 1)), confidence.when(*_case(rule, 2))
    semantic = which.otherwise("unknown")
    return columns.withColumns(
        {
            "semantic_type": semantic,
            "confidence": confidence.otherwise(0.0),
            "needs_review": semantic.isin("free_text", "unknown"),
        }
    )


def _case(rule, index):
    return rule[0], F.lit(rule[index])


def schema_columns(columns: DataFrame) -> DataFrame:
    """Column descriptors: name, type, nullability, key candidate."""
    return columns.select(
        "ordinal", F.col("column_name").alias("name"), "data_type", "semantic_type", "confidence",
        (F.col("null_count") > 0).alias("nullable"),
        F.round("null_rate", 4).alias("null_rate"),
        "unique_count",
        F.col("null_count").alias("missing_count"),
        "sample_values",
        ((F.col("semantic_type") == "identifier") & (F.col("unique_count") == F.col("total_rows"))).alias(
            "is_primary_key"
        ),
    )


def schema_summary(columns: DataFrame) -> DataFrame:
    stype = F.col("semantic_type")
    return columns.agg(
        F.max("total_rows").alias("row_count"),
        F.count("*").alias("column_count"),
        F.coalesce(F.bool_or(stype.isin("date", "datetime")), F.lit(False)).alias("has_time_series"),
        F.count_if(stype.isin("currency", "numeric_measure", "numeric_count", "percentage")).alias(
            "numeric_column_count"
        ),
        F.count_if("needs_review").alias("ambiguous_count"),
    )


def target_priority(semantic_type: Column) -> Column:
    return (
        F.when(semantic_type == "currency", 0)
        .when(semantic_type == "numeric_measure", 1)
        .when(semantic_type == "numeric_count", 2)
    )


def forecast_candidates(columns: DataFrame, min_rows: int = 30) -> DataFrame:
    """Date columns and numeric targets in order of preference, with the viability verdict."""
    stype = F.col("semantic_type")
    listed = columns.select(
        "ordinal", "column_name", "semantic_type", "total_rows",
        F.when(stype.isin("date", "datetime"), "date").when(target_priority(stype).isNotNull(), "target").alias("role"),
        F.coalesce(target_priority(stype), F.lit(0)).alias("_p"),
    )
    names = lambda role: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("_p", "ordinal", "column_name")))),
        lambda s: s["column_name"],
    )
    one = listed.agg(
        F.max("total_rows").alias("n"), names("date").alias("date_columns"), names("target").alias("target_columns")
    )
    reason = (
        F.when(F.size("date_columns") == 0, "No datetime columns detected")
        .when(F.size("target_columns") == 0, "No numeric target columns detected")
        .when(F.col("n") < min_rows, F.concat(F.lit("Insufficient data ("), F.col("n").cast("string"),
                                             F.lit(f" rows, need ≥ {min_rows})")))
        .otherwise("Forecasting conditions met")
    )
    return one.select(
        (reason == "Forecasting conditions met").alias("viable"), reason.alias("reason"),
        "date_columns", "target_columns",
    )


def ml_target(columns: DataFrame) -> DataFrame:
    """The column to predict: first currency, then measure, then count."""
    return (
        columns.withColumn("_p", target_priority(F.col("semantic_type")))
        .where(F.col("_p").isNotNull())
        .orderBy("_p", "ordinal")
        .limit(1)
        .select("column_name", "semantic_type")
    )


def types_of(columns: DataFrame) -> dict[str, str]:
    """column name -> semantic type (one row per column reaches the driver)."""
    return {r.column_name: r.semantic_type for r in columns.select("column_name", "semantic_type").collect()}
