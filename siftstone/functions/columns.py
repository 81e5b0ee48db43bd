"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed import DATETIME_FORMATS, NULL_TOKENS

LONG_TEXT = 64


def ref(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def kind_of(dtype: T.DataType) -> str:
    """numeric, datetime, text, boolean or unknown."""
    if is_numeric(dtype):
        return "numeric"
    if is_temporal(dtype) or isinstance(dtype, T.DayTimeIntervalType):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "unknown"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def number(df: DataFrame, name: str) -> Column:
    """The column as double with NaN read as null."""
    dtype = df.schema[name].dataType
    value = ref(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        value = value.cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        value = value.try_cast("double")
        return F.when(~F.isnan(value), value)
    return value.cast("double")


def moment(df: DataFrame, name: str) -> Column:
    """The column as timestamp; strings go through the lenient parser."""
    if kind_of(df.schema[name].dataType) == "text":
        return parse_datetime(ref(name))
    return ref(name).cast("timestamp")


def blank_to_null(value: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    return F.when(~value.isin(list(tokens)), value)


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def parse_number(value: Column) -> Column:
    """Currency and percent signs and thousands separators removed, then a lenient cast."""
    return strip(F.regexp_replace(value, "[,$€£%]", "")).try_cast("double")


def parse_datetime(value: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(fmt)) for fmt in DATETIME_FORMATS])


def as_text(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(F.struct(ref(name).alias("v")))
    if isinstance(dtype, T.BinaryType):
        return F.hex(ref(name))
    return ref(name).cast("string")


def value_key(text: Column) -> Column:
    """Grouping key of a value: short text itself, long text by its SHA-256.

    Keeps whole texts out of the shuffle. A digest key is longer than any
    short value, so the two never meet.
    """
    return F.when(F.length(text) <= LONG_TEXT, text).otherwise(
        F.concat(F.lit("sha256:"), F.sha2(text, 256))
    )


def long_form(df: DataFrame, columns: Sequence[str], value) -> DataFrame:
    """One row per (row, column): ``column_name, value``. Unpivot stays inside generated code."""
    narrow = df.select(*[value(df, c).alias(c) for c in columns])
    return narrow.unpivot([], [ref(c) for c in columns], "column_name", "value")


def row_fingerprint(columns: Iterable[str], df: DataFrame) -> Column:
    """128-bit fingerprint of a whole row; null flags keep (null, x) apart from (x, null)."""
    names = list(columns)
    values = [
        F.to_json(F.struct(ref(c).alias("v"))) if isinstance(df.schema[c].dataType, T.MapType) else ref(c)
        for c in names
    ]
    flags = [v.isNull() for v in values]
    return F.struct(
        F.xxhash64(*values, *flags).alias("h1"),
        F.xxhash64(F.lit("second"), *reversed(values), *flags).alias("h2"),
    )


# ── stable content keys ─────────────────────────────────────────────────────


def content_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by ':' (model and prompt, dataset and chunk number …)."""
    return F.sha2(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def prompt_key(model: Column, prompt: Column) -> Column:
    return content_key(model, prompt)


def chunk_key(dataset: Column, index: Column) -> Column:
    return content_key(dataset, F.lit("chunk"), index.cast("string"))


def short_hash(text: Column, length: int = 8) -> Column:
    if not 1 <= length <= 64:
        raise ValueError(f"length must be between 1 and 64, got {length}")
    return F.substring(F.sha2(text, 256), 1, length)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object text with sorted keys and ', ' / ': ' separators."""
    members = []
    for name in sorted(fields):
        literal = F.regexp_extract(F.to_json(F.array(fields[name])), r"(?s)^\[(.*)\]$", 1)
        members.append(F.concat(F.lit(f'"{name}": '), literal))
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def fixed_point(value: Column, digits: int = 2) -> Column:
    """Plain decimal text of a double (``string(double)`` may use an exponent)."""
    return F.round(value, digits).cast(f"decimal(38,{digits})").cast("string")


def grade(score: Column) -> Column:
    return (
        F.when(score >= 0.95, "A")
        .when(score >= 0.85, "B")
        .when(score >= 0.70, "C")
        .when(score >= 0.55, "D")
        .otherwise("F")
    )


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).otherwise(3)
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys of ``left`` are kept."""
    if not keys:
        raise ValueError("no join keys")
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = None
    for key in keys:
        part = ref(key).eqNullSafe(ref(f"_right_{key}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])
