"""File sources: landing catalogue, upload checks, dataset readers, file streams."""

from __future__ import annotations

import csv
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.columns import blank_to_null, ref
from ..session import cut_lineage
from . import ranges, records

HEAD_BYTES = 8192
SNIFF_CHARS = 4096
SNIFFED = T.StructType([
    T.StructField("delimiter", T.StringType()), T.StructField("has_header", T.BooleanType()), T.StructField("has_quotes", T.BooleanType()),
])
# Spark's names of the encodings; its UTF-16 reads the byte order from the mark and drops it
CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "utf-16-le": "UTF-16", "utf-16-be": "UTF-16"}


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _format_of(extension: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, form in fixed.FORMAT_BY_EXTENSION.items():
        out = F.when(extension == name, form).otherwise(out)
    return out


def _encoding_of(head: Column, utf8: Column) -> Column:
    mark = F.hex(F.substring(head, 1, 3))
    return (
        F.when(mark.startswith("FFFE"), "utf-16-le")
        .when(mark.startswith("FEFF"), "utf-16-be")
        .when(~utf8, "latin-1")
        .when(mark == "EFBBBF", "utf-8-sig")
        .otherwise("utf-8")
    )


@F.pandas_udf(SNIFFED)
def _sniff(head: pd.Series, encoding: pd.Series) -> pd.DataFrame:
    """Delimiter and header guess of the first characters of each file."""
    found = []
    for raw, name in zip(head, encoding):
        text = bytes(raw).decode(name, errors="replace")[:SNIFF_CHARS]
        try:
            dialect = csv.Sniffer().sniff(text, delimiters=",\t;|")
            found.append((dialect.delimiter, bool(csv.Sniffer().has_header(text)), '"' in text))
        except csv.Error:
            found.append((",", True, '"' in text))
    return pd.DataFrame(found, columns=["delimiter", "has_header", "has_quotes"])


def _binary(spark: SparkSession, path: str) -> DataFrame:
    """Files of a store that only Spark opens; their content comes whole, and empty ones are passed over."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def _samples(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, head, utf8, quotes`` of every file, from a few pieces of it; beyond the upload limit only where ranges can be read."""
    if ranges.open_store(path):
        return ranges.with_samples(ranges.listing(spark, path), path).select("path", "length", "head", "utf8", "quotes")
    text = F.col("content").cast("string")
    read = _binary(spark, path).where(F.col("length") <= fixed.MAX_UPLOAD_BYTES).select(
        "path", "length", F.substring("content", 1, HEAD_BYTES).alias("head"), F.is_valid_utf8(text).alias("utf8"), text.contains('"').alias("quotes")
    )
    large = _binary(spark, path).select("path", "length").where(F.col("length") > fixed.MAX_UPLOAD_BYTES)
    return read.unionAll(large.selectExpr("path", "length", "CAST(NULL AS BINARY) AS head", "true AS utf8", "false AS quotes"))


def catalog_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: format (magic bytes, then extension, else csv), encoding, CSV layout.

    Folders are listed in tasks, and of each file only its head, three inner pieces and its tail are read, however large it is. The encoding is what those
    pieces show; ``load_dataset`` decides on whole files.
    """
    extension = _extension(F.col("path"))
    magic = F.coalesce(F.hex(F.substring("head", 1, 6)), F.lit(""))
    form = (
        F.when(magic.startswith("504B0304") | magic.startswith("D0CF11E0"), "excel")
        .when(magic.startswith("50415231") | magic.startswith("FFFE50415231"), "parquet")
        .otherwise(F.coalesce(_format_of(extension), F.lit("csv")))
    )
    listed = _samples(spark, path).select(
        "path", "length", extension.alias("extension"), form.alias("format"), "head", "quotes",
        F.when((form == "csv") & F.col("head").isNotNull(), _encoding_of(F.col("head"), F.col("utf8"))).otherwise("utf-8").alias("encoding"),
    )
    text = (F.col("format") == "csv") & (F.length("head") > 0)
    # sniffed in the task that reads the head; a file without one has the defaults
    sniffed = listed.withColumn("s", _sniff(F.when(text, F.col("head")).otherwise(F.lit(b"")), "encoding"))
    newline = (F.col("format") == "json") & F.col("extension").isin("jsonl", "ndjson")
    return sniffed.select(
        "path", "length", "extension", "format", "encoding",
        F.col("s.delimiter").alias("delimiter"), F.col("s.has_header").alias("has_header"),
        (F.coalesce(text, F.lit(False)) & F.col("quotes")).alias("has_quotes"), newline.alias("is_newline_json"),
    )


def check_uploads(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Accept or reject each file: empty, unsupported, too large, or a duplicate by SHA-256.

    ``known`` holds the ``checksum`` of earlier files. Of equal new files the first path is accepted; copies meet one row per checksum.
    Files are listed in tasks and hashed as they stream by, so that none has to fit a row.
    """
    whole = ranges.open_store(path) is None
    listed = cut_lineage((_binary(spark, path) if whole else ranges.listing(spark, path)).select("path", "length"))
    rule = (
        F.when(F.col("length") == 0, "empty")
        .when(_format_of(_extension(F.col("path"))).isNull(), "unsupported")
        .when(F.col("length") > fixed.MAX_UPLOAD_BYTES, "too large")
    )
    judged = listed.withColumn("rule", rule)
    sized = (F.col("length") > 0) & (F.col("length") <= fixed.MAX_UPLOAD_BYTES)
    if whole:
        hashed = _binary(spark, path).where(sized).select("path", F.sha2("content", 256).alias("checksum"))
    else:
        hashed = ranges.with_checksums(listed.where(sized), path)
    hashed = cut_lineage(hashed)
    valid = judged.where(F.col("rule").isNull()).select("path")
    first = hashed.join(valid, "path", "left_semi").groupBy("checksum").agg(F.min("path").alias("first_path"))
    out = judged.join(hashed, "path", "left").join(first, "checksum", "left")
    seen = F.lit(False)
    if known is not None:
        old = known.select(F.lower("checksum").alias("checksum"), F.lit(True).alias("_seen")).distinct()
        out = out.join(old, "checksum", "left")
        seen = F.coalesce(F.col("_seen"), F.lit(False))
    reason = F.coalesce(
        F.col("rule"), F.when(seen | (F.col("path") != F.col("first_path")), F.lit("duplicate"))
    )
    return out.select(
        "path", "length", "checksum", reason.alias("reject_reason"), reason.isNull().alias("accepted")
    )


# ── readers ─────────────────────────────────────────────────────────────────


def infer_text_types(df: DataFrame) -> DataFrame:
    """Text columns cast to the narrowest type that fits every non-null value (one aggregate)."""
    ladder = ["bigint", "double", "boolean", "date", "timestamp"]
    # a cast to date also takes a timestamp and drops its time of day
    only_date = r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    checks = []
    for i, c in enumerate(names):
        checks.append(F.count(ref(c)).alias(f"n{i}"))
        checks += [F.count(ref(c).try_cast(t)).alias(f"{t}{i}") for t in ladder if t != "date"]
        checks.append(F.count(F.when(ref(c).rlike(only_date), ref(c).try_cast("date"))).alias(f"date{i}"))
    row = df.agg(*checks).first()
    casts = {}
    for i, c in enumerate(names):
        fits = [t for t in ladder if row[f"{t}{i}"] == row[f"n{i}"]] if row[f"n{i}"] else []
        if "bigint" in fits and "boolean" in fits:
            fits.remove("boolean")
        if fits:
            casts[c] = ref(c).try_cast(fits[0])
    return df.withColumns(casts) if casts else df


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    has_header: bool = True,
    encoding: str | None = None,
    schema: T.StructType | str | None = None,
    null_tokens: Sequence[str] = tuple(fixed.NULL_TOKENS),
    quoted_newlines: bool | None = None,
) -> DataFrame:
    """CSV with several null texts; unreadable values become null.

    What is not given is found in a first pass over all bytes: the ``encoding`` of each file (UTF-8 if all of it is, else Latin-1), and whether any quoted
    value spans lines. If so, records are cut by quote states block by block, so that a large file still is many tasks; else Spark's reader splits at
    lines. A file is one task in UTF-16, or where only Spark can open the store and quoted values may span lines.
    With a ``schema`` values are cast to it, by position; else types are inferred from all rows.
    """
    charset = CHARSETS.get(encoding.lower(), encoding) if encoding else None
    raw, by_bytes = None, ranges.open_store(path) is not None and not (charset or "").startswith("UTF-16")
    if by_bytes and (charset is None or quoted_newlines is not False):
        states = cut_lineage(records.block_states(ranges.listing(spark, path), path, delimiter))
        layouts = records.file_layouts(states).withColumn("encoding", F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1") if charset is None else F.lit(charset))
        facts = layouts.agg(F.min("encoding").alias("least"), F.max("encoding").alias("most"), F.bool_or("quoted_break").alias("breaks"), F.bool_or("returns").alias("returns")).first()
        breaks = facts.breaks if quoted_newlines is None else quoted_newlines
        if facts.returns:  # lines end in carriage returns alone
            charset, quoted_newlines = charset or facts.most, breaks
        elif breaks or facts.least != facts.most:
            cut = records.cut_records(states.join(layouts.select("path", "encoding"), "path"), path, delimiter)
            raw = records.parsed(cut, delimiter, has_header)
        else:
            charset, quoted_newlines = charset or facts.most, False
    if raw is None:
        charset = charset or _whole_encoding(spark, path)
        raw = (
            spark.read.option("header", has_header).option("sep", delimiter).option("encoding", charset or "UTF-8").option("escape", '"')
            .option("mode", "PERMISSIVE").option("multiLine", quoted_newlines is not False or charset.startswith("UTF-16")).csv(path)
        )
    text = raw.withColumns({c: blank_to_null(ref(c), null_tokens) for c in raw.columns})
    if schema is None:
        return infer_text_types(text)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    by_position = dict(zip(raw.columns, wanted.fields))
    return text.select(*[ref(c).try_cast(f.dataType).alias(f.name) for c, f in by_position.items()])


def _whole_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line of every file is, else Latin-1; by Spark's own text reader."""
    row = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8")).first()
    return "ISO-8859-1" if row.utf8 is False else "UTF-8"


def load_dataset(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    sample_rows: int | None = None,
    schema: T.StructType | str | None = None,
    delimiter: str | None = None,
    has_header: bool | None = None,
    encoding: str | None = None,
    quoted_newlines: bool | None = None,
) -> DataFrame:
    """A dataset by URI; without ``fmt`` the files' heads tell format, delimiter and header. Files of different layouts are an error.

    Encoding and quoted line breaks are found in the whole files (see ``read_csv``) unless both are given.
    """
    newline = True
    if fmt is None:
        layout = ["format", "is_newline_json", "delimiter", "has_header", "wide"]
        wide = F.when(F.col("encoding").startswith("utf-16"), F.col("encoding"))
        heads = catalog_files(spark, path).where("length > 0").withColumn("wide", wide).groupBy(*layout).agg(F.min("path").alias("path")).orderBy("path").limit(2).collect()
        if not heads:
            raise FileNotFoundError(path)
        if len(heads) > 1:
            raise ValueError(f"files of different layouts: {heads[0].path} and {heads[1].path}")
        head = heads[0]
        fmt, newline = head.format, head.is_newline_json
        delimiter = delimiter or head.delimiter
        has_header = head.has_header if has_header is None else has_header
        encoding = encoding or head.wide
    if fmt == "csv":
        df = read_csv(
            spark, path, delimiter or ",", True if has_header is None else has_header, encoding, schema, quoted_newlines=quoted_newlines
        )
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "json":
        reader = spark.read.option("multiLine", not newline)
        df = (reader.schema(schema) if schema else reader).json(path)
    else:
        raise ValueError(f"unsupported format: {fmt!r}")
    return df.limit(sample_rows) if sample_rows else df


def register_view(df: DataFrame, name: str = "dataset") -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def stream_dataset(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    max_files: int = 1000,
    name_filter: str | None = None,
    **options,
) -> DataFrame:
    """New files of a folder as a stream, a bounded number of files per batch."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unsupported format: {fmt!r}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).options(**options)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.format(fmt).load(path)
