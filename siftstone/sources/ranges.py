"""Files by byte ranges: a folder listing, heads and samples, blocks and checksums, all read inside tasks.

The stores are those that Arrow can open (local and mounted folders, S3, GCS, HDFS where its library is installed). Others are left to Spark's
own readers by ``files.py``.
"""

from __future__ import annotations

import codecs
import datetime
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of one piece of a sample, and pieces between head and tail.
PIECE_BYTES, INNER_PIECES = 8192, 3
#: Bytes of one block of a file that is read whole.
BLOCK_BYTES = 64 << 20
#: Sub-folders are opened level by level until the listing has this many partitions.
LISTING_PARTITIONS = 200


def open_store(uri: str):
    """(file system, path within, what to put before a path to get its URI); None where Arrow cannot open the store."""
    scheme, _, rest = uri.partition(":")
    if not rest or "/" in scheme:
        return stores.LocalFileSystem(), uri, "file:"
    if scheme == "file":
        return stores.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    try:
        if scheme in ("s3", "s3a", "s3n"):
            store, path = stores.FileSystem.from_uri("s3:" + rest)
            return store, path, f"{scheme}://"
        store, path = stores.FileSystem.from_uri(uri)
    except (OSError, pa.ArrowInvalid):
        return None
    return store, path, uri.split(path, 1)[0] if path in uri else f"{scheme}://"


def _visible(info) -> bool:
    return not info.base_name.startswith(("_", "."))  # as Spark's readers


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class FolderListing(DataSource):
    """``spark.read.format("siftstone_listing").load(folder)``: a row per file, empty ones too; hidden ones are left out.

    A partition is a folder. The planner opens the upper levels to find sub-folders and keeps only those; tasks list what is in them, all the way down.
    """

    @classmethod
    def name(cls):
        return "siftstone_listing"

    def schema(self):
        return "path string, length long, modified timestamp"

    def reader(self, schema):
        return _ListingReader(self.options["path"])


class _ListingReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        store, path, _ = open_store(self.root)
        if store.get_file_info(path).type != stores.FileType.Directory:
            return [_Folder(path, False)]
        flat, level = [], [path]
        while level and len(flat) + len(level) < LISTING_PARTITIONS:
            below = [
                info.path for folder in level for info in store.get_file_info(stores.FileSelector(folder)) if info.type == stores.FileType.Directory and _visible(info)
            ]
            flat, level = flat + level, below
        return [_Folder(p, False) for p in flat] + [_Folder(p, True) for p in level]

    def read(self, partition):
        store, _, prefix = open_store(self.root)
        folders = [partition.path]
        while folders:
            here = store.get_file_info(folders.pop())
            for info in [here] if here.is_file else store.get_file_info(stores.FileSelector(here.path, allow_not_found=True)):
                if info.type == stores.FileType.File and (_visible(info) or here.is_file):
                    yield prefix + info.path, info.size, info.mtime.astimezone(datetime.timezone.utc) if info.mtime else None
                elif info.type == stores.FileType.Directory and partition.deep and _visible(info):
                    folders.append(info.path)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modified`` of every file below ``root``."""
    spark.dataSource.register(FolderListing)
    found = open_store(root)
    if found and found[0].get_file_info(found[1]).type == stores.FileType.NotFound:
        raise FileNotFoundError(root)
    return spark.read.format("siftstone_listing").load(root)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows that stand for work elsewhere: few bytes, but many tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


# ── samples ─────────────────────────────────────────────────────────────────


def is_utf8(data: bytes, begins: bool, ends: bool, more: int = 0) -> bool:
    """Whether a piece of a text is UTF-8, as far as that piece has to answer for it.

    A piece answers for the bytes from its first one that begins a character to the first such byte behind it; the last ``more`` bytes of ``data``
    lie behind it already. ``begins`` and ``ends`` tell whether ``data`` reaches the ends of the file.
    """
    start, stop = 0, len(data) - more
    while not begins and start < len(data) and data[start] & 0xC0 == 0x80:
        start += 1
    while stop < len(data) and data[stop] & 0xC0 == 0x80:
        stop += 1
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data[start:], final=ends)
    except UnicodeDecodeError as error:
        return start + error.start >= stop
    return True


def with_samples(files: DataFrame, root: str, piece: int = PIECE_BYTES, inner: int = INNER_PIECES) -> DataFrame:
    """``files`` (with ``path, length``) and ``head`` (the first piece), ``utf8`` and ``quotes`` over all pieces, ``bytes_read``.

    The pieces are the head, ``inner`` ones spread over the file and the tail; a file no longer than that is read whole.
    """

    def run(batches):
        store, _, prefix = open_store(root)
        for batch in batches:
            found = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                with store.open_input_file(path[len(prefix) :]) as file:
                    if length <= piece * (inner + 2):
                        parts = [(0, file.read_at(length, 0))]
                    else:
                        parts = [(at, file.read_at(piece, at)) for at in ((length - piece) * i // (inner + 1) for i in range(inner + 2))]
                utf8 = all(is_utf8(data, at == 0, at + len(data) >= length) for at, data in parts)
                found.append((parts[0][1][:piece], utf8, any(b'"' in data for _, data in parts), sum(len(data) for _, data in parts)))
            columns = list(zip(*found)) or [()] * 4
            kinds = (pa.binary(), pa.bool_(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=[*names, "head", "utf8", "quotes", "bytes_read"])

    names = files.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return _spread(files).mapInArrow(run, f"{types}, head binary, utf8 boolean, quotes boolean, bytes_read long")


def with_checksums(files: DataFrame, root: str, chunk: int = 8 << 20) -> DataFrame:
    """``path, checksum`` (SHA-256) of the files' content, hashed as it streams by."""

    def run(batches):
        store, _, prefix = open_store(root)
        for batch in batches:
            paths, sums = batch.column("path").to_pylist(), []
            for path in paths:
                state = hashlib.sha256()
                with store.open_input_stream(path[len(prefix) :]) as file:
                    while data := file.read(chunk):
                        state.update(data)
                sums.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sums, pa.string())], names=["path", "checksum"])

    return _spread(files.select("path")).mapInArrow(run, "path string, checksum string")


# ── blocks ──────────────────────────────────────────────────────────────────


def blocks(files: DataFrame, size: int | None = None) -> DataFrame:
    """``path, length, start`` of every block of the files; empty files have none."""
    size = size or BLOCK_BYTES
    return _spread(files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start")))


def read_block(store, path: str, start: int, size: int, before: int, after: int) -> tuple[bytes, int]:
    """The block's bytes with up to ``before`` bytes before and ``after`` bytes behind it; also how many came before."""
    first = max(0, start - before)
    with store.open_input_file(path) as file:
        return file.read_at(start - first + size + after, first), start - first


def read_on(store, path: str, at: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Chunks of a file from a place to its end."""
    with store.open_input_file(path) as file:
        while data := file.read_at(chunk, at):
            yield data
            at += len(data)
