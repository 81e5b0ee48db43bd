"""A stored index for exact cosine search: vectors in partitions around centroids, with one byte a dimension beside them.

A search bounds what it reads twice, and neither bound costs a result. A partition knows the widest angle between its centroid and a
member, so that no member can be nearer to a query than the angle to the centroid less that; partitions that cannot hold one of the best ``k`` are
not read. In those that are read, a vector's rest against its centroid is kept as bytes, whose rounding error is known; only vectors that
may still be among the best are scored from their exact components. Short vectors, whose bytes would tell too few of them apart, are scored
exactly at once, by cells of near ones.

The index is a folder of Parquet tables: ``centroids``, ``rows`` (by ``part``), ``extents`` (rows and widest angle by part and batch), ``gone``
(ids replaced or deleted, by part). Every change is a further batch of files; one writer at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..session import cut_lineage
from . import cells, retrieval

#: Centroids are fitted on so many vectors (those with the smallest hash of their id), in so many rounds.
FIT_ROWS, FIT_ROUNDS = 20_000, 12
#: Vectors a partition should hold, and partitions at most.
PART_ROWS, MOST_PARTS = 5_000, 4_096
#: Vectors per file of a partition.
FILE_ROWS = 500_000
#: Ids replaced or deleted are broadcast up to this number, beyond it joined by a shuffle.
BROADCAST_GONE = 1_000_000
#: Slack on the bounds, for the last digits of sums.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """A stored index; ``centroids`` has a row per partition (of unit length)."""

    spark: SparkSession
    folder: str
    centroids: np.ndarray

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def changed(self) -> bool:
        """Whether anything was ever replaced or deleted."""
        return not self.table("gone").isEmpty()

    def batch(self) -> int:
        """The last batch."""
        return self.table("extents").agg(F.max("batch")).first()[0]


def _units(column, size: int) -> np.ndarray:
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = v.flatten().to_numpy().reshape(len(v), size).astype(np.float64)
    norms = np.linalg.norm(v, axis=1)
    return v / np.where(norms == 0, 1.0, norms)[:, None]


def _usable(df: DataFrame, id_column: str, name: str, vector: str, *more) -> DataFrame:
    v = ref(vector).cast("array<double>").alias("v")
    return df.select(ref(id_column).alias(name), *more, v).where(F.forall("v", lambda x: x.isNotNull()))


def fit_centroids(sample: np.ndarray, parts: int, rounds: int = FIT_ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit vectors; an empty centroid moves to the vector that is farthest from its own."""
    random = np.random.default_rng(seed)
    centroids = sample[np.sort(random.choice(len(sample), parts, replace=False))]
    for _ in range(rounds):
        likeness = sample @ centroids.T
        own, best = likeness.argmax(axis=1), likeness.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=parts) == 0)
        sums[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1)
        centroids = np.where(norms[:, None] > 0, sums / np.where(norms == 0, 1.0, norms)[:, None], centroids)
    return centroids


def build_index(
    chunks: DataFrame, folder: str, parts: int | None = None, chunk_id: str = "id", vector: str = "embedding",
    scope: str | None = None, chunk_type: str | None = None,
) -> VectorIndex:
    """An index of the chunks in a new folder.

    ``parts`` defaults to one partition per ``PART_ROWS`` vectors, ``MOST_PARTS`` at most; centroids are fitted on ``FIT_ROWS`` vectors, which
    only balances the work. Null vectors, vectors with null parts and those whose length is not the most frequent one take no part.
    """
    spark = chunks.sparkSession
    rows = _usable(chunks, chunk_id, "id", vector)
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if not usual:
        raise ValueError("no vectors")
    fitted = rows.where(F.size("v") == usual.d).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toArrow()
    sample = _units(fitted["v"], usual.d)
    wanted = parts or max(1, min(MOST_PARTS, math.ceil(usual.n / PART_ROWS)))
    centroids = fit_centroids(sample, min(wanted, len(sample)))
    table = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(table, "part int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
    _no_changes(chunks, folder, chunk_id)
    index = VectorIndex(spark, folder, centroids)
    _append(index, chunks, 0, chunk_id, vector, scope, chunk_type)
    return index


def _no_changes(chunks: DataFrame, folder: str, chunk_id: str) -> None:
    chunks.limit(0).select(ref(chunk_id).alias("id"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("batch")).write.parquet(f"{folder}/gone")


def open_index(spark: SparkSession, folder: str) -> VectorIndex:
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("part").collect()  # MOST_PARTS rows at most
    return VectorIndex(spark, folder, np.array([r.centroid for r in rows]))


def _append(index: VectorIndex, chunks: DataFrame, batch: int, chunk_id: str, vector: str, scope: str | None, chunk_type: str | None) -> DataFrame:
    """Writes the chunks as a batch; of rows that share an id the one with the greatest vector stays."""
    size, parts = index.centroids.shape[1], len(index.centroids)
    more = [
        (ref(scope).cast("string") if scope else F.lit(None).cast("string")).alias("scope"),
        (ref(chunk_type).cast("string") if chunk_type else F.lit(None).cast("string")).alias("chunk_type"),
    ]
    rows = _usable(chunks, chunk_id, "id", vector, *more).where(F.size("v") == size)
    rows = rows.groupBy("id").agg(F.max(F.struct("v", "scope", "chunk_type")).alias("r")).select("id", "r.*")
    known = index.spark.sparkContext.broadcast(index.centroids)

    def place(batches):
        for b in batches:
            units = _units(b.column("v"), size)
            own = (units @ known.value.T).argmax(axis=1) if len(units) else np.zeros(0, int)
            centre = known.value[own]
            rest = units - centre
            # a byte a dimension; the widest component of a row sets its step
            step = np.maximum(np.abs(rest).max(axis=1, initial=0) / 127, 1e-12)
            code = np.rint(rest / step[:, None]).astype(np.int8)
            angle = np.arccos(np.clip((units * centre).sum(axis=1), -1, 1))
            codes = pa.Array.from_buffers(pa.binary(size), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(own.astype(np.int32)), codes, pa.array(step), pa.array(angle)], names=[*names, "part", "code", "step", "angle"]
            )

    names = rows.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = cut_lineage(rows.mapInArrow(place, f"{types}, part int, code binary, step double, angle double"))
    extents = placed.groupBy("part").agg(F.count("*").alias("rows"), F.max("angle").alias("widest")).withColumn("batch", F.lit(batch).cast("long"))
    extents = cut_lineage(extents)  # a row per partition
    files = F.ceil(F.col("rows") / FILE_ROWS)
    dealt = placed.join(F.broadcast(extents.select("part", files.alias("files"))), "part").withColumn("batch", F.lit(batch).cast("long"))
    dealt = dealt.repartition(parts, "part", F.pmod(F.xxhash64("id"), F.col("files")))
    dealt.drop("files").sortWithinPartitions("part", "id").write.mode("append").partitionBy("part").parquet(f"{index.folder}/rows")
    if extents.isEmpty() and batch == 0:
        raise ValueError("no vectors")
    extents.write.mode("append").parquet(f"{index.folder}/extents")
    return placed.select("id", "part")


# ── changes ─────────────────────────────────────────────────────────────────


def _bury(index: VectorIndex, ids: DataFrame, batch: int) -> None:
    """Marks the rows of earlier batches that ``ids`` names."""
    found = index.table("rows").where(F.col("batch") < batch).select("id", "part").join(ids, "id", "left_semi").distinct()
    found.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(f"{index.folder}/gone")


def _mark(index: VectorIndex, batch: int) -> None:
    """A batch without rows still counts as one."""
    empty = index.spark.createDataFrame([(0, 0, 0.0, batch)], "part int, rows long, widest double, batch long")
    empty.write.mode("append").parquet(f"{index.folder}/extents")


def upsert(index: VectorIndex, chunks: DataFrame, chunk_id: str = "id", vector: str = "embedding", scope: str | None = None, chunk_type: str | None = None) -> None:
    """Adds chunks; those whose id is there already replace it, wherever it lies. Doing it twice changes nothing."""
    batch = index.batch() + 1
    _bury(index, cut_lineage(chunks.select(ref(chunk_id).alias("id")).distinct()), batch)
    _append(index, chunks, batch, chunk_id, vector, scope, chunk_type)
    _mark(index, batch)


def delete(index: VectorIndex, ids: DataFrame | None = None, scope: str | None = None) -> None:
    """Takes out the chunks named by ``ids`` (column ``id``) or those of a scope."""
    batch = index.batch() + 1
    if ids is not None:
        _bury(index, ids.select("id").distinct(), batch)
    if scope is not None:
        _bury(index, index.table("rows").where(F.col("scope") == scope).select("id"), batch)
    _mark(index, batch)


def compact(index: VectorIndex, folder: str) -> VectorIndex:
    """The same index in a new folder, without what is gone."""
    index.table("centroids").coalesce(1).write.parquet(f"{folder}/centroids")
    _no_changes(index.table("rows"), folder, "id")
    fresh = VectorIndex(index.spark, folder, index.centroids)
    _append(fresh, live_rows(index).select("id", "v", "scope", "chunk_type"), 0, "id", "v", "scope", "chunk_type")
    return fresh


def live_rows(index: VectorIndex, parts: list[int] | None = None) -> DataFrame:
    """The rows that are neither replaced nor deleted; with ``parts`` only those partitions are read."""
    rows = index.table("rows")
    if parts is not None:
        rows = rows.where(F.col("part").isin(parts))
    gone = index.table("gone")
    if not index.changed():
        return rows
    gone = gone if parts is None else gone.where(F.col("part").isin(parts))
    gone = gone.groupBy("part", "id").agg(F.max("batch").alias("buried"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone
    return rows.join(gone, ["part", "id"], "left").where(F.col("batch") >= F.coalesce("buried", F.lit(0))).drop("buried")


# ── search ──────────────────────────────────────────────────────────────────


def _reach(index: VectorIndex) -> tuple[np.ndarray, np.ndarray]:
    """Rows and widest angle of every partition (one row each)."""
    rows, widest = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids))
    for r in index.table("extents").groupBy("part").agg(F.sum("rows").alias("rows"), F.max("widest").alias("widest")).collect():
        rows[r.part], widest[r.part] = r.rows, r.widest
    return rows, widest


def _asked(index: VectorIndex, queries: DataFrame, choose) -> DataFrame:
    """``queries`` with ``parts``: the partitions that ``choose`` names for the cosines to the centroids and the rows' bounds."""
    size, at = index.centroids.shape[1], {c: i for i, c in enumerate(queries.columns)}
    known = index.spark.sparkContext.broadcast(index.centroids)

    def run(batches):
        for b in batches:
            likeness = _units(b.column(at["v"]), size) @ known.value.T if b.num_rows else np.zeros((0, len(known.value)))
            bound = b.column(at["bound"]).to_numpy(zero_copy_only=False)
            lists = [choose(row, low) for row, low in zip(likeness, bound)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*b.schema.names, "parts"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{types}, parts array<int>")


def _scored(index: VectorIndex, asked: DataFrame, top_k: int, rows: np.ndarray, chunk_type: str | None) -> tuple[DataFrame, list[int], int]:
    """``query_id, chunk_id, part, score, error`` of the candidates in the partitions that the queries ask for, from the bytes (of short vectors exactly); which those are; how many (query, partition).

    A partition is cut into slices that a task holds; its queries stream past each. A slice hands on what may be among its best ``top_k``.
    """
    size = index.centroids.shape[1]
    short, held_rows = size <= cells.CELL_SIZE, retrieval.SLICE_ROWS if size <= cells.CELL_SIZE else min(retrieval.SLICE_ROWS, cells.DENSE_ROWS)
    wanted = cut_lineage(asked.select("query_id", "scope", "v", "bound", F.explode("parts").alias("part")))
    parts = sorted(r.part for r in wanted.select("part").distinct().collect())  # MOST_PARTS at most
    slices = F.lit(1)
    for part in parts:
        cuts = math.ceil(max(rows[part] * size / retrieval.SLICE_NUMBERS, rows[part] / held_rows))
        if cuts > 1:
            slices = F.when(F.col("part") == part, cuts).otherwise(slices)
    spot = lambda k: (F.col("part").cast("long") * (1 << 32) + k).alias("slice")
    data = live_rows(index, parts)
    data = data.where(F.col("chunk_type") == chunk_type) if chunk_type else data
    own = data.select(spot(F.pmod(F.xxhash64("id"), slices)), F.lit(0).alias("is_query"), F.col("id").alias("item_id"), "scope", "part", *(["v"] if short else ["code", "step"]))
    sent = wanted.select("*", F.explode(F.sequence(F.lit(0), slices - 1)).alias("k")).select(spot(F.col("k")), F.lit(1).alias("is_query"), "query_id", "scope", "v", "bound")
    columns = [*own.columns, *[c for c in sent.columns if c not in own.columns]]
    pad = lambda df, other: df.select(*df.columns, *retrieval._missing(other, df)).select(*columns)
    both = pad(own, sent).unionByName(pad(sent, own))
    tasks = max(len(parts), int(index.spark.conf.get("spark.sql.shuffle.partitions")))
    placed = both.repartition(tasks, "slice").sortWithinPartitions("slice", "is_query")
    at = {c: i for i, c in enumerate(placed.columns)}
    known = index.spark.sparkContext.broadcast(index.centroids)

    def hold_short(table):
        units = _units(table["v"], size)
        sound = np.isfinite(units).all(axis=1)
        scopes = table["scope"].combine_chunks().dictionary_encode(null_encoding="encode")
        names = {name: i for i, name in enumerate(scopes.dictionary.to_pylist())}
        held = cells.Cells(units[sound], scopes.indices.to_numpy()[sound])
        return int(table["part"][0].as_py()), table["item_id"].combine_chunks().filter(pa.array(sound)), names, held

    def score_short(ready, batch):
        part, ids, names, held = ready
        own = batch.column(at["scope"])  # null where the search is not scoped
        scopes = None if own.null_count else np.array([names.get(name, -1) for name in own.to_pylist()])
        floor = batch.column(at["bound"]).to_numpy(zero_copy_only=False) - SLACK
        row, place, near = held.best(_units(batch.column(at["v"]), size), scopes, floor, top_k)
        yield pa.RecordBatch.from_arrays(
            [batch.column(at["query_id"]).take(pa.array(row)), ids.take(pa.array(place)), pa.array(np.full(len(row), part, np.int32)), pa.array(near), pa.array(np.full(len(row), 2 * cells.TIE))],
            names=["query_id", "chunk_id", "part", "score", "error"],
        )

    def hold(table):
        part = int(table["part"][0].as_py())
        column = table["code"].combine_chunks()
        code = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), size)
        return part, table["item_id"].combine_chunks(), table["scope"].to_numpy(), code.astype(np.float64), table["step"].to_numpy()

    def score(ready, batch):
        part, ids, scopes, code, step = ready
        asks = _units(batch.column(at["v"]), size)
        near = (asks @ known.value[part])[:, None] + (asks @ code.T) * step[None, :]
        error = np.abs(asks).sum(axis=1)[:, None] * step[None, :] / 2 + SLACK
        own = batch.column(at["scope"]).to_numpy(zero_copy_only=False)
        allowed = np.array([[a is None or a == s for s in scopes] for a in own]) if any(a is not None for a in own) else np.ones(near.shape, bool)
        allowed &= near + error >= batch.column(at["bound"]).to_numpy(zero_copy_only=False)[:, None]
        row, place = [], []
        for i in range(len(asks)):
            usable = np.flatnonzero(allowed[i])
            if len(usable) > top_k:
                low = near[i, usable] - error[i, usable]
                usable = usable[near[i, usable] + error[i, usable] >= np.partition(low, -top_k)[-top_k]]
            row.append(np.full(len(usable), i))
            place.append(usable)
        row, place = np.concatenate(row), np.concatenate(place)
        yield pa.RecordBatch.from_arrays(
            [batch.column(at["query_id"]).take(pa.array(row)), ids.take(pa.array(place)), pa.array(np.full(len(row), part, np.int32)), pa.array(near[row, place]), pa.array(error[row, place])],
            names=["query_id", "chunk_id", "part", "score", "error"],
        )

    kinds = [placed.schema[c].dataType.simpleString() for c in ("query_id", "item_id")]
    found = placed.mapInArrow(
        lambda batches: retrieval._streamed(batches, *((hold_short, score_short) if short else (hold, score))), f"query_id {kinds[0]}, chunk_id {kinds[1]}, part int, score double, error double"
    )
    return cut_lineage(found), parts, wanted.count()


def _least(found: DataFrame, top_k: int) -> DataFrame:
    """``query_id, bound``: what the best ``top_k`` of each query reach at least; no row where there are fewer."""
    order = Window.partitionBy("query_id").orderBy(F.desc("low"))
    ranked = found.select("query_id", (F.col("score") - F.col("error")).alias("low")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= top_k)
    return ranked.where(F.col("r") == top_k).select("query_id", F.col("low").alias("bound"))


@dataclass(frozen=True)
class Searched:
    """``rows``: query_id, chunk_id, score, rank. ``parts_read`` of ``parts`` partitions were opened; ``probed`` counts a partition once for each query."""

    rows: DataFrame
    parts_read: int
    probed: int
    parts: int


def search_index(
    index: VectorIndex, queries: DataFrame, top_k: int = retrieval.DEFAULT_TOP_K, threshold: float | None = 0.72, chunk_type: str | None = None,
    query_id: str = "query_id", query_vector: str = "embedding", scope: str | None = None, probes: int | None = None,
) -> Searched:
    """Cosine top-k per query from the index, the same rows as ``search_vectors`` on what it holds.

    The nearest partitions come first; what they yield bounds which others are read at all. With ``probes`` each query reads that many
    partitions and no more, which may miss rows. ``scope`` names the queries' column that chunks must share.
    """
    size, (rows, widest) = index.centroids.shape[1], _reach(index)
    floor = -2.0 if threshold is None else threshold - SLACK
    scoped = (F.coalesce(ref(scope).cast("string"), F.lit("")) if scope else F.lit(None).cast("string")).alias("scope")
    asked = _usable(queries, query_id, "query_id", query_vector, scoped).where(F.size("v") == size).withColumn("bound", F.lit(floor))
    asked = cut_lineage(asked)
    full = rows > 0

    def first(likeness, bound):
        """The nearest partitions, until they hold some times ``top_k`` rows, or ``probes`` of them."""
        order = np.argsort(-np.where(full, likeness, -np.inf), kind="stable")[: int(full.sum())]
        enough = probes or int(np.searchsorted(np.cumsum(rows[order]), 4 * top_k)) + 1
        return order[:enough].tolist()

    def further(likeness, bound):
        """The others that can hold a vector at least as near as ``bound``."""
        angle = np.maximum(np.arccos(np.clip(likeness, -1, 1)) - widest - SLACK, 0)
        known = set(first(likeness, bound))
        return [p for p in np.flatnonzero(full & (np.cos(angle) >= bound - SLACK)).tolist() if p not in known]

    found, read, probed = _scored(index, _asked(index, asked, first), top_k, rows, chunk_type)
    if probes is None:
        bounded = asked.drop("bound").join(_least(found, top_k), "query_id", "left").withColumn("bound", F.greatest(F.coalesce("bound", F.lit(-2.0)), F.lit(floor)))
        more, others, further_probed = _scored(index, _asked(index, bounded.select(*asked.columns), further), top_k, rows, chunk_type)
        found, read, probed = found.unionByName(more), sorted({*read, *others}), probed + further_probed
    short = found.join(_least(found, top_k), "query_id", "left").where(F.col("score") + F.col("error") >= F.coalesce("bound", F.lit(-2.0)))
    short = cut_lineage(short.select("query_id", "chunk_id", "part"))
    exact = live_rows(index, read).select(F.col("id").alias("chunk_id"), "part", F.col("v").alias("w"))
    scored = short.join(exact, ["chunk_id", "part"]).join(asked.select("query_id", "v"), "query_id")
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norms = F.sqrt(product("v", "v")) * F.sqrt(product("w", "w"))
    scored = scored.select("query_id", "chunk_id", F.when(norms == 0, 0.0).otherwise(product("v", "w") / norms).alias("score"))
    scored = scored if threshold is None else scored.where(F.col("score") >= threshold)
    return Searched(retrieval._ranked(scored, top_k, "chunk_id", 6), len(read), probed, int(full.sum()))


def retrieve_from(index: VectorIndex, chunks: DataFrame, queries: DataFrame, top_k: int = retrieval.DEFAULT_TOP_K, min_score: float = 0.60, **names) -> DataFrame:
    """``retrieve`` with its candidates from the index: twice ``top_k`` by vector, then the keyword boost."""
    vectors = {k: v for k, v in names.items() if k in ("query_id", "query_vector", "scope")}
    candidates = search_index(index, queries, 2 * top_k, None, **vectors).rows
    return retrieval.rerank(candidates, queries, chunks, top_k, min_score, **{k: v for k, v in names.items() if k in ("query_id", "query_text", "chunk_id", "content")})
