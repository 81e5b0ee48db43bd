"""Approximate nearest neighbours by inner product: inverted lists with an adaptive scan of the dimensions.

A further coordinate makes all vectors equally long, so that the largest inner product is the smallest distance; a random
rotation then spreads the variance evenly over the dimensions. Within a probed list the vectors are held dimension by dimension; after each
block of dimensions a hypothesis test drops the candidates whose distance so far, scaled up to all dimensions, lies too far beyond
the best ones found. Survivors are scored exactly on the original vectors. Equal vectors travel as one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plain_ids, stored, tidy

#: The index is fitted on at most so many vectors, those with the smallest hash of their id.
FIT_ROWS = 20_000
LIST_ROWS, MOST_LISTS = 512, 4_096
#: Lists are probed until a sample of queries finds this share of its true neighbours within the fitted vectors.
RECALL = 0.97
FIT_QUERIES = 256
#: Dimensions per block, and the tolerance of the test.
COLUMNS, TOLERANCE = 16, 2.1
#: Vectors and queries that one task holds of a list; larger lists are cut into cells.
CELL_ROWS, CELL_QUERIES = 8_192, 4_096
#: Queries whose best a task holds before it hands them on.
HELD_QUERIES = 50_000
SALTS = 16
SEED = 47


@dataclass(frozen=True)
class Index:
    """Rotation, the squared length given to all vectors, list centres and the number of lists to probe."""

    rotation: np.ndarray
    reach: float
    centres: np.ndarray
    probes: int

    def place(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors with the coordinate that fills up their length; a query gets none."""
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.reach - (vectors**2).sum(1), 0))
        return np.column_stack([vectors, rest]) @ self.rotation

    def distances(self, placed: np.ndarray) -> np.ndarray:
        """To all centres, squared, less the vector's own length."""
        return (self.centres**2).sum(1) - 2 * placed @ self.centres.T


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` of the rows that take part: an id, and as many numbers as most rows have, all finite, not all zero.

    Where an id is repeated, the smallest of its vectors counts, so an exact repeat counts once.
    """
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<float>").alias("embedding")).filter(F.col("vec_id").isNotNull() & good)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.filter(F.size("embedding") == (sizes["d"] if sizes else 0))
    if plain_ids(rows.select(F.col("vec_id").alias("doc_id"))):
        return rows
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def fit(distinct: DataFrame, k: int) -> Index:
    """The index of ``distinct(key, embedding)``: k-means centres of a bounded sample, probes set by the recall within it."""
    sample = distinct.orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS).select("embedding").toArrow()["embedding"].combine_chunks()
    x = _matrix(sample)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    rows, longest = distinct.agg(F.count(F.lit(1)), F.max(size)).first()
    random = np.random.default_rng(SEED)
    rotation = np.linalg.qr(random.standard_normal((x.shape[1] + 1, x.shape[1] + 1)))[0]
    bare = Index(rotation, longest**2 * (1 + 1e-9), np.zeros((1, x.shape[1] + 1)), 1)
    placed = bare.place(x)
    lists = int(min(max(1, rows // LIST_ROWS), MOST_LISTS, len(x)))
    centres = placed[random.choice(len(x), lists, replace=False)]
    for _ in range(8):
        near = _nearest(placed, centres)
        count = np.bincount(near, minlength=lists)
        total = np.zeros_like(centres)
        np.add.at(total, near, placed)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    index = Index(rotation, bare.reach, centres, lists)
    # the place of each true neighbour's list in the query's order of lists
    asked = random.choice(len(x), min(FIT_QUERIES, len(x)), replace=False)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-score, 1)[:, : min(k, len(x) - 1)]
    order = np.argsort(index.distances(index.place(x[asked], query=True)), 1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(lists)[None, :], 1)
    needed = np.sort(np.take_along_axis(rank, _nearest(placed, centres)[best], 1).ravel())
    probes = int(needed[min(int(RECALL * len(needed)), len(needed) - 1)]) + 1 if len(needed) else 1
    return Index(rotation, bare.reach, centres, probes)


def _nearest(placed, centres, rows=4_096):
    norms = (centres**2).sum(1)
    return np.concatenate([(norms - 2 * placed[a : a + rows] @ centres.T).argmin(1) for a in range(0, len(placed), rows)])


def _listed(vectors: DataFrame, index: Index) -> DataFrame:
    """``list, key, placed, embedding, ids`` for every vector."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                piece = batch.slice(at, 2_000)
                placed = index.place(_matrix(piece.column(1)))
                near = _nearest(placed, index.centres)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), piece.column(0), _binary(placed), _binary(_matrix(piece.column(1))), piece.column(2)], names=["list", "key", "placed", "embedding", "ids"])

    return vectors.select("key", "embedding", "ids").mapInArrow(tidy(run), "list int, key long, placed binary, embedding binary, ids array<long>")


def _probing(queries: DataFrame, index: Index) -> DataFrame:
    """``list, key, placed, embedding`` for every query and list that it probes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                x = _matrix(piece.column(1))
                placed = index.place(x, query=True)
                lists = np.argpartition(index.distances(placed), index.probes - 1, 1)[:, : index.probes]
                rows = np.repeat(np.arange(len(x)), index.probes)
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel(), pa.int32()), piece.column(0).take(pa.array(rows)), _binary(placed).take(pa.array(rows)), _binary(x).take(pa.array(rows))], names=["list", "key", "placed", "embedding"])

    return queries.select("key", "embedding").mapInArrow(tidy(run), "list int, key long, placed binary, embedding binary")


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows as 32-bit floats."""
    return pa.array([r.tobytes() for r in rows.astype(np.float32)], pa.binary())


def _rows(table, name) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), np.float32).reshape(table.num_rows, -1)


def scan(vectors: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query the places of its ``k`` nearest of ``vectors``, as far as the test keeps them.

    Vectors come in groups of rows; within a group all queries take the first block of dimensions together, and only pairs that pass the test
    go on to the next block. The bound of a query is its k-th best distance so far, or the one given, if smaller.
    """
    size = vectors.shape[1]
    best = np.full((len(queries), k), np.inf, np.float32)
    place = np.full((len(queries), k), -1, np.int64)
    bound = np.full(len(queries), np.inf, np.float32) if bound is None else bound.astype(np.float32)
    edges = [*range(0, size, COLUMNS), size]
    # a short first group finds bounds that spare the rest
    starts = [0, *range(min(128, len(vectors)), len(vectors), 1_024), len(vectors)]
    for a, b in zip(starts[:-1], starts[1:]):
        columns = np.ascontiguousarray(vectors[a:b].T)
        head = columns[: edges[1]]
        far = (head**2).sum(0)[None, :] - 2 * queries[:, : edges[1]] @ head + (queries[:, : edges[1]] ** 2).sum(1)[:, None]
        q, v = np.nonzero(far <= (bound * _slack(edges[1], size))[:, None])
        d = far[q, v]
        for low, high in zip(edges[1:-1], edges[2:]):
            step = columns[low:high, v].T - queries[q, low:high]
            d = d + np.einsum("ij,ij->i", step, step)
            keep = d <= bound[q] * _slack(high, size)
            q, v, d = q[keep], v[keep], d[keep]
        if not len(q):
            continue
        found = np.full((len(queries), b - a), np.inf, np.float32)
        found[q, v] = d
        hit = np.unique(q)
        both = np.concatenate([best[hit], found[hit]], 1)
        where = np.concatenate([place[hit], np.broadcast_to(np.arange(a, b), (len(hit), b - a))], 1)
        order = np.argpartition(both, k - 1, 1)[:, :k]
        best[hit], place[hit] = np.take_along_axis(both, order, 1), np.take_along_axis(where, order, 1)
        bound[hit] = np.minimum(bound[hit], best[hit].max(1))
    return [p[np.isfinite(d)] for p, d in zip(place, best)]


def _slack(seen: int, size: int) -> float:
    """How far a distance over ``seen`` dimensions may lie beyond the bound: its expected share, widened by the tolerance."""
    return 1.0 if seen >= size else seen / size * (1 + TOLERANCE / np.sqrt(seen)) ** 2


class _Best:
    """The best candidates of each query, over all cells that a task has seen."""

    def __init__(self, k: int, reach: float):
        self.k, self.reach, self.found = k, reach, {}

    def add(self, queries: pa.RecordBatch, placed, vectors, ids) -> None:
        table = pa.Table.from_batches([queries])
        asked, keys = _rows(table, "embedding").astype(np.float64), queries.column("key").to_pylist()
        # the distance that belongs to a score, with room for the rounding of 32-bit floats
        far = [(float(x @ x) + self.reach + 2 * own[-1][0]) * (1 + 1e-5) if len(own := self.found.get(key, ())) == self.k else np.inf for key, x in zip(keys, asked)]
        for key, x, places in zip(keys, asked, scan(placed, _rows(table, "placed"), self.k, np.array(far))):
            if len(places):
                score = (vectors[places].astype(np.float64) * x).sum(1).tolist()
                new = [(-s, i) for s, p in zip(score, places) for i in ids[p]]
                self.found[key] = sorted([*self.found.get(key, ()), *new])[: self.k]

    def rows(self):
        rows = [(key, i, -s) for key, own in self.found.items() for s, i in own]
        self.found = {}
        for a in range(0, len(rows), 50_000):
            key, vec, score = zip(*rows[a : a + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], names=["key", "vec_id", "score"])


def _searched(cells: DataFrame, k: int, reach: float) -> DataFrame:
    """``key, vec_id, score``: each query's best in each task. Rows come sorted by cell, its vectors first."""

    def run(batches):
        name, held, ready, best = None, [], None, _Best(k, reach)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                own, is_query = tuple(cell[a][:3]), cell[a][3] == 1
                if own != name:
                    name, held, ready = own, [], None
                if not is_query:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    table = pa.Table.from_batches(held)
                    ready = _rows(table, "placed"), _rows(table, "embedding"), table["ids"].to_pylist()
                    held = []
                for at in range(a, b, 64) if ready else ():
                    best.add(batch.slice(at, min(64, b - at)), *ready)
                if len(best.found) > HELD_QUERIES:
                    yield from best.rows()
        yield from best.rows()

    return cells.mapInArrow(tidy(run), "key long, vec_id long, score double")


def _cells(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Vectors and queries of each list dealt into cells: blocks of the list times chunks of the queries that probe it.

    The sizes of the lists, one row per list, are broadcast; there are at most ``MOST_LISTS``.
    """
    sizes = vectors.groupBy("list").agg(F.count(F.lit(1)).alias("n")).join(queries.groupBy("list").agg(F.count(F.lit(1)).alias("m")), "list")
    blocks, chunks = F.ceil(F.col("n") / CELL_ROWS).cast("int"), F.ceil(F.col("m") / CELL_QUERIES).cast("int")
    sizes = F.broadcast(sizes.select("list", blocks.alias("blocks"), chunks.alias("chunks")))
    block, chunk = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    kept = ["list", "block", "chunk", "is_query", "key", "placed", "embedding", "ids"]
    own = vectors.join(sizes, "list").withColumns({"block": block, "chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "is_query": F.lit(0)})
    asked = queries.join(sizes, "list").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "chunk": chunk, "is_query": F.lit(1), "ids": F.lit(None).cast("array<long>")})
    return own.select(kept).unionByName(asked.select(kept))


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest inner product found for each query, never its own.

    ``vectors(vec_id, embedding)``; ``is_query`` is a condition on ``vec_id``. Rows that cannot take part (see ``usable``) are neither queries nor
    candidates. The score is the inner product of the original vectors in double precision; ties go to the smaller id. With fewer candidates than
    ``k`` all that were found are returned; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    # of equal vectors the k + 1 smallest ids are enough for every query
    few = rows.withColumn("__n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("__n") <= k + 1)
    distinct = stored(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("key"), "embedding", "ids"), "vectors")
    if distinct.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(distinct, k)

    copies = distinct.filter(F.size("ids") > 1).select(F.col("embedding").alias("e"), F.col("key").alias("shared"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")
    asked = rows.filter(is_query).withColumn("salt", salt).join(copies, (F.col("embedding") == F.col("e")) & (F.col("salt") == F.col("s")), "left")
    asked = stored(asked.select(F.col("vec_id").alias("query_id"), F.coalesce("shared", "vec_id").alias("key"), "embedding"), "queries")
    units = asked.groupBy("key").agg(F.first("embedding").alias("embedding"))

    cells = _cells(stored(_listed(distinct, index), "lists"), stored(_probing(units, index), "probes"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_cells = cells.repartition(parts, "list", "block", "chunk").sortWithinPartitions("list", "block", "chunk", "is_query", "key")
    found = _searched(sorted_cells, k + 1, index.reach)
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    # at most k + 1 rows of each
    listed = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("best"))
    spread = listed.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    answers = asked.select("query_id", "key").withColumn("s", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")).join(spread, ["key", "s"])
    own = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(own).alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score")
    )
