"""Text chunks, vector and keyword retrieval.

Both searches cut the corpus into slices that a task holds, and let the queries, a DataFrame to the end, stream past each
slice. Only the best rows per query and slice move on; no (query, chunk) pairs are formed as rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..session import cut_lineage
from .cells import DENSE_ROWS, Cells
from .cells import tops as _tops  # noqa: F401

DEFAULT_TOP_K = 8
#: Numbers of the corpus that one task holds, and queries that it scores at a time.
SLICE_NUMBERS = 4_000_000
QUERY_ROWS = 256
#: Vectors of a slice, however short they are.
SLICE_ROWS = 1_000_000
#: Postings of a slice; sorting them takes some ten times their bytes for a while.
SLICE_POSTINGS = 1_000_000
#: Up to so many query words they are broadcast; beyond that they are joined by a shuffle.
BROADCAST_WORDS = 200_000


# ── vectors ─────────────────────────────────────────────────────────────────


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns, 0 where a norm is 0."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    size = norm(a) * norm(b)
    return F.round(F.when(size == 0, 0.0).otherwise(dot / size), 6)


def _sliced(items: DataFrame, queries: DataFrame, slices: int) -> DataFrame:
    """Items dealt out by a hash of their id, and all queries with every slice; per slice the items come first."""
    slice_ = F.pmod(F.xxhash64("item_id"), F.lit(slices)).cast("int")
    own = items.select(slice_.alias("slice"), F.lit(0).alias("is_query"), *items.columns, *_missing(queries, items))
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(1).alias("is_query"), *queries.columns, *_missing(items, queries)
    )
    return own.unionByName(asked).repartitionById(slices, "slice").sortWithinPartitions("slice", "is_query")


def _missing(there: DataFrame, here: DataFrame) -> list[Column]:
    return [F.lit(None).cast(f.dataType).alias(f.name) for f in there.schema if f.name not in here.columns]


def _streamed(batches: Iterator[pa.RecordBatch], hold, score) -> Iterator[pa.RecordBatch]:
    """Goes through the slices of a task: ``hold`` gets the items of one, ``score`` that and a few queries at a time."""
    current, held, ready = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        mark = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(mark[1:] != mark[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if mark[a] // 2 != current:
                current, held, ready = mark[a] // 2, [], None
            if mark[a] % 2 == 0:
                held.append(batch.slice(a, b - a))
                continue
            if held:
                ready, held = hold(pa.Table.from_batches(held).combine_chunks()), []
            if ready is not None:
                for at in range(a, b, QUERY_ROWS):
                    yield from score(ready, batch.slice(at, min(QUERY_ROWS, b - at)))


def _ranked(found: DataFrame, top_k: int, item: str, digits: int) -> DataFrame:
    """One ranking per query; scores are compared at 1e-9 so that ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), item)
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
        .select("query_id", item, F.round("score", digits).alias("score"), "rank")
    )


def search_vectors(
    chunks: DataFrame,
    queries: DataFrame,
    top_k: int = DEFAULT_TOP_K,
    threshold: float | None = 0.72,
    chunk_type: str | None = None,
    chunk_id: str = "id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    scope: str | None = None,
) -> DataFrame:
    """Exact cosine top-k per query: ``query_id, chunk_id, score, rank``.

    ``scope`` names a column (the dataset) that query and chunk must share. Null vectors, vectors with null parts and
    those whose length is not the chunks' most frequent one take no part.
    """
    data = chunks.where(F.col("chunk_type") == chunk_type) if chunk_type else chunks
    scope_column = F.coalesce(ref(scope).cast("string"), F.lit("")) if scope else F.lit("")

    def whole(df, id_column, name, column):
        v = ref(column).cast("array<double>").alias("v")
        return df.select(ref(id_column).alias(name), scope_column.alias("scope"), v).where(F.forall("v", lambda x: x.isNotNull()))

    items, asked = whole(data, chunk_id, "item_id", vector), whole(queries, query_id, "query_id", query_vector)
    usual = items.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    size, rows = (usual.d, usual.n) if usual else (0, 0)
    items, asked = items.where(F.size("v") == size), asked.where(F.size("v") == size)
    busy = min(math.ceil(rows / DENSE_ROWS), 2 * chunks.sparkSession.sparkContext.defaultParallelism)  # tasks for all cores
    placed = _sliced(items, asked, max(1, math.ceil(rows * size / SLICE_NUMBERS), math.ceil(rows / SLICE_ROWS), busy))
    at = {c: i for i, c in enumerate(placed.columns)}

    def unit(column) -> np.ndarray:
        v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        v = v.flatten().to_numpy().reshape(len(v), size)
        norms = np.linalg.norm(v, axis=1)
        return v / np.where(norms == 0, 1.0, norms)[:, None]

    def hold(table):
        vectors = unit(table["v"])
        sound = np.isfinite(vectors).all(axis=1)
        names, codes = np.unique(table["scope"].to_numpy(), return_inverse=True)
        return table["item_id"].combine_chunks().filter(pa.array(sound)), dict(zip(names.tolist(), range(len(names)))), Cells(vectors[sound], codes[sound])

    def score(ready, batch):
        ids, names, cells = ready
        asks = unit(batch.column(at["v"]))
        own = np.array([names.get(name, -1) for name in batch.column(at["scope"]).to_pylist()])
        row, place, scores = cells.best(asks, own, np.full(len(asks), -np.inf if threshold is None else threshold), top_k)
        yield pa.RecordBatch.from_arrays([batch.column(at["query_id"]).take(pa.array(row)), ids.take(pa.array(place)), pa.array(scores)], names=["query_id", "chunk_id", "score"])

    kinds = [placed.schema[c].dataType.simpleString() for c in ("query_id", "item_id")]
    found = placed.mapInArrow(lambda batches: _streamed(batches, hold, score), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
    return _ranked(found, top_k, "chunk_id", 6)


def query_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != ""))


def rerank(
    results: DataFrame, queries: DataFrame, chunks: DataFrame, top_k: int = DEFAULT_TOP_K,
    min_score: float = 0.60, boost: float = 0.10, max_boost: float = 0.30,
    query_id: str = "query_id", query_text: str = "text", chunk_id: str = "id", content: str = "content",
) -> DataFrame:
    """Keyword boost on search results: 0.10 per query term found in the chunk, at most 0.30."""
    texts = queries.select(ref(query_id).alias("query_id"), query_terms(ref(query_text)).alias("_terms"))
    bodies = chunks.select(ref(chunk_id).alias("chunk_id"), F.lower(ref(content)).alias("_body"))
    kept = results.where(F.col("score") >= min_score).join(texts, "query_id")
    # at most 2·k candidates per query: broadcast them (checked) rather than shuffle the chunk texts
    if queries.count() * 2 * top_k <= 100_000:
        kept = F.broadcast(kept)
    joined = bodies.join(kept, "chunk_id")
    hits = F.size(F.filter("_terms", lambda t: F.contains(F.col("_body"), t)))
    scored = joined.select(
        "query_id", "chunk_id",
        F.round(F.least(F.lit(1.0), F.col("score") + F.least(boost * hits, F.lit(max_boost))), 4).alias("score"),
        hits.alias("keyword_hits"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def retrieve(
    chunks: DataFrame, queries: DataFrame, top_k: int = DEFAULT_TOP_K, min_score: float = 0.60,
    chunk_id: str = "id", vector: str = "embedding", content: str = "content",
    query_id: str = "query_id", query_text: str = "text", scope: str | None = None,
) -> DataFrame:
    """2·k candidates by vector, minimum score, keyword re-ranking to k."""
    candidates = search_vectors(
        chunks, queries, 2 * top_k, None, None, chunk_id, vector, query_id, vector, scope
    )
    return rerank(
        candidates, queries, chunks, top_k, min_score,
        query_id=query_id, query_text=query_text, chunk_id=chunk_id, content=content,
    )


def merge_searches(results: DataFrame, top_k: int = DEFAULT_TOP_K, by: str = "query_id") -> DataFrame:
    """Several vectors per query: a chunk's score is its average over the vectors that found it."""
    merged = results.groupBy(ref(by), "chunk_id").agg(F.avg("score").alias("score"))
    order = Window.partitionBy(ref(by)).orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def build_context(
    results: DataFrame, max_chars: int = 3000, by: str = "query_id", rank: str = "rank",
    chunk_type: str = "chunk_type", content: str = "content",
) -> DataFrame:
    """``[TYPE]`` blocks in rank order up to the first one that does not fit.

    Results hold at most k rows per query, so the list per query is small.
    """
    block = F.concat(F.lit("["), F.upper(F.coalesce(ref(chunk_type), F.lit(""))), F.lit("]\n"), ref(content))
    blocks = results.where(F.coalesce(ref(content), F.lit("")) != "").withColumn("_block", block)
    order = Window.partitionBy(ref(by)).orderBy(ref(rank)).rowsBetween(Window.unboundedPreceding, 0)
    fitting = blocks.withColumn("_total", F.sum(F.length("_block")).over(order)).where(F.col("_total") <= max_chars)
    joined = fitting.groupBy(ref(by)).agg(
        F.sort_array(F.collect_list(F.struct(ref(rank).alias("r"), F.col("_block").alias("b")))).alias("s"),
        F.count("*").alias("blocks"),
    )
    return joined.select(ref(by), "blocks", F.concat_ws("\n\n", F.col("s.b")).alias("context"))


# ── keywords ────────────────────────────────────────────────────────────────


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


def bm25(
    documents: DataFrame,
    queries: DataFrame,
    top_k: int = 3,
    k1: float = 1.5,
    b: float = 0.75,
    document_id: str = "doc_id",
    text: str = "text",
    query_id: str = "query_id",
    query_text: str = "text",
) -> DataFrame:
    """BM25 top-k per query: ``query_id, document_id, score, rank``.

    idf = ln(1 + (N − df + 0.5) / (df + 0.5)), average length from the data. The texts are split once into their
    length and the counts of the words that queries ask for, which are written to the checkpoint folder;
    document frequencies and scores read that. Query words are broadcast up to a checked number, else joined by a shuffle.
    """
    asked = queries.select(ref(query_id).alias("query_id"), F.explode(query_terms(ref(query_text))).alias("t"))
    vocabulary = cut_lineage(asked.select("t").distinct())
    wanted = F.broadcast(vocabulary) if vocabulary.count() <= BROADCAST_WORDS else vocabulary
    words = documents.select(ref(document_id).alias("item_id"), tokens(ref(text)).alias("w"))
    named = words.select("item_id", F.size("w").alias("length"), F.explode_outer("w").alias("t"))
    # a document without any of the words keeps one row, for its length
    counted = named.join(wanted.withColumn("known", F.lit(True)), "t", "left").groupBy("item_id", "length", F.when(F.col("known"), F.col("t")).alias("t")).agg(F.count("*").alias("tf"))
    matched = cut_lineage(
        counted.groupBy("item_id", "length").agg(F.collect_list(F.when(F.col("t").isNotNull(), F.struct(F.xxhash64("t").alias("h"), "t", F.col("tf").cast("double").alias("tf")))).alias("p"))
    )
    size = matched.agg(F.count("*").alias("n"), F.avg("length").alias("avg"), F.sum(F.size("p")).alias("postings")).first()
    frequency = matched.select(F.explode("p.t").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weighed = asked.join(frequency, "t").select("query_id", F.xxhash64("t").alias("h"), F.log1p((size.n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    terms = weighed.groupBy("query_id").agg(F.collect_list("h").alias("h"), F.collect_list("idf").alias("idf"))
    items = matched.where(F.size("p") > 0).select("item_id", "length", F.col("p.h").alias("words"), F.col("p.tf").alias("tf"))
    average = float(size.avg or 1)
    placed = _sliced(items, terms, max(1, math.ceil((size.postings or 0) / SLICE_POSTINGS)))
    at = {c: i for i, c in enumerate(placed.columns)}

    def hold(table):
        ids, lists = table["item_id"].combine_chunks(), table["words"].combine_chunks()
        owner = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        h, tf = lists.flatten().to_numpy(), table["tf"].combine_chunks().flatten().to_numpy()
        norm = k1 * (1 - b + b * table["length"].to_numpy() / average)
        order = np.argsort(h, kind="stable")
        return ids, h[order], owner[order], (tf * (k1 + 1) / (tf + norm[owner]))[order]

    def score(ready, batch):
        ids, h, owner, part = ready
        rows, places, values = [], [], []
        for i, (hashes, idf) in enumerate(zip(batch.column(at["h"]).to_pylist(), batch.column(at["idf"]).to_pylist())):
            low, high = np.searchsorted(h, hashes, "left"), np.searchsorted(h, hashes, "right")
            total = np.zeros(len(ids))
            for a, z, w in zip(low, high, idf):
                total[owner[a:z]] += w * part[a:z]
            _, place = _tops(np.where(total > 0, total, -np.inf)[None, :], top_k)
            rows.append(np.full(len(place), i))
            places.append(place)
            values.append(total[place])
        yield pa.RecordBatch.from_arrays(
            [batch.column(at["query_id"]).take(pa.array(np.concatenate(rows))), ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(values))],
            names=["query_id", "document_id", "score"],
        )

    kinds = [placed.schema[c].dataType.simpleString() for c in ("query_id", "item_id")]
    found = placed.mapInArrow(lambda batches: _streamed(batches, hold, score), f"query_id {kinds[0]}, document_id {kinds[1]}, score double")
    return _ranked(found, top_k, "document_id", 4)


def hit_rate(results: DataFrame, truth: DataFrame, item: str = "document_id", k: int = 3) -> DataFrame:
    """Share of queries whose expected item is among the first k."""
    hits = truth.join(results.where(F.col("rank") <= k).select("query_id", item), ["query_id", item], "left_semi")
    caught = hits.select("query_id").distinct().withColumn("_hit", F.lit(1))
    asked = truth.select("query_id").distinct()
    return asked.join(caught, "query_id", "left").agg(
        F.count("*").alias("queries"), F.count("_hit").alias("hits"),
        F.round(F.count("_hit") / F.count("*"), 4).alias("hit_rate"),
    )


# ── chunks ──────────────────────────────────────────────────────────────────

CHUNK = ["id", "dataset_id", "chunk_type", "column_name", "content", "metadata"]


def _chunk(dataset_id: str, kind: str, column: Column, content: Column, metadata: dict[str, Column]) -> list[Column]:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return [
        F.sha2(F.concat_ws(":", F.lit(dataset_id), F.lit(kind), content), 256).alias("id"),
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(kind).alias("chunk_type"),
        column.cast("string").alias("column_name"),
        content.alias("content"),
        F.create_map(*pairs).alias("metadata"),
    ]


def _percent(share: Column) -> Column:
    return F.concat(F.format_number(share * 100, 1), F.lit("%"))


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def schema_chunks(dataset_id: str, columns: DataFrame) -> DataFrame:
    """One chunk per column from profile rows with semantic types."""
    key = (F.col("semantic_type") == "identifier") & (F.col("unique_count") == F.col("total_rows"))
    samples = F.concat(F.lit("['"), F.concat_ws("', '", F.slice("sample_values", 1, 5)), F.lit("']"))
    content = F.concat(
        F.lit("Column: "), F.col("column_name"),
        F.lit("\nType: "), F.col("data_type"), F.lit(" (semantic: "), F.col("semantic_type"), F.lit(")"),
        F.lit("\nNull rate: "), _percent(F.col("null_rate")),
        F.lit("\nUnique values: "), F.col("unique_count").cast("string"),
        F.lit("\nSample values: "), F.when(F.size("sample_values") > 0, samples).otherwise("[]"),
        F.lit("\nIs primary key: "), F.initcap(key.cast("string")),
    )
    meta = {c: F.col(c) for c in ("semantic_type", "null_rate", "unique_count")}
    return columns.select(*_chunk(dataset_id, "column_description", F.col("column_name"), content, meta))


def index_chunks(dataset_id: str, columns: DataFrame, table: DataFrame, max_columns: int | None = None) -> DataFrame:
    """The indexing variant: columns with at most half nulls (the first ``max_columns``, if given) and one overview chunk."""
    usable = columns.where(F.col("null_rate") <= 0.5)
    usable = usable if max_columns is None else usable.orderBy("ordinal").limit(max_columns)
    key = (F.col("semantic_type") == "identifier") & (F.col("unique_count") == F.col("total_rows"))
    content = F.concat(
        F.lit("Column: "), F.col("column_name"), F.lit("\nData type: "), F.col("data_type"),
        F.lit("\nSemantic type: "), F.col("semantic_type"), F.lit("\nNull rate: "), _percent(F.col("null_rate")),
        F.lit("\nUnique values: "), F.col("unique_count").cast("string"),
        F.lit("\nSample values: "), F.concat_ws(", ", F.slice("sample_values", 1, 5)),
        F.when(key, "\nRole: Primary key / identifier").otherwise(""),
    )
    meta = {c: F.col(c) for c in ("data_type", "semantic_type", "null_rate", "unique_count")}
    described = usable.select(*_chunk(dataset_id, "column_description", F.col("column_name"), content, meta))
    counts = columns.agg(
        F.struct(
            F.least(F.count_if(F.col("null_rate") <= 0.5), F.lit(max_columns).cast("long")).alias("i"), F.count("*").alias("n")
        )
    ).scalar()
    overview = F.concat(
        F.lit("Dataset overview:\nTotal rows: "), F.format_number("row_count", 0),
        F.lit("\nTotal columns: "), F.col("column_count").cast("string"),
        F.lit("\nCompleteness score: "), _percent(F.col("completeness_score")),
        F.lit("\nConsistency score: "), _percent(F.col("consistency_score")),
        F.lit("\nDuplicate rows removed: "), F.format_number("duplicate_count", 0),
        F.lit("\nColumns indexed: "), F.col("_c.i").cast("string"), F.lit(" of "), F.col("_c.n").cast("string"),
    )
    meta = {c: F.col(c) for c in ("row_count", "column_count", "completeness_score")}
    one = table.withColumn("_c", counts).select(
        *_chunk(dataset_id, "profile_summary", F.lit(None), overview, meta)
    )
    return described.unionByName(one)


def profile_chunks(dataset_id: str, columns: DataFrame, table: DataFrame) -> DataFrame:
    """One summary chunk and one statistics chunk per numeric column."""
    summary = F.concat(
        F.lit("Dataset profile summary:\nTotal rows: "), F.col("row_count").cast("string"),
        F.lit("\nTotal columns: "), F.col("column_count").cast("string"),
        F.lit("\nCompleteness score: "), _percent(F.col("completeness_score")),
        F.lit("\nConsistency score: "), _percent(F.col("consistency_score")),
        F.lit("\nDuplicate rows: "), F.col("duplicate_count").cast("string"),
        F.lit("\nHas time series: "), F.initcap(F.col("has_time_series").cast("string")),
    )
    meta = {c: F.col(c) for c in ("row_count", "completeness_score")}
    first = table.select(*_chunk(dataset_id, "profile_summary", F.lit(None), summary, meta))
    numbers = F.concat(
        F.lit("Statistics for column '"), F.col("column_name"), F.lit("':\nMean: "), _text(F.col("mean")),
        F.lit("\nStd dev: "), _text(F.col("stddev")), F.lit("\nMin: "), _text(F.col("min_val")),
        F.lit(", Max: "), _text(F.col("max_val")), F.lit("\nMedian (P50): "), _text(F.col("p50")),
        F.lit("\nSkewness: "), _text(F.col("skewness")),
    )
    meta = {c: F.col(c) for c in ("mean", "stddev", "min_val", "max_val", "p50", "skewness")}
    stats = columns.where((F.col("kind") == "numeric") & F.col("mean").isNotNull()).select(
        *_chunk(dataset_id, "column_statistics", F.col("column_name"), numbers, meta)
    )
    return first.unionByName(stats)


def insight_chunks(dataset_id: str, insights: DataFrame) -> DataFrame:
    listed = F.concat(F.lit("['"), F.concat_ws("', '", "source_columns"), F.lit("']"))
    content = F.concat(
        F.lit("Insight: "), F.col("headline"), F.lit("\n"), F.col("explanation"),
        F.lit("\nBusiness impact: "), F.col("business_impact"),
        F.lit("\nRelated columns: "), F.when(F.size("source_columns") > 0, listed).otherwise("[]"),
    )
    meta = {c: F.col(c) for c in ("business_impact", "confidence")}
    return insights.select(*_chunk(dataset_id, "insight", F.lit(None), content, meta))


def correlation_chunks(dataset_id: str, correlations: DataFrame, min_abs_r: float = 0.5) -> DataFrame:
    strong = correlations.where(F.abs("r") >= min_abs_r)
    content = F.concat(
        F.lit("Correlation: '"), F.col("col_a"), F.lit("' and '"), F.col("col_b"), F.lit("' have a "),
        F.col("strength"), F.when(F.col("r") > 0, " positive").otherwise(" negative"),
        F.lit(" correlation (r = "), F.format_number("r", 3), F.lit(")."),
    )
    return strong.select(
        *_chunk(dataset_id, "correlation", F.lit(None), content, {c: F.col(c) for c in ("r", "strength")})
    )


# ── chunk table ─────────────────────────────────────────────────────────────


def upsert_chunks(current: DataFrame, new: DataFrame, version: str = "version", key: str = "id") -> DataFrame:
    """Both sides with the newest row per id; running it twice changes nothing."""
    both = current.unionByName(new)
    newest = F.max_by(F.struct(*[c for c in both.columns if c != key]), ref(version))
    return both.groupBy(ref(key)).agg(newest.alias("_n")).select(key, "_n.*")


def delete_chunks(current: DataFrame, dataset_id: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    out = current
    if dataset_id is not None:
        out = out.where(~F.col("dataset_id").eqNullSafe(F.lit(dataset_id)))
    if ids is not None:
        out = out.join(ids, "id", "left_anti")
    return out


def page_chunks(chunks: DataFrame, size: int, after=None, key: str = "id", where: Column | None = None) -> DataFrame:
    """Keyset paging: the next ``size`` rows after the last key of the previous page."""
    data = chunks.where(where) if where is not None else chunks
    if after is not None:
        data = data.where(ref(key) > F.lit(after))
    return data.orderBy(ref(key)).limit(size)


def chunk_counts(chunks: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    return chunks.groupBy(*[ref(c) for c in by]).agg(F.count("*").alias("chunks"))
