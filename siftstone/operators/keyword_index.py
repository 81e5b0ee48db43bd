"""A stored inverted index for BM25 search.

Documents lie in spans of bounded size. A span keeps, for each of its words, the documents that have it and how often; and, in narrow columns beside that,
their number, the largest count and the shortest length. From those columns alone follows the highest score any document of a span
can reach for a query, so that a search scores the most promising spans first and then only those that can still beat what it has found.

The index is a folder of Parquet tables: ``cells`` (words and documents of the spans), ``maxima`` (documents of a word that left), ``totals``, ``gone``
(documents replaced or deleted). Changes add files: what leaves is counted off in ``maxima`` and ``totals``. One writer at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..session import cut_lineage
from . import retrieval

#: Documents of a span, about, and words of its texts.
SPAN_DOCS, SPAN_WORDS = 2_500, 2_500_000
#: Bytes of a word, about, as a first guess of the spans a table needs.
WORD_BYTES = 6
#: Folders that appended cells go to.
FOLDERS = 16
#: What stands between words: Java's ``(?U)\\s``.
SPACE = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Spans that a query looks into first.
FIRST_SPANS = 4
#: Spans are broadcast up to so many rows, beyond it joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Spans whose flags of dead documents (a byte each) are broadcast.
FLAGGED_SPANS = 10_000
K1, B = 1.5, 0.75


@dataclass(frozen=True)
class KeywordIndex:
    """A stored index; ``kind`` is the type of the documents' ids."""

    spark: SparkSession
    folder: str
    kind: str

    def table(self, name: str) -> DataFrame:
        schema = {
            "cells": f"span long, term string, places array<int>, tf array<int>, ids array<{self.kind}>, lengths array<int>, max_tf int, min_length int, df int, folder int",
            "maxima": "term string, span long, df long, max_tf int, min_length int, folder int",
            "totals": "span long, docs long, texts long, words long",
            "gone": f"span long, id {self.kind}",
        }[name]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")


def build_index(documents: DataFrame, folder: str, document_id: str = "doc_id", text: str = "text") -> KeywordIndex:
    """An index of the documents in a new folder. Of rows that share an id the one with the greatest text stays. A null text has no words and counts in no average."""
    kind = documents.select(ref(document_id)).schema[0].dataType.simpleString()
    index = KeywordIndex(documents.sparkSession, folder, kind)
    nothing = index.spark.createDataFrame([], f"span long, id {kind}")
    nothing.write.parquet(f"{folder}/gone")
    index.spark.createDataFrame([], "term string, span long, df long, max_tf int, min_length int").write.parquet(f"{folder}/maxima/folder=0")
    _append(index, documents, document_id, text, 0)
    return index


def open_index(spark: SparkSession, folder: str) -> KeywordIndex:
    return KeywordIndex(spark, folder, spark.read.parquet(f"{folder}/gone").schema["id"].dataType.simpleString())


def _append(index: KeywordIndex, documents: DataFrame, document_id: str, text: str, first_span: int) -> None:
    docs = documents.select(ref(document_id).alias("id"), ref(text).alias("text"))
    # texts are sorted by id only where ids repeat, and cut into words once, on their way to the spans
    size = docs.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).agg(F.count("*").alias("n"), F.max("n").alias("most"), F.sum("bytes").alias("bytes")).first()
    if (size.most or 0) > 1:
        docs = docs.groupBy("id").agg(F.max("text").alias("text"))
    docs = docs.select("id", F.lower("text").alias("text"))
    tasks = max(1, math.ceil(size.n / SPAN_DOCS), math.ceil((size.bytes or 0) / (SPAN_WORDS * WORD_BYTES)))
    most, step = math.ceil(1.25 * SPAN_DOCS), 1 << 20  # tasks hold about a span; what one has beyond a quarter more is a span of its own

    def cells(batches):
        span, held, n, count = first_span + TaskContext.get().partitionId() * step, [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(most - n, batch.num_rows - at))
                at += part.num_rows
                part = pa.table({"id": part.column(0), "w": _split(part.column(1))})
                held.append(part)
                n += part.num_rows
                count += len(part["w"].chunk(0).flatten())
                if n >= most or count >= 1.25 * SPAN_WORDS:
                    yield _cells(span, pa.concat_tables(held).combine_chunks(), index_kind)
                    span, held, n, count = span + 1, [], 0, 0
        if held:
            yield _cells(span, pa.concat_tables(held).combine_chunks(), index_kind)

    index_kind = pa.field("id", docs.limit(0).toArrow().schema.field("id").type).type
    schema = f"span long, term string, places array<int>, tf array<int>, ids array<{index.kind}>, lengths array<int>, max_tf int, min_length int, df int"
    docs.repartition(tasks, F.xxhash64("id")).mapInArrow(cells, schema).write.mode("append").parquet(f"{index.folder}/cells/folder={first_span % FOLDERS}")
    new = index.table("cells").where(F.col("span") >= first_span)
    totals = new.where(F.col("term").isNull()).select("span", F.size("ids").cast("long").alias("docs"), F.size(F.array_compact("lengths")).cast("long").alias("texts"), F.aggregate(F.array_compact("lengths"), F.lit(0).cast("long"), lambda s, x: s + x).alias("words"))
    totals.coalesce(1).write.mode("append").parquet(f"{index.folder}/totals")


def _split(texts: pa.Array) -> pa.Array:
    """The words of texts in lower case, as ``retrieval.tokens`` cuts them; a null text has none."""
    texts = pc.utf8_trim(pc.replace_substring_regex(texts, SPACE, " "), " ")
    lists = pc.split_pattern(texts, " ")
    bare = pc.equal(texts, "")
    if pc.any(bare).as_py():  # the only text with an empty part
        lists = pc.if_else(bare, pa.scalar([], lists.type), lists)
    return lists


def _cells(span: int, docs: pa.Table, kind) -> pa.RecordBatch:
    """Cells of one span, by word; the first row has its documents."""
    lists = docs["w"].combine_chunks()
    offsets = lists.offsets.to_numpy()
    lengths = np.diff(offsets).astype(np.int32)
    coded = lists.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(lists)), lengths)
    pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * max(1, len(lists)) + owner, return_counts=True)
    word, place = np.divmod(pair, max(1, len(lists)))
    cuts = np.flatnonzero(np.diff(word, prepend=-1))
    bounds = np.append(cuts, len(word)).astype(np.int32)
    n = len(cuts)
    listed = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.concatenate(([0, 0], bounds[1:])).astype(np.int32) if n else np.zeros(2, np.int32)), pa.array(values, kind))
    whole = lambda values, kind: pa.array([values, *[None] * n], pa.list_(kind))
    top = np.maximum.reduceat(tf, cuts) if n else np.zeros(0, int)
    short = np.minimum.reduceat(lengths[place], cuts) if n else np.zeros(0, int)
    df = np.diff(np.append(cuts, len(word)))
    terms = pa.concat_arrays([pa.array([None], pa.string()), coded.dictionary.cast(pa.string()).take(pa.array(word[cuts]))])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, span)), terms, listed(place.astype(np.int32), pa.int32()), listed(tf.astype(np.int32), pa.int32()),
            whole(docs["id"].to_pylist(), kind), whole([k if valid else None for k, valid in zip(lengths.tolist(), lists.is_valid().to_pylist())], pa.int32()),
            pa.array([0, *top.tolist()], pa.int32()), pa.array([0, *short.tolist()], pa.int32()), pa.array([0, *df.tolist()], pa.int32()),
        ],
        names=["span", "term", "places", "tf", "ids", "lengths", "max_tf", "min_length", "df"],
    )


# ── changes ─────────────────────────────────────────────────────────────────


def _bury(index: KeywordIndex, ids: DataFrame) -> None:
    """Takes documents out: they are named in ``gone`` and counted off."""
    own = index.table("cells").where(F.col("term").isNull())
    placed = own.select("span", F.posexplode(F.arrays_zip("ids", "lengths")).alias("place", "doc")).select("span", "place", "doc.*").toDF("span", "place", "id", "length")
    found = placed.join(ids, "id", "left_semi").join(index.table("gone"), ["span", "id"], "left_anti")
    found = cut_lineage(found)
    spans = found.agg(F.countDistinct("span")).first()[0]
    if not spans:
        return
    # a word has one row in a span, so its documents are counted there: postings are neither exploded nor moved
    dead = found.groupBy("span").agg(F.sort_array(F.collect_set("place")).alias("dead"))
    before = lambda i: F.coalesce(F.get("dead", i - 1), F.lit(-1))
    flags = F.flatten(F.transform("dead", lambda p, i: F.concat(F.array_repeat(F.lit(False), p - before(i) - 1), F.array(F.lit(True)))))
    dead = dead.select("span", flags.alias("dead"))
    cells = index.table("cells").where(F.col("term").isNotNull()).select("span", "term", "places")
    words = cells.join(F.broadcast(dead) if spans <= FLAGGED_SPANS else dead, "span").select("term", "span", (-F.size(F.filter("places", lambda p: F.get("dead", p)))).cast("long").alias("df")).where("df < 0")
    words.select("term", "span", "df", F.lit(0).alias("max_tf"), F.lit(2**31 - 1).alias("min_length")).write.mode("append").parquet(f"{index.folder}/maxima/folder=0")
    found.groupBy("span").agg((-F.count("*")).alias("docs"), (-F.count("length")).alias("texts"), (-F.coalesce(F.sum("length"), F.lit(0))).cast("long").alias("words")).coalesce(1).write.mode("append").parquet(f"{index.folder}/totals")
    found.select("span", "id").write.mode("append").parquet(f"{index.folder}/gone")


def _maxima(index: KeywordIndex) -> DataFrame:
    """A row per word and span, and what was counted off: narrow columns of the cells, so that nothing has to be written twice."""
    own = index.table("cells").where("term IS NOT NULL AND df IS NOT NULL").select("term", "span", F.col("df").cast("long").alias("df"), "max_tf", "min_length")
    return index.table("maxima").drop("folder").unionByName(own)


def upsert(index: KeywordIndex, documents: DataFrame, document_id: str = "doc_id", text: str = "text") -> None:
    """Adds documents; those whose id is there already replace it."""
    documents = cut_lineage(documents.select(ref(document_id).alias("id"), ref(text).alias("text")))
    _bury(index, documents.select("id").distinct())
    last = index.table("totals").agg(F.max("span")).first()[0]
    _append(index, documents, "id", "text", 0 if last is None else last + 1)


def delete(index: KeywordIndex, ids: DataFrame) -> None:
    """Takes out the documents named by ``ids`` (column ``id``)."""
    _bury(index, ids.select("id").distinct())


# ── search ──────────────────────────────────────────────────────────────────


def _part(tf, length, average: float, k1: float, b: float):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


@dataclass(frozen=True)
class Found:
    """``rows``: query_id, document_id, score, rank. ``looked``: (query, span) pairs that were scored, of ``matching`` that share a word."""

    rows: DataFrame
    looked: int
    matching: int


def search_index(
    index: KeywordIndex, queries: DataFrame, top_k: int = 3, k1: float = K1, b: float = B, query_id: str = "query_id", query_text: str = "text",
) -> Found:
    """BM25 top-k per query from the index: the same rows as ``bm25`` on the documents that it holds."""
    asked = queries.select(ref(query_id).alias("query_id"), F.explode(retrieval.query_terms(ref(query_text))).alias("term")).distinct()
    wanted = cut_lineage(asked.select("term").distinct())
    few = wanted.count() <= retrieval.BROADCAST_WORDS
    size = index.table("totals").agg(
        F.sum("docs").alias("n"), F.sum("texts").alias("texts"), F.sum("words").alias("words"), F.countDistinct("span").alias("spans")
    ).first()
    average = float(size.words / size.texts) if size.texts and size.words else 1.0
    maxima = _maxima(index).join(F.broadcast(wanted) if few else wanted, "term")
    maxima = cut_lineage(maxima.groupBy("term", "span").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length")))
    frequency = maxima.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    idf = F.log1p((F.lit(size.n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = asked.join(frequency, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("words"))
    words = cut_lineage(words)
    look = lambda pairs, few_spans: _scored(index, pairs, words, wanted, few, few_spans, top_k, average, k1, b)
    if size.spans <= FIRST_SPANS:  # nothing to leave out
        all_spans = [r.span for r in index.table("totals").select("span").distinct().collect()]
        pairs = words.select("query_id", F.explode(F.lit(all_spans).cast("array<bigint>")).alias("span"))
        looked = words.count() * size.spans
        return Found(retrieval._ranked(look(pairs, True), top_k, "document_id", 4), looked, looked)
    best = F.sum(F.col("idf") * _part(F.col("max_tf"), F.col("min_length"), average, k1, b))
    weights = words.select("query_id", F.inline("words"))
    bounds = weights.join(maxima.where("df > 0"), "term").groupBy("query_id", "span").agg(best.alias("bound"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "span")
    bounds = cut_lineage(bounds.withColumn("turn", F.row_number().over(order)))
    few_spans = size.spans <= BROADCAST_ROWS
    found = look(bounds.where(F.col("turn") <= FIRST_SPANS), few_spans)
    least = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("r") == top_k).select("query_id", "score")
    # equal scores go by id, so a span that can only draw level counts too
    rest = bounds.where(F.col("turn") > FIRST_SPANS).join(least, "query_id", "left").where(F.col("score").isNull() | (F.col("bound") >= F.col("score") - 1e-9))
    rest = cut_lineage(rest.select("query_id", "span"))
    more = rest.count()
    found = found.unionByName(look(rest, few_spans)) if more else found
    counted = bounds.agg(F.count("*").alias("all"), F.count_if(F.col("turn") <= FIRST_SPANS).alias("first")).first()
    return Found(retrieval._ranked(found, top_k, "document_id", 4), counted["first"] + more, counted["all"])


def _scored(index, pairs, words, wanted, few, few_spans, top_k, average, k1, b) -> DataFrame:
    """``query_id, document_id, score``: the best of each (query, span); a task holds a span's cells of the words that are asked for."""
    spans = pairs.select("span").distinct()
    spans = F.broadcast(spans) if few_spans else spans
    cells = index.table("cells").join(spans, "span", "left_semi")
    named = cells.join(F.broadcast(wanted) if few else wanted, "term", "left_semi").select("span", "term", "places", "tf", "ids", "lengths")
    named = named.unionByName(cells.where(F.col("term").isNull()).select(named.columns))
    gone = index.table("gone").join(spans, "span", "left_semi").groupBy("span").agg(F.collect_list("id").alias("ids"))
    items = named.unionByName(gone.select("span", *[F.lit(None).cast(named.schema[c].dataType).alias(c) for c in ("term", "places", "tf")], "ids", F.lit(None).cast("array<int>").alias("lengths")))
    words = words.select("query_id", F.col("words.term").alias("terms"), F.col("words.idf").alias("idf"))
    terms = pairs.select("query_id", "span").join(words, "query_id")
    own = items.select(F.col("span").alias("slice"), F.lit(0).alias("is_query"), "term", "places", "tf", "ids", "lengths", *retrieval._missing(words, items))
    sent = terms.select(F.col("span").alias("slice"), F.lit(1).alias("is_query"), *retrieval._missing(items.drop("span"), terms), *words.columns).select(own.columns)
    tasks = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
    placed = own.unionByName(sent).repartition(tasks, "slice").sortWithinPartitions("slice", "is_query")
    at = {c: i for i, c in enumerate(placed.columns)}

    def hold(table):
        ids, norm, dead = None, None, []
        names = table["term"].combine_chunks()
        for i in np.flatnonzero(names.is_null().to_numpy(zero_copy_only=False)):  # the span's documents, and those that are gone
            own_ids, lengths = table["ids"][i], table["lengths"][i]
            if lengths.is_valid:
                ids, norm = own_ids.values, k1 * (1 - b + b * lengths.values.to_numpy(zero_copy_only=False) / average)
            else:
                dead += own_ids.as_py()
        places, tf = table["places"].combine_chunks(), table["tf"].combine_chunks()
        at_place, n = places.flatten().to_numpy(), tf.flatten().to_numpy()
        part = n * (k1 + 1) / (n + norm[at_place])
        cuts = np.concatenate(([0], np.cumsum(np.nan_to_num(places.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
        parts = {t: (at_place[x:y], part[x:y]) for t, x, y in zip(names.to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()) if t is not None}
        alive = np.ones(len(ids), bool)
        if dead:
            alive = ~np.isin(np.array(ids.to_pylist(), object), np.array(dead, object))
        return ids, alive, parts

    def score(ready, batch):
        ids, alive, parts = ready
        rows, places, values = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        for i, (own, idf) in enumerate(zip(batch.column(at["terms"]).to_pylist(), batch.column(at["idf"]).to_pylist())):
            total = np.zeros(len(ids))
            for term, weight in zip(own, idf):
                if term in parts:
                    place, part = parts[term]
                    total[place] += weight * part
            _, place = retrieval._tops(np.where(alive & (total > 0), total, -np.inf)[None, :], top_k)
            rows.append(np.full(len(place), i))
            places.append(place)
            values.append(total[place])
        row, place = np.concatenate(rows), np.concatenate(places)
        yield pa.RecordBatch.from_arrays([batch.column(at["query_id"]).take(pa.array(row)), ids.take(pa.array(place)), pa.array(np.concatenate(values))], names=["query_id", "document_id", "score"])

    kind = placed.schema["query_id"].dataType.simpleString()
    found = placed.mapInArrow(lambda batches: retrieval._streamed(batches, hold, score), f"query_id {kind}, document_id {index.kind}, score double")
    return cut_lineage(found)
