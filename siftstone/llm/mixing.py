"""Mixing sources to target weights, in exact word counts and evenly over output shards.

The target of each source is split into draws of documents: whole passes, then a prefix of a random order (the
order of a hash) that is cut inside its last document. The numbers of draws per source are then divided among the output
shards by a tree: each node gives half of its draws to the left, composed by a multivariate hypergeometric draw, until every
shard has its quotas. Each source's draws in permuted order fill the quotas one after another, so the shards get disjoint
blocks, and every shard is shuffled by itself. DataFrame functions only; the same seed gives the same mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Weights by place of the source in code point order, repeating; the mix has this share of all words; the most passes.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Documents with the same first hexadecimal digits of their hash are ordered together: about this many per source.
GROUP_ROWS = 50_000
#: Ranks are looked up in the quotas by blocks of this many.
CHUNK = 4_096
DRAWS_PER_SHARD = 20_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, documents, target`` per source of ``sized(source, size)``.

    Targets are in proportion to the weights, but no more than ``most`` times the source's size; what a source cannot take is shared
    anew among the rest. That ends at ``target = min(most * size, level * weight)``, with the level found from running sums over the
    sources in the order in which they fill up. Sources are a short table: one row each.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sums.withColumn("weight", weight).withColumn("most", (F.col("source_size") * most).cast("double"))
    everywhere = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("wanted", F.sum("source_size").over(everywhere) * share)
    rows = rows.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # supposing that just the sources before are full, the level rises up to the first that isn't and falls after it
    target = F.least("most", F.max("level").over(everywhere) * F.col("weight"))
    return rows.select("source", "source_size", "documents", target.alias("target"))


def ordered_documents(sized: DataFrame, totals: DataFrame, order: Column) -> DataFrame:
    """Adds ``place`` (0, 1, …) and ``words_before`` of each document with words in its source's random order.

    No source is sorted as a whole: documents are ordered within groups of the same first digits of the hash, and the groups' running
    counts and sums are added. ``totals`` adds its columns per source.
    """
    largest = totals.agg(F.max("documents")).first()[0] or 0
    digits = max(2, math.ceil(math.log(max(largest / GROUP_ROWS, 1), 16)))
    hashed = sized.filter("size > 0").withColumn("__order", order).withColumn("__group", F.substring("__order", 1, digits))
    groups = hashed.groupBy("source", "__group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(
        F.col("source").alias("__s"), F.col("__group").alias("__g"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("__w"),
    ).join(totals.withColumnRenamed("source", "__t"), F.col("__s").eqNullSafe(F.col("__t"))).drop("__t")
    within = Window.partitionBy("source", "__group").orderBy("__order", "doc_id", "size")
    numbered = hashed.withColumn("__r", F.row_number().over(within)).withColumn("__c", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    return numbered.join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__group") == F.col("__g"))).withColumns({
        "place": F.col("__n") + F.col("__r") - 1,
        "words_before": F.col("__w") + F.coalesce("__c", F.lit(0)),
    }).drop("__s", "__g", "__n", "__w", "__r", "__c", "__group", "__order")


def _uniform(*parts: Column) -> Column:
    """A number above 0 and below 1 from a hash of the parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(2**52)) + F.lit(0.5)) / float(2**52)


def hypergeometric(good: Column, total: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``good`` ones: inverse of the distribution function at ``uniform``.

    Probabilities follow from their neighbours' by ratio; all values within 12 standard deviations (and 12 more) of the mode are summed,
    beyond which less than a double's precision remains.
    """
    k, n, m = (c.cast("double") for c in (good, total, drawn))
    mode = F.floor((m + 1) * (k + 1) / (n + 2))
    spread = F.sqrt(F.greatest(m * k / n * (n - k) / n * (n - m) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
    reach = F.ceil(spread * 12) + 12
    low = F.greatest(F.lit(0), drawn + good - total, mode - reach).cast("long")
    high = F.least(drawn, good, mode + reach).cast("long")

    def following(p, x):
        x = x.cast("double")
        return p * (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))

    values = F.sequence(low, high)
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
    whole = F.aggregate(values, start, lambda a, x: F.struct(following(a["p"], x).alias("p"), (a["sum"] + a["p"]).alias("sum")), lambda a: a["sum"])
    begin = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), low.alias("at"), (whole * uniform).alias("goal"))
    found = F.aggregate(
        values, begin,
        lambda a, x: F.struct(following(a["p"], x).alias("p"), (a["sum"] + a["p"]).alias("sum"), F.when(a["sum"] < a["goal"], x).otherwise(a["at"]).alias("at"), a["goal"].alias("goal")),
        lambda a: a["at"],
    )
    return F.when((n <= 0) | (m <= 0) | (k <= 0), F.lit(0).cast("long")).when(k >= n, drawn.cast("long")).otherwise(found)


def _split(seed: str, level: int):
    """One step of a node's split: what the left half gets of the next source."""

    def step(a, quota):
        taken = hypergeometric(quota, a["total"], a["drawn"], _uniform(F.lit(seed), F.lit(level), F.col("node"), a["i"]))
        return F.struct(
            (a["i"] + 1).alias("i"), (a["total"] - quota).alias("total"), (a["drawn"] - taken).alias("drawn"), F.concat(a["left"], F.array(taken)).alias("left")
        )

    return step


def shard_quotas(draws: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """``source, shard, first, quota``: the draws of each source (``draws(source, n)``) divided among ``shards`` (a power of 2).

    Each node of the tree is a row with one quota per source. Going through the sources, the left half's part of a source is a
    hypergeometric draw from what is left of the node's draws, which together is the multivariate distribution. Children's totals differ by one at most.
    """
    nodes = draws.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "n"))).alias("s"))
    nodes = nodes.select(F.lit(0).cast("long").alias("node"), F.col("s.source").alias("sources"), F.col("s.n").alias("quotas"))
    for level in range(int(math.log2(shards))):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        start = F.struct(
            F.lit(0).alias("i"), total.alias("total"), F.floor(total / 2).cast("long").alias("drawn"), F.array().cast("array<bigint>").alias("left")
        )

        left = F.aggregate("quotas", start, _split(seed, level), lambda a: a["left"])
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")),
        )
        nodes = nodes.withColumn("left", left).select("sources", F.explode(halves).alias("h")).select("h.node", "sources", "h.quotas")
    each = nodes.select(F.col("node").alias("shard"), F.explode(F.arrays_zip("sources", "quotas")).alias("z")).select("shard", F.col("z.sources").alias("source"), F.col("z.quotas").alias("quota"))
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("first", F.coalesce(F.sum("quota").over(upto), F.lit(0))).filter("quota > 0")


def draw(sized: DataFrame, shards: int | None = None, whole: bool = False, seed: str = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets, documents in their random order, and draws of ``sized(doc_id, source, size, …)``; other columns travel along.

    A draw has the document's columns and ``place, pass, words, shard, position``: ``words`` of its words are taken in that pass, all but in the
    last draw of a source; with ``whole`` that one is rounded to all or nothing. ``place`` numbers a source's documents, so
    (source, place) names an input row, also among repeated ones. Documents without words are never drawn. A null source is a source of its
    own, the last one. An empty table gives an empty mix.
    """
    others = [c for c in sized.columns if c != "source"]
    totals = stored(targets(sized.select("source", "size")), "mix-targets")
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - passes * F.col("source_size")).cast("long")
    plan = totals.select("source", "documents", passes.alias("passes"), rest.alias("rest"))
    placed = ordered_documents(sized, plan, order)
    part = F.greatest(F.least(F.col("rest") - F.col("words_before"), F.col("size")), F.lit(0))
    part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long")) if whole else part
    # all passes but the last are whole
    numbers = F.sequence(F.lit(1).cast("long"), F.col("passes") + 1)
    drawn = F.transform(numbers, lambda i: F.struct(i.alias("pass"), F.when(i <= F.col("passes"), F.col("size")).otherwise(part).alias("words")))
    draws = placed.withColumn("d", F.explode(F.filter(drawn, lambda d: d["words"] > 0)))
    draws = draws.select("source", *others, "place", "d.pass", "d.words", (F.col("place") + (F.col("d.pass") - 1) * F.col("documents")).alias("rank"))
    # the last pass is a prefix of the order, so that ranks have no gaps
    counts = stored(draws.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "mix-draws")
    if shards is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
        shards = 2 ** max(0, math.ceil(math.log2(max(total / DRAWS_PER_SHARD, 1))))
    quotas = shard_quotas(counts, shards, seed)
    chunks = quotas.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / CHUNK), F.floor((F.col("first") + F.col("quota") - 1) / CHUNK))))
    chunks = chunks.select(F.col("source").alias("__s"), "shard", "first", "quota", "chunk")
    dealt = draws.withColumn("__chunk", F.floor(F.col("rank") / CHUNK)).join(
        chunks, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__chunk") == F.col("chunk")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("quota"))
    ).drop("__s", "__chunk", "chunk", "first", "quota", "rank")
    shuffled = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "doc_id", "pass", "place"), "source", "place", "pass"))
    return totals, placed, dealt.withColumn("position", shuffled)


def taken_words(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs(doc_id, source, text)``: the words that the mix takes of it, repeats counted."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")]
    sized = stored(docs.select(*own), "mix-sizes")
    totals, placed, draws = draw(sized, seed=seed)
    key = ["source", "place", "doc_id", "size"]
    unused = placed.select(*key, F.lit(0).cast("long").alias("words"))
    taken = draws.select(*key, "words").unionByName(unused).groupBy(*key).agg(F.sum("words").alias("taken"))
    every = taken.drop("place").unionByName(sized.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    by_source = totals.select(F.col("source").alias("__s"), "source_size", "target")
    return every.join(by_source, F.col("source").eqNullSafe(F.col("__s"))).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` mixed: each row as often as it is drawn as a whole, all its columns; rows lie in shards, shuffled within each."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row.alias("row"))
    _, _, draws = draw(sized, whole=True, seed=seed)
    return draws.select("row.*")
