"""Near-duplicate documents by HyperMinHash.

Documents with the same set of word shingles are one class. A class has a HyperMinHash sketch (see ``shingles``);
sketches that agree in a band of registers meet in a bucket. Inside a bucket the collision-corrected Jaccard estimate of every pair
(left to the first band that the pair shares) leaves the candidates, which are not listed: each bucket only says which of its members hang together.
Groups of hanging classes then get their full sets from the texts and are compared exactly, where each pair that is not yet connected and passes the
estimate is verified. Large buckets and groups are cut into blocks, and every two blocks are compared in a task of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import byte_buffer, plain_ids, signed, stored, tidy
from .components import connected

#: Links: 100 * intersection >= PERCENT * union. Pairs are verified down to MARGIN standard errors below.
PERCENT = 75
MARGIN = 5.0
#: Members of a bucket or a group that one task compares with as many others.
BUCKET_BLOCK, GROUP_BLOCK = 4_096, 1_024
SALTS = 16


def _sketches(docs: DataFrame) -> DataFrame:
    """``node, n_shingles, key, registers`` of ``docs(node, text)``; key and registers are null for empty sets."""

    def run(batches):
        for batch in batches:
            data, offsets = byte_buffer(batch.column(1))
            counts, keys, registers = [], [], []
            for _, own in shingles.shingle_sets(data, offsets):
                counts.append(len(own))
                keys.append(shingles.set_key(own) if len(own) else None)
                registers.append(shingles.sketch(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(registers, pa.binary())], names=["node", "n_shingles", "key", "registers"])

    return docs.select("node", "text").mapInArrow(tidy(run), "node long, n_shingles long, key binary, registers binary")


def _band_rows(sketches: DataFrame) -> DataFrame:
    """``node, band`` with one 64-bit key per band."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                piece = batch.slice(at, 1_000)
                keys = [signed(shingles.band_keys(np.frombuffer(r, np.uint16))) for r in piece.column(1).to_pylist()]
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(piece.column(0).to_numpy(), shingles.BANDS)), pa.array(np.concatenate(keys))], names=["node", "band"])

    return sketches.select("node", "registers").mapInArrow(tidy(run), "node long, band long")


def _in_blocks(rows: DataFrame, key: str, counts: DataFrame, block: int) -> DataFrame:
    """``rows`` with ``i, j, side``: one copy per pair of blocks of its ``key`` group that the row's block is part of.

    ``counts(key, n)`` has the group sizes; rows of groups that it lacks go away. A group has n / block blocks, to which a hash deals its rows.
    """
    dealt = rows.join(counts, key)
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j")))
    return dealt.withColumn("mine", mine).withColumn("pair", F.explode(pairs)).withColumns(
        {"i": F.col("pair.i"), "j": F.col("pair.j"), "side": (F.col("mine") != F.col("pair.i")).cast("int")}
    ).drop("mine", "pair", "n")


def _grouped(batches, keys: int):
    """Rows of sorted batches, one group of equal leading ``keys`` columns after another, as lists of record batches."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = tuple(c[a] for c in columns)
            if own != name and held:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            name = own
    if held:
        yield held


def _registers(column) -> np.ndarray:
    data, _ = byte_buffer(column)
    return data.view(np.uint16).reshape(-1, shingles.REGISTERS) if data.flags["C_CONTIGUOUS"] and data.ctypes.data % 2 == 0 else np.frombuffer(data.tobytes(), np.uint16).reshape(-1, shingles.REGISTERS)


def _hopeful(a, b) -> np.ndarray:
    """Pairs of sketches whose estimate does not rule the wanted similarity out."""
    value, used = shingles.estimate(a, b)
    wanted = PERCENT / 100
    return value >= wanted - MARGIN * np.sqrt(wanted * (1 - wanted) / np.maximum(used, 1))


class _Groups:
    """Which of some members hang together."""

    def __init__(self, size):
        self.of = np.arange(size)

    def join(self, a, others):
        for old in np.unique(self.of[others]):
            low, high = sorted((self.of[a], old))
            self.of[self.of == high] = low


def _links(nodes, of):
    """Each member that is not the first of its group, with that one."""
    far = np.flatnonzero(of != np.arange(len(of)))
    return nodes[far], nodes[of[far]]


def _hanging(members: DataFrame) -> DataFrame:
    """``a, b``: for each bucket's members that hang together by hopeful pairs, links to the first of them."""

    def run(batches):
        out_a, out_b = [], []
        for held in _grouped(batches, 3):
            table = pa.Table.from_batches(held)
            nodes, side, n = table["node"].to_numpy(), table["side"].to_numpy(), table["n_shingles"].to_numpy()
            i, j = held[0].column(1)[0].as_py(), held[0].column(2)[0].as_py()
            if len(nodes) < 2:
                continue
            registers, groups = _registers(table["registers"]), _Groups(len(nodes))
            for at in range(len(nodes) - 1):
                # within one block every later member, of two blocks those of the other side
                others = at + 1 + np.flatnonzero((side[at + 1 :] != side[at]) | (i == j))
                others = others[(groups.of[others] != groups.of[at]) & (100 * np.minimum(n[others], n[at]) >= PERCENT * np.maximum(n[others], n[at]))]
                for k in range(0, len(others), 4_096):
                    few = others[k : k + 4_096]
                    few = few[groups.of[few] != groups.of[at]]
                    if len(few):
                        groups.join(at, few[_hopeful(registers[at], registers[few])])
            a, b = _links(nodes, groups.of)
            out_a.append(a)
            out_b.append(b)
            if sum(map(len, out_a)) > 10_000:
                yield _pairs(out_a, out_b)
                out_a, out_b = [], []
        if out_a:
            yield _pairs(out_a, out_b)

    return members.mapInArrow(tidy(run), "a long, b long")


def _pairs(a, b):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _with_sets(texts: DataFrame) -> DataFrame:
    """``node, group, hashes`` of ``texts(node, group, text)``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                data, offsets = byte_buffer(piece.column(2))
                sets = [own.tobytes() for _, own in shingles.shingle_sets(data, offsets)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(sets, pa.binary())], names=["node", "group", "hashes"])

    return texts.select("node", "group", "text").mapInArrow(tidy(run), "node long, group long, hashes binary")


def _verified(members: DataFrame) -> DataFrame:
    """``a, b``: true links enough to connect what is linked within each group's pair of blocks."""

    def run(batches):
        for held in _grouped(batches, 3):
            table = pa.Table.from_batches(held)
            nodes, side = table["node"].to_numpy(), table["side"].to_numpy()
            i, j = held[0].column(1)[0].as_py(), held[0].column(2)[0].as_py()
            data, offsets = byte_buffer(table["hashes"])
            flat, cuts = np.frombuffer(data.tobytes(), np.uint64), offsets // 8
            n, groups = np.diff(cuts), _Groups(len(nodes))
            sets = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            registers = np.stack([shingles.sketch(s) for s in sets])
            for at in range(len(nodes) - 1):
                others = at + 1 + np.flatnonzero((side[at + 1 :] != side[at]) | (i == j))
                others = others[(groups.of[others] != groups.of[at]) & (100 * np.minimum(n[others], n[at]) >= PERCENT * np.maximum(n[others], n[at]))]
                if len(others):
                    others = others[_hopeful(registers[at], registers[others])]
                for k in range(0, len(others), 64):
                    # of each group one link is enough, so those joined meanwhile are left out
                    few = others[k : k + 64]
                    few = few[groups.of[few] != groups.of[at]]
                    if len(few):
                        groups.join(at, few[_linked(sets[at], [sets[o] for o in few])])
            a, b = _links(nodes, groups.of)
            if len(a):
                yield _pairs([a], [b])

    return members.mapInArrow(tidy(run), "a long, b long")


def _linked(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Exact test of one set against several."""
    flat, sizes = np.concatenate(others), np.array([len(o) for o in others])
    place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    found = np.concatenate(([0], np.cumsum(own[place] == flat)))
    ends = np.cumsum(sizes)
    common = found[ends] - found[ends - sizes]
    return 100 * common >= PERCENT * (len(own) + sizes - common)


def _nodes(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a ``node`` that names a text: the id, if ids are unique and not null (the second result), else a hash of id and text."""
    plain = plain_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("node", doc_id if plain else F.xxhash64(doc_id, text)), plain


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    The component id is the smallest document id that is reachable over links; one document of each component is kept, that one. Null
    and empty texts have no shingles and stand alone. Where ids are null or repeated, rows are told apart by id and text: equal rows
    are copies of each other, all rows with the component's smallest id are kept, and a component of null ids only has a null id and is kept.
    """
    nodes, plain = _nodes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    placed = components(nodes.select("node", "text"), plain)
    if plain:
        return placed.select(F.col("node").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("node") == F.col("component")).alias("kept"))
    rows = nodes.select("doc_id", "node").join(placed, "node")
    least = rows.groupBy("component").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "component").select("doc_id", "n_shingles", F.col("least").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("least")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, but one document of each component only; exact repeats of a row are copies too."""
    taken = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*taken).alias("rest")) if taken else docs.select("doc_id", "text", F.lit(None).alias("rest"))
    nodes, plain = _nodes(packed)
    placed = components(nodes.select("node", "text"), plain)
    dropped = placed.filter("node <> component").select("node")
    kept = nodes.join(dropped, "node", "left_anti")
    kept = kept if plain else kept.dropDuplicates(["node"])
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns])


def components(nodes: DataFrame, plain: bool) -> DataFrame:
    """``node, n_shingles, component`` of ``nodes(node, text)``, with the smallest node of each component; ``plain``: nodes are unique."""
    nodes = nodes.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    nodes = nodes if plain else nodes.dropDuplicates(["node"])
    sketched = stored(_sketches(nodes), "sketches")
    full = sketched.filter("key IS NOT NULL")
    classes = full.groupBy("key").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct("n_shingles", "registers"), "node").alias("s"))
    classes = stored(classes.select("key", "node", "n", "s.n_shingles", "s.registers"), "classes")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    bands = _band_rows(classes)
    crowded = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = _in_blocks(bands, "band", crowded, BUCKET_BLOCK).join(classes.select("node", "n_shingles", "registers"), "node")
    members = members.select("band", "i", "j", "node", "side", "n_shingles", "registers")
    hanging = connected(_hanging(members.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j", "node")))
    hanging = hanging.select("node", F.col("component").alias("group"))

    sets = _with_sets(nodes.join(hanging, "node"))
    sizes = hanging.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    grouped = _in_blocks(sets, "group", sizes, GROUP_BLOCK).select("group", "i", "j", "node", "side", "hashes")
    found = connected(_verified(grouped.repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j", "node")))

    # classes of several documents hand their component to all of them; a document alone in its class has it by its own node
    several = classes.filter("n > 1").select("key", F.col("node").alias("first")).join(found.select(F.col("node").alias("first"), "component"), "first", "left")
    several = several.select(F.col("key").alias("k"), F.coalesce("component", "first").alias("shared"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = sketched.select("node", "n_shingles", "key").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    placed = salted.join(several, (F.col("key") == F.col("k")) & (F.col("salt") == F.col("s")), "left").join(found, "node", "left")
    return placed.select("node", "n_shingles", F.coalesce("shared", "component", "node").alias("component"))
