"""Isolation forest: trees grow in parallel on small hash samples, rows are scored on Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import fixed_point, number, ref
from ..session import cut_lineage
from .quantiles import column_quantiles

TREE_ROWS = 256
NODE = "tree int, node int, feature int, threshold double, size int"


def _path_constant(n: np.ndarray) -> np.ndarray:
    """Average path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    many = n > 2
    out[many] = 2.0 * (np.log(n[many] - 1.0) + 0.5772156649015329) - 2.0 * (n[many] - 1.0) / n[many]
    return out


def _grow(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """Random splits down to the depth limit; node i has children 2i+1 and 2i+2."""
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes, pending = [], [(0, np.arange(len(x)), 0)]
    while pending:
        node, rows, depth = pending.pop()
        part = x[rows]
        open_features = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(open_features) == 0:
            nodes.append((tree, node, -1, 0.0, len(rows)))
            continue
        feature = int(rng.choice(open_features))
        column = part[:, feature]
        threshold = float(rng.uniform(column.min(), column.max()))
        left = column <= threshold
        nodes.append((tree, node, feature, threshold, len(rows)))
        pending += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "size"])


def _bound(share: float) -> int:
    """The signed 64-bit number that a ``share`` of all 64-bit hashes lies below (at 1 all but one)."""
    return min(int(share * 2**64) - 2**63, 2**63 - 1)


def tree_samples(data: DataFrame, key: Sequence[str], trees: int, rows: int, seed: int) -> DataFrame:
    """Up to 256 rows for each tree, chosen by a hash of the row key.

    A large table is thinned before the shuffle so that about 1.5 · 256 · trees
    rows move; a small one is offered to several trees.
    """
    wanted = TREE_ROWS * trees
    copies = int(min(trees, max(1, np.ceil(1.5 * wanted / max(rows, 1)))))
    share = min(1.0, 1.5 * wanted / max(rows * copies, 1))
    drawn = data.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy")).withColumn(
        "_hash", F.xxhash64(*[ref(k) for k in key], "_copy", F.lit(seed))
    )
    # Copies of a row start at its own tree and step on, so a tree never holds a row twice.
    home = F.pmod(F.xxhash64(*[ref(k) for k in key], F.lit(seed + 1)), F.lit(trees))
    step = max(1, trees // copies)
    drawn = drawn.where(F.col("_hash") < _bound(share)).withColumn(
        "tree", F.pmod(home + F.col("_copy") * step, F.lit(trees)).cast("int")
    )
    order = Window.partitionBy("tree").orderBy("_hash", *[ref(k) for k in key])
    return drawn.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= TREE_ROWS)


def score_rows(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    trees: int = 100,
    seed: int = 42,
    rows: int | None = None,
) -> DataFrame:
    """Adds ``anomaly`` in (0, 1]: 2^(−average path length / c(sample size))."""
    columns, key = list(columns), list(key)
    features = [F.coalesce(number(df, c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)]
    data = df.select(*[ref(k) for k in key], *features)
    rows = data.count() if rows is None else rows
    width = len(columns)
    names = [f"x{i}" for i in range(width)]
    sample = tree_samples(data, key, trees, rows, seed)

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_r")
        return _grow(int(part["tree"].iloc[0]), part[names].to_numpy(dtype=float), seed)

    # At most trees · 511 nodes: the only thing collected.
    nodes = sample.select("tree", "_r", *names).groupBy("tree").applyInPandas(grow, NODE).toPandas()
    numbers = {t: i for i, t in enumerate(sorted(nodes["tree"].unique()))}
    depth = int(np.ceil(np.log2(TREE_ROWS)))
    slots = 2 ** (depth + 1) - 1
    feature = np.full((len(numbers), slots), -1, dtype=np.int32)
    threshold = np.zeros((len(numbers), slots))
    length = np.zeros((len(numbers), slots))
    at = nodes["tree"].map(numbers).to_numpy(), nodes["node"].to_numpy()
    feature[at], threshold[at] = nodes["feature"], nodes["threshold"]
    length[at] = np.floor(np.log2(nodes["node"].to_numpy() + 1)) + _path_constant(nodes["size"].to_numpy())
    sizes = nodes.loc[nodes["node"] == 0, "size"].to_numpy()
    normal = float(_path_constant(np.array([sizes.mean().round()]))[0])
    model = df.sparkSession.sparkContext.broadcast((feature, threshold, length, normal))

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.DataFrame) -> pd.Series:
        feature, threshold, length, normal = model.value
        values = x.to_numpy(dtype=float)
        total = np.zeros(len(values))
        index = np.arange(len(values))
        for t in range(len(feature)):
            node = np.zeros(len(values), dtype=np.int64)
            for _ in range(depth):
                f = feature[t, node]
                right = values[index, np.maximum(f, 0)] > threshold[t, node]
                node = np.where(f >= 0, 2 * node + 1 + right, node)
            total += length[t, node]
        return pd.Series(np.exp2(-total / len(feature) / normal))

    return data.withColumn("anomaly", score(F.struct(*names)))


def isolation_forest(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    contamination: float = 0.05,
    trees: int = 100,
    seed: int = 42,
    max_results: int | None = None,
) -> DataFrame:
    """Multivariate outliers: the ``contamination`` share of rows that are isolated fastest.

    Needs two columns and fifty rows (else no row). Every row is scored once, into the
    shared folder; the cut is the exact quantile of all scores.
    """
    from .anomaly import _none

    columns, key = list(columns), list(key)
    rows = df.count()
    if len(columns) < 2 or rows < 50:
        return _none(df, key)
    scored = cut_lineage(score_rows(df, key, columns, trees, seed, rows))
    cut = column_quantiles(scored, ["anomaly"], [1.0 - contamination], rows=rows)
    cut = cut.select(F.col("q")[0]).first()[0]
    decision = F.lit(cut) - F.col("anomaly")
    confidence = F.round(F.least(F.lit(1.0), 0.5 + F.abs(decision) * 2), 4)
    values = F.concat_ws(
        ", ", *[F.concat(F.lit(f"{c}="), fixed_point(F.col(f"x{i}"), 4)) for i, c in enumerate(columns)]
    )
    found = scored.where(decision < 0).select(
        *[ref(k) for k in key],
        F.lit("multivariate").alias("column"),
        F.lit("IsolationForest").alias("detection_method"),
        F.lit("outlier").alias("anomaly_type"),
        F.when(confidence > 0.8, "medium").otherwise("low").alias("severity"),
        confidence.alias("confidence"),
        F.lit(1).alias("rows_affected"),
        values.alias("value"),
        F.round(decision, 6).alias("score"),
        F.concat(F.lit("Unusual combination of values: "), values).alias("description"),
    )
    if max_results is None:
        return found
    return found.orderBy("score", *[ref(k) for k in key]).limit(max_results)
