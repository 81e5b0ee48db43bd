"""Toxicity by maximum-scoring segments.

Each token has the log-odds of toxic against other labelled documents. Its Dirichlet prior is its stem's share, that
stem's prior the shorter stem's, and so on; a token frequent in all documents has a stronger prior. A linear-time scan finds every maximal-scoring passage (Ruzzo and Tompa); the
passages of a document are compared with what a document of its length shows by chance (extreme-value statistics:
``E = K n exp(-lambda S)``), and a logistic curve fitted on the labelled documents turns that evidence into a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_buffer, byte_codes, gram_hashes, mixed, row_groups, tidy, word_pieces, words

#: Tokens and stems are counted in 2 ** BUCKET_BITS hash buckets, which bounds the model that travels to the tasks (12 MB).
BUCKET_BITS = 20
STEMS = (4, 5, 6)
#: Most labelled documents that the model is fitted on; those with the smallest hash of their id are taken.
LABELLED_ROWS = 50_000
#: Weight of a prior: so many tokens, and so many more spread over all tokens by their frequency.
PRIOR_LEAST, PRIOR_SPREAD = 5.0, 1_000.0
#: A stem never tells a longer one more than this surely.
LEAST_SHARE = 0.01
#: What an uninformative token costs a passage.
DRIFT = 2.0
#: Chance statistics come from the passages of harmless documents above this quantile of their scores.
TAIL = 0.9
#: A passage is significant below this many chance passages per document.
SIGNIFICANT = 0.05
SEED = 17

_ASCII_WORD = np.zeros(256, bool)
for _range in (b"09", b"AZ", b"az", b"\x80\xff"):
    _ASCII_WORD[_range[0] : _range[1] + 1] = True
_SEPARATOR = ~_ASCII_WORD
_CODES = byte_codes(SEED)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]


def token_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of every token, and the buckets of the whole token and of its beginnings of ``STEMS`` bytes (one column each).

    Tokens are runs of ASCII letters, digits and bytes above 127; A-Z count as a-z. Where a token is no longer than a
    stem, that column repeats the whole token.
    """
    row, start, end, whole = words(data, offsets, _SEPARATOR, _CODES)
    out = np.empty((len(row), 1 + len(STEMS)), np.int64)
    out[:, 0] = whole >> np.uint64(64 - BUCKET_BITS)
    for k, size in enumerate(STEMS, 1):
        grams = mixed(gram_hashes(_CODES[data], size) + np.uint64(size))
        long = end - start > size
        out[:, k] = out[:, 0]
        out[long, k] = grams[start[long]] >> np.uint64(64 - BUCKET_BITS)
    return row, out


def _groups(column):
    """Row range, token rows and buckets, group by group."""
    data, offsets = byte_buffer(column)
    for first, last in row_groups(offsets):
        here, inner = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        if last > first + 1:
            yield first, last, *token_buckets(here, inner)
        else:  # a long text is cut between tokens
            parts = [token_buckets(here[a:b], np.array([0, b - a])) for a, b, _ in word_pieces(here, inner, _SEPARATOR)]
            yield first, last, *(np.concatenate(c) for c in zip(*parts))


def is_held_out(doc_id):
    """Documents whose labels are never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """``doc_id, toxic``: one row per labelled id outside the held-out fold (the larger label, if they differ), at most ``rows``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.filter(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


#: Columns of the counts: all documents; toxic and other labelled ones for the first fit; the same of the calibration fold.
_KINDS = ("n", "toxic", "other", "toxic_aside", "other_aside")


def token_counts(docs: DataFrame, known: DataFrame) -> np.ndarray:
    """Occurrences per bucket, one row per kind of document (``_KINDS``)."""
    size = 1 << BUCKET_BITS

    def run(batches):
        total = np.zeros((len(_KINDS), size), np.int32)
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, row, bucket in _groups(batch.column(0)):
                total[0] += np.bincount(bucket.ravel(), minlength=size)
                own = kind[first:last][row]
                for k in np.unique(own):
                    if k:
                        total[k] += np.bincount(bucket[own == k].ravel(), minlength=size)
        there = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(there), *[pa.array(t[there], pa.int64()) for t in total]], names=["bucket", *_KINDS])

    kind = F.when(F.col("toxic") == 1, 1).otherwise(2) + F.when(_aside(F.col("doc_id")), 2).otherwise(0)
    joined = docs.join(F.broadcast(known), "doc_id", "left").select("text", F.when(F.col("toxic").isNull(), 0).otherwise(kind).alias("kind"))
    counts = joined.mapInArrow(tidy(run), "bucket long, " + ", ".join(f"{k} long" for k in _KINDS))
    out = np.zeros((len(_KINDS), size))
    for part in counts.groupBy("bucket").agg(*[F.sum(k).alias(k) for k in _KINDS]).toArrow().to_batches():
        out[:, part.column(0).to_numpy()] = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]])
    return out


def _aside(doc_id):
    """The calibration fold among the documents outside the held-out one."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 4


@dataclass(frozen=True)
class Model:
    """Counts and prior weight per bucket, the share of toxic tokens, the extreme-value constants and the logistic curve."""

    toxic: np.ndarray
    seen: np.ndarray
    prior: np.ndarray
    share: float
    rate: float = 1.0
    scale: float = 1.0
    curve: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)

    def token_scores(self, bucket: np.ndarray) -> np.ndarray:
        """Log-odds of each token against the share of toxic tokens, from the shortest stem to the whole token, less the drift."""
        share = np.full(len(bucket), self.share)
        for k in (*range(1, bucket.shape[1]), 0):
            own = bucket[:, k]
            share = np.clip(share, LEAST_SHARE, 1 - LEAST_SHARE)
            prior = self.prior[own].astype(float)
            share = (self.toxic[own] + prior * share) / (self.seen[own] + prior)
        return np.log(share / (1 - share)) - math.log(self.share / (1 - self.share)) - DRIFT

    def passages(self, column):
        """Per text: number of tokens, the scores of its passages, and the score of its worst token (the drift's loss, if none)."""
        for first, last, row, bucket in _groups(column):
            score = self.token_scores(bucket)
            cuts, up = np.searchsorted(row, np.arange(last - first + 1)), np.flatnonzero(score > 0)
            total, inner = np.concatenate(([0.0], np.cumsum(score))), np.searchsorted(up, cuts)
            for i in range(last - first):
                own = up[inner[i] : inner[i + 1]]
                top = float(score[cuts[i] : cuts[i + 1]].max()) if cuts[i + 1] > cuts[i] else -2 * DRIFT
                yield int(cuts[i + 1] - cuts[i]), [s for _, _, s in segments(total, own)] if len(own) else [], max(top, -2 * DRIFT)

    def evidence(self, column) -> np.ndarray:
        """Per text: the evidence of its best passage, of all its significant passages together, and of its worst token."""
        return np.array([self.weigh(*found) for found in self.passages(column)]).reshape(-1, 3)

    def weigh(self, n, best, top) -> tuple[float, float, float]:
        gains = [self.rate * s - math.log(self.scale * max(n, 1)) for s in best]
        return max([0.0, *gains]), math.log1p(sum(g for g in gains if g > -math.log(SIGNIFICANT))), min(top, 0.0)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(evidence) @ np.array(self.curve), -50, 50)))

    @staticmethod
    def features(evidence: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(evidence)), np.log1p(evidence[:, 0]), evidence[:, 1:]])


def segments(total: np.ndarray, up: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring passages: (first token, end, score), in order.

    ``total`` are running sums with a leading 0, ``up`` the places of positive scores. Each positive token starts as a
    passage of its own and merges to the left while that makes a better one; only positive tokens cost time.
    """
    kept: list[tuple[int, int, float, float]] = []  # first, end, sum before it, sum at its end
    for i in up.tolist():
        start, end, low, high = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j -= 1
            if j < 0 or kept[j][3] >= high:
                kept.append((start, end, low, high))
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high in kept]


def learned(everything: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> Model:
    """Token statistics; without toxic or without other tokens there is nothing to tell apart and every token scores alike."""
    prior = PRIOR_LEAST + PRIOR_SPREAD * everything / max(everything.sum(), 1)
    if not (toxic.any() and other.any()):
        toxic = other = np.zeros(len(everything))
        share = 0.5
    else:
        share = float(toxic.sum() / (toxic.sum() + other.sum()))
    # single precision is enough in transit; shares are reckoned in double
    return Model(*(a.astype(np.float32) for a in (toxic, toxic + other, prior)), share)


def chance(scores: np.ndarray, tokens: float) -> tuple[float, float]:
    """Rate and scale of chance passages: above a score S there are scale * exp(-rate S) of them per token."""
    if not len(scores):
        return 1.0, 1 / max(tokens, 1.0)
    from_ = float(np.quantile(scores, TAIL))
    above = scores[scores >= from_]
    rate = min(1 / max(float((above - from_).mean()), 1e-2), 10.0)
    return rate, len(above) / tokens * math.exp(rate * from_)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from the labels outside the held-out fold; the prior comes from all documents.

    Log-odds learned on four fifths of them judge the calibration fold, which gives the chance statistics and the curve; the final
    log-odds use all of them. ``docs(doc_id, text)``. Without toxic or without other labelled documents every text gets a low score.
    """
    known = labelled(docs, labels)
    everything, toxic, other, toxic_aside, other_aside = token_counts(docs, known)
    probe, final = learned(everything, toxic, other), learned(everything, toxic + toxic_aside, other + other_aside)

    def passages(batches):
        for batch in batches:
            found = list(probe.passages(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.float64())],
                names=["toxic", "n", "scores", "top"],
            )

    # of at most LABELLED_ROWS documents, whose passages are few, come some numbers each
    aside = docs.join(F.broadcast(known.filter(_aside(F.col("doc_id")))), "doc_id").select("text", "toxic")
    rows = aside.mapInArrow(tidy(passages), "toxic int, n long, scores array<double>, top double").toPandas()
    y = rows["toxic"].to_numpy(float)
    if not (y.any() and (y == 0).any()):
        return final
    calm = rows[y == 0]
    final = replace(final, **dict(zip(("rate", "scale"), chance(np.concatenate([np.zeros(0), *calm["scores"]]), float(calm["n"].sum())))))
    evidence = np.array([final.weigh(n, list(s), top) for n, s, top in zip(rows["n"], rows["scores"], rows["top"])])
    return replace(final, curve=_logistic(final.features(evidence), y))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row of ``docs(doc_id, text)``: 0 to 1, higher is likelier toxic.

    Null and empty texts have no passages and get the lowest score; repeated rows get the same score each.
    """

    def run(batches):
        for batch in batches:
            score = model.probability(model.evidence(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under ``below``."""
    columns, where = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            score = model.probability(model.evidence(batch.column(where)))
            yield pa.RecordBatch.from_arrays(batch.columns, names=columns).filter(pa.array(score < below))

    return docs.mapInArrow(tidy(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, scored by a model of the labels outside the held-out fold."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score_documents(texts, fit(texts, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
