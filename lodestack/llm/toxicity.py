"""Operator 7, toxicity: non-negative positive-unlabelled learning.

The classifier is linear over hashed words and five-byte word beginnings, present
or not.  It is trained in numpy on two samples: documents confirmed as toxic
(positives) and documents taken without looking at their label (unlabelled).
The risk is the class-prior-corrected estimate

    prior * E_P[l(f, +)] + max(0, E_U[l(f, -)] - prior * E_P[l(f, -)])

with the logistic loss, so that the sigmoid of the output is a probability under
that prior.  ``POSITIVES`` and ``UNLABELLED`` bound the samples (they are the
documented bound of the training rows); class prior and scores cover all rows,
whole texts.  The samples' features are counted by bucket on the executors first; only
those of which the positives have clearly more go to the driver.

Defined results: null and empty texts get the score of the bias alone; a text
of any length is scored by the set of its words; repeated rows get equal scores
in a row each; labels that disagree on a document count as toxic; with no
positive at all every score is the class prior, zero; empty tables give an empty
table; columns other than the id and the text are not read; a null id counts
as the id "" for the split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .bytescan import ALPHANUMERIC, mix, text_blocks, word_bounds, word_hashes
from .sampling import sampled
from .scratch import Scratch

BUCKETS = 1 << 18
PREFIX = 5
POSITIVES, UNLABELLED = 8_000, 24_000
#: A feature is used if its count among positives lies so many standard deviations over that expected from the unlabelled.
EVIDENCE = 5.0
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """``weights`` by bucket (0: not used), ``bias``; ``prior`` as estimated."""

    weights: np.ndarray
    bias: float
    prior: float


def held_out(id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return (F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 3) == 1


def _features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word and of each longer word's beginning, in no order, with repeats."""
    starts, ends, first = word_bounds(raw, offsets, ALPHANUMERIC)
    words = word_hashes(raw, starts, ends) % np.uint64(BUCKETS)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    long = np.flatnonzero(ends - starts > PREFIX)
    begun = mix(word_hashes(raw, starts[long], starts[long] + PREFIX)) % np.uint64(BUCKETS)
    return np.concatenate([owner, owner[long]]), np.concatenate([words, begun]).astype(np.int64)


def _buckets(rows: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """role, buckets (distinct; of those wanted) of rows of role and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, raw, offsets in text_blocks(batch.column(1)):
                owner, bucket = _features(raw, offsets)
                if wanted is not None:
                    kept = wanted[bucket]
                    owner, bucket = owner[kept], bucket[kept]
                pairs = np.unique(owner * BUCKETS + bucket)
                cuts = np.searchsorted(pairs, np.arange(end - start + 1) * BUCKETS)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((pairs % BUCKETS).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:end], lists], names=["role", "buckets"])

    ship(rows.sparkSession)
    return rows.mapInArrow(work, "role int, buckets array<int>")


def training_texts(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """role (1: confirmed toxic, 0: unlabelled) and text of the sampled documents, and the class prior."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    open_ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out())
    by = lambda seed: F.xxhash64("doc_id", F.lit(seed))
    picked = (
        sampled(known.where("toxic = 1").select("doc_id"), by(1), positives).withColumn("role", F.lit(1))
        .unionByName(sampled(open_ids, by(2), unlabelled).distinct().withColumn("role", F.lit(0)))
    )
    # Broadcast: at most about positives + unlabelled ids.
    return docs.join(F.broadcast(picked), "doc_id").select("role", "text"), float(prior)


def evidence(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets are used, from the number of positives and of unlabelled with each; and their log ratios."""
    expected = n_p * (in_u + 1) / (n_u + 2)
    ratio = np.log((in_p + 0.5) / (n_p + 1)) - np.log((in_u + 0.5) / (n_u + 1))
    return (in_p - expected >= EVIDENCE * np.sqrt(expected)) & (in_p >= 3), ratio


def risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of the outputs ``z``, and the slope that descent follows.

    Where the negative part would fall under zero, its own slope is turned round.
    """
    weight_p, weight_u = positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    loss_minus = np.logaddexp(0, z)
    rest = (weight_u * loss_minus).sum() - prior * (weight_p * loss_minus).sum()
    minus = weight_u * p - prior * weight_p * p
    value = prior * (weight_p * np.logaddexp(0, -z)).sum() + max(0.0, rest)
    return float(value), prior * weight_p * (p - 1) + minus if rest >= 0 else -minus


def fit(rows: list[np.ndarray], positive: np.ndarray, prior: float, used: np.ndarray, ratio: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the non-negative risk; ``rows`` hold the used buckets of each document."""
    weights = np.zeros(BUCKETS, dtype=np.float32)
    if not positive.any() or positive.all() or prior <= 0:
        return Model(weights, -30.0, prior)
    prior = min(prior, 0.99)
    column = np.full(BUCKETS, -1)
    column[used] = np.arange(used.sum())
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    col = column[np.concatenate(rows)]
    value = ratio[used][col]  # naive-Bayes scaling: rarer evidence needs smaller steps
    w = np.zeros(int(used.sum()) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=value * w[col], minlength=len(rows)) + w[-1]
        _, slope = risk(z, positive, prior)
        g = np.append(np.bincount(col, weights=value * slope[row], minlength=len(w) - 1), slope.sum())
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights[used] = w[:-1] * ratio[used]
    return Model(weights, float(w[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, prior = training_texts(docs, labels, positives, unlabelled)
    with Scratch(docs.sparkSession) as scratch:
        # In a stable order: sums of floats depend on it.
        texts = scratch.save(texts, "texts")
        sizes = {r["role"]: r["n"] for r in texts.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts = _buckets(texts).select("role", F.explode("buckets").alias("b")).groupBy("role", "b").agg(F.count(F.lit(1)).alias("n")).toArrow()
        role, bucket, n = (counts[c].to_numpy() for c in ("role", "b", "n"))
        have = [np.bincount(bucket[role == r], weights=n[role == r], minlength=BUCKETS) for r in (1, 0)]
        used, ratio = evidence(*have, sizes.get(1, 0), sizes.get(0, 0))
        table = _buckets(texts, used).orderBy("role", "buckets").toArrow()
    lists = [x for chunk in table["buckets"].chunks for x in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1]) if len(chunk)]
    return fit(lists or [np.zeros(0, np.int32)], table["role"].to_numpy() == 1, prior, used, ratio)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; the model (one megabyte) goes with the tasks."""
    weights, bias = model.weights, model.bias

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, raw, offsets in text_blocks(batch.column(2)):
                owner, bucket = _features(raw, offsets)
                used = np.flatnonzero(weights[bucket])
                pairs = np.unique(owner[used] * BUCKETS + bucket[used])
                z = bias + np.bincount(pairs // BUCKETS, weights=weights[pairs % BUCKETS], minlength=end - start)
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:end], batch.column(1)[start:end], pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    ship(narrow.sparkSession)
    return narrow.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")
