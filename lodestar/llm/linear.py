"""What the linear classifiers share: the sample of labelled rows, dual coordinate descent for the hinge loss, and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bounded_sample, bucket_of, discard, stash


def dual_coordinate_descent(rows, signs, size: int, cost, epochs: int, seed: int):
    """Linear hinge loss, L2 norm: weights after `epochs` passes over the dual variables in random order."""
    import numpy as np

    weights, alpha = np.zeros(size), np.zeros(len(rows))
    norms = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            if norms[i] == 0:
                continue
            gradient = signs[i] * float(weights[idx] @ val) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                weights[idx] += (new - alpha[i]) * signs[i] * val
                alpha[i] = new
    return weights


def logistic(margins, labels, share=None):
    """Slope and offset of a one-dimensional logistic fit, with labels smoothed as in Platt's method. share: how many rows each one stands for."""
    import numpy as np

    share = np.ones(len(labels)) if share is None else share
    pos, neg = float((share * labels).sum()), float((share * (1 - labels)).sum())
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    slope, offset = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        g = np.array([(share * (p - target) * margins).sum(), (share * (p - target)).sum()])
        w = share * p * (1 - p)
        h = np.array([[(w * margins**2).sum(), (w * margins).sum()], [(w * margins).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(offset)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train_rows: int, seed: int = 10) -> DataFrame:
    """doc_id, text and label of at most train_rows rows outside the held-out fold, as many of either class where there are enough.

    Rows without a label, a doc_id or a fold are not learned from. A doc_id that
    has several labels counts with each distinct one, and one on several rows of
    docs with each distinct text; the bound holds for what they give together.
    Labels are sampled first, so that only documents of sampled ids are written.
    """
    known = labels.where(F.col(label).isin(0, 1) & (bucket_of(F.col("doc_id"), 5) != 0)).select(F.col("doc_id").alias("l_id"), label).distinct()
    chosen = None
    for value in (0, 1):
        part = bounded_sample(known.where(F.col(label) == value), train_rows // 2, seed=seed + value)
        chosen = part if chosen is None else chosen.unionByName(part)
    # its size is bounded by the sample's, so that the documents needn't move
    texts = docs.select("doc_id", "text")
    joined = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["l_id"]).drop("l_id")
    joined = stash(joined.select("*", F.xxhash64("doc_id", "text", label, F.lit(seed)).alias("__hash")), f"labelled-{label}")
    out = None
    for value in (0, 1):
        mine = joined.where(F.col(label) == value)
        cut = mine.select("__hash").distinct().orderBy("__hash").limit(train_rows // 2).agg(F.max("__hash")).head()[0]
        part = mine.where(F.col("__hash") <= F.lit(cut)).dropDuplicates(["__hash"]).drop("__hash")
        out = part if out is None else out.unionByName(part)
    small = stash(out, f"sampled-{label}")
    discard(joined)
    return small
