"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

An n-gram counts where it occurs, and once more for each share of the text's
words that its occurrences reach, so that a text which repeats a stem is told
from a long one that holds it by chance. Features are hashed to a fixed number of
buckets, scaled by the log-count ratio of the two classes and fitted by a linear
model with hinge loss on a bounded sample of labelled texts; margins become
probabilities by a logistic fit on texts that the model didn't see.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm import linear
from lodestar.llm.common import bucket_of, free_name, sparing, table

BITS, SHARE_BITS = 20, 17
ORDERS = (4, 6, 8)
#: A repeated n-gram has a further feature for each part of the words, in 256ths, that its occurrences reach.
SHARES = (2, 4, 8)
SIZE = 2**BITS + len(SHARES) * 2**SHARE_BITS
TRAIN_ROWS = 3_000
EPOCHS = 8
THRESHOLD = 0.5
#: Texts are hashed together up to about so many characters.
TOGETHER = 300_000


def _mixed(x):
    """A bijection of 32-bit numbers that spreads every bit."""
    import numpy as np

    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _joined(left, right):
    import numpy as np

    return _mixed(left * np.uint32(0x9E3779B1) + right)


def _windows(points) -> dict:
    """Buckets of the windows of each order that start at each place, as far as they fit."""
    import numpy as np

    two = _joined(points[:-1] + 1, points[1:])
    four = _joined(two[:-2], two[2:])
    mask = np.uint32(2**BITS - 1)
    return {4: four & mask, 6: _joined(four[:-2], two[4:]) & mask, 8: _joined(four[:-4], four[4:]) & mask}


def features(texts: list[str]):
    """The distinct buckets of each text, sorted: lower-cased, runs of white space as one space, a space at either end."""
    import numpy as np

    at = 0
    while at < len(texts):
        parts, size = [], 0
        while at < len(texts) and (size < TOGETHER or not parts):
            words = texts[at].lower().split()
            parts.append((f" {' '.join(words)} ", len(words)))
            size += len(parts[-1][0])
            at += 1
        # zeros behind the last text, so that short ones have the windows they have among others
        points = np.frombuffer(("".join(p for p, _ in parts) + "\0" * max(ORDERS)).encode("utf-32-le", "surrogatepass"), "<u4")
        hashes = _windows(points)
        start = 0
        for part, words in parts:
            stop = start + len(part)
            # a text too short for an order has no windows of it; hashes end earlier than points
            mine = [hashes[n][start : stop - n + 1] for n in ORDERS if stop - start >= n]
            yield _levels(np.concatenate(mine), words) if mine else np.empty(0, "i4")
            start = stop


def _levels(hashes, words: int):
    """The sorted distinct buckets of hashes, then those of the shares that repeated ones reach, each share in a range of its own."""
    import numpy as np

    if len(hashes) > 2 ** (BITS - 3):
        counts = np.bincount(hashes, minlength=1)
        distinct = np.flatnonzero(counts)
        counts = counts[distinct]
    else:
        hashes.sort()
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        distinct, counts = hashes[first], np.diff(first, append=len(hashes))
    repeated = counts > 1
    often, times = distinct[repeated].astype("u4"), counts[repeated] * 256
    out = [distinct.astype("i4")]
    for k, share in enumerate(SHARES):
        reached = often[times >= share * words]
        out.append(np.unique(_mixed(reached) & np.uint32(2**SHARE_BITS - 1)).astype("i4") + np.int32(2**BITS + k * 2**SHARE_BITS))
    return np.concatenate(out)


def train(found: list, labels: list[int], totals: tuple[int, int] | None = None, seed: int = 12):
    """Weights by bucket (float32, scaled by the ratios), bias, slope and offset.

    Ratios and weights are of one part of the rows, slope and offset of the
    other. Buckets that one text alone has are left out. totals: how many rows
    of either class there are beyond the sample, for the calibration.
    """
    import numpy as np

    y, size = np.array(labels, "i8"), SIZE
    if len(set(labels)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(size, "f4"), 0.0, 1.0, float(np.log(p / (1 - p)))
    part = np.random.default_rng(seed).random(len(y)) < 0.2
    if len(set(y[part])) < 2 or len(set(y[~part])) < 2:
        part = np.zeros(len(y), bool)
    fit_on = np.flatnonzero(~part)
    per_class = np.ones((2, size))
    for i in fit_on:
        per_class[y[i], found[i]] += 1
    ratio = np.log((per_class[1] / per_class[1].sum()) / (per_class[0] / per_class[0].sum()))
    ratio[per_class.sum(0) < 4] = 0.0
    ratio = ratio.astype("f4")

    def row(idx):
        kept = idx[ratio[idx] != 0]
        return np.append(kept, size).astype("i4"), np.append(ratio[kept], np.float32(1)) / np.float32(max(1.0, np.sqrt(len(idx))))

    signs = np.where(y > 0, 1.0, -1.0)
    n, pos = len(fit_on), int(y[fit_on].sum())
    cost = np.where(y > 0, n / (2 * pos), n / (2 * (n - pos)))
    weights = linear.dual_coordinate_descent([row(found[i]) for i in fit_on], signs[fit_on], size + 1, cost[fit_on], EPOCHS, seed)
    check = np.flatnonzero(part) if part.any() else fit_on
    margins = np.array([float(weights[i] @ v) for i, v in (row(found[k]) for k in check)])
    have = (max(1, int((1 - y).sum())), max(1, int(y.sum())))
    stands_for = [t / h for t, h in zip(totals or have, have, strict=True)]
    slope, offset = linear.logistic(margins, y[check], np.array(stands_for)[y[check]])
    return (weights[:-1] * ratio).astype("f4"), float(weights[-1]), slope, offset


def labelled_sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most train_rows rows outside the held-out fold; see linear.labelled_sample."""
    return linear.labelled_sample(docs, labels, "toxic", train_rows, seed=12)


def class_totals(labels: DataFrame) -> tuple[int, int]:
    """How many documents outside the held-out fold are labelled 0 and 1."""
    known = labels.where(F.col("toxic").isin(0, 1) & (bucket_of(F.col("doc_id"), 5) != 0)).select("doc_id", "toxic").distinct()
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    return counts.get(0, 0), counts.get(1, 0)


def fit(labelled: DataFrame, totals: tuple[int, int] | None = None):
    """Train on all rows of labelled (doc_id, text, toxic) in one task: give it a bounded sample. Features are made where the texts are; no text moves. No rows give a model that scores 0.5."""

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            found = [f.tobytes() for f in features([t.as_py() or "" for t in batch.column(1)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2), batch.column(3)], names=["doc_id", "found", "toxic", "all"])

    def run(rows):
        import numpy as np
        import pyarrow as pa

        ids, toxic = rows.column("doc_id").to_pylist(), rows.column("toxic").to_pylist()
        # views of the column's own memory
        found = [np.frombuffer(f.as_buffer(), "i4") for f in rows.column("found")]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, toxic[i], len(found[i]), zlib.crc32(found[i])))
        weights, bias, slope, offset = train([found[i] for i in order], [toxic[i] for i in order], totals)
        return pa.table({"weights": [weights.tobytes()], "bias": [bias], "slope": [slope], "offset": [offset]})

    import numpy as np

    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"), F.lit(1).alias("all"))
    out = rows.mapInArrow(each, "doc_id long, found binary, toxic int, `all` int").groupBy("all").applyInArrow(sparing(run), "weights binary, bias double, slope double, offset double").collect()
    if not out:
        return np.zeros(SIZE, "f4"), 0.0, 1.0, 0.0
    return np.frombuffer(out[0]["weights"], "f4"), out[0]["bias"], out[0]["slope"], out[0]["offset"]


def score(docs: DataFrame, model) -> DataFrame:
    """docs (any columns) with toxicity, 0 to 1; where docs has that name, the added column has underscores after it.

    NULL text is empty text and is scored; texts are read whole; rows are
    independent, so repeated rows score alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name, schema = free_name("toxicity", docs), docs.schema
    at = schema.names.index("text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weights, bias, slope, offset = shared.value
        for batch in batches:
            out = []
            for idx in features([t.as_py() or "" for t in batch.column(at)]):
                margin = (float(weights[idx].sum(dtype="f8")) + bias) / max(1.0, float(np.sqrt(len(idx))))
                out.append(1 / (1 + float(np.exp(-np.clip(slope * margin + offset, -30, 30)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField(name, T.DoubleType())]))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents; labels are learned only from rows outside the held-out fold. A NULL doc_id is not held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(labelled_sample(docs, labels), class_totals(labels))
    held = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
