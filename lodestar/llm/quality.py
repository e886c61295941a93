"""Quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams, of characters and of repeated words, are scaled
by the log-count ratios of the two classes; a linear model with hinge loss is
then fitted by dual coordinate descent, and its margin is mapped to a
probability by a logistic fit on a part of the sample that the model didn't see.
The fit reads a bounded sample of labelled rows in one task; the weights that
are broadcast have a fixed size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm import linear
from lodestar.llm.common import bucket_of, columns_of, free_name, sparing, table
from lodestar.llm.linear import dual_coordinate_descent, logistic

BITS = 16
ORDERS = (2, 3)
TRAIN_ROWS = 8_000
EPOCHS = 12
COST = 1.0
THRESHOLD = 0.3
#: Repeated word pairs: an indicator each for at least so many in a text.
REPEATS = (1, 4, 16)


def indicators(text: str):
    """Sorted bucket numbers of the n-grams that a text has; the buckets from 2**BITS on are those of word pairs that repeat a word."""
    import numpy as np

    from lodestar.llm.ngrams import code_points, hashed

    points, _, _ = code_points([text], edge=1)
    seen = np.zeros(2**BITS + len(REPEATS) + 1, bool)
    for order in ORDERS:
        seen[hashed(points, order, BITS)] = True
    words = text.split()
    twice = sum(map(str.__eq__, words, words[1:]))
    for i, least in enumerate(REPEATS):
        seen[2**BITS + i] = twice >= least
    seen[-1] = not words
    return np.flatnonzero(seen).astype("i4")


def train(found: list, labels: list[int], seed: int = 10):
    """Weights by bucket (float64), bias, slope and offset, from indicators of texts. The ratios and weights are of one part of the rows, slope and offset of the other."""
    import numpy as np

    y = np.array(labels)
    size = 2**BITS + len(REPEATS) + 1
    if len(set(labels)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(size), 0.0, 1.0, float(np.log(p / (1 - p)))
    rng = np.random.default_rng(seed)
    part = rng.random(len(y)) < 0.2
    if len(set(y[part])) < 2 or len(set(y[~part])) < 2:
        part = np.zeros(len(y), bool)
    fit_on = np.flatnonzero(~part)
    per_class = [np.ones(size), np.ones(size)]
    for i in fit_on:
        per_class[y[i]][found[i]] += 1
    ratio = np.log((per_class[1] / per_class[1].sum()) / (per_class[0] / per_class[0].sum()))
    rows = []
    for idx in found:
        val = ratio[idx]
        rows.append((np.append(idx, size), np.append(val, 1.0) / max(1.0, np.sqrt(len(idx)))))
    signs = np.where(y > 0, 1.0, -1.0)
    n, pos = len(fit_on), y[fit_on].sum()
    weight = np.where(y > 0, n / (2 * pos), n / (2 * (n - pos)))
    weights = dual_coordinate_descent([rows[i] for i in fit_on], signs[fit_on], size + 1, COST * weight[fit_on], EPOCHS, seed)
    check = np.flatnonzero(part) if part.any() else fit_on
    margins = np.array([float(weights[rows[i][0]] @ rows[i][1]) for i in check])
    slope, offset = logistic(margins, y[check])
    return weights[:-1] * ratio, float(weights[-1]), slope, offset


def fit(labelled: DataFrame):
    """Train on all rows of labelled (text, quality) in one task: give it a bounded sample. Indicators are made where the texts are; no text moves."""

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            found = [indicators(t.as_py() or "").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2), batch.column(3)], names=["doc_id", "found", "quality", "all"])

    def run(rows):
        import numpy as np
        import pyarrow as pa

        order = sorted(range(rows.num_rows), key=lambda i, k=rows.select(["doc_id", "found", "quality"]).to_pylist(): (k[i]["doc_id"] is None, k[i]["doc_id"] or 0, k[i]["found"], k[i]["quality"]))
        rows = rows.take(pa.array(order, pa.int64()))
        weights, bias, slope, offset = train([np.frombuffer(f.as_py(), "i4") for f in rows.column("found")], rows.column("quality").to_pylist())
        return pa.table({"weights": [weights.tobytes()], "bias": [bias], "slope": [slope], "offset": [offset]})

    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("quality").cast("int").alias("quality"), F.lit(1).alias("all"))
    out = rows.mapInArrow(each, "doc_id long, found binary, quality int, `all` int").groupBy("all").applyInArrow(sparing(run), "weights binary, bias double, slope double, offset double").collect()
    import numpy as np

    if not out:
        return np.zeros(2**BITS + len(REPEATS) + 1), 0.0, 1.0, 0.0
    return np.frombuffer(out[0]["weights"], "f8"), out[0]["bias"], out[0]["slope"], out[0]["offset"]


def score(docs: DataFrame, model) -> DataFrame:
    """docs (any columns) with quality_score, 0 to 1; where docs has that name, the added column has underscores after it.

    NULL text is empty text and is scored; texts are read whole; rows are independent.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    name = free_name("quality_score", docs)
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weights, bias, slope, offset = shared.value
        for batch in batches:
            out = []
            for text in batch.column(at):
                idx = indicators(text.as_py() or "")
                margin = (float(weights[idx].sum()) + bias) / max(1.0, float(np.sqrt(len(idx))))
                out.append(1 / (1 + float(np.exp(-np.clip(slope * margin + offset, -30, 30)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField(name, T.DoubleType())]))


def accepted(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, whose score reaches the threshold."""
    return score(docs, model).where(F.col(free_name("quality_score", docs)) >= threshold).select(columns_of(docs))


def labelled_sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, quality of at most train_rows rows outside the held-out fold; see linear.labelled_sample."""
    return linear.labelled_sample(docs, labels, "quality", train_rows)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """All documents; labels are learned only from rows outside the held-out fold. A NULL doc_id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
