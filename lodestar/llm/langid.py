"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language come from a bounded sample of labelled rows; the
log-probability matrix, languages by buckets, is broadcast, and numpy sums the
log probabilities of each whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bounded_sample, bucket_of, table

BITS = 16
ORDERS = (1, 2, 3)
TRAIN_ROWS = 20_000
SMOOTHING = 0.1
BATCH = 256
UNKNOWN = "und"


def counts(labelled: DataFrame, bits: int = BITS) -> DataFrame:
    """lang, counts: little-endian 64-bit counts of all n-grams of the texts of each language, a row per language."""

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        from lodestar.llm.ngrams import code_points, hashed

        total: dict = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points, _, _ = code_points([text.lower()])
                own = total.setdefault(lang, np.zeros(2**bits, "i8"))
                for order in ORDERS:
                    own += np.bincount(hashed(points, order, bits), minlength=2**bits)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "counts": [v.tobytes() for v in total.values()]})

    def add(rows):
        import numpy as np
        import pyarrow as pa

        total = sum((np.frombuffer(r.as_py(), "i8") for r in rows.column("counts")), np.zeros(2**bits, "i8"))
        return pa.table({"lang": rows.column("lang")[:1], "counts": [total.tobytes()]})

    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    return rows.mapInArrow(partial, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary")


def fit(labelled: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING):
    """Languages in order, and the matrix of log probabilities as float32, buckets by languages: its size depends on them only."""
    import numpy as np

    rows = sorted(counts(labelled, bits).collect(), key=lambda r: r["lang"])
    langs = [r["lang"] for r in rows]
    if not langs:
        return [], np.zeros((2**bits, 0), "f4")
    matrix = np.stack([np.frombuffer(r["counts"], "i8") for r in rows], 1).astype("f8") + smoothing
    return langs, np.log(matrix / matrix.sum(0)).astype("f4")


def identify(docs: DataFrame, langs: list[str], matrix) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.

    score is the posterior probability of lang_pred under equal priors. A text
    that is NULL, empty or without a letter gets `und` and 0, as does every text
    if no language was learned; equal posteriors go to the first language in
    alphabetical order. Rows are independent; repeated rows and NULL ids pass;
    other columns are ignored. Texts are scored whole.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((langs, matrix))
    bits = len(matrix).bit_length() - 1

    def score(batches):
        import re

        import numpy as np
        import pyarrow as pa

        from lodestar.llm.ngrams import code_points, hashed

        names, weights = model.value
        columns = [np.ascontiguousarray(weights[:, i]) for i in range(len(names))]
        letter = re.compile(r"[^\W\d_]")
        for batch in batches:
            best, sure = [], []
            texts = batch.column(1)
            for at in range(0, len(texts), BATCH):
                some = [t.as_py() or "" for t in texts[at : at + BATCH]]
                has = [bool(letter.search(t)) and any(map(str.isalpha, t)) if not t.isascii() else bool(letter.search(t)) for t in some]
                sums = np.zeros((len(some), len(names)))
                points, starts, _ = code_points([t.lower() for t in some])
                for order in ORDERS:
                    buckets = hashed(points, order, bits)
                    for i, column in enumerate(columns):
                        sums[:, i] += np.add.reduceat(column[buckets], starts, dtype="f8")
                if not names:
                    best += [UNKNOWN] * len(some)
                    sure += [0.0] * len(some)
                    continue
                sums -= sums.max(1, keepdims=True)
                post = np.exp(sums)
                post /= post.sum(1, keepdims=True)
                top = post.argmax(1)
                best += [names[k] if h else UNKNOWN for k, h in zip(top, has, strict=True)]
                sure += [float(p[k]) if h else 0.0 for p, k, h in zip(post, top, has, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": best, "score": sure}, schema=pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def op5_langid(spark, sf_dir: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """All documents; learns from a bounded sample of those whose fold is not held out. A NULL doc_id is neither held out nor learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = docs.where((bucket_of(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs, matrix = fit(bounded_sample(learn, train_rows, seed=5))
    held = F.coalesce(bucket_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return identify(docs, langs, matrix).select("doc_id", held, "lang_pred", "score")
