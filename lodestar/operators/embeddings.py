"""A cache of embeddings: rows are only appended, the last of a chunk counts, and a hit must be of the same text, model and length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.names import embedding_text


def latest(cache: DataFrame) -> DataFrame:
    """The last row (greatest seq) of each chunk of a cache (chunk_id, seq, text_sha256, model, dimension, vector); rows without a chunk_id aren't read."""
    rest = [c for c in cache.columns if c not in ("chunk_id",)]
    return cache.where("chunk_id is not null and chunk_id <> ''").groupBy("chunk_id").agg(F.max_by(F.struct(*rest), "seq").alias("row")).select("chunk_id", "row.*")


def digests(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, text) with the text that is embedded and its digest."""
    text = embedding_text(F.col("text"))
    return chunks.select("chunk_id", text.alias("embedded"), F.sha2(text.cast("binary"), 256).alias("digest"))


def lookup(chunks: DataFrame, cache: DataFrame, model: str, dimension: int) -> DataFrame:
    """chunk_id, embedded, digest, vector: NULL where the cache has none of this text, model and dimension."""
    own = latest(cache).select(F.col("chunk_id").alias("c_id"), "text_sha256", "model", F.col("dimension").alias("c_dimension"), F.col("vector").alias("c_vector"))
    joined = digests(chunks).join(own, F.col("chunk_id") == F.col("c_id"), "left")
    hit = (F.col("text_sha256") == F.col("digest")) & (F.col("model") == model) & (F.col("c_dimension") == dimension) & (F.size("c_vector") == dimension)
    return joined.select("chunk_id", "embedded", "digest", F.when(hit, F.col("c_vector").cast("array<double>")).alias("vector"))


def embed(pending: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dimension: int, batch: int = 256) -> DataFrame:
    """pending (chunk_id, embedded, digest) with vectors of an embedder that takes lists of texts; a vector of another length fails the task."""

    def run(batches):
        import pyarrow as pa

        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = embedder(part.column(1).to_pylist())
                if len(vectors) != part.num_rows or any(len(v) != dimension for v in vectors):
                    raise ValueError("embedding_dimension_mismatch")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(vectors, pa.list_(pa.float64()))], names=["chunk_id", "digest", "vector"])

    return pending.select("chunk_id", "embedded", "digest").mapInArrow(run, "chunk_id string, digest string, vector array<double>")


def ingest(chunks: DataFrame, cache: DataFrame, embedder, model: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """The vectors of all chunks (chunk_id, vector), and the rows to append to the cache for those that it lacked."""
    found = lookup(chunks, cache, model, dimension)
    made = embed(found.where("vector is null"), embedder, dimension)
    seq = cache.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    fresh = made.join(F.broadcast(seq)).select("chunk_id", (F.col("last") + 1).alias("seq"), F.col("digest").alias("text_sha256"), F.lit(model).alias("model"), F.lit(dimension).alias("dimension"), "vector")
    return found.where("vector is not null").select("chunk_id", "vector").unionByName(made.select("chunk_id", "vector")), fresh


def parsed_response(body: DataFrame, expected: int) -> DataFrame:
    """Vectors of an embedding service's answer (json): index and vector in order; another number of them than expected gives an error."""
    item = "array<struct<index:int,embedding:array<double>>>"
    rows = body.select(F.from_json("json", f"struct<data:{item}>")["data"].alias("data"))
    counted = rows.withColumn("error", F.when(F.col("data").isNull(), "embedding_invalid_json").when(F.size("data") != expected, "embedding_count_mismatch"))
    return counted.select("error", F.when(F.col("error").isNull(), F.transform(F.array_sort("data"), lambda d: d["embedding"])).alias("vectors"))
