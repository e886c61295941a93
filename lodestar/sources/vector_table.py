"""A table of vectors that is searched exactly without reading all of it.

Vectors lie in lists, each around a centroid; the centroids are fitted on a
bounded sample, every vector is in a list. A manifest names the files of each
list with its size and radius. A search visits a query's nearest lists first;
what they give bounds which others can hold anything better, by the triangle
inequality, and only those are read. An upsert writes the lists that it touches
anew and then a manifest, last and at once, so a reader sees the table before or
after it, and a job that is lost leaves it as it was.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import retrieval
from lodestar.sources.files import stash

SAMPLE_ROWS = 20_000
ROUNDS = 8
VECTORS_PER_LIST = 2_000
#: At most so many lists, whatever the table: the manifest and the centroids go to every task.
MOST_LISTS = 1_024
#: More than the rounding of a score to 6 digits.
SLACK = 2e-6
ROW = "vec_id long, embedding array<double>, list int"


class DimensionMismatch(ValueError):
    """Vectors of another length than the table's."""


@dataclass(frozen=True)
class Manifest:
    """dimension, centroids (unit vectors) and the lists: number, files, n, radius."""

    version: int
    dimension: int
    centroids: list
    lists: list
    pending: list

    @property
    def ready(self) -> bool:
        """Whether nothing is left to build."""
        return not self.pending


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The table's latest manifest; None where there is no table yet."""
    folder, fs = _path(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return None
    versions = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(folder) if f.getPath().getName().startswith("v=") and fs.exists(f.getPath().suffix("/_SUCCESS"))]
    return Manifest(**json.loads(spark.read.text(f"{path}/manifest/v={max(versions)}").head()[0])) if versions else None


def _commit(spark: SparkSession, path: str, made: Manifest) -> Manifest:
    """The manifest is one small file that Spark's writer moves into place when it is whole."""
    spark.createDataFrame([(json.dumps(made.__dict__),)], "value string").coalesce(1).write.text(f"{path}/manifest/v={made.version}")
    return made


def _fit(sample, lists: int, seed: int = 7):
    """Unit centroids by k-means on the sphere."""
    import numpy as np

    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        near = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def _placed(vectors: DataFrame, centroids: list) -> DataFrame:
    """vectors (vec_id, embedding) with their list and distance from its centroid, both on the unit sphere; a vector of norm 0 is in list -1."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        middle = np.array(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            norms = np.linalg.norm(own, axis=1, keepdims=True)
            cosine = own / np.where(norms > 0, norms, 1) @ middle.T
            at = cosine.argmax(1)
            away = np.sqrt(np.maximum(0, 2 - 2 * cosine[np.arange(len(at)), at]))
            at = np.where(norms[:, 0] > 0, at, -1).astype("i4")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(away)], names=["vec_id", "embedding", "list", "away"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"{ROW}, away double")


def _checked(vectors: DataFrame, dimension: int | None) -> tuple[DataFrame, int]:
    """Rows with an id and finite components, as doubles; another length than the table's, or than each other's, raises."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and embedding is not null").where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = rows.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).head()
    dimension = sizes["a"] if dimension is None else dimension
    if sizes["a"] is not None and (sizes["a"] != dimension or sizes["b"] != dimension):
        raise DimensionMismatch(f"vectors of {sizes['a']} to {sizes['b']} components, the table has {dimension}")
    return rows, dimension or 0


def _written(rows: DataFrame, path: str) -> list[dict]:
    """Placed rows written by list; their lists' entries."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.partitionBy("list").parquet(f"{path}/{folder}")
    kept = rows.sparkSession.read.schema(f"{ROW}, away double").parquet(f"{path}/{folder}")
    found = kept.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()
    return [{"list": r["list"], "files": f"{folder}/list={r['list']}", "n": r["n"], "radius": r["radius"]} for r in sorted(found)]


def build(vectors: DataFrame, path: str) -> Manifest:
    """A new table of vectors (vec_id, embedding) under a fresh path; of rows with one id that with the greatest embedding stays. Rows without an id, a vector, or with components that aren't finite are left out."""
    spark = vectors.sparkSession
    rows, dimension = _checked(vectors, None)
    rows = stash(rows.groupBy("vec_id").agg(F.max("embedding").alias("embedding")), "vectors")
    import numpy as np

    some = np.array([r["embedding"] for r in rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).collect()], "f8").reshape(-1, max(1, dimension))
    norms = np.linalg.norm(some, axis=1, keepdims=True)
    some = (some / np.where(norms > 0, norms, 1))[norms[:, 0] > 0]
    lists = max(1, min(MOST_LISTS, len(some), -(-rows.count() // VECTORS_PER_LIST)))
    centroids = _fit(some, lists).tolist() if len(some) else [[0.0] * dimension]
    return _commit(spark, path, Manifest(0, dimension, centroids, _written(_placed(rows, centroids), path), []))


def read(spark: SparkSession, path: str, lists: list[int] | None = None) -> DataFrame:
    """vec_id, embedding, list of the table, or of some lists; other lists' files aren't touched."""
    own = manifest(spark, path)
    by_folder: dict = {}  # a scan for each write that lists stand in
    for entry in own.lists:
        if lists is None or entry["list"] in lists:
            by_folder.setdefault(entry["files"].rsplit("/", 1)[0], []).append(f"{path}/{entry['files']}")
    scans = [spark.read.schema(f"{ROW}, away double").option("basePath", f"{path}/{folder}").parquet(*own_files).select("vec_id", "embedding", "list") for folder, own_files in by_folder.items()]
    out = spark.createDataFrame([], ROW)
    for scan in scans:
        out = out.unionByName(scan)
    return out


def upsert(vectors: DataFrame, path: str) -> Manifest:
    """Vectors (vec_id, embedding) put in the place of those with their ids. Only lists that lose or gain a vector are written anew; a vector of another length raises, and then nothing changes."""
    spark = vectors.sparkSession
    own = manifest(spark, path)
    fresh, _ = _checked(vectors, own.dimension)
    fresh = stash(_placed(fresh.groupBy("vec_id").agg(F.max("embedding").alias("embedding")), own.centroids), "vectors-fresh")
    gains = [r["list"] for r in fresh.select("list").distinct().collect()]
    losing = [r["list"] for r in read(spark, path).join(fresh.select("vec_id"), "vec_id", "left_semi").select("list").distinct().collect()]
    touched = sorted({*gains, *losing})
    if not touched:
        return own
    kept = read(spark, path, touched).join(fresh.select("vec_id"), "vec_id", "left_anti")
    entries = _written(_placed(kept.select("vec_id", "embedding"), own.centroids).unionByName(fresh), path)
    lists = sorted([e for e in own.lists if e["list"] not in touched] + entries, key=lambda e: e["list"])
    return _commit(spark, path, Manifest(own.version + 1, own.dimension, own.centroids, lists, []))


def _reach(asks: DataFrame, own: Manifest) -> DataFrame:
    """asks with, for each list, the greatest cosine that a vector in it can have: query_id, asked, list, bound."""
    shared = asks.sparkSession.sparkContext.broadcast((own.centroids, [(e["list"], e["radius"]) for e in own.lists if e["list"] >= 0]))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        centroids, lists = np.array(shared.value[0]), shared.value[1]
        names, radii = np.array([x[0] for x in lists], "i4"), np.array([x[1] for x in lists], "f8")
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            q = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            norms = np.linalg.norm(q, axis=1, keepdims=True)
            away = np.sqrt(np.maximum(0, 2 - 2 * (q / np.where(norms > 0, norms, 1) @ centroids[names].T)))
            bound = 1 - np.maximum(0, away - radii[None]) ** 2 / 2
            order, n = np.argsort(-bound, axis=1, kind="stable"), len(names)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n)
            places = np.tile(np.arange(n, dtype="i4"), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names[order].ravel()), pa.array(np.take_along_axis(bound, order, 1).ravel()), pa.array(places)], names=["query_id", "list", "bound", "place"])

    return asks.select("query_id", "asked").mapInArrow(run, "query_id long, list int, bound double, place int")


def search(queries: DataFrame, path: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The k nearest vectors of each query (query_id, embedding), exact: query_id, vec_id, score, rank, error; and visits: query_id, lists, of.

    A query whose length isn't the table's has one row with the error
    dimension_mismatch; k below 1 gives no others. A query isn't its own answer.
    Two rounds suffice: the lists with the greatest bounds that hold twice k
    vectors give a k-th score, and every list that could beat it is in the second.
    """
    spark = queries.sparkSession
    own = manifest(spark, path)
    asks = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("asked"))
    text, none = F.lit(None).cast("string"), F.lit(None)
    wrong = asks.where(F.size("asked") != own.dimension).select("query_id", none.cast("long").alias("vec_id"), none.cast("double").alias("score"), none.cast("int").alias("rank"), F.lit("dimension_mismatch").alias("error"))
    good = asks.where(F.size("asked") == own.dimension)
    reach = stash(_reach(good, own), "vector-reach")
    if k < 1:
        return wrong, reach.where("false").groupBy("query_id").agg(F.count(F.lit(1)).alias("lists"), F.lit(len(own.lists)).alias("of"))
    sizes = F.broadcast(spark.createDataFrame([(e["list"], e["n"]) for e in own.lists], "list int, n long"))
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    first = stash(reach.join(sizes, "list").withColumn("before", before).where(F.col("before") < 2 * k).select("query_id", "list", "bound"), "vector-first")
    near = stash(_scored(first, good, own, path, k), "vector-near")
    last = retrieval.top_k(near, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    rest = reach.join(first.select("query_id", "list"), ["query_id", "list"], "left_anti").join(last, "query_id", "left")
    more = stash(rest.where((F.coalesce("n", F.lit(0)) < k) | (F.col("bound") >= F.col("kth") - SLACK)).select("query_id", "list", "bound"), "vector-more")
    found = near.unionByName(_scored(more, good, own, path, k))
    best = retrieval.top_k(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select("query_id", "vec_id", "score", F.col("rank").cast("int").alias("rank"), text.alias("error"))
    visits = first.unionByName(more).groupBy("query_id").agg(F.count(F.lit(1)).alias("lists"), F.lit(len(own.lists)).alias("of"))
    return best.unionByName(wrong), visits


def _scored(pairs: DataFrame, asks: DataFrame, own: Manifest, path: str, k: int) -> DataFrame:
    """The k best of each query in each list that it visits. Large lists, and many queries of one list, are dealt to several tasks."""
    spark = pairs.sparkSession
    lists = sorted(r["list"] for r in pairs.select("list").distinct().collect())
    if not lists:
        return spark.createDataFrame([], retrieval.BEST)
    tiles = {e["list"]: max(1, -(-e["n"] // retrieval.VECTORS_PER_TILE)) for e in own.lists}
    asked = {r["list"]: max(1, -(-r["count"] // retrieval.QUERIES_PER_TILE)) for r in pairs.groupBy("list").count().collect()}
    wide = lambda: F.broadcast(spark.createDataFrame([(n, tiles[n], asked[n]) for n in lists], "list int, tiles int, blocks int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = pairs.join(asks, "query_id").join(wide(), "list").withColumn("block", mine("query_id", "blocks")).withColumn("tile", every("tiles"))
    right = read(spark, path, lists).withColumnRenamed("embedding", "own").join(wide(), "list").withColumn("tile", mine("vec_id", "tiles")).withColumn("block", every("blocks"))
    keys = ["list", "tile", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(retrieval.best_in_tile(k), retrieval.BEST)
