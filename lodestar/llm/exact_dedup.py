"""Exact deduplication by a stateful stream over content digests.

A Structured Streaming aggregation keeps, for each digest of the normalised
text, the number of rows seen, the stable identifier of the row that stays and
a locator of its content: the file that holds it and its row there. The state has
no expiry and lives in RocksDB on disk; its changelog goes to the shared folder.
A digest that is hit is not trusted: the full normalised text of each further
row is fetched by its locator and compared with the text at the locator that the
state kept, and digests whose texts differ are grouped by the text itself.

Everything is DataFrame and SQL expressions inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import SPACE_CLASS, columns_of, discard, drop_path, free_name, located, lookup, scratch_path, stash, table, text_or_empty

#: The state lives in RocksDB; a task closes its store when it has committed, so that no local copy outlives the stream.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Files of digests that a micro-batch reads at most.
FILES_PER_BATCH = 512
#: Hits of one digest that are compared with one copy of the text that stays.
HITS_PER_TEXT = 1000
LOCATOR = "struct<file:string,row:bigint>"


def normalised(column: str = "text") -> Column:
    """The text without white space; NULL counts as empty."""
    return F.regexp_replace(text_or_empty(column), SPACE_CLASS + "+", "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed_state(digests: DataFrame, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Stream the digest table at `path` through the keyed state; one row per digest with its latest state."""
    spark = digests.sparkSession
    out, log = scratch_path(spark, "exact-state"), scratch_path(spark, "exact-log")
    reader = spark.readStream.schema(digests.schema).option("maxFilesPerTrigger", files_per_batch)
    state = (
        reader.parquet(path)
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.max(F.struct("points", F.expr("~doc_id").alias("order"), "doc_id", "locator")).alias("best"),
        )
    )
    before = {key: spark.conf.get(key) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", log)
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    batches = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    if not batches:
        return spark.createDataFrame([], state.schema)
    updates = spark.read.parquet(out)
    if len(batches) > 1:
        updates = updates.groupBy("digest").agg(F.max_by(F.struct("group_size", "best"), "batch").alias("s")).select("digest", "s.*")
    return updates.select("digest", "group_size", "best")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256_hex, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, keep_locator, locator.

    Texts are equal when they are identical after white space is deleted. Of
    equal texts the one with the most code points in the original stays, then
    the smallest doc_id. NULL text is empty text, and all empty texts are equal.
    A NULL doc_id loses every tie; its own rows report kept = false unless no
    other row of the group has an id, and then keep_id is NULL and kept is true.
    Rows that repeat a doc_id are one document listed twice: each row counts in
    group_size and both say the same; only one of them is at keep_locator. Other columns of docs are ignored. An
    empty table gives an empty result. Texts of any length are read whole.
    """
    return _decided(located(docs.select("doc_id", "text"), "locator"), digest, files_per_batch)


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs, all its columns, with one row of each group of equal texts: that at the locator which the state kept."""
    name = free_name("locator", docs)
    rows = located(docs, name)
    decided = _decided(rows.select("doc_id", "text", F.col(f"`{name}`").alias("locator")), sha256_hex, FILES_PER_BATCH)
    dropped = decided.where("locator != keep_locator").select(F.col("locator").alias("__dropped"))
    return rows.join(dropped, rows[name] == dropped["__dropped"], "left_anti").select(columns_of(docs))


def _decided(base: DataFrame, digest: Callable[[Column], Column], files_per_batch: int) -> DataFrame:
    """exact_dedup of rows doc_id, text, locator."""
    spark = base.sparkSession
    sha = sha256_hex(normalised())
    digests = base.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(sha).alias("sha"),
        digest(normalised()).alias("digest") if digest is not sha256_hex else F.unhex(sha).alias("digest"),
        F.char_length(text_or_empty()).cast("long").alias("points"),
        F.col("locator").cast(LOCATOR).alias("locator"),
    )
    path = scratch_path(spark, "exact-digests")
    digests.write.parquet(path)
    digests = spark.read.schema(digests.schema).parquet(path)
    groups = keyed_state(digests, path, files_per_batch).select(
        "digest", F.col("group_size").alias("copies"), F.col("best.doc_id").alias("keep_id"), F.col("best.locator").alias("keep_locator")
    )
    rows = lookup(digests, groups, ["digest"], digests.count()).withColumnRenamed("copies", "group_size")
    rows = stash(rows, "exact-rows")
    drop_path(spark, path)
    differing = stash(_differing(base, rows), "exact-differing")
    if differing.isEmpty():
        discard(differing)
    else:
        rows = _by_full_text(base, rows, differing)
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "keep_locator",
        "locator",
    )


def _differing(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Digests under which two rows have different bytes. Only the texts of rows that hit a digest are compared.

    The hits of a digest are dealt to as many copies of the text that stays as their number asks for.
    """
    parts = F.ceil(F.col("group_size") / HITS_PER_TEXT).cast("int")
    hits = rows.where("group_size > 1 and locator != keep_locator").select("locator", "digest", F.pmod(F.xxhash64("locator"), parts).cast("int").alias("part"))
    keeps = rows.where("group_size > 1 and locator = keep_locator").select("locator", "digest", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    texts = base.select(F.col("locator").alias("place"), "text")
    mine = hits.join(texts, hits["locator"] == texts["place"]).select("digest", "part", normalised().alias("mine"))
    theirs = keeps.join(texts, keeps["locator"] == texts["place"]).select("digest", "part", normalised().alias("theirs"))
    return mine.join(theirs, ["digest", "part"]).where("mine != theirs").select("digest").distinct()


def _by_full_text(base: DataFrame, rows: DataFrame, differing: DataFrame) -> DataFrame:
    """Group the rows of the given digests by their full normalised text instead."""
    texts = base.select(F.col("locator").alias("place"), normalised().alias("norm"))
    odd = rows.join(differing, "digest", "left_semi").drop("group_size", "keep_id", "keep_locator")
    odd = odd.join(texts, odd["locator"] == texts["place"])
    best = odd.groupBy("norm").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("points", F.expr("~doc_id").alias("order"), "doc_id", "locator")).alias("best"),
    )
    odd = odd.join(best, "norm").select(*[c for c in odd.columns if c not in ("place", "norm")], "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.locator").alias("keep_locator"))
    return rows.join(differing, "digest", "left_anti").select(odd.columns).unionByName(odd)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row and whole text of documents; the columns that the SQL has."""
    return exact_dedup(table(spark, sf_dir, "documents")).drop("keep_locator", "locator")


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
