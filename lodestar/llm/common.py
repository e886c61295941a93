"""Shared folder, tables and fixed patterns used by several operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that the contracts name, as a Java pattern.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the JVM deletes it when it ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stash(df: DataFrame, name: str, partition_by: list[str] | None = None, arrow_rows: int = 1000) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors.

    While it is written, Arrow batches hold arrow_rows rows at most, so that whole
    texts on their way to Python and back take little memory.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    before = df.sparkSession.conf.get(ARROW_ROWS)
    df.sparkSession.conf.set(ARROW_ROWS, arrow_rows)
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        df.sparkSession.conf.set(ARROW_ROWS, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for df in stashed:
        drop_path(df.sparkSession, df._scratch)


#: At most so many keys are broadcast by lookup().
HEAVY_KEYS = 10_000


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined on keys with found, which has one row per key and how many of the `total` rows have it, as copies.

    Fewer than HEAVY_KEYS keys can hold more than that part of all rows. These are
    broadcast, so that their rows stay where they are; no other key has enough
    rows to fill a task.
    """
    heavy = F.col("copies") * F.lit(HEAVY_KEYS) > F.lit(total)
    often = found.where(heavy).select(*keys, F.struct(*[c for c in found.columns if c not in keys]).alias("__often"))
    marked = rows.join(F.broadcast(often), keys, "left")
    here = marked.where("__often is not null").select(*rows.columns, "__often.*")
    return here.unionByName(marked.where("__often is null").drop("__often").join(found.where(~heavy), keys).select(here.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def bucket_of(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; NULL for NULL."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def bounded_sample(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """`rows` rows of df at most, those with the least hashes of all columns; all of them where df has no more.

    Equal rows count once, so neither repeated nor NULL keys gather in a sample.
    Only hashes are sorted, a top-k in every task before the merge; the rows
    themselves are then filtered where they are.
    """
    at = free_name("__hash", df)
    hashed = df.select("*", F.xxhash64(*columns_of(df), F.lit(seed)).alias(at))
    cut = hashed.select(at).distinct().orderBy(at).limit(rows).agg(F.max(at)).head()[0]
    return hashed.where(F.col(at) <= F.lit(cut)).dropDuplicates([at]).select(columns_of(df))


def groups_for(total: int, per_group: int, least: int = 1) -> int:
    return max(least, math.ceil(total / per_group))


class Cache(dict):
    """A bounded cache in two generations: when the younger is full it becomes the older, and what is used again is young again."""

    def __init__(self, entries: int) -> None:
        super().__init__()
        self.entries = entries
        self.older: dict = {}

    def keep(self, key, value) -> None:
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value


def held(key, build):
    """What build() gives, once in each Python worker process."""
    import sys

    kept = sys.__dict__.setdefault("_lodestar_held", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def let_go() -> None:
    """Drop what held() keeps in this worker process: for steps that need the memory themselves."""
    import sys

    sys.__dict__.get("_lodestar_held", {}).clear()


def trim() -> None:
    """Give what this worker process has freed back to the system: workers live on between tasks, and what idle ones hold counts like what busy ones do."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other systems' libraries have no such call
        pass


#: Groups of so many bytes are worth a trim.
TRIM_FROM = 1 << 22


def sparing(run):
    """run over one group, then trim."""

    def inner(rows):
        out = run(rows)
        if rows.nbytes > TRIM_FROM:
            trim()
        return out

    return inner


def sparing_stream(run):
    """run over a task's batches, then trim."""

    def inner(batches):
        yield from run(batches)
        trim()

    return inner


def free_name(name: str, df: DataFrame) -> str:
    """name, or with underscores after it a name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _scans_files(df: DataFrame) -> bool:
    """Whether df is a table of files, at most projected and filtered, so that a row's place in its file names it."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        node = node.children().head()
    return "Relation" in node.nodeName()


def located(df: DataFrame, name: str) -> DataFrame:
    """df with a column `name` that locates each row: struct of file and row. What isn't a table of Parquet files is written as one first."""
    from pyspark.errors import AnalysisException

    if _scans_files(df):
        try:
            place = df.metadataColumn("_metadata")
            return df.select("*", F.struct(place["file_path"].alias("file"), place["row_index"].alias("row")).alias(name))
        except AnalysisException:  # other formats don't number their rows
            pass
    kept = stash(df, "located")
    place = kept.metadataColumn("_metadata")
    return kept.select("*", F.struct(place["file_path"].alias("file"), place["row_index"].alias("row")).alias(name))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df as they are, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
