"""Files of records: JSON lines and tab-separated values, as sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, any other line that isn't an object of the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, "qid string, qtype string, question string, answer array<string>, gold_doc_ids array<string>").orderBy("qid")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object a line, keys sorted, without spaces; NULLs are written."""
    rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def escape_cell(value: Column) -> Column:
    """Backslash, carriage return, line feed and tab as two characters; NULL as nothing."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for plain, escaped in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def _replacing(what: str, by: str):
    return lambda text: F.replace(text, F.lit(what), F.lit(by))


def unescape_cell(cell: Column) -> Column:
    """The inverse; other escapes stay as they are. Between doubled backslashes no backslash is one of a pair."""
    own = F.split(cell, r"\\\\")
    for plain, escaped in (("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        own = F.transform(own, _replacing(escaped, plain))
    return F.array_join(own, "\\")


def write_tsv(rows: DataFrame, path: str) -> None:
    """A header and escaped cells, in as many files as rows has partitions, each with the header."""
    plain = {"header": True, "sep": "\t", "quote": "", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.select(*[escape_cell(F.col(f"`{c}`")).alias(c) for c in rows.columns]).write.mode("overwrite").options(**plain).csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, unescaped; short rows are padded with ''."""
    plain = {"sep": "\t", "quote": "", "escape": "\x00", "emptyValue": "", "nullValue": "\x00", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows = spark.read.options(header=True, mode="PERMISSIVE", **plain).csv(path)
    return rows.select(*[F.coalesce(unescape_cell(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns])


def stash(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once to a scratch folder and read from there by all that follow; it survives lost executors."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out._scratch = path
    return out


def discard(stashed: DataFrame) -> None:
    """Delete a stashed table that no later plan reads."""
    target = stashed.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(stashed._scratch)
    target.getFileSystem(stashed.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of a shuffle that a task takes.
ROWS_PER_TASK = 400_000


def dealt(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """rows, about `count` of them, dealt by keys to tasks of ROWS_PER_TASK; as they are where Spark's own number of shuffle partitions is enough.

    Joins and groups by these keys, or by more, stay in those tasks, so that what one of them sorts or holds doesn't grow with the table.
    """
    tasks = -(-count // ROWS_PER_TASK)
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def numbered(rows: DataFrame, name: str = "doc_ord") -> DataFrame:
    """rows, a table of files that is at most projected and filtered, with their ordinal from 0: by file path, then by place in the file.

    Every task reads blocks of files in order. The rows are written once with
    their block and a running number; the sizes of the blocks before a block,
    of which there are a few for each task, give its first ordinal, and no task
    orders rows. Any format has blocks; an empty table stays empty.
    """
    from pyspark.sql import Window

    meta = rows.metadataColumn("_metadata")
    block = F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"))
    kept = stash(rows.select("*", block.alias("__block"), F.monotonically_increasing_id().alias("__at")), "numbered")
    sizes = kept.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__least"))
    first = sizes.withColumn("__first", F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n"))
    placed = kept.join(F.broadcast(first.select("__block", "__first", "__least")), "__block")
    # within a block a filter leaves no gap: rows are numbered after it
    return placed.select(*rows.columns, (F.col("__first") + F.col("__at") - F.col("__least")).alias(name))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus records of JSON lines (doc_id, title, url, wikidata_qid, wikipedia_pageid, approx_tokens, text) with doc_ord, their place over all files."""
    return numbered(read_jsonl(spark, path, "doc_id string, title string, url string, wikidata_qid string, wikipedia_pageid long, approx_tokens int, text string"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder's path where driver and executors both reach it: under spark.checkpoint.dir, or on one machine in the warehouse."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path
