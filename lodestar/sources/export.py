"""The event graph as files: typed tables, a manifest that accounts for them, and loading that holds what the manifest says."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.graph import reconcile
from lodestar.sources import files

# Attributes that are whole numbers and those that are yes or no; all others are text.
INTEGERS = ["year", "competitors", "nations", "prev_year", "next_year", "chunk_index", "token_count", "start_char", "end_char", "approx_tokens", "wikipedia_pageid"]
BOOLEANS = ["is_event", "has_competitors", "has_nations", "has_gold", "has_olympic_infobox", "competitors_overflow"]
TRUE = ["true", "1", "yes"]


def coerced(name: str, value: Column) -> Column:
    """A cell as its attribute's type: numbers that can't be read are 0, and what doesn't say true is false."""
    if name in INTEGERS:
        return F.coalesce(F.trim(value).try_cast("int"), F.lit(0))
    if name in BOOLEANS:
        return F.coalesce(F.lower(F.trim(value)).isin(TRUE), F.lit(False))
    return F.coalesce(value, F.lit(""))


def checksum(table: DataFrame) -> DataFrame:
    """n and checksum: the number of rows and a sum of their hashes, in whatever order and files they stand."""
    cells = [files.escape_cell(F.col(f"`{c}`")) for c in sorted(table.columns)]
    return table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*cells).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def _accounts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], "table string, n long, checksum string")
    for name, table in tables.items():
        out = out.unionByName(checksum(table).select(F.lit(name).alias("table"), "n", "checksum"))
    return out


def export(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write tables, texts as tab-separated values, and a manifest of their counts, checksums and columns; gives the accounts (table, n, checksum).

    Tables are sorted by their id, or source and target, within files that hold
    ranges of them. What is written is read back for the accounts. Each export
    has a folder of its own and its manifest comes last: until then, and if a
    job is lost on the way, the export before is the one that is loaded.
    """
    spark = next(iter(tables.values())).sparkSession
    root, folder = path, f"data-{uuid.uuid4().hex}"
    path = f"{root}/{folder}"
    for name, table in tables.items():
        order = [c for c in ("id", "src", "tgt") if c in table.columns]
        files.write_tsv(table.repartitionByRange(*order).sortWithinPartitions(*order) if order else table, f"{path}/{name}")
    written = {name: files.read_tsv(spark, f"{path}/{name}") for name in tables}
    accounts = _accounts(spark, written).collect()
    manifest = {"format": "tsv", "loading": "upsert_by_stable_id", "folder": folder, "tables": {r["table"]: {"n": r["n"], "checksum": r["checksum"], "columns": tables[r["table"]].columns} for r in accounts}}
    rows = spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    rows.coalesce(1).write.text(f"{root}/manifest/v={max(_versions(spark, root), default=-1) + 1}")
    return spark.createDataFrame(accounts, "table string, n long, checksum string")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests that are whole."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    return [int(f.getPath().getName()[2:]) for f in fs.listStatus(folder) if f.getPath().getName().startswith("v=") and fs.exists(f.getPath().suffix("/_SUCCESS"))]


def manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of the last export that is whole."""
    return json.loads(spark.read.text(f"{path}/manifest/v={max(_versions(spark, path))}").head()[0])


class PartialUpsert(RuntimeError):
    """Fewer rows arrived than were sent."""


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The exported tables with typed attributes. A table whose rows differ from the manifest's count or checksum raises PartialUpsert."""
    last = manifest(spark, path)
    known = last["tables"]
    raw = {name: files.read_tsv(spark, f"{path}/{last['folder']}/{name}").select(*[F.col(f"`{c}`") for c in own["columns"]]) for name, own in known.items()}
    for row in _accounts(spark, raw).collect():
        want = known[row["table"]]
        if (row["n"], row["checksum"]) != (want["n"], want["checksum"]):
            raise PartialUpsert(f"{row['table']}: {row['n']} rows of {want['n']}, checksum {row['checksum']} for {want['checksum']}")
    return {name: table.select(*[coerced(c, F.col(f"`{c}`")).alias(c) for c in table.columns]) for name, table in raw.items()}


def reconciled(spark: SparkSession, path: str, live: dict[str, DataFrame]) -> DataFrame:
    """Tables whose live counts differ from the export's: table, expected, actual."""
    own = manifest(spark, path)["tables"]
    expected = spark.createDataFrame([(name, entry["n"]) for name, entry in own.items()], "table string, n long")
    actual = spark.createDataFrame([], "table string, n long")
    for name, table in live.items():
        actual = actual.unionByName(table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n"))
    return reconcile(expected, actual)


def missing(required: list[str], live: dict[str, DataFrame]) -> list[str]:
    """Required tables that aren't there."""
    return [name for name in required if name not in live]
