"""Scores, rates, percentiles and profiles of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, by: list[str], value: str, percent: float) -> DataFrame:
    """The value at place round-half-even(percent / 100 * (n - 1)) of each group.

    Equal values are counted first; the running counts are over distinct values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy(*by)
    running = counted.withColumn("upto", F.sum("c").over(own.orderBy(value))).withColumn("n", F.sum("c").over(own))
    place = F.bround(F.lit(percent / 100.0) * (F.col("n") - 1), 0)
    return running.where((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place)).select(*by, F.col(value).alias(f"p{percent:g}"), "n")


def rate(part: Column, whole: Column) -> Column:
    """Percentage; NULL where there is no whole."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 6))


def first_rank(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "doc").agg(F.min("rank").alias("rank"))


def last_rank(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "doc").agg(F.max("rank").alias("rank"))


def recall_at(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """For each query of gold (query_id, doc): whether some gold document is among the first k hits, and the share that is; rows of gold count as often as they come."""
    near = hits.where(F.col("rank") <= k).select("query_id", "doc").distinct().withColumn("hit", F.lit(1))
    joined = gold.select("query_id", "doc").join(near, ["query_id", "doc"], "left")
    return joined.groupBy("query_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("recalled"), F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("set_recall"))


def missing_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """field, n, missing, percent present: all columns in one pass."""
    counted = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in columns])
    return counted.select("n", F.explode(fields).alias("f")).select("f.field", "n", "f.missing", rate(F.col("n") - F.col("f.missing"), F.col("n")).alias("present"))


def buckets(present: Column) -> Column:
    return F.when(present >= 95, "reliable").when(present >= 70, "partial").otherwise("sparse")


def median_exact(rows: DataFrame, value: str) -> DataFrame:
    """count, mean, exact median, min and max of a column, without sorting it in one task: equal values are counted first."""
    return rows.agg(F.count(value).alias("n"), F.round(F.avg(F.col(value).cast("double")), 6).alias("mean"), F.round(F.percentile(value, 0.5), 6).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def normal_answer(value: Column) -> Column:
    """Answers compare without regard to case, dashes and spaces."""
    from lodestar.functions import names

    return names.fold_text(value)


def failure_category(status: Column, correct: Column, suppressed: Column, errors: Column, qtype: Column) -> Column:
    """Why an answer is not right, by the first cause that holds; NULL for a right one."""
    broken = (status == "error") | F.exists(errors, lambda e: e.startswith("system_error") | e.startswith("unknown_system"))
    ladder = F.when(broken, "system_failure").when(status == "invalid_citations", "citation_failure").when(status == "generation_error", "generation_failure")
    ladder = ladder.when(status == "ambiguous", "ambiguous_suppressed").when(status.isin("not_found", "unresolved", "unsupported"), status)
    ladder = ladder.when((status == "abstained") | suppressed, "abstained").when(qtype == "aggregation", "incorrect_or_incomplete").otherwise("incorrect")
    return F.when(~F.coalesce(correct, F.lit(False)), ladder)


def completeness(system: Column, qtype: Column, complete: Column, truncated: Column) -> Column:
    """Whether a set was kept whole, where that is asked; NULL elsewhere."""
    return F.when(system == "rag", None).when(qtype == "aggregation", complete & ~truncated).when(truncated, False)
