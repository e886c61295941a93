"""Profiles of a parsed corpus and of the questions that it can answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import pools
from lodestar.operators.scoring import rate

FIELDS = ["sport", "year", "season", "event_name_raw", "venue_raw", "date", "competitors", "nations", "prev_year", "next_year"]


def corpus_counts(parsed: DataFrame) -> DataFrame:
    """One row: documents, event documents, others, infoboxes, titles of events, and those without an infobox.

    Reads what the title and the infobox's header say, so that no event need be made.
    """
    titled = F.col("title_parse.parsed") & F.col("title_parse.event_name").isNotNull()
    event = F.col("kind") == "event"
    return parsed.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(event).alias("event_documents"),
        F.count_if(~event).alias("document_only"),
        F.count_if("has_olympic_infobox").alias("with_infobox"),
        F.count_if(titled).alias("event_titles"),
        F.count_if(F.col("rejection_reason") == "olympic_title_without_infobox").alias("rejected_titles"),
    )


def flag_counts(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def missing_values(parsed: DataFrame) -> DataFrame:
    """field, n, missing and its rate over events, in one pass."""
    gold = F.exists("event.medals", lambda m: m["place"] == "gold")
    lacks = {f: F.col(f"event.{f}").isNull() for f in FIELDS} | {"gold": ~gold}
    row = parsed.where("event is not null").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(test).alias(f) for f, test in lacks.items()])
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in lacks])
    return row.select("n", F.inline(fields)).select("field", "n", "missing", rate(F.col("missing"), F.col("n")).alias("rate"))


def histogram(parsed: DataFrame, field: str) -> DataFrame:
    """Values of an event's field by how often they occur, the first seen document deciding ties."""
    value = F.col(f"event.{field}")
    return parsed.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_seen"))


def duplicate_identities(parsed: DataFrame) -> DataFrame:
    """Groups of events with the same sport, Games and name."""
    name = F.lower(F.trim(F.regexp_replace("event.event_name_raw", r"(?U)\s+", " ")))
    rows = parsed.where("event is not null").select("doc_id", "event.sport", "event.year", "event.season", name.alias("name")).where("sport is not null and year is not null and season is not null and name <> ''")
    return rows.groupBy("sport", "year", "season", "name").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def samples(parsed: DataFrame, flag: str, most: int = 5) -> DataFrame:
    """A report's first documents with a flag."""
    return parsed.where(F.array_contains("flags", flag)).orderBy("doc_id").select("doc_id", "title").limit(most)


def matchable(events: DataFrame, relation: str = "previous") -> DataFrame:
    """One row: events with a name and Games, and how many of them have an edition before or after under that name."""
    named = events.where("sport is not null and year is not null and season is not null and event_name is not null")
    related = pools.related_edition(named, relation, ["sport", "season", "event_name"])
    return related.agg(F.count(F.lit(1)).alias("n"), F.count("related").alias("matched")).select("n", "matched", rate(F.col("matched"), F.col("n")).alias("rate"))


def support(status: Column, reason: Column) -> Column:
    """How far the corpus supports a question: fully, partly where only a value or a tie stands in the way, or not."""
    return F.when(status == "supported", "supported").when((status == "ambiguous") | reason.startswith("missing_field"), "partial").otherwise("unsupported")


def question_coverage(outcomes: DataFrame) -> DataFrame:
    """Outcomes (qtype, status, reason) by type and overall (qtype NULL): n, supported, partial, unsupported, and the percentage supported."""
    rows = outcomes.withColumn("support", support(F.col("status"), F.coalesce("reason", F.lit("")))).groupingSets([[], ["qtype"]], "qtype")
    n, count = F.count(F.lit(1)), lambda s: F.count_if(F.col("support") == s)
    return rows.agg(F.grouping("qtype").cast("int").alias("overall"), n.alias("n"), *[count(s).alias(s) for s in ("supported", "partial", "unsupported")], rate(count("supported"), n).alias("supported_pct"))
