"""Queries over pages, questions and evidence made from the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import calendar, questions
from lodestar.operators import chunks, evaluation, evidence, ingest, pools
from lodestar.plans import answers
from lodestar.queries.catalog import QUERIES, ev, query
from lodestar.sources import files
from lodestar.sources.tables import event_view, read_table
from lodestar.streaming import upsert

__all__ = ["QUERIES"]


def pages(events: DataFrame) -> DataFrame:
    """Each event as a record of the corpus: a title, an infobox and a sentence."""
    line = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit(f"  {key}: "), c.cast("string")))
    box = [line("games", F.concat_ws(" ", "year", "season")), line("venue", F.col("venue")), line("date", F.date_format("event_date", "d MMMM")), line("competitors", F.col("competitors")), line("nations", F.col("nations")), line("gold", F.col("gold"))]
    text = F.concat_ws("\n", F.lit("[Infobox Olympic event]"), *box, F.lit(""), F.lit("The event was held."))
    title = F.format_string("%s at the %s %s Olympics – %s", F.initcap("sport"), F.col("year").cast("string"), "season", "event_name")
    return events.select(F.col("id").cast("string").alias("doc_id"), title.alias("title"), text.alias("text"))


@query(ev("""SELECT id::VARCHAR AS id, sport, year::INTEGER AS year, season, event_name, venue, competitors, nations, gold, CASE WHEN competitors IS NULL THEN 'olympic_event_title,missing_competitors,missing_nations' ELSE 'olympic_event_title' END AS flags,
year::VARCHAR || '|' || month(event_date)::VARCHAR || '|' || day(event_date)::VARCHAR AS date FROM ev"""))
def parse_infobox(spark, sf_dir) -> DataFrame:
    parsed = ingest.parse_documents(pages(event_view(spark, sf_dir)), ingest.SOLVER_FIELDS)
    date = F.concat_ws("|", *[F.concat_ws(",", F.col(f"date.{p}").cast("array<string>")) for p in ("years", "months", "days")])
    events = ingest.solver_events(parsed, F.array_join("flags", ",").alias("flags"))
    return events.select("id", "sport", "year", "season", "event_name", "venue", "competitors", "nations", "gold", "flags", date.alias("date"))


@query("""SELECT o_orderkey, year(o_orderdate)::VARCHAR AS years, month(o_orderdate)::VARCHAR AS months, array_to_string(range(day(o_orderdate), day(o_orderdate) + 1 + (o_orderkey % 3 = 0 AND day(o_orderdate) < 31)::INTEGER), ',') AS days FROM orders""")
def date_span(spark, sf_dir) -> DataFrame:
    date, first = F.to_date("o_orderdate"), F.dayofmonth("o_orderdate")
    days = F.when((F.col("o_orderkey") % 3 == 0) & (first < 31), F.concat(first.cast("string"), F.lit(" to "), (first + 1).cast("string"))).otherwise(first.cast("string"))
    span = calendar.date_span(F.concat(days, F.date_format(date, " MMMM yyyy")))
    return read_table(spark, sf_dir, "orders").withColumn("span", span).select("o_orderkey", *[F.concat_ws(",", F.col(f"span.{p}").cast("array<string>")).alias(p) for p in ("years", "months", "days")])


@query()
def chunk_documents(spark, sf_dir) -> DataFrame:
    records = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), "text")
    return chunks.chunk_documents(ingest.parse_documents(records)).drop("indexed_text")


def asked(events: DataFrame) -> DataFrame:
    """A count and a superlative of each pool, and the nations of each event, in words."""
    own = events.select("sport", F.col("year").cast("string").alias("y"), "season").distinct()
    key = F.concat_ws(":", "sport", "y", "season")
    count = own.select(F.concat(F.lit("count:"), key).alias("qid"), F.format_string("How many %s events at the %s %s Olympics had more than 4 competitors?", "sport", "y", "season").alias("question"))
    top = own.select(F.concat(F.lit("top:"), key).alias("qid"), F.format_string("Please tell me which %s event at the %s %s Olympics had the most competitors?", "sport", "y", "season").alias("question"))
    look = events.select(F.concat(F.lit("nations:"), F.col("id").cast("string")).alias("qid"), F.format_string("What's the nation count for %s?", "title").alias("question"))
    return count.unionByName(top).unionByName(look)


def _canonical(events: DataFrame) -> DataFrame:
    date = F.struct(F.date_format("event_date", "d MMMM yyyy").alias("raw"), *[F.col(f"d.{p}").alias(p) for p in ("years", "months", "days")])
    none = F.lit(None).cast("int")
    return events.withColumn("d", pools.event_days(F.col("event_date"))).withColumns({"date": date, "prev_year": none, "next_year": none}).withColumn("year", F.col("year").cast("int")).drop("d")


SPORTS = ["automobile", "building", "furniture", "household", "machinery"]


@query(ev("""SELECT 'count:' || sport || ':' || year::VARCHAR || ':' || season AS qid, 'count_over_threshold' AS operation, 'supported' AS status, NULL::VARCHAR AS reason, (count(*) FILTER (competitors > 4))::VARCHAR AS answer FROM ev GROUP BY sport, year, season
UNION ALL SELECT 'top:' || sport || ':' || year::VARCHAR || ':' || season, 'argmax_competitors', CASE WHEN max(competitors) IS NULL THEN 'unresolved' WHEN count(*) FILTER (competitors = best) > 1 THEN 'ambiguous' ELSE 'supported' END,
 CASE WHEN max(competitors) IS NULL THEN 'missing_field:competitors' WHEN count(*) FILTER (competitors = best) > 1 THEN 'tied_max_competitors' END, CASE WHEN count(*) FILTER (competitors = best) = 1 THEN min(title) FILTER (competitors = best) END
 FROM (SELECT *, max(competitors) OVER (PARTITION BY sport, year, season) AS best FROM ev) GROUP BY sport, year, season
UNION ALL SELECT 'nations:' || id::VARCHAR, 'lookup_nations', CASE WHEN nations IS NULL THEN 'unresolved' ELSE 'supported' END, CASE WHEN nations IS NULL THEN 'missing_field:nations' END, nations::VARCHAR FROM ev"""))
def solve_questions(spark, sf_dir) -> DataFrame:
    events = files.stash(event_view(spark, sf_dir), "events")
    return answers.solve(files.stash(questions.parse_questions(asked(events), SPORTS), "parsed"), files.stash(_canonical(events), "canonical"))


@query(ev("SELECT sport, year, season, string_agg(title, ' | ' ORDER BY 'p:entity:' || id::VARCHAR) AS answer, count(*) AS cited FROM (SELECT * FROM ev QUALIFY competitors = max(competitors) OVER (PARTITION BY sport, year, season)) GROUP BY ALL"))
def deterministic_answer(spark, sf_dir) -> DataFrame:
    winners = pools.argmax_ties(event_view(spark, sf_dir))
    items = evidence.event_evidence(winners, "p").join(winners.select(F.col("id").cast("string").alias("event_id"), *pools.POOL), "event_id")
    packed = evidence.pack(pools.POOL, items)
    return evidence.deterministic_answer(packed, pools.POOL, "argmax_competitors").select(*pools.POOL, "answer", F.size("citation_ids").cast("long").alias("cited"))


@query(ev("SELECT id::VARCHAR AS event_id, 'p:fact:nations:' || id::VARCHAR AS evidence_id FROM ev WHERE nations IS NULL"))
def citation_orphans(spark, sf_dir) -> DataFrame:
    events = event_view(spark, sf_dir)
    key = F.col("id").cast("string")
    cited = events.select(key.alias("event_id"), F.concat(F.lit("p:fact:nations:"), key).alias("evidence_id"))
    return evidence.citation_orphans(cited, evidence.pack(["event_id"], evidence.event_evidence(events, "p")), ["event_id"])


@query(ev("SELECT id::VARCHAR AS event_id, CASE WHEN nations IS NULL THEN 'orphan_citation:p:fact:nations:' || id::VARCHAR WHEN competitors <> nations THEN 'ungrounded_answer' ELSE '' END AS errors, coalesce(nations = competitors, false) AS valid FROM ev"))
def citation_validation(spark, sf_dir) -> DataFrame:
    events = event_view(spark, sf_dir)
    key = F.col("id").cast("string")
    given = events.select(key.alias("event_id"), F.col("competitors").cast("string").alias("answer"), F.array(F.concat(F.lit("p:fact:nations:"), key)).alias("citation_ids"))
    checked = evidence.validate(given, evidence.pack(["event_id"], evidence.event_evidence(events, "p")), ["event_id"])
    return checked.select("event_id", F.array_join("errors", ",").alias("errors"), "valid")


@query(ev("""SELECT qtype, failure, count(*) AS n FROM (SELECT 'superlative' AS qtype, CASE WHEN usable = 0 THEN 'unresolved' WHEN ties > 1 THEN 'ambiguous_suppressed' END AS failure FROM (
SELECT count(competitors) AS usable, count(*) FILTER (competitors = best) AS ties FROM (SELECT *, max(competitors) OVER (PARTITION BY sport, year, season) AS best FROM ev) GROUP BY sport, year, season)) GROUP BY ALL"""))
def failure_histogram(spark, sf_dir) -> DataFrame:
    rows = pools.argmax_status(event_view(spark, sf_dir)).withColumn("qtype", F.lit("superlative"))
    failure = evaluation.failure_category(F.col("status"), F.col("status") == "supported", F.col("status") != "supported", F.expr("array()").cast("array<string>"), F.col("qtype"))
    return rows.groupBy("qtype", failure.alias("failure")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text, replace(replace(replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), chr(13), chr(92) || 'r'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') AS cell FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def tsv_cells(spark, sf_dir) -> DataFrame:
    cells = read_table(spark, sf_dir, "documents").select("doc_id", files.escape_cell(F.col("text")).alias("cell"))
    return cells.select("doc_id", files.unescape_cell(F.col("cell")).alias("text"), "cell")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max((ts, event_id))[2] AS event_id FROM events GROUP BY user_id")
def stream_upsert(spark, sf_dir) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("user_id", "ts", "event_id", "event_type")
    return upsert.upsert_available(source, ["user_id"], ["ts", "event_id"], files.scratch(spark, "upsert")).drop("ts")
