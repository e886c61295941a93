"""Queries over scored results made from events, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import answers, lexical
from lodestar.operators import scoring
from lodestar.plans import textsearch
from lodestar.queries.catalog import QUERIES, ev, query
from lodestar.queries.corpus import pages
from lodestar.sources import files
from lodestar.sources.tables import event_view, read_table

__all__ = ["QUERIES"]


def gold(events: DataFrame) -> DataFrame:
    qtype = F.when(F.col("id") % 3 == 0, "aggregation").when(F.col("id") % 3 == 1, "lookup").otherwise("temporal")
    return events.select(F.col("id").cast("string").alias("qid"), qtype.alias("qtype"), F.array(F.coalesce(F.col("nations"), F.lit(-1)).cast("string")).alias("answer"), F.array(F.col("id").cast("string"), F.concat(F.lit("x"), F.col("id").cast("string"))).alias("gold_doc_ids"))


def results(events: DataFrame) -> DataFrame:
    """One result of each system: one copies the nations, one guesses the competitors, one gives nothing for events without them."""
    key = F.col("id").cast("string")
    systems = F.explode(F.array(*[F.lit(s) for s in scoring.SYSTEMS])).alias("system_name")
    rows = events.select("id", key.alias("qid"), "nations", "competitors", systems)
    value = F.when(F.col("system_name") == "rag", F.col("competitors")).otherwise(F.col("nations")).cast("string")
    agentic = F.col("system_name") == "agentic_graphrag"
    evidence = F.array(F.struct(F.col("qid").alias("evidence_id"), F.when(F.col("system_name") != "rag", F.col("qid")).alias("event_id"), F.lit(None).cast("string").alias("document_id")))
    status = F.when(value.isNull(), "unresolved").when(agentic & (F.col("id") % 10 == 0), "generation_error").otherwise("supported")
    none = F.lit(None)
    return rows.select(
        "qid", "system_name", status.alias("status"), F.when(agentic, F.concat(value, F.lit(".0"))).otherwise(value).alias("answer"), F.when(F.col("id") % 7 == 0, F.array(F.lit("other"))).otherwise(F.array("qid")).alias("citations"), evidence.alias("evidence"),
        none.cast("array<string>").alias("errors"), (F.col("id") % 100).cast("double").alias("latency_ms"), none.cast("array<string>").alias("event_ids"), F.when(F.col("id") % 2 == 0, "complete_set").alias("cardinality"), none.cast("boolean").alias("complete_set"), (F.col("id") % 5 == 0).alias("truncated_set"),
        F.when(agentic, F.col("id") % 3 + 1).alias("tool_calls"), F.when(agentic, F.col("id") % 2).alias("followups"), F.when(agentic, F.when(F.col("id") % 11 == 0, "no_progress").otherwise("answered")).alias("stop_reason"), F.when(agentic & (F.col("id") % 4 == 0), F.array(F.lit("gsql:event_neighborhood"))).alias("methods"),
        F.when(agentic, F.col("id") % 3).otherwise(0).alias("model_calls"), F.when(agentic, F.col("id") % 50).alias("tokens"), (agentic & (F.col("id") % 13 == 0)).alias("tokens_unknown"), F.when(agentic & (F.col("id") % 10 == 0), "timeout").alias("failure_class"),
    )


SCORED = """, r AS (
  SELECT id, id::VARCHAR AS qid, s AS system_name, s = 'agentic_graphrag' AS agentic, nations, competitors, CASE WHEN id % 3 = 0 THEN 'aggregation' WHEN id % 3 = 1 THEN 'lookup' ELSE 'temporal' END AS qtype,
         CASE WHEN s = 'rag' THEN competitors ELSE nations END AS value FROM ev, (SELECT unnest(['rag', 'graphrag', 'agentic_graphrag']) AS s)
), s1 AS (
  SELECT *, CASE WHEN value IS NULL THEN 'unresolved' WHEN agentic AND id % 10 = 0 THEN 'generation_error' ELSE 'supported' END AS status, coalesce(value = nations, false) AS correct, coalesce(value = nations AND NOT agentic, false) AS correct_exact FROM r
), s2 AS (
  SELECT *, value IS NULL OR status <> 'supported' AS suppressed, status <> 'generation_error' AND id % 7 <> 0 AS citations_valid FROM s1
), scored AS (
  SELECT *, CASE WHEN status = 'generation_error' THEN false WHEN suppressed THEN true ELSE citations_valid END AS grounded,
         CASE WHEN system_name = 'rag' THEN NULL WHEN qtype = 'aggregation' THEN id % 5 <> 0 AND id % 2 = 0 WHEN id % 5 = 0 THEN false END AS complete,
         CASE WHEN system_name = 'rag' THEN 0.0 ELSE 0.5 END AS doc_recall, (id % 100)::DOUBLE AS latency_ms,
         CASE WHEN correct THEN NULL WHEN status = 'generation_error' THEN 'generation_failure' WHEN status = 'unresolved' THEN 'unresolved' WHEN qtype = 'aggregation' THEN 'incorrect_or_incomplete' ELSE 'incorrect' END AS failure FROM s2
)"""


def _scored(spark, sf_dir) -> DataFrame:
    events = event_view(spark, sf_dir)
    return scoring.score(results(events), gold(events))


@query(ev("SELECT qid, system_name, status, correct, correct_exact, suppressed, citations_valid, grounded, complete, doc_recall::DOUBLE AS doc_recall, failure FROM scored", SCORED))
def scored_rows(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir).select("qid", "system_name", "status", "correct", "correct_exact", "suppressed", "citations_valid", "grounded", "complete", "doc_recall", "failure")


@query(ev("""SELECT qtype, system_name, grouping(qtype)::INT AS overall, count(*) AS n, round_even(100.0::DOUBLE * count(*) FILTER (correct) / count(*), 1) AS correctness, count(complete) AS completeness_n, round_even(100.0::DOUBLE * count(*) FILTER (grounded) / count(grounded), 1) AS grounding,
count(*) FILTER (status = 'generation_error') AS system_errors, count(*) FILTER (suppressed) AS answer_suppressed, round_even(avg(latency_ms), 3) AS latency_avg_ms, max(latency_ms) AS latency_max_ms, round_even(avg(doc_recall)::DOUBLE, 3) AS doc_recall_avg FROM scored GROUP BY GROUPING SETS ((system_name), (qtype, system_name))""", SCORED))
def benchmark_summary(spark, sf_dir) -> DataFrame:
    return scoring.summarize(_scored(spark, sf_dir)).select("qtype", "system_name", "overall", "n", "correctness", "completeness_n", "grounding", "system_errors", "answer_suppressed", "latency_avg_ms", "latency_max_ms", "doc_recall_avg")


@query(ev("SELECT system_name, failure, count(*) AS n FROM scored WHERE failure IS NOT NULL GROUP BY ALL", SCORED))
def failure_counts(spark, sf_dir) -> DataFrame:
    return scoring.counted(_scored(spark, sf_dir), ["system_name"], "failure")


@query(ev("""SELECT qtype, grouping(qtype)::INT AS overall, count(*) AS n, count(*) FILTER (id % 3 = 0) AS one_tool_call, count(*) FILTER (id % 2 = 1) AS followups, count(*) FILTER (id % 4 = 0) AS used_neighborhood, 0::BIGINT AS used_temporal, count(*) FILTER (id % 2 = 0) AS complete_set,
count(*) FILTER (id % 5 = 0) AS truncated_set, count(*) FILTER (id % 11 = 0) AS no_progress, 0::BIGINT AS budget_exhausted, round_even(avg(id % 3 + 1), 3) AS tool_calls_avg FROM scored WHERE agentic GROUP BY GROUPING SETS ((), (qtype))""", SCORED))
def agentic_behaviour(spark, sf_dir) -> DataFrame:
    return scoring.behaviour(_scored(spark, sf_dir))


@query(ev("""SELECT system_name, count(*) FILTER (status = 'generation_error') AS generation_errors, count(*) FILTER (agentic AND id % 10 = 0) AS failure_classes, count(*) FILTER (agentic AND id % 13 = 0) AS tokens_unknown, count(*) FILTER (agentic AND id % 3 > 1) AS retried,
sum(CASE WHEN agentic THEN id % 50 ELSE 0 END)::BIGINT AS tokens_total, sum(CASE WHEN agentic THEN id % 3 ELSE 0 END)::BIGINT AS model_calls_total FROM scored GROUP BY 1""", SCORED))
def reliability(spark, sf_dir) -> DataFrame:
    return scoring.reliability(_scored(spark, sf_dir))


@query(ev("SELECT qid, qtype, system_name, coalesce(nations, -1)::VARCHAR AS expected, coalesce(value::VARCHAR || CASE WHEN agentic THEN '.0' ELSE '' END, '') AS predicted, status, failure FROM scored WHERE NOT correct ORDER BY id, system_name LIMIT 80", SCORED))
def failure_table(spark, sf_dir) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("ord", F.col("qid").cast("long"))
    return scoring.failures(rows, ["ord", "system_name"]).select("qid", "qtype", "system_name", "expected", "predicted", "status", "failure")


VARIANTS = SCORED + ", v AS (SELECT *, CASE system_name WHEN 'rag' THEN 'V0' WHEN 'graphrag' THEN 'V1' ELSE 'V2' END AS variant FROM scored), f AS (SELECT *, NULL AS family FROM v UNION ALL SELECT *, qtype FROM v UNION ALL SELECT *, 'abstention' FROM v WHERE status = 'unresolved'), st AS (SELECT variant, family, count(*) AS n, round_even(100.0::DOUBLE * count(*) FILTER (correct) / count(*), 1) AS correctness, count(*) FILTER (status = 'unresolved') AS abstentions FROM f GROUP BY ALL)"


def _variants(spark, sf_dir) -> DataFrame:
    scored = _scored(spark, sf_dir)
    place = F.array_position(F.array(*[F.lit(s) for s in scoring.SYSTEMS]), F.col("system_name")) - 1
    return scoring.variants(scored.withColumns({"variant": F.concat(F.lit("V"), place.cast("string")), "recall_at_5": F.col("doc_recall") > 0, "recall_at_10": F.col("doc_recall") > 0}))


@query(ev("SELECT variant, family, n, correctness, abstentions FROM st", VARIANTS))
def variant_statistics(spark, sf_dir) -> DataFrame:
    return _variants(spark, sf_dir).select("variant", "family", "n", "correctness", "abstentions")


@query(ev("SELECT a.variant, a.family, round_even(a.correctness - b.correctness, 3) AS correctness, round_even((a.n - b.n)::DOUBLE, 3) AS n FROM st a JOIN st b ON b.variant = 'V0' AND a.variant <> 'V0' AND a.family IS NOT DISTINCT FROM b.family", VARIANTS))
def variant_deltas(spark, sf_dir) -> DataFrame:
    return scoring.deltas(_variants(spark, sf_dir).select("variant", "family", "n", "correctness")).select("variant", "family", "correctness", "n")


@query(ev("SELECT family, round_even(max(a.correctness) - b.correctness, 3) AS gain, CASE WHEN round_even(max(a.correctness) - b.correctness, 3) >= 0.1 THEN 'benefit' WHEN round_even(max(a.correctness) - b.correctness, 3) <= -0.1 THEN 'regress' ELSE 'same' END AS move FROM st a JOIN st b USING (family) WHERE a.variant <> 'V0' AND b.variant = 'V0' GROUP BY family, b.correctness", VARIANTS))
def family_moves(spark, sf_dir) -> DataFrame:
    return scoring.family_moves(_variants(spark, sf_dir))


@query(ev("""SELECT qtype, grouping(qtype)::INT AS overall, count(*) AS n, count(*) FILTER (status = 'supported') AS solved, count(*) FILTER (status = 'unresolved') AS unresolved, round_even(100.0::DOUBLE * count(*) FILTER (correct_exact) / count(*), 1) AS exact_accuracy, round_even(100.0::DOUBLE * count(*) FILTER (correct) / count(*), 1) AS normalized_accuracy
FROM scored WHERE system_name = 'graphrag' GROUP BY GROUPING SETS ((), (qtype))""", SCORED))
def solver_by_type(spark, sf_dir) -> DataFrame:
    rows = _scored(spark, sf_dir).where("system_name = 'graphrag'").withColumnsRenamed({"correct_exact": "exact", "correct": "normalized", "latency_ms": "elapsed_ms"})
    return scoring.by_type(rows).select("qtype", "overall", "n", "solved", "unresolved", "exact_accuracy", "normalized_accuracy")


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 79) || '…' END AS short, CASE WHEN length(text) <= 101 THEN text ELSE left(text, 48) || ' ... ' || right(text, 48) END AS ends FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def shortened_texts(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", answers.shortened(F.array(F.coalesce("text", F.lit("")))).alias("short"), answers.bounded(F.col("text"), 101).alias("ends"))


# Text search ---------------------------------------------------------------------------------------------------------

def _questions(events: DataFrame) -> DataFrame:
    """For every pool a count, a superlative and the edition before."""
    own = events.select("sport", F.col("year").cast("string").alias("y"), "season").distinct()
    key = F.concat_ws(":", "sport", "y", "season")
    ask = lambda tag, pattern: own.select(F.concat(F.lit(f"{tag}:"), key).alias("qid"), F.format_string(pattern, "sport", "y", "season").alias("question"))
    return ask("count", "According to the provided corpus, how many %s events at the %s %s Olympics had more than 4 competitors?").unionByName(ask("top", "Which %s event at the %s %s Olympics had the most nations?")).unionByName(ask("prev", "Who won the %s final before the %s %s Olympics?"))


PLANS = ", own AS (SELECT DISTINCT sport, year::VARCHAR AS y, season FROM ev), tags AS (SELECT unnest(['count', 'top', 'prev']) AS tag)"


@query(ev("""SELECT tag || ':' || sport || ':' || y || ':' || season AS qid, CASE tag WHEN 'count' THEN 'set_count' WHEN 'top' THEN 'set_extreme' ELSE 'temporal' END AS intent, y AS years, lower(season) AS seasons, CASE WHEN tag = 'prev' THEN sport || ' final ' || lower(season) || ' olympics' ELSE sport END AS words,
CASE WHEN tag = 'prev' THEN sport || ' final ' || lower(season) || ' olympics ' || y ELSE sport || ' ' || y || ' ' || lower(season) || ' olympics' END AS title, 3::BIGINT AS n FROM own, tags""", PLANS))
def query_plans(spark, sf_dir) -> DataFrame:
    plans = lexical.plan_queries(_questions(event_view(spark, sf_dir)))
    return plans.select("qid", "intent", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), F.array_join("seasons", ",").alias("seasons"), F.array_join("sport_tokens", " ").alias("words"), F.get("variants", F.lit(1)).alias("title"), F.size("variants").cast("long").alias("n"))


def _infoboxes(events: DataFrame) -> DataFrame:
    """Every event's page as one infobox chunk."""
    page = pages(events)
    none = F.lit(None).cast("string")
    return page.select(F.concat("doc_id", F.lit("::c000")).alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("title").alias("document_title"), F.lit(0).alias("chunk_index"), none.alias("section"), F.lit("infobox").alias("kind"), "text", F.concat_ws("\n", "title", "text").alias("indexed_text"), F.col("doc_id").alias("event_id"), none.alias("source_url"))


TITLES = ", titles AS (SELECT id::VARCHAR || '::c000' AS chunk_id, upper(left(sport, 1)) || substr(sport, 2) || ' at the ' || year::VARCHAR || ' ' || season || ' Olympics – ' || event_name AS title, sport, year::VARCHAR AS y FROM ev)"


@query(ev("SELECT tag || ':' || sport || ':' || y || ':' || season AS qid, chunk_id FROM own JOIN titles USING (sport, y), tags WHERE tag <> 'prev'", PLANS + TITLES))
def set_sweep(spark, sf_dir) -> DataFrame:
    """All infoboxes of every question for a set."""
    events = event_view(spark, sf_dir)
    # written, as questions and titles read them; a page has more columns, which nothing reads here
    page = files.stash(_infoboxes(events).select("chunk_id", "document_title"), "infoboxes")
    asked = files.stash(_questions(events), "questions")
    plans = files.stash(lexical.plan_queries(asked).where(textsearch.is_set()).select("qid", "years", "sport_tokens"), "plans")
    return textsearch.sweep(plans, page, None)


@query(ev("SELECT 'count:' || sport AS qid, chunk_id FROM (SELECT DISTINCT sport FROM ev) JOIN titles USING (sport) WHERE y = '1995' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY title, chunk_id) <= 64", TITLES))
def text_search(spark, sf_dir) -> DataFrame:
    """The whole search for a count of each sport; a sweep's hits don't depend on scores, so SQL can name them."""
    events = files.stash(event_view(spark, sf_dir), "events")
    asked = events.select("sport").distinct().select(F.concat(F.lit("count:"), "sport").alias("qid"), F.format_string("How many %s events at the 1995 Summer Olympics had more than 4 competitors?", "sport").alias("question"))
    return textsearch.search(asked, files.stash(_infoboxes(events), "infoboxes")).select("qid", "chunk_id")
