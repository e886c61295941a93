"""Queries of the graph contract, investigations, exports, embeddings and diagnostics, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import names, questions
from lodestar.operators import contract, diagnostics, embeddings, graph, ingest, scoring
from lodestar.plans import answers
from lodestar.plans.investigate import Retrieved
from lodestar.plans.investigate import investigate as run_rounds
from lodestar.queries.catalog import QUERIES, ev, query
from lodestar.queries.corpus import SPORTS, _canonical, asked, pages
from lodestar.sources import export, files
from lodestar.sources.tables import event_view, read_table

__all__ = ["QUERIES"]


def _parsed(events: DataFrame) -> DataFrame:
    return questions.parse_questions(asked(events), SPORTS)


def _written(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Parsed questions and events, both written once: every family of questions reads them."""
    events = files.stash(event_view(spark, sf_dir), "events")
    return files.stash(_parsed(events), "parsed"), files.stash(_canonical(events), "canonical")


KEY = "sport || ':' || year::VARCHAR || ':' || season"
POOLED = f""", pool AS (SELECT DISTINCT sport, year, season, {KEY} AS key FROM ev),
best AS (SELECT *, {KEY} AS key, max(competitors) OVER (PARTITION BY sport, year, season) AS top FROM ev)"""


@query(ev("""SELECT 'count:' || key AS qid, 'count_over_threshold' AS query_name, NULL::VARCHAR AS reason, 'season=' || season || ',sport=' || sport || ',threshold=4,year=' || year::VARCHAR AS params FROM pool
UNION ALL SELECT 'top:' || key, 'argmax_competitors', NULL, 'season=' || season || ',sport=' || sport || ',year=' || year::VARCHAR FROM pool
UNION ALL SELECT 'nations:' || id::VARCHAR, 'lookup_event', NULL, 'title=' || title || ',title_folded=' || lower(title) FROM ev""", POOLED))
def bound_parameters(spark, sf_dir) -> DataFrame:
    rows = contract.bound(_parsed(event_view(spark, sf_dir)))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("qid", "query_name", "reason", listed.alias("params"))


@query(ev("""SELECT operation, reason, count(*) AS n FROM (SELECT 'lookup_nations' AS operation, CASE WHEN id % 4 = 0 THEN 'missing_event_title' END AS reason FROM ev UNION ALL SELECT 'argmax_competitors', CASE WHEN id % 4 < 2 THEN 'missing_sport_games_args' END FROM ev
UNION ALL SELECT 'unknown', 'question_template_unparsed' FROM ev UNION ALL SELECT 'next_event_gold', CASE WHEN id % 4 = 1 THEN 'missing_temporal_args' WHEN id % 4 = 0 THEN 'missing_event_name' END FROM ev
UNION ALL SELECT 'events_at_venue_date', CASE WHEN id % 4 = 2 THEN 'missing_venue_date_args' END FROM ev) GROUP BY ALL"""))
def spec_validation(spark, sf_dir) -> DataFrame:
    """Every event asked about in five ways, with arguments left out by its id."""
    n = F.col("id") % 4
    rows = event_view(spark, sf_dir).withColumn("operation", F.explode(F.array(*[F.lit(o) for o in ("lookup_nations", "argmax_competitors", "unknown", "next_event_gold", "events_at_venue_date")])))
    given = lambda test, value: F.when(test, value)
    rows = rows.select("operation", F.lit(True).alias("matched_template"), given(n != 0, F.col("title")).alias("event_title"), "sport", given(n != 0, F.col("year")).alias("year"), given(n != 1, F.col("season")).alias("season"), given(n != 1, F.col("year")).alias("named_year"), given(n != 0, F.col("event_name")).alias("event_name"), F.lit(" ").alias("event_desc"), given(n != 2, F.col("venue")).alias("venue"), F.lit("May").alias("date_text"))
    return rows.select("operation", contract.invalid().alias("reason")).groupBy("operation", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(ev("""SELECT qid, 'c:entity:' || id::VARCHAR AS evidence_id, 'entity' AS evidence_type, title AS value, 'gsql:' || op AS retrieval_method FROM (
 SELECT 'count:' || key AS qid, id, title, 'count_over_threshold' AS op FROM best WHERE competitors > 4 UNION ALL SELECT 'top:' || key, id, title, 'argmax_competitors' FROM best WHERE competitors = top UNION ALL SELECT 'nations:' || id::VARCHAR, id, title, 'lookup_event' FROM ev)
UNION ALL SELECT 'nations:' || id::VARCHAR, 'c:fact:nations:' || id::VARCHAR, 'fact', nations::VARCHAR, 'gsql:lookup_event' FROM ev WHERE nations IS NOT NULL
UNION ALL SELECT 'top:' || key, 'c:fact:competitors:' || min(id)::VARCHAR, 'fact', min(top)::VARCHAR, 'gsql:argmax_competitors' FROM best WHERE competitors = top GROUP BY key HAVING count(*) = 1
UNION ALL SELECT 'count:' || key, 'c:fact:count', 'fact', (count(*) FILTER (competitors > 4))::VARCHAR, 'gsql:count_over_threshold' FROM best GROUP BY key""", POOLED))
def result_evidence(spark, sf_dir) -> DataFrame:
    parsed, events = _written(spark, sf_dir)
    steps = answers.Steps(parsed, events)
    items = contract.evidence(files.stash(steps.outcomes(), "outcomes"), contract.matched(parsed, events, steps), "c")
    return items.select("qid", "evidence_id", "evidence_type", "value", "retrieval_method")


@query(ev("SELECT id::VARCHAR AS event_id, 'n:edge:IN_GAMES:' || year::VARCHAR || '_' || season AS evidence_id, 'd' || id::VARCHAR AS document_id, CASE WHEN n > 0 THEN id::VARCHAR || '::' || n::VARCHAR END AS source_chunk_id FROM (SELECT id, year, season, (SELECT max(l_linenumber) FROM lineitem WHERE l_orderkey = id) AS n FROM ev) WHERE n IS NOT NULL"))
def neighbourhood_evidence(spark, sf_dir) -> DataFrame:
    """The Games of every event as evidence, with the event's last chunk."""
    events = event_view(spark, sf_dir)
    key = F.col("l_orderkey").cast("string")
    chunks = read_table(spark, sf_dir, "lineitem").select(key.alias("event_id"), F.concat(F.lit("d"), key).alias("document_id"), F.concat_ws("::", key, F.col("l_linenumber").cast("string")).alias("chunk_id"), F.col("l_linenumber").alias("ord"))
    items = contract.neighbourhood_evidence(graph.neighborhood(events).where("relation = 'IN_GAMES'").withColumnRenamed("tgt", "target"), "n")
    return contract.attach_chunks(items, chunks).where("source_chunk_id is not null").select("event_id", "evidence_id", "document_id", "source_chunk_id")


@query("SELECT user_id AS qid, event_type AS evidence_id, min(step) AS step, count(*) OVER (PARTITION BY user_id) AS ids FROM (SELECT user_id, event_type, event_id % 4 AS step FROM events) GROUP BY user_id, event_type")
def merged_retrievals(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("evidence_id"), (F.col("event_id") % 4).alias("step"))
    merged = contract.merged(rows)
    return merged.join(merged.groupBy("qid").agg(F.count(F.lit(1)).alias("ids")), "qid").select("qid", "evidence_id", "step", "ids")


OBSERVED = """WITH o AS (SELECT conv_id AS qid, lpad(turn::VARCHAR, 6, '0') AS evidence_id, coalesce(text, '') AS t FROM conversations),
p AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY qid) AS n, coalesce(sum(length(t)) OVER (PARTITION BY qid ORDER BY evidence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o WINDOW w AS (PARTITION BY qid ORDER BY evidence_id))"""


@query(OBSERVED + " SELECT qid, evidence_id, length(t) > greatest(300 - before, 0) OR n > 5 AS truncated, least(length(t), greatest(300 - before, 0))::BIGINT AS chars FROM p WHERE i <= 5")
def observation_budget(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("evidence_id"), F.lit("chunk").alias("evidence_type"), F.coalesce("text", F.lit("")).alias("value"), F.lit(False).alias("complete_set"))
    return contract.observed(rows, 300, 5).select("qid", "evidence_id", "truncated", F.char_length("value").cast("long").alias("chars"))


@query(ev("""SELECT id AS qid, CASE WHEN id % 5 = 0 THEN 'unresolved' WHEN nations IS NULL THEN 'unresolved' WHEN id % 7 = 0 THEN 'ambiguous' ELSE 'answered' END AS stop_reason,
CASE WHEN id % 5 = 0 THEN 0 WHEN nations IS NULL THEN 1 WHEN id % 7 = 0 THEN 2 WHEN id % 2 = 0 THEN 3 ELSE 1 END AS tool_calls, CASE WHEN id % 5 = 0 OR nations IS NULL THEN 0 WHEN id % 7 = 0 OR id % 2 = 0 THEN 1 ELSE 0 END AS followups FROM ev"""))
def investigation(spark, sf_dir) -> DataFrame:
    """Every event asked for its nations: some unparsed, some by two hops, some with two candidates."""
    # written, as every tool reads them in every round
    events = files.stash(event_view(spark, sf_dir).withColumn("qid", F.col("id")), "events")
    status = F.when(F.col("nations").isNull(), "unresolved").when(F.col("id") % 7 == 0, "ambiguous").otherwise("supported")
    none = F.lit(None).cast("string")
    item = lambda tag, kind, event, field, value, method: F.struct(F.concat(F.lit(tag), event).alias("evidence_id"), F.lit(kind).alias("evidence_type"), event.alias("event_id"), F.lit(field).alias("field_name"), value.alias("value"), F.lit(method).alias("retrieval_method"))
    own, other, nations = F.col("id").cast("string"), (F.col("id") + 1).cast("string"), F.col("nations").cast("string")
    primary = F.array_compact(F.array(item("entity:", "entity", own, "title", F.col("title"), "lookup"), F.when(F.col("id") % 7 == 0, item("entity:", "entity", other, "title", F.col("title"), "lookup")), F.when(status == "supported", item("fact:", "fact", own, "nations", nations, "lookup"))))

    def retrieve(asks):
        rows = events.join(asks, "qid")
        return Retrieved(rows.select("qid", status.alias("status"), none.alias("error")), rows.select("qid", F.inline(primary)))

    edges = graph.neighborhood(events).select(F.col("event_id").cast("string").alias("event_id"), "relation", "tgt")
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("event_id"), F.concat_ws("::", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk"), "l_returnflag")

    def found(asks, rows):
        return Retrieved(rows.select("qid", F.lit("supported").alias("status"), none.alias("error")).distinct(), rows)

    hop = lambda asks: found(asks, asks.join(edges, "event_id").select("qid", F.concat("relation", F.lit(":"), "tgt").alias("evidence_id"), F.lit("edge").alias("evidence_type"), "event_id", F.col("relation").alias("field_name"), F.col("tgt").alias("value"), F.lit("hop").alias("retrieval_method")))
    texts = lambda asks: found(asks, asks.join(lines, "event_id").select("qid", F.concat(F.lit("chunk:"), "chunk").alias("evidence_id"), F.lit("chunk").alias("evidence_type"), "event_id", F.lit("text").alias("field_name"), F.col("l_returnflag").alias("value"), F.lit("chunks").alias("retrieval_method")))
    asks = events.select("qid", F.when(F.col("id") % 2 == 0, "multi_hop").otherwise("lookup").alias("qtype"), F.when(F.col("id") % 5 != 0, "parsed").otherwise("unresolved").alias("parse_status"))
    done = run_rounds(asks, {"retrieve_spec": retrieve, "event_neighborhood": hop, "supporting_chunks": texts})
    return done.questions.select("qid", "stop_reason", "tool_calls", "followups")


@query(ev("SELECT 'events' AS \"table\", count(*) AS n, true AS whole FROM ev UNION ALL SELECT 'games', count(DISTINCT (year, season)), true FROM ev UNION ALL SELECT 'held_at', count(venue), true FROM ev"))
def graph_export(spark, sf_dir) -> DataFrame:
    """Tables exported, loaded again with types, and compared with those that were sent."""
    events = event_view(spark, sf_dir)
    tables = {"events": events.select("id", "title", "sport", "year", "season", "competitors", F.col("competitors").isNotNull().alias("has_competitors")), "games": graph.dim_games(events), "held_at": graph.edge_held_at(events)}
    path = files.scratch(spark, "export")
    accounts = export.export(tables, path)
    loaded = export.load(spark, path)
    lost = export.reconciled(spark, path, loaded).withColumnRenamed("table", "lost")
    return accounts.join(lost, F.col("table") == F.col("lost"), "left").select("table", "n", F.col("lost").isNull().alias("whole"))


@query("SELECT doc_id::VARCHAR AS chunk_id, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS hit, length(coalesce(text, ''))::DOUBLE AS first FROM documents")
def embedding_cache(spark, sf_dir) -> DataFrame:
    """Every document's text looked up in a cache that has every other one, some of them made anew by another model."""
    chunks = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text")
    own = embeddings.digests(chunks).join(chunks.select("chunk_id", "doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("double").alias("size")), "chunk_id")
    vector = F.array("size", F.lit(1.0)).alias("vector")
    row = lambda seq, model: [F.col("chunk_id"), F.lit(seq).alias("seq"), F.col("digest").alias("text_sha256"), F.lit(model).alias("model"), F.lit(2).alias("dimension"), vector]
    cache = own.where("doc_id % 2 = 0").select(*row(1, "a")).unionByName(own.where("doc_id % 6 = 0").select(*row(2, "b")))
    found = embeddings.lookup(chunks, cache, "a", 2)
    return found.join(chunks.select("chunk_id", F.char_length(F.coalesce("text", F.lit(""))).cast("double").alias("size")), "chunk_id").select("chunk_id", F.col("vector").isNotNull().alias("hit"), F.coalesce(F.get("vector", F.lit(0)), "size").alias("first"))


@query(ev("SELECT count(*) AS total_documents, count(*) AS event_documents, 0::BIGINT AS document_only, count(*) AS with_infobox, count(*) AS event_titles, 0::BIGINT AS rejected_titles FROM ev"))
def corpus_counts(spark, sf_dir) -> DataFrame:
    return diagnostics.corpus_counts(ingest.parse_documents(pages(event_view(spark, sf_dir))))


@query(ev("SELECT field, count(*) AS n, count(*) FILTER (lost) AS missing, round_even(100.0::DOUBLE * count(*) FILTER (lost) / count(*), 1) AS rate FROM (SELECT unnest(['competitors', 'nations', 'prev_year', 'venue_raw', 'gold']) AS field, unnest([competitors IS NULL, nations IS NULL, true, venue IS NULL, gold IS NULL]) AS lost FROM ev) GROUP BY field"))
def missing_values(spark, sf_dir) -> DataFrame:
    parsed = ingest.parse_documents(pages(event_view(spark, sf_dir)), [*diagnostics.FIELDS, "medals"])
    # written, as counts read each field of an event
    rows = files.stash(parsed.select("event"), "parsed-events")
    return diagnostics.missing_values(rows).where(F.col("field").isin("competitors", "nations", "prev_year", "venue_raw", "gold"))


@query(ev("SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM prior p WHERE p.sport = e.sport AND p.season = e.season AND p.event_name = e.event_name AND p.year = CASE WHEN e.season = 'Winter' AND e.year = 1994 THEN 1992 WHEN e.season = 'Winter' AND e.year = 1992 THEN 1988 ELSE e.year - 4 END)) AS matched FROM ev e", ", prior AS (SELECT DISTINCT sport, season, event_name, year FROM ev)"))
def previous_matchable(spark, sf_dir) -> DataFrame:
    return diagnostics.matchable(event_view(spark, sf_dir)).select("n", "matched")


@query(ev("""SELECT qtype, grouping(qtype)::INT AS overall, count(*) AS n, count(*) FILTER (s = 'supported') AS supported, count(*) FILTER (s = 'partial') AS partial, count(*) FILTER (s = 'unsupported') AS unsupported FROM (
SELECT 'count' AS qtype, 'supported' AS s FROM pool UNION ALL SELECT 'nations', CASE WHEN nations IS NULL THEN 'partial' ELSE 'supported' END FROM ev
UNION ALL SELECT 'top', CASE WHEN count(*) FILTER (competitors = top) = 1 THEN 'supported' ELSE 'partial' END FROM best GROUP BY key) GROUP BY GROUPING SETS ((), (qtype))""", POOLED))
def question_coverage(spark, sf_dir) -> DataFrame:
    solved = answers.solve(*_written(spark, sf_dir)).withColumn("qtype", F.split_part("qid", F.lit(":"), F.lit(1)))
    return diagnostics.question_coverage(solved).drop("supported_pct")


@query(ev("SELECT count(*) AS n, count(*) FILTER (id % 3 = 0 OR nations IS NULL) AS mismatched FROM ev"))
def solver_equivalence(spark, sf_dir) -> DataFrame:
    """Two solvers' outcomes of every event, one of which errs on every third count and on unknown nations."""
    rows = event_view(spark, sf_dir)
    outcome = lambda status, count: rows.select(F.col("id").alias("qid"), status.alias("status"), F.lit("").alias("reason"), F.array(F.col("id").cast("string")).alias("event_ids"), count.alias("count"), F.col("year").alias("target_year"))
    left = outcome(F.lit("supported"), F.col("id"))
    right = outcome(F.when(F.col("nations").isNull(), "unresolved").otherwise("supported"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")))
    return scoring.equivalence(scoring.compared(left, right))


@query("SELECT o_orderkey, '|' || o_orderkey::VARCHAR || '|x|' AS packed, o_orderkey % 2 = 0 OR year(o_orderdate) = 1995 AS overlap FROM orders")
def packed_id_lists(spark, sf_dir) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    asked_years = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("|1995|")
    return orders.select("o_orderkey", contract.packed_ids(F.array(key, F.lit("x"), key, F.lit(" "))).alias("packed"), contract.packed_overlap(names.packed_ints(F.array(F.year("o_orderdate"))), asked_years).alias("overlap"))


@query("SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS chunk_id, unnest(list_value(o_orderstatus, NULL)) AS kind FROM orders")
def rows_of_lists(spark, sf_dir) -> DataFrame:
    """Parallel lists of two lengths made rows."""
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", F.split("o_orderpriority", "-").alias("ids"), F.array(F.col("o_orderstatus")).alias("kinds"))
    return contract.rows_of_lists(rows, {"chunk_id": "ids", "kind": "kinds"})
