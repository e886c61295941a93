"""Scores of answering systems: one row for each question and system, and summaries by any grouping.

results has qid, system_name, status, answer, citations (array of evidence ids),
evidence (array of struct evidence_id, event_id, document_id), errors, latency_ms,
event_ids, cardinality, complete_set, truncated_set, tool_calls, followups,
stop_reason, methods, model_calls, tokens, tokens_unknown and failure_class.
gold has qid, qtype, answer (array) and gold_doc_ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import answers
from lodestar.operators.evaluation import failure_category

# Statuses without an answer, those of failures, those of abstention, and the order in which systems are listed.
SUPPRESSED = ["ambiguous", "not_found", "unresolved", "unsupported", "abstained", "invalid_citations", "generation_error", "error", "not_implemented"]
ERRORS = ["error", "generation_error", "invalid_citations", "not_implemented"]
ABSTAINED = ["abstained", "not_found", "unresolved", "unsupported"]
SYSTEMS = ["rag", "graphrag", "agentic_graphrag"]
# Reasons that lie in the data rather than in the solver.
DATA_REASONS = ["previous_event_name_missing", "next_event_name_missing", "related_year_unresolved", "no_sport_games_events", "venue_not_found", "date_does_not_overlap"]


def rate(part: Column, whole: Column) -> Column:
    """Percentage to one decimal; NULL without a whole."""
    return F.when(whole > 0, F.bround(F.lit(100.0) * part / whole, 1))


def mean(value: Column) -> Column:
    return F.bround(F.avg(value.cast("double")), 3)


def grounding(status: Column, suppressed: Column, valid: Column, cited: Column) -> Column:
    """holds and why: failures are not grounded, abstentions are."""
    case = lambda holds, why: F.struct(F.lit(holds).cast("boolean").alias("holds"), F.lit(why).alias("why"))
    failed = status.isin("error", "generation_error", "not_implemented")
    return F.when(failed, case(False, "system_failure")).when(suppressed, case(True, "faithful_abstention")).when(valid & cited, case(True, "cited_retrieved_evidence")).when(~valid, case(False, "citation_invalid")).otherwise(case(None, "semantic_grounding_not_evaluated"))


def completeness(system: Column, qtype: Column, cardinality: Column, complete: Column, truncated: Column) -> Column:
    """holds and why: whether a set was kept whole, where a question asks for one."""
    case = lambda holds, why: F.struct(F.lit(holds).cast("boolean").alias("holds"), F.lit(why).alias("why"))
    cut, whole, sets = F.coalesce(truncated, F.lit(False)), (cardinality == "complete_set") | F.coalesce(complete, F.lit(False)), qtype == "aggregation"
    ladder = F.when(system == "rag", case(None, "rag_top_k_has_no_complete_set_semantics")).when(sets & cut, case(False, "complete_set_truncated"))
    return ladder.when(sets & whole, case(True, "complete_set_preserved")).when(sets, case(False, "complete_set_not_marked")).when(cut, case(False, "set_truncated")).otherwise(case(None, "complete_set_not_required"))


def score(results: DataFrame, gold: DataFrame) -> DataFrame:
    """results with qtype, expected and: correct, correct_exact, suppressed, citations_valid, grounded, grounding_why, complete, completeness_why, doc_recall, failure.

    A result without a gold row has no expected answer and is not correct. NULL lists are empty.
    """
    none, no_evidence = F.expr(answers.NONE), F.expr("cast(array() as array<struct<evidence_id:string,event_id:string,document_id:string>>)")
    asked = gold.select("qid", "qtype", F.col("answer").alias("expected"), "gold_doc_ids")
    lists = {c: F.coalesce(c, none) for c in ("citations", "errors", "event_ids", "methods")}
    rows = results.join(asked, "qid", "left").withColumns(lists | {"evidence": F.coalesce("evidence", no_evidence), "answer": F.coalesce("answer", F.lit(""))})
    says = F.trim("answer") != ""
    rows = rows.withColumns({"correct_exact": says & answers.match_exact(F.array("answer"), F.col("expected")), "correct": says & answers.match_normal(F.array("answer"), F.col("expected")), "suppressed": ~says | F.col("status").isin(SUPPRESSED)})
    known = F.filter(F.transform("evidence", lambda e: e["evidence_id"]), lambda i: i.isNotNull() & (i != ""))
    broken = F.col("status").isin(ERRORS) | F.exists("errors", lambda e: e.startswith("orphan_citation") | (e == "missing_citations"))
    cited = F.size("citations") > 0
    valid = ~broken & (~says | cited) & (F.size(F.array_except("citations", known)) == 0)
    got = F.array_union("event_ids", F.filter(F.flatten(F.transform("evidence", lambda e: F.array(e["event_id"], e["document_id"]))), lambda i: i.isNotNull()))
    rows = rows.withColumn("citations_valid", valid).withColumns(
        {
            "g": grounding(F.col("status"), F.col("suppressed"), F.col("citations_valid"), cited),
            "c": completeness(F.col("system_name"), F.col("qtype"), F.col("cardinality"), F.col("complete_set"), F.col("truncated_set")),
            "doc_recall": F.when(F.size("gold_doc_ids") > 0, F.size(F.filter("gold_doc_ids", lambda d: F.array_contains(got, d))) / F.size("gold_doc_ids")),
            "failure": failure_category(F.col("status"), F.col("correct"), F.col("suppressed"), F.col("errors"), F.col("qtype")),
        }
    )
    out = rows.withColumns({"grounded": F.col("g.holds"), "grounding_why": F.col("g.why"), "complete": F.col("c.holds"), "completeness_why": F.col("c.why")})
    return out.drop("g", "c", "gold_doc_ids")


def nearest_rank_of(value: Column, percent: float) -> Column:
    """The value at place round-half-even(percent / 100 * (n - 1)) of a group, as an aggregate over counted values."""
    counted = F.array_sort(F.collect_list(value))
    place = F.bround(F.lit(percent / 100.0) * (F.size(counted) - 1), 0).cast("int")
    return F.bround(F.get(counted, place), 3)


def statistics() -> list[Column]:
    """Aggregates of scored rows, for any grouping."""
    n, true = F.count(F.lit(1)), lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return [
        n.alias("n"),
        rate(true("correct"), n).alias("correctness"),
        rate(true("correct_exact"), n).alias("correctness_exact"),
        rate(true("complete"), F.count("complete")).alias("completeness"),
        F.count("complete").alias("completeness_n"),
        rate(true("grounded"), F.count("grounded")).alias("grounding"),
        rate(true("citations_valid"), n).alias("citation_validity"),
        F.count_if(F.col("status").isin(ERRORS)).alias("system_errors"),
        true("suppressed").alias("answer_suppressed"),
        mean(F.col("latency_ms")).alias("latency_avg_ms"),
        F.bround(F.max("latency_ms"), 3).alias("latency_max_ms"),
        mean(F.col("doc_recall")).alias("doc_recall_avg"),
        mean(F.col("tool_calls")).alias("tool_calls_avg"),
        mean(F.col("followups")).alias("followups_avg"),
    ]


def summarize(scored: DataFrame) -> DataFrame:
    """Statistics of every system, over all questions (qtype NULL, overall 1) and by type."""
    return scored.groupingSets([["system_name"], ["qtype", "system_name"]], "qtype", "system_name").agg(F.grouping("qtype").cast("int").alias("overall"), *statistics())


def counted(scored: DataFrame, by: list[str], column: str) -> DataFrame:
    """How often each value of a column occurs by group; NULLs aren't counted."""
    return scored.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))


def behaviour(scored: DataFrame) -> DataFrame:
    """How the adaptive system worked, overall (qtype NULL) and by type."""
    used = lambda *names: F.count_if(F.exists("methods", lambda m: reduce(Column.__or__, [F.contains(m, F.lit(n)) for n in names])))
    rows = scored.where("system_name = 'agentic_graphrag'").groupingSets([[], ["qtype"]], "qtype")
    return rows.agg(
        F.grouping("qtype").cast("int").alias("overall"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("tool_calls") == 1).alias("one_tool_call"),
        F.count_if(F.col("followups") > 0).alias("followups"),
        used("event_neighborhood").alias("used_neighborhood"),
        used("previous_event_gold", "next_event_gold").alias("used_temporal"),
        F.count_if(F.col("cardinality") == "complete_set").alias("complete_set"),
        F.count_if(F.col("truncated_set")).alias("truncated_set"),
        F.count_if(F.col("stop_reason") == "no_progress").alias("no_progress"),
        F.count_if(F.col("stop_reason") == "budget_exhausted").alias("budget_exhausted"),
        mean(F.col("tool_calls")).alias("tool_calls_avg"),
    ).where("n > 0")


def reliability(scored: DataFrame) -> DataFrame:
    return scored.groupBy("system_name").agg(
        F.count_if(F.col("status") == "generation_error").alias("generation_errors"),
        F.count("failure_class").alias("failure_classes"),
        F.count_if(F.col("tokens_unknown")).alias("tokens_unknown"),
        F.count_if(F.col("model_calls") > 1).alias("retried"),
        F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens_total"),
        F.sum(F.coalesce("model_calls", F.lit(0))).alias("model_calls_total"),
    )


def failures(scored: DataFrame, order: list[str], limit: int = 80) -> DataFrame:
    """A report's first rows that aren't right, shortened."""
    wrong = scored.where(~F.col("correct") | F.col("failure").isNotNull()).orderBy(*order).limit(limit)
    return wrong.select("qid", "qtype", "system_name", answers.shortened(F.col("expected")).alias("expected"), answers.shortened(F.array("answer")).alias("predicted"), "status", "failure", "failure_class", "stop_reason")


def variants(scored: DataFrame) -> DataFrame:
    """Statistics by variant, over all rows (family NULL) and by family: the question's type, and the buckets of ambiguous and abstaining answers, so that a row may be in two."""
    bucket = F.when(F.col("status") == "ambiguous", "ambiguity").when(F.col("status").isin(ABSTAINED), "abstention")
    families = F.array_compact(F.array(F.col("qtype"), bucket))
    rows = scored.withColumn("family", F.explode(F.concat(F.array(F.lit(None).cast("string")), families)))
    n, recalled = F.count(F.lit(1)), lambda c: rate(F.count_if(F.coalesce(F.col(c), F.lit(False))), F.count(F.lit(1)))
    more = [F.count_if(F.col("status").isin(ABSTAINED)).alias("abstentions"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.count_if(F.col("status") == "not_found").alias("not_found"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens_total")]
    ranks = [nearest_rank_of(F.col("latency_ms"), p).alias(f"latency_p{p}_ms") for p in (50, 95)]
    return rows.groupBy("variant", "family").agg(n.alias("n"), recalled("correct").alias("correctness"), recalled("correct_exact").alias("correctness_exact"), recalled("citations_valid").alias("citation_validity"), recalled("recall_at_5").alias("recall_at_5"), recalled("recall_at_10").alias("recall_at_10"), *more, *ranks)


def deltas(stats: DataFrame, baseline: str = "V0") -> DataFrame:
    """What each variant's numbers differ from the baseline's of the same family; NULL where either has none."""
    values = [c for c, kind in stats.dtypes if c not in ("variant", "family") and kind != "string"]
    base = stats.where(F.col("variant") == baseline).select(F.col("family").alias("b_family"), *[F.col(c).alias(f"b_{c}") for c in values])
    rows = stats.where(F.col("variant") != baseline).join(base, F.col("family").eqNullSafe(F.col("b_family")))
    return rows.select("variant", "family", *[F.bround(F.col(c).cast("double") - F.col(f"b_{c}"), 3).alias(c) for c in values])


def family_moves(stats: DataFrame, baseline: str = "V0", step: float = 0.1) -> DataFrame:
    """Families whose best other variant gains a step or more of correctness on the baseline, or loses it."""
    base = stats.where((F.col("variant") == baseline) & F.col("family").isNotNull()).select("family", F.col("correctness").alias("base"))
    best = stats.where((F.col("variant") != baseline) & F.col("family").isNotNull()).groupBy("family").agg(F.max("correctness").alias("best"))
    moved = base.join(best, "family").withColumn("gain", F.bround(F.col("best") - F.col("base"), 3))
    return moved.select("family", "gain", F.when(F.col("gain") >= step, "benefit").when(F.col("gain") <= -step, "regress").otherwise("same").alias("move"))


def fairness(rows: DataFrame) -> DataFrame:
    """Per variant whether any row used graph operations, vectors or word search, or lacks either list. rows has variant, graph_operations, backend, backends."""
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    lists = F.coalesce("backends", F.expr(answers.NONE))
    return rows.groupBy("variant").agg(
        some(F.coalesce(F.size("graph_operations"), F.lit(0)) > 0).alias("graph_operations"),
        some(F.contains(F.coalesce("backend", F.lit("")), F.lit("vector"))).alias("used_vector"),
        some((F.col("backend") == "bm25") | F.array_contains(lists, "bm25")).alias("used_bm25"),
        some((F.size(lists) > 0) & ~F.array_contains(lists, "bm25")).alias("missing_bm25"),
        some(~F.exists(lists, lambda b: F.contains(b, F.lit("vector")))).alias("missing_vector"),
    )


def limitation(status: Column, reason: Column, exact: Column, gold_found: Column, noted: Column) -> Column:
    """Whether the data or the solver keeps a question from its answer; NULL for right ones."""
    in_data = (noted == "data") | reason.startswith("missing_field")
    ladder = F.when(exact, None).when(F.coalesce(in_data, F.lit(False)), "data").when((status == "ambiguous") & gold_found, "data")
    return ladder.when(status.isin("unresolved", "not_found") & reason.isin(DATA_REASONS), "data").otherwise("solver")


def by_type(rows: DataFrame) -> DataFrame:
    """Solved, unresolved, ambiguous and not found questions of each type and overall (qtype NULL), with accuracies. rows has qtype, status, exact, normalized, elapsed_ms."""
    n, is_status = F.count(F.lit(1)), lambda s: F.count_if(F.col("status") == s)
    return rows.groupingSets([[], ["qtype"]], "qtype").agg(
        F.grouping("qtype").cast("int").alias("overall"), n.alias("n"), is_status("supported").alias("solved"), is_status("unresolved").alias("unresolved"), is_status("ambiguous").alias("ambiguous"),
        is_status("not_found").alias("not_found"), rate(F.count_if("exact"), n).alias("exact_accuracy"), rate(F.count_if("normalized"), n).alias("normalized_accuracy"), mean(F.col("elapsed_ms")).alias("avg_ms"), F.bround(F.max("elapsed_ms"), 3).alias("max_ms"),
    )


def three_way(results: DataFrame, gold: DataFrame, systems: list[str] = SYSTEMS) -> DataFrame:
    """Scored rows of every question and system; a system that gave no result for a question gets an error row, and one that isn't known an error."""
    every = gold.select("qid").crossJoin(F.broadcast(gold.sparkSession.createDataFrame([(s,) for s in systems], "system_name string")))
    rows = every.join(results, ["qid", "system_name"], "left")
    lost = F.col("status").isNull()
    known = F.col("system_name").isin(SYSTEMS)
    error = F.when(~known, "unknown_system").when(lost, "system_error:no_result")
    rows = rows.withColumn("errors", F.when(error.isNotNull(), F.array_append(F.coalesce("errors", F.expr(answers.NONE)), error)).otherwise(F.col("errors"))).withColumn("status", F.when(error.isNotNull(), "error").otherwise(F.col("status")))
    return score(rows, gold)


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two solvers' outcomes (qid, status, reason, event_ids, count, target_year) of each question: mismatches names the parts that differ, event ids in any order."""
    other = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns if c != "qid"})
    parts = {
        "status": ~F.col("status").eqNullSafe(F.col("r_status")),
        "reason": ~F.nullif(F.col("reason"), F.lit("")).eqNullSafe(F.nullif(F.col("r_reason"), F.lit(""))),
        "event_ids": F.array_sort(F.coalesce("event_ids", F.expr(answers.NONE))) != F.array_sort(F.coalesce("r_event_ids", F.expr(answers.NONE))),
        "count": ~F.col("count").eqNullSafe(F.col("r_count")),
        "target_year": F.col("target_year").isNotNull() & F.col("r_target_year").isNotNull() & (F.col("target_year") != F.col("r_target_year")),
    }
    return left.join(other, "qid").select("qid", F.array_compact(F.array(*[F.when(test, name) for name, test in parts.items()])).alias("mismatches"))


def equivalence(compared_rows: DataFrame) -> DataFrame:
    return compared_rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("mismatches") > 0).alias("mismatched"))


def ranked(scored: DataFrame) -> DataFrame:
    """Rows in a report's order: by question, then systems as they are listed, others by name."""
    place = F.array_position(F.array(*[F.lit(s) for s in SYSTEMS]), F.col("system_name"))
    order = [F.when(place > 0, place).otherwise(len(SYSTEMS) + 1), "system_name"]
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
