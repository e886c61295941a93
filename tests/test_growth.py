"""Queries over larger tables: the tasks of shuffles grow with the rows, and events are made once."""

import contextlib
import io
import re

import pytest

from lodestar.registry import oracle_sql, queries
from lodestar.sources import files
from tests.conftest import same_rows


def widths(df, keys: str) -> list[int]:
    """Partitions of the shuffles of a plan by these keys."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return [int(n) for by, n in re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\), [A-Z]", out.getvalue()) if re.search(rf"\b(?:{keys})#", by)]


@pytest.mark.parametrize("name, keys", [("chunks_for_events_cap", "event_id|l_orderkey"), ("previous_gold", "doc_id|qid|event_name"), ("evidence_graph_nodes", "qid|l_orderkey")])
def test_tasks_grow_with_rows(spark, sf, duck, monkeypatch, name, keys):
    monkeypatch.setattr(files, "ROWS_PER_TASK", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries()[name](spark, sf)
        # 1500 orders and 6000 lines; Spark's own number here is 4
        assert min(widths(df, keys)) > 4
        same_rows(df, duck.execute(oracle_sql()[name]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["result_evidence", "question_coverage", "text_search", "graph_upsert", "investigation"])
def test_events_are_made_once(spark, sf, duck, monkeypatch, name):
    """The query's own plan reads what was written, not the tables of which events are made."""
    df = queries()[name](spark, sf)
    assert not any(f.endswith("/orders.parquet") for f in df.inputFiles())
    same_rows(df, duck.execute(oracle_sql()[name]))


def test_sweep_keeps_every_infobox(spark):
    """At sf0.01 each question for a set finds some 400 infoboxes."""
    import duckdb

    large = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("orders", "customer", "nation", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{large}/{name}.parquet'")
    df = queries()["set_sweep"](spark, large)
    assert df.groupBy("qid").count().agg({"count": "min"}).head()[0] > 64
    same_rows(df, con.execute(oracle_sql()["set_sweep"]))


def test_families_without_questions_take_no_part(spark, sf):
    """Events don't meet questions of editions and venues that nobody asks; a mixed table has the same rows."""
    from lodestar.functions import questions
    from lodestar.operators import contract
    from lodestar.plans import answers
    from lodestar.queries.corpus import SPORTS, _canonical
    from lodestar.sources.tables import event_view

    events = files.stash(_canonical(event_view(spark, sf)), "canonical")
    nations = [(f"n{i}", f"What's the nation count for Order {i}?") for i in (1, 2, 10**6)]
    more = [("e", "Who won gold in the x building event at the Summer Olympics held before 1996?"), ("v", "Who won gold at NATION_3 on 7 May at the 1995 Summer Olympics?")]
    solved = []
    for rows in (nations, nations + more):
        steps = answers.Steps(files.stash(questions.parse_questions(spark.createDataFrame(rows, "qid string, question string"), SPORTS), "parsed"), events)
        plan = steps.outcomes()
        assert ("edition-rows" in str(plan.inputFiles())) == ("venue-asked" in str(plan.inputFiles())) == (len(rows) > 3)
        found = contract.matched(steps.parsed, events, steps).where("qid like 'n%'").select("qid", "id").collect()
        solved.append((sorted(map(str, plan.where("qid like 'n%'").collect())), sorted(found)))
    assert solved[0] == solved[1] and len(solved[0][0]) == 3 and [r.id for r in solved[0][1]] == [1, 2]
