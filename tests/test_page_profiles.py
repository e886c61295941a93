"""Profiles of pages make only the fields that they read, and read the tables once."""

import pytest
from conftest import same_rows

import __spark_entry__ as entry
from lodestar.operators import diagnostics, ingest
from lodestar.queries.corpus import pages
from lodestar.sources.tables import event_view


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["parse_infobox", "corpus_counts", "missing_values"])
def test_same_as_sql(spark, sf, duck, name):
    same_rows(entry.queries()[name](spark, sf), duck.execute(entry.oracle_sql()[name]))


def test_only_asked_fields_are_made(spark, sf):
    records = pages(event_view(spark, sf))
    slim = ingest.parse_documents(records, ingest.SOLVER_FIELDS)
    assert slim.schema["event"].dataType.names == [f for f in ingest.parse_documents(records).schema["event"].dataType.names if f in ingest.SOLVER_FIELDS]


def test_counts_make_no_events(spark, sf):
    text = plan(diagnostics.corpus_counts(ingest.parse_documents(pages(event_view(spark, sf)))))
    assert "lambda" not in text


def test_pages_are_parsed_once(spark, sf):
    text = plan(entry.queries()["parse_infobox"](spark, sf))
    assert text.count("Relation ") == plan(event_view(spark, sf)).count("Relation ")
