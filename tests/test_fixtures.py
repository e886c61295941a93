"""Small pages, questions and files with the results that are known for them."""

import pytest
from lodestar.functions import calendar, questions
from lodestar.operators import chunks, evidence, ingest
from lodestar.plans import answers
from lodestar.sources import files
from pyspark.sql import functions as F

BOX = "[Infobox Olympic event]\n{}\n\nThe event was held.\n"


def page(doc_id, title, tail="", **fields):
    return (doc_id, title, (BOX.format("\n".join(f"  {k}: {v}" for k, v in fields.items())) + tail) if fields else tail)


PAGES = [
    page("Q1", "Canoeing at the 2012 Summer Olympics – Men's K-2 1000 metres", games="2012 Summer", venue="Eton Dorney", date="6 to 8 August", competitors="24", nations="12", gold="Rudolf Dombi", goldNOC="HUN", prev="2008", next="2016"),
    page("Q2", "Sailing at the 1988 Summer Olympics – Women's 470", games="1984 Summer", venue="Busan", dates="20–27 September", competitors="42 (21 boats)", nations="unknown", gold="Allison Jolly", goldNOC="USA"),
    page("Q3", "Cycling at the 2000 Summer Olympics – Women's individual pursuit", tail="Results of the event.\n\nMedalists\n"),
    page("Q4", "1994 Winter Olympics", games="2010 Winter", event="Moguls"),
    page("Q5", "Forrest Gump", tail="A film.\r\n\r\nPlot\r\nThe film follows someone."),
    page("Q6", "Athletics at the 2012 Summer Olympics – Men's pole vault", date="8 and 10 August", venue="Olympic Stadium", competitors="32", gold="Renaud Lavillenie", next="2016"),
    page("Q7", "Athletics at the 2016 Summer Olympics – Men's pole vault", date="13–15 August", venue="Estádio Olímpico", competitors="32", gold="Thiago Braz", prev="2012"),
    page("Q8", "Judo at the 2016 Summer Olympics – Women's 57 kg", date="8 August", venue="Carioca Arena 2", competitors="23", nations="23", gold="Rafaela Silva"),
    page("Q9", "Judo at the 2016 Summer Olympics – Women's 52 kg", date="7 August", venue="Carioca Arena 2", competitors="23", nations="20", gold="Majlinda Kelmendi"),
    (None, None, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    return ingest.parse_documents(spark.createDataFrame(PAGES, "doc_id string, title string, text string")).cache()


def test_parsed_pages(parsed):
    rows = {r.doc_id: r for r in parsed.collect()}
    one = rows["Q1"].event
    assert (one.sport, one.year, one.season, one.competitors, one.nations, one.prev_year, one.next_year, one.games_id) == ("canoeing", 2012, "Summer", 24, 12, 2008, 2016, "2012_Summer")
    assert (one.date.years, one.date.months, one.date.days) == ([2012], [8], [6, 7, 8])
    assert [(m.place, m.name_raw, m.noc) for m in one.medals] == [("gold", "Rudolf Dombi", "HUN")]
    assert one.provenance["venue"].raw_text == "Eton Dorney" and one.flags == []
    two = rows["Q2"].event
    assert (two.year, two.year_source, two.competitors, two.nations) == (1988, "title_preferred", 42, None)
    assert two.flags == ["title_infobox_games_conflict", "malformed_nations", "competitors_has_extra_text", "missing_nations"]
    assert two.provenance["date"].field_name == "dates" and two.date.days == list(range(20, 28))
    assert rows["Q3"].event is None and rows["Q3"].rejection_reason == "olympic_title_without_infobox"
    assert (rows["Q4"].event.year, rows["Q4"].event.year_source) == (2010, "infobox") and "infobox_without_title_parse" in rows["Q4"].flags
    assert rows["Q5"].rejection_reason == rows[""].rejection_reason == "no_olympic_event_infobox"


def test_last_of_repeated_keys_and_end_of_box(spark):
    text = "Before.\n[infobox OLYMPIC event x]\n\tgold: no\n  gold: A\r\n  gold: B: C\n   : none\nrest\n  silver: S"
    (row,) = ingest.parse_documents(spark.createDataFrame([("d", "t", text)], "doc_id string, title string, text string")).collect()
    assert row.infobox == {}  # a single tab is no indent
    (row,) = ingest.parse_documents(spark.createDataFrame([("d", "t", text.replace("\tgold", "\t\tgold"))], "doc_id string, title string, text string")).collect()
    assert row.infobox == {"gold": "B: C"}


@pytest.mark.parametrize(
    ("raw", "years", "months", "days"),
    [("New Year's Day 1998", [1998], [1], [1]), ("30 to 2 Sept", [], [9], [30, 2]), ("9, 11–13 Feb 1960", [1960], [2], [11, 12, 13, 9]), ("TBA 45", [], [], []), (" ", None, None, None)],
)
def test_date_span(spark, raw, years, months, days):
    (row,) = spark.createDataFrame([(raw,)], "raw string").select(calendar.date_span(F.col("raw")).alias("d")).collect()
    assert (row.d and (row.d.years, row.d.months, row.d.days)) == (None if years is None else (years, months, days))


def test_chunks(parsed):
    rows = chunks.chunk_documents(parsed).collect()
    assert len({r.id for r in rows}) == len(rows)
    first = min((r for r in rows if r.document_id == "Q1"), key=lambda r: r.chunk_index)
    assert (first.id, first.kind, first.event_id) == ("Q1::c000", "infobox", "Q1") and "nations: 12" in first.text and first.indexed_text.startswith("Canoeing")
    assert {r.document_kind for r in rows if r.document_id == "Q3"} == {"document"}
    assert not [r for r in rows if r.document_id == ""]


def test_chunk_windows():
    limits = chunks.Limits(max_chars=200, min_chars=60, hard_max_chars=400)
    long = "Intro line.\n\n" + "word " * 400
    found = chunks.chunk_text(long, limits)
    assert max(len(w.text) for w in found) <= 400 and sum(w.text.count("word") for w in found) == 400
    middle = chunks.chunk_text("x" * 900 + "\n\n" + "y" * 100, limits)
    assert [len(w.text) for w in middle] == [900, 100] and [w.start for w in middle] == [0, 900]
    sections = chunks.chunk_text("Lead text that is long enough to stand on its own in the chunks here.\n\nHeat 1\nA long enough line of the first heat, to be a chunk of its own.\nSee also\nx", limits)
    assert [(w.section, w.kind) for w in sections] == [("lead", "lead"), ("Heat 1", "section"), ("See also", "section")]
    assert chunks.chunk_text(None) == chunks.chunk_text(" \n ") == []
    assert [chunks.is_heading(x) for x in ("Results table", "The Final Of Many Words", "a line.", "Men's 100 m", "| x", "")] == [True, False, False, False, False, False]


ASKED = [
    ("1", "How many nations competed in Judo at the 2016 Summer Olympics – Women's 57 kg?", "lookup_nations", "supported", "23"),
    ("2", "Could you tell me, how many judo events at the 2016 Summer Olympics exceeded 20 competitors?", "count_over_threshold", "supported", "2"),
    ("3", "At the 2012 Summer Olympics, which canoeing event had the largest field?", "argmax_competitors", "supported", "Canoeing at the 2012 Summer Olympics – Men's K-2 1000 metres"),
    ("4", "Which judo event at the 2016 Summer Olympics had the most competitors?", "argmax_competitors", "ambiguous", None),
    ("5", "Who took gold in the men's pole vault athletics event at the Summer Olympics just prior to 2016?", "previous_event_gold", "supported", "Renaud Lavillenie"),
    ("6", "After the 2012 Summer Olympics, who won gold in the men's pole vault athletics event?", "next_event_gold", "supported", "Thiago Braz"),
    ("7", "Who won the gold medal in the men's pole vault athletics event at the Summer Olympics held immediately before 2012?", "previous_event_gold", "unresolved", None),
    ("8", "Who won the gold medal in the event held at Carioca Arena 2 on 8 August at the 2016 Summer Olympics?", "events_at_venue_date", "supported", "Rafaela Silva"),
    ("9", "Who won gold at Carioca Arena 2 in August 2016?", "events_at_venue_date", "ambiguous", None),
    ("10", "Who earned gold at Placeholder Arena on 28 July 2012?", "events_at_venue_date", "not_found", None),
    ("11", "Who was the tallest athlete at the 2012 Summer Olympics?", "unknown", "unresolved", None),
    ("12", None, "unknown", "unresolved", None),
    ("13", "Count the curling events at the 1850 Winter Olympics with more than 3 competitors.", "count_over_threshold", "not_found", None),
    ("14", "What’s the nation count for Sailing at the 1988 Summer Olympics – Women's 470?", "lookup_nations", "unresolved", None),
    ("15", "Who was the gold medalist for the event held at estadio olimpico from 13 to 15 August 2016?", "events_at_venue_date", "supported", "Thiago Braz"),
]


def test_questions_are_answered(spark, parsed):
    asked = questions.parse_questions(spark.createDataFrame([a[:2] for a in ASKED], "qid string, question string"), ["athletics", "judo", "canoeing"])
    slots = {r.qid: r for r in asked.collect()}
    assert (slots["5"].sport, slots["5"].event_name, slots["5"].named_year, slots["5"].year) == ("athletics", "men's pole vault", 2016, 2012)
    assert (slots["8"].venue, slots["8"].year, slots["8"].season) == ("Carioca Arena 2", 2016, "Summer")
    assert (slots["2"].sport, slots["2"].year, slots["2"].threshold) == ("judo", 2016, 20)
    got = {r.qid: (r.operation, r.status, r.answer) for r in answers.solve(asked, ingest.solver_events(parsed)).collect()}
    assert got == {a[0]: tuple(a[2:]) for a in ASKED}


def test_citations(spark):
    items = spark.createDataFrame([("q", "a", "fact", "e", "nations", "23"), ("q", "a", "fact", "e", "nations", "23"), ("q", "b", "chunk", "e", "text", "gold: Ann B. Cole (x)")], "q string, evidence_id string, evidence_type string, event_id string, field_name string, value string")
    packed = evidence.pack(["q"], items)
    assert packed.count() == 2
    cases = [("23", ["a"], []), ("2", ["a"], ["ungrounded_answer"]), ("ann b. cole", ["b"], []), ("gold", ["b"], ["ungrounded_answer"]), ("23 | Cole", ["a", "b"], []), ("23", ["z"], ["orphan_citation:z"]), ("23", [], ["missing_citations"]), ("", [], [])]
    for answer, ids, errors in cases:
        (row,) = evidence.validate(spark.createDataFrame([("q", answer, ids)], "q string, answer string, citation_ids array<string>"), packed, ["q"]).collect()
        assert (row.errors, row.valid) == (errors, not errors), answer


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a\tb\\n\nc", 1, True), ('"q" \\', 2, None), (None, 3, False), (" é ", 4, True)], "t string, n int, b boolean")
    files.write_tsv(rows, str(tmp_path / "t"))
    got = {r.n: (r.t, r.b) for r in files.read_tsv(spark, str(tmp_path / "t")).collect()}
    assert got == {"1": ("a\tb\\n\nc", "true"), "2": ('"q" \\', ""), "3": ("", "false"), "4": (" é ", "true")}
    files.write_jsonl(rows, str(tmp_path / "j"))
    back = files.read_jsonl(spark, str(tmp_path / "j"), "b boolean, n int, t string")
    assert {tuple(r) for r in back.select("t", "n", "b").collect()} == {tuple(r) for r in rows.collect()}
    (tmp_path / "bad.jsonl").write_text('{"n": 1}\n\n[2]\nx\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "n int").collect()
