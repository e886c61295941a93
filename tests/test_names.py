"""Names, venues, dates and tokens by small cases with known results."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import calendar, names
from lodestar.operators import pools, retrieval


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_folding(spark):
    got = rows(spark, [("Été–Ça",), (None,), ("ﬁnal  ſtate",), ("",)], "t string").select(names.fold_text("t").alias("f")).collect()
    assert [r.f for r in got] == ["ete ca", "", "final state", ""]


@pytest.mark.parametrize(
    ("left", "right", "match"),
    [("Men's 100 metres", "100 meter men", True), ("men's", "men", True), ("women's 50 kms", "50 km", True), ("men 50", "women 50", False), ("girls 50", "50", False), ("", "", False), (None, "x", False), ("50", "mixed 50", True)],
)
def test_names_match(spark, left, right, match):
    row = rows(spark, [(left, right)], "a string, b string").select(names.names_match(names.normalize_event_name(names.fold_text("a")), names.normalize_event_name(names.fold_text("b"))).alias("m"))
    assert row.head().m is match


@pytest.mark.parametrize(
    ("query", "venue", "score"),
    [("wembley-arena", "Wembley Arena", 100), ("Wembley", "Wembley Arena", 70), ("The Wembley Arena, London", "Wembley Arena", 60), ("Olympic Centre Lake", "Lake Placid", 40), ("Olympic Centre", "Lake Placid", 0), (None, "x", 0), ("in lake", "lake", 60), ("on placid", "Placid Lake", 0)],
)
def test_venue_score(spark, query, venue, score):
    assert rows(spark, [(query, venue)], "q string, v string").select(names.venue_score(names.fold_text("q"), names.fold_text("v")).alias("s")).head().s == score


def test_date_specificity(spark):
    cases = [(([2000], [9], [1, 2]), ([2000], [9], [2, 1]), 3), (([], [], [2]), ([2000], [9], [1, 2]), 2), (([], [9], []), ([2000], [9], [1]), 1), (([], [9], [2, 3]), ([2000], [9], [1, 2]), 1), (([], [8], []), ([2000], [9], [1]), 0), (None, ([2000], [9], [1]), 0)]
    kind = "struct<years:array<int>,months:array<int>,days:array<int>>"
    got = rows(spark, [(a, b) for a, b, _ in cases], f"a {kind}, b {kind}").select(calendar.date_specificity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == [s for *_, s in cases]


def test_tokens_are_case_folded(spark):
    got = rows(spark, [("ﬁnal ſtate Straße ẞ ŉ 12K",), (None,)], "t string").select(names.tokenize(F.col("t")).alias("t")).collect()
    assert got[0].t == ["final", "state", "strasse", "ss", "n", "12k"] and got[1].t == []


def test_titles_are_looked_up_by_folded_form(spark):
    events = rows(spark, [(1, "Café – Final"), (2, "cafe final"), (3, "Other")], "id long, title string")
    got = pools.title_lookup(events, rows(spark, [("CAFE FINAL",), ("Other",), ("cafe final",), ("-",)], "asked string")).collect()
    assert sorted((r.asked, r.id) for r in got if r.id) == [("CAFE FINAL", 1), ("CAFE FINAL", 2), ("Other", 3), ("cafe final", 2)]
    assert [r.tier for r in got if r.asked == "-"] == [None]


def test_holders_of_passages(spark):
    docs = rows(spark, [(1, "one two three four five six seven eight"), (2, "two  three four five six seven"), (3, "short text"), (4, None)], "doc long, text string")
    passages = rows(spark, [(1, "wo three four five six seven eig"), (2, "short"), (3, "t"), (4, "two three four five six seven eight nine")], "query_id long, passage string")
    want = {(d.doc, p.query_id) for d in docs.collect() for p in passages.collect() if d.text and p.passage in d.text}
    assert {(r.doc, r.query_id) for r in retrieval.holders(docs, passages).collect()} == want


def test_mmr_against_brute_force(spark):
    texts = {1: "a b c", 2: "a b c d", 3: "x y", 4: "", 5: "a x"}
    scores = {1: 0.9, 2: 0.89, 3: 0.5, 4: 0.5, 5: 0.4}
    hits = rows(spark, [(q, d, scores[d], texts[d]) for q in (1, 2) for d in texts], "query_id long, doc long, score double, text string")
    left, taken = sorted(texts, key=lambda d: (-scores[d], d)), []
    while left:
        overlap = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        value = lambda d: 0.7 * scores[d] - 0.3 * max((overlap(set(texts[d].split()), set(texts[t].split())) for t in taken), default=0.0)  # noqa: E731, B023
        best = max(left, key=value)
        taken.append(best)
        left.remove(best)
    got = retrieval.mmr(hits).collect()
    for q in (1, 2):
        assert [r.doc for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == taken
