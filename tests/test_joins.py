"""Questions meet events by what both name, and lose none that a comparison of all pairs would find."""

import itertools

from pyspark.sql import functions as F

from lodestar.functions import calendar
from lodestar.plans import answers

DATE = "struct<raw:string,years:array<int>,months:array<int>,days:array<int>>"


def test_dates_meet_like_all_pairs(spark):
    parts = [None, [], [5], [5, 6], [7]]
    dates = [None, *[("x", y, m, d) for y, m, d in itertools.product([None, [1996]], parts, [None, [], [1], [1, 2], [3]])]]
    asked = spark.createDataFrame([(i, "a", d) for i, d in enumerate(dates)], f"qid int, hall string, q_date {DATE}")
    events = spark.createDataFrame([(i, v, d) for v in "ab" for i, d in enumerate(dates)], f"id int, venue string, date {DATE}")
    for test in (
        F.col("q_date").isNull() | F.coalesce(calendar.dates_overlap(F.col("date"), F.col("q_date")), F.lit(False)),
        F.col("q_date").isNull() | F.col("date").isNull() | F.coalesce(calendar.dates_overlap(F.col("date"), F.col("q_date")), F.lit(False)),
    ):
        place = F.col("hall") == F.col("venue")
        got = answers.met_on_dates(asked, events, place, test).select("qid", "id").collect()
        want = asked.join(events, place).where(test).select("qid", "id").collect()
        assert sorted(got) == sorted(want)


def test_names_meet_by_their_core(spark):
    made = [("100 metres, men", 1), ("Men's 100 meters", 2), ("100 metres", 3), ("women's 100 metres", 4), ("200 metres", 5), ("men", 6), ("", 7), (None, 8)]
    events = spark.createDataFrame([(i, "run", 1996, "Summer", name, f"g{i}", None, None) for name, i in made], "id int, sport string, year int, season string, event_name string, gold string, prev_year int, next_year int")
    asks = [("a", "100 metres, men"), ("b", "men's 100 metres"), ("c", "100 metre"), ("d", "mens"), ("e", ""), ("f", None), ("g", "300")]
    asked = spark.createDataFrame([(q, None if q in "bf" else "run", "Summer", 1996, name, "next") for q, name in asks], "qid string, sport string, season string, named_year int, event_name string, temporal_relation string")
    start = answers._edition_steps(asked, events)[2]
    found: dict = {}
    for r in start.collect():
        found.setdefault(r["qid"], []).append(r["id"])
    everything = [1, 2, 3, 4, 5, 6, 7, 8]
    assert {q: sorted(ids) for q, ids in found.items()} == {"a": [1], "b": [1, 2, 3], "c": [1, 2, 3, 4], "d": [6], "e": everything, "f": everything}
    # a pool of many names isn't compared with each of its questions
    assert "q_core" in start._jdf.queryExecution().optimizedPlan().toString()


def test_a_tile_of_vectors_holds_few_scores():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lodestar.operators import retrieval

    rng = np.random.default_rng(0)
    table = lambda i, c, n: pa.table({i: pa.array(range(n), pa.int64()), c: pa.array(rng.random((n, 4)).tolist())})
    asks, rows = table("query_id", "asked", 1000), table("vec_id", "own", 8000)
    tracemalloc.start()
    got = retrieval.best_in_tile(3)(asks, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    a, b = (np.array(t.column(1).to_pylist()) for t in (asks, rows))
    score = np.round(a @ b.T / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None]), 6)
    np.fill_diagonal(score, -1)
    assert np.allclose(np.sort(score, 1)[:, -3:], np.array(got.column("score").to_pylist()).reshape(1000, 3)[:, ::-1], atol=2e-6)
    # all pairs would take 64 MB
    assert peak < 20_000_000


def test_sweep_takes_few_of_each_title(spark):
    from lodestar.plans import textsearch

    boxes = spark.range(3000).select(F.format_string("c%05d", "id").alias("chunk_id"), F.concat(F.lit("Run 1996 "), (F.col("id") % 2).cast("string")).alias("document_title"))
    wanted = spark.range(20).select(F.col("id").alias("qid"), F.array(F.lit(1996)).alias("years"), F.array(F.lit("run")).alias("sport_tokens"))
    rows = textsearch.sweep(wanted, boxes)
    found = {r["qid"]: r["ids"] for r in rows.groupBy("qid").agg(F.sort_array(F.collect_list("chunk_id")).alias("ids")).collect()}
    assert found == {q: [f"c{2 * i:05d}" for i in range(textsearch.SWEEP)] for q in range(20)}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 2


def test_what_nobody_asks_meets_no_events(spark):
    """Only questions that lack the key or the name, or ask in other words than the event's own, make a second join."""
    events = spark.createDataFrame([(i, "run", y, "Summer", "100 metres", f"g{i}", None, None) for i, y in ((1, 1992), (2, 1996))], "id int, sport string, year int, season string, event_name string, gold string, prev_year int, next_year int")
    schema = "qid string, operation string, sport string, season string, year int, named_year int, event_name string, temporal_relation string"
    ask = lambda *rows: answers._edition_steps(spark.createDataFrame([(q, "previous_event_gold", sport, "Summer", None, 1996, name, "previous") for q, sport, name in rows], schema), events)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
    own, other = ask(("a", "run", "100 metres")), ask(("a", "run", "100 metres"), ("b", None, "100 meter"), ("c", "run", None))
    assert joins(own[2]) == 1 and joins(other[2]) == 3
    # the edition before is found under the event's own name; only b and c ask in other words
    assert [(r.qid, r.id) for r in own[3].collect()] == [("a", 1)] and own[4].collect() == []
    assert sorted((r.qid, r.id) for r in other[3].collect()) == [("a", 1), ("b", 1), ("c", 1)] and sorted((r.qid, r.id) for r in other[4].collect()) == [("b", 1), ("c", 1)]
    pairs = answers.editions(other).collect()
    assert sorted((r.qid, r.status, r.answer) for r in pairs) == [(q, "supported", "g1") for q in "abc"]
