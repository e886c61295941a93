"""Investigations, gold sets and the pipeline against plain-Python versions of their rules; untrusted completions and headings."""

import random
import time

import pytest

from lodestar.operators import chunks, completion, contract, gold
from lodestar.plans import investigate
from lodestar.plans.investigate import Budget, Retrieved

ITEM = investigate.ITEM
OPS = {"lookup": "answer_field", "aggregation": "complete_count", "superlative": "max_attribute", "multi_hop": "answer_field", "temporal": "answer_field"}


def made(seed):
    """Questions, and for each and each tool: (status, error, items)."""
    rng = random.Random(seed)
    asks, found = [], {}
    for n in range(160):
        qid, qtype = f"q{n}", rng.choice(list(OPS))
        asks.append((qid, qtype, rng.choice(["parsed"] * 6 + ["unresolved", "unsupported"])))
        status = rng.choice(["supported"] * 5 + ["ambiguous", "ambiguous", "unresolved", "not_found"])
        events = [f"e{n}.{i}" for i in range(rng.choice([0, 1, 1, 1, 2, 3]))]
        items = [(f"s:entity:{e}", "entity", e, "title", rng.choice(["Title", "Title", None]), "m0") for e in events]
        items += [(f"s:fact:{e}", "fact", e, "gold", rng.choice(["Ann", "Ann", None]), "m0") for e in events if rng.random() < 0.7]
        error = lambda p: "Broken" if rng.random() < p else None
        found[qid, "retrieve_spec"] = (status, error(0.05), items)
        edges = [(f"h:{r}:{e}", "edge", e, r, "x", "m1") for e in events[:1] for r in rng.sample(["IN_GAMES", "HELD_AT"], rng.choice([0, 1, 2]))]
        found[qid, "event_neighborhood"] = ("supported" if edges else rng.choice(["not_found", "unresolved", "supported"]), error(0.1), edges)
        boxes = [(f"c:{e}", "chunk", e, "text", "words", "m2") for e in events if rng.random() < 0.6] + ([(f"s:entity:{events[0]}", "entity", events[0], "title", "Other", "m2")] if events and rng.random() < 0.2 else [])
        found[qid, "supporting_chunks"] = ("supported" if boxes else "not_found", error(0.1), boxes)
        found[qid, "vector_search"] = ("supported", error(0.1), [(f"v:{n}", "chunk", None, "text", "words", "m3")] if rng.random() < 0.5 else [])
    return asks, found


def plain(asks, found, budget, vector, hops):
    """One question after the other, step by step."""
    out, evidence, ledger = {}, {}, {}
    for qid, qtype, parse in asks:
        slots = {"target_event": "unknown", OPS[qtype]: "unknown"} | ({"graph_relation": "unknown"} if qtype == "multi_hop" else {})
        s = dict(primary=None, events=[], chunks=False, asked=False, hood=False, searched=False, it=0, calls=0, follow=0, stop=None)
        kept, tried = {}, set()

        def ready():
            return s["primary"] == "supported" and (not hops or slots.get("graph_relation", "resolved") == "resolved") and not (vector and s["asked"] and not s["chunks"] and not s["searched"]) and slots["target_event"] == slots[OPS[qtype]] == "resolved"

        if parse != "parsed":
            s["stop"] = "unsupported" if parse == "unsupported" else "unresolved"
        while s["stop"] is None:
            room = budget.tool_calls - s["calls"]
            if s["it"] >= budget.iterations or room <= 0:
                s["stop"] = "budget_exhausted"
                break
            if s["it"] == 0:
                todo = ["retrieve_spec"]
                slots |= {k: "searching" for k in ("target_event", OPS[qtype])}
            else:
                todo, some = [], bool(s["events"]) and not s["chunks"]
                if hops and slots.get("graph_relation", "resolved") != "resolved" and s["primary"] == "supported" and len(s["events"]) == 1 and not s["hood"]:
                    todo.append("event_neighborhood")
                if s["primary"] in ("supported", "ambiguous") and some and not s["asked"]:
                    todo.append("supporting_chunks")
                if s["primary"] in ("supported", "ambiguous") and some and s["asked"] and vector and not s["searched"]:
                    todo.append("vector_search")
                todo = [t for t in todo if t not in tried][:room] if s["follow"] < budget.follow_ups else []
            if not todo:
                s["stop"] = "answered" if ready() else s["primary"] if s["primary"] in ("ambiguous", "not_found", "unresolved") else "unresolved" if s["calls"] == 0 else "no_progress"
                break
            for tool in todo:
                status, error, items = found[qid, tool]
                if error:
                    s["stop"] = "tool_failure"
                    break
                tried.add(tool)
                s["calls"] += 1
                for i in items:
                    kept.setdefault(i[0], (s["it"], tool))
                has = lambda kind, items=items: any(i[1] == kind for i in items)
                if tool == "retrieve_spec":
                    s["primary"], s["events"] = status, sorted({i[2] for i in items if i[1] == "entity"})
                    slots["target_event"] = {"supported": "resolved", "ambiguous": "ambiguous"}.get(status, "unsupported")
                    facts, titles = any(i[1] == "fact" and i[4] for i in items), any(i[1] == "entity" and i[4] for i in items)
                    if status == "supported" and (facts or (OPS[qtype] == "max_attribute" and titles)):
                        slots[OPS[qtype]] = "resolved"
                    elif status != "supported":
                        slots[OPS[qtype]] = "ambiguous" if status == "ambiguous" else "unsupported"
                    if slots.get("graph_relation") == "unknown":
                        slots["graph_relation"] = "searching"
                elif tool == "event_neighborhood":
                    s["hood"] = has("edge") or has("entity")
                    if status == "supported" and s["hood"]:
                        slots["graph_relation"] = "resolved"
                    elif status in ("not_found", "unresolved"):
                        slots["graph_relation"] = "unsupported"
                elif tool == "supporting_chunks":
                    s["asked"], s["chunks"] = True, s["chunks"] or has("chunk")
                else:
                    s["searched"], s["chunks"] = True, s["chunks"] or has("chunk")
            if s["stop"]:
                break
            s["follow"] += s["it"] > 0
            s["it"] += 1
            if ready():
                s["stop"] = "answered"
            elif s["primary"] in ("not_found", "unresolved"):
                s["stop"] = s["primary"]
        out[qid], evidence[qid], ledger[qid] = (s["stop"], s["it"], s["calls"], s["follow"], ready()), kept, slots
    return out, evidence, ledger


@pytest.mark.parametrize(("seed", "budget", "vector", "hops"), [(1, Budget(), False, True), (2, Budget(), True, True), (3, Budget(2, 2, 1), True, True), (4, Budget(4, 3, 2), True, False)])
def test_investigation_against_a_plain_loop(spark, seed, budget, vector, hops):
    asks, found = made(seed)
    everything = spark.createDataFrame([(q, t, st, e) for (q, t), (st, e, _) in found.items()], "qid string, tool string, status string, error string")
    items = spark.createDataFrame([(q, t, *i) for (q, t), (_, _, own) in found.items() for i in own], f"qid string, tool string, {ITEM}")
    sent = []

    def tool(name):
        def run(frontier):
            sent.append((name, [tuple(r) for r in frontier.collect()]))
            mine = frontier.select("qid").distinct()
            return Retrieved(everything.where(everything["tool"] == name).join(mine, "qid").select("qid", "status", "error"), items.where(items["tool"] == name).join(mine, "qid").drop("tool"))

        return run

    tools = {t: tool(t) for t in investigate.TOOLS if vector or t != "vector_search"}
    got = investigate.investigate(spark.createDataFrame(asks, "qid string, qtype string, parse_status string"), tools, budget, hops)
    out, evidence, ledger = plain(asks, found, budget, vector, hops)
    assert {r.qid: (r.stop_reason, r.iterations, r.tool_calls, r.followups, r.answer_ready) for r in got.questions.collect()} == out
    assert {(r.qid, r.evidence_id): (r.step, r.tool) for r in got.evidence.collect()} == {(q, e): v for q, own in evidence.items() for e, v in own.items()}
    assert {(r.qid, r.slot): r.status for r in got.slots.collect()} == {(q, k): v for q, own in ledger.items() for k, v in own.items()}
    assert len({v[0] for v in out.values()}) >= 6 and got.slot_evidence().where("evidence_id is null").count() > 0
    hops_sent = [r for name, rows in sent if name == "event_neighborhood" for r in rows]
    assert len(hops_sent) == len(set(hops_sent))  # no action is repeated


def test_plans_do_not_grow_with_rounds(spark):
    asks, found = made(9)
    frame = spark.createDataFrame(asks, "qid string, qtype string, parse_status string")
    none = spark.createDataFrame([], f"qid string, {ITEM}")
    sizes = []

    def tool(frontier):
        sizes.append(len(frontier._jdf.queryExecution().analyzed().toString()))
        return Retrieved(frontier.select("qid", investigate.F.lit("supported").alias("status"), investigate.F.lit(None).cast("string").alias("error")).distinct(), none)

    investigate.investigate(frame, dict.fromkeys(investigate.TOOLS, tool), Budget(5, 20, 5))
    assert max(sizes) < 8 * min(sizes)
    empty = investigate.investigate(frame.where("false"), dict.fromkeys(investigate.TOOLS, tool))
    assert empty.questions.count() == empty.slot_evidence().count() == 0


def test_gold_before_the_named_year(spark):
    documents = spark.createDataFrame([("a", 1996), ("b", 1992), ("c", 1992), ("d", None), ("e", 2000)], "doc_id string, year int")
    asks = [("1", 2000, ["e", "c", "b"]), ("2", 1992, ["b", "c"]), ("3", None, ["a"]), ("4", 2000, []), ("5", 2000, ["d", "zz"]), ("6", 1996, ["b", "c", "a"]), ("7", 2004, None)]
    got = {r.qid: tuple(r)[2:] for r in gold.previous_gold(spark.createDataFrame(asks, "qid string, named_year int, gold_doc_ids array<string>"), documents).collect()}
    no = gold.NO_OLDER
    assert got == {"1": ("c", "e", True, None), "2": (None, "b", False, no), "3": (None, None, False, gold.NO_YEAR), "4": (None, None, False, no), "5": (None, None, False, no), "6": ("b", "a", True, None), "7": (None, None, False, no)}


def test_as_of_edition_against_all_pairs(spark):
    rng = random.Random(5)
    docs = [(f"d{i}", rng.choice("ab"), rng.choice([None, *range(1900, 1912)])) for i in range(60)]
    asks = [(f"q{i}", rng.choice("abc"), rng.choice([None, *range(1898, 1914)])) for i in range(60)]
    got = sorted(map(tuple, gold.edition_before(spark.createDataFrame(asks, "qid string, key string, named_year int"), spark.createDataFrame(docs, "doc_id string, key string, year int"), ["key"]).collect()), key=str)
    want = []
    for qid, key, named in asks:
        years = [y for _, k, y in docs if k == key and y is not None and named is not None and y < named]
        last = max(years, default=None)
        want += [(qid, named, last, d) for d in ([d for d, k, y in docs if k == key and y == last] if last else [None])]
    assert got == sorted(want, key=str)


def test_observations_mark_cut_lists(spark):
    rows = [("a", f"c{i}", "chunk", "xx", False, "lookup") for i in range(4)] + [("a", "e", "entity", "t", False, "lookup")] + [("b", f"c{i}", "chunk", "xx", False, "count_over_threshold") for i in range(4)] + [("c", f"c{i}", "chunk", "xx", True, "lookup") for i in range(4)] + [("d", "c0", "chunk", "x" * 30, None, None)]
    got = contract.observed(spark.createDataFrame(rows, "qid string, evidence_id string, evidence_type string, value string, complete_set boolean, operation string"), 20, 2).collect()
    by = {q: sorted((r.evidence_id, r.truncated, len(r.value)) for r in got if r.qid == q) for q in "abcd"}
    assert by["a"] == [("c0", True, 2), ("c1", True, 2), ("e", False, 1)]
    assert [r[1] for r in by["b"]] == [r[1] for r in by["c"]] == [False] * 4 and by["d"] == [("c0", True, 20)]


def test_completions_that_nest_or_repeat_without_end(spark):
    deep, many = '{"a":' * 100_000, "{ " * 300_000
    began = time.time()
    assert completion.first_object(deep) is None and completion.first_object(many) is None and time.time() - began < 30
    assert completion.first_object('so {x} then {"a": 1} and {"status": "answered", "in": {"status": 2}}') == {"status": "answered", "in": {"status": 2}}
    assert completion.first_object('```json\n{"a": {"b": []}}\n``` {"status": 1}') == {"a": {"b": []}} and completion.first_object("``` {\"a\": 1}") == {"a": 1}
    assert completion.first_object(None) is None and completion.first_object("[1]") is None
    frame = spark.createDataFrame([(1, deep), (2, '{"status": "answered", "answer": "x"}')], "n int, text string")
    got = {r.n: r.c for r in frame.select("n", completion.read(frame["text"]).alias("c")).collect()}
    assert (got[1] is None or got[1].status is None) and got[2].status == "answered"


def test_headings_and_runs():
    yes = ["Heat 12", "final b", "Semifinals", "Round 3", "RESULTS TABLE", "Men and Women of Sweden", "100 Metres"]
    no = ["Heat #", "Final E", "[Results", "Results:", "a | b", "One Two Three Four Five Six Seven Eight", "The Final Of Many Words", "X" * 71, "", "lower case words"]
    assert all(map(chunks.is_heading, yes)) and not any(map(chunks.is_heading, no))
    rng = random.Random(1)
    for _ in range(300):
        sizes, most = [rng.randint(1, 40) for _ in range(rng.randint(0, 12))], rng.randint(5, 90)
        want, at = [], 0
        while at < len(sizes):
            stop = at + 1
            while stop < len(sizes) and sum(sizes[at : stop + 1]) + 2 * (stop - at) <= most:
                stop += 1
            want.append((at, stop))
            at = stop
        assert list(chunks.runs(sizes, most)) == want
