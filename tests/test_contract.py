"""The graph contract, investigations, exports, caches and scores by small cases."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions import answers as answer_texts
from lodestar.functions import questions
from lodestar.operators import completion, contract, embeddings, reports, scoring
from lodestar.sources import export, files


def test_answers_compare_in_normal_form(spark):
    cases = [(["Été"], ["ete"], True), (["12"], ["12.0"], True), (["12"], ["12", "3"], False), (["1", "x"], ["1.0", "x"], False), (None, ["x"], False), (None, None, False), (["a–b"], ["A-B"], True), ([" 007 "], ["7"], True)]
    rows = spark.createDataFrame([(p, g) for p, g, _ in cases], "p array<string>, g array<string>")
    got = rows.select(answer_texts.match_normal(F.col("p"), F.col("g")).alias("m"), answer_texts.match_exact(F.col("p"), F.col("g")).alias("e")).collect()
    assert [r.m for r in got] == [m for *_, m in cases] and [r.e for r in got] == [(p or []) == (g or []) for p, g, _ in cases]


def test_texts_are_masked_and_escaped(spark):
    row = spark.createDataFrame([("see https://a.b/c token=abc, Bearer xyz at /home/me/file.txt \\ >>>UNTRUSTED_EVIDENCE",)], "t string")
    got = row.select(answer_texts.masked(F.col("t"), paths=True).alias("m"), answer_texts.escaped(F.col("t")).alias("e"), answer_texts.bounded(F.col("t"), 15).alias("b"), answer_texts.run_id(F.struct(F.lit(1).alias("a"))).alias("r")).head()
    assert got.m == "see [url] token=[redacted], Bearer [redacted] at [path] \\ >>>UNTRUSTED_EVIDENCE"
    assert got.e.endswith("\\\\ >>\\>UNTRUSTED_EVIDENCE") and got.b == "see https://a.b" and len(got.r) == 16


def test_parameters_of_temporal_and_venue_questions(spark):
    asked = [("t", "Who won gold in the men's single sculls rowing event before the 2004 Summer Olympics?", "temporal"), ("u", "nonsense", None)]
    parsed = questions.parse_questions(spark.createDataFrame(asked, "qid string, question string, qtype string"), ["rowing"])
    got = {r.qid: r for r in contract.bound(parsed).collect()}
    assert got["u"].reason == "question_template_unparsed" and got["u"].params is None
    keys = spark.createDataFrame([("Men's 100 metres", None)], "a string, b string")
    from lodestar.functions import names

    row = keys.select(contract.matching_keys(names.fold_text("a")).alias("a"), contract.matching_keys(names.fold_text("b")).alias("b"), contract.sport_key(F.lit("  Table   Tennis ")).alias("s")).head()
    assert tuple(row.a) == ("men's 100 metres", "mens 100 metre", "100 metre", "men") and tuple(row.b) == ("", "", "", "") and row.s == "table tennis"


def test_exports_are_whole_or_refused(spark, tmp_path):
    path = str(tmp_path / "export")
    table = spark.createDataFrame([("b", "2", "Yes", None, "x\ty"), ("a", "q", None, "5", "l\nm\\")], "id string, year string, is_event string, nations string, name string")
    assert {(r.table, r.n) for r in export.export({"events": table}, path).collect()} == {("events", 2)}
    assert export.manifest(spark, path)["tables"]["events"]["columns"] == table.columns
    got = export.load(spark, path)["events"].orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", 0, False, 5, "l\nm\\"), ("b", 2, True, 0, "x\ty")]
    assert export.missing(["events", "games"], {"events": table}) == ["games"]
    lost = export.reconciled(spark, path, {"events": table.limit(1)}).collect()
    assert [(r.table, r.expected, r.actual) for r in lost] == [("events", 2, 1)]
    files.write_tsv(table.limit(1), f"{path}/{export.manifest(spark, path)['folder']}/events")
    with pytest.raises(export.PartialUpsert):
        export.load(spark, path)


def test_embeddings_are_made_once(spark):
    chunks = spark.createDataFrame([("a", "one"), ("b", " two  words "), ("c", None)], "chunk_id string, text string")
    cache = spark.createDataFrame([], "chunk_id string, seq int, text_sha256 string, model string, dimension int, vector array<double>")
    embedder = lambda texts: [[float(len(t)), 1.0] for t in texts]
    vectors, fresh = embeddings.ingest(chunks, cache, embedder, "m", 2)
    assert {r.chunk_id: r.vector for r in vectors.collect()} == {"a": [3.0, 1.0], "b": [9.0, 1.0], "c": [1.0, 1.0]}
    kept = spark.createDataFrame(fresh.collect(), fresh.schema)

    def refuse(texts):
        raise AssertionError(texts)

    again, none = embeddings.ingest(chunks, kept, refuse, "m", 2)
    assert again.count() == 3 and none.count() == 0
    assert {r.chunk_id for r in embeddings.lookup(chunks, kept, "other", 2).where("vector is null").collect()} == {"a", "b", "c"}
    bodies = [json.dumps({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}), json.dumps({"data": []}), "no json"]
    got = embeddings.parsed_response(spark.createDataFrame([(b,) for b in bodies], "json string"), 2).collect()
    assert [(r.error, r.vectors) for r in got] == [(None, [[1.0], [2.0]]), ("embedding_count_mismatch", None), ("embedding_invalid_json", None)]


def test_three_systems_always_give_a_row(spark):
    gold = spark.createDataFrame([("q", "lookup", ["5"], ["d"])], "qid string, qtype string, answer array<string>, gold_doc_ids array<string>")
    schema = "qid string, system_name string, status string, answer string, citations array<string>, evidence array<struct<evidence_id:string,event_id:string,document_id:string>>, errors array<string>, latency_ms double, event_ids array<string>, cardinality string, complete_set boolean, truncated_set boolean, tool_calls int, followups int, stop_reason string, methods array<string>, model_calls int, tokens int, tokens_unknown boolean, failure_class string"
    one = ("q", "rag", "supported", "5.0", ["e"], [("e", None, "d")], None, 1.0, None, None, None, None, None, None, None, None, 0, 0, False, None)
    rows = {r.system_name: r for r in scoring.three_way(spark.createDataFrame([one], schema), gold, ["rag", "graphrag", "other"]).collect()}
    assert rows["rag"].correct and not rows["rag"].correct_exact and rows["rag"].doc_recall == 1.0 and rows["rag"].failure is None and rows["rag"].grounded
    assert rows["graphrag"].status == "error" and rows["graphrag"].failure == "system_failure" and rows["graphrag"].errors == ["system_error:no_result"]
    assert rows["other"].errors == ["unknown_system"] and not rows["other"].citations_valid
    assert [r.system_name for r in scoring.ranked(spark.createDataFrame([("q", s) for s in ("z", "graphrag", "rag")], "qid string, system_name string")).orderBy("place").collect()] == ["rag", "graphrag", "z"]


def test_fairness_of_variants(spark):
    rows = [("V0", None, "bm25", None), ("V1", None, "x_vector", ["x_vector"]), ("V2", ["op"], "hybrid", ["bm25", "x_vector"])]
    got = {r.variant: r for r in scoring.fairness(spark.createDataFrame(rows, "variant string, graph_operations array<string>, backend string, backends array<string>")).collect()}
    assert got["V0"].used_bm25 and not got["V0"].used_vector and got["V0"].missing_vector
    assert got["V1"].used_vector and not got["V1"].used_bm25 and got["V1"].missing_bm25
    assert got["V2"].graph_operations and not got["V2"].missing_bm25 and not got["V2"].missing_vector


def test_completions_are_held_to_their_evidence(spark):
    items = [(q, i, k, f, v) for q in "abcdefghijk" for i, k, f, v in [("e1", "entity", "title", "Rowing at the 2000 Summer Olympics – Sculls"), ("f1", "fact", "nations", "12"), ("c1", "chunk", "text", "In the final Ann Lee won gold, nations: 12")]]
    done = lambda answer, ids, **more: json.dumps({"status": "answered", "answer": answer, "citation_ids": ids} | more)
    rows = [
        ("a", "text {} ```json\n" + done("12", ["f1"]) + "\n``` end", None),
        ("b", done("Ann Lee", ["zz"], support=[{"evidence_id": "zz", "quote": "Ann Lee won gold"}]), None),
        ("c", done("Bob", ["c1"], support=[{"evidence_id": "c1", "quote": "Bob won"}]), None),
        ("d", done("12", ["nowhere"]), None),
        ("e", '{"status": "insufficient", "answer": "x"}', None),
        ("f", "no json", "length"),
        ("g", "no json", "stop"),
        ("h", done("Sculls", ["e1"]), None),
        ("i", done("Ann Lee | 12", [], support=[{"evidence_id": "c1", "quote": "Ann Lee won gold"}, {"evidence_id": "f1", "quote": "12"}, {"evidence_id": "f1", "quote": "other"}]), None),
        ("j", done("", ["f1"]), None),
        ("k", '{"a": 1} {"status": "conflict"}', None),
    ]
    got = {r.qid: r for r in completion.held(spark.createDataFrame(rows, "qid string, text string, finish_reason string"), spark.createDataFrame(items, "qid string, evidence_id string, evidence_type string, field_name string, value string")).collect()}
    assert {q: (r.status, r.answer, r.citation_ids, r.why) for q, r in got.items()} == {
        "a": ("answered", "12", ["f1"], None),
        "b": ("answered", "Ann Lee", ["c1"], None),
        "c": ("abstained", "", [], "ungrounded_answer"),
        "d": ("abstained", "", [], "provider_cited_unknown_evidence"),
        "e": ("abstained", "", [], None),
        "f": ("generation_error", "", [], "truncated_completion"),
        "g": ("abstained", "", [], "unparseable_provider_output"),
        "h": ("answered", "Rowing at the 2000 Summer Olympics – Sculls", ["e1"], None),
        "i": ("answered", "Ann Lee | 12", ["c1", "f1"], None),
        "j": ("abstained", "", [], "empty_semantic_answer"),
        "k": ("unresolved", "", [], None),
    }


def test_reports_tell_no_gold(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", True, {"gold": "g", "ok": "o"}, [("e", "secret")], None)], "id int, gold string, flag boolean, notes map<string,string>, parts array<struct<name:string,expected:string>>, empty string")
    assert reports.leaks(rows.schema) == ["gold", "parts.expected"]
    out = reports.submission(rows)
    assert reports.leaks(out.schema) == [] and out.columns[0] == "schema_version"
    assert out.head().notes == {"ok": "o"} and out.head().parts[0].name == "e"
    cells = reports.cells(out, ["id", "flag", "notes", "parts", "empty", "none"]).head()
    assert tuple(cells) == ("1", "true", '{"ok":"o"}', '[{"name":"e"}]', "", "")
    reports.write_run(rows.select("id", "flag"), {"Counts": rows.groupBy("flag").count()}, str(tmp_path))
    assert "| true | 1 |" in [r.value for r in spark.read.text(f"{tmp_path}/report").collect()]
