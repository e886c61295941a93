"""The whole graph: exports that come at once, merges, edges that dangle; ordinals over many files."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import contract, evaluation, evidence_graph, graph
from lodestar.sources import export, files


@pytest.fixture
def parts(spark):
    documents = spark.createDataFrame([("d1", "One", "1"), ("d2", "Two", "2"), ("d3", "None", None), ("d4", "Lost", "9")], "id string, title string, event_id string")
    events = spark.createDataFrame([(1, "judo", 2012, "Summer", "A", "Hall "), (2, None, 2012, "Summer", "B", None)], "id long, sport string, year int, season string, event_name string, venue string")
    chunks = spark.createDataFrame([("d1::c0", "d1", 0, "infobox"), ("d1::c1", "d1", 1, "lead"), ("d7::c0", "d7", 0, "lead")], "id string, document_id string, chunk_index int, section string")
    return documents, events, chunks


def test_graph_has_all_tables_and_dangling_edges_are_told(parts):
    tables = graph.whole_graph(*parts)
    assert {name: t.count() for name, t in tables.items()} == {"Document": 4, "Event": 2, "Games": 1, "Sport": 1, "Venue": 1, "Chunk": 3, "DESCRIBES": 3, "CONTAINS_CHUNK": 3, "IN_GAMES": 2, "OF_SPORT": 1, "HELD_AT": 1}
    assert sorted(map(tuple, graph.dangling(tables).collect())) == [("CONTAINS_CHUNK", "d7", "d7::c0", "Document"), ("DESCRIBES", "d4", "9", "Event")]
    whole = graph.with_whole_edges(tables)
    assert whole["DESCRIBES"].count() == 2 and whole["CONTAINS_CHUNK"].count() == 2 and graph.dangling(whole).count() == 0 and whole["DESCRIBES"].columns == tables["DESCRIBES"].columns


def test_merge_replaces_by_key(spark, parts):
    tables = graph.whole_graph(*parts)
    base = {"Document": spark.createDataFrame([("d1", "Old", None), ("dx", "Own", None)], "id string, title string, event_id string"), "IN_GAMES": spark.createDataFrame([("1", "2012_Summer", 1900, "x"), ("8", "1900_Summer", 1900, "Summer")], "src string, tgt string, year int, season string")}
    live = graph.merged_graph(base, tables)
    assert {r.id: r.title for r in live["Document"].collect()} == {"d1": "One", "d2": "Two", "d3": "None", "d4": "Lost", "dx": "Own"}
    assert sorted((r.src, r.tgt, r.year) for r in live["IN_GAMES"].collect()) == [("1", "2012_Summer", 2012), ("2", "2012_Summer", 2012), ("8", "1900_Summer", 1900)]
    twice = graph.merged_table(base["Document"], base["Document"].unionByName(base["Document"].withColumn("title", F.lit("Newer"))), ["id"])
    assert twice.count() == 2


def test_a_lost_export_leaves_the_one_before(spark, parts, tmp_path, monkeypatch):
    path, tables = str(tmp_path / "graph"), graph.whole_graph(*parts)
    export.export(tables, path)
    before = export.manifest(spark, path)
    write, done = files.write_tsv, []

    def breaking(rows, to):
        if len(done) == 4:
            raise RuntimeError("lost")
        done.append(to)
        write(rows, to)

    monkeypatch.setattr(files, "write_tsv", breaking)
    with pytest.raises(RuntimeError):
        export.export(tables | {"Document": tables["Document"].limit(1)}, path)
    monkeypatch.setattr(files, "write_tsv", write)
    assert export.manifest(spark, path) == before and export.load(spark, path)["Document"].count() == 4
    export.export(tables | {"Document": tables["Document"].limit(1)}, path)
    assert export.load(spark, path)["Document"].count() == 1


def test_ordinals_follow_files_and_places(spark, tmp_path):
    rows = [(f"id{i}", i) for i in range(500)]
    for n in range(5):
        with (tmp_path / f"part-{n}.json").open("w") as f:
            f.write("".join(json.dumps({"doc_id": r[0], "title": "t" * (n * 50)}) + "\n" for r in rows[100 * n : 100 * n + 100]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        got = {r.doc_id: r.doc_ord for r in files.read_corpus(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(rows)
    spark.range(1000, numPartitions=7).write.parquet(str(tmp_path / "p"))
    own = files.numbered(spark.read.parquet(str(tmp_path / "p")).where("id % 3 = 0"))
    assert sorted((r.doc_ord, r.id) for r in own.collect()) == [(i, 3 * i) for i in range(334)]
    assert files.numbered(spark.read.parquet(str(tmp_path / "p")).where("false")).count() == 0


def test_cardinalities(spark):
    rows = spark.createDataFrame([("count_over_threshold", "supported", 3), ("lookup_event", "supported", 1), ("lookup_event", "supported", 0), ("x", "supported", 2), ("x", "ambiguous", 2), ("x", "not_found", 0), ("x", "unresolved", 0)], "op string, status string, n int")
    got = [r.c for r in rows.select(contract.cardinality(F.col("op"), F.col("status"), F.col("n")).alias("c")).collect()]
    assert got == ["complete_set", "one", "empty", "multiple", "ambiguous", "empty", "unresolved"] and evaluation is not None


def test_ids_with_colons_are_read(spark):
    ids = {"c:entity:Q1:2": ("entity", "title", "Q1:2", None), "c:fact:gold_raw:Q:1": ("fact", "gold_raw", "Q:1", None), "c:edge:HELD_AT:hall: one": ("edge", "HELD_AT", None, None), "c:chunk:d:1::c0": ("chunk", None, None, "d:1::c0"), "c:fact:x": ("unknown", None, None, None), "plain": ("unknown", None, None, None), "": ("unknown", None, None, None)}
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", evidence_graph.parsed_id(F.col("id")).alias("p")).collect()
    assert {r.id: (r.p.evidence_type, r.p.field_name, r.p.event_id, r.p.chunk_id) for r in rows} == ids
    assert [r.p.document_id for r in rows if r.id == "c:chunk:d:1::c0"] == ["d:1"] and [r.p.value for r in rows if r.id.startswith("c:edge")] == ["hall: one"]


def test_graph_is_cut_in_order_and_no_edge_leads_nowhere(spark):
    items = [("q", i, f"c:fact:nations:e{i}", "fact", f"e{i}", None, None, "nations", str(i)) for i in range(50)] + [("q", 50, "c:chunk:x", "chunk", "e0", "d", "d::c0", "text", "t"), ("r", 1, "c:fact:count", "fact", "aggregate", None, None, "count", "3"), ("r", 2, "c:chunk:y", "chunk", "e1", None, "y", None, None), ("r", 2, "c:unknown", "odd", "e9", None, None, None, None)]
    frame = spark.createDataFrame(items, "qid string, place int, evidence_id string, evidence_type string, event_id string, document_id string, chunk_id string, field_name string, value string")
    nodes, edges, totals = evidence_graph.graph_of(frame, spark.createDataFrame([("q", "c:fact:nations:e1"), ("q", None)], "qid string, evidence_id string"))
    shown = {(r.qid, r.ord): r for r in nodes.collect()}
    assert len([k for k in shown if k[0] == "q"]) == 64 and shown["q", 1].id == "fact:c:fact:nations:e0:0" and shown["q", 2].id == "event:e0" and [k for k, r in shown.items() if r.cited] == [("q", 3)]
    own = {r.id for k, r in shown.items() if k[0] == "q"}
    drawn = [r for r in edges.collect() if r.qid == "q"]
    assert len(drawn) == 32 and all(r.source in own and r.target in own for r in drawn)
    assert {(r.qid, r.nodes, r.edges, r.truncated) for r in totals.collect()} == {("q", 102, 52, True), ("r", 3, 1, False)}
