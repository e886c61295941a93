"""The vector table against brute force, its upserts, and payloads of many shapes against plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import payloads, retrieval
from lodestar.sources import vector_table


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), i) for i, w in rows if i != q and len(w) == len(v) and np.any(w) and np.any(v))
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    return [(i, (centres[i % 40] + rng.normal(size=16) * 0.08).round(3).tolist()) for i in range(3000)]


def frame(spark, rows, name="vec_id"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>")


def test_table_gives_what_brute_force_gives_and_visits_few_lists(spark, cloud, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_table, "VECTORS_PER_LIST", 75)
    path = str(tmp_path / "table")
    rows = [*cloud, (9001, [0.0] * 16), (9002, cloud[5][1]), (9003, cloud[5][1])]
    odd = [(9004, None), (None, cloud[0][1]), (9005, [float("nan")] * 16), (9006, [None] * 16), (9002, cloud[5][1])]
    made = vector_table.build(frame(spark, rows + odd), path)
    assert made.ready and vector_table.manifest(spark, path) == made and len(made.lists) > 30
    assert sorted(r.vec_id for r in vector_table.read(spark, path).collect()) == sorted(i for i, _ in rows)
    queries = [(i, v) for i, v in cloud if i % 60 == 0] + [(-1, (np.array(cloud[7][1]) * 3).tolist())]
    hits, visits = vector_table.search(frame(spark, [*queries, (-2, [1.0, 2.0]), (-3, None)], "query_id"), path, 7)
    got = hits.collect()
    assert sorted(tuple(r)[:4] for r in got if r.error is None) == brute(rows, queries, 7)
    assert [(r.query_id, r.vec_id, r.error) for r in got if r.error] == [(-2, None, "dimension_mismatch")]
    seen = visits.agg(F.sum("lists"), F.sum("of")).head()
    assert seen[0] < 0.35 * seen[1]
    none, _ = vector_table.search(frame(spark, queries, "query_id"), path, 0)
    assert none.count() == 0 and vector_table.search(frame(spark, queries[:1], "query_id"), path, 10_000)[0].count() == len(rows) - 2


def test_upserts_touch_few_lists_and_happen_at_once(spark, cloud, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_table, "VECTORS_PER_LIST", 75)
    path = str(tmp_path / "table")
    before = vector_table.build(frame(spark, cloud), path)
    fresh = [(i, (np.array(v) + 0.001).tolist()) for i, v in cloud if i % 40 == 3][:20] + [(7000 + i, cloud[3][1]) for i in range(5)]
    with pytest.raises(vector_table.DimensionMismatch):
        vector_table.upsert(frame(spark, [(1, [1.0])]), path)
    broken = vector_table._commit
    monkeypatch.setattr(vector_table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        vector_table.upsert(frame(spark, fresh), path)
    monkeypatch.setattr(vector_table, "_commit", broken)
    assert vector_table.manifest(spark, path) == before and vector_table.read(spark, path).count() == len(cloud)
    after = vector_table.upsert(frame(spark, fresh), path)
    kept = [e for e in after.lists if e in before.lists]
    assert after.version == 1 and len(kept) > 0.8 * len(before.lists)
    now = dict(cloud) | dict(fresh)
    assert {r.vec_id: r.embedding for r in vector_table.read(spark, path).collect()} == now
    queries = [fresh[0], cloud[90]]
    assert sorted(tuple(r)[:4] for r in vector_table.search(frame(spark, queries, "query_id"), path, 5)[0].collect()) == brute(list(now.items()), queries, 5)
    assert vector_table.upsert(frame(spark, []), path) == after


def test_tiled_search_of_mixed_rows(spark, cloud, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTORS_PER_TILE", 400)
    monkeypatch.setattr(retrieval, "QUERIES_PER_TILE", 7)
    rows = [*cloud[:1500], (8001, [1.0, 2.0]), (8002, [2.0, 1.0]), (8003, None), (8004, [0.0] * 16)]
    queries = [(i, v) for i, v in rows if i % 50 == 0 and v] + [(8001, [1.0, 2.0])]
    got = retrieval.vector_top_k(frame(spark, rows), frame(spark, queries, "query_id"), 4).collect()
    assert sorted(tuple(r) for r in got) == brute([r for r in rows if r[1]], queries, 4)
    assert retrieval.vector_top_k(frame(spark, rows), frame(spark, queries, "query_id"), 0).count() == 0


def test_flattening_is_that_of_plain_dicts(spark):
    shapes = [{"a": 1}, [{"a": 1, "b": [1]}, {"a": {"c": 2}}, 3, "x", None, [1]], [], {}, 5, "text", None, [{"a": None}, {"a": 2}, {"a": None}]]
    frame_ = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(shapes)] + [(90, "{bad"), (91, ""), (92, None)], "n int, p string")
    got = {r.n: json.loads(r.f) for r in frame_.select("n", F.to_json(payloads.flattened(payloads.payload(F.col("p"))), {"ignoreNullFields": "false"}).alias("f")).collect()}
    for i, shape in enumerate(shapes):
        want = shape if isinstance(shape, dict) else {}
        for block in shape if isinstance(shape, list) else []:
            want = {**want, **block} if isinstance(block, dict) else want
        assert got[i] == want
    assert got[90] == got[91] == got[92] == {}


def test_hits_ids_distances_and_readiness(spark):
    cases = {
        1: ([{"v": [{"v_id": "a"}, {"id": 4}, {"vertex_id": {"v_id": "b"}}, "a", None, {}]}, {"distances": {"b": "0.25", "4": "near"}}, {"distances": [["a", 2], {"from": {"id": "4"}, "value": 1}]}], [("b", -0.25), ("4", -1.0), ("a", -2.0)]),
        2: ({"v": {"v_id": "only"}}, [("only", -0.0)]),
        3: ({"distances": {"a": 1}}, []),
        4: ("text", []),
        5: ([{"v": ["x", "y", "z"]}, {"distances": {"z": 0.5, "y": 0.5}}], [("x", -0.0), ("y", -0.5), ("z", -0.5)]),
    }
    rows = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in cases.items()] + [(8, "[{"), (9, None)], "n int, payload string")
    got: dict = {}
    for r in sorted(payloads.vector_hits(rows).collect(), key=lambda r: (r.n, r["rank"])):
        got.setdefault(r.n, []).append((r.chunk_id, r.score))
    assert got == {i: c[1] for i, c in cases.items() if c[1]}
    status = {'{"NeedRebuildServers": []}': True, '{"NeedRebuildServers": ["s1"]}': False, '{"NeedRebuildServers": null}': False, '{"NeedRebuildServers": ""}': False, "{}": False, "[]": False, "x": False}
    frame_ = spark.createDataFrame([(s,) for s in status] + [(None,)], "s string")
    assert {r.s: r.ok for r in frame_.select("s", payloads.index_ready(F.col("s")).alias("ok")).collect()} == status | {None: False}
