"""Queries of the vector table, payloads and ordinals, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import evidence_graph, graph, payloads
from lodestar.queries.catalog import QUERIES, VECTOR_SQL, ev, query
from lodestar.sources import export, files, vector_table
from lodestar.sources.tables import event_view, read_table

__all__ = ["QUERIES"]


@query(VECTOR_SQL.format("a.vec_id % 50 = 0", 10))
def vector_lists_topk(spark, sf_dir) -> DataFrame:
    """The stated query set, every row whose id is divisible by 50, against a table of all vectors in lists."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = files.scratch(spark, "vector-table")
    vector_table.build(vectors, path)
    hits, _ = vector_table.search(vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), path, 10)
    return hits.select("query_id", "vec_id", "score", "rank")


@query("""WITH t AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_reverse(embedding)::DOUBLE[] ELSE embedding::DOUBLE[] END AS e FROM embeddings UNION ALL SELECT vec_id + 10000000, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 7 = 0)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, t.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], t.e), 6) AS score FROM embeddings q JOIN t ON q.vec_id <> t.vec_id WHERE q.vec_id % 50 = 0) QUALIFY rank <= 5""")
def vector_table_upsert(spark, sf_dir) -> DataFrame:
    """Each tenth vector turned around and copies of each seventh put into a table of all, then searched."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = files.scratch(spark, "vector-table")
    vector_table.build(vectors, path)
    turned = vectors.where("vec_id % 10 = 0").select("vec_id", F.reverse("embedding").alias("embedding"))
    copies = vectors.where("vec_id % 7 = 0").select((F.col("vec_id") + 10000000).alias("vec_id"), "embedding")
    vector_table.upsert(turned.unionByName(copies), path)
    hits, _ = vector_table.search(vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), path, 5)
    return hits.select("query_id", "vec_id", "score", "rank")


def _shaped(orders: DataFrame) -> DataFrame:
    """Each order's payload, in a shape that goes by its key."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    seventh = (k % 7).cast("string")
    shapes = [
        F.concat(F.lit('{"event_ids": ["'), text, F.lit('"], "count": '), seventh, F.lit("}")),
        F.concat(F.lit('[{"event_ids": ["x"], "count": 1}, {"count": '), seventh, F.lit(', "titles": ["Order '), text, F.lit('"]}]')),
        F.concat(F.lit('["junk", 5, null, {"event_ids": '), text, F.lit("}]")),
        F.lit('{"event_ids": ['),
        F.lit(None).cast("string"),
    ]
    return orders.select("o_orderkey", F.coalesce(*[F.when(k % 5 == i, s) for i, s in enumerate(shapes)]).alias("payload"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'count,event_ids' WHEN 1 THEN 'count,event_ids,titles' WHEN 2 THEN 'event_ids' ELSE '' END AS names, CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 7 END AS "count",
CASE o_orderkey % 5 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN 'x' WHEN 2 THEN o_orderkey::VARCHAR ELSE '' END AS ids FROM orders""")
def flattened_payloads(spark, sf_dir) -> DataFrame:
    rows = _shaped(read_table(spark, sf_dir, "orders")).withColumn("f", payloads.flattened(payloads.payload(F.col("payload"))))
    field = lambda name: F.try_element_at("f", F.lit(name))
    ids = F.transform(payloads.items(field("event_ids")), lambda v: payloads.as_(v, "string"))
    return rows.select("o_orderkey", F.array_join(F.array_sort(F.map_keys("f")), ",").alias("names"), payloads.as_(field("count"), "long").alias("count"), F.array_join(ids, ",").alias("ids"))


@query("""SELECT o_orderkey, chunk_id, score, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM (
SELECT o_orderkey, unnest(['a' || o_orderkey::VARCHAR, 'b', '7']) AS chunk_id, unnest([-0.5::DOUBLE, -1.0::DOUBLE, CASE o_orderkey % 4 WHEN 3 THEN -4.0 ELSE -(o_orderkey % 9)::DOUBLE / 8 END]) AS score FROM orders WHERE o_orderkey % 4 < 4)""")
def vector_payload_hits(spark, sf_dir) -> DataFrame:
    """Hits whose ids and distances stand in four shapes, with a repeated id, and an id or two without a distance."""
    k = F.col("o_orderkey")
    own, eighth = F.concat(F.lit("a"), k.cast("string")), ((k % 9) / 8).cast("string")
    hits = F.concat(F.lit('{"v": [{"v_id": "'), own, F.lit('"}, "b", {"v_id": {"id": "'), own, F.lit('"}}, " ", {"attributes": {"id": 7}}]}'))
    known = [
        F.concat(F.lit('{"'), own, F.lit('": 0.5, "7": '), eighth, F.lit(', "z": "far"}')),
        F.concat(F.lit('[{"v_id": "'), own, F.lit('", "distance": 0.5}, {"key": "7", "score": '), eighth, F.lit("}]")),
        F.concat(F.lit('[["'), own, F.lit('", 9], ["'), own, F.lit('", 0.5], [7, "'), eighth, F.lit('"], ["b"]]')),
        F.concat(F.lit('{"'), own, F.lit('": 0.5}')),
    ]
    measured = F.coalesce(*[F.when(k % 4 == i, d) for i, d in enumerate(known)])
    text = F.concat(F.lit("["), hits, F.lit(', "junk", {"distances": '), measured, F.lit("}]"))
    return payloads.vector_hits(read_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("payload")))


INTERPRETED = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS op, o_orderkey % 3 AS ids, o_orderkey % 4 AS pool, o_orderkey % 7 AS y, o_orderkey % 2 AS g FROM orders)
SELECT k AS o_orderkey, CASE op WHEN 0 THEN CASE WHEN ids = 0 THEN 'not_found' WHEN ids > 1 THEN 'ambiguous' WHEN g = 0 THEN 'unresolved' ELSE 'supported' END
 WHEN 1 THEN CASE WHEN pool = 0 THEN 'not_found' WHEN y = 0 THEN 'unresolved' ELSE 'supported' END WHEN 2 THEN CASE WHEN g = 0 AND pool = 0 THEN 'not_found' WHEN g = 0 THEN 'unresolved' WHEN ids > 1 THEN 'ambiguous' ELSE 'supported' END
 WHEN 3 THEN CASE WHEN pool > 1 THEN 'ambiguous' WHEN y = 0 THEN 'unresolved' WHEN ids = 0 THEN 'unresolved' WHEN ids > 1 THEN 'ambiguous' WHEN g = 0 THEN 'unresolved' ELSE 'supported' END
 ELSE CASE WHEN ids = 0 AND pool = 0 THEN 'not_found' WHEN ids = 0 THEN 'unresolved' WHEN ids > 1 THEN 'ambiguous' WHEN g = 0 THEN 'unresolved' ELSE 'supported' END END AS status,
CASE op WHEN 0 THEN CASE WHEN ids = 0 THEN 'event_title_not_found' WHEN ids > 1 THEN 'multiple_title_matches' WHEN g = 0 THEN 'missing_field:nations' END
 WHEN 1 THEN CASE WHEN pool = 0 THEN 'no_sport_games_events' WHEN y = 0 THEN 'missing_threshold' END WHEN 2 THEN CASE WHEN g = 0 AND pool = 0 THEN 'no_sport_games_events' WHEN g = 0 THEN 'missing_field:competitors' WHEN ids > 1 THEN 'tied_max_competitors' END
 WHEN 3 THEN CASE WHEN pool > 1 THEN 'multiple_named_year_events' WHEN y = 0 THEN 'related_year_unresolved' WHEN ids = 0 THEN 'next_event_name_missing' WHEN ids > 1 THEN 'multiple_related_events' WHEN g = 0 THEN 'missing_field:gold' END
 ELSE CASE WHEN ids = 0 AND pool = 0 THEN 'venue_not_found' WHEN ids = 0 THEN 'date_does_not_overlap' WHEN ids > 1 THEN 'multiple_events_same_venue_date' WHEN g = 0 THEN 'missing_field:gold' END END AS reason,
CASE WHEN op = 3 AND (pool > 1 OR (y <> 0 AND ids = 0)) THEN array_to_string(list_transform(range(pool), lambda i: 'n' || i::VARCHAR), ',') ELSE array_to_string(list_transform(range(ids), lambda i: 'e' || i::VARCHAR), ',') END AS event_ids,
CASE WHEN op = 1 AND pool > 0 THEN ids END AS "count" FROM o"""


@query(INTERPRETED)
def interpreted_results(spark, sf_dir) -> DataFrame:
    """A payload of one of five operations for each order, read to its status."""
    k = F.col("o_orderkey")
    ops = ["lookup_event", "count_over_threshold", "argmax_competitors", "previous_event_gold", "events_at_venue_date"]
    made = lambda letter, n: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.concat(F.lit(letter), i.cast("string")))).otherwise(F.expr("cast(array() as array<string>)"))
    ids, pool, year, good = k % 3, k % 4, k % 7, k % 2
    body = F.struct(made("e", ids).alias("event_ids"), made("n", pool).alias("named_ids"), pool.alias("pool_size"), good.alias("usable_with_competitors"), F.array(good == 1).alias("has_nations"), year.alias("target_year"), pool.alias("venue_hits"), F.array(F.when(good == 1, "Ann").otherwise("")).alias("gold"))
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(*[F.when(k % 5 == i, o) for i, o in enumerate(ops)]).alias("operation"), F.when(year != 0, F.lit(3)).alias("threshold"), F.lit("next").alias("temporal_relation"), F.concat(F.lit("["), F.to_json(body), F.lit("]")).alias("payload"))
    return payloads.interpreted(rows).select("o_orderkey", "status", "reason", F.array_join("event_ids", ",").alias("event_ids"), "count")


@query("SELECT doc_id, row_number() OVER () - 1 AS doc_ord FROM documents")
def corpus_ordinals(spark, sf_dir) -> DataFrame:
    return files.numbered(read_table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "doc_ord")


@query("SELECT lang, count(*) AS n, min(o) AS first_seen FROM (SELECT lang, row_number() OVER () - 1 AS o FROM documents) GROUP BY lang")
def first_seen_counts(spark, sf_dir) -> DataFrame:
    """Values by how often they occur, with the ordinal of the first document that has each: ties of counts go by it."""
    return files.numbered(read_table(spark, sf_dir, "documents").select("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_ord").alias("first_seen"))


@query(ev("""SELECT 'Document' AS "table", count(*) + 1 AS n, 0 AS dangling FROM ev UNION ALL SELECT 'Event', count(*) FILTER (id % 11 <> 0 OR id % 22 = 0), 0 FROM ev
UNION ALL SELECT 'Games', count(DISTINCT (year, season)), 0 FROM sent UNION ALL SELECT 'Sport', count(DISTINCT sport), 0 FROM sent UNION ALL SELECT 'Venue', count(DISTINCT lower(trim(venue))), 0 FROM sent
UNION ALL SELECT 'Chunk', count(*) FILTER (l_linenumber <> 3), 0 FROM line UNION ALL SELECT 'CONTAINS_CHUNK', count(*) FILTER (l_linenumber <> 3), count(*) FILTER (l_linenumber = 3) FROM line
UNION ALL SELECT 'DESCRIBES', count(*) FILTER (id % 11 <> 0 OR id % 22 = 0), count(*) FILTER (id % 11 = 0 AND id % 22 <> 0) FROM ev
UNION ALL SELECT 'IN_GAMES', count(*), 0 FROM sent UNION ALL SELECT 'OF_SPORT', count(*), 0 FROM sent UNION ALL SELECT 'HELD_AT', count(*), 0 FROM sent""",
", sent AS (SELECT * FROM ev WHERE id % 11 <> 0), line AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT id FROM ev))"))
def graph_upsert(spark, sf_dir) -> DataFrame:
    """The whole graph exported, loaded and put into a base that has some of it already; edges to vertices that neither has are counted and left out."""
    events = files.stash(event_view(spark, sf_dir).select("id", "title", "sport", "year", "season", "event_name", "competitors", "venue"), "events")
    page = F.concat(F.lit("d"), F.col("id").cast("string"))
    documents = events.select(page.alias("id"), "title", F.col("id").cast("string").alias("event_id"))
    lines = read_table(spark, sf_dir, "lineitem")
    lines = files.dealt(lines, lines.count(), "l_orderkey").join(events.select(F.col("id").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber").distinct()
    lines = files.stash(lines, "lines")
    key = F.col("l_orderkey").cast("string")
    chunks = lines.select(F.concat_ws("::", key, F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.lit("d"), key).alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.lit("lead").alias("section"))
    sent = graph.whole_graph(documents, events.where("id % 11 <> 0"), chunks)
    sent["Chunk"] = sent["Chunk"].where("chunk_index <> 3")
    path = files.scratch(spark, "whole-graph")
    export.export(sent, path)
    loaded = export.load(spark, path)
    old = {"Document": documents.where("id like '%0'").withColumn("title", F.lit("old")).unionByName(spark.createDataFrame([("x", "own", None)], "id string, title string, event_id string")), "Event": events.where("id % 22 = 0").select(*[F.col(c).cast("string").alias(c) if c == "id" else F.col(c) for c in events.columns])}
    base = {name: old[name].select(*[F.col(c).cast(kind).alias(c) for c, kind in loaded[name].dtypes]) for name in old}
    # written, as each table of vertices meets all its edges; counts need the keys only
    live = {name: files.stash(table.select(*graph.keys_of(name)), f"live-{name}") for name, table in graph.merged_graph(base, loaded).items()}
    lost = graph.dangling(live).groupBy(F.col("edge").alias("table")).agg(F.countDistinct("src", "tgt").alias("dangling"))
    counted = graph.counts(graph.with_whole_edges(live))
    return counted.join(lost, "table", "left").select("table", "n", F.coalesce("dangling", F.lit(0)).cast("int").alias("dangling"))


@query("""WITH m AS (SELECT conv_id AS qid, 'evidence' AS kind, role || ':' || (turn % 3)::VARCHAR AS id, turn AS place FROM conversations UNION ALL SELECT conv_id, 'chunk', 'c' || (turn % 2)::VARCHAR, turn FROM conversations
UNION ALL SELECT conv_id, 'evidence', 'seen:' || (turn % 5)::VARCHAR, 100000 + turn FROM conversations UNION ALL SELECT conv_id, 'event', role, turn FROM conversations),
f AS (SELECT qid, kind, id, min(place) AS place FROM m GROUP BY ALL)
SELECT qid, coalesce(string_agg(id, ',' ORDER BY place) FILTER (kind = 'evidence'), '') AS evidence_ids, coalesce(string_agg(id, ',' ORDER BY place) FILTER (kind = 'chunk'), '') AS chunk_ids, '' AS document_ids, coalesce(string_agg(id, ',' ORDER BY place) FILTER (kind = 'event'), '') AS event_ids FROM f GROUP BY qid""")
def observable_ids(spark, sf_dir) -> DataFrame:
    """Each conversation as a run: its turns as evidence, and what its observations saw besides."""
    text = lambda c: F.col(c).cast("string")
    none, own = F.lit(None).cast("string"), F.concat(F.col("role"), F.lit(":"), (F.col("turn") % 3).cast("string"))
    item = F.struct(own.alias("evidence_id"), none.alias("chunk_id"), F.concat(F.lit(" c"), (F.col("turn") % 2).cast("string"), F.lit(" ")).alias("source_chunk_id"), none.alias("document_id"), text("role").alias("event_id"), F.expr("cast(null as array<string>)").alias("event_ids"))
    seen = F.struct(F.array(F.concat(F.lit("seen:"), (F.col("turn") % 5).cast("string"))).alias("evidence_ids"), F.array(F.lit("")).alias("event_ids"))
    listed = lambda name: F.transform("own", lambda o: o[name])
    runs = read_table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("qid")).agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("item"), seen.alias("seen")))).alias("own"))
    runs = runs.select("qid", listed("item").alias("evidence"), F.expr("null").cast("array<struct<evidence_id:string,chunk_id:string,source_chunk_id:string,document_id:string,event_id:string,event_ids:array<string>>>").alias("citations"), listed("seen").alias("observations"), F.expr("cast(null as array<struct<evidence_ids:array<string>>>)").alias("slot_updates"))
    return evidence_graph.observable_ids(runs).select("qid", *[F.array_join(c, ",").alias(c) for c in ("evidence_ids", "chunk_ids", "document_ids", "event_ids")])


GRAPH_SQL = """WITH i AS (SELECT l_orderkey AS qid, l_linenumber AS p, l_partkey % 3 AS a, l_suppkey % 7 AS s FROM lineitem),
n AS (SELECT qid, p * 10 AS o, 'event:e' || a::VARCHAR AS id FROM i WHERE p % 3 = 0 UNION ALL SELECT qid, p * 10, 'athlete:' FROM i WHERE false
UNION ALL SELECT qid, p * 10, 'fact:c:fact:gold_raw:e' || a::VARCHAR || ':' || s::VARCHAR FROM i WHERE p % 3 = 1 UNION ALL SELECT qid, p * 10 + 1, 'event:e' || a::VARCHAR FROM i WHERE p % 3 > 0
UNION ALL SELECT qid, p * 10, 'venue:h' || s::VARCHAR FROM i WHERE p % 3 = 2),
e AS (SELECT qid, 'event:e' || a::VARCHAR AS s, CASE p % 3 WHEN 1 THEN 'fact:c:fact:gold_raw:e' || a::VARCHAR || ':' || s::VARCHAR ELSE 'venue:h' || s::VARCHAR END AS t FROM i WHERE p % 3 > 0)
SELECT n.qid, n.nodes, coalesce(e.edges, 0) AS edges, n.nodes > 64 OR coalesce(e.edges, 0) > 96 AS truncated FROM (SELECT qid, count(DISTINCT id) AS nodes FROM n GROUP BY qid) n LEFT JOIN (SELECT qid, count(DISTINCT (s, t)) AS edges FROM e GROUP BY qid) e USING (qid)"""


@query(GRAPH_SQL)
def evidence_graph_nodes(spark, sf_dir) -> DataFrame:
    """Each order's lines as evidence: entities, facts and edges, drawn as a graph."""
    line = F.col("l_linenumber")
    event = F.concat(F.lit("e"), (F.col("l_partkey") % 3).cast("string"))
    other = (F.col("l_suppkey") % 7).cast("string")
    which = lambda a, b, c: F.when(line % 3 == 0, a).when(line % 3 == 1, b).otherwise(c)
    none = F.lit(None).cast("string")
    hall = F.concat(F.lit("h"), other)
    items = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("qid"), line.alias("place"), F.concat(F.lit("c:"), which(F.concat(F.lit("entity:"), event), F.concat(F.lit("fact:gold_raw:"), event), F.concat(F.lit("edge:HELD_AT:"), hall))).alias("evidence_id"),
        which(F.lit("entity"), F.lit("fact"), F.lit("edge")).alias("evidence_type"), event.alias("event_id"), none.alias("document_id"), none.alias("chunk_id"), which(F.lit("title"), F.lit("gold_raw"), F.lit("HELD_AT")).alias("field_name"), which(none, other, hall).alias("value"),
    )
    return evidence_graph.graph_of(items, items.where("place = 1").select("qid", "evidence_id"))[2]
