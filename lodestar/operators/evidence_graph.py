"""What a run showed: ids in the order in which they came, and the graph that its evidence draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.files import dealt

# The kind of vertex to which an edge leads, what a fact's value is, and how much of a graph is shown.
NEIGHBOURS = {"HELD_AT": "venue", "IN_GAMES": "games", "OF_SPORT": "sport"}
FACTS = {"gold_raw": "athlete"}
MOST_NODES, MOST_EDGES = 64, 96
#: An event id that stands for a whole set names none.
AGGREGATE = "aggregate"


def said(value: Column) -> Column:
    """Trimmed text; NULL for nothing."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def in_order(*arrays: Column) -> Column:
    """The values of arrays one after the other, trimmed, each where it comes first; NULL arrays and blank values are left out."""
    none = F.expr("cast(array() as array<string>)")
    every = F.concat(*[F.coalesce(a.cast("array<string>"), none) for a in arrays])
    return F.array_distinct(F.filter(F.transform(every, said), lambda v: v.isNotNull()))


def observable_ids(runs: DataFrame) -> DataFrame:
    """qid with evidence_ids, chunk_ids, document_ids, event_ids of a run, each id once, in the order in which it was seen.

    runs has evidence and citations, arrays of structs (evidence_id, chunk_id,
    source_chunk_id, document_id, event_id, event_ids), observations (evidence_ids,
    event_ids) and slot_updates (evidence_ids); any may be NULL. A run is one row,
    so nothing is shuffled.
    """
    none = F.expr("cast(array() as array<string>)")
    shown = F.concat(*[F.coalesce(c, F.array()) for c in ("evidence", "citations")])
    of = lambda name: F.transform(shown, lambda i: i[name].cast("string"))
    chunk = F.transform(shown, lambda i: F.coalesce(said(i["chunk_id"]), said(i["source_chunk_id"])))
    events = F.flatten(F.transform(shown, lambda i: F.concat(F.array(i["event_id"].cast("string")), F.coalesce(i["event_ids"], none))))
    inner = lambda column, name: F.flatten(F.transform(F.coalesce(column, F.array()), lambda o: F.coalesce(o[name], none)))
    return runs.select("qid", in_order(of("evidence_id"), inner(F.col("observations"), "evidence_ids"), inner(F.col("slot_updates"), "evidence_ids")).alias("evidence_ids"), in_order(chunk).alias("chunk_ids"), in_order(of("document_id")).alias("document_ids"), in_order(events, inner(F.col("observations"), "event_ids")).alias("event_ids"))


def first_mentions(mentions: DataFrame, by: list[str]) -> DataFrame:
    """mentions (by, id, place) with each id once, at its least place: an aggregate that merges in every task, so no run is ordered whole."""
    return mentions.where(said(F.col("id")).isNotNull()).groupBy(*by, said(F.col("id")).alias("id")).agg(F.min("place").alias("place"))


def parsed_id(evidence_id: Column) -> Column:
    """What a composite id (call:kind:...) names: call, evidence_type, field_name, event_id, value, chunk_id, document_id.

    Ids of events, neighbours and chunks may hold colons themselves. A chunk's
    document is what comes before '::'. Anything else is of unknown type.
    """
    part = lambda pattern, group: F.regexp_extract(evidence_id, pattern, group)
    entity, fact, edge, chunk = r"(?s)^[^:]*:entity:(.*)$", r"(?s)^[^:]*:fact:([^:]*):(.*)$", r"(?s)^[^:]*:edge:([^:]*):(.*)$", r"(?s)^[^:]*:chunk:(.*)$"
    kind = F.when(evidence_id.rlike(entity), "entity").when(evidence_id.rlike(fact), "fact").when(evidence_id.rlike(edge), "edge").when(evidence_id.rlike(chunk), "chunk").otherwise("unknown")
    text = F.lit(None).cast("string")
    own_chunk = F.when(kind == "chunk", part(chunk, 1))
    return F.struct(
        F.split_part(evidence_id, F.lit(":"), F.lit(1)).alias("call"), kind.alias("evidence_type"),
        F.when(kind == "entity", "title").when(kind == "fact", part(fact, 1)).when(kind == "edge", part(edge, 1)).otherwise(text).alias("field_name"),
        F.when(kind == "entity", part(entity, 1)).when(kind == "fact", part(fact, 2)).otherwise(text).alias("event_id"),
        F.when(kind == "entity", part(entity, 1)).when(kind == "fact", part(fact, 1)).when(kind == "edge", part(edge, 2)).otherwise(text).alias("value"),
        own_chunk.alias("chunk_id"), F.when(F.contains(own_chunk, F.lit("::")), F.split_part(own_chunk, F.lit("::"), F.lit(1))).alias("document_id"),
    )


def graph_of(items: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (qid, ord, id, kind, label, cited), edges (qid, ord, source, target, label, evidence_id) and totals (qid, nodes, edges, truncated) of evidence.

    items have qid, place (their order), evidence_id, evidence_type, event_id,
    document_id, chunk_id, field_name and value; citations qid and evidence_id.
    Only what evidence names is drawn. Nodes and edges stand in the order in
    which they are first named; MOST_NODES nodes are shown, and of the edges
    between shown nodes MOST_EDGES, so none leads to a node that was cut off.
    """
    many = items.count()
    cited = dealt(citations.where("evidence_id is not null").select("qid", "evidence_id"), many, "qid", "evidence_id").distinct().withColumn("cited", F.lit(True))
    rows = dealt(dealt(items, many, "qid", "evidence_id").join(cited, ["qid", "evidence_id"], "left"), many, "qid").withColumn("cited", F.coalesce("cited", F.lit(False)))
    kind, no = F.col("evidence_type"), F.lit(False)
    event = F.nullif(said(F.col("event_id")), F.lit(AGGREGATE))
    document, chunk, value = said(F.col("document_id")), said(F.col("chunk_id")), F.coalesce(F.col("value"), F.lit(""))
    field = F.coalesce(said(F.col("field_name")), F.when(kind == "fact", "fact").otherwise(F.coalesce(said(F.col("value")), F.lit("related"))))
    tables = [F.create_map(*[F.lit(x) for pair in t.items() for x in pair]) for t in (NEIGHBOURS, FACTS)]
    leads, is_a = F.coalesce(F.try_element_at(tables[0], field), F.lit("entity")), F.coalesce(F.try_element_at(tables[1], field), F.lit("fact"))
    ids = {"event": F.concat(F.lit("event:"), event), "fact": F.concat(F.lit("fact:"), F.coalesce(said(F.col("evidence_id")), field), F.lit(":"), value), "edge": F.concat(leads, F.lit(":"), value), "document": F.concat(F.lit("document:"), document), "chunk": F.concat(F.lit("chunk:"), chunk)}
    node = lambda id_, what, label, mark: F.struct(id_.alias("id"), what.alias("kind"), F.coalesce(said(label), id_).alias("label"), mark.alias("cited"))
    plain_event, mark = node(ids["event"], F.lit("event"), event, no), F.col("cited")
    named = F.coalesce(
        F.when(kind == "entity", F.array(node(ids["event"], F.lit("event"), F.coalesce(said(F.col("value")), event), mark))),
        F.when(kind == "fact", F.array(node(ids["fact"], is_a, F.coalesce(said(value), field), mark), plain_event)),
        F.when(kind == "edge", F.array(node(ids["edge"], leads, F.replace(value, F.lit("_"), F.lit(" ")), mark), plain_event)),
        F.when(kind == "document", F.array(node(ids["document"], F.lit("document"), document, mark))),
        F.when(kind == "chunk", F.array(node(ids["chunk"], F.lit("chunk"), chunk, mark), node(ids["document"], F.lit("document"), document, mark), plain_event)),
    )
    edge = lambda a, b, label: F.struct(a.alias("source"), b.alias("target"), label.alias("label"))
    drawn = F.coalesce(
        F.when(kind == "fact", F.array(edge(ids["event"], ids["fact"], field))),
        F.when(kind == "edge", F.array(edge(ids["event"], ids["edge"], field))),
        F.when(kind == "chunk", F.array(edge(ids["document"], ids["chunk"], F.lit("CONTAINS_CHUNK")), F.when(document.isNotNull(), edge(ids["document"], ids["event"], F.lit("DESCRIBES"))).otherwise(edge(ids["chunk"], ids["event"], F.lit("event_id"))))),
    )
    at = F.struct("place", "evidence_id", "sub")
    mentions = rows.select("qid", "place", "evidence_id", F.posexplode(named).alias("sub", "n")).where("n.id is not null")
    nodes = mentions.groupBy("qid", F.col("n.id").alias("id")).agg(F.min(at).alias("at"), F.min_by("n", at).alias("n"), F.max("n.cited").alias("cited"))
    links = rows.select("qid", "place", "evidence_id", F.posexplode(drawn).alias("sub", "e")).where("e.source is not null and e.target is not null and e.source <> e.target")
    edges = links.groupBy("qid", "e").agg(F.min(at).alias("at"))
    place = lambda: F.row_number().over(Window.partitionBy("qid").orderBy("at"))
    shown = nodes.withColumn("ord", place()).where(F.col("ord") <= MOST_NODES)
    kept = lambda end: shown.select("qid", F.col("id").alias(end))
    ends = edges.select("qid", "at", "e.*")
    between = ends.join(kept("source"), ["qid", "source"], "left_semi").join(kept("target"), ["qid", "target"], "left_semi")
    first = between.withColumn("ord", place()).where(F.col("ord") <= MOST_EDGES)
    n = lambda df, name: df.groupBy("qid").agg(F.count(F.lit(1)).alias(name))
    totals = n(nodes, "nodes").join(n(ends, "edges"), "qid", "left").select("qid", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))
    totals = totals.withColumn("truncated", (F.col("nodes") > MOST_NODES) | (F.col("edges") > MOST_EDGES))
    return shown.select("qid", "ord", "id", "n.kind", "n.label", "cited"), first.select("qid", "ord", "source", "target", "label", F.col("at.evidence_id").alias("evidence_id")), totals
