"""Results of installed queries, whose JSON varies in shape, as variants: flattening, hits of vector searches, and statuses.

Nothing here fails on a payload: what isn't JSON, or is of another shape than
expected, counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS, ITEMS = "map<string,variant>", "array<variant>"
# Under which names a hit has its id, a distance its vertex, and a distance its value, the first that is there counting.
IDS, NESTED_IDS = ["v_id", "id", "attributes.id", "vertex_id"], ["id", "v_id"]
VERTICES, DISTANCES = ["key", "from", "vertex"], ["distance", "value", "score"]


def payload(text: Column) -> Column:
    """The variant of a JSON text; NULL for what isn't JSON."""
    return F.try_parse_json(text)


def as_(variant: Column, kind: str) -> Column:
    return F.try_variant_get(variant, "$", kind)


def at(variant: Column, path: str) -> Column:
    """What stands under a path of names; NULL where the variant is no object that has it."""
    return F.try_variant_get(variant, f"$.{path}", "variant")


def items(variant: Column) -> Column:
    """The elements of an array; anything else but NULL is one element."""
    return F.coalesce(as_(variant, ITEMS), F.when(variant.isNotNull() & ~F.is_variant_null(variant), F.array(variant)), F.expr(f"cast(array() as {ITEMS})"))


def merged(maps: Column) -> Column:
    """One map of an array of maps, later entries in place of earlier ones with their key; NULL maps add nothing."""
    none = F.expr(f"cast(map() as {FIELDS})")

    def over(acc: Column, own: Column) -> Column:
        names = F.map_keys(own)
        return F.when(own.isNull(), acc).otherwise(F.map_concat(F.map_filter(acc, lambda k, v: ~F.array_contains(names, k)), own))

    return F.aggregate(maps, none, over)


def flattened(variant: Column) -> Column:
    """A payload's fields as a map: those of an object, or of the objects of a list, where later ones win; else none."""
    return F.coalesce(as_(variant, FIELDS), merged(F.transform(F.coalesce(as_(variant, ITEMS), F.expr(f"cast(array() as {ITEMS})")), lambda v: as_(v, FIELDS))))


def vertex_id(variant: Column) -> Column:
    """The id of a hit: a text or number is one; an object has it under one of IDS, as a text, a number or an object with an id. NULL if blank."""
    plain = lambda v: F.nullif(F.trim(as_(v, "string")), F.lit(""))
    is_object = lambda v: as_(v, FIELDS).isNotNull()
    bare = lambda v: F.when(~is_object(v) & as_(v, ITEMS).isNull(), plain(v))
    inner = lambda v: F.coalesce(bare(v), *[bare(at(v, n)) for n in NESTED_IDS])
    return F.when(is_object(variant), F.coalesce(*[inner(at(variant, n)) for n in IDS])).otherwise(bare(variant))


def distances(variant: Column) -> Column:
    """A map of ids to distances from an object of them, a list of objects, or a list of pairs; the last of an id counts, and what isn't a number is left out."""
    pair = lambda i, d: F.struct(i.alias("id"), d.alias("distance"))
    number = lambda v: as_(v, "double")
    of_object = F.transform(F.map_entries(as_(variant, FIELDS)), lambda e: pair(F.nullif(F.trim(e["key"]), F.lit("")), number(e["value"])))

    def of_item(v: Column) -> Column:
        own = F.coalesce(*[number(at(v, n)) for n in DISTANCES])
        named = pair(F.coalesce(vertex_id(v), *[vertex_id(at(v, n)) for n in VERTICES]), own)
        both = as_(v, ITEMS)
        return F.when(as_(v, FIELDS).isNotNull(), named).when(F.size(both) >= 2, pair(vertex_id(F.get(both, F.lit(0))), number(F.get(both, F.lit(1)))))

    pairs = F.coalesce(of_object, F.transform(items(variant), of_item))
    known = F.filter(pairs, lambda p: p["id"].isNotNull() & p["distance"].isNotNull())
    none = F.expr("cast(map() as map<string,double>)")
    return F.aggregate(known, none, lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, v: k != p["id"]), F.map_from_arrays(F.array(p["id"]), F.array(p["distance"]))))


def vector_hits(rows: DataFrame, column: str = "payload") -> DataFrame:
    """rows with the hits of their payload (JSON text), one row for each: chunk_id, score, rank instead of the payload.

    Blocks with v hold hits, blocks with distances their distances. A repeated
    id counts where it comes first; a hit without a distance scores by its place;
    order is by score, then id. Payloads without hits have no rows.
    """
    rest = [c for c in rows.columns if c != column]
    blocks = items(payload(F.col(column)))
    hits = F.transform(F.flatten(F.transform(blocks, lambda b: items(at(b, "v")))), lambda v, i: F.struct(vertex_id(v).alias("id"), i.alias("place")))
    measured = F.transform(F.filter(blocks, lambda b: at(b, "distances").isNotNull()), lambda b: distances(at(b, "distances")))
    none = F.expr("cast(map() as map<string,double>)")
    every = F.aggregate(measured, none, lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, v: ~F.array_contains(F.map_keys(m), k)), m))
    found = rows.select(*rest, F.filter(hits, lambda h: h["id"].isNotNull()).alias("__hits"), every.alias("__distances"))
    first = F.filter("__hits", lambda h: ~F.exists("__hits", lambda g: (g["id"] == h["id"]) & (g["place"] < h["place"])))
    scored = F.transform(first, lambda h: F.struct((-F.coalesce(F.try_element_at("__distances", h["id"]), h["place"].cast("double"))).alias("score"), h["id"].alias("id")))
    ordered = F.transform(F.array_sort(F.transform(scored, lambda h: F.struct((-h["score"]).alias("far"), h["id"].alias("id"), h["score"].alias("score")))), lambda h, i: F.struct(h["id"].alias("chunk_id"), h["score"].alias("score"), (i + 1).cast("int").alias("rank")))
    return found.select(*rest, F.inline(ordered))


def index_ready(status: Column) -> Column:
    """Whether a status (JSON text) says that no server has an index to rebuild: it must say so by an empty list."""
    return F.coalesce(F.size(as_(at(payload(status), "NeedRebuildServers"), ITEMS)) == 0, F.lit(False))


def interpreted(results: DataFrame) -> DataFrame:
    """results (operation, threshold, temporal_relation, payload as JSON text; other columns stay) with status, reason, event_ids and count.

    An installed query's fields decide its status; ties are never broken. Where a
    temporal result has no related event the named ones stand for it. A count is
    as the query says, or that of its events. Payloads that can't be read are empty ones.
    """
    rows = results.withColumn("__f", flattened(payload(F.col("payload"))))
    field = lambda name: F.try_element_at("__f", F.lit(name))
    texts = lambda name: F.transform(items(field(name)), lambda v: as_(v, "string"))
    number = lambda name: as_(field(name), "long")
    n = lambda name: F.coalesce(number(name), F.lit(0))
    op, ids, named = F.col("operation"), texts("event_ids"), texts("named_ids")
    some, gold = F.size(ids), F.coalesce(F.get(texts("gold"), F.lit(0)), F.lit(""))
    has = F.coalesce(as_(F.get(items(field("has_nations")), F.lit(0)), "boolean"), F.lit(True))
    at_named = F.coalesce(number("named_year_hits"), F.size(named).cast("long"))
    relation = F.coalesce("temporal_relation", F.lit("previous"))
    cases = {
        "lookup_event": [(some == 0, "not_found", F.lit("event_title_not_found")), (some > 1, "ambiguous", F.lit("multiple_title_matches")), (~has, "unresolved", F.lit("missing_field:nations"))],
        "count_over_threshold": [(number("pool_size") == 0, "not_found", F.lit("no_sport_games_events")), (F.col("threshold").isNull(), "unresolved", F.lit("missing_threshold"))],
        "argmax_competitors": [((n("usable_with_competitors") == 0) & (n("pool_size") == 0), "not_found", F.lit("no_sport_games_events")), (n("usable_with_competitors") == 0, "unresolved", F.lit("missing_field:competitors")), (some > 1, "ambiguous", F.lit("tied_max_competitors"))],
        "previous_event_gold": [(at_named > 1, "ambiguous", F.lit("multiple_named_year_events")), (n("target_year") == 0, "unresolved", F.lit("related_year_unresolved")), (some == 0, "unresolved", F.concat(F.when(relation == "previous", "previous").otherwise("next"), F.lit("_event_name_missing"))), (some > 1, "ambiguous", F.lit("multiple_related_events")), (gold == "", "unresolved", F.lit("missing_field:gold"))],
        "events_at_venue_date": [((some == 0) & (n("venue_hits") == 0), "not_found", F.lit("venue_not_found")), (some == 0, "unresolved", F.lit("date_does_not_overlap")), (some > 1, "ambiguous", F.lit("multiple_events_same_venue_date")), (gold == "", "unresolved", F.lit("missing_field:gold"))],
    }
    status, reason = F.lit("supported"), F.lit(None).cast("string")
    for name, tests in cases.items():
        for test, says, why in reversed(tests):
            holds = (op == name) & F.coalesce(test, F.lit(False))
            status, reason = F.when(holds, says).otherwise(status), F.when(holds, why).otherwise(reason)
    counted = F.coalesce(number("count"), number("hit_count"), F.when(op == "count_over_threshold", some.cast("long")))
    counted = F.when((op == "count_over_threshold") & (number("pool_size") == 0), F.lit(None)).otherwise(counted)
    instead = (op == "previous_event_gold") & F.col("reason").isin("multiple_named_year_events", "previous_event_name_missing", "next_event_name_missing")
    out = rows.withColumns({"status": status, "reason": reason})
    return out.withColumns({"event_ids": F.when(instead & ((F.size(named) > 0) | (F.col("status") == "unresolved")), named).otherwise(ids), "count": counted}).drop("__f", "payload")
