"""Pages to parsed documents and events: one pass, no shuffle, all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import calendar, infobox, names

RECORD = "doc_id string, title string, url string, wikidata_qid string, wikipedia_pageid bigint, approx_tokens int, text string"


def _first(fields: Column, *keys: str) -> Column:
    return F.coalesce(*[infobox.value_of(fields, k) for k in keys])


def _flags(**tests: Column) -> Column:
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


def _provenance(fields: Column) -> Column:
    """Where each value was read: a map from its name to document, page, field and raw text."""
    title, parsed = F.col("title"), F.col("title_parse.parsed")
    read = {
        "title": ("title", title),
        "sport": ("title", F.when(parsed, title)),
        "year": ("title", F.when(parsed, title)),
        "season": ("title", F.when(parsed, title)),
        "event_name": ("title", F.col("title_parse.event_name")),
        "infobox_event": ("event", infobox.value_of(fields, "event")),
        "infobox_games": ("games", infobox.value_of(fields, "games")),
        "prev_year": ("prev", infobox.value_of(fields, "prev")),
        "next_year": ("next", infobox.value_of(fields, "next")),
    }
    read |= {k: (k, infobox.value_of(fields, k)) for k in ("competitors", "nations", "gold", "goldNOC")}
    read |= {k.removesuffix("s"): (F.when(infobox.value_of(fields, k.removesuffix("s")).isNull(), k).otherwise(k.removesuffix("s")), _first(fields, k.removesuffix("s"), k)) for k in ("venues", "dates")}

    def entry(name: str, field: str | Column, raw: Column) -> Column:
        field = F.lit(field) if isinstance(field, str) else field
        return F.when(raw.isNotNull(), F.struct(F.lit(name).alias("key"), F.struct(F.col("doc_id").alias("document_id"), title.alias("page_title"), field.alias("field_name"), raw.alias("raw_text")).alias("value")))

    return F.map_from_entries(F.array_compact(F.array(*[entry(name, *pair) for name, pair in read.items()])))


def parse_documents(records: DataFrame, event_fields: list[str] | None = None) -> DataFrame:
    """Corpus records (doc_id, title, text; url and ids where present) with what their title and infobox say.

    Only a page with an infobox of an event is an event; then `event` is not
    NULL. Where title and infobox name different Games the title holds, and a
    flag says so. NULL title or text count as empty. Values that can't be read
    are NULL, with a flag. Repeated records give repeated rows. With
    event_fields, `event` has only these fields, and the others aren't computed.
    """
    has = set(records.columns)
    own = [F.trim(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("doc_id"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "text")]]
    kinds = {"url": "string", "wikidata_qid": "string", "wikipedia_pageid": "bigint", "approx_tokens": "int"}
    own += [(F.col(c).try_cast(kind) if c in has else F.lit(None).cast(kind)).alias(c) for c, kind in kinds.items()]
    rows = records.select(*own).withColumns({"title_parse": infobox.parse_title(F.col("title")), "has_olympic_infobox": infobox.has_infobox(F.col("text")), "fields": infobox.infobox_fields(F.col("text"))})

    fields, title, boxed = F.col("fields"), F.col("title_parse"), F.col("has_olympic_infobox")
    names_event = title["parsed"] & title["event_name"].isNotNull()
    raw = {c: _first(fields, *keys) for c, keys in {"games_raw": ["games"], "venue_raw": ["venue", "venues"], "date_raw": ["date", "dates"], "competitors_raw": ["competitors"], "nations_raw": ["nations"], "prev_raw": ["prev"], "next_raw": ["next"], "event_raw": ["event"]}.items()}
    rows = rows.withColumns(raw | {"date_field": F.when(infobox.value_of(fields, "date").isNotNull(), "date").otherwise("dates"), "medals": infobox.medals(fields)})
    box_year, box_season = infobox.part(F.col("games_raw"), infobox.GAMES, 1).cast("int"), infobox.season_name(infobox.part(F.col("games_raw"), infobox.GAMES, 2))
    rows = rows.withColumns({"box_year": box_year, "box_season": box_season, "competitors": names.first_int(F.col("competitors_raw")), "nations": names.first_int(F.col("nations_raw"))})
    from_box = title["year"].isNull() & F.col("box_year").isNotNull()
    rows = rows.withColumns({"year": F.coalesce(title["year"], F.col("box_year")), "season": F.when(from_box, F.col("box_season")).otherwise(title["season"])})
    conflict = title["year"].isNotNull() & F.col("box_year").isNotNull() & ((title["year"] != F.col("box_year")) | (title["season"] != F.col("box_season")))
    more_than_number = lambda c: F.col(c).isNotNull() & ~F.col(f"{c}_raw").rlike(r"^-*[0-9]+\z")
    unread = lambda c: F.col(f"{c}_raw").isNotNull() & F.col(c).isNull()
    event_flags = _flags(
        title_infobox_games_conflict=conflict,
        infobox_without_title_parse=~title["parsed"],
        malformed_competitors=unread("competitors"),
        malformed_nations=unread("nations"),
        competitors_has_extra_text=more_than_number("competitors"),
        nations_has_extra_text=more_than_number("nations"),
        missing_venue=F.col("venue_raw").isNull(),
        missing_date=F.col("date_raw").isNull(),
        missing_competitors=F.col("competitors").isNull(),
        missing_nations=F.col("nations").isNull(),
        missing_gold=~F.exists("medals", lambda m: m["place"] == "gold"),
    )
    source = F.when(conflict, "title_preferred").when(title["year"].isNotNull(), "title").when(from_box, "infobox").otherwise("missing")
    own_fields = {
        "event_id": F.col("doc_id"), "document_id": F.col("doc_id"), "title": F.col("title"),
        "sport_raw": title["sport"], "sport": infobox.or_null(F.lower(infobox.strip(F.regexp_replace(title["sport"], r"(?U)\s+", " ")))),
        "event_name_raw": F.coalesce(title["event_name"], F.col("event_raw")), "infobox_event": F.col("event_raw"), "year": F.col("year"), "season": F.col("season"),
        "games_id": F.concat(F.col("year").cast("string"), F.lit("_"), F.col("season")), "infobox_games_raw": F.col("games_raw"), "year_source": source,
        "venue_raw": F.col("venue_raw"), "venue_key": infobox.or_null(F.lower(infobox.strip(F.regexp_replace(F.col("venue_raw"), r"(?U)\s+", " ")))),
        "date": calendar.date_span(F.col("date_raw"), F.col("date_field"), F.col("year")),
        "competitors_raw": F.col("competitors_raw"), "competitors": F.col("competitors"), "nations_raw": F.col("nations_raw"), "nations": F.col("nations"), "medals": F.col("medals"),
        "prev_year_raw": F.col("prev_raw"), "prev_year": infobox.year_value(F.col("prev_raw")),
        "next_year_raw": F.col("next_raw"), "next_year": infobox.year_value(F.col("next_raw")),
        "flags": event_flags, "provenance": _provenance(fields),
    }
    event = F.struct(*[value.alias(name) for name, value in own_fields.items() if event_fields is None or name in event_fields])
    page_flags = _flags(olympic_event_title=names_event, games_overview_title=title["parsed"] & ~names_event, rejected_event_title=names_event & ~boxed)
    return rows.select(
        "doc_id", "title", "url", "wikidata_qid", "wikipedia_pageid", "approx_tokens", "text", "has_olympic_infobox", "title_parse",
        F.when(boxed, infobox.field_map(fields)).otherwise(F.create_map().cast("map<string,string>")).alias("infobox"),
        F.when(boxed, "event").otherwise("document").alias("kind"),
        F.when(~boxed, F.when(names_event, "olympic_title_without_infobox").otherwise("no_olympic_event_infobox")).alias("rejection_reason"),
        F.when(boxed, F.array_distinct(F.concat(page_flags, event_flags))).otherwise(page_flags).alias("flags"),
        F.when(boxed, event).alias("event"),
    )


#: The fields of an event that solver_events reads.
SOLVER_FIELDS = ["event_id", "sport", "year", "season", "event_name_raw", "competitors", "nations", "venue_raw", "date", "medals", "prev_year", "next_year"]


def solver_events(parsed: DataFrame, *more: Column) -> DataFrame:
    """Events of parsed documents in the columns that questions are answered from, and more of the documents' where asked."""
    gold = F.try_element_at(F.filter("event.medals", lambda m: m["place"] == "gold"), F.lit(1))["name_raw"]
    return parsed.where("event is not null").select(
        F.col("event.event_id").alias("id"), "title", "event.sport", "event.year", "event.season", F.col("event.event_name_raw").alias("event_name"),
        "event.competitors", "event.nations", F.col("event.venue_raw").alias("venue"), "event.date", gold.alias("gold"), "event.prev_year", "event.next_year", *more,
    )
