"""Event pages as column expressions: titles, infobox fields, numbers and medals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Medal fields of an infobox; the committee's field has NOC before the number.
MEDALS = ["gold", "silver", "bronze", "gold2", "silver2", "bronze2", "silver3"]
# Formats of a title, of an infobox's header and lines, and of a Games field.
TITLE = r"(?U)^([^\n]+?) at the ([0-9]{4}) (Summer|Winter) Olympics(?:\s+[–—-]\s+([^\n]+))?$"
HEADER = r"(?iU)\[Infobox Olympic event\b[^\]]*\]"
LINE = r"^[ \t]{2,}([^:\n]+):"
GAMES = r"(?iU)([0-9]{4})\s+(Summer|Winter)"
YEAR = r"(?U)\b((?:18|19|20)[0-9]{2})\b"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def or_null(text: Column) -> Column:
    return F.when(text != "", text)


def part(text: Column, pattern: str, group: int) -> Column:
    """What a group of the first match holds; NULL if nothing."""
    return or_null(F.regexp_extract(text, pattern, group))


def season_name(text: Column) -> Column:
    return F.initcap(F.lower(text))


def parse_title(title: Column) -> Column:
    """raw, sport, year, season, event_name and whether the title names Games at all."""
    raw = strip(F.coalesce(title, F.lit("")))
    return F.struct(
        raw.alias("raw"),
        or_null(strip(part(raw, TITLE, 1))).alias("sport"),
        part(raw, TITLE, 2).cast("int").alias("year"),
        part(raw, TITLE, 3).alias("season"),
        or_null(strip(part(raw, TITLE, 4))).alias("event_name"),
        raw.rlike(TITLE).alias("parsed"),
    )


def has_infobox(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(HEADER)


def infobox_fields(text: Column) -> Column:
    """Array of (key, value) in order: the lines under the first header up to one that isn't indented or has no colon."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    lines = F.split(F.regexp_extract(plain, HEADER + r"\n?((?s:.*))", 1), "\n")
    stop = F.array_position(F.transform(lines, lambda line: ~line.rlike(LINE)), F.lit(True))
    own = F.slice(lines, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(lines)).cast("int"))
    pairs = F.transform(own, lambda line: F.struct(strip(F.regexp_extract(line, LINE, 1)).alias("key"), strip(F.regexp_replace(line, r"^[^:]*:", "")).alias("value")))
    return F.filter(pairs, lambda p: p["key"] != "")


def value_of(fields: Column, key: str | Column) -> Column:
    """The last value of a key; NULL if it is missing or blank."""
    last = F.try_element_at(F.filter(fields, lambda p: p["key"] == key), F.lit(-1))
    return or_null(last["value"])


def field_map(fields: Column) -> Column:
    keys = F.array_distinct(F.transform(fields, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(fields, lambda p: p["key"] == k), F.lit(-1))["value"]))


def year_value(text: Column) -> Column:
    return part(text, YEAR, 1).cast("int")


def noc(text: Column) -> Column:
    return F.when(text.rlike(r"^[A-Za-z]{3}\z"), F.upper(text))


def medals(fields: Column) -> Column:
    """Array of (place, name_raw, noc_raw, noc) of the places that have a name."""

    def medal(place: str) -> Column:
        name = place.rstrip("23")
        committee = value_of(fields, f"{name}NOC{place.removeprefix(name)}")
        own = F.struct(F.lit(place).alias("place"), value_of(fields, place).alias("name_raw"), committee.alias("noc_raw"), noc(committee).alias("noc"))
        return F.when(own["name_raw"].isNotNull(), own)

    return F.array_compact(F.array(*[medal(p) for p in MEDALS]))
