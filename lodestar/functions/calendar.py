"""Dates of events: Games calendar, sets of years, months and days, and how well they agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def previous_games_year(year: Column, season: Column) -> Column:
    winter = F.when(year == 1994, 1992).when(year == 1992, 1988).otherwise(year - 4)
    return F.when(season == "Winter", winter).otherwise(year - 4)


def next_games_year(year: Column, season: Column) -> Column:
    return F.when((season == "Winter") & (year == 1992), 1994).otherwise(year + 4)


def parts_overlap(left: Column, right: Column) -> Column:
    """Sets of one part of a date: an empty or missing set agrees with all."""
    return left.isNull() | right.isNull() | (F.size(left) == 0) | (F.size(right) == 0) | F.arrays_overlap(left, right)


def dates_overlap(left: Column, right: Column) -> Column:
    """Structs of years, months and days; a missing date agrees with none."""
    both = left.isNotNull() & right.isNotNull()
    return both & parts_overlap(left["years"], right["years"]) & parts_overlap(left["months"], right["months"]) & parts_overlap(left["days"], right["days"])


def date_specificity(asked: Column, own: Column) -> Column:
    """Of structs of years, months and days: 3 equal day sets, 2 asked days within the event's, 1 dates that overlap, 0 others and missing dates."""
    a, b = F.array_sort(F.array_distinct(asked["days"])), F.array_sort(F.array_distinct(own["days"]))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    inside = F.size(F.array_except(a, b)) == 0
    known = asked.isNotNull() & own.isNotNull()
    return F.coalesce(F.when(~known, 0).when(both & (a == b), 3).when(both & inside, 2).when(dates_overlap(asked, own), 1), F.lit(0))


def date_span(raw: Column, source_field: Column | None = None, fallback_year: Column | None = None) -> Column:
    """raw, source_field, years, months and days that a date text names; ranges of days are expanded, and come first. NULL if blank."""
    text = F.regexp_replace(raw, r"(?iU)\bnew\s+year'?s\s+day\b", "1 January")
    found = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    numbers = lambda values: F.transform(values, lambda v: v.try_cast("int"))
    is_day = lambda v: v.between(1, 31)
    years = numbers(found(r"(?U)\b((?:18|19|20)[0-9]{2})\b", 1))
    if fallback_year is not None:
        years = F.when((F.size(years) == 0) & fallback_year.isNotNull(), F.array(fallback_year.cast("int"))).otherwise(years)
    span = r"(?iU)\b([0-9]{1,2})\s*(?:to|–|—|-)\s*([0-9]{1,2})\b"
    ranges = F.zip_with(numbers(found(span, 1)), numbers(found(span, 2)), lambda a, b: F.when(is_day(a) & is_day(b) & (a <= b), F.sequence(a, b)).otherwise(F.expr("array()").cast("array<int>")))
    words = found("[A-Za-z]+|[0-9]+", 0)
    known = {name: n for n, name in enumerate(MONTHS, 1)}
    known |= {name[:3]: n for name, n in known.items()} | {"sept": 9}
    table = F.create_map(*[F.lit(x) for entry in known.items() for x in entry])
    months = F.array_compact(F.transform(words, lambda w: F.try_element_at(table, F.lower(w))))
    days = F.concat(F.flatten(ranges), F.filter(numbers(words), is_day))
    return F.when(
        F.trim(raw) != "",
        F.struct(
            F.trim(raw).alias("raw"),
            (F.lit("date") if source_field is None else source_field).alias("source_field"),
            F.array_distinct(years).alias("years"),
            F.array_distinct(months).alias("months"),
            F.array_distinct(days).alias("days"),
        ),
    )
