"""The five analytic operations over events, set-based, with status and reason: ties and collisions are never broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import calendar, names

POOL = ["sport", "year", "season"]


def pool_filter(events: DataFrame, sport: str, year: int, season: str) -> DataFrame:
    return events.where((F.col("sport") == sport) & (F.col("year") == year) & (F.col("season") == season))


def title_lookup(events: DataFrame, titles: DataFrame) -> DataFrame:
    """titles (asked) with the events of that title; only titles without an exact match are matched by their folded forms.

    Events that hold title_folded, made once at ingest, aren't folded again. A title without letters matches nothing.
    """
    if "title_folded" not in events.columns:
        events = events.withColumn("title_folded", names.fold_text("title"))
    titles = titles.withColumn("__asked", names.fold_text("asked"))
    both = titles.join(events, (F.col("title_folded") == F.col("__asked")) & (F.col("__asked") != ""), "left").drop("title_folded", "__asked")
    exact = F.col("title") == F.col("asked")
    return both.withColumn("tier", F.when(exact, 1).when(F.col("id").isNotNull(), 2)).withColumn("best", F.min("tier").over(Window.partitionBy("asked"))).where(F.col("tier").eqNullSafe(F.col("best"))).drop("best")


def lookup_status(matches: DataFrame) -> DataFrame:
    """One row per asked title: nations of the only event, or why there is no answer."""
    out = matches.groupBy("asked").agg(F.count("id").alias("n"), F.max("nations").alias("nations"))
    status = F.when(F.col("n") == 0, "not_found").when(F.col("n") > 1, "ambiguous").when(F.col("nations").isNull(), "unresolved").otherwise("supported")
    reason = F.when(F.col("n") == 0, "event_title_not_found").when(F.col("n") > 1, "multiple_title_matches").when(F.col("nations").isNull(), "missing_field:nations")
    return out.select("asked", status.alias("status"), reason.alias("reason"), F.when(status == "supported", F.col("nations")).cast("string").alias("answer"))


def count_over_threshold(events: DataFrame, threshold: int, by: list[str] = POOL) -> DataFrame:
    """By pool: pool_size, usable, missing, hits (competitors strictly over the threshold). Without by, one row, also for an empty pool."""
    aggregates = [
        F.count(F.lit(1)).alias("pool_size"),
        F.count("competitors").alias("usable"),
        F.count_if(F.col("competitors").isNull()).alias("missing"),
        F.count_if(F.col("competitors") > threshold).alias("hits"),
    ]
    return events.groupBy(*by).agg(*aggregates) if by else events.agg(*aggregates)


def count_status(counted: DataFrame) -> DataFrame:
    empty = F.col("pool_size") == 0
    return counted.withColumn("status", F.when(empty, "not_found").otherwise("supported")).withColumn("reason", F.when(empty, "no_sport_games_events"))


def argmax_ties(events: DataFrame) -> DataFrame:
    """All events with the most competitors of their pool. The maximum is aggregated first, so no pool is sorted."""
    top = events.where("competitors is not null").groupBy(*POOL).agg(F.max("competitors").alias("top"))
    return events.join(top, POOL).where("competitors = top").drop("top")


def argmax_status(events: DataFrame) -> DataFrame:
    top = events.groupBy(*POOL).agg(F.count(F.lit(1)).alias("pool_size"), F.count("competitors").alias("usable"), F.max("competitors").alias("top"))
    winners = argmax_ties(events).groupBy(*POOL).agg(F.count(F.lit(1)).alias("ties"), F.min("title").alias("title"))
    out = top.join(winners, POOL, "left")
    status = F.when(F.col("usable") == 0, "unresolved").when(F.col("ties") > 1, "ambiguous").otherwise("supported")
    reason = F.when(F.col("usable") == 0, "missing_field:competitors").when(F.col("ties") > 1, "tied_max_competitors")
    return out.select(*POOL, "pool_size", "usable", "top", F.coalesce("ties", F.lit(0)).alias("ties"), status.alias("status"), reason.alias("reason"), F.when(status == "supported", F.col("title")).alias("answer"))


def related_edition(events: DataFrame, relation: str, keys: list[str]) -> DataFrame:
    """One row per event: the edition before or after it under the same keys, counted, never picked.

    Editions are aggregated before the join, so an event meets one row however
    many events its related edition has.
    """
    year = (calendar.previous_games_year if relation == "previous" else calendar.next_games_year)(F.col("year"), F.col("season"))
    editions = events.groupBy(*keys, F.col("year").alias("related_year")).agg(F.count(F.lit(1)).alias("related"), F.min("id").alias("related_id"), F.max("gold").alias("related_gold"))
    return events.withColumn("related_year", year.cast("long")).join(editions, [*keys, "related_year"], "left")


def related_status(related: DataFrame, relation: str) -> DataFrame:
    n = F.coalesce("related", F.lit(0))
    status = F.when(n == 0, "unresolved").when(n > 1, "ambiguous").when(F.col("related_gold").isNull(), "unresolved").otherwise("supported")
    reason = F.when(n == 0, f"{relation}_event_name_missing").when(n > 1, "multiple_related_events").when(F.col("related_gold").isNull(), "missing_field:gold")
    return related.select("id", "related_year", n.alias("related"), status.alias("status"), reason.alias("reason"), F.when(status == "supported", F.col("related_gold")).alias("answer"))


def venue_matches(events: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query_id, asked) with the events at the best-scoring venues, ties kept.

    Venues are made distinct first; only they meet the queries, and events join
    the winners on equality.
    """
    venues = events.select("venue").where("venue is not null").distinct()
    asked, venues = queries.withColumn("__asked", names.fold_text("asked")), venues.withColumn("__venue", names.fold_text("venue"))
    score = names.venue_score(F.col("__asked"), F.col("__venue"))
    scored = asked.join(venues, score > 0).withColumn("score", score).drop("__asked", "__venue")
    best = scored.withColumn("top", F.max("score").over(Window.partitionBy("query_id"))).where("score = top").drop("top")
    return best.join(events, "venue")


def event_days(date: Column) -> Column:
    """A single date as a struct of sets."""
    return F.struct(F.array(F.year(date)).alias("years"), F.array(F.month(date)).alias("months"), F.array(F.dayofmonth(date)).alias("days"))


def venue_date(matches: DataFrame) -> DataFrame:
    """Of matches with years, months and days asked: those whose dates overlap, narrowed to the most specific."""
    own = event_days(F.col("event_date"))
    asked = F.struct("years", "months", "days")
    kept = matches.where(calendar.dates_overlap(own, asked)).withColumn("specificity", calendar.date_specificity(asked, own))
    return kept.withColumn("top", F.max("specificity").over(Window.partitionBy("query_id"))).where("specificity = top").drop("top")


def venue_date_status(queries: DataFrame, matches: DataFrame, narrowed: DataFrame) -> DataFrame:
    found = matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("at_venue"))
    left = narrowed.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("gold").alias("gold"))
    out = queries.select("query_id").join(found, "query_id", "left").join(left, "query_id", "left")
    status = F.when(F.col("at_venue").isNull(), "not_found").when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").when(F.col("gold").isNull(), "unresolved").otherwise("supported")
    reason = F.when(F.col("at_venue").isNull(), "venue_not_found").when(F.col("n").isNull(), "date_does_not_overlap").when(F.col("n") > 1, "multiple_events_same_venue_date").when(F.col("gold").isNull(), "missing_field:gold")
    return out.select("query_id", status.alias("status"), reason.alias("reason"), F.when(status == "supported", F.col("gold")).alias("answer"))
