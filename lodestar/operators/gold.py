"""Gold documents of questions: those that the slots of a question call for, and the edition before the named year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import calendar, names
from lodestar.operators import pools
from lodestar.plans import answers
from lodestar.sources.files import dealt, stash

# Why no edition before the named year is known.
NO_YEAR, NO_OLDER = "named_year_not_parsed", "no_gold_doc_older_than_named_year"


def structured_gold(parsed: DataFrame, events: DataFrame) -> DataFrame:
    """qid, event_id: the events that each parsed question is about, each once.

    A lookup has those of its title, a count and a superlative their whole pool,
    a temporal question the named edition and the related one, a venue and date
    the events at the best-fitting venue among those whose date doesn't
    contradict. Other questions have none. events as plans.answers takes them.
    """
    asked = lambda *qtypes: parsed.where(F.col("qtype").isin(*qtypes) & F.col("matched_template"))
    titles = asked("lookup").select("qid", F.col("event_title").alias("asked"))
    looked = titles.join(pools.title_lookup(events, titles.select("asked").distinct()).where("id is not null"), "asked").select("qid", "id")
    pooled = asked("aggregation", "superlative").select("qid", *answers.POOL).join(events.select("id", *answers.POOL), answers.POOL).select("qid", "id")
    parts = [looked, pooled, answers.edition_pairs(asked("temporal"), events), _at_venue(asked("multi_hop"), events)]
    return reduce(DataFrame.unionByName, parts).select("qid", F.col("id").cast("string").alias("event_id")).distinct()


def _at_venue(asked: DataFrame, events: DataFrame) -> DataFrame:
    """qid, id. Distinct venues of a year meet the distinct asked ones; only the events of those that fit meet the questions."""
    date = calendar.date_span(F.col("date_text"), F.lit("question"), F.col("year"))
    q = asked.select("qid", F.col("year").alias("q_year"), names.fold_text("venue").alias("q_venue"), date.alias("q_date"))
    halls = events.where("venue is not null").select("venue", "year").distinct().withColumn("hall", names.fold_text("venue"))
    score = names.venue_score(F.col("q_venue"), F.col("hall"))
    places = q.select("q_venue", "q_year").distinct()
    fits = answers.met(places, halls, ["year"], "year", score > 0).withColumn("score", score)
    fits = fits.select(F.col("q_venue").alias("f_venue"), F.col("q_year").alias("f_year"), "score", F.col("venue").alias("v"), F.col("year").alias("y"))
    own = q.join(fits, (F.col("q_venue") == F.col("f_venue")) & F.col("q_year").eqNullSafe(F.col("f_year")))
    open_date = F.col("q_date").isNull() | F.col("date").isNull() | F.coalesce(calendar.dates_overlap(F.col("date"), F.col("q_date")), F.lit(False))
    here = (F.col("v") == F.col("venue")) & F.col("y").eqNullSafe(F.col("year"))
    kept = answers.met_on_dates(own, events.select("id", "venue", "year", "date"), here, open_date).withColumn("top", F.max("score").over(Window.partitionBy("qid"))).where("score = top")
    return kept.select("qid", "id")


def document_year(event_year: Column, title_year: Column) -> Column:
    """The year of a document's event, else of its title."""
    return F.coalesce(event_year, title_year).cast("int")


def previous_gold(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per question: qid, named_year, previous_doc_id, named_year_doc_id, identifiable, reason.

    questions have qid, named_year and gold_doc_ids, an array in order; documents
    doc_id and year (document_year). The previous document is the gold one with
    the latest year strictly before the named one, the first of the list among
    equals; that of the named year is the first in the list too. Gold ids that
    aren't documents, and documents without a year, don't count.
    """
    questions = stash(questions, "gold-questions")
    many = questions.agg(F.sum(F.size("gold_doc_ids"))).head()[0] or 0
    gold = dealt(questions.select("qid", "named_year", F.posexplode("gold_doc_ids").alias("place", "doc_id")), many, "doc_id")
    dated = dealt(gold.join(documents.where("year is not null").select("doc_id", "year"), "doc_id"), many, "qid")
    older, same = F.col("year") < F.col("named_year"), F.col("year") == F.col("named_year")
    found = dated.groupBy("qid").agg(
        F.max(F.when(older, F.struct("year", (-F.col("place")).alias("first"), "doc_id")))["doc_id"].alias("previous_doc_id"),
        F.min(F.when(same, F.struct("place", "doc_id")))["doc_id"].alias("named_year_doc_id"),
    )
    rows = questions.select("qid", "named_year").join(found, "qid", "left")
    reason = F.when(F.col("named_year").isNull(), NO_YEAR).when(F.col("previous_doc_id").isNull(), NO_OLDER)
    return rows.select("qid", "named_year", "previous_doc_id", "named_year_doc_id", F.col("previous_doc_id").isNotNull().alias("identifiable"), reason.alias("reason"))


def edition_before(questions: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """qid, named_year, year, doc_id: as-of join to the documents of the same keys with the latest year strictly before the named one; all that tie, NULLs where there are none.

    Documents are reduced to one row for each key and year, and questions to one
    for each key and named year, before both stand in one window: so a key of any
    number of rows is as long as its distinct years. No pair of all is made.
    """
    years = documents.where("year is not null").groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("year").alias("at"), F.lit(1).alias("kind"), F.col("year").alias("known"))
    points = questions.where("named_year is not null").select(*keys, F.col("named_year").alias("at")).distinct().select("*", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("known"))
    # a question of a year stands before the documents of that year
    order = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = years.unionByName(points).withColumn("year", F.last("known", ignorenulls=True).over(order)).where("kind = 0").select(*keys, F.col("at").alias("named_year"), "year")
    dated = questions.join(found, [*keys, "named_year"], "left")
    return dated.join(documents.select(*keys, "year", "doc_id"), [*keys, "year"], "left").select("qid", "named_year", "year", "doc_id")
