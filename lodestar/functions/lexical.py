"""Lexical plans of questions: what a text search looks for, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.names import tokenize

# Phrases that open a question, and those by which its intent is known.
OPENING = r"(?iU)^\s*according to the provided corpus,?\s*"
SET_COUNT = r"(?isU)how many\s+(.+?)\s+events?\s+at\b.{0,80}?\b(?:more than|fewer than|at least|over)\s+[0-9]+"
SET_EXTREME = r"(?isU)which\s+(.+?)\s+events?\s+at\b.{0,80}?\b(?:highest|lowest|most|fewest|largest|smallest)\b"
TEMPORAL = r"(?iU)\b(?:previous|prior|before|next|following|after)\b"
BACKWARD, FORWARD = r"(?iU)\b(?:previous|prior|before)\b", r"(?iU)\b(?:next|following|after)\b"
# Words of a question that say nothing about what it looks for.
STOP = """according provided corpus how many which what who whom had have has was were did the a an of in at on for with from than
more most less least highest lowest largest smallest fewest number numbers count events event competed competitors nations gold won
winner previous prior before next following after and or to by""".split()

SETS = ("set_count", "set_extreme")


def telling(text: Column) -> Column:
    """Tokens that are neither stop words nor numbers."""
    return F.filter(tokenize(text), lambda t: ~t.isin(STOP) & ~t.rlike("^[0-9]+$"))


def intent(text: Column) -> Column:
    return F.when(text.rlike(SET_COUNT), "set_count").when(text.rlike(SET_EXTREME), "set_extreme").when(text.rlike(TEMPORAL), "temporal").otherwise("lookup")


def plan_queries(questions: DataFrame) -> DataFrame:
    """questions (qid, question, ...) with cleaned, intent, years, seasons, sport_tokens, content_tokens and variants.

    variants are up to three texts to search for: the question without its
    opening, its telling words with years, seasons and Games in the manner of a
    title, and sport and first year with the words of an infobox. NULL is ''.
    """
    question = F.coalesce("question", F.lit(""))
    bare = F.trim(F.regexp_replace(question, OPENING, ""))
    rows = questions.withColumn("cleaned", F.when(bare != "", bare).otherwise(F.trim(question)))
    text = F.col("cleaned")
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    rows = rows.withColumns(
        {
            "intent": intent(text),
            "years": F.transform(found(r"(?U)\b((?:18|19|20)[0-9]{2})\b"), lambda y: y.cast("int")),
            "seasons": F.array_distinct(F.transform(found(r"(?iU)\b(summer|winter)\b"), lambda s: F.lower(s))),
            "content_tokens": telling(text),
        }
    )
    phrase = F.when(F.col("intent") == "set_count", F.regexp_extract(text, SET_COUNT, 1)).when(F.col("intent") == "set_extreme", F.regexp_extract(text, SET_EXTREME, 1)).otherwise("")
    rows = rows.withColumn("sport_tokens", F.when(F.size(telling(phrase)) > 0, telling(phrase)).otherwise(F.slice("content_tokens", 1, 4)))
    games = F.when(F.exists(tokenize(text), lambda t: t.isin("olympics", "olympic")), F.array(F.lit("olympics"))).otherwise(F.expr("cast(array() as array<string>)"))
    lead = F.when(F.size("sport_tokens") > 0, F.col("sport_tokens")).otherwise(F.slice("content_tokens", 1, 6))
    title = F.array_join(F.array_distinct(F.concat(lead, F.col("years").cast("array<string>"), F.col("seasons"), games)), " ")
    box = F.when((F.size("sport_tokens") > 0) & (F.size("years") > 0), F.concat_ws(" ", F.array_join("sport_tokens", " "), F.get("years", F.lit(0)).cast("string"), F.lit("olympics competitors")))
    tried = F.filter(F.array_compact(F.array(text, title, box)), lambda v: F.trim(v) != "")
    # of variants that differ in case only the first stays
    first = F.filter(tried, lambda v, i: ~F.exists(F.slice(tried, F.lit(1), i), lambda w: F.lower(w) == F.lower(v)))
    return rows.withColumn("variants", first)
