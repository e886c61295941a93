"""Text normalisation as column expressions; Unicode folding, which Spark lacks, as an Arrow function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name a gender, and what they name.
GENDERS = {"men": "men", "mens": "men", "male": "men", "women": "women", "womens": "women", "woman": "women", "female": "women", "mixed": "mixed"}
# Plural units and their singular.
UNITS = {"metres": "metre", "meters": "metre", "meter": "metre", "kilometres": "kilometre", "kilometers": "kilometre", "kilometer": "kilometre", "kms": "km"}
# Words of a venue query that say nothing.
VENUE_STOP = ["the", "and", "at", "of", "olympic", "olympics", "centre", "center"]
#: Characters outside ASCII whose case folding holds ASCII letters, by rule from Unicode: ligatures, sharp and long s and some more.
ASCII_FOLDS = {c: c.casefold() for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and re.search("[a-z0-9]", c.casefold())}


def fold(value: str | None) -> str:
    """Compatibility forms, no combining marks, dashes as spaces, single spaces, case-folded; nothing for NULL."""
    if value is None:
        return ""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", value))
    text = "".join(" " if c in "-–—" else c for c in text if not unicodedata.combining(c))
    return " ".join(text.split()).casefold()


def fold_text(column: Column | str) -> Column:
    """fold() over batches of values; NULL gives ''."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: fold(v) if isinstance(v, str) else "")

    return F.pandas_udf(run, "string")(column)


def compact_alnum(folded: Column) -> Column:
    return F.regexp_replace(folded, "[^a-z0-9]", "")


def normalize_event_name(folded: Column) -> Column:
    plain = F.regexp_replace(folded, "[,'’]", "")
    out = plain
    for plural, singular in UNITS.items():
        out = F.regexp_replace(out, rf"\b{plural}\b", singular)
    # each unit holds one of these, and few names do
    out = F.when(F.contains(plain, F.lit("met")) | F.contains(plain, F.lit("kms")), out).otherwise(plain)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def name_tokens(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit("[a-z0-9+]+"), F.lit(0))


def gender_of(normalized: Column) -> Column:
    """men, women or mixed by the first word that names one; NULL if none does."""
    table = F.create_map(*[F.lit(x) for pair in GENDERS.items() for x in pair])
    known = F.filter(name_tokens(normalized), lambda t: t.isin(*GENDERS))
    return F.try_element_at(table, F.get(known, F.lit(0)))


def event_name_core(normalized: Column) -> Column:
    return F.array_join(F.filter(name_tokens(normalized), lambda t: ~t.isin(*GENDERS)), " ")


def names_match(left: Column, right: Column) -> Column:
    """Normalised names are equal, or both have words, their cores are equal and their genders don't contradict. No name matches none."""
    a, b = gender_of(left), gender_of(right)
    worded = (F.size(name_tokens(left)) > 0) & (F.size(name_tokens(right)) > 0)
    alike = worded & (event_name_core(left) == event_name_core(right)) & (a.isNull() | b.isNull() | (a == b))
    return (left != "") & (right != "") & ((left == right) | alike)


def venue_tokens(query: Column) -> Column:
    return F.filter(name_tokens(query), lambda t: ~t.isin(*VENUE_STOP))


def venue_score(query: Column, venue: Column) -> Column:
    """Of folded texts, by their letters and digits: 100 equal, 70 venue holds query, 60 query holds venue; 40 all words of the query that say something in the venue, else 0."""
    a, b = compact_alnum(query), compact_alnum(venue)
    words = venue_tokens(normalize_event_name(query))
    within = (F.size(words) > 0) & (F.size(F.array_except(words, name_tokens(normalize_event_name(venue)))) == 0)
    return F.coalesce(F.when((a == "") | (b == ""), 0).when(a == b, 100).when(F.contains(b, a), 70).when(F.contains(a, b), 60).when(within, 40), F.lit(0))


def tokenize(text: Column) -> Column:
    """Case-folded runs of a-z and 0-9."""
    return F.regexp_extract_all(ascii_casefold(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def ascii_casefold(text: Column) -> Column:
    """Case folding as far as letters of ASCII come from it; other letters are in lower case.

    Texts of ASCII only need nothing else; sharp s is common, and the rest is looked for before it is replaced.
    """
    sharp = F.replace(text, F.lit("ß"), F.lit(ASCII_FOLDS["ß"]))
    rare = {c: form for c, form in ASCII_FOLDS.items() if c != "ß"}
    folded = sharp
    for c, form in rare.items():
        folded = F.replace(folded, F.lit(c), F.lit(form))
    other = F.when(text.rlike(f"[{''.join(rare)}]"), folded).otherwise(sharp)
    return F.lower(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(other))


def packed_ints(values: Column) -> Column:
    """|a|b| of the distinct values; '' if there are none."""
    own = F.array_distinct(F.filter(values, lambda v: v.isNotNull()))
    return F.when(F.size(own) == 0, "").otherwise(F.concat(F.lit("|"), F.array_join(F.transform(own, lambda v: v.cast("string")), "|"), F.lit("|")))


def unpack_ints(packed: Column) -> Column:
    parts = F.filter(F.split(packed, r"\|"), lambda p: p.rlike("^-?[0-9]+$"))
    return F.transform(parts, lambda p: p.cast("int"))


def clamp_int32(value: Column) -> Column:
    return F.coalesce(F.greatest(F.least(value.cast("long"), F.lit(2**31 - 1)), F.lit(-(2**31))), F.lit(-1)).cast("long")


def embedding_text(text: Column, most: int = 1800) -> Column:
    """White space collapsed, at most `most` characters; a space if nothing is left."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(out == "", " ").otherwise(F.left(out, F.lit(most)))


def first_year(text: Column) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?:18|19|20)[0-9]{2}", 0)
    return F.when(found != "", found).cast("long")


def first_int(text: Column) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"-?[0-9]+", 0)
    return F.when(F.length(found).between(1, 18), found).cast("long")
