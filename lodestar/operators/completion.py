"""Completions of language models held to their evidence: parsed, repaired where one item only can be meant, and refused where a quote or an answer isn't in what is cited.

The models themselves are not part of the library: completions are a table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.evidence import grounded

# What a completion's own status stands for, and reasons of an end that cut it short.
STATUS = {"answered": "answered", "abstained": "abstained", "insufficient": "abstained", "ambiguous": "ambiguous", "conflicting": "unresolved", "conflict": "unresolved"}
CUT = ["length", "max_tokens"]
#: How often a text may be read in vain.
WASTE = 20
SUPPORT = "array<struct<evidence_id:string,quote:string>>"
READ = f"struct<status:string,answer:string,reason:string,citation_ids:array<string>,support:{SUPPORT}>"
EMPTY = ["ambiguous", "not_found", "unresolved", "unsupported", "abstained", "generation_error", "error", "not_implemented"]


def objects(text: str) -> Iterator[dict]:
    """The JSON objects that stand in a text, outermost ones, in order.

    Text that only looks like JSON can make a reader start over at every brace,
    or nest deeper than it goes: what was read in vain is counted, and beyond
    WASTE times the text's length nothing more is read.
    """
    reader, left, after = json.JSONDecoder(), WASTE * (len(text) + 1000), 0
    for brace in re.finditer(r"\{(?=\s*[\"}])", text):
        if brace.start() < after:
            continue
        try:
            value, after = reader.raw_decode(text, brace.start())
        except RecursionError:
            left -= 10_000
        except json.JSONDecodeError as broken:
            left -= broken.pos - brace.start() + broken.pos // 64 + 1  # an error counts the lines before it
        else:
            yield value
        if left < 0:
            return


def first_object(text: str | None) -> dict | None:
    """The first JSON object of a text, or of its first fenced block where it has one; one with a status is preferred. None where there is none, or none can be read."""
    plain = text or ""
    _, _, block = plain.partition("```")
    block, closed, _ = block.partition("```")
    found = list(objects(block.removeprefix("json") if closed else plain))
    return next(iter([v for v in found if "status" in v] + found), None)


def read(text: Column) -> Column:
    """Status, answer, reason, citation ids and support of a completion; NULL where it holds no object. Without support the answer is quoted from all it cites."""

    def one(value: str | None) -> dict | None:
        given = first_object(value)
        if given is None:
            return None
        listed = lambda key: given[key] if isinstance(given.get(key), list) else []
        answer = str(given.get("answer") or "").strip()
        ids = list(dict.fromkeys(str(i) for i in listed("citation_ids") if str(i)))
        pairs = [(str(s.get("evidence_id") or "").strip(), str(s.get("quote") or "").strip()) for s in listed("support") if isinstance(s, dict)]
        pairs = [p for p in pairs if all(p)] or ([(i, answer) for i in ids] if answer else [])
        reason = given.get("reason")
        return {"status": str(given.get("status") or "").strip().casefold(), "answer": answer, "reason": None if reason is None else str(reason), "citation_ids": ids, "support": [{"evidence_id": i, "quote": q} for i, q in pairs]}

    def run(values: pd.Series) -> pd.DataFrame:
        rows = [one(v) for v in values]
        return pd.DataFrame([r or dict.fromkeys(("status", "answer", "reason", "citation_ids", "support")) for r in rows], columns=["status", "answer", "reason", "citation_ids", "support"])

    return F.pandas_udf(run, READ)(text)


def needles(answer: Column) -> Column:
    """The parts of a joined answer, or the answer."""
    return F.filter(F.transform(F.split(answer, r" \| "), lambda p: F.trim(p)), lambda p: p != "")


def held(completions: DataFrame, items: DataFrame) -> DataFrame:
    """completions (qid, text, finish_reason) with status, answer, citation_ids and why, after the packed items (qid, evidence_id, evidence_type, field_name, value).

    An answer stands if every part of it is in a quote, every quote is in the item
    that it names, and the answer is in the items that are cited. A quote whose id
    isn't known is taken to be of the one item that holds it. Quotes without a
    part of the answer are left out. An answer that is part of the one title
    among its cited entities becomes that title.
    """
    rows = completions.withColumn("r", read(F.col("text")))
    cut = F.lower(F.trim(F.coalesce("finish_reason", F.lit("")))).isin(CUT)
    mapped = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), F.col("r.status")), F.lit("abstained"))
    rows = rows.select("qid", F.col("r.answer").alias("answer"), F.col("r.status").isNull().alias("unread"), cut.alias("cut"), mapped.alias("given"), "r.support")
    quotes = rows.where("given = 'answered' and answer <> '' and not unread").select("qid", "answer", F.posexplode("support").alias("pos", "s")).select("qid", "answer", "pos", "s.evidence_id", "s.quote")
    parts = quotes.withColumn("part", F.explode(needles(F.col("answer"))))
    supporting = parts.withColumn("in_quote", grounded(F.col("part"), F.col("quote"))).where("in_quote")
    covered = supporting.groupBy("qid").agg(F.size(F.collect_set("part")).alias("covered"))
    quotes = supporting.select("qid", "answer", "pos", "evidence_id", "quote").distinct()

    own = items.select("qid", F.col("evidence_id").alias("i_id"), "evidence_type", "field_name", "value")
    named = quotes.join(own, (quotes["qid"] == own["qid"]) & (quotes["evidence_id"] == own["i_id"]), "left").drop(own["qid"])
    known = named.where("i_id is not null").select("qid", "answer", "pos", "quote", "i_id", "evidence_type", "field_name", "value")
    lost = named.where("i_id is null").select("qid", "answer", "pos", "quote")
    meant = lost.join(own, "qid").where(grounded(F.col("quote"), F.col("value")))
    one = meant.groupBy("qid", "pos").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    repaired = meant.join(one, ["qid", "pos"]).select(known.columns)
    unknown = lost.join(one, ["qid", "pos"], "left_anti").groupBy("qid").agg(F.count(F.lit(1)).alias("unknown"))

    cited = known.unionByName(repaired).withColumn("quote_holds", grounded(F.col("quote"), F.col("value")))
    title = F.when((F.col("evidence_type") == "entity") & (F.col("field_name") == "title") & (F.col("answer") != F.col("value")) & ~F.col("answer").rlike(r"^[0-9]+(?:[.,][0-9]+)?\z") & grounded(F.col("answer"), F.col("value")), F.col("value"))
    found = cited.groupBy("qid").agg(F.min("quote_holds").alias("quotes_hold"), F.array_sort(F.collect_set(F.struct("pos", "i_id"))).alias("ids"), F.collect_set(title).alias("titles"))
    in_items = cited.withColumn("part", F.explode(needles(F.col("answer")))).where(grounded(F.col("part"), F.col("value"))).groupBy("qid").agg(F.size(F.collect_set("part")).alias("in_items"))
    out = rows.join(found, "qid", "left").join(covered, "qid", "left").join(unknown, "qid", "left").join(in_items, "qid", "left")
    size = F.size(F.array_distinct(needles(F.col("answer"))))
    why = (
        F.when(F.col("unread") & F.col("cut"), "truncated_completion").when(F.col("unread"), "unparseable_provider_output").when(F.col("given") != "answered", "not_answered").when(F.col("answer") == "", "empty_semantic_answer")
        .when(F.col("ids").isNull() & F.col("unknown").isNull(), "missing_citations").when(F.col("unknown").isNotNull(), "provider_cited_unknown_evidence")
        .when((F.coalesce("covered", F.lit(0)) < size) | ~F.col("quotes_hold") | (F.coalesce("in_items", F.lit(0)) < size), "ungrounded_answer")
    )
    status = F.when(why == "truncated_completion", "generation_error").when(why == "not_answered", F.col("given")).when(why.isNotNull(), "abstained").otherwise("answered")
    answered = why.isNull()
    answer = F.when(answered, F.when(F.size("titles") == 1, F.get("titles", F.lit(0))).otherwise(F.col("answer"))).otherwise("")
    ids = F.when(answered, F.array_distinct(F.transform("ids", lambda i: i["i_id"]))).otherwise(F.expr("cast(array() as array<string>)"))
    return out.select("qid", status.alias("status"), answer.alias("answer"), ids.alias("citation_ids"), F.when(why != "not_answered", why).alias("why"))


def public_status(status: Column, answer: Column) -> Column:
    """Statuses without an answer win over any text; else there is an answer or there is none."""
    return F.when(status.isin(EMPTY), status).when(F.trim(F.coalesce(answer, F.lit(""))) != "", "answered").otherwise("abstained")
