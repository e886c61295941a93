"""Text search for many questions at once: lexical variants, candidates, set sweeps, temporal expansion, grouping and compaction.

Every step is one plan over all questions. Candidates meet chunks by equality of
tokens or documents, never by a scan of all pairs; what is gathered by group is
bounded: the chunks of one document that one question took, a few at most but
for sweeps, which have a greatest size of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import lexical
from lodestar.functions.names import tokenize
from lodestar.operators import retrieval
from lodestar.sources.files import stash

# Sizes of a sweep and of an unknown rank, and the keys that a compact infobox keeps.
SWEEP, UNRANKED = 64, 10_000
KEYS = r"(?iU)^\s*(?:event|games|date|venue|competitors|nations|gold|silver|bronze|prev|next)\s*:"
#: Columns of a chunk that a hit carries on.
HIT = ["chunk_id", "document_id", "document_title", "section", "kind", "event_id", "source_url"]
IN_DOC = ["in_doc_kind", "chunk_index", "chunk_id"]


def is_set(intent: str = "intent") -> Column:
    return F.col(intent).isin(*lexical.SETS)


def candidates(plans: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
    """qid, chunk_id, document_id, score, rank: the best score of each chunk over the variants' BM25 lists, one pass for all of them."""
    variants = plans.select("qid", "intent", F.posexplode("variants").alias("variant", "text"))
    pool = F.when(is_set(), max(8 * top_k, 80)).otherwise(max(3 * top_k, 20))
    indexed = chunks.select(F.col("chunk_id").alias("doc_id"), F.col("indexed_text").alias("text"))
    hits = retrieval.bm25(indexed, variants.withColumnRenamed("qid", "query_id"), max(8 * top_k, 80)).where(F.col("rank") <= pool)
    best = hits.groupBy(F.col("query_id").alias("qid"), F.col("doc").alias("chunk_id")).agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")))
    return ranked.join(chunks.select("chunk_id", "document_id"), "chunk_id")


def sweep(wanted: DataFrame, infoboxes: DataFrame, most: int | None = SWEEP) -> DataFrame:
    """wanted (qid, years, sport_tokens): qid and chunk_id of the infoboxes whose title holds one of the years, if any, and all the words: `most` of them by title, or all.

    Questions meet distinct titles on one word; the others are checked there. Infoboxes join
    the titles that fit. With `most`, no question keeps more of one title, so only so many of each meet questions.
    """
    own = infoboxes.where(F.col("document_title") != "").select("chunk_id", "document_title")
    titles = own.select("document_title").distinct().withColumn("words", F.array_distinct(tokenize(F.col("document_title"))))
    # an outer explode, as the test for words that Spark infers of an inner one is made of every title before they are distinct
    by_word = titles.select("*", F.explode_outer("words").alias("word"))
    asked = wanted.where(F.size("sport_tokens") > 0).withColumn("word", F.get("sport_tokens", F.lit(0)))
    met = asked.join(by_word, "word").where(F.size(F.array_except("sport_tokens", "words")) == 0)
    met = met.where((F.size("years") == 0) | F.exists("years", lambda y: F.contains(F.col("document_title"), y.cast("string")))).select("qid", "document_title")
    if most is None:
        return own.join(met, "document_title").select("qid", "chunk_id")
    few = retrieval.top_k(own, ["document_title"], ["chunk_id"], most).select("chunk_id", "document_title")
    return retrieval.top_k(few.join(met, "document_title"), ["qid"], ["document_title", "chunk_id"], most).select("qid", "chunk_id")


def expand(first: DataFrame, seed: Column, chunks: DataFrame, per_doc: int = 3) -> DataFrame:
    """qid and chunk_id of the first per_doc chunks, infoboxes first, of the documents of hits whose rank is at most `seed`."""
    docs = first.where(F.col("rank") <= seed).select("qid", "document_id").distinct()
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("kind") != "infobox", "chunk_index", "chunk_id"))
    few = chunks.select("chunk_id", "document_id", "kind", "chunk_index").withColumn("place", place).where(F.col("place") <= per_doc)
    return docs.join(few, "document_id").select("qid", "chunk_id")


def editions(plans: DataFrame, taken: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid and chunk_id of infoboxes of the years that the infoboxes taken for a temporal question name as previous or next."""
    boxes = taken.join(chunks.where("kind = 'infobox'").select("chunk_id", "text"), "chunk_id").join(plans.where("intent = 'temporal'").select("qid", "cleaned"), "qid")
    years = lambda key: F.regexp_extract_all("text", F.lit(rf"(?i)(?:^|\n)\s*{key}:\s*((?:18|19|20)[0-9]{{2}})"), F.lit(1))
    none = F.expr("cast(array() as array<string>)")
    named = F.concat(F.when(F.col("cleaned").rlike(lexical.BACKWARD), years("prev")).otherwise(none), F.when(F.col("cleaned").rlike(lexical.FORWARD), years("next")).otherwise(none))
    found = boxes.select("qid", F.explode(named.cast("array<int>")).alias("year")).groupBy("qid").agg(F.collect_set("year").alias("years"))
    words = F.when(F.size("sport_tokens") > 0, F.col("sport_tokens")).otherwise(F.slice("content_tokens", 1, 4)).alias("sport_tokens")
    return sweep(plans.select("qid", words).join(found, "qid"), chunks.where("kind = 'infobox'"))


def coverage(text: Column) -> Column:
    """How much of what a question names stands in a lower-cased text: years 3, sport words 4, seasons and its other words 1, asked fields 2."""
    words = F.array_distinct(tokenize(text))
    count = lambda values, test: F.size(F.filter(values, test))
    within = lambda values: count(values, lambda t: F.array_contains(words, t))
    asked = F.lower("cleaned")
    own = F.filter(tokenize(F.col("cleaned")), lambda t: ~t.isin("according", "provided", "corpus"))
    field = lambda name, *signs: F.when(F.contains(text, F.lit(f"{name}:")) & F.greatest(*[F.contains(asked, F.lit(s)) for s in signs], F.lit(False)), 2).otherwise(0)
    fields = field("competitors", "competitor", "highest", "more than", "most") + field("nations", "nation") + field("gold", "gold")
    return 3 * count(F.col("years"), lambda y: F.contains(text, y.cast("string"))) + 4 * within(F.col("sport_tokens")) + count(F.col("seasons"), lambda s: F.contains(text, s)) + within(own) + fields


def compact_infobox(text: Column, title: Column) -> Column:
    """The header and the lines of an infobox that KEYS names, without the event's name where the title has it; the whole text if none is left."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|[\r\n]"), lambda line: F.regexp_replace(line, r"(?U)\s+$", "")), lambda line: line != "")
    value = lambda line: F.lower(F.trim(F.regexp_replace(line, "^[^:]*:", "")))
    repeats = lambda line: (title != "") & (F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1))) == "event") & F.contains(F.lower(title), value(line))
    kept = F.filter(lines, lambda line: F.contains(F.lower(line), F.lit("infobox olympic event")) | (line.rlike(KEYS) & ~repeats(line)))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(F.trim(F.coalesce(text, F.lit(""))))


def evidence_text(text: Column, title: Column, compact: Column) -> Column:
    """The text, after its title where it doesn't hold it."""
    title = F.coalesce(title, F.lit(""))
    body = F.when(compact, compact_infobox(text, title)).otherwise(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    return F.when((title != "") & ~F.contains(body, title), F.regexp_replace(F.concat(title, F.lit("\n"), body), r"(?U)^\s+|\s+$", "")).when(bare == "", title).otherwise(bare)


def final_k(top_k: int, docs: Column) -> Column:
    """How many hits a question keeps of so many documents."""
    return F.when(is_set(), F.greatest(F.lit(top_k), F.least(F.lit(SWEEP), docs))).when(F.col("intent") == "temporal", F.least(F.lit(top_k + 4), F.greatest(F.lit(top_k), docs))).otherwise(max(1, top_k))


def select_evidence(plans: DataFrame, first: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
    """Hits of planned questions from their candidates: qid, rank, score, text and the chunk's columns, in the order of their documents."""
    swept = sweep(plans.where(is_set() & (F.size("years") > 0)).select("qid", "years", "sport_tokens"), chunks.where("kind = 'infobox'"))
    swept = stash(swept, "search-swept")
    left = plans.join(swept.select("qid").distinct(), "qid", "left_anti").select("qid", "intent")
    sets_left = is_set() & (F.size("years") > 0) & (F.size("sport_tokens") > 0)
    seeds = plans.select("qid", F.when(sets_left, max(top_k, 20)).otherwise(max(2 * top_k, 12)).alias("seed"))
    grown = expand(first.join(left.select("qid"), "qid", "left_semi").join(seeds, "qid"), F.col("seed"), chunks)
    taken = stash(swept.unionByName(grown).unionByName(editions(plans, grown, chunks)).distinct(), "search-taken")

    scores = first.select("qid", "chunk_id", "score")
    ranks = first.groupBy("qid", "document_id").agg(F.min("rank").alias("doc_rank"))
    members = taken.join(chunks.select(*HIT, "chunk_index", "text"), "chunk_id").join(scores, ["qid", "chunk_id"], "left").withColumn("in_doc_kind", (F.col("kind") != "infobox").cast("int"))
    by_doc = members.groupBy("qid", "document_id").agg(
        F.max(F.coalesce("score", F.lit(0.0))).alias("top_score"),
        (1 - F.min("in_doc_kind")).alias("boxed"),
        F.first("document_title").alias("title"),
        F.array_sort(F.collect_list(F.struct(*IN_DOC, F.coalesce("text", F.lit("")).alias("text")))).alias("members"),
    )
    by_doc = by_doc.join(plans.drop("question"), "qid").join(ranks, ["qid", "document_id"], "left")
    text = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.array_join("members.text", " ")))
    by_doc = by_doc.withColumn("coverage", coverage(text)).withColumn("doc_rank", F.coalesce("doc_rank", F.lit(UNRANKED)))
    cover, place = (-F.col("coverage")).cast("double"), F.col("doc_rank").cast("double")
    order = [F.when(is_set(), cover).otherwise(place), -F.col("boxed"), -F.col("top_score"), F.when(is_set(), place).otherwise(cover), "title", "document_id"]
    by_qid = Window.partitionBy("qid")
    docs = by_doc.withColumn("place", F.row_number().over(by_qid.orderBy(*order))).withColumn("docs", F.count(F.lit(1)).over(by_qid))
    docs = docs.select("qid", "document_id", "intent", "place", final_k(top_k, F.col("docs").cast("int")).alias("final_k"))
    within = F.row_number().over(Window.partitionBy("qid", "document_id").orderBy(*IN_DOC))
    hits = members.join(docs, ["qid", "document_id"]).withColumn("within", within).where(F.col("within") <= F.when(is_set(), 1).otherwise(2))
    hits = hits.withColumn("rank", F.row_number().over(by_qid.orderBy("place", "within"))).where(F.col("rank") <= F.col("final_k"))
    return hits.select("qid", "rank", F.coalesce("score", F.lit(0.0)).alias("score"), *HIT, evidence_text(F.col("text"), F.col("document_title"), is_set()).alias("text"), F.lit("bm25").alias("retrieval_method"))


def search(questions: DataFrame, chunks: DataFrame, top_k: int = 10, vectors: DataFrame | None = None, asked_vectors: DataFrame | None = None, use_mmr: bool = False) -> DataFrame:
    """Evidence for questions (qid, question) from chunks (chunk_id, document_id, document_title, chunk_index, section, kind, text, indexed_text, event_id, source_url).

    With vectors (vec_id, chunk_id, embedding) and asked_vectors (query_id, qid,
    embedding) the sparse and the exact dense list are fused by reciprocal rank.
    With use_mmr the hits are reranked against what was taken before. A question
    that matches nothing has no rows.
    """
    plans = stash(lexical.plan_queries(questions), "search-plans")
    hits = select_evidence(plans, stash(candidates(plans, chunks, top_k), "search-candidates"), chunks, top_k)
    if vectors is not None and asked_vectors is not None:
        hits = fused(hits, dense(vectors, asked_vectors, chunks, top_k), top_k)
    if use_mmr:
        order = retrieval.mmr(hits.select(F.xxhash64("qid").alias("query_id"), F.xxhash64("chunk_id").alias("doc"), "score", "text"))
        hits = hits.drop("rank").join(order, (F.xxhash64("qid") == F.col("query_id")) & (F.xxhash64("chunk_id") == F.col("doc"))).drop("query_id", "doc")
    return hits


def dense(vectors: DataFrame, asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Hits of exact vector search, mapped to chunks; ids without a chunk are left out, and ranks are made anew."""
    found = retrieval.vector_top_k(vectors.select("vec_id", "embedding"), asked.select("query_id", "embedding"), k)
    named = found.join(asked.select("query_id", "qid"), "query_id").join(vectors.select("vec_id", "chunk_id"), "vec_id").drop("rank")
    hits = named.join(chunks.select(*HIT, "text"), "chunk_id").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")))
    return hits.select("qid", "rank", "score", *HIT, evidence_text(F.col("text"), F.col("document_title"), F.lit(False)).alias("text"), F.lit("vector").alias("retrieval_method"))


def fused(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Two lists of hits by reciprocal rank; of a chunk in both the left hit's columns stay."""
    both = left.withColumn("arm", F.lit(0)).unionByName(right.withColumn("arm", F.lit(1)))
    rest = [c for c in left.columns if c not in ("qid", "chunk_id", "rank", "score")]
    merged = both.groupBy("qid", "chunk_id").agg(F.round(F.sum(1.0 / (retrieval.RRF + F.col("rank"))), 9).alias("score"), F.min_by(F.struct(*rest), "arm").alias("hit"))
    ranked = retrieval.top_k(merged, ["qid"], [F.desc("score"), F.asc("chunk_id")], k)
    return ranked.select("qid", "rank", "score", "chunk_id", "hit.*").withColumn("retrieval_method", F.lit("hybrid")).select(left.columns)
