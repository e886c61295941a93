"""Queries over the driver's tables, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import calendar, names
from lodestar.operators import evaluation, graph, pools, retrieval
from lodestar.sources.files import dealt
from lodestar.sources.tables import EVENT_SQL, event_view, read_table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def ev(select: str, more: str = "") -> str:
    return f"WITH {EVENT_SQL}{more}\n{select}"


# Pools ---------------------------------------------------------------------------------------------------------------

@query(ev("SELECT id, title, competitors FROM ev WHERE sport = 'building' AND year = 1995 AND season = 'Summer'"))
def pool_filter(spark, sf_dir) -> DataFrame:
    return pools.pool_filter(event_view(spark, sf_dir), "building", 1995, "Summer").select("id", "title", "competitors")


ASKED = ["Order 1", "order 7", "ORDER 33", "Order 2000000000", "Order 5"]
ASKED_SQL = ", q AS (SELECT unnest(['Order 1', 'order 7', 'ORDER 33', 'Order 2000000000', 'Order 5']) AS asked), m AS (SELECT asked, id, title, nations, CASE WHEN title = asked THEN 1 WHEN id IS NOT NULL THEN 2 END AS tier FROM q LEFT JOIN ev ON lower(trim(title)) = lower(trim(asked)))"


def _asked(spark) -> DataFrame:
    return spark.createDataFrame([(a,) for a in ASKED], "asked string")


@query(ev("SELECT asked, id, tier FROM m QUALIFY tier IS NOT DISTINCT FROM min(tier) OVER (PARTITION BY asked)", ASKED_SQL))
def title_lookup_tiered(spark, sf_dir) -> DataFrame:
    return pools.title_lookup(event_view(spark, sf_dir), _asked(spark)).select("asked", "id", "tier")


@query(ev("""SELECT asked, CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' WHEN nations IS NULL THEN 'unresolved' ELSE 'supported' END AS status,
CASE WHEN n = 0 THEN 'event_title_not_found' WHEN n > 1 THEN 'multiple_title_matches' WHEN nations IS NULL THEN 'missing_field:nations' END AS reason,
CASE WHEN n = 1 THEN nations::VARCHAR END AS answer FROM (SELECT asked, count(id) AS n, max(nations) AS nations FROM (SELECT * FROM m QUALIFY tier IS NOT DISTINCT FROM min(tier) OVER (PARTITION BY asked)) GROUP BY asked)""", ASKED_SQL))
def lookup_nations_status(spark, sf_dir) -> DataFrame:
    return pools.lookup_status(pools.title_lookup(event_view(spark, sf_dir), _asked(spark)))


COUNT_SQL = "count(*) AS pool_size, count(competitors) AS usable, count(*) FILTER (competitors IS NULL) AS missing, count(*) FILTER (competitors > 4) AS hits"


@query(ev(f"SELECT *, CASE WHEN pool_size = 0 THEN 'not_found' ELSE 'supported' END AS status, CASE WHEN pool_size = 0 THEN 'no_sport_games_events' END AS reason FROM (SELECT {COUNT_SQL} FROM ev WHERE sport = 'machinery' AND year = 1996 AND season = 'Winter')"))
def count_over_threshold(spark, sf_dir) -> DataFrame:
    return pools.count_status(pools.count_over_threshold(pools.pool_filter(event_view(spark, sf_dir), "machinery", 1996, "Winter"), 4, []))


@query(ev(f"SELECT sport, year, season, {COUNT_SQL} FROM ev GROUP BY ALL"))
def count_over_threshold_all_pools(spark, sf_dir) -> DataFrame:
    return pools.count_over_threshold(event_view(spark, sf_dir), 4)


@query(ev("SELECT id, title, sport, year, season, competitors FROM ev QUALIFY competitors = max(competitors) OVER (PARTITION BY sport, year, season)"))
def argmax_ties(spark, sf_dir) -> DataFrame:
    return pools.argmax_ties(event_view(spark, sf_dir)).select("id", "title", "sport", "year", "season", "competitors")


@query(ev("""SELECT sport, year, season, pool_size, usable, top, ties, CASE WHEN usable = 0 THEN 'unresolved' WHEN ties > 1 THEN 'ambiguous' ELSE 'supported' END AS status,
CASE WHEN usable = 0 THEN 'missing_field:competitors' WHEN ties > 1 THEN 'tied_max_competitors' END AS reason, CASE WHEN usable > 0 AND ties = 1 THEN title END AS answer
FROM (SELECT sport, year, season, count(*) AS pool_size, count(competitors) AS usable, max(competitors) AS top, count(*) FILTER (competitors = best) AS ties, min(title) FILTER (competitors = best) AS title
FROM (SELECT *, max(competitors) OVER (PARTITION BY sport, year, season) AS best FROM ev) GROUP BY ALL)"""))
def argmax_status(spark, sf_dir) -> DataFrame:
    return pools.argmax_status(event_view(spark, sf_dir))


KEYS = ["sport", "season", "event_name", "venue"]
PREVIOUS = "CASE WHEN season = 'Winter' AND year = 1994 THEN 1992 WHEN season = 'Winter' AND year = 1992 THEN 1988 ELSE year - 4 END"
NEXT = "CASE WHEN season = 'Winter' AND year = 1992 THEN 1994 ELSE year + 4 END"


def _related_sql(year: str) -> str:
    return f", ed AS (SELECT sport, season, event_name, venue, year AS related_year, count(*) AS related, min(id) AS related_id, max(gold) AS related_gold FROM ev GROUP BY ALL), rel AS (SELECT e.id, e.related_year, related, related_id, related_gold FROM (SELECT *, {year} AS related_year FROM ev) e LEFT JOIN ed USING (sport, season, event_name, venue, related_year))"


@query(ev("SELECT * FROM rel", _related_sql(PREVIOUS)))
def previous_edition_join(spark, sf_dir) -> DataFrame:
    return pools.related_edition(event_view(spark, sf_dir), "previous", KEYS).select("id", "related_year", "related", "related_id", "related_gold")


@query(ev("SELECT * FROM rel", _related_sql(NEXT)))
def next_edition_join(spark, sf_dir) -> DataFrame:
    return pools.related_edition(event_view(spark, sf_dir), "next", KEYS).select("id", "related_year", "related", "related_id", "related_gold")


@query(ev("""SELECT id, related_year, coalesce(related, 0) AS related, CASE WHEN related IS NULL THEN 'unresolved' WHEN related > 1 THEN 'ambiguous' WHEN related_gold IS NULL THEN 'unresolved' ELSE 'supported' END AS status,
CASE WHEN related IS NULL THEN 'previous_event_name_missing' WHEN related > 1 THEN 'multiple_related_events' WHEN related_gold IS NULL THEN 'missing_field:gold' END AS reason, CASE WHEN related = 1 THEN related_gold END AS answer FROM rel""", _related_sql(PREVIOUS)))
def temporal_status(spark, sf_dir) -> DataFrame:
    return pools.related_status(pools.related_edition(event_view(spark, sf_dir), "previous", KEYS), "previous")


@query(ev(f"SELECT DISTINCT year, season, {PREVIOUS} AS previous_year, {NEXT} AS next_year FROM ev"))
def calendar_year_expr(spark, sf_dir) -> DataFrame:
    years = event_view(spark, sf_dir).select("year", "season").distinct()
    return years.select("year", "season", calendar.previous_games_year(F.col("year"), F.col("season")).cast("long").alias("previous_year"), calendar.next_games_year(F.col("year"), F.col("season")).cast("long").alias("next_year"))


VENUES = [(1, "NATION_3", [1995], [7], [4, 5, 6]), (2, "the nation_2 stadium", [], [3], [10]), (3, "NATION", [1996], [], []), (4, "Atlantis", [], [], []), (5, "7 of nation", [1996, 1997], [5], [1, 2]), (6, "nation_14", [1997], [2], [14]), (7, "Olympic-Centre Nation 9", [], [5], [])]
VENUES_SQL = """, vq AS (SELECT * FROM (VALUES (1, 'NATION_3', [1995], [7], [4, 5, 6]), (2, 'the nation_2 stadium', [], [3], [10]), (3, 'NATION', [1996], [], []), (4, 'Atlantis', [], [], []), (5, '7 of nation', [1996, 1997], [5], [1, 2]), (6, 'nation_14', [1997], [2], [14]), (7, 'Olympic-Centre Nation 9', [], [5], [])) t(query_id, asked, years, months, days)),
sc AS (SELECT query_id, venue, CASE WHEN a = '' OR v = '' THEN 0 WHEN a = v THEN 100 WHEN contains(v, a) THEN 70 WHEN contains(a, v) THEN 60
 WHEN len(words) > 0 AND len(list_filter(words, lambda w: NOT list_contains(regexp_extract_all(lower(venue), '[a-z0-9+]+'), w))) = 0 THEN 40 ELSE 0 END AS score
 FROM (SELECT *, regexp_replace(lower(asked), '[^a-z0-9]', '', 'g') AS a, list_filter(regexp_extract_all(lower(asked), '[a-z0-9+]+'), lambda w: w NOT IN ('the', 'and', 'at', 'of', 'olympic', 'olympics', 'centre', 'center')) AS words FROM vq), (SELECT DISTINCT venue, regexp_replace(lower(venue), '[^a-z0-9]', '', 'g') AS v FROM ev)),
best AS (SELECT * FROM sc WHERE score > 0 QUALIFY score = max(score) OVER (PARTITION BY query_id)),
vm AS (SELECT b.query_id, b.score, e.*, q.years, q.months, q.days FROM best b JOIN ev e USING (venue) JOIN vq q USING (query_id)),
vd AS (SELECT * FROM (SELECT *, CASE WHEN days = [day(event_date)] THEN 3 ELSE 1 END AS specificity FROM vm
 WHERE (len(years) = 0 OR list_contains(years, year(event_date))) AND (len(months) = 0 OR list_contains(months, month(event_date))) AND (len(days) = 0 OR list_contains(days, day(event_date)))) QUALIFY specificity = max(specificity) OVER (PARTITION BY query_id))"""


def _venue_queries(spark) -> DataFrame:
    return spark.createDataFrame(VENUES, "query_id int, asked string, years array<int>, months array<int>, days array<int>")


@query(ev("SELECT query_id, venue, score FROM sc", VENUES_SQL))
def venue_score_theta(spark, sf_dir) -> DataFrame:
    venues = event_view(spark, sf_dir).select("venue").distinct()
    return venues.crossJoin(F.broadcast(_venue_queries(spark))).select("query_id", "venue", names.venue_score(names.fold_text("asked"), names.fold_text("venue")).alias("score"))


@query(ev("SELECT query_id, score, id FROM vm", VENUES_SQL))
def venue_best_ties(spark, sf_dir) -> DataFrame:
    return pools.venue_matches(event_view(spark, sf_dir), _venue_queries(spark)).select("query_id", "score", "id")


@query(ev("SELECT query_id, id FROM ev, vq WHERE asked NOT IN ('NATION', 'Atlantis') AND (len(years) = 0 OR list_contains(years, year(event_date))) AND (len(months) = 0 OR list_contains(months, month(event_date))) AND (len(days) = 0 OR list_contains(days, day(event_date)))", VENUES_SQL))
def date_part_overlap(spark, sf_dir) -> DataFrame:
    asked = F.broadcast(_venue_queries(spark).where("asked not in ('NATION', 'Atlantis')"))
    overlap = calendar.dates_overlap(pools.event_days(F.col("event_date")), F.struct("years", "months", "days"))
    return event_view(spark, sf_dir).join(asked, overlap).select("query_id", "id")


@query(ev("SELECT query_id, id, specificity FROM vd", VENUES_SQL))
def venue_date_narrow(spark, sf_dir) -> DataFrame:
    return pools.venue_date(pools.venue_matches(event_view(spark, sf_dir), _venue_queries(spark))).select("query_id", "id", "specificity")


@query(ev("""SELECT query_id, CASE WHEN a.n IS NULL THEN 'not_found' WHEN d.n IS NULL THEN 'unresolved' WHEN d.n > 1 THEN 'ambiguous' WHEN gold IS NULL THEN 'unresolved' ELSE 'supported' END AS status,
CASE WHEN a.n IS NULL THEN 'venue_not_found' WHEN d.n IS NULL THEN 'date_does_not_overlap' WHEN d.n > 1 THEN 'multiple_events_same_venue_date' WHEN gold IS NULL THEN 'missing_field:gold' END AS reason, CASE WHEN d.n = 1 THEN gold END AS answer
FROM vq LEFT JOIN (SELECT query_id, count(*) AS n FROM vm GROUP BY 1) a USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n, max(gold) AS gold FROM vd GROUP BY 1) d USING (query_id)""", VENUES_SQL))
def venue_date_status(spark, sf_dir) -> DataFrame:
    queries = _venue_queries(spark)
    matches = pools.venue_matches(event_view(spark, sf_dir), queries)
    return pools.venue_date_status(queries, matches, pools.venue_date(matches))


# Graph ---------------------------------------------------------------------------------------------------------------

@query(ev("SELECT DISTINCT year::VARCHAR || '_' || season AS id, year, season FROM ev"))
def dim_games(spark, sf_dir) -> DataFrame:
    return graph.dim_games(event_view(spark, sf_dir))


@query(ev("SELECT sport AS id, arg_min(event_name, id) AS name FROM ev GROUP BY sport"))
def dim_sport_first_name(spark, sf_dir) -> DataFrame:
    return graph.dim_sport(event_view(spark, sf_dir))


@query(ev("SELECT lower(trim(venue)) AS id, min(venue) AS name FROM ev GROUP BY 1"))
def dim_venue_min_name(spark, sf_dir) -> DataFrame:
    return graph.dim_venue(event_view(spark, sf_dir))


@query(ev("SELECT 'event' AS \"table\", count(*) AS n FROM ev UNION ALL SELECT 'games', count(DISTINCT (year, season)) FROM ev UNION ALL SELECT 'sport', count(DISTINCT sport) FROM ev UNION ALL SELECT 'venue', count(DISTINCT lower(venue)) FROM ev UNION ALL SELECT 'in_games', count(*) FROM ev UNION ALL SELECT 'held_at', count(venue) FROM ev"))
def graph_counts(spark, sf_dir) -> DataFrame:
    events = event_view(spark, sf_dir)
    return graph.counts({"event": events, "games": graph.dim_games(events), "sport": graph.dim_sport(events), "venue": graph.dim_venue(events), "in_games": graph.edge_in_games(events), "held_at": graph.edge_held_at(events)})


@query(ev("SELECT id AS src, year::VARCHAR || '_' || season AS tgt, year, season FROM ev"))
def edge_in_games(spark, sf_dir) -> DataFrame:
    return graph.edge_in_games(event_view(spark, sf_dir))


@query(ev("SELECT id AS src, lower(trim(venue)) AS tgt, venue AS venue_raw FROM ev"))
def edge_held_at(spark, sf_dir) -> DataFrame:
    return graph.edge_held_at(event_view(spark, sf_dir))


@query(ev("SELECT id AS event_id, 'IN_GAMES' AS relation, year::VARCHAR || '_' || season AS tgt FROM ev UNION ALL SELECT id, 'OF_SPORT', sport FROM ev UNION ALL SELECT id, 'HELD_AT', lower(trim(venue)) FROM ev"))
def neighborhood_edges(spark, sf_dir) -> DataFrame:
    return graph.neighborhood(event_view(spark, sf_dir))


def _line_chunks(spark, sf_dir) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    return dealt(lines, lines.count(), "l_orderkey").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("chunk_index"), F.when(F.col("l_linenumber") == 1, "infobox").otherwise("text").alias("kind"))


@query(ev("SELECT event_id, chunk_index, kind FROM (SELECT l_orderkey AS event_id, l_linenumber AS chunk_index, CASE WHEN l_linenumber = 1 THEN 'infobox' ELSE 'text' END AS kind FROM lineitem WHERE l_orderkey IN (SELECT id FROM ev WHERE season = 'Winter')) QUALIFY kind = 'infobox' OR row_number() OVER (PARTITION BY event_id, kind ORDER BY chunk_index) <= 2"))
def chunks_for_events_cap(spark, sf_dir) -> DataFrame:
    return graph.chunks_for_events(_line_chunks(spark, sf_dir), event_view(spark, sf_dir).where("season = 'Winter'"), 2)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_join_ids(spark, sf_dir) -> DataFrame:
    returned = read_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey").join(returned, "o_orderkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_join_unmapped(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey").join(read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT coalesce(a.k, b.k) AS \"table\", coalesce(a.n, 0) AS expected, coalesce(b.n, 0) AS actual FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1) b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def full_outer_reconcile(spark, sf_dir) -> DataFrame:
    expected = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("table")).agg(F.count(F.lit(1)).alias("n"))
    actual = read_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("table")).agg(F.count(F.lit(1)).alias("n"))
    return graph.reconcile(expected, actual)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max((ts, event_id))[2] AS event_id FROM events GROUP BY user_id")
def upsert_latest_wins(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    late = rows.where("event_type = 'purchase'")
    return rows.where("event_type <> 'purchase' or event_type is null").unionByName(late).groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.event_type", "r.event_id")


# Text and vectors ----------------------------------------------------------------------------------------------------

FOLDED = "coalesce(text, '')"
for _c, _form in names.ASCII_FOLDS.items():
    FOLDED = f"replace({FOLDED}, '{_c}', '{_form}')"
TOKENS = f"regexp_extract_all(lower({FOLDED}), '[a-z0-9]+')"


@query(f"SELECT doc_id, len({TOKENS}) AS n_tokens, len(list_distinct({TOKENS})) AS n_distinct FROM documents")
def tokenize_counts(spark, sf_dir) -> DataFrame:
    tokens = names.tokenize(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"))


@query(f"SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY token")
def bm25_stats(spark, sf_dir) -> DataFrame:
    return retrieval.postings(read_table(spark, sf_dir, "documents")).groupBy("token").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def bm25_sql(name: str, queries: str, k: int) -> str:
    """CTEs that end in `name` (query_id, doc, score, rank)."""
    return f"""{name}_q AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({TOKENS}) AS token FROM ({queries})) GROUP BY ALL),
{name}_d AS (SELECT doc_id, greatest(len({TOKENS}), 1) AS dl, {TOKENS} AS t FROM documents),
{name}_c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_d),
{name}_t AS (SELECT token, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS token FROM {name}_d) GROUP BY ALL),
{name}_f AS (SELECT token, count(*) AS df FROM {name}_t GROUP BY token),
{name}_s AS (SELECT query_id, doc_id AS doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * times), 6) AS score
 FROM {name}_t JOIN {name}_f USING (token) JOIN {name}_q USING (token), {name}_c GROUP BY ALL),
{name} AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM {name}_s WHERE score > 0 QUALIFY rank <= {k})"""


def _items(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _variant(spark, sf_dir) -> DataFrame:
    """The longer words of every whole item."""
    return _items(spark, sf_dir).withColumn("text", F.array_join(F.filter(names.tokenize(F.col("text")), lambda t: F.length(t) > 3), " "))


ITEMS_SQL = "SELECT item_id AS query_id, text FROM benchmark"
VARIANT_SQL = f"SELECT item_id AS query_id, array_to_string(list_filter({TOKENS}, lambda t: length(t) > 3), ' ') AS text FROM benchmark"


@query("WITH " + bm25_sql("r", ITEMS_SQL, 1) + " SELECT * FROM r")
def bm25_topk(spark, sf_dir) -> DataFrame:
    """The best document of every item."""
    return retrieval.bm25(read_table(spark, sf_dir, "documents"), _items(spark, sf_dir), 1).select("query_id", "doc", "score", "rank")


@query("WITH " + bm25_sql("r", ITEMS_SQL, 10) + " SELECT * FROM r")
def bm25_multi_query(spark, sf_dir) -> DataFrame:
    return retrieval.bm25(read_table(spark, sf_dir, "documents"), _items(spark, sf_dir), 10).select("query_id", "doc", "score", "rank")


TWO = "WITH " + bm25_sql("a", ITEMS_SQL, 10) + ", " + bm25_sql("b", VARIANT_SQL, 10)


def _two(spark, sf_dir) -> list[DataFrame]:
    """Both lists, of one pass over the documents."""
    both = _items(spark, sf_dir).withColumn("list", F.lit(0)).unionByName(_variant(spark, sf_dir).withColumn("list", F.lit(1)))
    found = retrieval.bm25(read_table(spark, sf_dir, "documents"), both, 10)
    return [found.where(F.col("list") == n).drop("list") for n in (0, 1)]


@query(TWO + " SELECT query_id, doc, max(score) AS score FROM (SELECT query_id, doc, score FROM a UNION ALL SELECT query_id, doc, score FROM b) GROUP BY ALL")
def max_merge_variants(spark, sf_dir) -> DataFrame:
    return retrieval.max_merge(*_two(spark, sf_dir))


@query(TWO + " SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM (SELECT query_id, doc, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, doc, rank FROM a UNION ALL SELECT query_id, doc, rank FROM b) GROUP BY ALL)")
def rrf_fuse(spark, sf_dir) -> DataFrame:
    return retrieval.rrf(*_two(spark, sf_dir))


@query("WITH " + bm25_sql("r", ITEMS_SQL, 10) + ", l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS chunk_index FROM documents) SELECT query_id, doc, chunk_index, row_number() OVER (PARTITION BY query_id, doc ORDER BY chunk_index) AS chunk_rank FROM (SELECT DISTINCT query_id, doc FROM r) JOIN l USING (doc) QUALIFY chunk_rank <= 3")
def doc_expand_top3(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n"))).select("doc", (F.col("pos") + 1).cast("long").alias("chunk_index"), F.lit("text").alias("kind"))
    return retrieval.doc_expansion(retrieval.bm25(docs, _items(spark, sf_dir), 10), chunks).select("query_id", "doc", "chunk_index", "chunk_rank")


WORDS = "list_distinct(list_filter(string_split(lower({}), ' '), lambda w: w <> ''))"


@query("WITH " + bm25_sql("r", ITEMS_SQL, 10) + f" SELECT query_id, doc, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS jaccard FROM (SELECT query_id, doc, {WORDS.format('i.text')} AS a, {WORDS.format('d.text')} AS b FROM r JOIN benchmark i ON item_id = query_id JOIN documents d ON doc_id = doc)")
def token_jaccard(spark, sf_dir) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), _items(spark, sf_dir)
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda w: w != ""))
    hits = retrieval.bm25(docs, items, 10).select("query_id", "doc").join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").join(items.withColumnRenamed("text", "asked"), "query_id")
    return hits.select("query_id", "doc", F.round(retrieval.jaccard(words(F.col("asked")), words(F.col("text"))), 6).alias("jaccard"))


VECTOR_SQL = "SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {}) QUALIFY rank <= {}"


@query(VECTOR_SQL.format("a.vec_id % 50 = 0", 10))
def vector_topk_cosine(spark, sf_dir) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return retrieval.vector_top_k(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


@query(VECTOR_SQL.format("a.vec_id % 50 = 0", 5))
def vector_self_knn(spark, sf_dir) -> DataFrame:
    """The stated query set, every row whose id is divisible by 50, against all rows."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return retrieval.vector_top_k(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@query()
def mmr_rerank(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    hits = retrieval.bm25(docs, _items(spark, sf_dir), 10)
    return retrieval.mmr(hits.join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc"))


# Evaluation and profiles ---------------------------------------------------------------------------------------------

GOLD_SQL = "gold AS (SELECT item_id AS query_id, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _gold(spark, sf_dir) -> DataFrame:
    """Documents that hold a passage."""
    items = _items(spark, sf_dir).withColumnRenamed("text", "passage")
    return retrieval.holders(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), items).select("query_id", "doc")


@query(f"WITH {GOLD_SQL} SELECT * FROM gold")
def gold_join(spark, sf_dir) -> DataFrame:
    return _gold(spark, sf_dir)


RECALL = "SELECT query_id, {} FROM (SELECT g.query_id, (r.doc IS NOT NULL)::INT AS hit FROM gold g LEFT JOIN (SELECT query_id, doc FROM r WHERE rank <= 5) r USING (query_id, doc)) GROUP BY query_id"


@query("WITH " + bm25_sql("r", ITEMS_SQL, 10) + f", {GOLD_SQL} " + RECALL.format("max(hit) AS recalled"))
def recall_at_k(spark, sf_dir) -> DataFrame:
    return evaluation.recall_at(retrieval.bm25(read_table(spark, sf_dir, "documents"), _items(spark, sf_dir), 10), _gold(spark, sf_dir), 5).select("query_id", "recalled")


@query("WITH " + bm25_sql("r", ITEMS_SQL, 10) + f", {GOLD_SQL} " + RECALL.format("round(avg(hit), 6) AS set_recall"))
def set_recall(spark, sf_dir) -> DataFrame:
    return evaluation.recall_at(retrieval.bm25(read_table(spark, sf_dir, "documents"), _items(spark, sf_dir), 10), _gold(spark, sf_dir), 5).select("query_id", "set_recall")


@query("SELECT event_type, value AS p95, n FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE i = round_even(0.95 * (n - 1), 0) + 1")
def nearest_rank_p95(spark, sf_dir) -> DataFrame:
    return evaluation.nearest_rank(read_table(spark, sf_dir, "events"), ["event_type"], "value", 95)


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) FILTER (value > 50) / count(*), 6) AS over_50, round(avg(value), 6) AS mean_value, max(value) AS most FROM events GROUP BY 1")
def system_stats(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), evaluation.rate(F.count_if(F.col("value") > 50), F.count(F.lit(1))).alias("over_50"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("most"))


def _labelled(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read_table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT lang, source, grouping(source)::INT AS overall, count(*) AS n, sum(quality) AS good FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (lang, source))")
def grouping_sets_summary(spark, sf_dir) -> DataFrame:
    rows = _labelled(spark, sf_dir).groupingSets([["lang"], ["lang", "source"]], "lang", "source")
    return rows.agg(F.grouping("source").cast("int").alias("overall"), F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))


@query("SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, quality)")
def rollup_coverage(spark, sf_dir) -> DataFrame:
    return _labelled(spark, sf_dir).rollup("lang", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.lang, count(l.quality) AS labelled, round(avg(l.quality), 6) AS mean_quality FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def null_skipping_mean(spark, sf_dir) -> DataFrame:
    joined = read_table(spark, sf_dir, "documents").select("doc_id", "lang").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("quality").alias("labelled"), F.round(F.avg("quality"), 6).alias("mean_quality"))


@query("WITH m AS (SELECT event_type, avg(value) AS v FROM events GROUP BY 1) SELECT event_type, round(v - (SELECT v FROM m WHERE event_type = (SELECT min(event_type) FROM m)), 6) AS delta FROM m")
def delta_vs_baseline(spark, sf_dir) -> DataFrame:
    means = read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("v"))
    base = means.agg(F.min_by("v", "event_type").alias("base"))
    return means.join(F.broadcast(base)).select("event_type", F.round(F.col("v") - F.col("base"), 6).alias("delta"))


@query(ev("SELECT status, count(*) AS n FROM (SELECT CASE WHEN related IS NULL THEN 'unresolved' WHEN related > 1 THEN 'ambiguous' WHEN related_gold IS NULL THEN 'unresolved' ELSE 'supported' END AS status FROM rel) GROUP BY 1", _related_sql(PREVIOUS)))
def status_histogram(spark, sf_dir) -> DataFrame:
    return temporal_status(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


FIELDS = ["competitors", "nations", "venue", "gold"]
MISSING_SQL = "mr AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n, count(*) - count({f}) AS missing, round(100.0 * count({f}) / count(*), 6) AS present FROM ev" for f in FIELDS) + ")"


@query(ev("SELECT * FROM mr", ", " + MISSING_SQL))
def profile_missing_rates(spark, sf_dir) -> DataFrame:
    return evaluation.missing_rates(event_view(spark, sf_dir), FIELDS)


@query(ev("SELECT field, CASE WHEN present >= 95 THEN 'reliable' WHEN present >= 70 THEN 'partial' ELSE 'sparse' END AS bucket FROM mr", ", " + MISSING_SQL))
def field_buckets(spark, sf_dir) -> DataFrame:
    return evaluation.missing_rates(event_view(spark, sf_dir), FIELDS).select("field", evaluation.buckets(F.col("present")).alias("bucket"))


@query(ev("SELECT sport, event_name, venue, event_date, count(*) AS n, min(id) AS first_id FROM ev GROUP BY ALL HAVING count(*) > 1"))
def profile_duplicates(spark, sf_dir) -> DataFrame:
    return event_view(spark, sf_dir).groupBy("sport", "event_name", "venue", "event_date").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query(ev("SELECT sport, count(*) AS n, min(id) AS first_seen, row_number() OVER (ORDER BY count(*) DESC, min(id)) AS place FROM ev GROUP BY sport"))
def profile_histogram_first_seen(spark, sf_dir) -> DataFrame:
    counted = event_view(spark, sf_dir).groupBy("sport").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_seen"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first_seen")).cast("long"))


@query("SELECT count(c) AS n, round(avg(c), 6) AS mean, round(median(c), 6) AS median, min(c) AS least, max(c) AS most FROM (SELECT length(text) AS c FROM documents)")
def chunk_stats_median(spark, sf_dir) -> DataFrame:
    return evaluation.median_exact(read_table(spark, sf_dir, "documents").select(F.char_length("text").cast("long").alias("c")), "c")


@query("SELECT conv_id AS query_id, role AS doc, min(turn) AS rank FROM conversations GROUP BY ALL")
def first_rank_per_doc(spark, sf_dir) -> DataFrame:
    return evaluation.first_rank(read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("doc"), F.col("turn").alias("rank")))


@query("SELECT conv_id AS query_id, role AS doc, max(turn) AS rank FROM conversations GROUP BY ALL")
def last_rank_per_doc(spark, sf_dir) -> DataFrame:
    return evaluation.last_rank(read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("doc"), F.col("turn").alias("rank")))


@query("SELECT conv_id, turn, count(*) FILTER (first) OVER (PARTITION BY conv_id ORDER BY turn) AS known FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) = 1 AS first FROM conversations)")
def running_distinct_set(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("d"))
    rows = rows.withColumn("first", (F.row_number().over(Window.partitionBy("conv_id", "d").orderBy("turn")) == 1).cast("long"))
    return rows.select("conv_id", "turn", F.sum("first").over(Window.partitionBy("conv_id").orderBy("turn")).alias("known"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events WHERE ts <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) GROUP BY 1")
def latest_status(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    middle = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select((F.unix_micros("a") + F.floor((F.unix_micros("b") - F.unix_micros("a")) / 2)).alias("middle"))
    near = rows.join(F.broadcast(middle)).where(F.unix_micros("ts") <= F.col("middle"))
    return near.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


# Sets ----------------------------------------------------------------------------------------------------------------

@query("SELECT doc_id, min(ord) AS ord FROM (SELECT doc_id, 1 AS ord FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 2 FROM documents WHERE lang = 'en') GROUP BY 1")
def ordered_distinct_union(spark, sf_dir) -> DataFrame:
    first = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("ord"))
    second = read_table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.lit(2).alias("ord"))
    return first.unionByName(second).groupBy("doc_id").agg(F.min("ord").alias("ord"))


@query("SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def set_intersect(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").intersect(read_table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id").exceptAll(read_table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT text AS evidence, min((conv_id, turn))[1] AS conv_id, min((conv_id, turn))[2] AS turn FROM conversations GROUP BY text")
def dedupe_first_wins(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").groupBy(F.col("text").alias("evidence")).agg(F.min(F.struct("conv_id", "turn")).alias("m")).select("evidence", "m.conv_id", "m.turn")


# Scalars -------------------------------------------------------------------------------------------------------------

@query("SELECT o_orderkey, '|' || year(o_orderdate)::VARCHAR || '|' || month(o_orderdate)::VARCHAR || '|' AS packed, year(o_orderdate) + month(o_orderdate) AS total FROM orders")
def packed_ints_roundtrip(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", names.packed_ints(F.array(F.year("o_orderdate"), F.month("o_orderdate"))).alias("packed"))
    return rows.select("o_orderkey", "packed", F.aggregate(names.unpack_ints(F.col("packed")), F.lit(0).cast("long"), lambda acc, v: acc + v).alias("total"))


@query("SELECT o_orderkey, greatest(least(coalesce((o_totalprice * 100000)::BIGINT, -1), 2147483647), -2147483648)::BIGINT AS clamped FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def clamp_int32(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", names.clamp_int32(F.floor("o_totalprice") * 100000).alias("clamped"))


NORM = "trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256(CASE WHEN {NORM} = '' THEN ' ' ELSE left({NORM}, 1800) END) AS digest FROM documents")
def digest_sha256(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(names.embedding_text(F.col("text")).cast("binary"), 256).alias("digest"))


@query(f"SELECT doc_id, CASE WHEN {NORM} = '' THEN ' ' ELSE left({NORM}, 1800) END AS norm FROM documents")
def embedding_text_norm(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", names.embedding_text(F.col("text")).alias("norm"))


@query("SELECT page_id, nullif(regexp_extract(html, '(?:18|19|20)[0-9]{2}'), '')::BIGINT AS year FROM pages")
def year_regex(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", names.first_year(F.col("html")).alias("year"))


@query("SELECT page_id, nullif(regexp_extract(url, '-?[0-9]+'), '')::BIGINT AS value FROM pages")
def int_regex(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", names.first_int(F.col("url")).alias("value"))


@query("SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS compact FROM pages")
def compact_alnum_ascii(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", names.compact_alnum(F.lower("url")).alias("compact"))


FOLD_SQL = "replace(lower(strip_accents(translate(coalesce(text, ''), '-–—', '   '))), 'ß', 'ss')"


@query(f"SELECT doc_id, trim(regexp_replace({FOLD_SQL}, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS folded FROM documents")
def fold_text(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", names.fold_text("text").alias("folded"))
