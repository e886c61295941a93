"""Text and vector retrieval: BM25, cosine, fusion, reranking, expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.names import tokenize
from lodestar.sources.files import discard, stash

K1, B, RRF = 1.5, 0.75, 60


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """token, doc, tf, dl: terms are counted within a document's row, before any shuffle."""
    tokens = docs.select(F.col(doc).alias("doc"), tokenize(F.col(text)).alias("t"))
    own = tokens.select("doc", F.greatest(F.size("t"), F.lit(1)).alias("dl"), F.explode("t").alias("token"))
    return own.groupBy("token", "doc", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n documents, avgdl."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.greatest(F.size(tokenize(F.col(text))), F.lit(1)).cast("double")).alias("avgdl"))


#: Queries, and their distinct terms, that meet all documents in one pass; what they make is all that a task holds beside its documents.
QUERIES_PER_PASS, TERMS_PER_PASS = 512, 100_000
#: (document, query) terms that are added up at once, and hits that a task gathers before it cuts them to k for each query.
TERMS_AT_ONCE, HITS_AT_ONCE = 2_000_000, 200_000


def _bags(vocabulary):
    """Tokens (doc, t) to bags: doc, its length, and the ids and counts of the vocabulary's tokens that it has, by id."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(vocabulary.value, pa.string())
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            ids = pc.index_in(batch.column(1).flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype("i8")
            row = np.repeat(np.arange(len(sizes)), sizes)[ids >= 0]
            key, tf = np.unique(row * max(1, len(known)) + ids[ids >= 0], return_counts=True)
            cuts = pa.array(np.searchsorted(key, np.arange(len(sizes) + 1) * max(1, len(known))), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (key % max(1, len(known)), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.maximum(sizes, 1), pa.int32()), *lists], ["doc", "dl", "ids", "tfs"])

    return run


def _merged(batches):
    """Documents with all their bags to one row each: how many bags, their whole length, and their terms by length and id; counts of the same add up."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        own = batch.column(1)
        bags = own.flatten()
        dl, ids, tfs = bags.field("dl").to_numpy(zero_copy_only=False), bags.field("ids"), bags.field("tfs")
        n = pc.list_value_length(own).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(n)), n)
        total = np.bincount(doc, dl, len(n)).astype("i8")
        sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        doc, length = np.repeat(doc, sizes), np.repeat(dl, sizes)
        term, tf = (x.flatten().to_numpy(zero_copy_only=False) for x in (ids, tfs))
        if len(bags) > len(n):
            order = np.lexsort((term, length, doc))
            doc, length, term, tf = doc[order], length[order], term[order], tf[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (length[1:] != length[:-1]) | (term[1:] != term[:-1])])) if len(doc) else np.empty(0, "i8")
            tf = np.add.reduceat(tf, first) if len(first) else tf
            doc, length, term = doc[first], length[first], term[first]
        cuts = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (length, term, tf)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total), *lists], ["doc", "n", "total", "dls", "ids", "tfs"])


def _best(asked, k: int):
    """Documents as _merged gives them to hits (q, doc, score): for each query the k best of a task, by score rounded to 6 digits, then doc."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names, first, query, times, idf, avgdl = asked.value
        owners = np.diff(first)
        floor, hits, held = np.zeros(len(names)), [], 0

        def cut():
            rows = pa.concat_tables(hits)
            rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("score", "descending"), ("doc", "ascending")]))
            q, score = rows.column("q").to_numpy(), rows.column("score").to_numpy()
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == k - 1
            floor[q[last]] = score[last]
            return rows.filter(pa.array(place < k))

        for batch in batches:
            dls, ids, tfs = (batch.column(i) for i in (1, 2, 3))
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(ids).to_numpy(zero_copy_only=False))
            dl, term, tf = (x.flatten().to_numpy(zero_copy_only=False) for x in (dls, ids, tfs))
            weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            # each document's terms, and with them the queries that have them, stay together
            work = np.concatenate([[0], np.cumsum(np.bincount(doc, owners[term], batch.num_rows) + len(names))])
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))])
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(work, work[low] + TERMS_AT_ONCE, "right")) - 1)
                part = slice(ends[low], ends[high])
                many = owners[term[part]]
                at = np.arange(many.sum()) + np.repeat(first[term[part]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
                cell = np.repeat((doc[part] - low) * len(names), many) + query[at]
                score = np.round(np.bincount(cell, np.repeat(weight[part], many) * times[at], (high - low) * len(names)), 6).reshape(high - low, len(names))
                d, q = np.nonzero((score > 0) & (score >= floor))
                hits.append(pa.table({"q": pa.array(q, pa.int64()), "doc": batch.column(0).take(pa.array(d + low)), "score": pa.array(score[d, q])}))
                held += len(d)
                low = high
                if held > HITS_AT_ONCE:
                    hits = [cut()]
                    held = len(hits[0])
        if held:
            rows = cut()
            yield from rows.set_column(0, "q", pa.array(names[rows.column("q").to_numpy()], pa.int64())).combine_chunks().to_batches()

    return run


def _pass(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """queries (q, terms) against all docs in one pass: the hits (q, doc, score) of every task, and the bags that they are made of."""
    import numpy as np

    spark = docs.sparkSession
    rows = sorted(queries.select("q", "terms").collect())
    vocabulary = sorted({t["token"] for r in rows for t in r["terms"]})
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select(F.col("doc_id").alias("doc"), tokenize(F.col("text")).alias("t"))
    bags = cut.mapInArrow(_bags(spark.sparkContext.broadcast(vocabulary)), f"doc {kind}, dl int, ids array<int>, tfs array<int>")
    # rows of one document add up
    bags = bags.groupBy("doc").agg(F.collect_list(F.struct("dl", "ids", "tfs")).alias("bags"))
    bags = stash(bags.mapInArrow(_merged, f"doc {kind}, n long, total long, dls array<int>, ids array<int>, tfs array<int>"), "bags")
    n, total = bags.agg(F.sum("n"), F.sum("total")).head()
    df = np.zeros(len(vocabulary))
    for row in bags.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        df[row["id"]] = row["count"]
    place = {token: i for i, token in enumerate(vocabulary)}
    terms = np.array([(place[t["token"]], i, t["times"]) for i, r in enumerate(rows) for t in r["terms"]], "i8").reshape(-1, 3)
    terms = terms[np.argsort(terms[:, 0], kind="stable")]
    first = np.searchsorted(terms[:, 0], np.arange(len(vocabulary) + 1))
    idf = np.log(1 + ((n or 0) - df + 0.5) / (df + 0.5))
    asked = spark.sparkContext.broadcast((np.array([r["q"] for r in rows], "i8"), first, terms[:, 1].copy(), terms[:, 2].copy(), idf, (total or 1) / (n or 1)))
    hits = bags.select("doc", "dls", "ids", "tfs").mapInArrow(_best(asked, k), f"q long, doc {kind}, score double")
    out = stash(hits, "hits")
    discard(bags)
    return out


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """queries (query_id, text): query_id, doc, score, rank, k documents at most for each, by score rounded to 6 digits, then doc.

    Other columns of queries, such as the list or the variant that a text belongs
    to, tell queries apart like query_id, so that many lists share one pass over
    the documents. A token that a query repeats adds repeatedly.

    A pass writes each document's counts of the queries' tokens once. Each task
    then scores its documents for all queries of the pass and keeps k for each,
    so that no row is made of a document and a query but those. Queries beyond
    QUERIES_PER_PASS or TERMS_PER_PASS take further passes.
    """
    by = [c for c in queries.columns if c != "text"]
    tokens = queries.select(*by, F.explode(tokenize(F.col("text"))).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("times"))
    asked = tokens.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("token", "times"))).alias("terms"))
    asked = stash(asked.withColumn("q", F.monotonically_increasing_id()), "asked-queries")
    many, terms = asked.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).head()
    passes = max(1, -(-many // QUERIES_PER_PASS), -(-(terms or 0) // TERMS_PER_PASS))
    block = F.pmod(F.xxhash64("q"), F.lit(passes))
    found = [_pass(docs, asked.where(block == i), k) for i in range(passes)]
    best = top_k(reduce(DataFrame.unionByName, found), ["q"], [F.desc("score"), F.asc("doc")], k)
    # written, so that joins with documents know how few they are
    out = stash(best.join(asked.select("q", *by), "q").select(*by, "doc", "score", "rank"), "bm25")
    for hits in [asked, *found]:
        discard(hits)
    return out


#: Words of a passage by which documents that may hold it are found.
ANCHOR_WORDS = 5
#: Passages, and their characters, that all tasks hold in one pass over the documents.
PASSAGES_PER_PASS, CHARACTERS_PER_PASS = 10_000, 16_000_000


def holders(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs (doc, text) with the passages (query_id, passage) that stand in their text, anywhere, even within words; a row for each row of both.

    The words of a passage but for its first and last, which may be cut, stand
    whole in any text that holds it. The first ANCHOR_WORDS of these meet the
    runs of as many words of the documents by equality, and only texts that
    share them are searched. Passages with fewer such words are searched for in all texts.

    Passages go to the documents, so that no text and no run of words is
    shuffled; more than PASSAGES_PER_PASS or CHARACTERS_PER_PASS take further passes.
    """
    words = lambda c: F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    inner = F.slice(words(F.col("passage")), F.lit(2), F.greatest(F.size(words(F.col("passage"))) - 2, F.lit(0)))
    anchor = F.when(F.size(inner) >= ANCHOR_WORDS, F.xxhash64(F.array_join(F.slice(inner, 1, ANCHOR_WORDS), " ")))
    asked = stash(passages.where("passage is not null").select("query_id", "passage", anchor.alias("anchor")), "passages")
    many, characters = asked.agg(F.count(F.lit(1)), F.sum(F.length("passage"))).head()
    passes = max(1, -(-many // PASSAGES_PER_PASS), -(-(characters or 0) // CHARACTERS_PER_PASS))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - ANCHOR_WORDS + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(ANCHOR_WORDS)), " ")))
    own = docs.select("doc", "text", words(F.col("text")).alias("w")).select("doc", "text", F.when(F.size("w") >= ANCHOR_WORDS, runs).alias("runs"))
    found = []
    for i in range(passes):
        some = asked.where(F.pmod(F.xxhash64("query_id", "passage"), F.lit(passes)) == i)
        long, short = some.where("anchor is not null"), some.where("anchor is null")
        shared = own.join(F.broadcast(long.agg(F.collect_set("anchor").alias("anchors")))).where(F.coalesce(F.arrays_overlap("runs", "anchors"), F.lit(False)))
        near = shared.select("doc", "text", F.explode(F.array_intersect("runs", "anchors")).alias("anchor")).join(F.broadcast(long), "anchor")
        found += [rows.where(F.contains("text", "passage")).select("doc", "query_id") for rows in (near, docs.join(F.broadcast(short)))]
    return reduce(DataFrame.unionByName, found)


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts each task's rows to k before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def max_merge(*lists: DataFrame) -> DataFrame:
    """Union of scored lists (query_id, doc, score), the best score of each pair."""
    every = lists[0].select("query_id", "doc", "score")
    for more in lists[1:]:
        every = every.unionByName(more.select("query_id", "doc", "score"))
    return every.groupBy("query_id", "doc").agg(F.max("score").alias("score"))


def rrf(*lists: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of lists (query_id, doc, rank)."""
    every = lists[0].select("query_id", "doc", "rank")
    for more in lists[1:]:
        every = every.unionByName(more.select("query_id", "doc", "rank"))
    fused = every.groupBy("query_id", "doc").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 6).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of arrays of doubles; NULL where a norm is 0."""
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return dot / F.nullif(norm(left) * norm(right), F.lit(0.0))


def best_in_tile(k: int):
    """For cogroups of queries (query_id, asked) and vectors (vec_id, own): the k best vectors of each query by cosine rounded to 6 digits, then id; vectors of another length, of norm 0 or with the query's id don't count."""

    def run(asks, rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out: dict = {"query_id": [], "vec_id": [], "score": []}
        sizes = [pc.list_value_length(t.column(c)).to_numpy() for t, c in ((asks, "asked"), (rows, "own"))]
        for n in np.intersect1d(*sizes):
            (q, asked), (v, own) = ((t.column(i).to_numpy()[at], pc.list_flatten(t.column(c).take(pa.array(at))).to_numpy().astype("f8").reshape(len(at), n)) for t, i, c, at in ((asks, "query_id", "asked", np.flatnonzero(sizes[0] == n)), (rows, "vec_id", "own", np.flatnonzero(sizes[1] == n))))
            with np.errstate(invalid="ignore"):
                left, right = (np.sqrt((x * x).sum(1)) for x in (asked, own))
            for i, query in enumerate(q):
                if i % QUERIES_AT_ONCE == 0:
                    some = slice(i, i + QUERIES_AT_ONCE)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        score = np.round(asked[some] @ own.T / (left[some, None] * right[None]), 6)
                mine = score[i % QUERIES_AT_ONCE]
                good = np.flatnonzero(np.isfinite(mine) & (v != query))
                if len(good) > k:
                    good = good[mine[good] >= np.partition(mine[good], len(good) - k)[len(good) - k]]
                top = good[np.lexsort((v[good], -mine[good]))[:k]]
                out["query_id"] += [int(query)] * len(top)
                out["vec_id"] += v[top].tolist()
                out["score"] += mine[top].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


BEST = "query_id long, vec_id long, score double"
QUERIES_PER_TILE, VECTORS_PER_TILE = 2048, 16_384
#: Queries whose scores with all vectors of a tile a task holds at once.
QUERIES_AT_ONCE = 64


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """queries (query_id, embedding) against all vectors (vec_id, embedding), exact, a query never with itself.

    Queries and vectors are dealt to blocks and tiles by hash, and meet in one
    task for each pair of these, so neither set is held by the driver or any task;
    k rows for each query and tile are shuffled. NULL vectors take no part, k below 1 gives nothing.
    """
    asks = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("asked"))
    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("own"))
    blocks, tiles = (max(1, -(-df.count() // most)) for df, most in ((asks, QUERIES_PER_TILE), (rows, VECTORS_PER_TILE)))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asks.withColumn("block", mine("query_id", blocks)).withColumn("tile", every(tiles))
    right = rows.withColumn("tile", mine("vec_id", tiles)).withColumn("block", every(blocks))
    found = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(best_in_tile(max(k, 0)), BEST) if k > 0 else left.sparkSession.createDataFrame([], BEST)
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


def mmr(ranked: DataFrame, weight: float = 0.7) -> DataFrame:
    """Greedy rerank of each query's short list (query_id, doc, score, text): score against word overlap with what was taken."""

    def one(rows):
        import pyarrow as pa

        left = sorted(zip(rows.column("doc").to_pylist(), rows.column("score").to_pylist(), [set((t or "").lower().split()) for t in rows.column("text").to_pylist()], strict=True))
        left.sort(key=lambda r: -r[1])
        taken: list = []
        overlap = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        while left:
            values = [weight * s - (1 - weight) * max((overlap(w, x[2]) for x in taken), default=0.0) for _, s, w in left]
            taken.append(left.pop(values.index(max(values))))
        query = rows.column("query_id")[0].as_py()
        return pa.table({"query_id": [query] * len(taken), "doc": [t[0] for t in taken], "rank": list(range(1, len(taken) + 1))})

    return ranked.select("query_id", "doc", "score", "text").groupBy("query_id").applyInArrow(one, "query_id long, doc long, rank long")


def doc_expansion(hits: DataFrame, chunks: DataFrame, per_doc: int = 3) -> DataFrame:
    """Chunks (doc, chunk_index, kind) of each hit's document, infoboxes first, per_doc at most."""
    first = hits.groupBy("query_id", "doc").agg(F.min("rank").alias("doc_rank"))
    joined = first.join(chunks, "doc")
    return top_k(joined, ["query_id", "doc"], [(F.col("kind") != "infobox").asc(), F.asc("chunk_index")], per_doc).withColumnRenamed("rank", "chunk_rank")


def jaccard(left: Column, right: Column) -> Column:
    """Of arrays as sets; 0 where either is empty."""
    union = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.size(F.array_intersect(left, right)) / union)
