"""BM25 and passages over documents that share their words: what is written, repeated ids, several passes."""

import os

from pyspark.sql import functions as F

from lodestar.operators import retrieval


def on_disk(spark) -> int:
    """Bytes of shuffles and scratch tables."""
    folders = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders.append(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    return sum(os.path.getsize(os.path.join(root, f)) for folder in folders for root, _, files in os.walk(folder) for f in files)


def test_no_row_for_each_document_and_query(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.array_join(F.shuffle(F.array(*map(F.lit, words)), seed=F.lit(1)), " ").alias("text"))
    queries = spark.range(100).select(F.col("id").alias("query_id"), F.lit(" ".join(words)).alias("text"))
    before = on_disk(spark)
    assert retrieval.bm25(docs, queries, 3).count() == 300
    # 4000 documents of 60 words, but 400,000 pairs with a query and 24 million of their terms
    assert on_disk(spark) - before < 1_000_000


def test_rows_of_one_document_add_up(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a b c"), (2, "a x"), (3, None), (None, "a a")], "doc_id long, text string")
    queries = spark.createDataFrame([("q", "a A b"), ("r", "zz"), (None, "x")], "query_id string, text string")
    rows = {(r["query_id"], r["doc"]): (r["score"], r["rank"]) for r in retrieval.bm25(docs, queries, 9).collect()}
    import duckdb

    from lodestar.queries.catalog import bm25_sql

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'a b'), (1, 'a b'), (1, 'a b c'), (2, 'a x'), (3, NULL), (NULL, 'a a')) t(doc_id, text)")
    con.execute("CREATE TABLE q AS SELECT * FROM (VALUES ('q', 'a A b'), ('r', 'zz'), (NULL, 'x')) t(query_id, text)")
    want = con.execute("WITH " + bm25_sql("r", "SELECT query_id, text FROM q", 9) + " SELECT query_id, doc, score, rank FROM r").fetchall()
    assert rows == {(q, d): (s, n) for q, d, s, n in want}


def test_passes_give_what_one_gives(spark, monkeypatch):
    docs = spark.range(50).select(F.col("id").cast("string").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.concat(F.lit("b"), F.col("id") % 7), F.concat(F.lit("c"), F.col("id") % 3)).alias("text"))
    queries = spark.range(9).select(F.col("id").alias("query_id"), F.concat_ws(" ", F.lit("a"), F.concat(F.lit("b"), F.col("id")), F.lit("c1")).alias("text"))
    one = sorted(retrieval.bm25(docs, queries, 5).collect())
    monkeypatch.setattr(retrieval, "QUERIES_PER_PASS", 4)
    assert sorted(retrieval.bm25(docs, queries, 5).collect()) == one and len(one) == 45
    assert retrieval.bm25(docs.limit(0), queries, 5).count() == retrieval.bm25(docs, queries.limit(0), 5).count() == 0


def test_passages_shuffle_no_text(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.range(4000).select(F.col("id").alias("doc"), F.array_join(F.shuffle(F.array(*map(F.lit, words)), seed=F.lit(1)), " ").alias("text")).localCheckpoint()
    passages = docs.where("doc % 40 = 0").select(F.col("doc").alias("query_id"), F.substring("text", 20, 80).alias("passage"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = on_disk(spark)
        assert {(r["doc"], r["query_id"]) for r in retrieval.holders(docs, passages).collect()} >= {(i, i) for i in range(0, 4000, 40)}
        # 4000 documents have 224,000 runs of words
        assert on_disk(spark) - before < 200_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_passages_row_by_row(spark, monkeypatch):
    texts = ["one two three four five six seven eight nine", "one two three four five six seven eight nine", "a one two three four five six seven eight nine two three four five six seven", "short", "", None]
    asked = ["ne two three four five six seven e", "ne two three four five six seven z", "hort", "", "two three four five six seven eight nine", None]
    docs = spark.createDataFrame([*[(i // 2, t) for i, t in enumerate(texts)], (None, texts[0])], "doc long, text string")
    passages = spark.createDataFrame([*[(i // 2, t) for i, t in enumerate(asked)], (7, asked[0]), (7, asked[0])], "query_id long, passage string")
    order = lambda rows: sorted(rows, key=str)
    want = order((d.doc, p.query_id) for d in docs.collect() for p in passages.collect() if None not in (d.text, p.passage) and p.passage in d.text)
    for most in (10_000, 2):
        monkeypatch.setattr(retrieval, "PASSAGES_PER_PASS", most)
        assert order(tuple(r) for r in retrieval.holders(docs, passages).collect()) == want
    assert retrieval.holders(docs, passages.limit(0)).count() == retrieval.holders(docs.limit(0), passages).count() == 0


def test_recall_of_repeated_ids_as_in_sql(spark, tmp_path):
    texts = [(1, "x p q r y"), (1, "z p q r y"), *[(i, "p q r" + " more" * i) for i in range(2, 9)], (None, "a p q r"), (None, None), (9, "none")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "p q r"), (1, "none"), (2, "absent")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    import duckdb

    from lodestar.registry import oracle_sql, queries
    from tests.conftest import same_rows

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("set_recall", "recall_at_k", "gold_join"):
        same_rows(queries()[name](spark, str(tmp_path)), con.execute(oracle_sql()[name]))
