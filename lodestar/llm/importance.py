"""Target-distribution importance resampling.

Each task hands its texts to DuckDB: SQL unnests their words, windows them to
n-grams and hashes these by a registered zlib CRC function. The counts of each
text's buckets are written to Parquet once. Spark merges them to the corpus's
and the target's distributions, turns these into a gain for each bucket, scores
every text from its own counts, and draws the highest scores by a sort over
ranges whose places are the ranks.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, scratch_path, stash, table

BUCKETS = 10_000
ORDER = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
# A word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The letters that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One SQL statement takes texts up to about so many characters, longer ones in pieces.
TOGETHER = 2_000_000

COUNTED = "n_words long, n_features long, buckets array<int>, counts array<long>"
#: Runs of 1 to {order} words that end after the words which a piece repeats of the one before.
COUNT_SQL = """
WITH words AS (
  SELECT doc, skip, unnest(regexp_extract_all(translate(piece, '{upper}', '{lower}'), '{word}')) AS word,
         generate_subscripts(regexp_extract_all(translate(piece, '{upper}', '{lower}'), '{word}'), 1) AS place
  FROM pieces
), runs AS ({runs}),
counted AS (SELECT doc, gram, count(*) AS n FROM runs GROUP BY doc, gram),
hashed AS (SELECT gram, crc(gram) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM counted))
SELECT doc, bucket::INTEGER AS bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (gram) GROUP BY doc, bucket ORDER BY doc, bucket
"""


def _count_sql(order: int, buckets: int) -> str:
    # words don't hold spaces, so a run of k words that runs past its text's end is NULL and left out
    of = lambda k: "word" + "".join(f" || ' ' || lead(word, {i}) OVER w" for i in range(1, k))
    runs = " UNION ALL ".join(f"SELECT doc, gram FROM (SELECT doc, place, skip, {of(k)} AS gram FROM words WINDOW w AS (PARTITION BY doc ORDER BY place)) WHERE gram IS NOT NULL AND place + {k - 1} > skip" if k > 1 else "SELECT doc, word AS gram FROM words WHERE place > skip" for k in range(1, order + 1))
    return COUNT_SQL.format(upper=UPPER, lower=LOWER, word=WORD, runs=runs, buckets=buckets)


def _pieces(text: str, pattern, order: int, size: int):
    """(piece, words that it repeats from the one before, words of its own): pieces end where no word goes on."""
    at, tail = 0, []
    while True:
        stop = at + size
        if stop >= len(text):
            stop = len(text)
        else:
            goes_on = pattern.match(text, stop)
            stop = goes_on.end() if goes_on and pattern.match(text, stop - 1) else stop
        piece = text[at:stop]
        words = sum(1 for _ in pattern.finditer(piece))
        yield " ".join([*tail, piece]) if tail else piece, len(tail), words
        if stop >= len(text):
            return
        if order > 1:
            tail = (tail + [m[0] for m in pattern.finditer(piece)])[1 - order :]
        at = stop


def _counter(order: int, buckets: int, together: int):
    """A function for mapInArrow: the columns but for text, and COUNTED."""

    def run(batches):
        import re

        import duckdb
        import numpy as np
        import pyarrow as pa

        pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # of the text as it is, so A-Z belong to it
        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        con.create_function("crc", lambda grams: pa.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) for g in grams.to_pylist()], pa.int64()), ["VARCHAR"], "BIGINT", type="arrow")
        sql = _count_sql(order, buckets)

        def counted(pieces: list) -> list:
            """For each piece its buckets and their counts."""
            con.register("pieces", pa.table({"doc": pa.array(range(len(pieces)), pa.int32()), "piece": [p[0] for p in pieces], "skip": pa.array([p[1] for p in pieces], pa.int32())}))
            got = con.execute(sql).fetchnumpy()
            con.unregister("pieces")
            cuts = np.searchsorted(got["doc"], np.arange(1, len(pieces)))
            return list(zip(np.split(got["bucket"], cuts), np.split(got["n"], cuts), strict=True))

        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sums: list = [(0, None, None)] * batch.num_rows
            waiting, size = [], 0

            def flush():
                if not waiting:
                    return
                for (row, piece), (own, n) in zip(waiting, counted([p for _, p in waiting]), strict=True):
                    words, before, n_before = sums[row]
                    if before is not None:
                        own, inverse = np.unique(np.concatenate([before, own]), return_inverse=True)
                        n = np.bincount(inverse, np.concatenate([n_before, n])).astype("i8")
                    sums[row] = (words + piece[2], own, n)
                waiting.clear()

            for row, text in enumerate(texts):
                for piece in _pieces(text.as_py() or "", pattern, order, together):
                    waiting.append((row, piece))
                    size += len(piece[0])
                    if size >= together:
                        flush()
                        size = 0
            flush()
            lists = [[s[i] for s in sums] for i in (1, 2)]
            ends = np.cumsum([0, *(len(x) for x in lists[0])]).astype("i4")
            flat = [np.concatenate(x) if x else np.empty(0, "i8") for x in lists]
            columns = [pa.array([s[0] for s in sums], pa.int64()), pa.array([int(s[2].sum()) for s in sums], pa.int64())]
            columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(v, kind)) for v, kind in zip(flat, (pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "n_words", "n_features", "buckets", "counts"])

    return run


def bucket_counts(texts: DataFrame, id_column: str | None = "doc_id", order: int = ORDER, buckets: int = BUCKETS, together: int = TOGETHER) -> DataFrame:
    """One row per row of texts, written to Parquet: doc_id, n_words, n_features, buckets and counts (arrays, by bucket).

    Features are all runs of 1 to `order` consecutive words joined by a space,
    repeats counted. NULL text has none. Texts are read whole; repeated rows and
    NULL ids pass; other columns are ignored; an empty table gives an empty one.
    """
    named = (F.col(id_column) if id_column else F.lit(None)).cast("long").alias("doc_id")
    return stash(texts.select(named, "text").mapInArrow(_counter(order, buckets, together), f"doc_id long, {COUNTED}"), "importance-counts")


def distribution(counted: DataFrame) -> DataFrame:
    """bucket, n: at most one row per bucket, summed in every task before the shuffle."""
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket: floor of 1000 times the log of its smoothed share of the target over that of the corpus. As many numbers as buckets, whatever the tables' sizes."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    both = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in "st"])
    totals = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")).head()
    d = lambda c: c.cast("double")
    ratio = d(F.col("t") + 1) * d(F.lit(totals["all_s"] + buckets)) / (d(F.col("s") + 1) * d(F.lit(totals["all_t"] + buckets)))
    return [r["gain"] for r in every.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).orderBy("bucket").collect()]


def scored(counted: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score. The gains are one constant of the plan; texts without features weigh 0; a NULL doc_id has a NULL score."""
    table_of = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(F.arrays_zip("buckets", "counts"), F.lit(0).cast("long"), lambda s, p: s + F.get(table_of, p["buckets"]) * p["counts"])
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(__total - pmod(__total, n_features)) div n_features"))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / F.lit(4294967296.0)))).cast("long")
    return counted.withColumn("__total", total).select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))


def drawn(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """rows with rank: of the N with at least least_words words and a score, the floor(percent * N / 100) highest scores, ties to the smaller doc_id, have 1, 2, 3 and so on; NULL elsewhere.

    Rows are dealt to ranges and written in order. A row's place in its part and
    the sizes of the parts before it, of which there are as many as tasks, give
    its rank; no task sorts more than its range. Rows that repeat an id and a score take ranks in any order.
    """
    spark = rows.sparkSession
    fit = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    order = [F.desc("__fit"), F.desc("score"), F.asc("doc_id")]
    path = scratch_path(spark, "importance-order")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__fit", fit).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    dealt.write.parquet(path)
    kept = spark.read.schema(dealt.schema).parquet(path)
    sizes = sorted((r["__part"], r["n"], r["fit"]) for r in kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__fit").cast("int")).alias("fit")).collect())
    take, before, firsts = percent * sum(s[2] for s in sizes) // 100, 0, {}
    for part, n, _ in sizes:
        firsts[part], before = before, before + n
    first = spark.createDataFrame(list(firsts.items()), "__part int, __first long")
    place = kept.metadataColumn("_metadata")["row_index"]
    ranked = kept.withColumn("__row", place).join(F.broadcast(first), "__part", "left")
    rank = F.col("__first") + F.col("__row") + 1
    return ranked.select(*rows.columns, F.when(F.col("__fit") & (rank <= take), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_features, weight, score, rank, drawn towards the texts of target (text).

    NULL texts have no words. Repeated rows count, are scored and may be drawn
    each. A NULL doc_id has no draw of its own: its score and rank are NULL and
    it isn't one of the N. Ties go to the smaller doc_id. Other columns of both
    tables are ignored; an empty table gives an empty result, an empty target
    gains that depend on the corpus alone.
    """
    counted, aim = bucket_counts(docs, order=order, buckets=buckets), bucket_counts(target, None, order, buckets)
    gain = gains(distribution(counted), distribution(aim), buckets)
    discard(aim)
    return drawn(scored(counted, gain, seed), least_words, percent)


def op11_importance(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, drawn towards those of benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), words AS (
  SELECT 'd' AS kind, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INTEGER, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) % 256) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)), crc_table
), per_doc AS (
  SELECT doc_id, bucket, count(*) AS n FROM words JOIN hashed USING (word) WHERE kind = 'd' GROUP BY ALL
), sums AS (
  SELECT bucket, sum(n)::BIGINT AS s, (SELECT count(*) FROM words w JOIN hashed h USING (word) WHERE w.kind = 'b' AND h.bucket = p.bucket) AS t FROM per_doc p GROUP BY bucket
), totals AS (
  SELECT (SELECT count(*) FROM words WHERE kind = 'd') AS all_s, (SELECT count(*) FROM words WHERE kind = 'b') AS all_t
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, totals
), weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM per_doc JOIN gain USING (bucket) GROUP BY doc_id
), scores AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features,
         coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h
  FROM documents d LEFT JOIN weighed USING (doc_id)
), full_scores AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scores
), ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM full_scores WHERE n_features >= 20
)
SELECT f.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM full_scores f LEFT JOIN ranks USING (doc_id)
"""
