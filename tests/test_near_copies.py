"""Groups of near copies: few of their pairs are dealt to chunks, and their largest component isn't sent for itself."""

import random

from pyspark.sql import functions as F

from lodestar.llm import jaccard


def test_few_pairs_of_near_copies_meet_by_chunks(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice("xyz") + str(i) if i in rng_edits else w for i, w in enumerate(base)) for rng_edits in ([set(rng.sample(range(200), 2)) for _ in range(150)])]
    texts += [" ".join(f"v{n}-{i}" for i in range(60)) for n in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen = {}
    known, dealt = jaccard._first_links, jaccard._pair_links
    monkeypatch.setattr(jaccard, "_first_links", lambda pairs, sets: seen.update(all=pairs.count()) or known(pairs, sets))
    monkeypatch.setattr(jaccard, "_pair_links", lambda pairs, nodes, sets: seen.update(dealt=pairs.count()) or dealt(pairs, nodes, sets))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_join(docs).collect()}
    assert seen["dealt"] * 4 < seen["all"]

    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    least = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(shingles[a] & shingles[b]) >= 75 * len(shingles[a] | shingles[b]):
                x, y = sorted((least[a], least[b]))
                least = [x if v == y else v for v in least]
    assert got == dict(enumerate(least))


def test_blocks_send_the_largest_component_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHINGLES_PER_CHUNK", 10)
    name = lambda i: F.encode(F.lpad(i.cast("string"), 16, "0"), "utf-8")
    rows = spark.range(104).select(name(F.col("id")).alias("node"), F.encode(F.lit("c"), "utf-8").alias("cluster"), F.when(F.col("id") < 100, F.encode(F.lit("g"), "utf-8")).otherwise(name(F.col("id"))).alias("component"), "id")
    nodes = rows.select("node", F.lit(2).cast("long").alias("n"))
    sent = jaccard._blocks(rows.select("node", "cluster", "component"), nodes, 104).join(rows.select("node", "id"), "node").collect()
    assert sum(r["id"] < 100 for r in sent) == 100
    blocks: dict = {}
    for r in sent:
        blocks.setdefault((r["x"], r["y"]), []).append((r["id"], r["side"]))
    met = {frozenset((i, j)) for (x, y), own in blocks.items() for i, s in own for j, t in own if i != j and (x == y or s != t)}
    assert met >= {frozenset((i, j)) for i in range(100, 104) for j in range(104) if i != j}
