"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, sparing_stream, stash


def _forest(batches):
    """Links of one task to stars: every node with the smallest node that the task's links connect it to."""
    import pyarrow as pa

    parent: dict = {}

    def root(x):
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    kind = None
    for batch in batches:
        kind = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if kind is not None:
        stars = [(x, root(x)) for x in parent]
        stars = [s for s in stars if s[0] != s[1]]
        for at in range(0, len(stars), 50_000):
            some = stars[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in some], kind.field(i).type) for i in (0, 1)], schema=pa.schema([pa.field("a", kind.field(0).type), pa.field("b", kind.field(1).type)]))


#: A round's tables are written by a task for so many of their rows at most, so that short ones aren't hundreds of tiny files.
ROWS_PER_TASK = 50_000


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b), both of one type that has an order.

    Each task first reduces its links to stars; then large-star and small-star
    steps alternate until the stars don't change. Minima are aggregated before
    the shuffle. Links are joined with one row per node, so the neighbours of a
    hub over the size at which adaptive execution splits a partition are dealt
    to several tasks, each with a copy of that row. Links of a node with itself, repeated links
    and NULL ends add nothing.
    """
    kind = links.schema["a"].dataType.simpleString()
    links = links.where("a is not null and b is not null and a != b").select("a", "b")
    stars = stash(links.mapInArrow(sparing_stream(_forest), f"a {kind}, b {kind}"), "stars")
    state = _state(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(_key(), F.least("a", "m").alias("m"))
        large = both.withColumn("k", _key()).join(least, "k").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        tasks = max(1, -(-2 * state[0] // ROWS_PER_TASK))
        large = stash(large.coalesce(tasks), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.withColumn("k", _key()).join(low.select(_key(), "m"), "k").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, stars = stars, stash(low.select("a", F.col("m").alias("b")).unionByName(small).distinct().coalesce(tasks), "small-star")
        discard(last, large)
        before, state = state, _state(stars)
        if state == before:
            break
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    out._scratch = stars._scratch
    return out


def _key():
    """a in a struct: the minima are shuffled once more for the join, and adaptive execution splits only partitions that come from a shuffle."""
    return F.struct("a").alias("k")


def _state(stars: DataFrame) -> tuple:
    row = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).head()
    return tuple(row)
