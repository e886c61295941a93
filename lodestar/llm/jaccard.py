"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

Documents with equal shingle sets are one node. The rarest shingles of a set
come first in one order for the whole corpus; two sets that link must share a
shingle among the first of either, as many as their sizes leave (the prefix
bound), so nodes meet in the tile of such a shingle. Within a tile nodes stand
by size and only sizes within the threshold's band are paired. A bitmap of the
hashed set bounds the intersection of a pair from above; pairs that it can't
refuse are settled by intersecting the sorted arrays.

Only connectivity is asked for. A tile with many nodes pairs each with those at
distances 1, 2, 4, ... first. Of the pairs, FIRST_PAIRS of each node are settled
first, and only those that these links leave apart are dealt to chunk pairs, so
that arrays aren't sent once for each chunk that a group of near copies fills.
After these links are verified, long tiles that still hold several components
are joined into clusters, and all pairs of different components in a cluster are
tried, block by block, where the arrays are: no pair leaves a task but as a
link, and pairs that links connect already are skipped. The largest component of
a cluster meets the others only, not itself. So no link between components is
lost, and groups of near copies cost no square of their size in rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import TRIM_FROM, columns_of, discard, free_name, groups_for, let_go, located, lookup, sparing, sparing_stream, stash, table, trim
from lodestar.llm.components import components

#: The threshold as a ratio: 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 3, 4
#: Buckets of the table of shingle counts; fixed, so that its broadcast is 4 MB whatever the corpus.
FREQUENCY_BITS = 20
FREQUENCY_SLICE_BITS = 14
KEYS_PER_TILE_TASK = 500_000
SHINGLES_PER_CHUNK = 1_000_000
PAIRS_PER_CHUNK = 250
#: Pairs of each node that are settled before all others; two random ones connect most of what links.
FIRST_PAIRS = 2
#: A shingle (hashed to FREQUENCY_BITS) that so many documents have is dealt to several tasks, by node.
HOT_SHINGLE = 100_000
ALL_PAIRS_UP_TO = 64
FLUSH_KEYS = 1_000_000
LEAST_BITS, MOST_BITS = 64, 1 << 16


def needed(a, b):
    """The smallest intersection with which sets of sizes a and b link: i / (a + b - i) >= 3 / 4."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def probe_prefix(n):
    """How many of the first shingles of a set of size n must hold one that a set it links with shares."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def bitmap(own) -> bytes:
    """A bit for each hashed element; the width is a power of two, at least the size of the set up to MOST_BITS."""
    import numpy as np

    width = min(MOST_BITS, max(LEAST_BITS, 1 << (len(own) - 1).bit_length()))
    flags = np.zeros(width, bool)
    flags[own & np.uint64(width - 1)] = True
    return np.packbits(flags).tobytes()


def most_common(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """An upper bound of the intersection: an element whose bit the other lacks isn't shared, and each such bit has one at least."""
    import numpy as np

    a, b = np.frombuffer(bits_a, "u1"), np.frombuffer(bits_b, "u1")
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def _sets(ids, texts):
    from lodestar.llm.shingles import shingle_sets

    return zip(ids, shingle_sets([t or "" for t in texts]), strict=True)


def _signatures(batches):
    """Kind 0: doc_id, locator, n, node and bitmap of each document. Kind 1: slices of the task's table of shingle counts."""
    import numpy as np
    import pyarrow as pa

    from lodestar.llm.shingles import set_digest

    place = pa.struct([("file", pa.string()), ("row", pa.int64())])
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("locator", place), ("n", pa.int64()), ("node", pa.binary()), ("bits", pa.binary())])
    let_go()
    counts = np.zeros(1 << FREQUENCY_BITS, "u4")
    for batch in batches:
        out = {"kind": [], "n": [], "node": [], "bits": []}
        for _, own in _sets(range(batch.num_rows), batch.column(1).to_pylist()):
            np.add.at(counts, own & np.uint64(len(counts) - 1), np.uint32(1))
            row = (0, len(own), set_digest(own) if len(own) else None, bitmap(own) if len(own) else None)
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out | {"doc_id": batch.column(0), "locator": batch.column(2).cast(place)}, schema=schema)
    step = 1 << FREQUENCY_SLICE_BITS
    slices = [i for i in range(len(counts) // step) if counts[i * step : (i + 1) * step].any()]
    if slices:
        yield pa.RecordBatch.from_pydict({"kind": [1] * len(slices), "doc_id": slices, "locator": [None] * len(slices), "n": [0] * len(slices), "node": [None] * len(slices), "bits": [counts[i * step : (i + 1) * step].tobytes() for i in slices]}, schema=schema)


def _add_slices(rows):
    import numpy as np
    import pyarrow as pa

    total = np.zeros(1 << FREQUENCY_SLICE_BITS, "u8")
    for raw in rows.column("bits"):
        total += np.frombuffer(raw.as_py(), "u4")
    return pa.table({"slice": rows.column("doc_id")[:1], "counts": [np.minimum(total, 2**32 - 1).astype("u4").tobytes()]})


def _frequencies(slices: DataFrame):
    """The corpus's counts of hashed shingles: 2**FREQUENCY_BITS numbers, over all documents."""
    import numpy as np

    out = np.zeros(1 << FREQUENCY_BITS, "u4")
    step = 1 << FREQUENCY_SLICE_BITS
    summed = slices.select("doc_id", "bits").groupBy("doc_id").applyInArrow(_add_slices, "slice long, counts binary")
    for row in summed.collect():
        out[row["slice"] * step : (row["slice"] + 1) * step] = np.frombuffer(row["counts"], "u4")
    return out


def _hot_buckets(frequencies) -> int:
    """How many buckets the shingles that very many documents have are dealt to."""
    return groups_for(int(frequencies[frequencies >= HOT_SHINGLE].sum(dtype="u8")), KEYS_PER_TILE_TASK, 0)


def _keys(docs: DataFrame, frequencies, buckets: int) -> DataFrame:
    """Prefix shingles of all nodes, dealt to buckets: rows of packed arrays, one for each bucket and flush of a task.

    The bucket is that of the shingle, or, for shingles that very many documents have, one from `buckets` on that the node's name chooses.
    """
    hot, hot_from = _hot_buckets(frequencies), HOT_SHINGLE
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from lodestar.llm.shingles import set_digest

        let_go()
        counts = shared.value
        mask = np.uint64(len(counts) - 1)
        nodes, sizes, keys, refs, places, held = {}, [], [], [], [], 0

        def flush():
            every, ref, place = np.concatenate(keys), np.concatenate(refs), np.concatenate(places)
            bucket = ((every & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype("i8")
            names, size = np.frombuffer(b"".join(nodes), "V16"), np.array(sizes, "u4")
            if hot:
                often = counts[every & mask] >= hot_from
                chosen = np.frombuffer(b"".join(nodes), "<u8")[::2] % np.uint64(hot)
                bucket = np.where(often, buckets + chosen[ref].astype("i8"), bucket)
            order = np.argsort(bucket, kind="stable")
            every, ref, place, bucket = every[order], ref[order], place[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            out = {"bucket": [], "nodes": [], "sizes": [], "keys": [], "refs": [], "places": []}
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                part = slice(start, stop)
                used, local = np.unique(ref[part], return_inverse=True)
                values = (int(bucket[start]), names[used].tobytes(), size[used].tobytes(), every[part].tobytes(), local.astype("u4").tobytes(), place[part].tobytes())
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32())] + [(n, pa.binary()) for n in ("nodes", "sizes", "keys", "refs", "places")]))

        for batch in batches:
            for _, own in _sets(range(batch.num_rows), batch.column(0).to_pylist()):
                n = len(own)
                if not n or (name := set_digest(own)) in nodes:
                    continue
                ref = nodes[name] = len(sizes)
                sizes.append(n)
                rank = (counts[own & mask].astype("u8") << np.uint64(32)) | (own >> np.uint64(32))
                first = own[np.argsort(rank, kind="stable")[: probe_prefix(n)]]
                keys.append(first)
                refs.append(np.full(len(first), ref, "i8"))
                places.append(np.minimum(np.arange(len(first)), 65535).astype("u2"))
                held += len(first)
                if held >= FLUSH_KEYS:
                    yield flush()
                    nodes, sizes, keys, refs, places, held = {}, [], [], [], [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(sparing_stream(run), "bucket int, nodes binary, sizes binary, keys binary, refs binary, places binary")


def _tiles(buckets: int):
    short = ALL_PAIRS_UP_TO
    return sparing(lambda rows: _tiles_of(rows, rows.column("bucket")[0].as_py() >= buckets, short))


def _tiles_of(rows, hot: bool, short: int):
    """Kind 0: candidate pairs (a, b) of the tiles of a bucket. Kind 1: members of tiles whose pairs are not all listed: here, or, of hot shingles, in other buckets."""
    import numpy as np
    import pyarrow as pa

    pair = np.dtype([("x", "<u8"), ("y", "<u8")])
    col = {n: [r.as_py() for r in rows.column(n)] for n in ("nodes", "sizes", "keys", "refs", "places")}
    names = np.frombuffer(b"".join(col["nodes"]), pair)
    sizes = np.frombuffer(b"".join(col["sizes"]), "u4").astype("i8")
    shift = np.cumsum([0, *(len(x) // 16 for x in col["nodes"])])[:-1]
    keys = np.frombuffer(b"".join(col["keys"]), "u8")
    refs = np.concatenate([np.frombuffer(x, "u4").astype("i8") + first for x, first in zip(col["refs"], shift, strict=True)])
    place = np.frombuffer(b"".join(col["places"]), "u2").astype("i8")
    names, first, local = np.unique(names, return_index=True, return_inverse=True)
    sizes = sizes[first]
    node = local[refs]
    order = np.lexsort((place, node, sizes[node], keys))
    keys, node, place = keys[order], node[order], place[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (node[1:] != node[:-1])
    keys, node, place = keys[fresh], node[fresh], place[fresh]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(np.append(edge, len(keys)))
    shared = (np.repeat(length, length) > 1) | hot
    rest = np.repeat(edge + length, length)[shared] - 1 - np.flatnonzero(shared)  # how many of the tile stand after it
    run, keys, node, place = np.repeat(np.arange(len(edge)), length)[shared], keys[shared], node[shared], place[shared]
    size, far = sizes[node], (length[run] > short) | hot
    pairs, distance, alive = [], 1, np.arange(len(run))
    while True:
        alive = alive[rest[alive] >= distance]
        if distance & (distance - 1):  # distances other than powers of two are for short tiles only
            here = alive[~far[alive]]
        else:
            here = alive
        if not len(alive):
            break
        there = here + distance
        least = needed(size[here], size[there])
        # if this is the first shingle in common, all before it are not
        hit = here[(place[here] + least <= size[here]) & (place[there] + least <= size[there])]
        a, b = node[hit], node[hit + distance]
        pairs.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
        distance = distance + 1 if distance < short else distance * 2
    code = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, "i8")
    code = code[code // max(1, len(names)) != code % max(1, len(names))]
    raw = names.view("V16")
    schema = pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("tile", pa.int64())])

    def as_binary(which):
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(which), [None, pa.py_buffer(raw[which].tobytes())]).cast(pa.binary())

    tables = []
    if len(code):
        tables.append(pa.Table.from_arrays([pa.array(np.zeros(len(code), "i4")), as_binary(code // len(names)), as_binary(code % len(names)), pa.nulls(len(code), pa.int64())], schema=schema))
    if far.any():
        # tiles with the same members are listed once; those of hot shingles may have others elsewhere
        members, runs, tile = node[far], run[far], keys[far]
        cuts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1], [True]]))
        seen, keep = set(), np.zeros(len(members), bool)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = members[a:b].tobytes()
            if hot or own not in seen:
                seen.add(own)
                keep[a:b] = True
        members, tile = members[keep], tile[keep].view("i8")
        tables.append(pa.Table.from_arrays([pa.array(np.ones(len(members), "i4")), as_binary(members), pa.nulls(len(members), pa.binary()), pa.array(tile)], schema=schema))
    return pa.concat_tables(tables) if tables else schema.empty_table()


def _refuse_by_bits(batches):
    import pyarrow as pa

    for batch in batches:
        c = {n: batch.column(i).to_pylist() for i, n in enumerate(("n_a", "bits_a", "n_b", "bits_b"), 2)}
        keep = [most_common(*x) >= needed(x[0], x[2]) for x in zip(*c.values(), strict=True)]
        yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(keep, pa.bool_()))


def _settle(pairs, sets):
    """Exact links among the pairs of a tile; pairs that its links connect already aren't computed."""
    import numpy as np
    import pyarrow as pa

    arrays = {n: np.frombuffer(s, "u8") for n, s in zip(sets.column("node").to_pylist(), sets.column("own").to_pylist(), strict=True)}
    parent = {n: n for n in arrays}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for a, b in sorted(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)):
        x, y = arrays[a], arrays[b]
        if root(a) != root(b) and len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x), len(y)):
            parent[root(a)] = root(b)
            links.append((a, b))
    return pa.table({"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())})


def _settled(pairs, sets):
    out = _settle(pairs, sets)
    if sets.nbytes > TRIM_FROM:
        trim()
    return out


def _linked(batches):
    """Of pairs (a, b) with their arrays those that link."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        x, y = ([np.frombuffer(r.as_buffer(), "u8") for r in batch.column(i)] for i in (2, 3))
        keep = [len(np.intersect1d(u, v, assume_unique=True)) >= needed(len(u), len(v)) for u, v in zip(x, y, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _arrays(batches):
    import pyarrow as pa

    from lodestar.llm.shingles import set_digest

    for batch in batches:
        # a doc_id may stand on rows with other texts too
        owns = [(node, own.tobytes()) for node, own in _sets(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if set_digest(own) == node]
        yield pa.RecordBatch.from_pydict({"node": [o[0] for o in owns], "own": [o[1] for o in owns]}, schema=pa.schema([("node", pa.binary()), ("own", pa.binary())]))


def _join_block(rows):
    """Links between components among the nodes of a block, or of two: bitmaps first, then, most promising first, the arrays."""
    import numpy as np
    import pyarrow as pa

    nodes, sizes = rows.column("node").to_pylist(), rows.column("n").to_numpy()
    arrays = [np.frombuffer(r, "u8") for r in rows.column("own").to_pylist()]
    side, diagonal = rows.column("side").to_numpy(), rows.column("x")[0].as_py() == rows.column("y")[0].as_py()
    _, label = np.unique(np.array([c.hex() for c in rows.column("component").to_pylist()]), return_inverse=True)
    width = min(MOST_BITS, max(LEAST_BITS, 1 << int(4 * np.median(sizes)).bit_length()))
    bits = np.zeros((len(nodes), width // 64), "u8")
    for i, own in enumerate(arrays):
        flags = np.zeros(width, bool)
        flags[own & np.uint64(width - 1)] = True
        bits[i] = np.packbits(flags).view("u8")
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    links = []
    rare = np.bincount(label)
    for i in sorted(range(len(nodes)), key=lambda k: (rare[label[k]], nodes[k])):
        low = np.searchsorted(ordered, -(-NUMERATOR * sizes[i] // DENOMINATOR))
        high = np.searchsorted(ordered, DENOMINATOR * sizes[i] // NUMERATOR, "right")
        others = order[low:high]
        others = others[(label[others] != label[i]) & (True if diagonal else side[others] != side[i])]
        if not len(others):
            continue
        most = np.minimum(sizes[i] - np.bitwise_count(bits[i] & ~bits[others]).sum(1, dtype="i8"), sizes[others] - np.bitwise_count(bits[others] & ~bits[i]).sum(1, dtype="i8"))
        least = needed(sizes[i], sizes[others])
        spare = most - least
        for j in others[np.argsort(-spare, kind="stable")][: int((spare >= 0).sum())]:
            if label[j] != label[i] and len(np.intersect1d(arrays[i], arrays[j], assume_unique=True)) >= needed(sizes[i], sizes[j]):
                label[label == label[j]] = label[i]
                links.append((nodes[i], nodes[j]))
    return pa.table({"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())})


def _chunked(members: DataFrame, nodes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """members (node, cluster) with n, chunk and chunks: a cluster's nodes are dealt to as many chunks as its sizes ask for.

    Where its listed pairs are counted (cluster, pairs), also as many as their number asks for, but no more than its nodes have pairs.
    """
    sized = members.join(nodes.select("node", "n"), "node")
    sums = sized.groupBy("cluster").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("copies"))
    by_size = F.ceil(F.col("total") / SHINGLES_PER_CHUNK)
    if pairs is not None:
        sums = sums.join(pairs, "cluster")
        by_size = F.greatest(by_size, F.least(F.ceil(F.sqrt(2 * F.col("pairs") / PAIRS_PER_CHUNK)), F.ceil(F.col("pairs") / F.col("copies"))))
    chunks = sums.select("cluster", by_size.cast("long").alias("chunks"), "copies")
    return lookup(sized, chunks, ["cluster"], members.count()).drop("copies").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))


def _first_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among FIRST_PAIRS of the pairs (a, b) of each node, taken by hash: each sends one array."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("a", "b"), "a", "b"))
    few = ends.withColumn("place", place).where(F.col("place") <= FIRST_PAIRS).select("a", "b").distinct()
    own = lambda x: sets.select(F.col("node").alias(x), F.col("own").alias(f"own_{x}")).hint("merge")
    met = few.join(own("a"), "a").join(own("b"), "b").select("a", "b", "own_a", "own_b")
    return stash(met.mapInArrow(sparing_stream(_linked), "a binary, b binary"), "jaccard-first-links", arrow_rows=100)


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    at = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"component_{x}"))
    placed = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
    return placed.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")


def _pair_links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect what the given pairs (a, b) link. Pairs of one cluster of candidates meet in one place, or, for large clusters, in that of two chunks."""
    clusters = components(pairs)
    labelled = clusters.withColumnRenamed("component", "cluster")
    counted = pairs.join(labelled.withColumnRenamed("node", "a"), "a").groupBy("cluster").agg(F.count(F.lit(1)).alias("pairs"))
    members = stash(_chunked(labelled, nodes, counted), "jaccard-members")
    at = lambda x: members.select(F.col("node").alias(x), F.col("cluster"), F.col("chunk").alias(f"chunk_{x}"))
    tile = F.xxhash64("cluster", F.least("chunk_a", "chunk_b"), F.greatest("chunk_a", "chunk_b"))
    placed = stash(pairs.join(at("a"), "a").join(at("b").drop("cluster"), "b").select("a", "b", tile.alias("tile")), "jaccard-placed")
    to = F.col("tile").alias("to_tile")
    wanted = placed.select(to, F.col("a").alias("node")).union(placed.select(to, F.col("b").alias("node"))).distinct()
    sent = wanted.join(sets.hint("merge"), "node").select("to_tile", "node", "own")
    links = stash(placed.groupBy("tile").cogroup(sent.groupBy("to_tile")).applyInArrow(_settled, "a binary, b binary"), "jaccard-links")
    discard(clusters, members, placed)
    return links


def _blocks(members: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """The `total` members (node, cluster, component) in each block (cluster, x, y) that they go to, with n and side.

    The largest component of a cluster has chunks of its own after those of all others, which meet each other and these.
    """
    sized = members.join(nodes.select("node", "n"), "node")
    sums = sized.groupBy("cluster", "component").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("copies"))
    sums = sums.groupBy("cluster").agg(F.max(F.struct("total", "component")).alias("main"), F.sum("total").alias("total"), F.sum("copies").alias("copies"))
    filled = lambda size: F.ceil(size / SHINGLES_PER_CHUNK)
    chunks = sums.select("cluster", F.col("main.component").alias("main"), filled(F.col("main.total")).alias("own"), filled(F.col("total") - F.col("main.total")).alias("others"), "copies")
    large = F.col("component") == F.col("main")
    dealt = lambda most: F.pmod(F.xxhash64("node"), most)
    placed = lookup(sized, chunks, ["cluster"], total).where("others > 0").withColumn("chunk", F.when(large, F.col("others") + dealt(F.greatest("own", F.lit(1)))).otherwise(dealt(F.col("others"))))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(large, F.col("others")).otherwise(F.col("others") + F.col("own")) - 1)))
    return sent.select("node", "n", "component", "cluster", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), (F.col("chunk") > F.col("other")).cast("int").alias("side"))


def _block_links(held: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components in the clusters that tiles (tile, node, component) make."""
    hubs = held.groupBy("tile").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("copies"))
    clusters = components(lookup(held, hubs, ["tile"], held.count()).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    members = clusters.withColumnRenamed("component", "cluster").join(held.select("node", "component").distinct(), "node")
    sent = _blocks(members, nodes, clusters.count())
    blocks = sent.join(sets.hint("merge"), "node")
    links = stash(blocks.groupBy("cluster", "x", "y").applyInArrow(sparing(_join_block), "a binary, b binary"), "jaccard-block-links")
    discard(clusters)
    return links


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, locator.

    A document's set holds its distinct five-word shingles; with fewer words,
    the whole sequence; without words, or with NULL text, it is empty, linked
    with nothing, and component_id is the doc_id. Documents link when 100 times
    the intersection is at least 75 times the union; component_id is the
    smallest doc_id that links reach. Equal sets always link. Repeated rows give
    repeated results; rows with a NULL doc_id are linked with nothing and have a
    NULL component_id. Of rows with one doc_id and different texts each has its
    own set. kept is true for one row of each component, of those with the smallest
    doc_id that which comes first by locator, and for rows without links. Other columns are ignored, and an
    empty table gives an empty result.

    Sets are of 64-bit hashes and named by 128 bits.
    """
    return _joined(located(docs.select("doc_id", "text"), "locator"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs, all its columns, with the one row of each component that jaccard_join keeps."""
    name = free_name("locator", docs)
    rows = located(docs, name)
    dropped = _joined(rows.select("doc_id", "text", F.col(f"`{name}`").alias("locator"))).where("not kept").select(F.col("locator").alias("__dropped"))
    return rows.join(dropped, rows[name] == dropped["__dropped"], "left_anti").select(columns_of(docs))


def _joined(base: DataFrame) -> DataFrame:
    """jaccard_join of rows doc_id, text, locator."""
    base = base.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "locator")
    signed = stash(base.mapInArrow(sparing_stream(_signatures), "kind int, doc_id long, locator struct<file:string,row:bigint>, n long, node binary, bits binary"), "jaccard-signatures", ["kind"])
    rows = signed.where("kind = 0")
    frequencies = _frequencies(signed.where("kind = 1"))
    total = rows.agg(F.sum("n")).head()[0] or 0
    buckets = groups_for(total // 4, KEYS_PER_TILE_TASK, 12)
    tiles = _keys(base.where("doc_id is not null"), frequencies, buckets).groupBy("bucket").applyInArrow(_tiles(buckets), "kind int, a binary, b binary, tile long")
    tiles = stash(tiles, "jaccard-tiles", ["kind"])

    least = F.min(F.struct("doc_id", "locator")).alias("least")
    nodes = rows.where("node is not null and doc_id is not null").groupBy("node").agg(least, F.first("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("copies"))
    nodes = stash(nodes, "jaccard-nodes")
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    pairs = tiles.where("kind = 0").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    candidates = pairs = stash(pairs.mapInArrow(sparing_stream(_refuse_by_bits), "a binary, b binary, n_a long, n_b long"), "jaccard-candidates")
    held = tiles.where("kind = 1").select(F.col("a").alias("node"), "tile")

    # the arrays of all nodes that are compared, made from the text of one document each; merged whatever their number
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(held.select("node")).distinct().join(nodes.select("node", F.col("least.locator").alias("place")), "node")
    texts = base.join(wanted.hint("merge"), base["locator"] == wanted["place"]).select("node", "text")
    sets = stash(texts.mapInArrow(sparing_stream(_arrays), "node binary, own binary"), "jaccard-sets")

    pairs = pairs.select("a", "b")
    few = _first_links(pairs, sets)
    close = components(few)
    apart = stash(_apart(pairs, close), "jaccard-apart")
    discard(candidates, close)
    links = _pair_links(apart, nodes, sets)
    discard(apart)
    first = components(few.unionByName(links))

    # long tiles that still hold several components
    held = stash(held.join(first, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-held")
    mixed = held.groupBy("tile").agg((F.min("component") != F.max("component")).alias("several"), F.count(F.lit(1)).alias("copies")).where("several").drop("several")
    several = stash(lookup(held, mixed, ["tile"], held.count()).drop("copies"), "jaccard-mixed")
    more = _block_links(several, nodes, sets)
    found = components(few.unionByName(links).unionByName(more))
    discard(tiles, sets, few, first, held, several, links, more)

    # by node first, so that copies of one text needn't meet
    named = nodes.select("node", "least", "copies").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumnRenamed("copies", "rows")
    best = named.groupBy("component").agg(F.min("least").alias("best"), F.count(F.lit(1)).alias("copies"))
    named = lookup(named, best, ["component"], nodes.count()).select("node", "best", F.col("rows").alias("copies"))
    named = stash(named, "jaccard-named")
    able = F.expr("node is not null and doc_id is not null")
    out = lookup(rows.where(able).select("doc_id", "locator", "n", "node"), named, ["node"], rows.count())
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"), (F.col("locator") == F.col("best.locator")).alias("kept"), "locator")
    rest = rows.where(~able).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "locator")
    return out.unionByName(rest)


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return jaccard_join(table(spark, sf_dir, "documents")).drop("kept", "locator")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
    ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
