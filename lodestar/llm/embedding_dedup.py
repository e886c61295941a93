"""Near-duplicate embeddings: subspace pigeonhole join.

Vectors that are equal are one node. Unit vectors are rotated and split into
low-dimensional blocks. Two vectors with cosine >= 0.9 have a squared distance
of at most 0.2, so in some block their squared distance is within that block's
share of it, shares being in proportion to the blocks' variance. Vectors are
dealt to cells of the rotated space, and sent to those cells only whose bounds
they are near enough to. There each block is range-joined under its budget: its
coordinates are cut into a tree of small boxes, and a vector meets only boxes
within the budget. The union of the candidates is verified in double precision.
Neither links nor pairs leave a task: only counts, and links that span what the
task connects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bounded_sample, stash, table
from lodestar.llm.components import components

COSINE = 0.9
BLOCK = 8
#: Rows that the rotation and the cells are fitted to; any rotation and any cells give the same result.
SAMPLE_ROWS = 20_000
VECTORS_PER_TILE = 4096
#: Rows of the sample that a cell needs at least; cells that would have fewer are dealt to tiles by hash instead.
SAMPLE_PER_CELL = 8
VECTORS_PER_BOX = 64
SLAB = 2048
#: More than the rounding of a cosine in double precision: nearer to the threshold one formula decides.
EDGE = 1e-9
#: More than the rounding of single precision over a block.
SLACK = 1e-5


def fit_layout(sample, cells: int, seed: int = 1):
    """Rotation, bounds and budgets of blocks, and the splits of a tree of cells, from rows of unit vectors."""
    import numpy as np

    dim = sample.shape[1]
    _, rotation = np.linalg.eigh(sample.T @ sample + 1e-9 * np.diag(np.random.default_rng(seed).random(dim)))
    rotation = rotation[:, ::-1]
    turned = sample @ rotation
    blocks = [(a, min(a + BLOCK, dim)) for a in range(0, dim, BLOCK)]
    energy = np.array([turned[:, a:b].var(0).sum() for a, b in blocks]) + 1e-6
    budgets = (2 - 2 * COSINE) * energy / energy.sum()
    splits = []
    parts = [np.arange(len(turned))]
    depth = 0
    while 2**depth < cells:
        axis = depth % dim
        level, deeper = [], []
        for own in parts:
            cut = float(np.median(turned[own, axis])) if len(own) else 0.0
            level.append(cut)
            deeper += [own[turned[own, axis] < cut], own[turned[own, axis] >= cut]]
        splits.append((axis, level))
        parts = deeper
        depth += 1
    return rotation, blocks, budgets, splits


def cell_of(turned, splits):
    """The cell of each rotated row."""
    import numpy as np

    cell = np.zeros(len(turned), "i8")
    for axis, level in splits:
        cell = 2 * cell + (turned[:, axis] >= np.array(level)[cell])
    return cell


def _unit(column, dim: int):
    import numpy as np

    own = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("f8")
    norms = np.sqrt((own * own).sum(1))
    return own, norms, own / norms[:, None]


def boxes_of(points, most: int = VECTORS_PER_BOX):
    """Row numbers box by box, the boxes' first places in them, and their bounds: halves along the widest side until at most `most` rows are left."""
    import numpy as np

    todo, done = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) > most:
            some = points[own]
            axis = int((some.max(0) - some.min(0)).argmax())
            half = np.argpartition(some[:, axis], len(own) // 2)
            todo += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
        elif len(own):
            done.append(own)
    low = np.array([points[own].min(0) for own in done])
    high = np.array([points[own].max(0) for own in done])
    return done, low, high


def _gaps(points, low, high):
    """Squared distance of each point to each box."""
    import numpy as np

    total = np.zeros((len(points), len(low)), points.dtype)
    for d in range(points.shape[1]):
        x = points[:, d, None]
        gap = np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0)
        total += gap * gap
    return total


def near(left, right, left_norms, right_norms, left_turned, right_turned, blocks, budgets, same: bool, counts: dict | None = None):
    """Index pairs of linked rows, slab by slab; of one set of rows with itself only pairs in order.

    counts, where given, adds up the pairs whose distance in a block was computed, and the candidates.
    """
    import numpy as np

    if not len(left) or not len(right):
        return
    trees = []
    for lo, hi in blocks:
        own = np.ascontiguousarray(right_turned[:, lo:hi], "f4")
        rows, low, high = boxes_of(own)
        trees.append((np.ascontiguousarray(left_turned[:, lo:hi], "f4"), [(at, np.ascontiguousarray(own[at].T), (own[at] * own[at]).sum(1) / 2) for at in rows], low, high))
    for at in range(0, len(left), SLAB):
        rows = slice(at, at + SLAB)
        found = np.zeros((len(left[rows]), len(right)), bool)
        for (mine, boxes, low, high), budget in zip(trees, budgets, strict=True):
            part = mine[rows]
            half = ((part * part).sum(1) - budget - SLACK) / 2
            reached = _gaps(part, low, high) <= budget + SLACK
            for b, (cols, theirs, theirs_half) in enumerate(boxes):
                here = np.flatnonzero(reached[:, b])
                if not len(here):
                    continue
                # |x - y|^2 <= budget  <=>  x.y - |y|^2 / 2 >= (|x|^2 - budget) / 2
                i, j = np.nonzero(part[here] @ theirs - theirs_half >= half[here, None])
                found[here[i], cols[j]] = True
                if counts is not None:
                    counts["compared"] = counts.get("compared", 0) + len(here) * len(cols)
        i, j = np.nonzero(found)
        if same:
            later = j > i + at
            i, j = i[later], j[later]
        if counts is not None:
            counts["candidates"] = counts.get("candidates", 0) + len(i)
        exact = lambda i, j: np.einsum("ij,ij->i", left[rows][i], right[j]) / left_norms[rows][i] / right_norms[j]  # noqa: E731, B023
        if len(i) > 0.01 * found.size:
            cosine = (left[rows] @ right.T)[i, j] / left_norms[rows][i] / right_norms[j]
            edge = np.flatnonzero(np.abs(cosine - COSINE) < EDGE)
            cosine[edge] = exact(i[edge], j[edge])
        else:
            cosine = exact(i, j)
        hit = cosine >= COSINE
        yield i[hit] + at, j[hit]


def _join_tile(layout, dim):
    rotation, blocks, budgets, _ = layout

    def run(rows):
        import numpy as np
        import pyarrow as pa

        rows = rows.combine_chunks()
        ids, weights = rows.column("node").to_numpy(), rows.column("weight").to_numpy()
        side = rows.column("side").to_numpy()
        own, norms, unit = _unit(rows.column("embedding").combine_chunks(), dim)
        turned = unit @ rotation
        same = rows.column("x")[0] == rows.column("y")[0]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        b = a if same else b
        linked = np.zeros(len(ids), "i8")
        label = np.arange(len(ids))
        spanning = []

        def root(x):
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        for i, j in near(own[a], own[b], norms[a], norms[b], turned[a], turned[b], blocks, budgets, same):
            x, y = a[i], b[j]
            np.add.at(linked, x, weights[y])
            np.add.at(linked, y, weights[x])
            for p, q in _spanning(x, y):
                p, q = root(p), root(q)
                if p != q:
                    label[p] = q
                    spanning.append((p, q))
        some = np.flatnonzero(linked)
        ends = np.array(spanning, "i8").reshape(-1, 2)
        none, blank = pa.nulls(len(some), pa.int64()), pa.nulls(len(ends), pa.int64())
        return pa.table(
            {
                "node": pa.chunked_array([pa.array(ids[some]), blank]),
                "links": pa.chunked_array([pa.array(linked[some]), blank]),
                "a": pa.chunked_array([none, pa.array(ids[ends[:, 0]])]),
                "b": pa.chunked_array([none, pa.array(ids[ends[:, 1]])]),
            }
        )

    return run


def _spanning(x, y):
    """Links x-y of a slab reduced to stars: each node with the smallest that the links connect it to."""
    import numpy as np

    if not len(x):
        return []
    label = np.arange(int(max(x.max(), y.max())) + 1)
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    nodes = np.unique(np.concatenate([x, y]))
    return [(int(n), int(label[n])) for n in nodes if label[n] != n]


def _cells(layout, dim):
    rotation, _, _, splits = layout

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            _, _, unit = _unit(batch.column(2), dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell_of(unit @ rotation, splits))], names=["node", "weight", "embedding", "cell"])

    return run


def _boxes(layout, dim, cells):
    """The bounds of the vectors of each cell that a task has seen, all coordinates."""
    rotation = layout[0]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        low, high, count = np.full((cells, dim), np.inf), np.full((cells, dim), -np.inf), np.zeros(cells, "i8")
        for batch in batches:
            if not batch.num_rows:
                continue
            _, _, unit = _unit(batch.column(2), dim)
            turned, cell = unit @ rotation, batch.column(3).to_numpy()
            np.minimum.at(low, cell, turned)
            np.maximum.at(high, cell, turned)
            count += np.bincount(cell, minlength=cells)
        have = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cell": have, "count": count[have], "low": list(low[have]), "high": list(high[have])}, schema=pa.schema([("cell", pa.int64()), ("count", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    return run


def _reached(layout, dim, low, high, firsts):
    """For each vector the tiles of all cells whose bounds are within the threshold."""
    rotation = layout[0]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tiles = [np.arange(a, b) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                _, _, unit = _unit(part.column(2), dim)
                within = _gaps(unit @ rotation, low, high) <= 2 - 2 * COSINE + SLACK
                lists = [np.concatenate([tiles[c] for c in np.flatnonzero(row)]) for row in within]
                others = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]).astype("i4")), pa.array(np.concatenate(lists).astype("i4")))
                yield pa.RecordBatch.from_arrays([*part.columns, others], names=["node", "weight", "embedding", "cell", "others"])

    return run


def _links_of(nodes: DataFrame, dim: int, count: int, kind: str) -> DataFrame:
    """node, links, a, b: counts of links with other nodes' vectors, and spanning links, for vectors of one dimension."""
    import numpy as np

    sample = np.array([r["embedding"] for r in bounded_sample(nodes.select("embedding"), SAMPLE_ROWS, seed=1).collect()], "f8").reshape(-1, dim)
    if not len(sample):
        sample = np.zeros((1, dim))
    norms = np.sqrt((sample * sample).sum(1, keepdims=True))
    cells = 1
    while cells * SAMPLE_PER_CELL * 2 <= len(sample) and cells * VECTORS_PER_TILE < count:
        cells *= 2
    layout = fit_layout(sample / np.where(norms > 0, norms, 1), cells)
    placed = stash(nodes.select("node", "weight", "embedding").mapInArrow(_cells(layout, dim), f"node long, weight long, embedding {kind}, cell long"), "embedding-cells")
    boxes = placed.mapInArrow(_boxes(layout, dim, cells), "cell long, count long, low array<double>, high array<double>")
    boxes = boxes.groupBy("cell").agg(F.sum("count").alias("count"), *[F.array(*[f(F.col(name)[i]) for i in range(dim)]).alias(name) for name, f in (("low", F.min), ("high", F.max))]).collect()
    low, high, chunks = np.full((cells, dim), np.inf), np.full((cells, dim), -np.inf), [0] * cells
    for r in boxes:
        low[r["cell"]], high[r["cell"]], chunks[r["cell"]] = r["low"], r["high"], -(-r["count"] // VECTORS_PER_TILE)
    firsts = np.cumsum([0, *chunks]).tolist()

    # tiles are numbered through all cells; a vector goes to the pairs of its own tile with all tiles of cells in reach
    cell = F.col("cell").cast("int")
    first, size = F.array(*[F.lit(v) for v in firsts[:-1]]), F.array(*[F.lit(max(1, v)) for v in chunks])
    mine = (F.get(first, cell) + F.pmod(F.xxhash64("node"), F.get(size, cell)).cast("int")).alias("tile")
    reached = placed.mapInArrow(_reached(layout, dim, low, high, firsts), f"node long, weight long, embedding {kind}, cell long, others array<int>")
    sent = reached.select("node", "weight", "embedding", mine, "others").select("node", "weight", "embedding", "tile", F.explode("others").alias("other"))
    sent = sent.select("node", "weight", "embedding", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), (F.col("tile") > F.col("other")).cast("int").alias("side"))
    return sent.groupBy("x", "y").applyInArrow(_join_tile(layout, dim), "node long, links long, a long, b long")


def embedding_dedup(vectors: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors link when their cosine, in double precision, is at least 0.9. A
    vector that is NULL, empty or zero, or has a NULL or non-finite component,
    links with nothing: n_links 0, component_id its own id, kept. So does one
    whose id is NULL; its component_id is NULL and kept is true. Vectors of
    different lengths don't link. Repeated rows count once and give repeated
    results; an id on rows with different vectors has the links of all of them. n_links counts other vectors; component_id is the smallest vec_id
    that links reach. Other columns, labels too, are ignored; an empty table
    gives an empty result.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(~bad & some, F.lit(False))
    good = rows.where(usable).distinct()
    nodes = good.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    nodes = stash(nodes, "embedding-nodes")
    dims = [(r["dim"], r["count"]) for r in nodes.groupBy(F.size("embedding").alias("dim")).count().collect()]
    joined = None
    for dim, count in sorted(dims):
        part = _links_of(nodes.where(F.size("embedding") == dim), dim, count, kind)
        joined = part if joined is None else joined.unionByName(part)
    if joined is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    joined = stash(joined, "embedding-links")
    counted = joined.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    found = components(joined.where("a is not null").select("a", "b"))
    named = nodes.join(counted, "node", "left").join(found, "node", "left")
    named = named.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    usable_rows = rows.where(usable).join(named, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable_rows.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All rows of embeddings, whatever their labels."""
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e
LEFT JOIN (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x) n USING (vec_id)
LEFT JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) c USING (vec_id)
"""
