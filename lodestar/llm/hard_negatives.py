"""Hard negatives by dual-tree search with inner-product intervals.

Components are whole numbers, so all scores are exact. Candidates are dealt to
nodes, by a hash of their label and by a tree of cells fitted on a bounded
sample, and large nodes to tiles. Anchors are the rows that ask; they stand in
coarser nodes of the same tree. Node pairs are pruned first by the interval in
which the inner products of their boxes and balls lie, so that whole groups of
anchors leave whole groups of candidates; what is left meets in tiles, where a
tree over the anchors and one over the candidates prune further, and leaf pairs
are scored exactly. Positives come first: each anchor's own tile gives a floor
under its k-th positive, which prunes the others. Negatives are then searched
for between the bounds that the positives set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bounded_sample, discard, stash, table
from lodestar.llm.embedding_dedup import cell_of, fit_layout

POSITIVES, NEGATIVES = 5, 3
SCALE = 256
#: Percent of a positive's score between which its negatives' scores lie.
LOW, HIGH = 50, 95
LABELS = 10
#: Rows that the cells are fitted to; any cells give the same result.
SAMPLE_ROWS = 20_000
#: At most so many cells: with LABEL_HASHES they bound the node pairs, about a million. Larger nodes have more tiles.
MOST_CELLS = 256
VECTORS_PER_TILE, ANCHORS_PER_TILE = 4096, 2048
#: Labels are dealt to so many hashes: anchors meet the tiles of their label's hash for positives.
LABEL_HASHES = 16
LEAF_ANCHORS, LEAF_VECTORS = 32, 128
#: Up to this a sum of products is exact in double precision.
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1


def products(left, right):
    """Integer inner products of the rows of left and right, exact: in double precision where it suffices, else in whole numbers held at the ends of 64 bits."""
    import numpy as np

    most = (float(np.abs(left).max()) if left.size else 0.0) * (float(np.abs(right).max()) if right.size else 0.0) * left.shape[1]
    if most < EXACT:
        return (left @ right.T).astype("i8")
    whole = np.array([[int(v) for v in row] for row in left], object).reshape(left.shape) @ np.array([[int(v) for v in row] for row in right], object).reshape(right.shape).T
    return np.clip(whole, LEAST, MOST).astype("i8")


def bounds_of(rows):
    """Low and high corner of the box around rows, and the radius of the ball around its middle that holds them."""
    import numpy as np

    low, high = rows.min(0), rows.max(0)
    return low, high, float(np.sqrt(((rows - (low + high) / 2) ** 2).sum(1).max()))


def interval(left, right):
    """Lowest and highest inner product of any two rows of node pairs: (low, high, radius) arrays of nodes on either side.

    The tighter of boxes and balls, widened by more than rounding.
    """
    import numpy as np

    (al, ah, ar), (bl, bh, br) = left, right
    a, b, wa, wb = (al + ah) / 2, (bl + bh) / 2, (ah - al) / 2, (bh - bl) / 2
    middle = a @ b.T
    box = np.abs(a) @ wb.T + wa @ np.abs(b).T + wa @ wb.T
    ball = np.linalg.norm(a, axis=1)[:, None] * br[None] + ar[:, None] * np.linalg.norm(b, axis=1)[None] + ar[:, None] * br[None]
    wide = np.minimum(box, ball)
    wide = wide + 1e-9 * (np.abs(middle) + wide) + 0.5
    # what is too large for a double bounds nothing; scores are held at the ends of 64 bits
    low, high = middle - wide, middle + wide
    return np.clip(np.where(np.isnan(low), -np.inf, low), LEAST, MOST), np.clip(np.where(np.isnan(high), np.inf, high), LEAST, MOST)


class Tree:
    """A balanced tree over rows: an order of them, and for each level the cuts of its nodes in that order and their bounds."""

    def __init__(self, rows, leaf: int) -> None:
        import numpy as np

        self.order = np.arange(len(rows))
        cuts = [0, len(rows)]
        self.levels = []
        while True:
            found = [bounds_of(rows[self.order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            self.levels.append((cuts, (np.array([f[0] for f in found]), np.array([f[1] for f in found]), np.array([f[2] for f in found]))))
            if max(b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)) <= leaf:
                break
            deeper = [0]
            for (a, b), (low, high, _) in zip(zip(cuts[:-1], cuts[1:], strict=True), found, strict=True):
                half = (b - a) // 2
                own = self.order[a:b]
                self.order[a:b] = own[np.argpartition(rows[own, int((high - low).argmax())], half)]
                deeper += [a + half, b]
            cuts = deeper


def leaf_pairs(anchors: Tree, vectors: Tree, floors, ceilings, counts: dict | None = None):
    """(anchor rows, vector rows) of leaf pairs that may hold a product from floors to ceilings of an anchor; both are given by row of anchors."""
    import numpy as np

    live = np.ones((1, 1), bool)
    for level in range(max(len(anchors.levels), len(vectors.levels))):
        sides = []
        for axis, tree in enumerate((anchors, vectors)):
            at = min(level, len(tree.levels) - 1)
            if at and at == level:
                live = np.repeat(live, 2, axis)
            sides.append(tree.levels[at])
        (cuts, mine), (_, theirs) = sides
        low, high = interval(mine, theirs)
        least = np.minimum.reduceat(floors[anchors.order], cuts[:-1])
        most = np.maximum.reduceat(ceilings[anchors.order], cuts[:-1])
        live = live & (high >= least[:, None]) & (low <= most[:, None])
    cuts_a, cuts_v = anchors.levels[-1][0], vectors.levels[-1][0]
    for i in np.flatnonzero(live.any(1)):
        columns = np.concatenate([vectors.order[cuts_v[j] : cuts_v[j + 1]] for j in np.flatnonzero(live[i])])
        rows = anchors.order[cuts_a[i] : cuts_a[i + 1]]
        if counts is not None:
            counts["scored"] = counts.get("scored", 0) + len(rows) * len(columns)
        yield rows, columns


def _matrix(column):
    """The components of a list column whose lists are of one length."""
    import numpy as np

    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _by_length(table):
    """The tables of rows whose vectors have one length, by length."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.list_value_length(table.column("vector")).to_numpy()
    lengths = np.unique(sizes)
    return {int(n): table if len(lengths) == 1 else table.take(pa.array(np.flatnonzero(sizes == n))) for n in lengths}


FOUND = "anchor_row long, anchor_id long, vec_id long, row long, score long"


def _best_positives(own: bool, k: int):
    """For each anchor of a tile its k best others of the same label among the tile's vectors. own: anchors are the tile's rows that ask; else they come beside them, with floors."""

    def found(asks, rows):
        import numpy as np
        import pyarrow as pa

        out = []
        theirs = _by_length(rows)
        for size, mine in _by_length(asks).items():
            if size not in theirs:
                continue
            other = theirs[size]
            a, b = _matrix(mine.column("vector")), _matrix(other.column("vector"))
            label_a, label_b = mine.column("label").to_numpy(), other.column("label").to_numpy()
            row_a, row_b, id_a, id_b = (t.column(c).to_numpy() for c in ("row", "vec_id") for t in (mine, other))
            floors = np.full(len(a), -np.inf) if own else mine.column("floor").to_numpy().astype("f8")
            for i, j in leaf_pairs(Tree(a, LEAF_ANCHORS), Tree(b, LEAF_VECTORS), floors, np.full(len(a), np.inf)):
                scores = products(a[i], b[j])
                fits = (label_a[i][:, None] == label_b[j][None]) & (row_a[i][:, None] != row_b[j][None]) & (scores >= floors[i][:, None])
                for n, at in enumerate(i):
                    some = np.flatnonzero(fits[n])
                    if len(some) > k:  # all that tie with the k-th stay for the order by id
                        some = some[scores[n, some] >= np.partition(scores[n, some], len(some) - k)[len(some) - k]]
                    top = some[np.lexsort((row_b[j[some]], id_b[j[some]], -scores[n, some]))[:k]]
                    out += [(int(row_a[at]), int(id_a[at]), int(id_b[j[c]]), int(row_b[j[c]]), int(scores[n, c])) for c in top]
        names = ["anchor_row", "anchor_id", "vec_id", "row", "score"]
        return pa.table({n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(names)})

    if own:
        import numpy as np
        import pyarrow as pa

        return lambda rows: found(rows.take(pa.array(np.flatnonzero(rows.column("asks").to_numpy(zero_copy_only=False)))), rows)
    return found


def _best_negatives(k: int):
    """For each anchor of a tile and each of its positives the k best vectors of other labels between the positive's bounds."""

    def found(asks, rows):
        import numpy as np
        import pyarrow as pa

        out = []
        theirs = _by_length(rows)
        for size, mine in _by_length(asks).items():
            if size not in theirs:
                continue
            other = theirs[size]
            a, b = _matrix(mine.column("vector")), _matrix(other.column("vector"))
            label_a, label_b = mine.column("label").to_numpy(), other.column("label").to_numpy()
            row_b, id_b = other.column("row").to_numpy(), other.column("vec_id").to_numpy()
            positives = mine.select(["row", "vec_id", "positives"]).to_pylist()
            # a bound on scores in double precision may be off by rounding beyond 2**53: one part in 2**50 makes up for it
            floors = np.array([min(p["low"] for p in m["positives"]) for m in positives], "f8")
            ceilings = np.array([max(p["high"] for p in m["positives"]) for m in positives], "f8")
            floors, ceilings = floors - np.abs(floors) * 2.0**-50, ceilings + np.abs(ceilings) * 2.0**-50
            for i, j in leaf_pairs(Tree(a, LEAF_ANCHORS), Tree(b, LEAF_VECTORS), floors, ceilings):
                scores = products(a[i], b[j])
                fits = (label_a[i][:, None] != label_b[j][None]) & (scores >= floors[i][:, None]) & (scores <= ceilings[i][:, None])
                for n, at in enumerate(i):
                    some = np.flatnonzero(fits[n])
                    some = some[np.lexsort((row_b[j[some]], id_b[j[some]], -scores[n, some]))]
                    falling = -scores[n, some]
                    for p in positives[at]["positives"]:
                        first, stop = np.searchsorted(falling, -p["high"], "left"), np.searchsorted(falling, -p["low"], "right")
                        out += [(positives[at]["row"], positives[at]["vec_id"], p["row"], p["vec_id"], p["score"], int(id_b[j[c]]), int(row_b[j[c]]), int(scores[n, c])) for c in some[first : min(stop, first + k)]]
        names = ["anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score", "negative_id", "negative_row", "negative_score"]
        return pa.table({n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(names)})

    return found


NEGATIVE = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, negative_id long, negative_row long, negative_score long"


class Nodes:
    """The nodes of candidates and anchors: bounds, tiles of each, and which pairs may hold a product between an anchor's bounds."""

    def __init__(self, rows: DataFrame, total: int) -> None:
        import numpy as np

        sample = bounded_sample(rows.select("vector"), SAMPLE_ROWS, seed=13).collect()
        sizes = [len(r["vector"]) for r in sample]
        self.dim = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
        fit_on = np.array([r["vector"] for r in sample if len(r["vector"]) == self.dim], "f8").reshape(-1, max(1, self.dim))
        self.depth = 0
        while 2 ** (self.depth + 1) <= min(MOST_CELLS, len(fit_on)) and 2**self.depth * VECTORS_PER_TILE * LABEL_HASHES < total:
            self.depth += 1
        norms = np.linalg.norm(fit_on, axis=1, keepdims=True)
        self.rotation, _, _, self.splits = fit_layout(fit_on / np.where(norms > 0, norms, 1), 2**self.depth) if len(fit_on) else (np.eye(1), None, None, [])

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows with cell; vectors of other lengths than the usual one are in cell -1, which has no bounds."""
        dim, rotation, splits = self.dim, self.rotation, self.splits

        def run(batches):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            for batch in batches:
                at = batch.schema.names.index("vector")
                sizes = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
                cell = np.full(batch.num_rows, -1, "i4")
                usual = np.flatnonzero(sizes == dim)
                if dim and len(usual):
                    own = batch.column(at).take(pa.array(usual)).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
                    norms = np.linalg.norm(own, axis=1, keepdims=True)
                    cell[usual] = cell_of(own / np.where(norms > 0, norms, 1) @ rotation, splits)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

        return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell int")

    def summed(self, rows: DataFrame, keys: list[str], *more) -> list:
        """One row per node: its keys, n, low and high corners, radius of the ball around their middle at most, and more."""
        dim = self.dim
        of = [F.array(*[f(F.when(F.col("cell") >= 0, F.get("vector", F.lit(i)))) for i in range(dim)]).alias(name) for name, f in (("low", F.min), ("high", F.max))]
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *of, *more).collect()


    def coarser(self, anchors: int) -> Column:
        """The cell of an anchor: one of so few of the tree's upper nodes that each has about a tile of anchors."""
        depth = 0
        while depth < self.depth and 2**depth * ANCHORS_PER_TILE < anchors:
            depth += 1
        return F.when(F.col("cell") < 0, F.lit(-1)).otherwise(F.shiftright("cell", self.depth - depth)).cast("int")


def _numbered(rows: DataFrame, nodes: list, keys: list[str], name: str) -> DataFrame:
    """rows with the place of their node among nodes, which cells and hashes bound."""
    found = [(i, *(r[k] for k in keys)) for i, r in enumerate(nodes)]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(found, f"{name} int, {', '.join(f'{k} int' for k in keys)}")), keys)


def _tiles(node, most: int) -> int:
    return max(1, -(-node["n"] // most))


def _bounds(nodes: list):
    """Arrays of corners and half diagonals of nodes; nodes without bounds have infinite ones."""
    import numpy as np

    low = np.array([r["low"] for r in nodes], "f8").reshape(len(nodes), -1)
    high = np.array([r["high"] for r in nodes], "f8").reshape(len(nodes), -1)
    return low, high, np.linalg.norm((high - low) / 2, axis=1)


def _pairs(asking: list, nodes: list, same_hash: bool) -> list[tuple[int, int, int, int]]:
    """Places and tiles of asking and answering nodes that may hold a product between the asking node's floor and ceiling."""
    import numpy as np

    if not asking or not nodes:
        return []
    low, high = interval(_bounds(asking), _bounds(nodes))
    floor, ceiling = np.array([r["floor"] for r in asking], "f8"), np.array([r["ceiling"] for r in asking], "f8")
    usual_a, usual_b = np.array([r["cell"] >= 0 for r in asking]), np.array([r["cell"] >= 0 for r in nodes])
    live = (high >= floor[:, None]) & (low <= ceiling[:, None])
    live = np.where(usual_a[:, None] & usual_b[None], live, usual_a[:, None] == usual_b[None])
    if same_hash:
        live &= np.array([r["hash"] for r in asking])[:, None] == np.array([r["hash"] for r in nodes])[None]
    return [(int(a), int(v), _tiles(asking[a], ANCHORS_PER_TILE), _tiles(nodes[v], VECTORS_PER_TILE)) for a, v in zip(*np.nonzero(live), strict=True)]


def _meet(asks: DataFrame, rows: DataFrame, pairs: list, run, schema: str) -> DataFrame:
    """Anchors (with node a) and vectors (with node v) of the node pairs, tile by tile of both."""
    links = lambda: F.broadcast(rows.sparkSession.createDataFrame(pairs, "a int, v int, a_tiles int, v_tiles int"))
    mine = lambda n: F.pmod(F.xxhash64("row", F.lit(13)), F.col(f"{n}_tiles")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(f"{n}_tiles") - 1))
    left = asks.join(links(), "a").withColumn("a_tile", mine("a")).withColumn("v_tile", every("v"))
    right = rows.join(links(), "v").withColumn("v_tile", mine("v")).withColumn("a_tile", every("a"))
    keys = ["a", "v", "a_tile", "v_tile"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _first(rows: DataFrame, keys: list[str], score: str, id_column: str, row: str, k: int, rank: str) -> DataFrame:
    """The k first rows of each key by score, id and row: at most k from each tile come here."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(id_column), F.asc(row))
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mine(vectors: DataFrame, anchors, label=None, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """One row per hard negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors has vec_id, embedding and label; anchors is a condition on vec_id,
    label a column that replaces the label. Rows with a NULL vec_id, label or
    vector, an empty vector, or a NULL or non-finite component take no part.
    A component x counts as floor(256 * x); a score is the inner product, held at
    the ends of 64 bits. Vectors of different lengths never meet. Equal rows
    (id, label and vector) count once; one id on differing rows is as many
    rows, ties between which go by a hash. An anchor's positives are its first
    rows of the same label by score, then smaller vec_id; a positive's negatives
    the first rows of another label whose score lies between LOW and HIGH percent
    of its own: a positive below zero has none. Other columns are ignored; an
    empty table gives an empty result.
    """
    own = F.col("label") if label is None else label
    scaled = lambda x: x.cast("double") * SCALE
    # doubles from 2**53 on are whole
    whole = lambda x: F.when(F.abs(scaled(x)) < EXACT, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))
    vector = F.transform("embedding", whole)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(scaled(x)) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~bad & (F.size("embedding") > 0), F.lit(False))
    rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), own.cast("long").alias("label"), vector.alias("vector"))
    rows = rows.withColumn("row", F.xxhash64("vec_id", "label", "vector")).dropDuplicates(["row"]).withColumn("asks", F.coalesce(anchors, F.lit(False)))
    rows = rows.withColumn("hash", F.pmod(F.xxhash64("label"), F.lit(LABEL_HASHES)).cast("int"))
    rows = stash(rows, "negatives-rows")
    placing = Nodes(rows, rows.count())
    placed = stash(placing.placed(rows), "negatives-placed")
    discard(rows)
    nodes = placing.summed(placed, ["hash", "cell"])
    widths = placed.sparkSession.createDataFrame([(i, _tiles(r, VECTORS_PER_TILE)) for i, r in enumerate(nodes)], "v int, tiles int")
    rows = _numbered(placed, nodes, ["hash", "cell"], "v").join(F.broadcast(widths), "v")

    # a floor under each anchor's last positive, from its own tile
    tile = F.pmod(F.xxhash64("row", F.lit(13)), F.col("tiles")).cast("int").alias("tile")
    near = rows.select("vec_id", "label", "vector", "row", "asks", "v", tile).groupBy("v", "tile").applyInArrow(_best_positives(True, positives), FOUND)
    floors = near.groupBy("anchor_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= positives).select(F.col("anchor_row").alias("row"), "floor")
    asks = placed.where("asks").select("vec_id", "label", "vector", "row", "hash", placing.coarser(placed.where("asks").count()).alias("cell"))
    asks = stash(asks.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST))), "negatives-anchors")
    asking = placing.summed(asks, ["hash", "cell"], F.min("floor").alias("floor"), F.lit(MOST).alias("ceiling"))
    rows = rows.select("vec_id", "label", "vector", "row", "v")
    met = _meet(_numbered(asks, asking, ["hash", "cell"], "a"), rows, _pairs(asking, nodes, True), _best_positives(False, positives), FOUND)
    best = _first(met, ["anchor_row"], "score", "vec_id", "row", positives, "rank")

    # anchors with the bounds of their positives; their nodes needn't be parted by label now
    share = lambda percent, whole: whole(F.col("score").cast("decimal(20,0)") * F.lit(percent) / F.lit(100)).cast("long")
    bounded = best.where("score >= 0").select("anchor_row", F.struct("vec_id", "row", "score", share(LOW, F.ceil).alias("low"), share(HIGH, F.floor).alias("high")).alias("p"))
    bounded = bounded.where("p.low <= p.high").groupBy("anchor_row").agg(F.collect_list("p").alias("positives"))
    chosen = stash(asks.drop("floor").join(bounded, asks["row"] == bounded["anchor_row"]).drop("anchor_row"), "negatives-bounded")
    least, most = F.min(F.array_min("positives.low")).alias("floor"), F.max(F.array_max("positives.high")).alias("ceiling")
    asking = placing.summed(chosen, ["cell"], least, most)
    met = _meet(_numbered(chosen, asking, ["cell"], "a"), rows, _pairs(asking, nodes, False), _best_negatives(negatives), NEGATIVE)
    out = _first(met, ["anchor_row", "positive_row"], "negative_score", "negative_id", "negative_row", negatives, "rank")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """All rows of embeddings; those whose vec_id is divisible by 50 ask, and each seventh has the next label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 50 == 0, label)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
