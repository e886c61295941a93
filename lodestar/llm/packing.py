"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are tokenised where they are read, and cut at multiples of the
sequence length: whole pieces fill sequences of their own. The pieces, without
their tokens, are written once and counted. Groups of pieces, randomised by a
hash of their place, are packed independently of each other: within a group
pieces go, longest first, into the first sequence with room, found by a walk
down a tree whose nodes hold the largest room below them.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.bpe import Encoder, each_batch
from lodestar.llm.common import groups_for, held, stash, table

SEQUENCE = 4096
END_ID = 2
PIECES_PER_GROUP = 8192
#: Sequence ids of a group start at its number shifted by so many bits.
GROUP_BITS = 32


def pieces(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, id_column: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, place. Every document ends with END_ID.

    NULL text is empty and is one piece with END_ID alone; a NULL id passes;
    repeated rows give repeated pieces. place is a number of the row, other for
    each row of docs, in the order in which tasks read them.
    """
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "place")

    def schema():
        import pyarrow as pa

        return pa.schema([(n, pa.int64()) for n in names])

    def make(path):
        encoder = held(("whole-words", path), lambda: Encoder(path, whole=True))
        end = END_ID.to_bytes(4, "little")

        def one(batch):
            out = {n: [] for n in names}
            ids, texts, places = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            for doc_id, text, place in zip(ids, texts, places, strict=True):
                raw = encoder.encode(text.as_py() or "") + end
                for cut in range(0, len(raw), 4 * sequence):
                    piece = raw[cut : cut + 4 * sequence]
                    for name, value in zip(names, (doc_id, cut // 4, len(piece) // 4, zlib.crc32(piece), len(raw) // 4, place), strict=True):
                        out[name].append(value)
            return out

        return one

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    return rows.mapInArrow(each_batch(vocabulary, make, schema), ", ".join(f"{n} long" for n in names))


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each item, given longest first. Bins are numbered from 0 in the order in which they open."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    placed = []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < length:
                node += 1
        placed.append((node - leaves, capacity - room[node]))
        room[node] -= length
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return placed


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, pieces_per_group: int = PIECES_PER_GROUP, seed: int = 0, id_column: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    Every id of every document lies in exactly one piece, and the pieces of a
    sequence follow each other from offset 0 without a gap. A sequence is padded
    to `sequence`, except one whose length is a power of two. NULL text is empty
    and still has its end id. Repeated rows are packed as often as they come; a
    NULL doc_id is packed like any other. Ties in length go by doc_id, start and
    checksum. The group of a piece comes from a hash of its place in docs and its
    start, so nothing that rows share, repeated rows included, gathers in a
    group, and groups have about pieces_per_group pieces whatever the texts' lengths.
    """
    cut = stash(pieces(docs, vocabulary, sequence, id_column), "packing-pieces")
    groups = groups_for(cut.count(), pieces_per_group)

    def one_group(rows):
        import numpy as np
        import pyarrow as pa

        order = sorted(
            range(rows.num_rows),
            key=lambda i, k=[rows.column(n).to_pylist() for n in ("length", "doc_id", "start", "ids_crc32")]: (-k[0][i], k[1][i] is None, k[1][i] or 0, k[2][i], k[3][i]),
        )
        rows = rows.take(pa.array(order, pa.int64()))
        placed = first_fit_decreasing(rows.column("length").to_pylist(), sequence)
        bins, offsets = np.array([p[0] for p in placed], "i8"), np.array([p[1] for p in placed], "i8")
        used = np.bincount(bins, rows.column("length").to_numpy().astype("f8")).astype("i8")
        padded = np.where(used & (used - 1) == 0, used, sequence)
        group = rows.column("group").to_numpy()
        return rows.drop_columns(["group"]).append_column("sequence_id", pa.array((group << GROUP_BITS) + bins)).append_column("offset", pa.array(offsets)).append_column("padded_length", pa.array(padded[bins]))

    group = F.pmod(F.xxhash64("place", "start", F.lit(seed)), F.lit(groups)).alias("group")
    rows = cut.select("*", group).drop("place")
    return rows.groupBy("group").applyInArrow(one_group, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))

