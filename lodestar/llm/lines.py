"""Substring deduplication by hashing lines, paragraphs and passages.

A unit is a line, a paragraph (lines between blank ones), a whole text, or, where
such borders differ around it, a passage: any least_words words in a row.
Units are normalised to words with A-Z in lower case, their digests are grouped
over the whole corpus, the occurrence that comes first by document and place
stays, and all others are removed. What is removed keeps its offsets in the
original text.

Lines, paragraphs and texts go first, in one pass. What they leave is searched
for passages: of the hashes of half a passage each passage selects the least, so
two equal passages select the same. Only passages whose selected hash recurs
are written out and grouped. So shuffles carry digests and places for all of the
corpus, and texts only where something recurs or is cut.

Digests have 128 bits. Counts and first places are summed before the shuffle;
digests with many occurrences are few, and are joined by broadcast.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, lookup, stash, table, text_or_empty

#: Repeated runs of fewer words are left where they are: set phrases and notices recur in clean documents too.
LEAST_WORDS = 50
#: Odd factors of the two polynomial hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
UNIT = "struct<h:bigint,g:bigint,start:int,stop:int>"
PLACE = ("doc_id", "text_key")


@lru_cache(1)
def _powers(longest: int):
    """For each factor its powers, and those of its inverse modulo 2**64."""
    import numpy as np

    out = []
    for factor in FACTORS:
        pair = []
        for f in (factor, pow(factor, -1, 2**64)):
            row = np.full(longest, f, "u8")
            row[0] = 1
            pair.append(np.multiply.accumulate(row))
        out.append(pair)
    return out


class Words:
    """Word hashes of texts in one array, with the places of their words and the digests of any run of words."""

    def __init__(self, texts: list[str]) -> None:
        import numpy as np

        from lodestar.llm.shingles import word_hashes

        self.raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b"\n".join(self.raws)
        self.raw = np.frombuffer(raw, "u1")
        hashes, self.starts = word_hashes(raw)
        self.edges = np.cumsum([0, *(len(r) + 1 for r in self.raws)])
        self.bounds = np.searchsorted(self.starts, self.edges)
        n = len(hashes)
        self.sums = []
        for power, _ in _powers(1 << max(12, n.bit_length())):
            self.sums.append(np.concatenate([np.zeros(1, "u8"), np.cumsum(hashes * power[:n], dtype="u8")]))

    def digest(self, which: int, start, stop):
        """64 bits of the runs of words from start to stop, exclusive; which is 0 or 1."""
        import numpy as np

        from lodestar.llm.shingles import mixed

        inverse = _powers(1 << max(12, (len(self.starts)).bit_length()))[which][1]
        total = (self.sums[which][stop] - self.sums[which][start]) * inverse[start]
        return mixed(total + (stop - start).astype("u8") * np.uint64(0xD6E8FEB86659FD93)).view("i8")

    def units(self, least: int):
        """Starts and stops of lines, paragraphs and texts of at least `least` words, each run once, in order."""
        import numpy as np

        n = len(self.starts)
        if not n:
            return np.empty((0, 2), "i8")
        line = np.searchsorted(np.flatnonzero(self.raw == 10), self.starts)
        apart = np.diff(line)
        other = np.zeros(n + 1, bool)
        other[self.bounds] = True
        runs = []
        for gap in (1, 2, None):
            cut = other.copy()
            if gap:
                cut[1:n] |= apart >= gap
            edge = np.flatnonzero(cut)
            runs.append(np.stack([edge[:-1], edge[1:]], 1))
        runs = np.unique(np.concatenate(runs), axis=0)
        return runs[runs[:, 1] - runs[:, 0] >= least]

    def selected(self, least: int):
        """Starts of all passages of `least` words, and the place and hash of the half passage that each selects."""
        import numpy as np

        half = max(1, least // 2)
        wide = least - half + 1
        n = len(self.starts) - half + 1
        if n < wide:
            none = np.empty(0, "i8")
            return none, none, none
        at = np.arange(n)
        grams = self.digest(0, at, at + half)
        least_at = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(1)
        start = np.arange(len(least_at))
        inside = start + least <= self.bounds[np.searchsorted(self.bounds, start, "right")]
        start, chosen = start[inside], (start + least_at)[inside]
        return start, chosen, grams[chosen]


def _grouped(texts: list[str], size: int = 1_000_000):
    """Index ranges of texts that together have about `size` characters."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _lists(counts, struct, names):
    """A list array of structs from columns and the number of rows of each list."""
    import numpy as np
    import pyarrow as pa

    rows = pa.StructArray.from_arrays([pa.array(c) for c in struct], names=names)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("i4")), rows)


def _scan(least: int):
    """doc_id, text_key, words, units and, for passages, the selected half passages (h, at) of each row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in _grouped(texts):
                own = Words(texts[a:b])
                units = own.units(least)
                of = np.searchsorted(own.bounds, units[:, 0], "right") - 1
                order = np.argsort(of, kind="stable")
                units, of = units[order], of[order]
                first = own.bounds[of]
                listed = _lists(
                    np.bincount(of, minlength=b - a),
                    [own.digest(0, units[:, 0], units[:, 1]), own.digest(1, units[:, 0], units[:, 1]), (units[:, 0] - first).astype("i4"), (units[:, 1] - first).astype("i4")],
                    ["h", "g", "start", "stop"],
                )
                _, chosen, hashes = own.selected(least)
                chosen, once = np.unique(chosen, return_index=True)
                of = np.searchsorted(own.bounds, chosen, "right") - 1
                anchors = _lists(np.bincount(of, minlength=b - a), [hashes[once], (chosen - own.bounds[of]).astype("i4")], ["h", "at"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(own.bounds).astype("i4")), listed, anchors],
                    names=["doc_id", "text_key", "words", "units", "anchors"],
                )

    return run


def _passages(least: int):
    """The digests of the passages that select one of the half passages at `wanted`."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                own = Words([batch.column(2)[i].as_py() or ""])
                start, chosen, _ = own.selected(least)
                start = start[np.isin(chosen, np.array(batch.column(3)[i].as_py(), "i8"))]
                for at in range(0, len(start), 10_000):
                    part = start[at : at + 10_000]
                    of = pa.array(np.zeros(len(part), "i4"))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, 1).take(of), batch.column(1).slice(i, 1).take(of), pa.array(own.digest(0, part, part + least)), pa.array(own.digest(1, part, part + least)), pa.array(part.astype("i4"))],
                        names=["doc_id", "text_key", "h", "g", "start"],
                    )

    return run


def _cut(batches):
    """doc_id, text without the words in runs, n_words, removed_words, removed_spans."""
    import numpy as np
    import pyarrow as pa

    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        out: dict = {"text": [], "removed_words": [], "removed_spans": []}
        for text, words, runs in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            text, runs, spans, kept = text.as_py(), runs.as_py(), [], []
            removed = 0
            if runs:
                own = Words([text])
                edge = np.zeros(words.as_py() + 1, "i8")
                np.add.at(edge, [r["start"] for r in runs], 1)
                np.add.at(edge, [r["stop"] for r in runs], -1)
                gone = np.concatenate([[False], np.cumsum(edge) > 0])
                change = np.flatnonzero(gone[1:] != gone[:-1])
                places = np.append(own.starts, len(own.raws[0]))
                points = np.cumsum((own.raw & 0xC0) != 0x80)
                at = 0
                for first, last in zip(change[::2], change[1::2], strict=True):
                    a, b = places[first], places[last]
                    kept.append(own.raws[0][at:a])
                    at, removed = b, removed + int(last - first)
                    spans.append({"start": int(points[a]) - 1, "stop": int(points[b - 1])})
                text = b"".join([*kept, own.raws[0][at:]]).decode("utf-8", "surrogatepass")
            for name, value in zip(out, (text, removed, spans), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out["text"], pa.string()), batch.column(2).cast(pa.int64()), pa.array(out["removed_words"], pa.int64()), pa.array(out["removed_spans"], spans_type)],
            names=["doc_id", "text", "n_words", "removed_words", "removed_spans"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: rows with the same id and text are one document that is listed again."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text_or_empty().cast("binary"))).alias("text_key"), "text")


def _repeats(units: DataFrame, total: int) -> DataFrame:
    """The rows of units (doc_id, text_key, h, g, start, ...) that aren't the first with their digest."""
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), *[F.col(c) for c in (*PLACE, "start")])
    first = units.groupBy("h", "g").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("keep")).where("copies > 1")
    rows = lookup(units, first, ["h", "g"], total)
    return rows.where(~(place.eqNullSafe(F.col("keep"))))


def _here(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left joined with right, which has one row per document, on the document."""
    right = right.withColumnsRenamed({c: f"r_{c}" for c in PLACE})
    return left.join(right, left["doc_id"].eqNullSafe(right["r_doc_id"]) & (left["text_key"] == right["r_text_key"]), how).drop("r_doc_id", "r_text_key")


def repeated_units(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """One row per line, paragraph or text of at least least_words words that occurred before: doc_id, text_key, start, stop (words), copies, keep.

    keep names the first occurrence. The unit that comes first by doc_id (NULL last), text and place is no repeat.
    """
    seen = _keyed(docs).mapInArrow(_scan(least_words), f"doc_id long, text_key binary, words int, units array<{UNIT}>, anchors array<struct<h:bigint,at:int>>").drop("anchors")
    seen = stash(seen, "line-units")
    total = seen.agg(F.sum(F.size("units"))).head()[0] or 0
    return _repeats(_unpacked(seen, "units"), total).select(*PLACE, "start", "stop", "copies", "keep")


def _unpacked(seen: DataFrame, column: str) -> DataFrame:
    return seen.select(*PLACE, F.explode(column).alias("u")).select(*PLACE, "u.*")


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text, n_words, removed_words, removed_spans.

    Every run of least_words words that occurred before, by doc_id and then by
    place, is cut out, each with the white space after it; the first occurrence
    stays. Repeats within one text count too. removed_spans are the cuts in the
    original text, in code points, stop exclusive. Words are runs without ASCII white
    space, A-Z in lower case. NULL text stays NULL, empty text empty.
    A NULL doc_id comes after all others. Rows that repeat a doc_id and text are
    one document and get the same result; of rows with one doc_id and different
    texts each is its own document, ordered by a digest. Other columns are
    ignored; an empty table gives an empty result; texts are read whole.
    """
    keyed = _keyed(docs)
    seen = stash(keyed.mapInArrow(_scan(least_words), f"doc_id long, text_key binary, words int, units array<{UNIT}>, anchors array<struct<h:bigint,at:int>>"), "passage-scan")
    row = seen.agg(F.sum(F.size("units")), F.sum(F.size("anchors"))).head()
    listed = lambda c: F.collect_set(F.struct(*c))
    gone = _repeats(_unpacked(seen, "units"), row[0] or 0).groupBy(*PLACE).agg(listed(["start", "stop"]).alias("gone"))
    gone = stash(gone, "passage-units")

    # half passages that recur, but for those whose passages are all gone with a unit
    lone = F.lit(max(1, least_words // 2) - least_words)
    rest = _here(seen.select(*PLACE, "words", "anchors"), gone, "left")
    ends = F.struct(F.greatest(F.col("a.at") + lone, F.lit(0)).alias("start"), F.least(F.col("a.at") + F.lit(least_words), F.col("words")).alias("stop"))
    rest = rest.select(*PLACE, "words", "gone", F.explode("anchors").alias("a")).withColumn("ends", ends)
    rest = rest.where(F.coalesce(~F.exists("gone", lambda g: (g["start"] <= F.col("ends.start")) & (g["stop"] >= F.col("ends.stop"))), F.lit(True)))
    rest = stash(rest.select(*PLACE, "a.*"), "passage-anchors")
    often = rest.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    wanted = lookup(rest, often, ["h"], rest.count()).groupBy(*PLACE).agg(F.collect_set("at").alias("wanted"))
    passages = _here(keyed, wanted, "inner").select(*PLACE, "text", "wanted").mapInArrow(_passages(least_words), "doc_id long, text_key binary, h long, g long, start int")
    passages = stash(passages, "passages")
    more = _repeats(passages, passages.count()).select(*PLACE, "start", (F.col("start") + F.lit(least_words)).alias("stop"))

    runs = more.unionByName(gone.select(*PLACE, F.explode("gone").alias("u")).select(*PLACE, "u.*")).groupBy(*PLACE).agg(listed(["start", "stop"]).alias("runs"))
    runs = stash(_here(seen.select(*PLACE, "words").distinct(), runs, "left"), "passage-runs")
    discard(seen, gone, rest, passages)
    cut = _here(keyed, runs, "left").select("doc_id", "text", "words", "runs")
    return cut.mapInArrow(_cut, "doc_id long, text string, n_words long, removed_words long, removed_spans array<struct<start:bigint,stop:bigint>>")


def spans_text(spans: Column) -> Column:
    """start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")


def op6_lines(spark, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words and more that came before."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_words", "removed_words", F.size("removed_spans").cast("long").alias("n_removed"), spans_text(F.col("removed_spans")).alias("removed_spans"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS tokens,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), passages AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS passage FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50)
), repeats AS (
  SELECT doc_id, i FROM passages QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM repeats
), t AS (
  SELECT doc_id, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS i, length(text) - len(array_to_string(tokens, '')) AS lead FROM d WHERE len(tokens) > 0
), placed AS (
  SELECT t.*, gone.i IS NOT NULL AS cut, lead + sum(length(token)) OVER (PARTITION BY t.doc_id ORDER BY t.i) AS stop FROM t LEFT JOIN gone USING (doc_id, i)
), runs AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, cut ORDER BY i) AS run FROM placed
), spans AS (
  SELECT doc_id, min(stop - length(token))::BIGINT AS start, max(stop)::BIGINT AS stop FROM runs WHERE cut GROUP BY doc_id, run
), listed AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(start || ':' || stop, ',' ORDER BY start) AS removed_spans FROM spans GROUP BY doc_id
), rest AS (
  SELECT doc_id, count(*) FILTER (WHERE cut) AS removed_words, coalesce(string_agg(token, '' ORDER BY i) FILTER (WHERE NOT cut), '') AS kept, any_value(lead) AS lead FROM placed GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN rest.doc_id IS NULL THEN d.text ELSE substr(d.text, 1, rest.lead::INT) || rest.kept END AS text,
       coalesce(len(d.words), 0)::BIGINT AS n_words, coalesce(rest.removed_words, 0) AS removed_words,
       coalesce(listed.n_removed, 0) AS n_removed, coalesce(listed.removed_spans, '') AS removed_spans
FROM d LEFT JOIN rest USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
