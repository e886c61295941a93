"""Personal data: overlapping candidate spans, boosted trees, calibrated redactions.

Base spans come from four fixed patterns. High-recall generators propose
further spans that may overlap these and each other. Format and context
features of every candidate are booleans and small levels, so a corpus has a
bounded number of feature patterns, whatever its size: one aggregation counts
the patterns over all documents, and gradient boosting fits depth-two trees to
those counts. Base spans can't confirm what lies outside them, so labels come from
seeded sentences, and from documents where base spans settle what a candidate is.
A held-out fold calibrates a threshold for each kind of candidate. The trees are
applied as one SQL expression.

Everything over documents is DataFrame and SQL expressions inside the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bucket_of, columns_of, free_name, table, text_or_empty

# The kinds in the order in which spans with one start are listed.
KINDS = ["email", "ip", "card", "phone"]

# The base patterns. A possessive quantifier stands where the greedy one can never give back,
# and a look-behind skips starts inside a run whose first character has failed already.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# What the generators propose, and the kind that an accepted span of each gets.
GENERATORS = {
    "digits": ("phone", r"(?<![0-9A-Za-z])[(+]?[0-9][0-9\x20().+/-]{7,40}[0-9](?![0-9A-Za-z])"),
    "address": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,64}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,64}+){1,8}"),
    "quad": ("ip", r"(?<![0-9.])[0-9]{1,3}(?:[.,]\x20?[0-9]{1,3}){3}(?![0-9])"),
}
# Four numbers, whatever parts them.
QUAD = r"^[0-9]{1,3}(?:[.,]\x20?[0-9]{1,3}){3}$"

# Words near a span that name what it is.
CONTEXT_WORDS = r"(?i)\b(?:phone|tel|call|mobile|fax|card|visa|mail|email|contact|ip|host|address|reach|write)\b"

# Words right before a number that is called.
CALLED_WORDS = r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell|reach)\b[^0-9]{0,12}$"

# Words right before an address of a machine.
HOST_WORDS = r"(?i)\b(?:ip|ips|host|hosts|server|address|addr|gateway|dns|ping|subnet)\b[^0-9]{0,12}$"

SEED, SEEDED = 3, 14_000

# What any match of a pattern holds. A text without it is not searched further.
NEEDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": "[0-9]",
    "phone": r"\+[0-9]",
    "digits": "[0-9]",
    "address": r"@|\(at\)|\[at\]",
    "quad": "[0-9][.,]",
}

CONTEXT_CHARS = 24
CHUNK = 256
SPAN_TYPE = "array<struct<start:int,stop:int,span:string,before:string,after:string>>"
REDACTION = "[{}]"


def _spans(text: Column, name: str) -> Column:
    """Leftmost matches that don't overlap: array of (start, stop, span, before, after); code points, stop exclusive."""
    pattern = BASE[name] if name in BASE else GENERATORS[name][1]
    return F.when(text.rlike(NEEDS[name]), _search(text, pattern)).otherwise(F.expr(f"cast(array() as {SPAN_TYPE})"))


def _let(value: Column, body) -> Column:
    """body over value, which is computed once: a lambda's variable is not computed again where the lambda uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _search(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(F.split(text, pattern, -1), lambda gaps: _let(F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), lambda pairs: _offsets(pairs, gaps)))


def _offsets(pairs: Column, gaps: Column) -> Column:
    """Offsets are running sums; by chunks, so that the work doesn't grow with the square of the number of matches."""

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["g"])
        stop = start + F.char_length(pair["m"])
        row = F.struct(start.alias("start"), stop.alias("stop"), pair["m"].alias("span"), F.right(pair["g"], F.lit(CONTEXT_CHARS)).alias("before"))
        return F.when(pair["m"].isNull(), acc).otherwise(F.struct(stop.alias("at"), F.concat(acc["out"], F.array(row)).alias("out")))

    none = F.expr("cast(array() as array<struct<start:int,stop:int,span:string,before:string>>)")
    count = F.greatest(F.ceil(F.size(pairs) / CHUNK).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(pairs, (i - 1) * CHUNK + 1, F.lit(CHUNK)))

    def walked(chunks: Column) -> Column:
        lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, p: acc + F.coalesce(F.char_length(p["g"]) + F.char_length(p["m"]), F.lit(0))))
        firsts = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        own = F.zip_with(chunks, F.slice(firsts, F.lit(1), count), lambda c, first: F.aggregate(c, F.struct(first.alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
        return F.transform(F.flatten(own), lambda s, i: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["span"].alias("span"), s["before"].alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT_CHARS)).alias("after")))

    return _let(cut, walked)


def luhn(digits: Column) -> Column:
    """Luhn's check over a string of 1 to 19 digits."""
    turned = F.reverse(digits)

    def worth(acc: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), worth) % 10 == 0


def _only_digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _valid(kind: str, span: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda p: F.char_length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 4).try_cast("int"), F.lit(0)) <= 255))
    digits = _only_digits(span)
    n = F.char_length(digits)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False))
    return n.between(9, 15)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, stop) of all base spans, kind as its place in KINDS."""
    each = []
    for place, kind in enumerate(KINDS):
        each.append(_plain(F.filter(_spans(text, kind), _validator(kind)), place))
    return F.array_sort(F.concat(*each))


def _validator(kind: str):
    return lambda s: _valid(kind, s["span"])


def _plain(spans: Column, place: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("kind"), s["stop"].alias("stop")))


def _with_features(text: Column, generator: str) -> Column:
    """Proposed spans: array of (start, kind, stop, f)."""
    place = F.lit(KINDS.index(GENERATORS[generator][0]))
    return F.transform(_spans(text, generator), lambda s: F.struct(s["start"].alias("start"), place.alias("kind"), s["stop"].alias("stop"), _features(generator, s).alias("f")))


def _features(generator: str, s: Column) -> Column:
    """Struct of the format and context features of a candidate; every field has few values."""
    digits = _only_digits(s["span"])
    n = F.char_length(digits)
    marks = F.regexp_replace(s["span"], "[0-9A-Za-z]", "")
    level = F.when(n < 7, 0).when(n < 9, 1).when(n < 12, 2).when(n < 16, 3).when(n == 16, 4).when(n <= 19, 5).otherwise(6)
    return F.struct(
        F.lit(generator).alias("generator"),
        level.alias("digits"),
        s["span"].startswith("+").alias("plus"),
        (F.char_length(marks) > 0).alias("marked"),
        s["span"].rlike(r"\((?:at|dot)\)|\[(?:at|dot)\]").alias("spelled"),
        s["span"].contains(" ").alias("spaced"),
        s["span"].rlike(r"^(?:[0-9]{4}[\x20-]){2,4}[0-9]{1,4}$").alias("fours"),
        s["before"].rlike(CONTEXT_WORDS).alias("named"),
        s["before"].rlike(CALLED_WORDS).alias("called"),
        s["before"].rlike(r"[=:\"'#]\x20?$").alias("assigned"),
        s["after"].rlike(r"^[\x20.,;)]?\x20|^[\x20.,;)\n]?$").alias("closed"),
        s["before"].rlike(HOST_WORDS).alias("hosted"),
        (s["span"].rlike(QUAD) & F.forall(F.regexp_extract_all(s["span"], F.lit("[0-9]+"), F.lit(0)), lambda p: p.try_cast("int") <= 255)).alias("octets"),
    )


FEATURES = ["digits", "plus", "marked", "spelled", "spaced", "fours", "named", "called", "assigned", "closed", "hosted", "octets"]
SPLITS = [(f, 1) for f in FEATURES if f != "digits"] + [("digits", v) for v in range(1, 7)]


def labelled_sentences(count: int = SEEDED, seed: int = SEED) -> list[tuple[int, str, int, int]]:
    """Seeded (id, text, start, stop): personal data without a base pattern's sign at start to stop, or look-alikes, 0 to 0."""
    import random

    rng = random.Random(seed)
    plain = ["then", "the", "was", "in", "about", "see", "page", "and", "from", "number", "total", "order", "room", "since"]
    called = ["phone", "tel", "tel:", "call", "mobile", "fax", "Phone:", "call me on", "call my phone", "reach us at", "fax no."]
    phones = ["0## ########", "(0##) ####-####", "###-###-####", "(###) ###-####", "01##/#######", "00## ## #######", "## ## #######", "0## ### ## ##", "### ### ####", "0##########", "00## (0) ## #######"]
    numbers = ["20##-0#-1# 1#", "19##-19##", "19##-19## 20##-20##", "################", "#### #### #### ####", "# ### ### ###", "### ### ###", "########.##", "978-#-##-######-#", "20##-######", "##.######", "###.###.###.3##", "3##.##.#.##", "#,###,###,###", "##, ##, ##, ##", "1#.2#.300.4", "#########", "############", "20##0#1#-1#####", "#####-####", "#### - ####", "##/##/20## ##", "##-##-20## 1#-##"]
    kinds = ["card", "visa", "ip", "host", "address", "card number", "visa:", "ip =", "order", "id=", "isbn", "invoice #"]
    fill = lambda shape: "".join(rng.choice("123456789") if c == "#" else c for c in shape)
    word = lambda: "".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 9)))
    hosts = ["ip", "ip:", "host", "server", "the address", "gateway", "dns", "ping", "IP address", "server at"]
    four = lambda most: rng.choice([", ", ",", ". "]).join(str(rng.randint(0, most)) for _ in range(4))
    out = []
    for i in range(count):
        start, good = f"{word()} {rng.choice(plain)} ", True
        kind = rng.randrange(7)
        if kind < 2:
            start, span = start + rng.choice(called) + " ", fill(rng.choice(phones))
        elif kind == 2:
            dot, at = rng.choice([(" (dot) ", " (at) "), (".", " (at) "), ("[dot]", "[at]"), (".", "[at]"), (".", "(at)")])
            start, span = start + rng.choice(["", "mail ", "contact: ", "write to "]), f"{word()}{rng.choice(['', '.' + word()])}{at}{word()}{dot}{rng.choice(['org', 'com', 'de'])}"
        elif kind == 3:
            start, good, span = start + rng.choice(kinds) + " ", False, fill(rng.choice(numbers))
        elif kind == 4:
            good, span = False, fill(rng.choice(numbers + [f"# @ #.## {word()}", f"{word()} @ {word()}. {word()}"]))
        elif kind == 5:
            good, span = rng.random() < 0.2, fill(rng.choice(phones))
        elif rng.random() < 0.5:
            start, span = start + rng.choice(hosts) + " ", four(255)
        else:
            start, good, span = start + rng.choice([*plain, *hosts[:4]]) + " ", False, four(rng.choice([255, 999]))
            good = start.rstrip().rsplit(maxsplit=1)[-1] in hosts and all(int(n) <= 255 for n in span.replace(",", " ").replace(".", " ").split())
        end = rng.choice([" now", ".", ", ", ") ", "", " " + word()])
        out.append((i, start + span + end, len(start) if good else 0, len(start) + len(span) if good else 0))
    return out


def candidates(docs: DataFrame, known: Column | None = None) -> DataFrame:
    """One row per proposed span: doc_id, start, stop, kind, features, label: whether known spans (base ones if None) of its kind overlap it, and settled: whether that is sure.

    What only base spans could confirm is not settled as wrong: unless they show that a candidate is of another kind,
    or an address in four numbers that isn't valid. Nor is it settled as right, since find_pii adds nothing over base spans.
    """
    text = text_or_empty()
    proposed = [_with_features(text, g) for g in GENERATORS]
    rows = docs.select("doc_id", F.concat(*proposed).alias("c"), (base_spans(text) if known is None else known).alias("base")).where(F.size("c") > 0)
    rows = rows.select("doc_id", "base", F.explode("c").alias("c"))
    over = lambda b: (b["start"] < F.col("c.stop")) & (b["stop"] > F.col("c.start"))
    own = F.exists("base", lambda b: over(b) & (b["kind"] == F.col("c.kind")))
    settled = F.lit(True) if known is not None else ~own & (F.exists("base", over) | ((F.col("c.f.generator") == "quad") & ~F.col("c.f.octets")))
    return rows.select("doc_id", "c.start", "c.stop", "c.kind", "c.f.*", own.alias("label"), settled.alias("settled"))


def seeded_candidates(spark) -> DataFrame:
    """candidates of labelled_sentences."""
    import pyarrow as pa

    columns = zip(*labelled_sentences(), strict=True)
    frame = spark.createDataFrame(pa.table(dict(zip(("doc_id", "text", "first", "last"), columns, strict=True))))
    known = {k: F.struct(F.col("first").alias("start"), F.lit(KINDS.index(k)).alias("kind"), F.col("last").alias("stop")) for k in KINDS}
    spelled, quad = F.col("text").rlike(r"\(at\)|\[at\]"), F.substring("text", F.col("first") + 1, F.col("last") - F.col("first")).rlike(QUAD)
    return candidates(frame, F.array(F.when(spelled, known["email"]).when(quad, known["ip"]).otherwise(known["phone"])))


@dataclass
class Tree:
    """Depth two: a split, and a split and two values on either side."""

    split: tuple[str, int]
    sides: list = field(default_factory=list)  # for false and true: (split, value if false, value if true)

    def value(self, row: dict) -> float:
        inner, low, high = self.sides[int(row[self.split[0]]) >= self.split[1]]
        return high if int(row[inner[0]]) >= inner[1] else low

    def column(self, f: Column) -> Column:
        """The tree over the fields of a struct."""
        test = lambda split: f[split[0]].cast("int") >= split[1]
        leaf = lambda side: F.when(test(side[0]), F.lit(side[2])).otherwise(F.lit(side[1]))
        return F.when(test(self.split), leaf(self.sides[1])).otherwise(leaf(self.sides[0]))


def boost(rows: list[dict], rounds: int = 20, rate: float = 0.3, l2: float = 1.0) -> tuple[float, list[Tree]]:
    """Gradient boosting with logistic loss on weighted rows: features, n (weight) and pos (weight of label 1)."""
    total, pos = sum(r["n"] for r in rows), sum(r["pos"] for r in rows)
    prior = math.log((pos + 1) / (total - pos + 1))
    scores, trees = [prior] * len(rows), []

    def best(ids: list[int], g: list[float], h: list[float]) -> tuple[float, tuple[str, int], float, float]:
        top = (-1.0, SPLITS[0], 0.0, 0.0)
        for f, v in SPLITS:
            g1 = h1 = g0 = h0 = 0.0
            for i in ids:
                if int(rows[i][f]) >= v:
                    g1, h1 = g1 + g[i], h1 + h[i]
                else:
                    g0, h0 = g0 + g[i], h0 + h[i]
            gain = g1 * g1 / (h1 + l2) + g0 * g0 / (h0 + l2)
            if gain > top[0]:
                top = (gain, (f, v), rate * g0 / (h0 + l2), rate * g1 / (h1 + l2))
        return top

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        g = [r["pos"] - r["n"] * q for r, q in zip(rows, p, strict=True)]
        h = [r["n"] * q * (1 - q) for r, q in zip(rows, p, strict=True)]
        options = []
        for f, v in SPLITS:
            sides = [[i for i, r in enumerate(rows) if (int(r[f]) >= v) == side] for side in (False, True)]
            found = [best(ids, g, h) for ids in sides]
            options.append((sum(x[0] for x in found), (f, v), found))
        _, split, found = max(options, key=lambda o: o[0])
        tree = Tree(split, [x[1:] for x in found])
        trees.append(tree)
        scores = [s + tree.value(r) for s, r in zip(scores, rows, strict=True)]
    return prior, trees


def calibrated(rows: list[dict], precision: float) -> float:
    """The lowest score at which the held-out precision, as Wilson's lower bound, reaches `precision`; 2 if none does."""
    chosen, n, pos = 2.0, 0.0, 0.0
    for r in sorted(rows, key=lambda r: -r["score"]):
        n, pos = n + r["n"], pos + r["pos"]
        z, q = 1.96, pos / n
        low = (q + z * z / (2 * n) - z * math.sqrt(q * (1 - q) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if low >= precision:
            chosen = r["score"]
    return chosen


@dataclass
class Model:
    prior: float
    trees: list
    thresholds: dict

    def score(self, f: Column) -> Column:
        """Between 0 and 1, over a struct of features."""
        total = F.lit(self.prior)
        for tree in self.trees:
            total = total + tree.column(f)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, precision: float = 0.98) -> Model:
    """Fit to the feature patterns of seeded sentences and of all documents' settled candidates; a fifth of either, by id, calibrates the thresholds.

    The tables that reach the driver have a row per feature pattern and fold: at
    most 3 x 7 x 2^11 x 2, whatever the corpus.
    """
    held = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False))
    rows = []
    for found in (candidates(docs), seeded_candidates(docs.sparkSession)):
        patterns = found.where("settled").groupBy("generator", *FEATURES, held.alias("held")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))
        rows += [r.asDict() for r in patterns.collect()]
    rows.sort(key=lambda r: tuple(str(r[k]) for k in ("generator", *FEATURES)))
    train, test = [r for r in rows if not r["held"]], [r for r in rows if r["held"]]
    prior, trees = boost(train) if train else (-9.0, [])
    for r in test:
        r["score"] = 1 / (1 + math.exp(-(prior + sum(t.value(r) for t in trees))))
    return Model(prior, trees, {g: calibrated([r for r in test if r["generator"] == g], precision) for g in GENERATORS})


def find_pii(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __base and __spans: sorted arrays of (start, kind, stop), kind as its place in KINDS.

    spans holds all base spans and the candidates whose score reaches the
    threshold of their generator and that overlap no base span; of such
    candidates that overlap each other the earliest, then longest, stays. NULL
    text is empty and has no spans. Rows are independent: repeated rows give
    repeated results, an empty table stays empty. Other columns are kept; where
    one has an added column's name, underscores follow the added one (span_columns).
    """
    text = text_or_empty()
    reached = lambda g: lambda c: model.score(c["f"]) >= F.lit(model.thresholds[g])
    proposed = [_plain(F.filter(_with_features(text, g), reached(g)), KINDS.index(GENERATORS[g][0])) for g in GENERATORS if model.thresholds[g] <= 1]
    none = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)")
    base, spans = span_columns(docs)
    more = free_name("__more", docs)
    out = docs.select("*", base_spans(text).alias(base), F.array_sort(F.concat(none, *proposed)).alias(more))
    free = F.filter(more, lambda c: ~F.exists(base, lambda b: (b["start"] < c["stop"]) & (b["stop"] > c["start"])))
    apart = F.aggregate(free, none, lambda acc, c: F.when((F.size(acc) == 0) | (F.coalesce(F.try_element_at(acc, F.lit(-1))["stop"], F.lit(0)) <= c["start"]), F.concat(acc, F.array(c))).otherwise(acc))
    return out.select(*columns_of(docs), base, F.array_sort(F.concat(base, apart)).alias(spans))


def span_columns(docs: DataFrame) -> tuple[str, str]:
    """The names that find_pii gives its columns: __base and __spans, or, where docs has these, with underscores after them."""
    return free_name("__base", docs), free_name("__spans", docs)


def _listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; overlapping spans are replaced together.

    The text is cut between spans, so every character outside them stays.
    Texts without spans, NULL ones too, stay as they are.
    """
    found, spans = find_pii(docs, model), span_columns(docs)[1]
    kinds = F.array(*[F.lit(REDACTION.format(k.upper())) for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(gap, F.get(kinds, s["kind"])))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.lit(2**31 - 1))))
    text = F.when(F.size(spans) > 0, done).otherwise(F.col("text"))
    return found.withColumn("text", text).select(columns_of(docs))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of every whole text of documents; the counts and the digest are those of base spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit(docs))
    count = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_listed(F.col("__base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("__spans")).alias("spans"), F.size("__spans").cast("long").alias("n_spans"))
