"""Importance resampling, toxicity and hard negatives against brute-force versions; the bounds that hold whatever the rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import exact_dedup, hard_negatives, importance, linear, packing, secrets, toxicity

EXTRA = "rank string, score string, bucket string, weight string, toxicity string, `at` string"


# Importance resampling


def runs_of(text, order):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize(("order", "together"), [(1, 2_000_000), (3, 2_000_000), (3, 7), (2, 40)])
def test_importance_against_brute_force(spark, monkeypatch, order, together):
    rng = random.Random(order)
    pieces = ["The", "cat", "42", "é", "ÄB", "a_b", "\x00", "\n", "—", "中文", "x" * 30, "don't", ""]
    texts = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    texts += [(80, None), (81, ""), (82, "\x00\x7f ..."), (83, "word " * 5000), (5, texts[5][1]), (84, texts[7][1])]
    aim = ["the cat 42", None, "é é", "THE cat"]
    frame = spark.createDataFrame([(*t, *["own"] * 6) for t in texts], f"doc_id long, text string, {EXTRA}").repartition(3)
    monkeypatch.setattr(importance, "TOGETHER", together)
    counted = importance.bucket_counts(frame, order=order, buckets=50, together=together)
    target = importance.bucket_counts(spark.createDataFrame([(t,) for t in aim], "text string"), None, order, 50, together)
    gain = importance.gains(importance.distribution(counted), importance.distribution(target), 50)
    got = importance.drawn(importance.scored(counted, gain), least_words=20, percent=10).collect()

    bucket = lambda g: zlib.crc32(g.encode()) % 50
    s, t = Counter(bucket(g) for _, x in texts for g in runs_of(x, order)[1]), Counter(bucket(g) for x in aim for g in runs_of(x, order)[1])
    wants = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50)))) for b in range(50)]
    assert gain == wants
    rows = []
    for doc_id, text in texts:
        words, grams = runs_of(text, order)
        weight = sum(wants[bucket(g)] for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(words), len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    take = 10 * len(fit) // 100
    assert sorted(tuple(r)[:5] for r in got) == sorted(rows)
    assert sorted((r["rank"], r.doc_id) for r in got if r["rank"] is not None) == [(i + 1, r[0]) for i, r in enumerate(fit[:take])] and take > 2


def test_importance_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, empty).count() == 0
    rows = spark.createDataFrame([(None, "w " * 30), (1, "w " * 30), (1, "w " * 30), (2, None)] + [(i, "w " * 30) for i in range(3, 21)], "doc_id long, text string")
    got = importance.resample(rows, empty, percent=50).collect()
    assert [r.score for r in got if r.doc_id is None] == [None] and all(r["rank"] is None for r in got if r.doc_id in (None, 2))
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11)) and len(got) == 22
    assert len({r.score for r in got if r.doc_id == 1}) == 1


def test_importance_of_long_texts_takes_linear_time():
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    for text in ("word " * 200_000, "x" * 1_000_000, "." * 1_000_000):
        parts = list(importance._pieces(text, pattern, 2, 50_000))
        assert sum(p[2] for p in parts) == len(pattern.findall(text))


# Toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in toxicity.op12_toxicity(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    toxic = [p for p, y in held if y]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(p for p, y in held if not y) <= 0.01 * len(held)


def test_toxicity_features_against_plain_counts():
    rng = random.Random(8)
    texts = ["", " \n", "abc", "idiot idiot IDIOT", "é ß " * 50, *(" ".join(rng.choice(["vile", "word", "ÄÖ", "x", "looong" * 9]) for _ in range(rng.randint(0, 300))) for _ in range(40)), "ab cd " * 60_000]
    got = list(toxicity.features(texts))
    alone = [next(toxicity.features([t])) for t in texts]
    assert all((a == b).all() for a, b in zip(got, alone, strict=True))
    for text, idx in zip(texts, got, strict=True):
        words = text.lower().split()
        line = f" {' '.join(words)} "
        grams = Counter(line[i : i + n] for n in toxicity.ORDERS for i in range(len(line) - n + 1))
        own = idx[idx < 2**toxicity.BITS]
        assert len(own) <= len(grams) and len(own) >= 0.97 * len(grams) - 1 and (np.diff(idx) > 0).all()
        for k, share in enumerate(toxicity.SHARES):
            low = 2**toxicity.BITS + k * 2**toxicity.SHARE_BITS
            want = sum(c > 1 and c * 256 >= share * len(words) for c in grams.values())
            assert abs(int(((idx >= low) & (idx < low + 2**toxicity.SHARE_BITS)).sum()) - want) <= 0.05 * want + 1


def test_toxicity_edges(spark):
    texts = [(i, f"{'you vile vile fool' if i % 3 == 0 else 'a kind word'} number {i}") for i in range(90)] + [(90, None), (91, ""), (None, "vile vile"), (3, "you vile fool")]
    frame = spark.createDataFrame([(*t, "own") for t in texts], "doc_id long, text string, toxicity string").repartition(4)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(None, 1, 1), (90, 1, None), (91, 0, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(frame, labels), toxicity.class_totals(labels))
    rows = toxicity.score(frame, model).collect()
    assert len(rows) == len(texts) and all(r.toxicity == "own" and 0 <= r["toxicity_"] <= 1 for r in rows)
    assert all((r["toxicity_"] >= 0.5) == (r.doc_id % 3 == 0) for r in rows if r.doc_id is not None and r.doc_id < 90)
    weights, bias, slope, offset = model
    for r in rows[:20]:
        idx = next(toxicity.features([r.text or ""]))
        margin = (sum(float(weights[i]) for i in idx) + bias) / max(1.0, len(idx) ** 0.5)
        assert r["toxicity_"] == pytest.approx(1 / (1 + math.exp(-(slope * margin + offset))), abs=1e-6)
    none = toxicity.fit(toxicity.labelled_sample(frame.where("false"), labels.where("false")))
    assert {r["toxicity_"] for r in toxicity.score(frame, none).collect()} == {0.5} and toxicity.score(frame.where("false"), none).count() == 0


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_labelled_sample_bounds_the_joined_rows(spark, label):
    docs = spark.range(20_000).select((F.col("id") % 2 + 1).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = linear.labelled_sample(docs, labels, label, 100)
    assert got.count() <= 100 and got.groupBy(label).count().count() == 2 and got.columns == ["doc_id", "text", label]


# Hard negatives


def brute_negatives(rows, positives=5, negatives=3):
    own = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own[(vec_id, label, tuple(vector))] = [math.floor(256 * x) for x in vector]
    out = []
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(map(lambda x, y: x * y, own[a], own[b]))))
    for a in own:
        if a[0] % 50:
            continue
        others = sorted(((-score(a, b), b[0], b) for b in own if b != a and len(b[2]) == len(a[2])), key=lambda x: x[:2])
        for minus, _, p in [o for o in others if o[2][1] == a[1]][:positives]:
            fits = [o for o in others if o[2][1] != a[1] and -50 * minus <= -100 * o[0] <= -95 * minus][:negatives]
            out += [(a[0], p[0], i + 1, n[2][0], -minus, -n[0]) for i, n in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("tile", "anchors", "hashes"), [(4096, 2048, 16), (20, 4, 3), (64, 2, 1)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, tile, anchors, hashes):
    for name, value in (("VECTORS_PER_TILE", tile), ("ANCHORS_PER_TILE", anchors), ("LABEL_HASHES", hashes), ("LEAF_ANCHORS", 2), ("LEAF_VECTORS", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(tile)
    centres = rng.normal(size=(12, 6))
    # coarse values, so that many scores tie; one label has most rows
    rows = [(i, np.round(centres[i % 12] + rng.normal(size=6) * 0.3, 1).tolist(), int(i % 5) if i % 3 == 0 else 2) for i in range(900)]
    rows += [(950, [1e30, 2.0, 1.0, 1.0, 1.0, 1.0], 1), (951, [1e30, -2.0, 1.0, 1.0, 1.0, 1.0], 1), (952, [6e29, 1.0, 0.0, 0.0, 0.0, 0.0], 3), (953, [-1e-30, 0.0, -0.5, 1.0, 2.0, 3.0], 1)]
    rows += [(1000, [1.0, 2.0], 1), (1001, [1.0, 2.5], 1), (1002, [0.5, 1.0], 2), (1003, [0.9, 1.8], 0)]
    odd = [(1050, None, 1), (1100, [], 1), (1150, [None, 1.0], 1), (1200, [float("nan")] * 6, 2), (1250, [float("inf")] * 6, 2), (1300, rows[0][1], None), (None, rows[0][1], 1)]
    every = rows + odd + [rows[0], rows[50], rows[3]]
    frame = spark.createDataFrame([(*r, "own") for r in every], "vec_id long, embedding array<double>, label int, `row` string").repartition(3)
    got = sorted(map(tuple, hard_negatives.mine(frame, F.col("vec_id") % 50 == 0).collect()))
    want = brute_negatives(every)
    assert got == want and len(want) > 150
    assert hard_negatives.mine(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_dual_trees_prune_groups_and_lose_nothing():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24)) * 100
    rows = np.floor(centres[np.arange(6000) % 60] + rng.normal(size=(6000, 24)) * 5)
    asks = rows[::50]
    exact = asks @ rows.T
    floors = np.partition(exact, -40, 1)[:, -40].astype("f8")
    counts: dict = {}
    found = np.zeros(exact.shape, bool)
    for i, j in hard_negatives.leaf_pairs(hard_negatives.Tree(asks, 8), hard_negatives.Tree(rows, 32), floors, np.full(len(asks), np.inf), counts):
        found[np.ix_(i, j)] = True
    assert (found | (exact < floors[:, None])).all() and counts["scored"] < 0.3 * exact.size


def test_products_are_exact():
    rng = random.Random(2)
    for scale in (10, 2**20, 2**31, 2**40):
        a, b = ([[float(rng.randint(-scale, scale)) for _ in range(7)] for _ in range(5)] for _ in range(2))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
        assert hard_negatives.products(np.array(a), np.array(b)).tolist() == want


# Bounds that hold whatever the rows


def test_exact_dedup_at_the_ends_of_long(spark):
    rows = [(-(2**63), "a b"), (1, "ab"), (2**63 - 1, "a b"), (None, "a b"), (2**63 - 1, "x"), (-(2**63), "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(frame).collect()}
    low, high = -(2**63), 2**63 - 1
    assert got == {(low, low, 4), (1, low, 4), (high, low, 4), (None, low, 4), (high, low, 2), (low, low, 2)}
    weak = exact_dedup.exact_dedup(frame, digest=lambda c: F.lit("same")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in weak} == got
    assert {r.text for r in exact_dedup.drop_copies(frame).collect()} == {"a b", "x"}


def test_repeated_rows_are_packed_in_several_groups(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    rows = packing.pack(docs, pieces_per_group=100).groupBy(F.shiftright("sequence_id", packing.GROUP_BITS).alias("g")).count().collect()
    assert sum(r["count"] for r in rows) == 4000 and max(r["count"] for r in rows) < 200
    long = spark.createDataFrame([(i, "word " * 3000) for i in range(20)], "doc_id long, text string")
    rows = packing.pack(long, sequence=16, pieces_per_group=100).groupBy(F.shiftright("sequence_id", packing.GROUP_BITS).alias("g")).count().collect()
    assert max(r["count"] for r in rows) < 200


def test_findings_of_a_table_train_the_forest(spark):
    known = [(s, b, p, y, a) for s, b, p, y, a in secrets.labelled_findings(400, seed=5)]
    frame = spark.createDataFrame([*known, (None, "", "", 1, ""), ("x", None, None, 0, None), ("y", "", "", 5, ""), known[0]], "span string, before string, path string, label int, after string")
    got = secrets.findings_of(frame)
    assert set(got) == {*known, ("x", "", "", 0, "")} and len(secrets.findings_of(frame, 50)) == 50
    words = frozenset({"tion", "the"})
    assert secrets.fit_forest(got, trees=3, words=words) == secrets.fit_forest(got, trees=3, words=words)


def test_candidates_without_caps():
    name = "n" * 500
    assert secrets.proposed(f"https://a.example/?{name}token=abc#frag") and "abc" in {f"https://a.example/?{name}token=abc#frag"[a:b] for a, b in secrets.proposed(f"https://a.example/?{name}token=abc#frag")}
    block = f"-----BEGIN {'VERY ' * 20}PRIVATE KEY-----\nabc\n-----END {'VERY ' * 20}PRIVATE KEY-----"
    assert (0, len(block)) in secrets.proposed(block)
