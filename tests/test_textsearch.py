"""Text search over a small corpus against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.functions import lexical
from lodestar.plans import textsearch

CHUNK = "chunk_id string, document_id string, document_title string, chunk_index int, section string, kind string, text string, indexed_text string, event_id string, source_url string"
QUESTIONS = [
    ("q1", "According to the provided corpus, how many rowing events at the 2000 Summer Olympics had more than 10 competitors?"),
    ("q2", "Which judo event at the 2004 Summer Olympics had the most nations?"),
    ("q3", "Who won gold in the edition before the 2004 single sculls rowing?"),
    ("q4", "Where was the judo heavyweight final held?"),
    ("q5", "how many curling events at the 1998 Winter Olympics had over 3 competitors?"),
    ("q6", ""),
    ("q7", None),
]


def corpus():
    out = []
    for sport, years in (("Rowing", (1996, 2000, 2004)), ("Judo", (2000, 2004)), ("Table tennis", (2000,))):
        for year in years:
            for n, event in enumerate(("Single sculls", "Heavyweight", "Rowing machine")):
                doc = f"{sport[:2]}{year}{n}"
                title = f"{sport} at the {year} Summer Olympics – {event}"
                box = f"[Infobox Olympic event]\n  event: {event}\n  games: {year} Summer\n  coach: nobody\n  competitors: {10 + n}\n  prev: {year - 4}\n  gold: Person {n}"
                out.append((f"{doc}::c000", doc, title, 0, "", "infobox", box, f"{title}\n{box}", doc, None))
                for i in range(1, 5):
                    text = f"The {event.lower()} final number {i} was held in a hall" + (f" at {title}" if i == 2 else "")
                    out.append((f"{doc}::c{i:03d}", doc, title, i, "Final", "section", text, f"{title}\n{text}", doc, None))
    return out


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").casefold())


def planned(question):
    text = re.sub(r"(?i)^\s*according to the provided corpus,?\s*", "", question or "").strip() or (question or "").strip()
    kinds = [("set_count", lexical.SET_COUNT), ("set_extreme", lexical.SET_EXTREME), ("temporal", lexical.TEMPORAL)]
    flag = lambda p: re.compile(re.sub(r"^\(\?[a-zA-Z]+\)", "", p), re.I | re.S)
    intent = next((k for k, p in kinds if flag(p).search(text)), "lookup")
    phrase = flag(dict(kinds)[intent]).search(text)[1] if intent.startswith("set") else ""
    telling = lambda t: [w for w in tokens(t) if w not in lexical.STOP and not w.isdigit()]
    years = [int(y) for y in re.findall(r"\b((?:18|19|20)\d{2})\b", text)]
    seasons = list(dict.fromkeys(s.lower() for s in re.findall(r"(?i)\b(summer|winter)\b", text)))
    sport = telling(phrase) or telling(text)[:4]
    parts = (sport or telling(text)[:6]) + [str(y) for y in years] + seasons + (["olympics"] if {"olympic", "olympics"} & set(tokens(text)) else [])
    tried = [text, " ".join(dict.fromkeys(parts))] + ([" ".join([*sport, str(years[0]), "olympics competitors"])] if sport and years else [])
    variants = []
    for v in tried:
        if v.strip() and v.lower() not in [w.lower() for w in variants]:
            variants.append(v)
    return {"cleaned": text, "intent": intent, "years": years, "seasons": seasons, "sport_tokens": sport, "content_tokens": telling(text), "variants": variants}


def bm25(chunks, text, k):
    bags = {c[0]: Counter(tokens(c[7])) for c in chunks}
    size = {i: max(1, sum(b.values())) for i, b in bags.items()}
    mean = sum(size.values()) / len(size)
    df = Counter(t for b in bags.values() for t in b)
    scores = {}
    for i, bag in bags.items():
        total = sum(math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] * 2.5 / (bag[t] + 1.5 * (0.25 + 0.75 * size[i] / mean)) for t in tokens(text) if t in bag)
        if round(total, 6) > 0:
            scores[i] = round(total, 6)
    return dict(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])


def brute(chunks, question, top_k):
    plan, by_id = planned(question), {c[0]: c for c in chunks}
    sets = plan["intent"].startswith("set")
    scores: dict = {}
    for v in plan["variants"]:
        for i, s in bm25(chunks, v, max(8 * top_k, 80) if sets else max(3 * top_k, 20)).items():
            scores[i] = max(s, scores.get(i, 0))
    first = sorted(scores, key=lambda i: (-scores[i], i))
    boxes = [c for c in chunks if c[5] == "infobox"]
    swept = lambda years, words: [c[0] for c in sorted(boxes, key=lambda c: (c[2], c[0])) if set(words) <= set(tokens(c[2])) and (not years or any(str(y) in c[2] for y in years))][:64]
    order = lambda c: (c[5] != "infobox", c[3], c[0])

    def grown(n):
        docs = dict.fromkeys(by_id[i][1] for i in first[:n])
        return [c[0] for d in docs for c in sorted((c for c in chunks if c[1] == d), key=order)[:3]]

    if sets and plan["years"] and plan["sport_tokens"]:
        taken = swept(plan["years"], plan["sport_tokens"]) or grown(max(top_k, 20))
    else:
        taken = grown(max(2 * top_k, 12))
        if plan["intent"] == "temporal":
            years = [int(y) for i in taken if by_id[i][5] == "infobox" for y in re.findall(r"(?:^|\n)\s*prev:\s*(\d{4})", by_id[i][6]) if re.search(r"\b(previous|prior|before)\b", plan["cleaned"], re.I)]
            if years:
                taken = list(dict.fromkeys(taken + swept(years, plan["sport_tokens"] or plan["content_tokens"][:4])))
    docs: dict = {}
    for i in taken:
        docs.setdefault(by_id[i][1], []).append(by_id[i])
    rank: dict = {}
    for n, i in enumerate(first, 1):
        rank.setdefault(by_id[i][1], n)

    def key(doc):
        own = sorted(docs[doc], key=order)
        text = (own[0][2] + "\n" + " ".join(c[6] for c in own)).lower()
        words, asked = set(tokens(text)), plan["cleaned"].lower()
        cover = 3 * sum(str(y) in text for y in plan["years"]) + 4 * sum(t in words for t in plan["sport_tokens"]) + sum(s in text for s in plan["seasons"])
        cover += sum(t in words for t in tokens(plan["cleaned"]) if t not in ("according", "provided", "corpus"))
        cover += 2 * ("competitors:" in text and any(s in asked for s in ("competitor", "highest", "more than", "most"))) + 2 * ("nations:" in text and "nation" in asked) + 2 * ("gold:" in text and "gold" in asked)
        top, box = max(scores.get(c[0], 0.0) for c in own), any(c[5] == "infobox" for c in own)
        place = rank.get(doc, 10_000)
        return (-cover, -box, -top, place, own[0][2], doc) if sets else (place, -box, -top, -cover, own[0][2], doc)

    ordered = sorted(docs, key=key)
    k = max(top_k, min(64, len(ordered))) if sets else min(top_k + 4, max(top_k, len(ordered))) if plan["intent"] == "temporal" else max(1, top_k)
    hits = [c[0] for d in ordered for c in sorted(docs[d], key=order)[: 1 if sets else 2]]
    return [(i, scores.get(i, 0.0)) for i in hits[:k]]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(corpus(), CHUNK).repartition(3)


def test_plans(spark):
    for row in lexical.plan_queries(spark.createDataFrame(QUESTIONS, "qid string, question string")).collect():
        want = planned(dict(QUESTIONS)[row.qid])
        assert {k: row[k] for k in want} == want, row.qid


@pytest.mark.parametrize("top_k", [3, 10])
def test_search_against_brute_force(spark, chunks, top_k):
    got: dict = {}
    for r in textsearch.search(spark.createDataFrame(QUESTIONS, "qid string, question string"), chunks, top_k).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r["rank"], r.chunk_id, r.score))
    for qid, question in QUESTIONS:
        want = brute(corpus(), question, top_k)
        assert [(i, s) for _, i, s in got.get(qid, [])] == want, qid
        assert [n for n, *_ in got.get(qid, [])] == list(range(1, len(want) + 1))


def test_evidence_text(spark):
    box = "[Infobox Olympic event]\n  event: Sculls  \n  coach: nobody\n\n  gold: Person"
    rows = spark.createDataFrame([(box, "Rowing – Sculls", True), (box, "Rowing", True), ("  text", "Title", False), ("has Title in it ", "Title", False), (None, "Title", False), ("no keys here", None, True)], "text string, title string, compact boolean")
    got = [r.t for r in rows.select(textsearch.evidence_text(F.col("text"), F.col("title"), F.col("compact")).alias("t")).collect()]
    assert got == ["Rowing – Sculls\n[Infobox Olympic event]\n  gold: Person", "Rowing\n[Infobox Olympic event]\n  event: Sculls\n  gold: Person", "Title\n  text", "has Title in it", "Title", "no keys here"]


def test_hybrid_and_mmr(spark, chunks):
    ids = [c[0] for c in corpus()][:20]
    vectors = spark.createDataFrame([(n, i, [1.0, n / 10]) for n, i in enumerate(ids)] + [(99, "missing", [1.0, 0.0])], "vec_id long, chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(-1, "q4", [1.0, 0.0])], "query_id long, qid string, embedding array<double>")
    questions = spark.createDataFrame([QUESTIONS[3]], "qid string, question string")
    sparse = {r.chunk_id: r["rank"] for r in textsearch.search(questions, chunks, 5).collect()}
    close = {r.chunk_id: r["rank"] for r in textsearch.dense(vectors, asked, chunks, 5).collect()}
    assert close == {i: n for n, i in enumerate(ids[:4], 1)}
    want = {i: sum(1 / (60 + r[i]) for r in (sparse, close) if i in r) for i in {*sparse, *close}}
    best = sorted(want, key=lambda i: (-round(want[i], 9), i))[:5]
    both = textsearch.search(questions, chunks, 5, vectors, asked)
    assert [r.chunk_id for r in both.orderBy("rank").collect()] == best
    assert sorted(r["rank"] for r in textsearch.search(questions, chunks, 5, use_mmr=True).collect()) == [1, 2, 3, 4, 5]
