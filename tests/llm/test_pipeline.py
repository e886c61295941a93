"""The pipeline's stages against plain Python, with repeated and missing ids, clashing names and empty tables."""

import re
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lodestar.llm import bpe, pii, quality  # noqa: E402
from test_operators import brute_components, shingles  # noqa: E402

CLASH = "kept boolean, locator string, `group` string, __base int, __more int, __spans int, __chars int, quality_score string, removed_spans string"
WIDTH = len(CLASH.split(", "))
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
STORY = " ".join(f"word{i}" for i in range(80))
TEXTS = [
    (1, STORY),
    (5, STORY.replace("word79", "end")),
    (5, "a text of its own with the id five and nothing else in common"),
    (7, "equal rows stay once"),
    (7, "equal rows stay once"),
    (7, "equal  rows stay once"),
    (8, "equalrows stayonce"),
    (None, "no id but a copy"),
    (None, "no id but a  copy"),
    (None, "no id and its own text"),
    (9, None),
    (10, ""),
    (11, "write to joe@example.org or call +49 30 1234567 now"),
    (12, "A b C"),
    (13, "a B c"),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, "en", "s", len(t or ""), True, "own", "own", 1, 2, 3, 4, "own", "own") for i, t in TEXTS]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def exact_by_hand(rows):
    """Of each group of equal texts one row: most code points, then smallest id."""
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(normalised(t), []).append((-len(t or ""), i is None, i or 0, t is None, t or ""))
    return {norm: sorted(g)[0][:3] for norm, g in groups.items()}


def test_exact_stage(spark, docs):
    got = corpus_pipeline.exact_stage(spark, docs, "")
    assert got.columns == docs.columns
    rows = pairs(got)
    want = exact_by_hand(TEXTS)
    assert len(rows) == len(want) and {normalised(t) for _, t in rows} == set(want)
    assert all((-len(t or ""), i is None, i or 0) == want[normalised(t)] for i, t in rows)
    assert got.where("locator != 'own' or __base != 1 or __chars != 4 or quality_score != 'own'").count() == 0


def test_jaccard_stage(spark, docs):
    got = corpus_pipeline.jaccard_stage(spark, docs, "")
    assert got.columns == docs.columns
    # names for rows, since ids repeat
    named = dict(enumerate(TEXTS))
    joined = brute_components([(n, t) for n, (i, t) in named.items() if i is not None])
    groups: dict = {}
    for n, (_, component) in joined.items():
        if shingles(named[n][1]):
            groups.setdefault(component, []).append(named[n])
    rows = pairs(got)
    free = [r for r in TEXTS if r[0] is None or not shingles(r[1])]
    assert len(rows) == len(groups) + len(free)
    for own in groups.values():
        least = min(i for i, _ in own)
        assert sum((i, t) in rows for i, t in {r for r in own if r[0] == least}) == 1
        assert not [r for r in own if r[0] != least and r in rows]
    assert all(r in rows for r in free)


def test_pii_stage(spark, docs):
    got = corpus_pipeline.pii_stage(spark, docs, "")
    assert got.columns == docs.columns and got.count() == len(TEXTS)
    row = got.where("doc_id = 11").head()
    assert row.text == "write to [EMAIL] or call [PHONE] now" and row.n_chars == len(row.text)
    assert got.where("__base != 1 or __more != 2 or __spans != 3 or __chars != 4").count() == 0
    assert [r for r in pairs(got) if r[0] != 11] == sorted((r for r in TEXTS if r[0] != 11), key=repr)


def test_quality_stage(spark, docs, tmp_path):
    labels = [(i, int(i in (1, 5, 7)), 0) for i in (1, 5, 7, 8, 9, 10, 11, 12, 13)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    model = quality.fit(quality.labelled_sample(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))))
    weights, bias, slope, offset = model
    want = []
    for i, t in TEXTS:
        own = quality.indicators(t or "")
        margin = (sum(float(weights[k]) for k in own) + bias) / max(1.0, len(own) ** 0.5)
        if 1 / (1 + 2.718281828459045 ** -(slope * margin + offset)) >= quality.THRESHOLD:
            want.append((i, t))
    assert got.columns == docs.columns and pairs(got) == sorted(want, key=repr)


def test_whole_pipeline(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()  # one class of labels: all documents have its share
    kept = corpus_pipeline.jaccard_stage(spark, corpus_pipeline.exact_stage(spark, docs, ""), "")
    final = pairs(pii.redact(kept, pii.fit(kept)))
    encoder = bpe.Encoder(bpe.default_vocabulary())
    want = sorted(((i, zlib.crc32(encoder.encode(t or "") + (2).to_bytes(4, "little"))) for i, t in final), key=repr)
    assert sorted(((r.doc_id, r.ids_crc32) for r in rows), key=repr) == want


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.jaccard_stage, corpus_pipeline.pii_stage, corpus_pipeline.packing_stage):
        assert stage(spark, none, "").count() == 0
