"""The pipeline's stages against brute-force versions on a small corpus."""

import collections
import random

import pytest

from test_text_operators import brute_components, brute_spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(r, n):
    return " ".join("".join(r.choice(("er", "th", "on", "que", "tion", "a")) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(21)
    rows = []
    for i in range(60):
        text = words(r, 120)
        rows.append([i, text, "en", f"s{i % 3}", len(text)])
    for i in range(60, 75):
        v = rows[i - 60][1].split()
        v[3] = "other"
        rows.append([i, " ".join(v), "en", "s1", 0])
    rows.append([80, "Write to me.now@mail.example.com or +1 (555) 555-0123. " + words(r, 90), "en", "s2", 0])
    rows += [[90 + i, " ".join(r.choice(("BUY!!", "NOW###", "$$$", "CHEAP|")) + str(r.randint(0, 99)) for _ in range(90)), "en", "s0", 0] for i in range(12)]
    rows += [[110, None, None, None, None], [111, "", "en", "s0", 0], [112, "short", "en", "s0", 5]]
    place = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(90 + i, 0, 0) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    start = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.quality(spark, docs, corpus)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in start if i < 90}
    single = corpus_pipeline.near_duplicates(spark, kept, corpus)
    want = brute_components([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in want.items() if c == i}
    clean = corpus_pipeline.private(spark, single, corpus)
    for r in clean.collect():
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == start[r.doc_id].text or r.doc_id == 80
    mixed = corpus_pipeline.mixture(spark, clean, corpus)
    assert mixed.columns == docs.columns
    counts = collections.Counter(r.doc_id for r in mixed.collect())
    assert max(counts.values()) <= 3 and abs(sum(len(r.text.split()) for r in mixed.collect()) - sum(len(r.text.split()) for r in clean.collect())) <= 130
    last = corpus_pipeline.pieces(spark, mixed, corpus)
    assert collections.Counter(r.doc_id for r in last.collect()) == counts


def test_whole_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).count() > 30


def test_stages_of_nothing(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0
