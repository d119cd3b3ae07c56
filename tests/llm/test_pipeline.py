"""The corpus pipeline: each stage on edge rows, empty tables and clashing names, and the whole on a table."""

import pytest

import __spark_entry__
import corpus_pipeline

from .test_duplicates import components, shingles


def test_each_stage_keeps_the_columns(spark, edges, no_rows, small):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edges, small)
        assert out.columns == edges.columns
        assert out.count() > 0
        assert stage(spark, no_rows, small).collect() == []
    assert corpus_pipeline.pack(spark, edges, small).count() >= 15


def test_language_stage_rejects_what_is_in_no_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, small).collect()}
    clean = {r.doc_id for r in docs.collect() if r.lang and r.text and any(c.isalpha() for c in r.text)}
    assert len(clean - kept) <= 0.02 * len(clean)


def test_near_duplicate_stage_keeps_one_of_each_group(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sets = {r.doc_id: shingles(r.text, 5) for r in docs.collect()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * (both := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - both)]
    label = components(ids, links)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()} == {i for i in ids if label[i] == i}


def test_a_document_listed_twice_stays_once(spark, small):
    text = " ".join(f"clean{i}" for i in range(60))
    rows = [(1, text, "en", "a", len(text))] * 2 + [(2, "some other words", "en", "a", 16), (None, "no id but words", "en", "b", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages):
        kept = stage(spark, docs, small)
        assert {r.doc_id: r.text for r in kept.collect()}[1] == text
    once = corpus_pipeline.near_duplicates(spark, docs, small)
    assert sorted(r.doc_id or 0 for r in once.collect()) == [0, 1, 2]
    assert {r.text for r in corpus_pipeline.repeated_passages(spark, once, small).collect()} == {text, "some other words", "no id but words"}


def test_whole_pipeline_packs_what_is_left(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and {r.piece for r in rows} >= {0}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(n for _, n in places) <= 2048


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_is_registered(n):
    assert sum(k.startswith(f"op{n}_") for k in __spark_entry__.queries()) == 1
