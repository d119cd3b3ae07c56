"""Language, quality, nearest neighbours and mixing: held-out accuracy, recall against brute force, and SQL."""

import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from ticklattice.llm import ann, language_crf, mixing, quality_nbsvm

from .conftest import SCHEMA

TABLES = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    truth = {r.doc_id: r for r in docs.collect()}
    got = language_crf.op_query(spark, docs).collect()
    assert len(got) == len(truth)
    known = [r for r in got if r.held_out and truth[r.doc_id].lang and r.lang_pred != "und"]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in known]) > 0.95
    other = language_crf.op_query(spark, docs.withColumn("source", F.lit("x")).withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2, F.col("lang"))))
    assert {r.doc_id: r.lang_pred for r in other.collect()} == {r.doc_id: r.lang_pred for r in got}


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    e, move, first = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    weight = {p: np.exp(first[p[0]] + sum(e[t, p[t]] for t in range(4)) + sum(move[p[t - 1], p[t]] for t in range(1, 4))) for p in product(range(3), repeat=4)}
    total = sum(weight.values())
    want = np.array([[sum(w for p, w in weight.items() if p[t] == k) / total for k in range(3)] for t in range(4)])
    post, pairs, begins = language_crf.posteriors(e, np.zeros(4, int), np.arange(4), np.array([4]), move, first)
    assert np.allclose(post, want) and np.allclose(begins, want[0]) and np.isclose(pairs.sum(), 3)


def test_language_edges(spark, edges, no_rows):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_crf.op_query(spark, edges).collect()}
    assert len(got) == 14 and all(got[i] == ("und", 0.0) for i in (3, 4, 5, 9))
    unknown = language_crf.op_query(spark, edges.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(unknown) == 15 and {r.lang_pred for r in unknown} == {"und"}
    assert language_crf.op_query(spark, no_rows).count() == 0


def test_quality_of_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_nbsvm.op_query(spark, docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (fold(r.doc_id, 5) == 0) for r in got)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.8


def test_quality_edges(spark, edges, no_rows):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (2, 1, "x"), (3, None, "x"), (None, 1, "x"), (99, 0, "x")], "doc_id long, quality int, text string")
    assert len(quality_nbsvm.op_query(spark, edges, labels).collect()) == 15
    assert {r.score for r in quality_nbsvm.op_query(spark, edges, labels.limit(0)).collect()} == {0.5}
    assert quality_nbsvm.op_query(spark, no_rows, labels).count() == 0


def brute_neighbours(rows, k=20):
    good = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in (i for i in good if i % 20 == 0):
        scored = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def test_neighbours_recall_and_exact_scores(spark):
    vectors = spark.read.parquet(f"{TABLES}/embeddings.parquet")
    want = brute_neighbours([(r.vec_id, r.embedding) for r in vectors.collect()])
    got = {}
    for r in sorted(ann.op_query(spark, vectors).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9
    assert all(got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) for q in got)
    exact = {q: dict(brute_neighbours([(r.vec_id, r.embedding) for r in vectors.collect()], 10**9)[q]) for q in list(want)[:3]}
    assert all(np.isclose(s, exact[q][i], rtol=1e-12) for q in exact for i, s in got[q])


def test_neighbours_in_hot_groups_of_copies(spark):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    spread, centre, copied = unit(rng.normal(size=(1500, 32))), unit(rng.normal(size=32)), unit(rng.normal(size=32))
    near = unit(centre + 0.2 / np.sqrt(32) * rng.normal(size=(1500, 32)))
    x = np.concatenate([spread, near, np.tile(copied, (1500, 1))])[rng.permutation(4500)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[21].tolist())] * 25 + [(21, x[21].tolist())] * 3 + [(None, x[40].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.op_query(spark, vectors).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(-1 if r.vec_id is None else r.vec_id)
    ids, every, recall = np.array([-1 if i is None else i for i, _ in rows]), np.array([v for _, v in rows]), {}
    for q in (q for q in range(0, 4500, 20) if q != 20):  # vec_id 20 has two vectors
        score = np.round(every @ x[q], 12)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        kind = "copies" if np.allclose(x[q], copied) else "near" if x[q] @ centre > 0.8 else "spread"
        want, found = ids[order].tolist(), got[q]
        recall.setdefault(kind, []).append(sum(min(want.count(i), found.count(i)) for i in set(want)) / 20)
        assert len(found) == 20 and q not in found
    assert min(recall["copies"]) == 1 and np.mean(recall["near"]) >= 0.95 and np.mean(recall["spread"]) >= 0.9


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [None, 1.0]), (80, [2.0, 0.0])]
    v = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.op_query(spark, v).collect())
    assert got == [(0, 1, 80, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (80, 1, 0, 2.0), (80, 2, 1, 2.0), (80, 3, 2, 2.0)]
    assert ann.op_query(spark, v.limit(0)).count() == 0


def test_mixing_equals_its_sql_on_edges(spark, edges, no_rows, tmp_path):
    edges.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.execute(f"select doc_id, size, source_size, target, taken from ({mixing.SQL})").fetchall()
    got = [tuple(r) for r in mixing.op_query(spark, edges).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(0 <= r[4] <= 2 * r[1] for r in got)
    assert mixing.op_query(spark, no_rows).count() == 0


def test_mixing_meets_targets_with_one_huge_source(spark):
    rows = [(i, "w " * (i % 7 + 1), None, "hot" if i % 3 else f"s{i % 9}", 1) for i in range(3000)]
    got = mixing.op_query(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    by, sizes = {}, {}
    for r in got:
        by[r.target] = by.get(r.target, 0) + r.taken
        sizes[r.target] = r.source_size
    assert all(abs(t - n) < 1.001 for t, n in by.items()) and all(t <= 2 * n for t, n in sizes.items())
    assert abs(sum(by) - 1.5 * sum(r.size for r in got)) < 1e-6 * len(got)


def test_word_spans_of_switched_text(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    model = language_crf.fit(docs.select("doc_id", "text", "lang"))
    by = {}
    for r in docs.where("lang is not null and length(text) between 300 and 3000").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(" ".join(r.text.split()[:30]))
    names, right, total = sorted(by), 0, 0
    mixed = [[(lang, by[lang][i]) for lang in names[:3]] for i in range(10)]
    rows = [(i, " ".join(t for _, t in parts), "x") for i, parts in enumerate(mixed)] + [(90, None, "x"), (91, " 12 ", "x")]
    t = spark.createDataFrame(rows, "doc_id long, text string, spans string").drop("spans")
    got = {r.doc_id: r.spans for r in language_crf.spans(t, model, "doc_id").collect()}
    assert got[90] == got[91] == []
    for i, parts in enumerate(mixed):
        text, at = rows[i][1], 0
        assert all(0 <= s.begin < s.end <= len(text) for s in got[i]) and all(a.end <= b.begin and a.lang != b.lang for a, b in zip(got[i], got[i][1:]))
        for lang, part in parts:
            for k in range(at, at + len(part)):
                if text[k].isalpha():
                    total += 1
                    right += any(s.begin <= k < s.end and s.lang == lang for s in got[i])
            at += len(part) + 1
    assert right / total > 0.9
    sure = {r.doc_id: (r.score, r.certainty) for r in language_crf.identify(t, model, "doc_id").collect()}
    assert all(sure[i][0] < 0.6 and sure[i][1] > 0.8 for i in range(10)) and sure[90] == sure[91] == (0.0, 0.0)


def test_log_ratios_equal_counts():
    rows = [np.array(x, np.int32) for x in ([1, 2], [2, 3], [2], [3])]
    got = quality_nbsvm.log_ratios(rows, np.array([1, 1, 0, 0]))
    for j, (p, n) in {1: (1, 0), 2: (2, 1), 3: (1, 1), 9: (0, 0)}.items():
        assert np.isclose(got[j], np.log((1 + p) / 4) - np.log((1 + n) / 4))


def test_dual_descent_solves_its_problem():
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(12, rng.integers(1, 8), replace=False)).astype(np.int32) for _ in range(40)]
    y, ratio = rng.integers(0, 2, 40), rng.normal(size=12)
    w, bias = quality_nbsvm.dual_descent(rows, y, ratio, epochs=400)
    x = np.zeros((40, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
    x[:, 12] = 1
    s = np.where(y == 1, 1.0, -1.0)
    value = lambda v: v @ v / 2 + np.maximum(0, 1 - s * (x @ v)).sum()
    q, a = (x * s[:, None]) @ (x * s[:, None]).T, np.zeros(40)  # the dual by projected gradients
    for _ in range(20000):
        a = np.clip(a - (q @ a - 1) / np.linalg.norm(q, 2), 0, 1)
    best = value((a * s) @ x)
    assert np.isclose(value(np.append(w, bias)), best, rtol=1e-4)


def test_indicators_equal_sets_of_n_grams():
    get, text = quality_nbsvm.Indicators(), b"abcabcd"
    grams = {text[i : i + n] for n in range(1, 5) for i in range(len(text) - n + 1)}
    assert len(get(text)) == len(grams) and set(get(b"abc")) < set(get(text)) and len(get(b"")) == 0


def test_neighbours_of_equal_vectors_go_by_id(spark):
    rng = np.random.default_rng(6)
    other = rng.normal(size=(300, 16))
    rows = [(i, [1.0] * 16) for i in range(0, 1001)] + [(2001 + i, (0.2 * v).tolist()) for i, v in enumerate(other)]
    got = sorted((r.rank, r.vec_id) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect())
    assert got == [(i, i) for i in range(1, 21)]


def test_neighbours_of_twenty_thousand_vectors(spark):
    """Recall at a size where lists are many and most are not probed, on spread and on clustered vectors."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centres = unit(rng.normal(size=(300, 32)))
    x = np.concatenate([unit(rng.normal(size=(6000, 32))), unit(centres[rng.integers(0, 300, 14000)] + 0.05 * rng.normal(size=(14000, 32)))])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    found = {}
    for r in ann.search(vectors, F.col("vec_id") % 40 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in range(0, 20000, 40):
        score = x @ x[q]
        score[q] = -9
        recall.append(len(found[q] & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.95 and np.mean(recall[:150]) >= 0.9
    index = ann.Index(x[rng.choice(20000, 5000, replace=False)], lists=141)
    assert index.probes < 141
