"""Near-duplicate documents and vectors, repeated substrings: against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from ticklattice.llm import minhash, substring_dedup, vector_dedup


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_minhash_finds_all_links(spark, small, words, percent):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sets = {r.doc_id: shingles(r.text, words) for r in docs.collect()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * (both := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - both)]
    label = components(ids, links)
    assert links
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, words, percent).collect()}
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i in ids}


def test_minhash_at_the_threshold_and_in_one_hot_group(spark):
    base = [f"w{i}" for i in range(19)]
    rows = [(i, " ".join([*base, f"tail{i % 3}"])) for i in range(300)] + [(1000, " ".join(base)), (1001, "other words here altogether"), (1002, None), (1003, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t, 3) for i, t in rows}
    reps = {s: min(i for i in sets if sets[i] == s) for s in set(sets.values()) if s}
    links = [(a, b) for x, a in reps.items() for y, b in reps.items() if a < b and 100 * len(x & y) >= 85 * len(x | y)]
    links += [(reps[s], i) for i, s in sets.items() if s]
    label = components(list(sets), links)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()} == label


def test_minhash_edges(spark, edges, no_rows):
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(edges, 3, 85).collect()), key=str)
    by = defaultdict(list)
    for d, c, k in got:
        by[d].append((c, k))
    assert by[2] == [(1, False)] and by[8] == [(7, False)] and by[3] == [(3, True)] and by[9] == [(9, True)] * 2 and by[None] == [(None, True)]
    assert minhash.near_duplicates(no_rows).count() == 0


def removed(rows, width=100):
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = removed([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in want) > 0
    assert sorted(map(tuple, substring_dedup.op_query(spark, docs).collect())) == sorted(want)


def test_substrings_on_planted_rows(spark):
    rng = np.random.default_rng(5)
    line = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    a, b, c = line(150), line(100), line(99)
    rows = [(1, line(50) + a + line(30) + a), (2, "é" + a[20:] + b + line(10) + c), (3, c + b + b), (4, "ab" * 400), (5, "z" * 1000), (6, None), (7, ""), (8, "z" * 99), (9, "z" * 100), (10, a), (11, a * 40), (12, "日本" * 60 + a[:120])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.op_query(spark, docs).collect())) == sorted(removed(rows))


def test_substrings_of_equal_rows_stay(spark):
    rng = np.random.default_rng(8)
    line = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    a, b = line(300), line(130)
    rows = [(1, a), (2, line(60) + b + line(40)), (3, line(20) + b), (4, a[30:200] + b + line(90))]
    want = {r[0]: r for r in removed(rows)}
    twice = rows * 2 + rows[1:2]
    docs = spark.createDataFrame(twice, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substring_dedup.op_query(spark, docs).collect())) == sorted(want[i] for i, _ in twice)


def test_substrings_of_many_texts_with_one_id(spark):
    rng = np.random.default_rng(9)
    line = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    texts = [line(300) for _ in range(1500)] + [x + line(5 + i % 40) + x for i, x in enumerate(line(120) for _ in range(1500))]
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.op_query(spark, docs).collect()), key=str) == sorted(removed(rows), key=str)


def test_minhash_joins_no_row_without_id_to_all_others(spark):
    docs = spark.createDataFrame([(None, f"a{i} b{i} c{i} d{i} " * (1 + i % 2)) for i in range(40)], "doc_id long, text string")
    nodes = minhash._nodes(minhash._signed(docs, 3)).select("node", "f1", "f2", "rep", "hash")
    sets = minhash._sets(docs, nodes, 3)
    assert sets.count() == 40
    assert "hash" in next(x for x in sets._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
    assert len({r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()}) == 1


def test_substrings_edges(spark, edges, no_rows):
    rows = substring_dedup.op_query(spark, edges).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 15 and by[8].n_removed == by[8].n_bytes > 0 and by[7].n_removed == 0 and by[3].n_bytes == 0
    assert substring_dedup.op_query(spark, no_rows).count() == 0


def brute_vectors(rows):
    good = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids, links, n = sorted(good), [], dict.fromkeys([i for i, _ in rows], 0)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = good[a], good[b]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    label = components([i for i, _ in rows], links)
    return {i: (n[i], label[i], label[i] == i) for i, _ in rows}


def test_vectors_equal_brute_force(spark, small):
    rng = np.random.default_rng(3)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    for i in range(60):  # copies with noise on either side of the threshold
        v = np.array(rows[i][1])
        rows.append((10_000 + i, (v + rng.normal(size=len(v)) * np.linalg.norm(v) / np.sqrt(len(v)) * (0.05, 0.3, 0.48, 0.6)[i % 4]).tolist()))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.op_query(spark, vectors).collect()}
    assert sum(n for n, _, _ in want.values()) > 0
    assert got == want


def test_vectors_in_a_dense_region(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "WINDOW", 32)
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.normal(size=64))
    hot = unit(centre + 0.5 * unit(rng.normal(size=(1800, 64))))  # mean cosine 0.8
    side = rng.normal(size=(300, 64))
    side = unit(side - (side * hot[:300]).sum(axis=1, keepdims=True) * hot[:300])
    x = np.concatenate([unit(rng.normal(size=(1500, 64))), hot, 0.905 * hot[:300] + np.sqrt(1 - 0.905**2) * side])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = components(range(len(x)), np.argwhere(near).tolist())
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.op_query(spark, docs).collect()}
    want = {i: (int(near[i].sum()), label[i], label[i] == i) for i in label}
    wrong = [i for i in want if got[i] != want[i]]
    assert near.any() and len(wrong) <= 2, len(wrong)  # 300 pairs, each lost with probability 0.001


def test_vectors_edges(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=8), rng.normal(size=8)
    rows = [(1, x), (2, x), (3, 2 * x), (4, -x), (5, None), (6, [0.0] * 8), (7, [float("nan"), *x[1:]]), (8, [float("inf"), *x[1:]]), (9, [None, *x[1:]]), (10, []), (11, y), (12, y + 0.1 * rng.normal(size=8)), (13, x[:4])]
    rows = [(i, None if v is None else [None if z is None else float(z) for z in v]) for i, v in rows]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, node string, label int")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.op_query(spark, docs).collect()} == brute_vectors(rows)
    assert vector_dedup.op_query(spark, docs.limit(0)).count() == 0


def test_substrings_combined_before_the_shuffle_or_not(spark, monkeypatch):
    """A passage in many documents, in different surroundings, with equal rows: tasks that hold few rows give the same."""
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(rng.randrange(30))) + passage[rng.randrange(30) :] + " ".join(word() for _ in range(rng.randrange(30))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (61, texts[5] * 2)], "doc_id long, text string")
    want = sorted(removed([*enumerate(texts), (61, texts[5] * 2)]))
    want.insert(3, want[3])
    for held in (1, 300_000):
        monkeypatch.setattr(substring_dedup, "HELD", held)
        assert sorted(map(tuple, substring_dedup.op_query(spark, docs.repartition(4)).collect())) == want
