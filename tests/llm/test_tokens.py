"""Token files, packing and token counts against the tokenizers library and plain loops."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ticklattice.llm import packing, token_files, wordpiece_counts

from .conftest import EDGES

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids(path, text, end):
    t = Tokenizer.from_file(path)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.fixture(params=["edges", "table"])
def docs(request, spark, edges, small):
    return edges if request.param == "edges" else spark.read.parquet(f"{small}/documents.parquet")


def test_token_files_hold_all_ids_in_order(spark, docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for d, text in rows:
        x = ids(BYTE, text, 2)
        want.append((d, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    got = token_files.op_query(spark, docs, BYTE, 2).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_coder_round_trips_any_ids():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 50, 1000).astype("<u4"), np.zeros(5000, "<u4"), np.array([7], "<u4"), (rng.zipf(1.3, 20_000) % 50_000).astype("<u4")]
    counts = np.bincount(np.concatenate(blocks), minlength=50_257)
    freq = token_files.quantised(counts)
    coded = token_files.encode_blocks(blocks, freq)
    back = token_files.decode_blocks([len(b) for b in blocks], *map(list, zip(*coded, strict=True)), freq)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))


def test_a_damaged_file_is_noticed(spark, edges, tmp_path):
    files = token_files.write_token_files(edges, BYTE, 2)
    blocks = spark.read.parquet(files.blocks)
    from pyspark.sql import functions as F

    broken = blocks.withColumn("payload", F.concat(F.lit(b"\x01\x02\x03\x04"), F.expr("substring(payload, 5)")))
    broken.write.parquet(str(tmp_path / "blocks"))
    damaged = token_files.TokenFiles(**{**files.__dict__, "blocks": str(tmp_path / "blocks")})
    with pytest.raises(Exception, match="."):
        token_files.read_token_files(spark, damaged).collect()


def test_packing_places_every_piece_once(spark, docs):
    got = packing.op_query(spark, docs, WORD).collect()
    want = defaultdict(int)
    for r in docs.collect():
        x = ids(WORD, r.text, 0)
        for k in range(0, len(x), 2048):
            want[(r.doc_id, k // 2048, k, min(2048, len(x) - k), zlib.crc32(x[k : k + 2048].tobytes()))] += 1
    have, by = defaultdict(int), defaultdict(list)
    for r in got:
        have[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        by[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    bins = []  # best-fit decreasing, the plain way
    for n in sorted((k[3] for k, c in want.items() for _ in range(c)), reverse=True):
        fit = [i for i, room in enumerate(bins) if room >= n]
        if fit:
            bins[min(fit, key=bins.__getitem__)] -= n
        else:
            bins.append(2048 - n)
    assert len(by) <= len(bins) * 1.01 + 1


def test_counts_equal_greedy_longest_matches(spark, docs):
    tokens = wordpiece_counts.vocabulary(WORD)
    known, longest = set(tokens), max(map(len, tokens))

    def greedy(word):
        s, n = word.encode().decode("latin-1") + wordpiece_counts.END, 0
        while s:
            n += 1
            s = s[next((k for k in range(min(longest, len(s)), 0, -1) if s[:k] in known), 1) :]
        return n

    want = sorted(((r.doc_id, len(w := (r.text or "").lower().split()), sum(map(greedy, w))) for r in docs.collect()), key=str)
    got = sorted(map(tuple, wordpiece_counts.op_query(spark, docs, WORD).select("doc_id", "n_words", "n_tokens").collect()), key=str)
    assert got == want


def test_empty_tables(spark, no_rows):
    assert token_files.op_query(spark, no_rows, BYTE, 2).count() == 0
    assert packing.op_query(spark, no_rows, WORD).count() == 0
    assert wordpiece_counts.op_query(spark, no_rows, WORD).count() == 0
    assert len(EDGES) == 15


def test_plans_are_never_worse_than_best_fit(monkeypatch):
    import random

    monkeypatch.setattr(packing, "GROUPS", (24,))  # each plan solves a linear programme
    rng = random.Random(2)
    for i in range(12):
        kind = i % 3
        lengths = [2048 if rng.random() < 0.02 else (rng.randrange(1, 2048) if kind == 0 else min(2047, 1 + int(rng.expovariate(1 / 500))) if kind == 1 else rng.choice([700, 690, 680, 650, 340, 1030, 1100])) for _ in range(rng.randrange(600, 4000))]
        h = {x: lengths.count(x) for x in set(lengths)}
        plain = packing.plan_packing(h, 2048, 10**9)[0]  # no groups: best fit by decreasing length
        n, runs = packing.best_plan(h)
        assert -(-sum(lengths) // 2048) <= n <= plain
        used, placed = {}, {}
        for x, first_rank, count, first, offset in runs:
            placed[x] = placed.get(x, 0) + count
            for k in range(count):
                used.setdefault(first + k, []).append((offset, x))
        assert placed == h and len(used) == n
        for parts in used.values():
            at = 0
            for offset, x in sorted(parts):
                assert offset == at
                at += x
            assert at <= 2048
    m = 40  # where best fit by decreasing length needs 11 sequences for 9
    h = {1032: 6 * m, 528: 6 * m, 520: 6 * m, 496: 12 * m}
    assert packing.plan_packing(h, 2048, 10**9)[0] == 11 * m and packing.best_plan(h)[0] <= 368
