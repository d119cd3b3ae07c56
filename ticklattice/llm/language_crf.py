"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters of the lower-cased text. Its features are its letters,
pairs and triples of letters with the word's borders (so prefixes and suffixes are
among them), a longer suffix, and the word itself as a lexicon entry; all are hashed.
Chains are stretches of up to CHAIN words of a text, and every word of every text is
in one. Labels are the languages of the training rows; training chains are spliced
from texts of different languages too, so that the transitions learn code-switching.
Training runs on executors: the chosen rows are dealt to GROUPS groups, each of which
goes once over its whole texts from the common weights, and the groups' changes are
averaged before the next round. The driver sees weights, no texts.

spans() labels words: runs of words of one language with their places. A text's
language is the one with the largest sum of its words' posteriors
(forward-backward), and the score the mean posterior. Texts that are null or have no
letters get `und`, score 0 and certainty 0 (the mean posterior of each word's own best label), and so does everything if no training row has a
language. Ties go to the language that sorts first. Rows are kept one to one; an
empty table gives no rows; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import drop, slices, stored

CHAIN = 128
BITS = 17  # of hashed features; as many again for the lexicon
#: Labelled rows that the model is fitted on, about; the same number of each language where there are so many.
SAMPLE = 1600
GROUPS = 8
EPOCHS, BATCH, RATE = 4, 64, 0.2

_BMP = np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x10000)])
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _A
    h ^= h >> np.uint64(29)
    return ((h * _B) >> np.uint64(64 - BITS)).astype(np.int64)


def _lower(text: str | None) -> str:
    """Lower case, letter for letter, so that places stay."""
    x = text or ""
    y = x.lower()
    return y if len(y) == len(x) else "".join(c.lower() if len(c.lower()) == 1 else c for c in x)


def _split(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each followed by a line feed, which are letters, and where texts begin."""
    lower = [_lower(x) for x in texts]
    cp = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le"), "<u4")
    letter = _BMP[np.minimum(cp, 0xFFFF)] & (cp < 0x10000)
    for x in np.unique(cp[cp >= 0x10000]).tolist():
        if chr(x).isalpha():
            letter |= cp == x
    return cp, letter, np.cumsum([0, *(len(x) + 1 for x in lower)])


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts in a row, where each word starts in them, and how many words each text has."""
    cp, letter, first = _split(texts)
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    per_text = np.diff(np.concatenate([[0], np.cumsum(start)])[first])
    before = np.cumsum(letter) - 1
    return cp[letter].astype(np.uint64), before[start], per_text


def word_hashes(c: np.ndarray, start: np.ndarray) -> np.ndarray:
    k = np.arange(len(c)) - np.repeat(start, np.diff(np.append(start, len(c))))
    power = np.cumprod(np.full(int(k.max(initial=0)) + 1, _A, np.uint64))
    return np.add.reduceat(c * power[k], start) if len(start) else np.zeros(0, np.uint64)


def features(c: np.ndarray, start: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Slots of features for each letter, and for each word."""
    k = np.arange(len(c)) - np.repeat(start, np.diff(np.append(start, len(c))))
    p1, p2 = np.roll(c, 1), np.roll(c, 2)
    p1[k < 1] = 0
    p2[k < 2] = 0
    two = c + p1 * _C
    three = two + p2 * _D
    end = np.append(start[1:], len(c)) - 1
    lexicon = word_hashes(c, start)
    return [_slot(c, 1), _slot(two, 2), _slot(three, 3)], [_slot(two[end], 4), _slot(three[end], 5), _slot(lexicon, 6) + (1 << BITS)]


def emissions(weights: np.ndarray, by_letter: list[np.ndarray], by_word: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    """Sums of weights, a row for each word."""
    total = weights[by_letter[0]]
    for x in by_letter[1:]:
        total += weights[x]
    total = np.add.reduceat(total, start, axis=0)
    for x in by_word:
        total += weights[x]
    return total


def posteriors(emission: np.ndarray, chain_of: np.ndarray, at: np.ndarray, lengths: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label posteriors of each word, expected transitions and first labels; word w is number at[w] of chain chain_of[w]."""
    n, steps, labels = len(lengths), int(lengths.max()), emission.shape[1]
    e = np.ones((steps, n, labels))
    e[at, chain_of] = np.exp(emission - emission.max(axis=1, keepdims=True))
    a, b = np.empty_like(e), np.ones_like(e)
    go = np.exp(move)
    a[0] = e[0] * np.exp(first)
    a[0] /= a[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a[t] = (a[t - 1] @ go) * e[t]
        a[t] /= a[t].sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        x = (e[t + 1] * b[t + 1]) @ go.T
        x /= x.sum(axis=1, keepdims=True)
        b[t] = np.where((t < lengths - 1)[:, None], x, 1.0)
    post = a * b
    post /= post.sum(axis=2, keepdims=True)
    pairs = np.zeros((labels, labels))
    for t in range(1, steps):
        live = lengths > t
        joint = a[t - 1][live][:, :, None] * go[None] * (e[t] * b[t])[live][:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return post[at, chain_of], pairs, post[0].sum(axis=0)


def _chains(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chain and place in it of each word, and chains' lengths, for texts of so many words."""
    text = np.repeat(np.arange(len(per_text)), per_text)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    count = -(-per_text // CHAIN)
    chain = (np.cumsum(count) - count)[text] + k // CHAIN
    return chain, k % CHAIN, np.bincount(chain, minlength=int(count.sum()))


class Model:
    def __init__(self, labels: list[str]):
        self.labels, n = labels, len(labels)
        self.weights = np.zeros((2 << BITS, n), np.float32)
        self.move, self.first = np.zeros((n, n)), np.zeros(n)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and certainty of each text."""
        c, start, per_text = words_of(texts)
        lang, score, sure = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not len(start) or not self.labels:
            return lang, score, sure
        post = self.word_posteriors(c, start, per_text)
        has = np.flatnonzero(per_text)
        first, n = (np.cumsum(per_text) - per_text)[has], per_text[has]
        sums = np.add.reduceat(post, first, axis=0) / n[:, None]
        own = np.add.reduceat(post.max(axis=1), first) / n
        for i, best, p, q in zip(has.tolist(), sums.argmax(axis=1).tolist(), sums.max(axis=1).tolist(), own.tolist(), strict=True):
            lang[i], score[i], sure[i] = self.labels[best], min(1.0, float(p)), min(1.0, float(q))
        return lang, score, sure

    def word_posteriors(self, c: np.ndarray, start: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return self._posteriors(emissions(self.weights, *features(c, start), start), *_chains(per_text))

    def spans(self, texts: list[str | None]) -> list[list[dict]]:
        """Runs of words of one language in each text: begin and end (characters) and lang."""
        c, start, per_text = words_of(texts)
        out: list[list[dict]] = [[] for _ in texts]
        if not len(start) or not self.labels:
            return out
        best = self.word_posteriors(c, start, per_text).argmax(axis=1)
        _, letter, first = _split(texts)
        edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        text = np.repeat(np.arange(len(texts)), per_text)
        new = np.append(True, (best[1:] != best[:-1]) | (text[1:] != text[:-1]))
        heads = np.flatnonzero(new)
        for h, t in zip(heads.tolist(), np.append(heads[1:], len(best)).tolist(), strict=True):
            i = int(text[h])
            out[i].append({"begin": int(begin[h] - first[i]), "end": int(end[t - 1] - first[i]), "lang": self.labels[best[h]]})
        return out

    def _posteriors(self, emission, chain, at, lengths):
        """posteriors() without the expectations that only training needs."""
        n, steps, labels = len(lengths), int(lengths.max()), emission.shape[1]
        e = np.ones((steps, n, labels), np.float32)
        e[at, chain] = np.exp(np.maximum(emission - emission.max(axis=1, keepdims=True), -60))
        go = np.exp(self.move).astype(np.float32)
        a = np.empty_like(e)
        a[0] = e[0] * np.exp(self.first).astype(np.float32)
        a[0] /= a[0].sum(axis=1, keepdims=True)
        for t in range(1, steps):
            a[t] = (a[t - 1] @ go) * e[t]
            a[t] /= a[t].sum(axis=1, keepdims=True)
        b = np.ones((n, labels), np.float32)
        for t in range(steps - 2, -1, -1):
            b = (e[t + 1] * b) @ go.T
            b /= b.sum(axis=1, keepdims=True)
            b[t >= lengths - 1] = 1
            a[t] *= b
        post = a[at, chain]
        return (post / post.sum(axis=1, keepdims=True)).astype(float)

    def round(self, rows: list[tuple[str, str]], seen: np.ndarray, seed: int) -> None:
        """Goes once over all words of rows (text, language): stochastic gradients of the chains' likelihood, with a rate for
        each weight from its summed squares (seen)."""
        rng = np.random.default_rng(seed)
        known: dict[int, int] = {}  # number of each distinct word
        slots, sizes, stretches = [], [], []
        for text, lang in rows:
            c, start, _ = words_of([text])
            if not len(start):
                continue
            by_letter, by_word = features(c, start)
            length = np.diff(np.append(start, len(c)))
            names, first, place = np.unique(word_hashes(c, start), return_index=True, return_inverse=True)
            for x, w in zip(names.tolist(), first.tolist(), strict=True):
                if x not in known:
                    known[x] = len(known)
                    own = slice(start[w], start[w] + length[w])
                    slots.append(np.concatenate([*(v[own] for v in by_letter), *(v[w : w + 1] for v in by_word)]).astype(np.int32))
                    sizes.append(len(slots[-1]))
            number = np.fromiter(map(known.__getitem__, names.tolist()), np.int32, len(names))[place]
            for b in range(0, len(number), CHAIN // 2):
                stretches.append((number[b : b + CHAIN // 2], self.labels.index(lang)))
        if not stretches:
            return
        flat, size = np.concatenate(slots), np.array(sizes)
        cut = np.cumsum(size) - size
        seen_move, seen_first = np.full_like(self.move, 1e-6), np.full_like(self.first, 1e-6)
        order = rng.permutation(len(stretches))
        for k in range(0, len(order), 2 * BATCH):
            some = [stretches[i] for i in order[k : k + 2 * BATCH]]  # neighbours make a chain: most are of two languages
            words, at_word = np.unique(np.concatenate([x[0] for x in some]), return_inverse=True)
            truth = np.concatenate([np.full(len(x[0]), x[1]) for x in some])
            lengths = np.add.reduceat(np.array([len(x[0]) for x in some]), np.arange(0, len(some), 2))
            chain = np.repeat(np.arange(len(lengths)), lengths)
            at = np.arange(len(truth)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            n = size[words]
            used_slots = flat[np.repeat(cut[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            emission = np.add.reduceat(self.weights[used_slots], np.cumsum(n) - n, axis=0).astype(float)[at_word]
            post, pairs, firsts = posteriors(emission, chain, at, lengths, self.move, self.first)
            post[np.arange(len(truth)), truth] -= 1
            inner = at[1:] > 0
            np.subtract.at(pairs, (truth[:-1][inner], truth[1:][inner]), 1)
            np.subtract.at(firsts, truth[at == 0], 1)
            scale = 1 / len(lengths)
            used, place = np.unique(used_slots, return_inverse=True)
            of_word = np.repeat(np.arange(len(words)), n)
            by_word = [np.bincount(at_word, post[:, j], len(words)) for j in range(post.shape[1])]
            g = np.stack([np.bincount(place, x[of_word]) for x in by_word], axis=1).astype(np.float32) * scale + 1e-5 * self.weights[used]
            seen[used] += g * g
            self.weights[used] -= RATE * g / np.sqrt(seen[used])
            for value, grad, sums in ((self.move, pairs * scale, seen_move), (self.first, firsts * scale, seen_first)):
                sums += grad * grad
                value -= RATE * grad / np.sqrt(sums)


def in_training(doc_id: Column, folds: int = 4, out: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) != out, F.lit(True))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on about `sample` rows of docs whose lang is not null, chosen by a hash, evenly over languages."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return Model([])
    share = sample / len(counts)
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col("lang") == lang) & (u < min(1.0, share / n)))
    rows = stored(known.where(chosen).select("text", "lang", F.pmod(F.xxhash64("text"), F.lit(GROUPS)).alias("_group")), "language-rows")
    model = Model(sorted(counts))
    seen = np.full(model.weights.shape, 1e-6, np.float32)
    for number in range(EPOCHS):
        _round(rows, model, seen, number)
    drop(rows)
    return model


def _round(rows: DataFrame, model: Model, seen: np.ndarray, number: int) -> None:
    """Each group goes over its rows from the model's weights; then the mean of the groups' changes is made to these."""
    labels, weights, move, first = model.labels, model.weights, model.move, model.first

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = Model(labels)
        own.weights, own.move, own.first = weights.copy(), move.copy(), first.copy()
        sums = seen.copy()
        texts = sorted(zip(table.column("text").to_pylist(), table.column("lang").to_pylist(), strict=True))
        own.round(texts, sums, 1000 * number + key[0].as_py())
        at = np.flatnonzero((sums != seen).any(axis=1))
        parts = (at.astype("<i4"), (own.weights - weights)[at].astype("<f4"), (sums - seen)[at].astype("<f4"), own.move - move, own.first - first)
        return pa.table({"at": pa.array([parts[0].tobytes()]), "weights": pa.array([parts[1].tobytes()]), "seen": pa.array([parts[2].tobytes()]), "move": pa.array([parts[3].tobytes()]), "first": pa.array([parts[4].tobytes()]), "group": pa.array([key[0].as_py()], pa.int64())})

    found = rows.groupBy("_group").applyInArrow(run, "at binary, weights binary, seen binary, move binary, first binary, group long").collect()  # GROUPS rows, each as large as the model at most
    total, squares, times = np.zeros_like(weights), np.zeros_like(weights), np.zeros(len(weights), np.float32)
    n = len(labels)
    for r in sorted(found, key=lambda r: r["group"]):
        at = np.frombuffer(r["at"], "<i4")
        total[at] += np.frombuffer(r["weights"], "<f4").reshape(-1, n)
        squares[at] += np.frombuffer(r["seen"], "<f4").reshape(-1, n)
        times[at] += 1
        model.move = model.move + np.frombuffer(r["move"]).reshape(n, n) / len(found)
        model.first = model.first + np.frombuffer(r["first"]) / len(found)
    times = np.maximum(times, 1)[:, None]
    model.weights = weights + total / times  # a weight's mean is over the groups that met it
    seen += squares / times


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns in `keep`, lang_pred, score and certainty for each row of docs."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "_text", 1_500_000):
                lang, score, sure = model.predict(batch.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.float64())], names=[*keep, "lang_pred", "score", "certainty"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double, certainty double"]))


def spans(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns in `keep` and spans, the runs of words of one language in the text: [(begin, end, lang)], places counted in
    characters; none where there are no letters."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "_text", 1_500_000):
                found = model.spans(batch.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))], names=[*keep, "spans"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "spans array<struct<begin:bigint,end:bigint,lang:string>>"]))


def op_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    model = fit(docs.where(in_training(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model, "doc_id")
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
