"""Greedy longest-match token counts by a linear automaton, without building pieces.

Every word, closed by an end mark, is matched greedily from the left against a
vocabulary. The vocabulary's trie has, for each node, a failure link and a number of
popped tokens: when no child fits, the tokens of the longest matches from there are
counted and matching goes on in the node of what is left of them. Each character is
read once and links are followed no more often than characters are read. A character
that no token starts with counts as one token, and so does an end mark left alone.

Words are the pieces between white space of the lower-cased text. The distinct words
of a batch go through the automaton side by side. Null counts as empty (0 tokens);
rows stay one to one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import slices

END = "\x00"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a letter: printable ones as themselves, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def vocabulary(path: str) -> list[str]:
    """The tokens of a word-end BPE vocabulary as byte strings written in Latin-1; END stands for the end of the word."""
    letters = _byte_letters()
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    out = []
    for x in names:
        closed = x.endswith("</w>")
        body = x.removesuffix("</w>")
        if all(c in letters for c in body):
            out.append("".join(chr(letters[c]) for c in body) + END * closed)
    return out


class Automaton:
    """count(words) gives the number of greedy tokens of each word."""

    def __init__(self, tokens: list[str]):
        child: list[dict[str, int]] = [{}]
        final = [False]
        for t in tokens:
            node = 0
            for c in t:
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                    final.append(False)
                node = child[node][c]
            if node:
                final[node] = True
        n = len(child)
        fail, popped = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for v in child[0].values():
            final[v] = True  # a character is a token of its own where no longer one fits
        queue = deque((0, c, v) for c, v in child[0].items())
        while queue:
            u, c, v = queue.popleft()
            if final[v]:
                fail[v], popped[v] = 0, 1
            else:
                z, k = int(fail[u]), int(popped[u])
                while z and c not in child[z]:
                    k += int(popped[z])
                    z = int(fail[z])
                fail[v], popped[v] = child[z].get(c, 0), k + (c not in child[z] and c != END)
            queue.extend((v, x, w) for x, w in child[v].items())
        edges = sorted((u * 256 + ord(c), v) for u, own in enumerate(child) for c, v in own.items())
        self.keys, self.ends = (np.array(x, np.int64) for x in zip(*edges, strict=True)) if edges else (np.array([-1]), np.array([-1]))
        self.fail, self.popped = fail, popped

    def _step(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = node * 256 + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ends[at], -1)

    def count(self, words: list[bytes]) -> np.ndarray:
        length = np.array([len(x) for x in words], np.int64)
        total = np.zeros(len(words), np.int64)
        if not len(words):
            return total
        order = np.argsort(-length, kind="stable")
        flat = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        begin = (np.cumsum(length) - length)[order]
        size, node, out = length[order], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for i in range(int(length.max()) + 1):
            live = np.searchsorted(-size, -i, side="right")  # words whose end mark is not yet read
            at = np.arange(live)
            c = np.where(i < size[:live], flat[np.minimum(begin[:live] + i, len(flat) - 1)], 0)
            while len(at):
                to = self._step(node[at], c[at])
                done = to >= 0
                node[at[done]] = to[done]
                at = at[~done]
                root = node[at] == 0  # no token starts so: one for the character, none for the end mark
                out[at[root]] += c[at[root]] > 0
                at = at[~root]
                out[at] += self.popped[node[at]]
                node[at] = self.fail[node[at]]
        while len(at := np.flatnonzero(node)):  # what is left after the end mark
            out[at] += self.popped[node[at]]
            node[at] = self.fail[node[at]]
        total[order] = out
        return total


def counts(docs: DataFrame, tokens: list[str]) -> DataFrame:
    """doc_id, n_words and n_tokens for each row of docs (doc_id, text)."""

    def run(batches):
        auto = Automaton(tokens)
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                index: dict[str, int] = {}
                split = [(x or "").lower().split() for x in batch.column("text").to_pylist()]
                for own in split:
                    for w in set(own).difference(index):
                        index[w] = len(index)
                n = auto.count([w.encode() for w in index])
                total = [int(n[np.fromiter(map(index.__getitem__, own), np.int64, len(own))].sum()) for own in split]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, split)), pa.int64()), pa.array(total, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op_query(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    return counts(docs, vocabulary(path))
