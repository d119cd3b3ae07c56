"""Token ids of whole texts with a public tokenizer, each distinct space-separated chunk encoded once.

Both vocabularies split a text before a lone space that stands between two
characters, so a text's ids are its chunks' ids in a row. Texts for which that is
not certain (runs of spaces, control characters, characters past Latin Extended-B,
the special tokens' own strings) go to the library whole; the ids are the same.
A new chunk of letters and punctuation after them is put together from the ids of the
two, which are chunks themselves: both vocabularies split there too. One of letters
alone is a single word to the vocabulary and goes to the library's model. All others go
to the library many at a time, as one text from which their ids can be told apart: by
the space that each starts with, or by a control character as a word of its own between
them.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np

#: Anything but tab, newline, printable ASCII and U+00A1..U+024F.
_ODD = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0ɐ-\U0010ffff]")
#: Chunks remembered by a Python worker (some 100 to 200 MB); beyond that those met again stay, a third at most.
_MOST_CHUNKS = 800_000
_MARK = "\x01"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others for
    those from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


def _goes_whole(text: str) -> bool:
    return "  " in text or "<|" in text or bool(_ODD.search(text))


class _Index(dict):
    """Numbers chunks as they are first looked up; new ones are listed."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = at = len(self)
        self.new.append(chunk)
        return at


class TextEncoder:
    """encode(texts) gives (ids, counts): all ids in a row, and how many each text has. Null counts as empty.

    keeps_spaces: a chunk after the first starts with its space (byte-level
    vocabularies); otherwise white space and case are dropped.
    """

    def __init__(self, path: str, keeps_spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_spaces = keeps_spaces
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        if keeps_spaces:
            names = self.tokenizer.get_vocab()
            self.starts = np.zeros(max(names.values()) + 1, bool)
            self.starts[[i for x, i in names.items() if x.startswith("Ġ")]] = True
        else:
            (self.mark,) = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.letters[ord("\n")] = "\n"  # parts words here
        self.index = _Index()
        self.flat = np.zeros(0, np.uint32)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Leaves the chunks met most often, none that was met once."""
        order = np.argsort(-self.hits, kind="stable")[: _MOST_CHUNKS // 3]
        kept = np.sort(order[self.hits[order] > 1])
        chunks, index = list(self.index), _Index()
        index.update((chunks[k], i) for i, k in enumerate(kept.tolist()))
        length = self.length[kept]
        begin = np.cumsum(length) - length
        self.flat = self._gathered(self.begin[kept], length)
        self.index, self.begin, self.length, self.hits = index, begin, length, self.hits[kept] // 2

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each chunk begin and how many they are. A chunk that begins with _MARK stands
        without a space, the empty one is a space alone."""
        if not self.keeps_spaces:
            ids = np.array(self._library([f" {_MARK} ".join([*chunks, ""])])[0], np.uint32)
            ends = np.flatnonzero(ids == self.mark)
            begin = np.append(0, ends[:-1] + 1)
            return ids, begin, ends - begin
        begin, length = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        odd = [i for i, x in enumerate(chunks) if not x or x[0] == _MARK]
        plain = np.ones(len(chunks), bool)
        plain[odd] = False
        joined = " ".join(["", *(x for x, p in zip(chunks, plain.tolist(), strict=True) if p)])
        ids = np.array(self._library([joined])[0], np.uint32)
        begin[plain] = np.flatnonzero(self.starts[ids])
        length[plain] = np.diff(begin[plain], append=len(ids))
        more = self._library([chunks[i][1:] or " " for i in odd])
        length[odd] = [len(x) for x in more]
        begin[odd] = len(ids) + np.cumsum(length[odd]) - length[odd]
        return np.concatenate([ids, np.array([i for x in more for i in x], np.uint32)]), begin, length

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters only, and how many each has."""
        space = self.letters[ord(" ")] if self.keeps_spaces else ""
        ids, length = [], []
        for word in "\n".join(words).encode().decode("latin-1").translate(self.letters).split("\n"):
            got = [x.id for x in self.model.tokenize(space + word)]
            ids += got
            length.append(len(got))
        return np.array(ids, np.uint32), np.array(length, np.int64)

    def _learn(self) -> None:
        new, number, tail_mark = self.index.new, self.index.__getitem__, _MARK if self.keeps_spaces else ""
        known, words, others, joined = len(self.begin), [], [], []
        for i, x in enumerate(new):  # grows by the words and the punctuation that are looked up
            if x.isalpha():
                words.append(i)
            elif (word := x.rstrip(string.punctuation)).isalpha():
                joined.append((i, number(word), number(tail_mark + x[len(word) :])))
            else:
                others.append(i)
        begin, length = (np.append(x, np.zeros(len(new), np.int64)) for x in (self.begin, self.length))
        size, flat = len(self.flat), [self.flat]
        for k in range(0, len(others), 1000):
            at = others[k : k + 1000]
            f, b, n = self._ids_of([new[i] for i in at])
            begin[known:][at], length[known:][at] = b + size, n
            flat.append(f)
            size += len(f)
        if words:
            f, n = self._words([new[i] for i in words])
            begin[known:][words], length[known:][words] = size + np.cumsum(n) - n, n
            flat.append(f)
            size += len(f)
        self.flat = np.concatenate(flat)
        if joined:
            at, parts = np.array(joined)[:, 0], np.array(joined)[:, 1:]
            n = length[parts.ravel()]
            f = self._gathered(begin[parts.ravel()], n)
            length[known:][at] = both = n.reshape(-1, 2).sum(axis=1)
            begin[known:][at] = size + np.cumsum(both) - both
            self.flat = np.concatenate([self.flat, f])
        self.begin, self.length = begin, length
        self.hits = np.append(self.hits, np.zeros(len(new), np.int64))
        self.index.new = []

    def _gathered(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The ids that lie at these places of flat, in a row."""
        ends = np.cumsum(length)
        return self.flat[np.repeat(begin - ends + length, length) + np.arange(int(length.sum()))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, x in enumerate(texts) if x and _goes_whole(x)]
        odd = dict(zip(whole, self._library([texts[i] for i in whole]), strict=True)) if whole else {}
        if len(self.index) > _MOST_CHUNKS:
            self._forget()
        places, per_text, number = [], np.zeros(len(texts), np.int64), self.index.__getitem__
        for i, text in enumerate(texts):
            if not text or i in odd:
                continue
            if self.keeps_spaces:
                chunks = text.split(" ")  # known without their leading space
                if chunks[0]:
                    chunks[0] = _MARK + chunks[0]
                else:
                    del chunks[0]
            else:
                chunks = text.lower().split()
            places.append(np.fromiter(map(number, chunks), np.int64, len(chunks)))
            per_text[i] = len(chunks)
        if self.index.new:
            self._learn()
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.hits += np.bincount(place, minlength=len(self.hits))
        length = self.length[place]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self._gathered(self.begin[place], length)
        ends = np.cumsum(per_text)
        counts = total[ends] - total[ends - per_text]
        if odd:
            cuts = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in odd.items():
                cuts[i], counts[i] = np.array(x, np.uint32), len(x)
            ids = np.concatenate(cuts)
        return ids, counts
