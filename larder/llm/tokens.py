"""Exact, memoised tokenisation with a public tokenizer file.

Texts are cut where no token can cross, each distinct chunk is encoded once by the ``tokenizers`` library, and a
document's ids are its chunks' ids joined.  Chunks are found by hash in a memo of bounded size, so memory does not grow
with the vocabulary of the corpus; a chunk of more than ``runs.LONGEST`` characters is encoded each time.  Where cuts
are safe:

* ``words``: the tokenizer drops white space, so no token crosses a space.  A-Z may be lowered first, as it lowers all.
* ``bytes``: a token starts with at most the white space before it, so a cut before white space that follows something
  else is safe.

In both, a run of Latin letters and the plain punctuation behind it are different pre-tokens and are encoded apart.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from larder.llm import runs

# Latin letters but U+0130, which becomes two characters in lower case, the second of them no letter.
_LATIN = re.compile(r"[A-Za-zß-öø-įı-ɏ]")
_MARKS = ".,;:!?%*#$&"
_TOGETHER = 400
_CHARACTERS_AT_ONCE = 400_000
#: Entries of the memo, about 60 MB with their ids; beyond, it starts anew.
MEMO_ENTRIES = 1_000_000
# Kinds of characters up to U+3000.  White space is so by anyone's definition, but a cut is made only before the plain one.
_SPACES = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_PLAIN_SPACES = np.isin(np.arange(0x3002), [9, 10, 11, 12, 13, 32])
_LETTERS = np.array([bool(_LATIN.match(chr(c))) for c in range(0x3002)])
_LETTERS_ENDED = np.isin(np.arange(0x3002), [ord(c) for c in _MARKS])


class MemoTokenizer:
    """``encode(texts, end_id)`` gives the texts' ids one after another as unsigned 16-bit numbers, and each text's number of them."""

    def __init__(self, path: str, cut: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2")
        if self.tokenizer.get_vocab_size() > np.iinfo(self.dtype).max:
            raise ValueError(f"16 bits do not hold the ids of {path}")
        # Plain words are encoded many at a time: each is one pre-token, and its last id (words) or first id (bytes) shows.
        vocabulary = self.tokenizer.get_vocab()
        mark = (lambda t: t.endswith("</w>")) if cut == "words" else (lambda t: t.startswith("Ġ"))
        self.at_edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.at_edge[[i for t, i in vocabulary.items() if mark(t)]] = True
        self.words = cut == "words"
        self._forget()

    def _forget(self) -> None:
        self.table, self.used = runs.Table(), 0
        self.pool = np.zeros(1 << 16, self.dtype)  # ids of all known chunks
        self.known = 0
        self.offset, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _remember(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Puts the ids of chunks, one after another, into the pool; returns the chunks' numbers."""
        total, count = len(ids), len(sizes)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.known + count > len(self.offset):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        self.pool[self.used : self.used + total] = ids
        self.offset[self.known : self.known + count] = self.used + np.cumsum(sizes) - sizes
        self.length[self.known : self.known + count] = sizes
        self.used, self.known = self.used + total, self.known + count
        return np.arange(self.known - count, self.known)

    def _chunks(self, kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the chunks, in order; none holds the line feed between texts."""
        space = _PLAIN_SPACES[kind]
        cut = np.append(True, _LETTERS[kind[:-1]] & _LETTERS_ENDED[kind[1:]])
        if self.words:
            cut |= ~space & np.append(True, space[:-1])
            begin = np.flatnonzero(cut)
            ends = np.flatnonzero(space & np.append(False, ~space[:-1]))
            end = np.minimum(np.append(begin[1:], len(kind)), ends[np.minimum(np.searchsorted(ends, begin), len(ends) - 1)]) if len(ends) else begin
        else:
            cut[1:] |= space[1:] & ~_SPACES[kind[:-1]]
            cut[starts[:-1]] = True
            begin = np.flatnonzero(cut)
            end = np.append(begin[1:], len(kind))
            end = end - np.isin(end, starts)  # the line feed that ends a text
        full = end > begin
        return begin[full], end[full]

    def encode(self, texts: Iterable[str], end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, sizes) of some texts at a time; each text is followed by ``end_id``, which its size counts."""
        held, size = [], 0
        for text in texts:
            if held and size + len(text) > _CHARACTERS_AT_ONCE:
                yield self._encode_some(held, end_id)
                held, size = [], 0
            if len(text) > 2 * _CHARACTERS_AT_ONCE:
                ids = [self._encode_some([p], end_id)[0][:-1] for p in runs.pieces(text, _CHARACTERS_AT_ONCE)]
                ids = np.concatenate([*ids, np.array([end_id], self.dtype)])
                yield ids, np.array([len(ids)])
                continue
            held.append(text)
            size += len(text)
        if held:
            yield self._encode_some(held, end_id)

    def _encode_some(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        text, codes, starts = runs.joined(texts, lower=self.words)
        kind = np.minimum(codes, len(_SPACES))
        begin, end = self._chunks(kind, starts)
        if self.known > MEMO_ENTRIES:
            self._forget()
        keys = runs.hashes(codes, begin, end)
        number = self.table.find(keys)
        long = np.flatnonzero(end - begin > runs.LONGEST)
        number[long] = -1
        missing = np.flatnonzero((number < 0) & (end - begin <= runs.LONGEST))
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            where = missing[first]
            # Plain words, which are one pre-token each, apart from all else.
            letters = np.append(0, np.cumsum(_LETTERS[kind]))
            b, e = begin[where] + (not self.words), end[where]
            plain = letters[e] - letters[np.minimum(b, e)] == e - b
            if not self.words:
                plain &= (codes[begin[where]] == 32) & (e > b)
            numbers = np.empty(len(where), np.int64)
            for some, find in ((plain, self._encode_words), (~plain, self._encode_each)):
                own = where[some]
                numbers[some] = self._remember(*find([text[b:e] for b, e in zip(begin[own].tolist(), end[own].tolist(), strict=True)]))
            self.table.add(new, numbers)
            number[missing] = numbers[back]
        if len(long):
            number[long] = self._remember(*self._encode_each([text[b:e] for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True)]))
        return self._gather(number, begin, starts, end_id)

    def _gather(self, number: np.ndarray, begin: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.length[number]
        upto = np.append(0, np.cumsum(sizes))  # ids before each chunk
        of_text = np.searchsorted(begin, starts)  # chunks before each text
        counts = np.diff(upto[of_text])
        place = np.arange(upto[-1]) + np.repeat(self.offset[number] - upto[:-1], sizes)
        out = np.empty(upto[-1] + len(counts), self.dtype)
        ends = np.cumsum(counts + 1) - 1
        out[ends] = end_id
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = self.pool[place]
        return out, counts + 1

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._encode(chunks) if chunks else []
        return np.array([i for ids in found for i in ids], self.dtype), np.array([len(ids) for ids in found], np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of plain words, many at a time: the first or last id of each shows."""
        ids, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), _TOGETHER):
            some = words[at : at + _TOGETHER]
            found = np.array(self._encode([(" " if self.words else "").join(some)])[0], self.dtype)
            edges = np.flatnonzero(self.at_edge[found])
            own = np.diff(edges, prepend=-1) if self.words else np.diff(edges, append=len(found))
            if len(own) != len(some) or own.sum() != len(found):  # not as expected of such words
                found, own = self._encode_each(some)
            ids.append(found)
            sizes.append(own)
        return np.concatenate(ids), np.concatenate(sizes)


_LOADED: dict[tuple, MemoTokenizer] = {}


def memo_tokenizer(path: str, cut: str) -> MemoTokenizer:
    """One per Python worker and file."""
    if (path, cut) not in _LOADED:
        _LOADED[path, cut] = MemoTokenizer(path, cut)
    return _LOADED[path, cut]
