"""Token ids of whole text columns, by a tokenizer file of the tokenizers library."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from .arrays import blocks, span_hashes

#: Bytes of text whose distinct pieces are looked up at a time; arrays take 60 times that.
BLOCK_BYTES = 1 << 22
#: Words whose ids a worker remembers.
CACHED_WORDS = 1_000_000
#: New words that are given to the tokenizer as one text.
WORDS_A_TEXT = 64


class Words(dict):
    """Ids, as native unsigned 32-bit bytes, of a run of bytes, as the tokenizer gives them.
    Beyond `most` words it starts anew."""

    def __init__(self, path: str):
        super().__init__()
        self.most = CACHED_WORDS
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self.whole("\n")[0]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def __missing__(self, word: bytes) -> bytes:
        self[word] = ids = array("I", self.whole(word.decode())).tobytes()
        return ids

    def all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece. New ones are encoded together, with line feeds between, a few
        to a text, which the tokenizer takes faster than one long text."""
        found = list(map(self.get, pieces))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        new = [p for p in (pieces[i] for i in lacking) if b"\n" not in p and len(p) < 64]
        if len(self) + len(new) > self.most:
            self.clear()
        if new:
            texts = [b"\n".join(new[i:i + WORDS_A_TEXT]).decode() for i in range(0, len(new), WORDS_A_TEXT)]
            ids = array("I")
            for text in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                ids.extend(text.ids)
                ids.append(self.feed)
            at = np.flatnonzero(np.frombuffer(ids, dtype=np.uint32) == self.feed)
            if len(at) == len(new):
                raw, ends = ids.tobytes(), (at * 4).tolist()
                self.update((p, raw[a:b]) for p, a, b in zip(new, [0, *[e + 4 for e in ends]], ends))
        for i in lacking:
            found[i] = self[pieces[i]]
        return found


_WORDS: dict[str, Words] = {}


def words_of(path: str, most: int = CACHED_WORDS) -> Words:
    """The worker's words of a tokenizer file, of which it remembers `most`."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    _WORDS[path].most = most
    return _WORDS[path]


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Places of white space outside ASCII: its first and its last byte."""
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    last = lambda k: data[np.minimum(at + k, len(data) - 1)]
    a, b, c = data[at], last(1), last(2)
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = (((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
             | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
             | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)))
    return np.concatenate([at[two | three], at[two] + 1, at[three] + 2])


def _found(raw: bytes, word: bytes) -> Iterator[int]:
    at = raw.find(word)
    while at >= 0:
        yield at
        at = raw.find(word, at + 1)


def encode(column: pa.Array, words: Words, block_bytes: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """Token ids of each row of a string column; none for null.

    A token always starts at a blank between two characters that are no white space, at
    a sign after an ASCII letter, and at and after a single line feed. Texts are cut
    there, each distinct piece of a block is looked up once, and the ids are put together
    by number. Texts with white space next to a blank, and texts that hold an added token
    of the tokenizer, which it finds before any cut, are encoded whole.
    """
    for first, last, data, bounds in blocks(column, block_bytes):
        raw = data.tobytes()
        blank = data == 32
        space = blank | ((data >= 9) & (data <= 13))
        space[_wide_space(data)] = True
        run = np.flatnonzero((space[1:] & blank[:-1]) | (blank[1:] & space[:-1]))
        held = np.array([at for word in words.added for at in _found(raw, word)], dtype=np.int64)
        slow = np.unique(np.searchsorted(bounds, np.concatenate([run, held]), "right") - 1)
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        sign = (data > 32) & (data < 127) & ~letter & ~((data >= 48) & (data <= 57))
        cut = blank.copy()
        cut[1:] |= sign[1:] & letter[:-1]
        feed = np.flatnonzero(data[1:-1] == 10) + 1
        feed = feed[~(space[feed - 1] | space[feed + 1])]
        cut[feed] = cut[feed + 1] = True
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
        for row in slow.tolist():  # looked up by row, so their pieces need no ids
            cut[bounds[row] + 1:bounds[row + 1]] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        codes, kinds = pd.factorize(span_hashes(data, start, end))
        sample = np.zeros(len(kinds), dtype=np.int64)
        sample[codes[::-1]] = np.arange(len(codes))[::-1]
        wanted = np.arange(len(kinds))
        if len(slow):  # a row may only look slow by its neighbour, so its text may be wanted elsewhere
            wanted = np.unique(codes[~np.isin(start, bounds[slow])])
        found = [b""] * len(kinds)
        for k, ids in zip(wanted.tolist(), words.all([raw[a:b] for a, b in zip(
                start[sample[wanted]].tolist(), end[sample[wanted]].tolist())])):
            found[k] = ids
        whole = {row: np.array(words.whole(raw[bounds[row]:bounds[row + 1]].decode()), dtype=np.uint32)
                 for row in slow.tolist()}
        lengths = np.array([len(x) // 4 for x in found], dtype=np.int64)
        pool = np.frombuffer(b"".join(found), dtype=np.uint32)
        n = lengths[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        places = (np.cumsum(lengths) - lengths)[codes]
        ids = pool[np.repeat(places - upto[:-1], n) + np.arange(upto[-1])]
        rows = upto[np.searchsorted(start, bounds)]
        for row in range(last - first):
            yield whole[row] if row in whole else ids[rows[row]:rows[row + 1]]
