"""Token ids of whole texts by the tokenizers library, with each distinct chunk encoded once.

A text is cut where the tokenizer's own pre-tokenizer always cuts (at ASCII white space, and
between an ASCII letter and ASCII punctuation), the distinct chunks of a slice are found by Arrow's
dictionary encoding, and only chunks that the worker has not met go to the library. A text with
white space beyond ASCII, or with an added token's literal, is encoded whole, as there the cuts might differ.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from larkspur.llm.common import SPACE, byte_view

#: Chunks that a worker keeps; later ones are encoded anew in each slice. Frequent ones come first.
CACHE_CHUNKS = 400_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PUNCT[39] = False
#: Bytes of which one stands in any text with white space beyond [\x20\x09-\x0D].
_ODD = np.zeros(256, bool)
_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Byte-level vocabularies write each byte as a printable character: itself where it has one, else those from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")


class ChunkTokenizer:
    """style "byte": a space belongs to the word after it; "word": white space yields no id."""

    def __init__(self, path: str, style: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.style = style
        literals = sorted({t.content.lower().encode() for t in self.tok.get_added_tokens_decoder().values()})
        self.added = re.compile(b"|".join(map(re.escape, literals)), re.IGNORECASE) if literals else None
        #: What all literals open with, without letters, which a text may write in either case.
        self.opening = re.match(rb"[^A-Za-z]*", os.path.commonprefix(literals))[0]
        self.known: dict[bytes, int] = {}
        self.arena, self.used = np.zeros(1 << 20, np.uint32), 0
        self.offs, self.lens = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.held = 0

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one after another, and each one's count. A chunk that is one word of letters up to U+00FF is one pre-token, so the model takes it as it is."""
        model, ids, lens = self.tok.model.tokenize, [], []
        for c in chunks:
            word = c.decode()
            bare = word[1:] if word[:1] == " " else word
            if bare.isalpha() and max(bare) < "\u0100":
                word = word if self.style == "byte" else bare.lower()
                got = [t.id for t in model(word.encode().decode("latin-1").translate(_BYTE_CHARS))]
            else:
                got = self._ids(word)
            ids += got
            lens.append(len(got))
        return np.array(ids, np.uint32), np.array(lens, np.int64)

    def _add(self, chunks: list[bytes]) -> int:
        """Holds the chunks' ids; the place of the first of them."""
        ids, lens = self._encode(chunks)
        while self.used + len(ids) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        while self.held + len(lens) > len(self.offs):
            self.offs, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offs, self.lens))
        base, end = self.held, self.held + len(lens)
        self.arena[self.used : self.used + len(ids)] = ids
        self.lens[base:end] = lens
        self.offs[base:end] = self.used + np.cumsum(lens) - lens
        self.held, self.used = end, self.used + len(ids)
        return base

    def _starts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        space = SPACE[buf]
        first = np.zeros(len(buf), bool)
        first[offsets[:-1][offsets[:-1] < len(buf)]] = True
        prev = np.empty_like(space)
        prev[0], prev[1:] = False, space[:-1]
        prev &= ~first
        start = first | (space & ~prev)
        if self.style == "byte":
            # the last of a run of white space stands alone or, if a space, before the next word
            after = np.empty_like(space)
            after[-1], after[:-1] = True, space[1:] | first[1:]
            start |= space & ~after
            before = np.empty_like(buf)
            before[0], before[1:] = 0, buf[:-1]
            start |= ~space & prev & (before != 0x20)
        else:
            start |= ~space & prev
        letter = np.empty_like(space)
        letter[0], letter[1:] = False, _LETTER[buf[:-1]]
        return np.flatnonzero(start | (letter & _PUNCT[buf]))

    def _fast(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts = self._starts(buf, offsets)
        bounds = np.append(starts, len(buf)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        codes, words = chunks.indices.to_numpy(), chunks.dictionary.to_pylist()
        at = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        new, used = [words[i] for i in missing.tolist()], self.used
        base = self._add(new)
        at[missing] = np.arange(base, base + len(new))
        offs, lens = self.offs[at], self.lens[at]
        size = lens[codes]
        ends = np.cumsum(size)
        total = int(ends[-1])
        ids = self.arena[np.repeat(offs[codes] - ends + size, size) + np.arange(total)]
        if base < CACHE_CHUNKS:
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
        else:  # the cache is full: forget what this slice added
            self.held, self.used = base, used
        sums = np.concatenate([[0], ends])
        return ids, sums[np.searchsorted(starts, offsets[1:])] - sums[np.searchsorted(starts, offsets[:-1])]

    def _with_added(self, buf: np.ndarray, offsets: np.ndarray) -> set[int]:
        """The texts that hold an added token's literal, in any case."""
        if not self.added:
            return set()
        if not self.opening:
            return {i for i in range(len(offsets) - 1) if self.added.search(buf[offsets[i] : offsets[i + 1]].tobytes())}
        data, found, at = buf.tobytes(), set(), 0
        while (at := data.find(self.opening, at)) >= 0:
            i = int(np.searchsorted(offsets, at, side="right")) - 1
            if self.added.search(data, int(offsets[i]), int(offsets[i + 1])):
                found.add(i)
            at = int(offsets[i + 1])
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a large_binary array, one text after another, and each text's count."""
        buf, offsets = byte_view(texts)
        sums = np.concatenate([[0], np.cumsum(_ODD[buf])])
        text = lambda i: buf[offsets[i] : offsets[i + 1]].tobytes()
        odd = sorted({i for i in np.flatnonzero(sums[offsets[1:]] > sums[offsets[:-1]]).tolist() if _ODD_SPACE.search(text(i).decode())} | self._with_added(buf, offsets))
        if not odd:
            return self._fast(buf, offsets)
        parts, lens, at = [], [], 0
        for i in [*odd, len(offsets) - 1]:
            if i > at:
                ids, n = self._fast(buf[offsets[at] : offsets[i]], offsets[at : i + 1] - offsets[at])
                parts.append(ids)
                lens.append(n)
            if i < len(offsets) - 1:
                ids = self._ids(text(i).decode())
                parts.append(np.array(ids, np.uint32))
                lens.append(np.array([len(ids)], np.int64))
            at = i + 1
        return np.concatenate(parts), np.concatenate(lens)


_HELD: dict[tuple[str, str], ChunkTokenizer] = {}


def tokenizer(path: str, style: str) -> ChunkTokenizer:
    """One for each worker process, kept from task to task."""
    if (path, style) not in _HELD:
        _HELD[path, style] = ChunkTokenizer(path, style)
    return _HELD[path, style]
