"""Token counts by a unigram vocabulary, with one dynamic programme over a trie of distinct pre-tokens.

Pre-tokens are the words [^\\x20\\x09-\\x0D]+ of a text, each after the word mark U+2581. The sorted
distinct pre-tokens of a slice are walked as a trie: a pre-token shares the forward scores of the
prefix that it has in common with the one before, so each prefix is scored once. A pre-token's
terminal state holds its number of tokens, and a document's count is the sum over its pre-tokens.

The score of the vocabulary's n-th piece is -log(n + 2): frequency by rank. A character that no piece
covers is its UTF-8 bytes, each of the score UNKNOWN. Of equal scores the longest last piece wins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import SPACE, byte_view, slices

MARK = "▁"
UNKNOWN = -24.0
CACHE_WORDS = 600_000


def load_pieces(path: str) -> dict[str, float]:
    """A sentencepiece model's pieces, without control and byte pieces, with their rank's score."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {p: -math.log(n + 2) for n, p in enumerate(usual)}


class TrieCounter:
    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.ends: dict[str, int] = {}  # a last character's longest piece
        for p in pieces:
            self.ends[p[-1]] = max(self.ends.get(p[-1], 0), len(p))
        self.known: dict[bytes, tuple[int, float]] = {}
        self.steps = 0

    def count_all(self, words: list[str]) -> list[tuple[int, float]]:
        """Number of tokens and score of each of the sorted words."""
        best, count, out, last = [0.0], [0], [], ""
        pieces, ends = self.pieces, self.ends
        for w in words:
            s, n = MARK + w, 0
            for a, b in zip(s, last):
                if a != b:
                    break
                n += 1
            del best[n + 1 :], count[n + 1 :]
            for i in range(n, len(s)):
                top, k = -math.inf, 0
                for j in range(max(0, i + 1 - ends.get(s[i], 0)), i + 1):
                    if (p := pieces.get(s[j : i + 1])) is not None and best[j] + p > top:
                        top, k = best[j] + p, count[j] + 1
                if k == 0:
                    size = len(s[i].encode())
                    top, k = best[i] + UNKNOWN * size, count[i] + size
                best.append(top)
                count.append(k)
            self.steps += len(s) - n
            out.append((count[-1], best[-1]))
            last = s
        return out

    def tokens(self, words: list[bytes]) -> np.ndarray:
        """The distinct words' counts and scores, one row each."""
        new = sorted(w.decode() for w in words if w not in self.known)
        fresh = dict(zip((w.encode() for w in new), self.count_all(new), strict=True))
        out = np.array([self.known[w] if w in self.known else fresh[w] for w in words]).reshape(-1, 2)
        if len(self.known) < CACHE_WORDS:
            self.known.update(fresh)
        return out


_HELD: dict[str, TrieCounter] = {}


def _counter(path: str) -> TrieCounter:
    if path not in _HELD:
        _HELD[path] = TrieCounter(load_pieces(path))
    return _HELD[path]


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts as a dictionary array, and each text's first word's number, with the end."""
    space = SPACE[buf]
    first = np.zeros(len(buf), bool)
    first[offsets[:-1][offsets[:-1] < len(buf)]] = True
    before = np.ones_like(space)
    before[1:] = space[:-1]
    edges = np.flatnonzero(first | (space != before))
    bounds = np.append(edges, len(buf)).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))])
    keep = ~space[edges]
    runs = runs.filter(pa.array(keep)).dictionary_encode()
    at = np.concatenate([[0], np.cumsum(keep)])
    return runs, at[np.searchsorted(edges, offsets)]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_tokens, score (the best segmentation's log score, to 3 places).

    Null and empty texts have no words; repeated rows and null ids stay as they are; the input's rows
    are the result's rows. A text of any length is one row; a word of any length is one path of the trie.
    """

    def run(batches):
        counter = _counter(path)
        for batch in batches:
            for rows, texts in slices(batch):
                buf, offsets = byte_view(texts)
                if len(buf):
                    runs, first = words_of(buf, offsets)
                    codes = runs.indices.to_numpy()
                    each = counter.tokens(runs.dictionary.to_pylist())
                    sums = np.vstack([np.zeros((1, 2)), np.cumsum(each[codes].reshape(-1, 2), axis=0)])
                    n, total = np.diff(first), sums[first[1:]] - sums[first[:-1]]
                else:
                    n, total = np.zeros(len(rows), np.int64), np.zeros((len(rows), 2))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.rint(total[:, 0]).astype(np.int64)), pa.array(np.round(total[:, 1], 3) + 0.0)], ["doc_id", "n_words", "n_tokens", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, score double")
