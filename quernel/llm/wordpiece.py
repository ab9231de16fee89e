"""Word-piece token counts by a linear longest-match automaton.

The pieces form a trie. Each node has a failure link, the node where matching
goes on once the longest pieces that the node's bytes settle are taken off,
and the number of those pieces. A word is read once, byte by byte: follow the
trie, or else add the node's count and take its failure link. The sum is the
number of pieces of greedy longest-match-first, which are never built. Words
are read in step, one byte of all distinct words of a batch at a time.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import tokens
from quernel.llm.bpe import byte_alphabet, default_vocabulary

#: Words of more bytes are read one by one, so that one long word does not make a whole batch wait.
LONG_WORD = 256


class LongestMatch:
    """The automaton of a vocabulary.

    ``initial`` pieces may begin a word, ``inner`` ones go on; both may be the
    same pieces. ``prefix`` is read before every word, as a byte-level
    vocabulary's space is. A word that no pieces make up is one unknown token.
    """

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes] | None = None, prefix: bytes = b""):
        initial = set(initial) - {b""}
        inner = initial if inner is None else set(inner) - {b""}
        child: dict[int, int] = {}
        piece = [False, False]

        def grow(root: int, pieces: set[bytes]) -> None:
            for p in sorted(pieces):
                at = root
                for c in p:
                    key = at << 8 | c
                    if key not in child:
                        child[key] = len(piece)
                        piece.append(False)
                    at = child[key]
                piece[at] = True

        self.root, self.again = (0, 0) if inner == initial else (0, 1)
        grow(0, initial)
        if self.again:
            grow(1, inner)
        n = len(piece)
        fail, popped, depth = [-1] * n, [0] * n, [0] * n
        by_depth: list[list[tuple[int, int, int]]] = [[]]
        for key, node in child.items():
            depth[node] = depth[key >> 8] + 1  # a parent is made before its children
            while len(by_depth) <= depth[node]:
                by_depth.append([])
            by_depth[depth[node]].append((key >> 8, key & 255, node))
        for level in by_depth:
            for parent, c, node in level:
                if piece[node]:
                    fail[node], popped[node] = self.again, 1
                    continue
                at, count = fail[parent], popped[parent]
                while at >= 0 and (at << 8 | c) not in child:
                    count += popped[at]
                    at = fail[at]
                if at >= 0:
                    fail[node], popped[node] = child[at << 8 | c], count
        # at a word's end: the counts along the failure links to the inner root, or -1
        flush = [-1] * n
        flush[self.root] = flush[self.again] = 0
        for level in by_depth:
            for _, _, node in level:
                if fail[node] >= 0 and flush[fail[node]] >= 0:
                    flush[node] = popped[node] + flush[fail[node]]
        self.child = child
        self.keys = np.array(sorted(child), np.int64)
        self.nodes = np.array([child[k] for k in sorted(child)], np.int32)
        self.fail, self.popped, self.flush = (np.array(x, np.int32) for x in (fail, popped, flush))
        self.start = self._read(prefix, self.root, 0)

    def _read(self, word: bytes, at: int, count: int) -> tuple[int, int]:
        """(node, count) after some bytes; node -1: unknown."""
        child, fail, popped = self.child, self.fail, self.popped
        for c in word:
            while at >= 0 and (at << 8 | c) not in child:
                count += int(popped[at])
                at = int(fail[at])
            if at < 0:
                return -1, 1
            at = child[at << 8 | c]
        return at, count

    def count(self, word: bytes) -> int:
        at, count = self._read(word, *self.start)
        return 1 if at < 0 or self.flush[at] < 0 else count + int(self.flush[at])

    def counts(self, ws: tokens.Words) -> np.ndarray:
        """Pieces of every word."""
        if not len(ws.starts):
            return np.zeros(0, np.int64)
        _, first, back = np.unique(ws.hashes, return_index=True, return_inverse=True)
        starts, lengths = ws.starts[first], (ws.ends - ws.starts)[first]
        order = np.argsort(-lengths, kind="stable")
        out = np.zeros(len(first), np.int64)
        n_long = int((lengths > LONG_WORD).sum())
        for i in order[:n_long]:
            out[i] = self.count(ws.data[starts[i] : starts[i] + lengths[i]].tobytes())
        order = order[n_long:]
        starts, lengths = starts[order], lengths[order]
        at = np.full(len(order), self.start[0], np.int64)
        got = np.full(len(order), self.start[1], np.int64)
        active = len(order)
        for step in range(int(lengths[0]) if len(order) else 0):
            active = int(np.searchsorted(-lengths, -step, "left"))  # words longer than step come first
            c = ws.data[starts[:active] + step].astype(np.int64)
            todo = np.flatnonzero(at[:active] >= 0)
            while len(todo):
                key = at[todo] << 8 | c[todo]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[place] == key
                at[todo[hit]] = self.nodes[place[hit]]
                todo = todo[~hit]
                got[todo] += self.popped[at[todo]]
                at[todo] = self.fail[at[todo]]
                todo = todo[at[todo] >= 0]
        end = np.where(at >= 0, self.flush[np.maximum(at, 0)], -1)
        out[order] = np.where(end >= 0, got + end, 1)
        return out[back]


@functools.lru_cache(maxsize=2)
def load(path: str) -> LongestMatch:
    """The automaton of a byte-level vocabulary file, special tokens left out: words are read with their leading space."""
    spec = json.load(open(path, encoding="utf-8"))
    alphabet, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
    return LongestMatch((bytes(alphabet[c] for c in t) for t in spec["model"]["vocab"] if t not in special), prefix=b" ")


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    r"""One row per input row: doc_id, n_words, n_tokens.

    Words are maximal runs outside ``[\x20\x09-\x0D]``, A-Z lower-cased; a
    text's tokens are the greedy longest-match pieces of its words. Null,
    empty and blank texts have none. Ids may be null or repeated; other
    columns are ignored. A very long text is read whole, in step. An empty table
    gives an empty result. Nothing is shuffled; the vocabulary's automaton, a fixed size, is built once in each
    Python worker.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(path)
        for batch in batches:
            for lo, hi, data, offsets in tokens.text_slices(batch.column("text"), 1 << 22):
                ws = tokens.words_of(data, offsets)
                total = np.concatenate([[0], np.cumsum(machine.counts(ws))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(ws.first)), pa.array(total[ws.first[1:]] - total[ws.first[:-1]])], ["doc_id", "n_words", "n_tokens"])

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
