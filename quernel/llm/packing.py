"""Packing of token sequences by minimum bin slack.

Documents are encoded and cut into chunks of one sequence's length; a full
chunk is a sequence of its own. What is left of the documents, one rest each,
is dealt to buckets by a hash, and each bucket fills its windows: the longest
rest opens a window, and a subset-sum table over the multiset of the other
lengths, kept as bits of an integer, says which sum comes closest to the
window's slack. Its lengths and their counts are traced back through the
table. Where the best multiset leaves slack, one more rest is cut to fill it.
The last tokens of a bucket, less than a window, are cut into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import bpe
from quernel.llm.scratch import Scratch

#: Ids are kept in so many bytes each, if the vocabulary allows two.
_NARROW, _WIDE = np.dtype("<u2"), np.dtype("<u4")


def best_multiset(counts: dict[int, int], slack: int) -> tuple[int, dict[int, int]]:
    """(sum, {length: times}) of the multiset of ``counts`` whose sum is the largest up to ``slack``; long lengths are preferred.

    Bit s of ``reach`` says whether some multiset of the lengths so far sums
    to s. ``before`` keeps the bits as they were before each length, so the
    smallest number of times that it must be taken can be read off.
    """
    full = (1 << (slack + 1)) - 1
    reach, before = 1, []
    for length in sorted((x for x in counts if x <= slack), reverse=True):
        before.append((length, reach))
        left, step = min(counts[length], slack // length), 1
        while left:  # by doubling: every number of times up to the count
            take = min(step, left)
            reach |= (reach << (take * length)) & full
            left, step = left - take, 2 * step
        if reach >> slack & 1:
            break
    total = at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, bits in reversed(before):
        times = 0
        while not bits >> at & 1:
            at, times = at - length, times + 1
        if times:
            chosen[length] = times
    return total, chosen


def fill_windows(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) that hold every token of every item once, none longer than ``capacity``."""
    pool: dict[int, list[tuple[int, int]]] = {}  # (item, start) by what is left of it
    for i in reversed(range(len(lengths))):
        if lengths[i]:
            pool.setdefault(lengths[i], []).append((i, 0))
    counts = {n: len(x) for n, x in pool.items()}
    left = sum(lengths)

    def take(length: int) -> tuple[int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return pool[length].pop()

    out: list[list[tuple[int, int, int]]] = []
    while left >= capacity:
        longest = max(counts)
        counts[longest] -= 1  # not for the table: it is in the window
        slack, chosen = best_multiset({n: c for n, c in counts.items() if c}, capacity - longest)
        counts[longest] += 1
        want = chosen | {longest: chosen.get(longest, 0) + 1}
        room = capacity - longest - slack
        # the same multiset again, for as long as all its lengths last
        for _ in range(1 if room else min(counts[n] // c for n, c in want.items())):
            window = [(*take(n), n) for n in sorted(want, reverse=True) for _ in range(want[n])]
            if room:
                n = max(counts)
                item, start = take(n)
                window.append((item, start, room))
                pool.setdefault(n - room, []).append((item, start + room))
                counts[n - room] = counts.get(n - room, 0) + 1
            out.append(window)
            left -= capacity
    rest = [(*at, n) for n in sorted(counts, reverse=True) for at in reversed(pool[n][-counts[n] :])]
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            window, room = [], 1 << bit
            while room:
                item, start, n = rest.pop(0)
                part = min(n, room)
                window.append((item, start, part))
                room -= part
                if part < n:
                    rest.insert(0, (item, start + part, n - part))
            out.append(window)
    return out


def _encoded(docs: DataFrame, id_type: str, path: str, end: int, capacity: int, leaf_chars: int, kind: np.dtype) -> DataFrame:
    """(uid, doc_id, doc_tokens, start, ids): the chunks of each document, its ids as bytes."""
    names = ["uid", "doc_id", "doc_tokens", "start", "ids"]
    out = f"uid long, doc_id {id_type}, doc_tokens long, start long, ids binary"

    def chunks(uids: list, keys: pa.Array, encoded: list[np.ndarray]) -> pa.RecordBatch:
        row, uid, size, start, ids = [], [], [], [], []
        for i, x in enumerate(encoded):
            for at in range(0, len(x), capacity):
                row.append(i)
                uid.append(uids[i])
                size.append(len(x))
                start.append(at)
                ids.append(x[at : at + capacity].tobytes())
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), keys.take(pa.array(row, pa.int64())), pa.array(size, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = bpe.load(path)
        for batch in batches:
            for part in bpe._slices(batch):
                yield chunks(part.column("uid").to_pylist(), part.column("doc_id"), [np.array([*core.encode(x), end], kind) for x in part.column("text").to_pylist()])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = bpe.load(path)
        for batch in batches:
            for part in bpe._slices(batch):
                ids = [np.array(core.encode(x), _WIDE).tobytes() for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("doc_id"), part.column("k"), pa.array(ids, pa.binary())], ["uid", "doc_id", "k", "ids"])

    def concatenate(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        ids = bpe.load(path).join_tree([np.frombuffer(x, _WIDE).tolist() for x in group.column("ids").to_pylist()])
        return pa.Table.from_batches([chunks(group.column("uid").slice(0, 1).to_pylist(), group.column("doc_id").slice(0, 1), [np.array([*ids, end], kind)])])

    leaves = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / leaf_chars).cast("int") - 1), lambda k: F.substring(F.col("text"), k * leaf_chars + 1, F.lit(leaf_chars)))
    long = docs.filter(F.length("text") > leaf_chars).select("uid", "doc_id", F.posexplode(leaves).alias("k", "text")).repartition("uid", "k").mapInArrow(leaf, f"uid long, doc_id {id_type}, k int, ids binary")
    return docs.filter(F.length("text") <= leaf_chars).mapInArrow(whole, out).unionByName(long.groupBy("uid").applyInArrow(concatenate, out))


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = 2048, end: int = 1, with_ids: bool = True, leaf_chars: int = 1 << 15, rests_per_bucket: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids (array of int) unless ``with_ids`` is off.

    A document is the ids of its text and then ``end``; ``doc_tokens`` counts
    them. ``start`` is the number of its ids before the piece; each id is in
    one piece. A sequence is at most ``capacity`` ids long and its pieces
    follow each other without gaps from ``offset`` 0. Every sequence is full
    or its length is a power of two: nothing is padded. At most one sequence
    of each power of two per bucket of about ``rests_per_bucket`` documents is
    not full.

    Null and empty texts are documents of the one id ``end``. A doc_id may be
    null or repeated: rows are documents of their own, told apart by a number
    that they get when they are first written. Other columns are ignored. An
    empty table gives no rows.

    Encoded chunks are written once; only rests are shuffled, to buckets by a
    hash of that number, so equal lengths, equal texts and hot ids spread
    evenly. A bucket is a bounded number of rests, each under ``capacity``.
    """
    path = vocabulary or bpe.default_vocabulary()
    scratch = Scratch(docs.sparkSession, "packing")
    kind = _NARROW if max(bpe.load(path).bytes_of, default=0) < 1 << 16 and end < 1 << 16 else _WIDE
    id_type = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    chunks = scratch.keep(_encoded(own, id_type, path, end, capacity, leaf_chars, kind))
    size = F.octet_length("ids") / kind.itemsize
    is_full = size == capacity
    rests = chunks.filter(~is_full)
    buckets = max(1, -(-rests.count() // rests_per_bucket))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["ids"] if with_ids else [])
    out = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")

    def pieces(keys: pa.Array, start: list, length: list, tokens: list, sequence: list, offset: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        crc = [zlib.crc32(x.astype(_WIDE).tobytes()) for x in ids]
        held = [keys, *[pa.array(x, pa.int64()) for x in (start, length, crc, tokens, sequence, offset)]]
        if with_ids:
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            held.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)), pa.array(flat)))
        return pa.RecordBatch.from_arrays(held, names)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]
            n = len(ids)
            yield pieces(batch.column("doc_id"), batch.column("start").to_pylist(), [capacity] * n, batch.column("doc_tokens").to_pylist(), batch.column("sequence_id").to_pylist(), [0] * n, ids)

    def fill(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("uid")
        ids = [np.frombuffer(x, kind) for x in group.column("ids").to_pylist()]
        first, tokens = group.column("start").to_pylist(), group.column("doc_tokens").to_pylist()
        row, start, length, sequence, offset, cut = [], [], [], [], [], []
        base = key[0].as_py() << 32
        for s, window in enumerate(fill_windows([len(x) for x in ids], capacity)):
            at = 0
            for i, begin, n in window:
                row.append(i)
                start.append(first[i] + begin)
                length.append(n)
                sequence.append(base + s)
                offset.append(at)
                cut.append(ids[i][begin : begin + n])
                at += n
        keys = group.column("doc_id").combine_chunks().take(pa.array(row, pa.int64()))
        return pa.Table.from_batches([pieces(keys, start, length, [tokens[i] for i in row], sequence, offset, cut)])

    # numbers of full chunks begin above those of the buckets' sequences
    alone = chunks.filter(is_full).select("doc_id", "start", "doc_tokens", "ids", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id")).mapInArrow(full, out)
    bucket = F.pmod(F.xxhash64("uid"), F.lit(buckets))
    filled = rests.select(bucket.alias("bucket"), "uid", "doc_id", "start", "doc_tokens", "ids").groupBy("bucket").applyInArrow(fill, out)
    return alone.unionByName(filled)
