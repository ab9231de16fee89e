"""Byte-level BPE encoding and decoding of whole texts.

Texts up to ``leaf_chars`` are encoded at once. A longer text is cut into
leaves that are encoded by tasks of their own, and a tree of concatenations
joins neighbours: a window around the join, some tokens of either side, is
encoded anew and grown until its first token is the left side's and its last
token the right side's. Why this is exact: a sequence of tokens is the BPE
encoding of its text if every pair of neighbours is, and each pair of the
joined sequence lies within one side or within the window, which share a
token. A window also begins and ends at places where the splitting pattern
sees the same on either side: before a space between two characters that are
no blanks, where every scan has a boundary, or else within a run of letters,
of numbers or of other characters, in any script.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _kind(c: str) -> str:
    """The class of the splitting pattern that a character is in: letters, numbers, blanks or others."""
    kind = unicodedata.category(c)[0]
    return kind if kind in "LN" else " " if c.isspace() else "o"


class ByteBpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library.

    The file must be byte-level BPE whose merges are in the order of the ids,
    without normalizer or added prefix space. Special tokens in a text are
    taken as such; truncation and padding settings are not used.
    """

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or spec["post_processor"]:
            raise ValueError(f"{path} is not plain byte-level BPE")
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"][m] for m in merged] != list(range(len(ranks) - len(merged), len(ranks))):
            raise ValueError(f"{path}: merges are not in the order of ids")
        self.core = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.special_ids = frozenset(self.special.values())
        self.longest_special = max(map(len, self.special), default=0)

    def encode(self, text: str) -> list[int]:
        return self.core.encode(text, allowed_special="all")

    def token_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.core.decode_bytes(ids).decode("utf-8", errors="replace")

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the two sides' whole text."""
        if not left or not right:
            return left + right
        m = 8
        while True:
            a, b = max(0, len(left) - m), min(len(right), m)
            while not self._whole(left, a):
                a -= 1
            while not self._whole(right, b):
                b += 1
            window = self.encode((self.token_bytes(left[a:]) + self.token_bytes(right[:b])).decode("utf-8"))
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            m = 2 * max(len(left) - a, b)

    def _even(self, before: bytes, after: bytes) -> bool:
        """Whether the pattern sees the same at this place from either side."""
        if not after or after[0] & 0xC0 == 0x80:
            return False
        b, a = before.decode("utf-8", "ignore")[-2:], after.decode("utf-8", "ignore")[:2]
        if len(b) < 2 or len(a) < 2:
            return False
        kinds = [_kind(c) for c in b + a]
        if a[0] == " ":
            return kinds[1] != " " != kinds[3]
        return kinds[0] != " " and len(set(kinds)) == 1 and "'" not in b + a

    def _whole(self, ids: list[int], at: int) -> bool:
        return at in (0, len(ids)) or self._even(self.token_bytes(ids[max(0, at - 8) : at]), self.token_bytes(ids[at : at + 8]))

    def join_tree(self, parts: list[list[int]]) -> list[int]:
        """Neighbours are joined level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _emit(keys: pa.Array | pa.ChunkedArray, encoded: list[list[int]], bpe: ByteBpe, digest: bool, with_ids: bool) -> pa.RecordBatch:
    out = {"doc_id": keys}
    if with_ids:
        out["ids"] = pa.array(encoded, pa.list_(pa.int32()))
    decoded = [bpe.decode(x) for x in encoded]
    if digest:
        out["n_tokens"] = pa.array([len(x) for x in encoded], pa.int64())
        out["ids_sha256"] = pa.array([hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in encoded], pa.string())
        out["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())
    else:
        out["decoded"] = pa.array(decoded, pa.string())
    return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out.values()], list(out))


def _slices(batch: pa.RecordBatch, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that the tokens of one part fit in memory many times over."""
    size, at = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column("text")).fill_null(0).to_pylist()):
        size += n
        if size > max_bytes:
            yield batch.slice(at, i + 1 - at)
            size, at = 0, i + 1
    if at < batch.num_rows:
        yield batch.slice(at)


def cut_places(text_length: int, leaf: int) -> int:
    return -(-text_length // leaf)


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, leaf_chars: int = 1 << 15, digest: bool = False, with_ids: bool | None = None) -> DataFrame:
    """One row per input row: doc_id, ids (array of int) and decoded (string).

    With ``digest``: doc_id, n_tokens, ids_sha256 (ids as little-endian
    unsigned 32-bit integers) and decoded_sha256, and ids before them if
    ``with_ids`` says so; without, they do not leave the Python worker. Null and empty texts have no tokens and decode to
    the empty text. A doc_id may be null or repeated: rows are independent
    and texts too long for one leaf are held together by a key of their own.
    Other columns are ignored. An empty table gives an empty result.

    Only texts longer than ``leaf_chars`` are shuffled, once, as ids.
    """
    path = vocabulary or default_vocabulary()
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    with_ids = not digest if with_ids is None else with_ids
    out = f"doc_id {id_type}, " + ("ids array<int>, " if with_ids else "") + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "decoded string")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in _slices(batch):
                yield _emit(part.column("doc_id"), [bpe.encode(x) for x in part.column("text").to_pylist()], bpe, digest, with_ids)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in _slices(batch):
                ids = [np.array(bpe.encode(x), "<u4").tobytes() for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("doc_id"), part.column("k"), pa.array(ids, pa.binary())], ["uid", "doc_id", "k", "ids"])

    def concatenate(group: pa.Table) -> pa.Table:
        bpe = load(path)
        group = group.sort_by("k")
        ids = bpe.join_tree([np.frombuffer(x, "<u4").tolist() for x in group.column("ids").to_pylist()])
        return pa.Table.from_batches([_emit(group.column("doc_id").slice(0, 1), [ids], bpe, digest, with_ids)])

    short = own.filter(F.length("text") <= leaf_chars).mapInArrow(whole, out)
    leaves = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / leaf_chars).cast("int") - 1), lambda k: F.substring(F.col("text"), k * leaf_chars + 1, F.lit(leaf_chars)))
    pieces = (
        own.filter(F.length("text") > leaf_chars)
        .withColumn("uid", F.monotonically_increasing_id())  # before the rows of a text are multiplied
        .select("uid", "doc_id", F.posexplode(leaves).alias("k", "text"))
        .repartition("uid", "k")
        .mapInArrow(leaf, f"uid long, doc_id {id_type}, k int, ids binary")
    )
    long = pieces.groupBy("uid").applyInArrow(concatenate, out)
    return short.unionByName(long)
