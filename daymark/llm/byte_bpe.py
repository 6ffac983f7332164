"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until it is short; the encodings of two neighbours are joined by encoding a small window at
their boundary again. Two levels do this. Texts are joined as lists of chunks (white space, then the characters up
to the next white space): no match of the split pattern spans the step from a character to white space after it, so
only the two chunks that touch can change. Pre-tokens are joined as token lists: the last k tokens of the left and
the first k of the right are encoded again, and k doubles until the pairs at both window edges are themselves the
encoding of their bytes. A token list all of whose neighbouring pairs encode to themselves is the encoding of the
whole, so the tokens outside the window are then final.
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache
from sys import getsizeof

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, keep_text, mapped, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS = 1 << 16
LEAF_BYTES = 16
LEAF_IDS = 1 << 16
#: Entries and bytes that a memo holds before it starts again; an entry takes ENTRY bytes besides its key and value.
MEMO, MEMO_BYTES, ENTRY = 500_000, 128 << 20, 100
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class Memo(dict):
    """f's results by argument, at most so many of them and so many bytes, so that long arguments don't fill a task."""

    def __init__(self, f, most: int = MEMO, most_bytes: int = MEMO_BYTES):
        super().__init__()
        self.f, self.most, self.most_bytes, self.bytes = f, most, most_bytes, 0

    def __missing__(self, key):
        value = self.f(key)
        self.bytes += getsizeof(key) + getsizeof(value) + ENTRY
        if len(self) >= self.most or self.bytes > self.most_bytes:
            self.clear()
            self.bytes = getsizeof(key) + getsizeof(value) + ENTRY
        if self.bytes <= self.most_bytes:
            self[key] = value
        else:
            self.bytes = 0
        return value


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBpe:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.rejoined = 0  # bytes of the windows that joined() encoded
        self.pair_ok = Memo(lambda pair: self.merged(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == list(pair))
        self.piece = Memo(lambda piece: pack(self.encode_piece(piece.encode())))
        self.chunk = Memo(lambda chunk: b"".join(map(self.piece.__getitem__, self.pattern.findall(chunk))))

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE of a few bytes: join the neighbours of lowest rank, leftmost first."""
        get, none = self.ranks.get, 1 << 31
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
        return list(map(self.ranks.__getitem__, parts))

    def encode_piece(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        return [self.ranks[data]] if data in self.ranks else self.reduced(data)

    def reduced(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.reduced(data[:half]), self.reduced(data[half:]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        k = 1
        while True:
            window = left[-k:] + right[:k]
            data = b"".join(map(self.bytes_of.__getitem__, window))
            again = self.merged(data)
            self.rejoined += len(data)
            before, after = left[-k - 1 : -k] if k < len(left) else [], right[k : k + 1]
            if (not before or self.pair_ok[before[0], again[0]]) and (not after or self.pair_ok[again[-1], after[0]]):
                return left[:-k] + again + right[k:]
            k *= 2

    def chunks(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return CHUNK.findall(text)
        half = len(text) // 2
        left, right = self.chunks(text[:half]), self.chunks(text[half:])
        return left[:-1] + CHUNK.findall(left[-1] + right[0]) + right[1:]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.chunk.__getitem__, self.chunks(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBpe:
    """One codec for each Python worker."""
    return ByteBpe(path, pattern)


def vocabulary(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids): ids as little-endian unsigned 32-bit integers in a binary column.

    A null or empty text has no tokens; repeated rows stay; other columns go. No shuffle.
    """
    path = path or vocabulary()

    def run(batches):
        bpe = codec(path)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column("text").to_pylist()]
            yield b.column("doc_id"), [len(x) // 4 for x in ids], pa.array(ids, pa.binary())

    return mapped(keep_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, token_ids binary")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds decoded (binary) to what bpe_encode returns; null ids decode to nothing."""
    path = path or vocabulary()

    def run(batches):
        bpe = codec(path)
        for b in batches:
            ids = [x or b"" for x in b.column("token_ids").to_pylist()]
            yield *(b.column(c) for c in ("doc_id", "n_tokens", "token_ids")), pa.array([bpe.decode(np.frombuffer(x, "<u4")) for x in ids], pa.binary())

    return mapped(encoded.select("doc_id", "n_tokens", "token_ids"), run, "doc_id long, n_tokens long, token_ids binary, decoded binary")


def op1_byte_bpe(spark, sf_dir):
    out = bpe_decode(bpe_encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
