"""Token files of independent zstandard frames with a trailing seek table and a checksum for each frame.

Layout of a file, after the public seekable format of zstandard:

* frames: each an independent zstandard frame over the token ids of some documents, 2 bytes an id (4 if the
  vocabulary needs it), little-endian;
* one skippable frame (magic 0x184D2A5D): doc ids (int64), frame numbers (uint32) and token counts (uint64) of all
  documents in file order, each array preceded by nothing and as long as the leading count (uint64) says; the next
  byte before them is the width of an id;
* one skippable frame (magic 0x184D2A5E): the seek table, an entry (compressed size, size, low 32 bits of XXH64 of
  the content) for each frame, then the number of frames, a descriptor byte (bit 7: checksums) and 0x8F92EAB1.

A reader takes the end of a file, finds the frames of the documents it wants, and decompresses only those.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Memo
from .common import WHITE, by_range, folder, fresh_dir, keep_text, mapped, put, range_cuts, table

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
FRAME_BYTES = 1 << 18
#: Stands for a missing doc_id in a file.
NO_ID = -(1 << 63)
SEEK_MAGIC, INDEX_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
CHUNK = re.compile(f"[^{WHITE}]+")
#: Chunks of these characters are split here as the vocabulary's own pattern splits them (NFC leaves them as they are).
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:_|[^\w\s])+")
MEMO = 250_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next free one."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class Encoder:
    """The tokenizers library, each distinct pre-token once while the memo holds it.

    The vocabulary drops white space and joins nothing over it, so a text's ids are those of its chunks.
    added: the vocabulary's added tokens in a text are one id each, as by the library's default; otherwise they are
    ordinary text, as with its encode_special_tokens.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        tokens = self.library.get_added_tokens_decoder().values() if added else ()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized or CHUNK.fullmatch(t.content) is None for t in tokens):
            raise ValueError(f"{path}: added tokens that depend on what is beside them")
        self.added = re.compile("(" + "|".join(sorted((re.escape(t.content) for t in tokens), key=len, reverse=True)) + ")") if tokens else None
        self.model = self.library.model
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.letters = dict(enumerate(byte_letters()))
        self.piece = Memo(self.encode_piece, MEMO)
        self.chunk = Memo(self.encode_chunk, MEMO)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def encode_piece(self, piece: str) -> bytes:
        own = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.model.tokenize(own)])

    def encode_chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk):
            return b"".join(map(self.piece.__getitem__, PIECE.findall(chunk.lower())))
        return self.packed(self.library.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            return b"".join(self.packed([self.library.token_to_id(p)]) if i % 2 else b"".join(map(self.chunk.__getitem__, CHUNK.findall(p))) for i, p in enumerate(parts))
        return b"".join(map(self.chunk.__getitem__, CHUNK.findall(text)))


@lru_cache(2)
def encoder(path: str, added: bool = False) -> Encoder:
    return Encoder(path, added)


def encode_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text and the end id, as many bytes an id as the vocabulary needs.
    The vocabulary's added tokens, such as <|endoftext|>, are one id each where a text holds them.

    A null or empty text has the end id alone; repeated rows stay; other columns go.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        enc = encoder(path, True)
        end = struct.pack(f"<{enc.code}", end_id)
        for b in batches:
            yield b.column("doc_id"), pa.array([enc.encode(t) + end for t in b.column("text").to_pylist()], pa.binary())

    return mapped(keep_text(docs, id_col, text_col), run, "doc_id long, ids binary")


def write_file(out, docs: Iterable[tuple[int, bytes]], width: int, frame_bytes: int = FRAME_BYTES) -> tuple[int, int]:
    """Write one file from (doc_id, id bytes); the number of documents and of ids."""
    packer = zstandard.ZstdCompressor(level=1, write_content_size=True)
    table_rows, ids, frames, counts = [], [], [], []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        data = b"".join(held)
        out.write(packed := packer.compress(data))
        table_rows.append(struct.pack("<III", len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        held.clear()
        size = 0

    for doc_id, data in docs:
        if held and size + len(data) > frame_bytes:
            flush()
        ids.append(doc_id)
        frames.append(len(table_rows))
        counts.append(len(data) // width)
        held.append(data)
        size += len(data)
    if held:
        flush()
    index = struct.pack("<BQ", width, len(ids)) + np.array(ids, "<i8").tobytes() + np.array(frames, "<u4").tobytes() + np.array(counts, "<u8").tobytes()
    out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
    seek = b"".join(table_rows) + struct.pack("<IBI", len(table_rows), 0x80, FOOTER_MAGIC)
    out.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)
    return len(ids), sum(counts)


class Reader:
    """One token file; only the frames of the wanted documents are read and decompressed, each checked."""

    def __init__(self, path: str):
        file_system, at = folder(path)
        self.file = file_system.open_input_file(at)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError(f"{path}: no seek table")
        seek = size - 9 - 12 * n
        entries = np.frombuffer(self.at(seek, 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.checks = entries[:, 0].astype(np.int64), entries[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        begin = int(self.starts[-1])
        (_, length) = struct.unpack("<II", self.at(begin, 8))
        index = self.at(begin + 8, length)
        self.width, m = struct.unpack_from("<BQ", index)
        self.doc_ids = np.frombuffer(index, "<i8", m, 9)
        self.frames = np.frombuffer(index, "<u4", m, 9 + 8 * m)
        self.counts = np.frombuffer(index, "<u8", m, 9 + 12 * m).astype(np.int64)

    def at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def frame(self, i: int) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(self.at(int(self.starts[i]), int(self.sizes[i])))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checks[i]:
            raise ValueError(f"frame {i}: wrong checksum")
        return data

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int, bytes]]:
        """(doc_id, ids before it in this file, its id bytes), in file order."""
        before = np.concatenate([[0], np.cumsum(self.counts)])
        opened, data, base = -1, b"", 0
        for k in range(len(self.doc_ids)):
            if wanted is not None and int(self.doc_ids[k]) not in wanted:
                continue
            if (i := int(self.frames[k])) != opened:
                opened, data = i, self.frame(i)
                base = int(before[np.searchsorted(self.frames, i)])
            at = (int(before[k]) - base) * self.width
            yield int(self.doc_ids[k]), int(before[k]), data[at : at + int(self.counts[k]) * self.width]


def write_token_files(encoded: DataFrame, path: str, cuts: list[float], width: int = 2) -> DataFrame:
    """Write (doc_id, ids) in ascending doc_id order as files of a folder; (file, part, n_docs, n_ids) a file.

    cuts: where one file's range of doc_id ends and the next begins, from range_cuts over the documents themselves, so
    that nothing is encoded to find them.

    Files are written whole under a name that the partition decides, so a repeated task writes the same again. Rows
    without doc_id come first, under the id NO_ID, and are null again when read.
    """
    ordered = by_range(encoded, "doc_id", cuts).repartitionById(len(cuts) + 1, "part").select("doc_id", "ids").sortWithinPartitions("doc_id", "ids")

    def run(batches):
        part, said = TaskContext.get().partitionId(), []

        def docs():
            for b in batches:
                yield from zip(b.column("doc_id").fill_null(NO_ID).to_pylist(), b.column("ids").to_pylist(), strict=True)

        put(path, f"tokens-{part:06d}.zst", lambda out: said.append(write_file(out, docs(), width)))
        yield [f"{path}/tokens-{part:06d}.zst"], [part], [said[0][0]], [said[0][1]]

    return mapped(ordered, run, "file string, part int, n_docs long, n_ids long")


def read_token_files(listing: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in the files that write_token_files lists, four bytes an id.

    listing has a row a file; it is small, and its running sum of ids gives each file's start.
    """
    spark = listing.sparkSession
    rows, base = [], 0
    for r in sorted(listing.collect(), key=lambda r: r.part):
        if r.n_docs:
            rows.append((r.file, base))
        base += r.n_ids
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, ids binary")
    files = spark.createDataFrame(rows, "file string, base long").repartition(len(rows), "file")

    def run(batches):
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                reader, held, size = Reader(file), [], 0
                for doc_id, start, data in reader.documents():
                    held.append((None if doc_id == NO_ID else doc_id, base + start, data if reader.width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()))
                    size += len(data)
                    if size > FRAME_BYTES * 16:
                        yield tuple(map(list, zip(*held, strict=True)))
                        held, size = [], 0
                if held:
                    yield tuple(map(list, zip(*held, strict=True)))

    return mapped(files, run, "doc_id long, start long, ids binary")


def op8_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = fresh_dir(spark, "tokens")
    files = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listing = write_token_files(encode_ids(docs), path, range_cuts(docs, "doc_id", files))
    return read_token_files(listing).select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_token_files": op8_token_files}
