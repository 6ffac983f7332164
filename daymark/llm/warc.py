"""WARC archives of individually compressed records that share a Zstandard dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed; then
comes one frame for each record, compressed with that dictionary, so that a record can be read alone. The
dictionary is built from a bounded sample of the archive's own records. Of records with equal payloads the one with
the largest id carries the payload as a response; the others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_range, folder, fresh_dir, mapped, outermost, put, range_cuts, table

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 1 << 16
#: Bytes of an archive's first records from which its dictionary is built.
SAMPLE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload, but its HTTP head."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"" if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def clean(url: str | None) -> str:
    return (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")


def parse(data: bytes) -> dict:
    """The fields of one record, and the bytes of its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    number = lambda x: None if x == "<urn:page:None>" else int(x.removeprefix("<urn:page:").removesuffix(">"))
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "record_type": fields["WARC-Type"],
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload_bytes": length,
        "payload": payload,
    }


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from records; the records' own bytes as raw content where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_archive(out, records: Iterable[bytes]) -> int:
    """Write one archive; only the sample's records are held at once."""
    records, held, size = iter(records), [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    raw = build_dictionary(held) if held else b""
    packed = zstandard.ZstdCompressor(level=9).compress(raw)
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_content_size=True, write_checksum=True)
    n = 0
    for part in (held, records):
        for r in part:
            out.write(packer.compress(r))
            n += 1
    return n


def read_archive(path: str) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    file_system, at = folder(path)
    with file_system.open_input_stream(at, compression=None) as f:
        magic, length = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{path}: no leading dictionary frame")
        raw = zstandard.ZstdDecompressor().decompress(f.read(length))
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        held = b""
        one, done = None, []
        while True:
            if not held and not (held := f.read(1 << 20)):
                break
            if one is None:
                one, done = unpack.decompressobj(), []
            done.append(one.decompress(held))
            held = one.unused_data if one.eof else b""
            if one.eof:
                yield b"".join(done)
                one = None
        if one is not None:
            raise ValueError(f"{path}: ends within a record")


def digested(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest); a null html is an empty payload."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("payload"))
    return own.withColumn("digest", F.sha1("payload"))


def write_warc(pages: DataFrame, path: str, archives: int, least: int = 0, **columns: str) -> DataFrame:
    """Write a record for every row of pages, in archives by ranges of page_id; (archive, n_records) an archive.

    Payloads of at least `least` bytes that are equal (SHA-1 and length) have one response, the largest page_id; rows
    with the same page_id as well are told apart by nothing, so all of them are responses. Only (digest, page_id)
    goes through the aggregation, by digest and a salt first. Rows without page_id come first and are responses.
    """
    rows = digested(pages, **columns)
    narrow = rows.where(F.length("payload") >= least).select("page_id", "digest", F.length("payload").alias("n_bytes"))
    roles = outermost(narrow, ["digest", "n_bytes"], "page_id", F.max).where("page_id != first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    # one shuffle for the payloads: roles travel to their page's range, and meet it there in the order of the sort
    cuts = range_cuts(pages, columns.get("id_col", "page_id"), archives)
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).withColumn("is_page", F.lit(True)).unionByName(roles.withColumn("is_page", F.lit(False)), allowMissingColumns=True)
    both = by_range(both, "page_id", cuts).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("page_id", "digest", "is_page")

    def run(batches):
        part, said = TaskContext.get().partitionId(), []

        def records():
            role = (None, None, None)
            for b in batches:
                for page_id, url, payload, digest, refers_to, is_page in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "is_page")), strict=True):
                    if not is_page:
                        role = (page_id, digest, refers_to)
                    else:
                        first = role[2] if role[:2] == (page_id, digest) else None
                        yield record(page_id, url, payload, len(payload), base64.b32encode(bytes.fromhex(digest)).decode(), first)

        put(path, f"pages-{part:06d}.warc.zst", lambda out: said.append(write_archive(out, records())))
        yield [f"{path}/pages-{part:06d}.warc.zst"], [said[0]]

    return mapped(both.select("page_id", "url", "payload", "digest", "refers_to", "is_page"), run, "archive string, n_records long")


def read_warc(listing: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record, from the archives.

    A response's length and digest are taken from the payload that is read and must agree with its head.
    """
    spark = listing.sparkSession
    paths = [(r.archive,) for r in listing.where("n_records > 0").collect()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    if not paths:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            for path in b.column("archive").to_pylist():
                held, size = [], 0
                for data in read_archive(path):
                    x = parse(data)
                    if x["record_type"] == "response":
                        found = base64.b32encode(hashlib.sha1(x["payload"]).digest()).decode()
                        if (found, len(x["payload"])) != (x["digest"], x["payload_bytes"]):
                            raise ValueError(f"{path}: record {x['page_id']} doesn't agree with its head")
                    held.append([x["page_id"], x["payload_bytes"], x["digest"], x["record_type"], x["refers_to"], *[x["payload"]] * with_payload])
                    size += len(data)
                    if len(held) >= 5000 or size > 32 << 20:
                        yield tuple(map(list, zip(*held, strict=True)))
                        held, size = [], 0
                if held:
                    yield tuple(map(list, zip(*held, strict=True)))

    return mapped(spark.createDataFrame(paths, "archive string").repartition(len(paths), "archive"), run, schema)


def op10_warc(spark, sf_dir):
    listing = write_warc(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return read_warc(listing)


QUERIES = {"op10_warc": op10_warc}
