"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, those into longer phrases, and so on. At each level runs of one symbol are
one symbol; four rounds of deterministic coin tossing turn each symbol, from the lowest bit in which its name differs
from its left neighbour's, into one of six labels that differs from its neighbour's; and a phrase begins at each
local maximum of the labels. Where a phrase begins depends on four symbols to the left and one to the right, and its
name is a hash of its symbols, so equal substrings get the same phrases inside, wherever they stand.

Levels follow each other until a text is one phrase. As parsing is local, a long text is parsed window by window at
each level, with a margin of a few symbols on both sides, and gets the same phrases.

A fingerprint is the hash of the whole text's parse and a sketch of the set of its phrase names from level 2 on:
the names fall into bins, and each bin keeps 8 bits of its least name. The likeness of two fingerprints is the part
of their bins that agree, corrected for chance agreement of 8 bits: an estimate of the sets' Jaccard similarity.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_range, keep_text, mapped, range_cuts, table

BINS = 128
#: The first level whose phrases are in the sketch.
FROM_LEVEL = 2
#: Bytes of texts, or symbols of one longer text, that are parsed at once.
BLOCK = 1 << 20
#: Runs beside a window that decide its phrases: more than a phrase's longest and what its labels depend on.
MARGIN = 32
NO_ID = -(1 << 63)

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_NAME = mix(np.arange(1, 257, dtype=np.uint64) * _M1)


def toss(own: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which a name differs from its left neighbour's, plus its own bit there."""
    low = own ^ left
    low &= ~low + np.uint64(1)
    return (2 * np.bitwise_count(low - np.uint64(1)) + ((own & low) != 0)).astype(np.uint8)


#: The same for two bytes' names, and for two labels below 128.
_BYTES = toss(np.repeat(_NAME, 256), np.tile(_NAME, 256))
_LABELS = toss(np.repeat(np.arange(128, dtype=np.uint64), 128), np.tile(np.arange(128, dtype=np.uint64), 128))


def labels(first: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Three more rounds over the first round's labels; a text's first symbol is told by its lowest bit."""
    out = first
    for _ in range(3):
        again = np.empty_like(out)
        again[1:] = _LABELS[out[1:].astype(np.uint16) * np.uint16(128) + out[:-1]]
        again[head] = out[head] & 1
        out = again
    return out


def parse_level(symbols: np.ndarray, head: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase names of one level, where each text's begin among them, and where each phrase begins among the symbols.

    symbols: names of all texts, one after the other; head: where each text begins (none is empty); first: the first
    round's labels where they are known.
    """
    n = len(symbols)
    starts = np.zeros(n, bool)
    starts[head] = True
    keep = starts.copy()
    keep[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(keep)
    length = np.diff(at, append=n)
    own = symbols[at]
    head = np.searchsorted(at, head)
    label = np.empty(len(at), np.uint8)
    if first is None:
        label[1:] = toss(own[1:], own[:-1])
        label[head] = toss(own[head], ~own[head])
    else:
        label[:] = first[at]
    label = labels(label, head)
    run = length > 1
    if run.any():
        own = own.copy()
        own[run] = mix(own[run] + _M1 * length[run].astype(np.uint64))
    peak = np.zeros(len(at), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    if len(head) > 1:
        peak[head[1:] - 1] = False  # a text's last symbol has no right neighbour
    peak[head] = True
    begin = np.flatnonzero(peak)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))
    names = mix(np.add.reduceat(mix(own + _M1 * (place + 1).astype(np.uint64)), begin))
    return names, np.searchsorted(begin, head), at[begin]


def first_labels(data: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The first round's labels of bytes."""
    first = np.empty(len(data), np.uint8)
    first[1:] = _BYTES[data[1:].astype(np.uint16) * np.uint16(256) + data[:-1]]
    first[head] = _NAME[data[head]] & np.uint64(1)
    return first


def run_starts(symbols: np.ndarray, at: int, many: int, step: int) -> int:
    """The place that `many` runs of equal symbols lie between it and a place, to the left or (step 1) to the right."""
    size = 4 * many
    while True:
        low, high = (max(0, at - size), at) if step < 0 else (at, min(len(symbols), at + size))
        own = symbols[low:high]
        changes = low + 1 + np.flatnonzero(own[1:] != own[:-1])
        if len(changes) >= many:
            return int(changes[-many] if step < 0 else changes[many - 1])
        if (low == 0) if step < 0 else (high == len(symbols)):
            return low if step < 0 else high
        size *= 4


def parse_windows(symbols: np.ndarray, of_bytes: bool) -> np.ndarray:
    """Phrase names of one level of one text, a window of BLOCK symbols at a time."""
    out = []
    for a in range(0, len(symbols), BLOCK):
        b = min(a + BLOCK, len(symbols))
        low, high = run_starts(symbols, a, MARGIN, -1), run_starts(symbols, b, MARGIN, 1)
        own, head = symbols[low:high], np.zeros(1, np.int64)
        first = first_labels(own, head) if of_bytes else None
        names, _, begin = parse_level(_NAME[own] if of_bytes else own, head, first)
        # a run that a window's edge cuts belongs to the window in which it begins
        out.append(names[(begin + low >= a) & (begin + low < b)])
    return np.concatenate(out)


class Sketches:
    """The least name of each text in each bin."""

    def __init__(self, texts: int):
        self.least = np.full((texts, BINS), np.uint64(0xFFFFFFFFFFFFFFFF))

    def add(self, symbols: np.ndarray, size: np.ndarray) -> None:
        cell = np.repeat(np.arange(len(size)) * BINS, size) + (symbols & np.uint64(BINS - 1)).astype(np.int64)
        np.minimum.at(self.least.reshape(-1), cell, symbols >> np.uint64(7))

    def rows(self, last: np.ndarray) -> np.ndarray:
        """Fingerprints, from each text's last phrase and its bins."""
        out = np.zeros((len(last), 8 + BINS), np.uint8)
        out[:, :8] = mix(last + _M2)[:, None].view(np.uint8)
        bits = ((self.least >> np.uint64(20)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
        bits[self.least == np.uint64(0xFFFFFFFFFFFFFFFF)] = 0
        out[:, 8:] = bits
        return out


def long_fingerprint(text: bytes) -> bytes:
    """The fingerprint of one text, in windows: besides the text, a level's names and one window are held."""
    symbols, sketch, level = np.frombuffer(text, np.uint8), Sketches(1), 0
    while level < FROM_LEVEL or len(symbols) > 1:
        symbols, level = parse_windows(symbols, level == 0), level + 1
        if level >= FROM_LEVEL:
            for a in range(0, len(symbols), BLOCK):
                part = symbols[a : a + BLOCK]
                sketch.add(part, np.array([len(part)]))
    return sketch.rows(symbols)[0].tobytes()


def fingerprints(texts: list[bytes]) -> list[bytes]:
    """8 bytes for the whole text and BINS for the sketch; an empty text has zeros."""
    out = np.zeros((len(texts), 8 + BINS), np.uint8)
    full = np.flatnonzero([len(t) > 0 for t in texts])
    if not len(full):
        return [x.tobytes() for x in out]
    data = np.frombuffer(b"".join(texts), np.uint8)
    head = np.concatenate([[0], np.cumsum([len(texts[i]) for i in full])[:-1]]).astype(np.int64)
    symbols, of_level, sketch, level = _NAME[data], first_labels(data, head), Sketches(len(full)), 0
    while level < FROM_LEVEL or len(symbols) > len(head):
        level += 1
        alone = (np.diff(head, append=len(symbols)) == 1) & (level > FROM_LEVEL)
        was = symbols[head]
        symbols, head, _ = parse_level(symbols, head, of_level)
        symbols[head[alone]] = was[alone]  # a text that is one phrase stays so, however many levels its neighbours need
        of_level = None
        if level >= FROM_LEVEL:
            sketch.add(symbols, np.diff(head, append=len(symbols)))
    out[full] = sketch.rows(symbols)
    return [x.tobytes() for x in out]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of fingerprints: 0 to 1; two texts without phrases are alike."""
    whole = (a[:, :8] == b[:, :8]).all(1)
    a, b = a[:, 8:], b[:, 8:]
    either = ((a > 0) | (b > 0)).sum(1)
    agree = ((a == b) & (a > 0)).sum(1) / np.maximum(either, 1)
    return np.where(whole, 1.0, np.clip((agree - 1 / 255) / (1 - 1 / 255), 0, 1))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text, hexadecimal; a null text is an empty one. No shuffle."""

    def run(batches):
        for b in batches:
            yield b.column("doc_id"), [x.hex() for x in blockwise([t.encode() for t in b.column("text").to_pylist()])]

    return mapped(keep_text(docs, id_col, text_col), run, "doc_id long, fingerprint string")


def blockwise(texts: list[bytes]) -> list[bytes]:
    """fingerprints() over a bounded number of bytes at once; a text longer than that alone, in windows."""
    out, held, size = [], [], 0
    for t in texts:
        if len(t) > BLOCK:
            out += [*fingerprints(held), long_fingerprint(t)]
            held, size = [], 0
            continue
        if held and size + len(t) > BLOCK:
            out += fingerprints(held)
            held, size = [], 0
        held.append(t)
        size += len(t)
    return out + (fingerprints(held) if held else [])


def in_order(docs: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, text, borrowed): each partition has a range of doc_id in descending order, and then the row after it.

    The row after a range is the first of the next lower one, that after the lowest is the first of all; it is flagged
    as borrowed. Only the first id of each partition reaches the driver. Repeated ids are in the order of their texts;
    rows without id come last.
    """
    spark = docs.sparkSession
    cuts = range_cuts(docs, "doc_id", partitions)
    own = by_range(keep_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), "doc_id", cuts)
    firsts = sorted((r.part, r.doc_id) for r in own.groupBy("part").agg(F.max("doc_id").alias("doc_id")).collect())
    lent = [(doc_id, firsts[(k + 1) % len(firsts)][0]) for k, (_, doc_id) in enumerate(firsts)]
    few = F.broadcast(spark.createDataFrame(lent, "doc_id long, part int"))  # a row a partition
    lent_rows = own.drop("part").join(few, "doc_id").select("doc_id", "text", "part", F.lit(True).alias("borrowed"))
    both = own.withColumn("borrowed", F.lit(False)).unionByName(lent_rows)
    return both.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("borrowed", F.desc("doc_id"), "text").drop("part")


def edited(text: str, after: str) -> str:
    """text with its last half of characters replaced by as many, or all, of the next text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def op5_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    partitions = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def compared(rows: list[tuple[int, str]], after: str):
        texts = [t for _, t in rows]
        changed = [edited(t, x) for t, x in zip(texts, [*texts[1:], after], strict=True)]
        coded = [t.encode() for t in changed]
        own = blockwise([t.encode() for t in [*texts, after]])
        new = blockwise(coded)
        grid = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
        a, b = grid(own), grid(new)
        return (
            [None if i == NO_ID else i for i, _ in rows], [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in coded],
            [x.hex() for x in own[:-1]], [x.hex() for x in new], likeness(a[:-1], b), likeness(a[:-1], a[1:]),
        )

    def run(batches):
        held: list[tuple[int, str]] = []
        size, after = 0, None
        for b in batches:
            for doc_id, text, borrowed in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "borrowed")), strict=True):
                if borrowed:
                    after = text if after is None else after
                    continue
                if size > BLOCK:
                    yield compared(held, text)
                    held, size = [], 0
                held.append((doc_id, text))
                size += len(text)
        if held:
            yield compared(held, after)

    return mapped(in_order(docs, partitions), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


QUERIES = {"op5_fingerprints": op5_fingerprints}
