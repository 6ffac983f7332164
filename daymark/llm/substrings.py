"""Exact substring dedup: bytes covered by a long string that also starts earlier are removed.

A string of `length` bytes holds at least one anchor: the place of the least hash of GRAM bytes among those that
start in it. Equal strings have it at the same offset, so only anchors with equal grams need meet.

1. Anchors of all documents, with a hash of the bytes that any such string around them can reach (their context),
   are dealt out by gram, one of each context from a task. A context that occurred before is covered as a whole. Of a
   gram that stands in several contexts, the first occurrence of each goes on.
2. The bytes of those contexts are dealt out by gram again. In each block, the Burrows-Wheeler transform of the
   contexts is extended backward, breadth first, which derives the common prefixes of neighbouring suffixes in
   increasing order; the search stops at `length`, and what then has no value has a common prefix of at least that.
   Of each such group of suffixes all but the earliest are covered. A gram with very many contexts is dealt out by
   the part that the strings of a few offsets have in common instead.
3. Each document gets its covered spans.

Exact copies of whole documents are found by a digest first, and a task emits no anchors for a text of which it has
seen an earlier copy, so a large group of copies costs each task one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_range, mapped, outermost, range_cuts, table, written

LENGTH = 100
GRAM = 32
#: Bytes that are hashed at once, and anchors that a task holds before it deals them out.
BLOCK = 2 << 20
HELD = 500_000
#: Contexts of one gram beyond which the gram is split, and of one transform.
HOT = 4096
CONTEXTS = 512
#: Offsets that stay together in a split gram.
OFFSETS = 8
NO_ID = (1 << 63) - 1

_C = np.uint64(0x9E3779B97F4A7C15)
_D = np.uint64(0xD6E8FEB86659FD93)
_NAMES = np.random.default_rng(11).integers(1, 1 << 63, 257, dtype=np.uint64) | np.uint64(1)

ANCHOR = np.dtype([("gram", "<u8"), ("context", "<u8"), ("rid", "<i8"), ("pos", "<i4")])
PLACE = np.dtype([("rid", "<i8"), ("pos", "<i4"), ("hot", "u1"), ("gram", "<u8")])
MARK = np.dtype([("rid", "<i8"), ("pos", "<i4")])
SPAN = np.dtype([("rid", "<i8"), ("start", "<i4"), ("end", "<i4")])


def reach(length: int) -> int:
    """Offsets that the anchor of a string can have."""
    return length - GRAM + 1


def _double(h: np.ndarray, s: int) -> np.ndarray:
    x = h[:-s] * _C + h[s:]
    x ^= x >> np.uint64(29)
    x *= _D
    return x


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each `width` neighbours; the result is shorter by width - 1."""
    n, size = len(x), 1
    while 2 * size <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: n - width + 1], x[width - size : width - size + n - width + 1])


def anchors(texts: list[bytes], rids: list[int], length: int = LENGTH) -> np.ndarray:
    """The anchors of some texts, all of at least `length` bytes."""
    w = reach(length)
    pad = np.full(length, 256, np.uint16)
    parts, starts, at = [pad], [], length
    for t in texts:
        parts += [np.frombuffer(t, np.uint8).astype(np.uint16), pad]
        starts.append(at)
        at += len(t) + length
    starts = np.array(starts)
    ends = starts + np.array([len(t) for t in texts])
    h = _NAMES[np.concatenate(parts)]
    size = 1
    while size < GRAM:
        h = _double(h, size)
        size *= 2
    wide = _double(h, GRAM)  # of 2 * GRAM bytes
    n = len(h)
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends - GRAM + 1, -1)
    h[np.cumsum(inside[:-1], dtype=np.int8) == 0] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = _slide(h, w, np.minimum)
    whole = np.zeros(len(least) + 1, np.int8)
    np.add.at(whole, starts, 1)
    np.add.at(whole, ends - length + 1, -1)
    least[np.cumsum(whole[:-1], dtype=np.int8) == 0] = 0
    most = _slide(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    p = np.flatnonzero(most[: len(least) + w - 1] == h[: len(least) + w - 1])
    out = np.empty(len(p), ANCHOR)
    out["gram"] = h[p]
    context = wide[p - (w - 1)]
    for q in (*range(p_step := 2 * GRAM, w - 1 + length - 2 * GRAM, p_step), w - 1 + length - 2 * GRAM):
        context = (context * _C ^ (context >> np.uint64(31))) * _D + wide[p - (w - 1) + q]
    out["context"] = context
    doc = np.searchsorted(starts, p, side="right") - 1
    out["rid"] = np.array(rids, np.int64)[doc]
    out["pos"] = p - starts[doc]
    return out


def dealt(rows: np.ndarray, bucket: np.ndarray) -> tuple[list[int], pa.Array]:
    """Rows of one bucket after the other, as bytes, field by field."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*cut[1:], len(rows)]
    return bucket[cut].tolist(), pa.array([packed(rows[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())


def packed(rows: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in rows.dtype.names)


def unpacked(data: list[bytes], dtype: np.dtype) -> np.ndarray:
    out = []
    for d in data:
        n, at = len(d) // dtype.itemsize, 0
        rows = np.empty(n, dtype)
        for f in dtype.names:
            rows[f] = np.frombuffer(d, dtype[f], n, at)
            at += n * dtype[f].itemsize
        out.append(rows)
    return np.concatenate(out) if out else np.empty(0, dtype)


def gathered(batches, dtype: np.dtype, column: str = "data") -> np.ndarray:
    return unpacked([x for b in batches for x in b.column(column).to_pylist()], dtype)


def first_contexts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose context occurred before; and of grams with several contexts, the first place of each."""
    rows = rows[np.lexsort((rows["pos"], rows["rid"], rows["context"], rows["gram"]))]
    new_gram = np.ones(len(rows), bool)
    new_gram[1:] = rows["gram"][1:] != rows["gram"][:-1]
    new = new_gram.copy()
    new[1:] |= rows["context"][1:] != rows["context"][:-1]
    number = np.cumsum(new_gram) - 1
    contexts = np.bincount(number, new).astype(np.int64)[number] if len(rows) else np.empty(0, np.int64)
    places = np.empty(len(rows), PLACE)
    for f in ("rid", "pos", "gram"):
        places[f] = rows[f]
    places["hot"] = contexts > HOT
    return places[~new], places[new & (contexts > 1)]


def one_of_each(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose context stands earlier in the rows, and the first row of each context."""
    rows = rows[np.lexsort((rows["pos"], rows["rid"], rows["context"], rows["gram"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["gram"][1:] != rows["gram"][:-1]) | (rows["context"][1:] != rows["context"][:-1])
    return rows[~new][["rid", "pos"]].astype(MARK), rows[new]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The order of the suffixes by their first `depth` symbols, and what is known of it after the first sort: its
    number of symbols; whether each suffix shares fewer with the one before; and where they share one fewer.

    Keys are as many neighbouring symbols as a word holds, then as many neighbouring ranks.
    """
    n = len(text)
    code = np.cumsum(np.bincount(text) > 0) - 1
    bits = max(int(code[-1]).bit_length(), 1)
    done = min(63 // bits, depth)
    own = np.concatenate([code[text], np.zeros(done, np.int64)])
    key = own[:n].copy()
    for i in range(1, done):
        key <<= bits
        key |= own[i : i + n]
    first = None
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if first is None:
            ends = np.flatnonzero(new)[1:]
            first = new, ends[ordered[ends] >> bits == ordered[ends - 1] >> bits], done
        ranks = np.cumsum(new)
        if done >= depth or ranks[-1] == n:
            return order, *first
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        width = int(ranks[-1]).bit_length()
        times = min(63 // width, -(-depth // done))
        key = rank.copy()
        for i in range(1, times):
            key <<= width
            key[: max(n - i * done, 0)] |= rank[i * done :]
        done *= times


def bounded_prefixes(text: np.ndarray, order: np.ndarray, apart: np.ndarray, ends: np.ndarray, depth: int, length: int) -> np.ndarray:
    """Whether each suffix in order shares fewer than `length` symbols with the one before it; apart: fewer than `depth`;
    ends: where it shares depth - 1.

    Intervals of the suffix order that start with a string w are extended backward to those of cw through the
    transform, breadth first, from the strings of `depth` symbols on. The first interval of a length l + 1 that ends before
    a place not yet known tells that the suffixes there share l symbols. Symbol 0 separates texts and is never extended over.
    """
    n = len(text)
    before = text[order - 1]  # the transform; the first symbol's is the last, a separator
    back = np.empty(n, np.int64)
    back[np.argsort(before, kind="stable")] = np.arange(n)
    known = np.append(apart, True)
    starts = np.flatnonzero(apart)
    lo, hi = starts[np.searchsorted(starts, ends) - 1], ends
    gaps = np.concatenate([[0], np.cumsum(text == 0)])
    whole = gaps[np.minimum(order[lo] + depth, n)] == gaps[order[lo]]
    lo, hi = lo[whole], hi[whole]
    scratch = np.full(n, -1, np.int64)
    for _ in range(depth, length):
        if not len(lo):
            break
        size = hi - lo
        number = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(number)) - np.repeat(np.cumsum(size) - size, size) + lo[number]
        symbol = before[at] > 0
        at, number = at[symbol], number[symbol]
        f = back[at]
        if len(f) > n // 16:
            scratch[f] = number
            f = np.flatnonzero(scratch >= 0)
            number = scratch[f]
            scratch[f] = -1
        else:
            turn = np.argsort(f)
            f, number = f[turn], number[turn]
        if not len(f):
            break
        # rows of one interval and one symbol are neighbours here, and no others lie between
        new = np.ones(len(f), bool)
        symbol = text[order[f]]
        new[1:] = (number[1:] != number[:-1]) | (f[1:] != f[:-1] + 1) | (symbol[1:] != symbol[:-1])
        begin = np.flatnonzero(new)
        lo, hi = f[begin], f[np.append(begin[1:], len(f)) - 1] + 1
        unknown = ~known[hi]
        lo, hi = lo[unknown], hi[unknown]
        known[hi] = True
    return known[:n]


def repeated(context: np.ndarray, rid: np.ndarray, pos: np.ndarray, length: int) -> np.ndarray:
    """Spans covered by a string of another context that starts earlier.

    context: rows of symbols (0 outside the document, else the byte plus 1); pos: where each row starts in its document.
    """
    own = np.zeros((len(context), context.shape[1] + 1), np.uint16)
    own[:, 1:] = context
    counts = own > 0
    counts[:, 0] = True  # a separator before each row
    row, offset = np.nonzero(counts)
    text = np.append(own[counts], np.uint16(0))
    order, *first = suffix_order(text, length)
    apart = bounded_prefixes(text, order, *first, length)
    gaps = np.concatenate([[0], np.cumsum(text == 0)])
    fits = order + length <= len(text)
    fits[fits] = gaps[order[fits] + length] == gaps[order[fits]]
    group = np.cumsum(apart)[fits]
    order = order[fits]
    row, offset = row[order], offset[order] - 1
    return later(group, rid, row, pos[row] + offset, length)


def later(group: np.ndarray, rid: np.ndarray, row: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Spans of the strings that aren't the earliest of their group, those of a document joined where they touch. Groups
    come one after the other; a string starts at a place of a row's document."""
    if not len(group):
        return np.empty(0, SPAN)
    names, number = np.unique(rid, return_inverse=True)
    place = number[row] << 32 | start
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    first = np.minimum.reduceat(place, np.flatnonzero(new))[np.cumsum(new) - 1]
    place = np.unique(place[place != first])
    start = place & 0xFFFFFFFF
    return joined_spans(names[place >> 32], start, start + length)


def joined_spans(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    turn = np.lexsort((start, rid))
    rid, start, end = rid[turn], start[turn].astype(np.int64), end[turn].astype(np.int64)
    if not len(rid):
        return np.empty(0, SPAN)
    number = np.cumsum(np.concatenate([[True], rid[1:] != rid[:-1]])).astype(np.int64)
    far = int(end.max()) + 2
    reached = np.maximum.accumulate(end + number * far) - number * far  # the furthest end so far in the document
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (start[1:] > reached[:-1])
    at = np.flatnonzero(new)
    out = np.empty(len(at), SPAN)
    out["rid"], out["start"] = rid[at], start[at]
    out["end"] = reached[np.append(at[1:], len(rid)) - 1]
    return out


def ranked(docs: DataFrame, partitions: int) -> DataFrame:
    """(rid, and the columns of docs) with rid in the order of (doc_id, text), nulls last: for tables with repeated or missing ids."""
    own = docs.withColumn("key", F.coalesce("doc_id", F.lit(NO_ID)))
    cuts = range_cuts(own, "key", partitions)
    parts = by_range(own, "key", cuts)
    before, counts = 0, {}
    for r in sorted(parts.groupBy("part").count().collect()):
        counts[r.part] = before
        before += r["count"]

    names = docs.columns

    def run(batches):
        n = None
        for b in batches:
            n = counts[b.column("part")[0].as_py()] if n is None else n
            yield list(range(n, n := n + b.num_rows)), *map(b.column, names)

    schema = ", ".join(["rid long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)])
    return mapped(parts.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("key", "text"), run, schema)


def covered_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, list[float]]:
    """Rows (part, kind, data) of packed spans by ranges of rid, and rows of later copies (part, kind, rid); and the cuts.

    docs: (rid, doc_id, text).
    """
    spark = docs.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = range_cuts(docs, "rid", buckets)
    edges, w = np.array(cuts), reach(length)
    part_of = lambda rid: np.searchsorted(edges, rid.astype(np.float64), side="right")

    def placed(batches):
        seen: dict[bytes, int] = {}
        texts, rids, size = [], [], 0
        held, count = [], 0

        def flush():
            """One row of each context by gram; the others are covered already, and go with the bucket of their part's number."""
            covered, rows = one_of_each(np.concatenate(held))
            bucket, data = dealt(rows, (rows["gram"] * _D >> np.uint64(33)).astype(np.int64) % buckets)
            yield bucket, [-1] * len(bucket), data
            if len(covered):
                part, data = dealt(covered, part_of(covered["rid"]))
                yield [p % buckets for p in part], part, data

        for b in batches:
            for rid, text in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = text.encode()
                if len(data) < length:
                    continue
                key = hashlib.blake2b(data, digest_size=16).digest()
                if seen.get(key, NO_ID) < rid:
                    continue
                seen[key] = rid
                texts.append(data)
                rids.append(rid)
                size += len(data)
                if size > BLOCK:
                    held.append(anchors(texts, rids, length))
                    count += len(held[-1])
                    texts, rids, size = [], [], 0
                if count > HELD:
                    yield from flush()
                    held, count = [], 0
        if texts:
            held.append(anchors(texts, rids, length))
        if held:
            yield from flush()

    def met(batches):
        packs = []
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                if part >= 0:
                    yield [part], [1], pa.array([data], pa.binary())
                else:
                    packs.append(data)
        covered, several = first_contexts(unpacked(packs, ANCHOR))
        for kind, rows in ((1, covered), (2, several)):
            if len(rows):
                part, data = dealt(rows if kind == 2 else rows[["rid", "pos"]], part_of(rows["rid"]))
                yield part, [kind] * len(part), data

    places = mapped(docs.select("rid", "text"), placed, "bucket int, part int, data binary").repartitionById(buckets, "bucket")
    places = written(mapped(places, met, "part int, kind int, data binary"), "places")

    text_rows = by_range(docs.select("rid", F.encode("text", "UTF-8").alias("data")), "rid", cuts).withColumn("kind", F.lit(9))

    def contexts(batches):
        marks, held, zipped = None, [], zstandard.ZstdCompressor(level=1)

        def flush():
            rows = np.concatenate(held)
            bucket, data = dealt(rows, (rows["key"] * _D >> np.uint64(33)).astype(np.int64) % buckets)
            return bucket, pa.array([zipped.compress(x.as_py()) for x in data], pa.binary())

        waiting, count = [], 0
        for b in batches:
            for kind, rid, data in zip(b.column("kind").to_pylist(), b.column("rid").to_pylist(), b.column("data").to_pylist(), strict=True):
                if kind != 9:
                    waiting.append(data)
                    continue
                if marks is None:
                    marks = unpacked(waiting, PLACE)
                    marks = marks[np.argsort(marks["rid"], kind="stable")]
                    waiting = []
                lo, hi = np.searchsorted(marks["rid"], [rid, rid + 1] if rid < NO_ID else [rid, rid])
                if lo < hi:
                    held.append(cut_out(data, marks[lo:hi], length))
                    count += len(held[-1])
                    if count > 100_000:
                        yield flush()
                        held, count = [], 0
        if held:
            yield flush()

    both = places.where("kind = 2").withColumn("rid", F.lit(None).cast("long")).unionByName(text_rows)
    around = mapped(both.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("kind").select("kind", "rid", "data"), contexts, "bucket int, data binary")

    def compared(batches):
        unzip = zstandard.ZstdDecompressor()
        rows = unpacked([unzip.decompress(x) for b in batches for x in b.column("data").to_pylist()], context_type(length))
        rows = rows[np.argsort(rows["key"], kind="stable")]
        for at in blocks(rows["key"], CONTEXTS):
            own = shared_part(rows[at], length)
            if not len(own):
                continue
            spans = repeated(symbols(own), own["rid"], own["pos"], length)
            if len(spans):
                part, data = dealt(spans, part_of(spans["rid"]))
                yield part, [3] * len(part), data

    spans = mapped(around.repartitionById(buckets, "bucket"), compared, "part int, kind int, data binary")
    return places.where("kind = 1").unionByName(spans), text_rows, cuts


def shared_part(rows: np.ndarray, length: int) -> np.ndarray:
    """Contexts, sorted by key, without what can't be in a string that another context of the key has around its anchor too;
    those without such a string go.

    In the order of what follows the anchors, the longest beginning that a context shares is shared with a neighbour;
    and so it is before the anchors.
    """
    w = reach(length)
    left, right = rows["bytes"][:, w - 2 :: -1] if w > 1 else rows["bytes"][:, :0], rows["bytes"][:, w - 1 + GRAM :]
    number = np.cumsum(np.diff(rows["key"], prepend=rows["key"][:1]) != 0)
    ends = []
    for side in (left, right):
        n = side.shape[1]
        words = np.zeros((len(rows), -(-max(n, 1) // 8) * 8), np.uint8)
        words[:, :n] = side
        words = words.view(">u8").astype(np.uint64)
        order = np.lexsort((*words.T[::-1], number))
        same = np.zeros((max(len(rows) - 1, 0), n + 1), bool)
        same[:, :n] = side[order[1:]] == side[order[:-1]]
        length_of = np.where(number[order[1:]] == number[order[:-1]], np.argmin(same, axis=1), -1)
        most = np.empty(len(rows), np.int64)
        most[order] = np.maximum(np.append(length_of, -1), np.append(-1, length_of))
        ends.append(most)
    alone = (ends[0] < 0) | (ends[1] < 0)
    out = rows.copy()
    out["lead"] = np.maximum(rows["lead"], np.maximum(w - 1 - ends[0], 0))
    out["tail"] = np.minimum(rows["tail"], w - 1 + GRAM + np.maximum(ends[1], 0))
    return out[~alone & (out["tail"].astype(np.int64) - out["lead"] >= length)]


def context_type(length: int) -> np.dtype:
    """A context's bytes; those before lead and from tail on don't count."""
    return np.dtype([("key", "<u8"), ("rid", "<i8"), ("pos", "<i4"), ("lead", "<u2"), ("tail", "<u2"), ("bytes", "u1", (length + reach(length) - 1,))])


def symbols(rows: np.ndarray) -> np.ndarray:
    """0 for what doesn't count, else the byte plus 1."""
    at = np.arange(rows["bytes"].shape[1])
    return np.where((at >= rows["lead"][:, None]) & (at < rows["tail"][:, None]), rows["bytes"].astype(np.uint16) + np.uint16(1), np.uint16(0))


def cut_out(data: bytes, marks: np.ndarray, length: int) -> np.ndarray:
    """The contexts of a document's marked anchors; those of split grams once for each group of offsets."""
    w = reach(length)
    width = length + w - 1
    text = np.zeros(len(data) + 2 * length, np.uint8)
    text[length : length + len(data)] = np.frombuffer(data, np.uint8)
    rows = np.empty(len(marks), context_type(length))
    rows["key"], rows["rid"], rows["pos"] = marks["gram"], marks["rid"], marks["pos"] - (w - 1)
    rows["lead"], rows["tail"] = np.maximum(-rows["pos"], 0), np.minimum(len(data) - rows["pos"], width)
    rows["bytes"] = text[(rows["pos"] + length)[:, None].astype(np.int64) + np.arange(width)]
    hot = marks["hot"] > 0
    if not hot.any():
        return rows
    out = [rows[~hot]]
    for lo in range(0, w, OFFSETS):
        hi = min(lo + OFFSETS, w)  # strings that start at offsets lo to hi - 1 share the bytes from hi - 1 to lo + length
        own = rows[hot].copy()
        own["lead"], own["tail"] = np.maximum(own["lead"], lo), np.minimum(own["tail"], hi - 1 + length)
        core = [hashlib.blake2b(x.tobytes(), digest_size=8).digest() for x in own["bytes"][:, hi - 1 : lo + length]]
        own["key"] ^= np.frombuffer(b"".join(core), "<u8") * _C + np.uint64(lo + 1)
        out.append(own)
    return np.concatenate(out)


def blocks(keys: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of whole groups of equal sorted keys, of about `most` rows unless a group has more."""
    ends = [*np.flatnonzero(np.diff(keys)) + 1, len(keys)] if len(keys) else []
    begin = last = 0
    for end in map(int, ends):
        if end - begin > most and last > begin:
            yield slice(begin, last)
            begin = last
        last = end
    if last > begin:
        yield slice(begin, last)


def drop_repeated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", passed: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_text, and the passed columns): each document's bytes without those that a
    string of `length` bytes which also starts earlier covers; earlier means a smaller doc_id, or an earlier place in
    the same document.

    A null text is empty; a text shorter than `length` keeps all. Documents without doc_id come last; rows with the
    same doc_id are in the order of their texts, and of equal rows the first keeps its bytes. Columns that aren't
    passed go.
    """
    spark = docs.sparkSession
    partitions = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    extra = [f"passed_{i}" for i in range(len(passed))]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(x) for c, x in zip(passed, extra, strict=True)))
    odd = own.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    rows = written(ranked(own, partitions), "ranked") if odd else own.withColumn("rid", F.col("doc_id"))
    spans, _, cuts = covered_spans(rows.select("rid", "text"), length)
    narrow = rows.where(F.octet_length("text") >= length).select("rid", F.md5("text").alias("digest"))
    copies = by_range(outermost(narrow, ["digest"], "rid").where("rid != first").select("rid"), "rid", cuts)
    text_rows = by_range(rows.select("rid", "doc_id", F.encode("text", "UTF-8").alias("data"), *extra), "rid", cuts).withColumn("kind", F.lit(9))
    w = reach(length)

    def cleaned(batches):
        places, found, copied, marks, whole = [], [], [], None, None
        for b in batches:
            out = []
            for kind, rid, doc_id, data, *rest in zip(*(b.column(c).to_pylist() for c in ("kind", "rid", "doc_id", "data", *extra)), strict=True):
                if kind == 1:
                    places.append(data)
                elif kind == 2:
                    copied.append(rid)
                elif kind == 3:
                    found.append(data)
                else:
                    if marks is None:
                        marks, whole = merged(unpacked(places, MARK), unpacked(found, SPAN), w, length), set(copied)
                        places, found, copied = [], [], []
                    own = without(data, rid, marks, rid in whole)
                    out.append((doc_id, *own, readable(own[3]), *rest))
            if out:
                yield tuple(map(list, zip(*out, strict=True)))

    both = spans.withColumn("rid", F.lit(None).cast("long")).unionByName(copies.withColumn("kind", F.lit(2)), allowMissingColumns=True).unionByName(text_rows, allowMissingColumns=True)
    both = both.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("kind").select("kind", "rid", "doc_id", "data", *extra)
    schema = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string", *(f"{x} {own.schema[x].dataType.simpleString()}" for x in extra)])
    return mapped(both, cleaned, schema).toDF("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", *passed)


def merged(places: np.ndarray, spans: np.ndarray, w: int, length: int) -> np.ndarray:
    """All covered spans, by document and start, joined where they touch."""
    rid = np.concatenate([places["rid"], spans["rid"]])
    start = np.concatenate([np.maximum(places["pos"].astype(np.int64) - (w - 1), 0), spans["start"]])
    end = np.concatenate([places["pos"].astype(np.int64) + length, spans["end"]])
    return joined_spans(rid, start, end)


def readable(data: bytes) -> str:
    """The text of what stayed of a document; a character of which a part went goes as a whole."""
    return data.decode("utf-8", errors="ignore")


def without(data: bytes, rid: int, marks: np.ndarray, whole: bool) -> tuple[int, int, int, bytes]:
    n = len(data)
    if whole:
        return n, n, 1, b""
    lo = np.searchsorted(marks["rid"], rid)
    kept, at, removed, spans = [], 0, 0, 0
    while lo < len(marks) and marks["rid"][lo] == rid:
        start, end = int(marks["start"][lo]), min(int(marks["end"][lo]), n)
        kept.append(data[at:start])
        removed += end - start
        spans += 1
        at, lo = end, lo + 1
    return n, removed, spans, b"".join([*kept, data[at:]])


def op2_substrings(spark, sf_dir):
    return drop_repeated(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_substrings": op2_substrings}
