"""Benchmark decontamination: documents that hold a passage within a given edit distance of a benchmark item.

Texts are lowered (A to Z) and white space runs become one space. Candidates come from the pigeonhole bound, so none is
lost: an item is cut into segments, and a passage within the edits allowed has a segment with no more than its share k
of them. Of s disjoint pieces of GRAM bytes of that segment at least s - k then stand in the passage, on diagonals
(place in the text less place in the item) at most k apart. Segments take the s = k + SPARE pieces that are rarest in
the texts at hand; hits of s - k different pieces on diagonals at most k apart make a window. A piece that occurs again
and again at small distances, as in a ruler of dashes, is one hit over a range of diagonals, so that a run costs as much
as a word. Windows that lack more of the item's bytes than it may have edits go; of all others the least edit distance
between the item and a part of the window is taken. This stands in for CGK embeddings and bit-sampling, which README
measures.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, table

GRAM = 4
#: Pieces of a segment besides the edits it may have: so many must stand on near diagonals.
SPARE = 6
SEGMENT = 256
#: Bytes of items in one pass; more items take further passes over the documents.
ITEM_BYTES = 16 << 20
BLOCK = 1 << 20
#: Bytes of texts whose windows are verified together.
TEXTS = 8 << 20
TABLE_BITS = 20
#: Segments whose pieces are chosen at once.
CHOSEN = 512
#: A piece that occurs again so near is in a run, if it goes on so far.
GAP, RUN = 8, 24
#: Hits, and parts of windows, that are held at once.
HITS = 4 << 20
PARTS = 1 << 18
#: Parts of windows whose bytes are counted at once, in cells of so many bytes at least.
COUNTED, CELL = 4096, 64


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of TABLE_BITS of the GRAM bytes from each place on."""
    words = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - GRAM + 1), GRAM), (1, 1)).view("<u4")[:, 0]
    return words * np.uint32(0x9E3779B1) >> np.uint32(32 - TABLE_BITS)


def closest(item: bytes, text: bytes, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance between item and any part of text (anchored: any beginning of it), by bit-parallel
    columns, and where the first such part ends."""
    m = len(item)
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top, low = (1 << m) - 1, 1 << (m - 1), int(anchored)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
        ph = (ph << 1 | low) & full
        mh = mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
    return best, end


def least_edits(item: bytes, text: bytes) -> int:
    """The least edit distance between item and any part of text."""
    return closest(item, text)[0]


def many_least_edits(items: list[bytes], texts: list[bytes]) -> np.ndarray:
    """least_edits() of each item and the text beside it, all at once: columns in words of 64 bits."""
    one, lengths = np.uint64(1), np.array([len(t) for t in items])
    words = -(-int(lengths.max()) // 64)
    own: dict[bytes, int] = {t: i for i, t in enumerate(dict.fromkeys(items))}
    masks = np.zeros((words, 257 * len(own)), np.uint64)
    for t, i in own.items():
        places = np.arange(len(t))
        np.bitwise_or.at(masks, (places // 64, 257 * i + np.frombuffer(t, np.uint8).astype(np.int64)), one << (places % 64).astype(np.uint64))
    base = np.array([257 * own[t] for t in items])
    # rows end with a symbol that no item has, and such columns can't lessen an edit distance
    text = np.full((max(map(len, texts)), len(texts)), 256, np.int16)
    for i, t in enumerate(texts):
        text[: len(t), i] = np.frombuffer(t, np.uint8)
    last, bit = (lengths - 1) // 64, ((lengths - 1) % 64).astype(np.uint64)
    up, down = np.full((words, len(items)), ~np.uint64(0)), np.zeros((words, len(items)), np.uint64)
    score, sixty_three = lengths.copy(), np.uint64(63)
    best = score.copy()
    ends = [(w, rows) for w in range(words) if len(rows := np.flatnonzero(last == w))]
    for column in text:
        at = base + column
        plus = minus = np.zeros(len(items), np.uint64)
        said = {}
        for w in range(words):
            eq, u, d = masks[w][at], up[w], down[w]
            xv = eq | d
            eq |= minus
            xh = (((eq & u) + u) ^ u) | eq
            ph, mh = d | ~(xh | u), u & xh
            said[w] = ph, mh
            p, m = ph >> sixty_three, mh >> sixty_three
            ph, mh = ph << one | plus, mh << one | minus
            up[w], down[w] = mh | ~(xv | ph), ph & xv
            plus, minus = p, m
        for w, rows in ends:
            ph, mh = said[w]
            score[rows] += ((ph[rows] >> bit[rows] & one).astype(np.int64) - (mh[rows] >> bit[rows] & one).astype(np.int64))
        np.minimum(best, score, out=best)
    return best


def merged(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of a group that overlap or touch as one, ordered by group and place."""
    if not len(low):
        return group, low, high
    least = int(low.min())
    width = int(high.max()) - least + 2
    start, end = group * width + (low - least), group * width + (high - least)
    order = np.argsort(start)
    start, end = start[order], end[order]
    new = np.flatnonzero(np.append(True, start[1:] > np.maximum.accumulate(end)[:-1]))
    start, end = start[new], np.maximum.reduceat(end, new)
    group = start // width
    return group, start - group * width + least, end - group * width + least


def runs_of(places: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the first and last places of runs, in which a slot is again and again at most GAP away, and of the
    places in no run that is long enough; places rise."""
    again = np.zeros(len(places), bool)
    for g in range(1, min(GAP, len(places) - 1) + 1):
        same = (slots[g:] == slots[:-g]) & (places[g:] - places[:-g] <= GAP)
        again[g:] |= same
        again[:-g] |= same
    order = np.flatnonzero(again)
    order = order[np.argsort(slots[order], kind="stable")]
    new = np.flatnonzero((np.diff(slots[order], prepend=-1) != 0) | (np.diff(places[order], prepend=0) > GAP))
    ends = np.append(new[1:], len(order))[: len(new)]
    long = places[order[ends - 1]] - places[order[new]] >= RUN
    again[order] = np.repeat(long, ends - new)
    return order[new[long]], order[ends[long] - 1], np.flatnonzero(~again)


def groups(rows: list, weight):
    """Runs of rows of about 4 BLOCK bytes by weight, at least one row each."""
    held, size = [], 0
    for r in rows:
        if held and size + weight(r) > 4 * BLOCK:
            yield held
            held, size = [], 0
        held.append(r)
        size += weight(r)
    if held:
        yield held


def best_part(item: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance between item and any part of text, and where the first such part begins."""
    if (p := text.find(item)) >= 0:
        return 0, p
    edits, end = closest(item, text)
    return edits, end - closest(item[::-1], text[:end][::-1], True)[1]


def chosen(costs: list[np.ndarray], many: np.ndarray) -> list[np.ndarray]:
    """For each array of costs of places, the given number of places at least GRAM apart whose costs sum to the least."""
    longest, most = max(map(len, costs)) + GRAM - 1, int(many.max())
    cost = np.full((len(costs), longest), np.inf)
    for i, c in enumerate(costs):
        cost[i, : len(c)] = c
    sums = np.full((longest + 1, len(costs), most + 1), np.inf)
    sums[:, :, 0] = 0
    taken = np.zeros(sums.shape, bool)
    for i in range(1, longest + 1):
        sums[i] = sums[i - 1]
        if i >= GRAM:
            own = sums[i - GRAM, :, :-1] + cost[:, i - GRAM, None]
            taken[i, :, 1:] = own < sums[i, :, 1:]
            sums[i, :, 1:] = np.minimum(own, sums[i, :, 1:])
    out = np.zeros((len(costs), most), np.int64)
    at, left, rows = np.full(len(costs), longest), many.copy(), np.arange(len(costs))
    while (left > 0).any():
        take = taken[at, rows, left]
        at = np.where(left > 0, at - np.where(take, GRAM, 1), at)
        left = left - take
        out[rows[take], left[take]] = at[take]
    return [o[:n] for o, n in zip(out, many, strict=True)]


class Items:
    """Some items, ready for search."""

    def __init__(self, rows: list[tuple[int, bytes]], num: int, den: int):
        self.rows = rows
        self.allowed = [len(t) * (den - num) // den for _, t in rows]
        self.lengths = np.array([len(t) for _, t in rows], np.int64)
        self.slack = np.array(self.allowed, np.int64)
        self.short = [k for k, (_, t) in enumerate(rows) if t and len(t) // GRAM <= self.allowed[k]]
        segments = []
        for k, (_, t) in enumerate(rows):
            if len(t) // GRAM > self.allowed[k]:
                parts = -(-len(t) // SEGMENT)
                ends = [len(t) * i // parts for i in range(parts + 1)]
                shares = [(a, b, self.allowed[k] * (b - a) // len(t)) for a, b in pairwise(ends)]
                # pieces of a segment can be too few where rounding takes them: then the item is one segment
                segments += [(k, *x) for x in (shares if all((b - a) // GRAM > e for a, b, e in shares) else [(0, len(t), self.allowed[k])])]
        self.item, self.begin, self.end, self.edits = (np.array(x, np.int64) for x in (zip(*segments, strict=True) if segments else ([],) * 4))
        self.pieces = np.minimum((self.end - self.begin) // GRAM, self.edits + SPARE)
        self.most_edits = int(self.edits.max(initial=0))
        self.ready = False

    def choose(self, data: np.ndarray) -> None:
        """Take the pieces that are rarest in data; which are taken changes the work, not the result."""
        self.ready = True
        often = np.bincount(grams(data), minlength=1 << TABLE_BITS) + 1.0
        held = [grams(np.frombuffer(self.rows[k][1][a:b], np.uint8)) for k, a, b in zip(self.item.tolist(), self.begin.tolist(), self.end.tolist(), strict=True)]
        places: list[np.ndarray] = [np.empty(0, np.int64)] * len(held)
        order = np.argsort(self.end - self.begin, kind="stable")
        for a in range(0, len(order), CHOSEN):
            few = order[a : a + CHOSEN].tolist()
            for x, p in zip(few, chosen([often[held[x]] for x in few], self.pieces[few]), strict=True):
                places[x] = p
        hashes = np.concatenate([np.empty(0, np.uint32), *(h[p] for h, p in zip(held, places, strict=True))])
        segment = np.repeat(np.arange(len(held)), self.pieces)
        order = np.argsort(hashes, kind="stable")
        self.segment, self.place = segment[order], np.concatenate([np.empty(0, np.int64), *places])[order]
        reach = int((self.end - self.begin + self.edits).max())
        # the number of the piece in its segment is the key's lowest part
        number = np.concatenate([np.empty(0, np.int64), *map(np.arange, self.pieces.tolist())])[order]
        self.piece_bits = int(self.pieces.max()).bit_length()
        # a key is the segment, below it the diagonal, and below that the piece; what lies between segments is wider than
        # any band
        self.reach, self.bits = reach, (BLOCK + 4 * reach).bit_length()
        self.key = ((self.segment << self.bits) + reach - self.place << self.piece_bits) + number
        self.least = self.pieces - self.edits
        self.needs = np.unique(self.least).tolist()
        distinct, self.first, self.many = np.unique(hashes[order], return_index=True, return_counts=True)
        self.slot = np.full(1 << TABLE_BITS, -1, np.int32)
        self.slot[distinct] = np.arange(len(distinct))

    def windows(self, texts: list[bytes]) -> np.ndarray:
        """Rows (text, item, begin, end): parts of texts such that every passage within the allowed edits is whole in one."""
        none = np.empty((0, 4), np.int64)
        if not len(self.item):
            return none
        data = np.frombuffer((b"\x00" * GRAM).join([*texts, b""]), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not self.ready:
            self.choose(data[:BLOCK])
        blocks = (self.near(data, a, min(a + BLOCK, len(data))) for a in range(0, len(data), BLOCK))
        return np.concatenate([none, *(p for block in blocks for w in block for p in self.parts(data, sizes, *w))])

    def near(self, data: np.ndarray, a: int, b: int):
        """(item, begin, end) as arrays, of windows that begin about a to b in data; a block of too many hits is halved."""
        reach, bits = self.reach, self.bits
        slots = self.slot[grams(data[a : b + 2 * reach])]
        at = np.flatnonzero(slots >= 0)
        slots = slots[at]
        first, last, alone = runs_of(at, slots)
        if int(self.many[slots[alone]].sum() + self.many[slots[first]].sum()) > HITS and b - a > 4 * reach:
            yield from self.near(data, a, (a + b) // 2)
            yield from self.near(data, (a + b) // 2, b)
            return
        keys = self.hits(slots[alone], at[alone])
        runs = self.hits(slots[first], at[first])
        if len(runs):
            # what a run is near to is counted by ranges of diagonals
            widths = np.repeat(at[last] - at[first], self.many[slots[first]])
            _, low, high = merged(np.zeros(len(first), np.int64), at[first] - reach, at[last] + reach)
            by = np.zeros(len(alone) + 1, np.int32)
            np.add.at(by, np.searchsorted(at[alone], low), 1)
            np.add.at(by, np.searchsorted(at[alone], high, side="right"), -1)
            by = alone[np.cumsum(by[:-1]) > 0]
            own = self.beside(runs, widths, self.hits(slots[by], at[by]))
            wide = self.covered(np.concatenate([runs, own]), np.append(widths, np.zeros(len(own), np.int64)))
        keys.sort()
        good = [np.empty(0, np.int64)]
        for need in self.needs if len(keys) else ():
            i = keys[need - 1 :] - keys[: max(0, len(keys) - need + 1)] >> self.piece_bits
            spread, i = i, np.flatnonzero(i <= self.most_edits)
            segment = keys[i] >> bits + self.piece_bits
            i = i[(spread[i] <= self.edits[segment]) & (self.least[segment] == need)]
            good.append(i[self.several(keys, i, need, self.edits[keys[i] >> bits + self.piece_bits])])
        low = keys[np.sort(np.concatenate(good))] >> self.piece_bits
        segment, low, high = low >> bits, low, low
        if len(runs):
            segment, low, high = (np.concatenate(x) for x in zip((segment, low, high), wide, strict=True))
        if not len(low):
            return
        k, own = self.item[segment], a - reach - self.begin[segment] - (segment << bits)
        yield merged(k, low + own - self.slack[k], high + own + self.lengths[k] + self.slack[k])

    def hits(self, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys of all pieces of the slots at these places."""
        n = self.many[slots]
        hit = np.repeat(self.first[slots] - (np.cumsum(n) - n), n)
        hit += np.arange(len(hit))
        keys = self.key[hit]
        keys += np.repeat(at, n) << self.piece_bits
        return keys

    def beside(self, runs: np.ndarray, widths: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The keys that a band may hold together with one of the runs."""
        segment, low = runs >> self.bits + self.piece_bits, (runs >> self.piece_bits) & (1 << self.bits) - 1
        touched = np.zeros(len(self.item), bool)
        touched[segment] = True
        keys = keys[touched[keys >> self.bits + self.piece_bits]]
        segment, low, high = merged(segment, low - self.edits[segment], low + widths + self.edits[segment])
        at = keys >> self.piece_bits
        n = np.searchsorted((segment << self.bits) + low, at, side="right") - 1
        return keys[(n >= 0) & (at <= ((segment << self.bits) + high)[n])]

    def covered(self, keys: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, low, high) of the ranges of diagonals from each of which on a band has hits of enough different
        pieces, where a hit is on all diagonals from its key's on, as many more as its width."""
        segment, low = keys >> self.bits + self.piece_bits, (keys >> self.piece_bits) & (1 << self.bits) - 1
        # a band from d on meets [low, high] where d is in [low - edits, high]
        own, low, high = merged((segment << self.piece_bits) + (keys & (1 << self.piece_bits) - 1), low - self.edits[segment], low + widths)
        base = own >> self.piece_bits << self.bits
        events = np.sort(np.concatenate([base + low << 1 | 1, base + high + 1 << 1]))
        many = np.cumsum(((events & 1) << 1) - 1)
        last = np.flatnonzero(np.append(np.diff(events >> 1) != 0, True))
        points, many = events[last] >> 1, many[last]
        enough = np.append(many >= self.least[points >> self.bits], False)
        begin, end = np.flatnonzero(np.diff(enough, prepend=False) & enough), np.flatnonzero(np.diff(enough) & enough[:-1]) + 1
        return points[begin] >> self.bits, points[begin], points[end] - 1

    def parts(self, data: np.ndarray, sizes: np.ndarray, k: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The rows of windows(): windows by text, cut so that parts are about as wide as their items allow, without
        those that lack too many bytes of the item."""
        starts = np.cumsum(np.append(0, sizes + GRAM))
        # a window over a gap counts for the texts on both sides
        from_ = np.searchsorted(starts, np.maximum(low, 0), side="right") - 1
        to = np.minimum(np.searchsorted(starts, np.minimum(high, len(data) - 1), side="right") - 1, len(sizes) - 1)
        n = np.maximum(to - from_ + 1, 0)
        text = np.repeat(from_ - (np.cumsum(n) - n), n)
        text += np.arange(len(text))
        k, low, high = np.repeat(k, n), np.repeat(low, n), np.repeat(high, n)
        begin, end = np.maximum(0, low - starts[text]), np.minimum(sizes[text], high - starts[text])
        can = end - begin >= self.lengths[k] - self.slack[k]
        text, k, begin, end = text[can], k[can], begin[can], end[can]
        step = self.lengths[k] + self.slack[k]
        n = np.maximum(0, -(-(end - begin - 2 * step) // step)) + 1
        for few in np.split(np.arange(len(k)), np.flatnonzero(np.diff(np.cumsum(n) // PARTS)) + 1):
            m = n[few]
            row = np.repeat(few, m)
            from_ = begin[row] + (np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)) * step[row]
            out = np.stack([text[row], k[row], from_, np.minimum(from_ + 2 * step[row], end[row])], axis=1)
            # counting pays where parts have more bytes than what they are of
            yield out[self.may_match(data, starts, out)] if (out[:, 3] - out[:, 2]).sum() > BLOCK else out

    def may_match(self, data: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether a row's part lacks no more of the item's bytes than the item may have edits; a part counts with the
        whole cells that it touches."""
        begin, end = starts[rows[:, 0]] + rows[:, 2], starts[rows[:, 0]] + rows[:, 3]
        base, size = int(begin.min()), int(end.max() - begin.min())
        cell = max(CELL, size >> 14)
        sums = np.zeros((-(-size // cell) + 1, 256), np.int32)
        sums[1:] = np.bincount((np.arange(size) // cell << 8) + data[base : base + size], minlength=len(sums) - 1 << 8).reshape(-1, 256)
        np.cumsum(sums, axis=0, out=sums)
        begin, end = (begin - base) // cell, -(-(end - base) // cell)
        out = np.zeros(len(rows), bool)
        for a in range(0, len(rows), COUNTED):
            few = slice(a, a + COUNTED)
            items, of = np.unique(rows[few, 1], return_inverse=True)
            wanted = np.stack([np.bincount(np.frombuffer(self.rows[i][1], np.uint8), minlength=256) for i in items.tolist()]).astype(np.int32)[of]
            out[few] = np.maximum(wanted - (sums[end[few]] - sums[begin[few]]), 0).sum(axis=1) <= self.slack[rows[few, 1]]
        return out

    def several(self, keys: np.ndarray, first: np.ndarray, need: int, edits: np.ndarray) -> np.ndarray:
        """Numbers of the bands, from a first hit on, that have hits of at least `need` different pieces."""
        n = np.searchsorted(keys, keys[first] + (edits + 1 << self.piece_bits)) - first
        out, ends = [np.empty(0, np.int64)], np.cumsum(n)
        for few in np.split(np.arange(len(first)), np.flatnonzero(np.diff(ends // (4 * BLOCK))) + 1):
            many = n[few]
            band = np.repeat(np.arange(len(few)), many)
            hit = np.arange(len(band)) + np.repeat(first[few] - (np.cumsum(many) - many), many)
            found = np.sort((band << self.piece_bits) + (keys[hit] & (1 << self.piece_bits) - 1))
            found = found[np.diff(found, prepend=-1) != 0] >> self.piece_bits
            out.append(few[np.bincount(found, minlength=len(few)) >= need])
        return np.concatenate(out)

    def short_windows(self, text: bytes, k: int) -> list[tuple[int, int]]:
        """Parts of text that hold every passage within the edits of an item too short for GRAM: around each of as many
        pieces as one more than the edits, or the whole text where pieces would be single bytes."""
        own, e = self.rows[k][1], self.allowed[k]
        size, out = len(own) // (e + 1), []
        if e and size < 2:
            return [(0, len(text))]
        for n in range(e + 1):
            piece, at = own[n * size : (n + 1) * size], -1
            while (at := text.find(piece, at + 1)) >= 0:
                out.append((max(0, at - n * size - e), min(len(text), at - n * size + len(own) + e)))
        return [(begin, end) for _, _, begin, end in joined([(0, 0, *w) for w in set(out)])]

    def found(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, start) of the pairs within the allowed edits: the fewest edits, and the first place that has them."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for i, t in enumerate(texts):
            for k in self.short:
                for begin, end in self.short_windows(t, k):
                    edits, start = best_part(self.rows[k][1], t[begin:end])
                    if edits <= self.allowed[k]:
                        best[i, k] = min((edits, begin + start), best.get((i, k), (edits, begin + start)))
        cut = self.windows(texts)
        pairs, of = np.unique(cut[:, 0] * len(self.rows) + cut[:, 1], return_inverse=True)
        whole = np.zeros(len(pairs), bool)
        for n, (i, k) in enumerate(divmod(p, len(self.rows)) for p in pairs.tolist()):
            if (start := texts[i].find(self.rows[k][1])) >= 0:
                best[i, k], whole[n] = (0, start), True
        cut = cut[~whole[of]]
        least = np.zeros(len(cut), np.int64)
        weights = (cut[:, 3] - cut[:, 2] + self.lengths[cut[:, 1]]).tolist()
        for few in groups(np.argsort(self.lengths[cut[:, 1]], kind="stable").tolist(), weights.__getitem__):
            rows = cut[few].tolist()
            least[few] = many_least_edits([self.rows[k][1] for _, k, _, _ in rows], [texts[i][p:q] for i, _, p, q in rows])
        hit = np.flatnonzero(least <= self.slack[cut[:, 1]])
        hit = hit[np.lexsort((cut[hit, 2], least[hit]))]
        for (i, k, begin, end), e in zip(cut[hit].tolist(), least[hit].tolist(), strict=True):
            # parts come by edits and place, and one that begins behind the best place can't better it
            if (i, k) not in best or (e, begin) < best[i, k]:
                edits, start = best_part(self.rows[k][1], texts[i][begin:end])
                best[i, k] = min((edits, begin + start), best.get((i, k), (edits, begin + start)))
        return [(i, k, *v) for (i, k), v in sorted(best.items())]


def joined(windows: list[tuple[int, int, int, int]]):
    """Windows of a text and an item that overlap as one."""
    last = None
    for i, k, begin, end in sorted(windows):
        if last and last[:2] == (i, k) and begin <= last[3]:
            last = (i, k, last[2], max(end, last[3]))
        else:
            if last:
                yield last
            last = (i, k, begin, end)
    if last:
        yield last


def item_chunks(benchmark: DataFrame, item_col: str, item_text: str):
    """Lists of (item_id, normalised text), each of about ITEM_BYTES at most, so that what a task holds is bounded; the
    driver fetches one partition of the ordered items at a time."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    held, size = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        own = normal(r.text)
        if held and size + len(own) > ITEM_BYTES:
            yield held
            held, size = [], 0
        held.append((r.item_id, own))
        size += len(own)
    if held:
        yield held


def searched(items: Items, texts: list[bytes]):
    """found() for each text, over a bounded number of bytes at once: (text, item, edits, start)."""
    begin, size = 0, 0
    for end in range(1, len(texts) + 1):
        size += len(texts[end - 1])
        if size > TEXTS or end == len(texts):
            yield from ((begin + i, *rest) for i, *rest in items.found(texts[begin:end]))
            begin, size = end, 0


def contaminated(docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, similarity, start): documents with a passage whose edit distance from an item is at most
    1 - num / den of the item's length; start is where the first passage with the fewest edits begins in the normalised text.

    Items go to the tasks in chunks of ITEM_BYTES, one pass over the documents each. Empty and null texts and items
    match nothing; items of so few bytes that the edits may break all their grams
    are sought by shorter pieces; rows repeat as documents and items do, whose ids may be missing. No shuffle of documents.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    schema = "doc_id long, item_id long, edits int, similarity double, start int"
    out = docs.sparkSession.createDataFrame([], schema)
    for few in item_chunks(benchmark, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(few)

        def run(batches, sent=sent):
            items = Items(sent.value, num, den)
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                pairs = [(ids[i], items.rows[k][0], e, 1 - e / len(items.rows[k][1]), s) for i, k, e, s in searched(items, [normal(t) for t in b.column("text").to_pylist()])]
                if pairs:
                    yield tuple(map(list, zip(*pairs, strict=True)))

        out = out.unionByName(mapped(own, run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no passage of an item by contaminated()'s rule. No shuffle."""
    for few in item_chunks(benchmark, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(few)

        def run(batches, sent=sent):
            items = Items(sent.value, num, den)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[i for i, *_ in searched(items, [normal(t) for t in b.column(text_col).to_pylist()])]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontaminate": op9_decontaminate}
