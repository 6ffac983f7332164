"""A join of documents on the Jaccard similarity of their word n-gram sets, exact, by count-vector R-trees.

A document's n-grams are hashed; its set is the distinct hashes. Hashes fall into groups, the more the larger the set,
and the counts of the groups are the document's point; points of different sets are compared in the fewer groups, as
halving the groups adds counts in pairs. Two sets share at most the sum of the smaller coordinates, so an R-tree over
points, whose boxes bound that sum from above, gives all pairs that can reach the similarity; those are verified.

To bring pairs together without comparing all, hashes also fall into parts, as many as two linked sets can differ in
elements and some more: then several parts of two linked sets are equal, and a key for each part, its elements' sum,
deals documents out. Parts without an element give no key while a document has no more of them than the extra parts.
Within a key, points are compared; pairs that pass make candidate classes, of which all linked pairs are inside one;
classes are verified on the sets, in blocks of bounded size. Of equal sets only the first takes part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_range, discard, keep_text, mapped, outermost, range_cuts, spread_join, table, written
from .graph import components
from .substrings import NO_ID, dealt, ranked, unpacked

#: Groups of a point: a power of 2 between these, of about half of a set's elements.
GROUPS, MOST_GROUPS = 64, 8192
#: Points of a leaf and nodes of a box.
LEAF = 16
#: Counts in one tree's points; beyond that they are folded to fewer groups, which loosens the bound only.
TREE_COUNTS = 1 << 24
#: Documents that share a key beyond which they are compared where the key is dealt to, and not where their first is.
MANY = 1000
#: Ratio of the sizes in one class.
RATIO = 1.5
#: Set elements in one block of a class, about.
BLOCK = 2_000_000
HELD = 1_000_000

_C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

KEY = np.dtype([("key", "<u8"), ("rid", "<i8")])
ROUTED = np.dtype([("key", "<u8"), ("rid", "<i8"), ("to", "<u8")])
EDGE = np.dtype([("u", "<i8"), ("v", "<i8")])
SIZED = np.dtype([("rid", "<i8"), ("n", "<i8"), ("width", "<u1")])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _D
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; one for all words where there are fewer; none without words."""
    own = text.encode().lower().split()  # bytes: A-Z alone are lowered, and white space is space and \\t to \\r
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    width = min(words, len(own))
    x = np.full(len(own) - width + 1, np.uint64(width))
    for i in range(width):
        x = mix(x * _C + h[i : len(h) - width + 1 + i])
    return np.unique(x)


def groups_of(n: int) -> int:
    return min(MOST_GROUPS, max(GROUPS, 1 << max(n - 1, 1).bit_length() - 1))


def point(own: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((own >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups)


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """The point in fewer groups."""
    return p if len(p) == groups else p.reshape(-1, groups).sum(0)


def packed_point(own: np.ndarray) -> bytes:
    """A set's point in as many bytes a count as its largest needs."""
    p = point(own, groups_of(len(own)))
    return p.astype(next(t for t in ("<u1", "<u2", "<u4") if p.max() <= np.iinfo(t).max)).tobytes()


class Similarity:
    """A threshold num / den of the Jaccard similarity, and what follows from it."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bounds = [1]
        self.known: dict[int, tuple[int, int, int]] = {}

    def linked(self, shared, a, b):
        """Works on numbers and on arrays."""
        return shared * (self.num + self.den) >= self.num * (a + b)

    def class_of(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * RATIO)))
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    def classes(self, c: int) -> tuple[int, int, int]:
        """Largest size of a class, its parts, and how many of those are extra."""
        if c in self.known:
            return self.known[c]
        low, high = self.bounds[c], self.bounds[c + 1] - 1
        least = (high + high * self.den // self.num) * (self.den - self.num) // (self.den + self.num) + 1
        extra = 1
        for _ in range(8):
            extra = math.ceil(1.5 * (least + extra) * math.exp(-low / (least + extra))) + 1
        self.known[c] = high, least + extra, extra
        return self.known[c]

    def keys(self, own: np.ndarray) -> np.ndarray:
        """The keys of a set: for its class, and for each lower one whose sets can be linked to it."""
        n, out = len(own), []
        c = self.class_of(n)
        while c >= 0:
            high, parts, extra = self.classes(c)
            if high * self.den < n * self.num:
                break
            part = (mix(own + np.uint64(c)) >> np.uint64(24)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            ordered = part[order]
            begin = np.flatnonzero(np.diff(ordered, prepend=-1))
            total = np.zeros(parts, np.uint64)
            total[ordered[begin]] = np.add.reduceat(mix(own[order] * _C), begin)
            name = mix(mix(np.arange(parts, dtype=np.uint64) + np.uint64(c << 32)) + total)
            out.append(name if parts - len(begin) > extra else name[ordered[begin]])
            c -= 1
        return np.concatenate(out) if out else np.empty(0, np.uint64)


class CountTree:
    """An R-tree of count vectors, loaded by size: leaves of LEAF points, boxes of LEAF leaves, and so on up to one box.

    A node has the largest count of each group and the least size of what is below it.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, similarity: Similarity):
        self.of = similarity
        self.order = np.lexsort((points[:, : points.shape[1] // 2].sum(1), sizes))
        self.most, self.least_n = [points[self.order]], [sizes[self.order].astype(np.int64)]
        while len(self.least_n[-1]) > LEAF:
            starts = np.arange(0, len(self.least_n[-1]), LEAF)
            self.most.append(np.maximum.reduceat(self.most[-1], starts))
            self.least_n.append(np.minimum.reduceat(self.least_n[-1], starts))

    def near(self, own: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the points that can be linked to this one."""
        nodes = np.arange(len(self.least_n[-1]))
        for level in range(len(self.most) - 1, -1, -1):
            bound = np.minimum(self.most[level][nodes], own).sum(1, dtype=np.int64)
            nodes = nodes[self.of.linked(bound, n, self.least_n[level][nodes])]
            if level:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
                nodes = nodes[nodes < len(self.least_n[level - 1])]
        return self.order[nodes]


class Classes(dict):
    """Union-find over ids."""

    def top(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = x = self[up] if up in self else up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


class Points:
    """Points of different sizes by rid. `levels` has, for each number of groups, the points of at least as many, folded."""

    def __init__(self, sized: np.ndarray, data: list[bytes]):
        sized, first = np.unique(sized, return_index=True)
        groups = np.array([groups_of(n) for n in sized["n"].tolist()], np.int64)
        order = np.lexsort((sized["width"], -groups))
        self.groups, width, data = groups[order], sized["width"][order], [data[i] for i in first[order].tolist()]
        self.rid, self.n = sized["rid"][order], sized["n"][order]
        self.by_rid = np.argsort(self.rid)
        kind = np.uint32 if (width > 2).any() else np.uint16
        self.levels, above, g = {}, np.empty((0, 2 * MOST_GROUPS), kind), MOST_GROUPS
        while g >= GROUPS:
            own = [np.frombuffer(b"".join(data[i] for i in few.tolist()), f"<u{w}").reshape(-1, g).astype(kind) for w in (1, 2, 4) if len(few := np.flatnonzero((self.groups == g) & (width == w)))]
            above = self.levels[g] = np.concatenate([above.reshape(len(above), 2, g).sum(1, dtype=kind), *own])
            g //= 2

    def at(self, rid: np.ndarray) -> np.ndarray:
        return self.by_rid[np.searchsorted(self.rid, rid, sorter=self.by_rid)]

    def can(self, pairs: np.ndarray, of: Similarity) -> np.ndarray:
        """Of rows of two numbers: whether they can be linked."""
        a, b = pairs[:, 0], pairs[:, 1]
        out, groups = np.zeros(len(pairs), bool), np.minimum(self.groups[a], self.groups[b])
        for g in np.unique(groups).tolist():
            own, level = np.flatnonzero(groups == g), self.levels[g]
            for few in np.array_split(own, -(-len(own) * g // (1 << 20))):
                shared = np.minimum(level[a[few]], level[b[few]]).sum(1, dtype=np.int64)
                out[few] = of.linked(shared, self.n[a[few]], self.n[b[few]])
        return out

    def tree(self, at: np.ndarray, of: Similarity) -> tuple[CountTree, np.ndarray]:
        """A tree of some points, and the points as it has them."""
        groups = int(self.groups[at].min())
        while groups > GROUPS and groups * len(at) > TREE_COUNTS:
            groups //= 2
        own = self.levels[groups][at]
        return CountTree(own, self.n[at], of), own


def key_groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the groups of a run sorted by (key, rid) begin, their sizes, and which of them are the first with their members."""
    begin = np.flatnonzero(np.diff(rows["key"], prepend=~rows["key"][:1]))
    size = np.diff(begin, append=len(rows))
    names = np.add.reduceat(mix(rows["rid"].astype(np.uint64) * _C), begin) if len(begin) else np.empty(0, np.uint64)
    first = np.zeros(len(begin), bool)
    first[np.unique(np.stack([names, size.astype(np.uint64)], 1).view("V16").reshape(-1), return_index=True)[1]] = True
    return begin, size, first


def unique_pairs(pairs: np.ndarray, most: int) -> np.ndarray:
    """Distinct rows of two numbers below most."""
    one = np.unique(pairs[:, 0] * most + pairs[:, 1])
    return np.stack([one // most, one % most], 1)


def possible_links(rows: np.ndarray, points: Points, of: Similarity, classes: Classes) -> None:
    """Join the ids of a sorted run of keys whose points can be linked; ids that no chain of such pairs joins stay apart."""
    begin, size, first = key_groups(rows)
    at, most = points.at(rows["rid"]), len(points.rid)
    first_at, of_group = np.repeat(at[begin], size), np.repeat(np.arange(len(begin)), size)
    pairs = unique_pairs(np.stack([at, first_at], 1), most)
    ok = points.can(pairs, of)
    for u, v in points.rid[pairs[ok]].tolist():
        classes.join(u, v)
    # where some can't be linked to their key's first: those of a small group are one leaf, a larger one makes a tree
    failed = np.isin(at * most + first_at, (pairs[:, 0] * most + pairs[:, 1])[~ok])
    leaves = []
    for g in np.unique(of_group[failed]).tolist():
        if not first[g]:
            continue
        own = np.unique(at[begin[g] : begin[g] + size[g]])
        ids = points.rid[own].tolist()
        if len({classes.top(i) for i in ids}) == 1:
            continue
        if len(own) <= LEAF:
            i, j = np.triu_indices(len(own), 1)
            leaves.append(np.stack([own[i], own[j]], 1))
            continue
        tree, dense = points.tree(own, of)
        for i, k in enumerate(ids):
            for j in tree.near(dense[i], int(points.n[own[i]])).tolist():
                classes.join(k, ids[j])
    if leaves:
        pairs = unique_pairs(np.concatenate(leaves), most)
        for u, v in points.rid[pairs[points.can(pairs, of)]].tolist():
            classes.join(u, v)


def fine_groups(sizes: np.ndarray) -> int:
    """Groups for the points of a block of sets, a power of 2: about a quarter of a set's elements, so that sets that share
    half of their elements are mostly told apart. The points take a few bytes for each element of the block."""
    return max(GROUPS, min(4096, 1 << math.ceil(math.log2(max(1.0, float(sizes.mean()) / 4)))))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    at = np.searchsorted(a, b)
    return int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b))


def verified_links(sets: list[np.ndarray], ids: list[int], left: list[bool], of: Similarity, classes: Classes) -> list[tuple[int, int]]:
    """Links that join all of these documents that links join: pairs of a left document and any other that the tree leaves,
    verified on the sets."""
    sizes = np.array([len(s) for s in sets])
    points, out = np.stack([point(s, fine_groups(sizes)) for s in sets]).astype(np.uint32), []
    tree, is_left = CountTree(points, sizes, of), np.array(left)
    for i in np.flatnonzero(is_left).tolist():
        near = np.sort(tree.near(points[i], int(sizes[i])))
        # a pair of two left documents is looked at once
        for j in near[(near > i) | ~is_left[near]].tolist():
            if classes.top(ids[i]) != classes.top(ids[j]) and of.linked(overlap(sets[i], sets[j]), int(sizes[i]), int(sizes[j])):
                classes.join(ids[i], ids[j])
                out.append((ids[i], ids[j]))
    return out


def summaries(rows: DataFrame, words: int) -> DataFrame:
    """(rid, n, a, b, point): size, two sums that tell sets apart, and counts."""

    def run(batches):
        for b in batches:
            own = [shingles(t, words) for t in b.column("text").to_pylist()]
            sums = [[int(mix(s + np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) for s in own] for k in (1, 2)]
            yield b.column("rid"), [len(s) for s in own], *sums, pa.array([packed_point(s) for s in own], pa.binary())

    return mapped(rows.select("rid", "text"), run, "rid long, n long, a long, b long, point binary")


def candidate_edges(rows: DataFrame, summary: DataFrame, copies: DataFrame, words: int, of: Similarity) -> DataFrame:
    """(u, v): edges whose components hold every linked pair of different sets. copies: (rid, first) of equal sets."""
    spark = rows.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = range_cuts(summary, "rid", buckets)
    edges = np.array(cuts)
    bucket_of = lambda key: (key >> np.uint64(33)).astype(np.int64) % buckets

    def keyed(batches):
        seen: dict[tuple[int, int], int] = {}
        held, count = [], 0

        def flush():
            rows = np.concatenate(held)
            return dealt(rows, bucket_of(rows["key"]))

        for b in batches:
            for rid, text in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = shingles(text, words)
                if not len(own):
                    continue
                same = (len(own), int(mix(own).sum(dtype=np.uint64)))
                if seen.get(same, NO_ID) < rid:
                    continue
                seen[same] = rid
                keys = of.keys(own)
                block = np.empty(len(keys), KEY)
                block["key"], block["rid"] = keys, rid
                held.append(block)
                count += len(block)
                if count > HELD:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    def shared(batches):
        rows = unpacked([x for b in batches for x in b.column("data").to_pylist()], KEY)
        rows = rows[np.lexsort((rows["rid"], rows["key"]))]
        same = rows["key"][1:] == rows["key"][:-1]
        rows = rows[np.append(same, False) | np.insert(same, 0, False)] if len(rows) else rows
        if len(rows):
            # a group goes where its first document's groups go, so that pairs and points come together once; keys that
            # the same documents share tell nothing more
            begin, size, first = key_groups(rows)
            out = np.empty(len(rows), ROUTED)
            out["key"], out["rid"] = rows["key"], rows["rid"]
            out["to"] = np.repeat(np.where(size > MANY, rows["key"][begin], mix(rows["rid"][begin].astype(np.uint64) * _C)), size)
            out = out[np.repeat(first, size)]
            part, data = dealt(out, np.searchsorted(edges, out["rid"].astype(np.float64), side="right"))
            yield part, [1] * len(part), data

    def pointed(batches):
        rids, points, sizes, gone, known = [], [], [], [], None
        held, count = [], 0

        def flush():
            """Keys by bucket, and each bucket's points once."""
            own = np.concatenate(held)
            own = own[np.argsort(bucket_of(own["to"]), kind="stable")]
            bucket = bucket_of(own["to"])
            for b in np.unique(bucket).tolist():
                few = own[np.searchsorted(bucket, b) : np.searchsorted(bucket, b, side="right")]
                at = np.searchsorted(known, np.unique(few["rid"]))
                sized = np.empty(len(at), SIZED)
                sized["rid"], sized["n"], data = known[at], sizes[at], [points[order[i]] for i in at.tolist()]
                sized["width"] = [len(x) // groups_of(n) for x, n in zip(data, sized["n"].tolist(), strict=True)]
                yield [b], [few[["key", "rid"]].astype(KEY).tobytes()], [sized.tobytes()], pa.array([b"".join(data)], pa.binary())

        for b in batches:
            for kind, rid, n, data in zip(*(b.column(c).to_pylist() for c in ("kind", "rid", "n", "data")), strict=True):
                if kind == -1:
                    gone.append(rid)
                    continue
                if kind == 0:
                    rids.append(rid)
                    sizes.append(n)
                    points.append(data)
                    continue
                if known is None:
                    known = np.array(rids)
                    order = np.argsort(known)
                    known, sizes, gone = known[order], np.array(sizes)[order], np.array(sorted(gone), np.int64)
                own = unpacked([data], ROUTED)
                held.append(own[~np.isin(own["rid"], gone)])
                count += len(held[-1])
                if count > HELD:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    def passed(batches):
        keys, sized, data = [], [], []
        for b in batches:
            for k, s, p in zip(*(b.column(c).to_pylist() for c in ("keys", "sized", "points")), strict=True):
                keys.append(np.frombuffer(k, KEY))
                sized.append(np.frombuffer(s, SIZED))
                ends = np.cumsum(sized[-1]["width"] * np.array([groups_of(n) for n in sized[-1]["n"].tolist()]))
                data += [p[x - y : x] for x, y in zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)]
        classes = Classes()
        if keys:
            rows = np.concatenate(keys)
            possible_links(rows[np.lexsort((rows["rid"], rows["key"]))], Points(np.concatenate(sized), data), of, classes)
        joined = np.array([(x, t) for x in list(classes) if (t := classes.top(x)) != x], np.int64).reshape(-1, 2)
        if len(joined):
            out = np.empty(len(joined), EDGE)
            out["u"], out["v"] = joined[:, 0], joined[:, 1]
            yield dealt(out, np.searchsorted(edges, out["u"].astype(np.float64), side="right"))

    def told_once(batches):
        out = np.unique(unpacked([x for b in batches for x in b.column("data").to_pylist()], EDGE))
        if len(out):
            yield out["u"], out["v"]

    keys = mapped(rows.select("rid", "text"), keyed, "bucket int, data binary").repartitionById(buckets, "bucket")
    shared_rows = mapped(keys, shared, "part int, kind int, data binary")
    point_rows = by_range(summary.where("n > 0").select("rid", "n", F.col("point").alias("data")), "rid", cuts).withColumn("kind", F.lit(0))
    gone = by_range(copies.where("rid != first").select("rid"), "rid", cuts).withColumn("kind", F.lit(-1))
    both = point_rows.unionByName(shared_rows, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
    both = both.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("kind").select("kind", "rid", "n", "data")
    found = mapped(mapped(both, pointed, "bucket int, keys binary, sized binary, points binary").repartitionById(buckets, "bucket"), passed, "part int, data binary")
    # a pair passes under many keys; it becomes one row
    return mapped(found.repartitionById(len(cuts) + 1, "part"), told_once, "u long, v long")


def verified_edges(rows: DataFrame, classes: DataFrame, summary: DataFrame, words: int, of: Similarity) -> DataFrame:
    """(u, v): links, verified on the sets, whose components are those of all links. classes: (id, component) of candidates."""
    members = classes.withColumnRenamed("id", "rid").join(summary.select("rid", "n"), "rid")
    sizes = members.groupBy("component").agg(F.sum("n").alias("total")).select("component", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"))
    members = spread_join(members, sizes, ["component"], "rid", "inner").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    members = written(members.select("rid", "component", "blocks", "block"), "members")

    def sets_of(chosen):
        def expanded(batches):
            for b in batches:
                own = [shingles(t, words) for t in b.column("text").to_pylist()]
                yield *(b.column(c) for c in ("component", "blocks", "block", "rid")), pa.array([s.tobytes() for s in own], pa.binary())

        return mapped(rows.select("rid", "text").join(chosen, "rid"), expanded, "component long, blocks int, block int, rid long, data binary")

    # a class in one block is compared there; one in several also gets its first document in each
    everywhere = F.when(F.col("rid") == F.col("component"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    near_first = sets_of(members).withColumn("block", F.explode(everywhere)).withColumns({"left": F.lit(True), "other": F.lit(-1)})

    def compared(batches):
        key, ids, data, left = None, [], [], []

        def found():
            links = verified_links([np.frombuffer(x, np.uint64) for x in data], ids, left, of, Classes()) if len(ids) > 1 else []
            return ([u for u, _ in links], [v for _, v in links]) if links else None

        for b in batches:
            for c, i, o, rid, x, s in zip(*(b.column(c).to_pylist() for c in ("component", "block", "other", "rid", "data", "left")), strict=True):
                if (c, i, o) != key:
                    yield found()
                    key, ids, data, left = (c, i, o), [], [], []
                ids.append(rid)
                data.append(x)
                left.append(s)
        yield found()

    def run(df):
        near = df.repartition("component", "block", "other").sortWithinPartitions("component", "block", "other", "rid")
        return mapped(near.select("component", "block", "other", "rid", "data", "left"), compared, "u long, v long")

    first = written(run(near_first), "links")
    large = members.where("blocks > 1")
    if not large.limit(1).count():
        return first
    # what isn't joined to a class's first document within its block meets the class's other blocks; two such documents
    # meet once, in the order of their blocks
    labels = components(first)
    sets = sets_of(large).join(labels.select(F.col("id").alias("rid"), F.col("component").alias("label")), "rid", "left")
    sets = written(sets.withColumn("apart", F.col("component") != F.coalesce("label", "rid")).drop("label"), "sets")
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = sets.where("apart").withColumn("left", F.lit(True)).withColumn("other", F.explode(blocks)).where("other != block")
    needed = pairs.select("component", "block", "other").distinct()
    right = sets.withColumnRenamed("block", "other").join(needed, ["component", "other"]).where("other > block or not apart").withColumn("left", F.lit(False))
    further = written(run(pairs.unionByName(right)), "links")
    discard(sets)
    return first.unionByName(further)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, n_shingles, component_id, top): the size of each document's set, the smallest doc_id that links reach,
    and that one's rid.

    Two documents link when den * shared >= num * union, of the distinct n-grams of `words` words; words lie between
    ASCII white space, A to Z lowered. With fewer words all of them are one n-gram. A null or empty text, or one of
    white space, has an empty set and links with nothing. rid tells rows apart: it is doc_id unless ids are missing or
    repeated, then a number in the order of (doc_id, text), nulls last. Other columns go.
    """
    of = Similarity(num, den)
    spark = docs.sparkSession
    partitions = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    odd = own.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    rows = written(ranked(keep_text(docs, id_col, text_col), partitions), "ranked") if odd else keep_text(docs, id_col, text_col).select(F.col("doc_id").alias("rid"), "doc_id", "text")
    summary = written(summaries(rows, words), "summary")
    copies = written(outermost(summary.where("n > 0").select("rid", "n", "a", "b"), ["a", "b", "n"], "rid").select("rid", "first"), "copies")
    links = verified_edges(rows, components(candidate_edges(rows, summary, copies, words, of)), summary, words, of)
    label = components(links).withColumnsRenamed({"id": "first", "component": "top"})
    out = summary.select("rid", F.col("n").alias("n_shingles")).join(copies, "rid", "left").withColumn("first", F.coalesce("first", "rid"))
    out = spread_join(out, label, ["first"], "rid").select("rid", "n_shingles", F.coalesce("top", "first").alias("top"))
    if not odd:
        return out.select("rid", F.col("rid").alias("doc_id"), "n_shingles", F.col("top").alias("component_id"), "top")
    names = rows.select("rid", "doc_id")
    return out.join(names, "rid").join(names.select(F.col("rid").alias("top"), F.col("doc_id").alias("component_id")), "top").select("rid", "doc_id", "n_shingles", "component_id", "top")


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, that come first in their class of near_duplicates(): the smallest
    doc_id. Where doc_id is missing or repeated, rows are told apart by (doc_id, text), and of equal rows one stays."""
    found = near_duplicates(docs, words, num, den)
    if found.where("doc_id is null or doc_id != rid").limit(1).count() == 0:
        return docs.join(found.where("component_id != doc_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "doc_id", "left_anti")
    digest = F.md5(F.coalesce("text", F.lit("")))
    spark = docs.sparkSession
    rows = ranked(keep_text(docs), spark.sparkContext.defaultParallelism)
    # ranked() is a function of the rows, so these are the numbers that near_duplicates() gave
    stay = rows.join(found.where("top = rid").select("rid"), "rid").select(F.col("doc_id").alias("stay_id"), F.md5("text").alias("stay_digest")).distinct()
    own = docs.withColumn("row_digest", digest).dropDuplicates(["doc_id", "row_digest"])
    return own.join(stay, F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("row_digest") == F.col("stay_digest")), "left_semi").drop("row_digest")


def op4_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op4_near_duplicates": op4_near_duplicates}
