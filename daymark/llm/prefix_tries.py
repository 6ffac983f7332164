"""The trie of conversations that share their first turns.

Every prefix of a conversation has a digest; the smallest conversation with a digest owns that node of the trie. What a
conversation owns is the end of it, from its first owned depth on, so that depth is found by binary search: each round
joins all conversations, at one depth each, with the table of the digests' smallest conversations. The owned ends are
chains, the chains make the tree, and sums over subtrees are sums over chains, put together from the bottom up.

No step gathers a conversation's turns or a node's members: order and running sums are taken within blocks first, a
table of the blocks' sums carries on, and joins with nodes that very many conversations share are dealt by a salt.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mapped, spread_join, table, written

#: Rows of one key over which a running sum is taken at once.
BLOCK = 4096
#: Bytes of ids that are packed into one row before the hash of a node's ends.
PACKED = 1 << 20
#: Turns that a conversation may take from the first one of its hundred.
BORROWED = 5
EMPTY = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, order: str, columns: list[str], down: bool = False) -> DataFrame:
    """rows with each of columns summed over its key's rows up to it, or from it on where down. rows is read twice."""
    own = rows.withColumn("block", F.floor(F.col(order) / BLOCK))
    way = (lambda c: F.col(c).desc()) if down else (lambda c: F.col(c).asc())
    within = Window.partitionBy(key, "block").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(way("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy(key, "block").agg(*(F.sum(c).alias(c) for c in columns))
    carried = blocks.select(key, "block", *(F.sum(c).over(before).alias(f"{c}_before") for c in columns)).where(F.col(f"{columns[0]}_before").isNotNull())
    out = own.withColumns({c: F.sum(c).over(within) for c in columns}).join(carried, [key, "block"], "left")
    return out.withColumns({c: F.col(c) + F.coalesce(F.col(f"{c}_before"), F.lit(0)) for c in columns}).drop("block", *(f"{c}_before" for c in columns))


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, row, content, chars) of every turn: one sort of the whole table by conversation and turn, in which
    part and row say where a turn stands. A conversation of any length spreads over parts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    hashed = F.unhex(F.sha2(text.cast("binary"), 256))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), hashed.alias("hashed"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("any"))
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hashed"), F.col("any")]
    # `any` only deals out turns that are the same in everything
    place = F.monotonically_increasing_id()
    content = F.unhex(F.md5(F.concat(F.col("hashed"), F.col("role").cast("binary"))))
    return own.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("row"), content.alias("content"), "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n), and (conv_id, depth, n, content, chars) of every rebuilt turn.

    The first h turns are those of the first conversation of its hundred (fewer if it has fewer, none if there is none),
    then come the conversation's own after its first h; h is the CRC32 of the id in decimals, modulo 6.
    """
    pieces = turns.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("many"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = written(pieces.withColumn("before", F.coalesce(F.sum("many").over(before), F.lit(0))), "pieces")
    sizes = pieces.groupBy("conv_id").agg(F.sum("many").alias("own"))
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (BORROWED + 1)
    heads = sizes.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = sizes.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 100}).join(heads, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    placed = turns.join(pieces.join(convs, "conv_id"), ["conv_id", "part"]).withColumn("place", F.col("row") - F.col("first") + 1 + F.col("before"))
    columns = ("conv_id", "depth", "n", "content", "chars")
    own = placed.where("place > h").withColumn("depth", F.col("place") - F.col("h") + F.col("taken")).select(*columns)
    firsts = placed.where(f"conv_id % 100 = 0 and place <= {BORROWED}").select("base", F.col("place").alias("depth"), "content", "chars")
    # at most 199 conversations have one base
    borrowed = convs.where("taken > 0").select("conv_id", "base", "taken", "n").join(firsts, "base").where("depth <= taken").select(*columns)
    return convs.select("conv_id", "n"), own.unionByName(borrowed)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, n, digest, chars) of every prefix, from the empty one on; chars is the length of its last text.

    A prefix is told by the sums of four 32-bit parts of its turns' hashes, in which depth and content enter: 128 bits
    that add up in any order, so a long conversation's prefixes are running sums over blocks.
    """
    hashed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("content")).cast("binary"), 256)
    parts = {f"h{i}": F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "n", F.lit(b"").alias("content"), F.lit(0).cast("long").alias("chars"))
    rows = written(turns.unionByName(roots).withColumns(parts).drop("content"), "turns")
    summed = running(rows, "conv_id", "depth", list(parts))
    out = written(summed.select("conv_id", "depth", "n", F.unhex(F.md5(F.concat_ws(",", *parts).cast("binary"))).alias("digest"), "chars"), "prefixes")
    discard(rows)
    return out


def owner_at(convs: DataFrame, known: DataFrame, minima: DataFrame, depth: str) -> DataFrame:
    """convs with owner: the smallest conversation with the same prefix of the depth in a column."""
    at = convs.join(known.select("conv_id", F.col("depth").alias(depth), "digest"), ["conv_id", depth])
    owners = minima.select(F.col("depth").alias(depth), "digest", "owner")
    return spread_join(at, owners, [depth, "digest"], "conv_id", "inner").drop("digest")


def first_owned(convs: DataFrame, known: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, n, first): the least depth that a conversation owns, n + 1 if it owns none.

    After k rounds of halving only conversations of 2^k - 1 turns or more are open, so ever fewer digests are read.
    """
    longest = convs.agg(F.max("n")).first()[0]
    open_, found, spent = convs.select("conv_id", "n", F.lit(0).cast("long").alias("low"), (F.col("n") + 1).alias("high")), [], []
    for k in range(math.ceil(math.log2(longest + 2)) if longest is not None else 0):
        asked = open_.withColumn("middle", F.floor((F.col("low") + F.col("high")) / 2))
        owns = F.col("owner") == F.col("conv_id")
        said = owner_at(asked, known.where(F.col("n") >= 2**k - 1), minima, "middle")
        step = written(said.select("conv_id", "n", F.when(owns, F.col("low")).otherwise(F.col("middle") + 1).alias("low"), F.when(owns, F.col("middle")).otherwise(F.col("high")).alias("high")), "search")
        found.append(step.where("low = high").select("conv_id", "n", F.col("low").alias("first")))
        spent.append(step)
        open_ = step.where("low < high")
    out = written(reduce(DataFrame.unionByName, found) if found else convs.withColumn("first", F.lit(0).cast("long")), "owned")
    discard(*spent)
    return out


def subtree_sums(chains: DataFrame, columns: list[str]) -> DataFrame:
    """(conv_id, up, columns): each column of (conv_id, parent, columns) summed over a chain and all chains below it; up is spent.

    In round k each chain adds its sum to the chain 2^k above it, so a tree of any height takes as many rounds as its
    logarithm; sums combine before they shuffle.
    """
    now = written(chains.select("conv_id", F.col("parent").alias("up"), *columns), "chains")
    while now.where("up is not null").limit(1).count():
        more = now.where("up is not null").groupBy("up").agg(*(F.sum(c).alias(f"{c}_more") for c in columns))
        above = now.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        moved = spread_join(now, above, ["up"], "conv_id").drop("up").join(more.withColumnRenamed("up", "conv_id"), "conv_id", "left")
        new = written(moved.select("conv_id", F.col("next").alias("up"), *((F.col(c) + F.coalesce(F.col(f"{c}_more"), F.lit(0))).alias(c) for c in columns)), "chains")
        discard(now)
        now = new
    return now


def hashed_ids(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of the ids `member` of each (conv_id, depth), ascending, as decimals with commas.

    Ids are packed in the order of one sort, at most a megabyte to a row, and each node's packs pass through one hash
    in turn, so a node of any size is in no task's memory.
    """
    by = ["conv_id", "depth", "member"]

    def packs(batches):
        node, least, held, size = None, None, [], 0
        for b in batches:
            out = []
            for c, d, m in zip(*(b.column(x).to_pylist() for x in by), strict=True):
                if (c, d) != node or size >= PACKED:
                    if held:
                        out.append((*node, least, ",".join(held)))
                    node, least, held, size = (c, d), m, [], 0
                held.append(str(m))
                size += len(held[-1]) + 1
            if out:
                yield tuple(map(list, zip(*out, strict=True)))
        if held:
            yield [node[0]], [node[1]], [least], [",".join(held)]

    def hashes(batches):
        node, state = None, None
        for b in batches:
            out = []
            for c, d, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "depth", "ids")), strict=True):
                if (c, d) == node:
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (c, d), hashlib.sha256()
                state.update(text.encode())
            if out:
                yield tuple(map(list, zip(*out, strict=True)))
        if node:
            yield [node[0]], [node[1]], [state.hexdigest()]

    packed = mapped(rows.select(*by).repartitionByRange(*by).sortWithinPartitions(*by), packs, "conv_id long, depth long, least long, ids string")
    return mapped(packed.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "least").select("conv_id", "depth", "ids"), hashes, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Turns go by turn, missing ones first, then by role and by the hash of the text; turns that are the same in all
    stay, each as a turn. A missing role or text is empty. Rows without conv_id belong to no conversation and go; a
    table without conversations has no nodes. Columns but conv_id, turn, role and text don't count.
    """
    turns = written(ordered(conversations), "ordered")
    convs, rows = rebuilt(turns)
    known = prefixes(convs, rows)
    discard(turns)
    minima = written(known.groupBy("depth", "digest").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars")), "minima")
    owned = first_owned(convs, known, minima)
    # the node above what a conversation owns; where it owns nothing, the node at which it ends
    above = owner_at(owned.where("first > 0").withColumn("at", F.col("first") - 1), known, minima, "at")
    chains = written(owned.where("first = 0").select("*", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("parent")).unionByName(above.withColumnRenamed("owner", "parent")), "links")
    discard(known)
    own = chains.where("first <= n")
    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    hung = own.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("n")).agg(F.count(F.lit(1)).alias("kids"))
    single = own.select("conv_id", "n", "parent").join(hung, ["conv_id", "n"], "left").select("conv_id", "parent", F.coalesce("kids", F.lit(0)).alias("kids"))
    alone = single.join(nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved")), "conv_id").select("conv_id", "parent", (F.col("kids") == 0).cast("long").alias("leaves"), "saved")
    sums = subtree_sums(alone, ["leaves", "saved"])
    below = own.where("parent is not null").join(sums.drop("up"), "conv_id").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("kids"), F.sum("leaves").alias("kids_leaves"), F.sum("saved").alias("kids_saved"))
    ends = written(chains.select(F.when(F.col("first") <= F.col("n"), F.col("conv_id")).otherwise(F.col("parent")).alias("conv_id"), F.col("n").alias("depth"), F.col("conv_id").alias("member")), "ends")
    tops = own.select("conv_id", F.col("first").alias("depth"), F.lit(True).alias("top"), "parent")
    lasts = own.select("conv_id", F.col("n").alias("depth"), F.lit(True).alias("last"))
    # every part has at most one row a node
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (nodes, below, tops, lasts, hashed_ids(ends)))
    whole = parts.groupBy("conv_id", "depth").agg(*(F.max(c).alias(c) for c in parts.columns if c not in ("conv_id", "depth")))
    kids, last = F.coalesce("kids", F.lit(0)), F.coalesce("last", F.lit(False))
    whole = whole.select(
        "conv_id", "depth", F.when(F.coalesce("top", F.lit(False)), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", (kids + (~last).cast("long")).alias("n_children"),
        ((last & (kids == 0)).cast("long") + F.coalesce("kids_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("kids_saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    whole = written(whole, "nodes")
    discard(minima, chains, ends, sums, owned)
    return running(whole, "conv_id", "depth", ["n_leaves", "saved_tokens"], down=True)


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
#: CRC32 of a decimal number, bit by bit: eight steps (-1) after each byte.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(s) + 1), lambda i: [ord(s[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
ORACLES = {
    "op11_prefix_trie": f"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {CRC} % 6 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM own)),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY origin, place) AS depth, role, text FROM (
  SELECT i.conv_id, 0 AS origin, place, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 100 AND place <= h
  UNION ALL SELECT i.conv_id, 1, place, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND place > h)),
paths AS (SELECT conv_id, depth, length(text) AS chars, sha256(string_agg(concat(length(role), ':', role, length(text), ':', text), '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
sizes AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved FROM paths GROUP BY depth, path),
members AS (SELECT p.conv_id AS member, n.* FROM paths p JOIN nodes n USING (depth, path)),
up AS (SELECT DISTINCT b.depth, b.path, a.conv_id AS parent_conv_id, a.path AS above FROM members b JOIN members a ON a.member = b.member AND a.depth = b.depth - 1),
kids AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM up GROUP BY ALL),
below AS (SELECT a.depth, a.path, sum(b.saved) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves FROM members b JOIN members a ON b.member = b.conv_id AND a.member = b.member AND a.depth <= b.depth
  LEFT JOIN kids k ON k.depth = b.depth AND k.path = b.path GROUP BY ALL),
ends AS (SELECT depth, path, sha256(string_agg(CAST(m.member AS VARCHAR), ',' ORDER BY m.member)) AS ends_sha256 FROM members m JOIN sizes s ON s.conv_id = m.member AND s.n = m.depth GROUP BY ALL)
SELECT n.conv_id, n.depth, u.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN up u USING (depth, path) LEFT JOIN kids k USING (depth, path) LEFT JOIN below b USING (depth, path) LEFT JOIN ends e USING (depth, path)"""
}
