"""Ranked search over an index of terms.

Documents are dealt into shards as they are read. A shard's index has its terms, and for each term the documents that
hold it with their impacts: what an occurrence adds to a score, as an integer, before the term's weight. Postings stand in
compressed sparse rows, so a shard is a few arrays. A query goes through the shards term by term and adds to one dense
row of scores; the best of each shard meet in a merge of the best.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, mapped, table, written

#: Everything in ASCII but digits and letters parts terms.
BREAKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Terms (with repeats) of a shard, after which it ends with the document.
SHARD = 2_000_000
#: Terms that are gathered before they are counted.
PENDING = 1 << 20
#: Bytes of queries that go through the index together.
QUERIES_AT_ONCE = 4 << 20
#: Parameters of the score, in hundredths: saturation 1.2, length normalization 0.25.
SATURATION, NORMALIZED = 12, 25
INDEX = "corpus long, n_docs int, doc_ids array<long>, terms binary, starts binary, docs binary, impacts binary"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, ASCII letters lowered, a piece at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        piece = text[at:end].translate(BREAKS)
        if end < len(text):
            cut = piece.rfind(b" ")
            while cut <= 0:  # one term fills the piece
                more = text[end : end + PIECE].translate(BREAKS)
                end += PIECE
                piece += more
                cut = piece.rfind(b" ") if more else len(piece)
            piece, end = piece[:cut], at + cut
        yield piece.lower().split()
        at = end


def texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def run(batches):
        n = total = 0
        for b in batches:
            for t in texts(b):
                own = sum(map(len, terms_of(t or b"")))
                n, total = n + (own > 0), total + own
        yield [n], [total]

    r = mapped(docs.select("text"), run, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return r.n or 0, r.total or 0


class Shard:
    """Terms of some documents, counted."""

    def __init__(self):
        self.vocabulary = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.lengths = array("q")
        self.keys, self.times, self.pending, self.waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, doc_id: int | None, text: bytes) -> int:
        """A document, unless it has no term; the number of its terms."""
        length, number = 0, len(self.ids)
        for terms in terms_of(text):
            own = np.fromiter(map(self.vocabulary.__getitem__, terms), np.int64, len(terms))
            self.pending.append(own << 32 | number)
            length += len(own)
            self.waiting += len(own)
            if self.waiting >= PENDING:
                self.counted()
        if length:
            self.ids.append(doc_id)
            self.lengths.append(length)
        return length

    def counted(self) -> None:
        """Put what was gathered to the counts, in the order of terms and documents."""
        keys, times = np.unique(np.concatenate(self.pending), return_counts=True) if self.pending else (np.empty(0, np.int64), np.empty(0, np.int64))
        keys, times = np.concatenate([self.keys, keys]), np.concatenate([self.times, times])
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.times = keys[first], np.add.reduceat(times, first) if len(first) else times
        self.pending, self.waiting = [], 0

    def row(self, n_docs: int, total: int) -> tuple:
        """The shard's arrays in the order of INDEX."""
        self.counted()
        term, doc = self.keys >> 32, self.keys & 0xFFFFFFFF
        norm = np.array([100 - NORMALIZED + NORMALIZED * n * n_docs // total for n in self.lengths], np.int64)
        impacts = 1_000_000_000 * self.times // (1000 * self.times + SATURATION * norm[doc])
        starts = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        return [n_docs], [len(self.ids)], [self.ids], [b"\n".join(self.vocabulary)], [starts.astype("<i8").tobytes()], [doc.astype("<u4").tobytes()], [impacts.astype("<u4").tobytes()]


def build_index(docs: DataFrame) -> DataFrame:
    """The index of (doc_id, text), one row a shard, as a table in the shared folder. Texts aren't shuffled.

    Documents without a term, a null text among them, are in no shard; a missing or repeated doc_id is a document of
    its own.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_docs, total = corpus_size(own)

    def run(batches):
        shard, size = Shard(), 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                size += shard.add(doc_id, text or b"")
                if size >= SHARD:
                    yield shard.row(n_docs, total)
                    shard, size = Shard(), 0
        if shard.ids:
            yield shard.row(n_docs, total)

    return written(mapped(own, run, INDEX), "index")


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): each item's terms with repeats; items that agree in id and text are one."""

    def run(batches):
        for b in batches:
            yield b.column("item_id"), [b"\n".join(t for part in terms_of(x or b"") for t in part) for x in texts(b)]

    return mapped(items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct(), run, "item_id long, terms binary").where("length(terms) > 0")


def document_counts(index: DataFrame, vocabulary: dict[bytes, int]) -> dict[int, int]:
    """How many documents hold each term of a bounded vocabulary, by its number."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for terms, starts in zip(b.column("terms").to_pylist(), b.column("starts").to_pylist(), strict=True):
                sizes = np.diff(np.frombuffer(starts, "<i8"))
                for i, t in enumerate(terms.split(b"\n")):
                    if (k := sent.value.get(t)) is not None:
                        own[k] += sizes[i]
        found = np.flatnonzero(own)
        yield found, own[found]

    out = {r.term: r.n for r in mapped(index.select("terms", "starts"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    sent.destroy()
    return out


def best(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores above 0; of equal ones those that are least in order."""
    found = np.flatnonzero(scores > 0)
    if len(found) <= k:
        return found
    own = scores[found]
    cut = own[np.argpartition(own, len(own) - k)[len(own) - k]]
    sure, tied = found[own > cut], found[own == cut]
    left = k - len(sure)
    if left < len(tied):
        tied = tied[np.argpartition(order[tied], left - 1)[:left]]
    return np.concatenate([sure, tied])


def searched(index: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): the best k of each task for each of a bounded list of queries (id, terms with weights)."""
    last = np.iinfo(np.int64).max

    def run(batches):
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * len(sent.value)
        for b in batches:
            for n_docs, ids, terms, starts, docs, impacts in zip(*(b.column(c).to_pylist() for c in ("n_docs", "doc_ids", "terms", "starts", "docs", "impacts")), strict=True):
                place = {t: i for i, t in enumerate(terms.split(b"\n"))}
                starts, docs, impacts = np.frombuffer(starts, "<i8"), np.frombuffer(docs, "<u4"), np.frombuffer(impacts, "<u4").astype(np.int64)
                missing = np.array([x is None for x in ids], bool)
                order = np.array([last if x is None else x for x in ids], np.int64)
                for q, (_, wanted) in enumerate(sent.value):
                    scores = np.zeros(n_docs, np.int64)
                    for t, weight in wanted:
                        if (i := place.get(t)) is not None:
                            at = slice(starts[i], starts[i + 1])
                            scores[docs[at]] += weight * impacts[at]
                    if len(own := best(scores, order, k)):
                        both = tuple(map(np.concatenate, zip(kept[q], (scores[own], order[own], missing[own]), strict=True)))
                        top = best(both[0], both[1], k)
                        kept[q] = tuple(x[top] for x in both)
        for q, (scores, order, missing) in enumerate(kept):
            if len(scores):
                yield [q] * len(scores), [sent.value[q][0]] * len(scores), pa.array(order, mask=missing), scores

    return mapped(index, run, "item int, item_id long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item, equal scores by doc_id, missing ids last.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))). Items go through the index in blocks of about
    QUERIES_AT_ONCE bytes, one of which is with the driver and the tasks at a time. Tasks keep the best k over their
    shards, and those meet by item and a salt before they meet by item. Two items of one id and different texts are two
    rankings under that id; items without a term, or of a text without one that any document has, have no rows.
    """
    own = written(query_terms(items), "queries")
    n_docs = index.agg(F.max("corpus")).first()[0] or 0
    size = own.agg(F.sum(F.length("terms") + 64)).first()[0] or 0
    blocks, out = max(1, math.ceil(size / QUERIES_AT_ONCE)), []
    for b in range(blocks if size else 0):
        rows = own.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b).collect()
        counts = [(r.item_id, np.unique(bytes(r.terms).split(b"\n"), return_counts=True)) for r in rows]
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, (terms, _) in counts for t in terms.tolist()))}
        df = document_counts(index, vocabulary)
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[i] + 1))) for t, i in vocabulary.items() if i in df}
        queries = [(item, [(t, weight[t] * n) for t, n in zip(terms.tolist(), times.tolist(), strict=True) if weight.get(t)]) for item, (terms, times) in counts]
        sent = index.sparkSession.sparkContext.broadcast(queries)
        found = searched(index, sent, k).withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        near = found.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("r") <= k)
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        if blocks > 1:
            ranked = written(ranked, "ranked")
            sent.destroy()
        out.append(ranked)
    return reduce(DataFrame.unionByName, out) if out else items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_lexical_search(spark, sf_dir):
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_lexical_search": op12_lexical_search}
TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""
ORACLES = {
    "op12_lexical_search": f"""
WITH held AS (SELECT doc_id, {TERMS} AS term FROM documents), asked AS (SELECT item_id, {TERMS} AS term FROM benchmark),
times AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY ALL), lengths AS (SELECT doc_id, sum(tf) AS n FROM times GROUP BY ALL),
whole AS (SELECT count(*) AS docs, sum(n) AS total FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM times, whole GROUP BY term),
norms AS (SELECT doc_id, CAST(100 - 25 + (25 * n * docs) // total AS BIGINT) AS m FROM lengths, whole),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM asked JOIN times USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 20"""
}
