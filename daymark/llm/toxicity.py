"""Toxicity by the nearest labelled examples, with exact TF-IDF cosines from a block-max inverted index.

The index holds a bounded, stratified sample of labelled documents. A document's terms are its words and their
beginnings, once for each level that their count reaches. The vocabulary is the terms whose document
frequency in the sample differs most between the labels (near copies count once); their inverse document frequencies come from all documents.
Examples are laid out in blocks; each term keeps its postings block by block and the largest weight in each block.
A query visits blocks by falling upper bound and stops when the bound of the next is below its k-th best cosine, so
the neighbours are those that a full scan gives. Votes are weighted by cosine and by class, with the prior as one
more voter; the neighbours are the evidence.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Memo
from .common import keep_text, mapped, table
from .labelled import held_out, labelled_sample

#: Labelled rows in the index, at most.
SAMPLE = 4000
VOCABULARY = 1024
#: Least difference of a word's document frequencies between the labels, in standard errors.
LEAST_Z = 4.0
#: And least part of the best word's difference, which leaves out words that a few alike documents bring along.
LEAST_PART = 0.3
#: Letters of a word's beginning that count as a key of their own, and the counts that each make a term.
BEGINNING = 5
LEVELS = (1, 2, 3, 4, 6, 8, 12)
BLOCK = 64
K = 15
#: A vote is the cosine to this power; the prior has a vote too.
SHARPNESS = 4
PRIOR_VOTE = 0.2
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def keys(word: str) -> tuple[str, ...]:
    """What a word counts for: itself, and its beginning where it is longer."""
    return (word, word[:BEGINNING] + "*") if len(word) > BEGINNING else (word,)


def reached(counts: dict[str, int]) -> list[str]:
    """A key and level for each level that the key's count reaches; these are the index's terms."""
    return [f"{key}#{level}" for key, n in counts.items() for level in LEVELS if n >= level]


def terms_of(ws: list[str]) -> list[str]:
    counts: Counter = Counter()
    for w, n in Counter(ws).items():
        for key in keys(w):
            counts[key] += n
    return reached(counts)


class Vocabulary:
    """The chosen terms, and a fast way from a text to those that it has."""

    def __init__(self, terms: list[str]):
        self.at = {t: i for i, t in enumerate(terms)}
        wanted = {t.rpartition("#")[0] for t in terms}
        self.keys_of = Memo(lambda w: tuple(k for k in keys(w) if k in wanted), 200_000)

    def ids(self, text: str) -> np.ndarray:
        counts: Counter = Counter(chain.from_iterable(map(self.keys_of.__getitem__, words(text))))
        return np.array(sorted(self.at[t] for t in reached(counts) if t in self.at), np.int64)


def sketch(ws: list[str], n: int = 5) -> int:
    """The least hash of a text's word n-grams: near copies mostly share it, and then count once as evidence for a word."""
    return min((zlib.crc32(" ".join(ws[i : i + n]).encode()) for i in range(max(1, len(ws) - n + 1))), default=0)


def choose_terms(counts: dict[int, Counter], totals: dict[int, int], most: int = VOCABULARY, least_z: float = LEAST_Z) -> list[str]:
    """The words whose document frequencies tell the labels apart best, in the order of that."""
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return []
    out = []
    for w, a in counts[1].items():
        b = counts[0].get(w, 0)
        p = (a + b + 1) / (n0 + n1 + 2)
        z = (a / n1 - b / n0) / (p * (1 - p) * (1 / n0 + 1 / n1)) ** 0.5
        if z >= least_z and a >= 3:
            out.append((-z, w))
    return [w for z, w in sorted(out)[:most] if z <= LEAST_PART * min(out)[0]]


def unit(ids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF weights of a document's terms."""
    value = idf[ids]
    return value / np.sqrt((value * value).sum()) if len(ids) else value


class BlockMaxIndex:
    """Inverted index over unit vectors: per term and block the postings, and the largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        self.n, self.block = len(vectors), block
        self.blocks = -(-self.n // block) if self.n else 0
        doc = np.repeat(np.arange(self.n), [len(i) for i, _ in vectors]) if self.n else np.empty(0, np.int64)
        term = np.concatenate([np.empty(0, np.int64), *(i for i, _ in vectors)]).astype(np.int64)
        weight = np.concatenate([np.empty(0), *(v for _, v in vectors)])
        cell = term * max(self.blocks, 1) + doc // block
        order = np.argsort(cell, kind="stable")
        self.doc, self.weight, cell = doc[order], weight[order], cell[order]
        cells = terms * max(self.blocks, 1)
        self.start = np.searchsorted(cell, np.arange(cells + 1))
        self.most = np.zeros(cells)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(terms, max(self.blocks, 1))

    def nearest(self, ids: np.ndarray, values: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine (ties: the earlier example) and their cosines."""
        if not len(ids) or not self.n:
            return np.empty(0, np.int64), np.empty(0)
        bound = values @ self.most[ids]
        order = np.argsort(-bound, kind="stable")
        found, scores = [np.empty(0, np.int64)], [np.empty(0)]
        best, floor, taken = np.empty(0), 0.0, 0
        while taken < len(order) and bound[order[taken]] > 0 and (len(best) < k or bound[order[taken]] >= floor - 1e-12):
            step = order[taken : taken + 4]
            taken += len(step)
            for b in step[bound[step] > 0].tolist():
                sums = np.zeros(self.block)
                for t, v in zip(ids.tolist(), values.tolist(), strict=True):
                    lo, hi = self.start[t * self.blocks + b : t * self.blocks + b + 2]
                    if hi > lo:
                        sums[self.doc[lo:hi] - b * self.block] += v * self.weight[lo:hi]
                hit = np.flatnonzero(sums)
                found.append(hit + b * self.block)
                scores.append(sums[hit])
                best = np.sort(np.concatenate([best, sums[hit]]))[-k:]
            floor = best[0] if len(best) == k else 0.0
        at, s = np.concatenate(found), np.round(np.concatenate(scores), 12)
        top = np.lexsort((at, -s))[:k]
        return at[top], s[top]


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each of these terms occurs, over all documents.

    Each task sums its part for this bounded list of terms first.
    """

    def run(batches):
        vocabulary = Vocabulary(terms)
        sums, n = np.zeros(len(terms), np.int64), 0
        for b in batches:
            texts = b.column("text").to_pylist()
            n += len(texts)
            for t in texts:
                sums[vocabulary.ids(t)] += 1
        if n:
            yield [-1, *range(len(terms))], [n, *sums.tolist()]

    rows = mapped(keep_text(docs).select("text"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    got = {r.term: r.n for r in rows}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(len(terms))], np.float64)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0, most: int = SAMPLE) -> dict:
    """The index and what a query needs with it."""
    sample, weights = labelled_sample(docs, labels, label, modulus, remainder, most)

    def listed(batches):
        for b in batches:
            own = [words(t) for t in b.column("text").to_pylist()]
            yield b.column("label"), [sketch(ws) for ws in own], [terms_of(ws) for ws in own]

    # at most `most` rows: what the words of the examples tell
    rows = mapped(sample.select("label", "text"), listed, "label int, sketch long, terms array<string>")
    told_apart = {r.label: r.n for r in rows.groupBy("label").agg(F.count_distinct("sketch").alias("n")).collect()}
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    both = rows.select("label", "sketch", F.explode("terms").alias("term")).groupBy("term").agg(*(F.count_distinct(F.when(F.col("label") == y, F.col("sketch"))).alias(f"n{y}") for y in (0, 1)))
    for r in both.where("n1 >= 3 and n1 > n0 / 4").toLocalIterator():
        counts[0][r.term], counts[1][r.term] = r.n0, r.n1
    terms = choose_terms(counts, told_apart)
    n, df = document_frequencies(docs, terms)
    idf = np.log((1 + n) / (1 + df)) + 1

    def weighed(batches):
        vocabulary = Vocabulary(terms)
        for b in batches:
            yield b.column("doc_id"), b.column("label"), [vocabulary.ids(t).tolist() for t in b.column("text").to_pylist()]

    got = mapped(sample.select("doc_id", "label", "text"), weighed, "doc_id long, label int, ids array<int>").collect()
    got.sort(key=lambda r: (min(r.ids, default=len(terms)), r.doc_id))  # alike examples share blocks, which tightens bounds
    votes = Counter()
    for r in got:
        votes[r.label] += weights.get(r.label, 1.0)
    return {
        "terms": terms, "idf": idf, "doc_id": np.array([r.doc_id for r in got], np.int64), "label": np.array([r.label for r in got], np.int64),
        "vote": np.array([weights.get(r.label, 1.0) for r in got]), "prior": votes[1] / sum(votes.values()) if votes else 0.5,
        "index": BlockMaxIndex([(ids := np.array(r.ids, np.int64), unit(ids, idf)) for r in got], len(terms)),
    }


def score_one(ids: np.ndarray, model: dict, k: int = K) -> tuple[float, np.ndarray, np.ndarray]:
    near, cosine = model["index"].nearest(ids, unit(ids, model["idf"]), k)
    vote = cosine**SHARPNESS * model["vote"][near]
    score = (float(vote[model["label"][near] == 1].sum()) + PRIOR_VOTE * model["prior"]) / (float(vote.sum()) + PRIOR_VOTE)
    return score, near, cosine


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """(doc_id, score, evidence): evidence has the ids, labels and cosines of the nearest examples.

    A text without a word of the vocabulary, an empty or a null text get the prior and no evidence.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE and VOCABULARY

    def run(batches):
        m = sent.value
        vocabulary = Vocabulary(m["terms"])
        for b in batches:
            own = [score_one(vocabulary.ids(t), m) for t in b.column("text").to_pylist()]
            said = [[{"doc_id": int(m["doc_id"][i]), "label": int(m["label"][i]), "cosine": float(c)} for i, c in zip(near[:evidence], cosine[:evidence], strict=True)] for _, near, cosine in own]
            yield b.column("doc_id"), [s for s, _, _ in own], said

    return mapped(keep_text(docs, id_col, text_col), run, "doc_id long, score double, evidence array<struct<doc_id: long, label: int, cosine: double>>")


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
