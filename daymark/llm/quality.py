"""A quality classifier with learned subword embeddings.

A document's features are its words and the character n-grams of each word with its ends marked, hashed to a fixed
number of buckets. Each bucket has a vector; their average is the document's vector, and a softmax over it gives the
score. Vectors and softmax are learned together by stochastic gradient descent in numpy, in one task, from a bounded
sample of labelled rows. For scoring, the product of each bucket's vector with the softmax weights is taken first
(the average is linear), so a word costs one number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Memo
from .common import keep_text, mapped, table
from .labelled import held_out, labelled_sample

BUCKETS = 1 << 17
DIMENSIONS = 16
NGRAMS = (3, 4)
#: Labelled rows that are learned from, at most.
SAMPLE = 4000
EPOCHS = 12
RATE = 0.5
SEED = 7
MEMO = 400_000


def features(word: str) -> list[int]:
    """The buckets of a word and its character n-grams, with repeats."""
    marked = f"<{word}>".encode()
    crc = zlib.crc32
    out = [crc(marked) % BUCKETS]
    # over bytes, so that an n-gram is a slice; the ends of a very long word are as good as its middle
    for n in NGRAMS:
        out += [crc(marked[i : i + n], n) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def counted(text: str, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and each one's share."""
    ids = np.concatenate([np.empty(0, np.int32), *map(memo.__getitem__, text.split())])
    ids, n = np.unique(ids, return_counts=True)
    return ids.astype(np.int32), (n / max(n.sum(), 1)).astype(np.float32)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], weights: dict[int, float], epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket vectors, softmax weights and offsets, learned by one document at a time."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    soft, offset = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share, y = rows[i]
            step = rate * (1 - done / steps)
            done += 1
            own = vectors[ids]
            mean = share @ own
            z = mean @ soft + offset
            p = np.exp(z - z.max())
            grad = p / p.sum()
            grad[y] -= 1
            grad *= np.float32(weights.get(y, 1.0))
            back = soft @ grad
            soft -= step * np.outer(mean, grad)
            offset -= step * 0.1 * grad
            if len(ids):
                # the step of the mean is `step`, however many features share it
                vectors[ids] = own - (step / max(float(share @ share), 1e-6)) * np.outer(share, back)
    return vectors, soft, offset


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1, most: int = SAMPLE) -> dict:
    """The model: vectors, soft, offset as arrays. Without labelled rows every score is 0.5."""
    sample, weights = labelled_sample(docs, labels, label, modulus, remainder, most)

    def featured(batches):
        memo = Memo(lambda w: np.array(features(w), np.int32), 50_000)
        for b in batches:
            own = [counted(t, memo) for t in b.column("text").to_pylist()]
            yield b.column("doc_id"), b.column("label"), [x.tobytes() for x, _ in own], [x.tobytes() for _, x in own]

    def trained(batches):
        rows = [(i, np.frombuffer(x, np.int32), np.frombuffer(s, np.float32), y) for b in batches for i, y, x, s in zip(*(b.column(c).to_pylist() for c in ("doc_id", "label", "ids", "share")), strict=True)]
        rows.sort(key=lambda r: (r[0], r[3]))
        v, s, o = learn([r[1:] for r in rows], weights)
        yield [v.tobytes()], [s.tobytes()], [o.tobytes()]

    few = mapped(sample.select("doc_id", "label", "text"), featured, "doc_id long, label int, ids binary, share binary")
    # one task learns from `most` rows at most
    model = mapped(few.repartition(1), trained, "vectors binary, soft binary, offset binary").collect()[0]
    array = lambda x, *shape: np.frombuffer(x, np.float32).reshape(shape)
    return {"vectors": array(model.vectors, BUCKETS, DIMENSIONS), "soft": array(model.soft, DIMENSIONS, 2), "offset": array(model.offset, 2)}


class Scorer:
    """Scores texts with a model, each distinct word once while the memo holds it."""

    def __init__(self, by_bucket: list[float], base: float):
        self.values, self.base, self.memo = by_bucket, base, Memo(self.worth, MEMO)

    def worth(self, word: str) -> complex:
        """The sum of a word's buckets, and as imaginary part their number."""
        own = features(word)
        return complex(sum([self.values[i] for i in own]), len(own))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        sums = [sum(map(self.memo.__getitem__, (t or "").split()), 0j) for t in texts]
        z = self.base + np.array([x.real / x.imag if x.imag else 0.0 for x in sums])
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def folded(model: dict) -> tuple[list[float], float]:
    """One number for each bucket, its vector times the difference of the softmax weights, and one for the offsets."""
    by_bucket = model["vectors"].astype(np.float64) @ (model["soft"][:, 1] - model["soft"][:, 0]).astype(np.float64)
    return by_bucket.tolist(), float(model["offset"][1] - model["offset"][0])


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; an empty or null text gets what the offsets say."""
    sent = docs.sparkSession.sparkContext.broadcast(folded(model))  # BUCKETS numbers

    def run(batches):
        scorer = Scorer(*sent.value)
        for b in batches:
            yield b.column("doc_id"), scorer.scores(b.column("text").to_pylist())

    return mapped(keep_text(docs, id_col, text_col), run, "doc_id long, score double")


def reject_low_quality(docs: DataFrame, model: dict, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores `least` or more. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(folded(model))

    def run(batches):
        scorer = Scorer(*sent.value)
        for b in batches:
            yield b.filter(pa.array(scorer.scores(b.column(text_col).to_pylist()) >= least))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
