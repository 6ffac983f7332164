"""Operators 3, 7 and 9, and the pipeline."""

import random
import time
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from daymark.llm import decontaminate, quality, toxicity
from daymark.llm import queries as llm

from .conftest import DOCS, rows, words

SMALL = "/root/testdata/sf0.001"


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


@pytest.fixture(scope="session")
def labelled(spark):
    rng = random.Random(6)
    texts = [words(rng, 60) if i % 3 else " ".join(w.upper() + "!!" for w in words(rng, 60).split()) for i in range(300)]
    texts = [t + (" scum idiot" if i % 5 == 0 else "") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows([*texts, "", None]), DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0), "clash") for i in range(300)] + [(None, 1, 1, "x"), (1, None, None, "x"), (9999, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    return docs, labels


def test_quality_held_out(labelled):
    docs, labels = labelled
    model = quality.train_quality(docs, labels)
    scored = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    held = [i for i in range(300) if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert auc([(scored[i], i % 3 > 0) for i in held]) > 0.98 and all(0 <= s <= 1 for s in scored.values()) and len(scored) == 302
    kept = quality.reject_low_quality(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scored.items() if s >= 0.5}


def test_models_without_rows(spark, labelled, no_documents, odd_documents):
    docs, labels = labelled
    for empty in (labels.limit(0), labels.where("doc_id = 9999")):
        assert {r.score for r in quality.score_quality(docs, quality.train_quality(docs, empty)).collect()} == {0.5}
        assert len({r.score for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, empty)).collect()}) == 1
    assert quality.score_quality(no_documents, quality.train_quality(no_documents, labels)).count() == 0
    assert toxicity.score_toxicity(no_documents, toxicity.train_toxicity(no_documents, labels)).count() == 0
    assert toxicity.score_toxicity(odd_documents, toxicity.train_toxicity(docs, labels)).count() == odd_documents.count()


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    scored = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()}
    held = [i for i in range(300) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert auc([(scored[i].score, i % 5 == 0) for i in held]) > 0.98
    near = scored[5].evidence
    assert near and near[0].label == 1 and near[0].cosine <= 1 + 1e-9


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(500):
        ids = np.sort(rng.choice(60, rng.integers(0, 9), replace=False))
        vectors.append((ids, toxicity.unit(ids, rng.random(60) + 0.1)))
    index = toxicity.BlockMaxIndex(vectors, 60)
    for ids, values in vectors[:150]:
        dense = np.zeros(60)
        dense[ids] = values
        cosines = sorted(((-round(float(dense[i] @ v), 12), k) for k, (i, v) in enumerate(vectors) if round(float(dense[i] @ v), 12) > 0))[:15]
        near, found = index.nearest(ids, values)
        assert [(-round(float(c), 9), int(k)) for k, c in zip(near, found, strict=True)] == [(round(c, 9), k) for c, k in cosines]


def edits_by_hand(item, text):
    last = list(range(len(item) + 1))
    best = last[-1]
    for c in text:
        now = [0]
        for i, a in enumerate(item):
            now.append(min(last[i] + (a != c), last[i + 1] + 1, now[i] + 1))
        last = now
        best = min(best, last[-1])
    return best


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(200):
        item, text = (bytes(rng.choice(b"ab c") for _ in range(rng.randint(a, b))) for a, b in ((1, 12), (0, 30)))
        assert decontaminate.least_edits(item, text) == edits_by_hand(item, text)


def test_contamination_against_brute_force(spark, no_documents, odd_documents):
    rng = random.Random(9)
    items = [words(rng, rng.randint(12, 40)) for _ in range(12)] + ["", None, "short one", "tiny"]
    texts = []
    for i in range(60):
        text = words(rng, 40)
        if i % 3 == 0:
            own = items[i % 12].split()
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(["", "other", "Zz"])
            text = text[:150] + "\n" + " ".join(own).upper() + " " + text[150:]
        texts.append(text)
    texts += ["", None, "has a Short   one inside", items[0]]
    benchmark = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(items)], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame(rows(texts), DOCS)
    found = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(docs, benchmark).collect()}
    plain, wanted = [decontaminate.normal(t) for t in texts], [decontaminate.normal(t) for t in items]
    true = {(i, k): e for i, t in enumerate(plain) for k, x in enumerate(wanted) if x and (e := edits_by_hand(x, t)) <= len(x) * 20 // 100}
    assert found == true
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, benchmark).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in found}
    assert decontaminate.contaminated(no_documents, benchmark).count() == 0 == decontaminate.contaminated(docs, benchmark.limit(0)).count()
    assert decontaminate.drop_contaminated(odd_documents, benchmark).count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas(), stage(spark, docs, SMALL).schema)
        sizes.append(docs.count())
        assert docs.columns == before or name == "byte_bpe"
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    assert all(k in llm.queries() for k in ("op1_byte_bpe", "op9_decontaminate")) and Counter(llm.queries())


def test_every_passage_within_the_edits_is_a_candidate():
    rng = random.Random(3)
    items = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(14, 60))).encode() for _ in range(60)]
    own, texts = decontaminate.Items(list(enumerate(items)), 80, 100), []
    for i, t in enumerate(items):
        if i % 3 == 0:  # one character in each word
            text = b" ".join(w[: len(w) // 2] + b"#" + w[len(w) // 2 + 1 :] for w in t.split())
        elif i % 3 == 1:  # a substitution every six bytes
            text = b"".join(b"#" if j % 6 == 3 else t[j : j + 1] for j in range(len(t)))
        else:  # as many edits as are allowed
            text = bytearray(t)
            for _ in range(len(t) // 5):
                j = rng.randrange(len(text))
                text[j : j + 1] = rng.choice([b"", b"#", text[j : j + 1] + b"#"])
        texts.append(b"lead " * rng.randint(0, 9) + bytes(text) + b" tail")
    found = {(i, k): e for i, k, e, _ in decontaminate.searched(own, texts)}
    for i, (t, text) in enumerate(zip(items, texts, strict=True)):
        e = decontaminate.least_edits(t, text)
        assert found.get((i, i)) == (e if e <= len(t) // 5 else None)
    assert len([1 for i, k in found if i == k]) > 45


def test_runs_against_brute_force(monkeypatch):
    rng = random.Random(12)
    units = [b"-", b"=-", b"- ", b"| --- ", b"abcdefg", b"abcdefghijk"]

    def mixed(n):
        out = b""
        while len(out) < n:
            out += rng.choice([rng.choice(units) * rng.randint(4, 30), bytes(rng.choice(b"etaoinshrdlu ") for _ in range(rng.randint(5, 60)))])
        return out

    items = [mixed(rng.randint(20, 200)) for _ in range(16)] + [b"-" * 40, b"=-" * 30, b"| --- " * 60]
    texts = [mixed(300) for _ in range(20)] + [b"-" * 500, b"- " * 300, b"| --- " * 90, b"-" * 30, b""]
    for t in items * 2:
        text = bytearray(t)
        for _ in range(rng.randint(0, len(t) // 5)):
            j = rng.randrange(len(text))
            text[j : j + 1] = rng.choice([b"", b"#", text[j : j + 1] + b"-"])
        texts.append(mixed(60) + bytes(text) + mixed(60))
    true = {(i, k): e for i, text in enumerate(texts) for k, t in enumerate(items) if (e := decontaminate.least_edits(t, text)) <= len(t) // 5}
    # small blocks and few hits at once change the work, not the result; nor do counted bytes
    for block, hits, parts in ((1 << 20, 4 << 20, 1 << 18), (1500, 1000, 7), (300, 1, 1)):
        for name, value in (("BLOCK", block), ("HITS", hits), ("PARTS", parts)):
            monkeypatch.setattr(decontaminate, name, value)
        found = {(i, k): e for i, k, e, _ in decontaminate.searched(decontaminate.Items(list(enumerate(items)), 80, 100), texts)}
        assert found == true and len(true) > 40


def test_long_runs_cost_as_much_as_words():
    rng = random.Random(1)
    letters = lambda: "".join(rng.choice("etaoin shrdlu") for _ in range(120))
    items = [(i, f"{letters()} {'-' * 40} {letters()}".encode()) for i in range(50)]
    begin = time.perf_counter()
    long = [b"-" * 1_000_000, b"- " * 300_000, (b"-" * 40 + b" | word ") * 4000, b"-" * 500_000 + items[7][1] + b"-" * 500_000]
    assert [(i, k, e, s) for i, k, e, s in decontaminate.searched(decontaminate.Items(items, 80, 100), long)] == [(3, 7, 0, 500_000)]
    rulers = [(i, b"-" * (30 + i)) for i in range(50)]
    assert len(list(decontaminate.searched(decontaminate.Items(rulers, 80, 100), [b"-" * 1_000_000]))) == 50
    assert time.perf_counter() - begin < 30


def test_items_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    texts = [f"item {i} " + "x" * 40 for i in range(9)]
    benchmark = spark.createDataFrame([(None if i < 5 else 3, t) for i, t in enumerate(texts)] + [(3, None)], "item_id long, text string")
    pieces = list(decontaminate.item_chunks(benchmark, "item_id", "text"))
    assert max(map(len, pieces)) <= 2 and sorted(t.decode() for p in pieces for _, t in p) == texts
    docs = spark.createDataFrame(rows(["a " + texts[2], "b " + texts[7], "nothing of that kind"]), DOCS)
    assert {r.doc_id for r in decontaminate.contaminated(docs, benchmark, 95).collect()} == {0, 1}


def test_short_items_against_brute_force():
    rng = random.Random(8)
    items = [bytes(rng.choice(b"abcdefgh ijkl") for _ in range(n)).replace(b" ", b"x") for n in range(1, 31)]
    texts = []
    for t in items * 4:
        text = bytearray(t)
        for _ in range(rng.randint(0, len(t) // 5 + 1)):
            j = rng.randrange(len(text) + 1)
            text[j : j + 1] = rng.choice([b"", b"#", b"a#"])
        texts.append(b"once " * rng.randint(0, 3) + bytes(text) + rng.choice([b"", b" more"]))
    for num in (80, 60):
        own = decontaminate.Items(list(enumerate(items)), num, 100)
        found = {(i, k): e for i, k, e, _ in decontaminate.searched(own, texts)}
        true = {(i, k): e for i, text in enumerate(texts) for k, t in enumerate(items) if (e := edits_by_hand(t, text)) <= len(t) * (100 - num) // 100}
        assert found == true
