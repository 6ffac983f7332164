"""Registered queries over sf0.001 against libraries and plain computations, and the pipeline's stages on odd tables."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from daymark.llm import byte_bpe, fingerprints, near_duplicates, quality, substrings, token_files, toxicity, warc

from .test_documents import removed_by_hand

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    con = duckdb.connect()
    return con.execute(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


def test_byte_bpe_equals_the_library(spark, small):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.QUERIES["op1_byte_bpe"](spark, SMALL).collect()}
    for i, t in small:
        ids = own.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_token_files_equal_the_library(spark, small):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.QUERIES["op8_token_files"](spark, SMALL).collect()}
    start = 0
    for i, t in small:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_substrings_query_by_hand(spark, small):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.QUERIES["op2_substrings"](spark, SMALL).collect()}
    for (i, _), (n, removed, spans, kept) in zip(small, removed_by_hand([t for _, t in small]), strict=True):
        assert got[i] == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_near_duplicates_query_by_hand(spark, small):
    sets = {}
    for i, t in small:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))} if ws else set()
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed = changed or (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.QUERIES["op4_near_duplicates"](spark, SMALL).collect()}
    assert got == {i: (len(s), label[i]) for i, s in sets.items()} and links


def test_warc_query_by_hand(spark):
    pages = duckdb.connect().execute(f"SELECT page_id, coalesce(encode(html), ''::BLOB) FROM '{SMALL}/pages.parquet'").fetchall()
    last = {}
    for i, data in pages:
        last[data] = max(i, last.get(data, i))
    wanted = {i: (len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if last[d] == i else "revisit", None if last[d] == i else last[d]) for i, d in pages}
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.QUERIES["op10_warc"](spark, SMALL).collect()}
    assert got == wanted


def test_fingerprint_query_by_its_contract(spark, small):
    ids, texts = [i for i, _ in reversed(small)], [t or "" for _, t in reversed(small)]
    got = {r.doc_id: r for r in fingerprints.QUERIES["op5_fingerprints"](spark, SMALL).collect()}
    prints = {}
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        after, half = texts[(k + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + after[:half] if half else t
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert (r.near_next == 1) >= (r.fingerprint == got[ids[(k + 1) % len(ids)]].fingerprint)


def buckets(text):
    for w in (text or "").split():
        marked = f"<{w}>".encode()
        yield zlib.crc32(marked) % quality.BUCKETS
        for n in quality.NGRAMS:
            for i in range(len(marked) - n + 1):
                yield zlib.crc32(marked[i : i + n], n) % quality.BUCKETS


def test_quality_scores_are_plain_averages(spark, small, monkeypatch):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train_quality(docs, labels)
    monkeypatch.setattr(quality, "train_quality", lambda *a, **k: model)
    got = {r.doc_id: r for r in quality.QUERIES["op3_quality"](spark, SMALL).collect()}
    for i, t in small:
        own = list(buckets(t))
        mean = model["vectors"][own].astype(float).mean(axis=0) if own else np.zeros(quality.DIMENSIONS)
        z = mean @ model["soft"].astype(float) + model["offset"]
        p = np.exp(z - z.max())
        score = p[1] / p.sum()
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert len(got) == len(small)


def test_toxicity_votes_by_full_scan(spark, small, monkeypatch):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.train_toxicity(docs, labels)
    monkeypatch.setattr(toxicity, "train_toxicity", lambda *a, **k: model)
    got = {r.doc_id: r for r in toxicity.QUERIES["op7_toxicity"](spark, SMALL).collect()}
    by_id, vocabulary = dict(small), toxicity.Vocabulary(model["terms"])

    def dense(t):
        v = np.zeros(len(model["terms"]))
        ids = vocabulary.ids(t or "")
        v[ids] = model["idf"][ids]
        return v / (np.sqrt((v * v).sum()) or 1.0)

    examples = np.array([dense(by_id[i]) for i in model["doc_id"].tolist()]).reshape(len(model["doc_id"]), len(model["terms"]))
    assert not {i for i in model["doc_id"].tolist() if zlib.crc32(str(i).encode()) % 5 == 0}
    for i, t in small:
        cosines = np.round(examples @ dense(t), 12)
        near = sorted((k for k in range(len(cosines)) if cosines[k] > 0), key=lambda k: (-cosines[k], k))[: toxicity.K]
        votes = [(cosines[k] ** toxicity.SHARPNESS * model["vote"][k], model["label"][k]) for k in near]
        score = (sum(v for v, y in votes if y == 1) + toxicity.PRIOR_VOTE * model["prior"]) / (sum(v for v, _ in votes) + toxicity.PRIOR_VOTE)
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert len(got) == len(small)


def odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    some = docs.orderBy("doc_id").limit(30)
    text = some.first().text
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "one", None, None, 3), (None, text, "en", "s", len(text)), (3, text, "en", "s", len(text)), (3, text, "en", "s", len(text)), (4, text + " " + "x" * 30_000, "en", "s", None), (5, " \n\t ", "en", "s", 4)]
    return some.unionByName(spark.createDataFrame(odd, docs.schema)).repartition(3)


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_tables(spark, at):
    """Missing values in any column, repeated ids and rows, white space, a long word; further columns with clashing names; no rows."""
    name, stage = corpus_pipeline.STAGES[at]
    docs = odd_rows(spark)
    out = stage(spark, docs, SMALL)
    n = out.count()
    clash = docs.withColumns({c: F.lit(1) for c in ("rid", "kind", "part", "score", "label", "item_id", "component_id", "n_tokens", "hash", "salt", "any", "kept")})
    more = stage(spark, clash, SMALL)
    assert more.count() == n and stage(spark, docs.limit(0), SMALL).count() == 0
    if name == "byte_bpe":
        assert n == docs.count() and {"doc_id", "n_tokens", "token_ids"} <= set(out.columns)
    else:
        assert out.columns == docs.columns and set(docs.columns) <= set(more.columns) and 0 < n <= docs.count()
    if name == "near_duplicates":
        assert n < docs.count()
