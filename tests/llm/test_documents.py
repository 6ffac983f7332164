"""Operators 2, 4, 5 and 10 against brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest

from daymark.llm import fingerprints, near_duplicates, substrings, warc
from daymark.llm.common import fresh_dir
from daymark.llm.graph import components

from .conftest import DOCS, rows, words


def removed_by_hand(texts, length=100):
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        cover = np.zeros(len(data) + 1, int)
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                cover[s] += 1
                cover[s + length] -= 1
            seen.add(data[s : s + length])
        gone = np.cumsum(cover[:-1]) > 0
        out.append((len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(data, np.uint8)[~gone])))
    return out


def test_repeated_substrings(spark, documents, base_texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.drop_repeated(documents).collect()}
    assert [got[i] for i in range(len(base_texts))] == removed_by_hand(base_texts)


def test_repeated_substrings_odd_tables(odd_documents, no_documents):
    out = substrings.drop_repeated(odd_documents, passed=("kind", "lang", "passed_0")).collect()
    assert len(out) == odd_documents.count() and {(r.kind, r.lang, r.passed_0) for r in out} == {(9, "en", "p")}
    own = sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.text or "") for r in odd_documents.collect())
    expected = removed_by_hand([t for _, t in own])
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == sorted(expected)
    assert substrings.drop_repeated(no_documents).count() == 0


def test_very_common_grams_are_split(monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 3)
    rng = random.Random(1)
    line = bytes(rng.choice(b"abcdefgh ") for _ in range(130))
    noise = lambda n, of: bytes(rng.choice(of) for _ in range(rng.randint(0, n)))
    docs = []
    for _ in range(60):
        k = rng.choice([90, 100, 104, 115, 130])
        o = rng.randint(0, 130 - k)
        docs.append(noise(60, b"abcdefgh ") + line[o : o + k] + noise(60, b"ab"))
    own = [(i, d) for i, d in enumerate(docs) if len(d) >= 100]
    covered, several = substrings.first_contexts(substrings.anchors([d for _, d in own], [i for i, _ in own]))
    assert several["hot"].any()
    cut = np.concatenate([substrings.cut_out(d, several[several["rid"] == i], 100) for i, d in own])
    cut = cut[np.argsort(cut["key"], kind="stable")]
    spans = [substrings.repeated(substrings.symbols(cut[at]), cut[at]["rid"], cut[at]["pos"], 100) for at in substrings.blocks(cut["key"], 5)]
    marks = substrings.merged(covered, np.concatenate(spans), substrings.reach(100), 100)
    assert [substrings.without(d, i, marks, False) for i, d in enumerate(docs)] == removed_by_hand([d.decode() for d in docs])


def test_contexts_are_compared_by_what_they_share():
    """Near copies with an edit every 150 bytes: what no other context shares isn't sorted, and the same is covered."""
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    docs = [text, *(bytes(c if i % 150 != k * 7 else 33 + k for i, c in enumerate(text)) for k in range(1, 6)), bytes(rng.choice(b"xy") for _ in range(300)) * 2]
    covered, several = substrings.first_contexts(substrings.anchors(docs, list(range(len(docs)))))
    cut = np.concatenate([substrings.cut_out(d, several[several["rid"] == i], 100) for i, d in enumerate(docs)])
    cut = cut[np.argsort(cut["key"], kind="stable")]
    spans, before, after = [], 0, 0
    for at in substrings.blocks(cut["key"], 7):
        own = substrings.shared_part(cut[at], 100)
        before, after = before + (substrings.symbols(cut[at]) > 0).sum(), after + (substrings.symbols(own) > 0).sum()
        spans.append(substrings.repeated(substrings.symbols(own), own["rid"], own["pos"], 100))
    marks = substrings.merged(covered, np.concatenate(spans), substrings.reach(100), 100)
    assert after < 0.85 * before
    assert [substrings.without(d, i, marks, False) for i, d in enumerate(docs)] == removed_by_hand([d.decode() for d in docs])


def classes_by_hand(texts, n, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    top = list(range(len(texts)))
    find = lambda x: x if top[x] == x else find(top[x])
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_near_duplicates(spark, base_texts, n, num):
    rng = random.Random(n)
    texts = list(base_texts)
    for _ in range(6):  # chains of edits: neighbours link, ends may not
        own = words(rng, 140).split()
        for _ in range(7):
            texts.append(" ".join(own))
            own[rng.randrange(len(own))] = "changed"
            own = own[: len(own) - rng.randint(0, 2)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows(texts), DOCS), n, num, 100).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_hand(texts, n, num, 100)


def test_near_duplicates_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 300)
    rng = random.Random(3)
    own, texts = words(rng, 120).split(), []
    for _ in range(25):
        texts.append(" ".join(own))
        own[rng.randrange(len(own))] = f"c{rng.randrange(99)}"
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(spark.createDataFrame(rows(texts), DOCS), 3, 90, 100).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in classes_by_hand(texts, 3, 90, 100)]


def test_near_duplicates_odd_tables(odd_documents, no_documents):
    out = near_duplicates.near_duplicates(odd_documents, 3, 90, 100).collect()
    assert len(out) == odd_documents.count() and {r.rid for r in out} == set(range(len(out)))
    assert near_duplicates.near_duplicates(no_documents).count() == 0
    kept = near_duplicates.drop_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns and 0 < kept.count() < odd_documents.count()


def test_bounds_never_lose_a_link():
    rng, of = random.Random(8), near_duplicates.Similarity(90, 100)
    for _ in range(120):
        a = {rng.getrandbits(64) for _ in range(rng.randint(1, 400))}
        b = set(list(a)[: len(a) - rng.randint(0, max(1, len(a) // 12))]) | {rng.getrandbits(64) for _ in range(rng.randint(0, max(1, len(a) // 12)))}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if b and of.linked(len(a & b), len(a), len(b)):
            assert set(of.keys(x).tolist()) & set(of.keys(y).tolist())
            for groups in (64, 512):
                assert of.linked(int(np.minimum(near_duplicates.point(x, groups), near_duplicates.point(y, groups)).sum()), len(a), len(b))
            assert (near_duplicates.folded(near_duplicates.point(x, 512), 64) == near_duplicates.point(x, 64)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (200, 150)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100, 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fingerprints(spark, documents, no_documents, base_texts):
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(documents).collect()}
    assert got[0] == got[24] == got[25] and got[29] == got[30] and len({got[i] for i in range(24)}) == 24
    row = lambda t: np.frombuffer(fingerprints.fingerprints([t])[0], np.uint8)[None]
    rng = random.Random(5)
    a, b = words(rng, 800, 9000).encode(), words(rng, 800, 9000).encode()
    assert fingerprints.likeness(row(a), row(b"some words in front " + a))[0] > 0.9
    assert 0.2 < fingerprints.likeness(row(a), row(a[: len(a) // 2] + b[: len(b) // 2]))[0] < 0.5
    assert fingerprints.likeness(row(a), row(b))[0] < 0.1
    assert fingerprints.likeness(row(b""), row(b""))[0] == 1 and fingerprints.likeness(row(b""), row(a))[0] == 0
    together = fingerprints.fingerprints([a, b"", b, b"x", b"aaaaaaaa"])
    assert together == [fingerprints.fingerprints([t])[0] for t in (a, b"", b, b"x", b"aaaaaaaa")]
    assert fingerprints.fingerprint(no_documents).count() == 0


def test_windows_of_long_texts_parse_as_the_whole(monkeypatch):
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcde  ") for _ in range(rng.randint(1, 3000))) for _ in range(30)]
    texts += [b"a" * 5000, b"a" * 900 + b"bcbcbcb" * 300 + b"z" * 3000, b"x", b"xy", b"xyz", b"ab" * 4000]
    whole = fingerprints.fingerprints(texts)
    for block in (40, 100, 1000):
        monkeypatch.setattr(fingerprints, "BLOCK", block)
        assert [fingerprints.long_fingerprint(t) for t in texts] == whole
        assert fingerprints.blockwise([b"", *texts]) == [fingerprints.fingerprints([b""])[0], *whole]


def test_edited_texts(spark, documents, odd_documents, no_documents, base_texts, tmp_path):
    def query(df, name):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return fingerprints.op5_fingerprints(spark, f"{tmp_path}/{name}").collect()

    for r in query(documents, "a"):
        text, after = base_texts[r.doc_id] or "", base_texts[(r.doc_id - 1) % len(base_texts)] or ""
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(fingerprints.edited(text, after).encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(query(odd_documents, "b")) == odd_documents.count()
    assert query(no_documents, "c") == []


def test_archives(spark):
    texts = ["<p>a</p>", None, "", "<p>a</p>", "é" * 500, "<p>b</p>\r\n\r\nx", "<p>a</p>", "x" * 2_000_000]
    pages = spark.createDataFrame([(i, None if i == 4 else f"http://e/{i}", t, "clash", 1) for i, t in enumerate(texts)] + [(None, "u", "<p>a</p>", "c", 2)], "page_id long, url string, html string, digest string, part int")
    got = {r.page_id: r for r in warc.read_warc(warc.write_warc(pages, fresh_dir(spark, "w"), 3), with_payload=True).collect()}
    first = {}
    for i, t in enumerate(texts):
        first[t or ""] = i
    for i, t in enumerate(texts):
        data, r = (t or "").encode(), got[i]
        role = ("response", None) if first[t or ""] == i else ("revisit", first[t or ""])
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *role)
        assert r.record_type == "revisit" or bytes(r.payload) == data
    assert got[None].record_type == "response" and len(got) == 9
    assert warc.read_warc(warc.write_warc(pages.limit(0), fresh_dir(spark, "w"), 2)).count() == 0
