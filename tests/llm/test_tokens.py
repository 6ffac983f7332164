"""Operators 1, 6 and 8 against the tokenizers' own libraries."""

import hashlib
import random
import zlib
from sys import getsizeof

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from daymark.llm import byte_bpe, token_counts, token_files
from daymark.llm.common import fresh_dir, range_cuts

BPE = byte_bpe.codec(byte_bpe.vocabulary())
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
PIECES = ["a", "b", " ", "  ", "\n", "é", "'s", "'ll", "the", "ing", "1", "!!", "　", "\x1c", "😀", "日本", "A", "aaaa", "'", "l"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(PIECES), max_size=60).map("".join)))
def test_encoding_is_the_librarys(text):
    ids = np.frombuffer(BPE.encode(text), "<u4")
    assert ids.tolist() == REFERENCE.encode_ordinary(text)
    assert BPE.decode(ids) == text.encode()


def test_long_pre_tokens_and_small_leaves(monkeypatch):
    rng = random.Random(1)
    for _ in range(60):
        piece = "".join(rng.choice("abcdeionsth") for _ in range(rng.randint(50, 900)))
        assert np.frombuffer(BPE.encode(piece), "<u4").tolist() == REFERENCE.encode_ordinary(piece)
    monkeypatch.setattr(byte_bpe, "LEAF_CHARS", 7)
    monkeypatch.setattr(byte_bpe, "LEAF_IDS", 5)
    for _ in range(200):
        text = "".join(rng.choice(PIECES) for _ in range(60))
        ids = np.frombuffer(BPE.encode(text), "<u4")
        assert ids.tolist() == REFERENCE.encode_ordinary(text) and BPE.decode(ids) == text.encode()


def test_encode_and_decode_tables(documents, odd_documents, no_documents, base_texts):
    got = {r.doc_id: r for r in byte_bpe.bpe_decode(byte_bpe.bpe_encode(documents)).collect()}
    for i, t in enumerate(base_texts):
        ids = np.array(REFERENCE.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, bytes(got[i].token_ids), bytes(got[i].decoded)) == (len(ids), ids.tobytes(), (t or "").encode())
    assert byte_bpe.bpe_encode(odd_documents).count() == odd_documents.count()
    assert byte_bpe.bpe_encode(no_documents).count() == 0


def height_bound(own):
    """A tree whose neighbours differ in height by one at most is this high at most."""
    if isinstance(own, token_counts.Leaf) or own is None:
        return
    assert abs(own.left.height - own.right.height) <= 1 and own.height == 1 + max(own.left.height, own.right.height)
    height_bound(own.left)
    height_bound(own.right)


@pytest.mark.parametrize("long", [6, 30, 256])
def test_counts_follow_edits(monkeypatch, long):
    monkeypatch.setattr(token_counts, "LONG", long)
    rng = random.Random(long)
    for n in range(150):
        pieces = [PIECES, ["日", "本", "字", "é", "a", "th", "in"], ["1", "2", "a", " "], [" ", "\n", "a"]][n % 4]
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 400)))
        own = token_counts.CountedText(text, BPE)
        for _ in range(8):
            e = (rng.randint(0, len(text) + 2), rng.choice([0, 1, 5, 20, 120]), "".join(rng.choice(PIECES if rng.random() < 0.5 else pieces) for _ in range(rng.choice([0, 1, 5, 60]))))
            own.edit(*e)
            text = token_counts.edited(text, [e])
            assert own.text == text and own.n_chars == len(text) and own.n_tokens == len(REFERENCE.encode_ordinary(text))
            height_bound(own.root)
            for leaf in token_counts.leaves_of(own.root):
                assert leaf.ids is None or leaf.ids == REFERENCE.encode_ordinary(leaf.text)


@pytest.mark.parametrize("letters", ["天地玄黄宇宙洪荒日月盈昃辰宿列张", "abcdefgh", "天地玄黄，宇宙洪荒。", "ab cd efg "])
def test_an_edit_encodes_a_few_hundred_bytes(letters):
    rng = random.Random(5)
    text = "".join(rng.choice(letters) for _ in range(60_000))
    own = token_counts.CountedText(text, BPE)
    for e in [(20_000, 1, "黄"), (30_000, 0, "b"), (40_000, 3, ""), (50, 1, ""), (59_990, 2, "a")]:
        own.encoded_bytes = 0
        own.edit(*e)
        text = token_counts.edited(text, [e])
        assert own.n_tokens == len(REFERENCE.encode_ordinary(text)) and own.encoded_bytes < 1000


def test_count_edits_table(documents, odd_documents, no_documents, base_texts):
    for r in token_counts.count_edits(documents).collect():
        text = base_texts[r.doc_id] or ""
        after = token_counts.edited(text, token_counts.example_edits(text))
        assert (r.n_tokens, r.edited_tokens, r.edited_chars) == (len(REFERENCE.encode_ordinary(text)), len(REFERENCE.encode_ordinary(after)), len(after))
        assert len(text) < 20_000 or r.encoded_again < len(text) / 10
    assert token_counts.count_edits(odd_documents).count() == odd_documents.count()
    assert token_counts.count_edits(no_documents).count() == 0


LIBRARY = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
LIBRARY.encode_special_tokens = True


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from([*PIECES, "É", "ß", "²", "_", "Σ", "İ", "<|endoftext|>", "’"]), max_size=40).map("".join)))
def test_chunks_encode_as_the_library_does(text):
    enc = token_files.encoder(public_tokenizers.path(token_files.VOCABULARY))
    assert np.frombuffer(enc.encode(text), "<u2").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


DEFAULT = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "É", "ß", "İ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "’", "\u0301"]), max_size=40).map("".join))
def test_added_tokens_encode_as_the_librarys_default(text):
    enc = token_files.encoder(public_tokenizers.path(token_files.VOCABULARY), True)
    assert np.frombuffer(enc.encode(text), "<u2").tolist() == DEFAULT.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_tables(spark):
    text = "ab <|endoftext|> c<|startoftext|>d"
    (row,) = token_files.encode_ids(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert np.frombuffer(row.ids, "<u2").tolist() == [*DEFAULT.encode(text, add_special_tokens=False).ids, 1]


def test_token_files_round_trip(spark, documents, odd_documents, no_documents, base_texts):
    def through(docs):
        return token_files.read_token_files(token_files.write_token_files(token_files.encode_ids(docs), fresh_dir(spark, "t"), range_cuts(docs, "doc_id", 3))).collect()

    start = 0
    for r, (i, t) in zip(sorted(through(documents)), enumerate(base_texts), strict=True):
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, bytes(r.ids)) == (i, start, ids.tobytes())
        start += len(ids)
    assert sorted(r.doc_id is None for r in through(odd_documents)) == [False] * 9 + [True] * 4
    assert through(no_documents) == []


def test_frames_are_checked_and_read_alone(tmp_path):
    path = str(tmp_path / "x.zst")
    docs = [(i, bytes([i % 250, 0]) * (i + 1)) for i in range(300)]
    with open(path, "wb") as f:
        assert token_files.write_file(f, docs, 2, frame_bytes=4000) == (300, sum(i + 1 for i in range(300)))
    reader = token_files.Reader(path)
    opened = []
    reader.frame = lambda i, f=reader.frame: opened.append(i) or f(i)
    assert [(d, x) for d, _, x in reader.documents({7, 290})] == [docs[7], docs[290]] and len(opened) == 2
    data = bytearray(open(path, "rb").read())
    data[20] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017
        token_files.Reader(path).frame(0)
    assert zlib.crc32(b"") == 0 and hashlib.sha256(b"").hexdigest()


def test_memo_is_bounded_in_entries_and_bytes():
    held = byte_bpe.Memo(lambda x: x + x, most=50, most_bytes=20_000)
    most = 0
    for i in range(3000):
        key = f"{i % 70}" * (1 + i % 40)
        assert held[key] == key + key
        own = sum(len(k) + len(v) for k, v in held.items())
        assert len(held) <= 50 and own <= held.bytes <= 20_000
        most = max(most, own)
    assert most > 1000
    assert held["y" * 30_000] == "y" * 60_000 and not held and held["z"] == "zz" and len(held) == 1


def test_long_chunks_do_not_fill_a_worker():
    encoder, rng = byte_bpe.ByteBpe(public_tokenizers.path(byte_bpe.VOCABULARY)), random.Random(3)
    for _ in range(3000):
        encoder.chunk["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(200))]
    held = [sum(getsizeof(k) + getsizeof(v) for k, v in m.items()) for m in (encoder.chunk, encoder.piece)]
    assert all(0 < h <= m.bytes <= byte_bpe.MEMO_BYTES for h, m in zip(held, (encoder.chunk, encoder.piece), strict=True))
