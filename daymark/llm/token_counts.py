"""Token counts that follow edits.

A document is a balanced binary tree whose leaves are runs of whole pre-tokens, or one long pre-token with its ids;
each node has the sums of characters and tokens below it. An edit cuts the leaves that it touches out of the tree,
splits them into pre-tokens again together with as much beside them as the split pattern can look at, and joins the
new leaves in between, which changes one path of sums. Of a long pre-token only the bytes at the seams of the edit are
encoded again, by the growing windows that join neighbours in byte-level BPE; its other ids stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .byte_bpe import ByteBpe, codec, vocabulary
from .common import WHITE, keep_text, mapped, table

LEAF_CHUNKS, LEAF_CHARS = 16, 128
#: Pre-tokens of more characters are leaves of their own that keep their ids.
LONG = 256
#: A match of the split pattern depends on the white space after it and on this many characters at most.
LOOK = 4


class Leaf(NamedTuple):
    chars: int
    tokens: int
    height: int
    text: str
    ids: list[int] | None


class Node(NamedTuple):
    chars: int
    tokens: int
    height: int
    left: Node | Leaf
    right: Node | Leaf


def node(left, right) -> Node:
    return Node(left.chars + right.chars, left.tokens + right.tokens, 1 + max(left.height, right.height), left, right)


def balanced(left, right) -> Node:
    """A node over two trees whose heights differ by two at most, rotated where they do."""
    if left.height > right.height + 1:
        a, b = left.left, left.right
        return node(a, node(b, right)) if a.height >= b.height else node(node(a, b.left), node(b.right, right))
    if right.height > left.height + 1:
        a, b = right.left, right.right
        return node(node(left, a), b) if b.height >= a.height else node(node(left, a.left), node(a.right, b))
    return node(left, right)


def joined(left, right):
    """One balanced tree of two."""
    if left is None or right is None:
        return left or right
    if left.height > right.height + 1:
        return balanced(left.left, joined(left.right, right))
    if right.height > left.height + 1:
        return balanced(joined(left, right.left), right.right)
    return node(left, right)


def tree(leaves: list[Leaf]):
    if len(leaves) < 2:
        return leaves[0] if leaves else None
    half = len(leaves) // 2
    return node(tree(leaves[:half]), tree(leaves[half:]))


def cut(own, place: int):
    """(tree before the leaf, the leaf that holds a place, the place in it, tree after the leaf); the last leaf for the end."""
    if isinstance(own, Leaf):
        return None, own, place, None
    if place < own.left.chars:
        before, leaf, at, after = cut(own.left, place)
        return before, leaf, at, joined(after, own.right)
    before, leaf, at, after = cut(own.right, place - own.left.chars)
    return joined(own.left, before), leaf, at, after


def leaves_of(own) -> Iterator[Leaf]:
    if isinstance(own, Leaf):
        yield own
    elif own:
        yield from leaves_of(own.left)
        yield from leaves_of(own.right)


def seen_through(text: str) -> bool:
    """Whether no match that ends before this text depends on what follows it."""
    return len(text) >= LOOK and bool(text.strip(WHITE))


class CountedText:
    """A text with its token count; edit() changes both. encoded_bytes counts what was encoded since it was set to 0."""

    def __init__(self, text: str, bpe: ByteBpe):
        self.bpe, self.encoded_bytes = bpe, 0
        self.root = tree(self.whole(text))

    def whole(self, text: str) -> list[Leaf]:
        chunks, out, ids = self.bpe.chunks(text), [], self.bpe.chunk
        for i in range(0, len(chunks), LEAF_CHUNKS):
            run = chunks[i : i + LEAF_CHUNKS]
            own = "".join(run)
            if max(map(len, run)) > LONG:
                out += self.grouped(self.bpe.pattern.findall(own), [])
            else:
                out.append(Leaf(len(own), sum([len(ids[c]) for c in run]) // 4, 0, own, None))
        return out

    @property
    def n_tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def n_chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def text(self) -> str:
        return "".join(leaf.text for leaf in leaves_of(self.root))

    def grouped(self, pieces: list[str], parts: list[tuple[str, Leaf | None, int]]) -> list[Leaf]:
        """Leaves over pre-tokens that follow each other; parts says what of their text stood in which leaf before."""
        out, held, size, tokens, at = [], [], 0, 0, 0
        for piece in [*pieces, None]:
            if held and (piece is None or len(piece) > LONG or size >= LEAF_CHARS):
                out.append(Leaf(size, tokens, 0, "".join(held), None))
                held, size, tokens = [], 0, 0
            if piece is None:
                break
            if len(piece) > LONG:
                ids = self.long_ids(piece, at, parts)
                out.append(Leaf(len(piece), len(ids), 0, piece, ids))
            else:
                held.append(piece)
                size += len(piece)
                tokens += len(self.bpe.piece[piece]) // 4
                self.encoded_bytes += len(piece.encode())
            at += len(piece)
        return out

    def long_ids(self, piece: str, at: int, parts: list[tuple[str, Leaf | None, int]]) -> list[int]:
        """The ids of a long pre-token that starts at `at` of the parts: tokens of its old leaves that lie in it whole
        stay, what is between them is encoded, and neighbours are joined."""
        data, out, done, start = piece.encode(), [], 0, 0

        def add(ids: list[int]) -> list[int]:
            before = self.bpe.rejoined
            both = self.bpe.joined(out, ids) if out and ids else out or ids
            self.encoded_bytes += self.bpe.rejoined - before
            return both

        def encoded(gap: bytes) -> list[int]:
            self.encoded_bytes += len(gap)
            return self.bpe.reduced(gap) if gap else []

        for text, leaf, skipped in parts:
            lo, hi = max(start, at), min(start + len(text), at + len(piece))
            if leaf and leaf.ids and hi > lo:
                begin = len(leaf.text[: skipped + lo - start].encode())
                end = begin + len(text[lo - start : hi - start].encode())
                ends = np.cumsum([len(self.bpe.bytes_of[i]) for i in leaf.ids])
                starts = np.concatenate([[0], ends[:-1]])
                first, last = int(np.searchsorted(starts, begin)), int(np.searchsorted(ends, end, "right"))
                if last > first:
                    moved = len(piece[: lo - at].encode()) - begin
                    out = add(encoded(data[done : moved + int(starts[first])]))
                    out, done = add(leaf.ids[first:last]), moved + int(ends[last - 1])
            start += len(text)
        return add(encoded(data[done:]))

    def edit(self, place: int, removed: int, inserted: str) -> None:
        """Replace `removed` characters from `place` on; both are clipped to the text."""
        place = max(0, min(place, self.n_chars))
        removed = max(0, min(removed, self.n_chars - place))
        if self.root is None:
            self.encoded_bytes += len(inserted.encode())
            self.root = tree(self.whole(inserted))
            return
        left, first, at, right = cut(self.root, place)
        last, end = first, at + removed
        if end > first.chars:
            _, last, end, right = cut(right, end - first.chars)
        head = first.text[:at]
        parts = [(head, first, 0), (inserted, None, 0), (last.text[end:], last, end)]
        while left and not seen_through(head):
            left, leaf, _, _ = cut(left, left.chars)
            parts.insert(0, (leaf.text, leaf, 0))
            head = leaf.text + head
        more = 1
        while True:
            region, ahead, rest = "".join([text for text, _, _ in parts]), "", right
            while rest and not seen_through(ahead):
                _, leaf, _, rest = cut(rest, 0)
                ahead += leaf.text
            pieces, size = [], 0
            for m in self.bpe.pattern.finditer(region + ahead):
                if size >= len(region):
                    break
                pieces.append(m.group())
                size = m.end()
            if size == len(region) or right is None:
                break
            for _ in range(more):  # a match goes over the end of the last leaf: take in the next ones
                if right:
                    _, leaf, _, right = cut(right, 0)
                    parts.append((leaf.text, leaf, 0))
            more *= 2
        self.root = joined(joined(left, tree(self.grouped(pieces, parts))), right)


def example_edits(text: str) -> list[tuple[int, int, str]]:
    """(place, removed, inserted): a deletion at a quarter, an insertion in the middle, a replacement at three quarters."""
    n = len(text)
    return [(n // 4, 7, ""), (n // 2, 0, text[:12]), (3 * n // 4, 5, text[-5:])]


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    for place, removed, inserted in edits:
        place = max(0, min(place, len(text)))
        text = text[:place] + inserted + text[place + max(0, removed) :]
    return text


def count_edits(docs: DataFrame, edits=example_edits, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_edits, edited_tokens, edited_chars, encoded_again): counts before and after a list of edits.

    edits: a function from a text to (place, removed, inserted), applied one after the other. encoded_again is the
    number of bytes that the edits made to be encoded, windows at seams included. A null
    text is empty; repeated rows stay; other columns go. A task holds one text at a time, of any length.
    """
    path = path or vocabulary()

    def run(batches):
        bpe = codec(path)
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                own = CountedText(text, bpe)
                before, own.encoded_bytes = own.n_tokens, 0
                todo = edits(text)
                for e in todo:
                    own.edit(*e)
                out.append((before, len(todo), own.n_tokens, own.n_chars, own.encoded_bytes))
            yield b.column("doc_id"), *map(list, zip(*out, strict=True))

    return mapped(keep_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, n_edits int, edited_tokens long, edited_chars long, encoded_again long")


def op6_token_counts(spark, sf_dir):
    return count_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6_token_counts}
