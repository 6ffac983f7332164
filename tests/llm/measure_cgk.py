"""What CGK embeddings with bit-sampling would find, without any gate before them: python -m tests.llm.measure_cgk

Items of the benchmark are edited at random; each item and its edited passage, begun at the same place, are embedded, and
so are unrelated windows of the same length. Printed is the share of embedded places that agree (p for passages, q for
unrelated windows, their means), and for bits b and repetitions L the recall over all passages and how many unrelated
windows collide with an item. Windows that don't begin where a passage does can only agree less.
"""

from __future__ import annotations

import random
import sys
import time

import duckdb
import numpy as np

FOLDER = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
rng = random.Random(1)


def edited(text: str, share: float) -> str:
    """As many random edits as a share of the characters: a third each of replaced, removed and added ones."""
    own = list(text)
    for _ in range(round(share * len(text))):
        kind, at = rng.randrange(3), rng.randrange(len(own))
        if kind == 0:
            own[at] = rng.choice("abcdefghijklmnopqrstuvwxyz ")
        elif kind == 1:
            del own[at]
        else:
            own.insert(at, rng.choice("abcdefghijklmnopqrstuvwxyz "))
    return "".join(own)


def typos(text: str) -> str:
    """One replaced character in each word."""
    words = text.split(" ")
    return " ".join(w if not w else w[: (i := rng.randrange(len(w)))] + rng.choice("abcdefghijklmnopqrstuvwxyz") + w[i + 1 :] for w in words)


def embedded(texts: list[str], length: int, seed: int) -> np.ndarray:
    """The walk of each text: at each of `length` steps the present byte, which a random bit a step and byte then passes."""
    data = np.zeros((len(texts), length + 1), np.uint8)
    for i, t in enumerate(texts):
        own = np.frombuffer(t.encode()[:length], np.uint8)
        data[i, : len(own)] = own
    bits = np.random.default_rng(seed).integers(0, 2, (length, 256)).astype(np.int64)
    at, rows, out = np.zeros(len(texts), np.int64), np.arange(len(texts)), np.zeros((len(texts), length), np.uint8)
    for step in range(length):
        out[:, step] = data[rows, np.minimum(at, length)]
        at += bits[step, out[:, step]]
    return out


def main() -> None:
    con = duckdb.connect()
    items = [t.lower() for (t,) in con.execute(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    texts = [t.lower() for (t,) in con.execute(f"SELECT text FROM '{FOLDER}/documents.parquet' WHERE length(text) > 2000 LIMIT 200").fetchall()]
    windows = [(t := rng.choice(texts))[(a := rng.randrange(len(t) - 400)) : a + 300] for _ in items]
    length = 3 * max(map(len, items))
    began = time.thread_time()
    embedded(items, length, 0)
    seconds = (time.thread_time() - began) / len(items)
    print(f"{seconds * 1e6:.0f} microseconds to embed one window once")
    kinds = {**{f"{s:.0%} edits": [edited(t, s) for t in items] for s in (0.1, 0.15, 0.18, 0.2)}, "a typo a word": [typos(t) for t in items]}
    seeds = range(8)
    own = {s: embedded(items, length, s) for s in seeds}
    short = np.array([3 * len(t) for t in items])
    mask = np.arange(length)[None, :] < short[:, None]
    agree = lambda a, b: ((a == b) & mask & (a > 0)).sum(1) / ((a > 0) | (b > 0)).sum(1)
    q = np.array([agree(own[s], embedded(windows, length, s)) for s in seeds])
    for name, passages in kinds.items():
        p = np.array([agree(own[s], embedded(passages, length, s)) for s in seeds])
        print(f"{name}: p {p.mean():.3f}, q {q.mean():.3f}")
        for b in (4, 8, 12, 16):
            for n in (8, 32, 128):
                # n repetitions, an eighth of them in each walk
                missed = np.prod((1 - p**b) ** (n / len(seeds)), axis=0).mean()
                wrong = 1 - np.prod((1 - q**b) ** (n / len(seeds)), axis=0).mean()
                print(f"  b {b}, L {n}: recall {1 - missed:.3f}, unrelated windows that collide with an item {wrong:.2e}")


if __name__ == "__main__":
    main()
