"""Benchmark decontamination by greedy string tiling.

A document and a test item are a candidate pair if they share a run of `least` words.
For a pair whose shared runs could cover enough of the item, greedy string tiling
finds the longest common runs of words that overlap no longer one, in any order, by
running Karp-Rabin matching at falling lengths (Wise, 1993).  A document is
contaminated by an item if its tiles cover `threshold` of the item's words, so that
passages moved about still count.

Documents are never shuffled: the items, in blocks of bounded size, go to them.  Each
block is a broadcast of at most `most` words; more blocks are more passes.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common as C
from quern.llm.shingles import word_hashes, words_of

LEAST = 5
THRESHOLD = 0.5
MOST = 1_000_000
PAIRS = "doc_id long, item_id long, coverage double, tiles int, matched int, item_words int"
ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("matched", pa.int32()), ("item_words", pa.int32())])
SIEVE = 20


def powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = C.MIX
    return np.cumprod(out, dtype=np.uint64)


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n words, each from the one before (mod 2^64)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    if n <= 8:
        for j in range(n):
            h = h * C.MIX + words[j : len(h) + j]
        return h
    base, w = int(C.MIX), [int(x) for x in words]
    top, mask = pow(base, n - 1, 1 << 64), (1 << 64) - 1
    x = 0
    for v in w[:n]:
        x = (x * base + v) & mask
    out = [x]
    for gone, new in zip(w, w[n:]):
        x = ((x - gone * top) * base + new) & mask
        out.append(x)
    return np.array(out, np.uint64)


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of the tiles of two word sequences, longest first."""
    a, b = item.tolist(), text.tolist()
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    found = []
    size = max(least, min(len(a), len(b)))

    def runs(free: np.ndarray, n: int) -> np.ndarray:
        """Starts of n free words."""
        if len(free) < n:
            return np.zeros(0, np.int64)
        c = np.concatenate([[0], np.cumsum(free)])
        return np.flatnonzero(c[n:] - c[:-n] == n)

    while size >= least:
        by_hash = defaultdict(list)
        h = rolling(text, size)
        for t in runs(free_b, size).tolist():
            by_hash[int(h[t])].append(t)
        h = rolling(item, size)
        waiting: dict[int, list] = defaultdict(list)
        longest = 0
        for p in runs(free_a, size).tolist() if by_hash else ():
            for t in by_hash.get(int(h[p]), ()):
                n = 0
                while p + n < len(a) and t + n < len(b) and a[p + n] == b[t + n] and free_a[p + n] and free_b[t + n]:
                    n += 1
                if n >= size:
                    waiting[n].append((p, t))
                    longest = max(longest, n)
            if longest > 2 * size:
                break
        if longest > 2 * size:
            size = longest
            continue
        while waiting:
            n = max(waiting)
            for p, t in waiting.pop(n):
                whole_a, whole_b = free_a[p : p + n], free_b[t : t + n]
                if whole_a.all() and whole_b.all():
                    free_a[p : p + n] = free_b[t : t + n] = False
                    found.append((p, t, n))
                    continue
                both = whole_a & whole_b  # what a longer tile has left of it
                rest = int(both.argmin()) if both[0] else 0
                if rest >= size:
                    waiting[rest].append((p, t))
        if size == least:
            break
        size = size // 2 if size > 2 * least else least
    return sorted(found, key=lambda m: -m[2])


class Items:
    """A block of items: their words, and their runs of `least` words by hash."""

    def __init__(self, ids: list, words: list[np.ndarray], least: int):
        self.ids, self.words, self.least = ids, words, least
        runs = [rolling(w, least) for w in words]
        h = np.concatenate([*runs, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(words)), [len(r) for r in runs])
        at = np.concatenate([*(np.arange(len(r)) for r in runs), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.owner, self.at = owner[order], at[order]
        self.hashes, self.first = np.unique(h[order], return_index=True)
        self.last = np.append(self.first[1:], len(h))
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[self.hashes >> np.uint64(64 - SIEVE)] = True

    def matches(self, doc: np.ndarray, threshold: float) -> list[tuple[int, float, int, int]]:
        """(item, coverage, tiles, matched words) of every item whose tiles cover enough of it."""
        h = rolling(doc, self.least)
        maybe = np.flatnonzero(self.sieve[h >> np.uint64(64 - SIEVE)])
        if not len(maybe) or not len(self.hashes):
            return []
        k = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        hit = self.hashes[k] == h[maybe]
        maybe, k = maybe[hit], k[hit]
        if not len(maybe):
            return []
        n = self.last[k] - self.first[k]
        post = C.ranges(self.first[k], n)
        item, at, pos = self.owner[post], self.at[post], np.repeat(maybe, n)
        out = []
        order = np.argsort(item, kind="stable")
        item, at, pos = item[order], at[order], pos[order]
        for i, lo, hi in zip(*np.unique(item, return_index=True), np.append(np.unique(item, return_index=True)[1][1:], len(item)), strict=True):
            words = self.words[i]
            covered = np.zeros(len(words) + 1, np.int64)
            np.add.at(covered, at[lo:hi], 1)
            np.add.at(covered, at[lo:hi] + self.least, -1)
            if (np.cumsum(covered[:-1]) > 0).sum() < threshold * len(words):
                continue  # no tiling can cover more
            keep = np.unique(pos[lo:hi, None] + np.arange(self.least))
            gap = np.flatnonzero(np.diff(keep) > 1) + 1
            text = np.insert(doc[keep], gap, 0)  # no word hashes to 0
            got = tiles(words, text, self.least)
            matched = sum(m for _, _, m in got)
            if matched >= threshold * len(words):
                out.append((int(i), matched / len(words), len(got), matched))
        return out


def item_blocks(benchmark: DataFrame, least: int, most: int):
    """Blocks of items of up to `most` words (a longer item is alone); those of under `least` words are left out."""
    ids, words, n = [], [], 0
    for i, t in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        w = word_hashes(t)
        if len(w) < least:
            continue
        if n and n + len(w) > most:
            yield ids, words
            ids, words, n = [], [], 0
        ids.append(i)
        words.append(w)
        n += len(w)
    if ids:
        yield ids, words


def _shared(spark, block):
    ids, words = block
    return spark.sparkContext.broadcast((ids, C.pack(np.concatenate(words)), [len(w) for w in words]))


def _open(b, least: int) -> Items:
    ids, flat, sizes = b.value
    return Items(ids, np.split(C.unpack(flat, np.uint64), np.cumsum(sizes)[:-1]), least)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per document and item whose tiles cover at least `threshold` of the item's words.

    Columns doc_id, item_id, coverage, tiles, matched, item_words.  Null and empty texts,
    and items of under `least` words, match nothing; repeated rows of documents or items
    give repeated rows; an empty table on either side gives none.
    """
    spark = docs.sparkSession
    out = None
    for block in item_blocks(benchmark, least, most):
        shared = _shared(spark, block)

        def task(batches, shared=shared):
            items = _open(shared, least)
            for b in batches:
                cols: list[list] = [[] for _ in ARROW]
                for d, w in zip(b.column(0).to_pylist(), words_of(b.column(1).to_pylist()), strict=True):
                    for i, share, n, matched in items.matches(w, threshold):
                        for c, v in zip(cols, (d, items.ids[i], share, n, matched, len(items.words[i])), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW, strict=True)], schema=ARROW)

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, PAIRS)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], PAIRS) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, most: int = MOST) -> DataFrame:
    """The rows of documents that no item contaminates; see contaminated()."""
    schema, place = docs.schema, docs.columns.index("text")
    for block in item_blocks(benchmark, least, most):
        shared = _shared(docs.sparkSession, block)

        def task(batches, shared=shared):
            items = _open(shared, least)
            for b in batches:
                yield b.filter(pa.array([not items.matches(w, threshold) for w in words_of(b.column(place).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(task, schema)
    return docs
