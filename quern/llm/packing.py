"""Cost-balanced packing of documents into sequences of a fixed token length.

A piece of n tokens costs linear * n + quadratic * n * n (attention stays inside a
document).  Inside one window of the input, documents are cut at `length`, the
pieces are taken in descending order, and each goes to the sequence of lowest cost
so far among those with room for it; a piece that fits nowhere whole is cut over
the sequences with room.  A window's token count decides its sequences: as many
full ones as go into it, and for the rest one sequence per power of two, so that
nothing is padded.

Windows are streams of whole documents of at least `window` tokens, held by one
task; there is no shuffle, memory is a window and the longest document, and a task
that runs again gives the same pieces.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import kept, trim
from quern.llm.pieces import ChunkIds
from quern.llm.shingles import parts

LENGTH = 4096
WINDOW = 1 << 20
CHUNKS = 300_000  # that a worker keeps
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
ARROW = pa.schema([(name, pa.int64()) for name in [f.split()[0] for f in SCHEMA.split(", ")]])


def capacities(total: int, length: int) -> list[int]:
    """Full sequences, then the binary digits of what is left."""
    full, rest = divmod(total, length)
    return [length] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(sizes: list[int], length: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a window; every capacity is filled exactly."""
    room = capacities(sum(sizes), length)
    size = list(room)
    pieces = sorted(((min(length, n - s), d, s) for d, n in enumerate(sizes) for s in range(0, n, length)), key=lambda p: (-p[0], p[1], p[2]))
    cost = lambda n: linear * n + quadratic * n * n
    heap = [(0.0, i) for i in range(len(room))]  # sequences by cost
    placed, late = [], []
    aside: list[tuple[int, float, int]] = []  # those that had no room for a piece, by room, most first

    def put(d: int, s: int, n: int, i: int) -> None:
        placed.append((d, s, n, i, size[i] - room[i]))
        room[i] -= n

    for n, d, s in pieces:
        while aside and -aside[0][0] >= n:  # pieces get smaller: there is room again
            _, c, i = heapq.heappop(aside)
            heapq.heappush(heap, (c, i))
        while heap:
            c, i = heapq.heappop(heap)
            if room[i] >= n:
                put(d, s, n, i)
                if room[i]:
                    heapq.heappush(heap, (c + cost(n), i))
                break
            heapq.heappush(aside, (-room[i], c, i))
        else:
            late.append((n, d, s))
    open_ = sorted((i for i in range(len(room)) if room[i]), key=lambda i: (-room[i], i))
    for n, d, s in late:  # what is left is cut over the largest rooms
        while n:
            i = open_[0]
            take = min(n, room[i])
            put(d, s, take, i)
            n, s = n - take, s + take
            if not room[i]:
                open_.pop(0)
    return placed


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, window: int = WINDOW, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> DataFrame:
    """One row per piece of every document's ids (with `end_id` after them); see the module's text.

    A null or empty text is its end id alone; repeated rows are packed as documents of
    their own; rows without a doc_id are packed under a null doc_id; an empty table gives
    no rows.  `length` is a power of two.
    """
    if length & (length - 1) or length <= 0:
        raise ValueError("length is a power of two")

    def task(batches):
        trim(("ids", tokenizer))
        ids_of = kept(("ids", tokenizer), lambda: ChunkIds(tokenizer, CHUNKS))
        base = TaskContext.get().partitionId() << 36
        end = np.array([end_id], np.uint32)
        keys, held, n, used = [], [], 0, 0

        def flush():
            nonlocal keys, held, n, used
            sizes = [len(ids) for ids in held]
            raw = [memoryview(ids.astype("<u4", copy=False)).cast("B") for ids in held]
            cols = [[] for _ in ARROW]
            out = assign(sizes, length, linear, quadratic)
            caps = capacities(n, length)
            for d, s, m, i, at in out:
                row = (keys[d], s, m, zlib.crc32(raw[d][4 * s : 4 * (s + m)]), sizes[d], base + used + i, at, caps[i])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            used += len(caps)
            keys, held, n = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=ARROW)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in parts(texts, 1 << 21):
                for k, ids in zip(names[lo:hi], ids_of([t or "" for t in texts[lo:hi]]), strict=True):
                    held.append(np.concatenate([ids, end]))
                    keys.append(k)
                    n += len(held[-1])
                    if n >= window:
                        yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, SCHEMA)
