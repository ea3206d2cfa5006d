"""Token counts by a map-side two-tier lookup.

Texts are cut into chunks that no pre-token crosses.  The first tier is a broadcast
table of the corpus's frequent chunks and their token lengths; what it lacks is
encoded by the tokenizer's library and kept in a bounded cache of the worker.  No
pre-token is shuffled: the frequent chunks come from one fixed-size summary per
task, merged in groups, so that neither a task nor the driver holds more than
`table` entries times a group.

Summaries are Misra-Gries counters (mergeable: Agarwal et al., 2012) over all
documents, so every chunk that makes up more than 1/(table+1) of the corpus is in
the table.  The table decides speed alone, never a count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import MIX, mix, pack, unpack
from quern.llm.pieces import LINE, PLAIN, chunk_places, encode, load
from quern.llm.shingles import parts, run_hashes

TABLE = 32_768
CACHE = 1_200_000
LONGEST = 48
GROUP = 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
#: Where a byte-level pre-tokenizer always starts anew: at a single space between two characters that are surely not white space.
_NOT = r"[^\s\x1c-\x1f\x85\u180e\u200b-\u200f\ufeff]"
CUT = re.compile(f"(?<={_NOT}) (?={_NOT})")
#: White space other than single spaces and line feeds, what a library might take for it, and the mark used below.
ODD = re.compile(r"[^\S \n]|[\x00\x1c-\x1f\x85\u180e\u200b-\u200f\ufeff]")
SPACE = re.compile(r"\s")
CHUNK = 1 << 22
_tables: dict[str, tuple[dict, dict]] = {}
_misses: dict[str, tuple[dict, dict]] = {}


def simple(text: str, special: list[str]) -> bool:
    """Whether the text's white space is single spaces and line feeds between other characters, and it holds no special string."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
        return False
    return not ODD.search(text) and not any(s in text for s in special)


def chunks(text: str, special: list[str]) -> list[str]:
    """A text that isn't simple in pieces that are tokenized alike alone and together.

    It is cut at single spaces, which each following piece's pre-token takes along; with
    a special string, not at all.
    """
    if any(s in text for s in special):
        return [text]
    first, *rest = CUT.split(text)
    return [first, *[" " + w for w in rest]]


class Runs:
    """The chunks of simple texts, by 64-bit hash: runs between white space, with the space before them, and stops between letters and white space.

    Line feeds are chunks too, which `feeds` counts by text.
    """

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.whole = b"\n".join([*raw, b""])
        b = np.frombuffer(self.whole, np.uint8)
        self.start, self.end = chunk_places(b)
        self.spaced = (self.start > 0) & (b[np.maximum(self.start - 1, 0)] == 32)
        h = run_hashes(b, self.start, self.end)
        h[self.spaced] = mix(h[self.spaced] ^ MIX)
        self.keys, self.first, self.back, self.counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        self.bytes = [len(r) for r in raw]
        self.feeds = np.array([t.count("\n") for t in texts])
        self.cut = np.searchsorted(self.start, np.cumsum([n + 1 for n in self.bytes]))

    def string(self, i: int) -> str:
        """The chunk of the i-th distinct key."""
        j = self.first[i]
        return (" " if self.spaced[j] else "") + self.whole[self.start[j] : self.end[j]].decode()

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Sums by text of a value for each distinct key."""
        return np.diff(np.concatenate([[0], np.cumsum(values[self.back])])[self.cut], prepend=0)


def key_of(chunks: list[str]) -> list[int]:
    """The keys of chunks that hold no white space but a space before them."""
    raw = [c.removeprefix(" ").encode() for c in chunks]
    sizes = np.array([len(r) for r in raw], np.int64)
    start = np.cumsum(sizes) - sizes
    h = run_hashes(np.frombuffer(b"".join(raw), np.uint8), start, start + sizes)
    spaced = np.array([c[:1] == " " for c in chunks], bool)
    h[spaced] = mix(h[spaced] ^ MIX)
    return h.tolist()


def prune(c: Counter, k: int) -> Counter:
    """The Misra-Gries cut to at most k entries: the (k+1)st count is taken from all."""
    if len(c) <= k:
        return c
    cut = sorted(c.values(), reverse=True)[k]
    return Counter({w: n - cut for w, n in c.items() if n > cut})


def fit(c: Counter) -> Counter:
    """The entries that a table takes."""
    return Counter({w: n for w, n in c.items() if len(w) <= LONGEST and "\0" not in w})


def _dump(c: Counter) -> bytes:
    words = pa.array(list(c), pa.string())
    t = pa.table({"w": words, "n": pa.array(c.values(), pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _undump(blob: bytes) -> Counter:
    t = pa.ipc.open_stream(blob).read_all()
    return Counter(dict(zip(t["w"].to_pylist(), t["n"].to_pylist(), strict=True)))


def summary(texts, cut: Callable[[str], list[str]], table: int) -> Counter:
    """A Misra-Gries summary of what `cut` makes of the texts."""
    total: Counter = Counter()
    for t in texts:
        if t:
            total.update(cut(t))
        if len(total) > 16 * table:
            total = prune(fit(total), 4 * table)
    return prune(fit(total), table)


def chunk_summary(texts, special: list[str], table: int) -> Counter:
    """A Misra-Gries summary of the texts' chunks; those of simple texts are counted by their hashes."""
    k, n, names, odd = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}, Counter()
    held, size = [], 0

    def add():
        nonlocal k, n, names
        r = Runs(held)
        both = np.concatenate([k, r.keys])
        u, back = np.unique(both, return_inverse=True)
        c = np.bincount(back, np.concatenate([n, r.counts]), len(u)).astype(np.int64)
        if len(u) > 4 * table:
            least = np.partition(c, -4 * table - 1)[-4 * table - 1]
            u, c = u[c > least], c[c > least] - least
        at = np.minimum(np.searchsorted(r.keys, u), max(len(r.keys) - 1, 0))
        names = {x: names.get(x) or r.string(i) for x, i in zip(u.tolist(), at.tolist(), strict=True)}
        k, n = u, c

    for t in texts:
        if not t:
            continue
        if simple(t, special):
            held.append(t)
            size += len(t)
            if size >= CHUNK:
                add()
                held, size = [], 0
        else:
            odd.update(chunks(t, special))
            if len(odd) > 16 * table:
                odd = prune(fit(odd), 4 * table)
    if held:
        add()
    return prune(fit(odd + Counter({names[x]: m for x, m in zip(k.tolist(), n.tolist(), strict=True)})), table)


def frequent(docs: DataFrame, summarised: Callable[[Iterator[str], int], Counter], table: int) -> Counter:
    """Counts (less at most 1/(table+1) of all) of the most frequent entries of the texts' summaries; at most `table` of them."""
    one = pa.schema([("g", pa.int64()), ("s", pa.binary())])

    def summarise(batches):
        total = summarised((t for b in batches for t in b.column(0).to_pylist()), table)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([_dump(total)], pa.binary())], schema=one)

    def merge(batches):
        total: Counter = Counter()
        g = 0
        for b in batches:
            for g0, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = g0
                total = prune(total + _undump(s), table)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([_dump(total)], pa.binary())], schema=one)

    level = docs.select("text").mapInArrow(summarise, "g long, s binary")
    n = docs.rdd.getNumPartitions()
    while True:  # as many rounds as groups of 64 need
        n = max(1, -(-n // GROUP))
        level = level.repartitionById(n, (F.col("g") % n).cast("int")).mapInArrow(merge, "g long, s binary")
        if n == 1:
            break
    total = Counter()
    for (s,) in level.select("s").collect():  # one row of at most `table` entries
        total = _undump(bytes(s))
    return total


def learn(tokenizer: str, new: set[str], known: dict[str, int]) -> None:
    """Token counts of new chunks.

    Plain letters after a space are one pre-token, so many of them are encoded as one
    string and told apart by the library's word numbers.  All others are encoded one by one.
    """
    t = load(tokenizer)
    plain = [w for w in new if w[:1] == " " and PLAIN.fullmatch(w, 1)]
    odd = list(new.difference(plain))
    for i in range(0, len(plain), 512 * LINE):
        some = plain[i : i + 512 * LINE]
        rows = [some[j : j + LINE] for j in range(0, len(some), LINE)]
        for row, e in zip(rows, t.encode_batch(["".join(r) for r in rows], add_special_tokens=False), strict=True):
            n = np.bincount(np.array(e.word_ids, np.int64))
            if len(n) == len(row):
                known.update(zip(row, n.tolist(), strict=True))
            else:
                odd += row
    for i in range(0, len(odd), 8192):
        some = odd[i : i + 8192]
        known.update(zip(some, map(len, t.encode_batch_fast(some, add_special_tokens=False)), strict=True))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, table: int = TABLE, cache: int = CACHE) -> DataFrame:
    """Per row of documents: doc_id, UTF-8 bytes, tokens, and whether they are more than `limit`.

    A null or empty text has no bytes and no tokens; repeated rows and null doc_ids keep
    their rows; an empty table gives none.  Special strings inside texts count as the
    library takes them by default.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    special = [t.content for t in load(tokenizer).get_added_tokens_decoder().values()]
    counts = frequent(docs, lambda texts, k: chunk_summary(texts, special, k), table)
    words = sorted(counts, key=lambda w: (-counts[w], w))
    lengths = []
    for lo in range(0, len(words), 4096):
        lengths += [len(x) for x in encode(tokenizer, words[lo : lo + 4096])]
    tiers = docs.sparkSession.sparkContext.broadcast((pack(np.frombuffer("\0".join(words).encode(), np.uint8)), np.array(lengths, np.uint8)))
    key = f"{tokenizer}|{id(tiers)}"

    feed = len(encode(tokenizer, ["\n"])[0])

    def task(batches):
        if key not in _tables:
            names, n = tiers.value
            names, n = unpack(names, np.uint8).tobytes().decode().split("\0"), n.tolist()
            runs = [i for i, w in enumerate(names) if w.strip() and not SPACE.search(w, 1)] if n else []
            _tables.clear()
            _tables[key] = dict(zip(names, n)), dict(zip(key_of([names[i] for i in runs]), [n[i] for i in runs], strict=True))
        (first, first_by_key), (miss, miss_by_key) = _tables[key], _misses.setdefault(tokenizer, ({}, {}))
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            sizes, counts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for lo, hi in parts(texts, CHUNK):
                plain = [i for i in range(lo, hi) if simple(texts[i], special)]
                if plain:
                    r = Runs([texts[i] for i in plain])
                    if len(miss_by_key) > cache:
                        miss_by_key.clear()
                    keys = r.keys.tolist()
                    found = list(map(first_by_key.get, keys))
                    rest = [i for i, n in enumerate(found) if n is None]
                    new = {keys[i]: r.string(i) for i in rest if keys[i] not in miss_by_key}
                    known: dict[str, int] = {}
                    learn(tokenizer, set(new.values()), known)
                    miss_by_key.update((k, known[w]) for k, w in new.items())
                    for i in rest:
                        found[i] = miss_by_key[keys[i]]
                    sizes[plain] = r.bytes
                    counts[plain] = r.totals(np.array(found, np.int64)) + feed * r.feeds
                for i in sorted(set(range(lo, hi)).difference(plain)):
                    words = chunks(texts[i], special)
                    if len(miss) > cache:
                        miss.clear()
                    new = set(words) - first.keys() - miss.keys()
                    learn(tokenizer, new, miss)
                    sizes[i] = len(texts[i].encode())
                    counts[i] = sum(first[w] if w in first else miss[w] for w in words)
                    for w in new:
                        if len(w) > LONGEST:
                            del miss[w]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], schema=ARROW)

    return docs.mapInArrow(task, SCHEMA)
