"""Exact token ids through a cache of chunks.

A text is cut where the tokenizer can never join what stands on both sides, each
distinct chunk is encoded once by the tokenizer's own library, and the results
are kept in a bounded cache of the worker.  Encoding chunk by chunk is then exact.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np

from quern.llm.common import ranges
from quern.llm.shingles import parts, run_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer of a .json file, without truncation or padding; one per worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def load_spec(spec: dict):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(json.dumps(spec))
    t.no_truncation()
    t.no_padding()
    return t


def encode(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in load(path).encode_batch_fast(texts, add_special_tokens=False)]


#: Letters whose case and class every library agrees on, and punctuation that stands alone after one.
PLAIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
BEYOND = re.compile("[^\\x00-\\xff]")
#: A plain word, and punctuation after it, which is always a pre-token of its own (an apostrophe may not be).
TAILED = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
SAMPLES = ("the of and", "étre eaux pouvoir straße ñandú", "onin therand eaquesh ungkeit")
LINE = 64  # words encoded together


class ChunkIds:
    """Ids of texts whose tokenizer drops white space and marks word ends, as arrays of uint32.

    Texts are cut at spaces and line feeds, which are white space to every such tokenizer;
    no token, and no special string, holds one, and no composed character spans one.  A
    stop between a letter and white space is a chunk of its own, and texts of Latin-1
    letters are looked up in lower case if the tokenizer lowers them: both make for fewer
    distinct chunks.  Chunks are known by 64-bit hashes; a batch looks each distinct one
    up once.  New plain words are encoded many at a time and told apart by their end
    marks, all else chunk by chunk.  About `most` chunks are cached; a full cache keeps
    those of at most two tokens.  That changes times only.
    """

    def __init__(self, path: str, most: int = 700_000, chunk: int = 1 << 21):
        self.path, self.most, self.chunk = path, most, chunk
        self.place: dict[int, int] = {}
        self.first, self.size, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for w, i in vocab.items():
            self.ends[i] = bool(suffix) and w.endswith(suffix)
        self.lower = encode(path, ["AbÀ"]) == encode(path, ["abà"])
        self.plain = load(path)
        if self.ends.any():  # the same model without the steps that do nothing to plain words
            short = load_spec(spec | {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}})
            if all(short.encode(t, add_special_tokens=False).ids == self.plain.encode(t, add_special_tokens=False).ids for t in SAMPLES):
                self.plain = short

    def _add(self, keys: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.place)
        while n + len(keys) > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.first[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.place.update(zip(keys, range(n, n + len(keys)), strict=True))

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, sizes) of plain words, encoded together; nothing if they can't be told apart."""
        lines = [" ".join(words[j : j + LINE]) for j in range(0, len(words), LINE)]
        rows = (e.ids for lo in range(0, len(lines), 512) for e in self.plain.encode_batch_fast(lines[lo : lo + 512], add_special_tokens=False))
        flat = np.fromiter(itertools.chain.from_iterable(rows), np.uint32)
        cuts = np.flatnonzero(self.ends[flat]) + 1
        return (flat, np.diff(cuts, prepend=0)) if len(cuts) == len(words) else None

    def _learn(self, keys: list[int], chunks: list[str]) -> None:
        """Cut the new chunks in a plain word and its tail, or take them whole; encode each different part once."""
        cut = [m.groups() if (m := TAILED.fullmatch(w)) else ("", w) for w in chunks] if self.ends.any() else [("", w) for w in chunks]
        words = list({c[0] for c in cut if c[0]})
        ids = self._plain(words)
        if ids is None:
            cut, words, ids = [("", w) for w in chunks], [], (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        others = ["", *{c[1] for c in cut if c[1]}]
        rows = [r for lo in range(0, len(others), 8192) for r in encode(self.path, others[lo : lo + 8192])]
        flat = np.concatenate([ids[0], np.fromiter(itertools.chain.from_iterable(rows), np.uint32)])
        sizes = np.concatenate([ids[1], np.fromiter(map(len, rows), np.int64, len(rows))])
        first = np.cumsum(sizes) - sizes
        at = {w: i for i, w in enumerate(words)} | {"": len(words)}
        tail = {w: i for i, w in enumerate(others, len(words))}
        pair = np.array([x for a, b in cut for x in (at[a], tail[b])], np.int64)
        self._add(keys, flat[ranges(first[pair], sizes[pair])], sizes[pair].reshape(-1, 2).sum(axis=1))

    def _shrink(self) -> None:
        """Keep the chunks of at most two tokens, or none if those are too many."""
        old = [(k, i) for k, i in self.place.items() if self.size[i] <= 2]
        first, size, flat = self.first, self.size, self.flat
        self.place, self.used = {}, 0
        self.first, self.size, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        if len(old) <= self.most // 2:
            at = np.array([i for _, i in old], np.int64)
            self._add([k for k, _ in old], flat[ranges(first[at], size[at])], size[at])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for lo, hi in parts(texts, self.chunk):
            if len(self.place) > self.most:
                self._shrink()
            raw = [(t.lower() if self.lower and (t.isascii() or not BEYOND.search(t)) else t).encode() for t in texts[lo:hi]]
            whole = b"\n".join([*raw, b""])
            start, end = chunk_places(np.frombuffer(whole, np.uint8))
            q, first, back = np.unique(run_hashes(np.frombuffer(whole, np.uint8), start, end), return_index=True, return_inverse=True)
            keys = q.tolist()
            place = list(map(self.place.get, keys))
            if None in place:
                new = [i for i, p in enumerate(place) if p is None]
                self._learn([keys[i] for i in new], [whole[a:b].decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
                place = list(map(self.place.__getitem__, keys))
            at = np.array(place, np.int64)[back]
            sizes = self.size[at]
            ids = self.flat[ranges(self.first[at], sizes)]
            ends = np.cumsum([len(r) + 1 for r in raw])
            tokens = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(start, ends)]
            out += np.split(ids, tokens[:-1])
        return out


def chunk_places(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between spaces and line feeds, a stop between a letter and white space (or the end) apart."""
    space = (b == 32) | (b == 10)
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    last = end - 1  # a stop before white space ends its run
    stop = ((b[last] == 46) | (b[last] == 44)) & (last > start)
    p = last[stop]
    before, lead = b[p - 1], b[np.maximum(p - 2, 0)]
    letter = ((before | 32) >= 97) & ((before | 32) <= 122) | (lead == 0xC3) & (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7)
    i = np.flatnonzero(stop)[letter]
    p = p[letter]
    return np.insert(start, i + 1, p), np.insert(end, i, p)
