"""Language identification by language-bitmask n-gram filters.

Learning: letter 3- and 4-grams (with word edges) are counted by language over all
training documents; those that make up at least `share` of a language's letters go
into one bit-sliced Bloom filter, whose every slot is a mask of languages, so that
one look-up of an n-gram answers for all languages.  At most 2/share n-grams a
language pass, whatever the corpus, which bounds the filter and what reaches the
driver.

Prediction: a text's n-grams are looked up; each language's popcount is corrected
for the share of slots that its own n-grams fill (its false positives), and the
language of the highest corrected share wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common as C

ORDERS = (3, 4)
SHARE = 1e-5
HASHES = 3
CHARS = 250_000  # letters worked on at a time
FLUSH = 1_000_000
MOST_LANGUAGES = 4096
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
BLOB = pa.schema([("pid", pa.int32()), ("lang", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
BLOB_SQL = "pid int, lang int, keys binary, counts binary"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter n-grams of lower-cased texts and the text of each."""
    parts = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.array([len(p) + 4 for p in parts])
    codes = np.zeros(int(sizes.sum()), np.uint64)
    starts = np.cumsum(sizes) - sizes
    for s, p in zip(starts, parts, strict=True):
        codes[s + 1 : s + 1 + len(p)] = p
    codes[~letters()[codes]] = 0
    owner = np.repeat(np.arange(len(texts)), sizes)
    full = codes > 0
    keys, own = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        inner = full[1 : 1 + m].copy()
        for j in range(2, n - 1):
            inner &= full[j : j + m]
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = h * C.MIX + codes[at + j]
        keys.append(C.mix(h))
        own.append(owner[at])
    return np.concatenate(keys), np.concatenate(own)


def slices(texts: list[str], most: int = CHARS):
    """Runs of texts of about `most` characters; a text longer than that is alone, and whole."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def learn(docs: DataFrame, share: float = SHARE) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """Languages (largest first), masks by slot and word of 64 languages, fill by language, and the slots' bits."""
    spark = docs.sparkSession
    sizes = docs.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).where("n > 0").orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = [r.lang for r in sizes]
    place = {x: i for i, x in enumerate(langs)}
    least = [max(1.0, share * r.n) for r in sizes]
    parts = C.partitions(spark)

    def count(batches):
        C.trim()
        held: dict[int, list] = {}
        n = 0

        def flush():
            nonlocal n
            for lang, keys in sorted(held.items()):
                k, c = np.unique(np.concatenate(keys), return_counts=True)
                rows = [(p, lang, C.pack_sorted(k[at]), C.pack(c[at].astype(np.uint32))) for p, at in C.split_by((k % np.uint64(parts)).astype(np.int32), parts)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), BLOB, strict=True)], schema=BLOB)
            held.clear()
            n = 0

        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = [i for i, x in enumerate(names) if x in place]
            for lang in sorted({place[names[i]] for i in at}):
                own = [texts[i] for i in at if place[names[i]] == lang]
                for lo, hi in slices(own):
                    k, _ = grams(own[lo:hi])
                    if len(k):
                        held.setdefault(lang, []).append(k)
                        n += len(k)
                    if n >= FLUSH:
                        yield from flush()
        yield from flush()

    def keep(batches):
        held: dict[int, tuple] = {}
        for b in batches:
            for lang, k, c in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                k, c = C.unpack_sorted(k), C.unpack(c, np.uint32).astype(np.int64)
                if lang in held:
                    k, c = np.concatenate([held[lang][0], k]), np.concatenate([held[lang][1], c])
                    order = np.argsort(k, kind="stable")
                    k = k[order]
                    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                    k, c = k[first], np.add.reduceat(c[order], first)
                held[lang] = k, c
        for lang, (k, c) in sorted(held.items()):
            k = k[c >= least[lang]]
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([lang], pa.int32()), pa.array([C.pack_sorted(k)], pa.binary()), pa.array([None], pa.binary())], schema=BLOB)

    kept: list[list[np.ndarray]] = [[] for _ in langs]
    if langs:
        for _, lang, k, _ in docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(count, BLOB_SQL).repartitionById(parts, "pid").mapInArrow(keep, BLOB_SQL).collect():
            kept[lang].append(C.unpack_sorted(bytes(k)))
    most = max([1, *(sum(map(len, k)) for k in kept)])
    bits = max(12, (8 * most - 1).bit_length())
    masks = np.zeros((1 << bits, -(-max(1, len(langs)) // 64)), np.uint64)
    for lang, keys in enumerate(kept):
        for k in keys:
            for j in range(HASHES):
                masks[slot(k, j, bits), lang // 64] |= np.uint64(1 << lang % 64)
    fill = np.array([(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(langs))])
    return langs, masks, fill, bits


def slot(keys: np.ndarray, j: int, bits: int) -> np.ndarray:
    return (keys >> np.uint64(j * (64 - bits) // (HASHES - 1))) & np.uint64((1 << bits) - 1)


def shares(texts: list[str], masks: np.ndarray, fill: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of each text, corrected share of them in each language)."""
    k, owner = grams(texts)
    n = np.bincount(owner, minlength=len(texts))
    out = np.zeros((len(texts), len(fill)))
    for word in range(masks.shape[1]):
        m = masks[slot(k, 0, bits), word]
        for j in range(1, HASHES):
            m &= masks[slot(k, j, bits), word]
        for i in range(64 * word, min(64 * word + 64, len(fill))):
            out[:, i] = np.bincount(owner, (m >> np.uint64(i % 64) & np.uint64(1)).astype(float), minlength=len(texts))
    false = fill**HASHES
    return n, np.clip((out / np.maximum(n, 1)[:, None] - false) / np.maximum(1 - false, 1e-9), 0, 1)


def predictor(docs: DataFrame, share: float):
    """A function of texts that gives their languages and scores, learned from documents and ready for the workers."""
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    langs, masks, fill, bits = learn(docs.where(rest != 0).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null"), share)
    model = docs.sparkSession.sparkContext.broadcast((langs, C.pack(masks), masks.shape, fill))
    opened: dict = {}

    def judge(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, packed, shape, fill = model.value
        if "m" not in opened:
            opened["m"] = C.unpack(packed, np.uint64).reshape(shape)
        texts = [t or "" for t in texts]
        best: list[str] = []
        score: list[float] = []
        for lo, hi in slices(texts):
            n, s = shares(texts[lo:hi], opened["m"], fill, bits)
            if not names:
                n[:] = 0
            top = s.argmax(axis=1) if names else n
            best += [names[i] if k else "und" for i, k in zip(top, n, strict=True)]
            score += [float(s[j, i]) if k else 0.0 for j, (i, k) in enumerate(zip(top, n, strict=True))]
        return best, score

    return judge


def predict(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents.

    Learned from text and non-null lang of rows whose crc32(doc_id as text) mod 5 is not
    0; predicted from text alone.  Null texts and those without a letter are `und` with
    score 0, as is everything when nothing was learned; ties go to the language with
    more training text.  A null doc_id is neither learned from nor held out; repeated
    rows are rows; an empty table gives none.
    """
    judge = predictor(docs, share)

    def task(batches):
        C.trim()
        for b in batches:
            best, score = judge(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())], schema=ARROW)

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text")).mapInArrow(task, SCHEMA)


def keep(docs: DataFrame, least: float, share: float = SHARE) -> DataFrame:
    """The rows of documents in a learned language with a score of at least `least`; see predict().

    Decided where the rows are read: no shuffle.
    """
    judge, place = predictor(docs, share), docs.columns.index("text")

    def task(batches):
        C.trim()
        for b in batches:
            best, score = judge(b.column(place).to_pylist())
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(best, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
