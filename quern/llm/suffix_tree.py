"""Scoring by a probabilistic suffix tree over words.

States are contexts of zero, one or two words.  A context s is retained when its
next-symbol counts diverge from what its suffix predicts: the log-likelihood gained
by its own distribution over its suffix's must be at least `gain` nats per symbol
that it lists, and it lists the symbols that gain `symbol` nats themselves.  A retained state predicts with absolute discounting,

    P(x | s) = max(c(s, x) - discount, 0) / c(s) + w(s) * P(x | suffix(s)),

w(s) being the mass that makes it sum to one, and the root with
P(x) = (c(x) + 0.1) / (N + 0.1 (V + 1)).  Each token is scored in the longest
suffix of its history that is a state.

Scale.  Counts cover every training document.  n-grams are counted through blob
shuffles, combined per map batch.  Only things of fixed size are broadcast: the
`VOCABULARY` most frequent words, and Bloom filters of 2^27 bits over the other words
and the tree's keys, which decide what is asked, never what is answered.  The tree
itself grows with the corpus and stays partitioned: every batch of documents sends
the keys that pass the filter to their partitions and gets the values back, in `ROUNDS`
parts one after the other, so that a part's requests and answers alone are on disk.
Words are known by 64-bit hashes.

The vocabulary is a fast tier, not a bound: n-grams of its words have keys of three
20-bit ids.  n-grams with another word that occurs often enough to be in one (the tail)
have 62-bit hashes as keys, and the counts of tail words come from joins on the word.
Base probabilities of words outside the vocabulary come from such a join too, and are a
factor of what is predicted; so probabilities listed for such symbols are in units of them.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common as C
from quern.llm.shingles import byte_words
from quern.llm.shingles import parts as cut

BITS = 20
VOCABULARY = (1 << BITS) - 2
TAIL = 1 << BITS  # from here ids are places among a batch's own tail words
LEAST = 3  # an n-gram seen less often is not listed
DISCOUNT = 0.6
GAIN = 1.0
SYMBOL = -math.inf  # every symbol of a retained context
BATCH = 250_000  # tokens a batch
FLUSH = 1_500_000  # keys that a map task combines at a time
SHARE = 6_000_000  # keys a reduce partition
ROUNDS = 4  # batches are scored in so many parts: the requests and answers of one are on disk at a time
CONTEXT = np.uint64(1 << 62)  # marks the key of a context's weight
HASHED = np.uint64(1 << 63)  # marks keys with a tail word
NONE = np.zeros(0, np.uint64)
_vocab: dict[int, tuple] = {}

TOK = pa.schema([("batch", pa.int64()), ("w", pa.int64()), ("row", pa.int32()), ("n", pa.int64()), ("docs", pa.binary()), ("nulls", pa.binary()), ("flags", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("tail", pa.binary())])
TOK_SQL = "batch long, w long, row int, n long, docs binary, nulls binary, flags binary, sizes binary, ids binary, tail binary"
BLOB = pa.schema([("pid", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])
BLOB_SQL = "pid int, batch long, keys binary, vals binary"


def pid(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys % np.uint64(1_000_003)) % np.uint64(n)).astype(np.int32)


def word_counts(docs: DataFrame, parts: int) -> DataFrame:
    """(w, n) of training tokens by 64-bit hash; the end token is 0."""

    def gather(batches):
        held, n, texts = [], 0, 0

        def flush():
            k, c = np.unique(np.concatenate([*held, np.zeros(texts, np.uint64)]), return_counts=True)
            return blobs(k, c, parts)

        for b in batches:
            every = [t or b"" for t in b.column(0).to_pylist()]
            for lo, hi in cut(every):
                held.append(byte_words(every[lo:hi])[0])
                n += len(held[-1])
                texts += hi - lo
                if n >= FLUSH:
                    yield flush()
                    held, n, texts = [], 0, 0
        if texts:
            yield flush()

    schema = pa.schema([("w", pa.int64()), ("n", pa.int64())])

    def total(batches):
        for k, c in summed(batches):
            for lo in range(0, len(k), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(k[lo : lo + (1 << 18)].view(np.int64)), pa.array(c[lo : lo + (1 << 18)])], schema=schema)

    return docs.where("train").select("text").mapInArrow(gather, BLOB_SQL).repartitionById(parts, "pid").mapInArrow(total, "w long, n long")


def vocabulary(counts: DataFrame, least: int) -> tuple[pa.Table, DataFrame | None]:
    """(w, n) of at most VOCABULARY words, most frequent first, and of the tail: all others that occur `least` times, if any do.

    A word's id is its place from 1.
    """
    level = F.floor(F.log2("n") * 16)
    bins = sorted(counts.groupBy(level.alias("b")).agg(F.count("*"), F.count_if((F.col("n") >= least) & (F.col("w") != 0))).collect(), reverse=True)
    total, lowest, rest = 0, 1 << 40, 0
    for b, n, enough in bins:
        total += n
        if total > VOCABULARY:
            rest += enough
        else:
            lowest = b
    words = counts.where((F.col("n") >= least) & (F.col("w") != 0))
    top = words.where(level >= F.lit(lowest)).toArrow()
    return top.take(pc.sort_indices(top, [("n", "descending"), ("w", "ascending")])), words.where(level < F.lit(lowest)) if rest else None


def lookup(b) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary's hashes in order, and their ids; sorted once a worker."""
    if id(b) not in _vocab:
        w = C.unpack(b.value, np.uint64)
        order = np.argsort(w)
        _vocab.clear()
        _vocab[id(b)] = (b, w[order], (order + 1).astype(np.uint32))
    return _vocab[id(b)][1:]


def ids_of(h: np.ndarray, words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Each hash's id, 0 where it is not in the vocabulary."""
    if not len(words) or not len(h):
        return np.zeros(len(h), np.uint32)
    q, back = np.unique(h, return_inverse=True)
    at = np.minimum(np.searchsorted(words, q), len(words) - 1)
    return np.where(words[at] == q, ids[at], np.uint32(0)).astype(np.uint32)[back]


def tokenized(docs: DataFrame, vocab, end: int, others=None) -> DataFrame:
    """Batches of id arrays, and a row for each rare word of each document of a batch.

    Words that pass the filter `others` have ids from TAIL: TAIL and the word's place in the batch's `tail`.
    """
    opened: dict = {}

    def task(batches):
        words, ids = lookup(vocab)
        serial = TaskContext.get().partitionId() << 24

        def flush(held):
            nonlocal serial
            names, flags = [x for h in held for x in h[0]], [x for h in held for x in h[1]]
            size = np.concatenate([h[3] for h in held])
            h = np.concatenate([x[2] for x in held])
            found = ids_of(h, words, ids)
            rare = np.flatnonzero(found == 0)
            row, w = np.repeat(np.arange(len(size)), size)[rare], h[rare]
            order = np.lexsort((w, row))
            row, w = row[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (w[1:] != w[:-1])])) if len(w) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(w)))
            tail = NONE
            if others is not None:
                if not opened:
                    opened["f"] = C.unpack(others.value, np.uint8)
                at = np.flatnonzero(found == 0)
                at = at[C.may_hold(opened["f"], h[at])]
                tail, back = np.unique(h[at], return_inverse=True)
                found[at] = (TAIL + back).astype(np.uint32)
            whole = np.insert(found, np.cumsum(size), np.uint32(end))
            k = len(first)
            blank = pa.nulls(k, pa.binary())
            cols = [
                np.full(k + 1, serial), pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(w[first].view(np.int64))]), np.append(len(size), row[first]).astype(np.int32), np.append(0, times),
                *(pa.concat_arrays([pa.array([x], pa.binary()), blank]) for x in (*map(C.pack, (np.array([x or 0 for x in names], np.int64), np.array([x is None for x in names], np.uint8), np.array(flags, np.uint8), (size + 1).astype(np.uint32))), C.pack_planes(whole), C.pack(tail))),
            ]
            serial += 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(cols, TOK, strict=True)], schema=TOK)

        held, n = [], 0
        for b in batches:
            names, texts, flags = (c.to_pylist() for c in b.columns)
            texts = [t or b"" for t in texts]
            for lo, hi in cut(texts):
                h, size = byte_words(texts[lo:hi])
                held.append((names[lo:hi], flags[lo:hi], h, size))
                n += len(h) + hi - lo
                if n >= BATCH:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    flags = F.when(F.col("held"), 2).otherwise(0) + F.when(F.col("train"), 1).otherwise(0)
    return docs.select("doc_id", "text", flags.cast("int")).mapInArrow(task, TOK_SQL)


def shifted(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that, 0 where there is none in its document."""
    starts = np.cumsum(sizes) - sizes
    b, a = np.zeros_like(ids), np.zeros_like(ids)
    b[1:], a[2:] = ids[:-1], ids[:-2]
    b[starts] = 0
    a[starts] = 0
    a[(starts + 1)[sizes > 1]] = 0
    return a, b


def hashed(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return C.mix(C.mix(p + C.MIX) + q) >> np.uint64(2) | HASHED


def alone(words: np.ndarray) -> np.ndarray:
    """The keys of the weights of contexts of one tail word."""
    return C.mix(words ^ C.MIX) | HASHED | CONTEXT


def ngrams(ids: np.ndarray, sizes: np.ndarray, tail: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bigrams (below 2^40, or hashed) and trigrams that end at each token; 0 where a word is rare or missing."""
    ids = ids.astype(np.uint64)
    a, b = shifted(ids, sizes)
    two = np.where((b > 0) & (ids > 0), b << np.uint64(BITS) | ids, np.uint64(0))
    three = np.where((a > 0) & (two > 0), a << np.uint64(2 * BITS) | two, np.uint64(0))
    if len(tail):
        big = ids >= TAIL

        def code(x):
            x = x.copy()
            x[x >= TAIL] = tail[(x[x >= TAIL] - np.uint64(TAIL)).astype(np.int64)]
            return x

        at = np.flatnonzero((two > 0) & (big | (b >= TAIL)))
        two[at] = hashed(code(b[at]), code(ids[at]))
        at = np.flatnonzero((three > 0) & (big | (b >= TAIL) | (a >= TAIL)))
        three[at] = hashed(two[at - 1], code(ids[at]))
    return two, three


def blobs(keys: np.ndarray, counts: np.ndarray | None, parts: int, batch: int = -1):
    """Sorted distinct keys as one row a partition."""
    cols: list[list] = [[], [], [], []]
    for p, at in C.split_by(pid(keys, parts), parts):
        for c, v in zip(cols, (p, batch, C.pack_sorted(keys[at]), None if counts is None else C.pack(counts[at].astype(np.uint32))), strict=True):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, BLOB, strict=True)], schema=BLOB)


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")  # runs of sorted keys: a merge
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n[order], first)


def summed(batches):
    """The distinct keys of a reduce partition's blobs and their total counts."""
    keys, counts, n = [], [], 0
    for b in batches:
        for k, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            keys.append(C.unpack_sorted(k))
            counts.append(C.unpack(c, np.uint32))
            n += len(keys[-1])
            if n >= 2 * SHARE and len(keys) > 1:
                k, c = add_up(keys, counts)
                keys, counts, n = [k], [c], 0
    if keys:
        yield add_up(keys, counts)


def count_ngrams(tok: DataFrame, parts: int, least: int, base, filter_=None) -> DataFrame:
    """(key, n, c, p) of the bigrams of training documents seen at least `least` times, or, given a filter of those, of the trigrams.

    A trigram is counted only where both of its bigrams are frequent, without which it
    can't be.  A bigram has its context's count c and its symbol's base probability p; a
    trigram, or what has a tail word, has 0.
    """
    opened: dict = {}

    def gather(batches):
        keys, n = [], 0

        def flush():
            k, c = np.unique(np.concatenate(keys), return_counts=True)
            return blobs(k, c, parts)

        for b in batches:
            for flags, sizes, ids, tail in zip(*(b.column(c).to_pylist() for c in ("flags", "sizes", "ids", "tail")), strict=True):
                flags, sizes, ids = C.unpack(flags, np.uint8), C.unpack(sizes, np.uint32).astype(np.int64), C.unpack_planes(ids)
                train = np.repeat(flags & 1, sizes).astype(bool)
                two, three = ngrams(ids, sizes, C.unpack(tail, np.uint64))
                if filter_ is None:
                    k = two[(two > 0) & train]
                else:
                    if not opened:
                        opened["f"] = C.unpack(filter_.value, np.uint8)
                    at = np.flatnonzero((three > 0) & train)
                    at = at[C.may_hold(opened["f"], two[at])]
                    k = three[at[C.may_hold(opened["f"], two[at - 1])]]
                keys.append(k)
                n += len(k)
                if n >= FLUSH:
                    yield flush()
                    keys, n = [], 0
        if n:
            yield flush()

    out = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("p", pa.float64())])

    def total(batches):
        for k, c in summed(batches):
            keep = c >= least
            k, c = k[keep], c[keep]
            sizes, p0 = base.value
            two = k < np.uint64(1 << 2 * BITS)
            first, last = np.where(two, k >> np.uint64(BITS), 0).astype(np.int64), np.where(two, k & np.uint64((1 << BITS) - 1), 0).astype(np.int64)
            cols = k.astype(np.int64), c, np.where(two, sizes[first], 0), np.where(two, p0[last], 0.0)
            for lo in range(0, len(k), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 18)]) for x in cols], schema=out)

    return tok.where("w is null").select("flags", "sizes", "ids", "tail").mapInArrow(gather, BLOB_SQL).repartitionById(parts, "pid").mapInArrow(total, "key long, n long, c long, p double")


def tail_parts(tok: DataFrame, counted: DataFrame, trigrams: bool) -> DataFrame:
    """What the counted n-grams (key, n) with a tail word consist of; n-grams that are too rare aren't shuffled.

    Bigrams are (key, a, aw, x, xw, n), with the ids of context and symbol, or the tail
    words that they are; trigrams (key, ctx, suffix, n), with the keys of their bigrams.
    """
    names = ("ctx", "suffix") if trigrams else ("a", "aw", "x", "xw")
    out = pa.schema([(c, pa.int64()) for c in ("key", *names)])
    shared = tok.sparkSession.sparkContext.broadcast(C.pack(C.key_filter(counted.select("key"))))
    opened: dict = {}

    def gather(batches):
        for b in batches:
            for flags, sizes, ids, tail in zip(*(b.column(c).to_pylist() for c in ("flags", "sizes", "ids", "tail")), strict=True):
                flags, sizes, ids, tail = C.unpack(flags, np.uint8), C.unpack(sizes, np.uint32).astype(np.int64), C.unpack_planes(ids), C.unpack(tail, np.uint64)
                if not len(tail):
                    continue
                if not opened:
                    opened["f"] = C.unpack(shared.value, np.uint8)
                two, three = ngrams(ids, sizes, tail)
                every = three if trigrams else two
                some = np.flatnonzero((every >= HASHED) & np.repeat(flags & 1, sizes).astype(bool))
                some = some[C.may_hold(opened["f"], every[some])]
                k, at = np.unique(every[some], return_index=True)
                at = some[at]
                cols: list = [pa.array(k.view(np.int64))]
                if trigrams:
                    cols += pa.array(two[at - 1].view(np.int64)), pa.array(two[at].view(np.int64))
                else:
                    for x in (ids[at - 1], ids[at]):
                        big = x >= TAIL
                        word = np.where(big, tail[np.where(big, x - np.uint32(TAIL), 0)], np.uint64(0))
                        cols += pa.array(np.where(big, 0, x).astype(np.int64), mask=big), pa.array(word.view(np.int64), mask=~big)
                yield pa.RecordBatch.from_arrays(cols, schema=out)

    rows = tok.where("w is null").select("flags", "sizes", "ids", "tail").mapInArrow(gather, ", ".join(f"{c} long" for c in ("key", *names)))
    return rows.groupBy("key").agg(*(F.first(c).alias(c) for c in names)).join(counted, "key").select("key", *names, "n")


def tail_bigrams(found: DataFrame, words: DataFrame, base, denominator: float) -> DataFrame:
    """(key, a, n, c, p, unit) of tail_parts()'s bigrams: as count_ngrams() has them, the context (an id, or the negative key of a tail word's weight), and the base probability of a symbol of the tail, else 1."""
    known = words.select("w", F.col("n").alias("of"))

    def join(df: DataFrame, word: str, name: str) -> DataFrame:
        there = df.where(F.col(word).isNotNull()).join(known.select(F.col("w").alias(word), F.col("of").alias(name)), word)
        return there.unionByName(df.where(F.col(word).isNull()).withColumn(name, F.lit(0).cast("long")))

    out = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("p", pa.float64()), ("unit", pa.float64())])

    def filled(batches):
        sizes, p0 = base.value
        for b in batches:
            b = {f.name: c for f, c in zip(b.schema, b.columns)}
            a, aw, x = (b[k].fill_null(0).to_numpy() for k in ("a", "aw", "x"))
            there, symbol = b["aw"].is_valid().to_numpy(zero_copy_only=False), b["xw"].is_valid().to_numpy(zero_copy_only=False)
            unit = np.where(symbol, (b["xn"].to_numpy() + 0.1) / denominator, 1.0)
            cols = b["key"], np.where(there, alone(aw.view(np.uint64)).view(np.int64), a), b["n"], np.where(there, b["an"].to_numpy(), sizes[a]), np.where(symbol, unit, p0[x]), unit
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], schema=out)

    return join(join(found, "aw", "an"), "xw", "xn").mapInArrow(filled, "key long, a long, n long, c long, p double, unit double")


def tree(bigrams: DataFrame, trigrams: DataFrame, words: int, discount: float, gain: float, symbol: float, tail: tuple[DataFrame, DataFrame] | None = None) -> tuple[np.ndarray, DataFrame]:
    """The weights of one-word contexts by word id (1 where not retained), and (key, value) of all else that scoring looks up.

    The values are listed probabilities for bigram and trigram keys, and weights for
    the keys of two-word contexts.  `tail` are tail_bigrams() and tail_parts()'s trigrams,
    with which contexts of one tail word have weights there.
    """
    spark = bigrams.sparkSession
    own = F.col("n") * F.log(F.col("n") / F.col("c") / F.col("p"))

    def retained(g: DataFrame, context: str) -> DataFrame:
        """Of (context, n, c, p): the context's weight, where its distribution gains enough on p."""
        by = g.where(own >= symbol).groupBy(context).agg(
            F.max("c").alias("c"), F.sum("n").alias("sn"), F.sum("p").alias("sp"), F.count("*").alias("k"),
            F.sum(own).alias("g"),
        )
        rest = F.col("c") - F.col("sn")
        more = F.when((rest > 0) & (F.col("sp") < 1), rest * F.log(rest / F.col("c") / (1 - F.col("sp")))).otherwise(0.0)
        return by.where(F.col("g") + more >= gain * F.col("k")).select(context, (1 - (F.col("sn") - discount * F.col("k")) / F.col("c")).alias("weight"))

    first = bigrams.select(F.shiftright("key", BITS).alias("a"), "n", "c", "p")
    if tail:
        single = C.materialize(retained(first.union(tail[0].select("a", "n", "c", "p")), "a"), "single-weights")
        lone = single.where("a < 0")
        got = single.where("a >= 0").toArrow()
    else:
        got = retained(first, "a").toArrow()  # a row a word of the vocabulary at most
    weight = np.full(words + 1, np.nan, np.float32)
    weight[got["a"].to_numpy()] = got["weight"].to_numpy()
    shared = spark.sparkContext.broadcast(weight)
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("p", pa.float64()), ("listed", pa.float64())])

    def mixed(batches):
        for b in batches:
            k, n, c, p = (x.to_numpy() for x in b.columns[:4])
            if b.num_columns > 4:
                a, own = b.column(4).to_numpy(), b.column(5).fill_null(np.nan).to_numpy()
                w = np.where(a < 0, own, shared.value[np.maximum(a, 0)])
            else:
                w = shared.value[k >> BITS].astype(float)
            own = (n - discount) / c
            listed = ~np.isnan(w) & (n * np.log(n / c / p) >= symbol)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.where(np.isnan(w), 1, w) * p + np.where(listed, own, 0)), pa.array(own, mask=~listed)], schema=schema)

    layout = "key long, n long, p double, listed double"
    two = bigrams.mapInArrow(mixed, layout)
    if tail:
        more = tail[0].join(lone, "a", "left").select("key", "n", "c", "p", "a", F.col("weight").cast("double").alias("weight")).mapInArrow(mixed, layout)
        two = two.withColumn("unit", F.lit(1.0)).unionByName(more.join(tail[0].select("key", "unit"), "key"))
    two = C.materialize(two, "bigrams")

    def attached(g: DataFrame, *more: str) -> DataFrame:
        return g.join(two.select(F.col("key").alias("suffix"), "p", *more), "suffix").join(two.select(F.col("key").alias("ctx"), F.col("n").alias("c")), "ctx").select("key", "ctx", "n", "c", "p", *more)

    three = attached(trigrams.select("key", "n", F.shiftright("key", BITS).alias("ctx"), F.col("key").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("suffix")))
    whole = [C.materialize(three.withColumn("unit", F.lit(1.0)) if tail else three, "trigrams")]
    C.release(spark)
    if tail:  # by itself, so that the shuffle files of one join are on disk at a time
        whole.append(C.materialize(attached(tail[1], "unit").select(whole[0].columns), "tail-trigrams"))
        C.release(spark)
    three = reduce(DataFrame.union, whole)
    pair = C.materialize(retained(three, "ctx"), "weights")
    unit = F.col("unit") if tail else F.lit(1.0)
    listed = three.where(own >= symbol).join(pair, "ctx", "left_semi").select("key", ((F.col("n") - discount) / F.col("c") / unit).cast("float").alias("value"))
    values = two.where("listed is not null").select("key", (F.col("listed") / unit).cast("float").alias("value")).union(listed).union(pair.select(F.col("ctx").bitwiseOR(F.lit(1 << 62)).alias("key"), F.col("weight").cast("float").alias("value")))
    if tail:
        values = values.union(lone.select(F.col("a").alias("key"), F.col("weight").cast("float").alias("value")))
    out = C.materialize(values, "tree")
    C.discard(two, *whole, pair, *([single] if tail else []))
    return np.where(np.isnan(weight), np.float32(1), weight), out


def wanted(two: np.ndarray, three: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys looked up at each token besides its one-word context of the tail: its bigram, its trigram, and its two-word context."""
    context = np.zeros_like(two)
    context[1:] = two[:-1]
    starts = np.cumsum(sizes) - sizes
    context[starts] = 0
    return two, three, np.where(context > 0, context | CONTEXT, np.uint64(0))


def score(docs: DataFrame, discount: float = DISCOUNT, gain: float = GAIN, symbol: float = SYMBOL, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of documents.

    Documents whose crc32(doc_id as text) mod 10 is not 0 are learned from; all are
    scored.  A null text is empty: its end token alone.  A row with a null doc_id is
    scored, not learned from and not held out; repeated rows count each time.  An empty
    table gives no rows, and a corpus without training documents gives every token
    probability one.
    """
    spark = docs.sparkSession
    C.shared_dir(spark)
    rest = F.crc32(F.col("doc_id").cast("string")) % 10
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.coalesce(rest != 0, F.lit(False)).alias("train"), F.coalesce(rest == 0, F.lit(False)).alias("held"))
    counts = C.materialize(word_counts(docs, C.partitions(spark)), "words")
    n, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top, rest_words = vocabulary(counts, least)
    sizes = np.append(top["n"].to_numpy(), counts.where("w = 0").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]).astype(np.int64)
    end = len(sizes)  # the end token has the last id
    vocab = spark.sparkContext.broadcast(C.pack(top["w"].to_numpy().view(np.uint64)))
    del top
    others = None if rest_words is None else spark.sparkContext.broadcast(C.pack(C.key_filter(rest_words.select("w"))))
    C.release(spark)
    tok = C.materialize(tokenized(docs, vocab, end, others), "tokens")
    parts = int(min(65_536, max(C.partitions(spark), -(-n // SHARE))))
    denominator = n + 0.1 * (distinct + 1)
    p0 = np.concatenate([[1.0], (sizes + 0.1) / denominator])
    base = spark.sparkContext.broadcast((np.append(0, sizes), p0))
    bigrams = C.materialize(count_ngrams(tok, parts, least, base), "bigrams")
    C.release(spark)
    frequent = spark.sparkContext.broadcast(C.pack(C.key_filter(bigrams.select("key"))))
    trigrams = C.materialize(count_ngrams(tok, parts, least, base, frequent), "trigrams")
    C.release(spark)
    tail = None
    if rest_words is not None:
        two, three = (g.where("key < 0").select("key", "n") for g in (bigrams, trigrams))
        tail = C.materialize(tail_bigrams(tail_parts(tok, two, False), rest_words, base, denominator), "tail-bigrams"), C.materialize(tail_parts(tok, three, True), "tail-trigrams")
    w1, values = tree(bigrams.where("key > 0"), trigrams.where("key > 0"), end, discount, gain, symbol, tail)
    C.discard(bigrams, trigrams, *(tail or ()))
    bits = C.key_filter(values.select("key"))
    C.release(spark)
    small = spark.sparkContext.broadcast((C.pack(bits), w1, sizes > 0))
    opened: dict = {}

    def asked_keys(ids: np.ndarray, sizes: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a batch looks up (wanted(), then a context for each of `tail`), of which 0 is nothing: all keys, and those that pass the filter."""
        if "bits" not in opened:
            opened["bits"] = C.unpack(small.value[0], np.uint8)
        k = np.concatenate([*wanted(*ngrams(ids, sizes, tail), sizes), alone(tail)])
        at = np.flatnonzero(k)
        return k, at[C.may_hold(opened["bits"], k[at])]

    def ask(batches):
        for b in batches:
            for batch, sz, ids, tail in zip(*(b.column(c).to_pylist() for c in ("batch", "sizes", "ids", "tail")), strict=True):
                k, at = asked_keys(C.unpack_planes(ids), C.unpack(sz, np.uint32).astype(np.int64), C.unpack(tail, np.uint64))
                if len(at):
                    yield blobs(C.distinct(k[at]), None, parts, batch)

    def model(batches):
        for b in batches:
            k, v = b.column(0).to_numpy().astype(np.uint64), b.column(1).to_numpy().astype(np.float32)
            order = np.argsort(k)
            k, v = k[order], v[order]
            cols: list[list] = [[], [], [], []]
            for p, at in C.split_by(pid(k, parts), parts):
                for c, x in zip(cols, (p, -1, C.pack_sorted(k[at]), C.pack(v[at])), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, BLOB, strict=True)], schema=BLOB)

    def answer(batches):
        keys, vals, asked = [], [], []
        for b in batches:
            for p, batch, k, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if batch < 0:
                    keys.append(C.unpack_sorted(k))
                    vals.append(C.unpack(v, np.float32))
                else:
                    asked.append((p, batch, k))  # still compressed
        if not keys:
            return
        k, v = np.concatenate(keys), np.concatenate(vals)
        order = np.argsort(k)
        k, v = k[order], v[order]
        for p, batch, q in asked:
            q = C.unpack_sorted(q)
            at = np.minimum(np.searchsorted(k, q), len(k) - 1)
            hit = k[at] == q
            if hit.any():  # which of the asked keys, and their values: the batch knows the keys
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([batch]), pa.array([C.pack(np.packbits(hit))], pa.binary()), pa.array([C.pack(v[at[hit]])], pa.binary())], schema=BLOB)

    out = pa.schema([("batch", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(batches):
        _, weight1, seen = small.value
        p0 = base.value[1]
        held: dict[int, list] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(row[0], []).append(row[1:])
        for batch, rows in held.items():
            got, t = {}, None
            for p, hits, v, *rest in rows:
                if p is None:
                    t = rest
                else:
                    got[p] = hits, v
            ids_of, nulls, flags, sz, tail = (C.unpack(x, kind) for x, kind in zip((*t[:4], t[5]), (np.int64, np.uint8, np.uint8, np.uint32, np.uint64), strict=True))
            ids = C.unpack_planes(t[4])
            sz = sz.astype(np.int64)
            every, asked = asked_keys(ids, sz, tail)
            order = np.argsort(every[asked])
            asked = asked[order]
            k = every[asked]
            new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
            k, back = k[new], np.cumsum(new) - 1
            value = np.full(len(k), np.nan)
            for p, at in C.split_by(pid(k, parts), parts):
                if p in got:
                    value[at[np.unpackbits(C.unpack(got[p][0], np.uint8), count=len(at)).astype(bool)]] = C.unpack(got[p][1], np.float32)
            found = np.full(len(every), np.nan)  # nan: not in the tree
            found[asked] = value[back]
            d1, d2, w2, own = np.split(found, [len(ids), 2 * len(ids), 3 * len(ids)])
            _, before = shifted(ids, sz)
            w1 = weight1[np.where(before < TAIL, before, 0)].astype(float)
            if len(tail):
                at = np.flatnonzero(before >= TAIL)
                w1[at] = np.where(np.isnan(own), 1.0, own)[before[at] - TAIL]
                ids = np.where(ids < TAIL, ids, np.uint32(0))
            p1 = np.where(np.isnan(d1), 0.0, d1) + w1 * p0[ids]
            p = np.where(np.isnan(w2), p1, np.where(np.isnan(d2), 0.0, d2) + w2 * p1)
            starts = np.cumsum(sz) - sz
            rare = ids == 0  # p0[0] is 1: what the join on the word gives is added to both
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(sz), batch)), pa.array(np.arange(len(sz), dtype=np.int32)), pa.array(ids_of, mask=nulls.astype(bool)), pa.array((flags & 2) > 0),
                    pa.array(sz), pa.array(np.add.reduceat(seen[ids - (~rare)].astype(np.int64) * ~rare, starts)), pa.array(np.add.reduceat(np.log10(p0[ids]), starts)), pa.array(np.add.reduceat(np.log10(p), starts)),
                ], schema=out,
            )

    cols = ("docs", "nulls", "flags", "sizes", "ids", "tail")
    to = max(C.partitions(spark), tok.where("w is null").count() // (4 * ROUNDS))
    place = F.pmod(F.hash("batch"), F.lit(to))
    listed = C.materialize(values.mapInArrow(model, BLOB_SQL), "model")
    C.discard(values)
    rounds = []
    for i in range(ROUNDS):
        whole = tok.where(F.col("w").isNull() & (F.pmod(F.col("batch") + F.shiftright("batch", 24), F.lit(ROUNDS)) == i))
        asked = whole.select("batch", "sizes", "ids", "tail").mapInArrow(ask, BLOB_SQL).union(listed)
        answers = C.materialize(asked.repartitionById(parts, "pid").mapInArrow(answer, BLOB_SQL), "answers")
        del asked
        C.release(spark)
        both = whole.select("batch", F.lit(None).cast("int").alias("pid"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("vals"), *cols).union(answers.select("batch", "pid", "keys", "vals", *(F.lit(None).cast("binary").alias(c) for c in cols)))
        rounds.append(C.materialize(both.repartitionById(to, place).mapInArrow(finish, "batch long, row int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores"))
        del both
        C.discard(answers)
        C.release(spark)
    C.discard(listed)
    done = reduce(DataFrame.union, rounds)
    rare = tok.where("w is not null").select("w", "batch", "row", F.col("n").alias("m")).join(counts, "w", "left")
    rare = rare.groupBy("batch", "row").agg(F.sum(F.col("m") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(denominator))).alias("r"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("known"))
    more = F.coalesce("r", F.lit(0.0))
    return done.join(rare, ["batch", "row"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
