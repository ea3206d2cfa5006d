"""Jaccard self-join of documents on word n-gram sets, by MinHash banding.

1. Documents with equal n-gram sets are one class; only classes go on.
2. Band and row counts are the cheapest that reach the target recall at the
   threshold.  Classes shuffle on band hashes; in each bucket every class is tied to
   the least one, which makes as many rows as the bucket has, not as its pairs.
3. Components of those ties hold all candidate pairs.  The full sets of their
   members (and of no other document: a fixed-size filter goes ahead of the shuffle)
   meet in blocks of bounded size, where every pair is verified.
4. Verified links are summed by class with the classes' sizes; a spanning forest of
   them gives the groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common as C
from quern.llm.shingles import N, shingles, words_of

THRESHOLD = 0.8
RECALL = 0.9995
BLOCK = 128


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which at most `most` hashes still find a pair at the threshold with probability `recall`."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most and (best is None or rows > best[1]):
            best = bands, rows
    if best is None:
        raise ValueError("no band count reaches that recall; raise `most`")
    return best


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def band_hashes(s: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash for each band of the set's MinHash signature."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 1024):
        h = np.multiply.outer(a, s[lo : lo + 1024])
        h += b[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    rows = low.reshape(bands, -1)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows.shape[1]):
        h = C.mix(h * C.MIX + rows[:, j])
    return h


def intersections(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    if n == 2:
        k = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), k], [k, len(sets[1])]], np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(seen > 1) - 1
    keep = (seen > 1)[place]
    place, own = shared[place[keep]], owner[keep]
    order = np.argsort(place, kind="stable")
    place, own = place[order], own[order]
    out = np.zeros((n, n))
    top = int(place[-1]) + 1 if len(place) else 0
    for lo in range(0, top, width):
        i, j = np.searchsorted(place, [lo, lo + width])
        m = np.zeros((n, min(width, top - lo)), np.float32)
        m[own[i:j], place[i:j] - lo] = 1
        out += m @ m.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out.astype(np.int64)


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id and n_links of every row of documents.

    Two documents are linked if the Jaccard similarity of their n-gram sets is at least
    the threshold; n_links counts the linked documents, copies among them, and class_id
    is the least doc_id that links lead to.  A text of fewer than n words has one
    n-gram, all its words.  A text without words, or null, is linked to none and is its
    own class; so is a row with a null doc_id (class null).  Rows that share a doc_id are
    one document with the links of all.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    C.shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands, rows = choose_bands(threshold, recall)
    a, b = multipliers(bands * rows)
    signed = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("bands", pa.binary())])

    def sign(batches):
        C.trim()
        for batch in batches:
            keys, found = [], []
            for w in words_of(batch.column(1).to_pylist()):
                s = shingles(w, n)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                found.append(band_hashes(s, a, b, bands).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], schema=signed)

    sig = C.materialize(docs.mapInArrow(sign, "doc_id long, key binary, bands binary"), "signatures")
    part = sig.where("doc_id is not null and key is not null")
    classes = C.materialize(part.groupBy("key").agg(F.min("doc_id").alias("node"), F.countDistinct("doc_id").alias("weight")), "classes")
    ties = _ties(part.join(classes.select("key", "node"), "key").where("doc_id = node").select("node", "bands"), bands)
    inside = C.materialize(C.components(ties), "candidates")
    # one set a class: that of the row whose document is the class's node
    filter_ = spark.sparkContext.broadcast(C.pack(C.key_filter(inside.select("node"))))
    sets = pa.schema([("node", pa.int64()), ("key", pa.binary()), ("grams", pa.binary())])
    opened: dict = {}

    def collect(batches):
        if not opened:
            opened["f"] = C.unpack(filter_.value, np.uint8)
        for batch in batches:
            ids = batch.column(0)
            maybe = np.flatnonzero(C.may_hold(opened["f"], ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            some = batch.take(pa.array(maybe))
            got = [(i, s) for i, w in zip(some.column(0).to_pylist(), words_of(some.column(1).to_pylist()), strict=True) if i is not None and len(s := shingles(w, n))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for _, s in got], pa.binary()), pa.array([C.pack_sorted(s) for _, s in got], pa.binary())], schema=sets)

    dealt = C.chunked(inside, block).join(classes.withColumnRenamed("key", "of"), "node")
    grams = docs.mapInArrow(collect, "node long, key binary, grams binary").join(dealt, "node").where("key = of").dropDuplicates(["node", "key", "root", "lo", "hi"])
    linked = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def verify(batches):
        """Rows (a, b, null): a spanning forest of the block's links; (a, null, n): n documents are linked to a."""
        C.trim()
        for group in C.sorted_groups(batches, ["root", "lo", "hi"]):
            if len(group) < 2:
                continue
            nodes = np.array([g[1] for g in group], np.int64)
            weight = np.array([g[3] for g in group], np.int64)
            half = np.array([g[6] for g in group])
            inter = intersections([C.unpack_sorted(g[2]) for g in group])
            size = inter.diagonal()
            link = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
            if group[0][4] != group[0][5]:
                link &= half[:, None] != half[None, :]
            np.fill_diagonal(link, False)
            links = link @ weight
            trees = C.Union(len(group))
            pairs = []
            for i in np.flatnonzero(links):
                pairs += [(i, j) for j in np.flatnonzero(link[i, :i]) if trees.join(i, j)]
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*nodes[[i for i, _ in pairs]], *nodes[some]] if len(some) else [], pa.int64()),
                    pa.array([*nodes[[j for _, j in pairs]].tolist(), *([None] * len(some))] if len(some) else [], pa.int64()),
                    pa.array([*([None] * len(pairs)), *links[some].tolist()], pa.int64()),
                ], schema=linked,
            )

    shaped = C.by_block(grams.select("root", "node", "grams", "weight", "lo", "hi", "half"))
    found = C.materialize(shaped.mapInArrow(verify, "a long, b long, links long"), "links")
    C.discard(inside)
    groups = C.components(found.where("b is not null").select("a", "b"))
    links = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    of = classes.join(groups, "node", "left").join(links.withColumnRenamed("a", "node"), "node", "left")
    of = of.select("key", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = sig.select("doc_id", "key").join(of, "key", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))


def _ties(classes: DataFrame, bands: int) -> DataFrame:
    """(a, b): each class with the least of its bucket, for every bucket of two or more."""
    out = pa.schema([("bucket", pa.int64()), ("node", pa.int64())])

    def spread(batches):
        for b in batches:
            node = b.column(0).to_numpy()
            if len(node):
                h = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(node, bands))], schema=out)

    member = classes.mapInArrow(spread, "bucket long, node long")
    hub = member.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("bucket", "hub")
    hub = hub.repartition(C.partitions(hub.sparkSession))  # the join then has a shuffle of its own, which Spark may split where a bucket is hot
    return member.join(hub, "bucket").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of documents less all but the first document (least doc_id) of each class; see join()."""
    of = join(docs, **how)
    gone, key = C.free(docs, "gone"), C.free(docs, "gone_id")
    drop = of.where("class_id <> doc_id").select(F.col("doc_id").alias(key)).distinct().withColumn(gone, F.lit(True))
    return docs.join(drop, docs["doc_id"] == drop[key], "left_anti")
