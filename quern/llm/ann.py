"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are scaled to length one, rotated at random, and dealt to the lists of a
coarse quantiser.  Inside a list they lie in column blocks.  A query's partial distance
over the first d of D rotated dimensions estimates the whole: with the hypothesis that
the candidate is nearer than the k-th best so far, a partial distance above
(d/D) (1 + eps/sqrt(d))^2 times that one rejects it (ADSampling: Gao and Long, 2023),
and only what is left is scanned further.  Scores of what survives are computed on the
original vectors in double precision.

Centroids are fitted on at most `sample` vectors (those of least hash); every vector is
indexed.  A list of more than `rows` vectors and its more than `asked` queries are cut
into blocks that meet pairwise, so no list is one task however many vectors it has.
Equal vectors in a block are scanned once, with their smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import common as C

K = 5
EVERY = 50
SAMPLE = 20_000
LISTS = 4096
PROBED = 0.75  # share of the lists
EPS = 2.1
COLUMNS = 16
ROWS, ASKED = 8192, 2048
PART = pa.schema([("list", pa.int32()), ("vec_id", pa.int64()), ("unit", pa.binary()), ("x", pa.binary())])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, n: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means; an empty list keeps its centroid."""
    c = x[np.random.default_rng(seed).choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        first = np.searchsorted(near[order], np.arange(n))
        have = np.bincount(near, minlength=n) > 0
        c[have] = np.add.reduceat(x[order], first[have])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def rows_of(column, d: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, float64 rows) of the vectors of dimension d (the most common in the batch if None) that are finite, complete and not zero.

    Rows come times a power of two that puts their largest component near 1, which leaves
    cosines as they are and keeps squares from under- and overflowing.
    """
    sizes = np.array([-1 if s is None else s for s in pa.compute.list_value_length(column).to_pylist()])
    if d is None:
        good = sizes[sizes > 0]
        if not len(good):
            return np.zeros(0, np.int64), np.zeros((0, 0))
        d = int(np.bincount(good).argmax())
    at = np.flatnonzero(sizes == d)
    if not len(at) or not d:
        return np.zeros(0, np.int64), np.zeros((0, d or 0))
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = np.array(flat, float).reshape(len(at), d)
    top = np.abs(x).max(axis=1)
    ok = np.isfinite(top) & (top > 0)
    return at[ok], np.ldexp(x[ok], -np.frexp(top[ok])[1][:, None])


def scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, own: int, eps: float = EPS, columns: int = COLUMNS) -> np.ndarray:
    """Places in a block of unit rotated vectors, given as column blocks' full matrix, that may be among q's k nearest."""
    n, d = x.shape
    if n <= 4 * k:
        return np.arange(n)
    head = min(n, max(64, 4 * k))
    dist = ((x[:head] - q) ** 2).sum(axis=1)
    dist[ids[:head] == own] = np.inf
    best = np.partition(dist, k - 1)[k - 1]
    alive = np.arange(head, n)
    part = np.zeros(n - head)
    for lo in range(0, d, columns):
        hi = min(d, lo + columns)
        diff = x[alive, lo:hi] - q[lo:hi]
        part = part + np.einsum("ij,ij->i", diff, diff)
        if hi < d:
            keep = part <= best * (hi / d) * (1 + eps / hi**0.5) ** 2
            alive, part = alive[keep], part[keep]
        if not len(alive):
            break
    every = np.concatenate([np.arange(head), alive])
    dist = np.concatenate([dist, np.where(ids[alive] == own, np.inf, part)])
    best = np.partition(dist, k - 1)[k - 1]
    return every[dist <= best + 1e-5]


def search(vectors: DataFrame, k: int = K, every: int = EVERY, lists: int | None = None, probed: float = PROBED, sample: int = SAMPLE, rows: int = ROWS, asked: int = ASKED) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest cosines found for each vector whose vec_id is divisible by `every`.

    Candidates are all rows but those of the query's own vec_id; ties go to the smaller
    vec_id.  Rows with a null vec_id, and vectors that are null, zero, of another length
    than the first's, or hold null or non-finite components, take no part, nor do vectors
    whose squares sum to no finite number.  Repeated rows are candidates once (equal
    vec_id and vector).  Fewer candidates than k give fewer rows, an empty table none.
    """
    spark = vectors.sparkSession
    C.shared_dir(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    n = v.count()
    fit = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow() if n else None
    _, x = rows_of(fit["embedding"].combine_chunks(), None) if n else (None, np.zeros((0, 0)))
    if not len(x):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = x.shape[1]
    turn = rotation(d)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True) @ turn
    n_lists = min(len(unit), lists or min(LISTS, max(1, int(n**0.5))))
    c = centroids(unit, n_lists)
    probes = min(n_lists, max(16, int(np.ceil(probed * n_lists))))
    model = spark.sparkContext.broadcast((turn, c))

    def place(batches, many: bool):
        turn, c = model.value
        for b in batches:
            ids = b.column(0).to_numpy()
            at, x = rows_of(b.column(1), d)
            if not len(at):
                continue
            u = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] @ turn
            if many:
                near = np.argpartition(-(u @ c.T), probes - 1, axis=1)[:, :probes] if probes < n_lists else np.tile(np.arange(n_lists), (len(u), 1))
            else:
                near = (u @ c.T).argmax(axis=1)[:, None]
            m = near.shape[1]
            us, xs = [r.tobytes() for r in u.astype(np.float32)], [r.tobytes() for r in x]
            for lo in range(0, len(at), 2048):
                hi = min(len(at), lo + 2048)
                yield pa.RecordBatch.from_arrays([pa.array(near[lo:hi].ravel().astype(np.int32)), pa.array(np.repeat(ids[at[lo:hi]], m)), pa.array([r for r in us[lo:hi] for _ in range(m)], pa.binary()), pa.array([r for r in xs[lo:hi] for _ in range(m)], pa.binary())], schema=PART)

    sql = "list int, vec_id long, unit binary, x binary"
    index = C.materialize(v.mapInArrow(lambda b: place(b, False), sql).dropDuplicates(["vec_id", "x"]), "index")
    queries = v.where(F.col("vec_id") % every == 0).mapInArrow(lambda b: place(b, True), sql).withColumnRenamed("vec_id", "query_id")
    queries = C.materialize(queries, "queries")
    # a row a list, of which there are at most LISTS unless the caller asks for more
    cut = index.groupBy("list").agg(F.ceil(F.count("*") / rows).cast("int").alias("nv")).join(queries.groupBy("list").agg(F.ceil(F.count("*") / asked).cast("int").alias("nq")), "list")

    def dealt(df: DataFrame, key: str, kind: int, own: str, other: str) -> DataFrame:
        df = df.join(F.broadcast(cut), "list").withColumn("mine", F.pmod(F.xxhash64(key), F.col(own)).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        a, b = ("mine", "to") if kind == 0 else ("to", "mine")
        return df.select("list", F.col(a).alias("vb"), F.col(b).alias("qb"), F.lit(kind).alias("kind"), F.col(key).alias("id"), "unit", "x")

    both = dealt(index, "vec_id", 0, "nv", "nq").union(dealt(queries, "query_id", 1, "nq", "nv"))
    both = both.repartition(C.partitions(spark), "list", "vb", "qb").sortWithinPartitions("list", "vb", "qb", "kind", "id")

    def match(batches):
        for group in C.sorted_groups(batches, ["list", "vb", "qb"]):
            m = sum(g[3] == 0 for g in group)
            if not m or m == len(group):
                continue
            copies: dict[bytes, list[int]] = {}
            keep = []
            for g in group[:m]:
                ids = copies.get(g[6])
                if ids is None:
                    copies[g[6]] = [g[4]]
                    keep.append(g)
                elif len(ids) <= k:
                    ids.append(g[4])
            x = np.frombuffer(b"".join(g[5] for g in keep), np.float32).reshape(len(keep), -1).astype(float)
            raw = np.frombuffer(b"".join(g[6] for g in keep), float).reshape(len(keep), -1)
            norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
            alone = np.array([copies[g[6]][0] if len(copies[g[6]]) == 1 else -1 for g in keep])
            single = np.array([len(copies[g[6]]) == 1 for g in keep])
            alone = np.where(single, alone, np.iinfo(np.int64).min)
            out: list[list] = [[], [], []]
            for g in group[m:]:
                at = scan(x, alone, np.frombuffer(g[5], np.float32).astype(float), k, g[4])
                q = np.frombuffer(g[6], float)
                score = np.einsum("ij,j->i", raw[at], q) / (norm[at] * np.sqrt(q @ q))
                ranked = sorted((-s, i) for s, p in zip(score.tolist(), at.tolist(), strict=True) for i in copies[keep[p][6]] if i != g[4])
                for s, i in ranked[:k]:
                    for col, val in zip(out, (g[4], i, -s), strict=True):
                        col.append(val)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, FOUND, strict=True)], schema=FOUND)

    found = both.mapInArrow(match, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
