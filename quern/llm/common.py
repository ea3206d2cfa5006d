"""What several operators share: shared folders, blob shuffles, number coding, components.

Blob shuffles.  Counting or matching hundreds of millions of 64-bit keys as
Spark rows costs tens of bytes and a few hundred nanoseconds a key.  The
operators here instead combine keys in numpy inside each map batch and shuffle
one binary row per (map batch, reduce partition): sorted keys, delta coded and
compressed.  Map-side combination means that a hot key is one entry per batch,
so no reduce partition grows with a key's frequency.
"""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import remove, shared_dir, shared_path

MIX = np.uint64(0x9E3779B97F4A7C15)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession):
    """Spark drops an action's shuffle files as it ends, rather than when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        remove(df.sparkSession, df._quern_path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are no longer referenced."""
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


_kept: dict = {}


def kept(key, make):
    """An object that a worker keeps from task to task; it keeps one, the last asked for."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def trim(keep=None) -> None:
    """Give memory that a worker's earlier tasks have freed, or that kept() holds for other keys, back to the system; called as tasks begin."""
    if keep not in _kept:
        _kept.clear()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):  # another C library: there is nothing to trim
    _libc = None


BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers at most BATCH_ROWS at a time: a batch of texts is in memory several times over on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Stafford's variant 13)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(keys: np.ndarray) -> np.ndarray:
    """np.unique(), which numpy since 2.3 does by hashing: of millions of numbers that is far slower than sorting them."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as compressed byte planes of their differences."""
    d = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    d = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64)


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def pack_planes(a: np.ndarray) -> bytes:
    """uint32 numbers as compressed byte planes: of small ones the upper planes nearly vanish."""
    return pack(np.ascontiguousarray(a.astype(np.uint32, copy=False).view(np.uint8).reshape(-1, 4).T))


def unpack_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(blob, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def split_by(part: np.ndarray, n: int):
    """(partition, positions) for every partition that has any; positions keep their order."""
    part = part.astype(np.uint16) if n < 1 << 16 else part  # so narrow a number is sorted by its digits
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(n + 1))
    for p in range(n):
        if ends[p] < ends[p + 1]:
            yield p, order[ends[p] : ends[p + 1]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated start..start+length-1."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths) + np.arange(total)


def record_batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the component's least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): a node's
    neighbours are never gathered, only their minimum (pre-aggregated), and the
    join back on the node is one that Spark may split where a hub is hot.  Every
    round is checkpointed in the shared folder.
    """
    spark = edges.sparkSession
    shared_dir(spark)

    def least(pairs: DataFrame) -> DataFrame:
        """Each node's least neighbour, dealt anew: the join on the node then has a shuffle of its own, which Spark may split."""
        return pairs.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct().checkpoint()
    for _ in range(most_rounds):
        seen = e.select(F.col("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("top")).union(e.select("v", F.lit(0), F.lit(1)))
        if seen.groupBy("n").agg(F.sum("low").alias("low"), F.max("top").alias("top")).where("low > 1 or low = 1 and top = 1").isEmpty():
            break  # every node has one edge, to a root: stars
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = least(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = small.where("u > v").distinct().checkpoint()
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


FILTER_BITS, SEGMENT_BITS = 27, 20


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of 2^bits bits, one a key, over a column of longs: a fixed size whatever their number.

    It is made segment by segment; the driver gets each segment once, compressed.
    """
    out = pa.schema([("segment", pa.int32()), ("bits", pa.binary())])
    segments = 1 << max(0, bits - SEGMENT_BITS)
    low = min(bits, SEGMENT_BITS)

    def places(batches):
        for b in batches:
            at = distinct(mix(b.column(0).drop_null().to_numpy().view(np.uint64)) & np.uint64((1 << bits) - 1))
            rows = [(p, pack(at[i].astype(np.uint32))) for p, i in split_by((at >> np.uint64(low)).astype(np.int32), segments)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=out)

    def fill(batches):
        sets: dict[int, np.ndarray] = {}
        for b in batches:
            for s, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sets.setdefault(s, np.zeros(1 << low, bool))[unpack(at, np.uint32) & np.uint32((1 << low) - 1)] = True
        for s, x in sets.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pack(np.packbits(x, bitorder="little"))], pa.binary())], schema=out)

    whole, width = np.zeros(1 << (bits - 3), np.uint8), 1 << (low - 3)
    n = min(partitions(keys.sparkSession), segments)
    for s, x in keys.mapInArrow(places, "segment int, bits binary").repartitionById(n, "segment").mapInArrow(fill, "segment int, bits binary").collect():
        whole[s * width : (s + 1) * width] = unpack(bytes(x), np.uint8)
    return whole


def may_hold(whole: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = mix(keys) & np.uint64(8 * len(whole) - 1)
    return (whole[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def sorted_groups(batches, keys: list[str]):
    """Groups of equal keys in a stream of record batches sorted by them: lists of row tuples, in column order."""
    held: list[tuple] = []
    last = None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        at = [b.schema.get_field_index(k) for k in keys]
        for row in zip(*cols, strict=True):
            k = tuple(row[i] for i in at)
            if k != last and held:
                yield held
                held = []
            last = k
            held.append(row)
    if held:
        yield held


def chunked(members: DataFrame, size: int) -> DataFrame:
    """Members (root, node, ...) of components, dealt to blocks: columns root, lo, hi, half and what members had.

    A component of up to `size` members is one block (lo = hi = 0).  A larger one is cut
    into chunks by a hash of `node`, and every unordered pair of chunks is a block, so
    that every pair of members meets in exactly one block (half tells the chunk; where
    lo = hi all pairs count, else those across) and no task holds more than about two
    chunks.
    """
    large = members.groupBy("root").agg(F.count("*").alias("__n")).where(F.col("__n") > size)
    large = large.select("root", F.ceil(F.col("__n") / size).cast("int").alias("__chunks")).repartition(partitions(members.sparkSession))  # the join has a shuffle of its own, which Spark may split
    cut = members.join(large, "root", "left").withColumn("__chunks", F.coalesce("__chunks", F.lit(1)))
    cut = cut.withColumn("half", F.pmod(F.xxhash64("node"), F.col("__chunks")).cast("int"))
    cut = cut.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
    return cut.select(*members.columns, F.least("half", "__other").alias("lo"), F.greatest("half", "__other").alias("hi"), "half")


def by_block(dealt: DataFrame) -> DataFrame:
    """The rows of each block of chunked() together, in order."""
    return dealt.repartition(partitions(dealt.sparkSession), "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")


class Union:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name
