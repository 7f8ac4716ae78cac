"""A uniform shuffle into shards of exact sizes by a communication matrix.

How many rows each input partition sends to each shard is drawn from the
multivariate hypergeometric law with the partitions' row counts and the shards'
exact sizes as margins, the law these counts have under a uniform permutation.
Each partition permutes its rows locally and deals them to the shards; after
the exchange each shard is permuted again, by random keys. All n! orders are
equally likely, and shard sizes differ by one row at most.

The matrix is never built: a binary tree over the partitions splits the shard
sizes in two at each node, with a generator seeded by the node, so a task
draws only the nodes on its own path. A shard is permuted in blocks, the runs of
its rows by key; a block holds about BLOCK_BYTES, as keys are random. Deals and
keys follow from the seed and the row counts alone, so where each block of a
shard begins is counted beforehand without reading a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from weftline.session import materialise

#: Size of the rows of a block, on average.
BLOCK_BYTES = 1 << 20
#: Blocks of a shard whose beginnings are counted together.
RUN_BLOCKS = 4096
#: Beginnings of blocks that are broadcast at most; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000
#: numpy draws from populations below this size directly.
_DIRECT = 10**9


def _rng(seed: int, *place: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, *place])))


def draw_one(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good; exact for any population.

    Beyond numpy's limit two binomial counts are drawn until their sum is ``n``,
    which leaves the hypergeometric law.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if max(good, bad) < _DIRECT:
        return int(rng.hypergeometric(good, bad, n))
    p = n / (good + bad)
    while True:
        g, b = rng.binomial(good, p, 100_000), rng.binomial(bad, p, 100_000)
        hit = np.flatnonzero(g + b == n)
        if len(hit):
            return int(g[hit[0]])


def draw(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``n`` out of groups of the given sizes."""
    out, left, rest = np.zeros(len(sizes), np.int64), int(n), int(sizes.sum())
    for i, c in enumerate(sizes.tolist()):
        rest -= c
        out[i] = draw_one(rng, c, rest, left)
        left -= int(out[i])
    return out


def matrix_row(counts: np.ndarray, shards: np.ndarray, at: int, seed: int) -> np.ndarray:
    """Row ``at`` of the communication matrix of partition counts and shard sizes."""
    lo, hi, sizes = 0, len(counts), np.asarray(shards, np.int64)
    total = np.concatenate(([0], np.cumsum(counts)))
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw(_rng(seed, 1, lo, hi), sizes, int(total[mid] - total[lo]))
        if at < mid:
            hi, sizes = mid, left
        else:
            lo, sizes = mid, sizes - left
    return sizes


def even_sizes(n: int, parts: int) -> np.ndarray:
    """``n`` in ``parts`` sizes that differ by one at most, larger ones first."""
    return np.array([n // parts + (i < n % parts) for i in range(parts)], np.int64)


def _dealt(counts: np.ndarray, sizes: np.ndarray, at: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard and the key, of 62 random bits, of each row of partition ``at``."""
    rng = _rng(seed, 2, at)
    shard = np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(counts, sizes, at, seed))
    rng.shuffle(shard)
    return shard, rng.integers(0, 2**62, len(shard), dtype=np.int64)


def _block(key: np.ndarray, blocks: int) -> np.ndarray:
    return (key >> 31) * blocks >> 31


def _send(counts: np.ndarray, sizes: np.ndarray, blocks: int, seed: int):
    def run(batches):
        at, done = TaskContext.get().partitionId(), 0
        shard, key = _dealt(counts, sizes, at, seed) if at < len(counts) else (np.empty(0, np.int32), np.empty(0, np.int64))
        for batch in batches:
            rows = slice(done, done + batch.num_rows)
            if rows.stop > len(shard):
                raise ValueError("the input changed between two reads; pass stable=False")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard[rows]), pa.array(_block(key[rows], blocks)), pa.array(key[rows])], names=[*batch.schema.names, "__shard", "__block", "__key"])
            done = rows.stop
        if done != len(shard):
            raise ValueError("the input changed between two reads; pass stable=False")

    return run


def _starts(spark, counts: np.ndarray, sizes: np.ndarray, blocks: int, seed: int) -> DataFrame:
    """(__shard, __block, start): where each block begins in its shard."""

    def run(batches):
        for batch in batches:
            for at in batch.column(0).to_pylist():
                shard, key = _dealt(counts, sizes, at, seed)
                place, n = np.unique(shard * np.int64(blocks) + _block(key, blocks), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((place // blocks).astype(np.int32)), pa.array(place % blocks), pa.array(n)], names=["__shard", "__block", "n"])

    parts = spark.range(0, len(counts), 1, max(1, min(len(counts), 4 * spark.sparkContext.defaultParallelism)))
    filled = parts.mapInArrow(run, "__shard int, __block long, n long").groupBy("__shard", "__block").agg(F.sum("n").alias("n"))
    filled = materialise(filled.withColumn("run", F.floor(F.col("__block") / RUN_BLOCKS)), "block-sizes")
    # Runs of blocks are added up first, so no shard's blocks meet in one task.
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = filled.groupBy("__shard", "run").agg(F.sum("n").alias("n"))
    runs = runs.select("__shard", "run", F.coalesce(F.sum("n").over(upto("__shard", "run")), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(upto("__shard", "run", "__block")), F.lit(0))
    starts = filled.withColumn("inside", inside).join(runs, ["__shard", "run"])
    return materialise(starts.select("__shard", "__block", (F.col("before") + F.col("inside")).alias("start")), "block-starts")


def shuffle_shards(df: DataFrame, shards: int, seed: int = 0, block_bytes: int = BLOCK_BYTES, stable: bool = False) -> DataFrame:
    """All columns of ``df`` with ``shard`` and ``slot``, a uniform random order of its rows.

    Shard sizes differ by one at most; slots of a shard run from 0 without gaps.
    The same input layout and seed give the same result. Equal rows are rows of
    their own, nulls in any column are carried along, very long values make a
    block larger by themselves alone, an empty table gives an empty table, and
    columns named shard or slot are replaced. ``stable`` tells that reading
    ``df`` again gives the same partitions, as a scan of files does; otherwise it
    is written once to the shared folder. A task holds a few bytes for each row
    of its partition; only a row count and a size for each partition reach the driver.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "slot")]
    # Names of one's own keep the columns of ``df`` apart from those made here.
    own = [f"c{i}" for i in range(len(names))]
    df = df.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)))
    if not stable:
        df = materialise(df, "to-shuffle")
    size = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8) for f in df.schema.fields), F.lit(8))
    found = {r.p: (r.n, r.b) for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("b")).collect()}
    counts = np.array([found.get(i, (0, 0))[0] for i in range(max(found, default=0) + 1)], np.int64)
    sizes = even_sizes(int(counts.sum()), shards)
    blocks = max(1, -(-sum(b for _, b in found.values()) // (shards * block_bytes)))
    schema = T.StructType([*df.schema.fields, T.StructField("__shard", T.IntegerType()), T.StructField("__block", T.LongType()), T.StructField("__key", T.LongType())])
    starts = _starts(spark, counts, sizes, blocks, seed)
    dealt = df.mapInArrow(_send(counts, sizes, blocks, seed), schema)
    placed = dealt.join(F.broadcast(starts) if shards * blocks <= BROADCAST_ROWS else starts, ["__shard", "__block"])
    nth = F.row_number().over(Window.partitionBy("__shard", "__block").orderBy("__key"))
    return placed.select(*(F.col(o).alias(c) for c, o in zip(names, own, strict=True)), F.col("__shard").alias("shard"), (F.col("start") + nth - 1).alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int, **kwargs) -> None:
    """Write the shuffled rows as Parquet, a folder for each shard, rows in slot order within a file."""
    shuffle_shards(df, shards, **kwargs).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
