"""Harmonic packing of token sequences.

With capacity C, a piece of length C // k belongs to the class of k pieces a
sequence. Documents are cut so that all pieces are of such a length: whole
capacities first, then repeatedly the largest C // k that fits, down to a rest
of at most C // 32, which is left as it is and makes the class of its own
length (C // length pieces a sequence). A worker numbers its pieces within each
class; counts per worker and class give each worker its first number, and with
it the worker fills its sequences without looking at any other piece. The last
sequence of each class would stay short; its pieces, fewer than the capacity
over all classes by a constant, are placed first-fit by decreasing length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from weftline.llm.textids import encoder
from weftline.session import arrow_rows, materialise

#: Rows of the per-worker counts that are broadcast at most; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Rows of the Arrow batches in which texts pass to Python.
BATCH_ROWS = 1000
_CLASS = 1 << 40


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n tokens, in order."""
    out, rest = [capacity] * (n // capacity), n % capacity
    while rest > max(1, capacity // 32):
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return [*out, rest] if rest else out


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        enc, worker, seen = encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4")
        cols: list[list] = [[] for _ in range(6)]
        held = 0

        def flush():
            doc, start, length, total, rank, ids = cols
            out = pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array([worker] * len(doc), pa.int32()), pa.array(rank, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "worker", "nth", "ids"])
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i, doc in enumerate(docs):
                ids = np.concatenate((np.frombuffer(enc.packed(batch.column(1)[i].as_py()), enc.dtype).astype("<u4"), end))
                at = 0
                for m in cut(len(ids), capacity):
                    nth = seen[m] = seen.get(m, -1) + 1
                    for c, v in zip(cols, (doc, at, m, len(ids), nth, ids[at : at + m].tobytes()), strict=True):
                        c.append(v)
                    at += m
                held += len(ids)
                if held > 1_000_000:
                    yield flush()
                    held = 0
        if cols[0]:
            yield flush()

    return run


def _first_fit(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "nth"], ascending=[False, True])
        used: list[int] = []
        seq, offset = [], []
        for m in pdf["length"]:
            at = next((i for i, u in enumerate(used) if u + m <= capacity), len(used))
            if at == len(used):
                used.append(0)
            seq.append(at)
            offset.append(used[at])
            used[at] += m
        return pd.DataFrame({"length": pdf["length"], "nth": pdf["nth"], "bin": seq, "at": offset})

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids), one row for each piece.

    ``ids`` holds the piece's tokens as little-endian unsigned 32-bit integers.
    A null or empty text still has its end id, hence one piece. Null and repeated
    ids are carried along, each row being a document; very long texts are encoded
    whole and cut into many pieces; pieces of equal length are told apart by
    their numbers, so ties are settled. Columns beyond the two named are not
    looked at, and an empty table gives no pieces.
    """
    schema = "doc_id long, start long, length long, doc_tokens long, worker int, nth long, ids binary"
    named = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        pieces = materialise(named.mapInArrow(_pieces(tokenizer_path, end_id, capacity), schema), "pieces", compression="zstd")
    counts = pieces.groupBy("length", "worker").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "worker", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"), F.sum("c").over(Window.partitionBy("length")).alias("all"))
    firsts = materialise(firsts, "firsts")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    per = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    ranked = pieces.join(firsts, ["length", "worker"]).withColumn("nth", F.col("first") + F.col("nth")).withColumn("per", per)
    ranked = ranked.withColumn("late", F.col("nth") >= F.col("all") - F.col("all") % F.col("per"))
    # Fewer than C // length pieces of each length are late: a constant number, whatever the input.
    late = ranked.where("late").select("length", "nth", F.lit(1).alias("one")).groupBy("one").applyInPandas(_first_fit(capacity), "length long, nth long, bin long, at long")
    placed = ranked.join(F.broadcast(late), ["length", "nth"], "left")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "doc_tokens",
        F.coalesce("bin", F.col("length") * F.lit(_CLASS) + F.expr("nth div per")).alias("sequence_id"),
        F.coalesce("at", (F.col("nth") % F.col("per")) * F.col("length")).alias("offset"),
        "ids",
    )
