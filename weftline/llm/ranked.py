"""Ranked lexical search: each item's best documents, by presence masks.

Documents are cut into terms once; what is kept of each is its length and how
often the items' terms occur in it. A block of documents has a bitmap for each
term, a bit for each document. For an item the bitmaps of its terms are turned
on their side: each document's mask of present terms. Documents of one mask
share an upper bound of their score, the sum of what each present term can give
at most in the block. Masks are evaluated by descending bound, and an item is
done with a block when its next bound is below the last of the best that the
task has found so far. Each task hands on its best of each item; the best of all
are among them.

Scores are whole numbers: a term's weight w = floor(1000 ln((2 N + 2) / (2 df + 1))),
a document's m = 50 + (50 n N) div L, and each term of the item that occurs tf
times gives w ((10^9 tf) div (1000 tf + 20 m)).
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftline.llm.contamination import words_of
from weftline.session import arrow_rows, materialise

#: Terms of items, each counted with its item, that are searched in one pass over the documents; more items take more passes.
PASS_TERMS = 300_000
#: Documents of a block.
BLOCK_DOCS = 4096
#: Documents whose masks are evaluated at first; each next step doubles it.
FIRST_DOCS = 64
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text: runs of digits, letters a-z and characters beyond ASCII, A-Z lower-cased."""
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _cut(number: dict[bytes, int]):
    """(doc_id, text) to (doc_id, n, terms, tfs) of the documents with a term at all; only terms with a number are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if words:
                    found = [(number[t], c) for t, c in Counter(words).items() if t in number]
                    ids.append(doc_id)
                    lengths.append(len(words))
                    terms.append([t for t, _ in found])
                    tfs.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return run


def _masks(bits: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an item's bitmaps (a row for each term): the distinct masks as rows of flags, the documents in order of mask, and where each mask's begin."""
    flags = np.unpackbits(bits, axis=1, count=docs)
    words = -(-len(flags) // 64)
    packed = np.zeros((docs, words * 8), np.uint8)
    turned = np.packbits(flags.T, axis=1)
    packed[:, : turned.shape[1]] = turned
    masks = packed.view(np.uint64)
    order = np.lexsort(masks.T) if words > 1 else np.argsort(masks[:, 0], kind="stable")
    ordered = masks[order]
    begins = np.flatnonzero(np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(1))))
    return flags[:, order[begins]].T, order, np.append(begins, docs)


class Block:
    """A block of documents with its postings by term."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, terms: int):
        self.ids = ids
        order = np.argsort(term, kind="stable")
        self.doc, tf = doc[order], tf[order]
        self.at = np.searchsorted(term[order], np.arange(terms + 1))
        self.gain = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.doc])
        self.most = np.zeros(terms, np.int64)
        here = np.flatnonzero(np.diff(self.at))
        if len(here):
            self.most[here] = np.maximum.reduceat(self.gain, self.at[here])
        self.bits = np.zeros((terms, -(-len(ids) // 8)), np.uint8)
        at = self.doc
        np.bitwise_or.at(self.bits, (term[order], at >> 3), (128 >> (at & 7)).astype(np.uint8))

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents."""
        out = np.zeros(len(docs), np.int64)
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            lo, hi = self.at[t], self.at[t + 1]
            there = self.doc[lo:hi]
            place = np.searchsorted(there, docs)
            place[place == hi - lo] = 0
            hit = there[place] == docs
            out[hit] += w * self.gain[lo:hi][place[hit]]
        return out

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, heap: list) -> None:
        """Merge the block's best documents for an item into ``heap`` of at most k (score, -doc_id)."""
        here = self.at[terms + 1] > self.at[terms]
        terms, weights = terms[here], weights[here]
        if not len(terms):
            return
        # No document gets more than all terms give at most.
        if len(heap) == k and int((weights * self.most[terms]).sum()) < heap[0][0]:
            return
        flags, order, begins = _masks(self.bits[terms], len(self.ids))
        bound = flags @ (weights * self.most[terms])
        ranked = np.argsort(-bound, kind="stable")
        ranked = ranked[bound[ranked] > 0]
        sizes = np.diff(begins)[ranked]
        ends = np.cumsum(sizes)
        done, step = 0, FIRST_DOCS
        while done < len(ranked):
            if len(heap) == k and bound[ranked[done]] < heap[0][0]:
                return
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + step, "right")))
            if len(heap) == k:
                # Bounds descend, so masks that cannot reach the last of the best are left out.
                upto = max(done + 1, min(upto, int(np.searchsorted(-bound[ranked], -heap[0][0], "right"))))
            docs = np.sort(np.concatenate([order[begins[g] : begins[g + 1]] for g in ranked[done:upto].tolist()]))
            score = self.scores(docs, terms, weights)
            keep = score > 0
            if len(heap) == k:
                keep &= score >= heap[0][0]
            docs, score = docs[keep], score[keep]
            if len(docs) > k:
                last = np.partition(score, len(score) - k)[len(score) - k]
                docs, score = docs[score >= last], score[score >= last]
            for s, d in zip(score.tolist(), self.ids[docs].tolist(), strict=True):
                if len(heap) < k:
                    heapq.heappush(heap, (s, -d))
                elif (s, -d) > heap[0]:
                    heapq.heapreplace(heap, (s, -d))
            done, step = upto, step * 2


def _search(items: list[tuple[int, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """(doc_id, n, terms, tfs) to (item, doc_id, score): the best of each item in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                terms, tfs = part.column(2), part.column(3)
                sizes = np.diff(terms.offsets.to_numpy())
                m = 50 + (50 * part.column(1).to_numpy() * n_docs) // n_terms
                # flatten() keeps to the slice.
                block = Block(part.column(0).to_numpy(), m, np.repeat(np.arange(part.num_rows), sizes), terms.flatten().to_numpy(), tfs.flatten().to_numpy(), len(weight))
                for item, own in items:
                    block.best(own, weight[own], k, heaps.setdefault(item, []))
        found = [(i, -d, s) for i, h in heaps.items() for s, d in h]
        for lo in range(0, len(found), 100_000):
            part = found[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in part], pa.int64()) for j in range(3)], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", pass_terms: int | None = None) -> DataFrame:
    """(item_col, rank, doc_id, score): the k documents of highest score above 0 for each row of ``items``.

    Equal scores go by ascending identifier. All documents are read whole and
    searched; null, empty and termless texts are no documents and no items.
    Every row of ``docs`` is a document of its own, so a repeated row takes ranks
    of its own, next to its equal; rows of a null identifier are left out of the
    ranking but count for N, L and df. Equal rows of ``items`` are searched
    once; rows of one identifier and different texts give a ranking each; a null
    identifier is kept. Other columns are not read. Empty tables give no rows.

    The items' terms go to the tasks in passes of about ``pass_terms``; a pass
    holds whole items, chosen by a hash.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.array_distinct(words_of(F.col(f"`{item_text}`"))).alias("terms")).where("size(terms) > 0").distinct()
    asked = materialise(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    total = asked.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    passes = max(1, -(-total // (pass_terms or PASS_TERMS)))
    out = None
    for i in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == i)
        best = _pass(spark, docs, mine.select("item", "terms"), k)
        out = best if out is None else out.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select(F.col("item_id").alias(item_col), "rank", "doc_id", "score")


def _pass(spark, docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score): the best of each partition for items that fit a pass."""
    found = [(r.item, r.terms) for r in items.collect()]
    terms = sorted({t for _, own in found for t in own})
    number = {t: i for i, t in enumerate(terms)}
    own = [(i, np.array(sorted(number[t] for t in x), np.int64)) for i, x in found]
    coded = spark.sparkContext.broadcast({t.encode("utf-8", "surrogatepass"): i for t, i in number.items()})
    with arrow_rows(spark, 2000):
        cut = materialise(docs.mapInArrow(lambda b: _cut(coded.value)(b), "doc_id long, n long, terms array<int>, tfs array<long>"), "postings")
    n_docs, n_terms = cut.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs or not terms:
        return spark.createDataFrame([], "item long, doc_id long, score long")
    weight = np.full(len(terms), math.floor(1000 * math.log(2.0 * n_docs + 2)), np.int64)
    for r in cut.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        weight[r.t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    sent = spark.sparkContext.broadcast((own, weight))
    with arrow_rows(spark, BLOCK_DOCS):
        return materialise(cut.where("doc_id is not null").mapInArrow(lambda b: _search(*sent.value, n_docs, n_terms, k)(b), "item long, doc_id long, score long"), "best-of-parts")
