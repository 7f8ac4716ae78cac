"""Audit of how far the sources of a language diverge in their words, by frequent-pattern trees of term rows.

A term's row lists the sources that have it, in source order, with what each
gives it. Most of the pairs of a language's sources see a term that both, or all
but one, of them lack; so a pair's sum over all terms starts from the value that
two absent counts give, takes a correction for each source and count by itself,
and one for each two counts of one row. The last are found on a tree of the
rows: rows with equal beginnings share their nodes, a node carries how many rows
pass through it, and each node meets each of its ancestors once. Rows are sorted, so
the lines of a tree lie together and it is read off them depth by depth. Trees
are built of ranges of the rows, and sums over trees are plain integer sums, so
no tree has to be whole.

Values are integers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and
f(p, q) = floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.session import arrow_rows, materialise

#: Entries of counts that a task holds before it hands them on.
HELD_COUNTS = 500_000
#: Rows of a tree at most.
TREE_ROWS = 4096
#: Rows of groups that are broadcast at most; beyond it both sides are shuffled.
BROADCAST_ROWS = 100_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) of a partition's documents, summed as far as memory is given."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out():
        for (lang, source), (n, df) in seen.items():
            terms = list(n)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array([t.decode() for t in terms], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "df"])

    for batch in batches:
        for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = _TERM.findall(text.encode("utf-8", "surrogatepass").lower())
            n, df = seen.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(words)
            df.update(set(words))
            held += len(n) - before
            if held > HELD_COUNTS:
                yield from out()
                seen, held = {}, 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term in each group of ``docs`` (text, lang, source)."""
    made = docs.mapInArrow(_count, "lang string, source string, term string, n long, df long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def smoothed(count: Column, total: Column, terms: Column) -> Column:
    """p of a count; in decimals, as the product leaves 64 bits for very large counts."""
    up = (count + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", up, (total + 2 * terms).cast("decimal(20,0)")) + 1


def difference(p: Column, q: Column) -> Column:
    """f(p, q), in whole numbers."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def corrections(numbers: np.ndarray, p: np.ndarray, p0: np.ndarray, rows: np.ndarray, sources: int) -> tuple[np.ndarray, np.ndarray]:
    """What each two sources have in common on the tree of some rows in order: (a * sources + b, value).

    A line of the three matrices is a path, with the number -1 after its end; ``rows``
    tells how many rows have it. Where a line leaves the line before, its nodes
    begin; a node's rows are those of the lines up to where its depth is left again.
    """
    differs = (numbers[1:] != numbers[:-1]) | (p[1:] != p[:-1])
    left_at = np.concatenate(([0], np.where(differs.any(1), differs.argmax(1), numbers.shape[1])))
    keys, values = np.empty(0, np.int64), np.empty(0, np.int64)
    for d in range(1, numbers.shape[1]):
        begins = np.flatnonzero(left_at <= d)
        passed = np.add.reduceat(rows, begins)
        there = numbers[begins, d] >= 0
        at, n = begins[there], passed[there]
        # All ancestors of the nodes of a depth at once; what is summed by then goes in again.
        q, q0 = p[at, d, None], p0[at, d, None]
        u, u0 = p[at, :d], p0[at, :d]
        part = n[:, None] * (_f(u, q) - _f(u, q0) - _f(u0, q) + _f(u0, q0))
        pair = numbers[at, :d] * sources + numbers[at, d, None]
        keys, place = np.unique(np.concatenate((keys, pair.ravel())), return_inverse=True)
        values, before = np.zeros(len(keys), np.int64), values
        np.add.at(values, place, np.concatenate((before, part.ravel())))
    return keys, values


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value): corrections of each two sources that rows (lang, path, rows) have in common.

    Rows come in the order of their language and path; those of a batch and a
    language are one tree. A path's elements are (source, p, p of an absent count).
    """
    for batch in batches:
        langs, paths, rows = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_numpy()
        bounds = paths.offsets.to_numpy()
        sid, p, p0 = (paths.values.field(i).to_numpy() for i in range(3))
        ends = [i for i in range(1, len(langs)) if langs[i] != langs[i - 1]]
        for lo, hi in zip([0, *ends], [*ends, len(langs)], strict=True):
            sizes = np.diff(bounds[lo : hi + 1])
            if not len(sizes):
                continue
            part = slice(bounds[lo], bounds[hi])
            known, number = np.unique(sid[part], return_inverse=True)
            line = np.repeat(np.arange(hi - lo), sizes)
            place = np.arange(len(line)) - np.repeat(bounds[lo:hi] - bounds[lo], sizes)
            wide = np.full((3, hi - lo, int(sizes.max())), -1, np.int64)
            for m, v in zip(wide, (number, p[part], p0[part]), strict=True):
                m[line, place] = v
            pair, value = corrections(*wide, rows[lo:hi], len(known))
            a, b = np.divmod(pair, len(known))
            yield pa.RecordBatch.from_arrays([pa.array([langs[lo]] * len(a), pa.string()), pa.array(known[a], pa.int64()), pa.array(known[b], pa.int64()), pa.array(value, pa.int64())], names=["lang", "a", "b", "value"])


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group of a language and a source of ``docs`` (text, lang, source).

    A language keeps the terms that at least ``least_docs`` of its documents
    have. Part ``pair``: each other source of the language with the divergence
    over all kept terms. Part ``term``: the ``top`` kept terms that the group
    has and that it has more of than the language, by their share.

    Null text, language and source are empty strings, and a group of its own;
    empty texts and those without letters make a group without terms, which is
    compared like any other. A language without kept terms has pairs of value 0.
    Very long texts are counted whole, repeated rows each time, a table without
    rows gives none, and further columns are not read. A language with one source has no pairs.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(blank("text"), blank("lang"), blank("source"))
    counts = materialise(term_counts(docs), "term-counts")
    # One row for each term of a language; the document counts of sources add up, as a document has one source.
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("of")).where(F.col("df") >= least_docs)
    rows = materialise(kept.drop("df"), "term-rows")
    cells = rows.select("lang", "term", "all", F.explode("of").alias("e")).select("lang", "term", "all", "e.source", "e.n")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    # Numbers follow the order of the sources within each language; the rows are groups, not documents.
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    p0 = F.when(F.col("terms") > 0, smoothed(F.lit(0), F.col("total"), F.col("terms")))
    groups = materialise(groups.select("*", number.alias("sid"), p0.alias("p0")), "groups")
    placed = cells.join(_bounded(groups), ["lang", "source"]).withColumn("p", smoothed(F.col("n"), F.col("total"), F.col("terms")))
    placed = materialise(placed.select("lang", "term", "source", "sid", "n", "p", "p0", smoothed(F.col("all"), F.col("lang_total"), F.col("terms")).alias("q")), "cells")

    # Rows that are equal become one with their number before they are dealt out by range of path.
    path = placed.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("sid", "p", "p0"))).alias("path"))
    same = path.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("rows"))
    both = _pairs_of_rows(same)
    alone = placed.groupBy("lang", "sid", "p", "p0").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("sid", "a")
    other = _bounded(groups.select("lang", F.col("sid").alias("b"), F.col("p0").alias("q0")))
    single = alone.join(other, "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("rows") * (difference(F.col("p"), F.col("q0")) - difference(F.col("p0"), F.col("q0")))).alias("value"))
    turned = lambda d: d.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    parts = single.unionByName(turned(single)).unionByName(both).unionByName(turned(both)).groupBy("lang", "a", "b").agg(F.sum("value").alias("part"))
    mine = groups.select("lang", "source", "terms", "p0", F.col("sid").alias("a"))
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("sid").alias("b"))
    pairs = mine.join(_bounded(theirs), "lang").where("a <> b").join(parts, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("terms") * difference(F.col("p0"), F.col("q0")) + F.coalesce("part", F.lit(0)), F.lit(0))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(order))
    more = placed.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(more)


def _pairs_of_rows(same: DataFrame) -> DataFrame:
    """(lang, a, b, value) of the trees of ``same`` (lang, path, rows); a path that holds one source meets nothing."""
    n = int(same.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(same.where("size(path) > 1"), "paths").repartitionByRange(n, "lang", "path").sortWithinPartitions("lang", "path")
    found = dealt.mapInArrow(_walk, "lang string, a long, b long, value long")
    with arrow_rows(same.sparkSession, TREE_ROWS):
        return materialise(found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "corrections")
