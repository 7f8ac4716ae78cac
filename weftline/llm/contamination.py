"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions only.

Test items are cut into windows of adjoining words. The corpus frequency of
every test term, counted over all documents, ranks each window's terms; its two
rarest are its anchors. The index holds the postings (term, document, position)
of all anchor terms in the whole corpus, each with the words around it. A
window is looked up from its rarest term: the postings, moved by the term's
place in the window, are the places where the window may start, and they are
intersected with the moved list of the second rarest term; the words kept with
the posting then confirm the phrase word by word, or its words in any order
within a few words more (proximity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.session import materialise

#: Windows and terms of the test items that are broadcast at most; beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters beyond ASCII that ``lower`` changes, which must keep their case.
_CASED = r"[\P{ASCII}&&[\p{Lu}\p{Lt}\x{2160}-\x{216F}\x{24B6}-\x{24CF}]]"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and all else kept; the slower ``translate`` runs only where ``lower`` would do more."""
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(_CASED)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """The words of a text: runs of digits, letters a-z and characters beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), _GAP), "")


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows_of(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(wid, words, n, items): each distinct window once, with all items that have it."""
    w = items.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1)))
    one = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(size)))).alias("words"))
    per = one.groupBy("words").agg(F.collect_set("item").alias("items"))
    return per.select(F.xxhash64("words").alias("wid"), "words", F.size("words").alias("n"), "items")


class PositionalIndex:
    """The postings of the anchor terms of a set of windows, over all ``words`` (key, w).

    Rows are told apart by the key, not by their identifier. Each posting of a
    leading term keeps ``reach`` - 1 words on either side.
    """

    def __init__(self, words: DataFrame, windows: DataFrame, reach: int):
        self.reach = reach
        self.words = words
        terms = windows.select(F.explode("words").alias("term")).distinct()
        token = self.words.select(F.explode("w").alias("term"))
        if terms.count() <= BROADCAST_ROWS:
            token = token.join(F.broadcast(terms), "term")
        # Tokens are counted before what is left meets the terms, so a frequent one is no large group.
        seen = token.groupBy("term").agg(F.count(F.lit(1)).alias("f"))
        self.frequency = materialise(terms.join(seen, "term", "left").select("term", F.coalesce("f", F.lit(0)).alias("f")), "term-counts")
        place = windows.select("wid", F.posexplode("words").alias("at", "term")).join(_bounded(self.frequency), "term")
        order = Window.partitionBy("wid").orderBy("f", "term", "at")
        ranked = place.withColumn("r", F.row_number().over(order))
        first = ranked.where("r = 1").select("wid", F.col("term").alias("t1"), F.col("at").alias("o1"), "f")
        second = ranked.where("r = 2").select("wid", F.col("term").alias("t2"), F.col("at").alias("o2"))
        # A window with a term that no document has cannot occur.
        self.anchors = materialise(first.where("f > 0").drop("f").join(second, "wid", "left").join(windows, "wid"), "anchors")
        both = self.anchors.select(F.col("t1").alias("term"), F.lit(True).alias("lead")).union(self.anchors.where("t2 is not null").select("t2", F.lit(False)))
        anchor_terms = materialise(both.groupBy("term").agg(F.max("lead").alias("lead")), "anchor-terms")
        near = F.slice("w", F.greatest(F.col("at") + 2 - reach, F.lit(1)), F.lit(reach) + F.least(F.col("at"), F.lit(reach - 1)))
        if anchor_terms.count() <= BROADCAST_ROWS:
            spread = self.words.select("key", "w", F.posexplode("w").alias("at", "term")).join(F.broadcast(anchor_terms), "term")
            spread = spread.select("term", "key", "at", F.when(F.col("lead"), near).alias("near"))
        else:
            # Tokens are shuffled without their texts; each text meets its own leading postings once.
            places = materialise(self.words.select("key", F.posexplode("w").alias("at", "term")).join(anchor_terms, "term"), "places")
            lead = places.where("lead").groupBy("key").agg(F.collect_list(F.struct("term", "at")).alias("leads"))
            spread = self.words.join(lead, "key").select("key", "w", F.inline("leads")).select("term", "key", "at", near.alias("near"))
            spread = spread.unionByName(places.where("not lead").select("term", "key", "at", F.lit(None).cast("array<string>").alias("near")))
        self.postings = materialise(spread, "postings")

    def starts(self) -> DataFrame:
        """(key, wid, start, near, before, ...): moved postings of each window's rarest term that meet the second's."""
        lead = self.postings.where("near is not null").join(_bounded(self.anchors), F.col("term") == F.col("t1"))
        lead = lead.withColumn("start", F.col("at") - F.col("o1")).withColumn("before", F.least("at", F.lit(self.reach - 1))).where("start >= 0")
        single = lead.where("t2 is null")
        also = self.postings.select(F.col("term").alias("t2"), "key", F.col("at").alias("at2"))
        pair = lead.where("t2 is not null").withColumn("at2", F.col("start") + F.col("o2"))
        # One posting at most has a term, a row and a position, so the join only removes rows.
        both = pair.join(also, ["key", "t2", "at2"], "left_semi")
        return single.unionByName(both.select(single.columns))

    def phrases(self) -> DataFrame:
        """(key, wid, start, n): each occurrence of each window, word for word."""
        at = F.col("before") - F.col("o1") + 1
        same = (at >= 1) & (F.slice("near", F.greatest(at, F.lit(1)), F.col("n")) == F.col("words"))
        return self.starts().where(same).select("key", "wid", "start", "n")

    def proximities(self, slack: int) -> DataFrame:
        """(key, wid, at): places of a window's rarest term with all its words within ``n + slack`` words around.

        ``reach`` must be the longest window and the slack at least.
        """
        lead = self.postings.where("near is not null").join(_bounded(self.anchors), F.col("term") == F.col("t1"))
        before = F.least("at", F.lit(self.reach - 1))
        spans = F.sequence(F.greatest(before + 2 - F.col("n") - slack, F.lit(1)), before + 1)
        inside = F.exists(spans, lambda i: F.size(F.array_except("words", F.slice("near", i, F.col("n") + slack))) == 0)
        return lead.where(inside).select("key", "wid", "at")


def find(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None, slack: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: n_words, n_hit, n_items, item_ids and contaminated.

    A window is ``size`` adjoining words of an item, or all its words if it has
    fewer; a word inside any occurrence of a window is hit. ``item_ids`` are the
    items with occurring windows, as strings in order. With ``slack`` there is
    also near_ids, the items of which some window has all its words, in any
    order, within its length and ``slack`` more words of the document.
    Null texts have no words; very long texts are read whole; items of a null
    identifier hit words but are not named. Rows of a repeated or null
    identifier, and equal rows, keep a row each. Columns of ``docs`` in ``keep``
    (all by default) stay, but for these names; empty tables on either side give
    rows without hits.
    """
    made = ["n_words", "n_hit", "n_items", "item_ids", "contaminated", *(["near_ids"] if slack is not None else [])]
    kept = [c for c in (keep or docs.columns) if c not in made]
    windows = materialise(windows_of(items, item_col, item_text, size), "windows")
    # Texts are cut into words once; a row's number is given when the table is written. Names of one's own keep columns apart.
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    base = materialise(docs.select(*own, words_of(F.col(f"`{text_col}`")).alias("w"), F.monotonically_increasing_id().alias("key")), "words")
    index = PositionalIndex(base.select("key", "w"), windows, size + (slack or 0))
    hits = materialise(index.phrases().distinct(), "phrases")
    before = Window.partitionBy("key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    spans = hits.groupBy("key", "start").agg(F.max("n").alias("n")).withColumn("end", F.col("start") + F.col("n"))
    count = spans.withColumn("new", new).groupBy("key").agg(F.sum("new").cast("long").alias("n_hit"))

    def named(found: DataFrame, name: str) -> DataFrame:
        one = found.join(_bounded(windows.select("wid", "items")), "wid").select("key", F.explode("items").alias("item")).distinct()
        return one.groupBy("key").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias(name))

    found = count.join(named(hits, "item_ids"), "key", "left")
    if slack is not None:
        found = found.join(named(index.proximities(slack).select("key", "wid").distinct(), "near_ids"), "key", "full")
    out = base.withColumn("n_words", F.size("w").cast("long")).join(_bounded(materialise(found, "contaminated")), "key", "left")
    none = F.array().cast("array<string>")
    return out.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *([F.coalesce("near_ids", none).alias("near_ids")] if slack is not None else []),
    )
