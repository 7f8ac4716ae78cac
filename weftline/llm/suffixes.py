"""Removal of repeated byte strings, by a common-prefix-aware distributed merge sort of suffixes.

A byte goes when it lies in a string of ``length`` bytes that also starts
anywhere else. Whether a string repeats is told by suffixes that start at
anchors: of the ``length`` - GRAM + 1 places where a gram of GRAM bytes starts
inside the string, the one of least hash, the first of equals. Equal strings
have their anchors at the same place, so a string's repeats are among the
suffixes that begin with the same gram. An entry is an anchor with all strings
that it is the anchor of: the bytes from the anchor on, and the bytes before it,
read backwards.

1. Each task cuts its texts into entries' positions; grams that occur once in
   the corpus fall out by a count.
2. Each task sorts the entries of its texts to runs. Equal entries of a run
   are one, with the places kept beside; a run goes out in ranges between
   splitters of GRAM bytes, front-coded: the length of the prefix that an entry
   shares with the one before, and the rest.
3. Each range merges its runs by a loser tree that keeps with each loser the
   length of the prefix it shares with the winner: unequal lengths decide
   without a look at the bytes, equal ones are compared from there on. The merge
   leaves the shared prefixes of neighbours in the order of all suffixes, which
   is the range's part of the suffix array with its LCP array.
4. A string that starts ``a`` bytes before the anchor repeats if two entries
   share ``length - a`` bytes from the anchor on and ``a`` bytes before it. Both
   are classes of neighbours in a sorted order, cut where the shared length is
   less; a pair of classes that occurs twice is a repeat.

Entries of a gram that occurs more than HOT times are not compared as entries,
which must meet by gram, but string by string: a suffix of ``length`` bytes for
each of their strings, equal ones once for each run, dealt out by hash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from weftline.llm.shingles import mix
from weftline.session import arrow_rows, discard, materialise

#: Bytes of a gram, at most half of the strings' length.
GRAM = 100
#: Bytes that are hashed at a time, below 2**20.
PIECE = 1 << 19
#: Bytes of distinct entries that a task holds before it closes a run.
RUN_BYTES = 24 << 20
#: Entries of a range, as counted before equal ones are put together.
RANGE_ENTRIES = 60_000
#: Occurrences of a gram beyond which its entries are compared string by string.
HOT = 50_000
#: Grams that are read at most to find the splitters.
SAMPLE = 20_000
_U = np.uint64
_PLACE = (1 << 20) - 1
_RNG = np.random.Generator(np.random.PCG64(20250611))
_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_STEP, PIECE + 1), _powers(pow(_STEP, -1, 2**64), PIECE + 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram of at most PIECE bytes, from running sums."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * _UP[: len(data)], out=sums[1:])
        return mix((sums[gram:] - sums[:-gram]) * _DOWN[: len(data) - gram + 1])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` adjoining values."""
    n = len(x) - width + 1
    rows = np.concatenate((x, np.full(-len(x) % width, ~_U(0)))).reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash of the gram, anchor, first start, last start) of all strings of texts that lie one after the other in ``data``."""
    width, at = length - gram + 1, 0
    while at + length <= len(data):
        piece = data[at : at + PIECE]
        h = gram_hashes(piece, gram)
        place = np.arange(len(h), dtype=np.uint64)
        anchor = (_sliding_least((h & ~_U(_PLACE)) | place, width) & _U(_PLACE)).astype(np.int64)
        n = len(anchor)
        start = np.arange(at, at + n)
        inside = start + length <= ends[np.searchsorted(ends, start, "right")]
        new = inside.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        last = inside.copy()
        last[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
        first = np.flatnonzero(new)
        yield h[anchor[first]].view(np.int64), anchor[first] + at, first + at, np.flatnonzero(last) + at
        at += n


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _positions(length: int, gram: int, keys: int):
    """(keys, text) to (keys, m, p, lo, hi, head): entries by place; the gram itself goes along with one hash in 256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [_raw(t) for t in batch.column(keys).to_pylist()]
            ends = np.cumsum([len(r) for r in raw])
            data = b"".join(raw)
            for m, p, lo, hi in anchors(np.frombuffer(data, np.uint8), ends, length, gram):
                doc = np.searchsorted(ends, p, "right")
                off = np.concatenate(([0], ends))[doc]
                heads = [data[i : i + gram] if h & 255 == 0 else None for i, h in zip(p.tolist(), m.tolist(), strict=True)]
                own = [batch.column(i).take(pa.array(doc)) for i in range(keys)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(m), *(pa.array((x - off).astype(np.int32)) for x in (p, lo, hi)), pa.array(heads, pa.binary())], names=[*(f"k{i}" for i in range(keys)), "m", "p", "lo", "hi", "head"])

    return run


def shared(x: bytes, y: bytes, since: int) -> int:
    """The length of the common prefix, known to be ``since`` at least."""
    n = min(len(x), len(y))
    if since == n or x[since] != y[since]:
        return since
    odd = int.from_bytes(x[since:n]) ^ int.from_bytes(y[since:n])
    return n - -(-odd.bit_length() // 8)


def _shared_of_neighbours(strings: list[bytes], width: int) -> np.ndarray:
    """How long a prefix each string shares with the one before; 0 for the first."""
    out = np.zeros(len(strings), np.int64)
    for at in range(1, len(strings), 4096):
        part = strings[at - 1 : at + 4096]
        sizes = np.array([len(s) for s in part])
        rows = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in part), np.uint8).reshape(-1, width)
        odd = rows[1:] != rows[:-1]
        first = np.where(odd.any(1), odd.argmax(1), width)
        out[at : at + len(part) - 1] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def front_code(entries: list[tuple], width: int) -> bytes:
    """Sorted entries (suffix, back, number, shift, many) as one string of bytes."""
    same = _shared_of_neighbours([e[0] for e in entries], width)
    rests = [e[0][k:] for e, k in zip(entries, same.tolist(), strict=True)]
    head = np.array([len(entries)], np.int64).tobytes()
    fields = [same, [len(r) for r in rests], [len(e[1]) for e in entries], [e[2] for e in entries], [e[3] for e in entries], [e[4] for e in entries]]
    return zlib.compress(head + b"".join(np.array(f, np.int32).tobytes() for f in fields) + b"".join(rests) + b"".join(e[1] for e in entries), 1)


def front_decode(block: bytes) -> Iterator[tuple]:
    """(shared with the one before, suffix, back, number, shift, many), in order."""
    data = zlib.decompress(block)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    same, rest, back, number, shift, many = np.frombuffer(data, np.int32, 6 * n, 8).reshape(6, n).tolist()
    at = 8 + 24 * n
    behind = at + sum(rest)
    suffix = b""
    for k, r, b, i, s, d in zip(same, rest, back, number, shift, many, strict=True):
        suffix = suffix[:k] + data[at : at + r]
        at += r
        yield k, suffix, data[behind : behind + b], i, s, d
        behind += b


class LoserTree:
    """Merges sorted streams of (shared with the one before, string, ...) without comparing a known prefix again.

    ``heads[s]`` is a stream's next entry and ``known[s]`` the prefix it shares
    with the last entry that came out. A node keeps the loser of its match; on
    the way up all known prefixes are with the same winner, so the longer one is the lesser string.
    """

    def __init__(self, streams: list[Iterator[tuple]]):
        self.streams = streams
        self.size = 1 << max(0, len(streams) - 1).bit_length()
        self.heads = [next(s, None) for s in streams] + [None] * (self.size - len(streams))
        self.known = [0] * self.size
        self.losers = [0] * self.size
        self.top = self._build(1) if self.size > 1 else 0

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._second(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def _second(self, a: int, b: int) -> bool:
        """Whether b wins; the loser's known prefix becomes that with the winner."""
        x, y, known = self.heads[a], self.heads[b], self.known
        if y is None:
            return False
        if x is None:
            return True
        if known[a] != known[b]:
            return known[a] < known[b]
        x, y = x[1], y[1]
        k = shared(x, y, known[a])
        if k < len(y) and (k == len(x) or x[k] < y[k]) or k == len(x) == len(y):
            known[b] = k
            return False
        known[a] = k
        return True

    def __iter__(self) -> Iterator[tuple[int, int, tuple]]:
        """(stream, shared with the entry before, entry) in order."""
        heads, known, losers = self.heads, self.known, self.losers
        while (entry := heads[self.top]) is not None:
            s = self.top
            yield s, known[s], entry
            heads[s] = e = next(self.streams[s], None)
            known[s] = e[0] if e else 0
            node = (s + self.size) >> 1
            while node:
                o = losers[node]
                # Unequal known prefixes, the common case, are told here.
                y = heads[o]
                if y is not None and (heads[s] is None or (known[s] < known[o] if known[s] != known[o] else self._second(s, o))):
                    s, losers[node] = o, s
                node >>= 1
            self.top = s


def _runs(length: int, keys: int, splitters: list[bytes], ranges: int, hot_ranges: int):
    """(keys, text, entries) to rows of two kinds: blocks of runs by range, and the places of the entries of runs."""
    def close(run: int, found: dict, places: list, types: list) -> Iterator[pa.RecordBatch]:
        # (range, suffix, back, number, shift, many)
        entries, hot = [], []
        for (forward, back, is_hot), (number, many) in found.items():
            if not is_hot:
                entries.append((forward, back, number, 0, many))
                continue
            whole, a_last = back[::-1] + forward, len(back)
            for a in range(length - len(forward), a_last + 1):
                s = whole[a_last - a : a_last - a + length]
                hot.append((ranges + zlib.crc32(s) % hot_ranges, s, b"", number, a, many))
        entries.sort()
        hot.sort()
        blocks, at = [], 0
        cut = [bisect_right(splitters, e[0][: len(splitters[0])]) for e in entries] if splitters else [0] * len(entries)
        while at < len(entries):
            to = bisect_right(cut, cut[at])
            blocks.append((cut[at], front_code(entries[at:to], length)))
            at = to
        at = 0
        while at < len(hot):
            to = at
            while to < len(hot) and hot[to][0] == hot[at][0]:
                to += 1
            blocks.append((hot[at][0], front_code([e[1:] for e in hot[at:to]], length)))
            at = to
        n, m = len(blocks), len(places)
        columns = [[b[0] for b in blocks] + [None] * m, [run] * (n + m), [b[1] for b in blocks] + [None] * m, [None] * n + [x[0] for x in places], [None] * n + [x[1] for x in places]]
        made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)]
        own = [pa.array([None] * n + [x[2][i] for x in places], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([*made, *own], names=["part", "run", "block", "entry", "p", *(f"k{i}" for i in range(keys))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, found, places, held = TaskContext.get().partitionId() << 32, {}, [], 0
        for batch in batches:
            types = [batch.column(i).type for i in range(keys)]
            own = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
            entries = batch.column(keys + 1)
            bounds = entries.offsets.to_pylist()
            flat = [entries.values.field(i).to_pylist() for i in range(4)]
            for key, text, lo_e, hi_e in zip(own, batch.column(keys).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                data = _raw(text)
                for p, lo, hi, is_hot in zip(*(f[lo_e:hi_e] for f in flat), strict=True):
                    forward, back = data[p : hi + length], data[lo:p][::-1]
                    entry = (forward, back, is_hot)
                    e = found.get(entry)
                    if e is None:
                        found[entry] = e = [len(found), 0]
                        held += len(forward) + len(back) + 200 + is_hot * (length - len(forward) + len(back) + 1) * length
                    else:
                        e[1] = 1
                    places.append((e[0], p, key))
                    held += 100
                if held > RUN_BYTES:
                    yield from close(run, found, places, types)
                    run, found, places, held = run + 1, {}, [], 0
        if found:
            yield from close(run, found, places, types)

    return work


def repeats(same: np.ndarray, sizes: np.ndarray, backs: list[bytes], many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted entries, the least and greatest bytes before the anchor at which a repeated string starts; -1 without one.

    ``same`` is the prefix each shares with the one before, ``sizes`` the bytes from the anchor on.
    """
    n = len(same)
    least, most = length - sizes, np.array([len(b) for b in backs], np.int64)
    low, high = np.where(many, least, length), np.where(many, most, -1)
    order = np.array(sorted(range(n), key=backs.__getitem__), np.int64)
    before = _shared_of_neighbours([backs[i] for i in order.tolist()], max(1, int(most.max(initial=0))))
    for a in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        mine = np.flatnonzero((least <= a) & (a <= most))
        ahead = np.cumsum(same < length - a)
        behind = np.empty(n, np.int64)
        behind[order] = np.cumsum(before < a)
        pair = ahead[mine] * (n + 1) + behind[mine]
        by = np.argsort(pair, kind="stable")
        twice = pair[by[1:]] == pair[by[:-1]]
        hit = mine[np.union1d(by[1:][twice], by[:-1][twice])]
        low[hit], high[hit] = np.minimum(low[hit], a), np.maximum(high[hit], a)
    return np.where(high < 0, -1, low), high


def _merge(length: int):
    """The runs of a range (part, run, block) to (run, entry, low, high) of the entries with a repeat."""

    def work(table: pa.Table) -> pa.Table:
        names, blocks = table.column("run").to_pylist(), table.column("block").to_pylist()
        runs, same, sizes, backs, numbers, shifts, many = [], [], [], [], [], [], []
        for s, k, (_, suffix, back, number, shift, d) in LoserTree([front_decode(b) for b in blocks]):
            runs.append(names[s])
            same.append(k)
            sizes.append(len(suffix))
            backs.append(back)
            numbers.append(number)
            shifts.append(shift)
            many.append(d)
        low, high = repeats(np.array(same), np.array(sizes), backs, np.array(many, bool), length)
        hit = np.flatnonzero(high >= 0)
        add = np.array(shifts)[hit]
        return pa.table({"run": pa.array(np.array(runs)[hit], pa.int64()), "entry": pa.array(np.array(numbers)[hit], pa.int32()), "low": pa.array(low[hit] + add, pa.int32()), "high": pa.array(high[hit] + add, pa.int32())})

    return work


def _remove(kept: int):
    """(columns, text, spans) to (columns, n_bytes, n_removed, n_spans, kept_bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(kept).to_pylist(), batch.column(kept + 1).to_pylist(), strict=True):
                data, out, at, gone, n = _raw(text), [], 0, 0, 0
                end = -1
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if lo > end:
                        out.append(data[at:lo])
                        n += 1
                        gone += hi - lo
                    elif hi > end:
                        gone += hi - end
                    end = at = max(end, hi)
                out.append(data[at:])
                rows.append((len(data), gone, n, b"".join(out)))
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), *made], names=[*(f"c{i}" for i in range(kept)), "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    return work


def remove_repeats(docs: DataFrame, length: int = 200, text_col: str = "text", keep: list[str] | None = None, key: list[str] | None = None, gram: int | None = None, hot: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: n_bytes, n_removed, n_spans and kept_bytes, the text without its repeated strings.

    A string of ``length`` UTF-8 bytes is repeated if it starts at another place
    too, in the same row or another; all of its bytes go, and strings are judged
    on the input alone. ``n_spans`` counts the maximal runs of removed bytes.
    ``kept_bytes`` may cut a character in two, as strings are of bytes.

    Null and empty texts, and those shorter than ``length``, lose nothing; equal
    rows are places of their own, so texts of at least ``length`` bytes that
    occur twice go wholly; very long texts are read in pieces. Columns of
    ``docs`` in ``keep`` (all by default) stay, but for these names. An empty
    table gives no rows. ``key`` names columns that tell rows apart and come out
    the same when ``docs`` is read again; without it the rows are numbered in a written copy.
    """
    spark = docs.sparkSession
    gram = min(gram or GRAM, length)
    hot = HOT if hot is None else hot
    made = ["n_bytes", "n_removed", "n_spans", "kept_bytes"]
    kept = [c for c in (keep or docs.columns) if c not in made]
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    if key:
        base = docs.select(*own, F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)))
    else:
        base = materialise(docs.select(*own, F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("k0")), "texts")
    ks = [c for c in base.columns if c[0] == "k"]
    fields = [T.StructField(c, base.schema[c].dataType) for c in ks]
    long = F.octet_length("text") >= length
    texts = base.select(*ks, "text").where(long)
    with arrow_rows(spark, 1000):
        found = texts.mapInArrow(_positions(length, gram, len(ks)), T.StructType([*fields, *(T.StructField(n, t) for n, t in (("m", T.LongType()), ("p", T.IntegerType()), ("lo", T.IntegerType()), ("hi", T.IntegerType()), ("head", T.BinaryType())))]))
        found = materialise(found, "anchors")
        again = materialise(found.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.max("head").alias("head")).where("n > 1"), "repeated-grams")
        total, hot_total, heads = again.agg(F.sum("n"), F.sum(F.when(F.col("n") > hot, F.col("n"))), F.count("head")).first()
        ranges, hot_ranges = max(1, (total or 0) // RANGE_ENTRIES), max(1, (hot_total or 0) // (RANGE_ENTRIES // 10))
        share = max(1, -(-heads // SAMPLE))
        sample = [bytes(r.head) for r in again.where(F.col("head").isNotNull() & (F.pmod(F.shiftright("m", 8), F.lit(share)) == 0)).select("head").collect()]
        sample.sort()
        splitters = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
        places = found.drop("head").join(again.select("m", (F.col("n") > hot).alias("hot")), "m")
        # Written by itself, so that neither anchors nor their shuffle are on disk beside the shuffle of the texts.
        by_text = materialise(places.groupBy(*ks).agg(F.collect_list(F.struct("p", "lo", "hi", "hot")).alias("entries")), "entries")
        discard(found, again)
        runs = texts.join(by_text, ks).select(*ks, "text", "entries")
        schema = T.StructType([*(T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("run", T.LongType()), ("block", T.BinaryType()), ("entry", T.IntegerType()), ("p", T.IntegerType()))), *fields])
        runs = materialise(runs.mapInArrow(_runs(length, len(ks), splitters, len(splitters) + 1, hot_ranges), schema), "runs")
        merged = runs.where("block is not null").select("part", "run", "block").groupBy("part").applyInArrow(_merge(length), "run long, entry int, low int, high int")
        discard(by_text)
        merged = materialise(merged, "merged")
        least = merged.groupBy("run", "entry").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        spans = runs.where("block is null").join(least, ["run", "entry"]).select(*ks, (F.col("p") - F.col("high")).alias("lo"), (F.col("p") - F.col("low") + length).alias("hi"))
        spans = materialise(spans.groupBy(*ks).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
        discard(runs, merged)
        n = len(kept)
        out_schema = T.StructType([*(base.schema[f"c{i}"] for i in range(n)), *(T.StructField(c, T.LongType()) for c in made[:3]), T.StructField("kept_bytes", T.BinaryType())])
        joined = base.join(spans, ks, "left").select(*(f"c{i}" for i in range(n)), "text", "spans")
        out = joined.mapInArrow(_remove(n), out_schema)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(kept)})
