"""MinHash near-duplicates by a multi-index Hamming join.

Each distinct shingle set becomes a signature of ``n_hashes`` b-bit values. Two
sets of similarity j differ in a binomial number of values; ``Plan`` takes the
signature-distance threshold T a little over four deviations above its mean.
The signature is split into m chunks with m * (errors + 1) > T, so by the
pigeonhole principle any pair within T agrees on some chunk but for ``errors``
values. Enumerating the positions of those errors as wildcards turns the search
into equality on keys: every pair within T shares a key.

Documents with equal sets, told by two independent 64-bit sums, are one class
from the start. Keys of many classes
are never expanded into all pairs: each key's classes are first compared with
its least one, and keys that then lie within one component are done. What
remains falls into groups of classes joined by common keys. A group is cut into
blocks of bounded size, and each two blocks that hold more than one component
make a tile, whose task compares full sets by matrix products and returns no
more links than classes. All links are confirmed on full shingle sets.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm.components import connected_components
from weftline.llm.shingles import mix, shingle_sets
from weftline.session import arrow_rows, materialise

#: Rows of a side that is broadcast at most; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000
#: Rows of the Arrow batches in which texts and full sets pass to Python.
BATCH_ROWS = 200
#: A block of a tile holds about so many sets and so many values in them.
BLOCK_SETS, BLOCK_VALUES = 512, 500_000
#: Sets of a text are hashed at most so many values at a time.
_SLICE = 8192


@dataclass(frozen=True)
class Plan:
    """Parameters of the join; the derived values follow from them."""

    shingle_words: int = 5
    percent: int = 80
    n_hashes: int = 96
    errors: int = 1
    deviations: float = 4.25

    @property
    def threshold(self) -> int:
        p = 1 - self.percent / 100
        return min(self.n_hashes - 1, ceil(self.n_hashes * p + self.deviations * sqrt(self.n_hashes * p * (1 - p))))

    @property
    def chunks(self) -> list[range]:
        m = min(self.n_hashes, ceil((self.threshold + 1) / (self.errors + 1)))
        cuts = [round(i * self.n_hashes / m) for i in range(m + 1)]
        return [range(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False)]

    def coefficients(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.Generator(np.random.PCG64(77))
        a = rng.integers(0, 2**31, self.n_hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 2**32, self.n_hashes, dtype=np.uint32)
        k = rng.integers(0, 2**63, self.n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return a, b, k


def signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least value under each hash."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(x), _SLICE):
        h = x[None, i : i + _SLICE] * a[:, None]
        h += b[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return least.astype(np.uint16)


def _sums(values: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums that tell a set."""
    return int(values.sum(dtype=np.uint64).astype(np.int64)), int(mix(values).sum(dtype=np.uint64).astype(np.int64))


def _sketches(plan: Plan):
    def run(batches):
        a, b, _ = plan.coefficients()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                n, h1, h2, sig = [], [], [], []
                for s in shingle_sets(part.column(1).to_pylist(), plan.shingle_words):
                    p, q = _sums(s)
                    n.append(len(s))
                    h1.append(p)
                    h2.append(q)
                    sig.append(signature(s, a, b).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], names=["id", "n", "h1", "h2", "sig"])

    return run


def chunk_keys(sigs: np.ndarray, plan: Plan) -> np.ndarray:
    """(rows, keys): for each chunk one key for each set of error positions."""
    _, _, k = plan.coefficients()
    out = []
    with np.errstate(over="ignore"):
        parts = sigs.astype(np.uint64) * k[None, :]
        tag = 0
        for chunk in plan.chunks:
            whole = parts[:, chunk.start : chunk.stop].sum(axis=1, dtype=np.uint64)
            for off in combinations(chunk, min(plan.errors, len(chunk) - 1)):
                tag += 1
                left = whole.copy()
                for p in off:
                    left -= parts[:, p]
                out.append(mix(left ^ np.uint64(tag * 0x9E3779B97F4A7C15 % 2**64)))
    return np.stack(out, axis=1).view(np.int64) if len(sigs) else np.empty((0, 0), np.int64)


def _keys(plan: Plan):
    def run(batches):
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, plan.n_hashes)
            keys = chunk_keys(sigs, plan)
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * (keys.shape[1] if len(keys) else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=["cls", "ks"])

    return run


def _near_signatures(plan: Plan):
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, plan.n_hashes) for i in (2, 3))
            ok = (x != y).sum(axis=1) <= plan.threshold
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _full_sets(plan: Plan):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                h1, h2, sets = [], [], []
                for s in shingle_sets(part.column(1).to_pylist(), plan.shingle_words):
                    p, q = _sums(s)
                    h1.append(p)
                    h2.append(q)
                    sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sets, pa.binary())], names=["h1", "h2", "members"])

    return run


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Intersection sizes of the sets at ``left`` with those at ``right``, over their common values a part at a time."""
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, n = np.unique(flat, return_inverse=True, return_counts=True)
    common = n[code] > 1
    code, of = (np.cumsum(n > 1) - 1)[code[common]], of[common]
    order = np.argsort(code, kind="stable")
    code, of = code[order], of[order]
    row = np.full(len(sets), -1)
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, _SLICE):
        i, j = np.searchsorted(code, (lo, lo + _SLICE))
        width = int(code[j - 1]) - lo + 1
        sides = []
        for rows in (left, right):
            row[:] = -1
            row[rows] = np.arange(len(rows))
            m, at = np.zeros((len(rows), width), np.float32), row[of[i:j]]
            m[at[at >= 0], code[i:j][at >= 0] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _tile(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        cls, label, block = (table[c].to_numpy() for c in ("cls", "label", "block"))
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table["members"]]
        first = block == block.min()
        left, right = np.flatnonzero(first), np.flatnonzero(~first if (~first).any() else first)
        size = np.array([len(v) for v in sets], np.float32)
        both = overlaps(sets, left, right)
        near = 100 * both.astype(np.float64) >= plan.percent * (size[left][:, None] + size[right][None, :] - both).astype(np.float64)
        near &= label[left][:, None] != label[right][None, :]
        x, y = np.nonzero(near)
        x, y = left[x], right[y]
        _, one = np.unique(np.stack((label[x], label[y])), axis=1, return_index=True)
        root = {}

        def find(v):
            while root.get(v, v) != v:
                root[v] = v = root.get(root[v], root[v])
            return v

        a, b = [], []
        for i, j in zip(x[one].tolist(), y[one].tolist(), strict=True):
            p, q = find(int(label[i])), find(int(label[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(int(min(cls[i], cls[j])))
                b.append(int(max(cls[i], cls[j])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _confirm(plan: Plan):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= plan.percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class _Join:
    """The state of one run: classes, their documents, and the links so far."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, plan: Plan):
        self.plan = plan
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
        sketched = self.docs.mapInArrow(_sketches(plan), "id long, n long, h1 long, h2 long, sig binary")
        self.rows = materialise(sketched, "sketches")
        # A class is told by both sums; its number is given once, when the table is written.
        per = self.rows.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
        self.classes = materialise(per.withColumn("cls", F.monotonically_increasing_id()), "classes")
        self.links = None
        self.sets = None

    def keys(self) -> DataFrame:
        k = self.classes.select("cls", "sig").mapInArrow(_keys(self.plan), "cls long, ks array<long>")
        return k.select("cls", F.explode("ks").alias("key"))

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a < b) of classes that the signatures and then the full sets confirm."""
        plan = self.plan
        side = self.classes.select("cls", "n", "sig")
        pairs = pairs.distinct().join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
        pairs = pairs.where(100 * F.least("na", "nb") >= plan.percent * F.greatest("na", "nb"))
        near = materialise(pairs.select("a", "b", "sa", "sb").mapInArrow(_near_signatures(plan), "a long, b long"), "near")
        self.fetch(near.select(F.col("a").alias("cls")).union(near.select(F.col("b").alias("cls"))).distinct())
        full = near.join(self.sets.toDF("a", "pa"), "a").join(self.sets.toDF("b", "pb"), "b")
        return full.select("a", "b", "pa", "pb").mapInArrow(_confirm(plan), "a long, b long")

    def fetch(self, need: DataFrame) -> None:
        """Have the full sets of the classes ``need`` in ``self.sets``."""
        if self.sets is not None:
            need = need.join(self.sets.select("cls"), "cls", "left_anti")
        # A class is read through its least id; ids may repeat or be null, so the sets found are matched by their sums.
        need = materialise(need.join(self.classes.select("cls", "first", "h1", "h2"), "cls"), "needed")
        ids = _bounded(need.select("first").distinct())
        texts = self.docs.join(ids, F.col("id").eqNullSafe(F.col("first")), "left_semi").select("id", "t")
        found = texts.mapInArrow(_full_sets(self.plan), "h1 long, h2 long, members binary").join(_bounded(need.select("cls", "h1", "h2")), ["h1", "h2"])
        found = materialise(found.select("cls", "members").dropDuplicates(["cls"]), "sets")
        self.sets = found if self.sets is None else self.sets.union(found)

    @staticmethod
    def mixed(open_: DataFrame) -> DataFrame:
        """The rows of keys that hold more than one component."""
        keys = open_.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        return materialise(open_.join(_bounded(materialise(keys, "mixed-keys")), "key", "left_semi"), "open")

    def add(self, pairs: DataFrame) -> None:
        found = materialise(self.confirm(pairs), "confirmed")
        self.links = found if self.links is None else self.links.union(found)

    def run(self) -> DataFrame:
        """(node, label) of the classes that have links."""
        keys = self.keys()
        shared = materialise(keys.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count(F.lit(1)).alias("c")).where("a < b"), "keys")
        # Each member of a larger key carries the key's least class, so no key has to meet in one task.
        members = materialise(keys.join(_bounded(shared.where("c > 2").select("key", "a")), "key").select("key", "a", "cls"), "members")
        # Many keys hold the same classes; one of them stands for all.
        alike = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *(F.sum(F.xxhash64("cls", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)))
        alike = alike.groupBy("c", "s1", "s2").agg(F.min("key").alias("key")).select("key")
        members = materialise(members.join(_bounded(materialise(alike, "distinct-keys")), "key", "left_semi"), "members")
        star = members.where("a < cls").select("a", F.col("cls").alias("b"))
        self.add(shared.where("c = 2").select("a", "b").union(star))
        labels = connected_components(self.links)
        open_ = members.join(_bounded(labels.withColumnRenamed("node", "cls")), "cls", "left").select("key", "cls", F.coalesce("label", "cls").alias("label"))
        open_ = self.mixed(open_)
        if open_.isEmpty():
            return labels
        self.links = self.links.union(materialise(self.tiles(open_), "confirmed"))
        return connected_components(self.links)

    def tiles(self, open_: DataFrame) -> DataFrame:
        """Links between components of the groups that the keys of ``open_`` make."""
        least = open_.groupBy("key").agg(F.min("cls").alias("b"))
        chain = open_.join(least, "key").select(F.col("cls").alias("a"), "b").distinct()
        groups = connected_components(chain).toDF("cls", "grp")
        self.fetch(open_.select("cls").distinct())
        one = open_.select("cls", "label").distinct().join(groups, "cls").join(self.classes.select("cls", "n"), "cls")
        one = materialise(one, "open-classes")
        parts = one.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
        # The largest component of a group is not compared with itself, so it gets blocks of its own.
        most = parts.groupBy("grp").agg(F.max(F.struct("c", "label")).alias("m")).select("grp", F.col("m.label").alias("main"))
        blocks = F.ceil(F.greatest(F.sum("c") / BLOCK_SETS, F.sum("n") / BLOCK_VALUES)).cast("int")
        cut = parts.join(most, "grp").groupBy("grp", (F.col("label") == F.col("main")).alias("inner")).agg(blocks.alias("k"))
        cut = cut.groupBy("grp").agg(F.coalesce(F.max(F.when(F.col("inner"), F.col("k"))), F.lit(0)).alias("k_in"), F.coalesce(F.max(F.when(~F.col("inner"), F.col("k"))), F.lit(0)).alias("k_out"))
        cut = materialise(cut.join(most, "grp"), "cuts")
        dealt = one.join(cut, "grp").withColumn("h", F.xxhash64("cls"))
        # Blocks 0 .. k_out - 1 hold the other components, those above the largest one.
        inner = F.col("label") == F.col("main")
        dealt = dealt.withColumn("block", F.when(inner, F.col("k_out") + F.pmod("h", "k_in")).otherwise(F.pmod("h", F.greatest("k_out", F.lit(1)))).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.when(F.col("block") >= F.col("k_out"), F.col("k_out") - 1).otherwise(F.col("k_in") + F.col("k_out") - 1)))
        dealt = dealt.where("k_out > 0").select("grp", "cls", "label", "block", other.alias("o"))
        dealt = dealt.select("grp", "cls", "label", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
        full = dealt.join(self.sets, "cls").select("grp", "i", "j", "cls", "label", "block", "members")
        return full.groupBy("grp", "i", "j").applyInArrow(_tile(self.plan), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id, n_copies, group_id), one row for each row of ``docs``.

    Two rows are linked if the Jaccard similarity of their shingle sets reaches
    ``plan.percent``; component_id is the least id that can be reached. Rows with
    a null text or no words are linked with nothing. Rows of a null id take part,
    but a null never names a component: with only such rows component_id is null
    and kept is true. Repeated ids keep a row each. Very long texts are read whole,
    a piece at a time. Nothing is decided by order, so ties do not arise. Other
    columns of ``docs`` are not looked at; an empty table gives an empty table.
    ``class_id`` spells a class's two sums and ``group_id`` numbers what is
    linked, also where ids repeat; both are null without words.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        join = _Join(docs, id_col, text_col, plan or Plan())
        labels = join.run()
    linked = join.classes.select("cls", "first").join(labels.withColumnRenamed("node", "cls"), "cls")
    least = linked.groupBy("label").agg(F.min("first").alias("comp"))
    comp = materialise(linked.join(least, "label").select("cls", "comp", "label"), "components")
    named = join.classes.select("h1", "h2", "cls", "first", "copies").join(_bounded(comp), "cls", "left")
    named = named.select("h1", "h2", F.coalesce("label", "cls").alias("label"), F.coalesce("comp", "first").alias("comp"), "copies")
    # Texts without words have sums of their own, which are no class.
    out = join.rows.select("id", "n", *(F.when(F.col("n") > 0, F.col(h)).alias(h) for h in ("h1", "h2"))).join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        _spelled(F.col("n"), F.col("h1"), F.col("h2")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.col("label").alias("group_id"),
    )


def _spelled(n: Column, h1: Column, h2: Column) -> Column:
    return F.when(n > 0, F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (h1, h2))))


def class_ids(docs: DataFrame, key_col: str, text_col: str = "text", plan: Plan | None = None) -> DataFrame:
    """(key, class_id) of each row of ``docs``, as ``near_duplicates`` spells it; ``key_col`` is a long."""
    words = (plan or Plan()).shingle_words

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1).to_pylist(), words))
            h = [_sums(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[i] for x in h], pa.int64()) for i in (0, 1))], names=["key", "n", "h1", "h2"])

    rows = docs.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, "key long, n long, h1 long, h2 long")
    return rows.select("key", _spelled(F.col("n"), F.col("h1"), F.col("h2")).alias("class_id"))
