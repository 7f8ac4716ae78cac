"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are read whole, in overlapping chunks. Each filter
looks at ``width`` adjoining bytes through a learned byte embedding, and at one
more input channel that tells where the bytes repeat what stood a few places
before; a chunk keeps each filter's largest response, and the mean and the
maximum of the chunks' responses are combined, with how short the document is,
into one probability.

The network is fitted on a bounded sample of labelled rows (``Settings``): at
most ``sample_rows`` rows and ``sample_bytes``, each label having its share of
both, in the order of a hash. A row that is longer than ``row_bytes`` or does not
fit what is left is passed over. Scoring is distributed over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftline.session import materialise


#: Filter places whose responses scoring holds at once.
PLACES = 1 << 17


@dataclass(frozen=True)
class Settings:
    filters: int = 12
    width: int = 6
    embedding: int = 8
    chunk: int = 512
    stride: int = 448
    lags: int = 24
    run: int = 8
    sample_rows: int = 3000
    sample_bytes: int = 12_000_000
    row_bytes: int = 300_000
    steps: int = 940
    batch: int = 16
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


class Network:
    """Parameters and passes; a batch of documents is one run of bytes."""

    def __init__(self, s: Settings):
        rng = np.random.Generator(np.random.PCG64(s.seed))
        self.s = s
        self.p = {
            "emb": rng.normal(0, 0.5, (256, s.embedding)).astype(np.float32),
            "conv": rng.normal(0, 1 / np.sqrt(s.embedding * s.width), (s.width, s.embedding, s.filters)).astype(np.float32),
            "again": rng.normal(0, 0.5, s.filters).astype(np.float32),
            "bias": np.zeros(s.filters, np.float32),
            "out": np.zeros(2 * s.filters + 1, np.float32),
            "shift": np.zeros(1, np.float32),
        }

    def _layout(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, the bounds of chunks' filter places (begin, end), and each document's first chunk.

        Zero bytes stand before each document, so nothing in it depends on its neighbours.
        """
        s, begins, ends, firsts, at = self.s, [], [], [0], 0
        gap = b"\0" * (s.lags + s.run)
        padded = [b if len(b) >= s.width else b.ljust(s.width, b"\0") for b in raw]
        for b in padded:
            n = len(b) - s.width + 1
            at += len(gap)
            c = np.arange(0, max(1, len(b) - (s.chunk - s.stride)), s.stride)
            begins.append(at + c)
            ends.append(at + np.minimum(c + s.chunk - s.width + 1, n))
            firsts.append(firsts[-1] + len(c))
            at += len(b)
        return np.frombuffer(gap + gap.join(padded) + gap, np.uint8), np.stack((np.concatenate(begins), np.concatenate(ends)), 1), np.array(firsts)

    def _repeats(self, data: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """For the places from ``lo`` to ``hi``: 1 where ``run`` bytes from there equal those some 2 to ``lags`` places before."""
        s, out = self.s, np.zeros(hi - lo, np.bool_)
        for lag in range(2, s.lags + 1):
            e, have = data[lo : hi + s.run] == data[lo - lag : hi + s.run - lag], 1
            while have < s.run:
                step = min(have, s.run - have)
                e = e[step:] & e[:-step]
                have += step
            out |= e[: hi - lo]
        return out.astype(np.float32)

    def _responses(self, data: np.ndarray, again: np.ndarray, lo: int, hi: int, pairs: list[np.ndarray]) -> np.ndarray:
        """Filter responses at the places from ``lo`` to ``hi``; two adjoining bytes are looked up at once."""
        s = self.s
        part = data[lo : hi + s.width]
        two = part[:-1].astype(np.intp) * 256 + part[1:]
        z = np.broadcast_to(self.p["bias"], (hi - lo, s.filters)).copy()
        for w, table in zip(range(0, s.width, 2), pairs, strict=True):
            z += table.take(two[w : w + hi - lo] if len(table) > 256 else part[w : w + hi - lo], axis=0)
        z += again[:, None] * self.p["again"][None, :]
        return z

    def _pairs(self) -> list[np.ndarray]:
        """What each two bytes give at filter places 0 and 1, 2 and 3, and so on; an odd last place has a table of single bytes."""
        single = np.einsum("be,wef->wbf", self.p["emb"], self.p["conv"])
        out = [(single[w][:, None, :] + single[w + 1][None, :, :]).reshape(65536, -1) for w in range(0, self.s.width - 1, 2)]
        return [*out, single[-1]] if self.s.width % 2 else out

    def forward(self, raw: list[bytes], places: int | None = None):
        """Logits, and what the gradient needs; chunks are pooled over at most about ``places`` places at a time."""
        data, spans, firsts = self._layout(raw)
        pairs, got, i = self._pairs(), [], 0
        again = z = None
        while i < len(spans):
            j = len(spans) if places is None else max(i + 1, int(np.searchsorted(spans[:, 1], spans[i, 0] + places, "right")))
            lo, hi = (int(spans[i, 0]), int(spans[j - 1, 1])) if places else (self.s.lags, len(data) - self.s.lags)
            again = self._repeats(data, lo, hi)
            z = np.vstack((self._responses(data, again, lo, hi, pairs), np.full((1, self.s.filters), -np.inf, np.float32)))
            got.append(np.maximum(np.maximum.reduceat(z, (spans[i:j] - lo).ravel(), axis=0)[::2], 0))
            i = j
        pooled = np.concatenate(got)
        counts = np.diff(firsts)[:, None]
        mean = np.add.reduceat(pooled, firsts[:-1], axis=0) / counts
        most = np.maximum.reduceat(pooled, firsts[:-1], axis=0)
        short = np.exp(-np.array([[len(b)] for b in raw], np.float32) / 100)
        doc = np.hstack((mean, most, short))
        logit = doc @ self.p["out"] + self.p["shift"]
        return logit, (data, spans - self.s.lags, firsts, z, pooled, doc, again)

    def score(self, raw: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(raw, PLACES)[0].astype(np.float64), -40, 40)))

    def gradient(self, raw: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        s, p = self.s, self.p
        logit, (data, spans, firsts, z, pooled, doc, again) = self.forward(raw)
        d = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(y)
        g = {"out": d @ doc, "shift": d.sum(keepdims=True)}
        back = d[:, None] * p["out"][None, :]
        of = np.repeat(np.arange(len(raw)), np.diff(firsts))
        dp = back[of, : s.filters] / np.diff(firsts)[of, None]
        most = slice(s.filters, 2 * s.filters)
        # Overlapping chunks may share a maximum; each takes its part.
        top = (pooled == doc[of, most]).astype(np.float32)
        dp += top * (back[:, most] / np.add.reduceat(top, firsts[:-1], axis=0))[of]
        dp = np.where(pooled > 0, dp, 0)
        g |= {"bias": dp.sum(0), "again": np.zeros_like(p["again"]), "emb": np.zeros_like(p["emb"]), "conv": np.zeros_like(p["conv"])}
        for f in range(s.filters):
            rows = np.flatnonzero(dp[:, f])
            if not len(rows):
                continue
            at = np.array([b + int(z[b:e, f].argmax()) for b, e in spans[rows]])
            w = dp[rows, f].astype(np.float32)
            g["again"][f] = w @ again[at]
            for k in range(s.width):
                byte = data[at + s.lags + k]
                g["conv"][k, :, f] += w @ p["emb"][byte]
                np.add.at(g["emb"], byte, w[:, None] * p["conv"][k, :, f][None, :])
        return g

    def fit(self, raw: list[bytes], y: np.ndarray) -> Network:
        s, rng = self.s, np.random.Generator(np.random.PCG64(self.s.seed + 1))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        while step < s.steps:
            order = rng.permutation(len(raw))
            for i in range(0, min(len(order), (s.steps - step) * s.batch), s.batch):
                part = order[i : i + s.batch]
                g = self.gradient([raw[j] for j in part], y[part])
                step += 1
                rate = s.rate * (1 - step / (s.steps + 1))
                for k, x in g.items():
                    x = x + s.decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id) -> F.Column:
    """True for rows that no classifier may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shares(counts: dict, most: int) -> dict:
    """How many rows each class gives to a sample of about ``most``: in proportion, a tenth of an even share at least."""
    total, least = sum(counts.values()), max(1, most // (10 * max(1, len(counts))))
    return {c: min(n, max(least, most * n // total)) for c, n in counts.items()}


def pick(rows: list[tuple], quota: dict, size: int) -> list:
    """Keys of (key, class, length) rows, in their order: those that fit what is left of their class's rows and size."""
    total, taken, held, out = sum(quota.values()), dict.fromkeys(quota, 0), dict.fromkeys(quota, 0), []
    for key, c, n in rows:
        if taken[c] < quota[c] and held[c] + n <= size * quota[c] // total:
            taken[c] += 1
            held[c] += n
            out.append(key)
    return out


def bounded_sample(rows: DataFrame, most: int, size: int, longest: int) -> list[tuple]:
    """(text, class) of a sample of rows (i, t, c, n), n being the length of t, in the order of a hash.

    Each class has its ``shares`` of ``most`` rows and of the summed length
    ``size``. Rows longer than ``longest``, or than what is left of the share,
    are passed over and the next is tried. A class of which no row fits gives its
    shortest one, so no class is missing. Equal rows count once.
    """
    rows = rows.withColumn("h", F.xxhash64("i", "t"))
    fits = F.col("n") <= longest
    counts = {r.c: (r.all, r.fit) for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(fits, 1)).alias("fit")).collect()}
    if not counts:
        return []
    quota = shares({c: a for c, (a, _) in counts.items()}, most)
    # A part of the hash's range that has four times the rows asked, and some more.
    part = F.lit(False)
    for c, (_, fit) in counts.items():
        share = min(1.0, (4 * quota[c] + 64) / max(fit, 1))
        part = part | (F.col("c") == F.lit(c)) & (F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
    some = materialise(rows.where(fits & part).select("h", "c", "n", "t").dropDuplicates(["h", "c"]), "sample")
    # Only keys and lengths of the candidates come to the driver, then the texts that were picked.
    seen = [((r.h, r.c), r.c, r.n) for r in some.select("h", "c", "n").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "c").collect()]
    keys = pick(seen, quota, size)
    texts = {(r.h, r.c): r.t for r in some.where(F.col("h").isin([h for h, _ in keys])).collect()} if keys else {}
    out = [(texts[k], k[1]) for k in keys]
    for c in sorted(counts.keys() - {c for _, c in keys}):
        out += [(r.t, c) for r in rows.where(F.col("c") == F.lit(c)).orderBy("n", "h").limit(1).collect()]
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int]]:
    """The bounded sample: (text, label) of learnable rows, one for each identifier."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    ids = ids.groupBy(F.col(id_col).alias("i")).agg((F.avg(label_col) >= 0.5).cast("int").alias("c"))
    # A hash's range is cut so that some 4 * sample_rows identifiers of each label are left, which are broadcast.
    spot, part = F.pmod(F.xxhash64("i"), F.lit(1 << 30)), F.lit(False)
    for r in ids.groupBy("c").count().collect():
        part = part | (F.col("c") == r.c) & (spot <= int(min(1.0, (4 * s.sample_rows + 64) / r["count"]) * (1 << 30)))
    found = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(ids.where(part)), "i")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("t"))).where("r = 1")
    found = materialise(found.select("i", "t", "c", F.octet_length("t").alias("n")), "labelled")
    return bounded_sample(found, s.sample_rows, s.sample_bytes, s.row_bytes)


def fit(docs: DataFrame, labels: DataFrame, s: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """A network fitted on the bounded sample; with no labelled rows it scores 0.5 everywhere."""
    s = s or Settings()
    rows = labelled_sample(docs, labels, s, id_col, text_col, label_col)
    net = Network(s)
    return net.fit([t.encode("utf-8", "replace") for t, _ in rows], np.array([y for _, y in rows], np.float32)) if rows else net


def score(docs: DataFrame, net: Network, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and ``score``, a double from 0 to 1.

    A null text counts as empty, an empty text as zero bytes of one chunk; very
    long texts are scored whole, some chunks at a time. A row's score depends on
    its text alone, so repeated rows, null identifiers and the order of rows make
    no difference, and an empty table gives an empty table. A column of ``docs``
    named score is replaced.
    """
    cols = [c for c in (keep or docs.columns) if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast((net.s, net.p))

    def run(batches):
        s, p = shared.value
        model = Network(s)
        model.p = p
        for batch in batches:
            got, part, held = [], [], 0
            for t in batch.column(len(cols)):
                b = (t.as_py() or "").encode("utf-8", "replace")
                if part and held + len(b) > PLACES:
                    got.append(model.score(part))
                    part, held = [], 0
                part.append(b)
                held += len(b)
            if part:
                got.append(model.score(part))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(cols))), pa.array(np.concatenate(got) if got else np.empty(0), pa.float64())], names=[*cols, "score"])

    frame = docs.select(*(F.col(f"`{c}`") for c in cols), F.col(f"`{text_col}`").alias("__text"))
    schema = docs.select(*(F.col(f"`{c}`") for c in cols)).schema.add("score", "double")
    return frame.mapInArrow(run, schema)
