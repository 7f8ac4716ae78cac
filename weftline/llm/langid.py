"""Language identification: sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (one to three
characters of the lower-cased text, other characters than letters and their
marks folded into one space): the n-gram's share of the text times its inverse document
frequency, which is counted over all learnable documents. Weights are trained
by follow-the-regularised-leader with an elastic-net penalty on a bounded
sample (``Settings``) in which each language has its share, most stay zero; the softmax's temperature is then set on
a part of the sample that training did not see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from weftline.llm.quality import bounded_sample, held_out

UNKNOWN = "und"
#: Letters by their Unicode category, for Python and for Java.
_LETTERS = r"\p{L}"
_LETTER = regex.compile(_LETTERS)
#: What stands between letters and their marks; the second form is the first on plain ASCII.
_FOLD = regex.compile(r"[^\p{L}\p{M}]+")
_FOLD_ASCII = re.compile("[^a-z]+")
#: Characters whose n-grams are held at once.
PIECE = 1 << 16


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 15
    sample_rows: int = 2000
    sample_chars: int = 6_000_000
    row_chars: int = 150_000
    calibration: float = 0.2
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-6
    scale: float = 30.0


@dataclass
class Model:
    settings: Settings
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0


def grams(text: str, s: Settings) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a whole text, in pieces of bounded size."""
    low = text.lower()
    folded = f" {(_FOLD_ASCII if low.isascii() else _FOLD).sub(' ', low).strip()} "
    shift, most = np.uint32(32 - (s.buckets.bit_length() - 1)), max(s.orders)
    for at in range(0, len(folded), PIECE):
        # A piece goes on by the rest of the n-grams that begin in it.
        c = np.frombuffer(folded[at : at + PIECE + most - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, most + 1):
            if len(c) < n:
                break
            with np.errstate(over="ignore"):
                h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
                if n in s.orders:
                    x = (h[:PIECE] ^ (h[:PIECE] >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                    yield (x >> shift).astype(np.int32)


def has_letters(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def document_frequencies(docs: DataFrame, s: Settings, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, over all rows; the buckets are a fixed number."""

    def run(batches):
        df, n, seen = np.zeros(s.buckets + 1, np.int64), 0, np.zeros(s.buckets, np.uint8)
        part = np.zeros(s.buckets, np.uint8)
        for batch in batches:
            for value in batch.column(0):
                t = value.as_py()
                if has_letters(t):
                    seen[:] = 0
                    for g in grams(t, s):
                        seen[g] = 1
                    part += seen
                    n += 1
                    if n % 255 == 0:
                        df[:-1] += part
                        part[:] = 0
        df[:-1] += part
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], names=["b", "n"])

    counted = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n"))
    out = np.zeros(s.buckets + 1, np.int64)
    for r in counted.collect():
        out[r.b] = r.n
    return out[:-1], int(out[-1])


def _features(text: str, model: Model) -> tuple[np.ndarray, np.ndarray]:
    count = np.zeros(model.settings.buckets, np.int64)
    for g in grams(text, model.settings):
        count += np.bincount(g, minlength=len(count))
    at = np.flatnonzero(count)
    n = count[at]
    return at, (n / n.sum() * model.idf[at] * model.settings.scale).astype(np.float64)


def train(rows: list[tuple[str, str]], model: Model) -> Model:
    """Fit weights and temperature on (text, language) rows."""
    s = model.settings
    model.languages = sorted({lang for _, lang in rows})
    k = len(model.languages)
    code = {lang: i for i, lang in enumerate(model.languages)}
    data = [(*_features(t, model), code[lang]) for t, lang in rows]
    cut = max(1, round(len(data) * (1 - s.calibration)))
    z, n = np.zeros((s.buckets + 1, k)), np.zeros((s.buckets + 1, k))
    rng = np.random.Generator(np.random.PCG64(3))

    def weights(at):
        return np.where(np.abs(z[at]) <= s.l1, 0.0, -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for i in rng.permutation(cut):
            at, x, y = data[i]
            at, x = np.append(at, s.buckets), np.append(x, 1.0)
            w = weights(at)
            o = x @ w
            p = np.exp(o - o.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    w = weights(np.arange(s.buckets + 1))
    model.weights, model.bias = w[:-1], w[-1]
    rest = data[cut:] or data
    o = np.array([x @ model.weights[at] + model.bias for at, x, _ in rest])
    y = np.array([y for *_, y in rest])

    # Smoothed targets keep the temperature finite where all rows are told apart.
    target = np.full(o.shape, 1 / (len(y) + 2) / k)
    target[np.arange(len(y)), y] += 1 - 1 / (len(y) + 2)

    def loss(t: float) -> float:
        a = o / t
        a = a - a.max(1, keepdims=True)
        return float((np.log(np.exp(a).sum(1)) - (target * a).sum(1)).mean())

    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def fit(docs: DataFrame, s: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages of the learnable rows: a non-null language, letters, and not held out.

    With no such rows the model knows no language, and everything is ``und``.
    """
    s = s or Settings()
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    model = Model(s)
    df, n = document_frequencies(rows, s, text_col)
    model.idf = np.log((1 + n) / (1 + df)) + 1
    some = rows.where(F.col(text_col).rlike(_LETTERS)).select(F.col(id_col).alias("i"), F.col(lang_col).alias("c"), F.col(text_col).alias("t"), F.length(text_col).alias("n"))
    picked = bounded_sample(some, s.sample_rows, s.sample_chars, s.row_chars)
    return train(picked, model) if picked else model


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), ``lang_pred`` and ``score``.

    ``score`` is the calibrated probability of the language; a text that is null
    or has no letter gives ``und`` and 0. Ties go to the first language in order
    of name. Very long texts are read whole, a piece at a time; a row's result
    depends on its text alone, so repeated rows and null identifiers make no
    difference, and an empty table gives an empty table. Columns of ``docs`` of
    these two names are replaced.
    """
    cols = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    s = model.settings
    known = bool(model.languages)
    table = (model.idf[:, None] * model.weights * s.scale).astype(np.float32) if known else None
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, table, model.bias, model.temperature))

    def run(batches):
        languages, v, bias, temperature = shared.value
        for batch in batches:
            pred, score = [], []
            for value in batch.column(len(cols)):
                t = value.as_py()
                if not known or not has_letters(t):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                n, total = 0, np.zeros(len(languages))
                for g in grams(t, s):
                    n += len(g)
                    total += v.take(g, axis=0).sum(axis=0, dtype=np.float64)
                o = (total / n + bias) / temperature
                p = np.exp(o - o.max())
                p /= p.sum()
                best = int(p.argmax())
                pred.append(languages[best])
                score.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(cols))), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*cols, "lang_pred", "score"])

    frame = docs.select(*(F.col(f"`{c}`") for c in cols), F.col(f"`{text_col}`").alias("__text"))
    schema = docs.select(*(F.col(f"`{c}`") for c in cols)).schema.add("lang_pred", "string").add("score", "double")
    return frame.mapInArrow(run, schema)
