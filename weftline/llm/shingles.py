"""Vectorised word and shingle hashing over batches of texts.

Words are maximal runs of bytes other than space and TAB..CR after lower-casing
A-Z, so work on UTF-8 bytes equals work on characters. A word's hash is a
polynomial over random byte codes modulo 2**64, a shingle's hash a mixed linear
form of its words' hashes; unequal shingles of compared documents meet with
probability of about 2**-55.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240917))
_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODES[_SPACE] = 0
_STEP = _U(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers = np.ones(1, np.uint64)
#: Bytes that are hashed at a time.
PIECE = 1 << 18


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers), 1024), _STEP, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches all output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the bounds of each text in them.

    The bytes are read in pieces of about ``PIECE`` that end at a space, so the
    arrays of a long text stay small; only a single longer word makes a longer piece.
    """
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    begins, hashes, at = [], [], 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        while True:
            gaps = np.flatnonzero(_SPACE[data[at:stop]])
            if len(gaps) or stop == len(data):
                break
            stop = min(stop + PIECE, len(data))
        stop = at + int(gaps[-1]) + 1
        b, h = _piece_hashes(data[at:stop])
        begins.append(b + at)
        hashes.append(h)
        at = stop
    return np.concatenate(hashes), np.concatenate(([0], np.searchsorted(np.concatenate(begins), ends)))


def _piece_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes begin, and their hashes."""
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(begins):
        return begins, np.empty(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64)
    at = np.zeros(len(data), np.int64)
    at[begins] = begins
    np.maximum.accumulate(at, out=at)
    place -= at
    place[space] = 0
    table = _power_table(int(place.max()) + 1)
    with np.errstate(over="ignore"):
        return begins, np.add.reduceat(_CODES[data] * table[place], begins)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    A text of fewer words gives its whole sequence as one shingle; a null text
    or one without words gives an empty array.
    """
    raw, held = [], 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass").lower()
        raw.append(b)
        held += len(b)
        if held > PIECE:
            yield from _sets(raw, k)
            raw, held = [], 0
    yield from _sets(raw, k)


def _sets(raw: list[bytes], k: int) -> Iterator[np.ndarray]:
    if not raw:
        return
    words, bounds = _word_hashes(raw)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - k + 1)
        forms = np.zeros(n, np.uint64)
        for j in range(k):
            forms += words[j : j + n] * _PLACE[j]
        forms = mix(forms)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            m = hi - lo
            if m >= k:
                yield np.unique(forms[lo : hi - k + 1])
            elif m:
                short = _U(m) * _STEP + (words[lo:hi] * _PLACE[:m]).sum(dtype=np.uint64)
                yield mix(np.array([short], np.uint64))
            else:
                yield np.empty(0, np.uint64)
