"""URL filters by Bloom filter cascades, with DataFrame functions only.

Rules are pairs of a host and a path prefix. The keys of a URL are its host and
each parent domain, joined with the prefixes of its path whose lengths occur
among the rules. For a list of rules the first filter holds its keys; every
other key of the corpus that passes it goes into the second; listed keys that
pass that one go into the third; and so on until none is left. A key's place is
the first filter it fails, and it is listed if that filter, counted from zero,
has an odd number.
As the levels are made over the corpus's whole key universe, membership is
exact for every URL in it, and judging a URL needs no join: each filter is one
array of words that the plan carries as a constant. The first filter has bits
enough that no more other keys pass it than are listed, so all later ones are
as small as the list, whatever the universe.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weftline.session import materialise

PROBES = 3
#: A level after the first takes so many bits for each key; all are rounded up to a power of two.
BITS_PER_KEY = 16
#: Filters of a cascade; each leaves a small share of the keys before, so even large universes need few.
MAX_LEVELS = 64
#: Bytes of one filter at most; a list that needs more is an error.
MAX_BYTES = 16 << 20
#: Rules that are literals of the plan; longer lists become a table.
PLAN_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and all its parent domains, longest first; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    all_ = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host != "", all_).otherwise(F.array().cast("array<string>"))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys of a URL that a rule could equal, for rules with paths of these lengths."""
    pre = F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths))
    pre = F.filter(pre, lambda p: p.isNotNull())
    return F.flatten(F.transform(_suffixes(host), lambda h: F.transform(pre, lambda p: F.concat(h, p))))


def _bit(key: Column, level: int, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(probe)), F.lit(bits))


def _filter_words(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row: the filter's words, of 64 bits each, for a table of keys."""
    bit = F.explode(F.array(*(_bit(F.col("key"), level, p, bits) for p in range(PROBES)))).alias("bit")
    words = keys.select(bit).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("v"))
    every = keys.sparkSession.range(0, bits // 64, 1, 1).select(F.col("id").alias("w")).join(words, "w", "left")
    in_order = F.array_sort(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0)).alias("v"))))
    return every.agg(F.transform(in_order, lambda x: x["v"]).alias("words"))


def _passes(key: Column, words: Column, level: int, bits: int) -> Column:
    def hit(p):
        b = _bit(key, level, p, bits)
        return F.getbit(F.element_at(words, (F.shiftright(b, 6) + 1).cast("int")), (b % 64).cast("int")) == 1

    return reduce(lambda a, b: a & b, (hit(p) for p in range(PROBES)))


def _rounded(bits: float) -> int:
    """The power of two, 64 at least, that is not below ``bits``."""
    return 1 << max(6, (int(bits) - 1).bit_length())


def filter_bits(listed: int, keys: int) -> int:
    """Bits of a first filter that about as many of ``keys`` keys pass wrongly as are listed.

    With PROBES bits set for each listed key, a share (PROBES * listed / bits) ** PROBES passes.
    """
    wanted = max(2.0, keys / max(1, listed))
    return _rounded(PROBES * listed * wanted ** (1 / PROBES))


class Cascade:
    """Exact membership of the universe's keys in ``listed`` (both tables have a column ``key``)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, name: str):
        listed = materialise(listed.select("key").where("key is not null").distinct(), f"{name}-listed")
        keys = universe.count()
        self.levels: list[tuple[Column, int]] = []
        encode, other = listed, universe.select("key")
        while n := encode.count():
            level = len(self.levels)
            if level == MAX_LEVELS:
                raise RuntimeError(f"{n} keys are left after {MAX_LEVELS} filters")
            bits = filter_bits(n, keys) if level == 0 else _rounded(n * BITS_PER_KEY)
            if bits > 8 * MAX_BYTES:
                raise ValueError(f"a filter of {n} keys needs {bits // 8} bytes, more than {MAX_BYTES}; split the list")
            # The words of one bounded filter; the optimiser folds the text into a constant array.
            text = _filter_words(encode, level, bits).select(F.to_json("words")).first()[0]
            words = F.from_json(F.lit(text), "array<bigint>")
            self.levels.append((words, bits))
            false = other.where(_passes(F.col("key"), words, level, bits))
            if level == 0:
                # Only keys that passed the first filter reach this comparison.
                false = false.distinct().join(listed, "key", "left_anti")
            encode, other = materialise(false, f"{name}-false"), encode

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            words, bits = self.levels[level]
            out = F.when(_passes(key, words, level, bits), out).otherwise(F.lit(level % 2 == 1))
        return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``pages`` with host, path, rule and verdict.

    ``rules`` are (verdict, host, path prefix) with the verdict allow or block. A
    rule fits its host and all subdomains if the path starts with its prefix; of
    several the longest wins, and block wins over allow for the same rule. With
    no rule the key is listed nowhere: rule is null and the verdict ``default``.
    A null url, or one without ``://``, has an empty host and path and fits no
    rule. Very long urls are read whole and repeated rows keep a row each.
    Columns of these four names are replaced; an empty table stays empty.
    """
    spark = pages.sparkSession
    if any(v not in ("allow", "block") or not h for v, h, _ in rules):
        raise ValueError("a rule is (allow or block, host, path prefix)")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*kept, host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    lengths = sorted({len(p) for _, _, p in rules})
    if not rules:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    universe = materialise(urls.select(F.explode(keys_of(F.col("host"), F.col("path"), lengths)).alias("key")).distinct(), "url-keys")
    member = {}
    for verdict in ("allow", "block"):
        own = [h.translate(str.maketrans(_UPPER, _LOWER)) + p for v, h, p in rules if v == verdict]
        listed = spark.range(1).select(F.explode(F.array(*map(F.lit, own)).cast("array<string>")).alias("key")) if len(own) <= PLAN_RULES else spark.createDataFrame([(k,) for k in own], "key string")
        member[verdict] = Cascade(listed, universe, f"url-{verdict}")
    keyed = parsed.withColumn("__keys", keys_of(F.col("host"), F.col("path"), lengths))

    def longest(verdict: str) -> Column:
        hits = F.filter("__keys", member[verdict].contains)
        return F.aggregate(hits, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))

    keyed = keyed.withColumns({"__allow": longest("allow"), "__block": longest("block")})
    blocked = F.coalesce(F.length("__block"), F.lit(-1)) >= F.coalesce(F.length("__allow"), F.lit(-1))
    hit = F.coalesce("__allow", "__block").isNotNull()
    return keyed.select(
        *kept,
        "host",
        "path",
        F.when(hit, F.when(blocked, F.col("__block")).otherwise(F.col("__allow"))).alias("rule"),
        F.when(hit, F.when(blocked, "block").otherwise("allow")).otherwise(default).alias("verdict"),
    )
