"""The numbered operators against brute force, round trips and held-out accuracy, on small tables with odd rows."""

import itertools
import math
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import components, contamination, divergence, langid, minhash, nearest, packing, quality, queries, ranked, sharding, shingles, sitestyle, sstable, suffixes, textids, urlfilter
from weftline.session import materialise

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "one", "one two", "One TWO three four five", "ein zwei drei vier fünf", "x " * 30_000]


def docs_of(spark, texts, extra=True):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        for c in ("score", "n", "id", "key", "shard", "slot", "length", "start", "lang_pred", "n_hit", "contaminated", "t", "cls"):
            df = df.withColumn(c, F.lit("own"))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


# -- 1 ---------------------------------------------------------------------------


def plain_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(texts, k, percent):
    sets, root = [plain_set(t, k) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_copies(n, seed, words=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = list(rng.choice(vocabulary, words))
    out = []
    for _ in range(n):
        t = list(base)
        for p in rng.integers(0, words, rng.integers(0, 9)):
            t[p] = str(rng.choice(vocabulary))
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rng = np.random.default_rng(k)
    texts = [*ODD, *near_copies(60, 1), *near_copies(20, 2, 30)]
    texts += [" ".join(rng.choice([f"v{i}" for i in range(300)], 40)) for _ in range(20)]
    texts += [texts[20], texts[20], texts[6].upper(), "one two"]
    want, sizes = plain_components(texts, k, percent)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs_of(spark, texts), plan=minhash.Plan(shingle_words=k, percent=percent)).collect()}
    assert len(got) == len(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) for i in got)


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "q r s t u"), (2, None), (3, "a b c d e f g")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 2, True), (3, 1, False)]


def test_keys_meet_within_the_threshold():
    plan = minhash.Plan(shingle_words=3, percent=85, n_hashes=24)
    rng = np.random.default_rng(0)
    sigs = rng.integers(0, 2**16, (300, 24), dtype=np.uint16)
    other = sigs.copy()
    for row in other:
        at = rng.choice(24, plan.threshold, replace=False)
        row[at] ^= rng.integers(1, 2**16, plan.threshold, dtype=np.uint16)
    a, b = minhash.chunk_keys(sigs, plan), minhash.chunk_keys(other, plan)
    assert (a == b).any(axis=1).all()


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 3), (10, 11), (11, 10), (20, 21), (21, 22), (22, 23), (23, 24), (None, 2)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 10: 10, 11: 10} | dict.fromkeys(range(20, 25), 20)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_words_hash_apart():
    a, b = "x" * 5000, "x" * 4999 + "y"
    sets = list(shingles.shingle_sets([a, b, a + " " + b], 1))
    assert len(sets[0]) == len(sets[1]) == 1 and len(sets[2]) == 2 and sets[0][0] in sets[2]


# -- 2, 6 --------------------------------------------------------------------------


def test_quality_is_learnt(spark):
    docs, labels = queries.table(spark, "/root/testdata/sf0.01", "documents"), queries.table(spark, "/root/testdata/sf0.01", "labels")
    net = quality.fit(docs, labels)
    got = quality.score(docs.select("doc_id", "text"), net).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).toPandas()
    assert ((got.score >= 0.5) == got.quality).mean() > 0.93
    odd = {r.doc_id: r.score for r in quality.score(docs_of(spark, ODD), net).collect()}
    assert len(odd) == len(ODD) and all(0 <= s <= 1 for s in odd.values()) and odd[0] == odd[1]
    assert quality.score(empty(spark), net).count() == 0
    assert quality.score(empty(spark), quality.fit(empty(spark), labels.limit(0))).columns[-1] == "score"


def test_network_gradient():
    s = quality.Settings(filters=3, width=3, embedding=2, chunk=16, stride=10)
    net = quality.Network(s)
    net.p["out"][:] = np.linspace(-1, 1, 7)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raw, y = [b"hello world, this is it", b"ab", b"some some some some other bytes here"], np.array([1.0, 0, 1])

    def loss():
        z = net.forward(raw)[0].astype(float)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = net.gradient(raw, y)
    for name, at in (("out", 1), ("out", 4), ("out", 6), ("shift", 0), ("bias", 1), ("again", 0), ("again", 1), ("conv", (1, 1, 2)), ("emb", (ord("e"), 0))):
        keep, h = net.p[name][at], 1e-3
        net.p[name][at] = keep + h
        up = loss()
        net.p[name][at] = keep - h
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / (2 * h) - g[name][at]) < 2e-3, name


def test_scores_do_not_depend_on_the_batch():
    net = quality.Network(quality.Settings())
    net.p["out"][:] = 1
    raw = [b"one two two two two two two", b"", b"x" * 2000, b"two two two two"]
    assert np.allclose(net.score(raw), [net.score([b])[0] for b in raw], atol=1e-6)
    again = net._repeats(np.frombuffer(b"\0" * 32 + b"abcdefgh word word word word!" + b"\0" * 32, np.uint8), 32, 80)
    assert again[14:20].all() and not again[:13].any()


def test_language_is_learnt(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs)
    got = langid.predict(docs, model).where(quality.held_out(F.col("doc_id"))).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    assert (model.weights == 0).mean() > 0.3 and model.temperature > 0
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs_of(spark, [*ODD, "12 34!"]), model).collect()}
    assert odd[0] == odd[1] == odd[2] == odd[len(ODD)] == ("und", 0.0) and odd[5][0] in model.languages
    assert langid.predict(empty(spark), model).count() == 0
    nothing = langid.predict(docs_of(spark, ["some text"]), langid.fit(empty(spark))).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)


def test_a_long_row_does_not_end_the_sample(spark):
    s = langid.Settings(sample_rows=40, sample_chars=4000, row_chars=1000)
    rows = [(i, f"the words number {i}", "en") for i in range(200)] + [(1000 + i, "long " * 300, "en") for i in range(60)] + [(2000, "seltene Worte", "de"), (2001, "muy largo " * 300, "es"), (2003, "muy largo " * 200, "es"), (2004, "muy largo " * 220, "es")] + [(3000 + i, "12 34", "xx") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnable = {r.lang for r in docs.where(~quality.held_out(F.col("doc_id"))).select("lang").distinct().collect()} - {"xx"}
    assert set(langid.fit(docs, s).languages) == learnable and "es" in learnable
    found = docs.where("lang = 'en'")
    q = quality.Settings(sample_rows=40, sample_bytes=4000, row_bytes=1000)
    labels = found.select("doc_id", (F.col("doc_id") % 50 != 0).cast("int").alias("quality"))
    got = quality.labelled_sample(found, labels, q, "doc_id", "text", "quality")
    assert {y for _, y in got} == {0, 1} and len(got) >= 30 and sum(len(t) for t, _ in got) <= 4000
    assert quality.pick([(0, "a", 9), (1, "a", 50), (2, "a", 9), (3, "b", 10)], {"a": 5, "b": 5}, 40) == [0, 2, 3]


# -- 3 --------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["https://WWW.Example.com/en/x?q", "http://a.example.com/en/", "http://example.com/e", "http://com", "http://com/", "ftp://x.net/es/1#a", "http://xnet/es/", "no scheme", None, "", "http://net/fr/", "://b.com/", "http://a.net/es", "x://h?u=://example.com/en/", "http://ÀB.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("own"))
    rules = queries.URL_RULES

    def plain(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m.group(1)) if m else ""
        path = m.group(2) if m else ""
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    assert [got[i] for i in range(len(urls))] == [plain(u) for u in urls]
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    keys = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("key like '%7'")
    c = urlfilter.Cascade(listed, keys, "test")
    assert len(c.levels) > 1
    assert keys.where(c.contains(F.col("key")) != F.col("key").like("%7")).count() == 0
    nothing = urlfilter.Cascade(listed.limit(0), keys, "test")
    assert keys.where(nothing.contains(F.col("key"))).count() == 0


# -- 4 ---------------------------------------------------------------------------------


def test_main_text_of_a_page(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><div id="cookie-banner">We use <b>cookies</b></div>
    <header class="site"><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav><main><article><header class="entry-header"><h1>Title&nbsp;A &amp; B</h1></header>
    <p>Hello <b>bold</b>\n   world &lt;x&gt;<script>var a="</p>";</script><!-- no --><ul><li>one<li>two</ul><aside>side</aside><form><p>mail</p></form>
    <table><tr><td>a<td>b</table><div class="comments"><p>Nice!</p></div><p>end</article></main><div class=sidebar>x</div><footer>f</footer><p cut"""
    rows = [(0, "http://a.org/1", page), (1, None, None), (2, "x", ""), (3, "http://b.org", "<p>just <i>text</i></p><div class='ad'>buy</div>"), (3, "http://b.org", "plain &eacute; text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in sitestyle.main_text(df).collect())
    want = "Title A & B\nHello bold world <x>\none\ntwo\na\nb\nend"
    assert got == [(0, want, len(want)), (1, "", 0), (2, "", 0), (3, "just text", 9), (3, "plain é text", 12)]
    assert sitestyle.main_text(df.limit(0)).count() == 0


def test_what_all_pages_of_a_host_share_goes(spark):
    page = lambda i: f"<body><div class='x'><p>Same words on all pages</p></div><div class='y'><p>Story {i} of many</p><p>more {i * 7}</p></div></body>"
    df = spark.createDataFrame([(i, f"http://h.org/{i}", page(i)) for i in range(20)] + [(99, "http://other.org/", page(99)), (100, "http://new.org/", "<body><div class='q'><p>Own words</p></div></body>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in sitestyle.main_text(df).collect()}
    assert got[3] == "Story 3 of many\nmore 21"
    # A host with few pages is judged by all hosts, and what is nowhere else stays.
    assert got[99] == "Story 99 of many\nmore 693" and got[100] == "Own words"


def test_the_tree_judges_marked_pages(spark):
    page = lambda i: f"<body><article><h1>Story {i}</h1><p>Words {i * 7}</p><div class='x'><p>Same words on all pages</p></div></article></body>"
    bare = lambda i: f"<body><div class='y'><p>Tale {i}</p></div><div class='z'><p>Shared by marked and bare</p></div></body>"
    mixed = lambda i: bare(i) if i < 2 else f"<body><div class='z'><p>Shared by marked and bare</p></div><main><p>Tale {i}</p></main></body>"
    rows = [(i, "http://h.org/", page(i)) for i in range(12)] + [(20 + i, "http://mixed.org/", mixed(i)) for i in range(12)] + [(40 + i, "http://h2.org/", page(1)) for i in range(5)] + [(50, "http://one.org/", page(1))]
    rows += [(60 + i, "http://copies.org/", "<body><article class='own'><h1>Only</h1><p>copies</p></article></body>") for i in range(5)]
    got = {r.page_id: r.text for r in sitestyle.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3\nWords 21"
    assert got[20] == "Tale 0" and got[25] == "Tale 5"
    assert got[40] == got[50] == "Story 1\nWords 7"
    assert got[60] == "Only\ncopies"


def test_role_words_inside_an_article(spark):
    anchors = "<h2 id='related-work'>Related</h2><section id='social-policy'><p>Policy</p></section><h2 id='search-results'>Results</h2><p class='share-price'>Price</p>"
    page = lambda i: f"<body><article><p>Story {i}</p>{anchors if i == 0 else ''}<div class='notice'>Own notice {i}</div><div class='share-buttons'>Share this</div><div class='comments'>Reader {i}</div></article></body>"
    rows = [(i, "http://h.org/", page(i)) for i in range(12)] + [(20, "http://one.org/", page(0)), (21, "http://two.org/", page(0).replace("<article>", "<article class='solo'>"))]
    got = {r.page_id: r.text for r in sitestyle.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Story 0\nRelated\nPolicy\nResults\nPrice\nOwn notice 0"
    assert got[5] == "Story 5\nOwn notice 5"
    assert got[20] == got[0] and got[21] == "Story 0\nRelated\nPolicy\nResults\nPrice"


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("a <svg class='i'/> b", "a b"),
        ("a <svg><title>t</title><svg><text>x</text></svg><text>y</text></svg> b", "a b"),
        ("a <svg width=1> b", "a b"),
        ("a <math/> b <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='tex'>x=1</annotation></math> c", "a b x=1 c"),
        ("a <iframe src='u'> b", "a b"),
        ("a <video src='u'/> b <object> c", "a b c"),
        ("a <audio>none</audio> b <object>p<object>q</object>r</object> c", "a b c"),
        ("a <svg><!-- </svg> --><text>y</text></svg> b <script>'<svg>'</script> c", "a b c"),
    ],
)
def test_raw_elements_end_where_they_end(inner, want):
    pieces = sitestyle.parse(f"<article><p>{inner}</p><p>end</p></article>")[0]
    assert sitestyle.lines(p for p in pieces if not p[1]) == [want, "end"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p class=it's>hello</p> <p>world's end</p><p>tail</p></article>", "hello\nworld's end\ntail"),
        ("<article><p><a href=foo\"bar>link</a> on</p></article>", "link on"),
        ("<article><p>text <label>inline</label> more</p></article>", "text more"),
        ("<article><p>one<span class='share'> Share</span> two</p></article>", "one two"),
        ("<article><p title='a > b' data-x=\"c > d\">kept</p></article>", "kept"),
        ("<article><p>a < b & c</p><p>cut <b", "a < b & c\ncut"),
        ("<article><p title=\"open>text</p><p>next</p></article>", "text\nnext"),
    ],
)
def test_quotes_and_inline_elements(spark, page, want):
    df = spark.createDataFrame([(1, "http://h.org/", page)], "page_id long, url string, html string")
    assert sitestyle.main_text(df).first().text == want


@pytest.mark.parametrize(
    "unit",
    ["<a '", "<a \"", "<a ='", "<a x=\"", "<svg ", "<!--", "</i", "<div>", "<b>x", "<div>x</span>", "<b></i>", "<p class=a>t", "<ul><li>x", "<table><tr><td>", "<script>", "<svg>", "< ", "<x", "&amp", "<div class='c'>y"],
)
def test_hostile_pages_take_no_longer(unit):
    import time

    page = "<article>" + unit * ((1 << 20) // len(unit))
    start = time.process_time()
    sitestyle._main_blocks(page, set(), set(), set(), set(), set())
    assert time.process_time() - start < 5


def test_main_text_of_the_pages_table(spark):
    pages = queries.table(spark, SF, "pages")
    got = {r.page_id: r.text for r in sitestyle.main_text(pages).collect()}
    import html

    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", body))
        assert got[r.page_id] == "\n".join(p for p in parts if p)


# -- 5 ----------------------------------------------------------------------------------


def test_shards(spark):
    texts = [*ODD, *(f"text {i}" for i in range(95))]
    df = docs_of(spark, texts).union(docs_of(spark, texts[:3]))
    df = df.withColumns({"__block": F.lit(1), "__key": F.lit("own"), "slot": F.lit("own")})
    got = sharding.shuffle_shards(df, 8, seed=3, block_bytes=50).collect()
    assert {(r["__block"], r["__key"]) for r in got} == {(1, "own")}
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted([(i, t or "") for i, t in enumerate(texts)] + [(i, t or "") for i, t in enumerate(texts[:3])])
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shuffle_shards(empty(spark), 8).count() == 0


def test_communication_matrix():
    counts, blocks = np.array([7, 0, 13, 5, 11]), sharding.even_sizes(36, 5)
    rows = np.array([[*sharding.matrix_row(counts, blocks, p, seed)] for seed in range(400) for p in range(5)]).reshape(400, 5, 5)
    assert (rows.sum(2) == counts).all() and (rows.sum(1) == blocks).all()
    assert np.abs(rows.mean(0) - np.outer(counts, blocks) / 36).max() < 0.25
    rng = np.random.default_rng(1)
    big = [sharding.draw_one(rng, 3 * 10**9, 10**9, 4 * 10**6) for _ in range(3)]
    assert all(abs(b - 3 * 10**6) < 10_000 for b in big)


# -- 7 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [(160,), (-160,), (300, -300), (160, 0, -5), (308,)])
def test_nearest_of_very_large_and_small_vectors(spark, sizes):
    rng = np.random.default_rng(4)
    v = [[float(x) * 10.0 ** sizes[i % len(sizes)] for x in rng.uniform(-1, 1, 6)] for i in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    from fractions import Fraction

    def product(a, b):
        x = sum(Fraction(p) * Fraction(q) for p, q in zip(a, b, strict=True))
        try:
            return float(x)
        except OverflowError:
            return float("inf") if x > 0 else -float("inf")

    got = {}
    for r in nearest.nearest(df, df.where("vec_id % 10 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 60, 10):
        s = {i: product(v[q], v[i]) for i in range(60) if i != q}
        want = sorted(s, key=lambda i: (-s[i], i))[:5]
        assert [i for i, _ in got[q]] == want and np.allclose([x for _, x in got[q]], [s[i] for i in want], rtol=1e-9)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(130, 6))
    v[40:60] = v[40]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(500, None), (501, [0.0] * 6), (502, [float("nan")] + [1.0] * 5), (503, [float("inf")] + [1.0] * 5), (504, [None] + [1.0] * 5), (505, []), (None, [1.0] * 6), (506, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(4)
    got = {}
    for r in nearest.nearest(df, df.where("vec_id % 10 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 130, 10))
    for q, found in got.items():
        s = (v * v[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(130), -s)) if i != q][:20]
        assert [i for _, i, _ in found] == want and [k for k, _, _ in found] == list(range(1, 21))
        assert np.abs(s[want] - [x for *_, x in found]).max() < 1e-12
    few = nearest.nearest(df.where("vec_id < 5"), df.where("vec_id = 0"), 20)
    assert few.count() == 4
    assert nearest.nearest(df.limit(0), df.limit(0), 20).count() == 0


# -- 8, 9 ------------------------------------------------------------------------------------

TOKEN_TEXTS = [*ODD, "it's  a \n\n test\t\tx \n y", "I'LL don't 12 ½ 3", "日本語 text", "  lead", "trail  ", "\n", "İstanbul ΣΑΣ", "<|endoftext|> hi", "a\u00a0b\u2003c", "é'sÀÉ ŁłßŒ ***a!!b"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_tokenizer(name):
    enc = textids.TextEncoder(queries.tokenizer_file(name))
    assert enc.pattern is not None
    rows = duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()
    for t in [*TOKEN_TEXTS, *(r[0] for r in rows)]:
        assert enc.packed(t) == (enc.whole(t) if t else b"")


@pytest.mark.parametrize("capacity", [2048, 64, 7, 1])
def test_packing(spark, capacity):
    path = queries.tokenizer_file("word_bpe_49k.json")
    enc = textids.TextEncoder(path)
    want = {i: [*np.frombuffer(enc.packed(t), enc.dtype).tolist(), 1] for i, t in enumerate(TOKEN_TEXTS) if capacity > 1 or i != 7}
    df = docs_of(spark, TOKEN_TEXTS).where(F.lit(capacity > 1) | (F.col("doc_id") != 7))
    got = packing.pack(df, path, 1, capacity).collect()
    ids, seqs = {}, {}
    for r in got:
        piece = np.frombuffer(r.ids, "<u4").tolist()
        assert len(piece) == r.length and r.doc_tokens == len(want[r.doc_id])
        ids.setdefault(r.doc_id, []).append((r.start, piece))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: [x for _, p in sorted(v) for x in p] for d, v in ids.items()} == want
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(empty(spark), path, 1, capacity).count() == 0


def test_cuts():
    for c in (2048, 100, 33, 1):
        for n in [*range(0, 3 * c + 2)]:
            assert sum(packing.cut(n, c)) == n and all(0 < m <= c for m in packing.cut(n, c))


def test_tables_come_back(spark):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    enc = textids.TextEncoder(path)
    texts = [*TOKEN_TEXTS, *(f"number {i}" for i in range(80))]
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)] + [(None, "nobody"), (4, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("own")).repartition(5)
    tables = sstable.write_tables(df, path, 0, shards=4)
    got = sstable.read_tables(tables).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    plain = {}
    for d, t in rows:
        plain.setdefault(d, []).append([*np.frombuffer(enc.packed(t), enc.dtype).tolist(), 0])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in plain[r.doc_id] and r.start == at and r.n_tokens == len(ids)
        at += len(ids)
    asked = spark.createDataFrame([(4,), (7,), (8,), (10**12,), (None,)], "doc_id long")
    found = sorted((-1 if r.doc_id is None else r.doc_id) for r in sstable.lookup(asked, tables).collect())
    assert found == [-1, 4, 4, 7]
    assert sstable.read_tables(sstable.write_tables(empty(spark), path, 0, shards=2)).count() == 0


def test_keys_keep_their_order():
    ids = [None, -(2**63), -5, -1, 0, 1, 7, 2**40, 2**63 - 1]
    keys = [sstable.encode_key(i) for i in ids]
    assert keys == sorted(keys) and [sstable.decode_key(k) for k in keys] == ids


# -- 10 --------------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(texts, items, size=10):
    out = []
    for t in texts:
        w, hit, named = plain_words(t), set(), set()
        for i, b in items:
            words = plain_words(b)
            for s in range(max(1, len(words) - size + 1)) if words else ():
                g = words[s : s + size]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        named.add(i)
        out.append((len(w), len(hit), len(named), sorted(str(i) for i in named)))
    return out


def test_contamination(spark):
    a = "the quick brown fox jumps over the lazy dog and runs away from the bear"
    items = [(1, a), (12, "Short Item"), (3, None), (4, "..."), (5, "É accents über ÀB"), (6, a), (70, "the the the the the the the the the the the the")]
    w = a.split()
    texts = [*ODD, a, a.upper(), " ".join(w[:10]), " ".join(w[1:11]) + "," + " ".join(w[3:]), " ".join(w[:9]), "a short, item here SHORT item", "é accents über Àb", "É accents über Àb", "É accents über ÀB", "the " * 15, "short", f"{a}. {a}", "x y z " + " ".join(w[5:])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, list(r.item_ids)) for r in contamination.find(docs_of(spark, texts), bench).collect()}
    want = plain_hits([t if i != 7 else None for i, t in enumerate(texts)], items)
    want[7] = (30_000, 0, 0, [])
    assert [got[i] for i in range(len(texts))] == want
    assert contamination.find(empty(spark), bench).count() == 0
    assert contamination.find(docs_of(spark, ODD), bench.limit(0)).where("contaminated").count() == 0
    twice = docs_of(spark, [a], extra=False)
    assert [r.n_hit for r in contamination.find(twice.union(twice), bench).collect()] == [15, 15]


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    windows = contamination.windows_of(bench, "item_id", "text", 4)
    docs = spark.createDataFrame([(0, "zz delta alpha x gamma beta yy"), (1, "alpha beta a b c d gamma delta"), (2, "alpha beta gamma delta")], "doc_id long, text string")
    words = docs.select(F.col("doc_id").alias("key"), contamination.words_of(F.col("text")).alias("w"))
    index = contamination.PositionalIndex(words, windows, 10)
    assert sorted(r.key for r in index.phrases().collect()) == [2]
    assert sorted({r.key for r in index.proximities(1).collect()}) == [0, 2]
    for slack, want in ((0, [2]), (1, [0, 2]), (4, [0, 1, 2])):
        got = contamination.find(docs, bench, 4, slack=slack).collect()
        assert sorted(r.doc_id for r in got if r.near_ids == ["1"]) == want and [r.doc_id for r in got if r.contaminated] == [2]


def test_proximity_reaches_all_words_before_the_rarest(spark):
    w = [f"w{i}" for i in range(10)]
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    texts = [" ".join([*w[:9], "x", "y", w[9]]), " ".join([*w[:9], "x", "y", "z", w[9]])]
    common = [" ".join(w[:9])] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *common])], "doc_id long, text string")
    got = contamination.find(docs, bench, 10, slack=2).collect()
    assert sorted(r.doc_id for r in got if r.near_ids) == [0]


def test_sql_forms(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        cols = sorted(got.columns)
        a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
        assert (a.astype(object).fillna("~") == b.astype(object).fillna("~")).all().all(), name


def test_later_filters_do_not_grow_with_the_universe(spark, monkeypatch):
    listed = spark.range(3).select(F.concat(F.lit("host"), "id", F.lit("/")).alias("key"))
    sizes = []
    for n in (50_000, 200_000, 800_000):
        universe = spark.range(n).select(F.concat(F.lit("host"), "id", F.lit("/")).alias("key"))
        made = urlfilter.Cascade(listed, universe, f"u{n}")
        sizes.append([bits for _, bits in made.levels])
        found = universe.where(made.contains(F.col("key"))).collect()
        assert sorted(r.key for r in found) == ["host0/", "host1/", "host2/"]
    assert all(max(s[1:], default=0) <= 256 for s in sizes) and sizes[2][0] <= 4096
    monkeypatch.setattr(urlfilter, "MAX_BYTES", 8)
    with pytest.raises(ValueError, match="split the list"):
        urlfilter.Cascade(listed, universe, "large")


def test_urls_that_are_long_or_repeated(spark):
    long = "http://www.example.com/en/" + "a" * 200_000
    df = spark.createDataFrame([(1, long), (1, long), (2, "http://" + "x." * 300 + "net/es/y"), (3, None)], "page_id long, url string")
    got = sorted((r.page_id, r.rule or "", r.verdict) for r in urlfilter.judge(df, queries.URL_RULES).collect())
    assert got == [(1, "www.example.com/en/", "allow"), (1, "www.example.com/en/", "allow"), (2, "net/es/", "block"), (3, "", "allow")]


# -- 11 to 13 ------------------------------------------------------------------------


def plain_ranking(docs, items, k):
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, w in held:
            m = 50 + 50 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in set(words(text)) if t in df)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def test_ranked_search(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 16)
    monkeypatch.setattr(ranked, "FIRST_DOCS", 2)
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(40)])
    weights = 1 / np.arange(1, 41)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 30), p=weights / weights.sum())) for _ in range(300)]
    texts[5] = texts[6] = texts[7] = texts[250]
    rows = list(enumerate([*ODD, *texts, "ÄB äb W1", "w1 " * 20_000]))
    rows += [(None, "w3 w4"), (9, "w39 w38"), (9, "w39 w38")]
    items = [(1, "w0 w1 w2"), (2, " ".join(vocabulary)), (3, None), (4, "..."), (5, "W39, w38; unknown"), (None, "äb"), (6, "w0 w1 w2"), (7, "w1"), (8, " ".join(f"w{i}" for i in range(20)) + " " + " ".join(f"u{i}" for i in range(100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("rank", F.lit("own")).withColumn("item", F.lit("own"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("own"))
    want = sorted(plain_ranking(rows, items, 10), key=lambda r: (r[0] or -1, *r[1:]))
    key = lambda r: (r.item_id or -1, r["rank"])
    for terms in (None, 30):
        got = [tuple(r) for r in sorted(ranked.search(docs, bench, 10, pass_terms=terms).collect(), key=key)]
        assert got == want
    # Equal rows are documents of their own, and equal items are asked once.
    twice = ranked.search(docs, bench.union(bench), 10)
    assert twice.count() == len(want)
    assert ranked.search(docs.limit(0), bench).count() == 0 and ranked.search(docs, bench.limit(0)).count() == 0


def plain_divergence(rows, least, top):
    words = lambda t: re.findall(rb"[a-z\x80-\xff]+", (t or "").encode().lower())
    rows = [(words(t), g or "", s or "") for t, g, s in rows]
    out = []
    for g in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == g]
        df = {}
        for w, _, _ in mine:
            for t in set(w):
                df[t] = df.get(t, 0) + 1
        kept = [t for t in df if df[t] >= least]
        count = {}
        for w, _, s in mine:
            for t in kept:
                count[s, t] = count.get((s, t), 0) + w.count(t)
        sources = sorted({r[2] for r in mine})
        total = {s: sum(count[s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 1_000_000_000 * (count[s, t] + 2) // (total[s] + 2 * len(kept)) for s in sources for t in kept}
        q = {t: 1 + 1_000_000_000 * (sum(count[s, t] for s in sources) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s, t], p[u, t]) for t in kept), u) for u in sources if u != s)
            out += [(g, s, "pair", u, -v, i + 1) for i, (v, u) in enumerate(pairs)]
            terms = sorted((-f(p[s, t], q[t]), t) for t in kept if count[s, t] and p[s, t] > q[t])
            out += [(g, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms[:top])]
    return out


def test_source_divergence(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_COUNTS", 50)
    monkeypatch.setattr(divergence, "TREE_ROWS", 7)
    rng = np.random.default_rng(5)
    vocabulary = [f"{'abcdefgh'[i % 8]}{'xyzé'[i // 8]}" for i in range(32)]
    rows = [(" ".join(rng.choice(vocabulary, rng.integers(1, 12))) + " 12", "ab"[i % 2], f"s{rng.integers(0, 6)}") for i in range(200)]
    rows += [("only here", "a", "empty"), ("...", "a", "none"), (None, "b", None), ("ax", None, None), ("ax " * 20_000, "a", "s1"), ("rare", "c", "x"), ("rare", "c", "y"), ("AX ax", "a", "s2"), ("AX ax", "a", "s2")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3).withColumn("rank", F.lit("own")).withColumn("sid", F.lit("own"))
    got = [tuple(r) for r in divergence.audit(docs, 4, 3).collect()]
    assert sorted(got) == sorted(plain_divergence(rows, 4, 3))
    assert {r[4] for r in got if r[0] == "c"} == {0} and divergence.audit(docs.limit(0)).count() == 0


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        out.append((len(r), int(gone.sum()), spans, bytes(b for b, g in zip(r, gone, strict=False) if not g)))
    return out


def repeating_texts(seed):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abcé "), 300)) for _ in range(6)]
    out = [None, "", "short", "a" * 500, "ab" * 150, "x" * 39, "x" * 40, base[0], base[0], base[1][:200]]
    for _ in range(60):
        a, b = base[rng.integers(6)], base[rng.integers(6)]
        i, j = rng.integers(0, 250, 2)
        t = "".join(rng.choice(list("xyz"), rng.integers(0, 40))) + a[i : i + rng.integers(10, 120)] + b[j : j + rng.integers(10, 120)]
        out.append(t[: len(t) // 2] + "Q" + t[len(t) // 2 :] if rng.random() < 0.5 else t)
    return [*out, *out[-5:], "\0" * 100 + "z", "\0" * 90, "long " * 30_000]


@pytest.mark.parametrize(("hot", "piece", "run_bytes"), [(None, None, None), (3, 4096, 20_000), (0, 4096, 5000)])
def test_repeated_strings_go(spark, monkeypatch, hot, piece, run_bytes):
    if piece:
        monkeypatch.setattr(suffixes, "PIECE", piece)
        monkeypatch.setattr(suffixes, "RUN_BYTES", run_bytes)
        monkeypatch.setattr(suffixes, "RANGE_ENTRIES", 50)
    texts = repeating_texts(11)
    docs = docs_of(spark, texts).withColumn("n_bytes", F.lit("own"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in suffixes.remove_repeats(docs, 40, gram=16, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats(texts, 40)
    assert suffixes.remove_repeats(empty(spark)).count() == 0


def test_anchors_are_gone_before_the_texts_are_shuffled(spark, monkeypatch):
    there, paths = {}, {}

    def write(df, name, **options):
        there[name] = {n for n, p in paths.items() if os.path.exists(p.removeprefix("file://"))}
        out = materialise(df, name, **options)
        paths[name] = out._weftline_path
        return out

    monkeypatch.setattr(suffixes, "materialise", write)
    suffixes.remove_repeats(docs_of(spark, ["a" * 500, "b" * 60]), 40, gram=16).collect()
    assert "anchors" in there["entries"] and not there["runs"] & {"anchors", "repeated-grams"} and "entries" not in there["merged"]


def test_loser_tree_merges_front_coded_runs():
    rng = np.random.default_rng(8)
    runs = [sorted(bytes(rng.choice([97, 98], rng.integers(1, 12)).astype(np.uint8)) for _ in range(rng.integers(0, 40))) for _ in range(7)]
    blocks = [suffixes.front_code([(x, b"", i, 0, 0) for i, x in enumerate(r)], 12) for r in runs if r]
    out = [(k, e[1]) for _, k, e in suffixes.LoserTree([suffixes.front_decode(b) for b in blocks])]
    assert [x for _, x in out] == sorted(x for r in runs for x in r)
    common = lambda a, b: next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    assert [k for k, _ in out] == [0, *(common(a[1], b[1]) for a, b in itertools.pairwise(out))]


@pytest.mark.parametrize("slack", [None, 2])
def test_many_terms_are_shuffled_without_texts(spark, monkeypatch, slack):
    a = "the quick brown fox jumps over the lazy dog and runs away from the bear"
    bench = spark.createDataFrame([(1, a), (2, "over the lazy dog"), (3, "not there")], "item_id long, text string")
    docs = docs_of(spark, [*ODD, a, f"x {a} y {a}", "over lazy the dog", "the " * 50])
    row = lambda r: (r.doc_id, r.n_words, r.n_hit, r.item_ids, *([r.near_ids] if slack else []))
    few = sorted(map(row, contamination.find(docs, bench, 6, slack=slack).collect()))
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", 0)
    assert sorted(map(row, contamination.find(docs, bench, 6, slack=slack).collect())) == few


def test_starts_of_blocks_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_BLOCKS", 3)
    docs = docs_of(spark, [f"text {i} " * (i % 9) for i in range(400)])
    got = sharding.shuffle_shards(docs, 3, seed=5, block_bytes=500).toPandas()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard")) and len(got) == 400


def test_shards_of_tables_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BYTES", 20_000)
    docs = docs_of(spark, ["some words " * 50] * 100 + [None, ""])
    shards = sstable.write_tables(docs, queries.tokenizer_file("byte_bpe_50k.json"), 0)
    assert 2 <= shards.count() <= 4 and sstable.read_tables(shards).count() == 102
