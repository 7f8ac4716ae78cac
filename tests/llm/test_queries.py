"""The registered queries of the numbered operators against brute force, all contract columns, on small tables."""

import hashlib
import html
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm import langid, minhash, quality, queries, sitestyle

SF = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "one", "Two WORDS", "½ ² Ⅷ 12 !", "हिन्दी में लेख", "日本語", "a b", "x" * 5000, "long words go on " * 6000, "same text here and there", "same text here and there", "Same TEXT here and there"]


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def held(doc_id) -> bool:
    return doc_id is not None and crc(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """The smallest tables with odd rows besides, and columns whose names clash with results."""
    d = tmp_path_factory.mktemp("small")
    docs = pq.read_table(f"{SF}/documents.parquet")
    names = docs.column_names
    rows = docs.to_pylist()
    top = max(r["doc_id"] for r in rows)
    for i, t in enumerate(ODD):
        rows.append(dict.fromkeys(names) | {"doc_id": top + 1 + i, "text": t})
    # Near copies: one word of many changed.
    words = next(r["text"] for r in rows if r["text"] and len(r["text"].split()) > 300).split()
    for i in range(5):
        rows.append(dict.fromkeys(names) | {"doc_id": top + 100 + i, "text": " ".join([*words[: 40 * i], "changed", *words[40 * i + 1 :]])})
    clash = {c: ["own"] * len(rows) for c in ("score", "shard", "slot", "n_words", "component_id", "lang_pred", "__key", "w")}
    table = pa.Table.from_pylist(rows, docs.schema)
    for c, v in clash.items():
        if c not in names:
            table = table.append_column(c, pa.array(v))
    pq.write_table(table, f"{d}/documents.parquet")
    for t in ("labels", "pages", "benchmark", "embeddings"):
        pq.write_table(pq.read_table(f"{SF}/{t}.parquet"), f"{d}/{t}.parquet")
    return str(d), {r["doc_id"]: r["text"] for r in rows}, {r["doc_id"]: r for r in rows}


def run(spark, name, d):
    return queries.QUERIES[name](spark, d).toPandas()


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def test_op1(spark, small):
    d, texts, _ = small
    got = run(spark, "op1_minhash_dedup", d)
    comp, size = components(texts, 3, 85)
    assert len(got) == len(texts) and got.doc_id.is_unique
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.itertuples()} == {i: (size[i], comp[i], comp[i] == i) for i in texts}
    assert len(set(comp.values())) < len(comp) - 5


def test_equal_first_sums_do_not_join(spark, monkeypatch):
    """Sets whose first sums clash are told by the second."""
    monkeypatch.setattr(minhash, "_sums", lambda v: (7, int(np.sort(v)[0].astype(np.int64)) if len(v) else 0))
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (3, "a b c d")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.n_copies) for r in minhash.near_duplicates(docs, plan=minhash.Plan(shingle_words=3, percent=85)).collect())
    assert got == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


def slow_score(net, raw):
    """The network's score of one text, a place and a filter at a time."""
    s, p = net.s, net.p
    data = raw if len(raw) >= s.width else raw.ljust(s.width, b"\0")
    at = lambda i: data[i] if 0 <= i < len(data) else 0
    places = len(data) - s.width + 1
    z = np.zeros((places, s.filters))
    for i in range(places):
        again = any(all(at(i + r) == at(i + r - lag) for r in range(s.run)) for lag in range(2, s.lags + 1))
        z[i] = p["bias"] + again * p["again"] + sum(p["emb"][data[i + w]].astype(float) @ p["conv"][w].astype(float) for w in range(s.width))
    begins = range(0, max(1, len(data) - (s.chunk - s.stride)), s.stride)
    pooled = np.array([np.maximum(z[b : b + s.chunk - s.width + 1].max(0), 0) for b in begins])
    doc = np.concatenate((pooled.mean(0), pooled.max(0), [np.exp(-len(raw) / 100)]))
    return 1 / (1 + np.exp(-(doc @ p["out"] + p["shift"][0])))


def test_op2(spark, small):
    d, texts, _ = small
    got = run(spark, "op2_quality_classifier", d)
    assert sorted(got.doc_id) == sorted(texts)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.itertuples())
    docs, labels = queries.table(spark, d, "documents"), queries.table(spark, d, "labels")
    net = quality.fit(docs, labels)
    score = dict(zip(got.doc_id, got.score, strict=True))
    for i in [*sorted(texts)[:6], *sorted(texts)[-18:-8]]:
        if len(texts[i] or "") < 4000:
            assert abs(score[i] - slow_score(net, (texts[i] or "").encode())) < 1e-4
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = [(score[i] >= 0.5) == bool(q) for i, q in truth.items() if held(i) and i in score]
    assert np.mean(right) > 0.9
    long = b"".join(bytes([65 + i % 23]) * (1 + i % 7) for i in range(90_000))
    assert np.allclose(net.score([long]), 1 / (1 + np.exp(-net.forward([long])[0].astype(float))), atol=1e-5)


def slow_language(model, text):
    """Language and probability by n-grams one at a time."""
    s = model.settings
    c = [ord(x) for x in " " + "".join(x if langid.regex.match(r"[\p{L}\p{M}]", x) else "\0" for x in text.lower()).replace("\0", " ").strip() + " "]
    c = [x for i, x in enumerate(c) if not (x == 32 and i and c[i - 1] == 32)]
    count = np.zeros(s.buckets)
    for n in s.orders:
        for i in range(len(c) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 0x01000193 + c[i + k] * 0x9E3779B1 + k + 1) % 2**32
            h = (h ^ (h >> 15)) * 0x85EBCA6B % 2**32
            count[h >> (32 - (s.buckets.bit_length() - 1))] += 1
    o = (count / count.sum() * model.idf * s.scale) @ model.weights + model.bias
    p = np.exp((o - o.max()) / model.temperature)
    return model.languages[int(p.argmax())], p.max() / p.sum()


def test_op6(spark, small):
    d, texts, rows = small
    got = run(spark, "op6_language_id", d)
    assert sorted(got.doc_id) == sorted(texts) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got.itertuples())
    found = {r.doc_id: (r.lang_pred, r.score) for r in got.itertuples()}
    for i, t in texts.items():
        letters = any(langid.regex.match(r"\p{L}", c) for c in t or "")
        assert (found[i][0] == "und") == (not letters) and (letters or found[i][1] == 0)
    model = langid.fit(queries.table(spark, d, "documents"))
    for i in sorted(texts)[:12]:
        if texts[i] and len(texts[i]) < 20_000:
            lang, p = slow_language(model, texts[i])
            assert found[i][0] == lang and abs(found[i][1] - p) < 1e-3
    right = [found[i][0] == r["lang"] for i, r in rows.items() if held(i) and r.get("lang") and found[i][0] != "und"]
    assert np.mean(right) > 0.9


def test_pieces_of_long_texts_have_all_grams(monkeypatch):
    s = langid.Settings()
    text = "Übung macht den Meister, sagt man 12 mal. " * 40
    whole = np.concatenate(list(langid.grams(text, s)))
    monkeypatch.setattr(langid, "PIECE", 37)
    assert sorted(np.concatenate(list(langid.grams(text, s))).tolist()) == sorted(whole.tolist())


def article(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", body))
    return "\n".join(p for p in parts if p)


def test_op4(spark, small):
    got = run(spark, "op4_html_text", small[0])
    pages = queries.table(spark, SF, "pages").toPandas()
    want = {r.page_id: (r.url, article(r.html)) for r in pages.itertuples()}
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got.itertuples()} == {i: (u, t, len(t)) for i, (u, t) in want.items()}


def test_the_tree_alone_finds_main_text(spark):
    """With all names of tags and classes made neutral, only the trees can tell the article from the rest."""
    pages = queries.table(spark, "/root/testdata/sf0.01", "pages").toPandas()

    def neutral(page):
        for i, t in enumerate(("article", "nav", "footer")):
            page = page.replace(f"<{t}>", f"<div class='k{i}'>").replace(f"</{t}>", "</div>")
        return page.replace('class="ad"', 'class="k9"')

    df = spark.createDataFrame([(r.page_id, r.url, neutral(r.html)) for r in pages.itertuples()], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in sitestyle.main_text(df).collect()}
    assert not [r.page_id for r in pages.itertuples() if got[r.page_id] != article(r.html)]


def test_importances(spark):
    """Presentation and importance of nodes against plain counting."""
    page = lambda i: f"<body><ul><li>home</li><li>news</li></ul><div class='t'>{'<p>word</p>' * (i % 5)}<p>text {i}</p></div></body>"
    rows = [(f"http://h.org/{i}", page(i)) for i in range(20)] + [("http://rare.org/", page(3))]
    got = {(r.host, r.node): r for r in sitestyle.style_tree(spark.createDataFrame(rows, "url string, html string")).collect()}
    nodes = {x.sign: x.path for x in sitestyle.parse(page(3))[1]}

    def plain(styles, contents, m):
        entropy = lambda v: -sum(v.count(x) / len(v) * np.log(v.count(x) / len(v)) for x in set(v))
        shown = min(1, entropy(styles) / np.log(min(m, 16)))
        matter = 1 - sum(np.log(contents.count(x)) for x in contents) / len(contents) / np.log(m)
        w = 0.9 ** len(set(styles))
        return shown, (1 - w) * shown + w * matter

    for host, m, of in (("h.org", 20, range(20)), ("rare.org", 21, [*range(20), 3])):
        for sign, styles, contents in (("ul  ", ["a"] * m, ["home news"] * m), ("div t ", [i % 5 for i in of], [f"{i % 5} {i}" for i in of])):
            r, (shown, importance) = got[(host, nodes[sign])], plain(styles, contents, m)
            assert r.pages == m and abs(r.presentation - shown) < 1e-9 and abs(r.importance - importance) < 1e-9


def test_op5(spark, small):
    d, texts, _ = small
    got = run(spark, "op5_sharding", d)
    assert {r.doc_id: (r.size, r.text_crc32, r.law) for r in got.itertuples()} == {i: (len((t or "").encode()) + 1, crc((t or "").encode()), "rows") for i, t in texts.items()}
    assert got.grown_shard.isna().all() and sorted(got.shard.unique()) == list(range(8))
    counts = got.shard.value_counts()
    assert counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_op7(spark, small):
    got = run(spark, "op7_nearest_neighbours", small[0])
    e = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    ids, v = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], float)
    for q in ids[ids % 20 == 0].tolist():
        s = v @ v[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and list(mine.vec_id) == ids[order].tolist() and np.allclose(mine.score, s[order], rtol=1e-12)
    assert len(got) == 20 * (ids % 20 == 0).sum()


def plain_ids(name, texts, end):
    t = Tokenizer.from_file(queries.tokenizer_file(name))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, end] for i, x in texts.items()}


def test_op8(spark, small):
    d, texts, _ = small
    got = run(spark, "op8_packing", d)
    want = plain_ids("word_bpe_49k.json", texts, 1)
    pieces = {}
    for r in got.itertuples():
        assert r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == crc(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, ids in want.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == len(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length.to_numpy())[:-1]]).all() and g.length.sum() <= 2048


def test_op9(spark, small):
    d, texts, _ = small
    got = run(spark, "op9_sstable", d)
    want, at, rows = plain_ids("byte_bpe_50k.json", texts, 0), 0, []
    for i in sorted(texts):
        rows.append((i, at, len(want[i]), crc(np.array(want[i], "<u4").tobytes())))
        at += len(want[i])
    assert sorted(map(tuple, got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False))) == rows


def test_op10(spark, small):
    d, texts, _ = small
    got = run(spark, "op10_decontamination", d)
    items = [(r["item_id"], plain_words(r["text"])) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    windows = {}
    for i, w in items:
        for s in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[s : s + 10]), set()).add(str(i))
    sizes = {len(g) for g in windows}
    for r in got.itertuples():
        w, hit, named = plain_words(texts[r.doc_id]), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    named |= who
        want = (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want
    assert len(got) == len(texts)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_stages_against_brute_force(spark, small):
    d, texts, _ = small
    docs = queries.table(spark, d, "documents")
    # Near-duplicates: the least id of each group of five-word sets at 0.8 stays.
    comp, _ = components(texts, 5, 80)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, d)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({*comp.values()})
    # Contaminated documents go, by the query's own result.
    hit = set(run(spark, "op10_decontamination", d).query("contaminated").doc_id)
    clean = corpus_pipeline.drop_contaminated(spark, docs, d)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.select("doc_id").collect()} == texts.keys() - hit
    score = run(spark, "op2_quality_classifier", d)
    good = corpus_pipeline.keep_quality(spark, docs, d)
    assert {r.doc_id for r in good.select("doc_id").collect()} == set(score[score.score >= 0.5].doc_id)
    lang = run(spark, "op6_language_id", d)
    named = corpus_pipeline.keep_languages(spark, docs, d)
    assert {r.doc_id for r in named.select("doc_id").collect()} == set(lang[(lang.lang_pred != "und") & (lang.score >= 0.5)].doc_id)


def test_repeated_ids_keep_what_is_like_nothing(spark):
    long = " ".join(f"word{i}" for i in range(60))
    near = long.replace("word59", "other")
    rows = [(1, long), (5, long), (5, " ".join(f"own{i}" for i in range(60))), (7, "x y z"), (8, near), (9, "a b c d e f"), (9, "a b c d e f"), (9, "p q r s t u"), (4, ""), (4, None), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("group_id", F.lit(1)).withColumn("__key0", F.lit("own"))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, long), (5, rows[2][1]), (7, "x y z"), (9, "a b c d e f"), (9, "p q r s t u"), (4, ""), (4, None), (None, long)]
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted((i or 0, t or "") for i, t in want)


def test_stages_take_empty_tables(spark, small):
    docs = queries.table(spark, small[0], "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small[0])
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.pack_sequences(spark, docs, small[0]).count() == 0


def test_the_pipeline_runs_on_an_empty_table(spark, small, tmp_path):
    for t in ("labels", "benchmark"):
        queries.table(spark, small[0], t).write.parquet(f"{tmp_path}/{t}.parquet")
    queries.table(spark, small[0], "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert got.count() == 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)
