"""The registered queries of the numbered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import contamination, divergence, langid, minhash, nearest, packing, quality, ranked, sharding, sitestyle, sstable, suffixes, urlfilter

#: (verdict, host, path prefix) of the URL filter's query.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
SHARDS = 8


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of three-word shingles at 0.85."""
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"), plan=minhash.Plan(shingle_words=3, percent=85))
    return out.select("doc_id", "n_shingles", "component_id", "kept", "n_copies")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of whole documents by the byte-level network."""
    docs = table(spark, sf_dir, "documents")
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs.select("doc_id", "text"), net, keep=["doc_id"])
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = sitestyle.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", "n_chars")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform shuffle of whole documents into eight shards; sizes and checksums are of the rows as exchanged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shuffle_shards(docs, SHARDS, seed=11, stable=True)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of whole documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    out = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every twentieth one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to sorted-string-table shards and read back."""
    shards = sstable.write_tables(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return sstable.read_tables(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside ten-word windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination.find(docs, table(spark, sf_dir, "benchmark"), 10, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty highest-scoring documents of each benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far sources of a language diverge in their words, and by which terms."""
    return divergence.audit(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of documents without strings of 200 bytes that start elsewhere too; rows are told by file and place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    out = suffixes.remove_repeats(docs, 200, keep=["doc_id"], key=["file", "row"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_url_filter": op3_url_filter,
    "op4_html_text": op4_html_text,
    "op5_sharding": op5_sharding,
    "op6_language_id": op6_language_id,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_packing": op8_packing,
    "op9_sstable": op9_sstable,
    "op10_decontamination": op10_decontamination,
    "op11_ranked_search": op11_ranked_search,
    "op12_source_divergence": op12_source_divergence,
    "op13_suffix_dedup": op13_suffix_dedup,
}

_URL_SQL = """
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
j AS (
  SELECT u.*, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN rules r ON (u.host = r.h OR suffix(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE k = 1
"""

_PHRASE_SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
b AS (SELECT item_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM d, lens, unnest(range(1, len(w) - n + 2)) t(i)),
occ AS (SELECT DISTINCT p.doc_id, p.i, p.n, k.item_id FROM pos p JOIN win k ON p.g = k.g AND p.n = k.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM occ, unnest(range(i, i + n)) t(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM occ GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_PAIRS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END) AS g FROM d),
m AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM m a JOIN m b ON a.k = b.k AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, least(s.doc_id, c.y) AS component_id, s.doc_id = least(s.doc_id, c.y) AS kept,
       CASE WHEN len(g) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY g) END::BIGINT AS n_copies
FROM s LEFT JOIN c ON c.x = s.doc_id
"""

_RANKED_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, [x FOR x IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
i AS (SELECT DISTINCT item_id, list_sort(list_distinct([x FOR x IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF x <> ''])) AS w FROM benchmark),
q AS (SELECT item_id, unnest(w) AS t FROM i),
c AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT id, doc_id, n, t, count(*) AS tf FROM (SELECT id, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
g AS (SELECT p.id, p.doc_id, p.t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l))) AS s
      FROM p JOIN f ON f.t = p.t, c),
s AS (SELECT item_id, id, doc_id, sum(s)::BIGINT AS score FROM q JOIN g ON g.t = q.t GROUP BY ALL),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""

_DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
s AS (SELECT id, lang, source, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
w AS (SELECT * FROM s WHERE term <> ''),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
t AS (SELECT lang, source, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.n, 0) + 2 * v.v) AS p,
             1 + (1000000000 * (k.n + 2)) // (v.n + 2 * v.v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10
"""

_REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
q AS (SELECT id, a, least(500, len(h) // 2 - 199 - a) AS m, substring(h, 2 * a + 1, 1398) AS h FROM d, unnest(range(0, greatest(0, len(h) // 2 - 199), 500)) t(a)),
w AS (SELECT id, a + i AS i, md5_number(substring(h, 2 * i + 1, 400)) AS g FROM q, unnest(range(0, m)) t(i)),
r AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
s AS (SELECT id, i FROM w SEMI JOIN r ON w.g = r.g),
b AS (SELECT id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM s),
n AS (SELECT id, i, sum(new) OVER (PARTITION BY id ORDER BY i) AS k FROM b),
p AS (SELECT id, k, min(i) AS lo, max(i) + 200 AS hi FROM n GROUP BY id, k),
c AS (SELECT id, sum(hi - lo)::BIGINT AS gone, count(*) AS spans FROM p GROUP BY id),
k AS (SELECT id, hi AS lo, lead(lo, 1, 1000000000) OVER (PARTITION BY id ORDER BY lo) AS hi FROM p UNION ALL SELECT id, 0, min(lo) FROM p GROUP BY id),
t AS (SELECT k.id, string_agg(substring(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS h FROM k JOIN d ON d.id = k.id GROUP BY k.id)
SELECT doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(t.h, d.h))) AS kept_sha256
FROM d LEFT JOIN c ON c.id = d.id LEFT JOIN t ON t.id = d.id
"""

ORACLES: dict[str, str] = {"op1_minhash_dedup": _PAIRS_SQL, "op3_url_filter": _URL_SQL, "op10_decontamination": _PHRASE_SQL, "op11_ranked_search": _RANKED_SQL, "op12_source_divergence": _DIVERGENCE_SQL, "op13_suffix_dedup": _REPEATS_SQL}
