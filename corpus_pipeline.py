"""A corpus pipeline of five stages, each one operator over all its input.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. ``run`` writes each stage's result to the shared
folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import contamination, langid, minhash, packing, quality
from weftline.llm.queries import table, tokenizer_file
from weftline.session import materialise, release, written

#: A language below this calibrated probability is no decision, and the document goes.
LEAST_CONFIDENCE = 0.5
#: Identifiers of dropped documents that are broadcast at most; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5.

    A null text is scored as an empty one; very long texts are scored whole.
    Repeated rows and null identifiers each keep their own decision, which the
    text alone makes. An empty table stays empty, and without labels all rows
    score 0.5 and stay.
    """
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    held = docs.withColumnRenamed("score", "__score")
    out = quality.score(held, net).where("score >= 0.5").drop("score")
    return out.withColumnRenamed("__score", "score").select(docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: letters, and a calibrated probability of at least 0.5.

    Null and empty texts, and others without letters, have none and go; very long
    texts are read whole. Repeated rows and null identifiers each keep their own
    decision. An empty table stays empty; where no row has a language to learn
    from, nothing is known and nothing stays.
    """
    model = langid.fit(docs)
    named = [c for c in docs.columns if c in ("lang_pred", "score")]
    held = docs.withColumnsRenamed({c: f"__{c}" for c in named})
    out = langid.predict(held, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_CONFIDENCE))
    return out.drop("lang_pred", "score").withColumnsRenamed({f"__{c}": c for c in named}).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), that of the least id.

    Rows of one id are told apart by their texts: of those in one group one stays,
    and one that is like nothing stays beside its namesakes. Rows of a null id are
    left alone, and so are null, empty and wordless texts, which are like nothing.
    Very long texts are compared whole; an empty table stays empty.
    """
    found = materialise(minhash.near_duplicates(docs), "near-duplicates").where("doc_id is not null")
    again = materialise(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    dropped = found.where("not kept").select("doc_id").distinct()
    if again.isEmpty():
        return docs.join(_few(materialise(dropped, "dropped")), "doc_id", "left_anti").select(docs.columns)
    again = _few(again)
    gone = _few(materialise(dropped.union(again), "dropped"))
    key, cls, group = (next(n for i in range(len(docs.columns) + 1) if (n := f"__{name}{i}") not in docs.columns) for name in ("key", "class", "group"))
    rows = materialise(docs.join(again, "doc_id", "left_semi").withColumn(key, F.monotonically_increasing_id()), "rows-of-repeated")
    told = found.where("kept or class_id is null").join(again, "doc_id", "left_semi").select("doc_id", F.coalesce("class_id", F.lit("")).alias(cls), F.col("group_id").alias(group)).distinct()
    with_class = rows.join(minhash.class_ids(rows, key).select(F.col("key").alias(key), F.coalesce("class_id", F.lit("")).alias(cls)), key)
    stays = with_class.join(told, ["doc_id", cls])
    one = stays.where(F.col(group).isNotNull()).dropDuplicates(["doc_id", group]).unionByName(stays.where(F.col(group).isNull()))
    return docs.join(gone, "doc_id", "left_anti").unionByName(one.select(docs.columns)).select(docs.columns)


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item.

    An item of fewer words is one window. Null, empty and wordless texts hit
    nothing and stay; very long texts are searched whole; repeated rows and null
    identifiers each keep their own decision; an empty table stays empty.
    """
    made = {c: f"__{c}" for c in ("n_words", "n_hit", "n_items", "item_ids", "contaminated") if c in docs.columns}
    held = docs.withColumnsRenamed(made)
    out = contamination.find(held, table(spark, sf_dir, "benchmark"), 10).where(~F.col("contaminated"))
    return out.select(*held.columns).withColumnsRenamed({v: k for k, v in made.items()}).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    Every row is a document, whatever its identifier; a null or empty text is its
    end id alone, a very long one many pieces; an empty table has no pieces.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=2048)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The trained and the hashed stages have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    What a stage wrote is deleted when its result is written and read no more;
    the last stage's files stay as long as the result that is returned.
    """
    docs = table(spark, sf_dir, "documents")
    start = written(spark)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, start, but_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
