"""Registered queries over the standard tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import distance, kernels, scalar, vectors
from weftline.operators import bounded_kmeans, cluster, decomposition, linear, logistic, matrix, metrics, naive_bayes, neighbors, preprocessing, selection, solvers, svm, svm_dual, tiles, tree
from weftline.operators.linalg import gram
from weftline.session import materialise, shared_dir
from weftline.sources import csv, datasets
from weftline.streaming import kept, scoring

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "gaussian_nb_accuracy"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# -- metrics -----------------------------------------------------------------


def _flags(spark, d):
    line = table(spark, d, "lineitem")
    return line.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") > 0.05).cast("int").alias("p"))


_FLAGS = "WITH f AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END y, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END p FROM lineitem) "
_TP, _MISS, _RAISE = "sum(CASE WHEN y = 1 AND p = 1 THEN 1.0 ELSE 0 END)", "sum(CASE WHEN y = 1 AND p = 0 THEN 1.0 ELSE 0 END)", "sum(CASE WHEN y = 0 AND p = 1 THEN 1.0 ELSE 0 END)"


@query("metric_accuracy", _FLAGS + "SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) score FROM f")
def _(spark, d):
    return metrics.accuracy(_flags(spark, d), "y", "p").select(r6("score").alias("score"))


for _compat, _name in ((False, ""), (True, "_compat")):
    _a, _b = (_RAISE, _MISS) if not _compat else (_MISS, _RAISE)

    @query(f"metric_precision{_name}", _FLAGS + f"SELECT round({_TP} / ({_TP} + {_a}), 6) score FROM f")
    def _(spark, d, compat=_compat):
        return metrics.precision(_flags(spark, d), "y", "p", compat).select(r6("score").alias("score"))

    @query(f"metric_recall{_name}", _FLAGS + f"SELECT round({_TP} / ({_TP} + {_b}), 6) score FROM f")
    def _(spark, d, compat=_compat):
        return metrics.recall(_flags(spark, d), "y", "p", compat).select(r6("score").alias("score"))


@query("metric_f_beta", _FLAGS + f", q AS (SELECT {_TP} / ({_TP} + {_RAISE}) a, {_TP} / ({_TP} + {_MISS}) b FROM f) SELECT round(5 * a * b / (4 * a + b), 6) score FROM q")
def _(spark, d):
    return metrics.f_beta(_flags(spark, d), "y", "p", beta=2.0).select(r6("score").alias("score"))


@query("metric_multiclass_precision", "SELECT round(avg(CASE WHEN (ascii(l_returnflag) % 3) = (l_linenumber % 3) THEN 1.0 ELSE 0.0 END), 6) score FROM lineitem")
def _(spark, d):
    df = table(spark, d, "lineitem").select((F.ascii("l_returnflag") % 3).alias("y"), (F.col("l_linenumber") % 3).alias("p"))
    return metrics.precision(df, "y", "p").select(r6("score").alias("score"))


def _auc_sql(s: str) -> str:
    return f"""WITH f AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END y, {s} s FROM lineitem),
    k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 r FROM f)
    SELECT round((sum(y * r) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) score FROM k"""


for _name, _col in (("metric_roc_auc", "l_extendedprice"), ("metric_roc_auc_ties", "l_quantity")):

    @query(_name, _auc_sql(_col))
    def _(spark, d, col=_col):
        df = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col(col).alias("s"))
        return metrics.roc_auc(df, "y", "s").select(r6("score").alias("score"))


def _fit(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("p"))


_FITS = "WITH f AS (SELECT l_extendedprice / 1000 y, l_quantity * 1.5 p FROM lineitem) "
for _name, _f, _sql in (
    ("metric_mse", metrics.mean_squared_error, "avg((y - p) * (y - p))"),
    ("metric_mae", metrics.mean_absolute_error, "avg(abs(y - p))"),
    ("metric_r2", metrics.r2, "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))"),
):

    @query(_name, _FITS + f"SELECT round({_sql}, 5) score FROM f")
    def _(spark, d, f=_f):
        return f(_fit(spark, d), "y", "p").select(F.round("score", 5).alias("score"))


_KINDS = "WITH f AS (SELECT event_type t, user_id % 5 q FROM events), n AS (SELECT t, q, count(*)::DOUBLE n FROM f GROUP BY ALL), s AS (SELECT sum(n) a FROM n), ht AS (SELECT -sum(n / a * ln(n / a)) h FROM (SELECT t, sum(n) n FROM n GROUP BY t), s), hq AS (SELECT -sum(n / a * ln(n / a)) h FROM (SELECT q, sum(n) n FROM n GROUP BY q), s), hb AS (SELECT -sum(n / a * ln(n / a)) h FROM n, s) "


def _kinds(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("t"), (F.col("user_id") % 5).alias("q"))


@query("metric_contingency", "SELECT event_type truth, user_id % 5 prediction, count(*) n FROM events GROUP BY ALL")
def _(spark, d):
    return metrics.contingency(_kinds(spark, d), "t", "q")


@query("metric_entropy", _KINDS + "SELECT round(h, 6) score FROM ht")
def _(spark, d):
    return metrics.entropy(_kinds(spark, d), "t").select(r6("score").alias("score"))


@query("metric_mutual_information", _KINDS + "SELECT round(greatest(0, ht.h + hq.h - hb.h), 6) score FROM ht, hq, hb")
def _(spark, d):
    return metrics.mutual_information(_kinds(spark, d), "t", "q").select(r6("score").alias("score"))


@query("metric_hcv", _KINDS + ", v AS (SELECT greatest(0, ht.h + hq.h - hb.h) / ht.h o, greatest(0, ht.h + hq.h - hb.h) / hq.h c FROM ht, hq, hb) SELECT round(o, 6) homogeneity, round(c, 6) completeness, round(2 * o * c / (o + c), 6) v_measure FROM v")
def _(spark, d):
    return metrics.hcv(_kinds(spark, d), "t", "q").select(*(r6(c).alias(c) for c in ("homogeneity", "completeness", "v_measure")))


# -- reductions, reshaping, linear algebra -------------------------------------

_NUM = ["l_quantity", "l_discount", "l_tax"]


@query("column_stats", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) n, round(sum({c}), 4) sum, round(avg({c}), 6) mean, round(min({c}), 6) min, round(max({c}), 6) max, round(var_pop({c}), 6) var, round(stddev_pop({c}), 6) std FROM lineitem" for c in _NUM))
def _(spark, d):
    s = matrix.column_stats(table(spark, d, "lineitem"), _NUM)
    return s.select("column", "n", F.round("sum", 4).alias("sum"), *(r6(c).alias(c) for c in ("mean", "min", "max", "var", "std")))


@query("covariance", " UNION ALL ".join(f"SELECT '{a}' i, '{b}' j, round(covar_samp({a}, {b}), 6) + 0.0 cov FROM lineitem" for a in _NUM for b in _NUM))
def _(spark, d):
    return matrix.covariance(table(spark, d, "lineitem"), _NUM).select("i", "j", (r6("cov") + 0.0).alias("cov"))


def _cells(spark, d, limit: int | None = None):
    e = table(spark, d, "embeddings")
    e = e.where(F.col("vec_id") < limit) if limit else e
    return e.select(F.col("vec_id").alias("i"), F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "value"))


_CELLS = "WITH c AS (SELECT vec_id i, generate_subscripts(embedding, 1) - 1 j, unnest(embedding)::DOUBLE v FROM embeddings) "


@query("matrix_transpose", _CELLS + "SELECT j::INT i, i::BIGINT j, round(v, 6) \"value\" FROM c")
def _(spark, d):
    return matrix.transpose(_cells(spark, d)).select("i", "j", r6("value").alias("value"))


@query("matrix_reshape", _CELLS + "SELECT ((i * 64 + j) // 16)::BIGINT i, ((i * 64 + j) % 16)::INT j, round(v, 6) \"value\" FROM c")
def _(spark, d):
    return matrix.reshape(_cells(spark, d), 64, 16).select("i", "j", r6("value").alias("value"))


@query("matrix_diagonal", _CELLS + "SELECT i, round(v, 6) \"value\" FROM c WHERE i = j")
def _(spark, d):
    return matrix.diagonal(_cells(spark, d)).select("i", r6("value").alias("value"))


@query("matrix_gram", _CELLS + "SELECT a.j::INT i, b.j::INT j, round(sum(a.v * b.v), 5) + 0.0 \"value\" FROM c a JOIN c b USING (i) GROUP BY a.j, b.j")
def _(spark, d):
    c = _cells(spark, d)
    return matrix.matmul(c, c, transpose_a=True).select("i", "j", (F.round("value", 5) + 0.0).alias("value"))


def _rows(spark, d, turned: bool = False):
    """The vectors as a matrix in tiles; ``turned`` moves each one's first component to its end."""
    v = F.col("embedding").cast("array<double>")
    e = table(spark, d, "embeddings").select("vec_id", (F.concat(F.slice(v, 2, 64), F.slice(v, 1, 1)) if turned else v).alias("v"))
    return tiles.from_rows(e, "vec_id", "v", e.count(), 64)


@query("matrix_gram_tiles", _CELLS + "SELECT a.j::BIGINT i, b.j::BIGINT j, round(sum(a.v * b.v), 5) + 0.0 \"value\" FROM c a JOIN c b USING (i) GROUP BY a.j, b.j")
def _(spark, d):
    x = _rows(spark, d)
    return x.transpose().multiply(x).cells().select("i", "j", (F.round("value", 5) + 0.0).alias("value"))


def _square(spark, d, turned: bool, shift: float):
    """All vectors' products with all, the second ones turned or not, and a number on the diagonal."""
    x = _rows(spark, d)
    return x.multiply(_rows(spark, d, turned).transpose()).shifted(shift)


_SQUARE = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings) SELECT a.vec_id::BIGINT i, b.vec_id::BIGINT j, round(list_dot_product(a.v, {}) + CASE WHEN a.vec_id = b.vec_id THEN {} ELSE 0 END, 5) + 0.0 \"value\" FROM e a, e b"


@query("matrix_cholesky", _SQUARE.format("b.v", "1.0"))
def _(spark, d):
    """L L' of the lower factor is the matrix again."""
    lower = tiles.cholesky_tiles(_square(spark, d, False, 1.0))
    return lower.multiply(lower.transpose()).cells().select("i", "j", (F.round("value", 5) + 0.0).alias("value"))


@query("matrix_lu", _SQUARE.format("(b.v[2:64] || b.v[1:1])", "3.0"))
def _(spark, d):
    """L U, its rows put back from pivot order, is the matrix again."""
    a = _square(spark, d, True, 3.0)
    f = tiles.lu(a)
    lower, upper = f.tiles()
    order = spark.createDataFrame(list(enumerate(f.order.tolist())), "t long, row long")
    found = lower.multiply(upper).cells().withColumnRenamed("i", "t").join(F.broadcast(order), "t")
    return found.select(F.col("row").alias("i"), "j", (F.round("value", 5) + 0.0).alias("value"))


@query("matrix_solve", "SELECT vec_id::BIGINT i, (vec_id % 7 + 0.5)::DOUBLE AS \"value\" FROM embeddings")
def _(spark, d):
    """A system made from its solution."""
    a = _square(spark, d, True, 3.0)
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), (F.col("vec_id") % 7 + 0.5).alias("value"))
    b = matrix.matvec(a.cells(), x)
    return tiles.solve(a, b.select("i", F.lit(0).cast("long").alias("j"), "value")).select("i", (r6("value") + 0.0).alias("value"))


@query("gram_eigenpairs", "SELECT k::INT k, 0.0::DOUBLE residual, 1.0::DOUBLE norm FROM range(10) t(k)")
def _(spark, d):
    """The ten greatest eigenvalues of the Gram matrix: what is left of G v - t v, by plain sums over all cells."""
    values, vectors, _ = tiles.gram_eigenpairs(_rows(spark, d), 10)
    v = materialise(vectors.cells().select(F.col("i").alias("j"), F.col("j").cast("int").alias("k"), F.col("value").alias("v")), "vectors")
    cells = _cells(spark, d)
    along = cells.join(F.broadcast(v), "j").groupBy("i", "k").agg(F.sum(F.col("value") * F.col("v")).alias("p"))
    back = cells.join(along, "i").groupBy("j", "k").agg(F.sum(F.col("value") * F.col("p")).alias("g"))
    t = F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.col("k") + 1)
    left = back.join(v, ["j", "k"]).groupBy("k").agg(F.sqrt(F.sum((F.col("g") - t * F.col("v")) ** 2) / F.first(t) ** 2).alias("r"), F.sum(F.col("v") ** 2).alias("n"))
    return left.select("k", (F.round("r", 6) + 0.0).alias("residual"), F.round("n", 6).alias("norm"))


@query("matrix_vector", _CELLS + "SELECT i, round(sum(v * (j + 1)), 5) + 0.0 \"value\" FROM c GROUP BY i")
def _(spark, d):
    x = spark.range(64).select(F.col("id").cast("int").alias("i"), (F.col("id") + 1.0).alias("value"))
    return matrix.matvec(_cells(spark, d), x).select("i", (F.round("value", 5) + 0.0).alias("value"))


@query("take_rows", "SELECT pos::INT pos, vec_id, label FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 499)) t(pos, k) JOIN embeddings ON vec_id = k")
def _(spark, d):
    return matrix.take_rows(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", [7, 3, 7, 499])


@query("take_columns", "SELECT vec_id, round(v[4], 6) + 0.0 a, round(v[1], 6) + 0.0 b, round(v[4], 6) + 0.0 c FROM (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings)")
def _(spark, d):
    taken = _vec(spark, d).select("vec_id", matrix.take_columns(F.col("v"), [3, 0, 3]).alias("t"))
    return taken.select("vec_id", *((r6(F.col("t")[k]) + 0.0).alias(c) for k, c in enumerate("abc")))


@query("matrix_equal", "SELECT s step, CASE WHEN s = 0 THEN true ELSE false END AS \"equal\", CASE WHEN s = 0 THEN 0 ELSE (SELECT sum((x <> 0)::INT) FROM (SELECT unnest(embedding) x FROM embeddings WHERE vec_id % 2 = 1)) END::BIGINT differing FROM (VALUES (0), (1)) t(s)")
def _(spark, d):
    c = _cells(spark, d)
    other = c.withColumn("value", F.when(F.col("i") % 2 == 1, -F.col("value")).otherwise(F.col("value")))
    step = lambda df, k: df.select(F.lit(k).alias("step"), "equal", "differing")
    return step(matrix.equal(c, c), 0).union(step(matrix.equal(c, other), 1))


@query("slice_rows", "SELECT vec_id, label FROM embeddings WHERE vec_id >= 10 AND vec_id < 20")
def _(spark, d):
    return matrix.slice_rows(table(spark, d, "embeddings"), "vec_id", 10, 20, ["label"])


@query("v_stack", "SELECT r_regionkey::BIGINT id, r_name AS name FROM region UNION ALL SELECT (n_nationkey + (SELECT max(r_regionkey) + 1 FROM region))::BIGINT, n_name FROM nation")
def _(spark, d):
    a = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return matrix.v_stack(a, b, "id")


@query("h_stack", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return matrix.h_stack(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("unique_with_indices", "SELECT l_quantity \"value\", (row_number() OVER (ORDER BY l_quantity) - 1)::BIGINT idx FROM (SELECT DISTINCT l_quantity FROM lineitem)")
def _(spark, d):
    return matrix.unique(table(spark, d, "lineitem"), "l_quantity")


@query("norms", "SELECT round(sqrt(sum(l_tax * l_tax)), 6) n2, round(sum(abs(l_tax)), 4) n1, max(abs(l_tax)) top, min(abs(l_tax)) low FROM lineitem")
def _(spark, d):
    t = table(spark, d, "lineitem")
    return matrix.norm(t, "l_tax", 2.0).select(r6("norm").alias("n2")).crossJoin(matrix.norm(t, "l_tax", 1.0).select(F.round("norm", 4).alias("n1"))).crossJoin(matrix.norm(t, "l_tax", float("inf")).toDF("top")).crossJoin(matrix.norm(t, "l_tax", float("-inf")).toDF("low"))


@query("top_k", "SELECT * FROM (SELECT l_returnflag, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY o_totalprice, o_orderkey)::INT rnk FROM (SELECT DISTINCT l_returnflag, o_orderkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) WHERE rnk <= 5")
def _(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_returnflag", "o_orderkey", "o_totalprice").distinct()
    return matrix.top_k(j, 5, "o_totalprice", "o_orderkey", ["l_returnflag"])


def _vec(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


_V = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings) "


@query("vector_reductions", _V + "SELECT vec_id, round(list_sum(v), 6) + 0.0 total, round(list_avg(v), 6) + 0.0 mean, round(list_var_pop(v), 6) var, (list_position(v, list_max(v)) - 1)::INT argmax, round(sqrt(list_sum([x * x FOR x IN v])), 6) norm2, round(list_max([abs(x) FOR x IN v]), 6) top FROM e")
def _(spark, d):
    v = F.col("v")
    return _vec(spark, d).select("vec_id", (r6(vectors.total(v)) + 0.0).alias("total"), (r6(vectors.mean(v)) + 0.0).alias("mean"), r6(vectors.variance(v)).alias("var"), vectors.argmax(v).alias("argmax"), r6(vectors.norm2(v)).alias("norm2"), r6(vectors.norm(v, float("inf"))).alias("top"))


@query("vector_differences", _V + ", p AS (SELECT e.vec_id, e.v v, q.v w FROM e, e q WHERE q.vec_id = 0) SELECT vec_id, round(list_max([abs(z[1] - z[2]) FOR z IN list_zip(v, w)]), 6) diff, list_max([abs(z[1] - z[2]) FOR z IN list_zip(v, w)]) <= 0.3 near, round(list_dot_product(v, w), 6) + 0.0 dot FROM p")
def _(spark, d):
    e = _vec(spark, d)
    p = e.join(F.broadcast(e.where("vec_id = 0").select(F.col("v").alias("w"))), F.lit(True))
    v, w = F.col("v"), F.col("w")
    return p.select("vec_id", r6(vectors.max_diff(v, w)).alias("diff"), vectors.approximate_eq(v, w, 0.3).alias("near"), (r6(vectors.dot(v, w)) + 0.0).alias("dot"))


@query("vector_unique", _V + ", u AS (SELECT vec_id, [round(x * 4) FOR x IN v] v FROM e) SELECT vec_id, len(list_distinct(v)) n, list_min(v) low, (list_sum([list_position(list_sort(list_distinct(v)), x) - 1 FOR x IN v]))::BIGINT places FROM u")
def _(spark, d):
    u = _vec(spark, d).select("vec_id", vectors.unique_with_indices(F.transform("v", lambda x: F.round(x * 4) + 0.0)).alias("u"))
    return u.select("vec_id", F.size("u.values").cast("long").alias("n"), F.col("u.values")[0].alias("low"), F.aggregate("u.indices", F.lit(0).cast("long"), lambda a, x: a + x).alias("places"))


@query("vector_softmax", _V + "SELECT vec_id, generate_subscripts(v, 1)::INT - 1 j, round(unnest([exp(x) / list_sum([exp(y) FOR y IN v]) FOR x IN v]), 6) p FROM e")
def _(spark, d):
    return _vec(spark, d).select("vec_id", F.posexplode(vectors.softmax(F.col("v"))).alias("j", "p")).select("vec_id", "j", r6("p").alias("p"))


@query("vector_argsort", _V + ", c AS (SELECT vec_id, generate_subscripts(v, 1) - 1 i, unnest(v) x FROM e) SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY x, i) - 1)::INT pos, i::INT i FROM c")
def _(spark, d):
    return _vec(spark, d).select("vec_id", F.posexplode(vectors.argsort(F.col("v"))).alias("pos", "i"))


@query("scalar_functions", "SELECT event_id, round(CASE WHEN value > 15 THEN value ELSE ln(1 + exp(value)) END, 6) ln_1pe, round(1 / (1 + exp(-greatest(least(value, 40), -40))), 6) sigmoid, CASE WHEN value > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END bin, round(value * value, 4) sq FROM (SELECT event_id, value / 10 AS value FROM events)")
def _(spark, d):
    x = F.col("x")
    e = table(spark, d, "events").select("event_id", (F.col("value") / 10).alias("x"))
    return e.select("event_id", r6(scalar.ln_1pe(x)).alias("ln_1pe"), r6(scalar.sigmoid(x)).alias("sigmoid"), scalar.binarize(x, 10.0).alias("bin"), F.round(scalar.square(x), 4).alias("sq"))


# -- preprocessing -----------------------------------------------------------------


@query("standard_scaler", "WITH s AS (SELECT avg(o_totalprice) m, stddev_pop(o_totalprice) s FROM orders) SELECT o_orderkey, round((o_totalprice - m) / s, 6) + 0.0 z FROM orders, s")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("z"))
    return preprocessing.StandardScaler.fit(o, ["z"]).transform(o).select("o_orderkey", (r6("z") + 0.0).alias("z"))


_FIRST = "WITH f AS (SELECT event_type, min(event_id) o FROM events GROUP BY 1), m AS (SELECT event_type, (row_number() OVER (ORDER BY o, event_type) - 1)::INT idx FROM f) "


@query("category_map", _FIRST + "SELECT event_id, idx FROM events JOIN m USING (event_type)")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", preprocessing.CategoryMapper.fit(e, "event_type", "event_id").number(F.col("event_type")).alias("idx"))


@query("category_one_hot", _FIRST + "SELECT event_id, generate_series - 0 AS j, CASE WHEN generate_series = idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hot FROM events JOIN m USING (event_type), (SELECT unnest(range(0, 5))::INT AS generate_series)")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.posexplode(preprocessing.CategoryMapper.fit(e, "event_type", "event_id").one_hot(F.col("event_type"))).alias("j", "hot"))


@query("one_hot_encoder", "SELECT l_orderkey, l_quantity, " + ", ".join(f"sum(CASE WHEN l_linenumber = {i} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS h{i}" for i in range(1, 8)) + " FROM lineitem GROUP BY l_orderkey, l_quantity")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber")
    t = preprocessing.OneHotEncoder.fit(li, ["l_linenumber"], "l_orderkey").transform(li)
    return t.groupBy("l_orderkey", "l_quantity").agg(*((F.sum(f"l_linenumber_{i}") if f"l_linenumber_{i}" in t.columns else F.sum(F.lit(0.0))).alias(f"h{i}") for i in range(1, 8)))


# -- distances, kernels, neighbours -----------------------------------------------


def _signs(v):
    return F.transform(v, lambda x: F.signum(x))


_PAIRS = _V + ", p AS (SELECT e.vec_id, q.vec_id q, e.v v, q.v w FROM e, e q WHERE q.vec_id % 100 = 0) "
_ZIP = "[({}) FOR z IN list_zip(v, w)]"
_DIST = {
    "distance_euclidian": (distance.euclidian, "list_distance(v, w)"),
    "distance_manhattan": (distance.manhattan, f"list_sum({_ZIP.format('abs(z[1] - z[2])')})"),
    "distance_minkowski": (distance.minkowski(3), f"list_sum({_ZIP.format('abs(z[1] - z[2]) ** 3')}) ** (1.0 / 3)"),
    "distance_hamming": (distance.hamming, f"list_sum({_ZIP.format('CASE WHEN sign(z[1]) <> sign(z[2]) THEN 1.0 ELSE 0.0 END')}) / 64"),
    "kernel_linear": (kernels.Linear(), "list_dot_product(v, w)"),
    "kernel_rbf": (kernels.RBF(0.5), "exp(-0.5 * list_distance(v, w) ** 2)"),
    "kernel_polynomial": (kernels.Polynomial(3, 0.5, 1.0), "(0.5 * list_dot_product(v, w) + 1) ** 3"),
    "kernel_sigmoid": (kernels.Sigmoid(0.5, 0.1), "tanh(0.5 * list_dot_product(v, w) + 0.1)"),
    "kernel_sigmoid_compat": (kernels.Sigmoid(0.5, 0.1, True), "0.5 * list_dot_product(v, w) + tanh(0.1)"),
}
for _name, (_f, _sql) in _DIST.items():

    @query(_name, _PAIRS + f"SELECT vec_id, q, round({_sql}, 6) + 0.0 AS \"value\" FROM p")
    def _(spark, d, f=_f):
        e = _vec(spark, d)
        e = e.withColumn("v", _signs("v")) if f is distance.hamming else e
        p = neighbors.compared(e, e.where("vec_id % 100 = 0"), f, "vec_id", "v")
        return p.select(F.col("id").alias("vec_id"), F.col("query_id").alias("q"), (r6("value") + 0.0).alias("value"))


@query(
    "distance_mahalanobis",
    """WITH c AS (SELECT var_samp(l_quantity) a, covar_samp(l_quantity, l_extendedprice) b, var_samp(l_extendedprice) e, avg(l_quantity) mx, avg(l_extendedprice) my FROM lineitem),
    z AS (SELECT l_orderkey, l_linenumber, l_quantity - mx x, l_extendedprice - my y, a, b, e FROM lineitem, c)
    SELECT l_orderkey, l_linenumber, round(sqrt((e * x * x - 2 * b * x * y + a * y * y) / (a * e - b * b)), 5) AS "value" FROM z""",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    g = gram(li, ["l_quantity", "l_extendedprice"])
    m = distance.mahalanobis(g.covariance())(F.array("l_quantity", "l_extendedprice"), F.array(*(F.lit(float(x)) for x in g.mean)))
    return li.select("l_orderkey", "l_linenumber", F.round(m, 5).alias("value"))


def _train(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label", (F.col("label") * 1.5).alias("y"))


_NEAR = _V + ", k AS (SELECT q.vec_id query_id, e.vec_id id, list_distance(e.v, q.v) d FROM e, e q WHERE q.vec_id % 100 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) rnk FROM k) "


@query("knn_search", _NEAR + "SELECT query_id, id, round(d, 6) distance, rnk::INT rnk FROM n WHERE rnk <= 4")
def _(spark, d):
    t = _train(spark, d)
    return neighbors.knn(t, t.where("id % 100 = 0"), 4).select("query_id", "id", r6("distance").alias("distance"), "rnk")


@query("radius_search", _NEAR + "SELECT query_id, id, round(d, 6) distance FROM n WHERE d <= 1.25")
def _(spark, d):
    t = _train(spark, d)
    return neighbors.radius(t, t.where("id % 100 = 0"), 1.25).select("query_id", "id", r6("distance").alias("distance"))


@query("knn_search_balls", _NEAR + "SELECT query_id, id, round(d, 6) distance, rnk::INT rnk FROM n WHERE rnk <= 4")
def _(spark, d):
    t = _train(spark, d)
    return neighbors.knn(t, t.where("id % 100 = 0"), 4, how="balls").select("query_id", "id", r6("distance").alias("distance"), "rnk")


@query("radius_search_balls", _NEAR.replace("list_distance(e.v, q.v)", "list_sum([abs(z[1] - z[2]) FOR z IN list_zip(e.v, q.v)])") + "SELECT query_id, id, round(d, 6) distance FROM n WHERE d <= 8.0")
def _(spark, d):
    t = _train(spark, d)
    return neighbors.radius(t, t.where("id % 100 = 0"), 8.0, distance=distance.manhattan, how="balls").select("query_id", "id", r6("distance").alias("distance"))


@query("knn_graph", "WITH p AS (SELECT s_suppkey i, s_acctbal / 100 x, s_nationkey::DOUBLE y FROM supplier), k AS (SELECT a.i query_id, b.i id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) d FROM p a, p b WHERE a.i <> b.i), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) rnk FROM k) SELECT query_id::BIGINT query_id, id::BIGINT id, round(d, 6) distance, rnk::INT rnk FROM r WHERE rnk <= 3")
def _(spark, d):
    """The three nearest others of every row, in two dimensions, where balls leave most pairs out."""
    p = _points(spark, d)
    return neighbors.knn(p, p, 3, keep_self=False, how="balls").select("query_id", "id", r6("distance").alias("distance"), "rnk")


@query(
    "radius_grid",
    "WITH c AS (SELECT s_suppkey i, s_acctbal / 100 x, s_nationkey::DOUBLE y FROM supplier) SELECT a.i query_id, b.i id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) distance FROM c a, c b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3",
)
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 100, F.col("s_nationkey").cast("double")).alias("features"))
    return neighbors.radius_grid(s, 3.0).select("query_id", "id", r6("distance").alias("distance"))


@query("closest_pair", _V + "SELECT a.vec_id node, b.vec_id neighbour, round(list_distance(a.v, b.v), 6) distance, round(list_distance(a.v, b.v) ** 2, 6) squared FROM e a, e b WHERE a.vec_id < b.vec_id ORDER BY list_distance(a.v, b.v), 1, 2 LIMIT 1")
def _(spark, d):
    return neighbors.closest_pair(_train(spark, d)).select("node", "neighbour", r6("distance").alias("distance"), r6("squared").alias("squared"))


@query("knn_classifier", _NEAR + ", v AS (SELECT query_id, label, count(*) w, min(rnk) r FROM n JOIN embeddings ON id = vec_id WHERE rnk <= 5 GROUP BY 1, 2) SELECT query_id, label prediction FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, r) k FROM v) WHERE k = 1")
def _(spark, d):
    t = _train(spark, d)
    return neighbors.KNNClassifier(t, "label", 5).predict(t.where("id % 100 = 0"))


@query("knn_regressor", _NEAR + ", v AS (SELECT query_id, label * 1.5 y, CASE WHEN bool_or(d = 0) OVER (PARTITION BY query_id) THEN (d = 0)::INT::DOUBLE ELSE 1 / d END w FROM n JOIN embeddings ON id = vec_id WHERE rnk <= 5) SELECT query_id, round(sum(w * y) / sum(w), 6) prediction FROM v GROUP BY 1")
def _(spark, d):
    t = _train(spark, d)
    return neighbors.KNNRegressor(t, "y", 5, "distance").predict(t.where("id % 100 = 0")).select("query_id", r6("prediction").alias("prediction"))


# -- naive Bayes ---------------------------------------------------------------------

_NB_PICK = ", b AS (SELECT vec_id, label prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label DESC) k FROM z) WHERE k = 1) "
_NB = "WITH c AS (SELECT vec_id, label, generate_subscripts(embedding, 1) j, unnest(embedding)::DOUBLE x FROM embeddings), p AS (SELECT label, count(*) n, count(*) / (SELECT count(*)::DOUBLE FROM embeddings) pr FROM embeddings GROUP BY label) "
_GNB = _NB + ", m AS (SELECT label, j, avg(x) t, var_pop(x) v FROM c GROUP BY 1, 2), z AS (SELECT c.vec_id, m.label, sum(-0.5 * (ln(2 * pi() * v) + (x - t) ** 2 / v)) + ln(any_value(pr)) s FROM c JOIN m USING (j) JOIN p ON p.label = m.label GROUP BY 1, 2)" + _NB_PICK


@query("gaussian_nb_predict", _GNB + "SELECT vec_id, prediction FROM b")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return naive_bayes.gaussian(e, "label", "embedding").predict(e, "vec_id", "embedding")


@query("gaussian_nb_accuracy", _GNB + "SELECT round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END), 6) score FROM b JOIN embeddings USING (vec_id)")
def _(spark, d):
    e = table(spark, d, "embeddings")
    p = naive_bayes.gaussian(e, "label", "embedding").predict(e, "vec_id", "embedding").join(e.select("vec_id", "label"), "vec_id")
    return metrics.accuracy(p, "label", "prediction").select(r6("score").alias("score"))


@query("gaussian_nb_model", _NB + "SELECT label, (j - 1)::INT j, round(avg(x), 6) + 0.0 theta, round(var_pop(x), 6) var FROM c GROUP BY label, j")
def _(spark, d):
    return naive_bayes.gaussian(table(spark, d, "embeddings"), "label", "embedding").stats.select("label", "j", (r6("theta") + 0.0).alias("theta"), r6("var").alias("var"))


@query("bernoulli_nb_predict", _NB + ", m AS (SELECT label, j, ln((sum((x > 0)::INT) + 1) / (any_value(n) + 2.0)) a, ln(1 - (sum((x > 0)::INT) + 1) / (any_value(n) + 2.0)) o FROM c JOIN p USING (label) GROUP BY 1, 2), z AS (SELECT c.vec_id, m.label, round(sum(CASE WHEN x > 0 THEN a ELSE o END) + ln(any_value(pr)), 9) s FROM c JOIN m USING (j) JOIN p ON p.label = m.label GROUP BY 1, 2)" + _NB_PICK + "SELECT vec_id, prediction FROM b")
def _(spark, d):
    e = table(spark, d, "embeddings")
    s = naive_bayes.bernoulli(e, "label", "embedding").scores(e, "vec_id", "embedding")
    return naive_bayes._pick(s.withColumn("score", F.round("score", 9)), "vec_id")


@query("multinomial_nb_predict", _NB.replace("unnest(embedding)::DOUBLE x", "floor(unnest([x * 10 FOR x IN embedding::DOUBLE[]]) + 10) x") + ", m AS (SELECT label, j, ln((sum(x) + 1) / (sum(sum(x)) OVER (PARTITION BY label) + 64)) a FROM c GROUP BY 1, 2), z AS (SELECT c.vec_id, m.label, round(sum(x * a) + ln(any_value(pr)), 8) s FROM c JOIN m USING (j) JOIN p ON p.label = m.label GROUP BY 1, 2)" + _NB_PICK + "SELECT vec_id, prediction FROM b")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("counts", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 10 + 10).cast("double")))
    s = naive_bayes.multinomial(e, "label", "counts").scores(e, "vec_id", "counts")
    return naive_bayes._pick(s.withColumn("score", F.round("score", 8)), "vec_id")


_CNB = """WITH u AS (SELECT event_id, (user_id % 4)::INT a, (length(event_type) % 5)::INT b, (value > 50)::INT y FROM events),
c AS (SELECT event_id, y, 0 j, a x FROM u UNION ALL SELECT event_id, y, 1, b FROM u),
k AS (SELECT j, max(x) + 1 k FROM c GROUP BY j), n AS (SELECT y label, count(*)::DOUBLE n FROM u GROUP BY y),
g AS (SELECT n.label, k.j, unnest(range(0, k)) x, n.n, k.k FROM n, k),
t AS (SELECT y label, j, x, count(*) q FROM c GROUP BY ALL),
m AS (SELECT g.label, g.j, g.x, ln((coalesce(q, 0) + 1) / (n + k)) a FROM g LEFT JOIN t ON t.label = g.label AND t.j = g.j AND t.x = g.x),
z AS (SELECT event_id, m.label, round(sum(a) + ln(any_value(n) / (SELECT count(*) FROM u)), 9) s FROM c JOIN m ON c.j = m.j AND c.x = m.x JOIN n ON n.label = m.label GROUP BY 1, 2)
SELECT event_id, label prediction FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, label DESC) k FROM z) WHERE k = 1"""


@query("categorical_nb_predict", _CNB)
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.array((F.col("user_id") % 4).cast("double"), (F.length("event_type") % 5).cast("double")).alias("features"), (F.col("value") > 50).cast("int").alias("y"))
    s = naive_bayes.categorical(e, "y").scores(e, "event_id")
    return naive_bayes._pick(s.withColumn("score", F.round("score", 9)), "event_id")


# -- linear models, decompositions ----------------------------------------------------


def _coef(spark, m, digits=6):
    return spark.createDataFrame([(c, round(float(w), digits) + 0.0) for c, w in zip([*m.columns, "intercept"], [*m.coefficients, m.intercept], strict=True)], "term string, w double")


_ONE = "WITH s AS (SELECT count(*)::DOUBLE n, avg(l_quantity) mx, avg(l_extendedprice / 1000) my, var_pop(l_quantity) vx, covar_pop(l_quantity, l_extendedprice / 1000) c FROM lineitem) "
_TERMS = "SELECT 'l_quantity' term, round(w, 6) + 0.0 w FROM b UNION ALL SELECT 'intercept', round(my - w * mx, 6) + 0.0 FROM b, s"


def _price(spark, d):
    return table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("y"))


@query("linear_regression", _ONE + ", b AS (SELECT c / vx w FROM s) " + _TERMS)
def _(spark, d):
    return _coef(spark, linear.linear_regression(_price(spark, d), ["l_quantity"], "y"))


@query("linear_regression_two", "WITH s AS (SELECT avg(l_quantity) a, avg(l_discount) b, avg(l_extendedprice / 1000) m, var_pop(l_quantity) v1, var_pop(l_discount) v2, covar_pop(l_quantity, l_discount) v12, covar_pop(l_quantity, l_extendedprice / 1000) c1, covar_pop(l_discount, l_extendedprice / 1000) c2 FROM lineitem), w AS (SELECT (v2 * c1 - v12 * c2) / (v1 * v2 - v12 * v12) w1, (v1 * c2 - v12 * c1) / (v1 * v2 - v12 * v12) w2, a, b, m FROM s) SELECT 'l_quantity' term, round(w1, 5) w FROM w UNION ALL SELECT 'l_discount', round(w2, 5) FROM w UNION ALL SELECT 'intercept', round(m - w1 * a - w2 * b, 5) FROM w")
def _(spark, d):
    return _coef(spark, linear.linear_regression(_price(spark, d), ["l_quantity", "l_discount"], "y", "qr"), 5)


@query("ridge_regression", _ONE + ", b AS (SELECT n * c / sqrt(vx) / (n + 100) / sqrt(vx) w FROM s) " + _TERMS)
def _(spark, d):
    return _coef(spark, linear.ridge_regression(_price(spark, d), ["l_quantity"], "y", 100.0))


@query("lasso", _ONE + ", b AS (SELECT sign(c) * greatest(abs(c) / sqrt(vx) - 0.01 / 2, 0) / sqrt(vx) w FROM s) " + _TERMS)
def _(spark, d):
    return _coef(spark, linear.lasso(_price(spark, d), ["l_quantity"], "y", 0.01))


@query("elastic_net", _ONE + ", b AS (SELECT sign(c) * greatest(abs(c) / sqrt(vx) - 0.02 * 0.5 / 2, 0) / (1 + 0.02 * 0.5) / sqrt(vx) w FROM s) " + _TERMS)
def _(spark, d):
    return _coef(spark, linear.elastic_net(_price(spark, d), ["l_quantity"], "y", 0.02, 0.5))


@query("linear_predict", "SELECT l_orderkey, l_linenumber, round(0.5 + 2 * l_quantity - l_tax, 6) prediction FROM lineitem")
def _(spark, d):
    m = linear.LinearModel(("l_quantity", "l_tax"), (2.0, -1.0), 0.5)
    return m.predict(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", r6("prediction").alias("prediction"))


_PARTS = [f"f{j}" for j in range(63)]


@query("linear_regression_many", "SELECT j::INT j, 0.0::DOUBLE slope FROM range(64) t(j)")
def _(spark, d):
    """What least squares of one component on the others leaves is at right angles to each of them, and has no mean."""
    e = _emb(spark, d)
    left = linear.linear_regression(e, _PARTS, "f63").predict(e).withColumn("left", F.col("f63") - F.col("prediction"))
    sums = F.array(*(F.round(F.avg(F.col("left") * (F.col(c) if c else 1.0)), 7) + 0.0 for c in [*_PARTS, None]))
    return left.agg(sums.alias("s")).select(F.posexplode("s").alias("j", "slope"))


@query("ridge_regression_many", "SELECT j::INT j, 0.0::DOUBLE slope FROM range(63) t(j)")
def _(spark, d):
    """At the minimum the slope of the squares is the penalty's, on scaled columns."""
    e = _emb(spark, d)
    m = linear.ridge_regression(e, _PARTS, "f63", 10.0)
    left = F.col("f63") - m.expression()
    sd = e.agg(*(F.stddev_pop(c) for c in _PARTS), *(F.avg(c) for c in _PARTS), F.count(F.lit(1))).first()
    slopes = [F.round((F.sum(left * (F.col(c) - sd[63 + i])) / sd[i] - 10.0 * m.coefficients[i] * sd[i]) / sd[-1], 7) + 0.0 for i, c in enumerate(_PARTS)]
    return e.agg(F.array(*slopes).alias("s")).select(F.posexplode("s").alias("j", "slope"))


for _name, _fitted, _l1, _l2 in (
    ("lasso_many", lambda e: linear.lasso(e, _PARTS, "f63", 0.005), 0.005, 0.0),
    ("elastic_net_many", lambda e: linear.elastic_net(e, _PARTS, "f63", 0.01, 0.5), 0.005, 0.005),
):

    @query(_name, "SELECT j::INT j, 0.0::DOUBLE off FROM range(63) t(j)")
    def _(spark, d, fitted=_fitted, l1=_l1, l2=_l2):
        """The conditions of the minimum, by column: the squares' slope is the penalty's, or within it where the weight is zero."""
        e = _emb(spark, d)
        m = fitted(e)
        stats = e.agg(*(F.stddev_pop(c) for c in _PARTS), *(F.avg(c) for c in _PARTS), F.count(F.lit(1))).first()
        left, off = F.col("f63") - m.expression(), []
        for i, c in enumerate(_PARTS):
            w, slope = m.coefficients[i] * stats[i], 2 * F.sum(left * (F.col(c) - stats[63 + i])) / stats[i] / stats[-1]
            off.append(F.abs(slope - l1 * (1 if w > 0 else -1) - 2 * l2 * w) if w else F.greatest(F.lit(0.0), F.abs(slope) - l1))
        return e.agg(F.array(*(F.round(x, 6) + 0.0 for x in off)).alias("s")).select(F.posexplode("s").alias("j", "off"))


@query("tall_qr", "WITH s AS (SELECT sum(l_quantity ** 2) a, sum(l_quantity * l_extendedprice / 1000) b, sum((l_extendedprice / 1000) ** 2) c FROM lineitem) SELECT round(sqrt(a), 4) r00, round(b / sqrt(a), 4) r01, round(sqrt(c - b * b / a), 4) r11 FROM s")
def _(spark, d):
    r = solvers.qr(_price(spark, d), ["l_quantity", "y"]).r
    return spark.createDataFrame([tuple(round(float(v), 4) for v in (r[0, 0], r[0, 1], r[1, 1]))], "r00 double, r01 double, r11 double")


@query("tall_qr_rows", "WITH s AS (SELECT sum(l_quantity ** 2) a, sum(l_quantity * l_extendedprice / 1000) b, sum((l_extendedprice / 1000) ** 2) c FROM lineitem) SELECT l_orderkey, l_linenumber, round(l_quantity / sqrt(a), 7) q0, round((l_extendedprice / 1000 - l_quantity * b / a) / sqrt(c - b * b / a), 7) + 0.0 q1 FROM lineitem, s")
def _(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    q = solvers.qr(df, ["l_quantity", "y"]).q(df)
    return q.select("l_orderkey", "l_linenumber", F.round(F.col("q")[0], 7).alias("q0"), (F.round(F.col("q")[1], 7) + 0.0).alias("q1"))


@query("tall_svd", "WITH s AS (SELECT sum(l_quantity ** 2) a, sum(l_quantity * l_extendedprice / 1000) c, sum((l_extendedprice / 1000) ** 2) b FROM lineitem) SELECT k, round(sqrt((a + b + s * sqrt((a - b) ** 2 + 4 * c * c)) / 2), 4) v FROM s, (VALUES (0, 1), (1, -1)) t(k, s)")
def _(spark, d):
    s = solvers.tall_svd(_price(spark, d), ["l_quantity", "y"]).s
    return spark.createDataFrame([(i, round(float(v), 4)) for i, v in enumerate(s)], "k int, v double")


@query("biconjugate_gradient", "SELECT n_nationkey::BIGINT i, round(n_regionkey + n_nationkey / 10.0, 6)::DOUBLE AS \"value\" FROM nation")
def _(spark, d):
    """A system that is not symmetric, made from its solution."""
    x = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), (F.col("n_regionkey") + F.col("n_nationkey") / 10.0).alias("value"))
    cell = lambda step, v: x.select("i", (F.col("i") + step).alias("j"), F.lit(v).alias("value"))
    a = cell(0, 4.0).union(cell(1, -1.0)).union(cell(-1, -0.5)).join(x.select(F.col("i").alias("j")), "j", "left_semi").select("i", "j", "value")
    found, _, _ = solvers.biconjugate_gradient(a, matrix.matvec(a, x))
    return found.select("i", (r6("value") + 0.0).alias("value"))


_EIG = "WITH s AS (SELECT count(*)::DOUBLE n, var_pop(l_quantity) a, var_pop(l_extendedprice / 1000) b, covar_pop(l_quantity, l_extendedprice / 1000) c FROM lineitem) "


@query("pca_eigenvalues", _EIG + "SELECT k, round((a + b + s * sqrt((a - b) ** 2 + 4 * c * c)) / 2, 5) v FROM s, (VALUES (0, 1), (1, -1)) t(k, s)")
def _(spark, d):
    df = _price(spark, d)
    p = decomposition.pca(df, ["l_quantity", "y"], 2)
    n = df.count()
    return spark.createDataFrame([(i, round(float(v) / n, 5)) for i, v in enumerate(p.eigenvalues)], "k int, v double")


# The eigenvector of the larger eigenvalue v of [[a, c], [c, b]] is (c, v - a), turned so that its larger part is positive.
_AXIS = "w AS (SELECT *, (a + b + sqrt((a - b) ** 2 + 4 * c * c)) / 2 v FROM s), e AS (SELECT *, CASE WHEN CASE WHEN abs(c) >= abs(v - a) THEN c ELSE v - a END < 0 THEN -1 ELSE 1 END / sqrt(c * c + (v - a) ** 2) k FROM w) "


@query("pca_scores", "WITH s AS (SELECT var_pop(l_quantity) a, var_pop(l_extendedprice / 1000) b, covar_pop(l_quantity, l_extendedprice / 1000) c, avg(l_quantity) mx, avg(l_extendedprice / 1000) my FROM lineitem), " + _AXIS + "SELECT l_orderkey, l_linenumber, round(k * (c * (l_quantity - mx) + (v - a) * (l_extendedprice / 1000 - my)), 5) + 0.0 pc0 FROM lineitem, e")
def _(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    return decomposition.pca(df, ["l_quantity", "y"], 2).transform(df).select("l_orderkey", "l_linenumber", (F.round("pc0", 5) + 0.0).alias("pc0"))


@query("truncated_svd", "WITH s AS (SELECT avg(l_quantity ** 2) a, avg((l_extendedprice / 1000) ** 2) b, avg(l_quantity * l_extendedprice / 1000) c FROM lineitem), " + _AXIS + "SELECT l_orderkey, l_linenumber, round(k * (c * l_quantity + (v - a) * l_extendedprice / 1000), 5) + 0.0 pc0 FROM lineitem, e")
def _(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    return decomposition.truncated_svd(df, ["l_quantity", "y"], 1).transform(df).select("l_orderkey", "l_linenumber", (F.round("pc0", 5) + 0.0).alias("pc0"))


@query("logistic_score", "SELECT l_orderkey, l_linenumber, CASE WHEN -3 + 0.1 * l_quantity > 0 THEN 1 ELSE 0 END prediction FROM lineitem")
def _(spark, d):
    m = logistic.LogisticModel(("l_quantity",), (0, 1), [[0.1]], [-3.0])
    return m.predict(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", "prediction")


@query("logistic_regression", "SELECT term, 0.0::DOUBLE slope FROM (VALUES ('l_quantity'), ('l_tax'), ('intercept')) t(term)")
def _(spark, d):
    """At the minimum of the loss its slope is zero along each coefficient."""
    df = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity", "l_tax")
    m = logistic.logistic_regression(df, ["l_quantity", "l_tax"], "y")
    off = scalar.sigmoid(m.margins()[0]) - F.col("y")
    terms = {"l_quantity": F.col("l_quantity") / 50, "l_tax": F.col("l_tax") / 0.08, "intercept": F.lit(1.0)}
    slopes = df.agg(F.array(*(F.struct(F.lit(t).alias("term"), (F.round(F.avg(off * x), 5) + 0.0).alias("slope")) for t, x in terms.items())).alias("s"))
    return slopes.select(F.inline("s"))


@query("logistic_regression_classes", "SELECT k::INT k, 0.0::DOUBLE slope FROM range((SELECT count(DISTINCT label) FROM embeddings)) t(k)")
def _(spark, d):
    """The same for each of several classes: the largest slope along its coefficients, with a penalty."""
    e, names = _emb(spark, d), [f"f{j}" for j in range(64)]
    m = logistic.logistic_regression(e, names, "label", alpha=1.0)
    p = e.select(*names, "label", vectors.softmax(F.array(*m.margins())).alias("p"))
    n = e.count()
    slopes = []
    for k, c in enumerate(m.classes):
        off = F.col("p")[k] - (F.col("label") == c).cast("double")
        along = [F.abs(F.sum(off * F.col(x)) + float(m.coefficients[k][j])) / n for j, x in enumerate(names)]
        slopes.append(F.round(F.greatest(*along, F.abs(F.avg(off))), 5) + 0.0)
    return p.agg(F.array(*slopes).alias("s")).select(F.posexplode("s").alias("k", "slope"))


# -- clustering ----------------------------------------------------------------------------


def _seeds(spark, d):
    rows = table(spark, d, "embeddings").where("vec_id < 4").select("vec_id", F.col("embedding").cast("array<double>")).collect()
    return cluster.KMeans(tuple(tuple(v) for _, v in sorted(rows)))


_ASSIGN = _V + ", k AS (SELECT e.vec_id, c.vec_id q, list_sum([(z[1] - z[2]) ** 2 FOR z IN list_zip(e.v, c.v)]) d FROM e, e c WHERE c.vec_id < 4), a AS (SELECT vec_id, q, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, q) r FROM k) WHERE r = 1) "


@query("kmeans_assign", _ASSIGN + "SELECT vec_id, q::INT AS \"cluster\" FROM a")
def _(spark, d):
    return _seeds(spark, d).predict(table(spark, d, "embeddings"), "embedding").select("vec_id", "cluster")


@query("kmeans_step", _ASSIGN + "SELECT q::INT AS \"cluster\", count(*) size, round([" + ", ".join(f"avg(e.v[{j}])" for j in range(1, 65)) + "][j], 6) + 0.0 AS \"value\", (j - 1)::INT j FROM a JOIN e USING (vec_id), range(1, 65) t(j) GROUP BY q, j")
def _(spark, d):
    m = _seeds(spark, d).step(table(spark, d, "embeddings"), "embedding")
    return spark.createDataFrame([(i, s, j, round(x, 6) + 0.0) for i, (c, s) in enumerate(zip(m.centroids, m.sizes, strict=True)) for j, x in enumerate(c)], "cluster int, size bigint, j int, value double")


@query("kmeans")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return cluster.kmeans(e, 4, 10, "embedding").predict(e, "embedding").select("vec_id", "cluster")


@query("kmeans_fixed_point", "SELECT q::INT AS \"cluster\", 0.0::DOUBLE change FROM range(4) t(q)")
def _(spark, d):
    """A fixed point: assigning all rows to the centroids and averaging once more changes nothing."""
    e = table(spark, d, "embeddings")
    m = cluster.kmeans(e, 4, 300, "embedding")
    v = F.col("embedding").cast("array<double>")
    cells = m.predict(e, "embedding").select("cluster", F.posexplode(v).alias("j", "x")).groupBy("cluster", "j").agg(F.avg("x").alias("mean"))
    own = spark.createDataFrame([(i, j, x) for i, c in enumerate(m.centroids) for j, x in enumerate(c)], "cluster int, j int, c double")
    return cells.join(F.broadcast(own), ["cluster", "j"]).groupBy("cluster").agg((F.round(F.max(F.abs(F.col("mean") - F.col("c"))), 6) + 0.0).alias("change"))


def _lloyd(steps: int) -> str:
    """SQL of some steps of the plain algorithm from the first four vectors."""
    sql, mean = _V + ", c0 AS (SELECT vec_id q, v FROM e WHERE vec_id < 4)", ", ".join(f"avg(e.v[{j}])" for j in range(1, 65))
    for i in range(steps):
        sql += f""", a{i} AS (SELECT vec_id, q FROM (SELECT e.vec_id, c.q, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_sum([(z[1] - z[2]) ** 2 FOR z IN list_zip(e.v, c.v)]), c.q) r FROM e, c{i} c) WHERE r = 1),
m{i} AS (SELECT a.q, [{mean}] v FROM a{i} a JOIN e USING (vec_id) GROUP BY a.q),
c{i + 1} AS (SELECT c.q, coalesce(m.v, c.v) v FROM c{i} c LEFT JOIN m{i} m ON m.q = c.q)"""
    return sql + f' SELECT q::INT AS "cluster", generate_subscripts(v, 1)::INT - 1 j, round(unnest(v), 6) + 0.0 AS "value" FROM c{steps}'


@query("kmeans_bounded", _lloyd(6))
def _(spark, d):
    """Six steps with distance bounds, and the mean of the rows as they are then; the same as six plain steps."""
    m, _ = bounded_kmeans.kmeans_bounded(table(spark, d, "embeddings"), 4, 7, "embedding", init=_seeds(spark, d))
    return spark.createDataFrame([(i, j, round(x, 6) + 0.0) for i, c in enumerate(m.centroids) for j, x in enumerate(c)], "cluster int, j int, value double")


_DB = """WITH RECURSIVE c AS (SELECT s_suppkey i, s_acctbal / 100 x, s_nationkey::DOUBLE y FROM supplier),
n AS (SELECT a.i q, b.i i FROM c a, c b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3),
k AS (SELECT q FROM n GROUP BY q HAVING count(*) >= 4),
e AS (SELECT n.q, n.i FROM n JOIN k ON n.q = k.q JOIN k k2 ON n.i = k2.q),
w(a, b) AS (SELECT q, q FROM k UNION SELECT w.a, e.i FROM w JOIN e ON w.b = e.q),
r AS (SELECT a core, min(b) root FROM w GROUP BY a),
o AS (SELECT root, row_number() OVER (ORDER BY root) - 1 num FROM (SELECT DISTINCT root FROM r)),
g AS (SELECT n.q, min(r.root) root FROM n JOIN r ON n.i = r.core GROUP BY n.q)
SELECT c.i id, coalesce(o.num, -1) AS "cluster" FROM c LEFT JOIN g ON c.i = g.q LEFT JOIN r ON c.i = r.core LEFT JOIN o ON o.root = coalesce(r.root, g.root)"""


def _points(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 100, F.col("s_nationkey").cast("double")).alias("features"))


@query("dbscan", _DB)
def _(spark, d):
    p = _points(spark, d)
    return cluster.dbscan(p, 3.0, 4).labels.select("id", "cluster")


@query("dbscan_balls", _DB)
def _(spark, d):
    return cluster.dbscan(_points(spark, d), 3.0, 4, how="balls").labels.select("id", "cluster")


_DB_VOTE = _DB.replace("\nSELECT c.i id", ",\nl AS (SELECT c.i id") + """),
v AS (SELECT n.q query_id, l."cluster" g, count(*) c FROM n JOIN l ON n.i = l.id GROUP BY ALL)
SELECT query_id::BIGINT query_id, (g + 1)::BIGINT prediction FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, CASE WHEN g < 0 THEN 1 ELSE 0 END, g) k FROM v) WHERE k = 1"""


@query("dbscan_predict", _DB_VOTE)
def _(spark, d):
    p = _points(spark, d)
    return cluster.dbscan(p, 3.0, 4, how="balls").predict(p)


# -- trees, machines ------------------------------------------------------------------------

_SPLIT = """WITH c AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END y, 0 j, l_quantity x FROM lineitem UNION ALL SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, 1, l_discount FROM lineitem),
g AS (SELECT j, x, count(*)::DOUBLE n, sum((y = 0)::INT)::DOUBLE a, sum((y = 1)::INT)::DOUBLE b, sum((y = 2)::INT)::DOUBLE c FROM c GROUP BY 1, 2),
w AS (SELECT j, x, lead(x) OVER o nx, sum(n) OVER o ln, sum(a) OVER o la, sum(b) OVER o lb, sum(c) OVER o lc, sum(n) OVER p tn, sum(a) OVER p ta, sum(b) OVER p tb, sum(c) OVER p tc FROM g WINDOW o AS (PARTITION BY j ORDER BY x), p AS (PARTITION BY j)),
q AS (SELECT j, (x + nx) / 2 t, (1 - (ta ** 2 + tb ** 2 + tc ** 2) / tn ** 2) - ln / tn * (1 - (la ** 2 + lb ** 2 + lc ** 2) / ln ** 2) - (tn - ln) / tn * (1 - ((ta - la) ** 2 + (tb - lb) ** 2 + (tc - lc) ** 2) / (tn - ln) ** 2) gain FROM w WHERE nx IS NOT NULL)
SELECT j::INT j, round(gain, 9) gain, round(t, 6) threshold FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY gain DESC, t) r FROM q) WHERE r = 1"""


@query("tree_best_split", _SPLIT)
def _(spark, d):
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = table(spark, d, "lineitem").select(F.lit(0).alias("tree"), F.lit(0).cast("long").alias("node"), F.lit(1.0).alias("w"), y.alias("y"), F.array("l_quantity", "l_discount").alias("v"))
    return tree.best_splits(rows, 3).select("j", F.round("gain", 9).alias("gain"), r6("threshold").alias("threshold"))


def _emb(spark, d, n=64):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", *(F.col("embedding")[j].cast("double").alias(f"f{j}") for j in range(n)))


def _best(rows: str) -> str:
    """(node, j, t): the best split by Gini of each node of (node, vec_id, y, j, x) with more than two rows and two classes."""
    return f"""(SELECT node, j, t FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, j, t) r FROM (
      SELECT node, j, (x + nx) / 2 t, (sum(lc * lc) / any_value(ln) + sum((tc - lc) * (tc - lc)) / (any_value(tn) - any_value(ln))) / any_value(tn) - sum(tc * tc) / any_value(tn) ** 2 gain
      FROM (SELECT *, sum(c) OVER (PARTITION BY node, j, y ORDER BY x) lc, sum(c) OVER (PARTITION BY node, j, y) tc FROM (
        SELECT g.node, g.j, g.x, g.nx, g.ln, g.tn, k.y, coalesce(c.c, 0)::DOUBLE c
        FROM (SELECT node, j, x, lead(x) OVER (PARTITION BY node, j ORDER BY x) nx, (sum(count(*)) OVER (PARTITION BY node, j ORDER BY x))::DOUBLE ln, (sum(count(*)) OVER (PARTITION BY node, j))::DOUBLE tn FROM {rows} GROUP BY node, j, x) g
        CROSS JOIN (SELECT DISTINCT label y FROM embeddings) k
        LEFT JOIN (SELECT node, j, x, y, count(*) c FROM {rows} GROUP BY ALL) c ON c.node = g.node AND c.j = g.j AND c.x = g.x AND c.y = k.y))
      WHERE nx IS NOT NULL AND tn > 2 GROUP BY node, j, x, nx)
    WHERE gain > 1e-12) WHERE r = 1)"""


_TREE = f"""WITH c0 AS (SELECT 1 node, vec_id, label y, generate_subscripts(embedding, 1) - 1 j, unnest(embedding)::DOUBLE x FROM embeddings),
s0 AS {_best("c0")}, n1 AS (SELECT vec_id, CASE WHEN x <= t THEN 2 ELSE 3 END node FROM c0 JOIN s0 USING (node, j)),
c1 AS (SELECT n1.node, vec_id, y, j, x FROM c0 JOIN n1 USING (vec_id)), s1 AS {_best("c1")},
n2 AS (SELECT c1.vec_id, c1.node * 2 + CASE WHEN c1.x <= s1.t THEN 0 ELSE 1 END node FROM c1 JOIN s1 ON c1.node = s1.node AND c1.j = s1.j),
leaf AS (SELECT vec_id, coalesce(n2.node, n1.node) node, label FROM n1 LEFT JOIN n2 USING (vec_id) JOIN embeddings USING (vec_id)),
vote AS (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, label) k FROM leaf GROUP BY node, label)
SELECT leaf.vec_id, vote.label prediction FROM leaf JOIN vote ON leaf.node = vote.node AND k = 1"""


@query("decision_tree_classifier", _TREE)
def _(spark, d):
    e = _emb(spark, d)
    return tree.decision_tree_classifier(e, [f"f{j}" for j in range(64)], "label", max_depth=2).predict(e).select("vec_id", "prediction")


#: Cuts of each component for trees that learn from binned values; a value counts as the least cut not below it.
_CUTS = [-0.2, -0.1, -0.05, 0.0, 0.05, 0.1, 0.2]
_CUT = "CASE " + " ".join(f"WHEN x <= {c} THEN {c}" for c in _CUTS) + " ELSE 9.0 END::DOUBLE x"


@query("decision_tree_classifier_binned", _TREE.replace("SELECT 1 node, vec_id, label y, generate_subscripts(embedding, 1) - 1 j, unnest(embedding)::DOUBLE x FROM embeddings", f"SELECT 1 node, vec_id, y, j, {_CUT} FROM (SELECT vec_id, label y, generate_subscripts(embedding, 1) - 1 j, unnest(embedding)::DOUBLE x FROM embeddings)"))
def _(spark, d):
    e = _emb(spark, d)
    return tree.decision_tree_classifier(e, [f"f{j}" for j in range(64)], "label", max_depth=2, cuts=[_CUTS] * 64).predict(e).select("vec_id", "prediction")


def _best_mean(rows: str) -> str:
    """(node, j, t): the split of (node, vec_id, y, j, x) that leaves the least squares in each node."""
    return f"""(SELECT node, j, t FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, j, t) r FROM (
      SELECT node, j, x t, ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn gain
      FROM (SELECT node, j, x, lead(x) OVER o nx, sum(sum(y)) OVER o ls, sum(count(*)) OVER o ln, sum(sum(y)) OVER p ts, sum(count(*)) OVER p tn FROM {rows} GROUP BY node, j, x WINDOW o AS (PARTITION BY node, j ORDER BY x), p AS (PARTITION BY node, j))
      WHERE nx IS NOT NULL) WHERE gain > 1e-12) WHERE r = 1)"""


@query(
    "decision_tree_regressor",
    f"""WITH c0 AS (SELECT 1 node, vec_id, y, j, {_CUT} FROM (SELECT vec_id, embedding[64]::DOUBLE y, generate_subscripts(embedding, 1) - 1 j, unnest(embedding)::DOUBLE x FROM embeddings) WHERE j < 63),
s0 AS {_best_mean("c0")}, n1 AS (SELECT vec_id, CASE WHEN x <= t THEN 2 ELSE 3 END node FROM c0 JOIN s0 USING (node, j)),
c1 AS (SELECT n1.node, vec_id, y, j, x FROM c0 JOIN n1 USING (vec_id)), s1 AS {_best_mean("c1")},
n2 AS (SELECT c1.vec_id, c1.node * 2 + CASE WHEN c1.x <= s1.t THEN 0 ELSE 1 END node FROM c1 JOIN s1 ON c1.node = s1.node AND c1.j = s1.j),
leaf AS (SELECT vec_id, coalesce(n2.node, n1.node) node, embedding[64]::DOUBLE y FROM n1 LEFT JOIN n2 USING (vec_id) JOIN embeddings USING (vec_id))
SELECT vec_id, round(avg(y) OVER (PARTITION BY node), 6) + 0.0 prediction FROM leaf""",
)
def _(spark, d):
    e = _emb(spark, d)
    return tree.decision_tree_regressor(e, _PARTS, "f63", max_depth=2, cuts=[_CUTS] * 63).predict(e).select("vec_id", (r6("prediction") + 0.0).alias("prediction"))


@query("forest_bags", "SELECT t::INT tree, label, count(*)::BIGINT drawn FROM embeddings, range(5) r(t) GROUP BY ALL")
def _(spark, d):
    """Each tree of a forest draws as many rows of each class as the class has."""
    e = _emb(spark, d, 8)
    f = tree.random_forest_classifier(e, [f"f{j}" for j in range(8)], "label", "vec_id", n_trees=5, max_depth=1)
    drawn = f.bags.select(F.col("id").alias("vec_id"), F.posexplode("w").alias("tree", "w")).join(e.select("vec_id", "label"), "vec_id")
    return drawn.groupBy("tree", "label").agg(F.sum("w").alias("drawn"))


@query("forest_oob", "SELECT vec_id FROM embeddings")
def _(spark, d):
    """Rows with a vote by the trees that left them out: of sixty-four trees some leave out each row."""
    e = _emb(spark, d, 8)
    f = tree.random_forest_classifier(e, [f"f{j}" for j in range(8)], "label", "vec_id", n_trees=64, max_depth=2)
    return f.predict_oob(e, "vec_id").where("prediction is not null").select("vec_id")


@query("random_forest_classifier")
def _(spark, d):
    e = _emb(spark, d)
    return tree.random_forest_classifier(e, [f"f{j}" for j in range(64)], "label", "vec_id", n_trees=5, max_depth=3).predict(e).select("vec_id", "prediction")


@query("random_forest_regressor")
def _(spark, d):
    e = _emb(spark, d)
    return tree.random_forest_regressor(e, _PARTS, "f63", "vec_id", n_trees=5, max_depth=3).predict(e).select("vec_id", "prediction")


@query("svm_decision", _V + ", s AS (SELECT vec_id k, v w FROM e WHERE vec_id < 3) SELECT vec_id, round(0.25 + sum((k - 1) * exp(-0.5 * list_distance(v, w) ** 2)), 6) + 0.0 score, CASE WHEN 0.25 + sum((k - 1) * exp(-0.5 * list_distance(v, w) ** 2)) > 0 THEN 1 ELSE -1 END prediction FROM e, s GROUP BY vec_id")
def _(spark, d):
    import numpy as np

    rows = sorted(_vec(spark, d).where("vec_id < 3").collect())
    m = svm.SupportVectors(kernels.RBF(0.5), np.array([v for _, v in rows]), np.array([i - 1.0 for i, _ in rows]), 0.25)
    return m.predict_class(_vec(spark, d), "v").select("vec_id", (r6(m.decision(F.col("v"))) + 0.0).alias("score"), "prediction")


@query("svc")
def _(spark, d):
    e = _train(spark, d).withColumn("t", F.when(F.col("label") < 5, 1).otherwise(-1))
    return svm.svc(e, "features", "t", kernels.RBF(0.5)).predict_class(_train(spark, d)).select("id", "prediction")


@query("svr")
def _(spark, d):
    e = _train(spark, d)
    return svm.svr(e, "features", "y", kernels.Linear()).predict_value(_train(spark, d)).select("id", "prediction")


def _proof(rows, m, y, c, loss, low, high, eps):
    """Each row's dual within its bounds, what the whole lacks of the optimum as a share of the objective, and the duals' sum."""
    f = materialise(m.machine.predict_value(rows, "features", "f").select("id", F.col(y).cast("double").alias("y"), "f").join(m.duals.select("id", "dual"), "id"), "proof")
    gap = c * loss + eps * F.abs("dual") + F.col("dual") * (F.col("f") - F.col("y"))
    one = f.agg(F.sum(gap).alias("g"), F.sum(c * loss + F.col("dual") * (F.col("f") - m.machine.bias) / 2).alias("p"), F.sum("dual").alias("s"))
    box = (F.col("dual") >= low) & (F.col("dual") <= high) & (gap > -1e-9)
    return f.crossJoin(F.broadcast(one)).select("id", box.alias("in_box"), (F.col("g") <= 1e-3 * F.greatest(F.lit(1.0), "p")).alias("gap_small"), (F.abs("s") <= 1e-3 * F.greatest(F.lit(1.0), "p")).alias("adds_up"))


_PROOF = "SELECT vec_id::BIGINT id, true in_box, true gap_small, true adds_up FROM embeddings"


@query("svc_dual", _PROOF)
def _(spark, d):
    """The optimum of a two-class machine, proved by its duals."""
    e = _train(spark, d).withColumn("t", F.when(F.col("label") < 5, 1).otherwise(-1))
    m = svm_dual.fit(e, "features", "t", kernels.RBF(0.5), "id")
    loss = F.greatest(F.lit(0.0), 1 - F.col("y") * F.col("f"))
    return _proof(e, m, "t", 1.0, loss, F.least(F.lit(0.0), "y"), F.greatest(F.lit(0.0), "y"), 0.0)


@query("svr_dual", _PROOF)
def _(spark, d):
    e = _train(spark, d)
    m = svm_dual.fit(e, "features", "y", kernels.Linear(), "id", eps=0.1)
    loss = F.greatest(F.lit(0.0), F.abs(F.col("f") - F.col("y")) - 0.1)
    return _proof(e, m, "y", 1.0, loss, F.lit(-1.0), F.lit(1.0), 0.1)


# -- model selection -----------------------------------------------------------------------------


@query("train_test_split", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.25) THEN 'test' ELSE 'train' END part FROM orders")
def _(spark, d):
    train, test = selection.train_test_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.25, shuffle=False)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("k_fold", "WITH n AS (SELECT count(*) n FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 i FROM orders) SELECT o_orderkey, (CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END)::INT fold FROM r, n")
def _(spark, d):
    return selection.k_fold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7, shuffle=False)


_CV = """WITH n AS (SELECT count(*) n FROM part), r AS (SELECT p_size::DOUBLE x, p_retailprice / 1000 y, row_number() OVER (ORDER BY p_partkey) - 1 i FROM part),
f AS (SELECT x, y, (CASE WHEN i < (n % 3) * (n // 3 + 1) THEN i // (n // 3 + 1) ELSE n % 3 + (i - (n % 3) * (n // 3 + 1)) // (n // 3) END)::INT fold FROM r, n),
m AS (SELECT k.fold k, regr_slope(y, x) w, regr_intercept(y, x) b FROM f, (SELECT DISTINCT fold FROM f) k WHERE f.fold <> k.fold GROUP BY k.fold)
SELECT k fold, round(avg(CASE WHEN fold = k THEN (y - w * x - b) ** 2 END), 6) test, round(avg(CASE WHEN fold <> k THEN (y - w * x - b) ** 2 END), 6) train FROM f, m GROUP BY k"""


@query("cross_validate", _CV)
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    score = lambda t: metrics.score(metrics.mean_squared_error(t, "y", "prediction"))
    cv = selection.cross_validate(p, "p_partkey", lambda t: linear.linear_regression(t, ["x"], "y"), score, 3, shuffle=False)
    return spark.createDataFrame([(i, round(a, 6), round(b, 6)) for i, (a, b) in enumerate(zip(cv.test_score, cv.train_score, strict=True))], "fold int, test double, train double")


@query("cross_val_predict", _CV.split("SELECT k fold")[0].replace("SELECT p_size::DOUBLE x", "SELECT p_partkey, p_size::DOUBLE x").replace("SELECT x, y,", "SELECT p_partkey, x, y,") + "SELECT p_partkey, round(w * x + b, 6) prediction FROM f JOIN m ON fold = k")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    out = selection.cross_val_predict(p, "p_partkey", lambda t: linear.linear_regression(t, ["x"], "y"), 3, shuffle=False)
    return out.select("p_partkey", r6("prediction").alias("prediction"))


_GRID = _CV.split("m AS (SELECT k.fold")[0] + """m AS (SELECT k.fold k, a.a, count(*) * covar_pop(y, x) / (var_pop(x) * (count(*) + a.a)) w, avg(y) - count(*) * covar_pop(y, x) / (var_pop(x) * (count(*) + a.a)) * avg(x) b
  FROM f, (SELECT DISTINCT fold FROM f) k, (VALUES (1.0::DOUBLE), (1e6)) a(a) WHERE f.fold <> k.fold GROUP BY k.fold, a.a),
t AS (SELECT a, k, avg((y - w * x - b) ** 2) e FROM f JOIN m ON fold = k GROUP BY a, k)
SELECT a alpha, round(-avg(e), 6) score FROM t GROUP BY a"""


@query("grid_search", _GRID)
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    score = lambda t: -metrics.score(metrics.mean_squared_error(t, "y", "prediction"))
    g = selection.grid_search(p, "p_partkey", lambda t, alpha: linear.ridge_regression(t, ["x"], "y", alpha), score, {"alpha": [1.0, 1e6]}, n_splits=3, shuffle=False)
    return spark.createDataFrame([(float(a["alpha"]), round(s, 6)) for a, s in g.scores], "alpha double, score double")


@query("k_fold_shuffled", "SELECT f fold, n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END size, 5 * (n // 5) + n % 5 AS total FROM (SELECT count(*) n FROM orders), range(5) t(f)")
def _(spark, d):
    f = selection.k_fold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5, shuffle=True, seed=3)
    total = f.agg(F.countDistinct("o_orderkey").alias("total"))
    return f.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("size")).crossJoin(F.broadcast(total))


@query("train_test_split_shuffled", "SELECT floor(count(*) * 0.25)::BIGINT test, (count(*) - floor(count(*) * 0.25))::BIGINT train, 0::BIGINT common FROM orders")
def _(spark, d):
    train, test = selection.train_test_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.25, shuffle=True, seed=4)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(test, "test").crossJoin(count(train, "train")).crossJoin(count(test.join(train, "o_orderkey", "left_semi"), "common"))


# -- sources, streams ------------------------------------------------------------------------------


@query("csv_round_trip", "SELECT s_suppkey::DOUBLE f0, s_acctbal f1 FROM supplier")
def _(spark, d):
    path = f"{shared_dir(spark)}/weftline/csv-{uuid.uuid4().hex}"
    csv.write_matrix(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), path)
    return csv.read_matrix(spark, path)


@query("make_circles", "SELECT i id, round(CASE WHEN i < 50 THEN cos(2 * pi() * i / 50) ELSE 0.5 * cos(2 * pi() * (i - 50) / 50) END, 6) + 0.0 x, round(CASE WHEN i < 50 THEN sin(2 * pi() * i / 50) ELSE 0.5 * sin(2 * pi() * (i - 50) / 50) END, 6) + 0.0 y, CASE WHEN i < 50 THEN 0 ELSE 1 END \"label\" FROM range(100) t(i)")
def _(spark, d):
    return datasets.make_circles(spark, 100, 0.5).select("id", (r6(F.col("features")[0]) + 0.0).alias("x"), (r6(F.col("features")[1]) + 0.0).alias("y"), "label")


@query("make_moons", "SELECT i id, round(CASE WHEN i < 50 THEN cos(pi() * i / 50) ELSE 1 - cos(pi() * (i - 50) / 50) END, 6) + 0.0 x, round(CASE WHEN i < 50 THEN sin(pi() * i / 50) ELSE 0.5 - sin(pi() * (i - 50) / 50) END, 6) + 0.0 y, CASE WHEN i < 50 THEN 0 ELSE 1 END \"label\" FROM range(100) t(i)")
def _(spark, d):
    return datasets.make_moons(spark, 100).select("id", (r6(F.col("features")[0]) + 0.0).alias("x"), (r6(F.col("features")[1]) + 0.0).alias("y"), "label")


@query("make_blobs")
def _(spark, d):
    return datasets.make_blobs(spark, 200, 3, 4, seed=5)


@query("stream_scores", "SELECT count(*) n, round(sum(1 + 2 * value), 4) total FROM events")
def _(spark, d):
    events = table(spark, d, "events")
    name = f"scores_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    scored = scoring.score_stream(stream, linear.LinearModel(("value",), (2.0,), 1.0)).groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("total"))
    q = scored.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/weftline/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("n", F.round("total", 4).alias("total"))


@query("stream_stats", "SELECT count(value) value_n, round(avg(value), 6) value_mean, round(var_pop(value), 4) value_var FROM events")
def _(spark, d):
    events = table(spark, d, "events")
    name = f"stats_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    q = scoring.running_stats(stream, ["value"]).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/weftline/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("value_n", r6("value_mean").alias("value_mean"), F.round("value_var", 4).alias("value_var"))


def _parts_of_events(spark, d, name):
    """The events in several files, so that a stream of them has several batches."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("double").alias("u"), F.length("event_type").cast("double").alias("t"), "value", "event_type", F.array("value", F.col("user_id").cast("double")).alias("features"))
    path = f"{shared_dir(spark)}/weftline/{name}"
    e.repartition(4, "event_id").write.parquet(f"{path}/in")
    return path, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


@query(
    "stream_linear_model",
    "WITH s AS (SELECT avg(user_id) a, avg(length(event_type)) b, avg(value) m, var_pop(user_id) v1, var_pop(length(event_type)) v2, covar_pop(user_id, length(event_type)) v12, covar_pop(user_id, value) c1, covar_pop(length(event_type), value) c2 FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL), w AS (SELECT (v2 * c1 - v12 * c2) / (v1 * v2 - v12 * v12) w1, (v1 * c2 - v12 * c1) / (v1 * v2 - v12 * v12) w2, a, b, m FROM s) SELECT 'u' term, round(w1, 5) + 0.0 w FROM w UNION ALL SELECT 't', round(w2, 5) + 0.0 FROM w UNION ALL SELECT 'intercept', round(m - w1 * a - w2 * b, 5) + 0.0 FROM w",
)
def _(spark, d):
    """Least squares kept by a stream; its last batch is run twice, as after a failure."""
    path, stream = _parts_of_events(spark, d, f"kept_{uuid.uuid4().hex}")
    model = kept.KeptLinear(f"{path}/sums", ("u", "t"), "value")
    model.start(stream, f"{path}/checkpoint", availableNow=True).awaitTermination()
    last = kept.batches(spark, model.path)[-1]
    before, again = (kept.total(spark, model.path, b).withColumnRenamed("v", n) for b, n in ((last - 1, "b"), (last, "a")))
    batch = again.join(before, ["i", "j"]).select("i", "j", (F.col("a") - F.col("b")).alias("v"))
    kept.add_batch(model.path, lambda df: df, ["i", "j"])(materialise(batch, "last-batch"), last)
    return _coef(spark, model.model(spark), 5)


@query("stream_class_stats", "SELECT event_type label, 0 j, count(value) n, round(avg(value), 5) theta, round(var_pop(value), 3) var FROM events GROUP BY 1 UNION ALL SELECT event_type, 1, count(user_id), round(avg(user_id), 5), round(var_pop(user_id), 3) FROM events GROUP BY 1")
def _(spark, d):
    path, stream = _parts_of_events(spark, d, f"classes_{uuid.uuid4().hex}")
    model = kept.KeptClasses(f"{path}/sums", "event_type")
    model.start(stream, f"{path}/checkpoint", availableNow=True).awaitTermination()
    return model.stats(spark).select("label", "j", "n", F.round("theta", 5).alias("theta"), F.round("var", 3).alias("var"))


@query("xy_round_trip", "SELECT vec_id, label::DOUBLE target, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 total FROM embeddings")
def _(spark, d):
    """Written to several files and read back; the identifier goes along as a feature."""
    path = f"{shared_dir(spark)}/weftline/xy-{uuid.uuid4().hex}"
    e = table(spark, d, "embeddings").select(F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>")).alias("features"), F.col("label").alias("target"), "vec_id")
    datasets.write_xy(e.repartition(4, "vec_id"), path)
    back = datasets.read_xy(spark, path)
    total = F.aggregate(F.slice("features", 2, 64), F.lit(0.0), lambda a, x: a + x)
    return back.select(F.col("features")[0].cast("long").alias("vec_id"), "target", (F.round(total, 4) + 0.0).alias("total"))
