"""ML, anomaly-model and forecast-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import anomaly, forecast as fc, knn, ml
from tessera.plans.catalog import register
from tessera.plans.oracle import oracle
from tessera.plans.views import sales, table, with_sales

REG_FEATURES = ["p_size", "p_brand", "p_type"]
CLF_FEATURES = ["n_chars", "lang", "source"]


def _docs(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    doc = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    return lab.join(doc, "doc_id")


@register("ml_prepare")
def ml_prepare(spark, d):
    p = ml.prepare(table(spark, d, "part"), "p_retailprice", REG_FEATURES)
    return p.select("label", "is_test", *[F.round(c + "_scaled", 6).alias(c + "_scaled") for c in REG_FEATURES])


def _split(*texts: str) -> str:
    """The split's rule on columns as text, seed first."""
    return f"CAST('0x' || substr(md5(concat_ws('|', '42', {', '.join(texts)})), 1, 8) AS BIGINT) % 10000 < 2000"


_PREPARED = f"""WITH e AS (SELECT CAST(p_size AS DOUBLE) AS a, CAST(DENSE_RANK() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS b,
             CAST(DENSE_RANK() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS c, p_retailprice AS y
      FROM part WHERE p_size IS NOT NULL AND p_brand IS NOT NULL AND p_type IS NOT NULL AND p_retailprice IS NOT NULL),
h AS (SELECT *, {_split('a', 'b', 'c', 'y')} AS is_test FROM e),
m AS (SELECT AVG(a) AS ma, STDDEV_POP(a) AS sa, AVG(b) AS mb, STDDEV_POP(b) AS sb, AVG(c) AS mc, STDDEV_POP(c) AS sc,
             AVG(y) AS my FROM h WHERE NOT is_test),
z AS (SELECT y, is_test, (a - ma) / sa AS x1, (b - mb) / sb AS x2, (c - mc) / sc AS x3, my FROM h, m)"""

oracle("ml_prepare", _PREPARED + """
SELECT y AS label, is_test, ROUND(x1, 6) AS p_size_scaled, ROUND(x2, 6) AS p_brand_scaled, ROUND(x3, 6) AS p_type_scaled FROM z""")


_QUALITY = """SELECT '{model}' AS model, ROUND(AVG(ABS(y - yhat)), 4) AS mae, ROUND(SQRT(AVG((y - yhat) * (y - yhat))), 4) AS rmse,
       ROUND(1 - SUM((y - yhat) * (y - yhat)) / SUM((y - ybar) * (y - ybar)), 4) AS r2,
       CAST(MAX(n_train) AS BIGINT) AS n_train, CAST(COUNT(*) AS BIGINT) AS n_test FROM p"""


def _least_squares(model: str, penalty: float) -> str:
    """Normal equations of three centred features by Cramer's rule; the penalty is on squared weights, not on the intercept."""
    return f"""{_PREPARED},
g AS (SELECT SUM(x1 * x1) + {penalty} AS a, SUM(x1 * x2) AS b, SUM(x1 * x3) AS c, SUM(x2 * x2) + {penalty} AS d, SUM(x2 * x3) AS e,
             SUM(x3 * x3) + {penalty} AS f, SUM(x1 * (y - my)) AS u, SUM(x2 * (y - my)) AS v, SUM(x3 * (y - my)) AS w,
             COUNT(*) AS n_train FROM z WHERE NOT is_test),
s AS (SELECT n_train, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det,
             u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w) AS d1,
             a * (v * f - e * w) - u * (b * f - e * c) + c * (b * w - v * c) AS d2,
             a * (d * w - v * e) - b * (b * w - v * c) + u * (b * e - d * c) AS d3 FROM g),
p AS (SELECT y, my + (d1 * x1 + d2 * x2 + d3 * x3) / det AS yhat, n_train, AVG(y) OVER () AS ybar FROM z, s WHERE is_test)
{_QUALITY.format(model=model)}"""


_SOFT = "SIGN({x}) * GREATEST(ABS({x}) - 1, 0)"

# coordinate descent on the co-moments: squared error / 2n + sum of absolute weights
oracle("reg_lasso", f"""WITH RECURSIVE {_PREPARED.removeprefix("WITH ")},
g AS (SELECT AVG(x1 * x2) AS a, AVG(x1 * x3) AS b, AVG(x2 * x3) AS c, AVG(x1 * (y - my)) AS u, AVG(x2 * (y - my)) AS v,
             AVG(x3 * (y - my)) AS w, COUNT(*) AS n_train FROM z WHERE NOT is_test),
l AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2, CAST(0 AS DOUBLE) AS w3
      UNION ALL
      SELECT i + 1, n1, n2, {_SOFT.format(x="(w - b * n1 - c * n2)")} FROM (
        SELECT *, {_SOFT.format(x="(v - a * n1 - c * w3)")} AS n2 FROM (
          SELECT l.*, g.*, {_SOFT.format(x="(u - a * w2 - b * w3)")} AS n1 FROM l, g WHERE i < 200))),
p AS (SELECT y, my + w1 * x1 + w2 * x2 + w3 * x3 AS yhat, n_train, AVG(y) OVER () AS ybar FROM z, l, g WHERE is_test AND i = 200)
{_QUALITY.format(model="lasso")}""")
oracle("reg_linear", _least_squares("linear", 0.0))
oracle("reg_ridge", _least_squares("ridge", 1.0))


for _m in ("linear", "ridge", "lasso", "rf", "gbt"):
    register(f"reg_{_m}")(lambda spark, d, _m=_m: ml.train_regression(
        table(spark, d, "part"), "p_retailprice", REG_FEATURES, _m)[0])

for _m in ("logistic", "rf", "gbt", "svm"):
    register(f"clf_{_m}")(lambda spark, d, _m=_m: ml.train_classification(
        _docs(spark, d), "quality", CLF_FEATURES, _m)[0])


@register("clf_knn")
def clf_knn(spark, d):
    return ml.train_classification(table(spark, d, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"],
                                   "knn")[0]


@register("clf_gbt_multi")
def clf_gbt_multi(spark, d):
    """Five classes: one tree per class and round."""
    return ml.train_classification(table(spark, d, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"], "gbt")[0]


@register("feature_importance")
def feature_importance(spark, d):
    return ml.train_regression(table(spark, d, "part"), "p_retailprice", REG_FEATURES, "rf")[1]


@register("feature_regression")
def feature_regression(spark, d):
    m, imp, _ = ml.feature_regression(table(spark, d, "lineitem"), "l_extendedprice")
    return m.crossJoin(imp)


@register("reg_linear_1d")
def reg_linear_1d(spark, d):
    li = table(spark, d, "lineitem")
    a = li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"),
               F.regr_intercept("l_extendedprice", "l_quantity").alias("a"),
               F.regr_r2("l_extendedprice", "l_quantity").alias("r2"))
    return a.select(F.round("b", 6).alias("slope"), F.round("a", 6).alias("intercept"), F.round("r2", 6).alias("r2"))


oracle("reg_linear_1d", """
SELECT ROUND(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       ROUND(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       ROUND(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")


@register("regression_metrics")
def regression_metrics(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    pred = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"))
    return ml.regression_metrics(pred)


oracle("regression_metrics", """
WITH p AS (SELECT l_extendedprice AS y, l_quantity * p_retailprice AS yhat
           FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT AVG(y) AS ybar FROM p)
SELECT ROUND(AVG(ABS(y - yhat)), 4) AS mae, ROUND(SQRT(AVG((y - yhat) * (y - yhat))), 4) AS rmse,
       ROUND(1 - SUM((y - yhat) * (y - yhat)) / SUM((y - ybar) * (y - ybar)), 4) AS r2,
       CAST(COUNT(*) AS BIGINT) AS n FROM p, m""")

_RULE = "CASE WHEN n_chars >= 2000 THEN 1 ELSE 0 END"


def _rule_pred(spark, d):
    return _docs(spark, d).select(F.col("quality").cast("double").alias("label"),
                                  F.when(F.col("n_chars") >= 2000, 1.0).otherwise(0.0).alias("prediction"))


def _metrics_sql(src: str) -> str:
    return f"""WITH p AS ({src}),
c AS (SELECT c, SUM(hit) AS tp, SUM(is_a) AS n_act, SUM(1 - is_a) AS n_pred FROM (
        SELECT y AS c, 1 AS is_a, CASE WHEN y = yhat THEN 1 ELSE 0 END AS hit FROM p
        UNION ALL SELECT yhat, 0, 0 FROM p) GROUP BY c),
m AS (SELECT c, tp, n_act,
             COALESCE(CASE WHEN n_pred > 0 THEN tp * 1.0 / n_pred END, 0.0) AS pr,
             COALESCE(CASE WHEN n_act > 0 THEN tp * 1.0 / n_act END, 0.0) AS re FROM c),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END AS f1 FROM m),
a AS (SELECT SUM(tp) AS hits, SUM(n_act) AS n, COUNT(*) FILTER (WHERE n_act > 0) AS k,
             SUM(n_act * pr) / SUM(n_act) AS wp, SUM(n_act * re) / SUM(n_act) AS wr, SUM(n_act * f1) / SUM(n_act) AS wf,
             COALESCE(MAX(CASE WHEN c = 1 THEN pr END), 0.0) AS bp, COALESCE(MAX(CASE WHEN c = 1 THEN re END), 0.0) AS br,
             COALESCE(MAX(CASE WHEN c = 1 THEN f1 END), 0.0) AS bf FROM f)
SELECT ROUND(hits * 1.0 / n, 4) AS accuracy,
       ROUND(CASE WHEN k <= 2 THEN bp ELSE wp END, 4) AS precision,
       ROUND(CASE WHEN k <= 2 THEN br ELSE wr END, 4) AS recall,
       ROUND(CASE WHEN k <= 2 THEN bf ELSE wf END, 4) AS f1,
       CASE WHEN k <= 2 THEN 'binary' ELSE 'weighted' END AS average FROM a"""


_DOCS_SQL = "SELECT CAST(quality AS DOUBLE) AS y, CAST(" + _RULE + " AS DOUBLE) AS yhat FROM labels JOIN documents USING (doc_id)"


@register("classification_metrics")
def classification_metrics(spark, d):
    return ml.classification_metrics(_rule_pred(spark, d))


oracle("classification_metrics", _metrics_sql(_DOCS_SQL))


@register("classification_metrics_weighted")
def classification_metrics_weighted(spark, d):
    li = table(spark, d, "lineitem")
    pred = li.select(F.col("l_linenumber").cast("double").alias("label"),
                     (F.pmod(F.col("l_quantity").cast("int"), F.lit(7)) + 1).cast("double").alias("prediction"))
    return ml.classification_metrics(pred)


oracle("classification_metrics_weighted", _metrics_sql(
    "SELECT CAST(l_linenumber AS DOUBLE) AS y, CAST(CAST(l_quantity AS INTEGER) % 7 + 1 AS DOUBLE) AS yhat "
    "FROM lineitem"))


@register("confusion_matrix")
def confusion_matrix(spark, d):
    return ml.confusion_matrix(_rule_pred(spark, d))


oracle("confusion_matrix", f"""
SELECT y AS actual, yhat AS predicted, CAST(COUNT(*) AS BIGINT) AS count FROM ({_DOCS_SQL}) GROUP BY 1, 2""")


@register("label_encode")
def label_encode(spark, d):
    return ml.label_encode(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"])


oracle("label_encode", """
SELECT p_partkey, p_brand, CAST(DENSE_RANK() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS p_brand_code FROM part""")


@register("standard_scale")
def standard_scale(spark, d):
    s = ml.standard_scale(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"),
                          ["p_size", "p_retailprice"])
    return s.select("p_partkey", F.round("p_size_scaled", 6).alias("p_size_scaled"),
                    F.round("p_retailprice_scaled", 6).alias("p_retailprice_scaled"))


oracle("standard_scale", """
WITH s AS (SELECT AVG(p_size) AS ms, STDDEV_POP(p_size) AS ss, AVG(p_retailprice) AS mr,
                  STDDEV_POP(p_retailprice) AS sr FROM part)
SELECT p_partkey, ROUND(CASE WHEN ss > 0 THEN (p_size - ms) / ss ELSE 0.0 END, 6) AS p_size_scaled,
       ROUND(CASE WHEN sr > 0 THEN (p_retailprice - mr) / sr ELSE 0.0 END, 6) AS p_retailprice_scaled
FROM part, s""")


@register("train_test_split")
def train_test_split(spark, d):
    s = ml.hash_split(table(spark, d, "orders"))
    return s.groupBy("is_test").agg(F.count(F.lit(1)).cast("long").alias("rows"))


oracle("train_test_split", f"""
SELECT {_split('o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority')} AS is_test,
       CAST(COUNT(*) AS BIGINT) AS rows FROM orders GROUP BY 1""")


@register("chrono_split")
def chrono_split(spark, d):
    s = ml.chrono_split(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    return s.agg(F.count_if(~F.col("is_test")).cast("long").alias("n_train"),
                 F.count_if("is_test").cast("long").alias("n_test"),
                 F.max(F.when(~F.col("is_test"), F.col("o_orderdate"))).alias("last_train"),
                 F.min(F.when(F.col("is_test"), F.col("o_orderdate"))).alias("first_test"))


oracle("chrono_split", """
WITH n AS (SELECT COUNT(*) AS n FROM orders),
o AS (SELECT o_orderdate, ROW_NUMBER() OVER (ORDER BY o_orderdate) AS rn FROM orders)
SELECT CAST(n - CEIL(n * 0.2) AS BIGINT) AS n_train, CAST(CEIL(n * 0.2) AS BIGINT) AS n_test,
       MAX(CASE WHEN rn <= n - CEIL(n * 0.2) THEN o_orderdate END) AS last_train,
       MIN(CASE WHEN rn > n - CEIL(n * 0.2) THEN o_orderdate END) AS first_test
FROM o, n GROUP BY n""")


@register("isolation_forest")
def isolation_forest(spark, d):
    return anomaly.detect(table(spark, d, "events"), ["value", "user_id"], "isolation_forest")[0]


@register("lof")
def lof(spark, d):
    return anomaly.detect(table(spark, d, "events"), ["value", "user_id"], "lof")[0]


@register("anomaly_detect")
def anomaly_detect(spark, d):
    return anomaly.detect(table(spark, d, "events"), ["value"], "iqr")[0]


oracle("anomaly_detect", """
WITH q AS (SELECT QUANTILE_CONT(value, 0.25) AS a, QUANTILE_CONT(value, 0.75) AS b FROM events)
SELECT 'IQR' AS method,
       CAST(COUNT(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS BIGINT) AS anomaly_count,
       ROUND(COUNT(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) * 100.0 / COUNT(*), 2)
       AS anomaly_pct FROM events, q""")


@register("knn_neighbors")
def knn_neighbors(spark, d):
    """Exact 5 nearest customers (by balance and nation key) of every customer."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    vec = F.array(F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double"))
    pts = knn.distinct_points(c.select(vec.alias("vec")), "vec")
    nn = knn.knn_search(pts.select(F.col("pid").alias("qid"), "vec"), pts, 5, 2, exclude_self=True)
    return nn.groupBy("qid").agg(F.round(F.max("dist"), 6).alias("kdist"), F.sum("c").cast("long").alias("k")) \
        .join(pts.select(F.col("pid").alias("qid"), "vec"), "qid") \
        .select(F.col("vec")[0].alias("c_acctbal"), F.col("vec")[1].cast("int").alias("c_nationkey"), "kdist", "k")


def _forest_sql(by: str, n_train: str = "n", least: int = 1, periods: int = 3) -> str:
    """CTEs up to ``p``: (key, idx, value, is_test, pred, n) of months and steps beyond, by the forest's own draws."""
    mix = "xor(s, s >> 15) * 48271 % 2147483647 AS s"
    return f"""m AS (SELECT {by} AS key, strftime(order_date, '%Y-%m') AS period, SUM(sales) AS value FROM sales
      WHERE order_date IS NOT NULL AND sales IS NOT NULL AND {by} IS NOT NULL GROUP BY 1, 2),
i AS (SELECT key, value, ROW_NUMBER() OVER (PARTITION BY key ORDER BY period) - 1 AS idx FROM m),
n AS (SELECT key, n, CAST({n_train} AS BIGINT) AS k FROM (SELECT key, COUNT(*) AS n FROM i GROUP BY key) WHERE n >= {least}),
s0 AS (SELECT key, k, t, (42 * 7919 + t * 104729 + idx * 1299709 + 1) % 2147483647 AS s
       FROM n JOIN i USING (key), (SELECT UNNEST(range(0, 100)) AS t) WHERE idx < k),
s1 AS (SELECT key, k, t, {mix} FROM s0), s2 AS (SELECT key, k, t, {mix} FROM s1), s3 AS (SELECT key, k, t, {mix} FROM s2),
d AS (SELECT DISTINCT key, t, s % k AS place FROM s3),
c AS (SELECT key, t, place, LAG(place) OVER o AS prev, LEAD(place) OVER o AS nxt FROM d WINDOW o AS (PARTITION BY key, t ORDER BY place)),
x AS (SELECT key, idx, value, k, n FROM i JOIN n USING (key) UNION ALL SELECT key, n + step, NULL, k, n FROM n, (SELECT UNNEST(range(0, {periods})) AS step)),
p AS (SELECT x.key, x.idx, x.value, x.n, x.k, x.idx >= x.k AND x.idx < x.n AS is_test, ROUND(AVG(v.value), 6) AS pred
      FROM x JOIN c ON c.key = x.key AND (prev IS NULL OR 2 * x.idx > prev + place) AND (nxt IS NULL OR 2 * x.idx <= place + nxt)
      JOIN i v ON v.key = c.key AND v.idx = c.place GROUP BY ALL)"""


_RF_FUTURE = """CAST(idx - n + 1 AS BIGINT) AS step, 'Month +' || CAST(idx - n + 1 AS VARCHAR) AS period, ROUND(pred, 2) AS forecast"""
_RF_BAND = "ROUND(pred - 1.96 * sd, 2) AS lower, ROUND(pred + 1.96 * sd, 2) AS upper"
_RF_SD = "(SELECT key, STDDEV_POP(value - pred) AS sd FROM p WHERE value IS NOT NULL GROUP BY key)"
_RF_QUALITY = """ROUND(AVG(ABS(value - pred)), 2) AS mae, ROUND(SQRT(AVG((value - pred) * (value - pred))), 2) AS rmse,
       ROUND(1 - SUM((value - pred) * (value - pred)) / SUM((value - ybar) * (value - ybar)), 4) AS r2"""
_RF_HOLDOUT = "n - CEIL(n * CAST(0.2 AS DOUBLE))"


@register("forecast_rf")
def forecast_rf(spark, d):
    return fc.forecast_rf(sales(spark, d), "order_date", "sales")[0]


oracle("forecast_rf", with_sales(f""", {_forest_sql("1")}
SELECT {_RF_FUTURE}, {_RF_BAND} FROM p JOIN {_RF_SD} USING (key) WHERE idx >= n"""))


@register("forecast_rf_metrics")
def forecast_rf_metrics(spark, d):
    return fc.forecast_rf(sales(spark, d), "order_date", "sales")[1]


oracle("forecast_rf_metrics", with_sales(f""", {_forest_sql("1")}
SELECT 'Random Forest' AS method, {_RF_QUALITY} FROM (SELECT *, AVG(value) OVER () AS ybar FROM p WHERE value IS NOT NULL)"""))


@register("forecast_rf_by_region")
def forecast_rf_by_region(spark, d):
    return fc.forecast_rf(sales(spark, d), "order_date", "sales", by=["region"])[0]


oracle("forecast_rf_by_region", with_sales(f""", {_forest_sql("region")}
SELECT key AS region, {_RF_FUTURE}, {_RF_BAND} FROM p JOIN {_RF_SD} USING (key) WHERE idx >= n"""))


@register("forecast_holdout_rf_by_product")
def forecast_holdout_rf_by_product(spark, d):
    """One small forest per product: as many series as there are products."""
    return fc.forecast_holdout_rf(sales(spark, d), "order_date", "sales", by=["product"])[0]


oracle("forecast_holdout_rf_by_product", with_sales(f""", {_forest_sql("product", _RF_HOLDOUT, 4)}
SELECT key AS product, CAST(ANY_VALUE(k) AS BIGINT) AS n_train, CAST(COUNT(*) AS BIGINT) AS n_test, ROUND(AVG(ABS(value - pred)), 2) AS mae,
       ROUND(1 - SUM((value - pred) * (value - pred)) / NULLIF(SUM((value - ybar) * (value - ybar)), 0), 4) AS r2
FROM (SELECT *, AVG(value) OVER (PARTITION BY key) AS ybar FROM p WHERE is_test) GROUP BY key"""))


@register("forecast_holdout_rf_future")
def forecast_holdout_rf_future(spark, d):
    return fc.forecast_holdout_rf(sales(spark, d), "order_date", "sales")[1]


oracle("forecast_holdout_rf_future", with_sales(f""", {_forest_sql("1", _RF_HOLDOUT, 4)}
SELECT {_RF_FUTURE} FROM p WHERE idx >= n"""))


_HO = """m AS (SELECT strftime(order_date, '%Y-%m') AS period, SUM(sales) AS value
           FROM sales WHERE order_date IS NOT NULL AND sales IS NOT NULL GROUP BY 1),
i AS (SELECT period, value, ROW_NUMBER() OVER (ORDER BY period) - 1 AS idx, COUNT(*) OVER () AS n FROM m),
s AS (SELECT *, idx >= n - CEIL(n * 0.2) AS is_test FROM i WHERE n >= 4),
f AS (SELECT regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a, COUNT(*) AS n_train
      FROM s WHERE NOT is_test),
t AS (SELECT s.value, a + b * idx AS p, AVG(s.value) OVER () AS tbar, n_train FROM s, f WHERE is_test)"""


@register("forecast_holdout")
def forecast_holdout(spark, d):
    return fc.forecast_holdout(sales(spark, d), "order_date", "sales")[0]


oracle("forecast_holdout", with_sales(f""", {_HO}
SELECT CAST(ANY_VALUE(n_train) AS BIGINT) AS n_train, CAST(COUNT(*) AS BIGINT) AS n_test,
       ROUND(AVG(ABS(value - p)), 2) AS mae,
       ROUND(1 - SUM((value - p) * (value - p)) / SUM((value - tbar) * (value - tbar)), 4) AS r2 FROM t"""))


@register("forecast_holdout_future")
def forecast_holdout_future(spark, d):
    return fc.forecast_holdout(sales(spark, d), "order_date", "sales")[1]


oracle("forecast_holdout_future", with_sales(f""", {_HO}
SELECT CAST(step AS BIGINT) AS step, 'Month +' || CAST(step AS VARCHAR) AS period,
       ROUND(a + b * ((SELECT MAX(idx) FROM s) + step), 2) AS forecast
FROM f, (SELECT UNNEST(range(1, 4)) AS step) x"""))


oracle("knn_neighbors", """
WITH p AS (SELECT CAST(c_acctbal AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y, COUNT(*) AS w
           FROM customer GROUP BY 1, 2),
d AS (SELECT a.x, a.y, SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist,
             b.w - CASE WHEN a.x = b.x AND a.y = b.y THEN 1 ELSE 0 END AS w FROM p a, p b),
r AS (SELECT x, y, dist, SUM(w) OVER (PARTITION BY x, y ORDER BY dist ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
             AS before FROM d WHERE w > 0)
SELECT x AS c_acctbal, CAST(y AS INTEGER) AS c_nationkey, ROUND(MAX(dist), 6) AS kdist, CAST(5 AS BIGINT) AS k
FROM r WHERE COALESCE(before, 0) < 5 GROUP BY x, y""")


_GRID_K = 5


@register("knn_grid")
def knn_grid(spark, d):
    """Exact neighbours on integer features, where many points share a projection."""
    li = table(spark, d, "lineitem")
    pts = knn.distinct_points(li.select(F.array(F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double")).alias("vec")), "vec")
    nn = knn.knn_search(pts.select(F.col("pid").alias("qid"), "vec"), pts.withColumn("w", F.lit(1).cast("long")), _GRID_K, 2, exclude_self=True)
    return nn.groupBy("qid").agg(F.round(F.max("dist"), 6).alias("kdist"), F.round(F.sum(F.col("dist") * F.col("c")), 6).alias("total")).select(
        F.col("qid")[0].cast("int").alias("l_linenumber"), F.col("qid")[1].alias("l_quantity"), "kdist", "total")


oracle("knn_grid", f"""
WITH p AS (SELECT DISTINCT CAST(l_linenumber AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS y FROM lineitem),
d AS (SELECT a.x, a.y, SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist,
             ROW_NUMBER() OVER (PARTITION BY a.x, a.y ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS r
      FROM p a, p b WHERE a.x <> b.x OR a.y <> b.y)
SELECT CAST(x AS INTEGER) AS l_linenumber, y AS l_quantity, ROUND(MAX(dist), 6) AS kdist, ROUND(SUM(dist), 6) AS total
FROM d WHERE r <= {_GRID_K} GROUP BY x, y""")


@register("chrono_split_rows")
def chrono_split_rows(spark, d):
    """The split row by row, on data with equal rows and without a time on some."""
    o = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 7 != 0, F.trunc("o_orderdate", "month")).cast("timestamp").alias("month"))
    return ml.chrono_split(o, "month").groupBy("priority", F.date_format("month", "yyyy-MM").alias("month"), "is_test").agg(
        F.count(F.lit(1)).cast("long").alias("rows"))


oracle("chrono_split_rows", """
WITH o AS (SELECT o_orderpriority AS priority, CASE WHEN o_orderkey % 7 <> 0 THEN DATE_TRUNC('month', o_orderdate) END AS month FROM orders),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY month NULLS FIRST, priority NULLS FIRST) AS place, COUNT(*) OVER () AS n FROM o)
SELECT priority, strftime(month, '%Y-%m') AS month, place > n - CEIL(n * 0.2) AS is_test, CAST(COUNT(*) AS BIGINT) AS rows
FROM r GROUP BY 1, 2, 3""")
