"""Keyword questions over a *table* of questions, and the answers they map to
(P5, P28, P29, D23, D30-D32, ``ask``).

The intent rules are a ``when`` cascade evaluated per question row, so a
question log of any size is classified in one narrow pass. Column matching
tests the data set's column names (a schema fact, known on the driver)
against every question with ``contains``.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import col, fixed
from tessera.functions.nulls import normalize_nulls
from tessera.functions.schema import categorical_cols, date_cols, numeric_cols
from tessera.operators import eda, forecast, groups, profile
from tessera.session import stage_input

# --- Fixed values: intent keyword cascades (order matters) -------------------
INTENTS_V2 = [
    ("overview", ["overview", "summary", "describe", "about"]),
    ("anomalies", ["anomal", "outlier", "unusual"]),
    ("top", ["top", "best", "highest", "most", "max"]),
    ("bottom", ["bottom", "worst", "lowest", "least", "min"]),
    ("total", ["total", "sum"]),
    ("average", ["average", "mean", "avg"]),
    ("trend", ["trend", "over time", "monthly", "growth"]),
    ("distribution", ["distribution", "histogram", "spread"]),
    ("correlation", ["correlation", "correlate", "relationship"]),
    ("compare", ["compare", "versus", "vs"]),
    ("charts", ["chart", "suggest", "visual", "plot"]),
    ("insights", ["insight", "recommendation"]),
]
DEFAULT_INTENT_V2 = "overview"
INTENTS_V1 = [
    ("overview", ["overview", "describe", "summary", "summarize", "about", "tell me about"]),
    ("anomalies", ["anomal", "outlier", "unusual", "abnormal"]),
    ("top", ["top", "best", "highest", "largest", "most", "maximum", "max"]),
    ("bottom", ["bottom", "worst", "lowest", "smallest", "least", "minimum", "min"]),
    ("total", ["total", "sum", "overall"]),
    ("average", ["average", "mean", "avg"]),
    ("trend", ["trend", "over time", "monthly", "growth", "timeline"]),
    ("distribution", ["distribution", "spread", "histogram"]),
    ("correlation", ["correlation", "correlate", "relationship", "related"]),
    ("compare", ["compare", "comparison", "versus", "vs", "difference"]),
    ("count", ["count", "how many", "number of"]),
    ("charts", ["chart", "suggest", "visualiz", "plot", "graph"]),
]
DEFAULT_INTENT_V1 = "general"
DEFAULT_TOP_N = 5
MAX_TOP_N = 20
INSIGHT_SALES_WORDS = ["sales", "revenue"]
INSIGHT_PROFIT_WORDS = ["profit"]
INSIGHT_SALES_WORDS_V1 = ["sales", "revenue", "amount", "total"]
INSIGHT_PROFIT_WORDS_V1 = ["profit", "margin"]
# --- end of fixed values ---------------------------------------------------


def _any_contains(text: Column, words: list[str]) -> Column:
    c = None
    for w in words:
        h = text.contains(w)
        c = h if c is None else (c | h)
    return c


def intent_expr(q: Column, version: int = 2) -> Column:
    """Ordered keyword cascade over the lower-cased question."""
    low = F.lower(q)
    rules, default = (INTENTS_V2, DEFAULT_INTENT_V2) if version == 2 else (INTENTS_V1, DEFAULT_INTENT_V1)
    e = F.lit(default)
    for name, words in reversed(rules):
        e = F.when(_any_contains(low, words), F.lit(name)).otherwise(e)
    return e


def topn_expr(q: Column) -> Column:
    """First integer in the question, default 5, capped at 20."""
    digits = F.regexp_extract(q, r"\d+", 0)
    v = digits.try_cast("decimal(38,0)")
    return F.least(F.coalesce(v, F.lit(DEFAULT_TOP_N)), F.lit(MAX_TOP_N)).cast("long")


def _col_words(name: str) -> list[str]:
    return [w for w in name.lower().replace("_", " ").split() if len(w) > 2]


def match_column_expr(q: Column, cols: list[str], version: int = 2) -> Column:
    """Column named in the question (NULL if none).

    v2: per column in order, its full name or any of its words (> 2 chars).
    v1: all full names first, then words.
    """
    low = F.lower(q)
    e = F.lit(None).cast("string")
    if version == 2:
        for c in reversed(cols):
            hit = _any_contains(low, [c.lower()] + _col_words(c))
            e = F.when(hit, F.lit(c)).otherwise(e)
        return e
    for c in reversed(cols):
        words = _col_words(c)
        if words:
            e = F.when(_any_contains(low, words), F.lit(c)).otherwise(e)
    for c in reversed(cols):
        e = F.when(low.contains(c.lower()), F.lit(c)).otherwise(e)
    return e


def classify_questions(questions: DataFrame, text_col: str, data: DataFrame, version: int = 2) -> DataFrame:
    """Per question: intent, top-n and the numeric / text columns of ``data``
    it names (NULL when none is named)."""
    q = col(text_col)
    return questions.select(
        "*", intent_expr(q, version).alias("intent"), topn_expr(q).alias("top_n"),
        match_column_expr(q, numeric_cols(data), version).alias("numeric_column"),
        match_column_expr(q, categorical_cols(data), version).alias("text_column"))


# ------------------------------------------------------------------ answers
def overview(df: DataFrame) -> DataFrame:
    """rows, columns, numeric / text column counts, missing cells, duplicates."""
    nums, cats = numeric_cols(df), categorical_cols(df)
    miss = profile.null_counts(df).agg(F.sum("missing").cast("long").alias("missing_values"))
    dup = profile.duplicate_count(df)
    return dup.crossJoin(miss).select(
        F.col("rows"), F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(len(nums)).cast("long").alias("numeric_columns"), F.lit(len(cats)).cast("long").alias("text_columns"),
        "missing_values", "duplicate_rows")


def overview_numeric(df: DataFrame, max_cols: int | None = None) -> DataFrame:
    """sum / mean / min / max (2 dp) of all numeric columns, or the first ``max_cols``."""
    from tessera.functions.exprs import stack_rows
    nums = numeric_cols(df)[:max_cols]
    d = normalize_nulls(df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(nums)]))
    aggs = []
    for i, _ in enumerate(nums):
        c = F.col(f"c{i}")
        aggs += [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s{i}"), F.avg(c).alias(f"m{i}"),
                 F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    wide = d.agg(*aggs)
    rows = [(c, {"total": F.round(F.col(f"s{i}"), 2), "mean": F.round(F.col(f"m{i}"), 2),
                 "min": F.round(F.col(f"lo{i}"), 2), "max": F.round(F.col(f"hi{i}"), 2)})
            for i, c in enumerate(nums)]
    return stack_rows(wide, rows)


def suggested_bar_data(df: DataFrame, n: int = 8) -> DataFrame:
    """Bar data: the first text column's top-n sums of the first numeric column."""
    cats, nums = categorical_cols(df), numeric_cols(df)
    if not (cats and nums):
        return df.sparkSession.createDataFrame([], "category string, value double")
    t = groups.top_n(df, cats[0], nums[0], n)
    return t.select(col(cats[0]).cast("string").alias("category"), "value")


def suggested_charts(df: DataFrame) -> DataFrame:
    """Which charts fit the column classes: (rank, chart, x, y)."""
    cats, nums, dates = categorical_cols(df), numeric_cols(df), date_cols(df)
    rows = []
    if cats and nums:
        rows.append((1, "Bar Chart", cats[0], nums[0]))
    if len(nums) >= 2:
        rows.append((2, "Scatter", nums[0], nums[1]))
    if dates:
        rows.append((3, "Line", dates[0], nums[0] if nums else None))
    if nums:
        rows.append((4, "Histogram", nums[0], None))
    if len(nums) >= 3:
        rows.append((5, "Heatmap", None, None))
    return df.sparkSession.createDataFrame(rows, "rank int, chart string, x string, y string")


def chart_data(df: DataFrame, bars: int = 8, bins: int = 30) -> DataFrame:
    """The data of every chart that ``suggested_charts`` names, from all rows:
    (rank, chart, x, y, value). Bars are the ``bars`` largest sums, the scatter
    chart counts rows on a grid of ``bins`` by ``bins``, the line is the sum per
    month, the histogram counts rows per bin, the heatmap has a correlation per pair."""
    text = lambda e: e.cast("string")
    no_y = F.lit(None).cast("string")
    nums = numeric_cols(df)
    needed = {*categorical_cols(df)[:1], *date_cols(df)[:1], *nums}
    df = stage_input(df.select(*[col(c) for c in df.columns if c in needed]), "charts")
    parts = []
    for r in suggested_charts(df).collect():  # at most five rows, from the schema alone
        if r["chart"] == "Bar Chart":
            d = suggested_bar_data(df, bars).select(F.col("category").alias("x"), no_y.alias("y"), "value")
        elif r["chart"] == "Scatter":
            d = groups.scatter_bins(df, r["x"], r["y"], bins=bins).select(text(F.col("x_bin")), text(F.col("y_bin")), F.col("count").cast("double"))
        elif r["chart"] == "Line":
            if r["y"] is None:
                continue  # dates alone have no values to draw
            d = forecast.monthly_totals(df, r["x"], r["y"]).select("period", no_y, F.round("value", 2))
        elif r["chart"] == "Histogram":
            d = eda.histogram(df, r["x"], bins).select(text(F.col("bin")), no_y, F.col("count").cast("double"))
        else:
            d = eda.corr_matrix(df, nums)
        parts.append(d.select(F.lit(r["rank"]).alias("rank"), F.lit(r["chart"]).alias("chart"), *d.columns).toDF("rank", "chart", "x", "y", "value"))
    if not parts:
        return df.sparkSession.createDataFrame([], "rank int, chart string, x string, y string, value double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def business_insights(df: DataFrame) -> DataFrame:
    """Per sales-like numeric column: total, mean and the top value of the
    first text column; per profit-like column: count of negative rows.
    Columns: ord, column_name, kind, value, label."""
    nums, cats = numeric_cols(df), categorical_cols(df)
    parts = []
    d = normalize_nulls(df)
    for i, c in enumerate(nums):
        low = c.lower()
        if any(w in low for w in INSIGHT_SALES_WORDS):
            a = d.agg(F.coalesce(F.sum(col(c)), F.lit(0.0)).alias("t"), F.avg(col(c)).alias("m"))
            parts.append(a.select(F.lit(i * 10 + 1).cast("long").alias("ord"), F.lit(c).alias("column_name"),
                                  F.lit("total").alias("kind"), F.round("t", 2).alias("value"),
                                  F.lit(None).cast("string").alias("label")))
            parts.append(a.select(F.lit(i * 10 + 2).cast("long"), F.lit(c), F.lit("mean"), F.round("m", 2),
                                  F.lit(None).cast("string")))
            if cats:
                b = groups.best_by(df, cats[0], c)
                parts.append(b.select(F.lit(i * 10 + 3).cast("long"), F.lit(c), F.lit(f"top {cats[0]}"),
                                      F.lit(None).cast("double"), F.col("best")))
        if any(w in low for w in INSIGHT_PROFIT_WORDS):
            a = d.agg(F.count_if(col(c) < 0).alias("neg"))
            parts.append(a.where(F.col("neg") > 0).select(
                F.lit(i * 10 + 4).cast("long"), F.lit(c), F.lit("negative rows"), F.col("neg").cast("double"),
                F.lit(None).cast("string")))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "ord long, column_name string, kind string, value double, label string")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def business_insights_v1(df: DataFrame, max_text: int | None = None, max_numeric: int | None = None, k: int = 5) -> DataFrame:
    """The older rules, one row per finding: (kind, column_name, label, value).

    Totals and means of sales-like columns, totals and negative rows of
    profit-like ones, the best value of each text column by each numeric one (all
    of them, or the first ``max_text`` and ``max_numeric``), and the ``k`` most
    frequent values of the first text column with their share of all rows in %.
    """
    nums, cats = numeric_cols(df), categorical_cols(df)
    df = stage_input(df.select(*[col(c) for c in nums + cats]), "insights")
    d = normalize_nulls(df)
    facts = []
    for i, c in enumerate(nums):
        x, low = col(c).cast("double"), c.lower()
        total = (F.lit("total"), c, F.round(F.coalesce(F.sum(x), F.lit(0.0)), 2))
        if any(w in low for w in INSIGHT_SALES_WORDS_V1):
            facts += [total, (F.lit("mean"), c, F.round(F.avg(x), 2))]
        if any(w in low for w in INSIGHT_PROFIT_WORDS_V1):
            facts += [(F.lit("profit total"), c, total[2]), (F.lit("negative rows"), c, F.nullif(F.count_if(x < 0), F.lit(0)).cast("double"))]
    no_label = F.lit(None).cast("string").alias("label")
    parts = []
    if facts:  # one pass for all of them
        one = d.agg(*[v.alias(f"v{i}") for i, (_, _, v) in enumerate(facts)])
        rows = F.explode(F.array(*[F.struct(k.alias("kind"), F.lit(c).alias("column_name"), no_label, F.col(f"v{i}").cast("double").alias("value"))
                                   for i, (k, c, _) in enumerate(facts)])).alias("r")
        parts.append(one.select(rows).select("r.*").where("kind <> 'negative rows' OR value IS NOT NULL"))
    picked = nums[:max_numeric]
    for cat in cats[:max_text] if picked else []:  # one grouping per text column, for all numeric ones
        sums = d.where(col(cat).isNotNull()).groupBy(col(cat).cast("string").alias("k")).agg(
            *[F.coalesce(F.sum(col(c).cast("double")), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(picked)])
        best = sums.agg(*[F.min(F.struct((-F.col(f"s{i}")).alias("v"), "k")).alias(f"b{i}") for i in range(len(picked))])
        rows = [F.struct(F.lit(f"top {cat}").alias("kind"), F.lit(c).alias("column_name"), F.col(f"b{i}.k").alias("label"), F.round(-F.col(f"b{i}.v"), 2).alias("value"))
                for i, c in enumerate(picked)]
        parts.append(best.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where(F.col("label").isNotNull()))
    if cats:
        share = groups.value_counts(df, cats[0], k)
        parts.append(share.select(F.lit("share").alias("kind"), F.lit(cats[0]).alias("column_name"), F.col("value").alias("label"), F.round("pct", 1).alias("value")))
    if not parts:
        return df.sparkSession.createDataFrame([], "kind string, column_name string, label string, value double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overview_text(df: DataFrame, k: int = 3) -> DataFrame:
    """Distinct count and the k most frequent values of every text column:
    (column_name, unique, rank, value, count)."""
    return eda.categorical_summary(df, k=k).select("column_name", "unique", "rank", "value", "count")


def find_column(df: DataFrame, name: str) -> str | None:
    """A column by its name, else the first that contains it (letter case aside)."""
    if name in df.columns:
        return name
    return next((c for c in df.columns if name.lower() in c.lower()), None)


def column_stats(df: DataFrame, name: str) -> DataFrame:
    """Statistics of the column that ``name`` means: numeric or text."""
    c = find_column(df, name)
    if c is None:
        raise ValueError(f"no column is called {name!r}; there are {', '.join(df.columns)}")
    return groups.numeric_summary(df, c) if c in numeric_cols(df) else groups.categorical_answer(df, c)


def dataset_context(df: DataFrame, k: int = 5, sample_rows: int = 3) -> DataFrame:
    """Compact summary rows (section, name, value): shape, numeric summaries,
    top values of text columns and a few sample rows (ordered by all columns;
    doubles to four digits)."""
    ov = overview(df)
    shape = ov.select(F.explode(F.array(
        F.struct(F.lit("shape").alias("section"), F.lit("rows").alias("name"), F.col("rows").cast("string").alias("value")),
        F.struct(F.lit("shape").alias("section"), F.lit("columns").alias("name"),
                 F.col("columns").cast("string").alias("value")))).alias("s")).select("s.*")
    nums = overview_numeric(df).select(
        F.lit("numeric").alias("section"), "column_name",
        F.format_string("sum=%s, mean=%s, min=%s, max=%s", *[fixed(F.col(c), 2) for c in ("total", "mean", "min", "max")])
    ).toDF("section", "name", "value")
    cats = categorical_cols(df)
    if cats:
        tops = profile.top_values_text(df, cats, k).select(F.lit("top_values").alias("section"),
                                                            F.col("column_name").alias("name"),
                                                            F.col("top_values").alias("value"))
    else:
        tops = df.sparkSession.createDataFrame([], "section string, name string, value string")
    sample = groups.preview(df, sample_rows).select(
        F.lit("sample").alias("section"), F.lit("row").alias("name"),
        F.to_json(F.struct(*[F.round(col(c), 4).alias(c) if t == "double" else col(c) for c, t in df.dtypes])).alias("value"))
    return shape.unionByName(nums).unionByName(tops).unionByName(sample)


def ask(df: DataFrame, question: str, version: int = 2) -> DataFrame:
    """Driver-side dispatch of ONE question to the operator it names; the
    answer is computed on Spark. (The same rules over a question table are
    ``classify_questions``.) ``version`` 1 knows counts too, and answers what it
    does not know with the statistics of a column that the question names."""
    q = question.lower()
    spark = df.sparkSession
    row = spark.createDataFrame([(q,)], "q string").select(
        intent_expr(F.col("q"), version).alias("intent"), topn_expr(F.col("q")).alias("n"),
        match_column_expr(F.col("q"), numeric_cols(df), version).alias("num"),
        match_column_expr(F.col("q"), categorical_cols(df), version).alias("cat")).first()
    nums, cats, dates = numeric_cols(df), categorical_cols(df), date_cols(df)
    num = row["num"] or (nums[0] if nums else None)
    cat = row["cat"] or (cats[0] if cats else None)
    intent = row["intent"]
    if intent == "anomalies":
        return eda.iqr_bounds(df, nums)
    if intent in ("top", "bottom") and num and cat:
        return (groups.top_n if intent == "top" else groups.bottom_n)(df, cat, num, row["n"])
    if intent == "total" and num:
        return groups.totals(df, num)
    if intent == "average" and num:
        return groups.average_by(df, num, row["cat"]) if row["cat"] else groups.average(df, num)
    if intent == "trend" and dates and num:
        return forecast.monthly_totals(df, dates[0], num)
    if intent == "distribution" and num:
        return eda.histogram(df, num)
    if intent == "correlation" and len(nums) >= 2:
        return eda.corr_matrix(df, nums, 3)
    if intent == "compare" and num and cat:
        return groups.compare(df, cat, num)
    if intent == "charts":
        return suggested_charts(df)
    if intent == "insights":
        return business_insights(df)
    if intent == "count":
        return groups.value_counts(df, cat) if cat else df.agg(F.count(F.lit(1)).cast("long").alias("rows"))
    if intent == "general" and (row["num"] or row["cat"]):
        return column_stats(df, row["num"] or row["cat"])
    return overview(df)


