"""Automatically detected business KPIs.

Columns are found by name (keyword-major search, see ``find_col``). Each KPI
family is a small number of aggregates over the whole table; the result is a
tidy frame (ord, name, value, formatted, category, context). A KPI whose
columns are missing is simply absent, as in the analysed application.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import col, fixed, month_str, signed_fixed, thousands
from tessera.functions.nulls import normalize_nulls
from tessera.functions.schema import find_col
from tessera.operators.clean import time_col
from tessera.session import materialize

# --- Fixed values: KPI display currency sign ---------------------------------
CURRENCY = "₹"
# --- end of fixed values ---------------------------------------------------

SCHEMA = "ord long, name string, value double, formatted string, category string, context string"


def detect(df: DataFrame) -> dict[str, str | None]:
    return {
        "sales": find_col(df, "sales", numeric=True), "profit": find_col(df, "profit", numeric=True),
        "quantity": find_col(df, "quantity", numeric=True), "customer": find_col(df, "customer"),
        "date": find_col(df, "date"), "category": find_col(df, "category"),
        "product": find_col(df, "product"), "region": find_col(df, "region"),
    }


def _row(ord_: int, name: str, value, formatted, category: str, context=None):
    return F.struct(F.lit(ord_).cast("long").alias("ord"), F.lit(name).alias("name"),
                    F.round(value.cast("double"), 4).alias("value"), formatted.alias("formatted"),
                    F.lit(category).alias("category"),
                    (context if context is not None else F.lit("")).alias("context"))


def _rows(one_row: DataFrame, entries: list) -> DataFrame:
    """entries: [(condition Column or None, struct Column)] -> tidy rows."""
    arr = F.array(*[F.when(cond, s) if cond is not None else s for cond, s in entries])
    return (one_row.select(F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("_k"))
            .select("_k.*"))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def _num(df: DataFrame, c: str):
    return col(c).cast("double")


_KEYS = ("product", "region", "category", "customer", "month")


def _summary(df: DataFrame, cols: dict, *keys: str) -> DataFrame:
    """One pass over the table: a row of totals (``_role`` is "all"; none if there is
    no row) and, by grouping sets, a row per value of each key. Sums are partial in
    every task, so a value of a third of all rows is a row per task."""
    number = lambda role: _num(df, cols[role]) if cols[role] else F.lit(None).cast("double")
    key = lambda k: month_str(time_col(df, cols["date"])) if k == "month" else col(cols[k])
    d = normalize_nulls(df.select(*[number(r).alias(f"_{r}") for r in ("sales", "profit", "quantity")], *[key(k).alias(k) for k in keys]))
    zero = F.lit(0.0)
    sums = [F.coalesce(F.sum("_sales"), zero).alias("_tot"), F.avg("_sales").alias("_avg"), F.coalesce(F.sum("_quantity"), zero).alias("_qty"),
            F.coalesce(F.sum("_profit"), zero).alias("_p"), F.count_if(F.col("_profit") < 0).alias("_neg"), F.count(F.lit(1)).alias("_n")]
    if not keys:
        return d.agg(*sums).withColumn("_role", F.lit("all"))
    g = d.groupingSets([*[[F.col(k)] for k in keys], []], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_gid"), *sums)
    every = (1 << len(keys)) - 1  # a key that is grouped by has its bit at 0, the first key the highest bit
    role = F.lit("all")
    for i, k in enumerate(keys):
        role = F.when(F.col("_gid") == every - (1 << (len(keys) - 1 - i)), k).otherwise(role)
    return g.withColumn("_role", role).drop("_gid")


def _totals(g: DataFrame) -> DataFrame:
    """The totals of a summary as one row, and ``_u``, its number of customers."""
    whole = lambda c: F.max(F.when(F.col("_role") == "all", F.col(c)))
    zero = lambda c, z: F.coalesce(whole(c), F.lit(z)).alias(c)
    u = F.count_if((F.col("_role") == "customer") & F.col("customer").isNotNull()) if "customer" in g.columns else F.lit(0)
    return g.agg(zero("_tot", 0.0), whole("_avg").alias("_avg"), zero("_qty", 0.0), zero("_p", 0.0), zero("_neg", 0), zero("_n", 0), u.alias("_u"))


def _money(x):
    return F.concat(F.lit(CURRENCY), thousands(x))


def _revenue(cols: dict) -> list:
    if not cols["sales"]:
        return []
    tot, avg, rpu = F.col("_tot"), F.col("_avg"), F.when(F.col("_qty") > 0, F.col("_tot") / F.col("_qty")).otherwise(F.lit(0.0))
    entries = [(None, _row(1, "Total Revenue", tot, _money(tot), "revenue")), (None, _row(2, "Average Order Value", avg, _money(avg), "revenue"))]
    return entries + ([(None, _row(3, "Revenue Per Unit", rpu, _money(rpu), "revenue"))] if cols["quantity"] else [])


def _profit(cols: dict) -> list:
    if not cols["profit"]:
        return []
    tp, neg = F.col("_p"), F.col("_neg")
    entries = [(None, _row(4, "Total Profit", tp, _money(tp), "profit"))]
    if cols["sales"]:
        margin = tp / F.col("_tot") * 100
        entries.append((F.col("_tot") > 0, _row(5, "Profit Margin", margin, F.concat(fixed(margin, 1), F.lit("%")), "profit")))
    share = F.concat(fixed(neg * 100.0 / F.col("_n"), 1), F.lit("% of transactions"))
    return entries + [(neg > 0, _row(6, "Loss Transactions", neg, neg.cast("string"), "profit", share))]


def _volume(cols: dict) -> list:
    return [(None, _row(7, "Total Quantity", F.col("_qty"), thousands(F.col("_qty")), "volume"))] if cols["quantity"] else []


def _customer(cols: dict) -> list:
    if not cols["customer"]:
        return []
    u, spend = F.col("_u"), F.when(F.col("_u") > 0, F.col("_tot") / F.col("_u")).otherwise(F.lit(0.0))
    entries = [(None, _row(8, "Unique Customers", u, thousands(u), "customer"))]
    return entries + ([(None, _row(9, "Avg Spend/Customer", spend, _money(spend), "customer"))] if cols["sales"] else [])


def _told(df: DataFrame, family, *keys: str) -> DataFrame:
    cols = detect(df)
    entries = family(cols)
    return _rows(_totals(_summary(df, cols, *keys)), entries) if entries else _empty(df.sparkSession)


def kpi_revenue(df: DataFrame) -> DataFrame:
    return _told(df, _revenue)


def kpi_profit(df: DataFrame) -> DataFrame:
    return _told(df, _profit)


def kpi_volume(df: DataFrame) -> DataFrame:
    return _told(df, _volume)


def kpi_customer(df: DataFrame) -> DataFrame:
    return _told(df, _customer, "customer")


_LEADERS = ((10, "product", "Top Product"), (11, "region", "Top Region"), (12, "category", "Top Category"))


def _leaders(g: DataFrame, roles: list[str]) -> DataFrame:
    out = _empty(g.sparkSession)
    for ord_, role, name in _LEADERS:
        if role in roles:
            best = g.where((F.col("_role") == role) & F.col(role).isNotNull()).orderBy(F.col("_tot").desc(), role).limit(1)
            label = best.select(F.col(role).cast("string").alias("_k"))
            out = out.unionByName(_rows(label, [(None, _row(ord_, name, F.lit(0.0), F.col("_k"), "performance"))]))
    return out


def kpi_top_performers(df: DataFrame) -> DataFrame:
    cols = detect(df)
    roles = [role for _, role, _ in _LEADERS if cols[role]] if cols["sales"] else []
    return _leaders(materialize(_summary(df, cols, *roles), "kpi"), roles) if roles else _empty(df.sparkSession)


def monthly_sums(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    d = normalize_nulls(df.select(time_col(df, date_col).alias("_d"), _num(df, value_col).alias("_v")))
    return (d.where(F.col("_d").isNotNull()).groupBy(month_str(F.col("_d")).alias("period"))
            .agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value")))


def mom_growth(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """Last vs previous present month: (last_period, last, previous, growth_pct);
    growth only when there are two months and the previous one is > 0."""
    m = monthly_sums(df, date_col, value_col)
    last2 = m.orderBy(F.col("period").desc()).limit(2)
    a = last2.agg(F.max("period").alias("last_period"),
                  F.max_by("value", "period").alias("_last"), F.min_by("value", "period").alias("_prev"),
                  F.count(F.lit(1)).alias("_n"))
    g = F.when((F.col("_n") >= 2) & (F.col("_prev") > 0),
               (F.col("_last") - F.col("_prev")) / F.col("_prev") * 100)
    return a.select("last_period", F.round("_last", 2).alias("last_value"),
                    F.round(F.when(F.col("_n") >= 2, F.col("_prev")), 2).alias("previous_value"),
                    F.round(g, 4).alias("growth_pct"))


def _time(m: DataFrame) -> DataFrame:
    """Growth and best month of (period, value)."""
    last2 = m.orderBy(F.col("period").desc()).limit(2).agg(
        F.max_by("value", "period").alias("_last"), F.min_by("value", "period").alias("_prev"),
        F.count(F.lit(1)).alias("_n"))
    best = m.orderBy(F.col("value").desc(), F.col("period")).limit(1).select(
        F.col("period").alias("_bp"), F.col("value").alias("_bv"))
    a = last2.crossJoin(best)
    growth = (F.col("_last") - F.col("_prev")) / F.col("_prev") * 100
    entries = [((F.col("_n") >= 2) & (F.col("_prev") > 0),
                _row(13, "MoM Growth", growth, F.concat(signed_fixed(growth, 1), F.lit("%")), "time")),
               (None, _row(14, "Best Month", F.col("_bv"), F.col("_bp"), "time"))]
    return _rows(a, entries)


def kpi_time(df: DataFrame) -> DataFrame:
    cols = detect(df)
    if not (cols["date"] and cols["sales"]):
        return _empty(df.sparkSession)
    return _time(monthly_sums(df, cols["date"], cols["sales"]))


def kpi_dashboard(df: DataFrame) -> DataFrame:
    """All families from one pass over the input, whose summary (a row per key value) is written once."""
    cols = detect(df)
    leaders = [role for _, role, _ in _LEADERS if cols[role]] if cols["sales"] else []
    keys = leaders + (["customer"] if cols["customer"] else []) + (["month"] if cols["date"] and cols["sales"] else [])
    entries = [e for family in (_revenue, _profit, _volume, _customer) for e in family(cols)]
    g = materialize(_summary(df, cols, *keys), "kpi")
    out = _rows(_totals(g), entries) if entries else _empty(df.sparkSession)
    out = out.unionByName(_leaders(g, leaders))
    if "month" in keys:
        months = g.where((F.col("_role") == "month") & F.col("month").isNotNull())
        out = out.unionByName(_time(months.select(F.col("month").alias("period"), F.col("_tot").alias("value"))))
    return out


def loss_transactions(df: DataFrame, c: str) -> DataFrame:
    """Count and share (% of all rows, 2 dp) of negative values."""
    d = normalize_nulls(df.select(_num(df, c).alias("_v")))
    return d.agg(F.count_if(F.col("_v") < 0).cast("long").alias("loss_count"),
                 F.round(F.try_divide(F.count_if(F.col("_v") < 0) * 100.0, F.count(F.lit(1))), 2).alias("loss_pct"))
