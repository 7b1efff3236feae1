"""Report bundle (S15): the multi-sheet report as one output folder per
sheet (Parquet, or CSV when asked), written by Spark in parallel.

Sheets: raw data, statistics (describe), correlations (>= 2 numeric
columns), the first text column's sum / mean / count of the first numeric
column, and — from the older report — the value counts of every text column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.longform import value_counts_long
from tessera.functions.schema import categorical_cols, numeric_cols
from tessera.operators import eda, groups, profile
from tessera.session import stage_input


def report_sheets(df: DataFrame, only: list[str] | None = None) -> dict[str, DataFrame]:
    """Sheet name -> its rows, for all sheets or those in ``only``; nothing runs until a sheet is read."""
    nums, cats = numeric_cols(df), categorical_cols(df)
    made = {"raw_data": lambda: df, "statistics": lambda: profile.describe_numeric(df)}
    if len(nums) >= 2:
        made["correlations"] = lambda: eda.corr_matrix(df, nums)
    if cats and nums:
        made["category_summary"] = lambda: groups.compare(df, cats[0], nums[0])
    if cats:
        made["category_counts"] = lambda: value_counts_long(df, cats).select("column_name", "value", F.col("count").cast("long"))
    return {name: sheet() for name, sheet in made.items() if only is None or name in only}


def report_bundle(df: DataFrame, path: str, fmt: str = "parquet", only: list[str] | None = None) -> dict[str, str]:
    """Write every sheet, or those in ``only``, under ``path/<sheet>``; returns {sheet: path}."""
    out = {}
    df = stage_input(df, "report")  # every sheet reads the same input
    for name, sheet in report_sheets(df, only).items():
        p = f"{path.rstrip('/')}/{name}"
        w = sheet.write.mode("overwrite")
        (w.option("header", True).csv(p) if fmt == "csv" else w.parquet(p))
        out[name] = p
    return out
