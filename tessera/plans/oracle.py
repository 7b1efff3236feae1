"""DuckDB oracle SQL per registered query key.

The SQL is written independently of the Spark code and runs on the same
parquet tables (pre-registered as views named after the tables). Keys
without an entry here get a rows-only check.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def oracle(key: str, sql: str) -> None:
    if key in ORACLE:
        raise ValueError(f"duplicate oracle key {key}")
    ORACLE[key] = sql
