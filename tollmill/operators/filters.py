"""Filters with optional arguments, closed and half-open time ranges, and guarded queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollmill.functions import constants as K


def where_opt(df: DataFrame, **eq) -> DataFrame:
    """Equality filters for the arguments that are given; None and '' mean no filter."""
    for name, value in eq.items():
        if value is not None and value != "":
            df = df.filter(F.col(name) == F.lit(value))
    return df


def _moment(df: DataFrame, col: str, value) -> Column:
    return F.lit(value).cast(df.schema[col].dataType)


def between_closed(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """``start <= col <= end``. A bare date means midnight, so the day of ``end`` itself is not included."""
    if start:
        df = df.filter(F.col(col) >= _moment(df, col, start))
    if end:
        df = df.filter(F.col(col) <= _moment(df, col, end))
    return df


def between_half_open(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    if start:
        df = df.filter(F.col(col) >= _moment(df, col, start))
    if end:
        df = df.filter(F.col(col) < _moment(df, col, end))
    return df


def scoped(df: DataFrame, ts: str, section_id=None, start=None, end=None) -> DataFrame:
    """The three filters every report takes."""
    return between_closed(where_opt(df, section_id=section_id), ts, start, end)


def truck(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).isin(*K.TRUCK_CODES)


def trucks_only(df: DataFrame, col: str) -> DataFrame:
    return df.filter(truck(col))


def usable_numeric(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose texts are neither NULL, nor empty, nor exactly '0' ('0.0' is usable)."""
    for c in cols:
        df = df.filter(F.col(c).isNotNull() & (F.col(c) != "") & (F.col(c) != "0"))
    return df


def non_blank(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & (c != "")


def contains(df: DataFrame, col: str, text: str) -> DataFrame:
    return df.filter(F.col(col).contains(text))


def text_is_true(c: Column) -> Column:
    return F.lower(c) == "true"


def either_key(df: DataFrame, a: str, b: str, value) -> DataFrame:
    """Rows that name the value in one of two key columns."""
    return df.filter((F.col(a) == F.lit(value)) | (F.col(b) == F.lit(value)))


def audit_scope(df: DataFrame, path: str = "api_endpoint", method: str = "http_method") -> DataFrame:
    """Calls that are audited: API paths outside the excluded ones, no OPTIONS calls."""
    keep = F.col(path).startswith(K.API_PREFIX) & ~F.col(path).isin(*K.UNAUDITED_PATHS)
    for prefix in K.UNAUDITED_PREFIXES:
        keep = keep & ~F.col(path).startswith(prefix)
    if method in df.columns:
        keep = keep & (F.coalesce(F.col(method), F.lit("")) != "OPTIONS")
    return df.filter(keep)


def _has_word(sql: str, word: str) -> bool:
    return re.search(rf"\b{word}\b", sql, re.IGNORECASE) is not None


def check_select(sql: str) -> None:
    """Raises ValueError unless the text is a plain SELECT. Words are matched whole, so created_at is fine."""
    if not re.match(r"\s*SELECT\b", sql, re.IGNORECASE):
        raise ValueError("only SELECT queries are allowed")
    for word in K.BANNED_SQL_WORDS:
        if _has_word(sql, word):
            raise ValueError(f"query contains the banned word {word}")


def safe_select(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """Runs a guarded ad-hoc query over the session's views; ``limit``, if given, applies where the query has none."""
    check_select(sql)
    out = spark.sql(sql.rstrip().rstrip(";"))
    return out if limit is None or _has_word(sql, "LIMIT") else out.limit(limit)
