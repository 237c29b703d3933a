"""Masking, truncation and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tollmill.functions import constants as K
from tollmill.functions.cleaning import clock_text


def mask_id(c: Column) -> Column:
    """First and last character with stars between; ids under three characters hide completely."""
    n = F.length(c)
    masked = F.concat(F.left(c, F.lit(1)), F.repeat(F.lit("*"), n - 2), F.right(c, F.lit(1)))
    return F.when(c.isNull() | (n < 3), "***").otherwise(masked)


def mask_key(c: Column) -> Column:
    """An API key as a user label that shows its first eight characters."""
    return F.concat(F.lit("api_key:"), F.left(c, F.lit(8)), F.lit("..."))


def truncate_text(c: Column, limit: int, marker: str = "...[TRUNCATED]", keep: int | None = None) -> Column:
    """Texts longer than ``limit`` are cut to ``keep`` characters (``limit`` by default) plus a marker."""
    kept = F.left(c, F.lit(limit if keep is None else keep))
    return F.when(F.length(c) > limit, F.concat(kept, F.lit(marker))).otherwise(c)


_RESPONSE = "success boolean, count bigint, total bigint, execution_type string, error string"


def response_summary(body: Column) -> Column:
    """Struct of the summary fields of a JSON response; ``data_count`` only where data is a list."""
    doc = F.from_json(body, _RESPONSE)
    items = F.from_json(F.get_json_object(body, "$.data"), "array<string>")
    is_list = F.ltrim(F.get_json_object(body, "$.data")).startswith("[")
    error = F.when(~doc["error"].isin("", "false", "0", "null"), F.left(doc["error"], F.lit(200)))
    return F.struct(
        doc["success"].alias("success"),
        doc["count"].alias("count"),
        doc["total"].alias("total"),
        doc["execution_type"].alias("execution_type"),
        F.when(is_list, F.size(items)).cast("bigint").alias("data_count"),
        error.alias("error"),
    )


def response_summary_json(body: Column) -> Column:
    return F.to_json(response_summary(body), {"ignoreNullFields": "false"})


def decode_json(c: Column) -> Column:
    """Parsed JSON as a VARIANT; text that is no JSON comes back as ``{"_raw": text}``."""
    raw = F.parse_json(F.to_json(F.struct(c.alias("_raw"))))
    return F.when(c.isNull(), F.lit(None)).otherwise(F.coalesce(F.try_parse_json(c), raw))


def operation_type(path: Column) -> Column:
    """Kind of an audited call, by the first path part that matches."""
    out = None
    for part, label in K.OPERATION_TYPES:
        cond = F.contains(path, F.lit(part))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(K.DEFAULT_OPERATION_TYPE)


def is_success(status: Column) -> Column:
    return status.between(200, 399)


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def composite_id(prefix, ts: Column, number: Column, width: int) -> Column:
    """Id made of a prefix, a time stamp and a zero-padded number."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.translate(clock_text(ts), "-: ", ""), F.lpad(number.cast("string"), width, "0"))


def row_json(*columns: str) -> Column:
    """A whole row, or the named columns, as one JSON document."""
    return F.to_json(F.struct(*(columns or ("*",))), {"ignoreNullFields": "false"})
