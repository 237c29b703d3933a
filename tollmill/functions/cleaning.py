"""Turning loose text into typed values without ever failing a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollmill.functions import constants as K

# Java parses "12d", "0x1p3" and "Infinity" as numbers; only plain decimal notation counts
# here. Digits, signs, the point and the exponent are all a plain number is made of.
_PLAIN = "+-.0123456789eE"
_ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"


def _text(c: Column) -> Column:
    return F.trim(c.cast("string"))


def as_number(c: Column) -> Column:
    """The text as a double, NULL when it is no plain number."""
    t = _text(c)
    rest = F.translate(t, _PLAIN, "")
    return F.when(rest == "", t.try_cast("double"))


def as_whole(c: Column) -> Column:
    """The text as a bigint, NULL unless it is written as a whole number ('9.0' is not)."""
    return c.cast("string").try_cast("bigint")


def number_of(df: DataFrame, name: str) -> Column:
    """A column as a double, by the shortest way its type allows."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).cast("double")
    return as_number(F.col(name))


PARSED = "_whole_"


def whole_of(df: DataFrame, name: str, default=None) -> Column:
    """A column as whole numbers, by the shortest way its type allows; a default where it is missing.

    A column that ``parse_whole`` has read already is not read again.
    """
    if PARSED + name in df.columns:
        return F.col(PARSED + name)
    if name not in df.columns:
        return F.lit(default).cast("bigint")
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).try_cast("bigint")
    return as_whole(F.col(name))


def parse_whole(df: DataFrame, *names: str) -> DataFrame:
    """Reads text columns once, for rules that look at them many times. Drop with ``drop_parsed``."""
    new = {
        PARSED + n: as_whole(F.col(n)) for n in names
        if n in df.columns and PARSED + n not in df.columns and isinstance(df.schema[n].dataType, T.StringType)
    }
    return df.withColumns(new) if new else df


def drop_parsed(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(PARSED)])


def safe_int(c: Column, default: int = 0, strict: bool = False) -> Column:
    """Whole part of a numeric text, cut towards zero; ``default`` (or an error) otherwise."""
    value = as_number(c).try_cast("bigint")
    return F.coalesce(value, _fallback(c, default, strict, "bigint"))


def safe_float(c: Column, default: float = 0.0, strict: bool = False) -> Column:
    return F.coalesce(as_number(c), _fallback(c, default, strict, "double"))


def safe_timestamp(c: Column, default=None, strict: bool = False) -> Column:
    """ISO text as a zone-less timestamp; 'Z' and offsets are accepted, the wall clock is kept."""
    t = _text(c)
    value = F.when(t.rlike(_ISO_DATE), t.try_cast("timestamp_ntz"))
    if default is None and not strict:
        return value
    return F.coalesce(value, _fallback(c, default, strict, "timestamp_ntz"))


def _fallback(c: Column, default, strict: bool, kind: str) -> Column:
    if strict:
        shown = F.coalesce(c.cast("string"), F.lit("NULL"))
        return F.raise_error(F.concat(F.lit("conversion failed: "), shown)).cast(kind)
    return F.lit(default).cast(kind)


def mileage_of(c: Column) -> Column:
    return safe_int(c, 0)


def fee_of(c: Column) -> Column:
    return safe_int(c, 0)


def vehicle_type_of(c: Column) -> Column:
    return safe_int(c, 1)


def weight_kg(c: Column) -> Column:
    """Weight text with an optional kg unit, 0 when unreadable."""
    return safe_float(F.regexp_replace(c.cast("string"), "kg|KG", ""), 0.0)


def time_of(df: DataFrame, name: str) -> Column:
    """A time column whatever its stored type: text is parsed, timestamps pass through."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return safe_timestamp(F.col(name))
    return F.col(name)


def is_present(df: DataFrame, name: str) -> Column:
    """Neither NULL, nor an empty text, nor the number zero. The text '0' is present."""
    if name not in df.columns:
        return F.lit(False)
    c = F.col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return c.isNotNull() & (c != "")
    if isinstance(kind, T.NumericType):
        return c.isNotNull() & (c != 0)
    return c.isNotNull()


def clock_text(ts: Column, upto: int = 19) -> Column:
    """The first characters of 'yyyy-MM-dd HH:mm:ss'. Pattern formatting would read a wall-clock
    time in the session zone and move the hour that a change to summer time leaves out."""
    return F.left(ts.cast("string"), F.lit(upto))


def micro_text(ts: Column) -> Column:
    """Six digits of the fraction of a second."""
    return F.rpad(F.substring(ts.cast("string"), 21, 6), 6, "0")


def iso_text(c: Column) -> Column:
    """ISO text of a timestamp, with microseconds only where there are any."""
    micros = micro_text(c)
    return F.concat(
        F.replace(clock_text(c), F.lit(" "), F.lit("T")),
        F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
    )


_MONEY = ["pay_fee", "discount_fee"]
_QUANTITY = ["fee_mileage", "total_weight"]
_CODES = ["vehicle_type", "axle_count", "gantry_type", "media_type", "transaction_type", "pass_state", "cpu_card_type"]


def coerce_codes(df: DataFrame) -> DataFrame:
    """Database rows as samples: '9.0' becomes '9', money whole fen, times ISO text. NULL stays NULL."""
    out = {}
    for field in df.schema.fields:
        name, c = field.name, F.col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[name] = iso_text(c)
        elif name in _MONEY:
            out[name] = F.when(c.isNotNull(), safe_int(c, 0))
        elif name in _QUANTITY:
            out[name] = F.when(c.isNotNull(), safe_int(c, 0).cast("string"))
        elif name in _CODES:
            raw = c.cast("string")
            whole = as_number(c).try_cast("bigint").cast("string")
            out[name] = F.when(raw == "", "0").otherwise(F.coalesce(whole, raw))
        elif not isinstance(field.dataType, T.StringType):
            out[name] = F.coalesce(c.cast("string"), F.lit(None).cast("string"))
    return df.withColumns(out)


_NUMERIC = [
    "pay_fee", "discount_fee", "fee", "fee_mileage", "total_weight",
    "obu_fee_sum_before", "obu_fee_sum_after", "pay_fee_prov_sum_local",
]
_INTEGER_CODES = [
    "axle_count", "vehicle_type", "media_type", "gantry_type",
    "transaction_type", "pass_state", "entrance_lane_type", "cpu_card_type",
]


def numeric_clean(df: DataFrame) -> DataFrame:
    """Training form: amounts as doubles and codes as integers, unreadable values become 0."""
    out = {n: safe_float(F.col(n), 0.0) for n in _NUMERIC if n in df.columns}
    out.update({n: safe_int(F.col(n), 0) for n in _INTEGER_CODES if n in df.columns})
    return df.withColumns(out)


def shown_ratio(part: Column, whole: Column, digits: int, scale: int = 1) -> Column:
    """``part * scale / whole`` with so many decimals, for counts and sums that are whole numbers from 0; NULL for 0 wholes.

    The quotient is rounded in whole numbers, so the figure does not depend on how a fraction is stored; exact halves
    go to the even digit.
    """
    a, b = part.cast("bigint") * F.lit(2 * scale * 10**digits), F.nullif(whole.cast("bigint") * F.lit(2), F.lit(0).cast("bigint"))
    down = F.floor((a - a % b) / b).cast("bigint")
    rest = (a % b) * F.lit(2)
    up = F.when((rest > b) | ((rest == b) & (down % 2 == 1)), F.lit(1)).otherwise(F.lit(0))
    return (down + up) / F.lit(10.0**digits)


def section_code(c: Column) -> Column:
    """Last ten digits of an id as a number, 0 when it has none."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    return F.when(digits == "", F.lit(0).cast("bigint")).otherwise(F.right(digits, F.lit(10)).try_cast("bigint"))


def day_fraction(ts: Column) -> Column:
    """Hour plus minute as a fraction, 0 for a missing time."""
    return F.coalesce(F.hour(ts) + F.minute(ts) / F.lit(60.0), F.lit(0.0))


def hour_label(ts: Column) -> Column:
    return clock_text(ts, 13)


def day_label(ts: Column) -> Column:
    return clock_text(ts, 10)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from start to end, cut towards zero."""
    return F.timestamp_diff("MINUTE", start, end)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end with their fraction, as a double."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1000000.0)


def stable_uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys and the seed only.

    ``rand`` follows the partition layout, so a recomputed task could draw other
    numbers; a keyed digest gives the same draw however often a task is rerun,
    and on every engine.
    """
    parts = [F.coalesce(k.cast("string"), F.lit("\\N")) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    bits = F.conv(F.left(digest, F.lit(12)), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
