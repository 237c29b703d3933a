"""The catalogue: every runnable query by name, with the SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollmill.functions.cleaning import clock_text, micro_text
from tollmill.plans.views import TollViews, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Registers a function of the toll views under a name, with its SQL twin if it has one."""

    def add(build: Callable[[TollViews], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query name: {name}")
        QUERIES[name] = lambda spark, directory: build(TollViews(spark, directory))
        if sql is not None:
            ORACLES[name] = with_views(sql, recursive)
        return build

    return add


def six(df: DataFrame, *cols: str) -> DataFrame:
    """Floating-point columns at six decimals, as both engines sum in their own order."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def sql_shown(part: str, whole: str, digits: int, scale: int = 1) -> str:
    """Rounded quotient of two whole numbers, exact halves to the even digit, as SQL."""
    a, b = f"(cast({part} as bigint) * {2 * scale * 10**digits})", f"(cast({whole} as bigint) * 2)"
    up = f"case when ({a} % {b}) * 2 > {b} or (({a} % {b}) * 2 = {b} and ({a} // {b}) % 2 = 1) then 1 else 0 end"
    return f"(({a} // {b}) + {up}) / {10.0**digits}::double"


def sql_key(seed: int, *keys: str) -> str:
    """The digest by which rows are drawn, as SQL."""
    return "md5(concat_ws('|', " + f"'{seed}', " + ", ".join(f"coalesce(cast({k} as varchar), chr(92) || 'N')" for k in keys) + "))"


def sql_uniform(seed: int, *keys: str) -> str:
    """The keyed number in (0, 1) of ``stable_uniform``, as SQL."""
    return f"((cast('0x' || left({sql_key(seed, *keys)}, 12) as bigint) + 0.5::double) / {float(1 << 48)}::double)"


def sql_noisy(count: str, eps: float = 1.0) -> str:
    """A count with Laplace noise from a column u, a uniform number less a half, as SQL."""
    noise = f"(-{1.0 / eps}::double * sign(u) * ln(greatest(1.0::double - 2.0::double * abs(u), {2.0**-53!r}::double)))"
    return f"cast(greatest(0, round_even({count} + {noise}, 0)) as bigint)"


def moment(c: str):
    """A timestamp as text with microseconds."""
    ts = F.col(c) if isinstance(c, str) else c
    return F.concat(clock_text(ts), F.lit("."), micro_text(ts))


def sql_moment(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


TRUCKS = "('11','12','13','14','15','16')"
# whole numbers from text, as SQL
WHOLE = "case when regexp_matches(trim({0}), '^[+-]?[0-9]+$') then try_cast(trim({0}) as bigint) end"
AXLE_LIMIT = "case {0} when '2' then 18000 when '3' then 25000 when '4' then 31000 when '5' then 43000 else 49000 end"
PERIOD = (
    "case when hour({0}) between 7 and 8 then '早高峰' when hour({0}) between 17 and 18 then '晚高峰' "
    "when hour({0}) >= 23 or hour({0}) < 5 then '深夜' when {0} is not null then '平峰' end"
)


def whole(c: str) -> str:
    return "(" + WHOLE.format(c) + ")"


def limit_of(c: str) -> str:
    return "(" + AXLE_LIMIT.format(c) + ")"


def period(c: str) -> str:
    return "(" + PERIOD.format(c) + ")"


def load_all() -> None:
    """Imports the modules that register queries."""
    from tollmill.plans import (  # noqa: F401
        audit_queries, column_queries, fidelity_queries, privacy_queries, profile_queries, quality_queries,
        relational_queries, report_queries, sample_queries, source_queries, stream_queries,
    )
