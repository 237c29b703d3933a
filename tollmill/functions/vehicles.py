"""Vehicle classes, axle limits, periods of the day and expected fees."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tollmill.functions import constants as K
from tollmill.functions.cleaning import as_whole


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a small literal mapping, NULL for an unknown key."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(table, key)


def vehicle_category(c: Column, default: str | None = K.PASSENGER, strict: bool = False) -> Column:
    """Class of a vehicle code. Unknown codes give ``default``, or an error when strict."""
    code = as_whole(c)
    if strict:
        other = F.raise_error(
            F.concat(F.lit("unknown vehicle code: "), F.coalesce(c.cast("string"), F.lit("NULL")))
        ).cast("string")
    else:
        other = F.lit(default).cast("string")
    return (
        F.when(code.between(1, 4), K.PASSENGER)
        .when(code.between(11, 16), K.TRUCK)
        .when(code.between(21, 26), K.SPECIAL)
        .otherwise(other)
    )


def is_passenger(c: Column) -> Column:
    return passenger_code(as_whole(c))


def is_truck(c: Column) -> Column:
    """Trucks and special vehicles."""
    return truck_code(as_whole(c))


def passenger_code(code: Column) -> Column:
    return F.coalesce(code.between(1, 4), F.lit(False))


def truck_code(code: Column) -> Column:
    return F.coalesce(code.between(11, 16) | code.between(21, 26), F.lit(False))


def freight_class(c: Column) -> Column:
    """Two-way split used for shares and quotas: trucks with special vehicles, everything else passenger."""
    return F.when(is_truck(c), K.TRUCK).otherwise(K.PASSENGER)


def expected_axles(c: Column, strict: bool = False) -> Column:
    """Axle count of a vehicle code as text, NULL (or an error) for an unknown code."""
    value = lookup(K.EXPECTED_AXLES, as_whole(c).try_cast("int"))
    if not strict:
        return value
    shown = F.coalesce(c.cast("string"), F.lit("NULL"))
    return F.coalesce(value, F.raise_error(F.concat(F.lit("unknown vehicle code: "), shown)).cast("string"))


def axle_limit(c: Column) -> Column:
    """Weight limit in kg of an axle text."""
    return F.coalesce(lookup(K.AXLE_LIMIT_KG, c), F.lit(K.DEFAULT_AXLE_LIMIT_KG))


def period_of_hour(hour: Column) -> Column:
    return (
        F.when(hour.between(7, 8), K.MORNING_PEAK)
        .when(hour.between(17, 18), K.EVENING_PEAK)
        .when((hour >= 23) | (hour < 5), K.NIGHT)
        .when(hour.isNotNull(), K.OFF_PEAK)
    )


def time_period(ts: Column) -> Column:
    """Period of the day of a timestamp, NULL for a missing one."""
    return period_of_hour(F.hour(ts))


def toll_rate(vehicle_type: Column) -> Column:
    """Yuan per km."""
    return F.coalesce(lookup(K.PASSENGER_RATE, vehicle_type), F.lit(K.FREIGHT_RATE))


def expected_fee(mileage: Column, vehicle_type: Column) -> Column:
    """Fee in fen for a mileage in metres, cut to whole fen."""
    value = mileage.cast("double") / F.lit(1000.0) * toll_rate(vehicle_type) * F.lit(100.0)
    return value.try_cast("bigint")
