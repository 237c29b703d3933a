"""Column functions against stated inputs and results."""

import pytest
from pyspark.sql import functions as F

from tollmill.functions import cleaning as C
from tollmill.functions import constants as K
from tollmill.functions import text as X
from tollmill.functions import vehicles as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def lit(x):
    return F.lit(x).cast("string") if x is None or isinstance(x, str) else F.lit(x)


@pytest.mark.parametrize("raw, expected", [
    ("123", 123), ("  123  ", 123), ("123.45", 123), ("-123.45", -123), (None, -1), ("", -1), ("   ", -1), ("abc", -1),
    (7, 7), (7.9, 7), ("12d", -1), ("0x10", -1), ("1e3", 1000), (".5", 0), ("1e400", -1),
])
def test_safe_int(spark, raw, expected):
    assert one(spark, C.safe_int(lit(raw), -1)) == expected


@pytest.mark.parametrize("raw", [None, "", "abc"])
def test_strict_conversion_fails(spark, raw):
    with pytest.raises(Exception, match="conversion failed"):
        one(spark, C.safe_int(lit(raw), strict=True))


@pytest.mark.parametrize("raw, expected", [("3.5", 3.5), (" -2 ", -2.0), ("x", 0.25), (None, 0.25)])
def test_safe_float(spark, raw, expected):
    assert one(spark, C.safe_float(lit(raw), 0.25)) == expected


@pytest.mark.parametrize("raw, expected", [
    ("2023-01-03T10:00:00", "2023-01-03 10:00:00"), ("2023-01-03T10:00:00Z", "2023-01-03 10:00:00"),
    (" 2023-01-03 10:00:00 ", "2023-01-03 10:00:00"), ("2023-01-03T10:00:00+08:00", "2023-01-03 10:00:00"),
    ("soon", None), ("", None), (None, None), ("2023", None),
])
def test_safe_timestamp(spark, raw, expected):
    assert one(spark, C.safe_timestamp(lit(raw)).cast("string")) == expected


def test_extraction(spark):
    row = spark.createDataFrame([("12", "12345", 1000)], "vehicle_type string, fee_mileage string, pay_fee int")
    got = row.select(C.vehicle_type_of(F.col("vehicle_type")), C.mileage_of(F.col("fee_mileage")), C.fee_of(F.col("pay_fee")))
    assert tuple(got.head()) == (12, 12345, 1000)


@pytest.mark.parametrize("code, label", [
    (1, K.PASSENGER), ("4", K.PASSENGER), ("11", K.TRUCK), (12, K.TRUCK), ("16", K.TRUCK), ("21", K.SPECIAL), (26, K.SPECIAL),
    ("999", K.PASSENGER), ("abc", K.PASSENGER), (None, K.PASSENGER),
])
def test_vehicle_category(spark, code, label):
    assert one(spark, V.vehicle_category(lit(code))) == label


def test_vehicle_category_defaults_and_errors(spark):
    assert one(spark, V.vehicle_category(lit("999"), K.TRUCK)) == K.TRUCK
    with pytest.raises(Exception, match="unknown vehicle code"):
        one(spark, V.vehicle_category(lit("abc"), strict=True))
    assert [one(spark, V.is_truck(lit(c))) for c in ("11", "23", "1", "abc")] == [True, True, False, False]
    assert [one(spark, V.is_passenger(lit(c))) for c in ("1", "5", "11")] == [True, False, False]


@pytest.mark.parametrize("code, axles", [(1, "2"), (4, "2"), (11, "2"), (13, "3"), (14, "4"), (15, "5"), (16, "6"), (26, "6"), (99, None)])
def test_expected_axles(spark, code, axles):
    assert one(spark, V.expected_axles(lit(code))) == axles


@pytest.mark.parametrize("axles, limit", [("2", 18000), ("3", 25000), ("6", 49000), ("255.0", 49000), (None, 49000)])
def test_axle_limit(spark, axles, limit):
    assert one(spark, V.axle_limit(lit(axles))) == limit


@pytest.mark.parametrize("hour, label", [
    (7, K.MORNING_PEAK), (8, K.MORNING_PEAK), (9, K.OFF_PEAK), (17, K.EVENING_PEAK), (18, K.EVENING_PEAK), (19, K.OFF_PEAK),
    (23, K.NIGHT), (0, K.NIGHT), (4, K.NIGHT), (5, K.OFF_PEAK),
])
def test_period(spark, hour, label):
    assert one(spark, V.period_of_hour(F.lit(hour))) == label


@pytest.mark.parametrize("kind, metres, fee", [("11", 90000, 5310), ("1", 60000, 2700), ("12", 120000, 7080), ("4", 10000, 1250)])
def test_expected_fee(spark, kind, metres, fee):
    assert one(spark, V.expected_fee(F.lit(metres), lit(kind))) == int(metres / 1000 * {**K.PASSENGER_RATE}.get(kind, K.FREIGHT_RATE) * 100)
    assert abs(one(spark, V.expected_fee(F.lit(metres), lit(kind))) - fee) <= 1


@pytest.mark.parametrize("raw, masked", [("G5615530120", "G*********0"), ("ab", "***"), (None, "***"), ("abc", "a*c")])
def test_mask_id(spark, raw, masked):
    assert one(spark, X.mask_id(lit(raw))) == masked


def test_text_helpers(spark):
    assert one(spark, X.mask_key(lit("0123456789abcdef"))) == "api_key:01234567..."
    assert one(spark, X.truncate_text(lit("abcdef"), 3)) == "abc...[TRUNCATED]"
    assert one(spark, X.truncate_text(lit("abc"), 3)) == "abc"
    assert one(spark, X.operation_type(lit("/api/ai/sql"))) == "AI_SQL_QUERY"
    assert one(spark, F.to_json(X.decode_json(lit("{broken")))) == '{"_raw":"{broken"}'
    assert one(spark, X.response_summary_json(lit('{"success": true, "count": 2, "data": [{"a": 1}, {"a": 2}]}'))) == (
        '{"success":true,"count":2,"total":null,"execution_type":null,"data_count":2,"error":null}'
    )
    assert one(spark, C.section_code(lit("G5615530120"))) == 5615530120
    assert one(spark, C.section_code(lit(None))) == 0


def test_coerce_codes(spark):
    row = spark.createDataFrame(
        [("9.0", "255.0", "", "12345.0", None, None)],
        "vehicle_type string, axle_count string, pass_state string, fee_mileage string, total_weight string, media_type string",
    )
    assert tuple(C.coerce_codes(row).head()) == ("9", "255", "0", "12345", None, None)
