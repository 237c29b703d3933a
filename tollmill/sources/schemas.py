"""Declared schemas of the toll tables. Times are local wall-clock times without a zone."""

from __future__ import annotations

from pyspark.sql import types as T

from tollmill.functions import constants as K

_S, _I, _D = T.StringType(), T.IntegerType(), T.TimestampNTZType()
_MONEY = T.DecimalType(10, 2)


def _schema(text: str = "", **typed) -> T.StructType:
    fields = [T.StructField(n, _S) for n in text.split()]
    return T.StructType(fields + [T.StructField(n, t) for n, t in typed.items()])


SECTION = _schema("section_id section_name")

TOLL_STATION = _schema(
    "toll_station_id station_name section_id station_type longitude latitude operation_status "
    "station_code station_status real_type agency_gantry_ids gantry_type"
)

GANTRY = _schema(
    "gantry_id gantry_name section_id gantry_type length status entrance_hex exit_hex lane_count "
    "direction start_station end_station neighbor_id reverse_id"
)

ENTRANCE = _schema(
    "entrance_transaction_id vehicle_class vehicle_color_id card_type pass_id vehicle_sign section_id section_name",
    entrance_time=_D,
)

EXIT = _schema(
    "exit_transaction_id vehicle_class vehicle_plate_color_id axis_count total_limit total_weight card_type "
    "pay_type pay_card_type discount_type section_id pass_id section_name",
    exit_time=_D, toll_money=_MONEY, real_money=_MONEY, card_pay_toll=_MONEY,
)

GANTRY_TRANSACTION = _schema(
    "gantry_transaction_id gantry_id gantry_type fee media_type vehicle_type vehicle_sign transaction_type "
    "pass_state entrance_lane_type pass_id axle_count total_weight cpu_card_type fee_mileage fee_prov_begin_hex "
    "obu_fee_sum_before obu_fee_sum_after pay_fee_prov_sum_local section_id section_name",
    transaction_time=_D, entrance_time=_D, pay_fee=_I, discount_fee=_I,
)

AUDIT_LOG = _schema(
    "operation_type api_endpoint http_method request_params request_body request_headers response_body user_id "
    "session_id user_agent client_ip server_ip trace_id parent_trace_id error_message",
    id=_I, response_status=_I, response_time_ms=_I, created_at=_D, ended_at=_D, is_success=T.BooleanType(),
)

# samples exchanged as JSON are loose, so every field is read as text and cleaned afterwards
SAMPLE = _schema(" ".join(K.SAMPLE_FIELDS))

TABLES = {
    "section": SECTION,
    "tollstation": TOLL_STATION,
    "gantry": GANTRY,
    "entrancetransaction": ENTRANCE,
    "exittransaction": EXIT,
    "gantrytransaction": GANTRY_TRANSACTION,
    "audit_logs": AUDIT_LOG,
}
