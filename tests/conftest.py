import os
import sys
import tempfile

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tollmill.plans.views import TollViews  # noqa: E402
from tollmill.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="tests-")
    session = build_session(
        "tests", "local[8]", spark__checkpoint__dir=f"file://{shared}", spark__sql__shuffle__partitions=8, spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def views(spark):
    return TollViews(spark, DATA)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def frame(spark):
    """A small DataFrame from rows and a schema text."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def values(df, *cols):
    """Rows as tuples, sorted."""
    rows = df.select(*cols).collect() if cols else df.collect()
    return sorted((tuple(r) for r in rows), key=repr)


SAMPLE_SCHEMA = (
    "gantry_transaction_id string, gantry_id string, section_id string, section_name string, vehicle_type string, "
    "transaction_time string, entrance_time string, pay_fee int, discount_fee int, fee_mileage string, axle_count string, "
    "total_weight string, media_type int, pass_state string, transaction_type string"
)


def sample(**changes):
    """A correct passenger transaction with some fields changed."""
    row = dict(
        gantry_transaction_id="T1", gantry_id="G761153001000110010", section_id="G7611530010", section_name="都香高速",
        vehicle_type="1", transaction_time="2023-02-01T09:45:10", entrance_time="2023-02-01T08:30:25", pay_fee=2700,
        discount_fee=135, fee_mileage="60000", axle_count="2", total_weight="2500", media_type=1, pass_state="1",
        transaction_type="06",
    )
    row.update(changes)
    return tuple(row.values())
