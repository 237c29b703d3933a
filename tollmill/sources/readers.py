"""Reading tables, samples and catalogues."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollmill.functions import constants as K
from tollmill.sources import schemas


def load(spark: SparkSession, directory: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """One Parquet table of a directory, as ``name.parquet`` (file or folder)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{directory}/{name}.parquet")


def get(df: DataFrame, key: str, value) -> DataFrame:
    """The row with a key, or no row."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def day_predicates(column: str, start: str, end: str) -> list[str]:
    """One half-open SQL range per day, so that a database scan is split into parallel reads."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    days = [first + timedelta(days=i) for i in range((last - first).days)]
    return [f"{column} >= '{d}' AND {column} < '{d + timedelta(days=1)}'" for d in days]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def jdbc_plan(
    columns=None, section_id: str | None = None, start: str | None = None, end: str | None = None,
    time_column: str = "transaction_time",
) -> dict:
    """Projection and predicates of a database scan, one part per day. Both dates are needed: a scan without
    bounds would come over one connection into one task. The range is closed: midnight of the end date belongs to it."""
    if not (start and end):
        raise ValueError("a database scan needs a start and an end date")
    parts = day_predicates(time_column, start, end)
    parts += [f"{time_column} = '{end}'"] if date.fromisoformat(start) <= date.fromisoformat(end) else ["1 = 0"]
    if section_id is not None:
        parts = [f"{p} AND section_id = {_quote(section_id)}" for p in parts]
    return {"columns": list(columns or K.SAMPLE_FIELDS), "predicates": parts}


def read_jdbc(
    spark: SparkSession, url: str, table: str = "gantrytransaction", columns=None, section_id: str | None = None,
    start: str | None = None, end: str | None = None, time_column: str = "transaction_time", properties=None,
) -> DataFrame:
    """Gantry rows from any JDBC database (MySQL, SQLite, ...), filtered and projected by the database."""
    plan = jdbc_plan(columns, section_id, start, end, time_column)
    rows = spark.read.jdbc(url, table, predicates=plan["predicates"], properties=properties or {})
    return rows.select(*plan["columns"])


def read_samples(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON array of samples, every field as text.

    A single JSON array cannot be split, so large sets should be written one
    object per line (``write_json``) and read with ``multi_line=False``.
    """
    return spark.read.schema(schemas.SAMPLE).option("multiLine", multi_line).json(path)


def sample_n(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` random rows, the same ones for the same seed; ``-1`` stands for all rows.

    The samples of one seed are nested: a larger one holds every smaller one.
    """
    from tollmill.operators.sampling import smallest_by_hash

    return df if n == -1 else smallest_by_hash(df, [], F.lit(n), seed=seed)


def first_n(df: DataFrame, n: int, order=None) -> DataFrame:
    """The first rows, in a stated order where one is given."""
    return (df.orderBy(order) if order is not None else df).limit(n)


PREVIEW_FIELDS = ["gantry_transaction_id", "vehicle_type", "section_id", "transaction_time", "pay_fee", "fee_mileage"]


def preview(df: DataFrame, n: int = 3, keys=None) -> DataFrame:
    return df.select(*[k for k in (keys or PREVIEW_FIELDS) if k in df.columns]).limit(n)


def profile_catalog(spark: SparkSession, tables=None, sample_rows: int = 3) -> DataFrame:
    """Tables and views of the session: columns with types, row count and a few rows as JSON."""
    names = tables or sorted(t.name for t in spark.catalog.listTables())
    out = None
    for name in names:
        df = spark.table(name)
        columns = F.array(*[F.lit(f"{f.name} {f.dataType.simpleString()}") for f in df.schema.fields])
        rows = df.limit(sample_rows).agg(F.collect_list(F.to_json(F.struct("*"))).alias("r")).select("r").scalar()
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), columns.alias("columns"), "row_count", rows.alias("sample_rows")
        )
        out = one if out is None else out.unionByName(one)
    return out
