"""Writing tables, samples, reports and audit rows. Every writer writes in parallel part files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "\ufeff"


def drop_internal(df: DataFrame) -> DataFrame:
    """Without the working columns, whose names start with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    drop_internal(df).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", bom: bool = True) -> None:
    """CSV with a header; each part file opens with the UTF-8 mark where ``bom`` is set."""
    out = drop_internal(df)
    if bom and out.columns:
        first = out.columns[0]
        out = out.withColumnRenamed(first, BOM + first)
    out.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def write_text(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    """One line per row."""
    line = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    df.select(line.alias("value")).write.mode(mode).text(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Adds audit rows. Start and end rows are paired later, nothing is updated in place."""
    df.write.mode("append").parquet(path)
