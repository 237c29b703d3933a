"""The corpus pipeline: documents to token ids in five stages, each of which works on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. The
driver, or ``run``, writes each result as Parquet and hands it to the next stage. What single stages do with nulls, empty and
repeated rows is told by the operators; an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollmill.llm import bpe, decontamination, jaccard, lines, quality
from tollmill.llm.common import stored, table

#: Words of an n-gram and least Jaccard similarity (in percent) of near-duplicates; the op10 query has its own, 4 and 85.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def fresh_name(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name = "_" + name
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the co-trained classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return quality.classify(docs, model, docs.columns, prefix=prefix).filter(F.col(f"{prefix}predicted") == 1).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: later copies of line runs are cut out; a document of which nothing is left goes. n_chars follows the text."""
    runs = fresh_name(docs, "runs")
    done = lines.dedup(docs, runs_col=runs)
    changed = F.col(runs).isNotNull()
    done = done.filter(~changed | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return done.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 at 5 words and 80 %: of each group of linked documents the row with the smallest id stays (null ids last), and of repeated rows one."""
    # a struct of the id is equal where both are null: both steps need the rows dealt by the same two columns, so texts move once
    first = jaccard.first_rows(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)
    first = stored(first.select(F.struct("id").alias("_first"), F.col("h").alias("_of")), "first")
    of, key = fresh_name(docs, "hash"), fresh_name(docs, "key")
    rows = docs.withColumns({of: F.xxhash64(F.coalesce("text", F.lit(""))), key: F.struct(F.col("doc_id").alias("id"))})
    rows = rows.dropDuplicates([key, of])
    return rows.join(first, (rows[key] == first["_first"]) & (rows[of] == first["_of"]), "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that leak an item of the benchmark go."""
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_leak"]), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: (doc_id, n_tokens, ids), ids as little-endian unsigned 32-bit numbers."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

#: No stage but the joins could be put as SQL; tests check the stages one by one, near-duplicates against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
