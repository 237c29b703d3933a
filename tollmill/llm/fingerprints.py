"""Operator 7: document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each run of five words (lower case, split at white space) is hashed once. The high bits of a hash name its bin and the
smallest hash of each bin is kept: hashes and one upper mark per bin are sorted together, so the first entry of each bin is
its minimum, or its mark if the bin is empty. Empty bins borrow from the first filled bin of their own random probe order
(optimal densification), which does not depend on the document. The low eight bits of each bin are packed, eight bins to a
long. The share of equal bins is corrected for chance: (matches / bins - 1/256) / (1 - 1/256), at least 0.

Null texts count as empty; a text with fewer than five words has its whole sequence as one run, and an empty text one fixed
run of its own. Equal texts have equal fingerprints. Documents follow each other by ascending id (null first), equal ids by
the hash of their text; rows that repeat id and text are one document for this order and get equal results. An empty table
gives an empty result; the only document is its own next one.

The order comes from a distributed numbering of the ids; a text then moves once, keyed by its id, and a quarter of the next
text is sent to it. All keys are unique, so no task gets more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollmill.llm.common import keyed, table
from tollmill.operators.ordering import number_rows

BINS = 256
SHINGLE = 5
_BIN_BITS = 8
_LOW_BITS = 62 - _BIN_BITS
_LOW = (1 << _LOW_BITS) - 1
_PROBES = 8  # tries before the rest of the probe order is worked out


def _bytes(x: int) -> int:
    return int.from_bytes(bytes([x] * 8))


def fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds the fingerprint of a text column as an array of BINS / 8 longs."""
    w, h, s, first, filled = (f"_{out}_{n}" for n in ("words", "hashes", "sorted", "bins", "filled"))
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda x: x != "")
    df = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    runs = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(F.col(w), i + k) for k in range(1, SHINGLE)]))
    runs = F.slice(runs, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
    runs = F.when(F.size(w) == 0, F.array(F.xxhash64(F.lit("")))).otherwise(runs)
    df = df.withColumn(h, F.transform(runs, lambda x: x.bitwiseAND(F.lit((1 << 62) - 1))))
    marks = F.transform(F.sequence(F.lit(1), F.lit(BINS)), lambda b: F.shiftleft(b.cast("long"), _LOW_BITS) - F.lit(1))
    df = df.withColumn(s, F.sort_array(F.concat(F.col(h), marks)))
    bin_of = lambda x: F.shiftright(x, _LOW_BITS)
    firsts = F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(s), i - 1))))
    minima = F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(_LOW)) != F.lit(_LOW), x))
    df = df.withColumn(first, minima)

    def rest(i: Column) -> Column:
        """The filled bin that comes first in the further probe order of bin i."""
        there = F.filter(first, lambda x: x.isNotNull())
        return F.array_min(F.transform(there, lambda x: F.struct(F.xxhash64(i, bin_of(x)).alias("at"), x.alias("x"))))["x"]

    probe = lambda i, t: F.get(F.col(first), F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int"))
    dense = F.transform(first, lambda x, i: F.coalesce(x, *[probe(i, t) for t in range(_PROBES)], rest(i)))
    df = df.withColumn(filled, F.transform(dense, lambda x: x.bitwiseAND(F.lit(255))))

    def lane(j: Column) -> Column:
        packed = F.get(F.col(filled), j * 8)
        for k in range(1, 8):
            packed = packed.bitwiseOR(F.shiftleft(F.get(F.col(filled), j * 8 + k), 8 * k))
        return packed

    df = df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), lane))
    return df.drop(w, h, s, first, filled)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the texts behind two fingerprints, 0 to 1."""

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift, low in ((4, 0x0F), (2, 0x03), (1, 0x01)):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift).bitwiseAND(F.lit(_bytes(low))))
        return F.bit_count(d.bitwiseAND(F.lit(_bytes(0x01))))

    different = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda n, x: n + x.cast("int"))
    chance = 1.0 / 256
    return F.greatest(F.lit(0.0), ((F.lit(BINS) - different) / F.lit(float(BINS)) - chance) / (1 - chance))


def as_hex(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, fp, next_part, next_fp): each text, and of the next document its fingerprint and as much of its start
    as a quarter of this text is long."""
    texts = fingerprint(keyed(docs, id_col, text_col), "text", "fp")
    ids = keyed(docs, id_col, text_col).select("id", "h", F.floor(F.length("text") / 4).cast("int").alias("part")).distinct()
    numbered = number_rows(ids, ["id", "h"])
    n = numbered.count()
    follows = numbered.select(
        F.col("id").alias("for_id"), F.col("h").alias("for_h"), "part", (F.col("_row") % F.lit(max(n, 1)) + 1).alias("_row")
    ).join(numbered.select("_row", "id", "h"), "_row")
    sent = texts.join(follows, texts["id"].eqNullSafe(follows["id"]) & (texts["h"] == follows["h"])).select(
        "for_id", "for_h", F.expr("substring(text, 1, part)").alias("next_part"), F.col("fp").alias("next_fp")
    ).dropDuplicates(["for_id", "for_h"])
    return texts.join(sent, texts["id"].eqNullSafe(sent["for_id"]) & (texts["h"] == sent["for_h"])).drop("for_id", "for_h", "h")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents")).withColumn("n_chars", F.length("text").cast("long"))
    kept = F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))")
    edited = fingerprint(rows.withColumn("edited", F.concat(kept, "next_part")), "edited", "edited_fp")
    return edited.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
