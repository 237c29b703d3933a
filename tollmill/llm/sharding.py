"""Operator 3: shards by k-d tree over document metadata, in DataFrame functions only.

All rows start in one node. A node that has to hold more than one shard is split at a weighted median: its shards are halved
(as evenly as their number allows), and the cut lies where the sizes below it add up to that share of the node. The cut runs
along the node's widest dimension, widths being taken as shares of the whole range. All nodes of a level are split together
by three histograms of 65 536 cells over the same rows: first of the dimension, then, inside the cell that holds the cut, of
the hash of the text, then, inside that cell, of the hash of the id. So one value with a third of all rows is cut as finely
as any other, and copies of a text stay side by side; each histogram is summed before it is shuffled and no row moves. Rows
carry how many shards their node still holds. The tables of cuts have a row per node and are written out, so Spark knows
their size: it sends small ones to all tasks and joins larger ones by shuffle.

Dimensions may be numbers (scaled by logarithm) or texts (ordered by their hash); null is the lowest value. The law that
holds is ``bytes``: sizes are near equal. Null texts weigh 8 bytes, as empty ones do. Repeated rows are cut like others; rows
with equal id and text fall into one shard. An empty table gives an empty result. With fewer rows than shards some
shards stay empty. Of very long texts only size and hashes are used; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollmill.llm.common import stored, table
from tollmill.operators.ordering import number_rows

_CELL_BITS = 16
_CELLS = 1 << _CELL_BITS


def _coordinate(df: DataFrame, name: str) -> Column:
    """A dimension as a number: the logarithm of a number, the hash of a text as a share of all hashes."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        x = F.col(name).cast("double")
        return F.when(x.isNull() | F.isnan(x), F.lit(None)).otherwise(F.signum(x) * F.log1p(F.abs(x)))
    return F.when(F.col(name).isNotNull(), F.crc32(F.col(name).cast("string").cast("binary")) / F.lit(2.0**32))


def points(docs: DataFrame, dims: list[str], id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, size, crc, c0.., th, ih): size, checksum, cells of the dimensions, cells of the hashes of text and id; and the sum of sizes."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - _CELL_BITS).cast("int").alias("th"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 64 - _CELL_BITS).cast("int").alias("ih"),
        *[_coordinate(docs, d).alias(f"x{i}") for i, d in enumerate(dims)],
    )
    base = stored(base, "points")
    edges = base.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        *[f(f"x{i}").alias(f"{n}{i}") for i in range(len(dims)) for f, n in ((F.min, "lo"), (F.max, "hi"))],
    ).first()
    cells = []
    for i in range(len(dims)):
        low, high = edges[f"lo{i}"], edges[f"hi{i}"]
        span = (high - low) if low is not None and high > low else 1.0
        scaled = F.floor((F.col(f"x{i}") - F.lit(low or 0.0)) / F.lit(span) * (_CELLS - 2)) + 1
        cells.append(F.coalesce(scaled, F.lit(0)).cast("int").alias(f"c{i}"))
    return base.select("id", "size", "crc", "th", "ih", *cells), int(edges["bytes"])


def _cut(rows: DataFrame, cell: str, goal: DataFrame, prefix: list[str], last: bool = False) -> DataFrame:
    """Per node, the cell that holds the cut and what remains of the goal inside it.

    ``rows`` has (node, cell, size); ``goal`` has (node, want, *prefix). The histogram has at most 65 536 rows a node.
    The last histogram cuts before or after its cell, whichever is nearer to the goal.
    """
    histogram = rows.groupBy("node", F.col(cell).alias("at")).agg(F.sum("size").alias("w"))
    before = W.partitionBy("node").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    below = histogram.withColumn("below", F.coalesce(F.sum("w").over(before), F.lit(0)))
    held = below.join(goal, "node").filter(F.col("below") < F.col("want"))
    found = held.groupBy("node", *prefix).agg(F.max(F.struct("at", "below", "want", "w")).alias("m"))
    rest = F.col("m.want") - F.col("m.below")
    at = F.when(rest * 2 < F.col("m.w"), F.col("m.at") - 1).otherwise(F.col("m.at")) if last else F.col("m.at")
    return found.select("node", *prefix, at.alias(f"at_{cell}"), rest.alias("want"))


def kd_shards(
    docs: DataFrame, dims: list[str], shards: int | None = None, target_bytes: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, size, crc, shard, slot): shards of near equal size, as many as given or as keep a shard near ``target_bytes``.

    Slots count the rows of a shard from 0, by id.
    """
    rows, total = points(docs, dims, id_col, text_col)
    if shards is None:
        shards = max(1, math.ceil(total / target_bytes))
    # node: the lowest shard it holds; leaves: how many it holds
    rows = rows.withColumns({"node": F.lit(0), "leaves": F.lit(shards)})
    for _ in range((shards - 1).bit_length()):
        whole = rows.filter(F.col("leaves") > 1)
        spread = whole.groupBy("node", "leaves").agg(
            F.sum("size").alias("w"), *[(F.max(f"c{i}") - F.min(f"c{i}")).alias(f"s{i}") for i in range(len(dims))]
        )
        widest = F.greatest(*[F.col(f"s{i}") for i in range(len(dims))], F.lit(0))
        pick = F.coalesce(*[F.when(F.col(f"s{i}") == widest, F.lit(i)) for i in range(len(dims))], F.lit(0))
        left = F.floor(F.col("leaves") / 2).cast("int")
        plan = stored(spread.select("node", pick.alias("dim"), (F.col("w") * left / F.col("leaves")).alias("want"), left.alias("left")), "nodes")
        cell = F.element_at(F.array(*[F.col(f"c{i}") for i in range(len(dims))]), F.col("dim") + 1)
        split = whole.join(plan.select("node", "dim"), "node").withColumn("c", cell)
        goal = stored(_cut(split, "c", plan.select("node", "want"), []), "cut")
        inside = split.join(goal.select("node", "at_c"), "node").filter(F.col("c") == F.col("at_c"))
        goal = stored(_cut(inside, "th", goal, ["at_c"]), "cut")
        inside = split.join(goal.select("node", "at_c", "at_th"), "node").filter(
            (F.col("c") == F.col("at_c")) & (F.col("th") == F.col("at_th"))
        )
        goal = _cut(inside, "ih", goal, ["at_c", "at_th"], last=True)
        cuts = stored(goal.select("node", "at_c", "at_th", "at_ih").join(plan.select("node", "dim", "left"), "node"), "cut")
        high = F.struct("c", "th", "ih") > F.struct("at_c", "at_th", "at_ih")
        placed = rows.join(cuts, "node", "left").withColumn("c", cell).withColumn("high", F.coalesce(high & F.col("left").isNotNull(), F.lit(False)))
        node = F.when(F.col("high"), F.col("node") + F.col("left")).otherwise(F.col("node"))
        leaves = F.when(F.col("high"), F.col("leaves") - F.col("left")).otherwise(F.coalesce("left", "leaves"))
        kept = [c for c in rows.columns if c not in ("node", "leaves")]
        rows = stored(placed.select(*kept, node.alias("node"), leaves.alias("leaves")), "level")  # each level reads narrow rows: plans do not nest
    return with_slots(rows.select("id", "size", "crc", F.col("node").alias("shard")))


def with_slots(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each shard from 0 by id: rows are numbered by ranges over all shards, less those of earlier shards."""
    numbered = number_rows(rows, ["shard", "id", "crc", "size"], "row")
    firsts = stored(numbered.groupBy("shard").agg(F.min("row").alias("first")), "firsts")
    return numbered.join(firsts, "shard").select("id", "size", "crc", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = kd_shards(table(spark, sf_dir, "documents"), ["n_chars", "lang"], shards=24)
    return done.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
