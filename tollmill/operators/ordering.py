"""Row numbers, running sums, shares, top-k and paging that hold at any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollmill.session import freeze

_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in its low 33 bits


def number_rows(df: DataFrame, order: list, name: str = "_row") -> DataFrame:
    """Global row numbers from 1 in the given order, without one big sort task.

    Rows are range-partitioned and sorted inside their range, which gives each row
    its place in its range; the sizes of the earlier ranges are then added. The
    ranges are frozen in between, so a recomputed task cannot shift them. A key
    that holds many rows is split as long as later order columns tell its rows apart.
    """
    ranged = (
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    )
    frozen = freeze(ranged)
    part = F.shiftright("_id", _ROW_BITS)
    place = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # one row per range: the number of ranges is the number of shuffle partitions
    sizes = frozen.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = frozen.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + place + 1).drop("_id", "_part", "_start")


def running_sum(df: DataFrame, order: list, weight: str, name: str = "cumulative") -> DataFrame:
    """Running total of ``weight`` in the given order, by the same two steps as ``number_rows``."""
    ranged = freeze(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.sum(weight).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = ranged.withColumn(name, F.sum(weight).over(inside)).join(F.broadcast(starts), "_part")
    return summed.withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")


def cumulative_weight(df: DataFrame, order: list, w: str) -> DataFrame:
    """Bounds for weighted choice: running weight and its share of the whole."""
    total = df.agg(F.sum(w)).scalar()
    return running_sum(df, order, w).withColumn("upper", F.col("cumulative") / total)


def rank_cut(df: DataFrame, keys: list[str], ratio: float, drawn: int = 10_000) -> Column:
    """The key at position ``floor(n * ratio)`` as a struct, NULL when that is position 0. Nothing is sorted but samples.

    About ``drawn`` keys are drawn in each round; two of them enclose the position but for bad luck. Counts of the keys below
    and up to each say where it lies, and only the keys in that part are looked at again. They no longer hold
    the two, so a key shared by any share of the rows ends the search or leaves it.

    The key is one column: Spark infers conditions from a filter below renamed columns, twice as many for each such column.
    """
    key, head = F.col("k"), lambda k: F.struct(k[keys[0]])
    rest = df.select(F.struct(*keys).alias("k"))
    n = rest.count()
    at = int(n * ratio)
    if at == 0:
        return rest.filter(F.lit(False)).scalar()
    seed = 0
    while n > drawn:
        seed += 1
        sample = freeze(rest.sample(drawn / n, seed))
        m = sample.count()
        if m == 0:
            continue
        place, reach = at * m / n, 2 * m**0.5  # four standard deviations at least
        ends = [max(1, math.floor(place - reach)), min(m, math.ceil(place + reach))]
        ranked = sample.withColumn("r", F.row_number().over(W.orderBy("k"))).filter(F.col("r").isin(ends))
        edges = freeze(ranked.agg(F.min("k").alias("lo"), F.max("k").alias("hi")))
        lo, hi = edges.select("lo").scalar(), edges.select("hi").scalar()
        sides = (key < lo, key <= lo, key < hi, key <= hi)
        below_lo, upto_lo, below_hi, upto_hi = rest.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(sides)]).first()
        if below_lo < at <= upto_lo:
            return lo
        if below_hi < at <= upto_hi:
            return hi
        if at <= below_lo:
            part, n = key < lo, below_lo
        elif at <= below_hi:
            # the first column alone turns nearly all rows away
            near = (head(key) >= head(lo)) & (head(key) <= head(hi))
            part, at, n = near & (key > lo) & (key < hi), at - upto_lo, below_hi - upto_lo
        else:
            part, at, n = key > hi, at - upto_hi, n - upto_hi
        rest = freeze(rest.filter(part))
    return freeze(rest.orderBy("k").offset(at - 1).limit(1)).scalar()


def first_part(df: DataFrame, keys: list[str], ratio: float) -> Column:
    """Whether a row is among the first ``floor(n * ratio)`` in key order. The key at the cut is found by counting; the rows stay."""
    return F.coalesce(F.struct(*keys) <= rank_cut(df, keys, ratio), F.lit(False))


def with_share(counts: DataFrame, over=(), count: str = "cnt", share: str = "share", scale: float = 1.0) -> DataFrame:
    """Share of each count in its group (or in everything). NULL groups count as groups."""
    if not over:
        total = counts.agg(F.sum(count)).scalar()
        return counts.withColumn(share, F.col(count) * F.lit(scale) / total)
    keys = [over] if isinstance(over, str) else list(over)
    totals = counts.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.sum(count).alias("_total"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = counts.join(totals, same, "inner")
    return joined.withColumn(share, F.col(count) * F.lit(scale) / F.col("_total")).drop(
        "_total", *[f"_k_{k}" for k in keys]
    )


def top_n_per_group(df: DataFrame, group, order: list, n: int, rank: str | None = None) -> DataFrame:
    """The first rows of each group. Spark drops the other rows before the shuffle."""
    keys = [group] if isinstance(group, str) else list(group)
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def mode_per_group(df: DataFrame, group, col: str) -> DataFrame:
    """Most frequent value per group; the smaller value wins a tie."""
    keys = [group] if isinstance(group, str) else list(group)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("cnt"))
    return top_n_per_group(counts, keys, [F.desc("cnt"), F.asc(col)], 1)


def latest(df: DataFrame, ts: str, limit: int | None = None, offset: int = 0, tie: str | None = None) -> DataFrame:
    """Newest rows first, with an optional page; ``tie`` makes equal times stable."""
    out = df.orderBy(F.desc(ts), *([F.asc(tie)] if tie else []))
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def page(df: DataFrame, order: list, page: int = 1, per_page: int = 50) -> DataFrame:
    """One page of the ordered rows; a page beyond the end is empty."""
    return df.orderBy(*order).offset((max(page, 1) - 1) * per_page).limit(per_page)


def page_info(df: DataFrame, page: int = 1, per_page: int = 50) -> DataFrame:
    """Total rows and number of pages."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(page).alias("page"), F.lit(per_page).alias("per_page"), "total",
        F.ceil(F.col("total") / F.lit(per_page)).alias("pages"),
    )


def top_k(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """Most frequent values of a column."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), F.asc(col)).limit(k)


def top_fraction(df: DataFrame, order: list, part: int = 5, cap: int | None = None) -> DataFrame:
    """The best ``n // part`` rows, or ``cap`` of them where the report has a largest size."""
    size = df.count() // part
    if cap is not None:
        return df.orderBy(*order).limit(min(size, cap))
    numbered = number_rows(df, order)
    return numbered.filter(F.col("_row") <= size).drop("_row")


def chunk_of(df: DataFrame, order: list, size: int, name: str = "chunk") -> DataFrame:
    """Positional chunks of ``size`` rows, numbered from 0."""
    return number_rows(df, order).withColumn(name, F.floor((F.col("_row") - 1) / F.lit(size))).drop("_row")
