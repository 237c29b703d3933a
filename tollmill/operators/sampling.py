"""Exact sampling by hash, resampling from learned distributions, and rebalancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollmill.functions.cleaning import stable_uniform
from tollmill.operators.ordering import running_sum
from tollmill.session import freeze

_CELL_BITS = 12
_CELLS = 1 << _CELL_BITS


def row_key(cols, seed: int | None = None) -> Column:
    """Hex digest of a row's columns: the same on every engine, and uniform."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols]
    return F.md5(F.concat_ws("|", *([F.lit(str(seed))] if seed is not None else []), *parts))


def smallest_by_hash(
    df: DataFrame, strata: list[str], quota: Column, seed: int | None = None, cols: list[str] | None = None
) -> DataFrame:
    """The ``quota`` rows of each stratum with the smallest row digests: an exact, repeatable random sample.

    No stratum is ever sorted as a whole. Rows are counted per cell of the digest (its first
    and its next 12 bits); full cells are taken or left as they are, and only the one cell in
    which the quota runs out is ordered. Equal rows are counted before that, so a stratum full
    of copies is no larger than its distinct rows there.
    """
    cols = cols or df.columns
    keyed = df.withColumn("_key", row_key(cols, seed)).withColumns(
        {"_c1": F.left("_key", F.lit(3)), "_c2": F.substring("_key", 4, 3), "_quota": quota.cast("bigint")}
    )
    groups = [*strata, "_quota"]
    size1 = keyed.groupBy(*groups, "_c1").agg(F.count(F.lit(1)).alias("_n"))
    one = _marked(size1, groups, "_c1", F.col("_quota"))
    joined = _same(keyed, one.select(*groups, "_c1", "_before", "_state"), [*groups, "_c1"])
    whole1 = joined.filter(F.col("_state") == "in")
    # one cell in 4096 per stratum is looked at again, so it is written out once
    cut = joined.filter(F.col("_state") == "edge").withColumn("_left", F.col("_quota") - F.col("_before"))
    edge1 = freeze(cut.drop("_before", "_state"))
    groups2 = [*groups, "_c1", "_left"]
    size2 = edge1.groupBy(*groups2, "_c2").agg(F.count(F.lit(1)).alias("_n"))
    two = _marked(size2, groups2, "_c2", F.col("_left"))
    joined2 = _same(edge1, two.select(*groups2, "_c2", "_before", "_state"), [*groups2, "_c2"])
    whole2 = joined2.filter(F.col("_state") == "in")
    edge2 = joined2.filter(F.col("_state") == "edge").withColumn("_take", F.col("_left") - F.col("_before"))
    # copies of a row share their digest: count them, then hand out what is left of the quota
    copies = edge2.groupBy(*df.columns, *groups2, "_c2", "_key", "_take").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(*groups2, "_c2").orderBy("_key", *df.columns).rowsBetween(W.unboundedPreceding, 0)
    shared = copies.withColumn("_had", F.sum("_n").over(upto) - F.col("_n"))
    rest = F.least(F.col("_n"), F.col("_take") - F.col("_had"))
    last = shared.filter(rest > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), rest)))
    keep = df.columns
    return whole1.select(*keep).unionByName(whole2.select(*keep)).unionByName(last.select(*keep))


def _marked(sizes: DataFrame, groups: list[str], cell: str, quota: Column) -> DataFrame:
    """Cells in digest order with the rows before them: taken whole, cut by the quota, or left out."""
    upto = W.partitionBy(*groups).orderBy(cell).rowsBetween(W.unboundedPreceding, 0)
    out = sizes.withColumn("_end", F.sum("_n").over(upto)).withColumn("_before", F.col("_end") - F.col("_n"))
    state = F.when(F.col("_end") <= quota, "in").when(F.col("_before") < quota, "edge").otherwise("out")
    return out.withColumn("_state", state).filter(F.col("_state") != "out")


def _same(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    renamed = table.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], "_before", "_state")
    on = [F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, on).drop(*[f"_j{i}" for i in range(len(keys))])


def quota_plan(df: DataFrame, stratum: Column, targets: dict, n: int) -> DataFrame:
    """Current and target share, gap and rows to draw per stratum, largest gap first."""
    counts = df.groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("available"))
    total = counts.agg(F.sum("available")).scalar()
    plan = df.sparkSession.createDataFrame(
        [(k, float(v), int(n * v)) for k, v in targets.items()], "stratum string, target double, quota bigint"
    )
    joined = plan.join(counts, "stratum", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    current = F.coalesce(F.try_divide(F.col("available"), total), F.lit(0.0))
    return joined.withColumn("current", current).withColumn("gap", F.col("target") - F.col("current")).orderBy(
        F.desc("gap"), "stratum"
    )


def rebalance(df: DataFrame, targets: dict, n: int, stratum: Column, seed: int | None = None) -> DataFrame:
    """``floor(n * target)`` rows of every stratum, or all of a smaller stratum."""
    quota = None
    for key, share in targets.items():
        cond = F.col("_stratum") == key
        rows = F.lit(int(n * share))
        quota = F.when(cond, rows) if quota is None else quota.when(cond, rows)
    cols = df.columns
    return smallest_by_hash(df.withColumn("_stratum", stratum), ["_stratum"], quota.otherwise(0), seed, cols).drop("_stratum")


_GRID = 4096


def _bounds(counts: DataFrame) -> DataFrame:
    """Lower and upper bound of every value in [0, 1) per (col, given), in the order of the values.

    Distinct values are numbered by ranges (``running_sum``), so no group is ordered in one task. Each bound is cut along
    a grid, so that a lookup joins by equality; a grid cell that holds several values has one row for each of them.
    """
    summed = running_sum(counts, ["col", "given", "value"], "cnt", "_end")
    ends = summed.groupBy("col", "given").agg(F.min(F.col("_end") - F.col("cnt")).alias("_base"), F.sum("cnt").alias("_total"))
    ends = ends.select(F.col("col").alias("_c"), F.col("given").alias("_g"), "_base", "_total")
    joined = summed.join(ends, (F.col("col") == F.col("_c")) & F.col("given").eqNullSafe(F.col("_g")))
    upper = (F.col("_end") - F.col("_base")) / F.col("_total")
    lower = (F.col("_end") - F.col("cnt") - F.col("_base")) / F.col("_total")
    cells = F.sequence(F.floor(lower * _GRID), F.floor(upper * _GRID))
    return joined.select("col", "given", "value", lower.alias("lower"), upper.alias("upper"), F.explode(cells).alias("cell"))


def _draw(out: DataFrame, bounds: DataFrame, name: str, u: Column, given: Column) -> DataFrame:
    """Adds the value whose bounds enclose u among the values that go with ``given``."""
    mine = bounds.filter(F.col("col") == name).drop("col").withColumnRenamed("given", "_given")
    drawn = out.withColumns({"_u": u, "_cell": F.floor(u * _GRID), "_for": given})
    hit = (F.col("_cell") == F.col("cell")) & F.col("_for").eqNullSafe(F.col("_given")) & (F.col("_u") >= F.col("lower")) & (F.col("_u") < F.col("upper"))
    return drawn.join(mine, hit).withColumnRenamed("value", name).drop("_u", "_cell", "_for", "_given", "lower", "upper", "cell")


def resample(
    df: DataFrame, n: int, cols=("gantry_id", "vehicle_type", "media_type", "pass_state"), cond=None, seed: int = 42,
    gantry_map: DataFrame | None = None,
) -> DataFrame:
    """Exactly n new rows drawn from the learned distributions of a table.

    ``cols`` are drawn independently; ``cond`` maps a column to the drawn column it depends on, e.g. axle_count to
    vehicle_type. A drawn value with which the dependent column never occurs falls back to that column's values over all
    rows. With ``gantry_map`` the section follows from the gantry. All columns are counted in one pass over the table,
    and the bounds are written once. A column without any value gives no rows to draw from and stays NULL.
    """
    cond = {"axle_count": "vehicle_type"} if cond is None else cond
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    wanted = [(c, none) for c in (*cols, *cond)] + [(c, text(g)) for c, g in cond.items()]
    kinds = F.array(*[
        F.struct(F.lit(c).alias("col"), g.alias("given"), text(c).alias("value"), F.lit(i >= len(cols) + len(cond)).alias("paired"))
        for i, (c, g) in enumerate(wanted)
    ])
    pairs = df.select(F.inline(kinds)).filter(F.col("value").isNotNull() & (~F.col("paired") | F.col("given").isNotNull()))
    bounds = freeze(_bounds(pairs.groupBy("col", "given", "value").agg(F.count(F.lit(1)).alias("cnt"))))
    present = {r["col"] for r in bounds.select("col").distinct().collect()}  # at most one row per column
    out = df.sparkSession.range(n)
    for i, c in enumerate((*cols, *cond)):
        if c not in present:
            out = out.withColumn(c, none)
            continue
        seeded = stable_uniform(seed + i if c not in cond else seed + 1000 + list(cond).index(c), F.col("id"))
        given = none
        if c in cond:
            g = cond[c]
            met = bounds.filter((F.col("col") == c) & F.col("given").isNotNull()).select(F.col("given").alias("_met")).distinct()
            out = out.join(met, F.col(g).cast("string") == F.col("_met"), "left")
            given = F.col("_met")
        out = _draw(out, bounds, c, seeded, given).drop("_met")
    out = out.select("id", *[F.col(c).cast(df.schema[c].dataType) for c in (*cols, *cond)])
    return out if gantry_map is None else out.join(gantry_map, "gantry_id", "left")


def standard_normal(seed: int, *keys: Column) -> Column:
    """Keyed standard normal numbers (Box-Muller)."""
    u, v = stable_uniform(seed, *keys), stable_uniform(seed + 1, *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def conditional_normal(spark: SparkSession, stats: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n fee-mileage pairs per class that follow the class's means, deviations and correlation.

    The mileage is kept within 5-150 km; the expected fee within three deviations of its mean;
    the fee within 0.8 times the smallest and 1.2 times the largest fee seen.
    """
    # there is one line of figures per class, so every id carries them along as one short array
    lines = stats.agg(F.collect_list(F.struct(*stats.columns))).scalar()
    rows = spark.range(n).withColumn("s", F.explode(lines)).select("id", "s.*")
    key = [F.col("vehicle_class"), F.col("id")]
    drawn = (F.col("mileage_mean") + F.col("mileage_std") * standard_normal(seed, *key)).cast("bigint")
    rows = rows.withColumn("mileage", F.greatest(F.lit(5000), F.least(F.lit(150000), drawn)))
    slope = F.col("correlation") * F.col("fee_std") / F.nullif(F.col("mileage_std"), F.lit(0).cast("bigint"))
    centre = F.col("fee_mean") + F.coalesce(slope, F.lit(0.0)) * (F.col("mileage") - F.col("mileage_mean"))
    reach = F.col("fee_std") * 3
    centre = F.greatest(F.col("fee_mean") - reach, F.least(F.col("fee_mean") + reach, centre))
    spread = F.col("fee_std") * F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("correlation") * F.col("correlation")))
    fee = (centre + spread * standard_normal(seed + 10, *key)).cast("bigint")
    low = F.greatest(F.lit(50), (F.col("fee_min") * 0.8).cast("bigint"))
    high = (F.col("fee_max") * 1.2).cast("bigint")
    rows = rows.withColumn("fee", F.least(high, F.greatest(low, fee)))
    return rows.select("vehicle_class", "id", "mileage", "fee")
