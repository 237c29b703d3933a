"""Joins and set operations between toll tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollmill.functions import constants as K
from tollmill.session import freeze


def with_section_name(df: DataFrame, section: DataFrame) -> DataFrame:
    """Inner lookup of the section name; rows of unknown sections drop out."""
    return df.join(section.select("section_id", "section_name"), "section_id")


def match_trips(exit_: DataFrame, entrance: DataFrame) -> DataFrame:
    """Exit and entrance records of one pass in one section; repeated passes fan out."""
    return exit_.join(entrance, ["pass_id", "section_id"])


def with_gantry(gtx: DataFrame, gantry: DataFrame) -> DataFrame:
    return gtx.drop("section_id").join(gantry.select("gantry_id", "section_id"), "gantry_id")


def children_count(parent: DataFrame, child: DataFrame, key: str, name: str = "child_count") -> DataFrame:
    """Every parent with its number of children, 0 where it has none. Children are counted before the join."""
    counts = child.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parent.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def repair_section(df: DataFrame, gantry_map: DataFrame) -> DataFrame:
    """Section id and name made to agree with the gantry.

    ``gantry_map`` has gantry_id, section_id and section_name. Where the gantry is known
    and its section differs, both columns are replaced; a gantry that is not known is
    flagged in ``_gantry_unknown``.
    """
    known = gantry_map.select(
        "gantry_id", F.col("section_id").alias("_section"), F.col("section_name").alias("_name"),
        F.lit(True).alias("_known"),
    )
    wrong = F.col("_known") & ~F.col("section_id").eqNullSafe(F.col("_section"))
    joined = df.join(known, "gantry_id", "left")
    changes = {"section_id": F.when(wrong, F.col("_section")).otherwise(F.col("section_id"))}
    if "section_name" in df.columns:
        name = F.coalesce("_name", F.lit("未知路段"))
        changes["section_name"] = F.when(wrong, name).otherwise(F.col("section_name"))
    present = F.coalesce(F.col("gantry_id") != "", F.lit(False))
    changes["_gantry_unknown"] = present & F.col("_known").isNull()
    return joined.withColumns(changes).drop("_section", "_name", "_known")


def with_fallback(df: DataFrame, conditional: DataFrame, marginal: DataFrame, key: str, value: str) -> DataFrame:
    """Conditional figure where the key has one, otherwise the marginal figure of the value."""
    best = conditional.select(key, value, F.col("prob").alias("_cond"))
    base = marginal.select(value, F.col("prob").alias("_marg"))
    joined = df.join(best, [key, value], "left").join(base, value, "left")
    return joined.withColumn("prob", F.coalesce("_cond", "_marg")).drop("_cond", "_marg")


def parent_child(log: DataFrame) -> DataFrame:
    """Calls with the call that caused them; a row is never its own child."""
    p = log.select(F.col("id").alias("parent_id"), F.col("trace_id").alias("parent_trace_id"))
    c = log.select(F.col("id").alias("child_id"), "parent_trace_id", F.col("trace_id").alias("child_trace_id"))
    return c.join(p, "parent_trace_id").filter(F.col("child_id") != F.col("parent_id"))


def align_distributions(a: DataFrame, b: DataFrame, keys=("field", "value"), prob: str = "prob") -> DataFrame:
    """Two distributions side by side on every key that occurs in one of them; absent is 0."""
    keys = list(keys)
    left = a.select(*keys, F.col(prob).alias("p"))
    right = b.select(*keys, F.col(prob).alias("q"))
    joined = left.join(right, keys, "full")
    return joined.withColumns({"p": F.coalesce("p", F.lit(0.0)), "q": F.coalesce("q", F.lit(0.0))})


def match_tags(queries: DataFrame, text: str = "query", tags: dict | None = None, default=None) -> DataFrame:
    """Tags whose search words occur in a text (in any case), or the default tags.

    One output row per text and tag. The word table is part of the program, so it is
    carried in the expression and the texts need no join.
    """
    tags = K.METRIC_TAGS if tags is None else tags
    default = K.DEFAULT_METRIC_TAGS if default is None else default
    lowered = F.lower(F.col(text))
    hits = []
    for tag, words in tags.items():
        hit: Column = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        hits.append(F.when(hit, F.lit(tag)))
    matched = F.array_compact(F.array(*hits))
    chosen = F.when(F.size(matched) > 0, matched).otherwise(F.array(*[F.lit(d) for d in default]))
    return queries.withColumn("tag", F.explode(chosen))


def resolve_section(df: DataFrame, section: DataFrame, text: str) -> DataFrame:
    """Section whose name occurs in a free text, NULL if none does; the smallest id wins.

    Names form a ladder of prefixes of 1, 2, 4, ... characters. A place of a distinct text goes on to the next rung only
    while a name begins with the characters from there on. On a rung of w characters it is compared, by equality, with the
    names of w to 2w - 1 characters, one row for each length that names with this prefix have; so thousands of names with
    one beginning cost a place a few rows. A place carries no more of its text than the longest name has characters.
    """
    names = section.filter(F.length("section_name") > 0).groupBy(F.col("section_name").alias("_name")).agg(F.min("section_id").alias("_section"))
    longest = names.agg(F.max(F.length("_name")).alias("n")).first()["n"]
    if longest is None:
        return df.withColumn("resolved_section_id", F.lit(None).cast("string"))
    texts = freeze(df.select(F.col(text).alias("_text")).filter(F.length("_text") > 0).distinct().withColumn("_t", F.monotonically_increasing_id()))
    at = texts.select("_t", "_text", F.explode(F.sequence(F.lit(1), F.length("_text"))).alias("_i"))
    alive = at.select("_t", F.expr(f"substring(_text, _i, {longest})").alias("_rest")).distinct()
    said, width = None, 1
    while width <= longest:
        n = F.length("_name")
        heads = names.filter(n >= width).groupBy(F.left("_name", F.lit(width)).alias("_head")).agg(
            F.collect_set(F.when(n < 2 * width, n)).alias("_lengths"), (F.max(n) >= 2 * width).alias("_on")
        )
        met = alive.filter(F.length("_rest") >= width).withColumn("_at", F.left("_rest", F.lit(width)))
        met = freeze(met.join(heads, F.col("_at") == F.col("_head")).select("_t", "_rest", "_lengths", "_on"))
        whole = met.select("_t", "_rest", F.explode("_lengths").alias("_n")).select("_t", F.left("_rest", F.col("_n")).alias("_said"))
        said = whole if said is None else said.unionByName(whole)
        alive = met.filter("_on").select("_t", "_rest")
        width *= 2
    found = said.join(names, F.col("_said") == F.col("_name")).groupBy("_t").agg(F.min("_section").alias("resolved_section_id"))
    by_text = found.join(texts, "_t").select("_text", "resolved_section_id")
    return df.join(by_text, df[text] == by_text["_text"], "left").drop("_text")


def mix(a: DataFrame, b: DataFrame, n: int, ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """``int(n * ratio)`` rows of one set and the rest of the other, each tagged with its origin."""
    from tollmill.sources.readers import sample_n

    first = int(n * ratio)
    left = sample_n(a, first, seed).withColumn("_source", F.lit("a"))
    right = sample_n(b, n - first, seed).withColumn("_source", F.lit("b"))
    return left.unionByName(right, allowMissingColumns=True)


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def shared_values(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values that occur in both columns."""
    return a.select(col).intersect(b.select(col))


def all_values(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values that occur in one of the columns."""
    return a.select(col).union(b.select(col)).distinct()


def partition_pass_fail(df: DataFrame, accepted: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition, and all others (NULL counts as not met)."""
    ok = F.coalesce(accepted, F.lit(False))
    return df.filter(ok), df.filter(~ok)
