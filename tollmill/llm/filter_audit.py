"""Operator 11: how five filters over documents interact, for every order in which they may be applied.

Each document gets one bit per filter that it fails. Filters A to D look at its text alone. Filter E, "its text is that of a
smaller id", is an existential self-join: a left-semi join of the rows with the texts' first holders on hash, exact text and
smaller id. The ids that E marks are joined by union with those that fail A to D, and one grouping counts the combinations
of bits per part. All orders and steps are then read off those 32 counts: what a filter removes at a step are the documents
with its bit and none of the bits before it.

The exact text is compared where it costs least. Texts are grouped by (hash, text) before they move, so copies move once
per task; a hash that turns out to stand for one text alone then speaks for it, and the join of the rows needs no text. Rows
of a hash with several texts are joined with the text itself. A text that holds more than a thousandth of all rows is dealt
out over ``SALTS`` parts; there can be no more than a thousand such texts, which bounds the one broadcast.

Null texts count as empty, null parts as the empty string. A null id is neither smaller nor larger than any other, so such a
row never fails E and marks nobody. Rows that repeat an id and its text are rows of their own, but not copies of each other,
as none has the smaller id. Of several labels for one id, any 1 counts. Texts are looked at whole, at any length. An empty
table has no parts: the result is empty. Further columns of the input are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollmill.llm.common import stored, table

FILTERS = "ABCDE"
HOT_SHARE, SALTS = 1000, 64


def text_bits(texts: DataFrame) -> DataFrame:
    """Adds ``bits``: 1, 2, 4 and 8 for the filters A to D, few words, few distinct words, many capitals, markup characters."""
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    words = texts.withColumn("words", F.when(trimmed != "", F.split(trimmed, r"\s+")).otherwise(F.array()))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    fails = [n < 50, distinct * 100 < n * 65, capitals * 100 > F.length("text").cast("long") * 5, F.col("text").rlike(r"[#$%&*|]")]
    bits = F.lit(0)
    for i, fail in enumerate(fails):
        bits = bits + F.when(fail, 1 << i).otherwise(0)
    return words.withColumn("bits", bits.cast("int")).drop("words")


def later_copies(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``rows`` (with id and h) whose text a row of ``texts`` (id, h, text) with a smaller id holds too."""
    held = texts.groupBy("h", "text").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"))
    by_hash = held.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    firsts = stored(by_hash.filter((F.col("lo") < F.col("hi"))), "firsts")
    one, several = firsts.filter("texts = 1"), firsts.filter("texts > 1").select("h")

    least = rows.count() / HOT_SHARE
    hot = one.filter(F.col("n") > least).select(F.col("h").alias("hot"))
    salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = rows.join(F.broadcast(hot), rows["h"] == hot["hot"], "left").withColumn("salt", salt)
    salts = F.when(F.col("n") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    marks = one.select(F.col("h").alias("mark"), "lo", F.explode(salts).alias("of"))
    by_one = dealt.join(marks, (dealt["h"] == marks["mark"]) & (dealt["salt"] == marks["of"]) & (marks["lo"] < dealt["id"]), "left_semi")

    # texts that share a hash with other texts: the text itself decides
    clash = texts.join(several, "h", "left_semi")
    first = clash.groupBy(F.col("h").alias("mark"), F.col("text").alias("of")).agg(F.min("id").alias("lo"))
    marked = clash.join(first, (clash["h"] == first["mark"]) & (clash["text"] == first["of"]) & (first["lo"] < clash["id"]), "left_semi")
    by_text = rows.join(marked.select("id", "h", "bits").distinct(), ["id", "h", "bits"], "left_semi")
    return by_one.select(*rows.columns).unionByName(by_text.select(*rows.columns))


def combinations(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """(part, bits, n, good, toxic): documents per part and combination of failed filters, and how many carry those labels."""
    base = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
    )
    base = text_bits(base.withColumn("h", F.xxhash64("text")))
    rows = stored(base.select("id", "part", "h", "bits"), "rows")
    copies = later_copies(base.select("id", "h", "text", "bits"), rows)
    key = ["id", "h", "part", "bits"]
    union = rows.select(*key, F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(
        copies.select(*key, F.lit(0).alias("n"), F.lit(1 << 4).alias("e"))
    )
    failed = union.groupBy(*key).agg(F.sum("n").alias("n"), F.max("e").alias("e"))
    failed = stored(failed.select("id", "part", (F.col("bits") + F.col("e")).alias("bits"), "n"), "failed")
    marks = labels.groupBy(F.col("doc_id").alias("of")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    labelled = failed.join(marks, failed["id"] == marks["of"]).select(
        "part", "bits", F.lit(0).alias("n"), (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic")
    )
    counted = failed.select("part", "bits", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic")).unionByName(labelled)
    return counted.groupBy("part", "bits").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")])


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of bit combinations.

    What a step does depends on its filter and on the set of filters before it, not on their order: counts are summed for
    those states, 80 for five filters, and the steps of all orders look their state up. Both tables have a fixed size.
    """
    spark, size = counted.sparkSession, len(filters)
    orders = list(permutations(range(size)))
    # states by combination: what becomes of a document with these bits at a filter, after the filters before it
    states = []
    for bits in range(1 << size):
        for i in range(size):
            hit = bits >> i & 1
            # each of a document's failed filters comes first in equally many orders
            share = hit * len(orders) // bits.bit_count() if hit else 0
            for before in range(1 << size):
                if not before >> i & 1:
                    earlier = bool(bits & before)
                    states.append((bits, i, before, int(not hit and not earlier), int(hit and not earlier), int(hit and earlier), int(bits == 1 << i), share))
    known = spark.createDataFrame(states, "bits int, filter int, before int, k int, r int, d int, u int, s int")
    met = counted.join(F.broadcast(known), "bits")
    names = {"kept": ("n", "k"), "removed": ("n", "r"), "redundant": ("n", "d"), "unique_fails": ("n", "u"), "good_lost": ("good", "r"), "toxic_lost": ("toxic", "r"), "shapley": ("n", "s")}
    by_state = met.groupBy("part", "filter", "before").agg(*[F.sum(F.col(c) * F.col(m)).cast("long").alias(out) for out, (c, m) in names.items()])
    steps = [
        ("".join(filters[i] for i in order), step + 1, order[step], sum(1 << i for i in order[:step])) for order in orders for step in range(size)
    ]
    plan = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    return by_state.join(F.broadcast(plan), ["filter", "before"]).select("part", "filter_order", "step", *names)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(stored(combinations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "combinations"))


SQL = f"""
with base as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words
    from documents
), firsts as (
    select text, min(doc_id) as lo from base group by text
), flagged as (
    select b.doc_id, b.part,
        len(words) < 50 as a, 100 * list_unique(words) < 65 * len(words) as b,
        100 * length(regexp_replace(b.text, '[^A-Z]', '', 'g')) > 5 * length(b.text) as c,
        regexp_matches(b.text, '[#$%&*|]') as d, coalesce(f.lo < b.doc_id, false) as e,
        exists (select 1 from labels l where l.doc_id = b.doc_id and l.quality = 1) as good,
        exists (select 1 from labels l where l.doc_id = b.doc_id and l.toxic = 1) as toxic
    from base b join firsts f on f.text = b.text
), failing as (
    select part, good, toxic, concat(case when a then 'A' else '' end, case when b then 'B' else '' end, case when c then 'C' else '' end,
        case when d then 'D' else '' end, case when e then 'E' else '' end) as fails
    from flagged
), counted as (
    select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
    from failing group by all
), orders as (
    select unnest([{', '.join(f"'{''.join(o)}'" for o in permutations(FILTERS))}]) as filter_order
), met as (
    select part, filter_order, step, n, good, toxic, fails,
        contains(fails, filter_order[step]) as hit,
        exists (select 1 from range(1, step) t(i) where contains(fails, filter_order[t.i])) as earlier
    from counted cross join orders cross join (select unnest(range(1, 6))::int as step)
), steps as (
    select part, filter_order, step,
        coalesce(sum(n) filter (where not hit and not earlier), 0)::bigint as kept,
        coalesce(sum(n) filter (where hit and not earlier), 0)::bigint as removed,
        coalesce(sum(n) filter (where hit and earlier), 0)::bigint as redundant,
        coalesce(sum(n) filter (where hit and length(fails) = 1), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (where hit and not earlier), 0)::bigint as good_lost,
        coalesce(sum(toxic) filter (where hit and not earlier), 0)::bigint as toxic_lost
    from met group by all
)
select *, sum(removed) over (partition by part, filter_order[step])::bigint as shapley from steps
"""
