"""Operator 5: runs of lines that repeat, by prefix doubling over line ids, in DataFrame functions only.

The corpus is one sequence of line ids, documents in id order; lines without a word are left where they are and do not
count. A run is repeated if the same lines occur at an earlier place, and it is deleted if it has at least ``min_words``
words; the first copy stays. What decides is a window: the shortest run from a line on (or back from a line) with
``min_words`` words. A repeated run of that many words is exactly covered by such windows that are repeated themselves:
the window from each of its lines on, and the one that ends with it. A window has at most ``min_words`` lines, so the
number of doubling rounds depends on that parameter alone.

Suffixes are ranked by doubling: rank k of a line orders the suffixes by their first 2^k lines, from the pair of ranks k - 1
of the line and of the line 2^(k-1) further. Equal ranks are an interval of the suffix array whose longest common prefix is
2^k lines or more. A suffix alone with its rank is out: nothing repeats it. Ranks are given to distinct pairs, which are
counted before they move, by a distributed numbering; so a line that occurs in a third of all documents is one pair. A
window of L lines is named by the ranks of its first and its last 2^k lines, k being as large as possible: windows of one
name are the interval of lcp L. In each interval every occurrence but the first is a later copy.

Null texts count as empty; texts of any length are read whole. Lines are compared without white space at their ends. Documents are ordered by id (null first),
then by the hash of their text; rows that repeat id and text are one document here and keep equal results. A run may overlap
its earlier copy (a line said many times): what stays then is its first period. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollmill.llm.common import keyed, stored, table
from tollmill.operators.ordering import number_rows

MIN_WORDS = 50


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, line, words, a, b): the lines that have words, with the two hashes that identify a line, each once.

    Texts are read once and do not move: the rows are narrow when repeated rows of a document are met.
    """
    texts = keyed(docs, id_col, text_col)
    rows = texts.select("id", "h", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("t", F.btrim("t", F.lit(" \t\n\x0b\f\r")))
    words = F.size(F.split("t", r"\s+"))
    named = rows.filter(F.col("t") != "").select("id", "h", "line", words.alias("words"), F.xxhash64("t").alias("a"), F.hash("t").alias("b"))
    return named.dropDuplicates(["id", "h", "line"])


def _rank(rows: DataFrame, pair: list[str], out: str) -> DataFrame:
    """Adds the rank of each row's pair, keeping only rows whose pair occurs more than once."""
    pairs = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    ranks = number_rows(pairs, pair, out)
    return rows.join(ranks, pair).drop(*pair)


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, line, of_id, of_line): the lines to delete (from 0), with the line of the first copy of a window that holds it."""
    lines = stored(_lines(docs, id_col, text_col), "rows")
    # place: the how-manieth line with words it is; lines that occur once cannot be part of a repeated run
    repeated = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b")
    ranks = number_rows(repeated, ["a", "b"], "r0")
    by_doc = W.partitionBy("id", "h").orderBy("line")
    # start: words before the line in its document; place: lines with words before it
    placed = lines.withColumn("place", F.row_number().over(by_doc)).withColumn(
        "start", F.sum("words").over(by_doc.rowsBetween(W.unboundedPreceding, 0)) - F.col("words")
    )
    base = stored(placed.join(ranks, ["a", "b"]).select("id", "h", "line", "place", "start", "words", "r0"), "lines")
    rounds = max(1, min_words).bit_length() - 1
    at = base
    for k in range(1, rounds + 1):
        half = 1 << (k - 1)
        last = f"r{k - 1}"
        there = F.lead("place", half).over(by_doc) == F.col("place") + half
        whole = at.select(
            "id", "h", "place", F.col(last).alias("p"),
            F.when(there & F.lead(last, half).over(by_doc).isNotNull(), F.lead(last, half).over(by_doc)).alias("q"), "line"
        )
        step = _rank(whole.filter(F.col("q").isNotNull() & F.col("p").isNotNull()).select("id", "h", "line", "p", "q"), ["p", "q"], f"r{k}")
        mine = step.select(F.col("id").alias("i"), F.col("h").alias("g"), F.col("line").alias("l"), f"r{k}")
        at = at.join(mine, at["id"].eqNullSafe(mine["i"]) & (at["h"] == mine["g"]) & (at["line"] == mine["l"]), "left").drop("i", "g", "l")
        at = stored(at, f"ranks{k}")
    # the ranks of the 2^k lines that end with a line
    back = [F.lag(f"r{k}", (1 << k) - 1).over(by_doc).alias(f"q{k}") for k in range(rounds + 1)]
    full = at.select("*", *back).withColumn("end", F.col("start") + F.col("words"))
    ahead = W.partitionBy("id", "h").orderBy("start").rangeBetween(0, min_words - 1)
    behind = W.partitionBy("id", "h").orderBy("end").rangeBetween(-(min_words - 1), 0)

    def windows(frame, first: bool) -> DataFrame:
        mine, other = ("r", "q") if first else ("q", "r")
        edge = F.last if first else F.first
        far = edge(F.struct("place", "line", *[f"{other}{k}" for k in range(rounds + 1)])).over(frame)
        seen = full.select("*", far.alias("far"), F.sum("words").over(frame).alias("held"))
        size = (F.abs(F.col("far.place") - F.col("place")) + 1).alias("size")
        seen = seen.withColumn("size", size).filter(F.col("held") >= min_words)
        level = F.floor(F.log2(F.col("size").cast("double")) + F.lit(1e-9))
        near_rank = F.coalesce(*[F.when(level == k, F.col(f"{mine}{k}")) for k in range(rounds + 1)])
        far_rank = F.coalesce(*[F.when(level == k, F.col(f"far.{other}{k}")) for k in range(rounds + 1)])
        head, tail = (near_rank, far_rank) if first else (far_rank, near_rank)
        lo, hi = (F.col("line"), F.col("far.line")) if first else (F.col("far.line"), F.col("line"))
        return seen.select("id", "h", lo.alias("lo"), hi.alias("hi"), "size", head.alias("head"), tail.alias("tail")).filter(
            F.col("head").isNotNull() & F.col("tail").isNotNull()
        )

    found = stored(windows(ahead, True).unionByName(windows(behind, False)).distinct(), "windows")
    name = ["size", "head", "tail"]
    firsts = found.groupBy(*name).agg(F.min(F.struct("id", "h", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = stored(firsts, "firsts")  # a side of its own, so that a window with very many copies can be split
    copies = found.join(firsts, name).filter(~F.struct("id", "h", "lo").eqNullSafe(F.col("first")))
    return copies.groupBy("id", "h", "lo").agg(F.max("hi").alias("hi"), F.min("first").alias("first")).select(
        "id", "h", "lo", "hi", F.col("first.id").alias("of_id"), F.col("first.lo").alias("of_line")
    )


def deleted_runs(copies: DataFrame) -> DataFrame:
    """(id, h, runs): the lines to delete as runs (lo, hi, of_id, of_line) in order, apart from each other.

    A window counts from the line on that no window before it reaches; stretches that follow each other in the document and
    in the earlier copy are one run. So each line of a run is the copy of the line as far behind ``of_line``.
    """
    by_doc = W.partitionBy("id", "h").orderBy("lo")
    before = by_doc.rowsBetween(W.unboundedPreceding, -1)
    reached = copies.withColumn("from", F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(before) + 1, F.col("lo"))))
    parts = reached.filter(F.col("from") <= F.col("hi")).withColumn("of_line", F.col("of_line") + F.col("from") - F.col("lo"))
    in_order = W.partitionBy("id", "h").orderBy("from")
    shift = F.col("of_line") - F.col("from")
    goes_on = (
        (F.lag("hi").over(in_order) + 1 == F.col("from")) & F.lag("of_id").over(in_order).eqNullSafe(F.col("of_id")) & (F.lag(shift).over(in_order) == shift)
    )
    parts = parts.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(in_order))
    runs = parts.groupBy("id", "h", "run").agg(
        F.min("from").alias("lo"), F.max("hi").alias("hi"), F.min_by("of_id", "from").alias("of_id"), F.min("of_line").alias("of_line")
    )
    # a document has at most as many runs as lines
    return runs.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "of_id", "of_line"))).alias("runs"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", runs_col: str = "_runs") -> DataFrame:
    """All rows with their columns; in ``text_col`` the later copies are deleted. Adds ``runs_col``: the deleted runs of lines
    as (lo, hi, of_id, of_line); null where nothing was deleted. An input column of that name is replaced; all others stay,
    whatever their names."""
    names = [c for c in docs.columns if c != runs_col]
    runs = deleted_runs(later_copies(docs, min_words, id_col, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    out = rows.join(runs.select(F.col("id").alias("of"), F.col("h").alias("hash"), "runs"), F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("hash")), "left")
    # what lies between the runs
    cut = out.withColumn("lines", F.split("text", "\n"))
    begins = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["hi"] + 1))
    ends = F.concat(F.transform("runs", lambda r: r["lo"]), F.array(F.size("lines")))
    between = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice("lines", a + 1, b - a)))
    kept = F.when(F.col("runs").isNull(), F.col(f"doc.`{text_col}`")).otherwise(F.array_join(between, "\n"))
    return cut.select(*[(kept if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in names], F.col("runs").alias(runs_col))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"))
    done = dedup(docs)
    deleted = F.aggregate(F.coalesce("_runs", F.expr("slice(_runs, 1, 0)")), F.lit(0), lambda n, r: n + r["hi"] - r["lo"] + 1)
    return done.select("doc_id", "n_lines", F.coalesce(deleted, F.lit(0)).alias("n_deleted"), F.col("_runs").alias("runs"), "text")
