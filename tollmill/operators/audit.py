"""Audit log: search, statistics and call traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollmill.functions.cleaning import shown_ratio
from tollmill.operators.filters import between_closed, either_key, where_opt
from tollmill.operators.ordering import page as page_of
from tollmill.operators.ordering import page_info
from tollmill.session import freeze


def search_audit(
    df: DataFrame, operation_type=None, endpoint=None, user_id=None, client_ip=None, start=None, end=None,
    is_success=None, trace_id=None, page: int = 1, per_page: int = 50,
) -> DataFrame:
    """One page of matching calls, newest first."""
    hits = audit_matches(df, operation_type, endpoint, user_id, client_ip, start, end, is_success, trace_id)
    return page_of(hits, [F.desc("created_at"), F.asc("id")], page, per_page)


def audit_matches(
    df: DataFrame, operation_type=None, endpoint=None, user_id=None, client_ip=None, start=None, end=None,
    is_success=None, trace_id=None,
) -> DataFrame:
    """All matching calls. ``endpoint`` and ``user_id`` match parts of the text; ``is_success`` may be text."""
    out = where_opt(df, operation_type=operation_type, client_ip=client_ip, trace_id=trace_id)
    if endpoint:
        out = out.filter(F.col("api_endpoint").contains(endpoint))
    if user_id:
        out = out.filter(F.col("user_id").contains(user_id))
    if is_success is not None:
        out = out.filter(F.col("is_success") == F.lit(str(is_success).lower() == "true"))
    return between_closed(out, "created_at", start, end)


def search_pages(df: DataFrame, page: int = 1, per_page: int = 50, **filters) -> DataFrame:
    return page_info(audit_matches(df, **filters), page, per_page)


def _ok() -> Column:
    return F.when(F.col("is_success"), 1)


def audit_totals(log: DataFrame, start=None, end=None) -> DataFrame:
    """Requests, success rate and mean response time, all over the same period."""
    rows = between_closed(log, "created_at", start, end)
    return rows.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count(_ok()).alias("success_requests"),
        F.coalesce(shown_ratio(F.count(_ok()), F.count(F.lit(1)), 2, 100), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg("response_time_ms"), F.lit(0.0)).alias("avg_response_time"),
    )


def endpoint_ranking(log: DataFrame, k: int = 10, start=None, end=None) -> DataFrame:
    time = "response_time_ms"
    return (
        between_closed(log, "created_at", start, end)
        .groupBy(F.col("api_endpoint").alias("endpoint"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.coalesce(shown_ratio(F.sum(time), F.count(time), 2), F.lit(0.0)).alias("avg_time"),
            shown_ratio(F.count(_ok()), F.count(F.lit(1)), 2, 100).alias("success_rate"),
        )
        .orderBy(F.desc("count"), F.asc("endpoint"))
        .limit(k)
    )


def user_activity(log: DataFrame, k: int = 10, start=None, end=None) -> DataFrame:
    return (
        between_closed(log, "created_at", start, end)
        .filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("request_count"), F.max("created_at").alias("last_active"))
        .orderBy(F.desc("request_count"), F.asc("user_id"))
        .limit(k)
    )


def hourly_requests(log: DataFrame, start=None, end=None) -> DataFrame:
    rows = between_closed(log, "created_at", start, end)
    return rows.groupBy(F.hour("created_at").alias("hour")).agg(F.count(F.lit(1)).alias("count")).orderBy("hour")


def trace_duration(log: DataFrame, trace_id=None) -> DataFrame:
    """Milliseconds from the first start to the last end of a trace, 0 while none has ended.

    With a ``trace_id`` the direct children count in; without one every trace id is
    measured over its own calls and the calls that name it as their parent.
    """
    spans = "created_at", "ended_at"
    if trace_id is not None:
        rows = either_key(log, "trace_id", "parent_trace_id", trace_id).withColumn("_trace", F.lit(trace_id))
    else:
        own = log.select(F.col("trace_id").alias("_trace"), *spans)
        foreign = F.col("parent_trace_id").isNotNull() & ~F.col("parent_trace_id").eqNullSafe(F.col("trace_id"))
        below = log.filter(foreign).select(F.col("parent_trace_id").alias("_trace"), *spans)
        rows = own.unionByName(below)
    spent = F.timestamp_diff("MILLISECOND", F.min("created_at"), F.max("ended_at"))
    return rows.groupBy(F.col("_trace").alias("trace_id")).agg(
        F.count(F.lit(1)).alias("total_calls"), F.coalesce(spent, F.lit(0)).alias("total_duration")
    )


def trace_calls(log: DataFrame, trace_id: str) -> DataFrame:
    """The calls of a trace and its direct children, oldest first."""
    return either_key(log, "trace_id", "parent_trace_id", trace_id).orderBy("created_at", "id")


def _reach(pairs: DataFrame, with_path: bool) -> DataFrame:
    """(node, top, depth, path): the roots above each id, by the shortest way, from pairs (node, up) of an id and its parent.

    Pairs without a parent are roots. Ways double in each round: ``far`` holds the ids that a node reaches in exactly 2^k
    steps, ``near`` the roots it reaches in fewer; a round puts both behind every way of ``far``. A root at 2^k steps or
    more has ids on its way that lie 2^k to 2^(k+1) - 1 steps below it, so the first round without a new root is the last,
    after about log2(depth) rounds, and circles end like everything else.
    """
    ways = lambda *cols: F.array(*cols) if with_path else F.lit(None).cast("array<string>")
    near = pairs.filter(F.col("up").isNull()).select("node", F.col("node").alias("top"), F.lit(0).alias("depth"), ways("node").alias("path"))
    far = pairs.filter(F.col("up").isNotNull()).select("node", F.col("up").alias("top"), F.lit(1).alias("depth"), ways("up", "node").alias("path"))

    def behind(ahead: DataFrame) -> DataFrame:
        first = ahead.select(F.col("node").alias("_at"), F.col("top").alias("_top"), F.col("depth").alias("_d"), F.col("path").alias("_p"))
        path = F.concat("_p", F.slice("path", F.lit(2), F.size("path"))) if with_path else F.col("path")
        met = far.join(first, F.col("top") == F.col("_at")).select("node", F.col("_top").alias("top"), (F.col("depth") + F.col("_d")).alias("depth"), path.alias("path"))
        shortest = met.groupBy("node", "top").agg(F.min(F.struct("depth", "path")).alias("w"))
        return shortest.select("node", "top", "w.depth", "w.path")

    while True:
        fresh = freeze(behind(near).join(near.select("node", "top"), ["node", "top"], "left_anti"))
        if fresh.isEmpty():
            return near
        far = freeze(behind(far))
        near = near.unionByName(fresh)


def _every_way(pairs: DataFrame) -> DataFrame:
    """(node, up, top, depth, path): all ways from the roots down to each pair (node, up), a step a round.

    A way takes no pair twice, so circles end; it may come to an id again by another pair. The number of ways is that of
    the result: ids that many calls share multiply it at each level.
    """
    step = F.struct("node", "up")
    level = pairs.filter(F.col("up").isNull()).select("node", "up", F.col("node").alias("top"), F.array("node").alias("path"), F.array(step).alias("taken"))
    edges, every = pairs.filter(F.col("up").isNotNull()), level
    while True:
        above = level.select(F.col("node").alias("up"), "top", "path", "taken")
        grown = edges.join(above, "up").filter(~F.array_contains("taken", step))
        level = freeze(grown.select("node", "up", "top", F.concat("path", F.array("node")).alias("path"), F.concat("taken", F.array(step)).alias("taken")))
        if level.isEmpty():
            return every.select("node", "up", "top", (F.size("path") - 1).alias("depth"), "path")
        every = every.unionByName(level)


def trace_ways(log: DataFrame) -> DataFrame:
    """Every call with all its ways from its roots: one row per call and way, with root, depth and path (of ids, from the root).

    Roots, circles and calls without an id are as in ``trace_tree``, which keeps the shortest of these ways for each root
    and does not list the others; calls that only circles reach come once, with root NULL.
    """
    calls = _with_up(log)
    pairs = freeze(calls.select(F.col("trace_id").alias("node"), F.col("_up").alias("up")).distinct())
    ways = _every_way(pairs).select(
        F.col("node").alias("_node"), F.col("up").alias("_above"), F.col("top").alias("root"), "depth", F.array_join("path", ">").alias("path")
    )
    placed = calls.join(ways, (F.col("trace_id") == F.col("_node")) & F.col("_up").eqNullSafe(F.col("_above")), "left")
    return placed.select(*log.columns, "root", "depth", "path")


def _with_up(log: DataFrame) -> DataFrame:
    """The calls that have an id, with ``_up``: their parent's id, NULL where that is not in the log or is their own."""
    calls = log.filter(F.col("trace_id").isNotNull())
    known = calls.select(F.col("trace_id").alias("_known")).distinct()
    calls = calls.join(known, F.col("parent_trace_id") == F.col("_known"), "left")
    return calls.withColumn("_up", F.when(F.col("_known") != F.col("trace_id"), F.col("_known"))).drop("_known")


def trace_tree(log: DataFrame, trace_id: str | None = None, with_path: bool = True) -> DataFrame:
    """Every call with its roots: one row per call and root, with depth and path (of ids, from the root) of the shortest way.

    A call without a parent, with itself as parent, or whose parent is not in the log, is a root; so an id that several
    calls share can be a root and a child at once, and a call can lie below another call of its own id. Of ways of one length the first in path order counts. Calls that only
    circles reach have no root: they come once, with root NULL. A requested trace starts its own tree wherever it hangs,
    and only that tree comes back. Sorted by path, the rows are the nested tree in reading order. Calls without an id
    are left out; without ``with_path`` the path is NULL. ``trace_ways`` lists all ways.
    """
    calls = _with_up(log)
    if trace_id is not None:
        calls = calls.withColumn("_up", F.when(F.col("trace_id") != trace_id, F.col("_up")))
    pairs = freeze(calls.select(F.col("trace_id").alias("node"), F.col("_up").alias("up")).distinct())
    if trace_id is not None:
        pairs = pairs.filter(F.col("up").isNotNull() | (F.col("node") == trace_id))
    above = _reach(pairs, with_path).select(F.col("node").alias("_node"), F.col("top").alias("_top"), F.col("depth").alias("_d"), F.col("path").alias("_p"))
    own = F.when(F.col("_up").isNull(), F.col("trace_id"))
    placed = calls.join(above, F.col("_up") == F.col("_node"), "left")
    path = F.when(F.col("_up").isNull(), F.col("trace_id")).otherwise(F.array_join(F.concat("_p", F.array("trace_id")), ">"))
    out = placed.select(
        *log.columns, F.coalesce(own, F.col("_top")).alias("root"), F.when(F.col("_up").isNull(), 0).otherwise(F.col("_d") + 1).alias("depth"),
        (path if with_path else F.lit(None).cast("string")).alias("path"),
    )
    return out if trace_id is None else out.filter(F.col("root") == trace_id)


def trace_summary(tree: DataFrame) -> DataFrame:
    """Calls and depth of each tree; calls in circles belong to none."""
    return tree.filter(F.col("root").isNotNull()).groupBy("root").agg(F.count(F.lit(1)).alias("total_calls"), F.max("depth").alias("max_depth"))
