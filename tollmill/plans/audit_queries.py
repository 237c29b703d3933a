"""Audit log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollmill.functions import text as X
from tollmill.operators import audit as U
from tollmill.operators import filters as R
from tollmill.operators import relational as J
from tollmill.plans.registry import moment, query, six, sql_moment, sql_shown

START, END = "2024-01-03", "2024-01-12"


_OK = "count(case when is_success then 1 end)"


@query("a17_audit_totals", f"""
    select count(*) as total_requests, count(case when is_success then 1 end) as success_requests,
           {sql_shown(_OK, 'count(*)', 2, 100)} as success_rate,
           avg(response_time_ms) as avg_response_time
    from v_audit""")
def a17(v):
    return U.audit_totals(v.audit)


@query("a18_endpoint_ranking", f"""
    select api_endpoint as endpoint, count(*) as count, {sql_shown('sum(response_time_ms)', 'count(response_time_ms)', 2)} as avg_time,
           {sql_shown(_OK, 'count(*)', 2, 100)} as success_rate
    from v_audit group by 1 order by 2 desc, 1 limit 10""")
def a18(v):
    return U.endpoint_ranking(v.audit)


@query("a19_user_activity", f"""
    select user_id, count(*) as request_count, {sql_moment('max(created_at)')} as last_active
    from v_audit where user_id is not null group by 1 order by 2 desc, 1 limit 10""")
def a19(v):
    return U.user_activity(v.audit).withColumn("last_active", moment("last_active"))


@query("a20_hourly_requests", "select cast(hour(created_at) as int) as hour, count(*) as count from v_audit group by 1")
def a20(v):
    return U.hourly_requests(v.audit)


@query("a21_trace_duration", """
    with spans as (
      select trace_id, created_at, ended_at from v_audit
      union all select parent_trace_id, created_at, ended_at from v_audit
                where parent_trace_id is not null and parent_trace_id is distinct from trace_id)
    select trace_id, count(*) as total_calls,
           coalesce(date_sub('millisecond', min(created_at), max(ended_at)), 0) as total_duration
    from spans group by 1""")
def a21(v):
    return U.trace_duration(v.audit)


@query("a21_single_trace_duration", """
    select 'tr21' as trace_id, count(*) as total_calls,
           coalesce(date_sub('millisecond', min(created_at), max(ended_at)), 0) as total_duration
    from v_audit where trace_id = 'tr21' or parent_trace_id = 'tr21'""")
def a21_single(v):
    return U.trace_duration(v.audit, "tr21")


_TREE = """
    with recursive tree as (
      select id, trace_id, trace_id as root, 0 as depth, trace_id as path from v_audit where parent_trace_id is null
      union all
      select c.id, c.trace_id, t.root, t.depth + 1, t.path || '>' || c.trace_id
      from v_audit c join tree t on c.parent_trace_id = t.trace_id and c.id <> t.id)"""


def _recursive(body: str) -> str:
    """The recursive definition goes after the views it reads."""
    return body.replace("with recursive tree", "with tree")


@query("a43_trace_tree", _recursive(_TREE) + " select id, trace_id, root, depth, path from tree", recursive=True)
def a43(v):
    return U.trace_tree(v.audit).select("id", "trace_id", "root", "depth", "path")


@query("a43_trace_summary", _recursive(_TREE) + """
    select root, count(*) as total_calls, max(depth) as max_depth from tree group by 1""", recursive=True)
def a43_summary(v):
    return U.trace_summary(U.trace_tree(v.audit, with_path=False))


# twelve calls on four ids: ids are shared, a call is a root and a child at once, one names itself as parent, and two pairs
# of ids form circles
_SHARED_PARENT = """case id % 12 when 2 then 3 when 3 then 0 when 4 then 0 when 5 then 3 when 6 then 3 when 7 then 0 when 8 then 9
                               when 9 then 6 when 10 then 6 when 11 then 3 end"""
_SHARED = f"""s as (select id, concat('tr', cast(id - id % 3 as varchar)) as trace_id,
                     concat('tr', nullif(cast(id - id % 12 + {_SHARED_PARENT} as varchar), '')) as up, {_SHARED_PARENT} as p from v_audit)"""
_SHARED_TREE = f"""
    with {_SHARED}, c as (select id, trace_id, case when p is not null and up <> trace_id then up end as up from s),
    e as (select distinct trace_id as node, up from c),
    tree as (
      select node, up, node as root, 0 as depth, node as path, [node] as nodes, [node] as seen from e where up is null
      union all
      select e.node, e.up, t.root, t.depth + 1, t.path || '>' || e.node, list_append(t.nodes, e.node), list_append(t.seen, e.node || '<' || e.up)
      from e join tree t on e.up = t.node and not list_contains(t.seen, e.node || '<' || e.up)),
    ways as (select c.id, root, depth, path, row_number() over (partition by c.id, root order by depth, nodes) as way
             from c join tree on c.trace_id = tree.node and c.up is not distinct from tree.up),
    rows as (select c.id, c.trace_id, root, depth, path from c left join ways on c.id = ways.id and way = 1)"""


def _shared(v):
    base = F.col("id") - F.col("id") % 12
    parent = F.expr(_SHARED_PARENT)
    return v.audit.select(
        "id", F.concat(F.lit("tr"), (F.col("id") - F.col("id") % 3).cast("string")).alias("trace_id"),
        F.concat(F.lit("tr"), (base + parent).cast("string")).alias("parent_trace_id"),
    )


@query("a43_trace_tree_shared", _SHARED_TREE + """
    select c.id, c.trace_id, root, depth, path from c left join tree on c.trace_id = tree.node and c.up is not distinct from tree.up""", recursive=True)
def a43_shared(v):
    return U.trace_ways(_shared(v)).select("id", "trace_id", "root", "depth", "path")


@query("a43_trace_summary_shared", _SHARED_TREE + """
    select root, count(*) as total_calls, max(depth) as max_depth from rows where root is not null group by 1""", recursive=True)
def a43_summary_shared(v):
    return U.trace_summary(U.trace_tree(_shared(v), with_path=False))


@query("j8_parent_child", """
    select c.id as child_id, p.id as parent_id, c.trace_id as child_trace_id, c.parent_trace_id
    from v_audit c join v_audit p on c.parent_trace_id = p.trace_id and c.id <> p.id""")
def j8(v):
    return J.parent_child(v.audit)


@query("f7_substring_match", "select id, api_endpoint from v_audit where contains(api_endpoint, 'sign')")
def f7(v):
    return R.contains(v.audit, "api_endpoint", "sign").select("id", "api_endpoint")


@query("f8_boolean_from_text", "select id from v_audit where is_success = (lower('FALSE') = 'true')")
def f8(v):
    return U.audit_matches(v.audit, is_success="FALSE").select("id")


@query("f9_either_key", "select id from v_audit where trace_id = 'tr700' or parent_trace_id = 'tr700'")
def f9(v):
    return R.either_key(v.audit, "trace_id", "parent_trace_id", "tr700").select("id")


_PATHS = """case id % 7 when 0 then '/api/audit/logs' when 1 then '/static/app.js' when 2 then '/api/health'
                   when 3 then '/dashboard' when 4 then '/api/agent/query' when 5 then '/api/ai/sql'
                   else api_endpoint end"""


def _paths(v):
    path = F.expr(_PATHS)
    method = F.when(F.col("id") % 5 == 0, "OPTIONS").when(F.col("id") % 5 == 1, "POST").otherwise("GET")
    return v.audit.select("id", path.alias("api_endpoint"), method.alias("http_method"))


_PATH_ROWS = f"""select id, {_PATHS} as path,
    case id % 5 when 0 then 'OPTIONS' when 1 then 'POST' else 'GET' end as method from v_audit"""


@query("f10_audit_scope", f"""
    with p as ({_PATH_ROWS})
    select id, path as api_endpoint, method as http_method from p
    where starts_with(path, '/api/') and not starts_with(path, '/api/audit/')
      and path not in ('/api/health', '/api/list', '/api/test/connection') and method <> 'OPTIONS'""")
def f10(v):
    return R.audit_scope(_paths(v))


@query("f12_search_audit", f"""
    select id, {sql_moment('created_at')} as created_at, user_id, api_endpoint from v_audit
    where contains(api_endpoint, 'view') and contains(user_id, '1') and created_at >= timestamp '{START}'
      and created_at <= timestamp '{END}' and is_success
    order by v_audit.created_at desc, id limit 50 offset 50""")
def f12(v):
    hits = U.search_audit(
        v.audit, endpoint="view", user_id="1", start=START, end=END, is_success="true", page=2, per_page=50
    )
    return hits.select("id", moment("created_at").alias("created_at"), "user_id", "api_endpoint")


@query("l3_pages", """
    select 2 as page, 50 as per_page, count(*) as total, cast(ceil(count(*) / 50.0) as bigint) as pages
    from v_audit where contains(api_endpoint, 'view')""")
def l3(v):
    return U.search_pages(v.audit, 2, 50, endpoint="view")


@query("c15_truncate_text", """
    select doc_id, case when length(text) > 500 then left(text, 500) || '...[TRUNCATED]' else text end as short,
           length(case when length(text) > 1000 then left(text, 950) || '... [TRUNCATED]' else text end) as summary_length
    from documents""")
def c15(v):
    t = F.col("text")
    return v.table("documents").select(
        "doc_id", X.truncate_text(t, 500).alias("short"),
        F.length(X.truncate_text(t, 1000, "... [TRUNCATED]", keep=950)).alias("summary_length"),
    )


_BODY = """case when id % 3 = 0 then concat('{"success": true, "count": ', cast(response_time_ms as {t}), ', "total": 10, "data": [', cast(id as {t}), ',2,3]}')
                when id % 3 = 1 then concat('{"success": false, "error": "', api_endpoint, ' failed"}')
                else request_params end"""


@query("c16_response_summary", f"""
    with b as (select id, {_BODY.replace('{t}', 'varchar')} as body from v_audit)
    select id, json_extract_string(body, '$.success') as success,
           json_extract_string(body, '$.count') as count,
           json_extract_string(body, '$.total') as total,
           cast(case when json_type(body, '$.data') = 'ARRAY' then json_array_length(body, '$.data') end as varchar) as data_count,
           left(json_extract_string(body, '$.error'), 200) as error
    from b""")
def c16(v):
    body = F.expr(_BODY.replace("{t}", "string"))
    s = X.response_summary(body)
    return v.audit.select(
        "id", *[s[c].cast("string").alias(c) for c in ("success", "count", "total", "data_count", "error")]
    )


@query("c17_decode_json", """
    with r as (select id, case when id % 4 = 0 then api_endpoint else request_params end as raw from v_audit)
    select id, case when json_valid(raw) then cast(json(raw) as varchar)
                    else concat('{"_raw":"', raw, '"}') end as decoded from r""")
def c17(v):
    raw = F.when(F.col("id") % 4 == 0, F.col("api_endpoint")).otherwise(F.col("request_params"))
    return v.audit.select("id", F.to_json(X.decode_json(raw)).alias("decoded"))


@query("c18_operation_type", f"""
    with p as ({_PATH_ROWS})
    select id, case when contains(path, '/api/agent/query') then 'AGENT_QUERY'
                    when contains(path, '/api/ai/sql') then 'AI_SQL_QUERY'
                    when contains(path, '/api/agent/smart-query') then 'SMART_QUERY' else 'API_CALL' end as operation_type
    from p""")
def c18(v):
    return _paths(v).select("id", X.operation_type(F.col("api_endpoint")).alias("operation_type"))


@query("c19_success_and_elapsed", """
    select id, 200 <= 100 + id % 500 and 100 + id % 500 < 400 as is_success,
           date_sub('millisecond', created_at, ended_at) as elapsed_ms from v_audit""")
def c19(v):
    return v.audit.select(
        "id", X.is_success(100 + F.col("id") % 500).alias("is_success"),
        X.elapsed_ms(F.col("created_at"), F.col("ended_at")).alias("elapsed_ms"),
    )


@query("p2_row_json", """
    select id, cast(to_json({'id': id, 'user_id': user_id, 'api_endpoint': api_endpoint, 'is_success': is_success}) as varchar) as document
    from v_audit""")
def p2(v):
    return v.audit.select("id", X.row_json("id", "user_id", "api_endpoint", "is_success").alias("document"))


@query("pv3_mask_key", """
    select id, 'api_key:' || left(md5(user_id), 8) || '...' as user_label from v_audit""")
def pv3(v):
    return v.audit.select("id", X.mask_key(F.md5("user_id")).alias("user_label"))
