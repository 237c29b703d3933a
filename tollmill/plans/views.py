"""The toll tables derived from the star-schema test tables, as DataFrames and as SQL text.

Both forms use integer arithmetic and CASE only, so any engine computes the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollmill.sources.readers import load


def _code(k: Column) -> Column:
    d = k % 10
    out = F.when(d == 0, "11")
    for digit, code in ((1, "12"), (2, "13"), (3, "14"), (4, "16"), (5, "2"), (6, "3"), (7, "22")):
        out = out.when(d == digit, code)
    return out.otherwise("1")


def _plus_minutes(ts: str, n: Column) -> Column:
    return F.timestamp_add("MINUTE", n.cast("int"), F.col(ts))


def _text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _gantry_id(key: str) -> Column:
    return F.concat(F.lit("GT"), F.lpad(_text(key), 8, "0")).alias("gantry_id")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


class TollViews:
    """Section, station, gantry, transactions and audit log over one directory of test tables."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.directory, name)

    def facts(self, name: str) -> DataFrame:
        """A large table. How it is split is a matter of the reader's settings."""
        return self.table(name)

    @cached_property
    def _section(self) -> DataFrame:
        side = F.when(F.col("n_regionkey") % 2 == 0, "G").otherwise("S")
        return self.table("nation").select(
            F.concat(side, _text(100 + F.col("n_regionkey")), F.lpad(_text("n_nationkey"), 7, "0")).alias("section_id"),
            F.col("n_name").alias("section_name"), F.col("n_nationkey").alias("nk"),
        )

    @cached_property
    def section(self) -> DataFrame:
        return self._section.select("section_id", "section_name")

    @cached_property
    def station(self) -> DataFrame:
        c = self.table("customer").join(self._section, F.col("c_nationkey") == F.col("nk"))
        bal = F.col("c_acctbal")
        return c.select(
            F.concat(F.lit("T"), F.lpad(_text("c_custkey"), 8, "0")).alias("toll_station_id"),
            F.col("c_name").alias("station_name"), "section_id", F.col("c_mktsegment").alias("station_type"),
            F.when(bal >= 0, "1").when(bal < -500, _null("string")).otherwise("0").alias("operation_status"),
        )

    @cached_property
    def _gantry(self) -> DataFrame:
        k = F.col("s_suppkey")
        s = self.table("supplier").join(self._section, F.col("s_nationkey") == F.col("nk"))
        return s.select(
            _gantry_id("s_suppkey"),
            F.col("s_name").alias("gantry_name"), "section_id", _text(1 + k % 3).alias("gantry_type"),
            F.when(k % 11 == 0, _null("string")).when(k % 13 == 0, "").otherwise(_text(2 + k % 4)).alias("lane_count"),
            "section_name",
        )

    @cached_property
    def gantry(self) -> DataFrame:
        return self._gantry.drop("section_name")

    @cached_property
    def gantry_map(self) -> DataFrame:
        return self._gantry.select("gantry_id", "section_id", "section_name")

    @cached_property
    def entrance(self) -> DataFrame:
        k = F.col("o_orderkey")
        o = self.facts("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return o.join(self._section, F.col("c_nationkey") == F.col("nk")).select(
            F.concat(F.lit("EN"), _text(k)).alias("entrance_transaction_id"),
            F.concat(F.lit("P"), _text(k)).alias("pass_id"), _code(k).alias("vehicle_class"),
            _plus_minutes("o_orderdate", (k * 7919) % 1440).alias("entrance_time"), "section_id", "section_name",
        )

    @cached_property
    def exit(self) -> DataFrame:
        k = F.col("o_orderkey")
        closed = self.facts("orders").filter(F.col("o_orderstatus") != "O")
        o = closed.join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        place = F.when(k % 7 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
        toll = F.col("o_totalprice").cast("decimal(12,2)")
        priority = F.col("o_orderpriority")
        return o.withColumn("_place", place).join(self._section, F.col("_place") == F.col("nk")).select(
            F.concat(F.lit("EX"), _text(k)).alias("exit_transaction_id"),
            F.concat(F.lit("P"), _text(k)).alias("pass_id"), _code(k).alias("vehicle_class"),
            _plus_minutes("o_orderdate", (k * 7919) % 1440 + 15 + (k * 31) % 346).alias("exit_time"),
            F.when(k % 9 == 0, "").when(k % 19 == 0, _null("string")).when(k % 23 == 0, "0")
            .otherwise(_text(2 + k % 5)).alias("axis_count"),
            F.when(k % 29 == 0, "0").when(k % 31 == 0, "").otherwise("18000").alias("total_limit"),
            F.when(k % 37 == 0, _null("string")).when(k % 41 == 0, "0.0")
            .otherwise(_text(8000 + (k * 53) % 14000)).alias("total_weight"),
            toll.alias("toll_money"),
            (toll * F.lit(0.95).cast("decimal(3,2)")).cast("decimal(12,2)").alias("real_money"),
            F.when(priority == "1-URGENT", "1").when(priority == "2-HIGH", "2").when(priority == "3-MEDIUM", "")
            .otherwise(_null("string")).alias("discount_type"),
            "section_id", "section_name",
        )

    @cached_property
    def gtx_named(self) -> DataFrame:
        """Gantry transactions with the name of their section."""
        o, p, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
        price = F.col("l_extendedprice") / 10
        at = (o * 31 + line * 977) % 1440
        late = F.when(p % 53 == 0, 600).otherwise(0)
        # table by table: the size of a stored table is known, that of a join of two is not
        rows = self.facts("lineitem").join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return rows.join(self._section, F.col("s_nationkey") == F.col("nk")).select(
            F.concat(F.lit("GX"), _text(o), F.lit("-"), _text(line)).alias("gantry_transaction_id"),
            _gantry_id("s_suppkey"), "section_id", _code(p).alias("vehicle_type"),
            _plus_minutes("l_shipdate", at).alias("transaction_time"),
            F.when(p % 101 == 0, _null("timestamp_ntz"))
            .otherwise(_plus_minutes("l_shipdate", at - 20 - p % 400 + late)).alias("entrance_time"),
            F.when(p % 53 == 0, 0).otherwise(F.floor(price).cast("int")).alias("pay_fee"),
            F.floor(price * F.col("l_discount")).cast("int").alias("discount_fee"),
            F.when(p % 59 == 0, "").otherwise(_text(F.floor("l_quantity").cast("int") * 2000)).alias("fee_mileage"),
            F.when(p % 6 == 0, "255").otherwise(_text(2 + p % 5)).alias("axle_count"),
            _text(1000 + (o * 97) % 60000).alias("total_weight"),
            F.when(F.col("l_returnflag") == "R", "1").otherwise("2").alias("media_type"),
            F.when(F.col("l_linestatus") == "F", "1").otherwise("2").alias("pass_state"),
            o.alias("ok"), "section_name",
        )

    @cached_property
    def gtx(self) -> DataFrame:
        return self.gtx_named.drop("section_name")

    @cached_property
    def even(self) -> DataFrame:
        """The reference half of the gantry transactions."""
        return self.gtx.filter(F.col("ok") % 2 == 0)

    @cached_property
    def odd(self) -> DataFrame:
        """The candidate half."""
        return self.gtx.filter(F.col("ok") % 2 == 1)

    @cached_property
    def audit(self) -> DataFrame:
        e = F.col("event_id")
        parent = e - e % 7 + F.floor((e % 7 - 1) / 2).cast("bigint")
        ms = F.floor("value").cast("int")
        return self.facts("events").select(
            e.alias("id"), F.col("ts").alias("created_at"), ms.alias("response_time_ms"),
            _text("user_id").alias("user_id"), F.concat(F.lit("/api/"), F.col("event_type")).alias("api_endpoint"),
            F.when(F.col("event_type") == "error", False).otherwise(True).alias("is_success"),
            F.col("props").alias("request_params"), F.concat(F.lit("tr"), _text(e)).alias("trace_id"),
            F.when(e % 7 == 0, _null("string")).otherwise(F.concat(F.lit("tr"), _text(parent))).alias("parent_trace_id"),
            F.timestamp_add("MILLISECOND", ms, F.col("ts")).alias("ended_at"),
        )


# --- the same views as SQL, for the check engine ----------------------------


def _vc(k: str) -> str:
    return (
        f"case {k} % 10 when 0 then '11' when 1 then '12' when 2 then '13' when 3 then '14' when 4 then '16' "
        f"when 5 then '2' when 6 then '3' when 7 then '22' else '1' end"
    )


def _pm(ts: str, n: str) -> str:
    return f"({ts} + ({n}) * interval 1 minute)"


_AT = "(l_orderkey * 31 + l_linenumber * 977) % 1440"

SQL_VIEWS = {
    "v_section": """
        select concat(case when n_regionkey % 2 = 0 then 'G' else 'S' end, cast(100 + n_regionkey as varchar),
                      lpad(cast(n_nationkey as varchar), 7, '0')) as section_id,
               n_name as section_name, n_nationkey as nk
        from nation""",
    "v_station": """
        select concat('T', lpad(cast(c_custkey as varchar), 8, '0')) as toll_station_id, c_name as station_name,
               section_id, c_mktsegment as station_type,
               case when c_acctbal >= 0 then '1' when c_acctbal < -500 then null else '0' end as operation_status
        from customer join v_section on c_nationkey = nk""",
    "v_gantry": """
        select concat('GT', lpad(cast(s_suppkey as varchar), 8, '0')) as gantry_id, s_name as gantry_name, section_id,
               cast(1 + s_suppkey % 3 as varchar) as gantry_type,
               case when s_suppkey % 11 = 0 then null when s_suppkey % 13 = 0 then ''
                    else cast(2 + s_suppkey % 4 as varchar) end as lane_count,
               section_name
        from supplier join v_section on s_nationkey = nk""",
    "v_entrance": f"""
        select concat('EN', cast(o_orderkey as varchar)) as entrance_transaction_id,
               concat('P', cast(o_orderkey as varchar)) as pass_id, {_vc('o_orderkey')} as vehicle_class,
               {_pm('o_orderdate', '(o_orderkey * 7919) % 1440')} as entrance_time, section_id, section_name
        from orders join customer on o_custkey = c_custkey join v_section on c_nationkey = nk""",
    "v_exit": f"""
        select concat('EX', cast(o_orderkey as varchar)) as exit_transaction_id,
               concat('P', cast(o_orderkey as varchar)) as pass_id, {_vc('o_orderkey')} as vehicle_class,
               {_pm('o_orderdate', '(o_orderkey * 7919) % 1440 + 15 + (o_orderkey * 31) % 346')} as exit_time,
               case when o_orderkey % 9 = 0 then '' when o_orderkey % 19 = 0 then null when o_orderkey % 23 = 0 then '0'
                    else cast(2 + o_orderkey % 5 as varchar) end as axis_count,
               case when o_orderkey % 29 = 0 then '0' when o_orderkey % 31 = 0 then '' else '18000' end as total_limit,
               case when o_orderkey % 37 = 0 then null when o_orderkey % 41 = 0 then '0.0'
                    else cast(8000 + (o_orderkey * 53) % 14000 as varchar) end as total_weight,
               cast(o_totalprice as decimal(12,2)) as toll_money,
               cast(cast(o_totalprice as decimal(12,2)) * cast(0.95 as decimal(3,2)) as decimal(12,2)) as real_money,
               case o_orderpriority when '1-URGENT' then '1' when '2-HIGH' then '2' when '3-MEDIUM' then ''
                    else null end as discount_type,
               section_id, section_name
        from orders join customer on o_custkey = c_custkey
             join v_section on nk = case when o_orderkey % 7 = 0 then (c_nationkey + 1) % 25 else c_nationkey end
        where o_orderstatus <> 'O'""",
    "v_gtx": f"""
        select concat('GX', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as gantry_transaction_id,
               gantry_id, section_id, {_vc('l_partkey')} as vehicle_type, {_pm('l_shipdate', _AT)} as transaction_time,
               case when l_partkey % 101 = 0 then null
                    else {_pm('l_shipdate', _AT + ' - 20 - l_partkey % 400 + case when l_partkey % 53 = 0 then 600 else 0 end')}
                    end as entrance_time,
               case when l_partkey % 53 = 0 then 0 else cast(floor(l_extendedprice / 10) as int) end as pay_fee,
               cast(floor(l_extendedprice / 10 * l_discount) as int) as discount_fee,
               case when l_partkey % 59 = 0 then '' else cast(cast(floor(l_quantity) as int) * 2000 as varchar) end as fee_mileage,
               case when l_partkey % 6 = 0 then '255' else cast(2 + l_partkey % 5 as varchar) end as axle_count,
               cast(1000 + (l_orderkey * 97) % 60000 as varchar) as total_weight,
               case l_returnflag when 'R' then '1' else '2' end as media_type,
               case l_linestatus when 'F' then '1' else '2' end as pass_state, l_orderkey as ok, section_name
        from lineitem join v_gantry on gantry_id = concat('GT', lpad(cast(l_suppkey as varchar), 8, '0'))""",
    "v_audit": """
        select event_id as id, ts as created_at, cast(floor(value) as int) as response_time_ms,
               cast(user_id as varchar) as user_id, concat('/api/', event_type) as api_endpoint,
               case when event_type = 'error' then false else true end as is_success, props as request_params,
               concat('tr', cast(event_id as varchar)) as trace_id,
               case when event_id % 7 = 0 then null
                    else concat('tr', cast(event_id - event_id % 7 + cast(floor((event_id % 7 - 1) / 2) as bigint) as varchar))
                    end as parent_trace_id,
               ts + cast(floor(value) as int) * interval 1 millisecond as ended_at
        from events""",
}

_NEEDS = {
    "v_station": ["v_section"], "v_gantry": ["v_section"], "v_entrance": ["v_section"], "v_exit": ["v_section"],
    "v_gtx": ["v_section", "v_gantry"],
}


def with_views(body: str, recursive: bool = False) -> str:
    """The statement with the view definitions it uses in front."""
    used: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in used:
            used.append(name)

    for name in SQL_VIEWS:
        if name in body:
            add(name)
    defs = ", ".join(f"{n} as ({SQL_VIEWS[n]})" for n in used)
    text = body.strip()
    if not defs:
        return text
    word = "with recursive " if recursive else "with "
    if text.lower().startswith("with "):
        return f"{word}{defs}, {text[5:]}"
    return f"{word}{defs} {text}"
