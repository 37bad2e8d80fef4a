"""The queries registered for the driver, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.database import Database

from . import api

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Case(NamedTuple):
    """A query of the dialect with its arguments, and the same in DuckDB's SQL."""

    sql: str
    oracle: str
    args: tuple = ()
    named: dict[str, Any] = {}
    prepared: bool = False


def database(spark: SparkSession, sf_dir: str, sql: str) -> Database:
    """A database with the tables that a query names."""
    db = Database(spark)
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            db.register_parquet(name, f"{sf_dir}/{name}.parquet")
    if "event_props" in sql:
        raw = spark.read.parquet(f"{sf_dir}/events.parquet")
        db.register("event_props", raw.select("event_id", F.from_json("props", "struct<k:bigint>").alias("props"), F.from_json("props", "map<string,bigint>").alias("entries"), F.parse_json("props").alias("any")))
    if "page_rows" in sql:
        db.register("page_rows", page_rows(spark))
    if "mixed_events" in sql:
        db.register("mixed_events", mixed_events(spark, sf_dir))
    db.register_function("prefix", 1, 1, "string", eval=lambda s: None if s is None else "x-" + s)
    db.register_function("shout", 1, 1, "string", native=lambda s: f"upper({s})")
    return db


# The generator and the three query shapes of the published micro-benchmark.
PAGE_ROWS = 20_000
PAGES = (
    "select * from page_rows where featured = true and draft = false and section = 'posts' order by updated desc limit 20",
    "select distinct section from page_rows order by section asc",
    "select section, count(distinct views) as n from page_rows where draft = false group by section order by section asc",
)


def page_rows(spark: SparkSession) -> DataFrame:
    """The micro-benchmark's table."""
    section = "element_at(array('posts', 'notes', 'docs'), int(id % 3) + 1) AS section"
    updated = "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, int(id)) AS updated"
    return spark.range(PAGE_ROWS).selectExpr("id + 1 AS id", "concat('Page ', id + 1) AS title", section, "id % 9 = 0 AS featured", "id % 11 = 0 AS draft", updated, "7 * id % 1000 AS views")


_PAGE_SQL = f"(select i + 1 as id, 'Page ' || (i + 1) as title, (['posts', 'notes', 'docs'])[i % 3 + 1] as section, i % 9 = 0 as featured, i % 11 = 0 as draft, timestamp '2026-01-01 00:00:00' + to_minutes(i) as updated, 7 * i % 1000 as views from range({PAGE_ROWS}) t(i))"


def mixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a dynamic column: whole numbers, floats, text, truth and lists in turn (kind 0 to 4)."""
    value = """CASE event_id % 5 WHEN 0 THEN string(user_id) WHEN 1 THEN concat(user_id, '.5') WHEN 2 THEN concat('"u', user_id, '"')
        WHEN 3 THEN IF(user_id % 2 = 0, 'true', 'false') ELSE concat('[', user_id, ',"a",', user_id, '.5]') END"""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id", "event_id % 5 AS kind", f"parse_json({value}) AS v")


def run(spark: SparkSession, sf_dir: str, case: Case) -> DataFrame:
    db = database(spark, sf_dir, case.sql)
    if case.prepared:
        return db.prepare(case.sql).query(db, *case.args, **case.named).df
    return db.query(case.sql, *case.args, **case.named).df


LEFT = "from orders o left join customer c on o.o_custkey = c.c_custkey and c.c_nationkey < 10"
CASES: dict[str, Case] = {
    "q_first": Case("select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'R' order by l_orderkey asc, l_linenumber asc limit 20", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'R' order by 1, 2 limit 20"),
    "q_project_arith": Case("select o_orderkey, o_custkey * 2 + 1 as a, -o_custkey as b, o_orderkey / 7 as c, -o_orderkey / 7 - 3 as d from orders", "select o_orderkey, o_custkey * 2 + 1 as a, -o_custkey as b, o_orderkey // 7 as c, -o_orderkey // 7 - 3 as d from orders"),
    "q_wildcard": Case("select *, n_nationkey as again from nation", "select *, n_nationkey as again from nation"),
    "q_float_args": Case("select l_orderkey, l_linenumber, l_extendedprice * (@one - l_discount) as rev from lineitem where l_quantity > ?", "select l_orderkey, l_linenumber, l_extendedprice * (1.0::double - l_discount) as rev from lineitem where l_quantity > 24", (24.0,), {"one": 1.0}),
    "q_float_divide": Case("select l_orderkey, l_linenumber, l_extendedprice / l_quantity as price from lineitem", "select l_orderkey, l_linenumber, l_extendedprice / l_quantity as price from lineitem"),
    "q_no_promotion": Case("select l_orderkey from lineitem where l_quantity > 24", "select l_orderkey from lineitem where false"),
    "q_filter_and_or_not": Case("select o_orderkey from orders where (o_orderstatus = 'F' or o_orderpriority != '1-URGENT') and not o_custkey < 50", "select o_orderkey from orders where (o_orderstatus = 'F' or o_orderpriority <> '1-URGENT') and not o_custkey < 50"),
    "q_in": Case("select o_orderkey from orders where o_orderstatus in ('F', 'P')", "select o_orderkey from orders where o_orderstatus in ('F', 'P')"),
    "q_not_in": Case("select o_orderkey from orders where o_orderstatus not in ('F', 'P')", "select o_orderkey from orders where o_orderstatus not in ('F', 'P')"),
    "q_in_null": Case("select o_orderkey, o_orderstatus in ('F', null) as a, o_orderstatus not in ('F', null) as b from orders", "select o_orderkey, o_orderstatus = 'F' as a, o_orderstatus <> 'F' as b from orders"),
    "q_in_subquery_item": Case("select o_orderkey from orders where o_custkey in ((select max(c_custkey) from customer), 7)", "select o_orderkey from orders where o_custkey in ((select max(c_custkey) from customer), 7)"),
    "q_is_null": Case(f"select o.o_orderkey, c.c_name is null as missing {LEFT} where c.c_custkey is null or c.c_mktsegment is not null", f"select o.o_orderkey, c.c_name is null as missing {LEFT}"),
    "q_is_expr": Case("select n_name, n_regionkey is 2 as a, n_regionkey is not n_nationkey as b from nation", "select n_name, n_regionkey = 2 as a, n_regionkey is distinct from n_nationkey as b from nation"),
    "q_two_valued_not": Case(f"select o.o_orderkey {LEFT} where not c.c_mktsegment = 'BUILDING'", f"select o.o_orderkey {LEFT} where not coalesce(c.c_mktsegment = 'BUILDING', false)"),
    "q_inner": Case("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'"),
    "q_left": Case(f"select o.o_orderkey, c.c_name {LEFT}", f"select o.o_orderkey, c.c_name {LEFT}"),
    "q_right": Case("select o.o_orderkey, c.c_custkey from orders o right join customer c on o.o_custkey = c.c_custkey and o.o_orderstatus = 'P'", "select o.o_orderkey, c.c_custkey from orders o right join customer c on o.o_custkey = c.c_custkey and o.o_orderstatus = 'P'"),
    "q_cross": Case("select n_name, r_name from nation, region", "select n_name, r_name from nation, region"),
    "q_theta": Case("select n.n_name, r.r_name from nation n join region r on n.n_regionkey < r.r_regionkey", "select n.n_name, r.r_name from nation n join region r on n.n_regionkey < r.r_regionkey"),
    "q_selfjoin": Case("select a.n_name as x, b.n_name as y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", "select a.n_name as x, b.n_name as y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey"),
    "q_multi": Case(
        "select r_name, count(*) as n, count(distinct o_custkey) as customers from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where l_returnflag = 'R' group by r_name",
        "select r_name, count(*) as n, count(distinct o_custkey) as customers from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where l_returnflag = 'R' group by r_name",
    ),
    "q_derived": Case("select c.c_name, t.n from customer c join (select o_custkey, count(*) as n from orders group by o_custkey) as t on t.o_custkey = c.c_custkey", "select c.c_name, t.n from customer c join (select o_custkey, count(*) as n from orders group by o_custkey) as t on t.o_custkey = c.c_custkey"),
    "q_group_all": Case(
        "select l_returnflag, l_linestatus, count(*) as n, sum(l_linenumber) as s, avg(l_linenumber) as a, min(l_quantity) as lo, max(l_shipdate) as hi from lineitem group by l_returnflag, l_linestatus",
        "select l_returnflag, l_linestatus, count(*) as n, cast(sum(l_linenumber) as bigint) as s, avg(l_linenumber) as a, min(l_quantity) as lo, max(l_shipdate) as hi from lineitem group by l_returnflag, l_linestatus",
    ),
    "q_global": Case("select count(*) as n, sum(o_custkey) as s, max(o_orderdate) as d from orders where o_orderkey < 0", "select count(*) as n, cast(sum(o_custkey) as bigint) as s, max(o_orderdate) as d from orders where o_orderkey < 0"),
    "q_count_distinct": Case("select l_returnflag, count(distinct l_suppkey) as n from lineitem group by l_returnflag", "select l_returnflag, count(distinct l_suppkey) as n from lineitem group by l_returnflag"),
    "q_sum_avg_distinct": Case("select sum(distinct p_size) as s, avg(distinct p_size) as a, min(distinct p_size) as lo from part", "select cast(sum(distinct p_size) as bigint) as s, avg(distinct p_size) as a, min(p_size) as lo from part"),
    "q_group_null": Case(f"select c.c_mktsegment, count(*) as n {LEFT} group by c.c_mktsegment", f"select c.c_mktsegment, count(*) as n {LEFT} group by c.c_mktsegment"),
    "q_having": Case("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and max(o_orderstatus) = 'P'", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and max(o_orderstatus) = 'P'"),
    "q_having_alone": Case("select max(n_name) as n from nation having count(*) > 100", "select max(n_name) as n from nation having count(*) > 100"),
    "q_agg_expr": Case("select o_orderstatus, sum(o_custkey) / count(*) as m, len(min(o_orderpriority)) as l from orders group by o_orderstatus", "select o_orderstatus, cast(sum(o_custkey) // count(*) as bigint) as m, strlen(min(o_orderpriority)) as l from orders group by o_orderstatus"),
    "q_group_by_expr": Case("select o_custkey / 100 as bucket, count(*) as n from orders group by o_custkey / 100", "select o_custkey // 100 as bucket, count(*) as n from orders group by 1"),
    "q_agg_order": Case("select o_custkey, count(*) as n from orders group by o_custkey order by count(*) desc, o_custkey asc limit 10", "select o_custkey, count(*) as n from orders group by o_custkey order by n desc, o_custkey limit 10"),
    "q_minmax_types": Case("select min(o_orderpriority) as a, max(o_orderdate) as b, min(o_totalprice) as c from orders", "select min(o_orderpriority) as a, max(o_orderdate) as b, min(o_totalprice) as c from orders"),
    "q_distinct": Case("select distinct l_returnflag, l_linestatus from lineitem", "select distinct l_returnflag, l_linestatus from lineitem"),
    "q_distinct_order_other": Case("select distinct l_returnflag from lineitem order by l_orderkey desc limit 3", "select l_returnflag from lineitem group by 1 order by max(l_orderkey) desc limit 3"),
    "q_sort_multi": Case("select p_brand, p_size, p_partkey from part order by p_brand desc, p_size, p_partkey limit 100", "select p_brand, p_size, p_partkey from part order by p_brand desc, p_size, p_partkey limit 100"),
    "q_topn": Case("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 7", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 7"),
    "q_limit_arg": Case("select o_orderkey from orders order by o_orderkey limit @n", "select o_orderkey from orders order by o_orderkey limit 5", (), {"n": 5}),
    "q_order_alias": Case("select -o_orderkey as o_orderkey from orders order by o_orderkey limit 5", "select -o_orderkey as o_orderkey from orders order by 1 limit 5"),
    "q_order_const": Case("select n_name, n_nationkey from nation order by 1, n_nationkey desc limit 4", "select n_name, n_nationkey from nation order by n_nationkey desc limit 4"),
    "q_order_nulls": Case("select r.r_name, n.n_name from region r left join nation n on n.n_regionkey = r.r_regionkey and n.n_nationkey < 3 order by n.n_name desc, r.r_name limit 4", "select r.r_name, n.n_name from region r left join nation n on n.n_regionkey = r.r_regionkey and n.n_nationkey < 3 order by n.n_name desc nulls last, r.r_name limit 4"),
    "q_scalar_uncorr": Case("select p_partkey from part where p_retailprice = (select max(p_retailprice) from part)", "select p_partkey from part where p_retailprice = (select max(p_retailprice) from part)"),
    "q_scalar_corr": Case("select c_custkey, (select max(o_orderkey) from orders where o_custkey = c_custkey) as last_order from customer", "select c_custkey, (select max(o_orderkey) from orders where o_custkey = c_custkey) as last_order from customer"),
    "q_corr_nonequi": Case("select a.n_name, (select min(b.n_name) from nation b where b.n_nationkey > a.n_nationkey) as m from nation a", "select a.n_name, (select min(b.n_name) from nation b where b.n_nationkey > a.n_nationkey) as m from nation a"),
    "q_corr_count": Case("select c_custkey, (select count(*) from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P') as n from customer c", "select c_custkey, (select count(*) from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P') as n from customer c"),
    "q_sub_where": Case("select o_orderkey from orders o where o.o_totalprice > (select avg(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey) and o.o_orderstatus = 'F'", "select o_orderkey from orders o where o.o_totalprice > (select avg(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey) and o.o_orderstatus = 'F'"),
    "q_sub_having": Case("select n_regionkey, count(*) as n from nation group by n_regionkey having count(*) >= (select count(*) from region)", "select n_regionkey, count(*) as n from nation group by n_regionkey having count(*) >= (select count(*) from region)"),
    "q_sub_order": Case("select n_name from nation n order by (select r.r_name from region r where r.r_regionkey = n.n_regionkey) desc, n_name limit 6", "select n_name from nation join region on r_regionkey = n_regionkey order by r_name desc, n_name limit 6"),
    "q_sub_aggselect": Case("select n.n_regionkey, (select r.r_name from region r where r.r_regionkey = n.n_regionkey) as r, count(*) as n from nation n group by n.n_regionkey", "select n_regionkey, r_name as r, count(*) as n from nation join region on r_regionkey = n_regionkey group by 1, 2"),
    "q_sub_on": Case("select n.n_name, r.r_name from nation n join region r on r.r_regionkey = (select max(x.r_regionkey) from region x where x.r_regionkey <= n.n_nationkey)", "select n.n_name, r.r_name from nation n join region r on r.r_regionkey = least(n.n_nationkey, 4)"),
    "q_unnest_inner": Case("select e.label, count(*) as n, max(x.value) as hi from embeddings e join unnest(e.embedding) x on true group by e.label", "select label, count(*) as n, max(v) as hi from (select label, unnest(embedding) as v from embeddings) group by label"),
    "q_unnest_left": Case("select e.vec_id, x.value from embeddings e left join unnest(e.embedding) x on x.value > ?", "select e.vec_id, x.v as value from embeddings e left join (select vec_id, unnest(embedding) as v from embeddings) x on x.vec_id = e.vec_id and x.v > 0.25", (0.25,)),
    "q_unnest_group": Case("select x.value is null as none, count(*) as n from embeddings e left join unnest(e.embedding) x on x.value > ? group by x.value is null", "select x.v is null as none, count(*) as n from embeddings e left join (select vec_id, unnest(embedding) as v from embeddings) x on x.vec_id = e.vec_id and x.v > 0.3 group by 1", (0.3,)),
    "q_unnest_arg": Case("select n.n_name, k.value from nation n join unnest(?) k on k.value = n.n_nationkey", "select n_name, cast(n_nationkey as bigint) as value from nation where n_nationkey in (1, 3, 5)", ([1, 3, 5, 99],)),
    "q_len": Case("select doc_id, len(text) as n from documents", "select doc_id, strlen(text) as n from documents"),
    "q_len_array": Case("select vec_id, len(embedding) as n from embeddings", "select vec_id, len(embedding) as n from embeddings"),
    "q_contains_str": Case("select p_partkey, contains(p_name, 'a') as a from part where contains(p_type, 'S')", "select p_partkey, contains(p_name, 'a') as a from part where contains(p_type, 'S')"),
    "q_contains_arr": Case("select n_name from nation where contains(?, n_name)", "select n_name from nation where n_name in ('FRANCE', 'CHINA', 'NATION_3')", (["FRANCE", "CHINA", "NATION_3"],)),
    "q_nested_path": Case("select event_id, p.props.k as k from event_props p where props.k > 50", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where cast(json_extract(props, '$.k') as bigint) > 50"),
    "q_map_path": Case("select event_id, entries.k as k, entries.other as o from event_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(null as bigint) as o from events"),
    "q_any_path": Case("select event_id from event_props e where e.any.k = 7", "select event_id from events where cast(json_extract(props, '$.k') as bigint) = 7"),
    "q_udf": Case("select n_nationkey, prefix(n_name) as a, shout(n_name) as b from nation", "select n_nationkey, 'x-' || n_name as a, upper(n_name) as b from nation"),
    "q_named_args": Case("select o_orderkey, @label as label from orders where o_custkey = @who and o_orderstatus != ?", "select o_orderkey, 'chosen' as label from orders where o_custkey = 10 and o_orderstatus <> 'F'", ("F",), {"label": "chosen", "who": 10}),
    "q_prepared": Case("select event_type, count(*) as n from events where user_id > ? group by event_type", "select event_type, count(*) as n from events where user_id > 20 group by event_type", (20,), {}, True),
    "q_bench_filter_topn": Case("select l_orderkey, l_linenumber, l_shipdate from lineitem where l_returnflag = 'N' and l_linestatus = 'O' and l_linenumber = 1 order by l_shipdate desc, l_orderkey limit 20", "select l_orderkey, l_linenumber, l_shipdate from lineitem where l_returnflag = 'N' and l_linestatus = 'O' and l_linenumber = 1 order by l_shipdate desc, l_orderkey limit 20"),
    "q_bench_distinct": Case("select distinct event_type from events order by event_type asc", "select distinct event_type from events"),
    "q_bench_group_distinct": Case("select event_type, count(distinct user_id) as n from events where event_id > 10 group by event_type order by event_type asc", "select event_type, count(distinct user_id) as n from events where event_id > 10 group by event_type"),
    "q_pages_filter_topn": Case(PAGES[0], f"select * from {_PAGE_SQL} where featured and not draft and section = 'posts' order by updated desc limit 20"),
    "q_pages_filter_topn_prepared": Case(PAGES[0], f"select * from {_PAGE_SQL} where featured and not draft and section = 'posts' order by updated desc limit 20", prepared=True),
    "q_pages_distinct": Case(PAGES[1], f"select distinct section from {_PAGE_SQL}"),
    "q_pages_group_distinct": Case(PAGES[2], f"select section, count(distinct views) as n from {_PAGE_SQL} where not draft group by section"),
    "q_pages_group_distinct_prepared": Case(PAGES[2], f"select section, count(distinct views) as n from {_PAGE_SQL} where not draft group by section", prepared=True),
    "q_count_null": Case("select count(null) as a, sum(null) as b, count(*) as n from nation", "select count(null) as a, cast(null as bigint) as b, count(*) as n from nation"),
    "q_sub_on_then_right": Case(
        "select n.n_name, r.r_name, c.c_custkey from nation n join region r on r.r_regionkey = (select max(x.r_regionkey) from region x where x.r_regionkey <= n.n_nationkey) right join customer c on c.c_nationkey = n.n_nationkey and r.r_regionkey < 3",
        "select n_name, r_name, c_custkey from (select * from nation join region on r_regionkey = least(n_nationkey, 4)) right join customer on c_nationkey = n_nationkey and r_regionkey < 3",
    ),
    "q_sub_on_left": Case(
        "select n.n_name, r.r_name from nation n left join region r on r.r_regionkey = (select max(x.r_regionkey) from region x where x.r_regionkey < n.n_regionkey) and n.n_nationkey < (select max(r_regionkey) from region) * 3",
        "select n_name, r_name from nation left join region on r_regionkey = n_regionkey - 1 and n_nationkey < 12",
    ),
    "q_sub_on_right": Case("select n.n_name, r.r_name from nation n right join region r on n.n_nationkey = (select max(x.n_nationkey) from nation x where x.n_regionkey = r.r_regionkey and x.n_nationkey < 9)", "select n_name, r_name from region left join (select n_regionkey as k, max_by(n_name, n_nationkey) as n_name from nation where n_nationkey < 9 group by 1) on k = r_regionkey"),
    "q_limit_large": Case("select o_orderkey from orders order by o_orderkey limit @n", "select o_orderkey from orders", (), {"n": 2**40}),
    "q_qualified_order": Case("select props.props.k as k, props.event_id from event_props props where props.props.k > 90", "select cast(json_extract(props, '$.k') as bigint) as k, event_id from events where cast(json_extract(props, '$.k') as bigint) > 90"),
    "q_alias_scope": Case("select nation.n_name, r.n_name as other from nation, nation r where nation.n_nationkey = r.n_regionkey", "select a.n_name, b.n_name as other from nation a, nation b where a.n_nationkey = b.n_regionkey"),
    "q_unnest_first": Case("select v.value, n.n_name from unnest(?) v join nation n on n.n_nationkey = v.value", "select cast(n_nationkey as bigint) as value, n_name from nation where n_nationkey in (2, 4, 8)", ([2, 4, 8, 400],)),
    "q_unnest_dynamic": Case("select m.event_id, x.value is 'a' as a from (select event_id, v from mixed_events where kind = 4) m join unnest(m.v) x on x.value is not m.event_id", "select event_id, x = 'a' as a from events, (values ('i'), ('a'), ('f')) t(x) where event_id % 5 = 4 and (x <> 'i' or user_id <> event_id)"),
    "q_unnest_dynamic_left": Case("select m.event_id, x.value is null as none from (select event_id, v from mixed_events where kind = 4) m left join unnest(m.v) x on x.value = 7", "select event_id, user_id <> 7 as none from events where event_id % 5 = 4"),
    "q_dyn_equal": Case("select event_id from mixed_events where v = 7 or v = ? or v = 'u9' or v = true", "select event_id from events where event_id % 5 = 0 and user_id = 7 or event_id % 5 = 1 and user_id = 8 or event_id % 5 = 2 and user_id = 9 or event_id % 5 = 3 and user_id % 2 = 0", (8.5,)),
    "q_dyn_compare": Case("select event_id from mixed_events where v > 20 or v <= ?", "select event_id from events where event_id % 5 = 0 and user_id > 20 or event_id % 5 = 1 and user_id < 4", (4.0,)),
    "q_dyn_in": Case("select event_id, v in (3, 'u3') as a, v not in (3, 'u3') as b from mixed_events", "select event_id, event_id % 5 in (0, 2) and user_id = 3 as a, not (event_id % 5 in (0, 2) and user_id = 3) as b from events"),
    "q_dyn_join": Case("select a.event_id as x, b.event_id as y from mixed_events a join mixed_events b on a.v = b.v where a.event_id < 100 and b.event_id < 100", "select a.event_id as x, b.event_id as y from events a join events b on a.event_id % 5 = b.event_id % 5 and a.event_id % 5 < 4 and (a.user_id = b.user_id or a.event_id % 5 = 3 and a.user_id % 2 = b.user_id % 2) where a.event_id < 100 and b.event_id < 100"),
    "q_dyn_order": Case("select event_id from mixed_events where kind != 4 order by v desc, event_id limit 2000", "select event_id from events where event_id % 5 < 4 order by case event_id % 5 when 0 then -user_id end nulls last, case event_id % 5 when 1 then -user_id end nulls last, case event_id % 5 when 2 then 'u' || user_id end desc nulls last, case event_id % 5 when 3 then user_id % 2 end nulls last, event_id limit 2000"),
    "q_dyn_group": Case("select t.n, count(*) as m from (select v, count(*) as n from mixed_events group by v) t group by t.n", "select n, count(*) as m from (select count(*) as n from events group by event_id % 5, case event_id % 5 when 3 then user_id % 2 else user_id end) group by n"),
    "q_dyn_distinct": Case("select count(*) as n from (select distinct v from mixed_events) t", "select count(distinct (event_id % 5, case event_id % 5 when 3 then user_id % 2 else user_id end)) as n from events"),
    "q_dyn_count_distinct": Case("select kind, count(distinct v) as n from mixed_events group by kind", "select event_id % 5 as kind, count(distinct case event_id % 5 when 3 then user_id % 2 else user_id end) as n from events group by 1"),
    "q_dyn_max": Case("select event_id from mixed_events where kind = 0 and v = (select max(v) from mixed_events where kind = 0)", "select event_id from events where event_id % 5 = 0 and user_id = (select max(user_id) from events where event_id % 5 = 0)"),
    "q_dyn_sum": Case("select user_id, avg(v) as a, sum(v) = ? as b from mixed_events where kind = 1 group by user_id", "select user_id, user_id + 0.5::double as a, sum(user_id + 0.5) = 11.5 as b from events where event_id % 5 = 1 group by user_id", (11.5,)),
    "q_dyn_arith": Case("select event_id, v * 2 + 1 as a, v / 3 as b from mixed_events where kind = 0", "select event_id, user_id * 2 + 1 as a, user_id // 3 as b from events where event_id % 5 = 0"),
    "q_dyn_len": Case("select event_id, len(v) as n from mixed_events where kind = 2 or kind = 4", "select event_id, case event_id % 5 when 2 then cast(strlen('u' || user_id) as bigint) else 3 end as n from events where event_id % 5 in (2, 4)"),
    "q_dyn_contains": Case("select event_id, contains(v, 'a') as a, contains(v, 7) as b from mixed_events where kind = 4", "select event_id, true as a, user_id = 7 as b from events where event_id % 5 = 4"),
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query."""
    return run(spark, sf_dir, CASES["q_multi"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, d, case=case: run(spark, d, case) for name, case in CASES.items()} | {name: made for name, (made, _) in api.CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: case.oracle for name, case in CASES.items()} | {name: sql for name, (_, sql) in api.CASES.items()}
