"""Plain SQL over the tables: what Spark SQL itself covers, each with the text for the other engine where it differs."""

from __future__ import annotations


def _both(text: str, duck: str | None = None) -> tuple[str, str]:
    return text, duck or text


QUERIES: dict[str, tuple[str, str]] = {
    "sql_set_union": _both("select o_custkey as k from orders union select c_custkey from customer"),
    "sql_set_intersect": _both("select o_custkey as k from orders intersect select c_custkey from customer"),
    "sql_set_except": _both("select c_custkey as k from customer except select o_custkey from orders"),
    "sql_intersect_all": _both("select l_linenumber as k from lineitem intersect all select l_linenumber from lineitem where l_tax > 0.02"),
    "sql_except_all": _both("select l_linenumber as k from lineitem except all select l_linenumber from lineitem where l_tax > 0.02"),
    "sql_distinct": _both("select distinct l_returnflag, l_linestatus from lineitem"),
    "sql_grouping_sets": _both("select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())"),
    "sql_cube": _both("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)"),
    "sql_rollup": _both("select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)"),
    "sql_agg_filter": _both("select l_returnflag, count(*) filter (where l_tax > 0.04) as n, count(distinct l_suppkey) as suppliers from lineitem group by l_returnflag"),
    "sql_bool_agg": _both("select l_returnflag, bool_or(l_tax > 0.07) as some, bool_and(l_tax >= 0) as every from lineitem group by l_returnflag"),
    "sql_list_agg": _both("select n_regionkey, listagg(n_name, ',') within group (order by n_name) as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey"),
    "sql_percentile": _both("select l_returnflag, percentile_disc(0.5) within group (order by l_quantity) as d, percentile_cont(0.5) within group (order by l_quantity) as c from lineitem group by l_returnflag"),
    "sql_regression_aggregates": _both(
        "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0d as slope, round(regr_r2(l_extendedprice, l_quantity), 6) + 0.0d as r2, regr_count(l_extendedprice, l_quantity) as n from lineitem group by l_returnflag",
        "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 as slope, round(regr_r2(l_extendedprice, l_quantity), 6) + 0.0 as r2, cast(regr_count(l_extendedprice, l_quantity) as bigint) as n from lineitem group by l_returnflag",
    ),
    "sql_window_ranks": _both("select o_orderkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, ntile(4) over w as nt from orders window w as (partition by o_custkey order by o_totalprice, o_orderkey)", "select o_orderkey, cast(row_number() over w as int) as rn, cast(rank() over w as int) as rk, cast(dense_rank() over w as int) as dr, cast(ntile(4) over w as int) as nt from orders window w as (partition by o_custkey order by o_totalprice, o_orderkey)"),
    "sql_window_offsets": _both("select o_orderkey, lag(o_totalprice) over w as lg, lead(o_totalprice, 2) over w as ld, first_value(o_totalprice) over w as fv, nth_value(o_totalprice, 2) over w as nv from orders window w as (partition by o_custkey order by o_orderkey)"),
    "sql_window_frames": _both("select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row), 2) as cum, count(*) over (partition by o_custkey order by o_orderkey rows between 1 preceding and 1 following) as near, round(cume_dist() over (partition by o_custkey order by o_orderkey), 6) as cd, round(percent_rank() over (partition by o_custkey order by o_orderkey), 6) as pr from orders"),
    "sql_correlated_exists": _both("select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 100000)"),
    "sql_scalar_subquery": _both("select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders)"),
    "sql_in_subquery": _both("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)"),
    "sql_theta_join": _both("select n1.n_name as a, n2.n_name as b from nation n1 join nation n2 on n1.n_regionkey = n2.n_regionkey and n1.n_nationkey < n2.n_nationkey"),
    "sql_lateral": _both("select n_name, x.k from nation, lateral (select n_nationkey * 2 as k) x"),
    "sql_cte_recursive": _both("with recursive t(n) as (select 1 union all select n + 1 from t where n < 20) select n from t"),
    "sql_values": _both("select * from (values (1, 'a'), (2, 'b'), (3, null)) as t(k, v)"),
    "sql_case_coalesce": _both("select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'other' end as state, coalesce(nullif(o_orderpriority, '1-URGENT'), 'top') as p from orders"),
    "sql_between_like_in": _both("select p_partkey from part where p_retailprice between 900 and 1500 and (p_name like '%a%' or p_brand in ('Brand#11', 'Brand#12')) and p_type not like 'X%'"),
    "sql_strings": _both("select c_custkey, upper(c_name) as up, lower(c_mktsegment) as low, substring(c_name, 1, 5) as sub, length(c_name) as len, trim('  ' || c_mktsegment || ' ') as tr, replace(c_name, 'Customer', 'C') as rep, position('#' in c_name) as pos, concat(c_mktsegment, '-', c_nationkey) as con, reverse(c_mktsegment) as rev, lpad(c_mktsegment, 12, '*') as lp, repeat('x', 3) as re, left(c_name, 3) as le, right(c_name, 3) as ri from customer",
        "select c_custkey, upper(c_name) as up, lower(c_mktsegment) as low, substring(c_name, 1, 5) as sub, cast(length(c_name) as int) as len, trim('  ' || c_mktsegment || ' ') as tr, replace(c_name, 'Customer', 'C') as rep, cast(position('#' in c_name) as int) as pos, concat(c_mktsegment, '-', c_nationkey) as con, reverse(c_mktsegment) as rev, lpad(c_mktsegment, 12, '*') as lp, repeat('x', 3) as re, left(c_name, 3) as le, right(c_name, 3) as ri from customer"),
    "sql_regex": _both("select c_custkey, regexp_replace(c_name, '[0-9]+', 'N') as r, regexp_extract(c_name, '([0-9]+)', 1) as d, regexp_like(c_name, '^C') as m from customer", "select c_custkey, regexp_replace(c_name, '[0-9]+', 'N', 'g') as r, regexp_extract(c_name, '([0-9]+)', 1) as d, regexp_matches(c_name, '^C') as m from customer"),
    "sql_dates": _both("select o_orderkey, extract(year from o_orderdate) as y, extract(month from o_orderdate) as m, extract(day from o_orderdate) as d, date_trunc('month', o_orderdate) as mo, dayofweek(o_orderdate) as dw, quarter(o_orderdate) as q from orders",
        "select o_orderkey, cast(extract(year from o_orderdate) as int) as y, cast(extract(month from o_orderdate) as int) as m, cast(extract(day from o_orderdate) as int) as d, date_trunc('month', o_orderdate)::timestamp as mo, cast(dayofweek(o_orderdate) + 1 as int) as dw, cast(quarter(o_orderdate) as int) as q from orders"),
    "sql_date_arithmetic": _both("select o_orderkey, o_orderdate + interval 3 days as later, cast(date_add(cast(o_orderdate as date), 30) as string) as plus, datediff(date '2000-01-01', cast(o_orderdate as date)) as days, cast(last_day(cast(o_orderdate as date)) as string) as ld from orders",
        "select o_orderkey, o_orderdate + interval 3 days as later, cast(cast(cast(o_orderdate as date) + 30 as date) as varchar) as plus, cast(date_diff('day', cast(o_orderdate as date), date '2000-01-01') as int) as days, cast(last_day(cast(o_orderdate as date)) as varchar) as ld from orders"),
    "sql_arrays": _both("select vec_id, size(embedding) as n, array_contains(array(1, 2, 3), label) as c, element_at(array(5, 6, 7), 2) as e, array_max(array(label, 2)) as mx, concat_ws('-', sort_array(array('b', 'a'))) as j from embeddings",
        "select vec_id, cast(len(embedding) as int) as n, list_contains([1, 2, 3], label) as c, [5, 6, 7][2] as e, list_max([label, 2]) as mx, array_to_string(list_sort(['b', 'a']), '-') as j from embeddings"),
    "sql_unnest": _both("select vec_id, count(*) as n, round(sum(x), 3) + 0.0d as s from (select vec_id, explode(embedding) as x from embeddings) t group by vec_id", "select vec_id, count(*) as n, round(sum(x), 3) + 0.0 as s from (select vec_id, unnest(embedding)::double as x from embeddings) t group by vec_id"),
    "sql_maps": _both("select r_regionkey, map('a', r_regionkey, 'b', 2)['a'] as a, size(map_keys(map('a', 1, 'b', 2))) as n from region", "select r_regionkey, map {'a': r_regionkey, 'b': 2}['a'] as a, cast(len(map_keys(map {'a': 1, 'b': 2})) as int) as n from region"),
    "sql_json": _both("select event_id, get_json_object(props, '$.page') as page from events", "select event_id, json_extract_string(props, '$.page') as page from events"),
    "sql_hash_functions": _both("select c_custkey, md5(c_name) as m, sha2(c_name, 256) as s from customer", "select c_custkey, md5(c_name) as m, sha256(c_name) as s from customer"),
    "sql_bits": _both("select l_orderkey, l_linenumber, l_orderkey & 255 as a, l_orderkey | 1 as o, shiftleft(l_orderkey, 2) as sl from lineitem", "select l_orderkey, l_linenumber, l_orderkey & 255 as a, l_orderkey | 1 as o, l_orderkey << 2 as sl from lineitem"),
    "sql_pivot": _both("select * from (select l_returnflag, l_linestatus, l_quantity from lineitem) pivot (count(l_quantity) for l_linestatus in ('O' as o, 'F' as f))", "select l_returnflag, count(*) filter (where l_linestatus = 'O') as o, count(*) filter (where l_linestatus = 'F') as f from lineitem group by 1"),
    "sql_unpivot": _both("select r_regionkey, col, val from (select r_regionkey, r_regionkey * 1 as a, r_regionkey * 2 as b from region) unpivot (val for col in (a, b))"),
    "sql_offset": _both("select o_orderkey from orders order by o_orderkey limit 20 offset 40"),
    "sql_null_order": _both("select k from (values (3), (null), (1)) as t(k) order by k desc nulls last"),
    "sql_within_distinct": _both("select l_returnflag, sum(q) as q from (select distinct l_returnflag, l_orderkey, l_quantity as q from lineitem) t group by l_returnflag"),
    "sql_star_join": _both("select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 5) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where l_tax > 0.02 group by r_name, n_name"),
}
