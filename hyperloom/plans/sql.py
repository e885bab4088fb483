"""DuckDB texts of the derived graphs, as common table expressions."""

from __future__ import annotations

SUPPLY = """supply as (
  select 'li:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || row_number() over (
      partition by l_orderkey, l_linenumber, l_partkey, l_suppkey
      order by l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as edge_id,
    ['o:' || l_orderkey, 'p:' || l_partkey, 's:' || l_suppkey] as nodes, 'supplies' as predicate,
    l_quantity / cast(50 as double) as I_value, cast(1 as double) + l_tax as base_weight,
    case when l_returnflag = 'R' then cast(-1 as double) else cast(1 as double) end as dir_factor
  from lineitem)"""


def _kg(name: str, short: str, key: str, a: str, b: str, predicate: str) -> str:
    return f"""select 'kg:{short}:' || {key} as edge_id, list_sort([{a}, {b}]) as nodes, '{predicate}' as predicate,
    ({key} % 100) / cast(100 as double) as I_value, cast(1 as double) as base_weight, cast(1 as double) as dir_factor,
    case {key} % 3 when 0 then ['name', 'type'] when 1 then ['name'] else ['name', 'segment', 'type'] end as attr_types from {name}"""


KG = "kg as (" + " union all ".join(
    [
        _kg("customer", "cn", "c_custkey", "'c:' || c_custkey", "'n:' || c_nationkey", "located_in"),
        _kg("supplier", "sn", "s_suppkey", "'s:' || s_suppkey", "'n:' || s_nationkey", "located_in"),
        _kg("nation", "nr", "n_nationkey", "'n:' || n_nationkey", "'r:' || n_regionkey", "part_of"),
        _kg("orders", "oc", "o_orderkey", "'o:' || o_orderkey", "'c:' || o_custkey", "placed_by"),
        _kg("part", "pt", "p_partkey", "'p:' || p_partkey", "'t:' || p_type", "is_a"),
        _kg("part", "pb", "p_partkey", "'p:' || p_partkey", "'b:' || p_brand", "instance_of"),
    ]
) + ")"

NODES = """nodes as (
  select 'c:' || c_custkey as node_id, 'customer' as kind, c_name as name, c_mktsegment as segment, c_custkey as num from customer
  union all select 's:' || s_suppkey, 'supplier', s_name, null, s_suppkey from supplier
  union all select 'n:' || n_nationkey, 'nation', n_name, null, n_nationkey from nation)"""

EVENTS = """numbered as (
  select user_id, event_id, value, row_number() over w - 1 as i, lag(event_id) over w as before, lead(event_id) over w as after
  from events window w as (partition by user_id order by ts, event_id)),
ev as (
  select 'ev:' || user_id || ':' || i as edge_id,
    list_sort(list_distinct(list_transform(list_filter([before, event_id, after], lambda x: x is not null), lambda x: 'e:' || x))) as nodes,
    'temporal' as predicate, cast(0.6 as double) + (i % 4) * cast(0.1 as double) as I_value, value, user_id, i
  from numbered where after is not null)"""

#: The built-in patterns that a graph of these tables can meet, and their keys.
KB = """kb as (select * from (values
  (7, 'pat_located_in_2', 'located_in', 2, ['name', 'type']), (9, 'pat_partof_3', 'part_of', 3, ['name', 'type']),
  (13, 'pat_is_a_2', 'is_a', 2, ['name', 'type']), (14, 'pat_instance_of_2', 'instance_of', 2, ['name', 'type'])) t(pat_pos, pattern_id, predicate, arity, attrs))"""


def seeds(source: str, order: str, ratio: float = 0.15) -> str:
    """rank from 0 of the first floor(n * ratio) rows of ``source`` by information."""
    return f"""seeds as (
  select * from (select *, row_number() over (order by I_value desc, {order}) - 1 as rank, count(*) over () as n from {source})
  where rank < greatest(1, floor(n * cast({ratio} as double))))"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"
