"""SQL counterparts of the registered queries, on the same tables."""

from __future__ import annotations

SITES = """sites as (
  select s_suppkey as idx,
         24.66818e0 - 0.07962e0 * cast(floor(s_suppkey / 40) as int) as lat,
         68.0e0 + 0.07962e0 * (s_suppkey % 40) as lon
  from supplier)"""
HIST = """hist as (
  select l_suppkey as idx, cast(year(l_shipdate) as int) as yr,
         cast(sum(cast(l_quantity as decimal(18,2))) as double) as biomass
  from lineitem group by 1, 2)"""
DIST = """dist as (
  select i, j, d from (
    select a.idx as i, b.idx as j,
           case when a.idx = b.idx then 0e0
                else round(100e0 * sqrt((a.lat-b.lat)*(a.lat-b.lat) + (a.lon-b.lon)*(a.lon-b.lon))
                           + ((a.idx*7 + b.idx*13) % 5), 4) end as d
    from sites a cross join sites b)
  where d <= {max_d})"""
FULL_DIST = DIST.replace("where d <= {max_d}", "")
MATRIX = """matrix as (select vec_id as i, n - 1 as j, cast(embedding[n] as double) as d
  from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as n from embeddings))"""
FLOWS = """lines as (
  select cast(year(l_shipdate) as int) as yr, l_suppkey, l_partkey % 26 as depot, l_partkey % 6 as refinery,
         cast(l_quantity as decimal(18,2)) as q,
         cast(l_quantity as decimal(18,2)) * (1 - cast(l_tax as decimal(4,2))) as kept
  from lineitem where year(l_shipdate) in (1999, 2000)),
flows as (
  select 'biomass_demand_supply' as data_type, yr, l_suppkey as src, depot as dst, cast(sum(q) as double) as value
  from lines group by 2, 3, 4
  union all
  select 'pellet_demand_supply', yr, depot, refinery, cast(sum(kept) as double) from lines group by 2, 3, 4
  union all
  select distinct 'depot_location', 20182019, p_partkey % 25, cast(null as bigint), cast(null as double) from part
  union all
  select distinct 'refinery_location', 20182019, p_partkey % 5, cast(null as bigint), cast(null as double) from part
  union all
  select 'biomass_forecast', yr, idx, null, biomass from hist where yr in (1999, 2000))"""
VARIABLES = """variables as (
  select concat_ws('_', 'b', yr, l_suppkey, depot) as name, v as value from (
    select cast(year(l_shipdate) as int) as yr, l_suppkey, l_partkey % 26 as depot,
           cast(sum(cast(case when l_returnflag = 'R' then l_quantity else 0 end as decimal(18,2))) as double) as v
    from lineitem group by 1, 2, 3))"""
ESTATES = """estates as (
  select c_custkey as estate,
         24.66818e0 - 0.013e0 * (c_custkey * 37 % 101) as lat,
         68.0e0 + 0.011e0 * (c_custkey * 53 % 307) as lon
  from customer)"""
NEAREST = """mapped as (
  select estate, lat_point, lon_point, idx, d from (
    select e.estate, e.lat as lat_point, e.lon as lon_point, s.idx,
           sqrt((e.lat-s.lat)*(e.lat-s.lat) + (e.lon-s.lon)*(e.lon-s.lon)) as d,
           row_number() over (partition by e.estate order by
             sqrt((e.lat-s.lat)*(e.lat-s.lat) + (e.lon-s.lon)*(e.lon-s.lon)), s.idx) as rn
    from estates e cross join sites s) where rn = 1)"""
LABELS = """labels as (select s_suppkey as idx, cast(s_nationkey as bigint) as cluster from supplier)"""
INNER = """inner_arcs as (
  select a.cluster, d.i, d.j, d.d from dist d
  join labels a on a.idx = d.i join labels b on b.idx = d.j where a.cluster = b.cluster)"""
PROFILE = """profile as (
  select t.cluster, points, total_1999, total_2000, (total_1999 + total_2000) / 2 as mean_total, max_inner
  from (select l.cluster, count(*) as points,
               sum(coalesce(a.biomass, 0)) as total_1999, sum(coalesce(b.biomass, 0)) as total_2000
        from labels l
        left join hist a on a.idx = l.idx and a.yr = 1999
        left join hist b on b.idx = l.idx and b.yr = 2000
        group by 1) t
  left join (select cluster, max(d) as max_inner from inner_arcs group by 1) m on m.cluster = t.cluster)"""
CATCHMENTS = """catchments as (
  select i as center, sum(biomass) as biomass from dist join hist on hist.idx = dist.j and hist.yr = 2000
  where d <= 18 group by 1)"""
WEATHER = """weather as (
  select vec_id as site, strftime(date '2018-01-01' + cast(n - 1 as int), '%Y-%m-%d') as time,
         cast(embedding[n] as double) as temperature_2m_max, cast(embedding[n] as double) - 1 as temperature_2m_min
  from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as n from embeddings))"""
HOURLY = """hourly as (
  select user_id as site, date_trunc('hour', ts) as time,
         cast(sum(cast(value as decimal(18,4))) as double) as hour_value, count(*) as hour_n
  from events group by 1, 2)"""
PANEL_YEARS = "panel as (select idx, yr from (select distinct idx from hist) cross join (select unnest(range(1995, 2002)) as yr))"
GAZETTEER = """asked as (
  select c_custkey as no, ' ' || upper(c_name) as estate, n_name as district, c_name, c_acctbal
  from customer join nation on n_nationkey = c_nationkey),
located as (
  select no, a.estate, district,
         case when c_acctbal > 0 then round(e.lat, 6) end as lat, case when c_acctbal > 0 then round(e.lon, 6) end as lon
  from asked a join estates e on e.estate = a.no)"""


def sql(*ctes: str, select: str, max_d: float | None = None) -> str:
    parts = [c.replace("{max_d}", str(max_d)) if max_d is not None else c for c in ctes]
    return (f"with {', '.join(parts)} " if parts else "") + select


def arcs(select: str, max_d: float = 60.0, *more: str) -> str:
    return sql(SITES, DIST, *more, select=select, max_d=max_d)


def check(body: str) -> str:
    return sql(
        HIST, FLOWS,
        select='select "constraint", cast(yr as int) as yr, cast(key as bigint) as key, '
        'round(cast(actual as double), 6) as actual, round(cast("limit" as double), 6) as "limit", ok from (' + body + ")",
    )


DEPOT_CAP, REFINERY_CAP = "8400.0", "36300.0"
C1 = """select 'C1_nonnegative_' || data_type as "constraint", yr, null as key, min(value) as actual, 0 as "limit", min(value) >= 0 as ok
from flows where value is not null group by data_type, yr"""
C2 = """select 'C2_site_supply' as "constraint", s.yr, s.src as key, s.v as actual, coalesce(f.v, 0) as "limit", s.v <= coalesce(f.v, 0) as ok
from (select yr, src, sum(value) as v from flows where data_type = 'biomass_demand_supply' group by 1, 2) s
left join (select yr, src, sum(value) as v from flows where data_type = 'biomass_forecast' group by 1, 2) f on f.yr = s.yr and f.src = s.src"""
C3 = f"""select 'C3_depot_in' as "constraint", yr, dst as key, sum(value) as actual, {DEPOT_CAP} as "limit", sum(value) <= {DEPOT_CAP} as ok
from flows where data_type = 'biomass_demand_supply' group by yr, dst
union all
select 'C3_depot_out', yr, src, sum(value), {DEPOT_CAP}, sum(value) <= {DEPOT_CAP}
from flows where data_type = 'pellet_demand_supply' group by yr, src"""
C4 = f"""select 'C4_refinery_in' as "constraint", yr, dst as key, sum(value) as actual, {REFINERY_CAP} as "limit", sum(value) <= {REFINERY_CAP} as ok
from flows where data_type = 'pellet_demand_supply' group by yr, dst"""
C56 = """select 'C5_depots' as "constraint", null as yr, null as key, count(distinct src) as actual, 25 as "limit", count(distinct src) <= 25 as ok
from flows where data_type = 'depot_location'
union all select 'C5_depots_per_cell', null, null, count(*) - count(distinct src), 0, count(*) = count(distinct src)
from flows where data_type = 'depot_location'
union all select 'C6_refineries', null, null, count(distinct src), 5, count(distinct src) <= 5
from flows where data_type = 'refinery_location'
union all select 'C6_refineries_per_cell', null, null, count(*) - count(distinct src), 0, count(*) = count(distinct src)
from flows where data_type = 'refinery_location'"""
RATIO = """select yr, sum(case when data_type = 'pellet_demand_supply' then value else 0 end) as processed,
sum(case when data_type = 'biomass_forecast' then value else 0 end) as forecast
from flows where data_type in ('pellet_demand_supply', 'biomass_forecast') group by yr"""
C7 = f"""select 'C7_coverage' as "constraint", yr, null as key, processed as actual, 0.8e0 * forecast as "limit", processed >= 0.8e0 * forecast as ok
from ({RATIO})"""
BALANCE = """select coalesce(a.yr, b.yr) as yr, coalesce(a.key, b.key) as key, coalesce(inflow, 0) as inflow, coalesce(outflow, 0) as outflow
from (select yr, dst as key, sum(value) as inflow from flows where data_type = 'biomass_demand_supply' group by 1, 2) a
full join (select yr, src as key, sum(value) as outflow from flows where data_type = 'pellet_demand_supply' group by 1, 2) b
  on a.yr = b.yr and a.key = b.key"""
C8 = f"""select 'C8_balance' as "constraint", yr, key, abs(inflow - outflow) as actual, 0.001e0 as "limit", abs(inflow - outflow) <= 0.001e0 as ok
from ({BALANCE})"""


def _undeclared(name: str, leg: str, side: str, kind: str) -> str:
    return f"""select '{name}' as "constraint", yr, u.{side} as key, sum(value) as actual, 0 as "limit", false as ok
from flows u anti join (select distinct src as {side} from flows where data_type = '{kind}') known using ({side})
where data_type = '{leg}' group by yr, u.{side}"""


C9 = " union all ".join([
    _undeclared("C9_depot_in_undeclared", "biomass_demand_supply", "dst", "depot_location"),
    _undeclared("C9_depot_out_undeclared", "pellet_demand_supply", "src", "depot_location"),
    _undeclared("C9_refinery_undeclared", "pellet_demand_supply", "dst", "refinery_location"),
    """select 'C9_location_year', yr, src, yr, 20182019, false from flows
    where data_type in ('depot_location', 'refinery_location') and yr <> 20182019""",
])
TRANSPORT = """select yr, data_type, coalesce(sum(d * value), 0e0) as cost, coalesce(sum(case when d is null then value end), 0e0) as unpriced
from flows left join dist on i = src and j = dst
where data_type in ('biomass_demand_supply', 'pellet_demand_supply') group by 1, 2"""
MAE = """select a.yr, avg(abs(a.biomass - f.biomass)) as mae from hist a join hist f on f.idx = a.idx and f.yr = a.yr - 2 group by 1"""
UNDERUSE = """select y.yr, (select sum(case when data_type = 'depot_location' then 20000e0 else 100000e0 end) from flows
  where data_type in ('depot_location', 'refinery_location')) - coalesce(used, 0e0) as underuse
from (select distinct yr from flows where data_type in ('biomass_demand_supply', 'pellet_demand_supply', 'biomass_forecast')) y
left join (select yr, sum(value) as used from flows
  where (data_type = 'biomass_demand_supply' and dst in (select src from flows where data_type = 'depot_location'))
  or (data_type = 'pellet_demand_supply' and dst in (select src from flows where data_type = 'refinery_location')) group by yr) u on u.yr = y.yr"""
FILL = """fill as (
  select i, j, d, least(f, greatest(20000e0 - prev, 0e0)) as b from (
    select i, j, d, biomass as f, coalesce(sum(biomass) over (
      partition by j order by d, i rows between unbounded preceding and 1 preceding), 0e0) as prev
    from dist join hist on hist.idx = dist.i and hist.yr = 2000 and biomass > 0)
  where prev < 20000e0)"""
OPEN = "(select distinct depot from lines)"
PIVOT_CUST = ", ".join(
    f"round(avg(case when year(o_orderdate) = {y} then o_totalprice end), 6) as y{y}" for y in range(1995, 2002)
)
CORR_COLS = ["lat", "lon", *[f"y{y}" for y in range(1995, 2002)]]
CORR = " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, round(corr({a}, {b}), 6) as r from wide" for a in CORR_COLS for b in CORR_COLS
)
WIDE = "wide as (select s.idx, lat, lon, " + ", ".join(
    f"max(case when yr = {y} then biomass end) as y{y}" for y in range(1995, 2002)
) + " from sites s join hist h on h.idx = s.idx group by 1, 2, 3)"
RADII = "radii as (select k as point, case when k = 19 then 50e0 else k * (50e0 / 19) end as radius from (select unnest(range(0, 20)) as k))"
AUDIT = " union all ".join([C1, C2, C3, C4, C56, C7, C8, C9])

# The constraints that a plan without violations gives rows for; of the location rule only violations are rows.
CONSTRAINTS = [
    "C1_nonnegative_biomass_demand_supply", "C1_nonnegative_pellet_demand_supply", "C1_nonnegative_biomass_forecast", "C2_site_supply",
    "C3_depot_in", "C3_depot_out", "C4_refinery_in", "C5_depots", "C5_depots_per_cell", "C6_refineries", "C6_refineries_per_cell",
    "C7_coverage", "C8_balance",
]

ORACLE: dict[str, str] = {
    "read_site_panel": sql(SITES, HIST, PANEL_YEARS, select="""
        select p.idx, lat, lon, cast(p.yr as int) as yr, biomass from panel p join sites s on s.idx = p.idx
        left join hist h on h.idx = p.idx and h.yr = p.yr"""),
    "read_distance_matrix": """select vec_id as i, n - 1 as j, cast(embedding[n] as double) as d
        from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as n from embeddings)""",
    "read_forecast": """select cast(year(o_orderdate) as int) as yr, strftime(o_orderdate, '%Y-%m-%d') as day, cast(o_custkey as double) as lat,
        cast(o_orderkey as double) as lon, o_totalprice as forecast from orders""",
    "read_estates": """select cast(c_custkey as int) as no, c_name as estate, c_mktsegment as district, c_acctbal as size_ha,
        case when c_acctbal >= 0 then c_acctbal end as power_mva,
        case when c_acctbal >= 0 then c_nationkey * 1.5e0 end as water_mld,
        case when c_acctbal >= 0 then c_nationkey * 0.5e0 end as drainage_mld from customer""",
    "read_submission": sql(HIST, FLOWS, select="select data_type, cast(yr as int) as yr, src, dst, round(value, 6) as value from flows"),
    "read_solution": sql(VARIABLES, select="select name, value from variables"),
    "write_table": sql(HIST, select="select * from hist"),
    "read_weather_json": sql(WEATHER, select="select * from weather"),
    "panel_unpivot": sql(HIST, PANEL_YEARS, select="""
        select p.idx, cast(p.yr as int) as yr, biomass from panel p left join hist h on h.idx = p.idx and h.yr = p.yr"""),
    "matrix_to_edges": """select vec_id as i, n - 1 as j, cast(embedding[n] as double) as d
        from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as n from embeddings)""",
    "forecast_pivot": f"select o_custkey, {PIVOT_CUST} from orders group by 1",
    "dense_site_index": sql(SITES, select="select row_number() over (order by lat, lon) - 1 as pos, idx from sites"),
    "recover_index": sql(HIST, select="select idx, yr, biomass from hist"),
    "lag_forecast": sql(HIST, select="""select a.idx, a.yr, a.biomass, f.biomass as expected
        from hist a join hist f on f.idx = a.idx and f.yr = a.yr - 2"""),
    "submatrix": sql(MATRIX, select="""select i, j, d from matrix where i in (select s_suppkey from supplier where s_acctbal >= 5000)
        and j in (select s_suppkey from supplier where s_acctbal >= 5000)"""),
    "edges_from_center": sql(MATRIX, select="select i, j, d from matrix where i = 5"),
    "arc_adjacency": arcs("""
        select 'i' as "by", i as node, cast(floor(j / 32) as bigint) as block, string_agg(j, ',' order by j) as neighbours, count(*) as n from dist group by 2, 3
        union all
        select 'j', j, cast(floor(i / 32) as bigint), string_agg(i, ',' order by i), count(*) from dist group by 2, 3""", 50.0),
    "two_hop_arcs": arcs("select a.i, a.j, b.j as k, round(a.d + b.d, 4) as d from dist a join dist b on b.i = a.j", 20.0),
    "least_two_hop_arcs": arcs("""select i, k, first(j order by d, j) as j, min(d) as d
        from (select a.i, a.j, b.j as k, round(a.d + b.d, 4) as d from dist a join dist b on b.i = a.j) group by i, k""", 20.0),
    "union_rows": sql(HIST, select="""select idx, yr, biomass, 'history' as origin from hist
        union all select idx, yr + 2, biomass, null from hist"""),
    "weather_flatten": sql(WEATHER, select="select * from weather"),
    "arcs_within": arcs("select i, j, d from dist", 50.0),
    "arc_share_over": sql(MATRIX, select="""select count(*) filter (d <= 0.5) as arcs_within,
        round(avg(case when d > 0.5 then 1e0 else 0e0 end), 6) as share_over, max(d) as max_d from matrix"""),
    "nonzero_solution": sql(VARIABLES, select="select name, value from variables where value <> 0"),
    "vars_by_pattern": sql(VARIABLES, select="""select count(*) as n, sum(value) as total from variables
        where regexp_full_match(name, 'b_1999_[0-9]+_5')"""),
    "arcs_to_open_sites": sql(SITES, FULL_DIST, HIST, FLOWS, select=f"select i, j, d from dist where j in {OPEN}"),
    "drop_unmatched": sql(ESTATES, GAZETTEER, select="select * from located where lat is not null"),
    "drop_sparse_columns": "select doc_id, text, lang, source, n_chars from documents",
    "top_n_sites": sql(HIST, select="""select idx, sum(biomass) as total from hist where yr in (1999, 2000)
        group by 1 order by total desc, idx limit 25"""),
    "even_sample": sql(SITES, select="""select distinct idx from sites join (
        select case when k = 29 then m else cast(floor(k * (m / 29e0)) as bigint) end as pos
        from (select max(idx) as m from sites) cross join (select unnest(range(0, 30)) as k)) on pos = idx"""),
    "distinct_values": arcs("select distinct j from dist", 20.0),
    "duplicate_arcs": """select cast(sum(n - 1) as bigint) as duplicates
        from (select count(*) as n from lineitem group by l_suppkey, l_partkey)""",
    "first_n_depots": sql(HIST, FLOWS, select="""select dst as idx, sum(value) as received from flows
        where data_type = 'biomass_demand_supply' group by 1 order by received desc, idx limit 25"""),
    "nearest_cell": sql(SITES, ESTATES, NEAREST, select="select estate, idx, round(d, 6) as d from mapped"),
    "cells_with_estates": sql(SITES, ESTATES, NEAREST, select="""
        select s.idx, round(s.lat, 6) as lat, round(s.lon, 6) as lon, m.estate, round(lat_point, 6) as lat_point,
               round(lon_point, 6) as lon_point from sites s join mapped m on m.idx = s.idx"""),
    "weather_daily_hourly": sql(HOURLY, """daily as (select user_id as site, date_trunc('day', ts) as time,
        cast(sum(cast(value as decimal(18,4))) as double) as day_value, max(value) as day_max from events group by 1, 2)""",
        select="""select d.site, strftime(d.time, '%Y-%m-%d %H:%M:%S') as time, day_value, day_max, hour_value, hour_n
        from daily d join hourly h on h.site = d.site and h.time = d.time"""),
    "attach_site_measure": sql(SITES, DIST, HIST, max_d=18.0, select="""
        select i, j, d, biomass from dist join hist on hist.idx = j and yr = 2000"""),
    "gazetteer_lookup": sql(ESTATES, GAZETTEER, select="select * from located"),
    "k_nearest": sql(MATRIX, select="""select i, j, d, rank from (select i, j, d, cast(row_number() over (partition by i order by d, j) as int) as rank
        from matrix where i <> j) where rank <= 5"""),
    "neighbour_candidates": sql(MATRIX, HIST, FLOWS, select=f"""
        select j as idx from (select j, row_number() over (partition by i order by d, j) as rank from matrix
          where i <> j and i in {OPEN}) where rank <= 5
        union select depot from lines"""),
    "neighbour_spacing": sql(ESTATES, select="""
        select round(spacing, 6) as spacing, spacing > 0.02e0 as flagged, count(*) as n from (
          select a.estate, min(sqrt((a.lat-b.lat)*(a.lat-b.lat) + (a.lon-b.lon)*(a.lon-b.lon))) as spacing
          from estates a join estates b on a.lat <> b.lat or a.lon <> b.lon group by 1) group by 1, 2"""),
    "flow_balance_join": sql(HIST, FLOWS, select=f"""select yr, key, round(inflow, 6) as inflow, round(outflow, 6) as outflow,
        round(inflow - outflow, 6) as diff from ({BALANCE})"""),
    "distance_asymmetry": sql(MATRIX, select="""select a.i, a.j, a.d, b.d as d_back, round(abs(a.d - b.d), 6) as gap
        from matrix a join matrix b on b.i = a.j and b.j = a.i where a.i < a.j"""),
    "radius_edges": sql(SITES, select="""select i, j, round(d, 6) as d from (select a.idx as i, b.idx as j,
        sqrt((a.lat-b.lat)*(a.lat-b.lat) + (a.lon-b.lon)*(a.lon-b.lon)) as d from sites a cross join sites b) where d <= 0.18e0"""),
    "total_by_year": sql(HIST, select="select yr, sum(biomass) as biomass from hist group by 1"),
    "describe_measure": sql(HIST, select="""select 'biomass' as measure, count(biomass) as n, round(avg(biomass), 6) as mean,
        round(stddev_samp(biomass), 6) as std, min(biomass) as min, round(quantile_cont(biomass, 0.25), 6) as q25,
        round(quantile_cont(biomass, 0.5), 6) as q50, round(quantile_cont(biomass, 0.75), 6) as q75, max(biomass) as max from hist"""),
    "value_counts": sql(HIST, FLOWS, select="select data_type, count(*) as n from flows group by 1"),
    "site_mean": sql(HIST, select="""select idx, round(avg(biomass), 6) as biomass,
        round(avg(biomass) filter (yr in (1999, 2000)), 6) as last_two from hist group by 1"""),
    "catchment_sum": sql(SITES, DIST, HIST, CATCHMENTS, max_d=18.0, select="select * from catchments"),
    "catchment_curve": sql(SITES, DIST, HIST, RADII, max_d=50.0, select="""
        select center, cast(point as int) as point, round(radius, 6) as radius,
               coalesce(sum(case when d <= radius then biomass end), 0e0) as biomass
        from (select i as center, d, biomass from dist join hist on hist.idx = j and yr = 2000) cross join radii group by 1, 2, 3"""),
    "catchment_band": sql(SITES, DIST, HIST, CATCHMENTS, max_d=18.0, select="""select center, biomass,
        biomass between 15000 and 20000 as in_band, biomass > 15000 as above from catchments"""),
    "correlation_matrix": sql(SITES, HIST, WIDE, select=CORR),
    "align_external_series": sql(HIST, select="""select h.yr, biomass, orders_value
        from (select yr, sum(biomass) as biomass from hist group by 1) h join (
          select cast(year(o_orderdate) as int) as yr, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as orders_value
          from orders group by 1) o on o.yr = h.yr"""),
    "minmax_by_year": sql(HIST, """t as (select h.yr, biomass, orders_value
        from (select yr, sum(biomass) as biomass from hist group by 1) h join (
          select cast(year(o_orderdate) as int) as yr, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as orders_value
          from orders group by 1) o on o.yr = h.yr)""",
        select="""select yr, round((biomass - min(biomass) over ()) / (max(biomass) over () - min(biomass) over ()), 6) as biomass,
        round((orders_value - min(orders_value) over ()) / (max(orders_value) over () - min(orders_value) over ()), 6) as orders_value from t"""),
    "histogram": sql(SITES, DIST, HIST, CATCHMENTS, "lim as (select min(biomass) as l, (max(biomass) - min(biomass)) / 10 as w from catchments)",
        max_d=18.0, select="""select cast(k as int) as bin, round(l + k * w, 6) as lo, round(l + k * w + w, 6) as hi, count(biomass) as n
        from (select unnest(range(0, 10)) as k) cross join lim
        left join catchments on least(floor((biomass - l) / w), 9) = k group by k, l, w"""),
    "busiest_depot": sql(HIST, FLOWS, select="""select yr, key as depot, load from (
        select yr, dst as key, sum(value) as load, row_number() over (partition by yr order by sum(value) desc, dst) as rn
        from flows where data_type = 'biomass_demand_supply' group by 1, 2) where rn = 1"""),
    "depot_load": sql(HIST, FLOWS, select="""select data_type, side, yr, key, round(sum(value), 6) as load from (
          select data_type, 'src' as side, yr, src as key, value from flows
          union all select data_type, 'dst', yr, dst, value from flows)
        where data_type in ('biomass_demand_supply', 'pellet_demand_supply') group by 1, 2, 3, 4"""),
    "pareto_share": sql(HIST, "m as (select idx, avg(biomass) as biomass from hist group by 1)", select="""
        select idx, round(biomass, 6) as biomass, round(c, 6) as cum_biomass, round(c / t, 6) as share from (
          select idx, biomass, sum(biomass) over (order by biomass desc, idx rows unbounded preceding) as c,
                 sum(biomass) over () as t from m) where c / t <= 0.8"""),
    "cluster_profile": sql(SITES, FULL_DIST, HIST, LABELS, INNER, PROFILE, select="select * from profile"),
    "coverage_share": sql(SITES, FULL_DIST, HIST, LABELS, INNER, PROFILE, select="""
        select round(sum(case when q > 0 then mean_total else 0 end) / sum(mean_total), 6) as covered,
               round(sum(case when q > 0 and lo <= hi then mean_total else 0 end) / sum(mean_total), 6) as covered_bounded
        from (select mean_total, case when mean_total > 5000 then floor(mean_total / 17000) + 1 else 0 end as q,
                     ceil(greatest(total_1999, total_2000) * 0.8e0 / 17000) as lo, floor(least(total_1999, total_2000) / 17000) as hi from profile)"""),
    "refinery_load_band": sql(HIST, select="""select round(t, 6) as total, round(t * 0.8e0 / 5, 6) as low, round(t / 5, 6) as high
        from (select sum(biomass) / 2 as t from hist where yr in (1999, 2000))"""),
    "forecast_mae": sql(HIST, select=f"select yr, round(mae, 6) as mae from ({MAE})"),
    "transport_cost": sql(SITES, FULL_DIST, HIST, FLOWS, select=f"select yr, data_type, round(cost, 4) as cost, round(unpriced, 4) as unpriced from ({TRANSPORT})"),
    "underuse_cost": sql(HIST, FLOWS, select=f"select yr, round(underuse, 4) as underuse from ({UNDERUSE})"),
    "total_cost": sql(SITES, FULL_DIST, HIST, FLOWS, select=f"""
        select u.yr, round(coalesce(transport, 0), 4) as transport, round(coalesce(mae, 0), 4) as mae, round(underuse, 4) as underuse,
               round(coalesce(transport, 0) + coalesce(mae, 0) + underuse, 4) as cost, round(coalesce(unpriced, 0), 4) as unpriced
        from ({UNDERUSE}) u left join (select yr, sum(cost) * 0.001e0 as transport, sum(unpriced) as unpriced from ({TRANSPORT}) group by 1) t on t.yr = u.yr
        left join ({MAE}) m on m.yr = u.yr"""),
    "processed_ratio": sql(HIST, FLOWS, select=f"""select yr, round(processed, 6) as processed, round(forecast, 6) as forecast,
        round(processed / forecast, 6) as ratio from ({RATIO})"""),
    "weather_hour_day": sql(HOURLY, select="""select site, strftime(date_trunc('day', time), '%Y-%m-%d') as time,
        cast(sum(cast(hour_value as decimal(18,4))) as double) as day_value, max(hour_value) as top_hour, count(*) as hours
        from hourly group by 1, 2"""),
    "depot_quota": sql(SITES, FULL_DIST, HIST, LABELS, INNER, PROFILE, select="""
        select cluster, cast(greatest(floor((mean_total - 8000) / 15000) + 1, 0) as bigint) as depots,
               cast(case when mean_total > 5000 then floor(mean_total / 17000) + 1 else 0 end as bigint) as depots_old,
               cast(case when mean_total > 20000 then floor(mean_total / 87000) + 1 else 0 end as bigint) as refineries from profile"""),
    "quota_bounds": sql(SITES, FULL_DIST, HIST, LABELS, INNER, PROFILE, select="""
        select cluster, cast(case when mean_total > 5000 then floor(mean_total / 17000) + 1 else 0 end as bigint) as quota,
               cast(ceil(greatest(total_1999, total_2000) * 0.8e0 / 17000) as bigint) as min_quota,
               cast(floor(least(total_1999, total_2000) / 17000) as bigint) as max_quota from profile"""),
    "intra_cluster_max": sql(SITES, FULL_DIST, LABELS, INNER, select="select cluster, max(d) as max_inner from inner_arcs group by 1"),
    "balanced_blocks": sql(HIST, "m as (select idx, avg(biomass) as biomass from hist group by 1)", select="""
        select idx, round(biomass, 6) as biomass, cast(least(floor(coalesce(c, 0) / (t / 5)), 4) as int) as block from (
          select idx, biomass, sum(biomass) over (order by biomass desc, idx rows between unbounded preceding and 1 preceding) as c,
                 sum(biomass) over () as t from m)"""),
    "per_cluster_arcs": sql(SITES, DIST, HIST, LABELS, INNER, PROFILE, max_d=60.0, select="""
        select cluster, i, j, d from inner_arcs where cluster in (
          select cluster from profile where greatest(floor((mean_total - 8000) / 15000) + 1, 0) > 0)"""),
    "fill_single_depot": sql(SITES, FULL_DIST, HIST, FILL, select="select i, j, d, b from fill where b > 0"),
    "choose_one_depot": sql(SITES, FULL_DIST, HIST, FILL, select="""
        select j, round(cost, 4) as cost, shipped, sources from (
          select j, sum(d * b) as cost, sum(b) as shipped, count(*) as sources from fill where b > 0 group by 1)
        where shipped >= 20000 - 1e-6 order by cost, j limit 1"""),
    "linkage_checks": "select cast(5 as bigint) as clusters, count(*) as sites, true as named_by_least from supplier",
    "plan_audit": "select unnest([" + ", ".join(f"'{c}'" for c in CONSTRAINTS) + """]) as "constraint", cast(0 as bigint) as failed""",
    "plan_status": sql(HIST, select="""select cast(0 as bigint) as cluster, yr, round(sum(biomass) * 0.8e0, 6) as target, (select greatest(1, count(*) // 4) from supplier) as quota,
        true as feasible from hist where yr in (1999, 2000) group by yr"""),
    "model_size": arcs("""select 10 * n + 4 as constraints, 2 * a + 2 * n * n + 2 * n as variables, 2 * n as integers,
        8 * a + 8 * n * n + 10 * n as nonzeros
        from (select count(*) filter (i = j) as n, count(*) filter (d <= 50) as a from dist)"""),
    "solution_to_submission": sql(HIST, FLOWS, select="""select data_type, cast(yr as int) as yr, src, dst,
        round(case when data_type in ('depot_location', 'refinery_location') then 1e0 else value end, 6) as value from flows
        where data_type not in ('biomass_demand_supply', 'pellet_demand_supply') or value <> 0"""),
    "check_nonnegative": check(C1),
    "check_site_supply": check(C2),
    "check_depot_capacity": check(C3),
    "check_refinery_capacity": check(C4),
    "check_counts": check(C56),
    "check_coverage": check(C7),
    "check_flow_balance": check(C8),
    "check_locations": check(C9),
    "audit": check(AUDIT),
    "repair_overload": sql(HIST, FLOWS, """loads as (select yr, src, sum(value) as load, max(sum(value)) over (partition by yr) as top
        from flows where data_type = 'pellet_demand_supply' group by 1, 2)""", select=f"""
        select data_type, cast(f.yr as int) as yr, f.src, dst, round(case when data_type = 'pellet_demand_supply' and top > {DEPOT_CAP}
               then value - 0.01e0 else value end, 6) as value, 'shave' as mode
        from flows f left join loads l on l.yr = f.yr and l.src = f.src where data_type <> 'biomass_forecast'
        union all
        select data_type, cast(f.yr as int), f.src, dst, round(case when data_type = 'pellet_demand_supply' and load > {DEPOT_CAP}
               then value * {DEPOT_CAP}e0 / load else value end, 6), 'scale'
        from flows f left join loads l on l.yr = f.yr and l.src = f.src where data_type <> 'biomass_forecast'"""),
    "flow_totals": sql(HIST, FLOWS, select="""select yr, round(sum(case when data_type = 'biomass_demand_supply' then value else 0 end), 6) as biomass,
        round(sum(case when data_type = 'pellet_demand_supply' then value else 0 end), 6) as pellets
        from flows where data_type in ('biomass_demand_supply', 'pellet_demand_supply') group by 1"""),
}
