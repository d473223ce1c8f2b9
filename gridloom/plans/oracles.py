"""SQL of the queries, for DuckDB. Common tables come first; each query takes the ones that it names."""

from __future__ import annotations

import re

from ..operators import profiles

_TABLES = {
    "nat": "select n_nationkey as n, n_regionkey as g from nation",
    "load": "select c_nationkey as load_id, 20 + 1.0::double / 7 + 0.002::double * avg(c_acctbal) as p, 0.3 * (20 + 1.0::double / 7 + 0.002::double * avg(c_acctbal)) as q from customer group by 1",
    "gen": """select s_suppkey::int as gen_id, (100 + s_nationkey)::int as bus_id, 0.001 * s_acctbal as p_mw, 1.0 + 0.001 * (s_suppkey % 3) as v_set, 0.0 as min_p, 5.0 + (s_suppkey % 7) as max_p,
        -2.0 as min_q, 2.0 as max_q, (1.0 + (s_suppkey % 4))::double as weight from supplier""",
    "trafo": "select n as branch_id, g as f, 100 + n as t, 0.002::double + 0.0005::double * (n % 5) as r, 0.02::double + 0.003::double * (n % 7) as x, 0.0::double as b from nat",
    "ring": """select n as branch_id, 100 + n as f, 100 + m as t, 0.004::double + 0.001::double * (n % 3) as r, 0.03::double + 0.004::double * (n % 4) as x, 0.02::double as b
        from (select n, coalesce(lead(n) over (partition by g order by n), min(n) over (partition by g)) as m from nat)""",
    "br": "select * from ring union all select branch_id + 25, f, t, r, x, b from trafo",
    "adm": """select branch_id, f, t, r / (r * r + x * x) as gs, -x / (r * r + x * x) as bs, b from br""",
    "stamp": """select branch_id, f as i, f as j, gs as g, bs + b / 2 as b from adm union all select branch_id, f, t, -gs, -bs from adm
        union all select branch_id, t, f, -gs, -bs from adm union all select branch_id, t, t, gs, bs + b / 2 from adm""",
    "ords": "select o_orderkey as row_id, n_regionkey as g, 0.8::double + 0.4::double * (o_orderkey % 97) / 96 as k from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
    "oload": "select row_id, load_id, k * p as p, k * q as q from ords join nat using (g) join load on load_id = n",
    "goff": "select distinct l_orderkey as row_id, l_suppkey::int as gen_id from lineitem",
    "pq": "select row_id, load_id, p / 100 as p, q / 100 as q, r, x from oload join trafo on branch_id = load_id",
    "vsol": """select row_id, load_id, p, q, r, x, sqrt(v2) as vm, -atan2(p * x - q * r, v2 + p * r + q * x) as va from (
        select *, (0.5 - (p * r + q * x)) + sqrt((0.5 - (p * r + q * x)) * (0.5 - (p * r + q * x)) - (p * p + q * q) * (r * r + x * x)) as v2 from pq)""",
    "cur": """select *, sqrt(ir * ir + ii * ii) as i from (select *, (gs * (1 - re) + bs * im) as ir, (bs * (1 - re) - gs * im) as ii from (
        select *, vm * cos(va) as re, vm * sin(va) as im, r / (r * r + x * x) as gs, -x / (r * r + x * x) as bs from vsol))""",
    "vlim": """select row_id, load_id, vt, value, lim, round(abs(value / lim - 1), 9) as sev from (select row_id, load_id, vm * 225 as value,
        case when vm * 225 < 225 * 0.9960 * (1 - 1e-9) then 0 when vm * 225 > 225 * 0.9973 * (1 + 1e-9) then 1 end as vt,
        case when vm * 225 < 225 * 0.9960 * (1 - 1e-9) then 225 * 0.9960 else 225 * 0.9973 end as lim from vsol) where vt is not null""",
    "ftrip": "select distinct l_orderkey as row_id, l_partkey % 25 as branch_id from lineitem",
    "clim": """select row_id, load_id, side, value, lim, round(abs(value / lim - 1), 9) as sev from (
        select row_id, load_id, 1 as side, i * 100 / (sqrt(3.0) * 400) as value, 0.045::double as lim from cur union all select row_id, load_id, 2, i * 100 / (sqrt(3.0) * 225), 0.080::double from cur) where value > lim * (1 + 1e-9)""",
    "sides": "select distinct l_orderkey as row_id, l_linenumber % 4 as k, (l_partkey % 3)::int as element_id from lineitem",
    "spur": """select n as row_id, unnest(case when n % 2 = 0 then [25 + n, n, bef] else [25 + n, n] end) as branch_id from (select n, coalesce(lag(n) over (partition by g order by n), max(n) over (partition by g)) as bef from nat)""",
    "bus": "select r_regionkey as bus_id from region union all select 100 + n from nat",
    "edges": "select s.row_id, b.f as a, b.t as b from (select distinct row_id from spur) s cross join br b where not exists (select 1 from spur x where x.row_id = s.row_id and x.branch_id = b.branch_id)",
    "twoway": "select row_id, a, b from edges union select row_id, b, a from edges",
    "reach": "select s.row_id, bus_id as src, bus_id as dst from (select distinct row_id from spur) s cross join bus union select r.row_id, r.src, e.b from reach r join twoway e on e.row_id = r.row_id and e.a = r.dst",
    "comp": "select row_id, src as bus_id, min(dst) as comp from reach group by 1, 2",
    "size": "select row_id, comp, count(*) as n from comp group by 1, 2",
    "main": "select row_id, comp as main from (select *, row_number() over (partition by row_id order by n desc, comp) as k from size) where k = 1",
    "mask": "select row_id, bus_id, comp, comp <> main as masked from comp join main using (row_id)",
    "unit": "select row_id, gen_id, p_mw, weight, bus_id, case when p_mw < 0 then min_p else greatest(min_p, 0) end as lo, case when p_mw < 0 then least(max_p, 0) else max_p end as hi, 100 * (k - 0.9) as lost from ords join nat using (g) join gen on bus_id = 100 + n",
    "share": "select *, p_mw + lost * weight / sum(weight) over (partition by row_id) as cand from unit",
    "round1": """select row_id, gen_id, bus_id, weight, case when lost > 0 and cand >= hi then greatest(p_mw, hi) when lost < 0 and cand <= lo then least(p_mw, lo) else cand end as new_p,
        (lost > 0 and cand >= hi) or (lost < 0 and cand <= lo) as saturated from share""",
    "allv": """select *, sqrt(v2) as vm, -atan2(p * x - q * r, v2 + p * r + q * x) as va from (select *, (0.5 - (p * r + q * x)) + sqrt((0.5 - (p * r + q * x)) * (0.5 - (p * r + q * x)) - (p * p + q * q) * (r * r + x * x)) as v2 from (
        select row_id, load_id, k * l.p / 100 as p, k * l.q / 100 as q, r, x from ords cross join load l join trafo on branch_id = load_id))""",
    "hv": """select row_id, h as hvdc_id, raw, abs(raw) * (1 - case when raw >= 0 then 0.01 else 0.02 end) as y, case when raw >= 0 then 0.02 else 0.01 end as lr from (
        select a.row_id, h, (4.0 - 2 * h) + 900.0 * (a.va - b.va) as raw from range(5) t(h) join allv a on a.load_id = 5 * h join allv b on b.load_id = 5 * h + 1 and b.row_id = a.row_id)""",
    "basev": "select load_id, sqrt(a + sqrt(a * a - (p * p + q * q) * (r * r + x * x))) as vm from (select *, 0.5 - (p * r + q * x) as a from (select load_id, p / 100 as p, q / 100 as q, r, x from load join trafo on branch_id = load_id))",
    "baselim": """select load_id, value, vt, round(abs(value / lim - 1), 9) as sev from (select load_id, vm * 225 as value, case when vm * 225 < 225 * 0.9960 * (1 - 1e-9) then 0 when vm * 225 > 225 * 0.9973 * (1 + 1e-9) then 1 end as vt,
        case when vm * 225 < 225 * 0.9960 * (1 - 1e-9) then 225 * 0.9960 else 225 * 0.9973 end as lim from basev) where vt is not null""",
    "newrec": "select v.* from vlim v where not exists (select 1 from baselim b where b.load_id = v.load_id and b.vt = v.vt)",
}


def _closed(source: str) -> str:
    """Voltages at the far ends of the radial grid for rows (row_id, load_id, p, q per unit drawn, r, x)."""
    a = "(0.5 - (p * r + q * x))"
    return f"""select row_id, 100 + load_id as bus_id, {_r('sqrt(v2)', 'vm')}, {_r('-atan2(p * x - q * r, v2 + p * r + q * x)', 'va')} from (
        select *, {a} + sqrt({a} * {a} - (p * p + q * q) * (r * r + x * x)) as v2 from ({source}))"""


def _needs(sql: str, among: list[str]) -> set[str]:
    """Names of the common tables that sql takes, with those that they take: a table takes only ones above it."""
    own = {n for n in among if re.search(rf"\b{n}\b(?!\s*\()", sql)}
    return own.union(*(_needs(_TABLES[n], among[: among.index(n)]) for n in own))


def _sql(body: str) -> str:
    needed = _needs(body, list(_TABLES))
    names = [n for n in _TABLES if n in needed]
    return f"with recursive {', '.join(f'{n} as ({_TABLES[n]})' for n in names)} {body}" if names else body


def _r(x: str, name: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0 as {name}"


_DAY = ", ".join(f"({hour}, {', '.join(f'{x!r}::double' for x in piece)})" for hour, piece in enumerate(profiles.cubic([h * 1.01 * 1.01 for h in [*profiles.HOURS, profiles.HOURS[0]]]).tolist()))

_BODIES = {
    "ybus_assembly": f"select i, j, {_r('sum(g)', 'g')}, {_r('sum(b)', 'b')} from stamp group by 1, 2",
    "branch_patch": f"select row_id, branch_id, i, j, {_r('-g', 'dg')}, {_r('-b', 'db')} from (select distinct l_orderkey as row_id, l_partkey % 50 as branch_id from lineitem) join stamp using (branch_id)",
    "branch_patch_merged": f"select row_id, i, j, {_r('sum(-g)', 'dg')}, {_r('sum(-b)', 'db')} from (select distinct l_orderkey as row_id, l_partkey % 50 as branch_id from lineitem) join stamp using (branch_id) group by 1, 2, 3",
    "one_sided_patch": f"""select row_id, branch_id, i, j, {_r('dg', 'dg')}, {_r('db', 'db')} from (
        select row_id, branch_id, unnest([{{'i': o, 'j': o, 'dg': -gs, 'db': -(bs + b / 2)}}, {{'i': o, 'j': k, 'dg': gs, 'db': bs}}, {{'i': k, 'j': o, 'dg': gs, 'db': bs}},
          {{'i': k, 'j': k, 'dg': -(mr * gs + mi * (bs + b / 2)) / (gs * gs + (bs + b / 2) * (bs + b / 2)), 'db': -(mi * gs - mr * (bs + b / 2)) / (gs * gs + (bs + b / 2) * (bs + b / 2))}}], recursive := true)
        from (select l_orderkey as row_id, l_partkey % 50 as branch_id, min(1 + l_linenumber % 2) as side from lineitem group by 1, 2)
        join (select *, gs * gs - bs * bs as mr, 2 * gs * bs as mi from adm) using (branch_id), lateral (select case when side = 1 then f else t end as o, case when side = 1 then t else f end as k))""",
    "trip_dedup": "select row_id, count(*) as n_trips, sum(b) as id_sum from (select distinct l_orderkey as row_id, l_partkey % 50 as b from lineitem) group by 1",
    "side_normalise": """select row_id, 'load' as element_type, element_id from sides where k = 2 union all
        select row_id, case when bool_or(k = 3) or (bool_or(k = 0) and bool_or(k = 1)) then 'branch' when bool_or(k = 0) then 'branch_side1' else 'branch_side2' end, element_id from sides where k <> 2 group by 1, 3""",
    "n1_enumeration": "select branch_id as row_id, 'branch' as element_type, branch_id as element_id from br",
    "scenario_assembly": f"select row_id, load_id, {_r('p', 'p_mw')}, {_r('q', 'q_mvar')} from oload",
    "bus_injections": f"""select row_id, bus_id, {_r('sum(p)', 'p_mw', 5)}, {_r('sum(q)', 'q_mvar', 5)} from (
        select row_id, 100 + load_id as bus_id, -p as p, -q as q from oload union all
        select row_id, bus_id, p_mw, 0.0 from ords cross join gen anti join goff using (row_id, gen_id)) group by 1, 2""",
    "gen_off_injections": f"select row_id, bus_id, {_r('sum(p_mw)', 'lost_mw', 5)} from goff join gen using (gen_id) group by 1, 2",
    "pv_to_pq_flip": "select row_id, bus_id from (select row_id, bus_id, count(*) as n from goff join gen using (gen_id) group by 1, 2) join (select bus_id, count(*) as n from gen group by 1) using (bus_id, n)",
    "gen_v_conflict": f"""select row_id, bus_id, {_r('max(v)', 'v_set')}, {_r('max(v) - min(v)', 'spread')}, max(v) - min(v) > 1e-8 as conflict from (
        select row_id, bus_id, coalesce(v, v_set) as v from (select l_orderkey as row_id, l_suppkey as gen_id, max(case when l_linenumber % 3 <> 0 then 1 + 0.001::double * (l_linenumber % 2) end) as v from lineitem group by 1, 2) join gen using (gen_id)) group by 1, 2""",
    "bridge_rows": "select row_id, count(distinct comp) as n_components, count(distinct comp) > 5 as disconnected from comp group by 1",
    "component_mask": "select row_id, bus_id, comp, masked from mask",
    "reference_slack": "select bus_id, coalesce(n, 0) as stranded from (select bus_id, max(weight) as w from gen group by 1) left join (select bus_id, count(*) as n from mask where masked group by 1) using (bus_id) order by 2, w desc, bus_id limit 1",
    "pf_radial_voltage": f"select row_id, 100 + load_id as bus_id, {_r('vm', 'vm')}, {_r('va', 'va')} from vsol",
    "load_trip": _closed("select row_id, load_id, case when row_id % 25 = load_id then 0 else p end as p, case when row_id % 25 = load_id then 0 else q end as q, r, x from pq"),
    "gen_off_solve": _closed("""select row_id, load_id, p - coalesce(fed, 0) / 100 as p, q, r, x from pq left join (
        select row_id, bus_id - 100 as load_id, sum(p_mw) as fed from ords join nat using (g) join gen on bus_id = 100 + n anti join goff using (row_id, gen_id) group by 1, 2) using (row_id, load_id)"""),
    "kcl_mismatch": "select row_id, 100 + load_id as bus_id, true as balanced from vsol",
    "branch_flows_amps": f"select row_id, load_id as branch_id, {_r('i * 100 * 1000 / (sqrt(3.0) * 400)', 'i_or_a', 5)}, {_r('i * 100 * 1000 / (sqrt(3.0) * 225)', 'i_ex_a', 5)} from cur",
    "branch_flows_power": f"select row_id, load_id as branch_id, {_r('ir * 100', 'p_or_mw', 5)}, {_r('-ii * 100', 'q_or_mvar', 5)}, {_r('-p * 100', 'p_ex_mw', 5)}, {_r('-q * 100', 'q_ex_mvar', 5)} from cur",
    "tripped_flows_zero": f"select c.row_id, load_id as branch_id, {_r('case when t.row_id is null then i * 100 * 1000 / (sqrt(3.0) * 400) else 0.0 end', 'i_or_a', 5)} from cur c left join ftrip t on t.row_id = c.row_id and t.branch_id = c.load_id",
    "voltage_limits": f"select row_id, 100 + load_id as element_id, vt as violation_type, {_r('value', 'value', 5)}, {_r('lim', 'limit', 5).replace('as limit', 'as \"limit\"')} from vlim",
    "current_limits": f"select c.row_id, load_id as element_id, side, {_r('value', 'value')}, {_r('lim', 'limit').replace('as limit', 'as \"limit\"')} from clim c where not exists (select 1 from ftrip t where t.row_id = c.row_id and t.branch_id = c.load_id)",
    "violations_topk": f"""select row_id, vt as violation_type, rank, e as element_id, side, {_r('sev', 'severity')} from (select *, row_number() over (partition by row_id, vt order by sev desc, scan) as rank from (
        select row_id, vt, 100 + load_id as e, 0 as side, sev, 100 + load_id as scan from vlim union all select row_id, 2, load_id, side, sev, 2 * load_id + side from clim)) where rank <= 2""",
    "violation_counts": """select row_id, coalesce(l, 0) as low_voltage, coalesce(h, 0) as high_voltage, coalesce(c, 0) as current, greatest(coalesce(l, 0), coalesce(h, 0), coalesce(c, 0)) > 4 as truncated from ords
        left join (select row_id, count(*) filter (vt = 0) as l, count(*) filter (vt = 1) as h from vlim group by 1) using (row_id) left join (select row_id, count(*) as c from clim group by 1) using (row_id)""",
    "violations_base": f"select vt as type_order, vt as violation_type, rank, 100 + load_id as element_id, {_r('value', 'value', 5)} from (select *, row_number() over (partition by vt order by sev desc, load_id) as rank from baselim) where rank <= 16",
    "row_status": "select event_id as row_id, event_id % 7 <> 0 and abs(value) * 1e-9 <= 1e-8 and event_id % 11 <> 0 as converged from events",
    "solver_records": """select event_id as row_id, 3 as element_type, case when event_id % 26 = 0 then 21 when event_id % 13 = 0 then 3 else 4 end as violation_type from events where event_id % 13 = 0 or event_id % 7 = 0 or abs(value) * 1e-7 > 1e-6""",
    "bus_q_check": f"""select row_id, bus_id, {_r('qm', 'q_mvar', 4)}, {_r('q_min', 'q_min', 4)}, {_r('q_max', 'q_max', 4)}, case when qm < q_min - 1e-4 then 5 else 6 end as violation_type from (
        select row_id, 100 + load_id as bus_id, -q * 100 + q * 100 * 0.2 as qm from vsol)
        join (select row_id, bus_id, sum(min_q) as q_min, sum(max_q) as q_max from (select row_id, bus_id, min_q, max_q from ords cross join gen anti join goff using (row_id, gen_id)) group by 1, 2) using (row_id, bus_id)
        where qm < q_min - 1e-4 or qm > q_max + 1e-4""",
    "gen_p_check": f"""select row_id, gen_id, {_r('p', 'value')}, {_r('case when p > max_p + 1e-4 then max_p else min_p end', 'limit').replace('as limit', 'as \"limit\"')}, case when p > max_p + 1e-4 then 7 else 8 end as violation_type from (
        select row_id, gen_id, min_p, max_p, p_mw + 20 * (k - 1) * (m + 1) * weight / w as p from ords cross join range(4) t(m) join gen on bus_id = 100 + m join (select bus_id as wb, sum(weight) as w from gen group by 1) on wb = bus_id)
        where p > max_p + 1e-4 or p < min_p - 1e-4""",
    "hvdc_flow": f"select row_id, hvdc_id, {_r('raw', 'raw', 5)}, {_r('case when raw >= 0 then raw else -(1 - lr) * (y - 0.0004 * y * y) end', 'p1_mw', 5)}, {_r('case when raw >= 0 then -(1 - lr) * (y - 0.0004 * y * y) else -raw end', 'p2_mw', 5)} from hv",
    "hvdc_saturation": f"select row_id, hvdc_id, case when raw >= 0 then 1 else 2 end as side, {_r('abs(raw)', 'value', 5)}, 3.0 as \"limit\" from hv where abs(raw) > 3.0001",
    "control_releases": f"""select row_id, load_id as element_id, vt as violation_type, {_r('vm', 'value')}, case when vt in (11, 13) then 0.9962 when vt in (12, 14) then 0.9972 else 0.9967 end::double as "limit" from (select row_id, load_id, vm,
        case when load_id % 5 = 0 then case when vm < 0.9962 - 1e-4 then 11 when vm > 0.9972 + 1e-4 then 12 end when load_id % 7 = 1 then case when vm < 0.9962 - 1e-4 then 13 when vm > 0.9972 + 1e-4 then 14 end
             when load_id % 2 = 0 and vm < 0.9967 - 1e-4 then 9 when load_id % 2 = 1 and vm > 0.9967 + 1e-4 then 10 end as vt from allv) where vt is not null""",
    "day_scenarios": f"""select row_id, gen_id, {_r('case when p_mw > 0 then p_mw * (total - negative) / base else p_mw end', 'p_mw', 5)} from gen, (select sum(p) as base from load),
        (select coalesce(sum(p_mw) filter (p_mw < 0), 0) as negative from gen),
        (select row_id, sum(p * (a + u * (b + u * (c + u * e)))) as total from load, (select hour * 4 + q as row_id, a, b, c, e, q / 4.0::double as u from (values {_DAY}) t(hour, a, b, c, e), (select unnest([0, 1, 2, 3]) as q)) group by 1)""",
    "slack_lost_power": f"select row_id, {_r('sum(p_mw)', 'lost_mw', 5)} from goff join gen using (gen_id) group by 1",
    "slack_distribute_1round": f"select row_id, gen_id, {_r('new_p', 'new_p')}, saturated from round1",
    "slack_distribute_full": "select row_id, true as conserved, count(*) as n_units from unit group by 1",
    "slack_weights": f"""select row_id, bus_id, {_r('w / total', 'weight')} from (select row_id, bus_id, sum(case when saturated then 0 else weight end) as w from round1 group by 1, 2)
        join (select row_id, sum(case when saturated then 0 else weight end) as total from round1 group by 1) using (row_id) where total > 0 and w > 0
        union all select row_id, 0, 1.0 from round1 group by row_id having sum(case when saturated then 0 else weight end) <= 0""",
    "new_vs_base": "select 100 + load_id as element_id, vt as violation_type, count(*) as n from newrec group by 1, 2",
    "n1_report": f"""select n_rows, n_converged, rows_with_records, n_records, n_new, rows_with_new, {_r('med', 'median_e9')}, {_r('mx', 'max_e9')} from
        (select count(*) as n_rows, count(*) filter (event_id % 3 = 0) as n_converged, median(abs(value)) as med, max(abs(value)) as mx from events), (select count(distinct row_id) as rows_with_records, count(*) as n_records from vlim),
        (select count(*) as n_new, count(distinct row_id) as rows_with_new from newrec)""",
    "worst_rows": f"select row_id, n_records, {_r('worst', 'worst')} from (select row_id, count(*) as n_records, max(sev) as worst from vlim group by 1 order by 2 desc, 3 desc, 1 limit 5)",
    "second_pass_merge": f"select o_orderkey as row_id, {_r('case when o_orderkey % 5 = 0 then o_totalprice * 2 else o_totalprice end', 'x', 3)}, case when o_orderkey % 5 <> 0 then o_orderstatus end as s, o_orderkey % 5 = 0 as second_pass from orders",
    "category_dim": """select * from (values (0, 'LOW_VOLTAGE', 0, 'OPERATIONAL'), (1, 'HIGH_VOLTAGE', 0, 'OPERATIONAL'), (2, 'CURRENT', 0, 'OPERATIONAL'), (3, 'NOT_SIMULATED', 2, 'SOLVER'), (4, 'DIVERGENCE', 2, 'SOLVER'),
        (5, 'LOW_Q', 1, 'PHYSICAL'), (6, 'HIGH_Q', 1, 'PHYSICAL'), (7, 'HIGH_P', 1, 'PHYSICAL'), (8, 'LOW_P', 1, 'PHYSICAL'), (9, 'LOW_VOLTAGE_AT_MIN_Q', 3, 'CONTROL'), (10, 'HIGH_VOLTAGE_AT_MAX_Q', 3, 'CONTROL'),
        (11, 'LOW_VOLTAGE_SVC_STANDBY', 3, 'CONTROL'), (12, 'HIGH_VOLTAGE_SVC_STANDBY', 3, 'CONTROL'), (13, 'LOW_VOLTAGE_REMOTE_CONTROL', 3, 'CONTROL'), (14, 'HIGH_VOLTAGE_REMOTE_CONTROL', 3, 'CONTROL'),
        (15, 'HVDC_AC_EMULATION_RELEASE', 3, 'CONTROL'), (21, 'BATCH_UNSUPPORTED', 2, 'SOLVER')) t(violation_type, type_name, category, category_name)""",
    "throughput_pivot": f"select l_returnflag, {_r('max(l_extendedprice) filter (l_linestatus = {0})'.format(chr(39) + 'F' + chr(39)), 'F', 2)}, {_r('max(l_extendedprice) filter (l_linestatus = {0})'.format(chr(39) + 'O' + chr(39)), 'O', 2)} from lineitem group by 1",
}

ORACLES = {k: _sql(v) for k, v in _BODIES.items()}
