"""One query for each operator over the grid derived from the star-schema tables, with its SQL where SQL can say it.

Rounded to six decimals (or fewer): sums meet in another order in each engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import balance, flows, limits, physical, profiles, radial, rows, topology, ybus
from ..schema import VIOLATION_TOL, RowStatus
from ..sources.grid import derived_grid, ieee14, make_grid
from .api import ContingencyAnalysis
from .powerflow import row_inputs, solve_rows, voltages
from .solver import Options

TIGHT = Options(tol=1e-11)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(*cols: str, n: int = 6) -> list:
    """Columns rounded, without negative zeros."""
    return [(F.round(c, n) + 0.0).alias(c) for c in cols]


def _order_rows(spark, d) -> DataFrame:
    """(row_id, g, k): an order's region and load factor."""
    # Each row's loads, voltages, flows and records (dozens of them) are worked out where the row is dealt to.
    orders = _t(spark, d, "orders")
    n = orders.count()
    cust = _t(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(_t(spark, d, "nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    r = orders.select("o_orderkey", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_orderkey as row_id", "n_regionkey as g")
    return rows.by_row(r, n).selectExpr("row_id", "g", "0.8D + 0.4D * (row_id % 97) / 96 as k")


def _order_loads(spark, d, grid) -> DataFrame:
    load = grid.load.join(F.broadcast(_t(spark, d, "nation").select("n_nationkey", "n_regionkey")), F.col("load_id") == F.col("n_nationkey"))
    return _order_rows(spark, d).join(F.broadcast(load.selectExpr("load_id", "n_regionkey as g", "p_mw as p", "q_mvar as q")), "g").selectExpr("row_id", "load_id", "k * p as p_mw", "k * q as q_mvar")


def _order_sbus(spark, d, grid) -> DataFrame:
    return _order_loads(spark, d, grid).selectExpr("row_id", "100 + load_id as bus_id", "-p_mw as p_mw", "-q_mvar as q_mvar")


def _v(spark, d, grid) -> DataFrame:
    return radial.closed_form(grid, _order_sbus(spark, d, grid))


def _with_hubs(spark, d, v) -> DataFrame:
    hubs = _order_rows(spark, d).selectExpr("row_id", "cast(g as int) as bus_id", "1.0D as vm", "0.0D as va", "1.0D as re", "0.0D as im")
    return v.select("row_id", "bus_id", "vm", "va", "re", "im").unionByName(hubs)


def _line_trips(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").selectExpr("l_orderkey as row_id", "cast(l_partkey % 50 as int) as branch_id")


def _gen_off(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").selectExpr("l_orderkey as row_id", "'gen' as element_type", "cast(l_suppkey as int) as element_id").distinct()


def _spur_trips(spark, d) -> DataFrame:
    """Row n opens a nation's transformer and its two ring lines (for odd n only one of them)."""
    n = _t(spark, d, "nation").selectExpr("n_nationkey as n", "n_regionkey as g")
    n = n.selectExpr("n", "coalesce(lag(n) over (partition by g order by n), max(n) over (partition by g)) as before")
    return n.select(F.col("n").cast("long").alias("row_id"), F.explode(F.expr("cast(case when n % 2 = 0 then array(25 + n, n, before) else array(25 + n, n) end as array<int>)")).alias("branch_id"))


# ---- rows, matrix, topology -------------------------------------------------------------------

def ybus_assembly(spark, d):
    return ybus.assemble(derived_grid(spark, d, rings=True)).select("i", "j", *_r("g", "b"))


def branch_patch(spark, d):
    return ybus.trip_patches(derived_grid(spark, d, rings=True), _line_trips(spark, d).distinct()).select("row_id", "branch_id", "i", "j", *_r("dg", "db"))


def branch_patch_merged(spark, d):
    g = derived_grid(spark, d, rings=True)
    trips = rows.by_row(_line_trips(spark, d), _t(spark, d, "lineitem").count())
    return ybus.merge_patches(ybus.trip_patches(g, trips.distinct())).select("row_id", "i", "j", *_r("dg", "db"))


def one_sided_patch(spark, d):
    opened = _t(spark, d, "lineitem").selectExpr("l_orderkey as row_id", "cast(l_partkey % 50 as int) as branch_id", "1 + l_linenumber % 2 as side").groupBy("row_id", "branch_id").agg(F.min("side").alias("side"))
    return ybus.one_sided(derived_grid(spark, d, rings=True), opened).select("row_id", "branch_id", "i", "j", *_r("dg", "db"))


def trip_dedup(spark, d):
    t = _line_trips(spark, d).selectExpr("row_id", "'branch' as element_type", "branch_id as element_id")
    return rows.normalise_sides(t).groupBy("row_id").agg(F.count("*").alias("n_trips"), F.sum("element_id").alias("id_sum"))


def side_normalise(spark, d):
    t = _t(spark, d, "lineitem").selectExpr("l_orderkey as row_id", "case l_linenumber % 4 when 0 then 'branch_side1' when 1 then 'branch_side2' when 2 then 'load' else 'branch' end as element_type", "cast(l_partkey % 3 as int) as element_id")
    return rows.normalise_sides(t)


def n1_enumeration(spark, d):
    return rows.n_minus_1(derived_grid(spark, d, rings=True))


def scenario_assembly(spark, d):
    return _order_loads(spark, d, derived_grid(spark, d)).select("row_id", "load_id", *_r("p_mw", "q_mvar"))


def day_scenarios(spark, d):
    """Generators that follow the loads along a day in quarters of an hour, without noise (SQL has no equal hash)."""
    return profiles.hourly_scenarios(spark, derived_grid(spark, d), 96, sigma=0.0)[1].select("row_id", "gen_id", *_r("p_mw", n=5))


def bus_injections(spark, d):
    g = derived_grid(spark, d)
    load = _order_loads(spark, d, g)
    return rows.bus_injections(g, load, load, off=_gen_off(spark, d)).select("row_id", "bus_id", *_r("p_mw", "q_mvar", n=5))


def gen_off_injections(spark, d):
    g = derived_grid(spark, d)
    return _gen_off(spark, d).join(F.broadcast(g.gen.select(F.col("gen_id").alias("element_id"), "bus_id", "p_mw")), "element_id").groupBy("row_id", "bus_id").agg(F.sum("p_mw").alias("lost_mw")).select("row_id", "bus_id", *_r("lost_mw", n=5))


def pv_to_pq_flip(spark, d):
    return rows.pv_flips(derived_grid(spark, d), _gen_off(spark, d))


def gen_v_conflict(spark, d):
    gen_v = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id"), F.col("l_suppkey").cast("int").alias("gen_id")).agg(F.max(F.expr("case when l_linenumber % 3 = 0 then cast(null as double) else 1 + 0.001D * (l_linenumber % 2) end")).alias("v"))
    return rows.set_points(derived_grid(spark, d), gen_v).select("row_id", "bus_id", *_r("v_set", "spread"), "conflict")


def bridge_rows(spark, d):
    """Rows that split off a part, against the components of the whole grid (one for each region)."""
    g = derived_grid(spark, d, rings=True)
    trips = _spur_trips(spark, d)
    comp = _components(g, trips)
    return topology.split_rows(comp).selectExpr("row_id", "n_components", "n_components > 5 as disconnected")


def _components(g, trips):
    edges = topology.live_edges(ybus.assemble(g), ybus.trip_patches(g, trips), trips)
    nodes = trips.select("row_id").distinct().crossJoin(F.broadcast(g.bus.select("bus_id")))
    return topology.components(edges, nodes)


def component_mask(spark, d):
    g = derived_grid(spark, d, rings=True)
    return topology.component_mask(_components(g, _spur_trips(spark, d)))


def reference_slack(spark, d):
    g = derived_grid(spark, d, rings=True)
    mask = topology.component_mask(_components(g, _spur_trips(spark, d)))
    return topology.reference_slack(mask, g.gen.selectExpr("bus_id", "weight"))


# ---- power flow ---------------------------------------------------------------------------------

def pf_radial_voltage(spark, d):
    """Newton on every order's scenario; the closed form of the radial grid is the check."""
    g = derived_grid(spark, d)
    sbus = _order_sbus(spark, d, g)
    return _region_voltages(spark, d, g, sbus)


def _region_voltages(spark, d, g, sbus, **parts):
    """Voltages of each row's own region; NaN where the row has no usable result (too much is fed in or drawn for any solution)."""
    solved = solve_rows(g, row_inputs(g, sbus, sbus, **parts), TIGHT)
    sound = F.expr(f"status <> {int(RowStatus.NOT_SIMULATED)} and residual <= {VIOLATION_TOL}")
    out = voltages(g, solved.withColumns({c: F.when(sound, F.col(c)).otherwise(F.transform(c, lambda x: F.lit(float("nan")))) for c in ("vm", "va")}))
    return out.join(_order_sbus(spark, d, g).select("row_id", "bus_id"), ["row_id", "bus_id"]).select("row_id", "bus_id", *_r("vm", "va"))


def load_trip(spark, d):
    """Newton on every order's scenario with one load off, against the closed form."""
    g = derived_grid(spark, d)
    load = _order_loads(spark, d, g)
    trip = _order_rows(spark, d).selectExpr("row_id", "'load' as element_type", "cast(row_id % 25 as int) as element_id")
    return _region_voltages(spark, d, g, rows.bus_injections(g.with_(gen=g.gen.limit(0)), load, load, off=trip), elements=trip)


def gen_off_solve(spark, d):
    """Newton on every order's scenario with the suppliers' generators, less those of its line items, against the closed form."""
    g = derived_grid(spark, d)
    load = _order_loads(spark, d, g)
    off = _gen_off(spark, d)
    return _region_voltages(spark, d, g, rows.bus_injections(g, load, load, off=off), elements=off)


def pf_residual(spark, d):
    g = derived_grid(spark, d)
    sbus = _order_sbus(spark, d, g)
    return solve_rows(g, row_inputs(g, sbus, sbus)).selectExpr("row_id", "status", "residual < 1e-8 as small", "n_iter")


def pf_meshed_status(spark, d):
    g = derived_grid(spark, d, rings=True)
    trips = _spur_trips(spark, d)
    return solve_rows(g, row_inputs(g, trips, trips=trips), handle_islands=True).select("row_id", "status", "disconnected", *_r("slack_mw", n=4))


def pf_ieee14_n1(spark, d):
    study = ContingencyAnalysis(ieee14(spark))
    study.n_minus_1()
    return study.compute().select("row_id", "status", "n_iter", *_r("slack_mw", n=4))


def pf_outer_loops(spark, d):
    study = ContingencyAnalysis(ieee14(spark), Options(outer=("distributed_slack", "reactive_limits")))
    study.n_minus_1()
    return study.compute().select("row_id", "status", "n_outer", "failed_loop", F.size("decisions").alias("n_decisions"))


def pf_distributed_slack(spark, d):
    study = ContingencyAnalysis(ieee14(spark), Options(distributed_slack=True))
    study.n_minus_1()
    return study.compute().select("row_id", "status", *_r("slack_mw", n=4))


# ---- flows, limits, balance -----------------------------------------------------------------------

def kcl_mismatch(spark, d):
    g = derived_grid(spark, d)
    v = _with_hubs(spark, d, _v(spark, d, g))
    return flows.kcl_mismatch(g, ybus.assemble(g), v, _order_sbus(spark, d, g)).selectExpr("row_id", "bus_id", "delta < 1e-9 as balanced")


def kcl_summary(spark, d):
    g = derived_grid(spark, d)
    v = _with_hubs(spark, d, _v(spark, d, g)).withColumn("re", F.expr("case when bus_id < 100 then re else re + 0.01D end"))
    s = flows.kcl_summary(flows.kcl_mismatch(g, ybus.assemble(g), v, _order_sbus(spark, d, g)))
    return s.select("n_rows", *_r("avg_mean", "max_mean", "avg_std", "max_max", "avg_p95", "avg_l2", n=4))


def _flows(spark, d, g, trips=None):
    f = flows.branch_flows(g, _with_hubs(spark, d, _v(spark, d, g)), trips)
    # A row has no voltages but its own region's: its branches are those of the nations there that have a load.
    return f.join(F.broadcast(g.load.selectExpr("load_id as branch_id")), "branch_id", "left_semi")


def branch_flows_amps(spark, d):
    return _flows(spark, d, derived_grid(spark, d)).select("row_id", "branch_id", *_r("i_or_a", "i_ex_a", n=5))


def branch_flows_power(spark, d):
    return _flows(spark, d, derived_grid(spark, d)).select("row_id", "branch_id", *_r("p_or_mw", "q_or_mvar", "p_ex_mw", "q_ex_mvar", n=5))


def _flow_trips(spark, d):
    return _t(spark, d, "lineitem").selectExpr("l_orderkey as row_id", "cast(l_partkey % 25 as int) as branch_id").distinct()


def tripped_flows_zero(spark, d):
    return _flows(spark, d, derived_grid(spark, d), _flow_trips(spark, d)).select("row_id", "branch_id", *_r("i_or_a", n=5))


def voltage_limits(spark, d):
    g = derived_grid(spark, d)
    return limits.voltage_limits(g, _v(spark, d, g)).select("row_id", "element_id", "violation_type", *_r("value", "limit", n=5))


def current_limits(spark, d):
    g = derived_grid(spark, d)
    return limits.current_limits(g, _flows(spark, d, g), _flow_trips(spark, d)).select("row_id", "element_id", "side", *_r("value", "limit"))


def _all_limits(spark, d, g):
    return limits.voltage_limits(g, _v(spark, d, g)).unionByName(limits.current_limits(g, _flows(spark, d, g)))


def violations_topk(spark, d):
    g = derived_grid(spark, d)
    x = _all_limits(spark, d, g).withColumn("severity", F.round("severity", 9))
    return limits.top_k(x, 2).select("row_id", "violation_type", "rank", "element_id", "side", *_r("severity"))


def violation_counts(spark, d):
    g = derived_grid(spark, d)
    return limits.counts(_order_rows(spark, d), _all_limits(spark, d, g), capacity=4)


def violations_base(spark, d):
    """The unchanged grid as one row: LOW, HIGH, then CURRENT."""
    g = derived_grid(spark, d)
    sbus = g.load.selectExpr("cast(0 as long) as row_id", "bus_id", "-p_mw as p_mw", "-q_mvar as q_mvar")
    x = limits.voltage_limits(g, radial.closed_form(g, sbus)).withColumn("severity", F.round("severity", 9))
    return limits.top_k(x, 16, base_order=True).select("type_order", "violation_type", "rank", "element_id", *_r("value", n=5))


def row_status(spark, d):
    r = _t(spark, d, "events").selectExpr("event_id as row_id", "case when event_id % 7 = 0 then cast('NaN' as double) else abs(value) * 1e-9 end as residual", "cast(case when event_id % 11 = 0 then 4 else 0 end as int) as status")
    return limits.converged(r, 1e-8).select("row_id", "converged")


def solver_records(spark, d):
    r = _t(spark, d, "events").selectExpr("event_id as row_id", "case when event_id % 7 = 0 then cast('NaN' as double) else abs(value) * 1e-7 end as residual", "cast(case when event_id % 13 = 0 then 3 else 0 end as int) as status", "case when event_id % 26 = 0 then 'why' end as reason")
    return limits.solver_records(r, 1e-6).select("row_id", "element_type", "violation_type")


def category_dim(spark, d):
    return limits.category_table(spark)


def bus_q_check(spark, d):
    g = derived_grid(spark, d)
    v = _with_hubs(spark, d, _v(spark, d, g))
    return physical.bus_q_check(g, ybus.assemble(g), v, _order_sbus(spark, d, g).withColumn("q_mvar", F.expr("q_mvar * 0.2D")), _gen_off(spark, d)).select("row_id", "bus_id", *_r("q_mvar", "q_min", "q_max", n=4), "violation_type")


#: Parts that the rows of one state are dealt in, where each has as many records as the grid has generators.
SPREAD = 8


def gen_p_check(spark, d):
    """A row has up to 4 buses' generators as records; what they are depends on the bus and its mismatch alone."""
    mis = _order_rows(spark, d).crossJoin(F.broadcast(spark.range(4).withColumnRenamed("id", "n"))).selectExpr("row_id", "cast(100 + n as int) as bus_id", "20D * (k - 1) * (n + 1) as mw")
    found = physical.gen_p_check(derived_grid(spark, d), rows.states(mis, "bus_id", "mw")).select("row_id", "gen_id", *_r("value", "limit"), "violation_type")
    return rows.of_states(mis, found, "bus_id", "mw", spread=SPREAD)


def _hvdc(spark):
    return make_grid(spark, hvdc=[(i, 100 + 5 * i, 101 + 5 * i, 4.0 - 2 * i, 900.0, 0.01, 0.02, 0.0004, 3.0) for i in range(5)]).hvdc


def _all_v(spark, d):
    """Voltages of every bus on every order's row, whose factor goes to all loads."""
    g = derived_grid(spark, d)
    sbus = _order_rows(spark, d).crossJoin(F.broadcast(g.load)).selectExpr("row_id", "bus_id", "-k * p_mw as p_mw", "-k * q_mvar as q_mvar")
    return radial.closed_form(g, sbus)


def hvdc_flow(spark, d):
    return physical.hvdc_flow(_hvdc(spark), _all_v(spark, d)).select("row_id", "hvdc_id", *_r("raw", "p1_mw", "p2_mw", n=5))


def hvdc_saturation(spark, d):
    return physical.hvdc_saturation(physical.hvdc_flow(_hvdc(spark), _all_v(spark, d))).select("row_id", "hvdc_id", "side", *_r("value", "limit", n=5))


def control_releases(spark, d):
    f = _t(spark, d, "nation").selectExpr("5 as element_type", "cast(n_nationkey as int) as element_id", "cast(100 + n_nationkey as int) as reg_bus", "n_nationkey % 2 = 0 as at_min", "n_nationkey % 5 = 0 as standby", "0.9967D as v_target", "0.9962D as v_low", "0.9972D as v_high", "n_nationkey % 7 = 1 as remote")
    frozen = _order_rows(spark, d).select("row_id").crossJoin(F.broadcast(f))
    return physical.releases(frozen, _all_v(spark, d), 1e-4).select("row_id", "element_id", "violation_type", *_r("value", "limit"))


def _slack_rows(spark, d):
    """(row_id, g, lost_mw): what a row's region has lost. Regions times load factors (at most 97) are all states that there are."""
    return _order_rows(spark, d).selectExpr("row_id", "g", "100D * (k - 0.9D) as lost_mw")


def _slack_states(spark, d, slack_rows):
    """(units, lost) of every state of the rows: a region's generators are one list, however many rows share it."""
    lost = rows.states(slack_rows, "g", "lost_mw")
    gen = derived_grid(spark, d).gen.join(F.broadcast(_t(spark, d, "nation").selectExpr("100 + n_nationkey as bus_id", "n_regionkey as g")), "bus_id")
    return lost.select("row_id", "g").join(gen, "g").select("row_id", "gen_id", "p_mw", "weight", "min_p", "max_p"), lost.select("row_id", "lost_mw")


def slack_lost_power(spark, d):
    return balance.lost_power(derived_grid(spark, d), _gen_off(spark, d)).select("row_id", *_r("lost_mw", n=5))


def slack_distribute_1round(spark, d):
    """Rows x units of their region come out; each state is shared out once."""
    r = _slack_rows(spark, d)
    found = balance.one_round(*_slack_states(spark, d, r)).select("row_id", "gen_id", *_r("new_p"), "saturated")
    return rows.of_states(r, found, "g", "lost_mw", spread=SPREAD)


def slack_distribute_full(spark, d):
    """Checked by what must hold: nothing lost, nobody beyond a limit."""
    r = _slack_rows(spark, d)
    x = balance.distribute(*_slack_states(spark, d, r))
    found = x.groupBy("row_id").agg(F.sum(F.expr("new_p - p_mw")).alias("given"), F.first("mismatch_mw").alias("m"), F.first("not_distributed_mw").alias("l"), F.count("*").alias("n_units")).selectExpr("row_id", "abs(given + l - m) < 1e-6 as conserved", "n_units")
    return rows.of_states(r, found, "g", "lost_mw")


def slack_weights(spark, d):
    r = _slack_rows(spark, d)
    found = balance.slack_weights(derived_grid(spark, d), balance.one_round(*_slack_states(spark, d, r)), 0).select("row_id", "bus_id", *_r("weight"))
    return rows.of_states(r, found, "g", "lost_mw")


def _records(spark, d):
    g = derived_grid(spark, d)
    return limits.voltage_limits(g, _v(spark, d, g)).withColumn("severity", F.round("severity", 9))


def _base_records(spark, d):
    g = derived_grid(spark, d)
    sbus = g.load.selectExpr("cast(0 as long) as row_id", "bus_id", "-p_mw as p_mw", "-q_mvar as q_mvar")
    return limits.voltage_limits(g, radial.closed_form(g, sbus))


def new_vs_base(spark, d):
    return limits.new_vs_base(_records(spark, d), _base_records(spark, d)).groupBy("element_id", "violation_type").agg(F.count("*").alias("n"))


def n1_report(spark, d):
    r = _t(spark, d, "events").selectExpr("event_id as row_id", "cast(event_id % 3 as int) as status", "abs(value) * 1e-9 as residual")
    return limits.n1_report(r, _records(spark, d), _base_records(spark, d)).select("n_rows", "n_converged", "rows_with_records", "n_records", "n_new", "rows_with_new", (F.round(F.col("residual_median") * 1e9, 6) + 0.0).alias("median_e9"), (F.round(F.col("residual_max") * 1e9, 6) + 0.0).alias("max_e9"))


def worst_rows(spark, d):
    return limits.worst_rows(_records(spark, d)).select("row_id", "n_records", *_r("worst"))


def second_pass_merge(spark, d):
    a = _t(spark, d, "orders").selectExpr("o_orderkey as row_id", "o_totalprice as x", "o_orderstatus as s")
    b = a.where("row_id % 5 = 0").selectExpr("row_id", "x * 2 as x", "cast(null as string) as s")
    return physical.second_pass_merge(a, b, ["row_id"]).select("row_id", *_r("x", n=3), "s", "second_pass")


def throughput_pivot(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.max("l_extendedprice")).select("l_returnflag", *_r("F", "O", n=2))


NAMES = [ybus_assembly, branch_patch, branch_patch_merged, one_sided_patch, trip_dedup, side_normalise, n1_enumeration, scenario_assembly, day_scenarios, bus_injections, gen_off_injections, pv_to_pq_flip, gen_v_conflict,
         bridge_rows, component_mask, reference_slack, pf_radial_voltage, load_trip, gen_off_solve, pf_residual, pf_meshed_status, pf_ieee14_n1, pf_outer_loops, pf_distributed_slack, kcl_mismatch, kcl_summary, branch_flows_amps,
         branch_flows_power, tripped_flows_zero, voltage_limits, current_limits, violations_topk, violation_counts, violations_base, row_status, solver_records, category_dim, bus_q_check, gen_p_check, hvdc_flow,
         hvdc_saturation, control_releases, slack_lost_power, slack_distribute_1round, slack_distribute_full, slack_weights, new_vs_base, n1_report, worst_rows, second_pass_merge, throughput_pivot]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
