import datetime

import numpy as np
import pytest

from gridloom.operators import balance, limits, rows
from gridloom.plans.api import AcPowerFlow, InjectionSweep, ScenarioSweep
from gridloom.plans.powerflow import arrays, row_inputs, solve_rows
from gridloom.plans.sensitivity import bus_gradients
from gridloom.plans.solver import Group, Hvdc, Options, Pattern, jacobian, mismatch
from gridloom.sources.grid import ieee14, read_grid, write_grid


@pytest.fixture(scope="module")
def grid(spark):
    return ieee14(spark)


def test_jacobian_against_differences():
    rng = np.random.default_rng(0)
    n = 5
    y = rng.standard_normal((n, n)) + 1j * rng.standard_normal((n, n))
    v = (1 + 0.05 * rng.standard_normal(n)) * np.exp(0.1j * rng.standard_normal(n))
    hv = Hvdc(np.array([1]), np.array([3]), np.array([0.1]), np.array([0.5]), np.array([0.01]), np.array([0.02]), np.array([0.03]), np.array([9.0]))
    group = Group(reg=2, buses=[2, 4], weights=[1.0, 2.0], v_set=1.01, slopes=[0.01, 0.0])
    pat = Pattern(np.array([1, 2, 3, 4]), np.array([2, 3, 4]), np.ones(n, bool), ref=0, groups=(group,))
    w, reg = np.full((1, n), 0.2), np.zeros((1, 1))
    s = rng.standard_normal((1, n)) + 0j

    def f(x):
        va, vm = np.angle(v), np.abs(v)
        va[pat.th] += x[:4]
        vm[pat.vm] += x[4:7]
        return mismatch(y[None], s, (vm * np.exp(1j * va))[None], pat, w, x[7:8], x[None, 8:], hv, reg)[0][0]

    j = jacobian(y[None], v[None], (y @ v)[None], pat, w, hv, reg)[0]
    h = 1e-6
    num = np.stack([(f(h * e) - f(-h * e)) / (2 * h) for e in np.eye(pat.size)], axis=1)
    assert np.allclose(-num, j, atol=1e-6)


def test_sweeps_agree_and_order_does_not_matter(spark, grid):
    base = np.array(AcPowerFlow(grid).compute().first().vm)
    scen = rows.lognormal_scenarios(spark, grid, 6)
    sweep = InjectionSweep(grid)
    sweep.set_injections_from_elements(scen)
    one = {r.row_id: r.vm for r in sweep.compute().collect()}
    other = ScenarioSweep(grid)
    other.set_injections_from_elements(scen.repartition(5))
    two = {r.row_id: r.vm for r in other.compute().collect()}
    assert all(np.allclose(one[k], two[k], atol=1e-12) for k in range(6))
    same = InjectionSweep(grid)
    same.set_injections_from_elements(spark.range(1).withColumnRenamed("id", "row_id").crossJoin(grid.load).select("row_id", "load_id", "p_mw", "q_mvar"))
    assert np.allclose(same.compute().first().vm, base, atol=1e-9)


def test_set_point_conflicts(spark, grid):
    two = grid.with_(gen=grid.gen.unionByName(grid.gen.where("gen_id = 1").selectExpr("7 as gen_id", *grid.gen.columns[1:])))
    bad = spark.createDataFrame([(0, 1, 1.0), (0, 7, 1.02), (1, 1, 1.01)], "row_id long, gen_id int, v double")
    sbus = rows.bus_injections(two, spark.range(2).withColumnRenamed("id", "row_id"))
    sweep = InjectionSweep(two)
    sweep.set_injections(sbus)
    with pytest.raises(ValueError):
        sweep.set_gen_v(bad)
    scen = ScenarioSweep(two)
    scen.set_injections(sbus)
    scen.set_gen_v(bad)
    assert {r.row_id: r.status for r in scen.compute().collect()} == {0: 3, 1: 0}


def test_contingency_tuples(spark):
    with pytest.raises(ValueError):
        rows.contingencies(spark, [([1], [], [], []), ([], [], [], [])])
    t = rows.contingencies(spark, [([], [], [], [], [3], [3])])
    assert [(r.element_type, r.element_id) for r in t.collect()] == [("branch", 3)]
    more = rows.contingencies(spark, [([1, 1], [], [2], [])], t)
    assert {(r.row_id, r.element_type, r.element_id) for r in more.collect()} == {(0, "branch", 3), (1, "branch", 1), (1, "load", 2)}


def test_distribution_against_a_straight_loop(spark):
    rng = np.random.default_rng(4)
    units = [(r, g, float(rng.uniform(-5, 20)), float(rng.integers(1, 4)), -3.0, float(rng.uniform(5, 25))) for r in range(10) for g in range(5)]
    lost = [(r, float(rng.uniform(-40, 60))) for r in range(10)]
    out = balance.distribute(spark.createDataFrame(units, "row_id long, gen_id int, p_mw double, weight double, min_p double, max_p double"), spark.createDataFrame(lost, "row_id long, lost_mw double")).collect()
    for r in range(10):
        own = sorted((x for x in out if x.row_id == r), key=lambda x: x.gen_id)
        p, left, on = [u[2] for u in units if u[0] == r], lost[r][1], set(range(5))
        spec = [u for u in units if u[0] == r]
        while on and abs(left) > 1e-6:
            total, new = sum(spec[i][3] for i in on), list(p)
            for i in sorted(on):
                want = p[i] + left * spec[i][3] / total
                lo, hi = (spec[i][4], min(spec[i][5], 0)) if spec[i][2] < 0 else (max(spec[i][4], 0), spec[i][5])
                if left > 0 and want >= hi:
                    new[i], on = max(p[i], hi), on - {i}
                elif left < 0 and want <= lo:
                    new[i], on = min(p[i], lo), on - {i}
                else:
                    new[i] = want
            left -= sum(new) - sum(p)
            p = new
        assert np.allclose([x.new_p for x in own], p, atol=1e-9)


def test_value_on_its_limit_is_no_violation(spark, grid):
    bus = spark.createDataFrame([(1, 100.0, "pq", 0.0, None, 95.0, 105.0)], "bus_id int, vn_kv double, kind string, slack_weight double, v_set double, vmin_kv double, vmax_kv double")
    v = spark.createDataFrame([(0, 1, 0.95), (1, 1, 1.05), (2, 1, 0.9499), (3, 1, float("nan")), (4, 1, 1.06)], "row_id long, bus_id int, vm double")
    got = {(r.row_id, r.violation_type) for r in limits.voltage_limits(grid.with_(bus=bus), v).collect()}
    assert got == {(2, 0), (4, 1)}


def test_tables_round_trip(spark, grid, tmp_path):
    write_grid(grid, str(tmp_path))
    again = read_grid(spark, str(tmp_path))
    assert np.allclose(arrays(again).y, arrays(grid).y)


def test_options_are_checked():
    with pytest.raises(ValueError):
        Options(strategy="nothing").check()
    with pytest.raises(ValueError):
        Options(strategy="direct_iter0_only").check()


def test_gradient_against_differences(spark, grid):
    rng = np.random.default_rng(5)
    a = arrays(grid)
    g = rng.standard_normal(14) + 1j * rng.standard_normal(14)
    opt = Options(tol=1e-12)
    h = 1e-4
    s = [(0, int(b), float(x.real) * 100, float(x.imag) * 100) for b, x in zip(a.ids, a.sbus)]
    plus, minus = ([(k, b, p + sign * h * 100 * float(b == 9), q) for _, b, p, q in s] for k, sign in ((1, 1), (2, -1)))
    sbus = spark.createDataFrame(s + plus + minus, "row_id long, bus_id int, p_mw double, q_mvar double")
    out = solve_rows(grid, row_inputs(grid, sbus, sbus), opt).cache()
    v = {r.row_id: np.array(r.vm) * np.exp(1j * np.array(r.va)) for r in out.collect()}
    num = ((g.real * (v[1] - v[2]).real + g.imag * (v[1] - v[2]).imag).sum()) / (2 * h)
    grad = spark.createDataFrame([(0, g.real.tolist(), g.imag.tolist())], "row_id long, re array<double>, im array<double>")
    got = {r.bus_id: r.dp for r in bus_gradients(grid, out, grad).collect()}
    assert got[9] == pytest.approx(num, rel=1e-3)


def test_stream_of_injections(spark, grid, tmp_path):
    from gridloom.streaming.scenarios import solve_stream
    t0 = datetime.datetime(2024, 1, 1)
    a = arrays(grid)
    feed = [(t0 + datetime.timedelta(minutes=5 * k), int(b), float(x.real) * 100, float(x.imag) * 100) for k in range(8) for b, x in zip(a.ids, a.sbus)]
    spark.createDataFrame(feed, "ts timestamp, bus_id int, p_mw double, q_mvar double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, bus_id int, p_mw double, q_mvar double").parquet(str(tmp_path / "in"))
    seen = []
    q = solve_stream(grid, stream, lambda df, e: seen.extend(df.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert seen and all(r.status == 0 for r in seen)
