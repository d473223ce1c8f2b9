import numpy as np
import pytest

from gridloom.plans.api import AcPowerFlow, ContingencyAnalysis
from gridloom.plans.powerflow import arrays, base_case
from gridloom.plans.solver import Options
from gridloom.operators import flows
from gridloom.operators.ybus import assemble
from gridloom.sources.grid import ieee14

VM = [1.06, 1.045, 1.01, 1.017671, 1.019514, 1.07, 1.06152, 1.09, 1.055932, 1.050985, 1.056907, 1.055189, 1.050382, 1.03553]
VA = [0, -4.982589, -12.7251, -10.312901, -8.773854, -14.220946, -13.359627, -13.359627, -14.938521, -15.097288, -14.790622, -15.075585, -15.156276, -16.033645]


@pytest.fixture(scope="module")
def grid(spark):
    return ieee14(spark)


def test_base_case(grid):
    v = base_case(arrays(grid))
    assert np.allclose(np.abs(v), VM, atol=1e-6) and np.allclose(np.degrees(np.angle(v)), VA, atol=1e-5)


def test_matrix_tables_agree_with_arrays(grid):
    a = arrays(grid)
    y = np.zeros_like(a.y)
    for r in assemble(grid).collect():
        y[a.pos[r.i], a.pos[r.j]] = r.g + 1j * r.b
    assert np.allclose(y, a.y)


def test_n_minus_1_and_flows(grid):
    study = ContingencyAnalysis(grid)
    study.n_minus_1()
    rows = {r.row_id: r for r in study.compute().collect()}
    assert len(rows) == 20
    # The only branch to bus 8 is a bridge.
    assert sorted(r.status for r in rows.values()) == [0] * 19 + [3]
    ok = [r for r in rows.values() if r.status == 0]
    assert max(r.residual for r in ok) < 1e-8
    single = AcPowerFlow(grid)
    single.compute()
    f = {r.branch_id: r for r in single.flows().collect()}
    assert f[0].p_or_mw == pytest.approx(156.8829, abs=1e-3) and f[0].q_ex_mvar == pytest.approx(27.6762, abs=1e-3)
    trip = study.flows().join(study._trips(), ["row_id", "branch_id"]).collect()
    assert all(r.i_or_a == 0 and r.p_ex_mw == 0 for r in trip)


def test_islands_leave_nan(grid):
    study = ContingencyAnalysis(grid, handle_islands=True)
    bridge = next(r.branch_id for r in grid.branch.collect() if (r.f, r.t) == (7, 8))
    study.add_contingencies_by_branch_id([[bridge], [0]])
    rows = {r.row_id: r for r in study.compute().collect()}
    assert rows[0].status == 0 and rows[0].vm[7] is None and None not in rows[0].vm[:7] + rows[0].vm[8:]
    assert rows[1].status == 0 and not rows[1].disconnected


@pytest.mark.parametrize("opt", [Options(schedule="fixed", nb_iter=8, strategy="direct_iter0_only"), Options(schedule="fixed", nb_iter=8, strategy="direct_refactor_every_n"),
                                 Options(schedule="fixed", nb_iter=12, strategy="direct_base_case_factors"), Options(scale_steps=True), Options(distributed_slack=True)])
def test_strategies_reach_the_same_root(grid, opt):
    base = AcPowerFlow(grid)
    v = np.array(base.compute().first().vm)
    other = AcPowerFlow(grid, opt).compute().first()
    assert other.residual < 1e-6 and np.allclose(other.vm, v, atol=1e-5)


def test_reactive_limits_hold_after_the_loop(grid):
    out = AcPowerFlow(grid, Options(outer=("reactive_limits",))).compute().first()
    assert out.status == 0
    a = arrays(grid)
    v = np.array(out.vm) * np.exp(1j * np.array(out.va))
    q = (v * np.conj(a.y @ v)).imag - a.sbus.imag
    for g in a.gen[a.gen["bus_id"] != 1].itertuples():
        assert g.min_q / 100 - 1e-3 <= q[g.pos] <= g.max_q / 100 + 1e-3


def test_power_balance(grid):
    single = AcPowerFlow(grid)
    single.compute()
    from gridloom.operators.rows import bus_injections
    rows = grid.spark.range(1).withColumnRenamed("id", "row_id")
    k = flows.kcl_mismatch(grid, assemble(grid), single.voltages(), bus_injections(grid, rows))
    assert max(r.delta for r in k.collect()) < 1e-5
