"""Scenario generators, hand-over of results, kept base cases and one-kind contingencies."""

import json

import numpy as np
import pytest

from gridloom.operators import profiles, rows
from gridloom.plans import api
from gridloom.schema import SCHEMAS
from gridloom.sources.grid import ieee14


@pytest.fixture(scope="module")
def grid(spark):
    g = ieee14(spark)
    # One load and one generator of negative power.
    load = g.load.unionByName(spark.createDataFrame([(50, 12, -2.0, 0.5)], SCHEMAS["load"]))
    gen = g.gen.unionByName(spark.createDataFrame([(50, 2, -3.0, 1.045, -5.0, 5.0, -1.0, 1.0, 1.0)], SCHEMAS["gen"]))
    return g.with_(load=load, gen=gen)


def test_the_cubic_goes_through_its_places_without_kinks():
    x = np.arange(9.0)
    c = profiles.cubic(list(2 - x + 0.3 * x**2 - 0.05 * x**3))
    u = np.linspace(0, 1, 5)
    for i in range(8):
        t = i + u
        assert np.allclose(c[i] @ np.stack([u**0, u, u**2, u**3]), 2 - t + 0.3 * t**2 - 0.05 * t**3)
    c = profiles.cubic([*profiles.HOURS, profiles.HOURS[0]])
    for i in range(23):
        assert np.isclose(c[i].sum(), profiles.HOURS[i + 1]) and np.isclose(c[i] @ [0, 1, 2, 3], c[i + 1][1]) and np.isclose(c[i] @ [0, 0, 2, 6], 2 * c[i + 1][2])
    assert np.isclose(c[0][3], c[1][3]) and np.isclose(c[-1][3], c[-2][3])


def followed(grid, load_p, gen_p):
    base, gens = sum(r.p_mw for r in grid.load.collect()), {r.gen_id: r.p_mw for r in grid.gen.collect()}
    total = {}
    for r in load_p:
        total[r.row_id] = total.get(r.row_id, 0) + r.p_mw
    negative = sum(p for p in gens.values() if p < 0)
    assert len(gen_p) == len(total) * len(gens)
    for r in gen_p:
        p = gens[r.gen_id]
        assert np.isclose(r.p_mw, p * (total[r.row_id] - negative) / base if p > 0 else p)


def test_a_day_follows_the_profile(spark, grid):
    load, gen = profiles.hourly_scenarios(spark, grid, 50, sigma=0.0)
    got = load.collect()
    own = {r.load_id: r for r in grid.load.collect()}
    assert len(got) == 48 * len(own)  # whole hours only
    at = {r.row_id: r.p_mw / own[r.load_id].p_mw for r in got}
    assert all(np.isclose(r.q_mvar, at[r.row_id] * own[r.load_id].q_mvar) for r in got)
    assert all(np.isclose(at[2 * h], profiles.HOURS[h] * 1.01 * 1.01) for h in range(24))
    assert min(profiles.HOURS[7:9]) * 1.0201 < at[15] < max(profiles.HOURS[7:9]) * 1.0201
    followed(grid, got, gen.collect())
    noisy = profiles.hourly_scenarios(spark, grid, 480, seed=5)[0].collect()
    smooth = {(r.row_id, r.load_id): r for r in profiles.hourly_scenarios(spark, grid, 480, sigma=0.0)[0].collect()}
    for c in ("p_mw", "q_mvar"):
        z = np.log([r[c] / smooth[r.row_id, r.load_id][c] for r in noisy])
        assert abs(z.mean()) < 2e-4 and abs(z.std() - 0.003) < 2e-4
    with pytest.raises(ValueError):
        profiles.hourly_scenarios(spark, grid, 23)


def test_uniform_rows_scale_all_loads_and_keep_negative_generators(spark, grid):
    load, gen = (t.collect() for t in rows.uniform_scenarios(spark, grid, 40))
    own = {r.load_id: r for r in grid.load.collect()}
    p, q = (np.array([r[c] / own[r.load_id][c] for r in load]) for c in ("p_mw", "q_mvar"))
    assert (abs(p - 1) <= 0.1).all() and (abs(q - 1) <= 0.1).all() and abs(np.corrcoef(p, q)[0, 1]) < 0.2
    assert np.std([r.p_mw for r in load if r.load_id == 50]) > 0
    followed(grid, load, gen)


def test_injections_come_and_results_go_as_arrow(spark, grid, tmp_path):
    load, gen = profiles.hourly_scenarios(spark, grid, 24)
    one, two = api.InjectionSweep(grid), api.InjectionSweep(grid)
    one.set_injections_from_elements(load, gen)
    two.set_injections_from_elements(load.toArrow(), gen.toArrow())
    one.compute(), two.compute()
    by = [("row_id", "ascending"), ("bus_id", "ascending")]
    a, b = one.to_arrow().sort_by(by), two.to_arrow().sort_by(by)
    assert a.num_rows == 24 * 14 and np.allclose(a["vm"].to_numpy(), b["vm"].to_numpy(), atol=1e-9)
    with pytest.raises(ValueError):
        one.to_arrow(most=10)
    with pytest.raises(ValueError):
        one.to_arrow("compute")
    kept = one.map_arrow(lambda batches: (x.select(["row_id", "vm"]) for x in batches), "row_id long, vm double")
    assert kept.count() == a.num_rows
    one.write(str(tmp_path), "json", ("converged", "metrics"))
    lines = [json.loads(x) for f in (tmp_path / "metrics").glob("*.json") for x in f.read_text().splitlines()]
    assert sum(x["n_rows"] for x in lines) == 24
    one.write(str(tmp_path), outputs=("voltages",))
    assert spark.read.parquet(f"{tmp_path}/voltages").count() == a.num_rows


def test_the_base_case_is_solved_once_for_a_grid_and_its_options(grid, monkeypatch):
    calls = []
    monkeypatch.setattr(api, "base_case", lambda a, o, f=api.base_case: calls.append(o.tol) or f(a, o))
    study = api.ContingencyAnalysis(grid)
    study.n_minus_1()
    study.compute()
    study.add_contingency_load(0, 1)
    study.compute()
    assert len(calls) == 1
    study.options.tol = 1e-9
    study.compute()
    study.grid = grid.with_(shunt=grid.shunt.limit(0))
    study.compute()
    assert len(calls) == 3


def test_contingencies_of_one_kind(grid):
    study = api.ContingencyAnalysis(grid)
    for kind, ids in (("shunt", (0,)), ("load", (0, 2)), ("gen", (3,)), ("sgen", (1,)), ("storage", (1,)), ("svc", (1,)), ("hvdc", (4, 5))):
        getattr(study, f"add_contingency_{kind}")(*ids)
    got = sorted((r.row_id, r.element_type, r.element_id) for r in study.trip.collect())
    assert got == [(0, "shunt", 0), (1, "load", 0), (1, "load", 2), (2, "gen", 3), (3, "sgen", 1), (4, "storage", 1), (5, "svc", 1), (6, "hvdc", 4), (6, "hvdc", 5)]


def test_the_report_holds_rows_against_the_base(spark, grid):
    tight = grid.with_(bus=grid.bus.withColumns({"vmin_kv": grid.bus.vn_kv * 1.0, "vmax_kv": grid.bus.vn_kv * 1.06}))
    study = api.ContingencyAnalysis(tight)
    study.n_minus_1()
    study.compute()
    base = study.base_violations().collect()
    r = study.report().first()
    keys = {(x.element_type, x.element_id, x.side, x.violation_type) for x in base}
    mine = study.violations().collect()
    assert r.n_rows == 20 and r.n_records == len(mine) and r.n_new == sum((x.element_type, x.element_id, x.side, x.violation_type) not in keys for x in mine)
