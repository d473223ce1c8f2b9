"""Rows that trip elements, against a grid without them."""

import numpy as np
import pytest

from gridloom.operators import rows
from gridloom.plans.api import AcPowerFlow, ContingencyAnalysis, ScenarioSweep
from gridloom.plans.powerflow import arrays, base_case
from gridloom.schema import SCHEMAS
from gridloom.sources.grid import ieee14


@pytest.fixture(scope="module")
def grid(spark):
    g = ieee14(spark)
    more = {"sgen": [(0, 9, 6.0, 1.0)], "storage": [(0, 13, 4.0, -1.0)], "hvdc": [(0, 4, 13, 5.0, 20.0, 0.01, 0.01, 0.0001, 90.0)]}
    return g.with_(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in more.items()})


def without(grid, kind, i):
    return grid.with_(**{kind: getattr(grid, kind).where(f"{kind}_id <> {i}")})


def test_each_kind_is_taken_out(spark, grid):
    kinds = [("branch", 0), ("shunt", 0), ("load", 3), ("sgen", 0), ("storage", 0), ("hvdc", 0)]
    study = ContingencyAnalysis(grid)
    for kind, i in kinds:
        study.add_contingency(kind, [[i]])
    got = {r.row_id: r for r in study.compute().collect()}
    base = base_case(arrays(grid))
    for k, (kind, i) in enumerate(kinds):
        assert got[k].status == 0, (kind, got[k].reason)
        want = base_case(arrays(without(grid, kind, i)))
        assert np.allclose(np.array(got[k].vm) * np.exp(1j * np.array(got[k].va)), want, atol=1e-6), kind
        assert not np.allclose(want, base, atol=1e-6)


def test_a_branch_that_is_open_at_one_end_keeps_its_charging(spark, grid):
    study = ContingencyAnalysis(grid)
    study.add_contingency("branch_side1", [[1]])
    study.add_contingency("branch_side2", [[1]])
    got = {r.row_id: np.array(r.vm) * np.exp(1j * np.array(r.va)) for r in study.compute().collect()}
    for row, at in ((0, 5), (1, 1)):
        # What is left at the closed end is a shunt.
        b = next(r for r in grid.branch.collect() if r.branch_id == 1)
        y, half = 1 / (b.r + 1j * b.x), 0.5j * b.b
        left = (y + half - y * y / (y + half)) * 100
        shunt = grid.shunt.unionByName(spark.createDataFrame([(7, at, float(left.real), float(left.imag))], SCHEMAS["shunt"]))
        assert np.allclose(got[row], base_case(arrays(without(grid, "branch", 1).with_(shunt=shunt))), atol=1e-6)
    flows = {(r.row_id, r.branch_id): r.i_or_a for r in study.flows().collect()}
    assert flows[0, 1] == 0 == flows[1, 1] and flows[0, 0] > 0


def test_a_row_that_cannot_be_simulated_says_why(spark, grid):
    study = ContingencyAnalysis(grid)
    for kind, i in (("svc", 1), ("gen", 99), ("load", 77), ("branch", 500), ("branch_side1", 500), ("shunt", 9), ("branch", 0)):
        study.add_contingency(kind, [[i]])
    got = {r.row_id: r for r in study.compute().collect()}
    assert [got[k].status for k in range(7)] == [3] * 6 + [0]
    assert got[0].reason == "there is no svc 1" and got[1].reason == "there is no gen 99" and got[1].residual is None


def test_a_generator_takes_its_row_s_own_power_along(spark, grid):
    load = spark.range(2).withColumnRenamed("id", "row_id").crossJoin(grid.load).select("row_id", "load_id", "p_mw", "q_mvar")
    gen = spark.range(2).withColumnRenamed("id", "row_id").crossJoin(grid.gen).selectExpr("row_id", "gen_id", "case when gen_id = 1 then 90.0D else p_mw end as p_mw")
    sweep = ScenarioSweep(grid)
    sweep.set_injections_from_elements(load, gen)
    sweep.set_contingency_gens(spark.createDataFrame([(0, 1)], "row_id long, gen_id int"))
    got = {r.row_id: r for r in sweep.compute().collect()}
    assert np.allclose(np.array(got[0].vm), np.abs(without_bus_control(grid, 1)), atol=1e-6)
    assert got[0].slack_mw - got[1].slack_mw == pytest.approx(90, abs=9)
    whole = ContingencyAnalysis(grid)
    whole.add_contingency("gen", [[1]])
    assert whole.compute().first().slack_mw == pytest.approx(got[0].slack_mw, abs=1e-6)


def without_bus_control(grid, gen):
    from pyspark.sql import functions as F

    bus = grid.gen.where(f"gen_id = {gen}").first().bus_id
    return base_case(arrays(without(grid, "gen", gen).with_(bus=grid.bus.withColumn("kind", F.when(F.col("bus_id") == bus, "pq").otherwise(F.col("kind"))))))


def test_masks_of_a_sweep(spark, grid):
    sweep = ScenarioSweep(grid)
    sweep.set_injections_from_elements(spark.range(3).withColumnRenamed("id", "row_id").crossJoin(grid.load).select("row_id", "load_id", "p_mw", "q_mvar"))
    sweep.set_contingency("load", spark.createDataFrame([(0, 2)], "row_id long, load_id int"))
    sweep.set_contingency("shunt", spark.createDataFrame([(1, 0)], "row_id long, shunt_id int"))
    sweep.set_topology([[], [], [3]])
    got = {r.row_id: np.array(r.vm) for r in sweep.compute().collect()}
    for row, (kind, i) in enumerate((("load", 2), ("shunt", 0), ("branch", 3))):
        assert np.allclose(got[row], np.abs(base_case(arrays(without(grid, kind, i)))), atol=1e-6), kind
    fixed = ScenarioSweep(grid)
    fixed.set_injections(rows.bus_injections(grid, spark.range(1).withColumnRenamed("id", "row_id")))
    fixed.set_contingency("load", spark.createDataFrame([(0, 2)], "row_id long, load_id int"))
    assert fixed.compute().first().status == 3
    assert AcPowerFlow(grid).compute().first().status == 0
