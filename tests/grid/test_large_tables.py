"""What larger tables bring along: grids without a base case, rows by the million."""

import importlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from gridloom.operators import balance, rows
from gridloom.plans.oracles import ORACLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fed(spark, tmp_path_factory):
    """The small tables with so many suppliers' megawatts that the unchanged grid has no power flow."""
    d = tmp_path_factory.mktemp("fed")
    for x in os.listdir(SMALL):
        if x != "supplier.parquet":
            (d / x).symlink_to(f"{SMALL}/{x}")
    spark.read.parquet(f"{SMALL}/supplier.parquet").withColumn("s_acctbal", F.col("s_acctbal") * 6000).write.parquet(str(d / "supplier.parquet"))
    return str(d)


@pytest.mark.parametrize("name", ["pf_radial_voltage", "load_trip"])
def test_rows_are_solved_where_the_base_case_is_not(spark, fed, name):
    con = duckdb.connect()
    for x in ("customer", "orders", "nation"):
        con.execute(f"create view {x} as select * from '{fed}/{x}.parquet'")
    want = con.execute(ORACLES[name]).df().sort_values(["row_id", "bus_id"])
    got = e.queries()[name](spark, fed).toPandas().sort_values(["row_id", "bus_id"])
    assert np.array_equal(got[["row_id", "bus_id"]], want[["row_id", "bus_id"]])
    assert np.allclose(got[["vm", "va"]], want[["vm", "va"]], atol=2.1e-6)


def test_status_of_rows_where_the_base_case_is_not_solved(spark, fed):
    got = e.queries()["pf_residual"](spark, fed).groupBy("status", "small").count().collect()
    assert [tuple(r) for r in got] == [(0, True, 1500)]
    got = e.queries()["pf_meshed_status"](spark, fed).toPandas()
    assert len(got) == 25 and (got["status"] != 0).all()


def test_rows_without_a_solution_have_no_voltages(spark, fed):
    got = e.queries()["gen_off_solve"](spark, fed).toPandas()
    assert len(got) == 7500
    # Regions without a supplier are solved; in the others more is fed in than the transformers can carry.
    lost = got.groupby("row_id")["vm"].agg(lambda x: x.isna().sum())
    assert set(lost) == {0, 5} or set(lost) == {5}


@pytest.mark.parametrize("name, module, operator, most", [("gen_p_check", "physical", "gen_p_check", 97 * 4), ("slack_distribute_1round", "balance", "one_round", 97 * 5), ("slack_distribute_full", "balance", "distribute", 97 * 5), ("slack_weights", "balance", "one_round", 97 * 5)])
def test_what_many_rows_share_is_worked_out_once(spark, monkeypatch, name, module, operator, most):
    """97 load factors in 5 regions (or on 4 buses) are all that 1,500 rows differ in."""
    m, seen = importlib.import_module(f"gridloom.operators.{module}"), []
    monkeypatch.setattr(m, operator, lambda *x, f=getattr(m, operator): seen.append(x[1]) or f(*x))
    got = e.queries()[name](spark, SMALL)
    assert seen and seen[0].count() <= most
    assert got.select("row_id").distinct().count() > most


def test_distribute_keeps_any_row_id(spark):
    units = spark.sql("select named_struct('g', 1, 'lost_mw', 3.0D) as row_id, cast(id as int) as gen_id, 1.0D * id as p_mw, 1.0D as weight, 0.0D as min_p, 3.0D as max_p from range(3)")
    got = balance.distribute(units, spark.sql("select named_struct('g', 1, 'lost_mw', 3.0D) as row_id, 3.0D as lost_mw"))
    assert [tuple(r) for r in got.select("row_id.g", "gen_id", F.round("new_p", 6)).orderBy("gen_id").collect()] == [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0)]


def exchanges(df) -> int:
    """Shuffles of the plan before adaptive execution, those of small broadcast sides included."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_patches_are_merged_where_their_rows_are(spark):
    """Entries are four times the trips: they are merged in the tasks that the trips were dealt to, in as many as the trips need."""
    df = e.queries()["branch_patch_merged"](spark, SMALL)
    assert exchanges(df) <= 2 and "hashpartitioning(row_id" in df._jdf.queryExecution().executedPlan().toString()
    assert rows.by_row(spark.range(9).withColumnRenamed("id", "row_id"), 3_000_000).rdd.getNumPartitions() == 12
