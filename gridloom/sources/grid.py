"""Grids as a few tables: from Parquet or CSV, from case arrays, the 14-bus case, and one derived from star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCHEMAS


@dataclass(frozen=True)
class Grid:
    """Normalised element tables. kind of a bus: slack, pv or pq; branches count lines first, then trafos. Loads and storages draw power, generators and static generators feed it in."""

    spark: SparkSession
    bus: DataFrame
    branch: DataFrame
    load: DataFrame
    gen: DataFrame
    shunt: DataFrame
    sgen: DataFrame
    storage: DataFrame
    hvdc: DataFrame
    sn_mva: float = 100.0

    def with_(self, **tables) -> Grid:
        return replace(self, **tables)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def make_grid(spark: SparkSession, sn_mva: float = 100.0, **tables) -> Grid:
    """Grid from DataFrames or lists of rows; tables that are not given are empty."""
    def of(name: str) -> DataFrame:
        t = tables.get(name)
        return empty(spark, name) if t is None else t if isinstance(t, DataFrame) else spark.createDataFrame(t, SCHEMAS[name])
    return Grid(spark, *(of(n) for n in ("bus", "branch", "load", "gen", "shunt", "sgen", "storage", "hvdc")), sn_mva)


def read_grid(spark: SparkSession, folder: str, fmt: str = "parquet", sn_mva: float = 100.0) -> Grid:
    """Tables folder/bus, folder/branch ... in any of Spark's formats."""
    reader = lambda n: spark.read.schema(SCHEMAS[n]).option("header", True).format(fmt).load(f"{folder}/{n}")
    return make_grid(spark, sn_mva, **{n: reader(n) for n in SCHEMAS})


def write_grid(grid: Grid, folder: str, fmt: str = "parquet") -> None:
    for n in SCHEMAS:
        getattr(grid, n).write.mode("overwrite").option("header", True).format(fmt).save(f"{folder}/{n}")


def from_case(spark: SparkSession, bus: list, branch: list, gen: list, base_mva: float = 100.0) -> Grid:
    """Case arrays in their usual columns: bus (id, type, Pd, Qd, Gs, Bs, ..., Vm, Va, baseKV, zone, Vmax, Vmin),
    branch (f, t, r, x, b, rateA, ..., ratio, angle in degrees, status), gen (bus, Pg, Qg, Qmax, Qmin, Vg, mBase, status, Pmax, Pmin).

    Reference buses have type 3; another bus with an online generator is pv, any other pq.
    """
    import math

    live = [g for g in gen if g[7] > 0]
    v_set = {int(g[0]): float(g[5]) for g in live}
    kind = lambda b: "slack" if int(b[1]) == 3 else "pv" if int(b[0]) in v_set else "pq"
    refs = max(sum(int(b[1]) == 3 for b in bus), 1)
    buses = [(int(b[0]), float(b[9]), kind(b), 1.0 / refs if int(b[1]) == 3 else 0.0, v_set.get(int(b[0])), float(b[12]) * b[9], float(b[11]) * b[9]) for b in bus]
    on = [x for x in branch if x[10] > 0]
    is_trafo = lambda x: bool(x[8]) or bool(x[9])
    ordered = [x for x in on if not is_trafo(x)] + [x for x in on if is_trafo(x)]
    n_lines = sum(not is_trafo(x) for x in on)
    branches = [(i, "trafo" if is_trafo(x) else "line", i if i < n_lines else i - n_lines, int(x[0]), int(x[1]), float(x[2]), float(x[3]), float(x[4]), float(x[8] or 1), math.radians(x[9]), None, None) for i, x in enumerate(ordered)]
    loads = [(i, int(b[0]), float(b[2]), float(b[3])) for i, b in enumerate(x for x in bus if x[2] or x[3])]
    gens = [(i, int(g[0]), float(g[1]), float(g[5]), float(g[9]), float(g[8]), float(g[4]), float(g[3]), 1.0) for i, g in enumerate(live)]
    shunts = [(i, int(b[0]), float(b[4]), float(b[5])) for i, b in enumerate(x for x in bus if x[4] or x[5])]
    return make_grid(spark, base_mva, bus=buses, branch=branches, load=loads, gen=gens, shunt=shunts)


# The public IEEE 14-bus case.
IEEE14_BUS = [(1, 3, 0, 0, 0), (2, 2, 21.7, 12.7, 0), (3, 2, 94.2, 19, 0), (4, 1, 47.8, -3.9, 0), (5, 1, 7.6, 1.6, 0), (6, 2, 11.2, 7.5, 0), (7, 1, 0, 0, 0), (8, 2, 0, 0, 0),
              (9, 1, 29.5, 16.6, 19), (10, 1, 9, 5.8, 0), (11, 1, 3.5, 1.8, 0), (12, 1, 6.1, 1.6, 0), (13, 1, 13.5, 5.8, 0), (14, 1, 14.9, 5, 0)]
IEEE14_GEN = [(1, 232.4, 1.06, 0, 10), (2, 40, 1.045, -40, 50), (3, 0, 1.01, 0, 40), (6, 0, 1.07, -6, 24), (8, 0, 1.09, -6, 24)]
IEEE14_BRANCH = [(1, 2, 0.01938, 0.05917, 0.0528, 0), (1, 5, 0.05403, 0.22304, 0.0492, 0), (2, 3, 0.04699, 0.19797, 0.0438, 0), (2, 4, 0.05811, 0.17632, 0.034, 0),
                 (2, 5, 0.05695, 0.17388, 0.0346, 0), (3, 4, 0.06701, 0.17103, 0.0128, 0), (4, 5, 0.01335, 0.04211, 0, 0), (4, 7, 0, 0.20912, 0, 0.978), (4, 9, 0, 0.55618, 0, 0.969),
                 (5, 6, 0, 0.25202, 0, 0.932), (6, 11, 0.09498, 0.1989, 0, 0), (6, 12, 0.12291, 0.25581, 0, 0), (6, 13, 0.06615, 0.13027, 0, 0), (7, 8, 0, 0.17615, 0, 0),
                 (7, 9, 0, 0.11001, 0, 0), (9, 10, 0.03181, 0.0845, 0, 0), (9, 14, 0.12711, 0.27038, 0, 0), (10, 11, 0.08205, 0.19207, 0, 0), (12, 13, 0.22092, 0.19988, 0, 0), (13, 14, 0.17093, 0.34802, 0, 0)]


def ieee14(spark: SparkSession) -> Grid:
    bus = [(i, k, p, q, 0, b, 1, 1.0, 0.0, 138.0, 1, 1.06, 0.94) for i, k, p, q, b in IEEE14_BUS]
    branch = [(f, t, r, x, b, 0, 0, 0, tap, 0, 1) for f, t, r, x, b, tap in IEEE14_BRANCH]
    gen = [(b, p, 0, hi, lo, v, 100, 1, 400.0, 0.0) for b, p, v, lo, hi in IEEE14_GEN]
    return from_case(spark, bus, branch, gen)


def derived_grid(spark: SparkSession, sf_dir: str, rings: bool = False) -> Grid:
    """Regions are slack hubs at 400 kV, nations are pq buses at 225 kV behind one transformer each; rings adds lines
    between a region's nations, one after the other. Loads follow the customers' balances, generators are the suppliers."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation").selectExpr("n_nationkey as n", "n_regionkey as g")
    hubs = read("region").selectExpr("cast(r_regionkey as int) as bus_id", "400.0D as vn_kv", "'slack' as kind", "1.0D as slack_weight", "1.0D as v_set", "399.0D as vmin_kv", "401.0D as vmax_kv")
    ends = nation.selectExpr("cast(100 + n as int) as bus_id", "225.0D as vn_kv", "'pq' as kind", "0.0D as slack_weight", "cast(null as double) as v_set", "225 * 0.9960D as vmin_kv", "225 * 0.9973D as vmax_kv")
    trafo = nation.selectExpr("cast(n as int) as branch_id", "'trafo' as kind", "cast(n as int) as local_id", "cast(g as int) as f", "cast(100 + n as int) as t",
                              "0.002D + 0.0005D * (n % 5) as r", "0.02D + 0.003D * (n % 7) as x", "0.0D as b", "1.0D as tap", "0.0D as shift", "0.045D as limit1_ka", "0.080D as limit2_ka")
    branch = trafo
    if rings:
        line = (nation.selectExpr("n", "g", "coalesce(lead(n) over (partition by g order by n), min(n) over (partition by g)) as m")
                .selectExpr("cast(n as int) as branch_id", "'line' as kind", "cast(n as int) as local_id", "cast(100 + n as int) as f", "cast(100 + m as int) as t",
                            "0.004D + 0.001D * (n % 3) as r", "0.03D + 0.004D * (n % 4) as x", "0.02D as b", "1.0D as tap", "0.0D as shift", "0.01D as limit1_ka", "0.01D as limit2_ka"))
        branch = line.unionByName(trafo.withColumn("branch_id", F.col("branch_id") + 25))
    load = (read("customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"))
            .selectExpr("cast(c_nationkey as int) as load_id", "cast(100 + c_nationkey as int) as bus_id", "20 + 1.0D / 7 + 0.002D * a as p_mw", "0.3D * (20 + 1.0D / 7 + 0.002D * a) as q_mvar"))
    gen = read("supplier").selectExpr("cast(s_suppkey as int) as gen_id", "cast(100 + s_nationkey as int) as bus_id", "0.001D * s_acctbal as p_mw", "1.0D + 0.001D * (s_suppkey % 3) as v_set",
                                      "0.0D as min_p", "5.0D + (s_suppkey % 7) as max_p", "-2.0D as min_q", "2.0D as max_q", "1.0D + (s_suppkey % 4) as weight")
    return make_grid(spark, bus=hubs.unionByName(ends), branch=branch, load=load, gen=gen)
