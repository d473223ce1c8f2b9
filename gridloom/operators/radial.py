"""Closed form of a radial grid: every pq bus hangs on a slack bus of 1 pu by one branch without charging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.grid import Grid


def closed_form(grid: Grid, sbus: DataFrame) -> DataFrame:
    """sbus (row_id, bus_id, p_mw, q_mvar injected) -> v(row_id, bus_id, vm, va, re, im), loads as consumption."""
    x = sbus.join(F.broadcast(grid.branch.selectExpr("t as bus_id", "r", "x")), "bus_id").selectExpr("row_id", "bus_id", f"-p_mw / {grid.sn_mva} as p", f"-q_mvar / {grid.sn_mva} as q", "r", "x")
    x = x.withColumn("a", F.expr("0.5D - (p * r + q * x)")).withColumn("v2", F.expr("a + sqrt(a * a - (p * p + q * q) * (r * r + x * x))"))
    x = x.selectExpr("row_id", "bus_id", "sqrt(v2) as vm", "-atan2(p * x - q * r, v2 + p * r + q * x) as va")
    return x.withColumns({"re": F.expr("vm * cos(va)"), "im": F.expr("vm * sin(va)")})
