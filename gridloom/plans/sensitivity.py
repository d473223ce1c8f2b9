"""Gradients of a loss with respect to injections: one transposed solve for each row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.grid import Grid
from .powerflow import arrays, pattern
from .solver import adjoint


def bus_gradients(grid: Grid, result: DataFrame, grad: DataFrame) -> DataFrame:
    """grad (row_id, re array, im array by bus position) of a loss by Re V, Im V -> (row_id, bus_id, dp, dq) by per-unit injections. Rows without topology changes."""
    a = arrays(grid)
    pat = pattern(a, a.kind == "pv", np.ones(len(a.ids), bool), False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v = np.array(b["vm"].tolist(), float) * np.exp(1j * np.array(b["va"].tolist(), float))
            y = np.broadcast_to(a.y, (len(b), *a.y.shape))
            dp, dq = adjoint(y, v, pat, np.array(b["re"].tolist(), float) + 1j * np.array(b["im"].tolist(), float), hvdc=a.hvdc)
            n = len(a.ids)
            yield pd.DataFrame({"row_id": np.repeat(b["row_id"].to_numpy(), n), "bus_id": np.tile(a.ids, len(b)).astype(np.int32), "dp": dp.ravel(), "dq": dq.ravel()})

    return result.where("status = 0").select("row_id", "vm", "va").join(grad, "row_id").mapInPandas(run, "row_id long, bus_id int, dp double, dq double")


def element_gradients(grid: Grid, by_bus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_id, load_id, dp, dq) with the loads' sign and (row_id, gen_id, dp)."""
    load = by_bus.join(F.broadcast(grid.load.select("load_id", "bus_id")), "bus_id").selectExpr("row_id", "load_id", "-dp as dp", "-dq as dq")
    return load, by_bus.join(F.broadcast(grid.gen.select("gen_id", "bus_id")), "bus_id").select("row_id", "gen_id", "dp")


def tied_set_points(grid: Grid, by_bus: DataFrame) -> DataFrame:
    """by_bus (row_id, bus_id, dv): generators of one bus share its derivative equally."""
    n = F.count("*").over(Window.partitionBy("bus_id"))
    return by_bus.join(F.broadcast(grid.gen.withColumn("n", n).select("gen_id", "bus_id", "n")), "bus_id").selectExpr("row_id", "gen_id", "dv / n as dv")
