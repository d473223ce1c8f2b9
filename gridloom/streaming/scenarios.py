"""A stream of element values solved window by window: an extension for live injections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.powerflow import arrays, row_inputs, solve_rows, start
from ..plans.solver import Options
from ..sources.grid import Grid


def windowed_injections(stream: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """stream (ts, bus_id, p_mw, q_mvar) -> (row_id: the window's start in seconds, bus_id, p_mw, q_mvar), means by tumbling window."""
    x = stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "bus_id").agg(F.avg("p_mw").alias("p_mw"), F.avg("q_mvar").alias("q_mvar"))
    return x.select(F.unix_timestamp("w.start").alias("row_id"), "bus_id", "p_mw", "q_mvar")


def solve_stream(grid: Grid, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, window: str = "10 minutes", late: str = "10 minutes", options: Options | None = None):
    """Start a query that solves each finished window and hands the results to sink(results, epoch)."""
    warm = start(arrays(grid), options or Options())

    def each(batch: DataFrame, epoch: int) -> None:
        sink(solve_rows(grid, row_inputs(grid, batch, batch), options, warm=warm), epoch)

    return windowed_injections(stream, window, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each).start()
