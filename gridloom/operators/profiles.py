"""Scenarios along a day: an hourly consumption profile, smoothed, with log-normal noise on every load."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.grid import Grid
from .rows import follow_loads, normal

# Consumption of each hour of a French day against the day's mean (2012), and the factors of an October Monday.
HOURS = [1.00, 0.93, 0.91, 0.86, 0.84, 0.85, 0.90, 0.97, 1.03, 1.06, 1.08, 1.09, 1.09, 1.09, 1.06, 1.03, 1.00, 1.00, 1.04, 1.09, 1.05, 1.01, 0.99, 1.03]
OCTOBER, MONDAY = 1.01, 1.01


def cubic(values: list[float]) -> np.ndarray:
    """(pieces, 4): rising powers of the cubic through values at 0, 1, 2 ... whose third derivative has no jump at the second and the last but one place."""
    y, n = np.asarray(values, float), len(values)
    if n < 4:
        raise ValueError("a cubic needs four values")
    bend = np.zeros((n, n))  # of the second derivatives at the places
    right = np.zeros(n)
    for i in range(1, n - 1):
        bend[i, i - 1 : i + 2] = 1, 4, 1
        right[i] = 6 * (y[i + 1] - 2 * y[i] + y[i - 1])
    bend[0, :3] = bend[-1, -3:] = 1, -2, 1
    m = np.linalg.solve(bend, right)
    return np.stack([y[:-1], np.diff(y) - (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, np.diff(m) / 6], axis=1)


def day_factor(row: Column, rows_an_hour: int, hours: list[float] = HOURS, scale: float = OCTOBER * MONDAY) -> Column:
    """The profile at a row of the day; the day closes on its first hour."""
    pieces = cubic([h * scale for h in [*hours, hours[0]]])
    hour = F.floor(row / F.lit(rows_an_hour))
    u = (row - hour * rows_an_hour) / F.lit(float(rows_an_hour))
    a, b, c, d = (F.element_at(F.array(*[F.lit(float(x)) for x in power]), hour.cast("int") + 1) for power in pieces.T)
    return a + u * (b + u * (c + u * d))


def hourly_scenarios(spark: SparkSession, grid: Grid, n: int = 288, sigma: float = 0.003, seed: int = 0, hours: list[float] = HOURS) -> tuple[DataFrame, DataFrame]:
    """(load_p, gen_p) of a day in n // len(hours) rows an hour.

    P and Q of each load follow the profile, each with noise of its own: a hash of row, load and seed. Generators follow their row's total.
    """
    an_hour = n // len(hours)
    if an_hour < 1:
        raise ValueError("fewer rows than hours")
    row = spark.range(an_hour * len(hours)).select(F.col("id").alias("row_id"), day_factor(F.col("id"), an_hour, hours).alias("day"))
    noisy = lambda c, k: (F.col("day") * F.col(c) * F.exp(sigma * normal(seed + k))).alias(c)
    load = row.crossJoin(F.broadcast(grid.load)).select("row_id", "load_id", noisy("p_mw", 1), noisy("q_mvar", 3))
    return load, follow_loads(grid, load)
