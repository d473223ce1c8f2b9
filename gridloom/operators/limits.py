"""Operational limits: voltages, currents, solver records, top-K ranking, exact counts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CATEGORY, TOL, VIOLATION_CAPACITY, VIOLATION_REL_TOL, VIOLATION_TOL, Category, RowStatus, ViolationType
from ..sources.grid import Grid

COLUMNS = ["row_id", "element_type", "element_id", "side", "violation_type", "value", "limit", "severity", "scan"]


def voltage_limits(grid: Grid, v: DataFrame, rel_tol: float = VIOLATION_REL_TOL) -> DataFrame:
    """v (row_id, bus_id, vm pu) in kV against the bus's limits; missing limits and NaN voltages are no violation."""
    x = v.join(F.broadcast(grid.bus.select("bus_id", "vn_kv", "vmin_kv", "vmax_kv")), "bus_id").withColumn("kv", F.expr("vm * vn_kv")).where("not isnan(kv)")
    low, high = f"kv < vmin_kv * (1 - {rel_tol})", f"kv > vmax_kv * (1 + {rel_tol})"
    return x.where(f"({low}) or ({high})").selectExpr("row_id", "0 as element_type", "bus_id as element_id", "0 as side", f"case when {low} then 0 else 1 end as violation_type", "kv as value",
                                                      f"case when {low} then vmin_kv else vmax_kv end as limit").withColumn("severity", F.expr("abs(value / limit - 1)")).withColumn("scan", F.col("element_id").cast("long"))


def current_limits(grid: Grid, flow: DataFrame, trips: DataFrame | None = None, rel_tol: float = VIOLATION_REL_TOL) -> DataFrame:
    """Currents in kA at both ends; a row's tripped branches are skipped."""
    if trips is not None:
        flow = flow.join(trips.select("row_id", "branch_id").distinct(), ["row_id", "branch_id"], "left_anti")
    x = flow.join(F.broadcast(grid.branch.select("branch_id", "kind", "local_id", "limit1_ka", "limit2_ka")), "branch_id")
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), (F.col("i_or_a") / 1000).alias("value"), F.col("limit1_ka").alias("limit")),
                              F.struct(F.lit(2).alias("side"), (F.col("i_ex_a") / 1000).alias("value"), F.col("limit2_ka").alias("limit"))))
    x = x.select("row_id", "branch_id", "kind", "local_id", sides.alias("s")).where(f"not isnan(s.value) and s.value > s.limit * (1 + {rel_tol})")
    return x.selectExpr("row_id", "case when kind = 'line' then 1 else 2 end as element_type", "local_id as element_id", "s.side as side", "2 as violation_type", "s.value as value", "s.limit as limit",
                        "abs(s.value / s.limit - 1) as severity", "cast(2 * branch_id + s.side as long) as scan")


def top_k(violations: DataFrame, capacity: int = VIOLATION_CAPACITY, base_order: bool = False) -> DataFrame:
    """The `capacity` most severe of each row and type, with their rank; ties by scan order. Types come CURRENT, LOW, HIGH (for a base case LOW, HIGH, CURRENT)."""
    w = Window.partitionBy("row_id", "violation_type").orderBy(F.desc("severity"), "scan")
    order = "case violation_type when 2 then 2 else violation_type end" if base_order else "case violation_type when 2 then -1 else violation_type end"
    return violations.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= capacity).withColumn("type_order", F.expr(order))


def solver_records(row_result: DataFrame, violation_tol: float = VIOLATION_TOL) -> DataFrame:
    """One GRID record for each row that has no usable result: (row_id, element_type 3, violation_type, value, limit)."""
    bad = f"residual is null or isnan(residual) or residual > {violation_tol}"
    kind = F.expr(f"case when status = {int(RowStatus.NOT_SIMULATED)} and coalesce(reason, '') <> '' then {int(ViolationType.BATCH_UNSUPPORTED)} "
                  f"when status = {int(RowStatus.NOT_SIMULATED)} then {int(ViolationType.NOT_SIMULATED)} else {int(ViolationType.DIVERGENCE)} end")
    nan = F.lit(float("nan"))
    return (row_result.where(f"status in (3, 4, 5) or {bad}").select("row_id", F.lit(3).alias("element_type"), F.lit(-1).alias("element_id"), F.lit(0).alias("side"), kind.alias("violation_type"),
            F.when(kind == int(ViolationType.DIVERGENCE), F.col("residual")).otherwise(nan).alias("value"), F.when(kind == int(ViolationType.DIVERGENCE), F.lit(violation_tol)).otherwise(nan).alias("limit"))
            .withColumn("severity", F.lit(0.0)).withColumn("scan", F.lit(0).cast("long")))


def violations(grid: Grid, row_result: DataFrame, v: DataFrame, flow: DataFrame, trips: DataFrame | None = None, capacity: int = VIOLATION_CAPACITY) -> DataFrame:
    """All records of a run: solver records alone for rows without a usable result, ranked limit records for the others."""
    solver = solver_records(row_result)
    sound = lambda df: df.join(solver.select("row_id"), "row_id", "left_anti")
    limits = voltage_limits(grid, sound(v)).unionByName(current_limits(grid, sound(flow), trips))
    return top_k(limits.unionByName(solver), capacity)


def counts(rows: DataFrame, limits: DataFrame, row_result: DataFrame | None = None, capacity: int = VIOLATION_CAPACITY) -> DataFrame:
    """(row_id, low_voltage, high_voltage, current, truncated): exact, however many are kept; -1 for rows not simulated."""
    c = limits.groupBy("row_id").agg(*[F.count_if(F.col("violation_type") == t).alias(n) for t, n in ((0, "low_voltage"), (1, "high_voltage"), (2, "current"))])
    out = rows.select("row_id").distinct().join(c, "row_id", "left").na.fill(0).withColumn("truncated", F.expr(f"greatest(low_voltage, high_voltage, current) > {capacity}"))
    if row_result is not None:
        out = out.join(row_result.select("row_id", (F.col("status") == int(RowStatus.NOT_SIMULATED)).alias("__no")), "row_id", "left")
        out = out.withColumns({n: F.when(F.col("__no"), F.lit(-1).cast("long")).otherwise(F.col(n)) for n in ("low_voltage", "high_voltage", "current")}).drop("__no")
    return out


def converged(row_result: DataFrame, tol: float = TOL) -> DataFrame:
    return row_result.withColumn("converged", F.expr(f"coalesce(not isnan(residual) and residual <= {tol}, false) and status not in (4, 5)"))


def category_table(spark) -> DataFrame:
    """(violation_type, type_name, category, category_name)."""
    return spark.createDataFrame([(int(t), t.name, int(CATEGORY[int(t)]), Category(CATEGORY[int(t)]).name) for t in ViolationType], "violation_type int, type_name string, category int, category_name string")


def with_category(records: DataFrame) -> DataFrame:
    return records.join(F.broadcast(category_table(records.sparkSession)), "violation_type")


def new_vs_base(records: DataFrame, base: DataFrame) -> DataFrame:
    """Records whose element, side and type the base case doesn't have."""
    keys = ["element_type", "element_id", "side", "violation_type"]
    return records.join(F.broadcast(base.select(keys).distinct()), keys, "left_anti")


def n1_report(row_result: DataFrame, records: DataFrame, base: DataFrame) -> DataFrame:
    """One row: rows, converged, rows with records, records new against the base, median and largest residual."""
    per = row_result.agg(F.count("*").alias("n_rows"), F.count_if(F.col("status") == 0).alias("n_converged"), F.percentile("residual", 0.5).alias("residual_median"), F.max("residual").alias("residual_max"))
    have = records.agg(F.count_distinct("row_id").alias("rows_with_records"), F.count("*").alias("n_records"))
    new = new_vs_base(records, base).agg(F.count("*").alias("n_new"), F.count_distinct("row_id").alias("rows_with_new"))
    return per.crossJoin(have).crossJoin(new)  # one row each


def worst_rows(records: DataFrame, n: int = 5) -> DataFrame:
    """The n rows with the most records; ties to the larger severity, then the smaller row."""
    return records.groupBy("row_id").agg(F.count("*").alias("n_records"), F.max("severity").alias("worst")).orderBy(F.desc("n_records"), F.desc("worst"), "row_id").limit(n)
