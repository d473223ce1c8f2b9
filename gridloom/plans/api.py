"""Four entry points over one pipeline: single power flow, contingencies, injection sweeps, row-aligned scenario sweeps."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import flows, limits, rows
from ..operators.ybus import assemble
from ..schema import VIOLATION_TOL
from ..sources.grid import Grid
from .powerflow import arrays, base_case, row_inputs, solve_rows, voltages
from .solver import Options


#: What a study can write or hand over.
OUTPUTS = ("voltages", "flows", "violations", "converged", "metrics")


class _Study:
    def __init__(self, grid: Grid, options: Options | None = None, handle_islands: bool = False, controls=None):
        self.grid, self.options, self.handle_islands, self.controls = grid, options or Options(), handle_islands, controls
        self.options.check()
        if self.options.tol > VIOLATION_TOL:
            warnings.warn("rows may converge whose residual counts as a divergence", stacklevel=3)

    def _inputs(self) -> DataFrame:
        raise NotImplementedError

    def _trips(self) -> DataFrame | None:
        return None

    _kept = None

    def _base(self):
        """Arrays and base case of the grid: read and solved once, then kept until the grid or the options change."""
        if self._kept is None or self._kept[0] is not self.grid or self._kept[1] != self.options:
            a = arrays(self.grid)
            self._kept = self.grid, replace(self.options), a, base_case(a, self.options)
        return self._kept[2:]

    def compute(self) -> DataFrame:
        """One record for each row (lazy): status, residual, iterations, voltages."""
        self.options.check()
        a, warm = self._base()
        self.result = solve_rows(self.grid, self._inputs(), self.options, self.handle_islands, self.controls, warm, a)
        return self.result

    def voltages(self) -> DataFrame:
        return voltages(self.grid, self.result)

    def flows(self) -> DataFrame:
        return flows.branch_flows(self.grid, self.voltages(), self._trips())

    def violations(self, capacity: int = 16) -> DataFrame:
        return limits.with_category(limits.violations(self.grid, self.result, self.voltages(), self.flows(), self._trips(), capacity))

    def base_violations(self, capacity: int = 16) -> DataFrame:
        """What the grid itself violates without any row's changes; its row_id is 0."""
        base = AcPowerFlow(self.grid, self.options)
        base._kept = self._kept
        base.compute()
        return base.violations(capacity)

    def to_arrow(self, of: str = "voltages", most: int = 10_000_000):
        """An Arrow table of one of OUTPUTS in the driver's memory: refused beyond `most` rows (see map_arrow)."""
        df = self._output(of)
        got = df.limit(most + 1).toArrow()
        if got.num_rows > most:
            raise ValueError(f"{of} has more than {most} rows: use map_arrow or write")
        return got

    def map_arrow(self, run, schema: str, of: str = "voltages") -> DataFrame:
        """Hand one of OUTPUTS as Arrow batches to run(batches), on the executors."""
        return self._output(of).mapInArrow(run, schema)

    def write(self, folder: str, fmt: str = "parquet", outputs: tuple[str, ...] = OUTPUTS) -> None:
        """folder/<output> for each of outputs, in any of Spark's formats that holds its columns."""
        for of in outputs:
            self._output(of).write.mode("overwrite").format(fmt).save(f"{folder}/{of}")

    def _output(self, of: str) -> DataFrame:
        if of not in OUTPUTS:
            raise ValueError(f"{of} is none of {', '.join(OUTPUTS)}")
        return getattr(self, of)()

    def converged(self) -> DataFrame:
        return limits.converged(self.result.select("row_id", "status", "residual"), self.options.tol)

    def metrics(self) -> DataFrame:
        return self.result.groupBy("status").agg(F.count("*").alias("n_rows"), F.sum("n_iter").alias("iterations"), F.max("n_iter").alias("most"), F.sum("n_outer").alias("outer_iterations"))


class AcPowerFlow(_Study):
    def _inputs(self) -> DataFrame:
        return row_inputs(self.grid, self.grid.spark.range(1).withColumnRenamed("id", "row_id"))

    def base(self):
        return self._base()[1]


class ContingencyAnalysis(_Study):
    trip = None

    def add_contingencies_by_branch_id(self, lists: list[list[int]]) -> None:
        self.trip = rows.contingencies_by_branch(self.grid.spark, lists)

    def add_contingencies(self, items: list[tuple]) -> None:
        self.trip = rows.contingencies(self.grid.spark, items, self.trip)

    def add_contingency(self, kind: str, lists: list[list[int]]) -> None:
        """Rows that trip elements of one kind (any of rows.KINDS)."""
        at = rows.KINDS.index(kind)
        self.add_contingencies([tuple(ids if i == at else [] for i in range(len(rows.KINDS))) for ids in lists])

    def add_contingency_shunt(self, *ids: int) -> None:
        self.add_contingency("shunt", [list(ids)])

    def add_contingency_load(self, *ids: int) -> None:
        self.add_contingency("load", [list(ids)])

    def add_contingency_gen(self, *ids: int) -> None:
        self.add_contingency("gen", [list(ids)])

    def add_contingency_sgen(self, *ids: int) -> None:
        self.add_contingency("sgen", [list(ids)])

    def add_contingency_storage(self, *ids: int) -> None:
        self.add_contingency("storage", [list(ids)])

    def add_contingency_svc(self, *ids: int) -> None:
        self.add_contingency("svc", [list(ids)])

    def add_contingency_hvdc(self, *ids: int) -> None:
        self.add_contingency("hvdc", [list(ids)])

    def n_minus_1(self) -> None:
        self.trip = rows.n_minus_1(self.grid)

    def report(self, capacity: int = 16) -> DataFrame:
        """What each row adds to the base case's violations."""
        return limits.n1_report(self.result, self.violations(capacity), self.base_violations(capacity))

    def get_contingencies(self) -> DataFrame:
        return rows.trip_lists(self.trip)

    def _trips(self) -> DataFrame:
        """Branches without a flow: a branch that is open at one end carries none that is checked."""
        return self.trip.where("element_type in ('branch', 'branch_side1', 'branch_side2')").select("row_id", F.col("element_id").alias("branch_id"))

    def _inputs(self) -> DataFrame:
        return row_inputs(self.grid, self.trip, elements=self.trip)


class InjectionSweep(_Study):
    """Rows differ in injections; set-point conflicts are an error."""

    parts = sbus = None

    def set_injections(self, sbus) -> None:
        """By bus: a DataFrame or an Arrow table (row_id, bus_id, p_mw, q_mvar)."""
        self.sbus, self.parts = self._frame(sbus), None

    def set_injections_from_elements(self, load_p, gen_p=None) -> None:
        """By load and generator: DataFrames or Arrow tables (row_id, load_id, p_mw, q_mvar) and (row_id, gen_id, p_mw)."""
        self.parts, self.sbus = (self._frame(load_p), None if gen_p is None else self._frame(gen_p)), None

    def _frame(self, table) -> DataFrame:
        return table if isinstance(table, DataFrame) else self.grid.spark.createDataFrame(table)

    def _injections(self, off: DataFrame | None = None) -> DataFrame:
        """What each row injects without what is off there: with the row's own values, or, where injections are given by bus, less the grid's."""
        if self.parts is not None:
            load_p, gen_p = self.parts
            return rows.bus_injections(self.grid, load_p, load_p, gen_p, off)
        if off is None:
            return self.sbus
        kinds = off.where("element_type in ('gen', 'sgen', 'storage')")
        gone = None
        for kind, sign in (("gen", 1), ("sgen", 1), ("storage", -1)):
            q = "0.0D" if kind == "gen" else f"{-sign} * q_mvar"
            own = rows._off(kinds, kind).join(getattr(self.grid, kind), f"{kind}_id").selectExpr("row_id", "bus_id", f"{-sign} * p_mw as p_mw", f"{q} as q_mvar")
            gone = own if gone is None else gone.unionByName(own)
        return self.sbus.select("row_id", "bus_id", "p_mw", "q_mvar").unionByName(gone).groupBy("row_id", "bus_id").agg(F.sum("p_mw").alias("p_mw"), F.sum("q_mvar").alias("q_mvar"))

    def _rows(self) -> DataFrame:
        return self.sbus if self.parts is None else self.parts[0]

    def set_gen_v(self, gen_v: DataFrame) -> None:
        v = rows.set_points(self.grid, gen_v)
        if not v.where("conflict").isEmpty():
            raise ValueError("generators of one bus have different set-points")
        self.v_set = v.select("row_id", "bus_id", "v_set")

    def _inputs(self) -> DataFrame:
        return row_inputs(self.grid, self._rows(), self._injections(), v_set=getattr(self, "v_set", None))


class ScenarioSweep(InjectionSweep):
    """Rows differ in injections, topology, trips and set-points, joined by row_id; conflicting rows are not simulated."""

    trip = conflicts = None

    def set_topology(self, lists: list[list[int]] | DataFrame) -> None:
        """Branches that are out: a list for each row, or (row_id, branch_id)."""
        self._replace("branch", lists if isinstance(lists, DataFrame) else rows.contingencies_by_branch(self.grid.spark, lists).select("row_id", F.col("element_id").alias("branch_id")))

    def set_contingency(self, kind: str, off: DataFrame) -> None:
        """Elements of one kind (any of rows.KINDS) that are off: (row_id, <kind>_id), or (row_id, branch_id) for the sides of branches."""
        self._replace(kind, off)

    def set_contingency_gens(self, off: DataFrame) -> None:
        self._replace("gen", off)

    def _replace(self, kind: str, off: DataFrame) -> None:
        column = "branch_id" if kind.startswith("branch") else f"{kind}_id"
        new = off.select("row_id", F.lit(kind).alias("element_type"), F.col(column).cast("int").alias("element_id"))
        old = None if self.trip is None else self.trip.where(F.col("element_type") != kind)
        self.trip = new if old is None else old.unionByName(new)

    def set_gen_v(self, gen_v: DataFrame) -> None:
        v = rows.set_points(self.grid, gen_v)
        self.conflicts = v.where("conflict").select("row_id", "conflict").distinct()
        self.v_set = v.where("not conflict").select("row_id", "bus_id", "v_set")

    def _trips(self) -> DataFrame | None:
        return None if self.trip is None else self.trip.where("element_type like 'branch%'").select("row_id", F.col("element_id").alias("branch_id"))

    def _inputs(self) -> DataFrame:
        trip = None if self.trip is None else rows.normalise_sides(self.trip)
        none = self.grid.spark.createDataFrame([], "row_id long, conflict boolean")
        reasons = rows.unsupported(none if self.conflicts is None else self.conflicts, self.grid.spark.createDataFrame([], rows.TRIP) if trip is None else trip, self.parts is None)
        return row_inputs(self.grid, self._rows(), self._injections(trip), v_set=getattr(self, "v_set", None), elements=trip, reasons=reasons)


__all__ = ["AcPowerFlow", "ContingencyAnalysis", "InjectionSweep", "ScenarioSweep", "assemble"]
