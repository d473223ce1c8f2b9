"""What each row changes: trips, injections, set-points, and the rules that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import GEN_V_TOL
from ..sources.grid import Grid

KINDS = ("branch", "shunt", "load", "gen", "branch_side1", "branch_side2", "sgen", "storage", "svc", "hvdc")
TRIP = "row_id long, element_type string, element_id int"


def contingencies_by_branch(spark: SparkSession, lists: list[list[int]]) -> DataFrame:
    """trip(row_id, element_type, element_id) of branch lists; repeated ids count once."""
    rows = [(i, "branch", int(b)) for i, ids in enumerate(lists) for b in ids]
    return spark.createDataFrame(rows, TRIP).dropDuplicates()


def contingencies(spark: SparkSession, items: list[tuple], after: DataFrame | None = None) -> DataFrame:
    """Tuples of 4, 6 or 10 id lists in the order of KINDS, added behind `after`. Empty ones are refused, all or none."""
    rows, start = [], 0
    if after is not None:
        last = after.agg(F.max("row_id")).first()[0]
        start = 0 if last is None else last + 1
    for i, item in enumerate(items):
        if len(item) not in (4, 6, 10):
            raise ValueError(f"contingency {i}: 4, 6 or 10 lists are needed, not {len(item)}")
        if not any(len(x) for x in item):
            raise ValueError(f"contingency {i} is empty")
        rows += [(start + i, k, int(e)) for k, ids in zip(KINDS, item, strict=False) for e in ids]
    new = normalise_sides(spark.createDataFrame(rows, TRIP))
    return new if after is None else after.unionByName(new)


def normalise_sides(trip: DataFrame) -> DataFrame:
    """Both sides of one branch open, or a branch that is also tripped whole: one whole trip."""
    side = F.col("element_type").isin("branch_side1", "branch_side2")
    whole = F.col("element_type") == "branch"
    per = (trip.where(side | whole).groupBy("row_id", "element_id")
           .agg(F.max(F.col("element_type") == "branch_side1").alias("s1"), F.max(F.col("element_type") == "branch_side2").alias("s2"), F.max(whole).alias("w")))
    kind = F.expr("case when w or (s1 and s2) then 'branch' when s1 then 'branch_side1' else 'branch_side2' end")
    return trip.where(~(side | whole)).dropDuplicates().unionByName(per.select("row_id", kind.alias("element_type"), "element_id"))


def n_minus_1(grid: Grid) -> DataFrame:
    """A row for each branch, in order."""
    n = F.row_number().over(Window.orderBy("branch_id")) - 1  # the grid's own branches: one grid, not the corpus of rows
    return grid.branch.select(n.cast("long").alias("row_id"), F.lit("branch").alias("element_type"), F.col("branch_id").alias("element_id"))


#: Rows of one task where a step multiplies them: what a task holds doesn't grow with the input.
ROWS_A_TASK = 250_000


def by_row(df: DataFrame, n: int) -> DataFrame:
    """df (row_id, ..) of about n records with each row_id in one task, n / ROWS_A_TASK tasks or more.

    All that is grouped by row_id and more afterwards needs no further shuffle. Adaptive execution would join tasks by the bytes that they
    read, which says little of what comes out of them: the number is fixed here.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK))
    return df.repartition(tasks, "row_id")


def states(rows: DataFrame, *of: str) -> DataFrame:
    """The different values of the columns `of`, with a row_id made of them: rows in one state have one result, which is worked out once."""
    return rows.select(F.struct(*of).alias("row_id"), *of).distinct()


def of_states(rows: DataFrame, found: DataFrame, *of: str, spread: int = 0) -> DataFrame:
    """found (row_id of states(), ..) handed to every row: (row_id, ..). spread: where found is small and bounded 0 (it goes to the rows);
    where rows x found is large, in how many parts the rows of a state are dealt. Rows of a part follow each other, so their equal records are stored once by columnar formats."""
    mine = rows.select("row_id", *of)
    rest = [c for c in found.columns if c != "row_id"]
    found = found.select(*[F.col(f"row_id.{c}").alias(c) for c in of], *rest)
    if not spread:
        return mine.join(F.broadcast(found), list(of)).select("row_id", *rest)
    mine = mine.withColumn("__part", F.pmod(F.xxhash64("row_id"), F.lit(spread)))
    found = found.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    return mine.join(found.hint("merge"), [*of, "__part"]).select("row_id", *rest)


def trip_lists(trip: DataFrame) -> DataFrame:
    """(row_id, one array of sorted ids for each kind)."""
    return trip.groupBy("row_id").agg(*[F.sort_array(F.collect_set(F.when(F.col("element_type") == k, F.col("element_id")))).alias(k) for k in KINDS])


def _off(off: DataFrame, kind: str) -> DataFrame:
    """(row_id, <kind>_id) of the trips of one kind, each once."""
    return off.where(F.col("element_type") == kind).select("row_id", F.col("element_id").alias(f"{kind}_id")).distinct()


def bus_injections(grid: Grid, rows: DataFrame, load_p: DataFrame | None = None, gen_p: DataFrame | None = None, off: DataFrame | None = None) -> DataFrame:
    """sbus(row_id, bus_id, p_mw, q_mvar): generators and static generators add, loads and storages subtract, what is off is left out.

    load_p: (row_id, load_id, p_mw, q_mvar); gen_p: (row_id, gen_id, p_mw); rows without own values take the grid's.
    off: trip rows of loads, generators, static generators and storages. Buses where nothing is on have no row.

    What the grid itself gives is summed by bus once, and each row takes its own trips off that sum: rows meet buses, never all elements.
    """
    base = rows.select("row_id").distinct()
    parts = []
    for kind, sign, own in (("load", -1, load_p), ("gen", 1, gen_p), ("sgen", 1, None), ("storage", -1, None)):
        q = "0.0D" if kind == "gen" else f"{sign} * q_mvar"
        value = [f"{sign} * p_mw as p_mw", f"{q} as q_mvar"]
        table = getattr(grid, kind)
        if own is not None:
            if off is not None:
                own = own.join(_off(off, kind), ["row_id", f"{kind}_id"], "left_anti")
            parts.append(own.join(table.select(f"{kind}_id", "bus_id"), f"{kind}_id").selectExpr("row_id", "bus_id", *value, "1L as n"))
            continue
        total = table.selectExpr("bus_id", *value).groupBy("bus_id").agg(F.sum("p_mw").alias("p_mw"), F.sum("q_mvar").alias("q_mvar"), F.count("*").alias("n"))
        # At most a row for each bus of one grid.
        parts.append(base.crossJoin(F.broadcast(total)).select("row_id", "bus_id", "p_mw", "q_mvar", "n"))
        if off is not None:
            gone = _off(off, kind).join(table.selectExpr(f"{kind}_id", "bus_id", *value), f"{kind}_id")
            parts.append(gone.selectExpr("row_id", "bus_id", "-p_mw as p_mw", "-q_mvar as q_mvar", "-1L as n"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("row_id", "bus_id").agg(F.sum("p_mw").alias("p_mw"), F.sum("q_mvar").alias("q_mvar"), F.sum("n").alias("n")).where("n > 0").drop("n")


#: Kinds that a solve can trip, with the grid's table of them.
TABLES = {"branch": "branch", "branch_side1": "branch", "branch_side2": "branch", "shunt": "shunt", "load": "load", "gen": "gen", "sgen": "sgen", "storage": "storage", "hvdc": "hvdc"}


def unknown_elements(grid: Grid, trip: DataFrame) -> DataFrame:
    """(row_id, reason): rows that trip an element which the grid doesn't have, or of a kind that it has no table for."""
    known = [grid.spark.createDataFrame([], "element_type string, element_id int")]
    for kind, table in TABLES.items():
        known.append(getattr(grid, table).select(F.lit(kind).alias("element_type"), F.col(f"{table}_id").alias("element_id")))
    every = known[0]
    for k in known[1:]:
        every = every.unionByName(k)
    missing = trip.join(every, ["element_type", "element_id"], "left_anti")
    return missing.groupBy("row_id").agg(F.min(F.concat(F.lit("there is no "), "element_type", F.lit(" "), F.col("element_id").cast("string"))).alias("reason"))


def pv_flips(grid: Grid, off: DataFrame) -> DataFrame:
    """(row_id, bus_id): buses whose every generator is off on that row, which are then pq."""
    n = grid.gen.groupBy("bus_id").agg(F.count("*").alias("n"))
    gone = (off.where("element_type = 'gen'").select("row_id", F.col("element_id").alias("gen_id")).distinct()
            .join(F.broadcast(grid.gen.select("gen_id", "bus_id")), "gen_id").groupBy("row_id", "bus_id").agg(F.count("*").alias("gone")))
    return gone.join(F.broadcast(n), "bus_id").where("gone = n").select("row_id", "bus_id")


def set_points(grid: Grid, gen_v: DataFrame, off: DataFrame | None = None) -> DataFrame:
    """gen_v (row_id, gen_id, v, null: keep) -> (row_id, bus_id, v_set, spread, conflict)."""
    own = gen_v if off is None else gen_v.join(off.where("element_type = 'gen'").select("row_id", F.col("element_id").alias("gen_id")), ["row_id", "gen_id"], "left_anti")
    return (own.join(F.broadcast(grid.gen.select("gen_id", "bus_id", "v_set")), "gen_id").withColumn("v", F.coalesce("v", "v_set"))
            .groupBy("row_id", "bus_id").agg(F.max("v").alias("v_set"), (F.max("v") - F.min("v")).alias("spread")).withColumn("conflict", F.col("spread") > GEN_V_TOL))


def unsupported(conflicts: DataFrame, trip: DataFrame, per_bus_injections: bool = False) -> DataFrame:
    """(row_id, reason) of rows that can not be simulated as asked."""
    a = conflicts.where("conflict").select("row_id", F.lit("generators of one bus have different set-points").alias("reason"))
    b = trip.where("element_type = 'load'").select("row_id", F.lit("loads can not be tripped where injections are given by bus").alias("reason")) if per_bus_injections else a.limit(0)
    return a.unionByName(b).groupBy("row_id").agg(F.min("reason").alias("reason"))


def check_row_sets(*tables: DataFrame) -> None:
    """All tables must be about the same rows."""
    first = tables[0].select("row_id").distinct()
    for t in tables[1:]:
        other = t.select("row_id").distinct()
        if not first.exceptAll(other).isEmpty() or not other.exceptAll(first).isEmpty():
            raise ValueError("the row specifications are not about the same rows")


def _uniform(seed: int):
    """In (0, 1), by a hash of row, load and seed."""
    return (F.pmod(F.xxhash64(F.lit(seed), "row_id", "load_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int):
    """Standard normal, by hashes of row, load, seed and seed + 1."""
    return F.sqrt(-2 * F.log(_uniform(seed))) * F.cos(2 * 3.141592653589793 * _uniform(seed + 1))


def lognormal_scenarios(spark: SparkSession, grid: Grid, n: int, sigma: float = 0.05, seed: int = 0) -> DataFrame:
    """load_p of n rows: each load times exp(sigma * noise), the noise a hash of row, load and seed."""
    z = F.exp(sigma * normal(seed + 1))
    return spark.range(n).withColumnRenamed("id", "row_id").crossJoin(F.broadcast(grid.load)).select("row_id", "load_id", (F.col("p_mw") * z).alias("p_mw"), (F.col("q_mvar") * z).alias("q_mvar"))


def follow_loads(grid: Grid, load: DataFrame) -> DataFrame:
    """gen_p (row_id, gen_id, p_mw): all scaled by (the row's loads - negative generators) / the grid's loads; negative generators stay as they are."""
    base = grid.load.agg(F.sum("p_mw").alias("base")).crossJoin(grid.gen.agg(F.coalesce(F.sum(F.least("p_mw", F.lit(0.0))), F.lit(0.0)).alias("negative")))
    ratio = load.groupBy("row_id").agg(F.sum("p_mw").alias("total")).crossJoin(F.broadcast(base)).selectExpr("row_id", "(total - negative) / base as ratio")
    return ratio.crossJoin(F.broadcast(grid.gen)).selectExpr("row_id", "gen_id", "case when p_mw > 0 then p_mw * ratio else p_mw end as p_mw")


def uniform_scenarios(spark: SparkSession, grid: Grid, n: int, spread: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(load_p, gen_p): every load within +-spread, P and Q apart (a negative load too); generators follow their row's total."""
    drawn = lambda c, k: (F.col(c) * (1 + spread * (2 * _uniform(seed + k) - 1))).alias(c)
    load = spark.range(n).withColumnRenamed("id", "row_id").crossJoin(F.broadcast(grid.load)).select("row_id", "load_id", drawn("p_mw", 1), drawn("q_mvar", 2))
    return load, follow_loads(grid, load)
