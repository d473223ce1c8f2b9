"""Islands: which rows split the grid, what is left of it, and which reference bus suits most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EDGE_EPS


def live_edges(ybus: DataFrame, patches: DataFrame | None, rows: DataFrame) -> DataFrame:
    """(row_id, a, b) with a < b: an edge goes when both directed entries vanish after the row's patches are summed."""
    cells = rows.select("row_id").distinct().crossJoin(F.broadcast(ybus.where("i <> j")))
    if patches is not None:
        own = patches.where("i <> j").groupBy("row_id", "i", "j").agg(F.sum("dg").alias("dg"), F.sum("db").alias("db"))
        cells = cells.join(own, ["row_id", "i", "j"], "left").selectExpr("row_id", "i", "j", "g + coalesce(dg, 0) as g", "b + coalesce(db, 0) as b")
    return cells.where(f"hypot(g, b) > {EDGE_EPS}").selectExpr("row_id", "least(i, j) as a", "greatest(i, j) as b").distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row_id, bus_id, comp): comp is the least bus of the component on that row.

    A row's grid is small, the rows are many: each row's labels are settled by one fold over its own edges, so there is
    one shuffle by row and no loop over jobs.
    """
    lists = edges.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("e"))
    own = nodes.groupBy("row_id").agg(F.sort_array(F.collect_set("bus_id")).alias("n")).join(lists, "row_id", "left")
    merged = F.expr("""aggregate(coalesce(e, array()), map_from_arrays(n, n),
        (m, x) -> case when m[x.a] = m[x.b] then m
                       else transform_values(m, (k, v) -> case when v = greatest(m[x.a], m[x.b]) then least(m[x.a], m[x.b]) else v end) end)""")
    return own.select("row_id", F.explode(merged).alias("bus_id", "comp"))


def component_mask(comp: DataFrame) -> DataFrame:
    """(row_id, bus_id, comp, masked): the largest component stays, ties go to the one with the least bus; islanded rows only have masked buses."""
    size = comp.groupBy("row_id", "comp").agg(F.count("*").alias("size"))
    best = size.groupBy("row_id").agg(F.min_by("comp", F.struct(-F.col("size"), "comp")).alias("main"))
    return comp.join(best, "row_id").select("row_id", "bus_id", "comp", (F.col("comp") != F.col("main")).alias("masked"))


def split_rows(comp: DataFrame) -> DataFrame:
    """(row_id, n_components, disconnected)."""
    return comp.groupBy("row_id").agg(F.count_distinct("comp").alias("n_components")).withColumn("disconnected", F.col("n_components") > 1)


def reference_slack(mask: DataFrame, candidates: DataFrame, forced: int | None = None) -> DataFrame:
    """(bus_id, stranded): of candidates (bus_id, weight) the one that the fewest rows strand; ties to the larger weight, then the smaller bus."""
    lost = mask.where("masked").groupBy("bus_id").agg(F.count("*").alias("n"))
    ranked = candidates.groupBy("bus_id").agg(F.max("weight").alias("weight")).join(lost, "bus_id", "left").select("bus_id", "weight", F.coalesce("n", F.lit(0)).alias("stranded"))
    if forced is not None:
        return ranked.where(F.col("bus_id") == forced).select("bus_id", "stranded")
    return ranked.agg(F.min(F.struct("stranded", (-F.col("weight")).alias("w"), "bus_id")).alias("m")).select("m.bus_id", "m.stranded")


def skipped_rows(mask: DataFrame, reference: int, hvdc: DataFrame | None = None) -> DataFrame:
    """(row_id, reason): rows whose island holds the reference or one end of an HVDC line."""
    out = mask.where("masked").where(F.col("bus_id") == reference).select("row_id", F.lit("the reference bus is stranded").alias("reason"))
    if hvdc is not None:
        ends = hvdc.select(F.explode(F.array("bus1", "bus2")).alias("bus_id")).distinct()
        out = out.unionByName(mask.where("masked").join(F.broadcast(ends), "bus_id").select("row_id", F.lit("an end of an HVDC line is stranded").alias("reason")))
    return out.groupBy("row_id").agg(F.min("reason").alias("reason"))
