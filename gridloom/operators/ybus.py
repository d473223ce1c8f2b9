"""Branch admittances, assembly of the admittance matrix and its patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_EPS
from ..sources.grid import Grid

_Y = ["yff", "yft", "ytf", "ytt"]


def branch_admittances(branch: DataFrame) -> DataFrame:
    """branch with the eight columns yff_re .. ytt_im (per unit) of its pi model."""
    return (branch.withColumn("__d", F.expr("r * r + x * x")).withColumn("__t", F.expr("case when coalesce(tap, 0) = 0 then 1.0D else tap end"))
            .withColumns({"__gs": F.expr("r / __d"), "__bs": F.expr("-x / __d"), "__c": F.expr("cos(coalesce(shift, 0))"), "__s": F.expr("sin(coalesce(shift, 0))")})
            .withColumns({
                "yff_re": F.expr("__gs / (__t * __t)"), "yff_im": F.expr("(__bs + b / 2) / (__t * __t)"),
                "yft_re": F.expr("-(__gs * __c - __bs * __s) / __t"), "yft_im": F.expr("-(__gs * __s + __bs * __c) / __t"),
                "ytf_re": F.expr("-(__gs * __c + __bs * __s) / __t"), "ytf_im": F.expr("-(__bs * __c - __gs * __s) / __t"),
                "ytt_re": F.col("__gs"), "ytt_im": F.expr("__bs + b / 2")}).drop("__d", "__t", "__gs", "__bs", "__c", "__s"))


def stamps(admittances: DataFrame, *keep: str) -> DataFrame:
    """Up to four entries (i, j, g, b) for each branch; those of a missing end are left out."""
    cells = F.expr("explode(array(struct(f as i, f as j, yff_re as g, yff_im as b), struct(f as i, t as j, yft_re as g, yft_im as b), "
                   "struct(t as i, f as j, ytf_re as g, ytf_im as b), struct(t as i, t as j, ytt_re as g, ytt_im as b)))")
    return admittances.select(*keep, cells.alias("c")).where("c.i is not null and c.j is not null").select(*keep, "c.i", "c.j", "c.g", "c.b")


def assemble(grid: Grid) -> DataFrame:
    """ybus(i, j, g, b), shunts on the diagonal."""
    shunt = grid.shunt.selectExpr("bus_id as i", "bus_id as j", f"g_mw / {grid.sn_mva} as g", f"b_mvar / {grid.sn_mva} as b")
    return stamps(branch_admittances(grid.branch)).unionByName(shunt).groupBy("i", "j").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))


def trip_patches(grid: Grid, trips: DataFrame) -> DataFrame:
    """trips (row_id, branch_id) -> entries (row_id, branch_id, i, j, dg, db) that leave the matrix."""
    own = branch_admittances(grid.branch)
    return stamps(trips.join(F.broadcast(own), "branch_id"), "row_id", "branch_id").selectExpr("row_id", "branch_id", "i", "j", "-g as dg", "-b as db")


def merge_patches(patches: DataFrame) -> DataFrame:
    """Patches on one entry are one: (row_id, i, j, dg, db)."""
    return patches.groupBy("row_id", "i", "j").agg(F.sum("dg").alias("dg"), F.sum("db").alias("db"))


def one_sided(grid: Grid, opened: DataFrame) -> DataFrame:
    """opened (row_id, branch_id, side 1 or 2): what an open end changes. The closed end keeps y_kk - y_ko y_ok / y_oo."""
    y = opened.join(F.broadcast(branch_admittances(grid.branch)), "branch_id")
    o, k = "case when side = 1 then yff_{p} else ytt_{p} end", "case when side = 1 then f else t end"
    y = y.selectExpr("row_id", "branch_id", "side", f"{k} as o", "case when side = 1 then t else f end as k", *[f"{o.format(p=p)} as o_{p}" for p in ("re", "im")],
                     *["case when side = 1 then ytt_{0} else yff_{0} end as k_{0}".format(p) for p in ("re", "im")], "yft_re", "yft_im", "ytf_re", "ytf_im",
                     "yft_re * ytf_re - yft_im * ytf_im as m_re", "yft_re * ytf_im + yft_im * ytf_re as m_im")
    y = y.withColumns({"q_re": F.expr("(m_re * o_re + m_im * o_im) / (o_re * o_re + o_im * o_im)"), "q_im": F.expr("(m_im * o_re - m_re * o_im) / (o_re * o_re + o_im * o_im)")})
    ko = "case when side = 1 then ytf_{0} else yft_{0} end"
    ok = "case when side = 1 then yft_{0} else ytf_{0} end"
    return y.select("row_id", "branch_id", F.expr(
        "explode(array(struct(o as i, o as j, -o_re as dg, -o_im as db), "
        f"struct(o as i, k as j, -({ok.format('re')}) as dg, -({ok.format('im')}) as db), "
        f"struct(k as i, o as j, -({ko.format('re')}) as dg, -({ko.format('im')}) as db), "
        "struct(k as i, k as j, -q_re as dg, -q_im as db)))").alias("c")).select("row_id", "branch_id", "c.i", "c.j", "c.dg", "c.db")


def patched(ybus: DataFrame, patches: DataFrame) -> DataFrame:
    """ybus of every patched row: (row_id, i, j, g, b); entries that vanish are left out."""
    rows = patches.select("row_id").distinct()
    return (rows.crossJoin(F.broadcast(ybus)).join(merge_patches(patches), ["row_id", "i", "j"], "left")
            .selectExpr("row_id", "i", "j", "g + coalesce(dg, 0) as g", "b + coalesce(db, 0) as b").where(f"hypot(g, b) > {EDGE_EPS}"))
