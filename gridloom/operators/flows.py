"""Branch currents and powers from voltages, and the power balance of every bus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.grid import Grid
from .ybus import branch_admittances


def branch_flows(grid: Grid, v: DataFrame, trips: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """v (row_id, bus_id, re, im) -> (row_id, branch_id, i_or_a, i_ex_a, p_or_mw, q_or_mvar, p_ex_mw, q_ex_mvar).

    A missing end counts as 0 V and takes the other end's base. trips (row_id, branch_id): their flows are 0. overrides
    (row_id, branch_id, yff_re .. ytt_im): rows whose transformer stands on another tap.
    """
    y = branch_admittances(grid.branch).select("branch_id", "f", "t", *[f"{a}_{c}" for a in ("yff", "yft", "ytf", "ytt") for c in ("re", "im")])
    base = grid.bus.select("bus_id", "vn_kv")
    y = (y.join(base.withColumnsRenamed({"bus_id": "f", "vn_kv": "vf"}), "f", "left").join(base.withColumnsRenamed({"bus_id": "t", "vn_kv": "vt"}), "t", "left")
         .withColumns({"vf": F.coalesce("vf", "vt"), "vt": F.coalesce("vt", "vf")}))
    # Voltages are the large side: the grid's branch ends go to them, and one grouping brings both ends together.
    ends = y.select("branch_id", F.col("f").alias("bus_id"), F.lit("f").alias("end")).unionByName(y.select("branch_id", F.col("t").alias("bus_id"), F.lit("t").alias("end")))
    at = v.select("row_id", "bus_id", "re", "im").join(F.broadcast(ends), "bus_id")
    both = at.groupBy("row_id", "branch_id").agg(*[F.max(F.when(F.col("end") == end, F.col(c))).alias(f"{end}_{c}") for end in ("f", "t") for c in ("re", "im")])
    both = both.na.fill(0.0, ["f_re", "f_im", "t_re", "t_im"])
    full = both.join(F.broadcast(y), "branch_id")
    if overrides is not None:
        names = [c for c in overrides.columns if c.startswith("y")]
        full = full.join(overrides.select("row_id", "branch_id", *[F.col(c).alias(f"o_{c}") for c in names]), ["row_id", "branch_id"], "left")
        full = full.withColumns({c: F.coalesce(f"o_{c}", c) for c in names})
    cur = lambda a, b: {f"{a}_r": f"{a}f_re * f_re - {a}f_im * f_im + {a}t_re * t_re - {a}t_im * t_im", f"{a}_i": f"{a}f_re * f_im + {a}f_im * f_re + {a}t_re * t_im + {a}t_im * t_re"}
    full = full.withColumns({k: F.expr(x) for a in ("yf", "yt") for k, x in cur(a, a).items()})
    if trips is not None:
        full = full.join(trips.select("row_id", "branch_id").distinct().withColumn("__out", F.lit(True)), ["row_id", "branch_id"], "left")
        for c in ("yf_r", "yf_i", "yt_r", "yt_i"):
            full = full.withColumn(c, F.when(F.col("__out"), 0.0).otherwise(F.col(c)))
    sn = grid.sn_mva
    return full.selectExpr("row_id", "branch_id", f"hypot(yf_r, yf_i) * {sn} * 1000 / (sqrt(3.0D) * vf) as i_or_a", f"hypot(yt_r, yt_i) * {sn} * 1000 / (sqrt(3.0D) * vt) as i_ex_a",
                           f"(f_re * yf_r + f_im * yf_i) * {sn} as p_or_mw", f"(f_im * yf_r - f_re * yf_i) * {sn} as q_or_mvar",
                           f"(t_re * yt_r + t_im * yt_i) * {sn} as p_ex_mw", f"(t_im * yt_r - t_re * yt_i) * {sn} as q_ex_mvar")


def kcl_mismatch(grid: Grid, ybus: DataFrame, v: DataFrame, sbus: DataFrame, flips: DataFrame | None = None) -> DataFrame:
    """(row_id, bus_id, dp_mw, dq_mvar, delta): V conj(Y V) - S on buses that are not slack; reactive power only on pq buses.

    flips (row_id, bus_id): pv buses that are pq on a row.
    """
    # A bus's own voltage comes along with its diagonal entry, its injection as one more record: one grouping and no joins of large sides.
    i = (v.select("row_id", F.col("bus_id").alias("j"), "re", "im").join(F.broadcast(ybus), "j").groupBy("row_id", F.col("i").alias("bus_id"))
         .agg(F.sum(F.expr("g * re - b * im")).alias("ir"), F.sum(F.expr("g * im + b * re")).alias("ii"), *[F.max(F.when(F.col("i") == F.col("j"), F.col(c))).alias(c) for c in ("re", "im")]))
    none = lambda *cs: [F.lit(None).cast("double").alias(c) for c in cs]
    s = i.select("row_id", "bus_id", "ir", "ii", "re", "im", *none("p_mw", "q_mvar")).union(sbus.select("row_id", "bus_id", *none("ir", "ii", "re", "im"), "p_mw", "q_mvar"))
    s = s.groupBy("row_id", "bus_id").agg(*[F.max(c).alias(c) for c in ("ir", "ii", "re", "im")], *[F.sum(c).alias(c) for c in ("p_mw", "q_mvar")])
    s = s.where("re is not null").join(F.broadcast(grid.bus.select("bus_id", "kind")), "bus_id").where("kind <> 'slack'")
    if flips is not None:
        s = s.join(flips.select("row_id", "bus_id", F.lit(True).alias("flip")), ["row_id", "bus_id"], "left").withColumn("kind", F.when(F.col("flip"), "pq").otherwise(F.col("kind")))
    s = s.selectExpr("row_id", "bus_id", f"(re * ir + im * ii) * {grid.sn_mva} - coalesce(p_mw, 0) as dp_mw", f"case when kind = 'pq' then (im * ir - re * ii) * {grid.sn_mva} - coalesce(q_mvar, 0) else 0.0D end as dq_mvar")
    return s.withColumn("delta", F.expr("hypot(dp_mw, dq_mvar)"))


def kcl_summary(kcl: DataFrame) -> DataFrame:
    """Of each row's mean, deviation, max, 95th and 99th percentile and norm: mean and max over the rows."""
    per = kcl.groupBy("row_id").agg(F.avg("delta").alias("mean"), F.stddev_pop("delta").alias("std"), F.max("delta").alias("max"), F.percentile("delta", 0.95).alias("p95"),
                                    F.percentile("delta", 0.99).alias("p99"), F.sqrt(F.sum(F.col("delta") * F.col("delta"))).alias("l2"))
    return per.agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{n}_{c}") for c in ("mean", "std", "max", "p95", "p99", "l2") for n, f in (("avg", F.avg), ("max", F.max))])
