"""Codes, tolerances and table layouts of the engine."""

from __future__ import annotations

from enum import IntEnum

# Codes and default tolerances are part of what users of the tables rely on.


class RowStatus(IntEnum):
    CONVERGED = 0
    MAX_ITER = 1
    DIVERGED = 2
    NOT_SIMULATED = 3
    OUTER_FAILED = 4
    OUTER_UNSTABLE = 5
    UNREALISTIC = 6


class ElementType(IntEnum):
    BUS = 0
    LINE = 1
    TRAFO = 2
    GRID = 3
    HVDC = 4
    GENERATOR = 5
    STORAGE = 6
    SVC = 7


class ViolationType(IntEnum):
    LOW_VOLTAGE = 0
    HIGH_VOLTAGE = 1
    CURRENT = 2
    NOT_SIMULATED = 3
    DIVERGENCE = 4
    LOW_Q = 5
    HIGH_Q = 6
    HIGH_P = 7
    LOW_P = 8
    LOW_VOLTAGE_AT_MIN_Q = 9
    HIGH_VOLTAGE_AT_MAX_Q = 10
    LOW_VOLTAGE_SVC_STANDBY = 11
    HIGH_VOLTAGE_SVC_STANDBY = 12
    LOW_VOLTAGE_REMOTE_CONTROL = 13
    HIGH_VOLTAGE_REMOTE_CONTROL = 14
    HVDC_AC_EMULATION_RELEASE = 15
    BATCH_UNSUPPORTED = 21


class Category(IntEnum):
    OPERATIONAL = 0
    PHYSICAL = 1
    SOLVER = 2
    CONTROL = 3


class ReactiveStatus(IntEnum):
    NO_SWITCH = 0
    RECOMPUTED = 1
    UNSUPPORTED = 2
    LEFT_OUT = 3
    DIVERGED = 4


#: Category of each violation type.
CATEGORY = {t: Category.OPERATIONAL for t in (0, 1, 2)} | {t: Category.SOLVER for t in (3, 4, 21)} | {t: Category.PHYSICAL for t in (5, 6, 7, 8)} | {t: Category.CONTROL for t in range(9, 16)}

TOL, NB_ITER = 1e-8, 4
MAX_ITER_BASE, TOL_BASE = 10, 1e-8
VIOLATION_REL_TOL, VIOLATION_CAPACITY, VIOLATION_TOL = 1e-9, 16, 1e-6
PHYSICAL_TOL = 1e-4
GEN_V_TOL, PSEUDO_OFF_TOL = 1e-8, 1e-7
SLACK_EPS_MW, SLACK_MIN_WEIGHT = 1e-6, 1e-7
EDGE_EPS = 1e-10
MAX_DVA, MAX_DVM = 0.5, 0.1

SCHEMAS = {
    "bus": "bus_id int, vn_kv double, kind string, slack_weight double, v_set double, vmin_kv double, vmax_kv double",
    "branch": "branch_id int, kind string, local_id int, f int, t int, r double, x double, b double, tap double, shift double, limit1_ka double, limit2_ka double",
    "load": "load_id int, bus_id int, p_mw double, q_mvar double",
    "gen": "gen_id int, bus_id int, p_mw double, v_set double, min_p double, max_p double, min_q double, max_q double, weight double",
    "shunt": "shunt_id int, bus_id int, g_mw double, b_mvar double",
    "sgen": "sgen_id int, bus_id int, p_mw double, q_mvar double",
    "storage": "storage_id int, bus_id int, p_mw double, q_mvar double",
    "hvdc": "hvdc_id int, bus1 int, bus2 int, p0_mw double, k double, lf1 double, lf2 double, r double, pmax_mw double",
}
