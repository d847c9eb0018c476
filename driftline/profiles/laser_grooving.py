"""Roles, limits and column lists of the laser-grooving shot table (68 columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftline.functions.expr import row_std
from driftline.operators.catalogue import ColumnRules
from driftline.plans.preprocess import PreprocessOptions
from driftline.schema import Limits, Roles

# Column groups of the shot table.
LASER = ("Laser_Power", "Power_Efficiency", "Laser_Centering_Position", "Laser_Current", "Laser_Voltage",
         "Beam_Diameter", "Frequency")
MOTION = ("Feed_Speed", "Alignment_Time", "Process_Time", "Cutting_X_Index", "Cutting_Y_Index")
THERMAL = ("Head_Temp", "Cooling_Flow", "Cooling_Water_Temp", "Focus")
CLEANING = ("CLN_Flow", "CLN_Pressure", "CLN_Time", "Coating_Flow", "Laser_Head_Remain_Time")
MECHANICAL = ("Vibration",)
RESPONSE = ("Kerf_Width_Profile", "Top_Kerf", "Bottom_Kerf", "Kerf_Angle", "Groove_Depth", "Package_Size_1",
            "Package_Size_2", "Package_Size_3", "Package_Size_4", "Coating_Thickness", "Coating_Uniformity",
            "Cutting_Offset", "Surface_Roughness")
DEFECTS = ("Chipping", "Remain_Coat", "Particle", "Micro_Crack", "Laser_Paim", "Edge_Burn")
DIE_COUNTS = ("Chipping_Die", "Remain_Coat_Die", "Particle_Die", "Micro_Crack_Die", "Laser_Paim_Die",
              "Edge_Burn_Die", "Fail_Die")
INFRASTRUCTURE = ("PLC_CPU_Load", "PLC_Memory", "Network_Latency", "LED_Brightness", "Room_Noise",
                  "Door_Open_Count", "Fan_RPM", "Vision_Exposure", "Maintenance_Count", "Factory_Power")

# Limits of ten measures (lower limit, target, upper limit).
LIMITS = {
    "Laser_Power": Limits(17.8, 18.5, 19.2),
    "Power_Efficiency": Limits(92, 95, 98),
    "Laser_Centering_Position": Limits(-3, 0, 3),
    "Frequency": Limits(98, 100, 102),
    "Feed_Speed": Limits(248, 250, 252),
    "Head_Temp": Limits(38, 42, 47),
    "Focus": Limits(-4, 0, 4),
    "Kerf_Width_Profile": Limits(49.2, 50, 50.8),
    "Coating_Thickness": Limits(9.5, 10, 10.5),
    "Coating_Uniformity": Limits(97, 99, 100),
}

# One-sided measures (True: rising is bad), two-sided ones, constants, pairs.
RISES_IS_BAD = {
    "Head_Temp": True, "Vibration": True, "Alignment_Time": True, "Process_Time": True,
    "Cooling_Flow": False, "Cooling_Water_Temp": True, "Coating_Flow": False, "Groove_Depth": False,
}
TWO_SIDED = ("Laser_Power", "Power_Efficiency", "Focus", "Beam_Diameter", "Kerf_Width_Profile", "Top_Kerf",
             "Bottom_Kerf", "CLN_Time", "Frequency", "Feed_Speed", "Coating_Uniformity", "Laser_Current",
             "Laser_Voltage")
RECOMPUTE_TARGET = ("Kerf_Width_Profile", "Coating_Uniformity")
CONSTANTS = {
    "Laser_Centering_Position": 0.0, "Cutting_X_Index": 0.0, "Cutting_Y_Index": 0.0, "Cutting_Offset": 0.0,
    "Kerf_Angle": 90.0, "Package_Size_1": 5.0, "Package_Size_2": 5.0, "Package_Size_3": 5.0, "Package_Size_4": 5.0,
}
FALLBACK_PAIRS = (("CLN_Pressure", "Remain_Coat"), ("Surface_Roughness", "Particle"), ("CLN_Flow", "Remain_Coat"))
VERIFIED_PAIRS = (("Laser_Power", "Chipping"),)
ALARM_ONLY_PAIRS = (("Coating_Thickness", "Remain_Coat"),)
ZERO_IMPLAUSIBLE = ("Cooling_Flow", "CLN_Flow", "CLN_Pressure", "Laser_Power", "Feed_Speed", "Coating_Flow",
                    "CLN_Time", "Vibration")
EXCLUDED_MEASURES = ("Focus", "Cutting_Offset")
EXCLUDED_LABELS = ("Edge_Burn", "Edge_Burn_Die")
EXPECTED = {"row_count": 100_000, "duplicate_rows": 0, "normal_count": 90_783}

SENSORS = LASER + MOTION + THERMAL + CLEANING + MECHANICAL
# counts are measured as numbers too when only drift is watched
TREND_MEASURES = SENSORS + RESPONSE + ("Yield",) + INFRASTRUCTURE

ROLES = Roles(
    entity="Machine_ID",
    stratum=("Product_ID", "Recipe_ID"),
    time="DateTime",
    key=("Lot_ID", "Strip_ID"),
    measures=TREND_MEASURES,
    labels=DEFECTS,
    normal="Yield = 100 AND NG_Code = 'OK'",
    ok="NG_Code = 'OK'",
    limits=LIMITS,
)

# Subsystems, identifiers, categories, counts and excluded columns.
RULES = ColumnRules(
    subsystems={
        "fdc_laser": LASER, "fdc_motion": MOTION, "fdc_thermal": THERMAL, "fdc_cleaning": CLEANING,
        "fdc_mechanical": MECHANICAL, "response": RESPONSE, "defect_binary": DEFECTS, "defect_count": DIE_COUNTS,
        "outcome": ("Yield", "NG_Code"), "undocumented_env_or_infra": INFRASTRUCTURE,
    },
    ids=("Lot_ID", "Strip_ID"),
    categories=("Machine_ID", "Product_ID", "Recipe_ID", "Shift", "Operator_ID", "NG_Code"),
    label_counts=DIE_COUNTS,
    counts=(*DIE_COUNTS, "Door_Open_Count", "Fan_RPM", "Maintenance_Count"),
    excluded_ids=("Shift", "Lot_ID", "Strip_ID", "Operator_ID"),
    excluded_measures=EXCLUDED_MEASURES,
    excluded_labels=EXCLUDED_LABELS,
    outcomes=("Yield", "NG_Code"),
    undocumented=tuple(c for c in INFRASTRUCTURE if c != "Maintenance_Count"),
    undocumented_kept=("Maintenance_Count",),
)

_PAIRS = FALLBACK_PAIRS + VERIFIED_PAIRS + ALARM_ONLY_PAIRS
#: Detector of each measure, a constant before a pair before a drift rule, and the defects a paired measure watches.
TYPES = {m: "A" for m in RISES_IS_BAD} | {m: "B" for m in TWO_SIDED} | {m: "C" for m, _ in _PAIRS} | {m: "E" for m in CONSTANTS}
WATCHED = {m: tuple(d for x, d in _PAIRS if x == m) for m, _ in _PAIRS}

# What preprocessing has to know.
OPTIONS = PreprocessOptions(
    pairs=FALLBACK_PAIRS,
    verified=VERIFIED_PAIRS,
    alarm_only=ALARM_ONLY_PAIRS,
    consistency=("Fail_Die", "-Yield"),
    rises_is_bad=RISES_IS_BAD,
    two_sided=TWO_SIDED,
    recompute_target=RECOMPUTE_TARGET,
    constants=CONSTANTS,
    averaged=("Head_Temp", "Coating_Uniformity", "Surface_Roughness", "Yield"),
    zero_implausible=ZERO_IMPLAUSIBLE,
    expected=EXPECTED,
    rules=RULES,
    flatline=SENSORS + RESPONSE,
    scanned=(SENSORS + RESPONSE, tuple(d for d in DEFECTS if d not in EXCLUDED_LABELS)),
)


def domain_features(df: DataFrame) -> DataFrame:
    """Five derived measures: thermal load, cleaning demand, capacity, their ratio, asymmetry.

    A zero denominator gives null.
    """
    demand = F.col("Laser_Power") * F.col("Groove_Depth")
    capacity = F.col("CLN_Flow") * F.col("CLN_Pressure") * F.col("CLN_Time")
    return df.withColumns(
        {
            "Cooling_Thermal_Load": F.try_divide("Cooling_Water_Temp", "Cooling_Flow"),
            "Laser_Cleaning_Demand": demand,
            "Cleaning_Capacity": capacity,
            "Cleaning_Load_Ratio": F.try_divide(demand, capacity),
            "Package_Size_Asymmetry": row_std([f"Package_Size_{i}" for i in range(1, 5)]),
        }
    )
