"""The shot-table profile: column roles, derived measures, expected catalogue."""

import pytest

from driftline.operators import catalogue
from driftline.profiles import laser_grooving as lg


def columns():
    head = ["DateTime", "Machine_ID", "Product_ID", "Shift", "Lot_ID", "Strip_ID", "Recipe_ID", "Operator_ID"]
    return head + list(lg.SENSORS + lg.RESPONSE + lg.DEFECTS + lg.DIE_COUNTS + ("Yield", "NG_Code") + lg.INFRASTRUCTURE)


def test_taxonomy_covers_the_table(spark):
    assert len(columns()) == len(set(columns())) == 68
    rows = {r["column"]: r for r in catalogue.taxonomy(spark, columns(), lg.ROLES, lg.RULES).collect()}
    assert rows["Frequency"]["subsystem"] == "fdc_laser" and rows["Lot_ID"]["subsystem"] == "id_production"
    assert rows["Lot_ID"]["data_type"] == "id" and rows["Fan_RPM"]["data_type"] == "count"
    assert rows["Particle"]["data_type"] == "binary" and rows["Yield"]["data_type"] == "continuous"
    role = {c: rows[c]["analysis_role"] for c in rows}
    assert role["Focus"] == "excluded_by_expert" and role["Shift"] == "identifier_excluded"
    assert role["Maintenance_Count"] == "undocumented_retained" and role["PLC_Memory"] == "undocumented_excluded"
    assert role["Edge_Burn"] == "excluded_defect" and role["Chipping_Die"] == "target_defect"
    continuous = [c for c in rows if rows[c]["data_type"] == "continuous" and role[c] == "predictor"]
    assert len(continuous) == 33


def test_domain_features(spark):
    values = {"Cooling_Water_Temp": 20.0, "Cooling_Flow": 5.0, "Laser_Power": 18.0, "Groove_Depth": 2.0, "CLN_Flow": 3.0,
              "CLN_Pressure": 2.0, "CLN_Time": 1.0, "Package_Size_1": 5.0, "Package_Size_2": 5.2, "Package_Size_3": 4.8, "Package_Size_4": 5.0}
    df = spark.createDataFrame([tuple(values.values()), tuple(0.0 if k == "Cooling_Flow" else v for k, v in values.items())], list(values))
    a, b = lg.domain_features(df).collect()
    assert (a["Cooling_Thermal_Load"], a["Laser_Cleaning_Demand"], a["Cleaning_Capacity"], a["Cleaning_Load_Ratio"]) == (4.0, 36.0, 6.0, 6.0)
    assert a["Package_Size_Asymmetry"] == pytest.approx(0.163299, abs=1e-6) and b["Cooling_Thermal_Load"] is None
