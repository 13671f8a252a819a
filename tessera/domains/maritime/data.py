"""Maritime constants: vessel types, navigation status, limits of fields."""

from __future__ import annotations

from tessera.model.ranges import CyclicMinMax, MinMax
from tessera.model.spec import ColumnSpec

# Vessel types in order of their ids.
VESSEL_TYPES = (
    "unspecified", "cargo", "passenger", "pleasure", "specialcraft", "tanker", "tug", "fishing", "squid_jigger",
    "drifting_longlines", "pole_and_line", "trollers", "fixed_gear", "pots_and_traps", "set_longlines", "set_gillnets",
    "trawlers", "dredge_fishing", "seiners", "purse_seines", "tuna_purse_seines", "other_purse_seines", "other_seines",
)
VESSEL_TYPE_ID = {name: k for k, name in enumerate(VESSEL_TYPES)}
FISHING_TYPES = tuple(VESSEL_TYPES[8:])

# Navigation status codes.
NAVIGATION_STATUS = {
    0: "under way using engine", 1: "at anchor", 2: "not under command", 3: "restricted manoeuvrability",
    4: "constrained by draught", 5: "moored", 6: "aground", 7: "engaged in fishing", 8: "under way sailing",
    9: "reserved", 10: "reserved", 11: "towing astern", 12: "pushing ahead", 13: "reserved", 14: "search and rescue",
    15: "undefined",
}
UNDEFINED_STATUS = 15

# Limits of the fields.
MMSI_MIN, MMSI_MAX = 200_000_000, 799_999_999
COURSE_MIN, COURSE_MAX = -360.0, 360.0
SPEED_MIN, SPEED_MAX = 0.0, 102.0
ROT_MIN, ROT_MAX = -720.0, 720.0


def vessel_type_id(name: str) -> int:
    if name not in VESSEL_TYPE_ID:
        raise KeyError(f"vessel type '{name}' is not known")
    return VESSEL_TYPE_ID[name]


def vessel_type_name(number: int) -> str:
    return VESSEL_TYPES[number]


POSITION_SPECS = (
    ColumnSpec("mmsi", "ship station identity", representation_type=int, value_range=MinMax(MMSI_MIN, MMSI_MAX)),
    ColumnSpec("lon", "longitude", unit="deg", representation_type=float, value_range=CyclicMinMax(-180.0, 180.0)),
    ColumnSpec("lat", "latitude", unit="deg", representation_type=float, value_range=MinMax(-90.0, 90.0)),
    ColumnSpec("sog", "speed over ground", unit="knots", representation_type=float, value_range=MinMax(SPEED_MIN, SPEED_MAX)),
    ColumnSpec("cog", "course over ground", unit="deg", representation_type=float, value_range=CyclicMinMax(COURSE_MIN, COURSE_MAX)),
    ColumnSpec("rot", "rate of turn", unit="deg / min", representation_type=float, value_range=MinMax(ROT_MIN, ROT_MAX)),
    ColumnSpec("nav_status", "navigation status", representation_type=int, value_range=MinMax(0, 15), value_meanings=NAVIGATION_STATUS),
)
