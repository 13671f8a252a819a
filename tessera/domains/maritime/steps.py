"""Maritime steps and the two pipelines that are composed of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tessera.domains.maritime.data import FISHING_TYPES, MMSI_MAX, MMSI_MIN, UNDEFINED_STATUS, VESSEL_TYPE_ID
from tessera.frame import AnnotatedFrame
from tessera.operators.augment import AddTimestamp, AddUndefinedValue, ChangeTypeColumn
from tessera.operators.filters import DropMissingOrNan, FilterRange, FilterWithin, RemoveValueRows
from tessera.operators.joins import MappedLookupJoin, NearestPoint
from tessera.operators.timeseries import AddLocalIndex
from tessera.plans.pipeline import Pipeline
from tessera.plans.step import Step, describe, input, output


class AddVesselType(MappedLookupJoin):
    """Add the vessel type id by identity; a name that is no vessel type is an error of the query."""

    mapping = VESSEL_TYPE_ID


class ComputeClosestAnchorage(NearestPoint):
    """Distance to the nearest anchorage."""


class AddMissingAISStatus(Step):
    """A missing navigation status becomes "undefined"."""

    @describe("Fill in the navigation status")
    @input({"x": {"representation_type": int}})
    @output({"x": {"representation_type": int}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        return AddUndefinedValue(UNDEFINED_STATUS).map_names({"x": self.get_name("x")}).transform(df)


class KeepValidIdentity(FilterRange):
    """Keep ship station identities."""

    def __init__(self) -> None:
        super().__init__(MMSI_MIN, MMSI_MAX)


def cleanse_and_sanitise(
    message_types: Sequence[int] = (1, 2, 3),
    status_column: str = "nav_status",
    fill: dict[str, object] | None = None,
    types: dict[str, str] | None = None,
    drop_missing: Sequence[str] = (),
    remove_source: str | None = "g",
) -> Pipeline:
    """Dated position messages of the given types that do not come from the ground, with an epoch timestamp.

    ``types`` adds columns ``{column}_{type}``; ``drop_missing`` names further columns that must be there.
    """
    p = Pipeline("cleanse_and_sanitise", "Clean position messages")
    if remove_source is not None:
        p.add("remove_source", RemoveValueRows(remove_source), {"x": "source"})
    for name in (*drop_missing, "date_time_utc"):
        p.add(f"drop_missing_{name}", DropMissingOrNan(), {"x": name})
    p.add("message_types", FilterWithin(list(message_types)), {"x": "message_nr"})
    p.add("timestamp", AddTimestamp(), {"from": "date_time_utc", "to": "timestamp"})
    for name, value in ({status_column: UNDEFINED_STATUS} | (fill or {})).items():
        p.add(f"fill_{name}", AddUndefinedValue(value), {"x": name})
    for name, kind in (types or {}).items():
        p.add(f"type_{name}", ChangeTypeColumn(kind), {"x": name, "y": f"{name}_{kind}"})
    return p


def data_processing(vessel_types: DataFrame, fishing_types: DataFrame, anchorages: DataFrame) -> Pipeline:
    """Vessel type, fishing type, distance to the nearest anchorage, and each message's place in its track."""
    p = Pipeline("data_processing", "Features of position messages")
    p.add("vessel_type", AddVesselType(vessel_types, "mmsi", "vessel_type"), {"x": "mmsi", "out": "vessel_type"})
    p.add("vessel_type_known", AddUndefinedValue(0), {"x": "vessel_type"})
    p.add("fishing_type", AddVesselType(fishing_types, "mmsi", "fishing_type"), {"x": "mmsi", "out": "fishing_type"})
    p.add("fishing_type_known", AddUndefinedValue(-1), {"x": "fishing_type"})
    p.add("anchorage", ComputeClosestAnchorage(anchorages, ["latitude", "longitude"]), {"x": "lat", "y": "lon", "distance": "distance_closest_anchorage"})
    p.add("local_index", AddLocalIndex(), {"group": "mmsi", "sort": "timestamp", "local_index": "event_index"})
    return p


__all__ = ["FISHING_TYPES", "AddMissingAISStatus", "AddVesselType", "ComputeClosestAnchorage", "KeepValidIdentity", "cleanse_and_sanitise", "data_processing"]
