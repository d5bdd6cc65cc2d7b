"""Attributes of a linear-referenced inventory for matched edges: which rows each table gives a match, and which of them is taken.

Classes, strategic network and truck routes go by the longest overlap; of the bridges along a match the one with the lowest condition rating, of the culverts
in it too; of traffic counts the latest for each start measure, then the longest overlap.  Only current records (``to_date`` null) count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfault.operators import linear_reference as L

#: Columns of the inventories' tables and what results call them; names of the coded domains.
COUNT_COLUMNS = {
    "FullCount": "full_count", "OnewayFlag": "oneway_flag", "CalculationYear": "calculation_year", "AADT": "aadt", "DHV": "dhv", "DDHV": "ddhv", "SU_AADT": "su_aadt", "CU_AADT": "cu_aadt",
    "KFactor": "k_factor", "DFactor": "d_factor", "AvgTruckPercent": "avg_truck_percent", "AvgSUPercent": "avg_su_percent", "AvgCUPercent": "avg_cu_percent",
    "AvgMotorcyclePercent": "avg_motorcycle_percent", "AvgCarPercent": "avg_car_percent", "AvgLightTruckPercent": "avg_light_truck_percent", "AvgBusPercent": "avg_bus_percent",
    "AvgWeekday_F5_7": "avg_weekday_f5_7", "AxleFactor": "axle_factor", "SU_Peak": "su_peak", "CU_PEAK": "cu_peak", "AvgKFactor": "avg_k_factor", "AvgDFactor": "avg_d_factor",
    "TruckAADT": "truck_aadt", "MORNING_HIGHEST_VALUE": "morning_highest_value", "AFTERNOON_HIGHEST_VALUE": "afternoon_highest_value", "EVENING_HIGHEST_VALUE": "evening_highest_value",
}
BRIDGE_COLUMNS = {
    "Carried": "carried", "Crossed": "crossed", "PrimaryOwn": "primary_owner", "PrimaryMai": "primary_maintainer", "GTMSStruct": "gtms_structure", "GTMSMateri": "gtms_material",
    "NumberOfSp": "number_of_spans", "ConditionR": "condition_rating", "BridgeLeng": "bridge_length", "DeckAreaSq": "deck_area_sq_ft", "AADT": "aadt", "YearBuilt": "year_built",
    "PostedLoad": "posted_load", "NBI_DeckCo": "nbi_deck_condition", "NBI_Substr": "nbi_substructure_condition", "NBI_Supers": "nbi_superstructure_condition", "FHWA_Condi": "fhwa_condition",
}
CULVERT_COLUMNS = {
    "Crossed": "crossed", "PrimaryOwn": "primary_owner", "PrimaryMai": "primary_maintainer", "GTMSStruct": "gtms_structure", "GTMSMateri": "gtms_material", "NumberOfSp": "number_of_spans",
    "ConditionR": "condition_rating", "TypeMaxSpa": "type_max_span", "YearBuilt": "year_built", "AbutmentTy": "abutment_type", "StreamBedM": "stream_bed_material",
    "Maintenanc": "maintenance_responsibility_primary", "AbutmentHe": "abutment_height", "CulvertSke": "culvert_skew", "OutToOutWi": "out_to_out_width", "SpanLength": "span_length",
    "StructureL": "structure_length", "GeneralRec": "general_recommendation", "REDC": "regional_economic_development_council",
}
STRATEGIC_DOMAIN, TRUCK_DOMAIN = "STRAHNET", "Tandem Truck Route"

Pull = Callable[[DataFrame], DataFrame]


def _named(df: DataFrame, names: dict[str, str], first: dict[str, str]) -> DataFrame:
    """``_idx_`` and the columns that there are, under the results' names."""
    have = {c.lower() for c in df.columns}
    return df.select("_idx_", *[F.col(c).alias(n) for c, n in (first | names).items() if c.lower() in have])


def counts(matches: DataFrame, events: DataFrame) -> DataFrame:
    """The latest count of each start measure (smallest ``dd_id``, then latest ``from_date``), and of these the longest overlap."""
    one = L.latest_count(L.overlap_join(matches, events))
    return _named(L.longest_overlap(one, ties=("from_measure",)), COUNT_COLUMNS, {"overlap_mi": "overlap_mi"})


def structures(found: DataFrame, number: str, names: dict[str, str]) -> DataFrame:
    """The structure of each match with the lowest condition rating; unrated ones come last."""
    return _named(L.lowest_rating(found, "ConditionR", ties=(number,)), names, {number: number})


def attribute_pulls(tables: dict[str, DataFrame]) -> dict[str, Pull]:
    """Pulls for ``linear_reference.conflate`` from the tables that there are.

    ``fclass`` (with ``fclass_types``), ``strategic`` and ``truck`` (with ``domains`` and ``domain_entries``), ``bridges`` (``bin``) and ``bridge_inventory``, ``culverts`` (``cin``, ``measure``) and
    ``culvert_inventory`` (both with ``bin``), ``counts`` (``dd_id, from_date``); event tables have ``event_route_id, from_measure, to_measure, to_date``.
    """
    t, out = tables, {}
    if "fclass" in t:
        out["fclass"] = lambda m: L.longest_overlap(L.functional_class(m, t["fclass"], t["fclass_types"]), ties=("functional_class",))
    if "strategic" in t:
        out["strategic"] = lambda m: L.longest_overlap(L.coded_overlaps(m, t["strategic"], "code", STRATEGIC_DOMAIN, t["domains"], t["domain_entries"]), ties=("code",))
    if "truck" in t:
        out["truck"] = lambda m: L.longest_overlap(L.coded_overlaps(m, t["truck"], "code", TRUCK_DOMAIN, t["domains"], t["domain_entries"]), ties=("code",))
    if "bridges" in t:
        out["bridge"] = lambda m: structures(L.structures_along(m, t["bridges"], t["bridge_inventory"], "bin"), "bin", BRIDGE_COLUMNS)
    if "culverts" in t:
        out["culvert"] = lambda m: structures(L.structures_at(m, t["culverts"], t["culvert_inventory"].withColumnRenamed("bin", "cin"), "cin"), "cin", CULVERT_COLUMNS)
    if "counts" in t:
        out["counts"] = lambda m: counts(m, t["counts"])
    return out
