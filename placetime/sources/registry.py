"""Named signals: a filter over one source table plus the columns that carry its id, date and place.  Filters are
trees (`predicates`); what a scan can test of them (comparisons, lists, null tests) is pushed down to it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from .predicates import All, FoldedOneOf, IsNull, Not, Predicate, any_token, as_predicate, matching, one_of


@dataclass(frozen=True)
class Signal:
    key: str
    table: str
    where: Predicate | Callable[[], Column]
    id_col: str
    date_col: str
    geo: tuple[str, ...] = ()            # ("lat", "long") columns or one point column
    name_col: str | None = None
    goal: str = "down"
    axis: str = "presence"
    settles: bool = False
    settle_months: int = 0
    distinct: bool = False
    citywide_only: bool = False
    group: str | None = None
    label: str = ""
    select: tuple[str, ...] = ()
    breaks: tuple[tuple[str, str], ...] = ()
    caveat: str | None = None
    components: tuple[tuple[str, Predicate], ...] = ()    # parts of a combined filter, to be audited one by one

    @property
    def filter(self) -> Predicate:
        return as_predicate(self.where)


@dataclass(frozen=True)
class Group:
    key: str
    members: tuple[str, ...]
    label: str = ""


@dataclass(frozen=True)
class Registry:
    signals: tuple[Signal, ...]
    groups: tuple[Group, ...] = field(default=())

    def __getitem__(self, key: str) -> Signal:
        return next(s for s in self.signals if s.key == key)

    def keys(self) -> list[str]:
        return [s.key for s in self.signals]

    def on(self, table: str) -> list[Signal]:
        return [s for s in self.signals if s.table == table]


def known(cond: Column) -> Column:
    """Two-valued form of a condition: unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def complement(gate: Predicate | Column, *classes: Predicate | Column) -> Predicate:
    """Rows of the gate in none of the classes, safe under null text."""
    return All((gate, *[Not(c) for c in classes]))


# -- fixed values: the filters of the named signals ----------------------------------------
COMMUNITY_CALL = one_of("onview_flag", "N", "HSOC")
NOT_DUPLICATE_CALL = IsNull("dup_cad_number")


def call_type(*types: str) -> Predicate:
    return All((one_of("call_type_final_desc", *types), COMMUNITY_CALL, NOT_DUPLICATE_CALL))


DRUG_CALL = All((
    one_of("call_type_final_desc", "SUSPICIOUS PERSON"), COMMUNITY_CALL,
    any_token(["call_type_original_notes", "call_type_final_notes"], fixed.DRUG_TOKENS),
))
ARREST_GATE = All((
    one_of("incident_category", "Drug Offense"), one_of("report_type_description", "Initial"),
    one_of("resolution", "Cite or Arrest Adult"),
))
DEALER_TEXT = any_token(["incident_description"], fixed.DEALER_TOKENS)
PARAPHERNALIA_TEXT = any_token(["incident_description"], ["PARAPHERNALIA"])


def service(*names: str) -> Predicate:
    return one_of("service_name", *names)


ENCAMPMENT_ONLY = service("Encampment", "Encampments")
HOMELESS_REQUEST = service("General Request") & any_token(["service_subtype"], ["homeless"], "lower")
ENCAMPMENT = ENCAMPMENT_ONLY | HOMELESS_REQUEST
CLEANING = service("Street and Sidewalk Cleaning")


def cleaning_detail(tokens: Sequence[str]) -> Predicate:
    return CLEANING & any_token(["service_details"], tokens, "lower")


NEEDLE_REQUEST = CLEANING & (
    (one_of("service_subtype", "garbage_and_debris") & one_of("service_details", "needles_less_than_20", "needles_20_or_more"))
    | (one_of("service_subtype", "Medical Waste") & one_of("service_details", "Needles"))
)
SHELTER_REQUEST = any_token(["service_subtype", "service_details"], fixed.SHELTER_TOKENS)


def subcategory(*names: str) -> Predicate:
    return one_of("incident_subcategory", *names)


def _calls(key: str, where: Predicate, **kw) -> Signal:
    return Signal(key, "raw_911", where, "cad_number", "received_datetime",
                  ("intersection_point",), "intersection_name", **kw)


def _requests(key: str, where: Predicate, **kw) -> Signal:
    return Signal(key, "raw_311", where, "service_request_id", "requested_datetime",
                  ("lat", "long"), "address", **kw)


def _reports(key: str, where: Predicate, date_col: str = "incident_datetime", **kw) -> Signal:
    return Signal(key, "raw_incidents", where, "incident_id", date_col,
                  ("latitude", "longitude"), "intersection", settles=True, **kw)


_ENCAMPMENT_PARTS = (("encampment_only", ENCAMPMENT_ONLY), ("unhoused_individual", HOMELESS_REQUEST))
_SPLIT_BREAK = (("2025-06", "request type split into two"),)

DRUG = Registry(
    (
        _calls("cfs_drug", DRUG_CALL, caveat="Calls whose notes name drugs; not every such call is about them.", label="Drug-activity calls"),
        _reports("dealer_arrests", ARREST_GATE & DEALER_TEXT, caveat="Counts enforcement: a rise can mean more effort.", goal="up",
                 axis="enforcement", distinct=True, settle_months=1, group="arrest_mix",
                 label="Dealer arrests"),
        _reports("paraphernalia", ARREST_GATE & PARAPHERNALIA_TEXT, caveat="Context only, no outcome.", goal="context",
                 axis="enforcement", distinct=True, settle_months=1, group="arrest_mix",
                 label="Paraphernalia arrests"),
        _reports("other_drug_arrests",
                 complement(ARREST_GATE, PARAPHERNALIA_TEXT, DEALER_TEXT),
                 goal="context", axis="enforcement", distinct=True, settle_months=1,
                 group="arrest_mix", label="Other drug arrests"),
        _requests("needles", NEEDLE_REQUEST, caveat="Depends on the reporting route; citywide only.", goal="context", distinct=True, citywide_only=True,
                  label="Needle requests"),
    ),
    (Group("arrest_mix", ("dealer_arrests", "paraphernalia", "other_drug_arrests"),
           "Drug arrests by kind"),),
)

UNHOUSED = Registry(
    (
        _requests("encampment", ENCAMPMENT, caveat="One request type was split into two in mid-2025; the union spans the split.", components=_ENCAMPMENT_PARTS, breaks=_SPLIT_BREAK,
                  label="Encampment and unhoused requests"),
        _requests("encampment_only", ENCAMPMENT_ONLY, caveat="Drops in mid-2025 because part of the type moved to another one.",
                  breaks=_SPLIT_BREAK, label="Encampment requests only"),
        _calls("cfs_sitlie", call_type("SIT/LIE ENFORCEMENT"), group="cfs_presence",
               label="Sit/lie calls"),
        _calls("cfs_homeless", call_type("HOMELESS COMPLAINT"), group="cfs_presence",
               label="Homeless-complaint calls"),
        _calls("hsoc", one_of("onview_flag", "HSOC") & NOT_DUPLICATE_CALL, caveat="Shows the response of the city, not the need.",
               goal="context", axis="response", label="Outreach responses"),
    ),
    (Group("cfs_presence", ("cfs_sitlie", "cfs_homeless"), "Presence calls"),),
)

DISTRICTS = Registry(
    (
        *UNHOUSED.signals,
        _requests("waste", cleaning_detail(["human", "urine", "fece"]), label="Human and animal waste requests"),
        _requests("needles", cleaning_detail(["needle", "syringe"]), label="Needle requests"),
    ),
)

STOPS = Registry(
    (
        UNHOUSED["encampment"],
        _requests("shelter_maint", SHELTER_REQUEST, label="Shelter maintenance requests"),
        _calls("cfs_presence", call_type("SIT/LIE ENFORCEMENT", "HOMELESS COMPLAINT"),
               label="Presence calls"),
        DRUG["cfs_drug"],
    ),
)

THEFT = Registry(
    (
        _reports("shoplifting", subcategory("Larceny Theft - Shoplifting"),
                 "incident_date", settle_months=1, label="Shoplifting"),
        _reports("commercial", subcategory("Burglary - Commercial", "Robbery - Commercial"),
                 "incident_date", settle_months=1, label="Commercial burglary and robbery"),
        _reports("vehicle", one_of("incident_category", "Motor Vehicle Theft"),
                 "incident_date", settle_months=1, label="Vehicle theft"),
    ),
)
RESOLUTION_AXES = {"reported": "Open or Active", "arrests": "Cite or Arrest Adult"}
LEGACY_THEFT_CODE = "Theft from Merchant or Library"

HOMEPAGE = Registry(
    (
        _reports("fraud", one_of("incident_category", "Fraud"), "incident_date", settle_months=2),
        _reports("dog_bites", one_of("incident_description", "Dog, Bite or Attack"),
                 "incident_date", settle_months=2),
        _reports("street_robbery", subcategory("Robbery - Street"), "incident_date",
                 settle_months=2),
    ),
)

_PRESENCE_CALLS = ("SIT/LIE ENFORCEMENT", "BLOCKED SIDEWALK", "HOMELESS COMPLAINT")
LEVERS: dict[str, tuple[Signal, ...]] = {
    "drug": (replace(DRUG["cfs_drug"], id_col=""),),       # this lever keeps every row
    "overflow": (_requests("overflow", cleaning_detail(fixed.OVERFLOW_TOKENS),
                           breaks=(("2025-11-01", "sensor reports end"),)),),
    "dumping": (_requests("dumping", cleaning_detail(fixed.DUMPING_TOKENS)
                          | (CLEANING & FoldedOneOf("service_subtype", ("bulky items",)))),),
    "hazard": (_requests("hazard", cleaning_detail(fixed.HAZARD_TOKENS)),),
    "homeless_presence": (
        _calls("homeless_presence", call_type(*_PRESENCE_CALLS)),
        _requests("homeless_presence", service("Encampment", "Encampments")),
    ),
    "mental_health": (_calls("mental_health",
                             call_type("MENTALLY DISTURBED", "MENTALLY DIST CRIT")),),
    "medical_emergencies": (
        Signal("medical_emergencies", "raw_ems",
               All((one_of("call_type", "Medical Incident"), one_of("call_type_group", "Potentially Life-Threatening"),
                    one_of("unit_sequence_in_call_dispatch", 1))),
               "call_number", "received_dttm", ("case_location",), "address"),
    ),
    "encampments": (_requests("encampments", ENCAMPMENT),),
    "graffiti": (_requests("graffiti",
                           service("Graffiti", "Graffiti Public", "Graffiti Private")),),
    "noise": (_requests("noise", service("Noise Report", "Noise")),),
    "lighting": (_requests("lighting", service("Streetlights")),),
    "shoplifting": (_reports("shoplifting", subcategory("Larceny Theft - Shoplifting"),
                             settle_months=2),),
    "street_robbery": (_reports("street_robbery", subcategory("Robbery - Street"),
                                settle_months=2),),
    "commercial_burglary": (_reports("commercial_burglary",
                                     subcategory("Burglary - Commercial"),
                                     settle_months=2),),
}


def tag_signals(events: DataFrame, tags: Mapping[str, Predicate | Column]) -> DataFrame:
    """One pass over events: a row per (event, matching signal), key in column `signal`."""
    return matching(events, {k: as_predicate(c) for k, c in tags.items()}, "signal")


def known_breaks(levers: dict[str, tuple[Signal, ...]] | None = None) -> list[tuple[str, str, str]]:
    """(lever, date, label) of every reporting change that the levers' signals carry."""
    return sorted({(lever, date, label) for lever, signals in (levers or LEVERS).items() for s in signals for date, label in s.breaks})
